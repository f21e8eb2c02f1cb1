"""Queries that SQL cannot express, against plain restatements over the whole of a small table."""

from __future__ import annotations

import html
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from test_functions import plain_sentences

from clausediff.plans import adapter, queries
from clausediff.plans.compare import compare_units
from clausediff.schema import QUOTES_AND_DASHES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    made = compare_units(adapter.units(spark, SF)).persist()
    yield made
    made.unpersist()


@pytest.fixture(scope="module")
def sections(whole):
    return {(r.pair_id, r.side, r.order_index): r for r in whole.sections.collect()}


@pytest.fixture(scope="module")
def matched(whole):
    return {(r.pair_id, r.old_index, r.new_index) for r in whole.matches.collect()}


@pytest.fixture
def shared(whole, monkeypatch):
    """Queries of one comparison, made once."""
    monkeypatch.setattr(queries, "comparison", lambda *_: whole)


def key(text: str) -> str:
    text = re.sub(r"(?<=[^\W\d_])-\n(?=[^\W\d_])", "", text)
    return re.sub(r"\s+", " ", "".join(QUOTES_AND_DASHES.get(c, c) for c in text))


def plain_steps(a: list, b: list) -> list[tuple]:
    out = []
    for op, i1, i2, j1, j2 in SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
        k = min(i2 - i1, j2 - j1) if op in ("equal", "replace") else 0
        out += [(op, i1 + x, j1 + x) for x in range(k)] + [("delete", i, None) for i in range(i1 + k, i2)] + [("insert", None, j) for j in range(j1 + k, j2)]
    return out


def plain_diff(old: str, new: str) -> list[tuple]:
    a, b = ([s for *_, s in plain_sentences(t)] for t in (old, new))
    return [(op, None if i is None else a[i], None if j is None else b[j]) for op, i, j in plain_steps([key(s) for s in a], [key(s) for s in b])]


def test_sentence_split(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: dict[int, list] = {i: [] for i in texts}
    for r in sorted(queries.sentence_split(spark, SF).collect()):
        got[r.doc_id].append((r.start, r.end, r.text))
    assert got == {i: plain_sentences(t or "") for i, t in texts.items()}


def test_sentence_diff(spark, shared, sections, matched):
    got: dict[tuple, list] = {m: [] for m in matched}
    for r in sorted(queries.sentence_diff(spark, SF).collect(), key=lambda r: r.diff_no):
        got[r.pair_id, r.old_index, r.new_index].append((r.op, r.old_text, r.new_text))
    for (p, i, j), steps in got.items():
        assert steps == plain_diff(sections[p, "old", i].body, sections[p, "new", j].body)


def test_word_diff(spark, shared, sections, matched):
    got: dict[tuple, list] = {}
    for r in sorted(queries.word_diff(spark, SF).collect(), key=lambda r: r.word_no):
        got.setdefault((r.pair_id, r.old_index, r.new_index, r.diff_no), []).append((r.op, r.old_words, r.new_words))
    want = {}
    for p, i, j in matched:
        for n, (op, a, b) in enumerate(plain_diff(sections[p, "old", i].body, sections[p, "new", j].body)):
            if op == "replace":
                x, y = a.split(), b.split()
                want[p, i, j, n] = [(o, " ".join(x[i1:i2]), " ".join(y[j1:j2])) for o, i1, i2, j1, j2 in SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes()]
    assert got == want


def test_seq_similarity(spark, shared, sections, matched):
    got = {(r.pair_id, r.old_index, r.new_index): r.similarity for r in queries.seq_similarity(spark, SF).collect()}
    assert set(got) == matched
    for (p, i, j), similarity in got.items():
        a, b = (key(sections[p, s, k].body).split() for s, k in (("old", i), ("new", j)))
        assert similarity == pytest.approx(SequenceMatcher(None, a, b).ratio(), abs=1e-6)


def test_rows_html(spark, shared, whole, sections):
    rows = {(r.pair_id, r.row_idx): r for r in whole.brief.collect()}
    got = queries.rows_html(spark, SF).collect()
    assert len(got) == len(rows)
    plain = lambda h: "".join(html.unescape(re.sub(r"<[^>]*>", "", h)).split())
    told = lambda s: "".join(s.split())
    for r in got:
        row = rows[r.pair_id, r.row_idx]
        old, new = (sections[r.pair_id, s, getattr(row, s).order_index].body if getattr(row, s) else "" for s in ("old", "new"))
        # without its marks each side is its text, and marks stand where the sides differ
        assert plain(r.old_html) == told(old) and plain(r.new_html) == told(new)
        assert ("mk-diff" in r.old_html or "mk-diff" in r.new_html) == (row.change_type != "IDENTICAL")
        assert f"MADDE {(row.old or row.new).madde_no} — {html.escape((row.old or row.new).baslik)}" in r.html and f"mk-badge-{row.change_type.lower()}" in r.html
        assert r.html.count("(karşılığı yok)") == (row.old is None) + (row.new is None)


def test_rows_html_keeps_each_text_once(spark):
    assert queries.rows_html(spark, "/root/testdata/sf0.001").count()
    made = queries._kept[-1]
    assert made.sections.storageLevel.useDisk and not made.sections.where("size(units) > 0").count()
    assert not made.sentence_diffs.storageLevel.useDisk and set(made.shown.schema["old"].dataType.names).isdisjoint({"units"})


def test_embedding_assignment(spark):
    """No cycle of exchanges gains anything: the assignment has the greatest total."""
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got: dict[int, set] = {}
    for r in queries.embedding_assignment(spark, SF).collect():
        got.setdefault(r.pair_id, set()).add((r.old_index, r.new_index))
    rows, vectors = queries._vector_rows(spark, SF)
    from clausediff.operators import match

    every: dict[int, dict] = {}
    for r in match.match_by_vectors(*match.sides(rows), vectors, -2.0).collect():
        every.setdefault(r.pair_id, {})[r.old_index] = r.new_index
    for pair in {i // 32 for i in v}:
        own = [[v[i] for i in range(pair * 32 + s, pair * 32 + 32, 2) if i in v] for s in (0, 1)]
        unit = [np.array([x / np.linalg.norm(x) for x in part]).reshape(len(part), -1) for part in own]
        if not all(map(len, own)):
            continue
        cosine = unit[0] @ unit[1].T
        chosen = every[pair]
        assert len(chosen) == min(cosine.shape)
        assert got.get(pair, set()) == {(i, j) for i, j in chosen.items() if cosine[i, j] >= 0.2}
        # Bellman and Ford over old sections: i may take the place of k; and free places may be taken
        n = cosine.shape[0]
        gain = np.full((n, n), -np.inf)
        for i in range(n):
            for k in chosen:
                if i in chosen and i != k:
                    gain[i, k] = cosine[i, chosen[k]] - cosine[i, chosen[i]]
        best = np.zeros(n)
        for _ in range(n + 1):
            step = (best[:, None] + gain).max(0)
            if (step <= best + 1e-9).all():
                break
            best = np.maximum(best, step)
        else:
            raise AssertionError(f"pair {pair}: a cycle gains")
