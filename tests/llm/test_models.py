"""Trained operators: accuracy on the fold that is held out, and the whole pipeline."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from clausediff.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "least"), [("op5_toxicity", "toxic", 0.95), ("op7_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries()[query](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in known) >= least * len(known)


def test_trained_operators_without_labels_and_rows(spark):
    from clausediff.llm.quality import quality_report
    from clausediff.llm.toxicity import toxicity_report

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "text")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, None, None)], "doc_id long, quality int, toxic int")
    for report in (quality_report, toxicity_report):
        assert sorted(r.doc_id for r in report(docs, labels, 0.5).collect()) == [1, 2, 3]
        assert report(docs.limit(0), labels.limit(0), 0.5).count() == 0
    rows = [(i, ("vile word " if i % 2 else "kind word ") * 9, i % 2, 0.5, "e", True, i) for i in range(40)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, y int, score double, evidence string, held_out boolean, id long")
    labels = spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id long, quality int, toxic int")
    for report in (quality_report, toxicity_report):  # columns of clashing names, ties, and a row that is there twice
        got = report(docs, labels, 0.5).collect()
        assert len(got) == 41 and len({(r.doc_id, round(r.score, 6)) for r in got}) == 40
    assert len({round(r.score, 6) for r in got}) == 2 and all(r.predicted == r.doc_id % 2 for r in got)


def test_pipeline_end_to_end(spark):
    """Every stage on what its predecessor kept, against plain restatements of what it must do."""
    import corpus_pipeline
    from clausediff.llm.queries.op3 import default_tokenizer
    from clausediff.llm.storage import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, rows = [docs], [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], SF), f"test-{name}"))
        rows.append(kept[-1].collect())
        assert kept[-1].columns == docs.columns, name
    good, single, clean, mixed = rows[1:]
    known = [r for r in rows[0] if labels.get(r.doc_id) is not None]
    stayed = {r.doc_id for r in good}
    assert sum((r.doc_id in stayed) == labels[r.doc_id] for r in known) >= 0.9 * len(known)

    def shingles(text):
        words = text.translate({c: c + 32 for c in range(65, 91)}).split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    left = {r.doc_id for r in single}
    sets = {r.doc_id: shingles(r.text) for r in good}
    near = lambda a, b: bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    for r in good:  # who went has a near copy of a smaller id or one that went for another
        if r.doc_id not in left:
            assert any(o < r.doc_id and near(sets[r.doc_id], s) for o, s in sets.items()) or any(o != r.doc_id and o not in left and near(sets[r.doc_id], s) for o, s in sets.items())
    some = sorted(left)
    assert not any(near(sets[a], sets[b]) for x, a in enumerate(some) for b in some[:x] if 0.7 < (len(sets[a]) + 1) / (len(sets[b]) + 1) < 1.5)
    stays = {r.doc_id for r in clean}
    leaks = {r.doc_id for r in single if any(b in r.text for b in bench)}
    assert leaks and not leaks & stays and len(stays) >= 0.9 * (len(left) - len(leaks))
    mass = lambda part: sum(len(r.text) + 1 for r in part)
    assert {r.doc_id for r in mixed} <= stays and abs(mass(mixed) / mass(clean) - 1) < 0.35
    # the files: the mixed rows, all of them, as they come, with copies apart
    got = sorted(corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    tokenizer, text = Tokenizer.from_file(default_tokenizer()), {r.doc_id: r.text for r in clean}
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in mixed)
    ids = [r.doc_id for r in got]
    again = sum(a == b for a, b in zip(ids, ids[1:], strict=False))
    assert ids != sorted(ids) and again < 0.1 * (len(ids) - len(set(ids)) + 20)
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    for r in got[:50]:
        own = [*tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.n_tokens, r.ids_crc32) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()))


def test_pipeline_of_nothing(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_every_operator_has_a_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and set(oracle_sql()) <= set(queries()) < set(names)
