"""Operators on small tables with odd rows: nulls, empty and repeated texts, clashing columns, nothing at all."""

from __future__ import annotations

import math
import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from clausediff.llm import decontaminate, hashing, jaccard, line_dedup, mixing, pii, substrings, token_files, vectors
from clausediff.llm.components import connected_components
from clausediff.llm.queries.op3 import default_tokenizer
from clausediff.llm.storage import new_folder

RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(4000)]


def prose(n: int) -> str:
    return " ".join(RNG.choices(WORDS, k=n))


LONG, PASSAGE = prose(300), prose(70)
COPY = LONG.split()
COPY[150] = "other"
TEXTS = [LONG, LONG, " ".join(COPY), None, "", "  \n ", "one two", "ONE two", prose(40) + " " + PASSAGE + " " + prose(30), prose(90) + " " + PASSAGE, prose(120), "mail a.b@c.de now", "x" * 60_000]
SCHEMA = "doc_id long, text string, source string, copy int, block string, h1 string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 4}" if i != 5 else None, 9, "b", "h", "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, LONG, "s1", 1, "b", "h", "k")], SCHEMA).repartition(3)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(7, 7), (None, 3), (100, 90), (90, 100)], "a long, b long")
    assert {r.id: r.component for r in connected_components(links).collect()} == {**dict.fromkeys(range(51), 0), 90: 90, 100: 90}
    assert {r.id: r.component for r in connected_components(links, one_task=3).collect()} == {**dict.fromkeys(range(51), 0), 90: 90, 100: 90}
    assert connected_components(links.limit(0)).count() == 0 == connected_components(links.limit(0), one_task=-1).count()


def test_jaccard_components(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, 4, 85).collect()}
    assert got[0] == got[1] == (297, 0) and got[2][1] == 0 and got[6] == (1, 6) and got[7] == (1, 6)
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5) and got[None][1] is None and got[10][1] == 10
    kept = sorted((r.doc_id is None, r.doc_id) for r in jaccard.drop_near_copies(docs).select("doc_id").collect() if r.doc_id is not None)
    assert [i for _, i in kept] == [0, 0, 3, 4, 5, 6, 8, 9, 10, 11, 12]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("salted", [False, True])
def test_large_components_are_cut_down_and_blocked(spark, monkeypatch, salted):
    for name, value in (("LARGE", 3), ("PARITY_BLOCK", 4), ("BLOCK_DOCS", 4), ("HUB_ROWS", 5), ("HUBS", 2), ("HELD", 500), *((("BROADCAST_ROWS", 0), ("SALTS", 3)) if salted else ())):
        monkeypatch.setattr(jaccard, name, value)
    base = prose(60).split()
    texts = []
    for i in range(24):
        own = list(base)
        for j in range(i % 5):
            own[(7 * i + 11 * j) % 60] = f"edit{i}-{j}"
        texts.append(" ".join(own + base[: 3 * (i % 4)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for t in texts]
    label = list(range(24))
    for _ in range(24):
        for a in range(24):
            for b in range(24):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert [r.component_id for r in jaccard.jaccard_components(df, 3, 80).orderBy("doc_id").collect()] == label


def test_candidates_lose_no_link_and_a_shared_passage_makes_none(spark):
    rng = random.Random(21)
    some = lambda n: [f"c{rng.randrange(10**9)}" for _ in range(n)]
    passage = some(60)
    rows = [" ".join(some(rng.randrange(120, 200)) + passage + some(40)) for _ in range(150)]
    assert jaccard.candidate_links(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), 5, 80).count() == 0
    for size in (1, 2, 4, 5, 7, 12, 30, 90, 300):
        for _ in range(12):
            base = some(size + 3)
            rows += [" ".join(base)] + [" ".join(base[rng.randrange(0, 2 + size // 12) :] + some(rng.randrange(0, 2 + size // 12))) for _ in range(4)]
    own = [{tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} for w in map(str.split, rows)]
    near = {(a, b) for a in range(150, len(own)) for b in range(max(150, a - 4), a) if 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])}
    label = list(range(len(own)))
    for _ in range(4):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert len(near) > 100 and [r.component_id for r in jaccard.jaccard_components(df, 4, 85).orderBy("doc_id").collect()] == label


def test_sets_that_share_half_with_each_of_two_others_are_no_candidates(spark):
    halves = [prose(100) for _ in range(60)]
    df = spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate(zip(halves, halves[1:]))], "doc_id long, text string")  # noqa: B905
    assert jaccard.candidate_links(df, 5, 80).count() == 0


def test_texts_that_are_not_asked_for_stay_out_of_a_shuffle(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "id * 7 as t", "'a' as text")
    got = {r.doc_id for r in jaccard.maybe_among(docs, docs.where("doc_id % 100 = 0")).collect()}
    assert got >= set(range(0, 4000, 100)) and len(got) < 60 and jaccard.maybe_among(docs, docs.limit(0)).count() == 0


def test_texts_that_surely_stay_are_not_shuffled(spark):
    rng = random.Random(15)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(600)), i) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, rows[7][1], 300), (None, rows[7][1], 301)], "doc_id long, text string, piece long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if those that go were many
    try:
        out = jaccard.drop_near_copies(docs)
        spark.sparkContext.setJobGroup("texts-stay", "")
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.columns == docs.columns and sorted(r.piece for r in got) == [*range(300), 301]
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup("texts-stay") for s in tracker.getJobInfo(job).stageIds}
    assert sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages) < sum(len(t) for _, t, _ in rows) / 20


def test_rows_of_one_id_have_the_links_of_all_their_texts(spark):
    a, b = prose(100), prose(100)
    rows = [(1, a), (1, b), (2, a + " more"), (3, "more " + b), (4, prose(100)), (4, prose(90)), (5, prose(80))]
    got = sorted(map(tuple, jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()))
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5)]


def test_repeated_passages(docs):
    got = substrings.repeated_passages(docs).collect()
    assert {(8, 9), (9, 8)} & {(r.doc_id, r.ref_doc_id) for r in got}
    linked = {x for r in got for x in (r.doc_id, r.ref_doc_id)}
    assert linked == {0, 1, 2, 8, 9}
    row = next(r for r in got if {r.doc_id, r.ref_doc_id} == {8, 9})
    assert row.n_words >= 70 and row.similarity == 1.0
    assert substrings.repeated_passages(docs.limit(0)).count() == 0


def test_passages_with_words_inserted_and_deleted(spark):
    rng = random.Random(11)
    some = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(60):
        words = some(102)
        other = list(words)
        other[68 : 68 + i % 2] = some(1 - i % 2)
        other[34:34] = some(1)
        rows += [(2 * i, " ".join(some(40) + words + some(30))), (2 * i + 1, " ".join(some(30) + other + some(40)))]
    got = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.doc_id // 2 == r.ref_doc_id // 2 and r.n_words >= 50 and r.similarity >= 0.8 for r in got)
    assert len({r.doc_id // 2 for r in got}) >= 58  # a passage of similarity 0.8 is missed with a chance of 0.006


def holds_a_passage(words: list[int], other: list[int]) -> bool:
    """Whether some 50 words or more of one agree with as many of the other: brute force over all ranges; words differ from each other."""
    place = {tuple(other[i : i + 5]): i for i in range(len(other) - 4)}
    spots = np.array([place.get(tuple(words[i : i + 5]), -1) for i in range(len(words) - 4)])
    for a in range(len(spots) - 45):
        for b in range(a + 46, len(spots) + 1):
            js = spots[a:b][spots[a:b] >= 0]
            if len(js) * 10 >= 8 * (b - a) and (q := max(46, int(js.max() - js.min()) + 1)) <= len(other) - 4 and 10 * len(js) >= 8 * (b - a + q - len(js)):
                return True
    return False


def test_recall_of_near_passages(spark):
    """Passages of 50 to 120 words with up to two words replaced and one inserted: of those that brute force finds, 0.9 at least in every cell."""
    rng = random.Random(13)
    some = lambda n: [rng.randrange(10**9) for _ in range(n)]
    told = lambda words: " ".join(f"z{w}" for w in words)
    rows, cells = [], {}
    for n in (50, 60, 80, 120):
        for replaced in (0, 1, 2):
            for inserted in (0, 1):
                for _ in range(20):
                    words = some(n)
                    other = list(words)
                    for at in rng.sample(range(n), replaced):
                        other[at] = some(1)[0]
                    if inserted:
                        other.insert(rng.randrange(1, n), some(1)[0])
                    if holds_a_passage(words, other):
                        i = len(rows)
                        rows += [(i, told(some(40) + words + some(30))), (i + 1, told(some(25) + other + some(45)))]
                        cells.setdefault((n, replaced, inserted), []).append(i)
    got = {frozenset((r.doc_id, r.ref_doc_id)) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(max(pair) - min(pair) == 1 and min(pair) % 2 == 0 for pair in got)
    recall = {cell: sum(frozenset((i, i + 1)) in got for i in own) / len(own) for cell, own in cells.items()}
    print("\n".join(f"{n} words, {r} replaced, {i} inserted: {recall[n, r, i]:.2f} of {len(cells[n, r, i])}" for n, r, i in sorted(recall)))
    assert len(recall) >= 14 and all(x >= 0.9 for cell, x in recall.items() if len(cells[cell]) >= 10) and sum(len(c) for c in cells.values()) > 250


def test_chains_of_overlapping_passages(spark):
    rng = random.Random(12)
    some = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(40):  # the first and the third share 49 words only
        whole = some(300)
        for j, words in enumerate((whole[:200], whole, whole[151:201 + i % 4])):
            rows.append((3 * i + j, " ".join(some(30) + words + some(30))))
    got = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    linked = {frozenset((r.doc_id, r.ref_doc_id)) for r in got}
    assert all(frozenset((3 * i + j, 3 * i + 1)) in linked for i in range(40) for j in (0, 2))


def test_windows_that_a_leader_does_not_cover_stay():
    n = substrings.FEW + 4
    v, around, doc = np.zeros(n, np.int64), np.full(n, 7 << 32, np.int64), np.arange(n)
    lo, hi = np.full(n, 100), np.full(n, 140)  # around 120, all within the first but two, which reach further on a side
    lo[0], hi[0], hi[-1], hi[-2] = 0, 150, 200, 190
    found, needed = substrings.pair_up(v, around, doc, np.full(n, 120), substrings._reaches(lo, 120, hi), 36)
    links = {frozenset(r[:2].tolist()) for r in found}
    assert frozenset((n - 1, n - 2)) in links and needed[[0, n - 1]].all() and needed.sum() == 2
    assert all(frozenset((0, i)) in links for i in range(1, n))


def test_a_common_phrase_hides_no_passage(spark):
    """A phrase of 35 words with the least shingles of all texts, under every hash function: pairs of texts that share 59 words around it are found, not only links with the longest text."""
    rng = random.Random(17)
    some = lambda n: [f"y{rng.randrange(10**9)}" for _ in range(n)]
    phrase: list[str] = []
    for seed in (substrings._SIDE, *substrings._SEEDS, substrings._SIDE):
        tried = some(100_000)
        data = " ".join(tried).encode()
        grams = substrings.shingle_hashes(hashing.word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0], 5)
        at = int((hashing.mix(grams ^ seed) >> np.uint64(25)).argmin())
        phrase += tried[at : at + 5]
    rows = [(1000, " ".join(some(900) + phrase + some(900)))]
    for i in range(30):
        before, after = some(12), some(12)
        other = list(before)
        other[i % 12] = some(1)[0] if i % 2 else other[i % 12]
        rows += [(2 * i + j, " ".join(some(150) + words + phrase + after + some(150))) for j, words in enumerate((before, other))]
    got = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {frozenset((r.doc_id, r.ref_doc_id)) for r in got} == {frozenset((2 * i, 2 * i + 1)) for i in range(30)}
    assert all(r.n_words >= 50 and r.similarity >= 0.8 for r in got)


def test_a_pair_of_words_said_over_and_over_makes_few_candidates(spark):
    """Each return of a shingle in a run is the least of a window: the rows for a document don't grow by one for each of them."""
    rng = random.Random(18)
    some = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    tails = [some(40) for _ in range(20)]
    rows = [(i, " ".join(some(60) + ["over", "again"] * 200 + tails[i // 2] + some(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert substrings.candidate_pairs(df).count() <= 40 * 40
    got = substrings.repeated_passages(df).collect()
    label = substrings.merged(np.arange(40), *(np.array([r[k] for r in got]) for k in (0, 1)))
    assert (label == 0).all() and all(r.n_words >= 50 and r.similarity >= 0.8 for r in got)
    assert all(any({r.doc_id, r.ref_doc_id} == {2 * i, 2 * i + 1} and r.n_words >= 440 for r in got) for i in range(20))  # the whole run and the tail that two of them share


def test_decontamination(spark, docs):
    item = PASSAGE.split()[:20]
    item[6], item[13] = "changed", "too"
    bench = spark.createDataFrame([(1, " ".join(item), 5), (2, "Never, seen; words", 5), (3, None, 5), (4, "one TWO", 5), (4, "one TWO", 5)], "item_id long, text string, doc_id int")
    got = sorted((r.doc_id, r.item_id, r.start, r.matched, r.n_item) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(6, 4, 0, 2, 2), (7, 4, 0, 2, 2), (8, 1, 40, 18, 20), (9, 1, 90, 18, 20)]
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 4
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_short_items_with_replaced_tokens(spark):
    items, rows = [], []
    for n in range(3, 13):
        item = [f"n{n}t{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        for bad in combinations(range(n), n - math.ceil(0.8 * n)):
            rows.append((n, " ".join(["a", "b", *("z" if j in bad else w for j, w in enumerate(item)), "c"])))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.start) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, n, 2) for i, (n, _) in enumerate(rows)}


def test_line_dedup(spark):
    rows = [(i, f"only {i}\n  shared line \nhalf {i % 2}\n", f"s{i}", 1) for i in range(12)] + [(20, None, "s1", 1), (21, "", "s1", 1), (22, "shared line", None, 1), (22, "shared line", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h1 int")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_shared_lines(df, 8).collect()}
    assert got[3] == ("only 3\nhalf 1\n", 3, 1) and got[20] == (None, 0, 0) and got[21] == ("", 0, 0) and got[22] == ("", 1, 1)
    assert line_dedup.remove_shared_lines(df, 6).where("doc_id = 3").first().text == "only 3\n"
    assert line_dedup.remove_shared_lines(df.limit(0), 8).count() == 0


def test_mixing(spark):
    rows = [(i, "a" * 99, "big" if i % 10 else "small", 5) for i in range(4000)] + [(9000, None, None, 5), (9001, "", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")
    mixed = mixing.mix(df, {"big": 1.0, "small": 1.0})
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(counts["big"] / 2000 - 1) < 0.1 and abs(counts["small"] / 2000 - 1) < 0.15 and None not in counts
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(df.repartition(7), {"big": 1.0, "small": 1.0}).collect()))
    large = spark.createDataFrame([(i, "a", "one" if i else "two") for i in range(3000)], "doc_id long, text string, source string")
    assert abs(mixing.mix(large).where("source = 'two'").count() / 1500 - 1) < 0.2  # a mean of many parts
    assert mixing.mix(df.limit(0)).count() == 0


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = default_tokenizer()
    corpus = token_files.write_token_files(docs.where("doc_id is not null"), new_folder(spark, "t"), path)
    tokenizer, start = Tokenizer.from_file(path), 0
    got = token_files.read_token_files(spark, corpus).orderBy("start").collect()
    for place, (i, r) in enumerate(zip([0, *range(len(TEXTS))], got, strict=True)):
        ids = [*tokenizer.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert token_files.token_ids(corpus, place).tolist() == ids
        start += len(ids)
    empty = token_files.write_token_files(docs.limit(0), new_folder(spark, "t"), path)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    path = default_tokenizer()
    encoder, tokenizer, rng = token_files.Encoder(path, 2), Tokenizer.from_file(path), random.Random(1)
    odd = ["<|endoftext|>", "don't", "İstanbul", "ΟΔΟΣ", "é", "\x1c", "\x85", "　", "²a", "ﬁn", "x.", "Ab,", " ", "\n", "9", "_", "-"]
    for _ in range(3000):
        t = "".join(rng.choice(odd) for _ in range(rng.randrange(0, 9)))
        assert encoder.encode([t])[0] == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes(), repr(t)


def test_a_word_is_kept_once_and_not_encoded_again(monkeypatch):
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrstvz"]
    entries = len(words) * 2 + 2  # alone, with a comma or a stop, and these
    monkeypatch.setattr(token_files, "CACHE", entries * (token_files.ENTRY + 4))
    encoder, asked = token_files.Encoder(default_tokenizer(), 2), []
    own = encoder._encode
    encoder._encode = lambda texts: asked.extend(texts) or own(texts)
    for _ in range(3):
        got = [encoder.encode([" ".join(words[i::2]) + " " + " ".join(f"{w}{',.'[i]}" for w in words[i::2])])[0] for i in (0, 1)]
    assert len(asked) == len(set(asked)) == len(words) + 2 and encoder.held <= token_files.CACHE
    assert got == own([" ".join(words[i::2]) + " " + " ".join(f"{w}{',.'[i]}" for w in words[i::2]) for i in (0, 1)])


def test_columns_encode_as_whole_texts_with_few_calls():
    from tokenizers import Tokenizer

    path, rng = default_tokenizer(), random.Random(2)
    letters = ["abcdefghijklmnopqrstuvwxyz", "abcäöüßéêσςñ", "дежзиклмн", "ABCdef"]
    words = ["".join(rng.choices(letters[i % 4], k=rng.randrange(1, 12))) for i in range(4000)]
    odd = ["\x1c", "\x85", "\u3000", "Σ", "İ", "don't", "a1b", "e\u0301", "--", "ﬁn", "\u1cff", "<|endoftext|>", "\U0001df00x"]
    texts = [" ".join(rng.choice(odd) if rng.random() < 0.1 else rng.choice(words) + rng.choice(["", "", ",", "!!"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts = [*texts, None, "", "  ", " a ", "\x1d"]
    encoder, tokenizer, calls = token_files.Encoder(path, 2), Tokenizer.from_file(path), []

    class Counted:
        def __init__(self, own):
            self.own = own

        def encode_batch_fast(self, some, **options):
            calls.extend(some)
            return self.own.encode_batch_fast(some, **options)

    encoder.tokenizer, encoder.plain = Counted(encoder.tokenizer), Counted(encoder.plain)
    got, sizes = encoder.encode_column(token_files.pa.array(["left out", *texts]).slice(1), b"\2\0")
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and got.tolist() == [i for w in want for i in w]
    assert len(calls) < 400  # a word alone takes longer than one among others


def test_words_before_any_punctuation_are_kept_once():
    from tokenizers import Tokenizer

    path = default_tokenizer()
    encoder, tokenizer = token_files.Encoder(path, 2), Tokenizer.from_file(path)
    words = ["plain", "Élan", "straße", "дом", "\u0958", "q\u0958", "\ufb2a", "İ", "ς", "\u212b"]
    texts = [w + rest for w in words for rest in ("", ",", "###", "'", "_<>", "`=!", "'s", "<|endoftext|>")]
    assert encoder.encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert "straße" in encoder.pieces and not {"plain###", "straße,", "Élan_<>", "élan_<>"} & encoder.pieces.keys()


_FRESH_WORDS = """
import re, sys
sys.path[:] = {path!r}
import pyarrow as pa
from clausediff.llm import token_files
from clausediff.llm.queries.op3 import default_tokenizer

def peak():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def word(n):
    return "".join(chr(97 + n * 7919 // 26**i % 26) for i in range(7))

encoder = token_files.Encoder(default_tokenizer(), 2)
columns = [pa.array([" ".join(map(word, range(a + b, a + b + 400))) for b in range(0, 400_000, 400)]) for a in (0, 400_000)]
before = peak()
for texts in columns:
    for _ in token_files.encoded(encoder, texts, b"\\2\\0"):
        pass
print(peak() - before)
"""


def test_a_worker_stays_small_whatever_words_come():
    import subprocess
    import sys

    ran = subprocess.run([sys.executable, "-c", _FRESH_WORDS.format(path=sys.path)], capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr
    assert float(ran.stdout) < 220  # MB beyond the tokenizer and 6 MB of texts; about 150, and 384 with all texts of a column split at once


def test_texts_come_to_the_encoder_in_small_batches(spark):
    def sized(batches):
        for batch in batches:
            yield token_files.pa.record_batch([token_files.pa.array([batch.nbytes] * batch.num_rows, token_files.pa.int64()), batch.column(0)], names=["doc_id", "text"])

    long = spark.range(0, 400, 1, 1).selectExpr("repeat('some words ', 3000 + id % 2) as text").mapInArrow(sized, "doc_id long, text string")
    corpus = token_files.write_token_files(long, new_folder(spark, "t"), default_tokenizer(), by_id=False)
    assert token_files.read_token_files(spark, corpus).agg({"doc_id": "max"}).first()[0] < 5 << 20 < 400 * 33_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "4m"


def test_the_shards_table_needs_no_python_workers_of_its_own(spark, tmp_path):
    corpus = token_files.Corpus(str(tmp_path), 2, [("00000", 0, 1, 1), ("00001", 1, 1, 1)])
    for some in (corpus, corpus._replace(shards=[])):
        plan = token_files.read_token_files(spark, some)._jdf.queryExecution().optimizedPlan().toString()
        assert "ExternalRDD" not in plan and "LogicalRDD" not in plan and ("LocalRelation" in plan or not some.shards), plan


def test_near_vectors_recall_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 32))
    x[300:] = x[:300] + np.linspace(0.05, 0.6, 300)[:, None] * rng.standard_normal((300, 32))
    x[590] = x[10]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] * 32, 1), (904, [1.0], 1), (905, [], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cell int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want, have = near.sum(1), np.array([got[i].n_links for i in range(600)])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum()
    assert got[590].component_id == 10 and not got[590].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906)) and got[None].component_id is None
    assert vectors.near_vectors(df.limit(0)).count() == 0 and vectors.near_vectors(df.where("vec_id = 900")).count() == 1


def test_pii_columns(docs):
    net = pii.train_tagger([])
    found = {r.doc_id: r for r in pii.find_pii(docs, net).collect()}
    assert [(s.kind, s.start, s.end, s.base) for s in found[11].pii] == [("email", 5, 13, True)] and found[3].pii == [] and found[12].pii == []
    report = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    none = pii.sha256([])
    assert report[11].n_email == 1 and report[11].base_sha256 == pii.sha256([(5, 13, 0)]) and all(report[i].base_sha256 == none and report[i].spans == "" for i in (3, 4, 5))
    assert pii.pii_report(docs.limit(0)).count() == 0
    blank = pii.pii_report(docs.where("text is null")).collect()
    assert [(r.doc_id, r.n_email + r.n_ip + r.n_card + r.n_phone, r.spans, r.base_sha256) for r in blank] == [(3, 0, "", none)]
