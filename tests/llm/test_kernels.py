"""Kernels of the operators against brute force; no session is needed."""

from __future__ import annotations

import random
import re
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest

from clausediff.llm import hashing, jaccard, pii, quality, substrings, toxicity, vectors
from clausediff.llm.components import forest


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_word_hashes_tell_words_apart_and_ignore_place():
    rng = random.Random(0)
    rows = ["".join(rng.choice("abAB \n\té\x0b ") for _ in range(rng.randrange(0, 30))) for _ in range(500)] + [None, "", " "]
    names: dict[str, int] = {}
    for first, last, hashes, bounds in hashing.chunks(pa.array(rows, pa.string())):
        for i in range(first, last):
            own = hashes[bounds[i - first] : bounds[i - first + 1]].tolist()
            plain = words_of(rows[i])
            assert len(own) == len(plain)
            for h, w in zip(own, plain, strict=True):
                assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_shingle_sets():
    rows = ["a b c d e", "a b", "", None, "A  B\nC d e", "a b c d a b c d"]
    sets = list(hashing.shingle_sets(pa.array(rows, pa.string()), 4))
    assert [len(s) for s in sets] == [2, 1, 0, 0, 2, 4]
    assert np.array_equal(sets[0], sets[4])


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 30, 25), rng.integers(0, 30, 25)
        u, v = forest(a, b)

        def labels(x, y):
            own = list(range(30))
            for p, q in list(zip(x, y, strict=True)) * 30:
                own[p] = own[q] = min(own[p], own[q])
            return own

        assert labels(a, b) == labels(u, v)


def test_patterns_agree_with_plain_regular_expressions():
    def plain(t):
        out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
            for m in re.finditer(pattern, t):
                digits = re.sub("[^0-9]", "", m[0])
                if least <= len(digits) <= most and (kind == 3 or pii.luhn(digits)):
                    out.append((m.start(), m.end(), kind))
        told = [(start, ("email", "ip", "card", "phone")[kind], end) for start, end, kind in out]
        return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(told, key=lambda s: (s[0], ("email", "ip", "card", "phone").index(s[1]))))

    rng = random.Random(3)
    for n in range(40000):
        t = "".join(rng.choice("a1@.-+ ()%é0259") for _ in range(rng.randrange(0, 26)))
        if n % 2:  # long runs of digits, dotted ones too, before an @
            t = f"{rng.choice(['', '+'])}{rng.choice(['4111111111111111', '1.2.3.4', '491234567890', '49 30 1234567'])}@x.co {t}"
        assert pii.told(pii.base_spans(t)) == plain(t), t
    for t, want in (("4111111111111111@x.com", "email:0:22,card:0:16"), ("1.2.3.4@x.com", "email:0:13,ip:0:7"), ("+491234567890@x.com", "email:0:19,phone:0:13,card:1:13")):
        assert pii.told(pii.base_spans(t)) == want
    assert pii.base_spans(None) == pii.base_spans("") == []
    assert pii.told(pii.base_spans("x a.b@c.de 4111 1111-11111111 +1 (555) 123-4567")) == "email:2:10,card:11:29,phone:30:47"
    pii.base_spans("a" * 300_000 + "@" + "1." * 100_000)  # linear


def test_tagger_gradients_and_learning():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    make = lambda: f"{word()} {word()} {word()}.{rng.randrange(99)}@{word()}.com {word()} {word()} {rng.randrange(200)}.1.2.{rng.randrange(200)} {word()}"
    x = pii._windows(pii.classes(make()), [0, 8])
    y = np.zeros(x.shape, np.int64)
    y[5], y[6:9] = 1, 2
    net = pii.new_tagger()
    _, grads = pii._gradients(net, x, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 3e-3
        up = pii._gradients(net, x, y)[0]
        p[at] = old - 3e-3
        down = pii._gradients(net, x, y)[0]
        p[at] = old
        assert (up - down) / 6e-3 == pytest.approx(g[at], rel=0.05)
    net = pii.train_tagger([make() for _ in range(200)])
    test = [make() for _ in range(60)] + ["kein Fund 12", "", "x" * 500 + " a.1@b.com"]
    found = pii.model_spans(net, test)
    hits = sum(len(set(f) & set(pii.base_spans(t))) for f, t in zip(found, test, strict=True))
    assert hits >= 0.9 * sum(len(pii.base_spans(t)) for t in test)
    assert pii.model_spans(net, ["kein Fund", ""]) == [[], []]


def test_global_decoding_is_the_best_path_over_merged_windows():
    rng = np.random.default_rng(3)
    net = pii.new_tagger()
    for p in net.parameters():
        p += rng.standard_normal(p.shape).astype(np.float32) * 0.3
    trans = net.trans + pii._FORBIDDEN
    for n in (1, 2, 3):
        scores = rng.standard_normal((n, pii.LABELS))
        paths = {p: scores[range(n), p].sum() + trans[p[:-1], p[1:]].sum() - 1e4 * (p[0] > 0 and p[0] % 2 == 0) for p in product(range(pii.LABELS), repeat=n)}
        assert tuple(pii._viterbi(scores, trans)) == max(paths, key=paths.get)
    # a text's spans are the same wherever its windows come to lie
    text = "call 12 or a.1@b.com now, " * 9
    one = pii.model_spans(net, [text])
    assert one == pii.model_spans(net, ["", text, "x"])[1:2] and all(0 <= a < b <= len(text) for a, b, _ in one[0])


def test_segments_and_parities_lose_no_link():
    rng = np.random.default_rng(0)
    links = 0
    for percent in (85, 80):
        segments = jaccard.Segments(percent)
        for _ in range(1500):
            a = np.unique(rng.integers(0, 2**63, int(rng.choice([1, 2, 3, 5, 8, 13, 40, 100, 400, 1100, 2500])), dtype=np.uint64))
            kept = rng.permutation(a)[: max(1, len(a) - rng.integers(0, len(a) // 5 + 1))]
            b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.integers(0, len(a) // 6 + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                links += 1
                assert len(np.intersect1d(segments.keys(a), segments.keys(b)))
                bits = [np.frombuffer(jaccard.parity(s), np.uint64)[None] for s in (a, b)]
                assert jaccard.within_bounds(np.array([len(a)]), bits[0], np.array([len(b)]), bits[1], percent)[0, 0]
    assert links > 1000
    # bounds tell unrelated sets apart, large ones too, and pairs are found whatever the lengths of their parities
    many = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (500, 990, 1000, 1040, 5000, 5100, 20000, 20000)]
    many += [np.delete(m, slice(0, len(m) // 50)) for m in many]
    size, raw = np.array([len(m) for m in many]), [jaccard.parity(m) for m in many]
    found = {(int(x), int(y)) for part in jaccard.bounded_pairs(size, raw, size, raw, 80) for x, y in zip(*part, strict=True)}
    assert found == {(i, j) for i in range(16) for j in range(16) if i % 8 == j % 8}


def test_prefixes_lose_no_link():
    rng = np.random.default_rng(5)
    links = 0
    for percent in (85, 80):
        prefixes = jaccard.Prefixes(percent)
        for _ in range(3000):
            a = np.unique(rng.integers(0, 2**63, int(rng.choice([1, 2, 3, 5, 8, 13, 40, 100, 400, 1100, 2500])), dtype=np.uint64))
            kept = rng.permutation(a)[: max(1, len(a) - rng.integers(0, len(a) // 5 + 1))]
            b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.integers(0, len(a) // 6 + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                links += 1
                shared = len(np.intersect1d(a[: prefixes.length(len(a))], b[: prefixes.length(len(b))]))
                assert shared >= max(prefixes.shared(len(a)), prefixes.shared(len(b)))
    assert links > 2000


def test_sketches_lose_no_link():
    rng = np.random.default_rng(17)
    sets = []
    for size in (1, 3, 20, 63, 70, 400, 1500, 5000):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(size) < 0.97], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in (0, 1, size // 20, size // 4)]
    sets = [s for s in sets if len(s)]
    size = np.array([len(s) for s in sets])
    (a, b), = jaccard.pairs_in_groups(np.array([0]), np.array([len(sets)]), 1 << 20)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == list(combinations(range(len(sets)), 2))
    parts = [np.concatenate(c) for c in zip(*jaccard.pairs_in_groups(np.array([4, 0]), np.array([5, 3]), 4), strict=True)]
    assert list(zip(*(p.tolist() for p in parts), strict=True)) == [*combinations(range(4, 9), 2), *combinations(range(3), 2)]
    near = jaccard.Sketches(size, [jaccard._sketch(len(s), jaccard.parity(s)) for s in sets], 80).near(a, b)
    both = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)])
    linked = 180 * both >= 80 * (size[a] + size[b])
    assert near[linked].all() and linked.sum() > 20 and near.sum() < linked.sum() + 30


def test_overlap_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    whole, part = jaccard.overlaps(sets), jaccard.overlaps(sets[:20], sets[20:])
    for i in range(60):
        for j in range(60):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert i == j or whole[i, j] == both
            assert i >= 20 or j < 20 or part[i, j - 20] == both


def test_compact_windows_are_the_wide_nodes_of_the_tree():
    rng = np.random.default_rng(0)
    for _ in range(500):
        values, width = rng.integers(0, 30, rng.integers(0, 60)).astype(np.uint64), int(rng.integers(1, 12))
        want, todo = [], [(0, len(values))]
        while todo:
            a, b = todo.pop()
            if b - a >= width:
                m = a + int(np.argmin(values[a:b]))
                want.append((a, m, b - 1))
                todo += [(a, m), (m + 1, b)]
        assert sorted(zip(*(x.tolist() for x in substrings.compact_windows(values, width)), strict=True)) == sorted(want)
        cuts = np.sort(rng.integers(0, len(values) + 1, 4))  # several texts, with values between them that are of none
        parts = [(a, max(a, b - 2)) for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True)]
        want = [(a + l, a + m, a + r) for a, b in parts for l, m, r in zip(*(x.tolist() for x in substrings.compact_windows(values[a:b], width)), strict=True)]
        got = substrings.compact_windows(values, width, *(np.array(c) for c in zip(*parts, strict=True)))
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(want)


def test_runs_are_found_wherever_some_run_is_alike():
    rng = np.random.default_rng(4)
    for n, edits in [(50, [47]), (60, [30]), (80, [40]), (90, [45]), (120, [40, 80]), *((int(rng.integers(50, 121)), rng.integers(0, 50, rng.integers(1, 6)).tolist()) for _ in range(150))]:
        a = rng.integers(0, 2**63, n - 4)
        b = a.copy()
        for e in edits:
            b[max(0, e - 4) : e + 1] += 1
        same = a == b
        total = np.concatenate([[0], np.cumsum(same)])
        runs = [(s, e) for s in range(n - 4) for e in range(s + 46, n - 3) if 10 * (total[e] - total[s]) >= 8 * (2 * (e - s) - total[e] + total[s])]
        got = substrings.alike(a, b, 46, 0.8)
        assert bool(got) == bool(runs), (n, edits)
        assert all((s, e) in runs and same[s:e].sum() == c for s, e, c in got)
        assert not [r for r in runs if all(r[1] <= s or r[0] >= e for s, e, _ in got)]


def test_aligned_passages_against_brute_force():
    rng = random.Random(6)
    many = [(50, 0), (60, 1), (90, 1), (90, 2), (120, 2), *((rng.randrange(50, 100), rng.randrange(0, 4)) for _ in range(30))]
    for n, edits in many:
        words = [rng.randrange(10**9) for _ in range(n)]
        other = list(words)
        for _ in range(edits):
            at = rng.randrange(len(other))
            other[at : at + rng.randrange(2)] = [rng.randrange(10**9)] * rng.randrange(2)
        pad = lambda: [rng.randrange(10**9) for _ in range(rng.randrange(0, 30))]
        x, y = (substrings.shingle_hashes(np.array(pad() + w + pad(), np.uint64), 5) for w in (words, other))
        place = {int(h): j for j, h in enumerate(y)}
        spots = np.array([place.get(int(h), -1) for h in x])
        some = False
        for a in range(len(x)):
            for b in range(a + 46, len(x) + 1):
                js = spots[a:b][spots[a:b] >= 0]
                if 10 * len(js) >= 8 * (b - a):
                    q = max(46, int(js.max() - js.min()) + 1)
                    some |= len(y) >= q and 10 * len(js) >= 8 * (b - a + q - len(js))
        got = substrings.aligned(x, y, 46, 0.8)
        assert bool(got) == some, (n, edits)
        for a, b, c, d, same in got:
            both = len(np.intersect1d(x[a:b], y[c:d]))
            assert both == same and min(b - a, d - c) >= 46 and 10 * both >= 8 * (b - a + d - c - both)
    halves = [substrings.shingle_hashes(np.array([rng.randrange(10**9) for _ in range(60)], np.uint64), 5) for _ in range(2)]
    assert [r[4] for r in substrings.aligned(np.concatenate(halves), np.concatenate(halves[::-1]), 46, 0.8)] == [56, 56]


def test_codes_bound_inner_products():
    rng = np.random.default_rng(2)
    x = vectors._unit(rng.standard_normal((400, 48)))
    x[1::2] = vectors._unit(x[::2] + 0.25 * rng.standard_normal((200, 48)) / np.sqrt(48))
    turn = vectors.rotation(48)
    bound, true = vectors.upper_bounds(x, vectors.encode(x, turn), turn), x @ x.T
    assert (bound >= true).mean() > 0.995 and (bound < 0.9).mean() > 0.9
    near = true >= 0.9
    assert (bound[near] >= 0.9).mean() > 0.99


@pytest.mark.parametrize(("cells", "dim"), [(160, 64), (500, 64), (1500, 32)])
def test_pairs_meet_with_hundreds_of_cells(cells, dim):
    rng = np.random.default_rng(8)
    x = vectors._unit(rng.standard_normal((6000, dim)))
    held, x = x[:600], x[600:]
    centroids = vectors.fit_centroids(x, cells, rounds=3)
    a = vectors._unit(rng.standard_normal((3000, dim)))
    aside = rng.standard_normal(a.shape)
    aside = vectors._unit(aside - (aside * a).sum(1, keepdims=True) * a)
    near = [np.argsort(-(v @ centroids.T), axis=1) for v in (a, 0.9 * a + np.sqrt(0.19) * aside)]

    def recall(probes):
        return np.mean([(p[:probes] == q[0]).any() or (q[:probes] == p[0]).any() for p, q in zip(*near, strict=True)])

    assert recall(vectors.PROBES) < 0.98 <= recall(vectors.probes_for(held, centroids, 0.9))


def test_network_gradients():
    net = quality.new_net()
    data, offsets = quality._packed(["some text, longer than one segment. " * 9, "x", "", "Ää!! " * 60])
    y = np.array([1, 0, 1, 0], np.float32)

    def loss():
        padded, bounds, fill = quality.segments(data, offsets)
        z = quality._forward(net, quality._pooled(net, padded, bounds)[0], bounds, fill)["z"].astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for p, g in list(zip(net.parameters(), quality._gradients(net, data, offsets, y), strict=True))[3:]:
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.1, abs=1e-4)


def plain_score(net, text):
    """The network by its definition, a kernel at a time."""
    data = list(text.encode())
    n = max(1, -(-(len(data) + quality.KERNEL - quality.STRIDE) // quality.SEGMENT))
    data += [0] * (n * quality.SEGMENT + quality.KERNEL - len(data))
    spots = [[data[s * quality.SEGMENT + k * quality.STRIDE :][: quality.KERNEL] for k in range(quality.PER_SEGMENT)] for s in range(n)]
    pooled = [np.max([net.embed[k].ravel() @ net.conv for k in segment], 0) for segment in spots]
    fill = [min(1, max(0, (len(text.encode()) - s * quality.SEGMENT) / quality.SEGMENT)) for s in range(n)]
    chunks = [(np.maximum(pooled[s], pooled[s + 1]), (fill[s] + fill[s + 1]) / 2) for s in range(n - 1)] or [(pooled[0], fill[0] / 2)]
    logits = [np.maximum(np.append(np.maximum(r + net.conv_bias, 0), f) @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias[0] for r, f in chunks]
    z = net.combine @ [max(logits), min(logits), np.mean(logits), 1] + net.shift
    return 1 / (1 + np.exp(-z))


def test_network_scores_each_text_whatever_stands_beside_it():
    rng = random.Random(2)
    net = quality.new_net(3)
    texts = ["kind word " * 9, "zzz", "", "x" * 117, "x" * 118, "x" * 120, *("".join(rng.choices("abcé \n", k=rng.randrange(0, 900))) for _ in range(40)), "kind word " * 9]
    want = [plain_score(net, t) for t in texts]
    assert quality.scores(net, *quality._packed(texts)) == pytest.approx(want, abs=1e-4)
    assert quality.scores(net, *quality._packed(texts[::-1]))[::-1] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("first", [1, 6])
def test_search_is_exact(monkeypatch, first):
    monkeypatch.setattr(toxicity, "FIRST", first)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = random.Random(1)
    vocabulary = sorted(f"w{i}" for i in range(300))
    text = lambda: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(1, 30)))
    sample = [(i, text(), i % 2) for i in range(300)] + [(300, "", 1)]
    index = toxicity.build_index(sample, vocabulary, np.array([rng.randrange(1, 200) for _ in vocabulary]), 300, (150, 150))
    assert len(index.dense) > 5 and len(index.value) > 500 and sorted(index.ids.tolist()) == list(range(300))
    lexicon = toxicity.Terms(vocabulary)
    dense = np.zeros((index.dense.shape[1], 300))
    for i, own in enumerate(index.ids.tolist()):
        t, c = lexicon.counts(sample[own][1])
        dense[i, t] = toxicity.unit_vector(index.weight, t, c)
    for query in [*(text() for _ in range(200)), sample[7][1]]:
        t, c = lexicon.counts(query)
        v = toxicity.unit_vector(index.weight, t, c)
        docs, sims = toxicity.nearest(index, t, v, toxicity.dense_scores(index, [(t, v)])[0])
        true = dense[:, t] @ v
        want = np.lexsort((np.arange(len(true)), -np.round(true, 12)))[:15]
        assert docs.tolist() == want[true[want] > 0].tolist() and np.allclose(true[docs], sims)
    assert sims[0] == pytest.approx(1) and 7 in index.ids[docs]


def test_votes_become_probabilities():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(2000)]
    bad = [f"bad{i}" for i in range(8)]

    def make(y: int) -> str:
        return " ".join(rng.choices(words, k=40) + rng.choices(bad, k=2) * (y if rng.random() < 0.9 else 1 - y))

    labels = [int(rng.random() < 0.3) for _ in range(900)]
    sample = [(i, make(y), y) for i, y in enumerate(labels[:600])]
    vocabulary = sorted({w for _, t, _ in sample for w in t.split()})
    index = toxicity.build_index(sample, vocabulary, np.ones(len(vocabulary)), 600, (7000, 3000))
    lexicon, scores = toxicity.Terms(vocabulary), []
    for y in labels[600:]:
        t, c = lexicon.counts(make(y))
        v = toxicity.unit_vector(index.weight, t, c)
        scores.append(toxicity.vote(index, *toxicity.nearest(index, t, v, toxicity.dense_scores(index, [(t, v)])[0])))
    scores, truth = np.array(scores), np.array(labels[600:])
    assert ((scores >= 0.5) == truth).mean() > 0.85
    for part in (scores < 0.3, scores >= 0.7):  # of what is called so likely, about so much is
        assert abs(scores[part].mean() - truth[part].mean()) < 0.1


def test_near_copies_of_one_shingle_are_joined_without_all_their_pairs(monkeypatch):
    rng = np.random.default_rng(11)
    base, n = rng.integers(1, 2**62, 135, dtype=np.uint64), 400
    near = []
    for _ in range(n):
        words = [int(w) for w in base]
        for side in ((8, 60), (75, 125)):  # a word replaced, one inserted and one deleted, apart from the middle
            at = int(rng.integers(*side))
            words[at : at + int(rng.integers(2))] = rng.integers(1, 2**62, int(rng.integers(2))).tolist()
        middle = words.index(int(base[67]))
        near.append(substrings._codes(substrings.shingle_hashes(np.array([0] * 80 + words + [0] * 80, np.uint64), 5))[middle + 80 - 65 : middle + 80 + 66])
    lone = rng.integers(1, 256, (n, 131)).astype(np.uint8)  # others share but the middle
    texts = np.concatenate([np.array(near, np.uint8), lone])
    v, doc, mid = np.full(2 * n, 7), np.arange(2 * n), np.full(2 * n, 70)
    for block in (substrings.BLOCK, 150):  # at once, and a part of the triples at a time
        monkeypatch.setattr(substrings, "BLOCK", block)
        links = substrings.join_texts(v, doc, mid, texts, 46, 0.8)
        assert len(links) < 8 * n
        label = substrings.merged(np.arange(2 * n), links[:, 0], links[:, 1])
        assert (label[:n] == 0).all()
        assert (label[n:] == np.arange(n, 2 * n)).all()


def test_windows_with_a_common_run_lead_to_the_first_that_holds_it():
    rng = np.random.default_rng(12)
    left, right = rng.integers(1, 256, (2, 4, 65)).astype(np.uint8)
    near = np.array([np.concatenate([left[i], [9], right[j]]) for i in range(4) for j in range(4)], np.uint8)
    near[:, :30] = rng.integers(1, 256, (16, 30))
    v, doc, mid = np.full(16, 7), np.arange(16), np.full(16, 70)
    rows, label = substrings.share_runs(v, doc, mid, near, 41)
    for start in range(25, 66):  # runs that hold the middle
        keys = {}
        for w in range(16):
            keys.setdefault(near[w, start : start + 41].tobytes(), []).append(w)
        for own in keys.values():
            held = [(a, b) for a, b, d, lo, hi in rows.tolist() if a in own and b in own and lo <= 70 + start - 65 and 70 + start - 65 + 40 <= hi]
            joined = substrings.merged(np.arange(16), *(np.array([h[k] for h in held], np.int64) for k in (0, 1)))
            assert len(set(joined[own].tolist())) == 1
            assert len(set(label[own].tolist())) == 1


def test_returns_of_a_shingle_in_a_run_of_words_have_stand_ins():
    rng = np.random.default_rng(14)
    some = lambda n: rng.integers(1, 2**62, n, dtype=np.uint64)
    for period in (*range(1, substrings.STEP // 2 + 1), 30):
        texts = [np.concatenate([some(20), np.resize(some(period), 160), some(20)]), np.resize(some(period), 161), some(50)]
        words, bounds = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
        grams, starts, stops = substrings.shingle_hashes(words, 5), bounds[:-1], bounds[1:] - 4
        mid = np.concatenate([np.arange(a, b) for a, b in zip(starts, stops, strict=True)])
        got = substrings.stand_ins(grams, mid, starts, stops)
        own, text = np.searchsorted(starts, mid, side="right"), np.searchsorted(starts, got, side="right")
        for m, o in zip(mid.tolist(), own.tolist(), strict=True):
            near = got[(text == o) & (grams[got] == grams[m])]
            assert ((near <= m) & (near > m - substrings.STEP)).any()
            assert (stops[o - 1] > near).all() and near.max() == mid[(own == o) & (grams[mid] == grams[m])].max()
        runs = period * (160 // (substrings.STEP // period * period) + 2) if period < 30 else 161  # in each of two texts
        assert len(got) <= 2 * runs + 92
