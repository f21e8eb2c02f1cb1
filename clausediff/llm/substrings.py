"""Near-duplicate passages by compact windows.

Under a hash function, the five-word shingles of a text form a Cartesian tree:
its node m covers the range l..r in which the shingle at m has the least hash.
Each passage of at least MIN_WORDS words has its min-hash at the one node that
is least within it, so the windows (l, m, r) of at least that width stand for
all such passages of a text; there are about two for every MIN_WORDS words
(Peng, Wang and Deng, 2023). Windows with the same least shingle, of any hash
function, may hold near copies of one passage: they are brought together by
that shingle and the min-hash of the shingles on one side of it, joined where
their ranges overlap far enough, over all hash functions and neighbouring
differences of positions, and verified on an alignment of their shingles.

Windows of a group of FEW or less are joined each with each. Those of a larger
group are read again with the text around their least shingle (``join_texts``).
Windows of equal text are joined with the first of them, first within each task
and then over all; windows that share a run long enough for a passage lead to
the first that holds it, by windows that hold it too; all others meet each other
if they have enough shingles in common, until they are in one group by such links.
So a passage that a third of all documents share costs a few links per document,
not one per pair, and two windows that share a passage are joined, or lead to
each other by windows that are near copies of the next one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.llm.hashing import chunks, mix, shingle_hashes
from clausediff.llm.storage import drop, small_enough, written

#: Words of a shingle, and the least of a passage.
SHINGLE, MIN_WORDS = 5, 50
#: Hash functions. Of a passage with Jaccard similarity 0.8 one brings both windows together with a chance of about 0.8 for
#: the least shingle times 0.8 for a side: all miss it with a chance of about 0.36**5, or 0.006.
HASHES = 5
SIMILARITY = 0.8
#: Of the passage with words inserted or deleted, the share by which its length and positions may differ: s / (2n - s) bounds it.
SLACK = 4
#: Windows of a group that are all joined with each other.
FEW = 8
#: Windows that a task gathers before it joins them: about 150 MB.
HELD = 500_000
#: Documents that are compared with a stretch of a leader in one task; up to so many stretches of more are broadcast.
MEMBERS, BROADCAST_ROWS = 2000, 200_000
#: Windows that are joined by their texts at once, unless more have one shingle (about 0.5 kB each), windows whose triples are looked up at once
#: (about 10 kB each), pairs of them that are listed at once, and bits that bound what they share.
TEXTS, BLOCK, PAIRS, _BITS = 20_000, 5000, 1_000_000, 1024
#: How far a shingle of a near copy may be shifted against the least one: a passage of less than two widths has so many words inserted at most.
_SHIFT = 22
#: Of a shingle that a run of words says over and over each window so far apart stands for those up to the next one.
STEP = 16
_SEEDS = [np.uint64(int(x) * 2 + 1) for x in np.random.default_rng(99).integers(1, 2**62, HASHES)]
_SIDE = np.uint64(0x5851F42D4C957F2D)


def runs_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` keys, by the least of runs of doubling length."""
    span = 1
    while span < width:
        step = min(span, width - span)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        span += step
    return keys


def compact_windows(values: np.ndarray, width: int, starts: np.ndarray | None = None, stops: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(l, m, r)`` of the nodes of the Cartesian tree of ``values`` (below 2**39) whose range l..r is ``width`` or wider; ties go left.

    With starts and stops, of the trees of values[starts[i]:stops[i]]. A node
    is as wide just if it is the least of some run of ``width`` values, and the
    next smaller value on either side of such a node is such a node itself: the
    trees are built from these alone.
    """
    n = len(values)
    starts, stops = (np.array([0]), np.array([n])) if starts is None else (starts, stops)
    wide = stops - starts >= width
    starts, stops = starts[wide], stops[wide]
    if not len(starts):
        return (np.empty(0, np.int64),) * 3
    bits = max(24, n.bit_length())  # of a position; of more than 24 the values lose as many
    keys = (values.astype(np.int64) >> (bits - 24)) << bits | np.arange(n)
    begins = np.zeros(n + 1, np.int64)  # of runs within one text
    np.add.at(begins, starts, 1)
    np.add.at(begins, stops - width + 1, -1)
    least = runs_least(keys, width)[np.cumsum(begins)[: n - width + 1] > 0]
    nodes = np.unique(least[np.concatenate([[True], least[1:] != least[:-1]])] & ((1 << bits) - 1))
    # a wall before and after each text is less than all values
    first, last = np.searchsorted(nodes, starts), np.searchsorted(nodes, stops)
    own, at, right, left = keys[nodes].tolist(), nodes.tolist(), [0] * len(nodes), [0] * len(nodes)
    for a, b, start, stop in zip(first.tolist(), last.tolist(), starts.tolist(), stops.tolist(), strict=True):
        stack: list[int] = []
        for i in range(a, b):
            key = own[i]
            while stack and own[stack[-1]] > key:
                right[stack.pop()] = at[i] - 1
            left[i] = at[stack[-1]] + 1 if stack else start
            stack.append(i)
        for i in stack:
            right[i] = stop - 1
    return np.array(left), nodes, np.array(right)


def _reach(min_words: int) -> int:
    """Shingles on either side of a window's least one that tell its surroundings: of a passage around it, at least so many lie on one side."""
    return (min_words - SHINGLE) // 2


def surroundings(grams: np.ndarray, reach: int, mid: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position ``mid`` of the texts start..stop the min-hash (never 0) of the ``reach`` shingles before it and of those after it; 0 where there are fewer."""
    least = mix(grams ^ _SIDE) >> np.uint64(32) | np.uint64(1)
    span = 1
    while span < reach:
        step = min(span, reach - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    last = max(0, len(least) - 1)
    before = np.where(mid - reach >= start, least[np.clip(mid - reach, 0, last)], np.uint64(0))
    return before, np.where(mid + reach < stop, least[np.clip(mid + 1, 0, last)], np.uint64(0))


def _reaches(lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How far a window reaches to either side of its least shingle, in one integer."""
    return (mid - lo).astype(np.int64) << 32 | (hi - mid)


def _group_key(v: np.ndarray, part: np.ndarray, side: int) -> np.ndarray:
    """Of a window's least shingle and its surroundings on a side."""
    return mix(v.view(np.uint64) + (part << np.uint64(1) | np.uint64(side)) * np.uint64(0x9E3779B97F4A7C15))


def pair_up(v: np.ndarray, around: np.ndarray, doc: np.ndarray, mid: np.ndarray, reaches: np.ndarray, width: int, last: bool = True, crowds: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Joins windows of equal least shingle and equal surroundings on a side.

    Returns rows (document, leader, difference of positions, from, to) - the
    latter in positions of the leader - and which windows must still meet those
    of other tasks: the leaders, and all of small groups, which wait for that
    unless this is the ``last`` meeting.

    With ``crowds``, the windows of larger groups are not joined and don't wait:
    the groups' keys are added to it, for ``join_texts`` to join all their windows.
    A leader alone would lose links, for it may not share the text of what it covers.
    """
    left, right = reaches >> 32, reaches & 0xFFFFFFFF
    found, needed = [np.empty((0, 5), np.int64)], np.zeros(len(v), bool)
    sides = around.view(np.uint64)

    def join(rows: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Which of ``rows`` their leader needs no other for."""
        near, far = np.minimum(left[rows], left[lead]), np.minimum(right[rows], right[lead])
        joined = (near + far + 1) * (SLACK + 1) >= width * SLACK
        other = joined & (doc[rows] != doc[lead])
        r, q = rows[other], lead[other]
        found.append(np.column_stack([doc[r], doc[q], mid[r] - mid[q], mid[q] - near[other], mid[q] + far[other]]))
        return joined & (left[rows] <= left[lead]) & (right[rows] <= right[lead])

    for side, part in enumerate((sides >> np.uint64(32), sides & np.uint64(0xFFFFFFFF))):
        rows = np.flatnonzero(part)
        key = _group_key(v[rows], part[rows], side)
        order = np.argsort(key)
        rows, key = rows[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        size = np.diff(np.append(first, len(rows)))
        if not last:
            needed[rows[np.repeat(size <= FEW, size)]] = True
        large = np.repeat(size > (1 if last else FEW), size)
        rows, key = rows[large], key[large]
        order = np.lexsort((mid[rows], doc[rows], -(left[rows] + right[rows]), key))
        rows, key = rows[order], key[order]
        # one row per window of a group: hash functions may share it
        new = np.ones(len(rows), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[rows[1:]] != doc[rows[:-1]]) | (mid[rows[1:]] != mid[rows[:-1]]) | (reaches[rows[1:]] != reaches[rows[:-1]])
        rows, key = rows[new], key[new]
        if not len(rows):
            continue
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(rows)))
        few = np.repeat(size <= FEW, size)
        needed[rows[few]] = True
        if last:
            small, group = rows[few], key[few]
            for step in range(1, FEW):
                same = group[step:] == group[:-step]
                a, b = small[:-step][same], small[step:][same]
                # the document of the smaller number is the leader
                lead = np.where(doc[a] <= doc[b], a, b)
                join(np.where(lead == a, b, a), lead)
        rows, key = rows[~few], key[~few]
        if crowds is not None:
            crowds.append(np.unique(key))
            continue
        while len(rows):
            first = np.concatenate([[True], key[1:] != key[:-1]])
            lead = rows[np.flatnonzero(first)[np.cumsum(first) - 1]]
            needed[rows[first]] = True
            rest = ~join(rows, lead) & ~first
            rows, key = rows[rest], key[rest]
    return np.concatenate(found), needed


def _codes(grams: np.ndarray) -> np.ndarray:
    """A byte of each shingle, never 0."""
    return (mix(grams) % np.uint64(255)).astype(np.uint8) + np.uint8(1)


def _least_equal(width: int, similarity: float) -> int:
    """Equal shingles that two passages of ``width`` shingles need for the similarity."""
    return int(np.ceil(2 * similarity * width / (1 + similarity) - 1e-9))


def _links(doc: np.ndarray, mid: np.ndarray, rows: np.ndarray, lead: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Rows as of ``pair_up`` for windows of two documents, so far before and after the leader's least shingle."""
    other = doc[rows] != doc[lead]
    r, q = rows[other], lead[other]
    return np.column_stack([doc[r], doc[q], mid[r] - mid[q], mid[q] - before[other], mid[q] + after[other]])


def copies(v: np.ndarray, doc: np.ndarray, mid: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins windows of equal text around their least shingle with the first of them, by document; the rows, and which windows are first, in the order of v, doc and mid."""
    span = near.shape[1] // 2
    wide = np.zeros((len(v), -(-near.shape[1] // 8) * 8), np.uint8)
    wide[:, : near.shape[1]] = near
    key = v.view(np.uint64)
    for col in wide.view(np.uint64).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + col)
    order = np.lexsort((mid, doc, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    firsts = order[new]
    lead = firsts[np.cumsum(new) - 1]
    known = near != 0
    before, after = known[:, :span].sum(axis=1), known[:, span + 1 :].sum(axis=1)
    return _links(doc, mid, order, lead, before[lead], after[lead]), firsts[np.lexsort((mid[firsts], doc[firsts], v[firsts]))]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the least member's number for each) once a and b are in one group."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def hulls(found: np.ndarray) -> np.ndarray:
    """Of the rows of a document, leader and difference of positions one, from the least to the greatest position."""
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(axis=1)]))
    return np.column_stack([found[new, :3], np.minimum.reduceat(found[:, 3], new), np.maximum.reduceat(found[:, 4], new)])


def share_runs(v: np.ndarray, doc: np.ndarray, mid: np.ndarray, near: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Joins windows that share a run of ``least`` shingles around the least one; windows are in the order of v and doc.

    A window stays with one earlier window as long as that holds each run that
    others share, and goes to the first that holds it else. So of all windows
    with a run each leads, by windows that hold it, to the first of them.
    Returns the rows, and labels: those of joined windows are equal.
    """
    n, span = len(v), near.shape[1] // 2
    odd = mix(np.arange(near.shape[1], dtype=np.uint64)) | np.uint64(1)
    own, lead, since, label = mix(v.view(np.uint64)), np.full(n, -1), np.zeros(n, np.int64), np.arange(n)
    start = span + STEP - 1
    total = np.zeros(n, np.uint64)  # of the run from start on
    for col in range(start, start + least):
        total += _VALUES[near[:, col]] * odd[col]
    out = [np.empty((0, 5), np.int64)]

    def ends(rows: np.ndarray, i: int) -> None:
        """The windows leave what led them up to the run ``i``."""
        rows = rows[lead[rows] >= 0]
        out.append(_links(doc, mid, rows, lead[rows], np.full(len(rows), i), least - 1 - since[rows]))

    for i in range(1 - STEP, least):
        start, stop = span - i, span - i + least
        if i > 1 - STEP:
            total += _VALUES[near[:, start]] * odd[start] - _VALUES[near[:, stop]] * odd[stop]
        there = (near[:, start] != 0) & (near[:, stop - 1] != 0)
        key = mix(total ^ own)
        kept = there & (lead >= 0)
        kept[kept] = (key[kept] == key[lead[kept]]) & there[lead[kept]]
        rows = np.flatnonzero(there)
        order = np.argsort(key[rows], kind="stable")
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = key[rows[1:]] != key[rows[:-1]]
        first = rows[new][np.cumsum(new) - 1]
        ends(np.flatnonzero(~kept & (lead >= 0)), i - 1)
        lead[~kept] = -1
        go = ~new & ~kept[rows]
        label = merged(label, rows[go], first[go])
        go &= doc[rows] != doc[first]
        lead[rows[go]], since[rows[go]] = first[go], i
    ends(np.flatnonzero(lead >= 0), least - 1)
    return np.concatenate(out), label


_NONE = np.uint64(2**64 - 1)


def _triples(v: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows' triples of neighbouring shingles, sorted, and how many there are; one that stands n times is n triples."""
    x = near.astype(np.uint64)
    token = mix((x[:, :-2] | x[:, 1:-1] << np.uint64(8) | x[:, 2:] << np.uint64(16)) + mix(v.view(np.uint64))[:, None])
    token[(near[:, :-2] == 0) | (near[:, 1:-1] == 0) | (near[:, 2:] == 0)] = _NONE
    token.sort(axis=1)
    place = np.arange(token.shape[1])
    again = np.zeros(token.shape, bool)
    again[:, 1:] = token[:, 1:] == token[:, :-1]
    there = token != _NONE
    if (again & there).any():
        nth = place - np.maximum.accumulate(np.where(again, 0, place), axis=1)
        token = np.where(there & (nth > 0), mix(token + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), token)
    return token, there.sum(axis=1)


def _blocks(n: int, size: int) -> Iterator[slice]:
    return (slice(i, min(n, i + size)) for i in range(0, n, size))


def dense(x: np.ndarray, y: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of windows' texts, whether ``width`` positions or more of x stand in y too, so large a share as the similarity takes of the shorter passage; and of y in x.

    A position stands in the other text if it is equal in place, or with a neighbour no more than _SHIFT further on or back. Of passages of n
    and m shingles, s of them equal, n + m is at most s (1 + similarity) / similarity, and twice the smaller of n and m at most that.
    """
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    cols, share = len(x), 2 * similarity / (1 + similarity)
    in_x = (x == y) & (x != 0)
    in_y = in_x.copy()
    for d in range(-_SHIFT, _SHIFT + 1):
        if d:
            a, b, n = max(0, -d), max(0, d), cols - abs(d)
            same = x[a : a + n] == y[b : b + n]
            same &= x[a : a + n] != 0
            two = same[1:] & same[:-1]
            for found, at in ((in_x, a), (in_y, b)):
                found[at : at + n - 1] |= two
                found[at + 1 : at + n] |= two
    out = []
    for found in (in_x, in_y):
        total = np.zeros((cols + 1, x.shape[1]), np.float32)
        np.cumsum(np.where(found, np.float32(1), np.float32(-share / (1 - share))), axis=0, out=total[1:])
        out.append((total[width:] - np.minimum.accumulate(total[: cols + 1 - width], axis=0) >= -1e-3).any(axis=0))
    return out[0], out[1]


def share_most(v: np.ndarray, doc: np.ndarray, mid: np.ndarray, near: np.ndarray, label: np.ndarray, need: int, width: int, similarity: float) -> np.ndarray:
    """Joins windows of equal v, but not of one label, of whose triples of neighbouring shingles ``need`` or more are equal.

    Of a window's triples all but the need - 1 most frequent ones are looked up: two windows with so many in common have one of these in common.
    Frequencies are those in up to BLOCK windows; any order of the triples serves. Of more windows a part of the triples is looked up
    at a time. Windows that are ``dense`` in each other get one label: no others of their two groups need to meet.
    """
    n, span = len(v), near.shape[1] // 2
    sample = np.arange(n) if n <= BLOCK else np.linspace(0, n - 1, BLOCK).astype(np.int64)
    names, count = np.unique(_triples(v[sample], near[sample])[0], return_counts=True)
    names, count = names[(count > 1) & (names != _NONE)], count[(count > 1) & (names != _NONE)]
    bits, many = np.zeros((n, _BITS // 64), np.uint64), np.zeros(n, np.int64)
    before, after = (near[:, :span] != 0).sum(axis=1), (near[:, span + 1 :] != 0).sum(axis=1)
    out, parts = [np.empty((0, 5), np.int64)], -(-n // BLOCK)
    low = np.uint64((1 << 40) - 1)

    def posts(part: int) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for block in _blocks(n, 2000):
            token, many[block] = _triples(v[block], near[block])
            there = token != _NONE
            if not part:
                r, c = np.nonzero(there)
                np.bitwise_or.at(bits, (r + block.start, (token[r, c] % np.uint64(_BITS)).astype(np.int64) >> 6), np.uint64(1) << token[r, c] % np.uint64(64))
            often = np.zeros(token.shape, np.uint64)
            if len(names):
                at = np.minimum(np.searchsorted(names, token), len(names) - 1)
                often = np.where(names[at] == token, count[at].astype(np.uint64), np.uint64(0))
            rarest = np.where(there, often << np.uint64(40) | token & low, _NONE)
            rarest.sort(axis=1)
            looked = (np.arange(token.shape[1]) < (many[block] - need + 1)[:, None]) & (rarest % np.uint64(parts) == np.uint64(part))
            if n <= BLOCK:
                looked &= rarest >> np.uint64(40) != 0  # others have no partner
            r, c = np.nonzero(looked)
            found.append((r + block.start, rarest[r, c]))
        rows, post = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(post, kind="stable")
        return rows[order], post[order]

    for part in range(parts):
        rows, post = posts(part)
        fresh, most = True, PAIRS // 16
        while len(rows):
            if fresh:  # within a triple, windows of one label follow each other; a triple of one label alone is done
                order = np.lexsort((rows, label[rows], post))
                rows, post = rows[order], post[order]
                fresh = False
            own = label[rows]
            new = np.flatnonzero(np.concatenate([[True], post[1:] != post[:-1]]))
            end = np.repeat(np.append(new[1:], len(rows)), np.diff(np.append(new, len(rows))))
            new = np.flatnonzero(np.concatenate([[True], (post[1:] != post[:-1]) | (own[1:] != own[:-1])]))
            next_own = np.repeat(np.append(new[1:], len(rows)), np.diff(np.append(new, len(rows))))
            first = np.concatenate([[True], post[1:] != post[:-1]])
            alone = (next_own == end) & (own == own[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))])
            if alone.any():
                rows, post = rows[~alone], post[~alone]
                continue
            total = np.cumsum(end - next_own)
            stop = max(1, int(np.searchsorted(total, most, side="right")))
            follow = (end - next_own)[:stop]
            b = np.repeat(next_own[:stop], follow) + np.arange(int(total[stop - 1])) - np.repeat(total[:stop] - follow, follow)
            pair = np.unique(np.minimum(x := np.repeat(rows[:stop], follow), y := rows[b]) * n + np.maximum(x, y))
            rows, post, most = rows[stop:], post[stop:], min(PAIRS, 2 * most)
            p, q = np.divmod(pair, n)
            for block in _blocks(len(pair), 10_000):
                a, b = p[block], q[block]
                maybe = (label[a] != label[b]) & (doc[a] != doc[b])
                a, b = a[maybe], b[maybe]
                maybe = many[a] + many[b] - np.bitwise_count(bits[a] | bits[b]).sum(axis=1) >= need
                a, b = a[maybe], b[maybe]
                for some in _blocks(len(a), 1000):
                    c, d = a[some], b[some]
                    apart = label[c] != label[d]
                    c, d = c[apart], d[apart]
                    one, other = dense(near[c], near[d], width, similarity)
                    c, d, sure, tries = c[one | other], d[one | other], (one & other)[one | other], 1
                    while len(c):  # of each two groups a few at a time
                        x, y = label[c], label[d]
                        apart = x != y
                        c, d, sure, x, y = c[apart], d[apart], sure[apart], x[apart], y[apart]
                        if not len(c):
                            break
                        groups = np.minimum(x, y) * n + np.maximum(x, y)
                        order = np.argsort(groups, kind="stable")
                        c, d, sure, groups = c[order], d[order], sure[order], groups[order]
                        new = np.concatenate([[True], groups[1:] != groups[:-1]])
                        nth = np.arange(len(c)) - np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
                        now = nth < tries
                        out.append(_links(doc, mid, d[now], c[now], before[c[now]], after[c[now]]))  # c is the earlier one, of the smaller document
                        if (now & sure).any():
                            label, fresh = merged(label, c[now & sure], d[now & sure]), True
                        c, d, sure, tries = c[~now], d[~now], sure[~now], 2 * tries
    return np.concatenate(out)


def _parted(v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which windows, in the order of v, have a v of several labels."""
    first = np.concatenate([[True], v[1:] != v[:-1]])
    group = np.cumsum(first) - 1
    return np.bincount(group, label != label[first][group])[group] > 0


def join_texts(v: np.ndarray, doc: np.ndarray, mid: np.ndarray, near: np.ndarray, width: int, similarity: float) -> np.ndarray:
    """Joins the windows of equal least shingle by the text around it, ``near``: as many bytes of shingles before it as after it.

    Windows of equal text are joined with the first of them, those that share a
    run long enough for the similarity lead to the first that holds it, and all
    others meet each other, if they have enough of their shingles in common,
    until links that hold in order have joined them.
    """
    found, kept = copies(v, doc, mid, near)
    v, doc, mid, near = v[kept], doc[kept], mid[kept], near[kept]
    several = np.zeros(len(v), bool)
    several[1:] = v[1:] == v[:-1]
    several[:-1] |= several[1:]
    v, doc, mid, near = v[several], doc[several], mid[several], near[several]
    if not len(v):
        return hulls(found)
    least = _least_equal(width, similarity)
    runs, label = share_runs(v, doc, mid, near, least)
    out = [found, runs]
    # a run of n shingles has n - 2 triples; a word inserted parts a run in two and costs 4 shingles
    need = max(1, least - 2 * (1 + (width - least) // (SHINGLE - 1)))
    left = np.flatnonzero(_parted(v, label))
    while len(left):  # whole groups, about BLOCK windows at a time
        stop = int(np.searchsorted(v[left], v[left[min(len(left), BLOCK) - 1]], side="right"))
        now, left = left[:stop], left[stop:]
        _, own = np.unique(label[now], return_inverse=True)
        least_of = np.full(own.max() + 1, len(now))
        np.minimum.at(least_of, own, np.arange(len(now)))
        out.append(share_most(v[now], doc[now], mid[now], near[now], least_of[own], need, width, similarity))
    return hulls(np.concatenate(out))


def _marks(keys: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for h in (keys, mix(keys)):
        at = h & np.uint64(size - 1)
        yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def key_bits(keys: np.ndarray) -> np.ndarray:
    """Two bits of each key, among at least 32 for each."""
    bits = np.zeros(1 << max(13, (4 * len(keys)).bit_length()), np.uint8)
    for byte, bit in _marks(keys, 8 * len(bits)):
        np.bitwise_or.at(bits, byte, bit)
    return bits


def told(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among those of the bits, and a few others."""
    out = np.ones(len(keys), bool)
    for byte, bit in _marks(keys, 8 * len(bits)):
        out &= bits[byte] & bit != 0
    return out


def stand_ins(grams: np.ndarray, mid: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The positions that stand for the windows of the least shingles ``mid`` of the texts starts..stops.

    In words said over and over, one, a pair or up to STEP / 2 of them, each
    return of a shingle is the least of a window. Of those within a STEP only the
    first stands for all, counted from the beginning of such a run, and the run's
    last return stands too: so texts that share what goes before or after a run
    have windows at the same distance from it.
    """
    first, last, todo, at = mid.copy(), mid.copy(), np.arange(len(mid)), np.arange(len(grams))
    for period in range(1, STEP // 2 + 1):
        if not (grams[mid[todo]] == grams[np.maximum(mid[todo] - period, 0)])[mid[todo] >= period].any():
            continue
        again = np.zeros(len(grams) + 1, bool)
        again[period:-1] = grams[period:] == grams[:-period]
        again[np.minimum(starts[:, None] + np.arange(period), len(grams))] = False
        again[np.minimum(stops, len(grams))] = False
        since = np.maximum.accumulate(np.where(again[:-1], 0, at))
        until = np.minimum.accumulate(np.where(again, len(grams), np.arange(len(grams) + 1))[::-1])[::-1]
        now = todo[again[mid[todo]]]
        own = mid[now]
        first[now] -= (own - (since[own] + 1 - period)) // period % (STEP // period) * period
        last[now] += (until[own] - 1 - own) // period * period
        todo = todo[~again[mid[todo]]]
    return np.unique(np.concatenate([first, last]))


def text_around(grams: np.ndarray, mid: np.ndarray, starts: np.ndarray, stops: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of the least shingles ``mid`` of the texts starts..stops, or what stands for them: text, position, and a byte of each shingle up to ``span`` before and after it (0 beyond the text)."""
    mid = stand_ins(grams, mid, starts, stops)
    own = np.searchsorted(starts, mid, side="right") - 1
    spot = mid[:, None] + np.arange(-span, span + 1)
    inside = (spot >= starts[own][:, None]) & (spot < stops[own][:, None])
    return own, mid, np.where(inside, _codes(grams)[np.clip(spot, 0, max(0, len(grams) - 1))], np.uint8(0))


_VALUES = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_WINDOW_ROW = "kind byte, a long, b long, c long, d long, e long"


def _rows(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    n = len(cols[0])
    cols = [*cols, *([np.zeros(n, np.int64)] * (5 - len(cols)))]
    return pa.record_batch([pa.array(np.full(n, kind, np.int8)), *(pa.array(np.ascontiguousarray(c)) for c in cols)], names=["kind", "a", "b", "c", "d", "e"])


def _windows_of(grams: np.ndarray, starts: np.ndarray, stops: np.ndarray, width: int, reach: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``(lo, mid, hi, text, before, after)`` of the windows of the texts starts..stops, for each hash function."""
    for seed in _SEEDS:
        lo, mid, hi = compact_windows(mix(grams ^ seed) >> np.uint64(25), width, starts, stops)
        own = np.searchsorted(starts, mid, side="right") - 1
        yield lo, mid, hi, own, *surroundings(grams, reach, mid, starts[own], stops[own])


def _text_rows(v: np.ndarray, doc: np.ndarray, mid: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    rows = _rows(1, v, doc, mid)
    return rows.append_column("near", pa.array([x.tobytes() for x in near], pa.binary()))


def _link_rows(found: np.ndarray) -> pa.RecordBatch:
    rows = _rows(0, *hulls(found).T)
    return rows.append_column("near", pa.nulls(rows.num_rows, pa.binary()))


def candidate_pairs(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, ref, diagonal, lo, hi)``: where a document may hold a passage of another, in shingle positions of ``ref``. Its ``_reads`` is a table to be dropped when this is read."""
    width, reach = min_words - SHINGLE + 1, _reach(min_words)
    span = width - 1 + SHINGLE - 1 + STEP  # of a passage with a word inserted, from the first window of a STEP on

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            own, crowds = [np.concatenate(c) for c in cols], [np.empty(0, np.uint64)]
            found, needed = pair_up(*own, width, last=False, crowds=crowds)
            yield _rows(0, *found.T)
            yield _rows(1, *(c[needed] for c in own))
            yield _rows(2, np.unique(np.concatenate(crowds)).view(np.int64))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, words, bounds in chunks(batch.column(1)):
                grams = shingle_hashes(words, SHINGLE)
                starts, stops = bounds[:-1], np.maximum(bounds[1:] - SHINGLE + 1, bounds[:-1])
                for lo, mid, hi, own, before, after in _windows_of(grams, starts, stops, width, reach):
                    for c, x in zip(cols, (grams[mid].view(np.int64), (before << np.uint64(32) | after).view(np.int64), ids[first:last][own], mid - starts[own], _reaches(lo, mid, hi)), strict=True):
                        c.append(x)
                    held += len(mid)
                if held >= HELD:
                    yield from out()
                    cols, held = [[], [], [], [], []], 0
        if held:
            yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by a: windows of a shingle follow each other, and no more than HELD of them and a batch are held."""
        held: list[list[np.ndarray]] = []

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            crowds = [np.empty(0, np.uint64)]
            yield _rows(0, *hulls(pair_up(*cols, width, crowds=crowds)[0]).T)
            yield _rows(2, np.unique(np.concatenate(crowds)).view(np.int64))

        for batch in batches:
            kind, *rest = (c.to_numpy() for c in batch.columns)
            for k in (0, 2):
                if (kind == k).any():
                    yield _rows(k, *(c[kind == k] for c in rest))
            held.append([c[kind == 1] for c in rest])
            if sum(len(h[0]) for h in held) >= HELD:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = int(np.searchsorted(cols[0], cols[0][-1]))  # windows of the last shingle may follow
                yield from out([c[:end] for c in cols])
                held = [[c[end:] for c in cols]]
        if held:
            yield from out([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    met = written(rows.mapInArrow(windows, _WINDOW_ROW).repartition(F.col("a")).sortWithinPartitions("a").mapInArrow(meet, _WINDOW_ROW), "passage-windows")
    found = met.where("kind = 0").select("a", "b", "c", "d", "e")
    keys = met.where("kind = 2").select("a").distinct().toArrow().column("a").to_numpy().view(np.uint64)
    if len(keys):
        bits = docs.sparkSession.sparkContext.broadcast(key_bits(keys))

        def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The windows of large groups, with their texts; of those of equal text in a task one."""
            cols: list[list[np.ndarray]] = [[], [], [], []]

            def out() -> Iterator[pa.RecordBatch]:
                own = [np.concatenate(c) for c in cols]
                links, kept = copies(*own)
                yield _link_rows(links)
                for i in range(0, len(kept), 10_000):
                    yield _text_rows(*(c[kept[i : i + 10_000]] for c in own))

            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for first, last, words, bounds in chunks(batch.column(1)):
                    grams = shingle_hashes(words, SHINGLE)
                    starts, stops = bounds[:-1], np.maximum(bounds[1:] - SHINGLE + 1, bounds[:-1])
                    hits = [np.empty(0, np.int64)]
                    for _, mid, _, _, *sides in _windows_of(grams, starts, stops, width, reach):
                        hit = np.zeros(len(mid), bool)
                        for side, part in enumerate(sides):
                            hit |= (part != 0) & told(bits.value, _group_key(grams[mid], part, side))
                        hits.append(mid[hit])
                    own, mid, near = text_around(grams, np.concatenate(hits), starts, stops, span)
                    for c, x in zip(cols, (grams[mid].view(np.int64), ids[first:last][own], mid - starts[own], near), strict=True):
                        c.append(x)
                if sum(len(c) for c in cols[0]) >= 10 * TEXTS:
                    yield from out()
                    cols = [[], [], [], []]
            if cols[0]:
                yield from out()

        def meet_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = []
            for batch in batches:
                kind, *rest = (c.to_numpy() for c in batch.columns[:-1])
                if (kind == 0).any():
                    yield _rows(0, *(c[kind == 0] for c in rest))
                own = kind == 1
                near = np.frombuffer(b"".join(batch.column(6).drop_null().to_pylist()), np.uint8).reshape(-1, 2 * span + 1)
                if own.any():
                    held.append([*(c[own] for c in rest[:3]), near])
                if sum(len(h[0]) for h in held) >= TEXTS and held[0][0][0] != held[-1][0][-1]:
                    cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                    end = int(np.searchsorted(cols[0], cols[0][-1]))
                    yield _rows(0, *join_texts(*(c[:end] for c in cols), width, similarity).T)
                    held = [[c[end:] for c in cols]]
            if held:
                yield _rows(0, *join_texts(*(np.concatenate(c) for c in zip(*held, strict=True)), width, similarity).T)

        texts = rows.mapInArrow(crowded, _WINDOW_ROW + ", near binary").repartition(F.col("a")).sortWithinPartitions("a")
        found = found.union(texts.mapInArrow(meet_texts, _WINDOW_ROW).select("a", "b", "c", "d", "e"))
    out = found.groupBy(F.col("a").alias("doc_id"), F.col("b").alias("ref"), F.col("c").alias("diagonal")).agg(F.min("d").alias("lo"), F.max("e").alias("hi"))
    out._reads = met
    return out


def alike(a: np.ndarray, b: np.ndarray, width: int, similarity: float) -> list[tuple[int, int, int]]:
    """``(from, to, equal)``: the runs of positions, ``width`` or longer, in which shingles agree to the similarity; a and b are as long.

    Of n positions with s equal shingles the Jaccard similarity is s / (2n - s).
    An equal position counts 1 and another as much less as lets the sum of a run
    of the similarity be 0: the longest run of no negative sum comes first, then
    what lies on either side of it. Unequal ends are cut off down to ``width``.
    """
    same = a == b
    share = 2 * similarity / (1 + similarity)  # of equal positions
    total = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -share / (1 - share)))])
    out, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < width:
            continue
        part = total[lo : hi + 1]
        most = np.maximum.accumulate(part[::-1])[::-1]  # from a position on; falls
        far = len(part) - 1 - np.searchsorted(most[::-1], part - 1e-9)  # the last position of no smaller sum
        length = far - np.arange(len(part))
        start = int(length.argmax())
        if length[start] < width:
            continue
        start, end = lo + start, lo + int(far[start])
        equal = np.flatnonzero(same[start:end]) + start
        start = min(int(equal[0]), end - width)
        end = max(int(equal[-1]) + 1, start + width)
        out.append((start, end, int(same[start:end].sum())))
        todo += [(lo, start), (end, hi)]
    return sorted(out)


def _rising(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest chain of the pairs that rises in both."""
    order = np.argsort(i)
    i, j = i[order], j[order]
    if (np.diff(j) < 0).any():
        ends, at, back = [], [], []
        for k, q in enumerate(j.tolist()):
            place = bisect_left(ends, q)
            ends[place : place + 1] = [q]
            at[place : place + 1] = [k]
            back.append(at[place - 1] if place else -1)
        kept, k = [], at[-1]
        while k >= 0:
            kept.append(k)
            k = back[k]
        i, j = i[kept[::-1]], j[kept[::-1]]
    return i, j


def _chain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of equal shingles, rising in both: the longest such chain of n-th occurrences, and equal ones beside its members; and how many shingles are equal in any order."""
    both = np.concatenate([x, y])
    order = np.argsort(both)
    again = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    a, b = np.minimum(order[again], order[again + 1]), np.maximum(order[again], order[again + 1])
    if (a < len(x)).all() and (b >= len(x)).all() and (np.diff(again) > 1).all():  # no shingle twice in x or in y
        return *_rising(a, b - len(x)), len(a)
    _, names = np.unique(np.concatenate([x, y]), return_inverse=True)

    def numbered(own: np.ndarray) -> np.ndarray:
        order = np.argsort(own, kind="stable")
        first = np.concatenate([[True], own[order][1:] != own[order][:-1]])
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        return own * (len(names) + 1) + place

    _, i, j = np.intersect1d(numbered(names[: len(x)]), numbered(names[len(x) :]), assume_unique=True, return_indices=True)
    equal = len(i)
    i, j = _rising(i, j)
    if not len(i):
        return i, j, 0
    more = []
    left, right = [(-1, -1), *zip(i.tolist(), j.tolist(), strict=True)], [*zip(i.tolist(), j.tolist(), strict=True), (len(x), len(y))]
    for (i0, j0), (i1, j1) in zip(left, right, strict=True):
        n = min(i1 - i0, j1 - j0) - 1
        if n <= 0:
            continue
        ahead = x[i0 + 1 : i0 + 1 + n] == y[j0 + 1 : j0 + 1 + n] if i0 >= 0 else np.zeros(n, bool)
        behind = x[i1 - n : i1] == y[j1 - n : j1] if i1 < len(x) else np.zeros(n, bool)
        if i0 >= 0 and (i1 == len(x) or i1 - i0 == j1 - j0):
            more += [(i0 + 1 + int(t), j0 + 1 + int(t)) for t in np.flatnonzero(ahead)]
        elif i0 < 0:
            more += [(i1 - n + int(t), j1 - n + int(t)) for t in np.flatnonzero(behind)]
        else:
            head = n if ahead.all() else int(ahead.argmin())
            tail = min(n - head, n if behind.all() else int(behind[::-1].argmin()))
            more += [(i0 + 1 + t, j0 + 1 + t) for t in range(head)] + [(i1 - tail + t, j1 - tail + t) for t in range(tail)]
    if more:
        i, j = np.concatenate([i, [m[0] for m in more]]), np.concatenate([j, [m[1] for m in more]])
        order = np.argsort(i)
        i, j = i[order], j[order]
    return i, j, max(equal, len(i))


def aligned(x: np.ndarray, y: np.ndarray, width: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """``(from, to, from, to, equal)`` in x and in y: the passages, ``width`` shingles or longer in both, that agree in order to the similarity.

    s equal shingles in order, of p in x and q in y, have the Jaccard
    similarity s / (p + q - s). The longest passage comes first, then what lies
    on either side of it, then what stands in another order. Passages begin and
    end with equal shingles unless they are too short for that.
    """
    least, found = 2 * similarity * width / (1 + similarity), []
    x, y = x.copy(), y.copy()
    while True:
        i, j, equal = _chain(x, y)
        before = len(found)
        todo = [(0, len(x), 0, len(y))] if len(i) >= least else []
        while todo:
            x0, x1, y0, y1 = todo.pop()
            a, b = max(np.searchsorted(i, x0), np.searchsorted(j, y0)), min(np.searchsorted(i, x1), np.searchsorted(j, y1))
            if min(x1 - x0, y1 - y0) < width or b - a < least:
                continue
            p, q, k = i[a:b], j[a:b], np.arange(b - a)
            opens = k * (1 + similarity) - similarity * (p + q)
            most = np.maximum.accumulate((opens + 1 - similarity)[::-1])  # from the end on; rises
            far = np.maximum(len(k) - 1 - np.searchsorted(most, opens - 1e-9), k)  # the last match that a passage may end with
            same, n1, n2 = far - k + 1, np.maximum(p[far] - p + 1, width), np.maximum(q[far] - q + 1, width)
            sound = same >= similarity * (n1 + n2 - same) - 1e-9
            if not sound.any():
                continue
            best = int(np.where(sound, n1 + n2, -1).argmax())
            last = int(far[best])
            e1, e2 = min(x1, int(max(p[last] + 1, p[best] + width))), min(y1, int(max(q[last] + 1, q[best] + width)))
            s1, s2 = min(int(p[best]), e1 - width), min(int(q[best]), e2 - width)
            found.append((s1, e1, s2, e2, int(((p >= s1) & (p < e1) & (q >= s2) & (q < e2)).sum())))
            todo += [(x0, s1, y0, s2), (e1, x1, e2, y1)]
        if len(found) == before or equal - sum(f[4] for f in found[before:]) < least:
            return sorted(found)
        for s1, e1, s2, e2, _ in found[before:]:  # no shingle is equal to these any more
            x[s1:e1], y[s2:e2] = _GONE + 2 * np.arange(s1, e1, dtype=np.uint64), _GONE + 2 * np.arange(s2, e2, dtype=np.uint64) + np.uint64(1)


def regions(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``(least and greatest diagonal, from, to)`` of candidates (diagonal, from, to) of two documents: those that meet in both are one region."""
    out: list[tuple[int, int, int, int]] = []
    for d, lo, hi in sorted(parts, key=lambda p: p[1:]):
        slack = (hi - lo) // SLACK
        own = (d, d, (lo - slack) // GRID * GRID, ((hi + slack) // GRID + 1) * GRID)
        while True:
            meets = [r for r in out if r[2] < own[3] and own[2] < r[3] and r[2] + r[0] < own[3] + own[1] and own[2] + own[0] < r[3] + r[1]]
            if not meets:
                break
            out = [r for r in out if r not in meets]
            own = (min(own[0], *(r[0] for r in meets)), max(own[1], *(r[1] for r in meets)), min(own[2], *(r[2] for r in meets)), max(own[3], *(r[3] for r in meets)))
        out.append(own)
    return out


GRID = 64
_GONE = np.uint64(2**63)


def _short(grams: np.ndarray) -> bytes:
    """The lower 32 bits of each: of two stretches of a few hundred shingles one is mistaken for equal with a chance of about 1e-5."""
    return grams.astype("<u4").tobytes()


def _long(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.uint64)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, ref_doc_id, start, ref_start, n_words, similarity)``: passages of at least ``min_words`` words that stand in two documents.

    ``docs`` needs doc_id and text; other columns are ignored. Words are those
    of ``hashing``, positions count words from 0. A passage is a run of words
    that agrees with one of the other document so far that the Jaccard
    similarity of their five-word shingles, equal ones in the same order, is at
    least ``similarity``; words may be replaced, inserted and deleted. n_words
    counts those of doc_id's passage. All documents that share a passage are
    linked with a document that holds it (ref_doc_id), not each with each.
    Texts that are null, empty or shorter than min_words hold none; rows of
    null doc_id are left out; rows of equal doc_id are read as one, that of the
    greatest text. An empty table gives an empty one.
    """
    width = min_words - SHINGLE + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, ref, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(doc, ref, *r) for r in regions([(p["diagonal"], p["lo"], p["hi"]) for p in parts])]
            yield pa.record_batch([pa.array([o[c] for o in out], pa.int64()) for c in range(6)], names=["doc_id", "ref", "dlo", "dhi", "glo", "ghi"])

    candidates = candidate_pairs(docs, min_words, similarity)
    met = candidates.groupBy("doc_id", "ref").agg(F.collect_list(F.struct("diagonal", "lo", "hi")).alias("parts"))
    pairs = written(met.mapInArrow(place, "doc_id long, ref long, dlo long, dhi long, glo long, ghi long"), "passage-pairs")
    drop(candidates._reads)
    # a stretch that many documents are compared with is dealt to as many tasks as they need
    stretch = ["ref", "glo", "ghi"]
    wide = pairs.groupBy(*stretch).count().where(F.col("count") > MEMBERS).select(*stretch, F.ceil(F.col("count") / MEMBERS).cast("int").alias("salts"))
    wide = written(wide, "wide-stretches")
    hint = F.broadcast if small_enough(docs.sparkSession, wide, BROADCAST_ROWS) else (lambda df: df)
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = pairs.join(hint(wide), stretch, "left").select("doc_id", *stretch, "dlo", "dhi", salt.alias("salt"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null").groupBy("id").agg(F.max("text").alias("text"))
    part = F.struct("leads", "owner", "glo", "ghi", "salt", "dlo", "dhi")
    # the stretch of words that each pair needs: once per pair of the document, once per distinct stretch (and salt) of the leader
    own = dealt.select(F.col("doc_id").alias("id"), F.lit(False).alias("leads"), F.col("ref").alias("owner"), "glo", "ghi", "salt", "dlo", "dhi")
    zero = F.lit(0).cast("long")
    theirs = dealt.select(F.col("ref").alias("id"), F.lit(True).alias("leads"), F.col("ref").alias("owner"), "glo", "ghi", "salt", zero.alias("dlo"), zero.alias("dhi")).distinct()
    asked = own.union(theirs).groupBy("id").agg(F.collect_list(part).alias("parts"))
    names = ["leads", "owner", "glo", "ghi", "salt", "dlo", "dhi", "id", "at", "grams"]
    kinds = [pa.bool_(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 4, pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def pieces() -> pa.RecordBatch:
            return pa.record_batch([pa.array([o[c] for o in out], kinds[c]) for c in range(len(names))], names=names)

        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            for first, last, words, bounds in chunks(batch.column(1)):
                for i in range(first, last):
                    grams = shingle_hashes(words[bounds[i - first] : bounds[i - first + 1]], SHINGLE)
                    for p in lists[i].as_py():
                        start, stop = max(p["glo"] + p["dlo"], 0), p["ghi"] + p["dhi"]
                        out.append((*p.values(), ids[i], start, _short(grams[start : max(stop, start)])))
                        if len(out) == 1000:
                            yield pieces()
                            out.clear()
        yield pieces()

    pieces = texts.join(asked, "id").select("id", "text", "parts").mapInArrow(cut, "leads boolean, owner long, glo long, ghi long, salt int, dlo long, dhi long, id long, at long, grams binary")
    group = ["owner", "glo", "ghi", "salt"]
    met = pieces.repartition(*(F.col(c) for c in group)).sortWithinPartitions(*group, F.desc("leads"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ref, at2, y = None, 0, 0, np.empty(0, np.uint64)
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            out = []
            for leads, owner, glo, ghi, salt, dlo, dhi, doc, at1, g1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = _long(g1)
                if leads:
                    key, ref, at2, y = (owner, glo, ghi, salt), doc, at1, x
                    continue
                if key != (owner, glo, ghi, salt):
                    raise RuntimeError(f"the leading stretch of {owner} is missing")
                found = aligned(x, y, width, similarity)
                if not found:  # shingles that repeat may stand in another order, but agree place by place
                    for d in {dlo, dhi}:
                        lo = max(at1 - d, at2)  # in the leader's positions
                        n = max(0, min(at1 - d + len(x), at2 + len(y)) - lo)
                        i, j = lo + d - at1, lo - at2
                        found += [(i + a, i + b, j + a, j + b, same) for a, b, same in alike(x[i : i + n], y[j : j + n], width, similarity)]
                for a, b, c, e, same in found:
                    out.append((doc, ref, at1 + a, at2 + c, b - a + SHINGLE - 1, same / (b - a + e - c - same)))
            yield pa.record_batch([pa.array([o[c] for o in out], pa.float64() if c == 5 else pa.int64()) for c in range(6)], names=["doc_id", "ref_doc_id", "start", "ref_start", "n_words", "similarity"])

    out = written(met.mapInArrow(verify, "doc_id long, ref_doc_id long, start long, ref_start long, n_words long, similarity double"), "passages")
    drop(pairs, wide)
    return out
