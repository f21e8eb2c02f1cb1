"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Which documents can reach the threshold t follows three times:

* a partner of a set of n n-grams holds all of them but (1 - t) * n. Of the
  n-grams that come first in the order of their hashes, taken (1 - t) * n plus a
  fifth of n from each set, two partners share a fifth of the smaller set at
  least: a set that shares fewer with all others together has no partner, and
  most sets end here. Of the shared n-grams of the others the rarest are kept,
  so many that two partners have one of them in common still. Two sets with a
  common one are candidates if sizes and parity bits (two sets whose parities
  differ in d bits differ in d n-grams at least) leave them a chance; sets that
  share an n-gram with PAIRED others or more are linked in a star instead, so
  that it costs a link per set and not one per pair;
* the documents of a large component of candidates are multiplied with a few of
  them, its hubs, first. Those that this already joins into one group need not
  be multiplied with each other: what is left are pairs with one of the others.
  They are cut down by the parity bits of all pairs. The pairs that the bound
  leaves give smaller components;
* documents of a component are multiplied with each other only if the smaller
  has t times the n-grams of the larger. A component is split by size class,
  and within a class into blocks of bounded size; each pair of blocks is a task
  of its own, which accumulates all overlap counts of its documents and gives a
  spanning forest of the pairs that reach the threshold.

None of the bounds loses a pair. Equal sets are one document until the end.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausediff.llm.components import connected_components, forest
from clausediff.llm.hashing import frugal, mix, shingle_sets
from clausediff.llm.storage import drop, small_enough, written

#: Documents of a block, and its n-grams: two blocks and their product take about 150 MB.
BLOCK_DOCS, BLOCK_GRAMS = 1000, 1_000_000
#: Columns of a tile of the dense part of a product; n-grams in fewer documents of a block are counted pair by pair.
TILE, DENSE = 1024, 24
#: Rows that a task gathers before it counts or links them, about 50 MB, and that it posts at once.
HELD, POSTED = 400_000, 100_000
#: Parity bits of a set at least; components of more documents get hubs and are cut down by parities, in blocks of so many
#: (few bytes each: large blocks send a document to few tasks); pairs that are bounded at once.
PARITY, LARGE, PARITY_BLOCK, BOUNDED = 1024, 200, 12_000, 1 << 20
#: Sets of an n-gram that are bounded pair by pair, and the least and most parity bits of a set that travel with each n-gram for that:
#: as many as it has n-grams; those of a set with more n-grams than bits tell less, and none loses a pair.
PAIRED, SKETCH = 1000, (64, 1024)
#: Bits that tell which texts are asked for (2**24: 2 MB), in pieces of 2**15.
ASKED = 1 << 24
#: Hubs of a size class of a component, and the documents that one task multiplies with them.
HUBS, HUB_ROWS = 4, 2000
#: Up to so many rows (about 100 bytes each) a table of components is broadcast; beyond, each of its rows is dealt to SALTS tasks.
BROADCAST_ROWS, SALTS = 200_000, 64


class Segments:
    """Another exact filter, which the join does not use: with a shared passage two sets share small segments. How sets are dealt to segments. Sizes fall into cells; a cell's group reaches as far beyond it as partners of its sets may."""

    def __init__(self, percent: int, largest: int = 1 << 40) -> None:
        self.edges = [1]
        while self.edges[-1] < largest:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * (100 / percent) ** 3)))
        self.high = [(e - 1) * 100 // percent for e in self.edges[1:]]
        self.differ = [(100 - percent) * 2 * h // (100 + percent) for h in self.high]
        # more than can differ, and some for segments without n-grams
        self.count = [d + 1 + 2 + d // 12 for d in self.differ]

    def keys(self, own: np.ndarray) -> np.ndarray:
        """One key for each segment of the set in each of its groups (one or two).

        Sets of few enough n-grams per segment that an equal segment might be
        an empty one have keys for these too; so have their partners then.
        """
        cell = bisect_right(self.edges, len(own)) - 1
        deal, value = mix(own ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32), mix(own + np.uint64(0x14057B7EF767814F))
        out = []
        for j in (cell, cell - 1):
            if j < 0 or j < cell and len(own) > self.high[j]:
                continue
            segment = (deal * np.uint64(self.count[j])) >> np.uint64(32)
            order = np.argsort(segment, kind="stable")
            ranked = segment[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            salt = np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)
            out.append(mix(np.add.reduceat(value[order], first) + ranked[first] * np.uint64(0xD6E8FEB86659FD93) + salt))
            if self.count[j] - len(first) >= self.count[j] - self.differ[j]:
                empty = np.setdiff1d(np.arange(self.count[j], dtype=np.uint64), ranked[first])
                out.append(mix(mix(empty + salt) + np.uint64(1)))
        return np.concatenate(out)


def parity(own: np.ndarray) -> bytes:
    """As many bits as the set has n-grams, to a power of two, PARITY at least: fewer would tell large sets apart no better than chance."""
    size = max(PARITY, 1 << max(0, len(own) - 1).bit_length())
    bits = np.bincount((mix(own ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The parities (rows of 64-bit words) of so many words only."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _signature(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    if not len(own):
        return 0, 0
    a = np.bitwise_xor.reduce(mix(own + np.uint64(0x9E3779B97F4A7C15)))
    b = np.sum(mix(own ^ np.uint64(0xD1B54A32D192ED03)), dtype=np.uint64)
    return int(np.int64(a.astype(np.int64))), int(b.astype(np.int64))


def _sketch(size: int, bits: bytes) -> bytes:
    """The parity bits of a set of so many n-grams, folded to about as many as it has n-grams."""
    least, most = SKETCH
    words = max(least, min(most, 1 << max(0, size - 1).bit_length())) // 64
    return folded(np.frombuffer(bits, np.uint64)[None], words).tobytes()


def set_sizes(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, t, n_shingles, s1, s2, parity, sketch)`` of each row of ``docs`` (doc_id, t, text): the size of its set, a signature of the set, and its parity bits, all and folded."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(own), *_signature(own), bits := parity(own), _sketch(len(own), bits)) for own in shingle_sets(batch.column(2), n)]
            cols = [pa.array([g[i] for g in got], pa.binary() if i >= 3 else pa.int64()) for i in range(5)]
            yield pa.record_batch([batch.column(0), batch.column(1), *cols], names=["doc_id", "t", "n_shingles", "s1", "s2", "parity", "sketch"])

    return docs.select("doc_id", "t", "text").mapInArrow(frugal(sizes), "doc_id long, t long, n_shingles long, s1 long, s2 long, parity binary, sketch binary")


class Prefixes:
    """How many n-grams of a set, least hashes first, are looked up, and how many of them its partners hold at least."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def common(self, size: int) -> int:
        """N-grams that a set shares with any partner; as many has the smallest partner."""
        return -(-self.percent * size // 100)

    def _beyond(self, size: int) -> int:
        return max(1, size // 5)

    def length(self, size: int) -> int:
        return min(size, size - self.common(size) + self._beyond(size))

    def shared(self, size: int) -> int:
        """Of two partners' prefixes the one that ends first lies, but for ``size - common``, in the other: it is the smallest partner's at worst."""
        return self._beyond(self.common(size))


def _runs(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first one: rows of equal values come together, about ``held`` rows at once."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        kept.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(k[0]) for k in kept) >= held:
            cols = [np.concatenate(c) for c in zip(*kept, strict=True)]
            end = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on
            if end:
                yield [c[:end] for c in cols]
            kept = [[c[end:] for c in cols]]
    if kept and sum(len(k[0]) for k in kept):
        yield [np.concatenate(c) for c in zip(*kept, strict=True)]


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pairs_in_groups(first: np.ndarray, size: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of each two members of each group (first member, members), about ``most`` pairs at once."""
    end = np.cumsum(size)
    after = np.repeat(end, size) - 1 - np.arange(size.sum())
    rows = np.repeat(first - end + size, size) + np.arange(len(after))
    total, at = np.cumsum(after), 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        n, own = after[at:end], rows[at:end]
        a = np.repeat(own, n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = end


class Sketches:
    """Folded parity bits of sets of so many n-grams, by which pairs of them are bounded."""

    def __init__(self, size: np.ndarray, raw: list[bytes], percent: int) -> None:
        self.size, self.percent = size, percent
        self.words = np.array([len(r) // 8 for r in raw], np.int64)
        self.place, self.bits = {}, {}
        for w in np.unique(self.words).tolist():  # of all sets with as many words or more
            place, parts, at = np.zeros(len(raw), np.int64), [], 0
            for longer in np.unique(self.words[self.words >= w]).tolist():
                own = np.flatnonzero(self.words == longer)
                place[own] = np.arange(at, at + len(own))
                parts.append(folded(np.frombuffer(b"".join(raw[i] for i in own), np.uint64).reshape(len(own), -1), w))
                at += len(own)
            self.place[w], self.bits[w] = place, np.concatenate(parts)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs a[i], b[i] may reach the threshold."""
        total, apart = self.size[a] + self.size[b], np.abs(self.size[a] - self.size[b])
        least = lambda apart, total: (100 + self.percent) * (total - apart) >= 2 * self.percent * total
        left = least(apart, total)
        words = np.minimum(self.words[a], self.words[b])
        for w, bits in self.bits.items():
            rows = np.flatnonzero(left & (words == w))
            x, y = self.place[w][a[rows]], self.place[w][b[rows]]
            differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            left[rows] = least(np.maximum(differ, apart[rows]), total[rows])
        return left


def candidate_links(docs: DataFrame, n: int, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """``(a, b)`` links of sets (their s1, see ``set_sizes``) that may reach the threshold. Equal sets are one; ``sets`` has s1, size and sketch of each, and is made if absent."""
    prefixes = Prefixes(percent)
    if sets is None:
        own = set_sizes(docs.where("doc_id is not null").withColumn("t", F.lit(0).cast("long")), n)
        sets = own.groupBy("s1").agg(F.max("n_shingles").alias("size"), F.max("sketch").alias("sketch"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, names, needs, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            size = [len(g) for g in grams]
            cols = [np.concatenate(grams).view(np.int64), np.repeat(np.array(names, np.int64), size), np.repeat(np.array(needs, np.int32), size)]
            return pa.record_batch([pa.array(c) for c in cols], names=["gram", "s1", "need"])

        for batch in batches:
            for own in shingle_sets(batch.column(0), n):
                if len(own):
                    grams.append(own[: prefixes.length(len(own))])
                    names.append(_signature(own)[0])
                    needs.append(prefixes.shared(len(own)))
                    held += len(grams[-1])
                if held >= POSTED:
                    yield out()
                    grams, names, needs, held = [], [], [], 0
        if held:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by n-gram, those whose n-gram several sets hold, and how many."""
        for gram, s1, need in _runs(batches, HELD):
            order = np.lexsort((s1, gram))
            gram, s1, need = gram[order], s1[order], need[order]
            new = _starts(gram, s1)
            gram, s1, need = gram[new], s1[new], need[new]
            first = _starts(gram)
            size = np.diff(np.append(first, len(gram)))
            size = np.repeat(size, size)
            many = size > 1
            yield pa.record_batch([pa.array(s1[many]), pa.array(gram[many]), pa.array(need[many]), pa.array(size[many])], names=["s1", "gram", "need", "sets"])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by set, the n-grams by which the sets that share enough are found."""
        for s1, gram, need, sets in _runs(batches, HELD):
            order = np.lexsort((gram, sets, s1))
            s1, gram, need = s1[order], gram[order], need[order]
            first = _starts(s1)
            size = np.diff(np.append(first, len(s1)))
            rank = np.arange(len(s1)) - np.repeat(first, size)
            kept = rank <= np.repeat(size, size) - need
            yield pa.record_batch([pa.array(gram[kept]), pa.array(s1[kept])], names=["gram", "s1"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, s1, size, raw in _runs(batches, HELD // 4):
            first = _starts(gram)
            sets = np.diff(np.append(first, len(gram)))
            least = np.repeat(np.minimum.reduceat(s1, first), sets)
            many = np.repeat(sets > PAIRED, sets) & (s1 != least)
            us, vs = [s1[many]], [least[many]]
            few = (sets > 1) & (sets <= PAIRED)
            sketches = Sketches(size, raw.tolist(), percent)
            for a, b in pairs_in_groups(first[few], sets[few], BOUNDED // 8):
                near = sketches.near(a, b)
                u, v = forest(s1[a[near]], s1[b[near]])
                us.append(u)
                vs.append(v)
            a, b = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    posted = docs.where("doc_id is not null").select("text").mapInArrow(frugal(post), "gram long, s1 long, need int")
    several = posted.repartition(F.col("gram")).sortWithinPartitions("gram").mapInArrow(frugal(count), "s1 long, gram long, need int, sets long")
    found = several.repartition(F.col("s1")).sortWithinPartitions("s1").mapInArrow(frugal(rarest), "gram long, s1 long")
    told = found.hint("merge").join(sets.select("s1", "size", "sketch"), "s1").select("gram", "s1", "size", "sketch")
    return told.repartition(F.col("gram")).sortWithinPartitions("gram").mapInArrow(frugal(link), "a long, b long")


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Overlap counts of each two of ``sets``, or of each of ``sets`` with each of ``others``."""
    rows = sets if others is None else sets + others
    n, left = len(rows), len(sets)
    out = np.zeros((n, n), np.int32)
    grams = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(grams)))
    del grams
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])[order]  # ascending within an n-gram
    del order
    # n-grams of few documents: one addition per pair, grouped by how many documents hold the n-gram
    for k in range(2, DENSE):
        at = first[count == k]
        for part in (at[a : a + (1 << 17)] for a in range(0, len(at), 1 << 17)):
            for i in range(k):
                for j in range(i + 1, k):
                    np.add.at(out, (owner[part + i], owner[part + j]), 1)
    # the others: tiles of a dense product
    many = np.flatnonzero(count >= DENSE)
    for tile in (many[a : a + TILE] for a in range(0, len(many), TILE)):
        size = count[tile]
        spots = np.repeat(first[tile] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        matrix = np.zeros((n, len(tile)), np.float32)
        matrix[owner[spots], np.repeat(np.arange(len(tile)), size)] = 1
        for a in range(0, n, 256):
            out[a : a + 256, a:] += (matrix[a : a + 256] @ matrix[a:].T).astype(np.int32)
    if others is not None:
        return out[:left, left:]
    out = np.triu(out, 1)
    return out + out.T


def reaching(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs with 100 * intersection >= percent * union."""
    both = overlaps(sets, others)
    a = np.array([len(s) for s in sets], np.int64)
    b = a if others is None else np.array([len(s) for s in others], np.int64)
    found = []
    for at in range(0, len(a), 256):
        part = both[at : at + 256].astype(np.int64)
        x, y = np.nonzero(((100 + percent) * part >= percent * (a[at : at + 256, None] + b)) & (part > 0))
        found.append((x + at, y))
    x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    return (x[x < y], y[x < y]) if others is None else (x, y)


def _beside(df: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of ``df`` (doc_id and ``keys``) with the written table ``plan``, which has one row for each ``keys``; many rows of a key don't meet in a task."""
    if small_enough(df.sparkSession, plan, BROADCAST_ROWS):
        return df.join(F.broadcast(plan), keys, "left")
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(plan, [*keys, "salt"], "left").drop("salt")


def _size_class(percent: int) -> Column:
    """Sets that may reach the threshold are of one class or of neighbouring ones; the step is a little wider, for rounding."""
    return F.floor(F.log("size") / (math.log(100 / percent) * 1.0001)).cast("int")


def _blocks(docs: Column, grams: Column, most_docs: int, most_grams: int) -> Column:
    return F.greatest(F.ceil(docs / most_docs), F.ceil(grams / most_grams)).cast("int")


def _dealt(met: DataFrame, percent: int, most_docs: int, most_grams: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, t, size, parity, block, first)``: the tasks that each document of ``met`` (doc_id, t, cluster, size, parity, settled) is in.

    A cluster that fits is one task. Else its documents fall into size classes
    and blocks of a class, of settled documents and of others; a task is two
    blocks of a class or of neighbouring ones, not both of settled documents,
    and ``first`` tells whether a document is of the first block. Clusters of
    one document have no task. The second table is the plan, to be dropped when
    the first is read.
    """
    met = met.withColumn("class", _size_class(percent))
    open_docs, open_grams = F.sum((~F.col("settled")).cast("int")), F.sum(F.when(~F.col("settled"), F.col("size")).otherwise(0))
    classes = met.groupBy("cluster", "class").agg(F.count("*").alias("docs"), F.sum("size").alias("grams"), open_docs.alias("open_docs"), open_grams.alias("open_grams"))
    classes = written(classes, "size-classes")
    large = classes.groupBy("cluster").agg(F.sum("docs").alias("d"), F.sum("grams").alias("g")).where((F.col("d") > most_docs) | (F.col("g") > most_grams)).select("cluster")
    # blocks of a class: first those of open documents, then those of settled ones
    opened = _blocks(F.col("open_docs"), F.col("open_grams"), most_docs, most_grams)
    closed = _blocks(F.col("docs") - F.col("open_docs"), F.col("grams") - F.col("open_grams"), most_docs, most_grams)
    own = classes.join(large, "cluster", "left_semi").select("cluster", "class", opened.alias("o"), (opened + closed).alias("n"))
    none = F.lit(0)
    sides = F.array(
        F.struct(F.col("class"), "o", "n", none.alias("ao"), none.alias("an"), none.alias("bo"), none.alias("bn")),
        F.struct((F.col("class") - 1).alias("class"), none.alias("o"), none.alias("n"), F.col("o").alias("ao"), F.col("n").alias("an"), none.alias("bo"), none.alias("bn")),
        F.struct((F.col("class") + 1).alias("class"), none.alias("o"), none.alias("n"), none.alias("ao"), none.alias("an"), F.col("o").alias("bo"), F.col("n").alias("bn")),
    )
    near = own.select("cluster", F.explode(sides).alias("x")).select("cluster", "x.*").groupBy("cluster", "class")
    plan = written(near.agg(*(F.sum(c).cast("int").alias(c) for c in ("o", "n", "ao", "an", "bo", "bn"))).where("n > 0"), "block-plan")
    drop(classes)
    placed = _beside(met, plan, ["cluster", "class"])
    # a cluster that fits: its rows are few
    whole = placed.where("n is null").withColumn("docs", F.count("*").over(Window.partitionBy("cluster"))).where("docs > 1")
    whole = whole.select("doc_id", "t", "size", "parity", F.col("cluster").cast("string").alias("block"), F.lit(True).alias("first"))
    split = placed.where("n is not null")
    at = F.when(F.col("settled"), F.col("o") + F.pmod(F.xxhash64("doc_id"), F.greatest(F.col("n") - F.col("o"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("doc_id"), F.greatest("o", F.lit(1)))).cast("int")
    task = lambda c1, b1, c2, b2: F.struct(c1.cast("int").alias("c1"), b1.cast("int").alias("b1"), c2.cast("int").alias("c2"), b2.cast("int").alias("b2"))
    c, b = F.col("class"), F.col("at")

    def each(open_blocks: str, blocks: str, make) -> Column:  # noqa: ANN001
        most = F.when(F.col("settled"), F.col(open_blocks)).otherwise(F.col(blocks))
        return F.when(most > 0, F.transform(F.sequence(F.lit(0), most - 1), make)).otherwise(F.array().cast("array<struct<c1:int,b1:int,c2:int,b2:int>>"))

    meets = F.concat(
        each("o", "n", lambda i: task(c, F.least(b, i), c, F.greatest(b, i))),
        each("ao", "an", lambda i: task(c, b, c + 1, i)),
        each("bo", "bn", lambda i: task(c - 1, i, c, b)),
    )
    tasks = split.withColumn("at", at).select("doc_id", "t", "size", "parity", "cluster", "class", "at", F.explode(meets).alias("m"))
    first = (F.col("class") == F.col("m.c1")) & (F.col("at") == F.col("m.b1"))
    name = F.concat_ws(":", *(F.col(x).cast("string") for x in ("cluster", "m.c1", "m.b1", "m.c2", "m.b2")))
    return whole.union(tasks.select("doc_id", "t", "size", "parity", name.alias("block"), first.alias("first"))), plan


def within_bounds(size1: np.ndarray, bits1: np.ndarray, size2: np.ndarray, bits2: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs sizes and parity bits (rows of 64-bit words) leave a chance to reach the threshold."""
    words = min(bits1.shape[1], bits2.shape[1])
    bits1, bits2 = folded(bits1, words), folded(bits2, words)
    apart = np.zeros((len(size1), len(size2)), np.int32)
    for w in range(words):
        apart += np.bitwise_count(bits1[:, w, None] ^ bits2[None, :, w])
    total = size1[:, None] + size2[None, :]
    apart = np.maximum(apart, np.abs(size1[:, None] - size2[None, :]))
    return (100 + percent) * (total - apart) >= 2 * percent * total


def bounded_pairs(size1: np.ndarray, raw1: list[bytes], size2: np.ndarray, raw2: list[bytes], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that the bounds leave, by lengths of parities."""

    def by_length(raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        length = np.array([len(r) for r in raw])
        groups = [np.flatnonzero(length == n) for n in np.unique(length)]
        return [(g, np.frombuffer(b"".join(raw[i] for i in g), np.uint64).reshape(len(g), -1)) for g in groups]

    others = by_length(raw2)
    for rows, bits in by_length(raw1):
        for cols, theirs in others:
            # sets of this length and that may be too far apart in size, whatever their bits
            if 100 * size1[rows].max() < percent * size2[cols].min() or 100 * size2[cols].max() < percent * size1[rows].min():
                continue
            step = max(1, BOUNDED // len(cols))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                x, y = np.nonzero(within_bounds(size1[part], bits[at : at + step], size2[cols], theirs, percent))
                yield part[x], cols[y]


def _told(docs: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` and _told: whether bits of the hashes of ``keys``' columns ``names``, which are broadcast, have the row's: true of rows that ``keys`` has, and of a few more."""
    spot = F.pmod(F.xxhash64(*names), F.lit(ASKED))
    at = lambda df: df.withColumn("_piece", F.shiftright(spot, 15)).withColumn("_bit", spot.bitwiseAND(F.lit((1 << 15) - 1)))
    bits = at(keys).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    told = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) % 2 = 1")
    return at(docs).join(F.broadcast(bits), "_piece", "left").withColumn("_told", F.coalesce(told, F.lit(False))).drop("_piece", "_bit", "_bits")


def maybe_among(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and t ``keys`` has, and a few more: bits of the keys' hashes, broadcast, keep the other texts out of a shuffle."""
    return _told(docs, keys, ["doc_id", "t"]).where("_told").drop("_told")


def _texts_of(docs: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text, block, first)``: the text of each document of ``tasks``, once for each of its tasks, dealt and sorted by block, first ones first; and a table to be dropped when this is read."""
    own = written(tasks.groupBy("doc_id", "t").agg(F.collect_list(F.struct("block", "first")).alias("tasks")), "text-tasks")
    texts = maybe_among(docs, own).join(own, ["doc_id", "t"]).groupBy("doc_id", "t").agg(F.max("text").alias("text"), F.max("tasks").alias("tasks"))
    placed = texts.select("doc_id", "text", F.explode("tasks").alias("t")).select("doc_id", "text", "t.block", "t.first")
    return placed.repartition(F.col("block")).sortWithinPartitions("block", F.desc("first")), own


def _hub_links(docs: DataFrame, met: DataFrame, n: int, percent: int) -> DataFrame:
    """``(a, b)`` links of the documents of ``met`` (doc_id, t, cluster, size) with hubs of their cluster, of their size class and the ones beside it."""
    met = met.withColumn("class", _size_class(percent)).withColumn("h", F.xxhash64("doc_id", "t"))
    hubs = met.groupBy("cluster", "class", F.pmod("h", F.lit(HUBS)).alias("slot")).agg(F.min(F.struct("h", "doc_id", "t")).alias("hub"))
    tasks = written(met.groupBy("cluster", "class").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("salts")), "hub-tasks")
    beside = hubs.select("cluster", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), "hub.doc_id", "hub.t")
    name = lambda salt: F.concat_ws(":", F.col("cluster").cast("string"), F.col("class").cast("string"), salt.cast("string"))
    leading = beside.join(tasks, ["cluster", "class"]).select("doc_id", "t", "cluster", "class", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    leading = leading.select("doc_id", "t", name(F.col("salt")).alias("block"), F.lit(True).alias("first"))
    members = _beside(met, tasks, ["cluster", "class"]).select("doc_id", "t", name(F.pmod("h", F.col("salts"))).alias("block"), F.lit(False).alias("first"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, heads = None, []
        for batch in batches:
            names, blocks, firsts, a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), [], []
            for i, own in enumerate(shingle_sets(batch.column(1), n)):
                if blocks[i] != block:
                    block, heads = blocks[i], []
                if firsts[i]:
                    heads.append((names[i], own))
                    continue
                for name_of, head in heads:
                    short, long = (own, head) if len(own) <= len(head) else (head, own)
                    if 100 * len(short) >= percent * len(long):
                        both = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
                        if (100 + percent) * both >= percent * (len(own) + len(head)):
                            a.append(names[i])
                            b.append(name_of)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    placed, asked = _texts_of(docs, members.union(leading))
    links = written(placed.mapInArrow(frugal(multiply), "a long, b long"), "hub-links")
    drop(tasks, asked)
    return links


def _settle(met: DataFrame, links: DataFrame) -> DataFrame:
    """``met`` with settled: whether a document is of the group of its cluster that ``links`` joins most documents of; a written table."""
    groups = connected_components(links)
    joined = written(met.join(groups.withColumnRenamed("id", "doc_id").withColumnRenamed("component", "of"), "doc_id", "left").select(*met.columns, "of"), "hub-groups")
    largest = joined.where("of is not null").groupBy("cluster", "of").count().groupBy("cluster").agg(F.max(F.struct("count", "of")).alias("m"))
    largest = written(largest.select("cluster", F.col("m.of").alias("largest")), "hub-largest")
    out = written(_beside(joined, largest, ["cluster"]).select(*met.columns, F.coalesce(F.col("of") == F.col("largest"), F.lit(False)).alias("settled")), "settled")
    drop(groups, joined, largest)
    return out


def _cut_down(met: DataFrame, percent: int) -> DataFrame:
    """``met`` (see ``_dealt``) with its clusters replaced by the components that the bounds leave of them; a written table."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, size, raw, first) in _by_block(batches, (0, 1, 2, 4)):
            names, n, side = np.array(ids, np.int64), np.array(size, np.int64), np.array(first, bool)
            a = np.flatnonzero(side)
            b = a if side.all() else np.flatnonzero(~side)
            us, vs = [], []
            for x, y in bounded_pairs(n[a], [raw[i] for i in a], n[b], [raw[i] for i in b], percent):
                u, v = forest(names[a[x]], names[b[y]])
                us.append(u)
                vs.append(v)
            if us:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                yield pa.record_batch([pa.array(u), pa.array(v)], names=["a", "b"])

    tasks, plan = _dealt(met, percent, PARITY_BLOCK, 1 << 60)
    tasks = tasks.select("doc_id", "size", "parity", "block", "first")
    parts = connected_components(tasks.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(frugal(compare), "a long, b long"))
    own = met.drop("cluster").join(parts.select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "doc_id")
    out = written(own.select(*met.columns), "parts")
    drop(plan, parts)
    return out


def _by_block(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...]) -> Iterator[tuple[str, list[list]]]:
    """Rows of each block (column 3) of batches sorted by it: lists of the columns."""
    block, held = None, [[] for _ in columns]
    for batch in batches:
        blocks, values = batch.column(3).to_pylist(), [batch.column(c).to_pylist() for c in columns]
        for i, name in enumerate(blocks):
            if name != block:
                if held[0]:
                    yield block, held
                block, held = name, [[] for _ in columns]
            for h, v in zip(held, values, strict=True):
                h.append(v[i])
    if held[0]:
        yield block, held


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents link when the sets of their distinct ``n``-word shingles
    (words as in ``hashing``) have 100 * intersection >= percent * union; a text
    with fewer words has its whole sequence as the only shingle. component_id
    is the smallest doc_id that a document reaches by links, itself included.
    Documents without words, null texts too, have 0 shingles and link with
    nothing. Rows of equal doc_id are one vertex, with the links of all their
    texts; rows of null doc_id link with nothing and have a null component. An
    empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    sizes = written(set_sizes(docs, n), "set-sizes")
    # one document of each set stands for all; t tells the texts of repeated ids apart
    sound = sizes.where("n_shingles > 0 and doc_id is not null")
    same = sound.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.max("n_shingles").alias("size"), F.max("parity").alias("parity"), F.max("sketch").alias("sketch"), F.count("*").alias("rows"))
    same = written(same.select("rep.doc_id", "rep.t", "s1", "s2", "size", "parity", "sketch", "rows"), "sets")
    clusters = connected_components(candidate_links(docs, n, percent, same))
    met = same.select("doc_id", "t", "s1", "size", "parity").join(clusters.withColumnRenamed("id", "s1").withColumnRenamed("component", "cluster"), "s1")
    met = written(met.select("doc_id", "t", "cluster", "size", "parity"), "candidates")
    counts = met.groupBy("cluster").agg(F.count("*").alias("d")).where(F.col("d") > LARGE)
    large = written(counts.select("cluster", F.lit(True).alias("large")), "large-clusters")
    flagged = written(_beside(met, large, ["cluster"]), "flagged")
    drop(clusters, met, large)
    met = flagged.where("large is null").select("doc_id", "t", "cluster", "size", "parity", F.lit(False).alias("settled"))
    inside = flagged.where("large").drop("large")
    linked, extra = [], []
    if inside.take(1):
        hub_links = _hub_links(docs, inside, n, percent)
        settled = _settle(inside, hub_links)
        parts = _cut_down(settled, percent)
        linked, extra = [hub_links], [settled, parts]
        met = met.union(parts.select(*met.columns))
    tasks, plan = _dealt(met, percent, BLOCK_DOCS, BLOCK_GRAMS)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sets, side = None, [], [], []

        def out() -> Iterator[pa.RecordBatch]:
            if len(ids) < 2:
                return
            names, first = np.array(ids, np.int64), np.array(side)
            if first.all():
                x, y = reaching(sets, None, percent)
            elif first.any():
                a, b = np.flatnonzero(first), np.flatnonzero(~first)
                x, y = reaching([sets[i] for i in a], [sets[i] for i in b], percent)
                x, y = a[x], b[y]
            else:
                return
            u, v = forest(names[x], names[y])
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["a", "b"])

        for batch in batches:
            blocks, firsts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            docs_of = batch.column(0).to_pylist()
            for i, own in enumerate(shingle_sets(batch.column(1), n)):
                if blocks[i] != block:
                    yield from out()
                    block, ids, sets, side = blocks[i], [], [], []
                ids.append(docs_of[i])
                sets.append(own)
                side.append(firsts[i])
        yield from out()

    placed, asked = _texts_of(docs, tasks)
    links = written(placed.mapInArrow(frugal(multiply), "a long, b long"), "copy-links")
    drop(plan, flagged, asked, *extra)
    # every document with its set's least document, and the links between sets
    equal = sound.join(same.where("rows > 1").select(F.col("doc_id").alias("least"), "s1", "s2"), ["s1", "s2"]).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    every = links.union(equal)
    for more in linked:
        every = every.union(more)
    found = connected_components(every)
    out = written(sizes.join(found, sizes.doc_id == found.id, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "copy-components")
    drop(links, *linked, found, sizes, same)
    return out


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the smallest of its component; rows of null doc_id stay."""
    gone = jaccard_components(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    # most rows stay for sure: they need no join, and their texts no shuffle
    told = _told(docs.withColumn("_gone", F.col("doc_id").cast("long")), gone, ["_gone"])
    maybe = told.where("_told").join(gone, "_gone", "left_anti").select(*told.columns)
    return told.where("not _told").union(maybe).drop("_told", "_gone")
