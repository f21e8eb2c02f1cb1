"""Near copies among embeddings by randomised-rotation binary codes.

Each vector, made a unit vector and turned by a random rotation, is stored as
the signs of its coordinates and a correction factor: the inner product of the
unit vector with its code's unit vector. For a second vector q the quotient of
<q, code> and the factor estimates <q, vector> without bias, and its error
stays within EPSILON * sqrt((1 - factor**2) / (factor**2 * (D - 1))) but for a
chance that falls exponentially with EPSILON squared (Gao and Long, 2024).
Pairs whose bound reaches the threshold are computed again in double
precision; no others are.

Vectors are dealt to the cells of centroids fitted on a bounded sample: a
vector lives in the nearest cell and visits the next ones, and a pair is
compared where one of the two lives and the other lives or visits. Cells grow
in number with the square root of the vectors, and the cells that are visited
with them: the least number that brings together RECALL of the pairs at the
threshold, measured with the centroids in use on sampled vectors they are not
fitted on and partners made for those.

A visitor comes as its code only, some 30 bytes; those that live in a cell, in
blocks of bounded size, bring their vectors, once each. That sifts out who
needs whom, and only vectors of pairs that the bounds leave travel again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.llm.components import connected_components, forest
from clausediff.llm.storage import drop, written

#: Cells that a vector is in at least; vectors that centroids are fitted on; centroids at most (each D doubles, broadcast).
PROBES, SAMPLE, MAX_CELLS = 6, 20_000, 4096
#: Vectors that live in a block, and visitors that are compared with them at once: their estimates take about 50 MB.
BLOCK, VISITORS = 2000, 2048
EPSILON = 3.0
#: Share of the pairs at the threshold that must meet in a cell, and pairs on which it is measured.
RECALL, TRIALS = 0.995, 4000


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass
class Codes:
    signs: np.ndarray  #: +1 or -1, as bits: D / 8 bytes a vector
    factor: np.ndarray  #: inner product of the vector with its code's unit vector


def encode(units: np.ndarray, turn: np.ndarray) -> Codes:
    turned = units @ turn.T
    return Codes(np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / math.sqrt(units.shape[1]))


def upper_bounds(units: np.ndarray, codes: Codes, turn: np.ndarray) -> np.ndarray:
    """For each two rows an upper bound on the inner product of ``units[i]`` and the vector of code j."""
    return _bounds((units @ turn.T).astype(np.float32), codes)


def _bounds(turned: np.ndarray, codes: Codes) -> np.ndarray:
    dim = turned.shape[1]
    signs = (np.unpackbits(codes.signs, axis=1, count=dim).astype(np.float32) * 2 - 1) / math.sqrt(dim)
    margin = EPSILON * np.sqrt(np.maximum(0, 1 - codes.factor**2) / codes.factor**2 / max(dim - 1, 1))
    return turned @ signs.T / codes.factor.astype(np.float32) + margin.astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; a scale of its largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:cells]]
    for _ in range(rounds):
        best = np.concatenate([(sample[a : a + 4096] @ centroids.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, best, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, threshold: float, least: int = PROBES, seed: int = 7) -> int:
    """The least number of cells, ``least`` or more, with which RECALL of the pairs of cosine ``threshold`` meet.

    ``sample`` must be unit vectors that the centroids are not fitted on, which
    lie no nearer to them than any. Partners lie in random directions, and towards
    other vectors of the sample; the harder of the two decides.
    """
    rng = np.random.default_rng(seed)
    most = len(centroids)
    if most <= least or not len(sample) or sample.shape[1] < 2:
        return min(least, most)
    u = sample[rng.integers(0, len(sample), TRIALS)]
    need = least
    for towards in (rng.standard_normal(u.shape), sample[rng.integers(0, len(sample), TRIALS)]):
        aside = towards - (towards * u).sum(1, keepdims=True) * u
        size = np.linalg.norm(aside, axis=1)
        some = size > 1e-6  # a vector may have been dealt itself
        a, b = u[some], threshold * u[some] + math.sqrt(max(0.0, 1 - threshold**2)) * aside[some] / size[some, None]
        if not len(a):
            continue
        near_a, near_b = a @ centroids.T, b @ centroids.T
        row, home_a, home_b = np.arange(len(a)), near_a.argmax(1), near_b.argmax(1)
        # the place of each one's home among the other's nearest cells: either lets them meet
        place_b = (near_a > near_a[row, home_b][:, None]).sum(1)
        place_a = (near_b > near_b[row, home_a][:, None]).sum(1)
        place = np.sort(np.minimum(place_a, place_b))
        need = max(need, int(place[min(len(place) - 1, math.ceil(RECALL * len(place)) - 1)]) + 1)
    return min(need, most)


@dataclass
class Residents:
    """Those that live in a block of a cell."""

    cell: int
    ids: np.ndarray
    x: np.ndarray
    cells: np.ndarray  #: their own and those that they visit
    turned: np.ndarray

    def candidates(self, ids: np.ndarray, home: np.ndarray, codes: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs of a resident and a visitor (ids, home, codes) whose bound reaches the threshold and that count here: each pair once in all cells."""
        r, v = np.nonzero(_bounds(self.turned, codes) >= threshold)
        same = home[v] == self.cell  # both live here: each meets the other
        twice = (self.cells[r] == home[v][:, None]).any(1) & ~same  # the resident visits the visitor's cell, too
        keep = np.where(same, self.ids[r] < ids[v], ~twice | (self.cell < home[v]))
        return r[keep], v[keep]


def reaching(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows a of x and b of y) whose cosine in double precision is at least ``threshold``."""
    reach = np.empty(len(a), bool)
    for s in range(0, len(a), 1 << 16):
        u, v = x[a[s : s + (1 << 16)]], y[b[s : s + (1 << 16)]]
        dot = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
        reach[s : s + (1 << 16)] = dot >= threshold
    return a[reach], b[reach]


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int] | None, int, pa.RecordBatch | None]]:
    """Runs of rows (cell, block, role, ...) of one cell, block and role; a run may come in pieces, each of VISITORS rows at most, and (None, 0, None) ends all."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            for at in range(lo, hi, VISITORS):
                yield (int(keys[lo, 0]), int(keys[lo, 1])), int(keys[lo, 2]), batch.slice(at, min(hi, at + VISITORS) - at)
    yield None, 0, None


def near_vectors(vectors: DataFrame, threshold: float = 0.9, probes: int = PROBES) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each row of ``vectors`` (vec_id, embedding; other columns are ignored).

    Two vectors link if they are found and their cosine in double precision is
    at least ``threshold``. Equal vectors are always found: they are compared
    as one and counted as many. n_links counts the other rows a row links with,
    component_id is the smallest vec_id that it reaches, itself included, and
    kept says whether that is its own. Vectors that are null, empty, zero, of
    another length than most, or that hold null or non-finite components link
    with nothing; rows of null vec_id too, and their component is null. Rows
    of equal vec_id are rows of their own that belong to one component. An
    empty table gives an empty one.
    """
    spark = vectors.sparkSession
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda v: v != 0)
    good = rows.where(sound)
    dims = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dim = dims.d
    good = good.where(F.size("v") == dim)
    classes = written(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    count = classes.count()
    sampled = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    sample = _unit(_matrix(sampled["v"].combine_chunks()))
    turn = rotation(dim)
    held, sample = np.split(sample, [len(sample) // 10])
    k = int(min(MAX_CELLS, max(1, math.sqrt(count) / 2), len(sample)))
    fitted = fit_centroids(sample, k)
    model = spark.sparkContext.broadcast((fitted, turn))
    probes = probes_for(held, fitted, threshold, probes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, turn = model.value
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1)))
                near = np.concatenate([np.argsort(-(x[a : a + 1024] @ centroids.T), axis=1, kind="stable")[:, : min(probes, len(centroids))] for a in range(0, len(x), 1024)])
                codes = encode(x, turn)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat, pa.array([c.tobytes() for c in codes.signs], pa.binary()), pa.array(codes.factor)], names=["id", "v", "copies", "cells", "code", "factor"])

    placed = written(classes.select("id", "v", "copies").mapInArrow(place, "id long, v array<double>, copies long, cells array<int>, code binary, factor double"), "vector-codes")
    homes = placed.groupBy(F.col("cells")[0].alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    homes = written(homes, "cell-blocks")
    blocks = F.broadcast(homes)  # at most MAX_CELLS rows
    living = placed.select(F.col("cells")[0].alias("cell"), "id", "v", "cells").join(blocks, "cell")
    living = living.select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "id", F.col("cell").alias("home"), "v", "cells", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("factor"))
    visiting = placed.select(F.explode("cells").alias("cell"), "id", F.col("cells")[0].alias("home"), "code", "factor").join(blocks, "cell")
    visiting = visiting.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "id", "home", F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("array<int>").alias("cells"), "code", "factor")

    def residents(key: tuple[int, int], parts: list[pa.RecordBatch]) -> Residents:
        table = pa.Table.from_batches(parts).combine_chunks()
        x = _matrix(table["v"].chunk(0))
        cells = table["cells"].chunk(0).flatten().to_numpy().reshape(len(x), -1)
        return Residents(key[0], table["id"].to_numpy(), x, cells, (_unit(x) @ model.value[1].T).astype(np.float32))

    def visitors(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Codes]:
        width = (dim + 7) // 8
        signs = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, width)
        return part.column("id").to_numpy(), part.column("home").to_numpy(), Codes(signs, part.column("factor").to_numpy())

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Who has a candidate in which block."""
        key, parts, here, needed = None, [], None, np.empty(0, bool)

        def out(role: int, ids: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(ids), c, np.int32)) for c in (*key, role)] + [pa.array(ids)], names=["cell", "block", "role", "id"])

        for own, role, part in _by_cell(batches):
            if own != key:
                if here is not None:
                    yield out(0, here.ids[needed])
                key, parts, here = own, [], None
            if part is None:
                continue
            if role == 0:
                parts.append(part)
                continue
            if here is None and parts:
                here = residents(key, parts)
                needed = np.zeros(len(here.ids), bool)
            if here is not None:
                ids, home, codes = visitors(part)
                r, v = here.candidates(ids, home, codes, threshold)
                needed[r] = True
                yield out(1, ids[np.unique(v)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, here, copies, links = None, [], None, np.empty(0), np.empty(0)

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b.astype(np.int64))], names=["kind", "a", "b"])

        for own, role, part in _by_cell(batches):
            if own != key:
                if here is not None:
                    yield out(1, here.ids[links > 0], links[links > 0])
                key, parts, here = own, [], None
            if part is None:
                continue
            if role == 0:
                parts.append(part)
                continue
            if here is None:
                here = residents(key, parts)
                copies = np.concatenate([p.column("copies").to_numpy() for p in parts])
                links = np.zeros(len(copies))
            ids, home, codes = visitors(part)
            y, theirs = _matrix(part.column("v")), part.column("copies").to_numpy()
            r, v = reaching(here.x, y, *here.candidates(ids, home, codes, threshold), threshold)
            links += np.bincount(r, theirs[v], len(copies))
            count = np.bincount(v, copies[r], len(ids))
            yield out(1, ids[count > 0], count[count > 0])
            yield out(0, *forest(here.ids[r], ids[v]))

    dealt = living.union(visiting).repartition(F.col("cell"), F.col("block")).sortWithinPartitions("cell", "block", "role")
    met = written(dealt.mapInArrow(sift, "cell int, block int, role int, id long"), "vector-candidates")
    again = met.join(placed.select("id", F.col("cells")[0].alias("home"), "v", "cells", "code", "factor", "copies"), "id")
    again = again.select("cell", "block", "role", "id", "home", "v", "cells", "code", "factor", "copies").repartition(F.col("cell"), F.col("block")).sortWithinPartitions("cell", "block", "role")
    found = again.mapInArrow(compare, "kind byte, a long, b long")
    found = written(found, "vector-links")
    drop(met)
    links = found.where("kind = 1").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    # a row's links: its equals, and every copy of the classes that its class links with
    per_class = placed.select("id", F.col("copies")).join(links, "id", "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    members = good.select("vec_id", "v").join(classes.select("v", "id"), "v").select("vec_id", "id").join(per_class, "id")
    members = written(members, "vector-members")
    edges = found.where("kind = 0").select("a", "b").union(members.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")))
    component = connected_components(edges)
    done = written(members.join(component.withColumnRenamed("id", "x"), F.col("vec_id") == F.col("x"), "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id")), "vector-components")
    drop(classes, placed, homes, found, members, component)
    odd = rows.where(~F.coalesce(sound & (F.size("v") == dim), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(odd).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
