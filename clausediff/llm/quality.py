"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are embedded and convolved by learned filters; each
filter's largest response within overlapping chunks describes a chunk, a
hidden layer gives each chunk a logit, and the document's probability combines
the largest, the smallest and the mean logit of its chunks. The chunks cover
the whole text, whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.llm import hashing
from clausediff.llm.labelled import class_counts, held_out, labelled_sample

#: Bytes of a kernel, between kernels, and of a segment; two successive segments make a chunk.
KERNEL, STRIDE, SEGMENT = 6, 3, 120
PER_SEGMENT = SEGMENT // STRIDE
EMBED, FILTERS, HIDDEN = 6, 24, 16
#: Segments that are convolved at once.
BLOCK = 2048
#: Bounds of the sample that is learned from: texts of each class, and characters of a text.
PER_CLASS, MAX_CHARS = 1200, 20_000
STEPS, BATCH, RATE = 600, 48, 0.004
#: Share of the good texts that are learned from in a shortened form, for short texts are rare among labelled ones.
SHORTENED = 0.2


@dataclass
class ByteNet:
    """Weights; ``shift`` moves the logit from the sample's class shares to the corpus's."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    combine: np.ndarray
    shift: float = 0.0

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.conv_bias, self.hidden, self.hidden_bias, self.out, self.out_bias, self.combine]


def new_net(seed: int = 0) -> ByteNet:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return ByteNet(
        draw(256, EMBED, scale=0.5), draw(KERNEL * EMBED, FILTERS, scale=0.35), np.zeros(FILTERS, np.float32), draw(FILTERS + 1, HIDDEN, scale=0.3), np.zeros(HIDDEN, np.float32),
        draw(HIDDEN, scale=0.3), np.zeros(1, np.float32), np.array([0.4, 0.4, 0.4, 0.0], np.float32),
    )


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, each padded by zeros to whole segments (a kernel's overhang at least), where their segments begin, and how full each is."""
    sizes = np.diff(offsets)
    counts = -(-(sizes + KERNEL - STRIDE) // SEGMENT)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    padded = np.zeros(int(bounds[-1]) * SEGMENT + KERNEL, np.uint8)
    for i, size in enumerate(sizes):
        padded[bounds[i] * SEGMENT : bounds[i] * SEGMENT + size] = data[offsets[i] : offsets[i + 1]]
    owner = np.repeat(np.arange(len(sizes)), counts)
    fill = np.clip((sizes[owner] - (np.arange(int(bounds[-1])) - bounds[owner]) * SEGMENT) / SEGMENT, 0, 1).astype(np.float32)
    return padded, bounds, fill


def _ends(bounds: np.ndarray) -> np.ndarray:
    """Which kernels are the last of their text: they reach over its segments' end, where the next text may begin."""
    out = np.zeros(int(bounds[-1]) * PER_SEGMENT, bool)
    out[bounds[1:] * PER_SEGMENT - 1] = True
    return out


def _columns(net: ByteNet, padded: np.ndarray, first: int, last: int, ends: np.ndarray) -> np.ndarray:
    """Rows of embedded kernels of the segments ``first`` to ``last``; past a text's end they see zeros."""
    n = (last - first) * PER_SEGMENT
    embedded = net.embed[padded[first * SEGMENT : first * SEGMENT + n * STRIDE + KERNEL - STRIDE]]
    out = np.ascontiguousarray(np.lib.stride_tricks.as_strided(embedded, (n, KERNEL * EMBED), (STRIDE * EMBED * 4, 4)))
    out[ends[first * PER_SEGMENT : last * PER_SEGMENT], STRIDE * EMBED :] = np.tile(net.embed[0], KERNEL - STRIDE)
    return out


def _pooled(net: ByteNet, padded: np.ndarray, bounds: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's largest response in each segment, and at which kernel."""
    count, ends = int(bounds[-1]), _ends(bounds)
    pooled = np.empty((count, FILTERS), np.float32)
    at = np.empty((count, FILTERS), np.int64) if keep else None
    for a in range(0, count, BLOCK):
        b = min(count, a + BLOCK)
        got = (_columns(net, padded, a, b, ends) @ net.conv).reshape(b - a, PER_SEGMENT, FILTERS)
        if at is None:
            pooled[a:b] = got.max(1)
        else:
            at[a:b] = got.argmax(1)
            pooled[a:b] = np.take_along_axis(got, at[a:b, None], 1)[:, 0]
    return pooled, at


def _forward(net: ByteNet, pooled: np.ndarray, bounds: np.ndarray, fill: np.ndarray) -> dict[str, np.ndarray]:
    last = np.zeros(len(pooled), bool)
    last[bounds[1:] - 1] = True
    following = np.where(last, np.arange(len(pooled)), np.arange(len(pooled)) + 1)
    nxt = pooled[np.minimum(following, len(pooled) - 1)]
    chunk = np.maximum(pooled, nxt)
    # a short chunk has low responses for want of bytes: how full it is goes beside them
    full = (fill + np.where(last, 0, fill[np.minimum(following, len(pooled) - 1)])) / 2
    seen = np.column_stack([np.maximum(chunk + net.conv_bias, 0), full])
    hidden = np.maximum(seen @ net.hidden + net.hidden_bias, 0)
    logits = hidden @ net.out + net.out_bias
    # a text's last segment only stands in the chunk before it, unless it is alone
    counts = np.diff(bounds)
    valid = ~last
    valid[bounds[:-1][counts == 1]] = True
    size = np.maximum(counts - 1, 1)
    starts = bounds[:-1]
    mean = np.add.reduceat(np.where(valid, logits, 0), starts) / size
    top = np.maximum.reduceat(np.where(valid, logits, -np.inf), starts)
    low = np.minimum.reduceat(np.where(valid, logits, np.inf), starts)
    z = net.combine[0] * top + net.combine[1] * low + net.combine[2] * mean + net.combine[3]
    return {"nxt": nxt, "following": following, "chunk": chunk, "seen": seen, "hidden": hidden, "logits": logits, "valid": valid, "size": size, "top": top, "low": low, "mean": mean, "z": z}


def scores(net: ByteNet, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text."""
    padded, bounds, fill = segments(data, offsets)
    pooled, _ = _pooled(net, padded, bounds)
    z = _forward(net, pooled, bounds, fill)["z"].astype(np.float64) + net.shift
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _gradients(net: ByteNet, data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    padded, bounds, fill = segments(data, offsets)
    count = int(bounds[-1])
    pooled, at = _pooled(net, padded, bounds, keep=True)
    s = _forward(net, pooled, bounds, fill)
    docs = np.repeat(np.arange(len(y)), np.diff(bounds))
    dz = ((1 / (1 + np.exp(-s["z"])) - y) / len(y)).astype(np.float32)
    combine = np.array([(dz * s["top"]).sum(), (dz * s["low"]).sum(), (dz * s["mean"]).sum(), dz.sum()], np.float32)
    logits = s["logits"]
    dl = s["valid"] * (dz * net.combine[2] / s["size"])[docs]
    for weight, extreme in ((net.combine[0], s["top"]), (net.combine[1], s["low"])):
        hit = s["valid"] & (logits == extreme[docs])
        dl = dl + hit * (dz * weight)[docs] / np.maximum(np.bincount(docs, hit, len(y)), 1)[docs]
    dl = dl.astype(np.float32)
    dh = np.outer(dl, net.out) * (s["hidden"] > 0)
    ds = ((dh @ net.hidden.T) * (s["seen"] > 0))[:, :FILTERS]
    own = pooled >= s["nxt"]
    dp = np.where(own, ds, 0)
    np.add.at(dp, s["following"], np.where(own, 0, ds))
    rows = (np.arange(count)[:, None] * PER_SEGMENT + at).ravel()  # kernel of each segment and filter
    spots = rows[:, None] * STRIDE + np.arange(KERNEL)
    spots[_ends(bounds)[rows], STRIDE:] = len(padded) - 1  # a zero
    bytes_ = padded[spots]
    flat = dp.ravel()
    cols = net.embed[bytes_].reshape(count, FILTERS, KERNEL * EMBED)
    dconv = np.einsum("sfk,sf->kf", cols, dp, optimize=True)
    dcols = (flat[:, None] * np.tile(net.conv.T, (count, 1))).reshape(-1, EMBED)
    dembed = np.stack([np.bincount(bytes_.ravel(), dcols[:, e], 256) for e in range(EMBED)], 1)
    return [dembed, dconv, ds.sum(0), s["seen"].T @ dh, dh.sum(0), s["hidden"].T @ dl, np.array([dl.sum()]), combine]


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hashing.texts(pa.array(texts, pa.large_string()))


def train(sample: list[tuple[str, int]], counts: tuple[int, int], seed: int = 0) -> ByteNet:
    """Learns from (text, label) rows by Adam; ``counts`` are the documents of label 0 and 1 in the corpus.

    Without rows, or with one class only, the net has no weights but gives
    every text the share of label 1 (smoothed by one row of either).
    """
    net = new_net(seed)
    if len({y for _, y in sample}) < 2:
        net.combine[:] = 0
        net.shift = math.log((counts[1] + 1) / (counts[0] + 1))
        return net
    rng = np.random.default_rng(seed)
    moments = [(np.zeros(p.shape, np.float64), np.zeros(p.shape, np.float64)) for p in net.parameters()]
    classes = [[t for t, y in sample if y == k] for k in (0, 1)]
    for step in range(1, STEPS + 1):
        # as many rows of either class, however few a class has
        rows = [(classes[k][i], k) for k in (0, 1) for i in rng.integers(0, len(classes[k]), BATCH // 2)]
        cut = [t[: rng.integers(8, 400)] if y and rng.random() < SHORTENED else t for t, y in rows]
        grads = _gradients(net, *_packed(cut), np.array([y for _, y in rows], np.float32))
        rate = RATE * (1 - step / (STEPS + 1))
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.002 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
    net.shift = math.log((counts[1] + 1) / (counts[0] + 1))
    return net


def fit_quality(docs: DataFrame, labels: DataFrame) -> ByteNet:
    sample = labelled_sample(docs, labels, "quality", PER_CLASS, MAX_CHARS)
    return train([(text, y) for _, text, y in sample], class_counts(labels, "quality"))


def score_quality(docs: DataFrame, net: ByteNet) -> DataFrame:
    """``docs`` with a column quality_score (replaced if there), the probability of label 1.

    Needs text and keeps all columns; null texts score as empty ones, and
    equal texts alike.
    """
    rest = [c for c in docs.columns if c != "quality_score"]
    weights = docs.sparkSession.sparkContext.broadcast(net)  # about 15 KB, whatever the data
    schema = docs.select(*(F.col(f"`{c}`") for c in rest)).schema.add("quality_score", "double")
    at = rest.index("text")

    @hashing.frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = hashing.texts(batch.column(at))
            got, a = np.empty(batch.num_rows), 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + hashing.CHUNK, side="right")) - 1)
                got[a:b] = scores(weights.value, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, "quality_score"])

    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(score, schema)


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs``."""
    scored = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
