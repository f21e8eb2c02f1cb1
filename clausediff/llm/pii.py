"""Personal data: patterns, and a character model that adds what they miss.

The patterns find e-mail addresses, IP addresses, card numbers and phone
numbers. From their spans in a bounded sample of texts a bidirectional LSTM
over characters with a CRF on top is trained; it tags characters, so it also
finds spans that a pattern rejects or does not know. Texts are tagged in
overlapping windows around the characters that every kind needs (a digit or
an @); each character's label scores from the windows that cover it are
weighted by how far it stands from their ends and merged, and one Viterbi pass
with the learned transitions over the merged run decides: spans do not depend
on where windows lie. How sure a span is follows from the merged label
distributions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausediff.llm.storage import drop, written

KINDS = ("email", "ip", "card", "phone")
#: Labels: 0 outside, 1 + 2 * kind first character, 2 + 2 * kind further characters of a span.
LABELS = 1 + 2 * len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANCHOR = re.compile(r"[0-9@]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each @ is tried once with the run before it, so the time is linear whatever the text."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            yield start, found.end()
            end = found.end()
        else:
            end = max(end, at + 1)  # no later match can begin before this @
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def by_start_and_kind(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """In the order of reports: by start, then kind as KINDS lists them."""
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the patterns' matches, by start and then kind, in code points."""
    if not text or not _ANCHOR.search(text):
        return []
    spans = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if len(d := _digits(m[0])) in range(12, 20) and luhn(d):
            spans.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if len(_digits(m[0])) in range(9, 16):
                spans.append((m.start(), m.end(), 3))
    return by_start_and_kind(spans)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


# ---------------------------------------------------------------- the model

EMBED, HIDDEN = 12, 20
#: Characters of a window, between the beginnings of windows, and around an anchor that windows cover.
WINDOW, STEP, MARGIN = 64, 32, 32
#: Windows of a batch, training steps, and the sample: texts with an anchor, and characters of a text.
BATCH, STEPS, RATE = 48, 300, 0.02
SAMPLE, MAX_CHARS = 1500, 20_000
#: Mean probability of its labels from which a decoded span is added.
SURE = 0.9
#: Character classes: ASCII as it is, other letters, other characters.
CLASSES = 130


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = np.where(points < 128, points, 129).astype(np.int64)
    for i in np.flatnonzero(points >= 128):
        out[i] = 128 if text[i].isalpha() else 129
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """Weights: embeddings; per direction an LSTM's input, recurrent and bias weights; label scores; CRF transitions."""

    embed: np.ndarray
    wx: np.ndarray
    wh: np.ndarray
    b: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    trans: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.wh, self.b, self.out, self.out_bias, self.trans]


def allowed() -> np.ndarray:
    """Which label may follow which: a further character only after a character of its kind's span."""
    ok = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


_FORBIDDEN = np.where(allowed(), 0.0, -1e4)


def new_tagger(seed: int = 0) -> Tagger:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    b = np.zeros((2, 4 * HIDDEN), np.float32)
    b[:, HIDDEN : 2 * HIDDEN] = 1  # forget gates begin open
    return Tagger(
        draw(CLASSES + 1, EMBED, scale=0.3), draw(2, EMBED, 4 * HIDDEN, scale=0.25), draw(2, HIDDEN, 4 * HIDDEN, scale=0.2), b,
        draw(2 * HIDDEN, LABELS, scale=0.2), np.zeros(LABELS, np.float32), np.zeros((LABELS, LABELS), np.float32),
    )


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """x: time, batch, EMBED; the states of every step, and what the way back needs."""
    steps, n, _ = x.shape
    pre = x @ wx + b
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        kept.append((i, f, o, g, before, tc, h))
        h = o * tc
        out[t] = h
    return out, kept


def _lstm_back(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, ...]:
    steps, n, _ = x.shape
    dpre = np.empty((steps, n, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dwh = np.zeros_like(wh)
    for t in reversed(range(steps)):
        i, f, o, g, before, tc, h = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        dpre[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dwh += h.T @ dpre[t]
        dh, dc = dpre[t] @ wh.T, dc * f
    return dpre @ wx.T, np.einsum("tne,tnk->ek", x, dpre, optimize=True), dwh, dpre.sum((0, 1))


def _states(net: Tagger, x: np.ndarray) -> tuple[np.ndarray, list, list]:
    """x: classes, time by batch."""
    e = net.embed[x]
    fore, kept = _lstm(e, net.wx[0], net.wh[0], net.b[0])
    back, kept_back = _lstm(e[::-1], net.wx[1], net.wh[1], net.b[1])
    return np.concatenate([fore, back[::-1]], 2), kept, kept_back


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _crf(scores: np.ndarray, trans: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition per window, label probabilities, and (if asked for) expected transitions; scores: time, batch, label."""
    steps, n, _ = scores.shape
    alpha, beta = np.empty(scores.shape), np.zeros(scores.shape)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsumexp(trans + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _logsumexp(alpha[-1], 1)
    marginal = np.exp(alpha + beta - total[:, None])
    pair = np.zeros(trans.shape)
    for t in range(1, steps if pairs else 1):
        pair += np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
    return total, marginal, pair


def _gradients(net: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients of the CRF's log-likelihood; x, y: time by batch."""
    states, kept, kept_back = _states(net, x)
    scores = (states @ net.out + net.out_bias).astype(np.float64)
    trans = net.trans + _FORBIDDEN
    total, marginal, pair = _crf(scores, trans)
    steps, n = x.shape
    gold = np.take_along_axis(scores, y[:, :, None], 2).sum() + trans[y[:-1], y[1:]].sum()
    np.put_along_axis(marginal, y[:, :, None], np.take_along_axis(marginal, y[:, :, None], 2) - 1, 2)
    np.add.at(pair, (y[:-1].ravel(), y[1:].ravel()), -1)
    ds = (marginal / n).astype(np.float32)
    dstates = ds @ net.out.T
    e = net.embed[x]
    dx0, dwx0, dwh0, db0 = _lstm_back(e, net.wx[0], net.wh[0], kept, dstates[:, :, :HIDDEN])
    dx1, dwx1, dwh1, db1 = _lstm_back(e[::-1], net.wx[1], net.wh[1], kept_back, dstates[::-1, :, HIDDEN:])
    dembed = np.zeros_like(net.embed)
    np.add.at(dembed, x.ravel(), (dx0 + dx1[::-1]).reshape(-1, EMBED))
    grads = [dembed, np.stack([dwx0, dwx1]), np.stack([dwh0, dwh1]), np.stack([db0, db1]), np.einsum("tnh,tnk->hk", states, ds, optimize=True), ds.sum((0, 1)), pair / n]
    return float((total.sum() - gold) / n), grads


def window_starts(text: str) -> list[list[int]]:
    """Runs of window beginnings: windows of a run overlap, and each anchor has MARGIN characters or the text's end on both sides in a run."""
    runs: list[list[int]] = []
    end = -1  # of what the last run must cover
    bounds: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if bounds and a <= end:
            bounds[-1] = (bounds[-1][0], b)
        else:
            bounds.append((a, b))
        end = b
    for a, b in bounds:
        runs.append(list(range(a, max(a + 1, b - WINDOW + STEP), STEP)))
    return runs


def _windows(codes: np.ndarray, starts: list[int]) -> np.ndarray:
    """Time by batch, filled up with CLASSES past the text's end."""
    spots = np.array(starts)[None, :] + np.arange(WINDOW)[:, None]
    return np.where(spots < len(codes), codes[np.minimum(spots, len(codes) - 1)], CLASSES)


_TRUST = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)) / (WINDOW / 2)


def _viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    steps = len(scores)
    back = np.zeros(scores.shape, np.int64)
    best = scores[0].copy()
    best[2::2] += -1e4  # no span begins with a further character
    for t in range(1, steps):
        path = best[:, None] + trans
        back[t] = path.argmax(0)
        best = path.max(0) + scores[t]
    out = np.empty(steps, np.int64)
    out[-1] = best.argmax()
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _plausible(found: str, kind: int) -> bool:
    """A span holds what its kind cannot do without."""
    digits = sum(c in "0123456789" for c in found)
    if kind == 0:
        return "@" in found[1:-1]
    return 4 <= digits if kind == 1 else 12 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


def model_spans(net: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans in each text, by start; runs of windows without any anchor hold none and are not read."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    trans = (net.trans + _FORBIDDEN).astype(np.float64)
    pending: list[tuple[int, list[int], np.ndarray]] = []
    held = 0

    def flush() -> None:
        x = np.concatenate([_windows(codes, starts) for _, starts, codes in pending], 1)
        both = []  # label scores and distributions side by side
        for a in range(0, x.shape[1], 256):
            part = x[:, a : a + 256]
            states, _, _ = _states(net, part)
            scores = (states @ net.out + net.out_bias).astype(np.float64)
            both.append(np.concatenate([scores, _crf(scores, trans, pairs=False)[1]], 2))
        both = np.concatenate(both, 1)
        at = 0
        for i, starts, codes in pending:
            first, last = starts[0], min(len(codes), starts[-1] + WINDOW)
            total, weight = np.zeros((last - first, 2 * LABELS)), np.zeros(last - first)
            for s in starts:
                n = min(WINDOW, len(codes) - s)
                total[s - first : s - first + n] += both[:n, at] * _TRUST[:n, None]
                weight[s - first : s - first + n] += _TRUST[:n]
                at += 1
            total /= weight[:, None]
            share = total[:, LABELS:]
            labels = _viterbi(total[:, :LABELS], trans)
            t = 0
            while t < len(labels):
                if labels[t] % 2 == 1:
                    e = t + 1
                    while e < len(labels) and labels[e] == labels[t] + 1:
                        e += 1
                    kind = int(labels[t] // 2)
                    sure = share[np.arange(t, e), labels[t:e]].mean()
                    if sure >= SURE and _plausible(texts[i][first + t : first + e], kind):
                        out[i].append((first + t, first + e, kind))
                    t = e
                else:
                    t += 1
        pending.clear()

    for i, text in enumerate(texts):
        runs = window_starts(text)
        codes = classes(text) if runs else None
        for starts in runs:
            pending.append((i, starts, codes))
            held += len(starts)
            if held >= 2048:
                flush()
                held = 0
    if pending:
        flush()
    return out


def all_spans(text: str, base: list[tuple[int, int, int]], added: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans, and the added ones that touch none of them."""
    taken = sorted((a, b) for a, b, _ in base)
    out = list(base)
    for a, b, k in added:
        if not any(a < y and x < b for x, y in taken):
            out.append((a, b, k))
    return by_start_and_kind(out)


def train_tagger(texts: list[str], seed: int = 0) -> Tagger:
    """Learns from the base spans of ``texts``; without any anchor in them every label but outside stays unlearned."""
    net = new_tagger(seed)
    xs, ys = [], []
    for text in texts:
        runs = window_starts(text)
        if not runs:
            continue
        codes, labels = classes(text), np.zeros(len(text), np.int64)
        for a, b, k in base_spans(text):
            if not labels[a:b].any():
                labels[a:b] = 2 + 2 * k
                labels[a] = 1 + 2 * k
        for starts in runs:
            xs.append(_windows(codes, starts))
            spots = np.array(starts)[None, :] + np.arange(WINDOW)[:, None]
            own = np.where(spots < len(codes), labels[np.minimum(spots, len(codes) - 1)], 0)
            cut = (own[0] % 2 == 0) & (own[0] > 0)  # a window that begins within a span
            own[0, cut] -= 1
            ys.append(own)
    if not xs:
        net.out[:], net.out_bias[1:], net.out_bias[0] = 0, -20, 20
        return net
    x, y = np.concatenate(xs, 1), np.concatenate(ys, 1)
    rng = np.random.default_rng(seed)
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in net.parameters()]
    for step in range(1, STEPS + 1):
        rows = rng.integers(0, x.shape[1], BATCH)
        _, grads = _gradients(net, x[:, rows], y[:, rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        grads = [g * min(1.0, 5.0 / (norm + 1e-9)) for g in grads]
        rate = RATE * (1 - step / (STEPS + 1))
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.002 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
    return net


# ---------------------------------------------------------------- on tables


_PII = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def fit_tagger(docs: DataFrame) -> Tagger:
    """A tagger learned from at most SAMPLE texts of at most MAX_CHARS characters: those with an anchor whose texts hash lowest."""
    some = docs.select("text").where(F.col("text").rlike("[0-9@]") & (F.length("text") <= MAX_CHARS))
    keys = written(some.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(SAMPLE), "sample")
    rows = some.withColumn("h", F.xxhash64("text")).join(F.broadcast(keys), "h").groupBy("h").agg(F.min("text").alias("text")).collect()
    drop(keys)
    return train_tagger([r.text for r in sorted(rows)])


def find_pii(docs: DataFrame, net: Tagger) -> DataFrame:
    """``docs`` with a column pii, replaced if there: array of (kind, start, end, base), by start and then kind.

    Needs text and keeps all columns. Offsets are code points, the end
    exclusive; ``base`` tells the patterns' spans from those that the tagger
    adds, which never overlap them. Null and empty texts have none. Base spans
    of different kinds may overlap.
    """
    rest = [c for c in docs.columns if c != "pii"]
    at = rest.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 60 KB, whatever the data
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    schema = docs.select(*(F.col(f"`{c}`") for c in rest)).schema.add("pii", _PII)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            base = [base_spans(t) for t in texts]
            added = model_spans(shared.value, texts)
            out = []
            for t, own, more in zip(texts, base, added, strict=True):
                known = set(own)
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": (a, b, k) in known} for a, b, k in all_spans(t, own, more)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "pii"])

    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(find, schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)``; counts and hash are of the base spans.

    One row per row of ``docs`` (doc_id and text; other columns are ignored).
    Null and empty texts have no spans and the hash of an empty string; an
    empty table gives an empty one, and texts without digits and @ train a
    tagger that adds nothing.
    """
    found = find_pii(docs.select("doc_id", "text"), fit_tagger(docs)).select("doc_id", "pii")
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("pii", lambda s: s["base"])

    def of_kind(kind: str) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == kind

    return found.select(
        "doc_id",
        *(F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", one), ",").alias("spans"),
        F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def sha256(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(told(spans).encode()).hexdigest()
