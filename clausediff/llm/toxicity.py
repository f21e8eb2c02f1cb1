"""Toxicity by the nearest labelled examples.

A bounded sample of labelled documents is the set of examples. Texts are
compared with them by exact TF-IDF cosine over all words of the examples; a
word that goes with the label (by the log-likelihood ratio on the examples)
weighs up to BOOST times more, but every word counts, so every text that shares
a word with an example has neighbours. Document frequencies are counted over
all documents.

The examples lie in an inverted index. Words of many examples are columns of a
dense matrix; the postings of the others are cut into blocks of examples, each
with its largest weight. The exact part of the dense columns and the largest
weights of the others bound what a block can reach, and blocks that cannot
reach the nearest found so far are left out. Votes of the nearest are weighted
by similarity, and made into a probability by a logistic curve fitted on the
examples themselves, each judged by the others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausediff.llm import hashing
from clausediff.llm.labelled import class_counts, held_out, labelled_sample

#: Bounds of the sample: documents of each class, characters of a document.
PER_CLASS, MAX_CHARS = 2000, 20_000
#: The weight of a word grows by its log-likelihood ratio over SCALE, up to BOOST times.
BOOST, SCALE = 21.0, 4.0
NEAREST, BLOCK = 15, 64
#: A word of more than one in so many examples has a dense column.
COMMON = 16
#: Blocks of the highest bounds, which are searched first; texts whose dense parts are computed at once.
FIRST, BATCH = 6, 128
#: Min-hashes by which near copies among the examples are found.
SIGNATURE = 8
#: Weight, as of so much similarity, of the share of label 1 among examples without words.
PRIOR_WEIGHT = 0.02

_WORD = re.compile(r"\w+")


def word_counts(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall((text or "").lower()))


def copies(texts: list[str]) -> np.ndarray:
    """For each text the first that it nearly copies (itself, if none): half of SIGNATURE min-hashes of five-word shingles agree."""
    signs = np.empty((len(texts), SIGNATURE), np.uint64)
    for i, own in enumerate(hashing.shingle_sets(pa.array(texts, pa.large_string()), 5)):
        for j in range(SIGNATURE):
            signs[i, j] = hashing.mix(own ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64)).min() if len(own) else i
    first: dict[tuple[int, int], int] = {}
    out = np.arange(len(texts))
    for i in range(len(texts)):
        for j in range(SIGNATURE):
            other = first.setdefault((j, int(signs[i, j])), i)
            if 2 * int((signs[other] == signs[i]).sum()) >= SIGNATURE:
                out[i] = min(out[i], out[other])
    return out


class Terms:
    """The words of the examples, and the counts of a text's words among them."""

    def __init__(self, words: list[str]) -> None:
        self.place = {w: i for i, w in enumerate(words)}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        get = self.place.get
        found = [(t, n) for w, n in word_counts(text).items() if (t := get(w)) is not None]
        terms = np.fromiter((t for t, _ in found), np.int64, len(found))
        return terms, np.fromiter((n for _, n in found), np.float64, len(found))


def association(terms: list[np.ndarray], labels: np.ndarray, groups: np.ndarray, n_terms: int) -> np.ndarray:
    """The log-likelihood ratio of each term's presence and the label; near copies (of one group) count as one example."""
    seen, size = np.zeros((2, n_terms)), np.zeros(2)
    for i, own in enumerate(terms):
        if groups[i] == i:
            seen[labels[i], own] += 1
            size[labels[i]] += 1
    ratio = np.zeros(n_terms)
    if size.all():
        share = seen.sum(0) / size.sum()
        for y in (0, 1):
            for part, expected in ((seen[y], share * size[y]), (size[y] - seen[y], (1 - share) * size[y])):
                ratio += 2 * np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return np.maximum(ratio, 0)


@dataclass
class Index:
    """Examples as unit vectors, by term and block of examples; the examples are filled up to whole blocks."""

    words: list[str]
    weight: np.ndarray  #: of a term: its inverse document frequency times what it gains by the label
    ids: np.ndarray
    labels: np.ndarray
    column: np.ndarray  #: of the dense matrix, or -1
    dense: np.ndarray  #: columns by examples
    entries: np.ndarray  #: per term, where its blocks begin
    block: np.ndarray  #: of an entry
    largest: np.ndarray  #: weight in an entry
    postings: np.ndarray  #: per entry, where its postings begin
    example: np.ndarray  #: of a posting
    value: np.ndarray
    class_weight: np.ndarray  #: corpus share of a class over its share of the examples
    prior: float  #: share of label 1 where there are no words
    curve: tuple[float, float] = (1.0, 0.0)  #: of the logistic curve that makes votes probabilities


def unit_vector(weight: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    values = (1 + np.log(counts)) * weight[terms]
    return values / np.linalg.norm(values)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and how many each has."""
    size = stop - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()), size


def build_index(sample: list[tuple[int, str, int]], words: list[str], df: np.ndarray, n_docs: int, class_sizes: tuple[int, int]) -> Index:
    lexicon, n = Terms(words), len(sample)
    labels, groups = np.array([y for *_, y in sample], np.int64), copies([text for _, text, _ in sample])
    size = np.bincount(labels, minlength=2)
    share = (np.array(class_sizes) + 1) / (sum(class_sizes) + 2)
    class_weight = share / np.maximum(size, 1) * max(n, 1)
    found = [lexicon.counts(text) for _, text, _ in sample]
    gain = association([t for t, _ in found], labels, groups, len(words))
    weight = (np.log((n_docs + 1) / (df + 1)) + 1) * np.minimum(1 + gain / SCALE, BOOST)
    without = np.bincount(labels[[not len(t) for t, _ in found]] if n else labels, minlength=2) * class_weight
    prior = float((without[1] + share[1]) / (without.sum() + 1))
    # examples of one label and of the same weightiest word stand together, so that blocks differ in what they can reach
    some = [i for i in range(n) if len(found[i][0])]
    vectors = {i: unit_vector(weight, *found[i]) for i in some}
    some.sort(key=lambda i: (labels[i], int(found[i][0][vectors[i].argmax()]), sample[i][0]))
    term = np.concatenate([np.empty(0, np.int64), *(found[i][0] for i in some)])
    value = np.concatenate([np.empty(0), *(vectors[i] for i in some)])
    example = np.repeat(np.arange(len(some), dtype=np.int32), [len(found[i][0]) for i in some])
    del found, vectors
    order = np.lexsort((example, term))
    term, value, example = term[order], value[order], example[order]
    often = np.bincount(term, minlength=len(words)) * COMMON > max(len(some), COMMON)
    column = np.where(often, np.cumsum(often) - 1, -1)
    padded = -(-len(some) // BLOCK) * BLOCK
    dense = np.zeros((int(often.sum()), padded))
    wide = often[term]
    dense[column[term[wide]], example[wide]] = value[wide]
    term, value, example = term[~wide], value[~wide], example[~wide]
    cell = term * (padded // BLOCK + 1) + example // BLOCK
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
    index = Index(
        words, weight, np.array([sample[i][0] for i in some], np.int64), labels[some] if some else labels[:0], column, dense,
        np.searchsorted(term[begins], np.arange(len(words) + 1)), example[begins] // BLOCK, np.maximum.reduceat(value, begins) if len(begins) else np.empty(0),
        np.append(begins, len(value)), example, value, class_weight, prior,
    )
    index.curve = _curve(index, [lexicon.counts(sample[i][1]) for i in some])
    return index


def dense_scores(index: Index, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What the dense columns give each vector (terms, values) with each example."""
    x = np.zeros((len(vectors), len(index.dense)))
    for row, (terms, values) in zip(x, vectors, strict=True):
        column = index.column[terms]
        row[column[column >= 0]] = values[column >= 0]
    return x @ index.dense


def nearest(index: Index, terms: np.ndarray, values: np.ndarray, score: np.ndarray, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` examples of the highest cosine above 0, exactly; ties go to the smaller position. ``score`` is from ``dense_scores``; the example ``without`` is left out."""
    blocks = len(score) // BLOCK
    if not blocks:
        return np.empty(0, np.int64), np.empty(0)
    column = index.column[terms]
    rare = terms[column < 0]
    entry, size = _ranges(index.entries[rare], index.entries[rare + 1])
    gain = np.repeat(values[column < 0], size)
    block = index.block[entry]
    bound = score.reshape(blocks, BLOCK).max(1) + np.bincount(block, gain * index.largest[entry], blocks)

    def best(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        here = chosen[block]
        posting, size = _ranges(index.postings[entry[here]], index.postings[entry[here] + 1])
        sims = score + np.bincount(index.example[posting], np.repeat(gain[here], size) * index.value[posting], len(score))
        docs = np.flatnonzero(np.repeat(chosen, BLOCK) & (sims > 0))
        docs = docs[docs != without]
        if len(docs) > k:
            docs = docs[sims[docs] >= np.partition(sims[docs], len(docs) - k)[len(docs) - k] - 1e-9]
        return docs, sims[docs]

    first = np.zeros(blocks, bool)
    first[np.argsort(-bound, kind="stable")[:FIRST]] = True
    docs, sims = best(first)
    least = np.partition(sims, len(sims) - k)[len(sims) - k] if len(sims) >= k else 0.0
    rest = ~first & (bound > 0) & (bound >= least - 1e-9)
    if rest.any():
        more, their = best(rest)
        docs, sims = np.concatenate([docs, more]), np.concatenate([sims, their])
    top = np.lexsort((docs, -np.round(sims, 12)))[:k]
    return docs[top], sims[top]


def raw_vote(index: Index, docs: np.ndarray, sims: np.ndarray) -> float:
    """The share of label 1 among the nearest, weighted by similarity and by how rare a class is in the sample."""
    weight = sims * index.class_weight[index.labels[docs]]
    return float((weight @ index.labels[docs] + PRIOR_WEIGHT * index.prior) / (weight.sum() + PRIOR_WEIGHT))


def _logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _curve(index: Index, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """Slope and shift of the logistic curve that gives the examples' votes, each judged by the others, the greatest likelihood of their labels (Platt, 1999)."""
    size = np.bincount(index.labels, minlength=2)
    if not size.all():
        return 1.0, 0.0
    votes = []
    for a in range(0, len(found), BATCH):
        vectors = [(t, unit_vector(index.weight, t, c)) for t, c in found[a : a + BATCH]]
        for i, ((t, v), score) in enumerate(zip(vectors, dense_scores(index, vectors), strict=True), a):
            votes.append(raw_vote(index, *nearest(index, t, v, score, without=i)))
    x, weight = np.column_stack([_logit(np.array(votes)), np.ones(len(votes))]), index.class_weight[index.labels]
    target = np.where(index.labels == 1, (size[1] + 1) / (size[1] + 2), 1 / (size[0] + 2))
    w = np.array([1.0, 0.0])
    for _ in range(30):  # Newton's steps, with a slight pull to the votes as they are
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + 0.1 * (w - [1.0, 0.0])
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), slope)
        w[0] = max(w[0], 0.1)
    return float(w[0]), float(w[1])


def vote(index: Index, docs: np.ndarray, sims: np.ndarray) -> float:
    """The probability of label 1, by the nearest."""
    slope, shift = index.curve
    return float(1 / (1 + np.exp(-np.clip(slope * _logit(raw_vote(index, docs, sims)) + shift, -30, 30))))


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """In how many rows of ``docs`` each word stands, and how many rows there are; a number for each word of the examples reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # bounded by the sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, df, n = Terms(shared.value).place.get, np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                if text:
                    df[[t for w in set(_WORD.findall(text.lower())) if (t := get(w)) is not None]] += 1
        df[-1] = n
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], names=["term", "n"])

    summed = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(words) + 1, np.int64)
    df[summed["term"].to_numpy()] = summed["n"].to_numpy()
    return df[:-1], int(df[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Index:
    sample = labelled_sample(docs, labels, "toxic", PER_CLASS, MAX_CHARS)
    words = sorted({w for _, text, _ in sample for w in word_counts(text)})
    df, n = document_frequencies(docs, words)
    return build_index(sample, words, df, n, class_counts(labels, "toxic"))


def score_toxicity(docs: DataFrame, index: Index) -> DataFrame:
    """``(doc_id, score, evidence)`` of each row of ``docs`` (doc_id, text; other columns are ignored).

    The score is in [0, 1]; evidence holds the nearest examples (doc_id,
    similarity, label), most similar first, ties by the index's order. A text
    that shares no word with the examples, so null and empty ones too, has no
    evidence and the score of examples without words. Repeated rows are scored
    alike; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lexicon = Terms(own.words)
        for batch in (whole.slice(a, BATCH) for whole in batches for a in range(0, whole.num_rows, BATCH)):
            out, evidence = [], []
            found = [lexicon.counts(text) for text in batch.column(1).to_pylist()]
            vectors = [(t, unit_vector(own.weight, t, c)) if len(t) else (t, c) for t, c in found]
            for (terms, values), dense in zip(vectors, dense_scores(own, vectors), strict=True):
                near, sims = nearest(own, terms, values, dense)
                out.append(vote(own, near, sims) if len(near) else own.prior)
                evidence.append([{"doc_id": int(own.ids[d]), "similarity": float(s), "label": int(own.labels[d])} for d, s in zip(near, sims, strict=True)])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(score, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,label:int>>")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)`` of each row of ``docs``; see ``labelled_sample`` for labels and ``score_toxicity`` for odd rows."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
