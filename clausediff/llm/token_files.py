"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

A corpus of token ids is a folder of shards, one per partition of ascending
``doc_id`` or of the order in which the documents come:

* ``NNNNN.ids`` - the ids of all its documents one after the other, as
  little-endian unsigned 16-bit integers if every id of the vocabulary fits,
  else 32-bit ones;
* ``NNNNN.idx`` - little-endian signed 64-bit integers: the number of its
  documents n, their n ids, then n + 1 offsets counted in tokens.

Where a shard begins in the corpus (its base) is the prefix sum of the token
counts of the shards before it; only these counts, one per shard, reach the
driver. Readers memory-map both files.
"""

from __future__ import annotations

import os
import re
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausediff.llm.hashing import frugal
from clausediff.llm.storage import SMALL_BATCHES, configured

#: A run of letters that stands alone or before ASCII punctuation is tokenized once.
_PUNCTUATION = r"[!-/:-@\[-`{-~]*"
_WORD = re.compile(rf"([^\W\d_]+)({_PUNCTUATION})")
_CONTROL = re.compile(r"[\x1c-\x1f]")
#: The like of Latin letters that are one character in either case.
_LATIN_WORD = rf"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>{_PUNCTUATION})$"
#: Bytes that a worker keeps of pieces and their ids; an entry takes about ENTRY besides its characters.
CACHE, ENTRY = 40 << 20, 200
#: Words that the tokenizer encodes as one text, and bytes of texts that are split at once unless one is longer.
WORDS, CHUNK = 100, 1 << 20


class Encoder:
    """Encodes texts piece by piece, with the same ids as the tokenizer gives for whole texts.

    White space ends every token of the tokenizers that this is made for (the
    pre-tokenizer drops it), so a text's ids are those of its pieces between
    white space, and each distinct piece is encoded once per worker. Of the
    pieces that are letters before optional punctuation, the pre-tokenizer
    makes one token for either part, so only their parts are encoded, and
    these are pieces too: a word is kept once, alone or with punctuation after
    it. A tokenizer of another kind encodes whole texts.

    New words are encoded many at a time, as one text with blanks between them:
    where the model marks the ends of words, the ids tell where each ends. For
    words of a-z alone, which the normalizer and the pre-tokenizer leave as they
    are, a tokenizer of the same model without these does it.
    """

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = {2: "H", 4: "I"}[width]
        self.pieces: dict[str, bytes] = {}
        self.held = 0
        spec = self.tokenizer.pre_tokenizer.__getstate__() + self.tokenizer.normalizer.__getstate__() if self.tokenizer.pre_tokenizer and self.tokenizer.normalizer else b""
        self.by_piece = rb"[^\\s\\p{L}\\p{N}]+" in spec.replace(rb"\\\\", rb"\\") and b'"invert":true' in spec and b'"Removed"' in spec and b"Lowercase" in spec

        model = self.tokenizer.model
        self.plain, self.ends = None, np.empty(0, bool)
        if self.by_piece and b"ByteLevel" in spec and b'"add_prefix_space":false' in spec and (mark := getattr(model, "end_of_word_suffix", None)):
            self.plain = Tokenizer(model)  # in memory once
            self.plain.pre_tokenizer = WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for name, i in vocabulary.items() if name.endswith(mark)]] = True

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)

    def _each(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, tokenizer, words: list[str]) -> list[bytes]:
        """The ids of words of letters, WORDS of them at a time."""
        groups, out = [words[i : i + WORDS] for i in range(0, len(words), WORDS)], []
        for group, got in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):  # some letters are none to the tokenizer
                out += self._each(group)
                continue
            data, width = ids.astype(f"<u{struct.calcsize(self.kind)}").tobytes(), struct.calcsize(self.kind)
            cuts = [0, *(stops * width).tolist()]
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.plain is None:
            return self._each(texts)
        kinds = [(1 if t.isascii() and t.islower() else 2) if t.isalpha() else 0 for t in texts]
        own = [[t for t, k in zip(texts, kinds, strict=True) if k == kind] for kind in range(3)]
        got = [iter(self._each(own[0])), iter(self._words(self.plain, own[1])), iter(self._words(self.tokenizer, own[2]))]
        return [next(got[k]) for k in kinds]

    def _parts_of(self, piece: str) -> tuple[str, ...]:
        if piece.isascii() and piece.islower() and piece.isalpha():
            return (piece,)
        word, rest = (piece, "") if piece.isalpha() else found.groups() if (found := _WORD.fullmatch(piece)) else ("", "")
        if word.isalpha():
            low = word.lower()
            # the normalizer makes a letter and a mark of some letters, and marks are one with punctuation
            if len(low) == len(word) and low.isalpha() and "Σ" not in word and is_normalized("NFC", low):
                return (low, rest) if rest else (low,)
        return (piece,)

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.pieces]
        if self.held + sum(map(len, new)) + len(new) * ENTRY > CACHE:  # what these texts need stays
            self.pieces = {p: self.pieces[p] for p in pieces if p in self.pieces}
            self.held = sum(map(len, self.pieces)) + len(self.pieces) * ENTRY
        known, before = self.pieces, len(self.pieces)
        cut = [self._parts_of(p) for p in new]
        parts = list({x for own in cut for x in own if x not in known})
        known.update(zip(parts, self._encode(parts), strict=True))
        self.held += sum(map(len, parts))
        for piece, own in zip(new, cut, strict=True):
            if piece != own[0]:
                known[piece] = known[own[0]] + known[own[1]] if len(own) == 2 else known[own[0]]
                self.held += len(piece)
        self.held += (len(known) - before) * ENTRY

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of this encoder's width."""
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        return [own.tobytes() for own in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, ``end`` after each, and how many each has; null counts as empty."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _CONTROL.pattern) if self.by_piece else pa.array(np.ones(len(texts), bool))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            texts, odd = pc.if_else(odd, "", texts), [t.as_py() for t in texts.take(pa.array(whole))]
        split = pc.utf8_split_whitespace(texts)  # the same white space as str.split's; a text has one piece at least
        named = split.flatten().dictionary_encode()
        cut = pc.extract_regex(named.dictionary, _LATIN_WORD)  # null where a piece is of another kind
        parts = [pc.coalesce(pc.utf8_lower(pc.struct_field(cut, [0])), named.dictionary).dictionary_encode(), pc.struct_field(cut, [1]).fill_null("").dictionary_encode()]
        pieces = [x for part in parts for x in part.dictionary.to_numpy(zero_copy_only=False).tolist()]
        self.learn({p for p in pieces if p})
        blobs = [self.pieces[p] if p else b"" for p in pieces]
        own = np.column_stack([parts[0].indices.to_numpy(), parts[1].indices.to_numpy() + len(parts[0].dictionary)])
        codes, stops = own[named.indices.to_numpy()].ravel(), 2 * np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)
        if len(whole):
            codes[stops[whole] - 2] = len(blobs) + np.arange(len(whole))
            blobs += self._each(odd)
        codes = np.insert(codes, stops, len(blobs))
        blobs.append(end)
        table = np.frombuffer(b"".join(blobs), f"<u{struct.calcsize(self.kind)}")
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // table.itemsize
        many = size[codes]
        after = np.cumsum(many)
        place = np.repeat((np.cumsum(size) - size)[codes] - (after - many), many)
        place += np.arange(len(place))
        return table[place], np.diff(after[stops + np.arange(len(stops))], prepend=0)


def encoded(enc: Encoder, texts: pa.Array, end: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``enc.encode_column`` of runs of rows of about CHUNK bytes."""
    held = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(held, (held[first - 1] if first else 0) + CHUNK, side="right")))
        yield enc.encode_column(texts.slice(first, last - first), end)
        first = last


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    if (path, width) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def id_width(path: str, end_id: int) -> int:
    """Bytes per id: 2 if all ids of the vocabulary and ``end_id`` are below 65,536, else 4."""
    from tokenizers import Tokenizer

    largest = max(max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()), end_id)
    return 2 if largest < 1 << 16 else 4


def _local(folder: str) -> str | None:
    """The folder as a path that this process can open, if it is in a mounted file system."""
    return re.sub(r"^file:/+", "/", folder) if re.match(r"file:/|/", folder) else None


class Store:
    """Whole files of a shared folder: by the operating system if mounted, else by pyarrow's file systems."""

    def __init__(self, folder: str) -> None:
        self.folder = _local(folder)
        self.remote = None
        if self.folder is None:
            from pyarrow import fs

            self.remote, self.folder = fs.FileSystem.from_uri(folder)

    def write(self, name: str, blocks: Iterator[bytes]) -> None:
        """Writes a new file and then gives it its name, so that a second attempt of a task replaces it whole."""
        path, made = f"{self.folder}/{name}", f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        if self.remote is None:
            os.makedirs(self.folder, exist_ok=True)
            with open(made, "wb") as out:
                out.writelines(blocks)
            os.replace(made, path)
        else:
            self.remote.create_dir(self.folder, recursive=True)
            with self.remote.open_output_stream(made) as out:
                for block in blocks:
                    out.write(block)
            self.remote.move(made, path)

    def map(self, name: str, dtype: str) -> np.ndarray:
        path = f"{self.folder}/{name}"
        if self.remote is None:
            return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
        # a copy on this machine's disk for as long as the array lives, so that it is mapped here too
        with tempfile.TemporaryFile() as copy:
            with self.remote.open_input_stream(path) as file:
                while some := file.read(1 << 24):
                    copy.write(some)
            copy.flush()
            return np.memmap(copy, dtype=dtype, mode="r") if copy.tell() else np.empty(0, dtype)


class Corpus(NamedTuple):
    """A folder of shards: their names, first document positions and bases, in order."""

    folder: str
    width: int
    shards: list[tuple[str, int, int, int]]  #: name, base in tokens, documents, tokens


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, partitions: int | None = None, by_id: bool = True) -> Corpus:
    """Encodes ``docs.text`` and writes the shards under ``folder`` (shared by all machines).

    ``docs`` needs doc_id and text; other columns are ignored. Null texts count
    as empty: only the end id is written for them. Rows of equal doc_id stand
    next to each other, ordered by text. Rows of null doc_id come first and
    are written as -1. An empty table gives a corpus without shards.

    Without ``by_id`` each partition of ``docs`` is a shard, in the order of its
    rows, and nothing is shuffled: for documents that are mixed already, in a
    table whose partitions come out alike when a task is tried again.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer, end_id)
    end = np.array([end_id], dtype=f"<u{width}").tobytes()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @frugal
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, enc = Store(folder), encoder(tokenizer, width)
        name = f"{TaskContext.get().partitionId():05d}"
        ids, sizes = [], []

        def blocks() -> Iterator[bytes]:
            for batch in batches:
                ids.append(batch.column(0).cast(pa.int64()).fill_null(-1).to_numpy())
                for got, many in encoded(enc, batch.column(1), end):
                    sizes.append(many)
                    yield got.tobytes()

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        batches = chain([first], batches)
        store.write(f"{name}.ids", blocks())
        docs, offsets = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        store.write(f"{name}.idx", iter([np.concatenate([[len(docs)], docs, offsets]).astype("<i8").tobytes()]))
        yield pa.record_batch([pa.array([name]), pa.array([len(docs)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], names=["shard", "docs", "tokens"])

    ordered = docs.select("doc_id", "text")
    if by_id:
        ordered = ordered.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    with configured(spark, SMALL_BATCHES):
        shards = sorted(ordered.mapInArrow(write, "shard string, docs long, tokens long").collect())
    bases = np.concatenate([[0], np.cumsum([s.tokens for s in shards], dtype=np.int64)])
    return Corpus(folder, width, [(s.shard, int(b), s.docs, s.tokens) for s, b in zip(shards, bases, strict=False)])


def read_token_files(spark: SparkSession, corpus: Corpus) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned
    32-bit integers, end id included.
    """
    folder, width = corpus.folder, corpus.width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, index = store.map(f"{name}.ids", f"<u{width}"), store.map(f"{name}.idx", "<i8")
                n = int(index[0])
                docs, offsets = index[1 : n + 1], index[n + 1 :]
                for a in range(0, n, 4096):
                    b = min(n, a + 4096)
                    crc = [zlib.crc32(tokens[offsets[i] : offsets[i + 1]].astype("<u4").data) for i in range(a, b)]
                    yield pa.record_batch(
                        [pa.array(np.array(docs[a:b])), pa.array(base + offsets[a:b]), pa.array(np.diff(offsets[a : b + 1])), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # from Arrow: rows from a list pass through Python workers of another daemon, which then stay in the executors' memory
    shards = spark.createDataFrame(pa.table({"shard": pa.array([s[0] for s in corpus.shards], pa.string()), "base": pa.array([s[1] for s in corpus.shards], pa.int64())}))
    return shards.repartition(max(1, len(corpus.shards)), F.col("shard")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(corpus: Corpus, position: int) -> np.ndarray:
    """The ids of the corpus's document at ``position`` in ascending order, from the mapped files."""
    store = Store(corpus.folder)
    for name, _, docs, _ in corpus.shards:
        if position < docs:
            index = store.map(f"{name}.idx", "<i8")
            offsets = index[int(index[0]) + 1 :]
            return store.map(f"{name}.ids", f"<u{corpus.width}")[offsets[position] : offsets[position + 1]]
        position -= docs
    raise IndexError(position)
