"""Encoding of a corpus with a public byte-pair vocabulary by a walk over the prefixes of its words.

The encoding of a word is known from states of its prefixes: the state of a prefix is the last token of its encoding.
A token can be the last one of a prefix if it ends there and, next to the last token of what is before it, stays
apart from it when the two are merged by rank; exactly one token can. The distinct words of a batch are walked in sorted
order, which is the depth-first order of their trie: what a word shares with the one before it keeps its states, so a prefix
is computed once however many words start with it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
# Fixed value: the pattern by which text is cut into words before the merges of the rank files.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 400_000  #: encoded words a worker remembers; it then starts anew, so memory stays bounded
KEPT_PAIRS = 2_000_000
KEPT_BYTES = 64  #: longer words are encoded when they occur and not remembered


def vocabulary_file(tokenizer: str, folder: str = FOLDER) -> bytes:
    """The rank file of a tokenizer, read on the driver; about 1 MB, so it can be broadcast."""
    with open(os.path.join(folder, f"{tokenizer}.tiktoken"), "rb") as f:
        return f.read()


class PrefixEncoder:
    """Encoder for one vocabulary of byte tokens with ranks."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        #: every ending of a token, so that the search for tokens that end at a place knows when to stop
        self.endings = {t[k:] for t in self.ranks for k in range(len(t))}
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.find = regex.compile(WORDS).findall

    def merged(self, piece: bytes) -> list[int]:
        """Encoding of a short piece straight by the rule: merge the neighbours of lowest rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _stays_alone(self, token: int) -> bool:
        ok = self.alone.get(token)
        if ok is None:
            ok = self.alone[token] = self.merged(self.bytes_of[token]) == [token]
        return ok

    def _stay_apart(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Encodings of distinct words, in the order of their bytes."""
        ranks, endings = self.ranks, self.endings
        last, begin, before = [-1], [0], b""
        for raw, word in sorted((w.encode("utf-8"), w) for w in words):
            shared = 0
            for x, y in zip(raw, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                ends, k = [], end - 1
                while k >= 0:
                    t = raw[k:end]
                    if t not in endings:
                        break
                    r = ranks.get(t)
                    if r is not None:
                        ends.append((k, r))
                    k -= 1
                for k, r in reversed(ends):
                    if self._stays_alone(r) if k == 0 else self._stay_apart(last[k], r):
                        last.append(r)
                        begin.append(k)
                        break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
            before, ids, at = raw, [], len(raw)
            while at:
                ids.append(last[at])
                at = begin[at]
            yield word, ids[::-1]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.find(t) if t else [] for t in texts]
        new = {w for ws in cut for w in ws} - self.words.keys()
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words.clear()
            new = {w for ws in cut for w in ws}
        long = {}
        for w, ids in self.walk(list(new)):
            (self.words if len(w) <= KEPT_BYTES else long)[w] = ids
        known = self.words
        return [[i for w in ws for i in (known[w] if w in known else long[w])] for ws in cut]


_encoders: dict[int, PrefixEncoder] = {}


def encoder(rank_file: bytes) -> PrefixEncoder:
    """The encoder of a vocabulary, made once in each worker."""
    key = hash(rank_file)
    if key not in _encoders:
        _encoders[key] = PrefixEncoder(rank_file)
    return _encoders[key]


BATCH_CHARS = 4_000_000  #: characters that are cut into words at a time


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, without special tokens, one row per row of the input.

    A null and an empty text both give an empty list; a blank one is encoded like any other; strings that look like special
    tokens are ordinary text. Repeated rows are encoded each; a null key stays null. An empty table gives an
    empty result. Further columns are not carried.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(vocabulary_file(tokenizer, folder))
    kind = documents.schema[key].dataType
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value)
        for b in batches:
            at = 0
            for part in _slices(b.column(1).to_pylist()):
                ids = pa.array(enc.encode_batch(part), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), ids], ["doc_id", "ids"])
                at += len(part)

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>")


class Counter:
    """Numbers of tokens of texts by several vocabularies, which all cut texts into the same words.

    A text is cut once, and a word's counts are packed into one number, so that a text costs one look-up for each of its words
    however many vocabularies there are.
    """

    BITS = 40  #: of a count; a text of 2 ** 40 tokens does not fit into memory

    def __init__(self, encoders: list[PrefixEncoder]):
        self.encoders, self.words = encoders, {}

    def count_batch(self, texts: list[str | None]) -> list[list[int]]:
        find = self.encoders[0].find
        cut = [find(t) if t else [] for t in texts]
        known = self.words
        new = set().union(*cut) - known.keys()
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = set().union(*cut)
        counts = dict.fromkeys(new, 0)
        for k, e in enumerate(self.encoders):
            for w, ids in e.walk(list(new)):
                counts[w] += len(ids) << (k * self.BITS)
        long = {}
        for w, n in counts.items():
            (known if len(w) <= KEPT_BYTES else long)[w] = n
        totals = [sum(map(known.__getitem__, ws)) if not long else sum(known[w] if w in known else long[w] for w in ws) for ws in cut]
        mask = (1 << self.BITS) - 1
        return [[t >> (k * self.BITS) & mask for k in range(len(self.encoders))] for t in totals]


_counters: dict[tuple[int, ...], Counter] = {}


def counter(rank_files: list[bytes]) -> Counter:
    """The counter of some vocabularies, made once in each worker."""
    key = tuple(hash(r) for r in rank_files)
    if key not in _counters:
        _counters[key] = Counter([encoder(r) for r in rank_files])
    return _counters[key]


def sizes(documents: DataFrame, tokenizers: list[str], folder: str = FOLDER, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, sizes``: the number of tokens of each text by each of the tokenizers, in their order."""
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast([vocabulary_file(t, folder) for t in tokenizers])
    kind = documents.schema[key].dataType
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks.value).count_batch
        for b in batches:
            at = 0
            for part in _slices(b.column(1).to_pylist()):
                col = pa.array(count(part), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), col], ["doc_id", "sizes"])
                at += len(part)

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, sizes array<int>")
