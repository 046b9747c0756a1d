"""BPE encoding and decoding over contiguous rank arrays.

A word is held as two parallel arrays: its parts and, between them, the rank of the merge
of each part with the next one. The smallest rank is looked for, the leftmost of equals;
its boundary is deleted from the arrays, and the two neighbouring ranks are looked up anew.
Words are short, so scanning a contiguous array beats a heap or a linked list. Words of
one length are rows of one matrix: every step shortens all rows by one boundary, and rows
without a rank left are done. Runs of over LONGEST_SHORT letters, for which scans would cost the
square of their length, merge in the same order by a heap over linked boundaries.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm.common import bounded_batches, sliced

#: The splitter's pattern for ASCII, and the white space that the vocabulary's file knows.
ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters that Python takes for white space and the file's patterns don't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
NO_RANK = 1 << 30
#: Bounds of a worker's memory: remembered words and runs, matrix cells and characters worked on at once.
WORDS_HELD, CHUNKS_HELD = 300_000, 400_000
CELLS, CHARACTERS_AT_ONCE = 400_000, 4_000_000
#: Longer words are neither scanned nor remembered.
LONGEST_SHORT = 256


class RankArrayBPE:
    """Encodes and decodes as a ``tokenizers`` file of kind BPE with word ends says.

    Merges are applied here; the library only normalises and splits what isn't ASCII, so
    that both know the same Unicode. Truncation and padding are unused and no special
    token is added; those that a text spells out become their ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        vocabulary: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in stored["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocabulary.items(), *self.added.items()]}
        self.size = max(self.tokens) + 1
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in model["merges"]]
        keys = np.array([a * self.size + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([m for _, _, m in pairs], np.int32)
        self.pair_ranks = dict(zip(keys.tolist(), range(len(pairs))))
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.letters = {c: vocabulary[c] for c in vocabulary if len(c) == 1}
        self.last_letters = {c: vocabulary[c + suffix] for c in self.letters}
        self.ascii_split = re.compile(ASCII_SPLIT, re.ASCII)
        self.chunk = re.compile(f"[^{SPACES}]+")
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.words: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.long: list[str] = []

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or NO_RANK."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word; words are in byte-level characters and not empty."""
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        by_length: dict[int, list[int]] = {}
        for n, word in enumerate(words):
            if len(word) > LONGEST_SHORT:
                found[n] = self.merge_long([*map(self.letters.__getitem__, word[:-1]), self.last_letters[word[-1]]])
            else:
                by_length.setdefault(len(word), []).append(n)
        for length, members in by_length.items():
            rows_at_once = max(1, CELLS // length)
            for at in range(0, len(members), rows_at_once):
                some = members[at: at + rows_at_once]
                first = [self.letters[c] for n in some for c in words[n]]
                parts = np.array(first, np.int32).reshape(len(some), length)
                parts[:, -1] = [self.last_letters[words[n][-1]] for n in some]
                for n, ids in self.merge(np.array(some), parts):
                    found[n] = ids
        return found

    def merge(self, rows: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Merges all rows' parts as far as ranks go; gives each row's number and ids."""
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                yield from zip(rows.tolist(), parts)
                return
            at = ranks.argmin(1)
            every = np.arange(len(rows))
            least = ranks[every, at]
            done = least == NO_RANK
            if done.any():
                yield from zip(rows[done].tolist(), parts[done])
                rows, parts, ranks, at, least = (x[~done] for x in (rows, parts, ranks, at, least))
                every = np.arange(len(rows))
                if not len(rows):
                    return
            width = parts.shape[1]
            parts[every, at] = self.merged[least]
            kept = np.ones(parts.shape, bool)
            kept[every, at + 1] = False
            parts = parts[kept].reshape(len(rows), width - 1)
            kept = np.ones(ranks.shape, bool)
            kept[every, at] = False
            ranks = ranks[kept].reshape(len(rows), width - 2)
            inner = at > 0
            row, col = every[inner], at[inner]
            ranks[row, col - 1] = self.rank(parts[row, col - 1], parts[row, col])
            inner = at < width - 2
            row, col = every[inner], at[inner]
            ranks[row, col] = self.rank(parts[row, col], parts[row, col + 1])

    def merge_long(self, parts: list[int]) -> np.ndarray:
        """The ids of one long word: the least rank first, the leftmost of equals."""
        size = len(parts)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        first = self.rank(np.array(parts[:-1]), np.array(parts[1:]))
        heap = [(rank, n, parts[n], parts[n + 1]) for n, rank in enumerate(first.tolist()) if rank != NO_RANK]
        heapq.heapify(heap)

        def push(n: int) -> None:
            if n >= 0 and after[n] < size:
                a, b = parts[n], parts[after[n]]
                rank = self.pair_ranks.get(a * self.size + b)
                if rank is not None:
                    heapq.heappush(heap, (rank, n, a, b))

        while heap:
            rank, n, a, b = heapq.heappop(heap)
            m = after[n]
            # An entry is of no use if either part has merged since.
            if parts[n] != a or m >= size or parts[m] != b:
                continue
            parts[n], parts[m] = int(self.merged[rank]), -1
            after[n] = after[m]
            if after[m] < size:
                before[after[m]] = n
            push(before[n])
            push(n)
        return np.array([p for p in parts if p >= 0], np.int32)

    def split(self, chunk: str) -> list[str]:
        """The words, in byte-level characters, of a run without white space."""
        if chunk.isascii() and chunk.isprintable():
            return self.ascii_split.findall(chunk.lower())
        return [word for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def learn(self, chunks: set[str]) -> None:
        """Encodes the runs that aren't remembered."""
        if len(self.chunks) > CHUNKS_HELD or len(self.words) > WORDS_HELD:
            self.chunks, self.words = {}, {}
        for held in (self.chunks, self.words):
            for long in self.long:
                held.pop(long, None)
        self.long = [chunk for chunk in chunks if len(chunk) > LONGEST_SHORT]
        split = {chunk: self.split(chunk) for chunk in chunks if chunk not in self.chunks}
        fresh = list({word for words in split.values() for word in words if word not in self.words})
        self.long += [word for word in fresh if len(word) > LONGEST_SHORT]
        for word, ids in zip(fresh, self.encode_words(fresh)):
            self.words[word] = ids.astype("<u4").tobytes(), " ".join([self.tokens[i] for i in ids.tolist()])
        for chunk, words in split.items():
            if len(words) == 1:
                self.chunks[chunk] = self.words[words[0]]
            else:
                pieces = [self.words[word] for word in words]
                self.chunks[chunk] = b"".join([p[0] for p in pieces]), " ".join([p[1] for p in pieces])

    def runs(self, text: str) -> list[str]:
        """The runs between white space; a special token that the text spells is one of them."""
        out, at = [], 0
        for special in self.special.finditer(text):
            out += self.plain_runs(text[at: special.start()])
            out.append(special[0])
            at = special.end()
        return out + self.plain_runs(text[at:] if at else text)

    def plain_runs(self, text: str) -> list[str]:
        return self.chunk.findall(text) if any(c in text for c in ODD_SPACES) else text.split()

    def pieces(self, texts: list[str]) -> Iterator[list[tuple[bytes, str]]]:
        """Of each text, the ids (little-endian, 32 bits) and decoded text of each run."""
        runs, size = [], 0
        for n, text in enumerate(texts):
            runs.append(self.runs(text))
            size += len(text)
            if size > CHARACTERS_AT_ONCE or n == len(texts) - 1:
                self.learn({run for own in runs for run in own if run not in self.added})
                for token, i in self.added.items():
                    self.chunks[token] = np.array([i], "<u4").tobytes(), token
                for own in runs:
                    yield [self.chunks[run] for run in own]
                runs, size = [], 0

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(p[0] for p in next(self.pieces([text]))), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a space; ids that the vocabulary lacks are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(1)
def loaded(path: str) -> RankArrayBPE:
    """One per worker process, which keeps the words it has met."""
    return RankArrayBPE(path)


def bpe_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text.

    ``vocabulary`` is the path of a word-end BPE file that every executor has. A null text
    is empty: no tokens, and the digests of nothing. Repeated rows stay; other columns are
    ignored; an empty table gives no rows. Each run between white space is encoded once
    while a worker remembers it, so a very long text costs its distinct runs, and a very long run
    its length times the logarithm of it.
    """

    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in sliced(batches):
            sizes, ids_digest, text_digest = [], [], []
            for found in bpe.pieces([x or "" for x in batch.column(1).to_pylist()]):
                pieces = [p for p in found if p[0]]
                ids = b"".join([p[0] for p in pieces])
                decoded = " ".join([p[1] for p in pieces])
                sizes.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row; a null text has no ids."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            ids = [bpe.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of, "doc_id long, ids array<int>"
    )


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of each row of (doc_id, ids); null ids give an empty text."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(of, "doc_id long, text string")
