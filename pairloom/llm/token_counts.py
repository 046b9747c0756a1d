"""Edit-aware token counts: a segment tree of pre-token counts for each document.

The leaves of a document's tree are runs of pre-tokens with their lengths and token counts. An
edit re-splits the text from a little before it until the new pre-token borders meet the old
ones again, re-encodes those pre-tokens only, and changes the sums on the path above the leaves
it touched. A tree can be kept as bytes beside its text and be edited again later.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm.common import BYTE_PATTERN, bounded_batches, byte_characters, has_long_blanks, sliced

#: The pattern looks at most one character beyond a match, or two beyond an apostrophe's start.
LOOKAHEAD = 2
#: Pre-tokens of a fresh leaf; a leaf that an edit leaves with under half as many joins its neighbour.
LEAF = 64
#: Remembered pre-tokens, and their longest; longer ones are rare and would fill a worker's memory.
HELD, LONGEST_HELD = 400_000, 64


class PretokenCounter:
    """Token counts of pre-tokens under a byte-level vocabulary file; remembers short ones that it met."""

    def __init__(self, path: str):
        self.library = library = Tokenizer.from_file(path)
        letters = byte_characters()
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in library.get_vocab(with_added_tokens=False).items() if not re.fullmatch(r"<\|\w+\|>", t)}
        self.encoding = tiktoken.Encoding("counter", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(BYTE_PATTERN)
        self.held: dict[str, int] = {}

    def counts(self, tokens: list[str]) -> list[int]:
        held = self.held
        if len(held) > HELD:
            held.clear()
        out = []
        for token in tokens:
            n = held.get(token)
            if n is None:
                # A pre-token of blanks is one on its own, too; the library doesn't backtrack over it.
                n = len(self.library.encode(token, add_special_tokens=False) if has_long_blanks(token) else self.encoding.encode_ordinary(token))
                if len(token) <= LONGEST_HELD:
                    held[token] = n
            out.append(n)
        return out


@lru_cache(1)
def loaded(path: str) -> PretokenCounter:
    """One per worker process."""
    return PretokenCounter(path)


class Node:
    """A balanced tree over leaves (lengths, counts), with the sums of characters and tokens below each node.

    Nodes are never changed: an edit makes new ones on the path from the root to the leaves it
    touches, ``Node.made`` in number, and shares all others.
    """

    __slots__ = ("left", "right", "leaf", "height", "leaves", "chars", "tokens")
    made = 0

    def __init__(self, left: Node | None = None, right: Node | None = None, leaf: tuple[list[int], list[int]] | None = None):
        Node.made += 1
        self.left, self.right, self.leaf = left, right, leaf
        if leaf is not None:
            self.height, self.leaves, self.chars, self.tokens = 0, 1, sum(leaf[0]), sum(leaf[1])
        else:
            self.height, self.leaves = 1 + max(left.height, right.height), left.leaves + right.leaves
            self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens


def built(leaves: list[tuple[list[int], list[int]]]) -> Node | None:
    if len(leaves) < 2:
        return Node(leaf=leaves[0]) if leaves else None
    half = len(leaves) // 2
    return Node(built(leaves[:half]), built(leaves[half:]))


def balanced(a: Node, b: Node) -> Node:
    """A node over ``a`` and ``b``, whose heights differ by two at most, with one or two rotations if by two."""
    if a.height > b.height + 1:
        if a.left.height < a.right.height:
            return Node(Node(a.left, a.right.left), Node(a.right.right, b))
        return Node(a.left, Node(a.right, b))
    if b.height > a.height + 1:
        if b.right.height < b.left.height:
            return Node(Node(a, b.left.left), Node(b.left.right, b.right))
        return Node(Node(a, b.left), b.right)
    return Node(a, b)


def joined(a: Node | None, b: Node | None) -> Node | None:
    """The leaves of ``a`` and then of ``b``; as many new nodes as their heights differ by, about."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return balanced(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return balanced(joined(a, b.left), b.right)
    return Node(a, b)


def cut(node: Node | None, n: int) -> tuple[Node | None, Node | None]:
    """The first ``n`` leaves and the others."""
    if node is None or n <= 0:
        return None, node
    if n >= node.leaves:
        return node, None
    if n <= node.left.leaves:
        a, b = cut(node.left, n)
        return a, joined(b, node.right)
    a, b = cut(node.right, n - node.left.leaves)
    return joined(node.left, a), b


def leaf_and_start(node: Node, place: int) -> tuple[int, int]:
    """The number of the leaf that holds the character at ``place``, or the last one, and where it starts."""
    number = start = 0
    while node.leaf is None:
        if place < start + node.left.chars:
            node = node.left
        else:
            number, start, node = number + node.left.leaves, start + node.left.chars, node.right
    return number, start


def start_of(node: Node, number: int) -> int:
    """The characters before leaf ``number``."""
    start = 0
    while node.leaf is None:
        if number < node.left.leaves:
            node = node.left
        else:
            number, start, node = number - node.left.leaves, start + node.left.chars, node.right
    return start


def leaves_from(node: Node | None, number: int) -> Iterator[tuple[list[int], list[int]]]:
    """The leaves from ``number`` on."""
    stack = []
    while node is not None and node.leaf is None:
        if number < node.left.leaves:
            stack.append(node.right)
            node = node.left
        else:
            number, node = number - node.left.leaves, node.right
    if node is None:
        return
    stack.append(node)
    while stack:
        node = stack.pop()
        if node.leaf is None:
            stack += [node.right, node.left]
        else:
            yield node.leaf


def chunked(lengths: list[int], counts: list[int]) -> list[tuple[list[int], list[int]]]:
    """Leaves of about LEAF pre-tokens, as even as they can be."""
    parts = max(1, round(len(lengths) / LEAF)) if lengths else 0
    at = [len(lengths) * i // parts for i in range(parts + 1)] if parts else []
    return [(lengths[i:j], counts[i:j]) for i, j in zip(at, at[1:])]


class CountedText:
    """One document's text and the tree over its pre-tokens."""

    def __init__(self, text: str, counter: PretokenCounter, kept: bytes | None = None):
        self.text, self.counter, self.encoded = text, counter, 0
        if kept is None:
            tokens = counter.pattern.findall(text)
            leaves = chunked(list(map(len, tokens)), counter.counts(tokens))
        else:
            numbers = np.frombuffer(kept, "<u4").astype(np.int64)
            size, rest = int(numbers[0]), numbers[1:]
            sizes, (lengths, counts) = rest[:size], rest[size:].reshape(2, -1).tolist()
            at = [0, *np.cumsum(sizes).tolist()]
            leaves = [(lengths[i:j], counts[i:j]) for i, j in zip(at, at[1:])]
        self.tree = built(leaves)

    def kept(self) -> bytes:
        """The tree's leaves as bytes: their number, sizes, all lengths and all counts, of 32 bits each."""
        leaves = list(leaves_from(self.tree, 0))
        numbers = [[len(leaves)], [len(a) for a, _ in leaves], *[a for a, _ in leaves], *[b for _, b in leaves]]
        return np.array([x for part in numbers for x in part], "<u4").tobytes()

    @property
    def tokens(self) -> int:
        return self.tree.tokens if self.tree else 0

    @property
    def chars(self) -> int:
        return self.tree.chars if self.tree else 0

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from ``start`` to ``end`` and counts what that touches anew."""
        old_size = len(self.text)
        start, end = max(0, min(start, old_size)), max(0, min(end, old_size))
        end = max(start, end)
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        # Every pre-token that looked at the edit begins in this leaf or later; one leaf more is context.
        first = begin = 0
        if self.tree:
            first = max(0, leaf_and_start(self.tree, max(0, start - LOOKAHEAD - 1))[0] - 1)
            begin = start_of(self.tree, first)
        old = leaves_from(self.tree, first)
        last, border = first, begin
        lengths, found = [], []
        for match in self.counter.pattern.finditer(self.text, begin):
            at = match.end()
            lengths.append(at - match.start())
            found.append(match[0])
            if at < start + len(new):
                continue
            # Take in old leaves as far as the new scan has come, and stop where borders meet.
            while border + shift < at and (leaf := next(old, None)) is not None:
                border += sum(leaf[0])
                last += 1
            if at == border + shift and border >= end:
                break
        else:
            last = self.tree.leaves if self.tree else 0
            old = iter(())
        self.encoded += sum(lengths)
        counts = self.counter.counts(found)
        if len(lengths) < LEAF // 2 and (leaf := next(old, None)) is not None:
            lengths, counts, last = lengths + leaf[0], counts + leaf[1], last + 1
        before, rest = cut(self.tree, first)
        self.tree = joined(joined(before, built(chunked(lengths, counts))), cut(rest, last - first)[1])


EDITED = "n_tokens long, edited_tokens long, edited_chars long, encoded_chars long"


def edit_kept_trees(trees: DataFrame, edits: Column, vocabulary: str) -> DataFrame:
    """``trees`` (doc_id, text, tree binary) after ``edits``, with the counts of :func:`edit_token_counts`.

    A null tree is made of the text; any other has to be the one of that text and vocabulary, as an
    earlier call gave it, and is changed without encoding anew what the edits leave alone. Without
    edits (null) this makes the trees. ``tree`` has 8 bytes for each pre-token.
    """
    bounded_batches(trees.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(vocabulary)
        for batch in sliced(batches):
            texts, kept, rows = [], [], []
            for text, tree, edits in zip(batch.column(1), batch.column(2), batch.column(3)):
                counted = CountedText(text.as_py() or "", counter, tree.as_py())
                before = counted.tokens
                for edit in edits.as_py() or []:
                    at, gone = edit["at"] or 0, edit["gone"] or 0
                    counted.edit(at, at + max(0, gone), edit["new"] or "")
                texts.append(counted.text)
                kept.append(counted.kept())
                rows.append((before, counted.tokens, len(counted.text), counted.encoded))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(kept, pa.binary()), *map(pa.array, columns)],
                ["doc_id", "text", "tree", "n_tokens", "edited_tokens", "edited_chars", "encoded_chars"],
            )

    own = trees.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("tree").cast("binary").alias("tree"), edits.alias("edits")
    )
    return own.mapInArrow(of, f"doc_id long, text string, tree binary, {EDITED}")


def edit_token_counts(docs: DataFrame, edits: Column, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, edited_tokens, edited_chars, encoded_chars) of each row.

    ``edits`` is a column of array<struct<at:int, gone:int, new:string>>: one after the other, each
    takes ``gone`` code points out at ``at`` of the text as it then is and puts ``new`` there; places
    beyond the end mean the end. ``n_tokens`` counts the whole text, ``edited_tokens`` the edited
    one, of edited_chars code points, of which the edits encoded encoded_chars anew (context
    included). Strings of special tokens are ordinary text. A null text is empty, null edits
    are none, null fields are 0 or empty. Repeated rows stay; other columns are ignored; an
    empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(vocabulary)
        for batch in sliced(batches):
            rows = []
            for text, edits in zip(batch.column(1), batch.column(2)):
                counted = CountedText(text.as_py() or "", counter)
                before = counted.tokens
                for edit in edits.as_py() or []:
                    at, gone = edit["at"] or 0, edit["gone"] or 0
                    counted.edit(at, at + max(0, gone), edit["new"] or "")
                rows.append((before, counted.tokens, len(counted.text), counted.encoded))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns)], ["doc_id", "n_tokens", "edited_tokens", "edited_chars", "encoded_chars"]
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.alias("edits"))
    return own.mapInArrow(of, f"doc_id long, {EDITED}")


def sample_edits(text: Column) -> Column:
    """Edits made of the text itself: an insertion, a deletion and a replacement at its quarters."""
    n = F.char_length(text)

    def one(at: Column, gone: Column, new: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), gone.cast("int").alias("gone"), new.alias("new"))

    return F.array(
        one(F.floor(3 * n / 4), F.lit(0), F.substring(text, 1, 40)),
        one(F.floor(n / 2), F.lit(25), F.lit("")),
        one(F.floor(n / 4), F.lit(10), F.concat(F.lit(" edited's "), F.substring(text, -10, 10))),
    )
