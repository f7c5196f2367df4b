"""Token counts that follow edits.

trees() keeps a segment tree for each document as a row of a table: a leaf holds a stretch of about LEAF pre-tokens, a node the sums of characters and tokens below (two
arrays in heap order, node 1 is the root).
edited() applies edits to such rows without the documents' texts, and can give the trees as they are then, for the next edits. An edit
replaces characters start to stop. The tree is descended to the leaves that the edit touches; there, the words that it touches and one word of
context on each side are encoded as they were and as they are now, and the difference goes into the sums on the way to the root. Leaves and regions begin
at borders where no token can lie across (before white space that follows other characters, and between Chinese characters and their punctuation), so one word of context is enough on either side.

Leaves stay within bounds: what an edit leaves of the leaves that it touches is parted where it has more than MOST characters, and joined with a neighbour where it has
fewer than LEAST, so a tree after many edits
is like a fresh one, and an edit encodes a bounded number of characters beside what it inserts. Only a stretch without any border (one word of thousands of letters) is a leaf of its own length.

Cases: null texts are empty; edits that are null or outside the text are clipped to it; a null replacement deletes; edits apply one after another, each to
the text the former left; a document without edits keeps its tree; an empty table gives no rows;
repeated rows are counted each; other columns are ignored."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, table
from tessera.llm.encode import BREAK, HAN, HAN_POINTS, WORD, Encoder, encoder, slices

LEAF = 64
#: Characters of a leaf: within these bounds after an edit, if its text has borders.
LEAST, MOST = 64, 1024
_HAN, _POINTS = "[" + "-".join(HAN) + "]", "[" + HAN_POINTS + "]"
BORDER = re.compile(f"{BREAK.pattern}|(?<={_HAN})(?={_POINTS})|(?<={_POINTS})(?={_HAN})")


class Tree:
    """A text in leaves; sums[0] has characters and sums[1] tokens, node 1 is the root, leaves begin at node `base`."""

    def __init__(self, enc: Encoder, text: str, starts: np.ndarray | None = None, counts: np.ndarray | None = None) -> None:
        """starts and counts: where the encoder's chunks of the text begin and their numbers of tokens, if they are known."""
        self.enc, self.work = enc, 0
        if not text:
            chars, tokens = [0], [0]
        else:
            if starts is None:
                starts, counts, _ = enc.counted([text])
            cuts, at = [0], starts.tolist()
            for k in range(LEAF, len(at), LEAF):
                while k < len(at) and not BORDER.match(text, at[k]):
                    k += 1
                if cuts[-1] < k < len(at):
                    cuts.append(k)
            chars = np.diff(np.append(starts[cuts], len(text))).tolist()
            tokens = np.add.reduceat(counts, cuts).tolist()
        ends = list(accumulate(chars))
        self._grow([text[b - n : b] for b, n in zip(ends, chars, strict=True)], tokens)

    def _grow(self, leaves: list[str], tokens: list[int]) -> None:
        """The tree over some leaves and their counts."""
        self.leaves = leaves
        self.base = 1 << (len(leaves) - 1).bit_length()
        self.sums = [[0] * self.base + x + [0] * (self.base - len(x)) for x in (list(map(len, leaves)), tokens)]
        for node in range(self.base - 1, 0, -1):
            self._up(node)

    @classmethod
    def stored(cls, enc: Encoder, leaves: list[str], chars: list[int], tokens: list[int]) -> Tree:
        """A tree from a row of trees()."""
        self = cls.__new__(cls)
        self.enc, self.work, self.leaves, self.base, self.sums = enc, 0, leaves, len(chars) // 2, [chars, tokens]
        return self

    def _up(self, node: int) -> None:
        for s in self.sums:
            s[node] = s[2 * node] + s[2 * node + 1]

    @property
    def count(self) -> int:
        return self.sums[1][1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf with character `at` (or the last one with any), and characters before it in that leaf."""
        node = 1
        while node < self.base:
            node *= 2
            if at >= self.sums[0][node] and self.sums[0][node + 1]:
                at -= self.sums[0][node]
                node += 1
        return node - self.base, at

    def _count(self, text: str) -> int:
        self.work += len(text)
        return len(self.enc.direct(text)) if len(text) < 1024 else self.enc.count(text)  # a short text isn't worth the cache

    def edit(self, start: int, stop: int, new: str) -> None:
        n = self.sums[0][1]
        start = min(max(0, start), n)
        stop = min(max(start, stop), n)
        if not n:
            text = self.text
            work, text = self.work, text[:start] + new + text[stop:]
            self.__init__(self.enc, text)
            self.work = work + len(text)
            return
        (first, a), (last, _) = self._find(start), self._find(max(start, stop - 1))
        left, right = max(0, first - 1), min(len(self.leaves) - 1, last + 1)  # leaves that may hold the context
        touched = range(left, right + 1)
        old = "".join(self.leaves[left : right + 1])
        a += len(self.leaves[left]) if left != first else 0
        b = a + stop - start
        lo = hi = 0
        cuts = [0, *(m.start() for m in BORDER.finditer(old) if m.start()), len(old)]
        words = list(zip(cuts, cuts[1:], strict=False))
        at = max(0, bisect_right(words, (a, len(old) + 1)) - 1)
        lo = words[max(0, at - 1)][0]
        at = max(0, bisect_right(words, (max(a, b - 1), len(old) + 1)) - 1)
        hi = words[min(len(words) - 1, at + 1)][1]
        now = old[lo:a] + new + old[b:hi]
        change = self._count(now) - self._count(old[lo:hi])
        tokens = sum(self.sums[1][self.base + k] for k in touched) + change
        if left < right:  # keep the leaves that only gave context
            if left != first and lo >= (m := len(self.leaves[left])):
                touched, old, lo, a, b, hi = range(first, right + 1), old[m:], lo - m, a - m, b - m, hi - m
                tokens -= self.sums[1][self.base + left]
            if right != last and hi <= len(old) - (m := len(self.leaves[right])):
                touched, old = range(touched.start, last + 1), old[: len(old) - m]
                tokens -= self.sums[1][self.base + right]
        self._put(touched, old[:lo] + now + old[hi:], tokens)

    def _put(self, touched: range, text: str, tokens: int) -> None:
        """Put a text with so many tokens in the place of some leaves, within the bounds of a leaf."""
        if len(text) < LEAST and len(self.leaves) > len(touched):  # too little: join a neighbour
            k = touched.stop if touched.stop < len(self.leaves) else touched.start - 1
            text = text + self.leaves[k] if k == touched.stop else self.leaves[k] + text
            tokens += self.sums[1][self.base + k]
            touched = range(min(k, touched.start), max(k + 1, touched.stop))
        pieces, counts = [text], [tokens]
        if len(text) > MOST:
            borders, pieces, at = [m.start() for m in BORDER.finditer(text) if m.start()], [], 0
            for k, b in enumerate(borders):
                if b - at >= MOST // 2 and len(text) - b >= LEAST and (k + 1 == len(borders) or borders[k + 1] - at > MOST // 2):
                    pieces.append(text[at:b])
                    at = b
            pieces.append(text[at:])
            counts = [self._count(p) for p in pieces[:-1]]
            counts.append(tokens - sum(counts))
        if len(touched) == len(pieces):
            for k, piece, n in zip(touched, pieces, counts, strict=True):
                self.leaves[k], self.sums[0][self.base + k], self.sums[1][self.base + k] = piece, len(piece), n
            nodes = {self.base + k for k in touched}
            while nodes := {x // 2 for x in nodes} - {0}:
                for x in nodes:
                    self._up(x)
        else:
            own = self.sums[1][self.base : self.base + len(self.leaves)]
            own[touched.start : touched.stop] = counts
            self._grow([*self.leaves[: touched.start], *pieces, *self.leaves[touched.stop :]], own)


EDITS = "array<struct<start: bigint, stop: bigint, text: string>>"


TREE = "doc_id long, leaves array<string>, chars array<bigint>, tokens array<bigint>"
_TREE = pa.schema([("doc_id", pa.int64()), ("leaves", pa.list_(pa.string())), ("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
_COUNTS = ["n_tokens", "n_tokens_after", "n_edits", "n_chars", "n_encoded_again"]


def trees(docs: DataFrame, path: str = WORD) -> DataFrame:
    """A tree for each row of docs (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            values = [v or "" for v in batch.column(1).to_pylist()]
            for a, b in slices(values):
                starts, n, first = enc.counted(values[a:b])
                at, rows = 0, []
                for k in range(a, b):
                    own = slice(first[k - a], first[k - a + 1])
                    tree = Tree(enc, values[k], starts[own] - at, n[own])
                    at += len(values[k])
                    rows.append((tree.leaves, *tree.sums))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(_TREE)[1:], strict=True))], schema=_TREE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), TREE)


def edited(rows: DataFrame, path: str = WORD, keep: bool = True) -> DataFrame:
    """Rows of trees() with edits (EDITS): n_tokens before and n_tokens_after all edits, n_edits, n_chars, and n_encoded_again, the characters encoded for the edits; with keep the trees after the edits, too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            out, counts = [], []
            for leaves, chars, tokens, edits in zip(*(batch.column(j).to_pylist() for j in range(1, 5)), strict=True):
                tree = Tree.stored(enc, leaves, chars, tokens)
                before, n, done = tree.count, chars[1], 0
                for e in edits or ():
                    if e:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                        done += 1
                counts.append((before, tree.count, done, n, tree.work))
                if keep:
                    out.append((tree.leaves, *tree.sums))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*counts, strict=True) if counts else [()] * 5))]
            if keep:
                arrays += [pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, list(_TREE)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *_COUNTS, *(_TREE.names[1:] if keep else ())])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + (", " + TREE.partition(", ")[2] if keep else "")
    return rows.select("doc_id", "leaves", "chars", "tokens", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(lean(run), schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after three edits of each, from their stored trees: a deletion, an insertion and a replacement (by the text's first nine characters) at places that follow from doc_id."""
    kept = table(trees(documents(spark, sf_dir)), "trees")
    n = F.greatest(F.col("chars")[1], F.lit(1))
    place = lambda k: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), n)
    edit = lambda a, b, t: F.struct(a.alias("start"), b.alias("stop"), t.alias("text"))
    begin = F.left(F.array_join(F.slice("leaves", 1, 9), ""), F.lit(9))  # a leaf has a character at least
    edits = F.array(edit(place(1), place(1) + 12, F.lit("")), edit(place(2), place(2), F.lit(" inserted words, 42")), edit(place(3), place(3) + 5, begin))
    return edited(kept.withColumn("edits", edits), keep=False)
