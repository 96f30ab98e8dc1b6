"""Edit-aware token counts (operator 3).

A document is cut at borders of pre-tokens into blocks, and a segment tree over the blocks keeps the number of characters and
of tokens below every node. An edit finds its blocks by descending the character sums; the text of these blocks, and of a
neighbour where the edit leaves a border that a pre-token may cross, is cut and encoded anew, and the sums above are updated. All
other blocks keep their counts. No token crosses a border, so blocks add up exactly.

count_trees() encodes whole documents once; its trees (blocks and counts of each document) are a table that can be kept.
apply_edits() takes kept trees and a batch of edits, encodes what the edits touch and gives counts and, if asked, the new trees.

A border is a place beside white space, between ASCII letters and digits, or where an ASCII or ideographic stop or comma is
followed by a letter or digit: all pre-token patterns end there, whatever stands further away. A document without any such place
is one block, so an edit encodes all of it.

Edits are applied one after another; positions refer to the text as the edits before have left it, and beyond its end mean the
end. Defined results: a null text is empty and has no block; a very long text has more blocks, and an edit still encodes only
those that it touches (memory: about 20 times its bytes while it is encoded first); an empty or null list of edits, or a null
edit, changes nothing; repeated rows are counted once for each row; null and repeated ids (all 64 bits of them) are returned as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricehist.llm.common import SPACE, hand_back, slices, stored, texts
from pricehist.llm.packing import word_encoder

BLOCK = 400
EDIT = "struct<start: int, length: int, insert: string>"
TREE = "blocks array<string>, counts array<int>"
#: Places between two characters that no pre-token crosses.
BORDER = re.compile(
    rf"(?=[{SPACE}])|(?<=[{SPACE}])|(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])"
    "|(?<=[.,;:!?\u3001\u3002\uff01\uff1f])(?=[0-9A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3])"
)


def blocks_of(text: str, size: int = BLOCK) -> list[str]:
    """Pieces of at least size characters (but for the last), cut at borders."""
    out, a = [], 0
    while a < len(text):
        m = BORDER.search(text, a + size) if a + size < len(text) else None
        b = m.start() if m else len(text)
        out.append(text[a:b])
        a = b
    return out


def parted(left: str, right: str) -> bool:
    """Whether the place between two texts that are not empty is a border."""
    return BORDER.match(left[-1] + right[0], 1) is not None


class CountTree:
    """Blocks of a text under sums of characters and tokens. count: number of tokens of a text."""

    def __init__(self, blocks: list[str], counts: list[int], count: Callable[[str], int]):
        self.count, self.encoded = count, 0
        self.build(blocks, counts)

    def build(self, blocks: list[str], counts: list[int]) -> None:
        n = 1
        while n < len(blocks):
            n *= 2
        self.n, self.blocks = n, blocks + [""] * (n - len(blocks))
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (b, c) in enumerate(zip(blocks, counts, strict=True)):
            self.chars[n + i], self.tokens[n + i] = len(b), c
        for i in range(n - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> tuple[list[str], list[int]]:
        """Blocks that are not empty, and their counts."""
        full = [i for i, t in enumerate(self.blocks) if t]
        return [self.blocks[i] for i in full], [self.tokens[self.n + i] for i in full]

    def text(self) -> str:
        return "".join(self.blocks)

    def find(self, at: int) -> tuple[int, int]:
        """The block that has the character at a position (the last one, at the end), and the place in it."""
        i = 1
        while i < self.n:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.n, at

    def put(self, i: int, text: str, tokens: int) -> None:
        self.blocks[i] = text
        i += self.n
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def filled(self, i: int, step: int) -> int | None:
        i += step
        while 0 <= i < self.n and not self.blocks[i]:
            i += step
        return i if 0 <= i < self.n else None

    def edit(self, start: int, length: int, insert: str) -> None:
        start = max(0, min(start, self.chars[1]))
        stop = max(start, min(start + length, self.chars[1]))
        a, x = self.find(start)
        b, y = self.find(stop)
        new = self.blocks[a][:x] + insert + self.blocks[b][y:]
        # Boundary context: where the edit leaves no border, a pre-token may reach into the neighbour.
        while (p := self.filled(a, -1)) is not None and not (new and parted(self.blocks[p], new)):
            new, a = self.blocks[p] + new, p
        while (p := self.filled(b, 1)) is not None and not (new and parted(new, self.blocks[p])):
            new, b = new + self.blocks[p], p
        parts = blocks_of(new)
        room = b - a + 1
        counts = [self.count(t) for t in parts]
        self.encoded += len(parts)
        if len(parts) > room:
            if len(parts) > room + 4:  # a long insertion: the tree is built again, from the counts it has
                kept = [(t, self.tokens[self.n + i]) for i, t in enumerate(self.blocks) if t and not a <= i <= b]
                before = sum(1 for i in range(a) if self.blocks[i])
                rows = [*kept[:before], *zip(parts, counts, strict=True), *kept[before:]]
                self.build([t for t, _ in rows], [c for _, c in rows])
                return
            parts = [*parts[: room - 1], "".join(parts[room - 1 :])]
            counts = [*counts[: room - 1], sum(counts[room - 1 :])]
        for i in range(room):
            self.put(a + i, parts[i] if i < len(parts) else "", counts[i] if i < len(parts) else 0)


def count_trees(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, blocks, counts of every document, and its edits if docs has such a column."""
    rest = ["edits"] if "edits" in docs.columns else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = word_encoder(path)
        for b in batches:
            column = texts(b["text"])
            for lo, hi in slices(column, 4096, 4 << 20):
                blocks = [blocks_of(t) for t in column[lo:hi]]
                flat = coder.count(pa.array([x for one in blocks for x in one], pa.string())).tolist()
                counts, at = [], 0
                for one in blocks:
                    counts.append(flat[at : at + len(one)])
                    at += len(one)
                yield b.iloc[lo:hi][["doc_id", *rest]].assign(blocks=blocks, counts=counts)
        hand_back()

    rows = docs.select(F.col("doc_id").cast("string"), "text", *rest).mapInPandas(run, "doc_id string, " + f"edits array<{EDIT}>, " * len(rest) + TREE)
    return rows.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def apply_edits(trees: DataFrame, path: str, keep_trees: bool = False) -> DataFrame:
    """doc_id, tokens_before, tokens_after, n_blocks, blocks_encoded, and with keep_trees the blocks and counts after the edits.
    trees: doc_id, blocks, counts, edits (an array of EDIT)."""
    names = ["doc_id", "tokens_before", "tokens_after", "n_blocks", "blocks_encoded", *["blocks", "counts"] * keep_trees]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = word_encoder(path)
        for b in batches:
            rows = []
            for doc, blocks, counts, edits in zip(b["doc_id"], b["blocks"], b["counts"], b["edits"], strict=True):
                tree = CountTree(list(blocks), list(counts), coder.count_one)
                before = tree.total
                for e in edits if edits is not None else ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                rows.append((doc, before, tree.total, len(blocks), tree.encoded, *tree.leaves()[: 2 * keep_trees]))
            yield pd.DataFrame(rows, columns=names)
        hand_back()

    kinds = "doc_id string, tokens_before long, tokens_after long, n_blocks int, blocks_encoded int"
    rows = trees.select(F.col("doc_id").cast("string"), "blocks", "counts", "edits").mapInPandas(run, kinds + f", {TREE}" * keep_trees)
    return rows.withColumn("doc_id", F.col("doc_id").cast(dict(trees.dtypes)["doc_id"]))


def count_edited(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tokens_before, tokens_after, n_blocks, blocks_encoded. docs: doc_id, text, edits (an array of EDIT). The trees are
    written to the shared folder first, as they would be for edits that come later."""
    return apply_edits(stored(count_trees(docs, path), "count-trees"), path)


def with_edits(docs: DataFrame, edits: int = 3) -> DataFrame:
    """doc_id, text and edits that follow from each row: pieces of the text are cut out and others of it put in."""
    n = F.length(F.coalesce("text", F.lit("")))

    def drawn(k: int, most: int | F.Column) -> F.Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(most) if isinstance(most, int) else most).cast("int")

    one = [
        F.struct(drawn(3 * k, n + 1).alias("start"), drawn(3 * k + 1, 40).alias("length"),
        F.substring(F.coalesce("text", F.lit("")), drawn(3 * k + 2, n + 1) + 1, F.lit(30)).alias("insert"))
        for k in range(edits)
    ]
    return docs.select("doc_id", "text", F.array(*one).alias("edits"))
