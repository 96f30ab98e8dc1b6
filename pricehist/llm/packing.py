"""Best-fit packing by sums of squares (operator 1).

Documents become token pieces of at most `capacity`; only longer documents are cut. A piece goes into the open sequence
that makes the sum of the squared counts of open sequences per residual gap smallest; a new sequence is opened where none
has room. Pieces come longest first, which leaves the short ones to close the gaps.

Pieces are dealt to tasks by a hash of their id, each task packing about `task_pieces` of them with a table of `capacity`
counts, so a task's work and memory do not grow with the input; each task leaves about one sequence unfilled.

Memory: texts are encoded in slices of about SLICE_SIZE bytes; a longer text is a slice of its own and takes some 20 times its bytes
while it is encoded.

Defined results: a null or empty text is one piece of the separator alone; a very long text is cut into pieces of `capacity`, of
which only the last may be shorter; repeated rows are packed once for each row; null and repeated ids (all 64 bits of them) are returned as they are; equal lengths are taken by id; an empty table has
no pieces; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricehist.llm.bpe import byte_letters
from pricehist.llm.common import INFO_SEPARATORS, cut, hand_back

#: Words in each of two dictionaries, the young and the old one.
KEEP_WORDS = 150_000
#: Texts that are cut into words at once: rows and characters.
SLICE_ROWS, SLICE_SIZE = 8_192, 8 << 20
#: Marks that end many words; behind a letter or digit, a run of them is a pre-token of its own.
MARKS = ".,;:!?#$%&*|"
#: A word that no normalisation but lower case changes and that is one pre-token.
PLAIN = re.compile("[a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")


class WordEncoder:
    """Ids of whole texts for a tokenizer that lower-cases and drops white space, which no token crosses: texts are cut into words
    at white space, each different word of a batch is looked up once, and the ids of words are kept in two bounded dictionaries,
    a young and an old one. A new word of Latin letters goes to the tokenizer's model alone, any other to the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.spelled = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def made(self, word: str) -> bytes:
        """The ids of a new word. Marks behind its last letter or digit are looked up by themselves."""
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.model.tokenize(word.lower())]).tobytes()
        base = word.rstrip(MARKS)
        if len(base) < len(word) and base and base[-1] < "\u0180" and base[-1].lower().isalnum():
            end = word[len(base) :]
            if end not in self.ends and len(self.ends) < 10_000:
                self.ends[end] = self.library(end)
            return (self.young.get(base) or self.old.get(base) or self.made(base)) + (self.ends.get(end) or self.library(end))
        if PLAIN.fullmatch(word):
            return array("I", [t.id for t in self.model.tokenize(word.lower().translate(self.spelled))]).tobytes()
        return self.library(word)

    def look(self, words: list[str]) -> list[bytes]:
        out, young, old = list(map(self.young.get, words)), self.young, self.old
        for i in [i for i, x in enumerate(out) if x is None]:
            w = words[i]
            got = out[i] = old.get(w) or self.made(w)
            if len(w) <= 64:
                young[w] = got
        if len(young) > KEEP_WORDS:
            self.old, self.young = young, {}
        return out

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """For a column without nulls: first word of each text (and the end), number of each word, numbers of ids and ids of each
        different word. A text in which words need not end at white space counts as one word."""
        odd = pc.or_(pc.match_substring(column, "<|"), pc.match_substring_regex(column, INFO_SEPARATORS.pattern))
        lists = pc.utf8_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", column) if pc.any(odd).as_py() else column))
        coded = lists.flatten().dictionary_encode()
        ids, which, ends = self.look(coded.dictionary.to_pylist()), coded.indices.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            which = which if which.flags.writeable else which.copy()
            which[ends[i] - ends[0]] = len(ids)  # an empty text is one empty word
            ids.append(self.library(column[i].as_py()))
        return ends - ends[0], which, np.fromiter(map(len, ids), np.int64, len(ids)) // 4, ids

    def count(self, column: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        ends, which, size, _ = self.words(column)
        return np.diff(np.append(0, np.cumsum(size[which]))[ends])

    def count_one(self, text: str) -> int:
        """Number of ids of a short text."""
        if "<|" in text or INFO_SEPARATORS.search(text):
            return len(self.library(text)) // 4
        words = text.lower().split() if text.isascii() else text.encode("utf-8", "replace").lower().decode().split()
        return sum(map(len, self.look(words))) // 4

    def encode(self, column: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ends, which, size, ids = self.words(column)
        n, first, flat = size[which], np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        at = np.append(0, np.cumsum(n))
        raw = flat[np.repeat(first[which] - at[:-1], n) + np.arange(at[-1])].tobytes()
        cuts = (4 * at[ends]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def column_slices(column: pa.Array, rows: int = SLICE_ROWS, size: int = SLICE_SIZE) -> Iterator[tuple[int, pa.Array]]:
    """Place of its first text, and a part of a column of texts, null as empty: at most `rows` texts and, but for a single longer
    text, `size` bytes."""
    column = pc.fill_null(column, "")
    at, a = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)), 0
    while a < len(column):
        b = int(np.searchsorted(at, size + (at[a - 1] if a else 0), side="right"))
        b = min(max(a + 1, b), a + rows, len(column))
        yield a, column.slice(a, b - a)
        a = b


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of each document."""
    end = np.array([separator], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(path)
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, part in column_slices(b.column(1)):
                rows = []
                for doc, raw in zip(ids[lo : lo + len(part)], coder.encode(part), strict=True):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[a : a + 4 * capacity]
                        rows.append((doc, k, a // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, pieces being placed in the given order.

    With n[g] open sequences of gap g, moving one from g to g - s changes the sum of squares by 2 (n[g - s] - n[g]) + 2;
    a full one leaves the sum."""
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for j, s in enumerate(lengths.tolist()):
        change = np.where(counts[s:] > 0, 2 * (counts[: capacity - s + 1] - counts[s:]) + 2, np.iinfo(np.int64).max)
        if counts[s]:
            change[0] = 1 - 2 * counts[s]
        after = int(change.argmin())
        if counts[after + s]:
            gap = after + s
            at = open_at[gap].pop()
            counts[gap] -= 1
        else:
            gap, after, at = capacity, capacity - s, made
            made += 1
        if after:
            counts[after] += 1
            open_at[after].append(at)
        sequence[j], offset[j] = at, capacity - gap
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = 2048, task_pieces: int = 20_000) -> DataFrame:
    """pieces with sequence_id and offset. pieces: doc_id, piece, length and what else is to be kept."""
    rest = pieces.filter(F.col("length") < capacity)
    tasks = max(1, round(rest.count() / task_pieces))
    columns = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        at, offset = place(rows["length"].to_numpy(), capacity)
        sequence = rows["task"].to_numpy() + tasks * np.asarray(at, np.int64)
        return rows.drop_columns("task").append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    # A whole piece is a sequence of its own: its id is negative, and no other row's.
    whole = pieces.filter(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    # Dealt by place as well, as many rows may have one id; pieces is a table or a checkpoint, whose places stay.
    dealt = rest.withColumn("task", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(tasks)))
    packed = dealt.groupBy("task").applyInArrow(run, f"{columns}, sequence_id long, offset long")
    return whole.unionByName(packed)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all documents."""
    return pack(cut(token_pieces(docs, path, capacity)), capacity)
