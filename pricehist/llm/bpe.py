"""Byte-level BPE by per-prefix dynamic programming (operator 7).

For every prefix of a pre-token there is exactly one last token that its BPE encoding can end with. An automaton over all
tokens of the vocabulary lists the tokens that end at a position; the one whose predecessor (the last token of the shorter
prefix) stays next to it under the merge rules is that last token. Back-pointers then give the ids. Decoding looks up
bytes.

Text is cut into units (white space, then what follows up to the next white space): no pre-token of the pattern crosses a
unit's end, so a unit's ids do not depend on its neighbours and can be kept in a bounded dictionary.

Defined results: a null text counts as empty; an empty text has no ids; a special token written in a text is one id, as in
the tokenizers library; very long texts are encoded whole, so that a task holds the units and ids of one of them (about 20 times its
bytes); repeated rows are encoded once for each row; null and repeated ids are returned as they are; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricehist.llm.common import SPACE, hand_back, texts

#: The pre-token pattern of this vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Units in each of two dictionaries, the young and the old one.
KEEP_UNITS = 250_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PrefixBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank, self.parts = {}, {}
        for r, (a, b) in enumerate(merges):
            self.rank[vocab[a], vocab[b]] = r
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.next_to: dict[tuple[int, int], bool] = {}
        self.left, self.right = {}, {}
        fit = []
        for t, i in sorted(vocab.items(), key=lambda x: x[1]):
            p = self.parts.get(i)
            # A token that the merges never make, or make otherwise, cannot be in an encoding.
            if len(t) == 1 or p and self.compatible(p[0], p[1], p[2]):
                fit.append((self.bytes_of[i], i))
        self.build(fit)
        self.pre = regex.compile(PATTERN)
        self.unit = regex.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.rare = re.compile(f"[{SPACE}\0]".replace("\n", "").replace(" ", ""))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.kept: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}

    def build(self, tokens: list[tuple[bytes, int]]) -> None:
        """The automaton: a state for each prefix of a token; ends[state]: the tokens that are suffixes of it, longest first."""
        step, own = [{}], [0]
        for word, token in tokens:
            s = 0
            for b in word:
                t = step[s].get(b)
                if t is None:
                    t = step[s][b] = len(step)
                    step.append({})
                    own.append(0)
                s = t
            own[s] = (len(word), token)
        fall, ends, queue = [0] * len(step), [()] * len(step), [0]
        for s in queue:
            for b, t in step[s].items():
                f = fall[s]
                while s and f and b not in step[f]:
                    f = fall[f]
                fall[t] = step[f].get(b, 0) if s else 0
                ends[t] = (own[t], *ends[fall[t]]) if own[t] else ends[fall[t]]
                queue.append(t)
        self.step, self.fall, self.ends = step, fall, ends

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts at one side of a token, each with the rank of the merge that uses it up."""
        memo = self.right if side else self.left
        if token not in memo:
            out, end, t = [], float("inf"), token
            while True:
                out.append((t, end))
                if t not in self.parts:
                    break
                p = self.parts[t]
                t, end = p[side], p[2]
            memo[token] = out
        return memo[token]

    def compatible(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether BPE leaves token a next to token b: no merge across the gap happens while both its parts exist.

        Of equal ranks the merge further left goes first: it takes a's part away, but b's part only later."""
        for x, x_end in self.edge(a, 1):
            for y, y_end in self.edge(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < x_end and r <= y_end and r < before:
                    return False
        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        step, fall, ends, next_to = self.step, self.fall, self.ends, self.next_to
        last, size, state, end = [-1], [0], 0, 0
        for b in piece:
            end += 1
            while (t := step[state].get(b)) is None:
                state = fall[state]
            state = t
            for length, token in ends[state]:
                if length == end:
                    break
                pair = (last[end - length], token)
                fits = next_to.get(pair)
                if fits is None:
                    if len(next_to) > 400_000:
                        next_to.clear()
                    fits = next_to[pair] = self.compatible(*pair)
                if fits:
                    break
            last.append(token)
            size.append(length)
        ids = []
        while end:
            ids.append(last[end])
            end -= size[end]
        return ids[::-1]

    def encode_unit(self, unit: str) -> tuple[str, bytes]:
        """Ids joined by commas, each with a comma before it; their decoded bytes."""
        plain = unit[1:] if unit[0] == " " else unit
        # One run of ASCII letters is one pre-token.
        pieces = [unit] if plain.isascii() and plain.isalpha() else self.pre.findall(unit)
        ids = [i for piece in pieces for i in self.encode_piece(piece.encode("utf-8", "replace"))]
        return "".join([f",{i}" for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    def look(self, key: str, unit: str) -> tuple[str, bytes]:
        """A unit's entry: from the young dictionary, the old one, or made now."""
        got = self.kept.get(key) or self.old.get(key) or self.encode_unit(unit)
        if len(key) <= 64:
            if len(self.kept) >= KEEP_UNITS:
                self.old, self.kept = self.kept, {}
            self.kept[key] = got
        return got

    def units(self, text: str) -> list[tuple[str, bytes]]:
        """Entries of a text's units, in order. Keys: a unit with one leading space goes without it, any other that starts
        otherwise than by a line break goes with a NUL before it."""
        out, split = [], self.split and "<|" in text
        for k, part in enumerate(self.split.split(text) if split else [text]):
            if k % 2:
                i = self.special[part]
                out.append((f",{i}", self.bytes_of[i]))
            elif not part:
                continue
            elif "  " in part or "\n\n" in part or " \n" in part or "\n " in part or self.rare.search(part):
                for u in self.unit.findall(part):
                    out.append(self.kept.get(f"\0{u}") or self.look(f"\0{u}", u))
            else:
                # Every run of white space is one space or one line break here.
                first, *rest = part.replace("\n", " \n").split(" ")
                if first:
                    out.append(self.look(f"\0{first}", first))
                got = list(map(self.kept.get, rest))
                if None in got:
                    for j, u in enumerate(got):
                        if u is None:
                            got[j] = self.look(rest[j], rest[j] if rest[j][:1] == "\n" else f" {rest[j]}")
                out += got
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in "".join([u[0] for u in self.units(text)]).split(",")[1:]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        units = self.units(text)
        ids = "".join([u[0] for u in units])
        plain = b"".join([u[1] for u in units]).decode("utf-8", "replace").encode()
        return ids.count(","), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(plain).hexdigest()


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": [bpe.encode(t) for t in texts(b[text])]})

    rows = docs.select(F.col(key).cast("string"), text).mapInPandas(run, f"{key} string, ids array<int>")
    return rows.withColumn(key, F.col(key).cast(dict(docs.dtypes)[key]))


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, text of ids that encode() made."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [bpe.decode(list(x)) if x is not None else None for x in b["ids"]]})

    rows = encoded.select(F.col(key).cast("string"), "ids").mapInPandas(run, f"{key} string, text string")
    return rows.withColumn(key, F.col(key).cast(dict(encoded.dtypes)[key]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without keeping the ids."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for text in parts:
            yield pd.DataFrame([bpe.digest(t) for t in texts(text)], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        hand_back()

    return docs.select(F.col("doc_id").cast("long"), digests("text").alias("d")).select("doc_id", "d.*")
