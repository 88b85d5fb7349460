"""Encoding of a corpus with a public byte-level BPE tokenizer.

Short texts are encoded where they lie, in one narrow pass: a batch is cut by Arrow at blanks, equal
units are found by dictionary encoding, each distinct unit is encoded once, and the ids of all texts are gathered
with numpy. A cut is made only where a sign that is no white space is followed by white space: no token of the
pattern contains such a place and the pattern never looks back, so the parts' ids, put together, are the ids of the whole.

Long texts become rows of chunks that are encoded in parallel, at such places where there are any; long
unsplit text is cut in halves anywhere. The chunks of a text are then concatenated as a tree: at a cut that is
not a safe place, windows growing to both sides of the join are encoded again until both sides agree exactly.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborloom.session import ship_code

#: Where the vocabulary files lie on every machine.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts of more characters are encoded in chunks.
LONG_TEXT = 32_768
CHUNK = 16_384
#: Characters that one step of the kernel encodes.
STEP = 4_000_000
#: Distinct units whose ids a process keeps.
KEPT_UNITS = 500_000

_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PARTS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_SAFE = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{_SPACE}]", c))


class Encoder:
    """One vocabulary in one process."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.units: dict[str, np.ndarray] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def unit(self, text: str) -> np.ndarray:
        """Ids of a unit, kept for its next occurrence; long ones are not kept."""
        ids = self.units.get(text)
        if ids is None:
            parts = _PARTS.findall(text) if len(text) > 24 else [text]
            if len(parts) > 1:
                ids = np.concatenate([self.unit(x) for x in parts])
            else:
                ids = np.array(self.bpe.encode_ordinary(text), np.int32)
            if len(text) <= 64:
                if len(self.units) >= KEPT_UNITS:
                    self.units.clear()
                self.units[text] = ids
        return ids

    def encode(self, texts: pa.Array, lengths_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """``(ids, bounds)`` of all texts: those of text i are ``ids[bounds[i]:bounds[i + 1]]``; null has none."""
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds, values = bounds - bounds[0], lists.flatten()
        coded = values.dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        strings = words.to_pylist()
        n = len(code)
        first = np.zeros(n, bool)
        first[bounds[:-1]] = True
        open_end = np.array([not s or s[-1] in _SPACES for s in strings], bool)[code]
        empty = np.array([not s for s in strings], bool)[code]
        open_end &= ~(empty & first)
        head = first.copy()
        head[1:] |= ~open_end[:-1]
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, n))
        key = code[start] * 2 + ~first[start]
        merged: dict[str, int] = {}
        several = np.flatnonzero(size > 1)
        if len(several):
            a, lead, many = start[several].tolist(), (~first[start[several]]).tolist(), size[several].tolist()
            listed, base = code.tolist() if len(several) * 20 > n else code, 2 * len(strings)
            made = [
                merged.setdefault(" " * x + " ".join([strings[listed[j]] for j in range(i, i + m)]), len(merged))
                for i, x, m in zip(a, lead, many, strict=True)
            ]
            key[several] = base + np.array(made, np.int64)
        total = 2 * len(strings) + len(merged)
        there = np.zeros(total, bool)
        there[key] = True
        used = np.flatnonzero(there)
        place = np.zeros(total, np.int64)
        place[used] = np.arange(len(used))
        joined = list(merged)
        plain = 2 * len(strings)
        pool = [self.unit(joined[k - plain] if k >= plain else (" " + strings[k >> 1] if k & 1 else strings[k >> 1])) for k in used.tolist()]
        length = np.fromiter(map(len, pool), np.int64, len(pool))
        at = place[key]
        out_before = np.zeros(len(at) + 1, np.int64)
        np.cumsum(length[at], out=out_before[1:])
        row_of_group = np.searchsorted(start, bounds)
        if lengths_only:
            return None, out_before[row_of_group]
        flat = np.concatenate(pool) if pool else np.empty(0, np.int32)
        pool_before = np.zeros(len(pool) + 1, np.int64)
        np.cumsum(length, out=pool_before[1:])
        source = np.repeat(pool_before[:-1][at] - out_before[:-1], length[at]) + np.arange(out_before[-1])
        return flat[source].astype(np.int32, copy=False), out_before[row_of_group]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a, b as they are when they stand side by side."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= KEPT_UNITS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.bpe._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two parts of one unsplit piece.

        The window around the join grows until its first token fits the token before it and its last the token after it;
        a sequence of tokens is the encoding of its bytes exactly if all its neighbours fit.
        """
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        w = 2
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            window = self.bpe._encode_single_piece(b"".join(self.bytes_of[x] for x in left[a:] + right[:b]))
            agree_left = a == 0 or self.fits(left[a - 1], window[0])
            agree_right = b == len(right) or self.fits(window[-1], right[b])
            if agree_left and agree_right:
                return left[:a] + window + right[b:]
            w *= 2

    def _cut_ids(self, ids: list[int], n_bytes: int, from_end: bool) -> int:
        """The index at which the last (first) ``n_bytes`` bytes of ids begin (end); they end with a token."""
        at, step = (len(ids), -1) if from_end else (0, 1)
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[at - 1 if from_end else at]])
            at += step
        assert n_bytes == 0
        return at

    def join(self, left: tuple[str, list[int]], right: tuple[str, list[int]], safe: bool) -> tuple[str, list[int]]:
        """Concatenate two encoded texts; at a join that is not safe the pattern runs again over a window around it."""
        (a, x), (b, y) = left, right
        if safe or not a or not b:
            return a + b, x + y
        # All pieces of the left text but the last two stay (the last ones may become a contraction, or grow).
        w = 64
        while True:
            spans = [m.span() for m in self.pattern.finditer(a, max(0, len(a) - w))]
            if w >= len(a) or len(spans) > 4 and (m := _SAFE.search(a, len(a) - w)):
                lo = 0 if w >= len(a) else m.end()
                spans = [m.span() for m in self.pattern.finditer(a, lo)]
                if lo == 0 or len(spans) > 2:
                    break
            w *= 2
        keep = spans[-2][0] if len(spans) > 1 else spans[0][0]
        # From there on, until the pieces of the joined text meet an end of a piece of the right text.
        w = 64
        while True:
            take = min(w, len(b))
            tail = a[keep:] + b[:take]
            ends = [m.end() - (len(a) - keep) for m in self.pattern.finditer(tail)]
            own = {m.end() for m in self.pattern.finditer(b[:take])}
            usable = ends if take == len(b) else ends[:-2]
            meet = next((e for e in usable if e > 0 and e in own and (take == len(b) or e <= sorted(own)[-3:][0])), None)
            if meet is not None:
                break
            w *= 2
        i = self._cut_ids(x, len(a[keep:].encode()), True)
        j = self._cut_ids(y, len(b[:meet].encode()), False)
        middle, at = [], keep
        for e in ends:
            if e > meet:
                break
            end = e + len(a)
            if at < len(a) < end and (at, len(a)) == spans[-1] and e in own and min(own) == e:
                last = self._cut_ids(x, len(a[at:].encode()), True)
                middle += self.join_piece(x[last:], y[:j] if e == meet else y[: self._cut_ids(y, len(b[:e].encode()), False)])
            else:
                middle += self.bpe._encode_single_piece((a[at:] + b[:e] if end > len(a) else a[at:end]) if at < len(a) else b[at - len(a) : e])
            at = end
        return a + b, x[:i] + middle + y[j:]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once per process."""
    return Encoder(path)


def chunks(text: str, size: int = CHUNK) -> list[tuple[str, bool]]:
    """``(chunk, safe)`` of a long text; safe: it begins where cutting changes no token.

    Cuts are made at the last safe place of each stretch of ``size`` characters; a stretch without one is cut
    in halves until no half is longer than ``size``.
    """
    out, at, safe = [], 0, True

    def halves(lo: int, hi: int, first: bool) -> None:
        if hi - lo <= size:
            out.append((text[lo:hi], first))
        else:
            middle = (lo + hi) // 2
            halves(lo, middle, first)
            halves(middle, hi, False)

    while at < len(text):
        end = len(text)
        if end - at > size:
            place = None
            for m in _SAFE.finditer(text, at, at + size + 1):
                place = m.end()
            if place is None and (m := _SAFE.search(text, at + size - 1)):
                place = m.end()
            end = place or len(text)
        halves(at, end, safe)
        at, safe = end, True
    return out


def concatenated(parts: list[tuple[str, list[int], bool]], e: Encoder) -> list[int]:
    """Ids of a text from its encoded chunks ``(chunk, ids, safe)``, joined as a balanced tree."""
    level = [((text, ids), safe) for text, ids, safe in parts]
    while len(level) > 1:
        paired = []
        for i in range(0, len(level), 2):
            if i + 1 < len(level):
                paired.append((e.join(level[i][0], level[i + 1][0], level[i + 1][1]), level[i][1]))
            else:
                paired.append(level[i])
        level = paired
    return level[0][0][1] if level else []


def _steps(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most STEP bytes of text, or one row."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.append(0, np.cumsum(sizes))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(before, before[at] + STEP, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _id_lists(ids: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))


def with_ids(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/{VOCABULARY}", long_text: int = LONG_TEXT, chunk: int = CHUNK) -> DataFrame:
    """``(key, ids)``: the ids of every row's text without special tokens.

    Defined results: null and empty texts have an empty list; strings of special tokens are ordinary text; every row
    gives one row, repeated rows and null keys too; texts are encoded whole; an empty table gives none; further columns
    are ignored. Only texts longer than ``long_text`` characters are shuffled (as chunks); one row's ids are put
    together in one task.
    """
    ship_code(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    length = F.coalesce(F.length("text"), F.lit(0))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for part in _steps(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("key"), _id_lists(*e.encode(part.column("text")))], names=["key", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, k, t in zip(*(batch.column(c).to_pylist() for c in ("row", "key", "text")), strict=True):
                parts = chunks(t, chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(parts)), pa.array([k] * len(parts), batch.column("key").type), pa.array(range(len(parts)), pa.int32()), pa.array([p for p, _ in parts]), pa.array([s for _, s in parts])],
                    names=["row", "key", "no", "text", "safe"],
                )

    def encode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for part in _steps(batch, "text"):
                ids = _id_lists(*e.encode(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, "ids"])

    def assemble(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("no")
        triples = [(t, i.tolist(), bool(s)) for t, i, s in zip(parts["text"], parts["ids"], parts["safe"], strict=True)]
        return pd.DataFrame({"key": parts["key"].iloc[:1], "ids": [concatenated(triples, encoder(path))]})

    short = rows.where(length <= long_text).mapInArrow(encode, f"key {kind}, ids array<int>")
    cut = rows.where(length > long_text).select(F.monotonically_increasing_id().alias("row"), "key", "text")
    pieces = cut.mapInArrow(split, f"row bigint, key {kind}, no int, text string, safe boolean").repartition("row", "no")
    coded = pieces.mapInArrow(encode_chunks, f"row bigint, key {kind}, no int, text string, safe boolean, ids array<int>")
    long = coded.groupBy("row").applyInPandas(assemble, f"key {kind}, ids array<int>")
    return short.unionByName(long).withColumnRenamed("key", key)


def token_counts(path: str = f"{TOKENIZERS}/{VOCABULARY}"):
    """A column function: the number of ids of a text (0 for null and empty)."""

    def count(texts: pa.Array) -> pa.Array:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        e, out = encoder(path), []
        for part in _steps(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            out.append(np.diff(e.encode(part.column("text"), lengths_only=True)[1]))
        return pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64())

    return F.arrow_udf(count, "bigint")
