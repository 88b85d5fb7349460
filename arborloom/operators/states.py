"""States of a depth-bounded left-corner model and the transitions between them.

A state is (j, a stack, b stack, f, g); its index is mixed radix with g fastest. Only valid stacks are enumerated: the same number of levels
filled in both, no gaps, no spare category. Transitions leave g out of the target (it is factored and multiplied in from the pos model).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborloom.operators.grammar import Components
from arborloom.session import ship_code


def encode(j: Column, a: Column, b: Column, f: Column, g: Column, size: int, depth: int) -> Column:
    """the index of a state; ``size`` categories in each stack slot and in g."""
    stack = lambda s: F.aggregate(s, F.lit(0).cast("bigint"), lambda x, y: x * size + y)
    return (((j * size**depth + stack(a)) * size**depth + stack(b)) * 2 + f) * size + g


def decode(index: Column, size: int, depth: int) -> Column:
    """The state of an index as a struct."""
    n = size**depth
    i = index.cast("bigint")
    part = lambda divisor, modulus: F.pmod(F.floor(i / divisor), F.lit(modulus)).cast("int")
    stack = lambda code: F.transform(F.sequence(F.lit(depth - 1), F.lit(0)), lambda d: F.pmod(F.floor(code / F.pow(F.lit(size), d)), F.lit(size)).cast("int"))
    b, a = F.pmod(F.floor(i / (2 * size)), F.lit(n)), F.pmod(F.floor(i / (2 * size * n)), F.lit(n))
    return F.struct(part(2 * size * n * n, 2).alias("j"), stack(a).alias("a"), stack(b).alias("b"), part(size, 2).alias("f"), part(1, size).alias("g"))


def end_index(size: int, depth: int) -> int:
    """The factored index of the end of a sentence: j = 1 over empty stacks, f = 0."""
    return 2 * size ** (2 * depth)


def state_text(s: Column, order: str = "jabfg") -> Column:
    """Q13: text of a state: ``jabfg``: ``j::ACTa/AWAb;..::f::POSg``; ``fjabg`` with f first; ``whole``: every level, filled or not, and J, F named.

    The first two show the first level and every filled one.
    """
    sign = lambda x: F.when(x == 1, F.lit("+")).otherwise(F.lit("-"))
    pairs = F.zip_with(s["a"], s["b"], lambda a, b: F.struct(a.alias("a"), F.concat(F.lit("ACT"), a.cast("string"), F.lit("/AWA"), b.cast("string")).alias("t")))
    pos = F.concat(F.lit("POS"), s["g"].cast("string"))
    if order == "whole":
        return F.concat_ws("::", F.concat(F.lit("J"), sign(s["j"])), F.array_join(F.transform(pairs, lambda x: x["t"]), "::"), F.concat(F.lit("F"), sign(s["f"])), pos)
    shown = F.array_join(F.transform(F.filter(pairs, lambda x, i: (x["a"] > 0) | (i == 0)), lambda x: x["t"]), ";")
    if order == "fjabg":
        return F.concat_ws("::", sign(s["f"]), sign(s["j"]), shown, pos)
    if order == "jabfg":
        return F.concat_ws("::", sign(s["j"]), shown, sign(s["f"]), pos)
    raise ValueError(f"no such order: {order}")


def tag_sequence(states: Column) -> Column:
    """g of every state of a sample."""
    return F.transform(states, lambda x: x["g"])


def valid_states(spark: SparkSession, size: int, depth: int) -> DataFrame:
    """O3: the indexes of states that can be left: the start and, over every stack of 1 .. depth levels of ordinary categories, all of
    f = 1 and those of f = 0 whose g is the deepest b; with an empty stack only f = 1, j = 0.
    """
    m = size - 2
    frames = [spark.range(1).select(F.lit(0).cast("bigint").alias("state"))]
    empty = F.array_repeat(F.lit(0), depth)
    frames.append(spark.range(1, m + 1).select(encode(F.lit(0), empty, empty, F.lit(1), F.col("id"), size, depth).alias("state")))
    for s in range(1, depth + 1):
        code = spark.range(m ** (2 * s))
        digit = lambda k: (F.pmod(F.floor(F.col("id") / m**k), F.lit(m)) + 1).cast("bigint")
        pad = [F.lit(0).cast("bigint")] * (depth - s)
        stacks = code.select(F.array(*(digit(k) for k in range(s)), *pad).alias("a"), F.array(*(digit(s + k) for k in range(s)), *pad).alias("b"), digit(2 * s - 1).alias("top"))
        free = stacks.select("a", "b", "top", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
        fork = free.select("a", "b", "j", F.lit(1).alias("f"), F.explode(F.sequence(F.lit(1), F.lit(m))).alias("g"))
        hold = free.select("a", "b", "j", F.lit(0).alias("f"), F.col("top").cast("int").alias("g"))
        both = fork.unionByName(hold)
        frames.append(both.select(encode(F.col("j"), F.col("a"), F.col("b"), F.col("f"), F.col("g"), size, depth).alias("state")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class Rows:
    """Transition rows of single states under component models."""

    def __init__(self, c: Components):
        self.c, self.depth, self.size = c, c.f.shape[0], c.pos.shape[0]
        self.place = self.size ** np.arange(self.depth - 1, -1, -1)

    def factored(self, j: int, a: np.ndarray, b: np.ndarray, f: int) -> int:
        n = self.size**self.depth
        return int(((j * n + a @ self.place) * n + b @ self.place) * 2 + f)

    def parts(self, index: int) -> tuple[int, np.ndarray, np.ndarray, int, int]:
        n, s = self.size**self.depth, self.size
        rest, g = divmod(index, s)
        rest, f = divmod(rest, 2)
        rest, b = divmod(rest, n)
        j, a = divmod(rest, n)
        return j, a // self.place % s, b // self.place % s, f, g

    def row(self, index: int) -> tuple[np.ndarray, np.ndarray]:
        """``(targets, probabilities)``; targets without g."""
        c, top = self.c, self.size - 1
        j0, a, b, f0, g = self.parts(index)
        empty = np.zeros(self.depth, np.int64)
        if index == 0:
            return np.array([self.factored(0, empty, empty, 1)]), np.array([1.0])
        s = int((b > 0).sum())
        act, awaited, above = (int(a[s - 1]), int(b[s - 1]), int(b[s - 2]) if s > 1 else 0) if s else (0, 0, 0)
        full = f0 == 1 and s == self.depth
        level = s if f0 == 1 else s - 1  # where the word is attached
        join = np.array([0.0, 1.0]) if full else (c.j[level, g, awaited] if f0 == 1 else c.j[level, act, above])
        targets, probs = [], []
        inner = np.arange(1, top)

        def add(j: int, at: int, acts: np.ndarray, weight: np.ndarray, base: int) -> None:
            """Stacks equal to the old one below level ``at`` and (a, b) there; weight[a, b]; f from the model of level ``base``."""
            na, nb = np.tile(np.where(np.arange(self.depth) < at, a, 0), (len(acts) * len(inner), 1)), np.tile(np.where(np.arange(self.depth) < at, b, 0), (len(acts) * len(inner), 1))
            na[:, at], nb[:, at] = np.repeat(acts, len(inner)), np.tile(inner, len(acts))
            n = self.size**self.depth
            code = ((j * n + na @ self.place) * n + nb @ self.place) * 2
            for f in (0, 1):
                targets.append(code + f)
                probs.append((weight * c.f[base, inner, f]).ravel())

        if join[1] > 0:
            if (f0 == 0 and s == 1) or (f0 == 1 and s == 0):
                targets.append(np.array([end_index(self.size, self.depth)]))
                probs.append(np.array([join[1]]))
            elif f0 == 1:
                add(1, s - 1, np.array([act]), join[1] * c.b1[s - 1, awaited, g, inner][None], s - 1)
            elif s > 1:
                add(1, s - 2, np.array([a[s - 2]]), join[1] * c.b0[s - 2, above, act, inner][None], s - 2)
        if join[0] > 0 and not full:
            if f0 == 0:
                if s:
                    add(0, s - 1, inner, join[0] * c.a[s - 1, above, act, inner][:, None] * c.b0[s - 1][inner, act][:, inner], s - 1)
            else:
                add(0, s, inner, join[0] * c.a[s, awaited, g, inner][:, None] * c.b0[s][inner, g][:, inner], s)
        if not targets:
            return np.empty(0, np.int64), np.empty(0)
        t, p = np.concatenate(targets), np.concatenate(probs)
        return t[p > 0], p[p > 0]


def transitions(spark: SparkSession, c: Components) -> DataFrame:
    """``(prev, nxt, p)``: next states (without g) of every valid state; one narrow pass over the enumerated states."""
    ship_code(spark)
    rows = Rows(c)

    def compile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prev, nxt, p = [], [], []
            for state in batch.column(0).to_pylist():
                t, q = rows.row(state)
                prev.append(np.full(len(t), state))
                nxt.append(t)
                p.append(q)
            join = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
            yield pa.RecordBatch.from_arrays([join(prev, pa.int64()), join(nxt, pa.int64()), join(p, pa.float64())], names=["prev", "nxt", "p"])

    states = valid_states(spark, rows.size, rows.depth)
    return states.mapInArrow(compile_rows, "prev bigint, nxt bigint, p double")


def tag_given_state(c: Components, factored: np.ndarray) -> np.ndarray:
    """p(g | state without g): a word without a fork has the deepest awaited category, one with a fork is drawn from pos."""
    n, s, depth = c.pos.shape[0] ** c.f.shape[0], c.pos.shape[0], c.f.shape[0]
    f, code = factored % 2, factored // 2 % n
    digits = code[:, None] // s ** np.arange(depth - 1, -1, -1) % s
    filled = (digits > 0).sum(axis=1)
    deepest = np.where(filled > 0, digits[np.arange(len(code)), np.maximum(filled - 1, 0)], 0)
    out = c.pos[deepest].copy()
    out[:, s - 1] = 0
    out[f == 0] = np.eye(s)[deepest[f == 0]]
    out[:, 0] = np.where((f == 0) & (deepest == 0), 0, out[:, 0])
    return out
