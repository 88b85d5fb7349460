"""Rule tables and depth-bounded component models (A08-A13, A24-A27, M01-M11, M25 of the blueprint).

Rule tables ``(lhs, r1, r2, is_lex, cnt)`` are DataFrames and grow with the corpus; the algebra over categories is dense numpy on the
driver, on tables of at most MOST_CATEGORIES ** 3 entries.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborloom.functions.scalars import gammas

#: Categories of a grammar whose algebra runs densely.
MOST_CATEGORIES = 200
STEPS = 50


def branching_rules(toks: DataFrame, categories: int = 5) -> DataFrame:
    """A08 over right-branching trees: ``(lhs, r1, r2, is_lex, cnt)``.

    A word's category is 1 + its length modulo ``categories``; the node over words i..n has the category of word i, so every word
    gives a lexical rule and every word but the last a binary one; a tree gives two rules of category 0 (ROOT).
    """
    cat = (1 + F.length("tok") % categories).cast("int")
    w = W.partitionBy("sent_id").orderBy("pos")
    rows = toks.withColumn("c", cat).withColumn("nxt", F.lead(cat).over(w))
    # One pass: each word is exploded into its rules, so the windowed rows are read once.
    rule = lambda lhs, r1, r2, lex: F.struct(lhs.alias("lhs"), r1.cast("string").alias("r1"), r2.cast("string").alias("r2"), F.lit(lex).alias("is_lex"))
    lexical = rule(F.col("c"), F.col("tok"), F.lit(None), True)
    binary = F.when(F.col("nxt").isNotNull(), rule(F.col("c"), F.col("c"), F.col("nxt"), False))
    top = F.when(F.col("pos") == 0, rule(F.lit(0), F.col("c"), F.lit(0), False))
    end = F.when(F.col("pos") == 0, rule(F.lit(0), F.lit("-ROOT-"), F.lit(None), True))
    found = rows.select(F.explode(F.array(lexical, binary, top, end)).alias("x")).where("x is not null").select("x.*")
    return found.groupBy("lhs", "r1", "r2", "is_lex").agg(F.count("*").alias("cnt"))


def conditional(rules: DataFrame, lhs: str = "lhs", cnt: str = "cnt") -> DataFrame:
    """Count over the total of the left side. Totals come from partial sums, so a frequent left side is no hot window."""
    totals = rules.groupBy(lhs).agg(F.sum(cnt).alias("_total"))
    # Left sides may be words: whether their totals are broadcast is left to the sizes adaptive execution sees.
    return rules.join(totals, lhs).withColumn("p", F.col(cnt) / F.col("_total")).drop("_total")


def marginal(rules: DataFrame, cnt: str = "cnt") -> DataFrame:
    """Count over the total of all."""
    total = rules.agg(F.sum(cnt).alias("_total"))
    return rules.join(F.broadcast(total)).withColumn("p", F.try_divide(F.col(cnt), F.col("_total"))).drop("_total")


def log_likelihood(rules: DataFrame) -> DataFrame:
    """Sum of count times log10 p over rules that are not ROOT's."""
    return conditional(rules).where("lhs <> 0").agg(F.sum(F.col("cnt") * F.log10("p")).alias("loglik"))


def parent_totals(rules: DataFrame) -> DataFrame:
    """All and lexical counts of each category and its lexical mass."""
    sums = rules.groupBy("lhs").agg(F.sum("cnt").alias("total"), F.sum(F.when(F.col("is_lex"), F.col("cnt")).otherwise(0)).alias("lexical"))
    return sums.withColumn("lexical_mass", F.round(F.col("lexical") / F.col("total"), 6))


def head_model(rules: DataFrame) -> DataFrame:
    """For parent and child: the sum of p / number of children over the sum of p of the parent."""
    p = conditional(rules).where(~F.col("is_lex"))
    parts = p.select("lhs", "p", F.explode(F.array("r1", "r2")).alias("child")).groupBy("lhs", "child").agg(F.sum(F.col("p") / 2).alias("w"))
    whole = p.groupBy("lhs").agg(F.sum("p").alias("t"))
    return parts.join(whole, "lhs").select("lhs", "child", (F.col("w") / F.col("t")).alias("p"))


def head_model_of(rules: DataFrame) -> DataFrame:
    """A12 for rules ``(lhs, rhs, cnt)`` of any arity: each child has its share p / number of children of the rule, over the rules of the parent."""
    p = conditional(rules).select("lhs", "p", F.size("rhs").alias("n"), F.explode("rhs").alias("child"))
    return p.groupBy("lhs", "child").agg(F.sum(F.col("p") / F.col("n")).alias("p"))


def starving(rules: DataFrame) -> DataFrame:
    """The category of least count if that is under 0.5 % of the average (over n - 1), with the largest as donor."""
    per = rules.where("lhs <> 0").groupBy("lhs").agg(F.sum("cnt").alias("c"))
    return per.agg(
        F.min_by("lhs", F.struct("c", "lhs")).alias("category"),
        F.max_by("lhs", F.struct("c", "lhs")).alias("donor"),
        (F.min("c") < 0.005 * F.sum("c") / F.nullif(F.count("*") - 1, F.lit(0))).alias("starves"),
    )


def rule_enumeration(spark: SparkSession, categories: int, words: int) -> DataFrame:
    """``(lhs, r1, r2, is_lex, ix)``: ROOT's (c, 0) then its sentinel; others all pairs row by row, then the words."""
    n = categories
    c = spark.range(1, n + 1).withColumnRenamed("id", "r1")
    top = c.select(F.lit(0).cast("bigint").alias("lhs"), F.col("r1").cast("string").alias("r1"), F.lit("0").alias("r2"), F.lit(False).alias("is_lex"), (F.col("r1") - 1).alias("ix"))
    end = spark.range(1).select(F.lit(0).cast("bigint").alias("lhs"), F.lit("-ROOT-").alias("r1"), F.lit(None).cast("string").alias("r2"), F.lit(True).alias("is_lex"), F.lit(n).cast("bigint").alias("ix"))
    per = n * n + words
    rest = spark.range(n * per).select((F.expr(f"id div {per}") + 1).alias("lhs"), (F.col("id") % per).alias("ix"))
    pair = F.col("ix") < n * n
    rest = rest.select(
        "lhs",
        F.when(pair, F.expr(f"ix div {n}") + 1).otherwise(F.col("ix") - n * n + 1).cast("string").alias("r1"),
        F.when(pair, F.col("ix") % n + 1).cast("string").alias("r2"),
        (~pair).alias("is_lex"),
        "ix",
    )
    return top.unionByName(end).unionByName(rest)


def with_prior(keys: DataFrame, rules: DataFrame, alpha: float | Column) -> DataFrame:
    """Prior plus observed counts; ROOT's prior is 1. ``alpha`` is a number or an expression over the rule's columns."""
    on = (keys.lhs == rules.lhs) & (keys.r1 == rules.r1) & keys.r2.eqNullSafe(rules.r2) & (keys.is_lex == rules.is_lex)
    seen = keys.join(rules, on, "left").select(keys.lhs, keys.r1, keys.r2, keys.is_lex, F.coalesce(rules.cnt, F.lit(0)).alias("cnt"))
    prior = F.when(F.col("lhs") == 0, F.lit(1.0)).otherwise(alpha if isinstance(alpha, Column) else F.lit(alpha))
    return seen.select("lhs", "r1", "r2", "is_lex", (prior + F.col("cnt")).alias("post"))


def dirichlet_draw(posterior: DataFrame, seed: int, iteration: int, coefficient: float = 1.0, prior: str | None = None) -> DataFrame:
    """Probabilities of each left side drawn from its Dirichlet posterior.

    The draws are gamma variates keyed by (seed, iteration, rule), made over whole Arrow batches, so a left side with many rules
    is never one group; they are normalised with partial sums. ``coefficient`` scales what exceeds the ``prior`` column (annealing).
    """
    shape = F.col("post") if prior is None else F.when(F.col("lhs") == 0, F.col("post")).otherwise((F.col("post") - F.col(prior)) * coefficient + F.col(prior))

    def gamma(keys: pa.Array, shapes: pa.Array) -> pa.Array:
        # A draw of a small shape is kept above 0.
        return pa.array(np.maximum(gammas(keys.to_numpy(), shapes.to_numpy()), 1e-300))

    key = F.xxhash64(F.lit(seed), F.lit(iteration), "lhs", "r1", F.coalesce("r2", F.lit("")))
    drawn = posterior.withColumn("cnt", F.arrow_udf(gamma, "double")(key, shape.cast("double")))
    return conditional(drawn).drop("cnt", "post")


class Components(NamedTuple):
    """Component models by depth; axes as named: F[d, b, f], J[d, l, x, j], A[d, x, l, a], B0 and B1[d, a, l, r], pos[b, g]."""

    f: np.ndarray
    j: np.ndarray
    a: np.ndarray
    b0: np.ndarray
    b1: np.ndarray
    pos: np.ndarray


def dense(rules: DataFrame, categories: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary rule probabilities P[a, l, r] and lexical mass of each category, category 0 being ROOT."""
    if categories > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    p, mass = np.zeros((categories + 1,) * 3), np.zeros(categories + 1)
    for r in rules.where(~F.col("is_lex")).select("lhs", F.col("r1").cast("int").alias("l"), F.col("r2").cast("int").alias("r"), "p").collect():
        p[r.lhs, r.l, r.r] += r.p
    for r in rules.where("is_lex").groupBy("lhs").agg(F.sum("p").alias("p")).collect():
        mass[r.lhs] = r.p
    return p, mass


def delta(p: np.ndarray, mass: np.ndarray, depth: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Probability that a category at a depth, as a left (A) or right (B) child, yields a finished tree within the bound."""
    a = np.tile(mass, (depth, 1))
    b = a.copy()
    for _ in range(steps - 2):
        na = mass + np.einsum("xlr,dl,dr->dx", p, a, b)
        nb = np.tile(mass, (depth, 1))
        nb[:-1] += np.einsum("xlr,dl,dr->dx", p, a[1:], b[:-1])
        a, b = na, nb
    return a, b


def gamma(p: np.ndarray, da: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rule probabilities given that the tree stays within the bound; 0 / 0 is 0."""
    ga = np.einsum("xlr,dl,dr->dxlr", p, da, db)
    gb = np.zeros_like(ga)
    gb[:-1] = np.einsum("xlr,dl,dr->dxlr", p, da[1:], db[:-1])
    safe = lambda n, d: np.divide(n, d[:, :, None, None], out=np.zeros_like(n), where=d[:, :, None, None] > 0)
    return safe(ga, da), safe(gb, db)


def left_descendants(ga: np.ndarray, gb: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Expected left descendants E[d, b, a] of an awaited category."""
    step, e = ga.sum(axis=3), gb.sum(axis=3)
    total = e.copy()
    for _ in range(steps - 1):
        e = e @ step
        total += e
    return total


def _normal(x: np.ndarray) -> np.ndarray:
    return x / (x.sum(axis=-1, keepdims=True) + 1e-20)


def components(p: np.ndarray, mass: np.ndarray, depth: int, steps: int = STEPS) -> Components:
    """The component models of a grammar with category tables widened by one spare category.

    Computed for one level more than asked for and cut back to ``depth``.
    """
    da, db = delta(p, mass, depth + 1, steps)
    ga, gb = gamma(p, da, db)
    e = left_descendants(ga, gb, steps)
    wide = lambda x, axes: np.pad(x, [(0, int(i in axes)) for i in range(x.ndim)])
    f = np.stack([np.tile(mass, (depth + 1, 1)), e @ mass], axis=2)
    f[0, 0, 0] = 0
    left = ga.sum(axis=3)
    j = np.stack([np.einsum("dal,dxa->dlx", left, e), np.einsum("dalr->dla", gb)], axis=3)
    a = np.einsum("dxa,dal->dxla", e, left)
    pos = (e * mass).sum(axis=0)
    cut = slice(0, depth)
    return Components(
        _normal(wide(f, {1}))[cut], _normal(wide(j, {1, 2}))[cut], _normal(wide(a, {1, 2, 3}))[cut],
        _normal(wide(ga, {1, 2, 3}))[cut], _normal(wide(gb, {1, 2, 3}))[cut], _normal(wide(pos, {0, 1})),
    )


def component_table(spark: SparkSession, c: Components) -> DataFrame:
    """Long form ``(model, depth, c1, c2, out, p)`` of the models' entries that are not 0; c2 is -1 where a model has one condition."""
    rows = []
    for name, x in zip(("F", "J", "A", "B_J0", "B_J1"), c[:5], strict=True):
        for at in np.argwhere(x > 0).tolist():
            v = float(x[tuple(at)])
            rows.append((name, at[0], at[1], at[2] if x.ndim == 4 else -1, at[-1], v))
    rows += [("pos", -1, b, -1, g, float(c.pos[b, g])) for b, g in np.argwhere(c.pos > 0).tolist()]
    return spark.createDataFrame(rows, "model string, depth int, c1 int, c2 int, out int, p double")


def as_condition_table(table: DataFrame, spare: int) -> DataFrame:
    """``(id, cond, out, p)``: the component models in the parser's naming; the spare category is "-", category 0 is "T"."""
    name = lambda c: F.when(F.col(c) == 0, F.lit("T")).when(F.col(c) == spare, F.lit("-")).otherwise(F.col(c).cast("string"))
    ids = F.when(F.col("model").startswith("B"), F.lit("B")).when(F.col("model") == "pos", F.lit("P")).otherwise(F.col("model"))
    cond = F.filter(F.array(F.when(F.col("depth") >= 0, (F.col("depth") + 1).cast("string")), name("c1"), F.when(F.col("c2") >= 0, name("c2"))), lambda x: x.isNotNull())
    out = F.when(F.col("model").isin("F", "J"), F.col("out").cast("string")).otherwise(name("out"))
    return table.select(ids.alias("id"), cond.alias("cond"), out.alias("out"), "p")
