"""Conditional tables ``(id, cond, out, p)`` and count tables, and series of iterations (F10, F11, F16, F17, T05, T09, W08, A17, A18, A22 of the blueprint)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entries(table: DataFrame, cond: str = "cond") -> DataFrame:
    """one row: conditions and entries of a conditional table."""
    return table.agg(F.countDistinct(cond).alias("n_conditions"), F.count("*").alias("n_entries"))


def without_conditions(table: DataFrame, part: str, cond: str = "cond") -> DataFrame:
    """the entries whose condition does not contain a text; null conditions stay."""
    return table.where(~F.coalesce(F.contains(F.col(cond), F.lit(part)), F.lit(False)))


def printed(table: DataFrame, name: str, cond: str = "cond", out: str = "out", p: str = "p") -> DataFrame:
    """``(cond, out, p, line)`` of the entries with p over 0: ``name cond : out = p``, without a colon where there is no condition."""
    value = F.col(p).cast("string")
    line = F.when(
        F.coalesce(F.col(cond), F.lit("")) == "", F.concat(F.lit(f"{name} "), F.col(out), F.lit(" = "), value)
    ).otherwise(F.concat(F.lit(f"{name} "), F.col(cond), F.lit(" : "), F.col(out), F.lit(" = "), value))
    return table.where(F.col(p) > 0).select(cond, out, p, line.alias("line"))


def descending(table: DataFrame, cond: str = "cond", out: str = "out", p: str = "p") -> DataFrame:
    """Entries by condition, then probability from the largest, then outcome."""
    return table.orderBy(F.col(cond).asc_nulls_first(), F.desc(p), out)


def looked_up(keys: DataFrame, table: DataFrame, on: list[str], p: str = "p", default: float = 0.0) -> DataFrame:
    """the probability of each key, ``default`` where the table has none."""
    return keys.join(table.select(*on, p), on, "left").withColumn(p, F.coalesce(p, F.lit(default)))


def damped(old: DataFrame, fresh: DataFrame, on: list[str], share: float, p: str = "p") -> DataFrame:
    """F16: (1 - share) * old + share * fresh, an entry that one side lacks being 0 there."""
    a, b = old.select(*on, F.col(p).alias("_old")), fresh.select(*on, F.col(p).alias("_new"))
    both = a.join(b, on, "full").fillna(0.0, ["_old", "_new"])
    return both.select(*on, ((1 - share) * F.col("_old") + share * F.col("_new")).alias(p))


def counted_up(counts: DataFrame, changes: DataFrame, on: list[str], cnt: str = "cnt") -> DataFrame:
    """Counts plus changes, which may be below 0; a count that falls below 0 is an error, one that is 0 goes."""
    both = counts.select(*on, cnt).unionByName(changes.select(*on, cnt)).groupBy(*on).agg(F.sum(cnt).alias(cnt))
    checked = F.when(F.col(cnt) < 0, F.raise_error(F.lit("a negative count")).cast("bigint")).otherwise(F.col(cnt))
    return both.withColumn(cnt, checked).where(F.col(cnt) > 0)


def after_burn_in(series: DataFrame, first: int, last: int | None = None, it: str = "iter") -> DataFrame:
    """Iterations from ``first`` to ``last``, in order of their number."""
    kept = series.where(F.col(it) >= first)
    return (kept if last is None else kept.where(F.col(it) <= last)).orderBy(it)


def _inner(pos: str, size: str, skip_first: int, skip_last: int) -> Column:
    return (F.col(pos) >= skip_first) & (F.col(pos) < F.col(size) - skip_last)


def center_events(steps: DataFrame, *by: str) -> DataFrame:
    """Forks without a join, the first two words and the last one of a sentence left out, by ``by``; ``steps(.., sent_id, pos, n, f, j)``."""
    return steps.groupBy(*by).agg(F.count(F.when((F.col("f") == 1) & (F.col("j") == 0) & _inner("pos", "n", 2, 1), 1)).alias("n_events"))


def branching_odds(steps: DataFrame, *by: str) -> DataFrame:
    """Share of forks without a join after the first word among all steps; left over left and right branching steps."""
    left, right = (F.count(F.when((F.col("f") == v) & (F.col("j") == v), 1)) for v in (0, 1))
    deep = F.count(F.when((F.col("pos") > 0) & (F.col("f") == 1) & (F.col("j") == 0), 1))
    return steps.groupBy(*by).agg((deep / F.count("*")).alias("deep_share"), F.try_divide(left, left + right).alias("left_share"))


def used_states(steps: DataFrame, column: str, most: int) -> DataFrame:
    """Largest and least value of a state column, how many are used, and whether all are in 0 .. ``most``."""
    return steps.agg(
        F.max(column).alias("most"), F.min(column).alias("least"), F.countDistinct(column).alias("n_used"),
        F.coalesce(F.every((F.col(column) >= 0) & (F.col(column) <= most)), F.lit(True)).alias("valid"),
    )


def located(lengths: DataFrame, indexes: DataFrame) -> DataFrame:
    """Sentence and place of running token numbers: ``lengths(sent_id, upto, n)`` with the tokens up to and with each sentence, ``indexes(ix)`` from 0.

    Both sides are cut into blocks of 4,096 numbers and joined by block, so the range join is no cross join.
    """
    block = 4096
    spans = lengths.select("sent_id", (F.col("upto") - F.col("n")).alias("first"), "upto").where("upto > first")
    cells = spans.withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(upto - 1) div {block}"))))
    at = indexes.select("ix", F.expr(f"ix div {block}").alias("block"))
    return at.join(cells, "block").where("ix >= first and ix < upto").select("ix", "sent_id", (F.col("ix") - F.col("first")).alias("pos"))
