"""Distributions, information measures and evaluation scores (A03-A07, A28, E01-E12 of the blueprint)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborloom.session import ship_code


def plog(p: Column, log=F.log2) -> Column:
    """p log p with 0 log 0 = 0."""
    return F.when(p > 0, p * log(p)).otherwise(F.lit(0.0))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Share of every id from 0 to the largest; ids not seen have 0."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("bigint").alias("id")).agg(F.count("*").alias("cnt"))
    most, total = counts.agg(F.max("id"), F.sum("cnt")).first()
    ids = df.sparkSession.range(0, (most if most is not None else -1) + 1)
    return ids.join(counts, "id", "left").select("id", (F.coalesce("cnt", F.lit(0)) / F.lit(total or 1)).alias("p"))


def joint(df: DataFrame, x: str, y: str) -> DataFrame:
    """Counts of pairs; pairs with a null are left out."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("cnt"))


def _entropy(counts: DataFrame, name: str, total: Column) -> DataFrame:
    return counts.agg((-F.sum(plog(F.col("cnt") / total))).alias(name))


def information(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: total, the entropies (bits) of x, y and their pairs, and their mutual information.

    One pass over the data gives the pair counts; everything else is derived from those few rows.
    """
    pairs = joint(df, x, y)
    xs = pairs.groupBy("x").agg(F.sum("cnt").alias("cnt"))
    ys = pairs.groupBy("y").agg(F.sum("cnt").alias("cnt"))
    # H = log2 N - (1/N) sum c log2 c: sums that need no total first.
    part = lambda d, n: d.agg(F.sum("cnt").alias(f"n_{n}"), F.sum(F.col("cnt") * F.log2("cnt")).alias(f"s_{n}"))
    one = part(pairs, "xy").crossJoin(part(xs, "x")).crossJoin(part(ys, "y"))  # three one-row tables
    h = lambda n: F.log2(F.col("n_xy")) - F.col(f"s_{n}") / F.col("n_xy")
    return one.where("n_xy > 0").select(F.col("n_xy").alias("n"), h("x").alias("h_x"), h("y").alias("h_y"), h("xy").alias("h_xy")).withColumn("mi", F.col("h_x") + F.col("h_y") - F.col("h_xy"))


def v_measure(info: DataFrame, beta: float = 1.0) -> DataFrame:
    """Homogeneity, completeness, V and variation of information of gold x and system y.

    A side with one class has no entropy: V is null then.
    """
    h = 1 - F.try_divide(F.col("h_xy") - F.col("h_y"), F.nullif(F.round("h_x", 12), F.lit(0.0)))
    c = 1 - F.try_divide(F.col("h_xy") - F.col("h_x"), F.nullif(F.round("h_y", 12), F.lit(0.0)))
    return info.withColumn("h", h).withColumn("c", c).select(
        F.round("h", 6).alias("homogeneity"),
        F.round("c", 6).alias("completeness"),
        F.round(F.try_divide((1 + beta) * F.col("h") * F.col("c"), beta * F.col("h") + F.col("c")), 6).alias("v"),
        F.round(F.col("h_x") + F.col("h_y") - 2 * F.col("mi"), 6).alias("vi"),
    )


def conditional_log_sums(df: DataFrame, condition: str, outcome: str) -> DataFrame:
    """Sum of p ln p of the outcomes of each condition (the sign is not turned)."""
    counts = joint(df, condition, outcome)
    totals = counts.groupBy("x").agg(F.sum("cnt").alias("total"))
    return counts.join(totals, "x").groupBy("x").agg(F.sum(plog(F.col("cnt") / F.col("total"), F.ln)).alias("sum_plogp"))


def symmetric_divergence(df: DataFrame, side: str, a: str, b: str, outcome: str) -> DataFrame:
    """mean of KL(a, b) and KL(b, a) in nats over outcomes that both sides have."""
    counts = df.where(F.col(outcome).isNotNull() & F.col(side).isin(a, b)).groupBy(outcome).agg(
        F.sum((F.col(side) == a).cast("bigint")).alias("ca"), F.sum((F.col(side) == b).cast("bigint")).alias("cb")
    )
    both = counts.where("ca > 0 and cb > 0")
    totals = both.agg(F.sum("ca").alias("ta"), F.sum("cb").alias("tb"))
    p, q = F.col("ca") / F.col("ta"), F.col("cb") / F.col("tb")
    return both.join(F.broadcast(totals)).agg(((F.sum(p * F.ln(p / q)) + F.sum(q * F.ln(q / p))) / 2).alias("divergence"))


def span_matches(system: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Per span key, the counts of both sides and how many match (least of the two)."""
    s = system.groupBy(*keys).agg(F.count("*").alias("n_sys"))
    g = gold.groupBy(*keys).agg(F.count("*").alias("n_gold"))
    both = s.join(g, keys, "full").fillna(0, ["n_sys", "n_gold"])
    return both.withColumn("n_match", F.least("n_sys", "n_gold"))


def bracket_scores(matches: DataFrame, *by: str) -> DataFrame:
    """Precision, recall and F1 over matched spans."""
    sums = matches.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n_sys", "n_gold", "n_match")))
    p, r = F.try_divide(F.col("n_match"), F.col("n_sys")), F.try_divide(F.col("n_match"), F.col("n_gold"))
    return sums.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn(
        "f1", F.round(F.coalesce(F.try_divide(2 * F.col("n_match"), F.col("n_sys") + F.col("n_gold")), F.lit(0.0)), 6)
    )


def scored_spans(nodes: DataFrame, spans: DataFrame, cutoff: int = 0, deleted: tuple[str, ...] = ()) -> DataFrame:
    """The spans that a scorer looks at: of trees with at most ``cutoff`` words (0: of any), labels in ``deleted`` left out.

    Words under a deleted label do not count for the length.
    """
    size = nodes.where(F.col("word").isNotNull() & ~F.col("label").isin(*deleted)).groupBy("tree_id").agg(F.count("*").alias("_n"))
    kept = spans.where(~F.col("label").isin(*deleted)) if deleted else spans
    return kept.join(size.where(F.col("_n") <= cutoff), "tree_id", "left_semi") if cutoff else kept


def within_errors(system: DataFrame, gold: DataFrame, most: int = 10) -> DataFrame:
    """Trees ``(tree_id)`` whose system and gold leaves ``(tree_id, leaf_ix, word)`` differ in number or words; more than ``most`` of them is an error."""
    s, g = system.select("tree_id", "leaf_ix", F.col("word").alias("s")), gold.select("tree_id", "leaf_ix", F.col("word").alias("g"))
    bad = s.join(g, ["tree_id", "leaf_ix"], "full").where(~F.col("s").eqNullSafe(F.col("g"))).select("tree_id").distinct()
    if bad.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} trees whose leaves differ")
    return bad


def phrase_recall(system: DataFrame, gold: DataFrame) -> DataFrame:
    """For each gold phrase type, gold spans that the system has under any label."""
    s = system.groupBy("tree_id", "span").agg(F.count("*").alias("n_s"))
    g = gold.groupBy("tree_id", "span", F.col("label").alias("phrase")).agg(F.count("*").alias("n_g"))
    sums = g.join(s, ["tree_id", "span"], "left").groupBy("phrase").agg(F.sum("n_g").alias("n_gold"), F.sum(F.least("n_g", F.coalesce("n_s", F.lit(0)))).alias("n_match"))
    return sums.withColumn("recall", F.round(F.col("n_match") / F.col("n_gold"), 6))


def label_scores(system: DataFrame, gold: DataFrame) -> DataFrame:
    """Each system label against each gold phrase type; spans ``(tree_id, label, span)`` match by tree and span."""
    s = system.groupBy("tree_id", "span", F.col("label")).agg(F.count("*").alias("n_s"))
    g = gold.groupBy("tree_id", "span", F.col("label").alias("phrase")).agg(F.count("*").alias("n_g"))
    hit = s.join(g, ["tree_id", "span"]).groupBy("label", "phrase").agg(F.sum(F.least("n_s", "n_g")).alias("n_match"))
    of_s = s.groupBy("label").agg(F.sum("n_s").alias("n_sys"))
    of_g = g.groupBy("phrase").agg(F.sum("n_g").alias("n_gold"))
    p, r = F.col("n_match") / F.col("n_sys"), F.col("n_match") / F.col("n_gold")
    return hit.join(of_s, "label").join(of_g, "phrase").withColumn("f1", F.round(2 * p * r / (p + r), 6))


def best_labels(scores: DataFrame) -> DataFrame:
    """The label of best F1 for each phrase type; ties by label."""
    best = F.max_by(F.struct("label", "f1"), F.struct(F.col("f1"), F.col("label"))).alias("b")
    return scores.groupBy("phrase").agg(best).select("phrase", "b.label", "b.f1")


def ranked_labels(scores: DataFrame) -> DataFrame:
    """Labels of each phrase type by F1, the best first; a table of labels times phrase types."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("phrase").orderBy(F.desc("f1"), "label")))


def throughput(tokens: int, seconds: float, target: int) -> tuple[float, float]:
    """Seconds a token, and the hours that ``target`` tokens would take."""
    each = seconds / tokens if tokens else 0.0
    return each, each * target / 3600


def greedy_labels(scores: DataFrame) -> DataFrame:
    """Labels added to a phrase type in the order of best F1 while the joint F1 grows.

    Works on the label table alone (labels x phrases), one phrase a group.
    """
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        gold = rows["n_gold"].iloc[0]
        left = rows.sort_values(["f1", "label"], ascending=[False, True])
        chosen, match, system, best = [], 0, 0, 0.0
        while len(left):
            m, s = match + left["n_match"], system + left["n_sys"]
            f = 2 * m / (s + gold)
            i = f.idxmax()
            if f[i] <= best:
                break
            best, match, system = float(f[i]), int(m[i]), int(s[i])
            chosen.append(left.at[i, "label"])
            left = left.drop(i)
        return pd.DataFrame({"phrase": [rows["phrase"].iloc[0]], "labels": [",".join(sorted(chosen))], "f1": [round(best, 6)]})

    return scores.groupBy("phrase").applyInPandas(pick, "phrase string, labels string, f1 double")


#: The prime of the coins: products of two numbers below it stay within 64 bits, in numpy and in SQL.
PRIME = 2**31 - 1


def coins(keys: np.ndarray, n: int) -> np.ndarray:
    """Coins of permutations 1 .. n for each key: a quadratic congruence, the same whatever the order of rows."""
    x = (keys[:, None] % PRIME * 48271 + np.arange(1, n + 1) * 69621 + 1) % PRIME
    return ((x * x % PRIME * 16807 + x) % PRIME % 2).astype(bool)


def permutation_sums(pairs: DataFrame, n: int) -> DataFrame:
    """``(i, ma, sa, mb, sb, g)``: the sums of both systems under each permutation, 0 being as observed; summed in each task, n + 1 rows a task."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((n + 1, 5), np.int64)
        for batch in batches:
            key, ma, sa, mb, sb, g = (c.to_numpy().astype(np.int64) for c in batch.columns)
            for a in range(0, len(key), 4096):  # bounds the coins held at once
                s = slice(a, a + 4096)
                swap = np.concatenate([np.zeros((len(key[s]), 1), bool), coins(key[s], n)], axis=1).astype(np.int64).T
                m, c = swap @ (mb[s] - ma[s]), swap @ (sb[s] - sa[s])
                held += np.stack([ma[s].sum() + m, sa[s].sum() + c, mb[s].sum() - m, sb[s].sum() - c, np.full(n + 1, g[s].sum())], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), *(pa.array(held[:, k]) for k in range(5))], names=["i", "ma", "sa", "mb", "sb", "g"])

    schema = "i bigint, ma bigint, sa bigint, mb bigint, sb bigint, g bigint"
    cells = pairs.select(*(F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("tree_id", "m_a", "s_a", "m_b", "s_b", "g")))
    ship_code(pairs.sparkSession)
    return cells.mapInArrow(f, schema).groupBy("i").agg(*(F.sum(c).alias(c) for c in ("ma", "sa", "mb", "sb", "g")))


def permutation_gaps(pairs: DataFrame, n: int) -> DataFrame:
    """``(i, gap)``: the absolute gap of the F scores of both systems under each permutation."""
    f = lambda m, s: 2 * F.col(m) / F.nullif(F.col(s) + F.col("g"), F.lit(0))
    return permutation_sums(pairs, n).select("i", F.abs(f("ma", "sa") - f("mb", "sb")).alias("gap"))


def permutation_test(pairs: DataFrame, n: int) -> DataFrame:
    """``pairs(tree_id, m_a, s_a, m_b, s_b, g)`` of matched, system and gold span counts of two systems; each permutation swaps the systems of a tree by a coin."""
    gaps = permutation_gaps(pairs, n)
    seen = gaps.where("i = 0").select(F.col("gap").alias("observed"))
    larger = F.sum((F.col("gap") > F.col("observed") + 1e-12).cast("int"))
    return gaps.where("i > 0").join(F.broadcast(seen)).agg(
        F.round(F.first("observed"), 6).alias("observed"), F.round((1 + larger) / (1 + F.count("*")), 6).alias("p_value"), F.round((1 + larger) / F.count("*"), 6).alias("p_compatible")
    )


def running_p_values(pairs: DataFrame, n: int) -> DataFrame:
    """``(i, p_value)`` after each permutation; a table of n rows, whatever the number of trees."""
    gaps = permutation_gaps(pairs, n)
    seen = gaps.where("i = 0").select(F.col("gap").alias("observed"))
    larger = F.sum((F.col("gap") > F.col("observed") + 1e-12).cast("int")).over(W.orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return gaps.where("i > 0").join(F.broadcast(seen)).select("i", F.round((1 + larger) / (1 + F.col("i")), 6).alias("p_value"))


def held_out_recall(system: DataFrame, gold: DataFrame, first: int) -> DataFrame:
    """Labels are chosen on trees below ``first`` and scored on the others: ``(phrase, labels, f1, n_match, n_gold, recall)``."""
    dev, test = F.col("tree_id") < first, F.col("tree_id") >= first
    chosen = greedy_labels(label_scores(system.where(dev), gold.where(dev)))
    pairs = chosen.select("phrase", F.explode(F.split("labels", ",")).alias("label"))
    scores = label_scores(system.where(test), gold.where(test)).join(pairs, ["phrase", "label"])
    sums = scores.groupBy("phrase").agg(F.sum("n_match").alias("n_match"), F.max("n_gold").alias("n_gold"))
    return chosen.join(sums, "phrase", "left").fillna(0, ["n_match", "n_gold"]).withColumn("recall", F.round(F.try_divide(F.col("n_match"), F.col("n_gold")), 6))


def posterior_components(chain: DataFrame, rules: list[str], k: int = 4) -> DataFrame:
    """Principal components of the rule probabilities of each iteration; ``chain(iter, rule, p)``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    wide = chain.groupBy("iter").pivot("rule", rules).agg(F.first("p")).fillna(0.0)
    vectors = wide.select("iter", array_to_vector(F.array(*(F.col(f"`{r}`") for r in rules))).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="c").fit(vectors).transform(vectors).select("iter", vector_to_array("c").alias("components"))


def collected(series: DataFrame, metrics: list[str]) -> DataFrame:
    """One row an iteration, one column a metric, from ``series(run, iter, metric, value)``."""
    return series.groupBy("run", "iter").pivot("metric", metrics).agg(F.first("value"))
