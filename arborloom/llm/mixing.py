"""Mixing sources to target weights: complete epochs, then an Efraimidis-Spirakis sample for the rest.

Each document gets an exponential key divided by its quality weight; in key order the documents of a source are a weighted
sample without replacement of any size. The token budget of a source is the largest that keeps all target shares
and repeat limits; it is spent on complete epochs of the source first and the remainder on the prefix of the key order
whose tokens add up to it.

Prefix sums need no sort of a whole source: the keys are quantised to BUCKETS ranges, token sums by range give the range in
which the budget ends, that range is quantised again, and only the documents of the small range that is left are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborloom.llm.encoding import TOKENIZERS, VOCABULARY, token_counts
from arborloom.session import ship_code, small_side, written

BUCKETS, LEVELS = 512, 2
#: Weight of a document that no reader has judged; judged ones weigh their mean quality.
NEUTRAL = 3.0
#: Sources a target table may list.
MAX_TARGETS = 10_000


def sized(documents: DataFrame, labels: DataFrame | None, seed: int, path: str) -> DataFrame:
    """``(doc_id, source, n_tokens, key)``, once per doc_id, of documents with tokens and a source."""
    docs = (
        documents.where("doc_id is not null and source is not null and text <> ''")
        .select("doc_id", "source", token_counts(path)("text").alias("n_tokens"))
        .groupBy("doc_id")
        .agg(F.min(F.struct("source", "n_tokens")).alias("d"))
        .select("doc_id", "d.source", "d.n_tokens")
    )
    if labels is None:
        docs = docs.withColumn("weight", F.lit(NEUTRAL))
    else:
        judged = labels.where("doc_id is not null and quality > 0").groupBy("doc_id").agg(F.avg("quality").alias("weight"))
        docs = docs.join(judged, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(NEUTRAL)))
    # 53 bits of the hash, moved off 0 by half a step.
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + 0.5) / F.lit(float(2**53))
    return docs.select("doc_id", "source", "n_tokens", (-F.log(u) / F.col("weight")).alias("key"))


def budgets(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens to take from each source: the largest amounts in the ratio of the weights that the repeat limits allow.

    Sources without tokens or repeats can give nothing; the others keep their ratio. ``total`` lowers the sum.
    """
    able = {s: w for s, (w, r) in targets.items() if w > 0 and r > 0 and available.get(s, 0) > 0}
    weight = sum(able.values())
    if not able:
        return {}
    most = min(available[s] * targets[s][1] * weight / w for s, w in able.items())
    if total is not None:
        most = min(most, total)
    return {s: min(int(most * w / weight + 1e-6), available[s] * targets[s][1]) for s, w in able.items()}


def mix(
    documents: DataFrame,
    targets: DataFrame,
    labels: DataFrame | None = None,
    total: int | None = None,
    seed: int = 7,
    path: str = f"{TOKENIZERS}/{VOCABULARY}",
) -> tuple[DataFrame, DataFrame]:
    """``(chosen, shares)``: ``chosen(doc_id, source, n_tokens, repeats)`` and a report by target source; ``binding`` marks the sources whose
    repeat limit sets the total.

    Defined results: documents with a null id, a null source, a null or empty text or a source without a target are not
    chosen; a doc_id counts once; targets without a source or a positive weight ask for nothing, a null max_repeats
    is 1; of several rows for a source the least counts; a target without documents is reported with 0 tokens; texts
    are measured whole. The document at which a budget ends is taken if that brings the source nearer to its budget.
    """
    spark = documents.sparkSession
    ship_code(spark)
    listed = (
        targets.where("source is not null and weight > 0")
        .select("source", F.col("weight").cast("double"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
        .groupBy("source")
        .agg(F.min(F.struct("weight", "max_repeats")).alias("t"))
        .select("source", "t.weight", "t.max_repeats")
    )
    rows = listed.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    wanted = {r.source: (r.weight, r.max_repeats) for r in rows}
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    docs = written(sized(documents.join(F.broadcast(names), "source", "left_semi"), labels, seed, path), "sized")
    sizes = docs.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most")).collect()  # one row a target
    available = {r.source: (r.n, r.most) for r in sizes}
    budget = budgets({s: n for s, (n, _) in available.items()}, wanted, total)
    # The sources that a repeat limit holds: they set the total of the whole mix.
    held = {s for s, b in budget.items() if b >= available[s][0] * wanted[s][1] - 1}
    plan = spark.createDataFrame(
        [(s, b // available[s][0], b % available[s][0]) for s, b in budget.items()], "source string, epochs bigint, rest bigint"
    )
    # A monotone map of the keys to 0 .. 1 that neutral documents fill evenly.
    columns = ["doc_id", "source", "n_tokens", "epochs"]
    left = docs.join(F.broadcast(plan), "source").withColumn("at", 1 - F.exp(-F.col("key") * NEUTRAL))
    decided = []
    for level in range(LEVELS):
        bucket = F.least(F.floor(F.col("at") * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        ranged = left.withColumn("bucket", bucket).withColumn("at", F.col("at") * BUCKETS - bucket)
        sums = ranged.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("inside"))
        before = F.sum("inside").over(W.partitionBy("source").orderBy("bucket")) - F.col("inside")
        edges = small_side(sums.withColumn("before", before))  # BUCKETS rows a source
        placed = written(ranged.join(edges, ["source", "bucket"]), f"range{level}")
        decided.append(placed.where("before + inside <= rest").select(*columns, F.lit(1).alias("extra")))
        decided.append(placed.where("before >= rest").select(*columns, F.lit(0).alias("extra")))
        last = placed.where("before < rest and before + inside > rest").withColumn("rest", F.col("rest") - F.col("before"))
        left = last.drop("bucket", "inside", "before")
    upto = F.sum("n_tokens").over(W.partitionBy("source").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    # Taken if it ends within the budget, or if it crosses it and overshoots by less than half of itself.
    over = (F.col("upto") - F.col("rest")) * 2
    ends = left.withColumn("upto", upto).select(*columns, F.when(over < F.col("n_tokens"), 1).otherwise(0).alias("extra"))
    for d in decided:
        ends = ends.unionByName(d)
    chosen = ends.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.col("extra")).cast("int").alias("repeats")).where("repeats > 0")
    got = chosen.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    sources = spark.createDataFrame(
        [(s, w, m, available.get(s, (0, 0))[0], available.get(s, (0, 0))[1], budget.get(s, 0), s in held) for s, (w, m) in wanted.items()],
        "source string, weight double, max_repeats int, available bigint, largest bigint, budget bigint, binding boolean",
    )
    whole_sum = F.sum("tokens").over(W.partitionBy())
    shares = (
        sources.join(got, "source", "left")
        .fillna(0, ["n_docs", "tokens", "most_repeats"])
        .withColumn("share", F.round(F.try_divide(F.col("tokens"), whole_sum), 6))
    )
    return chosen, shares


def kept_bounds(chosen: DataFrame, shares: DataFrame) -> DataFrame:
    """By target source: whether no document exceeds its repeats, the tokens are within half of the source's largest document of the budget, and each doc_id is there once."""
    counts = chosen.groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"))
    return shares.join(counts, "source", "left").select(
        "source",
        F.col("weight"),
        F.coalesce(F.col("most_repeats") <= F.col("max_repeats"), F.lit(True)).alias("repeats_kept"),
        (F.abs(F.col("tokens") - F.col("budget")) * 2 <= F.col("largest")).alias("budget_kept"),
        F.coalesce(F.col("rows") == F.col("ids"), F.lit(True)).alias("once"),
    )
