"""Queries of distributions and information measures."""

from pyspark.sql import functions as F

from arborloom.operators import metrics as m
from arborloom.operators import tables
from arborloom.plans import query
from arborloom.plans.base import PAIR, word_tags
from arborloom.session import read_table


@query("distribution", """WITH c AS (SELECT l_linenumber AS id, count(*) AS cnt FROM lineitem GROUP BY 1), i AS (SELECT unnest(range(0, (SELECT max(id) FROM c) + 1)) AS id)
  SELECT CAST(i.id AS BIGINT) AS id, round(coalesce(cnt, 0) / (SELECT sum(cnt) FROM c), 6) AS p FROM i LEFT JOIN c ON c.id = i.id""")
def q_distribution(spark, sf):
    """A03."""
    return m.distribution(read_table(spark, sf, "lineitem"), "l_linenumber").select("id", F.round("p", 6).alias("p"))


@query("joint_distribution", f"WITH {PAIR} SELECT corpus AS x, tag AS y, count(*) AS cnt FROM pr WHERE corpus IS NOT NULL GROUP BY corpus, tag")
def q_joint(spark, sf):
    """A04."""
    return m.joint(word_tags(spark, sf), "corpus", "tag")


def _info_sql(source, x, y):
    h = lambda c: f"(SELECT -sum(n / t * log2(n / t)) FROM (SELECT {c}, count(*) AS n FROM s GROUP BY {c}), (SELECT count(*) AS t FROM s))"
    return f"WITH s AS (SELECT {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), i AS (SELECT (SELECT count(*) FROM s) AS n, {h('x')} AS h_x, {h('y')} AS h_y, {h('x, y')} AS h_xy)"


@query("mutual_info", _info_sql("lineitem", "l_returnflag", "l_linestatus") + " SELECT n, round(h_x, 6) AS h_x, round(h_y, 6) AS h_y, round(h_xy, 6) AS h_xy, round(h_x + h_y - h_xy, 6) AS mi FROM i")
def q_mutual_info(spark, sf):
    """A05, A06."""
    i = m.information(read_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return i.select("n", *(F.round(c, 6).alias(c) for c in ("h_x", "h_y", "h_xy", "mi")))


_V = " SELECT round(1 - (h_xy - h_y) / h_x, 6) AS homogeneity, round(1 - (h_xy - h_x) / h_y, 6) AS completeness, round(2 * (1 - (h_xy - h_y) / h_x) * (1 - (h_xy - h_x) / h_y) / ((1 - (h_xy - h_y) / h_x) + (1 - (h_xy - h_x) / h_y)), 6) AS v, round(2 * h_xy - h_x - h_y, 6) AS vi FROM i"


@query("v_measure_lineitem", _info_sql("lineitem", "l_returnflag", "l_linestatus") + _V)
def q_v_lineitem(spark, sf):
    """Order status against return flag."""
    return m.v_measure(m.information(read_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@query("v_measure_documents", _info_sql("documents", "source", "lang") + _V)
def q_v_documents(spark, sf):
    """Language against source."""
    return m.v_measure(m.information(read_table(spark, sf, "documents"), "source", "lang"))


@query("v_measure_tags", f"WITH {PAIR}, " + _info_sql("pr", "tag", "word").removeprefix("WITH ") + _V)
def q_v_tags(spark, sf):
    """Words as clusters of tags."""
    return m.v_measure(m.information(word_tags(spark, sf), "tag", "word"))


@query("cond_entropy_sum", f"WITH {PAIR}, c AS (SELECT tag AS x, word, count(*) AS n FROM pr GROUP BY ALL), p AS (SELECT x, n / sum(n) OVER (PARTITION BY x) AS p FROM c) SELECT x, round(sum(p * ln(p)), 6) AS sum_plogp FROM p GROUP BY x")
def q_cond_entropy_sum(spark, sf):
    """A07."""
    return m.conditional_log_sums(word_tags(spark, sf), "tag", "word").select("x", F.round("sum_plogp", 6).alias("sum_plogp"))


@query("sym_kl", f"""WITH {PAIR}, c AS (SELECT tag, count(*) FILTER (WHERE corpus = 'fables') AS ca, count(*) FILTER (WHERE corpus = 'ferry') AS cb FROM pr GROUP BY tag), b AS (SELECT * FROM c WHERE ca > 0 AND cb > 0),
  q AS (SELECT ca / (SELECT sum(ca) FROM b) AS p, cb / (SELECT sum(cb) FROM b) AS q FROM b) SELECT round((sum(p * ln(p / q)) + sum(q * ln(q / p))) / 2, 6) AS divergence FROM q""")
def q_sym_kl(spark, sf):
    """tags of two corpora."""
    return m.symmetric_divergence(word_tags(spark, sf), "corpus", "fables", "ferry", "tag").select(F.round("divergence", 6).alias("divergence"))


@query("embed_moments", """WITH e AS (SELECT label, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
  SELECT label, dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM e GROUP BY label, dim""")
def q_embed_moments(spark, sf):
    """Mean and deviation of each label and dimension."""
    e = read_table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    v = F.col("v").cast("double")
    return e.groupBy("label", "dim").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("sd"))


@query("embed_stats", """WITH e AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY dim)
  SELECT round(avg(m), 6) AS mean_of_means, round(stddev_pop(m), 6) AS sd_of_means, round(avg(s), 6) AS mean_of_sds, round(stddev_pop(s), 6) AS sd_of_sds FROM c""")
def q_embed_stats(spark, sf):
    """A20."""
    e = read_table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("dim", "v"))
    v = F.col("v").cast("double")
    c = e.groupBy("dim").agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s"))
    return c.agg(F.round(F.avg("m"), 6).alias("mean_of_means"), F.round(F.stddev_pop("m"), 6).alias("sd_of_means"), F.round(F.avg("s"), 6).alias("mean_of_sds"), F.round(F.stddev_pop("s"), 6).alias("sd_of_sds"))


@query("kmeans")
def q_kmeans(spark, sf):
    """K-means with 10 centres and 5 iterations."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = read_table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", array_to_vector("embedding").alias("features"))
    return KMeans(k=10, maxIter=5, seed=1).fit(e).transform(e).groupBy("prediction").agg(F.count("*").alias("n"))


@query("gauss_logpdf", """WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS (SELECT label AS tag, dim, avg(v) AS m, stddev_pop(v) AS s FROM e GROUP BY ALL)
  SELECT vec_id, tag, round(sum(-0.5 * ((v - m) / s) ** 2 - ln(s) - 0.5 * ln(2 * pi())), 3) AS log_density FROM e JOIN g ON g.dim = e.dim GROUP BY vec_id, tag""")
def q_gauss_logpdf(spark, sf):
    """Q02, M17 input: log density of every vector under every label's diagonal normal; the labels' table is small and broadcast."""
    from arborloom.functions.scalars import normal_log_density

    e = read_table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("v", F.col("x").cast("double"))
    from arborloom.session import small_side

    g = e.groupBy(F.col("label").alias("tag"), "dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return e.join(small_side(g), "dim").groupBy("vec_id", "tag").agg(F.round(F.sum(normal_log_density(F.col("v"), F.col("m"), F.col("s"))), 3).alias("log_density"))


_STEPS = """st AS (SELECT user_id AS sent_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, count(*) OVER (PARTITION BY user_id) AS n,
  CAST(event_id % 2 AS INTEGER) AS f, CAST(event_id // 2 % 2 AS INTEGER) AS j FROM events)"""


def _steps(spark, sf):
    """Fork and join decisions: bits of the events of each user, in order."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id")
    pos = (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("pos")
    return read_table(spark, sf, "events").select(F.col("user_id").alias("sent_id"), pos, F.count("*").over(w).alias("n"), (F.col("event_id") % 2).alias("f"), (F.expr("event_id div 2") % 2).alias("j"))


@query("center_events", f"WITH {_STEPS} SELECT sent_id, count(*) FILTER (WHERE f = 1 AND j = 0 AND pos >= 2 AND pos < n - 1) AS n_events FROM st GROUP BY sent_id")
def q_center_events(spark, sf):
    """A17."""
    return tables.center_events(_steps(spark, sf), "sent_id")


@query("branching_odds", f"""WITH {_STEPS} SELECT sent_id, round(count(*) FILTER (WHERE pos > 0 AND f = 1 AND j = 0) / count(*), 6) AS deep_share,
  round(count(*) FILTER (WHERE f = 0 AND j = 0) / nullif(count(*) FILTER (WHERE f = j), 0), 6) AS left_share FROM st GROUP BY sent_id""")
def q_branching_odds(spark, sf):
    """A18."""
    return tables.branching_odds(_steps(spark, sf), "sent_id").select("sent_id", F.round("deep_share", 6).alias("deep_share"), F.round("left_share", 6).alias("left_share"))


@query("used_states", "SELECT max(head) AS most, min(head) AS least, count(DISTINCT head) AS n_used, coalesce(bool_and(head BETWEEN 0 AND 40), true) AS valid FROM conll_tokens")
def q_used_states(spark, sf):
    """Greatest and least value, how many are used, and whether all are within bounds."""
    return tables.used_states(read_table(spark, sf, "conll_tokens"), "head", 40)


@query("tag_functions", f"""WITH {PAIR}, c AS (SELECT corpus, tag, count(*) AS cnt FROM pr WHERE corpus IS NOT NULL GROUP BY ALL), l AS (SELECT corpus, list(cnt ORDER BY tag) AS x FROM c GROUP BY corpus)
  SELECT corpus, round(list_sum(list_transform(x, lambda v: lgamma(v + 0.5::DOUBLE))) - lgamma(list_sum(x) + 0.5::DOUBLE * len(x)), 4) AS constant,
    round((x[1]::DOUBLE ** 0.5) / list_sum(list_transform(x, lambda v: v::DOUBLE ** 0.5)), 6) AS tempered FROM l""")
def q_tag_functions(spark, sf):
    """Dirichlet constant of the tag counts of each corpus, and the share of the first tag at temperature 2."""
    from arborloom.functions import scalars

    c = word_tags(spark, sf).where("corpus is not null").groupBy("corpus", "tag").agg(F.count("*").alias("cnt"))
    x = c.groupBy("corpus").agg(F.transform(F.array_sort(F.collect_list(F.struct("tag", "cnt"))), lambda v: v["cnt"].cast("double")).alias("x"))  # one entry a tag
    return x.select("corpus", F.round(scalars.dirichlet_constant(F.col("x"), 0.5), 4).alias("constant"), F.round(scalars.tempered(F.col("x"), 2.0)[0], 6).alias("tempered"))


@query("stack_functions", """WITH e AS (SELECT DISTINCT sent_id, toks FROM ev_seqs WHERE sent_id IS NOT NULL AND len(toks) > 0 AND len(list_filter(toks, lambda x: x IS NULL)) = 0), p AS (SELECT *, coalesce(list_position(toks, 0), 0) AS z FROM e)
  SELECT sent_id, CAST(CASE WHEN z = 0 THEN len(toks) - 1 ELSE z - 2 END AS INTEGER) AS deepest, CAST(coalesce(list_position(list_transform(toks, lambda t: t - 100 >= 0), true), 0) - 1 AS INTEGER) AS first_known FROM p""")
def q_stack_functions(spark, sf):
    """last entry before the first 0 of a token list taken as a stack; first entry that is not negative after 100 is taken off."""
    from arborloom.functions import scalars
    from arborloom.plans.base import int_sentences

    s = int_sentences(spark, sf).where("not exists(toks, x -> x is null)").select("sent_id", "toks").distinct()
    return s.select("sent_id", scalars.deepest(F.col("toks")).alias("deepest"), scalars.first_non_negative(F.transform("toks", lambda t: t - 100)).alias("first_known"))


@query("label_functions", """SELECT DISTINCT l_discount, replace(regexp_replace(printf('%.6f', l_discount::DOUBLE), '\\.?0+$', ''), '.', 'p') AS label, CASE WHEN l_discount > 0.05 THEN 0.0::DOUBLE END AS mask FROM lineitem""")
def q_label_functions(spark, sf):
    """numbers as file-safe labels; a condition as a log mask."""
    from arborloom.functions import scalars

    d = read_table(spark, sf, "lineitem").select("l_discount").distinct()
    return d.select("l_discount", scalars.file_label(F.col("l_discount")).alias("label"), scalars.log_mask(F.col("l_discount") > 0.05).alias("mask"))


@query("bracket_tags", f"WITH {PAIR} SELECT DISTINCT tag, regexp_full_match(tag, '-?[LR](R|S|C)B-?') AS is_bracket FROM pr")
def q_bracket_tags(spark, sf):
    """F14."""
    from arborloom.functions import scalars

    return word_tags(spark, sf).select("tag").distinct().withColumn("is_bracket", scalars.bracket_tag(F.col("tag")))
