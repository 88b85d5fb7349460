"""Queries of the llm operators and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from arborloom.llm import canonical, clusters, encoding, mixing, packing, terms, toxicity
from arborloom.plans import Query
from arborloom.session import read_table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL twin."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _placed(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "ev_seqs"), read_table(spark, sf_dir, "run_config"))


@query(
    "p1_found",
    """
    SELECT DISTINCT r.run AS run, e.sent_id AS sent_id
    FROM run_config r JOIN ev_seqs e ON e.corpus = r.corpus
    WHERE r.gpu = 1 AND r.gpu_batch_size > 0 AND len(e.toks) > r.gpu_batch_size
    """,
)
def p1_found(spark, sf_dir):
    """Sentences that must be cut, by run."""
    return packing.cut_sequences(_placed(spark, sf_dir))


@query("p1_batches")
def p1_batches(spark, sf_dir):
    """The batches of every GPU run and how full they are."""
    return packing.batches(_placed(spark, sf_dir))


@query(
    "p1_totals",
    """
    WITH s AS (SELECT sent_id, arg_min({'c': corpus, 'n': len(toks)}, {'l': coalesce(loaded_at, TIMESTAMP '9999-12-31'), 'c': corpus, 'n': len(toks)}) AS x
               FROM ev_seqs WHERE sent_id IS NOT NULL GROUP BY sent_id),
    r AS (SELECT DISTINCT run, corpus, gpu_batch_size AS cap FROM run_config WHERE gpu = 1 AND gpu_batch_size > 0 AND corpus IS NOT NULL AND run IS NOT NULL),
    p AS (SELECT run, cap, x.n AS n FROM s JOIN r ON x.c = r.corpus WHERE x.n > 0)
    SELECT run, cap AS capacity, count(*) AS n_sentences, CAST(sum((n + cap - 1) // cap) AS BIGINT) AS n_pieces, CAST(sum(n) AS BIGINT) AS tokens,
           0::BIGINT AS overfull, CAST((sum(n) + cap - 1) // cap AS BIGINT) AS n_bins
    FROM p GROUP BY run, cap
    """,
)
def p1_totals(spark, sf_dir):
    """Sentences, pieces and tokens placed by run, no bin over its capacity, and as few bins as the tokens need."""
    return packing.totals(_placed(spark, sf_dir))


@query("p2_found")
def p2_found(spark, sf_dir):
    """Every word in a cluster, and the smallest id of that cluster."""
    members, _ = clusters.clusters(read_table(spark, sf_dir, "word_vectors"))
    return members.select(F.col("id").cast("int"), F.col("cluster_id").cast("int"))


@query("p2_clusters")
def p2_clusters(spark, sf_dir):
    """Size and most typical words of every cluster."""
    words = read_table(spark, sf_dir, "word_vectors")
    members, _ = clusters.clusters(words)
    return clusters.described(members, words.select("id", "word"))


_TERMS_SQL = """
    WITH s AS (SELECT sent_id, arg_min(words, coalesce(loaded_at, TIMESTAMP '9999-12-31')) AS words
               FROM tagwords WHERE sent_id IS NOT NULL GROUP BY sent_id),
    f AS (SELECT sent_id, words FROM s WHERE len(words) > 0),
    w AS (SELECT sent_id, unnest(words) AS word FROM f),
    c AS (SELECT word, count(*) AS occurrences, count(DISTINCT sent_id) AS records
          FROM w WHERE word IS NOT NULL AND word <> '' GROUP BY word),
    m AS (SELECT word, occurrences, records,
                 CASE WHEN occurrences < 3 OR records < 2 THEN 'rare'
                      WHEN records * 10 > (SELECT count(*) FROM f) THEN 'common' END AS mark FROM c)
"""


@query("p4_found", _TERMS_SQL + "SELECT word, mark FROM m WHERE mark IS NOT NULL")
def p4_found(spark, sf_dir):
    """Words too rare or too common."""
    return terms.marked_words(read_table(spark, sf_dir, "tagwords")).where("mark is not null").select("word", "mark")


@query("p4_terms", _TERMS_SQL + "SELECT word, occurrences, records, mark FROM m")
def p4_terms(spark, sf_dir):
    """Occurrences and sentences of every distinct word."""
    return terms.marked_words(read_table(spark, sf_dir, "tagwords")).select("word", "occurrences", "records", "mark")


@query("p5_found")
def p5_found(spark, sf_dir):
    """Pairs of dictionary ids whose words look the same."""
    return canonical.look_alike_pairs(read_table(spark, sf_dir, "word_dict"))


@query("p5_forms")
def p5_forms(spark, sf_dir):
    """The canonical form of every distinct form of the treebank and word of the tagged text."""
    forms = read_table(spark, sf_dir, "conll_tokens").select(F.col("form").alias("word"))
    words = read_table(spark, sf_dir, "tagwords").select(F.explode("words").alias("word"))
    distinct = forms.unionByName(words).where("word is not null and word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return canonical.with_canonical(distinct, "word", "canonical")


@query("p5_classes")
def p5_classes(spark, sf_dir):
    """Every dictionary word with its canonical form and its class of look-alikes."""
    return canonical.look_alike_classes(read_table(spark, sf_dir, "word_dict"))


@query("p6_ids")
def p6_ids(spark, sf_dir):
    """Ids of every document's text."""
    return encoding.with_ids(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark, sf_dir):
    return mixing.mix(*(read_table(spark, sf_dir, x) for x in ("documents", "mix_targets", "labels")))


@query("p7_mix")
def p7_mix(spark, sf_dir):
    """Documents chosen to reach the target shares, with their repeats."""
    return _mixed(spark, sf_dir)[0]


@query("p7_shares")
def p7_shares(spark, sf_dir):
    """Shares asked for and reached, by source."""
    return _mixed(spark, sf_dir)[1]


@query(
    "p7_bounds",
    """
    SELECT source, CAST(min(weight) AS DOUBLE) AS weight, true AS repeats_kept, true AS budget_kept, true AS once
    FROM mix_targets WHERE source IS NOT NULL AND weight > 0 GROUP BY source
    """,
)
def p7_bounds(spark, sf_dir):
    """Whether the mix keeps the repeat limits and the budgets."""
    return mixing.kept_bounds(*_mixed(spark, sf_dir))


def _scored(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    return toxicity.scored(documents, toxicity.fitted(documents, read_table(spark, sf_dir, "labels")))


@query("p8_found")
def p8_found(spark, sf_dir):
    """Documents with an abusive, hateful or sexually explicit passage."""
    return _scored(spark, sf_dir).where("passages > 0").select("doc_id")


@query("p8_scores")
def p8_scores(spark, sf_dir):
    """Score of every document."""
    return _scored(spark, sf_dir)


@query("p8_rates")
def p8_rates(spark, sf_dir):
    """Rates of such documents by source."""
    return toxicity.rates(_scored(spark, sf_dir))
