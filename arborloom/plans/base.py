"""Inputs that several queries share, in both languages: repeated rows dropped, whole tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborloom.operators import text
from arborloom.session import read_table

#: Sentences of words: null and empty words are left out.
TW = """tw AS (SELECT sent_id, corpus, list_filter(words, lambda w: w IS NOT NULL AND w <> '') AS words
  FROM (SELECT DISTINCT sent_id, words, corpus FROM tagwords WHERE sent_id IS NOT NULL AND len(words) > 0))"""
TOK = TW + """, tok AS (SELECT sent_id, corpus, CAST(unnest(range(len(words))) AS INTEGER) AS pos, unnest(words) AS tok FROM tw)"""
#: Pairs of word and tag of sentences whose arrays are of one length, nulls left out.
PAIR = """pr AS (SELECT sent_id, corpus, pos, word, tag FROM (
    SELECT sent_id, corpus, CAST(unnest(range(len(words))) AS INTEGER) AS pos, unnest(words) AS word, unnest(tags) AS tag
    FROM (SELECT DISTINCT sent_id, words, tags, corpus FROM tagwords WHERE sent_id IS NOT NULL AND len(words) = len(tags)))
  WHERE word IS NOT NULL AND word <> '' AND tag IS NOT NULL)"""
EV = "ev AS (SELECT DISTINCT sent_id, toks, tags, corpus FROM ev_seqs WHERE sent_id IS NOT NULL AND len(toks) > 0)"
EVT = EV + ", evt AS (SELECT sent_id, corpus, CAST(unnest(range(len(toks))) AS INTEGER) AS pos, unnest(toks) AS tok FROM ev)"
CT = "ct AS (SELECT DISTINCT sent_id, tok_id, form, lemma, tag, head, file FROM conll_tokens WHERE sent_id IS NOT NULL)"
LN = """ln AS (SELECT doc_id, line_no, line FROM (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
  WHERE NOT regexp_full_match(line, '[ \\t\\r]*'))"""


def word_sentences(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "tagwords").where("sent_id is not null and size(words) > 0").select("sent_id", "words", "corpus").distinct()
    return rows.withColumn("words", F.filter("words", lambda w: w.isNotNull() & (w != "")))


def word_tokens(spark, sf_dir) -> DataFrame:
    return word_sentences(spark, sf_dir).select("sent_id", "corpus", F.posexplode("words").alias("pos", "tok"))


def word_tags(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "tagwords").where("sent_id is not null and size(words) = size(tags) and size(words) > 0")
    pairs = rows.select("sent_id", "words", "tags", "corpus").distinct()
    return (
        pairs.select("sent_id", "corpus", F.posexplode(F.arrays_zip("words", "tags")).alias("pos", "p"))
        .select("sent_id", "corpus", "pos", F.col("p.words").alias("word"), F.col("p.tags").alias("tag"))
        .where("word is not null and word <> '' and tag is not null")
    )


def int_sentences(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "ev_seqs").where("sent_id is not null and size(toks) > 0")
    return rows.select("sent_id", "toks", "tags", "corpus").distinct()


def int_tokens(spark, sf_dir) -> DataFrame:
    return int_sentences(spark, sf_dir).select("sent_id", "corpus", F.posexplode("toks").alias("pos", "tok"))


def conll(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "conll_tokens").where("sent_id is not null")
    return rows.select("sent_id", "tok_id", "form", "lemma", "tag", "head", "file").distinct()


def doc_lines(spark, sf_dir) -> DataFrame:
    return text.lines(read_table(spark, sf_dir, "documents"))
