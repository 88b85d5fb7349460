"""Queries of readers and writers: tables are written in a text format to the shared folder, read back, and compared with SQL over the tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborloom.operators import grammar, tables, trees
from arborloom.operators import text as t
from arborloom.plans import query
from arborloom.plans.base import CT, EV, LN, TOK, conll, int_sentences, word_sentences, word_tokens
from arborloom.plans.grammar import _RULES, rules
from arborloom.plans.trees import _TREES, line_trees
from arborloom.session import read_table, shared_folder
from arborloom.sources import formats


def _place(spark: SparkSession, name: str) -> str:
    """A folder for one written table; it goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/arborloom-format-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def _lines(df: DataFrame, name: str) -> str:
    path = _place(df.sparkSession, name)
    df.write.text(path)
    return path


_WHOLE = EV + ", w AS (SELECT toks, tags FROM ev WHERE len(toks) = len(tags) AND len(list_filter(toks, lambda x: x IS NULL)) = 0 AND len(list_filter(tags, lambda x: x IS NULL)) = 0)"


def _whole(spark, sf):
    return int_sentences(spark, sf).where("size(toks) = size(tags) and not exists(toks, x -> x is null) and not exists(tags, x -> x is null)")


@query("read_int_corpus", f"WITH {_WHOLE} SELECT array_to_string(toks, ' ') AS toks, array_to_string(tags, ' ') AS tags FROM w")
def q_int_corpus(spark, sf):
    """tag/tok lines."""
    pair = F.zip_with("tags", "toks", lambda a, b: F.concat(a.cast("string"), F.lit("/"), b.cast("string")))
    back = formats.read_int_corpus(spark, _lines(_whole(spark, sf).select(F.array_join(pair, " ")), "ints"))
    return back.select(F.array_join(F.col("toks").cast("array<string>"), " ").alias("toks"), F.array_join(F.col("tags").cast("array<string>"), " ").alias("tags"))


@query("read_samples", f"WITH {_WHOLE} SELECT array_to_string(tags, ' ') AS tags FROM w")
def q_samples(spark, sf):
    """Lists of tags as literals."""
    rows = _whole(spark, sf).select(F.concat(F.lit("["), F.array_join(F.col("tags").cast("array<string>"), ", "), F.lit("]")))
    return formats.read_samples(spark, _lines(rows, "samples")).select(F.array_join(F.col("tags").cast("array<string>"), " ").alias("tags"))


@query("read_dictionary", "SELECT DISTINCT word, id FROM word_dict WHERE word IS NOT NULL AND id IS NOT NULL AND trim(word) <> ''")
def q_dictionary(spark, sf):
    """The dictionary written by word and read."""
    d, path = read_table(spark, sf, "word_dict").where("id is not null and trim(word) <> ''").select("word", "id").distinct(), _place(spark, "dictionary")
    formats.write_dictionary(d, path)
    return formats.read_dictionary(spark, path)


_VEC = """v AS (SELECT min(d.id) AS id, d.word, any_value(v.vec) AS vec FROM (SELECT DISTINCT id, vec FROM word_vectors WHERE len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) v
  JOIN (SELECT DISTINCT id, word FROM word_dict WHERE regexp_full_match(word, '[A-Za-z]+')) d ON d.id = v.id GROUP BY d.word HAVING count(*) = 1)"""


@query("read_word_vectors", f"WITH {_VEC} SELECT id, CAST(len(vec) AS INTEGER) AS width, round(CAST(vec[1] AS DOUBLE), 4) + 0.0 AS first, round(CAST(vec[64] AS DOUBLE), 4) + 0.0 AS last FROM v")
def q_word_vectors(spark, sf):
    """Vectors of words that have one, as text lines with a header."""
    v = read_table(spark, sf, "word_vectors").where("size(vec) = 64 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity'))").select("id", "vec").distinct()
    d = read_table(spark, sf, "word_dict").where("word rlike '^[A-Za-z]+$'").select("id", "word").distinct()
    one = v.join(d, "id").groupBy("word").agg(F.min("id").alias("id"), F.first("vec").alias("vec"), F.count("*").alias("c")).where("c = 1")
    lines = one.select(F.concat_ws(" ", "word", F.array_join(F.col("vec").cast("array<string>"), " ")))
    back = formats.read_word_vectors(spark, _lines(lines, "vectors"), one.select("word", "id"), 64)
    return back.select("id", F.size("vec").alias("width"), (F.round(F.col("vec")[0].cast("double"), 4) + F.lit(0.0)).alias("first"), (F.round(F.col("vec")[63].cast("double"), 4) + F.lit(0.0)).alias("last"))


@query("read_states", f"""WITH {TOK} SELECT CAST(CASE WHEN pos > 1 THEN 1 ELSE 0 END AS INTEGER) AS j, CAST(CASE WHEN pos < len(words) - 1 THEN 1 ELSE 0 END AS INTEGER) AS f, CAST(1 + length(tok.tok) % 5 AS INTEGER) AS g, count(*) AS n
  FROM tok JOIN tw ON tw.sent_id = tok.sent_id AND tw.corpus IS NOT DISTINCT FROM tok.corpus WHERE len(words) > 1 GROUP BY ALL""")
def q_states(spark, sf):
    """State sequences of right branching parses, read and counted."""
    s = word_sentences(spark, sf).where("size(words) > 1")
    n = F.size("words")
    state = lambda w, i: F.concat(F.when(i > 1, F.lit("+")).otherwise(F.lit("-")), F.when(i == 0, F.lit("::ACT0/AWA0::")).otherwise(F.lit("::ACT1/AWA1::")), F.when(i < n - 1, F.lit("+")).otherwise(F.lit("-")), F.lit("::POS"), (1 + F.length(w) % 5).cast("string"), F.lit("::w"))
    back = formats.read_states(spark, _lines(s.select(F.array_join(F.transform("words", state), " ")), "states"))
    return back.select(F.explode("states").alias("s")).groupBy("s.j", "s.f", "s.g").agg(F.count("*").alias("n"))


@query("read_line_trees", f"WITH {_TREES} SELECT trim(tree) AS tree FROM tr")
def q_line_trees(spark, sf):
    """Gold trees, one a line."""
    return formats.read_line_trees(spark, _lines(line_trees(spark, sf).select("tree"), "trees")).select("tree")


@query("write_trees", f"WITH {_TREES} SELECT regexp_replace(tree, '\\s+$', '') AS tree FROM tr JOIN ok ON ok.tree_id = tr.tree_id")
def q_write_trees(spark, sf):
    """Node tables written as trees and read as lines."""
    path = _place(spark, "written-trees")
    formats.write_trees(trees.read_trees(line_trees(spark, sf)), path)
    return formats.read_line_trees(spark, path).select("tree")


_BLOCKS = CT + ", c AS (SELECT * FROM ct WHERE tok_id IS NOT NULL AND form IS NOT NULL AND NOT regexp_matches(form, '[\\t\\n\\r]'))"


@query("read_conll", f"WITH {_BLOCKS} SELECT tok_id, form, coalesce(tag, '_') AS tag, coalesce(head, 0) AS head, count(*) AS n FROM c GROUP BY ALL")
def q_read_conll(spark, sf):
    """Sentences as blocks with a comment each, written with both line ends, and their rows read."""
    rows = conll(spark, sf).where("tok_id is not null and form is not null and not form rlike '[\\t\\n\\r]'")
    line = F.concat_ws("\t", F.col("tok_id").cast("string"), "form", F.lit("_"), F.coalesce("tag", F.lit("_")), F.lit("_"), F.lit("_"), F.coalesce("head", F.lit(0)).cast("string"))
    blocks = rows.groupBy("sent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", line.alias("line")))), lambda x: x["line"]).alias("l"))
    end = F.when(F.xxhash64("sent_id") % 2 == 0, F.lit("\n")).otherwise(F.lit("\r\n"))
    back = formats.read_conll(spark, _lines(blocks.select(F.concat(F.lit("# "), F.col("sent_id").cast("string"), end, F.array_join("l", "\u0001"), end).alias("b"), end.alias("e")).select(F.replace("b", F.lit("\u0001"), F.col("e"))), "conll"))
    f = F.col("fields")
    return back.select("tok_id", f[1].alias("form"), f[3].alias("tag"), f[6].cast("int").alias("head")).groupBy("tok_id", "form", "tag", "head").agg(F.count("*").alias("n"))


@query("read_conll_blocks", f"WITH {_BLOCKS} SELECT n_tokens, count(*) AS n FROM (SELECT sent_id, count(*) AS n_tokens FROM c GROUP BY sent_id) GROUP BY n_tokens")
def q_conll_blocks(spark, sf):
    """Sentences found between blank lines, by length."""
    rows = conll(spark, sf).where("tok_id is not null and form is not null and not form rlike '[\\t\\n\\r]'")
    line = F.concat_ws("\t", F.col("tok_id").cast("string"), "form")
    blocks = rows.groupBy("sent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_id", line.alias("line")))), lambda x: x["line"]), "\r\n").alias("l"))
    back = formats.read_conll(spark, _lines(blocks.select(F.concat("l", F.lit("\r\n \r\n"))), "blocks"))
    return back.groupBy("file", "sent_id").agg(F.count("*").alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n"))


@query("read_ltf", """WITH k AS (SELECT unnest(regexp_extract_all(text, '<TOKEN[^>]*>')) AS x FROM documents WHERE fmt = 'ltf' AND contains(text, '</LTF>'))
  SELECT replace(coalesce(nullif(regexp_extract(x, ' pos="([^"]*)"', 1), ''), 'UNK'), '/', '\\/') AS tag, count(*) AS n FROM k GROUP BY tag""")
def q_ltf(spark, sf):
    """Tokens of annotation XML by tag."""
    path = _place(spark, "ltf")
    docs = read_table(spark, sf, "documents").where("fmt = 'ltf' and text like '%</LTF>%'").select("text")
    docs.write.option("maxRecordsPerFile", 1).text(path)  # the format has one document a file
    return formats.read_ltf(spark, path).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("read_conditional_model", f"WITH {_RULES} SELECT 'R' AS id, CAST(lhs AS VARCHAR) AS cond, r1 || ' ' || r2 AS out, round(p, 6) AS p FROM rp WHERE NOT is_lex")
def q_conditional_model(spark, sf):
    """Binary rules printed as a conditional model and read."""
    p = grammar.conditional(rules(spark, sf)).where(~F.col("is_lex"))
    table = p.select(F.col("lhs").cast("string").alias("cond"), F.concat_ws(" ", "r1", "r2").alias("out"), "p")
    back = formats.read_conditional_model(spark, _lines(tables.printed(table, "R").select("line"), "model"))
    return back.select("id", F.array_join("cond", " ").alias("cond"), F.array_join("out", " ").alias("out"), F.round("p", 6).alias("p"))


@query("read_model_dump", f"WITH {_RULES} SELECT lhs AS depth, r1 AS cond, r2 AS out, round(p, 6) AS p FROM rp WHERE NOT is_lex AND CAST(r2 AS INTEGER) <= 3")
def q_model_dump(spark, sf):
    """A dump of P( o | c, d ) = p, outcomes beyond 3 dropped."""
    p = grammar.conditional(rules(spark, sf)).where(~F.col("is_lex"))
    lines = p.select(F.concat(F.lit("P( "), "r2", F.lit(" | "), "r1", F.lit(", "), F.col("lhs").cast("string"), F.lit(" ) = "), F.col("p").cast("string")))
    return formats.read_model_dump(spark, _lines(lines, "dump"), 3).select("depth", "cond", "out", F.round("p", 6).alias("p"))


@query("read_dump_tuples", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def q_dump_tuples(spark, sf):
    """Tuples of an SQL dump."""
    n = read_table(spark, sf, "nation")
    lines = n.select(F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(",'"), "n_name", F.lit("',"), F.col("n_regionkey").cast("string"), F.lit("),")))
    f = F.col("fields")
    return formats.read_dump_tuples(spark, _lines(lines, "tuples")).select(f[0].alias("key"), f[1].alias("name"), f[2].alias("region"))


_CHAIN = "ch AS (SELECT CAST(l_linenumber AS INTEGER) AS iter, l_returnflag AS rule, round(avg(l_discount), 6) AS p FROM lineitem GROUP BY ALL)"


def _chain(spark, sf):
    """A chain of values by iteration, from the line items."""
    return read_table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("iter"), F.col("l_returnflag").alias("rule")).agg(F.round(F.avg("l_discount"), 6).alias("p"))


@query("read_chain", f"WITH {_CHAIN} SELECT CAST(iter AS BIGINT) AS step, rule AS name, p AS value FROM ch")
def q_chain(spark, sf):
    """A chain laid out wide, written as a table with a header, read, and given as a series."""
    path = _place(spark, "chain")
    formats.chain_view(_chain(spark, sf), ["A", "N", "R"]).write.csv(path, sep="\t", header=True)
    return formats.scalar_series(formats.read_table_with_header(spark, path)).select(F.col("step").cast("bigint").alias("step"), "name", "value").where("value is not null")


@query("read_reports", f"WITH {_CHAIN} SELECT iter, p AS value FROM ch WHERE rule = 'A'")
def q_reports(spark, sf):
    """A report an iteration, of which the first line with the key counts; the iteration comes from the path."""
    path = _place(spark, "reports")
    report = F.concat(F.lit("run\nrule A = "), F.col("p").cast("string"), F.lit("\nrule A = 0\n"))
    _chain(spark, sf).where("rule = 'A'").select("iter", report.alias("value")).write.partitionBy("iter").text(path)
    return formats.with_iteration(formats.read_reports(spark, path, "rule A"), r"iter=(\d+)/").select("iter", F.round("value", 6).alias("value"))


@query("append_series", f"WITH {_CHAIN} SELECT iter, rule, p FROM ch WHERE iter BETWEEN 2 AND 5")
def q_append(spark, sf):
    """A series appended by iteration and read from the second to the fifth."""
    path, chain = _place(spark, "series"), _chain(spark, sf)
    formats.append_series(chain.where("iter <= 3"), path)
    formats.append_series(chain.where("iter > 3"), path)
    return tables.after_burn_in(spark.read.parquet(path), 2, 5).select("iter", "rule", "p")


@query("checkpoints", f"WITH {_RULES} SELECT 3 AS last, lhs, count(*) AS n FROM rc GROUP BY lhs")
def q_checkpoints(spark, sf):
    """Rule counts of three iterations, the last whole one found and read."""
    path, counts = _place(spark, "checkpoints"), rules(spark, sf)
    for i in (1, 2, 3):
        formats.write_checkpoint(counts, path, i)
    last = formats.last_checkpoint(spark, path)
    return spark.read.parquet(f"{path}/iter={last}").groupBy(F.lit(last).alias("last"), "lhs").agg(F.count("*").alias("n"))


@query("lex_distribution", f"""WITH {TOK}, c AS (SELECT 1 + length(tok) % 5 AS c1, tok, count(*) AS cnt FROM tok GROUP BY ALL), p AS (SELECT CAST(c1 AS INTEGER) AS c1, tok AS out, cnt / sum(cnt) OVER (PARTITION BY c1) AS p FROM c)
  SELECT c1, out, round(p, 9) AS p FROM p WHERE p >= 0.0001""")
def q_lex(spark, sf):
    """Lexical distribution of categories, small probabilities dropped, outcomes by word."""
    toks = word_tokens(spark, sf)
    words = t.first_occurrence_dictionary(toks).select(F.col("tok").alias("word"), "id")
    counts = t.encoded(toks, words.select(F.col("word").alias("tok"), "id")).groupBy((1 + F.length("tok") % 5).cast("int").alias("c1"), F.col("id").alias("out")).agg(F.count("*").alias("cnt"))
    full = counts.select(F.lit("lex").alias("model"), F.lit(0).alias("depth"), "c1", F.lit(-1).alias("c2"), "out", "cnt")
    return formats.distributions(full, 1e-4, words).select("c1", "out", F.round("p", 9).alias("p"))


@query("write_gaussian", """WITH e AS (SELECT label, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)
  SELECT label AS pos, dim, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS sd FROM e GROUP BY label, dim""")
def q_gaussian_file(spark, sf):
    """Gaussian parameters of each label written as lines and read."""
    e = read_table(spark, sf, "embeddings").select(F.col("label").alias("pos"), F.posexplode("embedding").alias("dim", "x"))
    g = e.groupBy("pos", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("sd"))
    path = _place(spark, "gaussian")
    formats.write_gaussian(g, path)
    return formats.read_gaussian(spark, path).select("pos", "dim", (F.col("mean") + F.lit(0.0)).alias("mean"), (F.col("sd") + F.lit(0.0)).alias("sd"))


@query("write_annotations", f"WITH {EV} SELECT CAST(len(toks) - 1 AS BIGINT) AS last, count(*) AS n FROM ev GROUP BY 1")
def q_annotations(spark, sf):
    """The whole-sentence segments written as annotation XML and read."""
    steps = int_sentences(spark, sf).select("sent_id", F.posexplode("toks").alias("pos", "tok")).withColumn("f", F.lit(1)).withColumn("j", F.lit(0))
    path = _place(spark, "annotations")
    formats.write_annotations(formats.segments(steps).where("segment = -1"), path)
    schema = "_id string, _start bigint, _end bigint"
    back = spark.read.format("xml").option("rowTag", "ANNOTATION").schema(schema).load(path)
    return back.groupBy(F.col("_end").alias("last")).agg(F.count("*").alias("n"))


@query("write_token_attributes", f"WITH {EV} SELECT CAST(len(toks) AS INTEGER) AS n_tokens, count(*) AS n FROM ev GROUP BY 1")
def q_token_attributes(spark, sf):
    """State parts as attributes of tokens, written as XML and read as segments."""
    toks = int_sentences(spark, sf).select(F.col("sent_id").alias("seg_id"), F.posexplode("toks").alias("pos", "tok"))
    rows = toks.select("seg_id", "pos", F.coalesce(F.col("tok").cast("string"), F.lit("-")).alias("word"), *(F.lit(k).alias(c) for k, c in enumerate("abgfj")))
    path = _place(spark, "attributes")
    formats.write_token_attributes(rows, path)
    return formats.read_ltf(spark, path).groupBy(F.size("words").alias("n_tokens")).agg(F.count("*").alias("n"))


@query("config_files", f"""WITH {LN}, c AS (SELECT ln.doc_id, line FROM ln JOIN documents d ON d.doc_id = ln.doc_id WHERE d.fmt = 'config')
  SELECT trim(string_split(line, '=')[1]) AS key, count(*) AS n FROM c WHERE contains(line, '=') AND NOT starts_with(line, '#') AND NOT starts_with(line, '[') GROUP BY 1""")
def q_configs(spark, sf):
    """Keys of the config files among the documents, counted."""
    rows = t.lines(read_table(spark, sf, "documents").where("fmt = 'config'"))
    return formats.config_entries(rows, "line").groupBy("key").agg(F.count("*").alias("n"))
