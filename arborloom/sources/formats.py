"""Readers and writers of the text formats (S01-S29 of the blueprint), as DataFrame plans over distributed text scans."""

from __future__ import annotations

import configparser
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborloom.operators import badrows, trees
from arborloom.operators.text import BLANK, joined_brackets, words_of


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``(file, line_id, line)``: line_id rises in file order, with gaps; lines are never collected or renumbered in one task."""
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))


def with_iteration(df: DataFrame, pattern: str = r"(\d+)[^/\d]*$") -> DataFrame:
    """``iter`` from the file name."""
    return df.withColumn("iter", F.regexp_extract(F.col("file"), pattern, 1).try_cast("int"))


def read_int_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(sent_id, toks, tags)`` of lines of ``tag/tok`` or ``tok``; a missing tag is 0; more than one slash is an error."""
    pieces = words_of(F.col("line"))
    parts = lambda w: F.split(w, "/")
    checked = lambda w: F.when(F.size(parts(w)) <= 2, w).otherwise(F.raise_error(F.concat(F.lit("more than one slash: "), w)).cast("string"))
    rows = read_lines(spark, path).select(F.col("line_id").alias("sent_id"), F.transform(pieces, checked).alias("w"))
    tag = lambda w: F.when(F.size(parts(w)) == 2, parts(w)[0].cast("int")).otherwise(0)
    return rows.select("sent_id", F.transform("w", lambda w: F.element_at(parts(w), -1).cast("int")).alias("toks"), F.transform("w", tag).alias("tags"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(word, id)``; the id is what follows the last blank."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    return rows.select(F.regexp_extract("value", "^(.*) (\\d+)[ \\r]*$", 1).alias("word"), F.regexp_extract("value", "^(.*) (\\d+)[ \\r]*$", 2).cast("int").alias("id"))


def read_word_vectors(spark: SparkSession, path: str, dictionary: DataFrame, width: int) -> DataFrame:
    """``(id, vec)``: lines of a word and ``width`` numbers (header and other lines skipped), unknown words dropped, repeated words summed."""
    pieces = F.split(F.trim("value"), BLANK)
    rows = spark.read.text(path).select(pieces.alias("p")).where(F.size("p") == width + 1)
    vec = F.transform(F.slice("p", 2, width), lambda v: v.cast("float"))
    known = rows.select(F.col("p")[0].alias("word"), vec.alias("vec")).join(dictionary, "word")
    sums = known.select("id", F.posexplode("vec").alias("pos", "v")).groupBy("id", "pos").agg(F.sum("v").cast("float").alias("v"))
    return sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vec"))


def state_structs(text: Column) -> Column:
    """Words and states ``j::ACTa/AWAb;..::f::POSg::word`` of a line."""

    def one(w: Column) -> Column:
        p = F.split(w, ":+", 5)
        pairs = F.split(p[1], ";")
        return F.struct(
            (p[0] == "+").cast("int").alias("j"),
            F.transform(pairs, lambda x: F.regexp_extract(x, "ACT(\\d+)", 1).cast("int")).alias("a"),
            F.transform(pairs, lambda x: F.regexp_extract(x, "AWA(\\d+)", 1).cast("int")).alias("b"),
            (p[2] == "+").cast("int").alias("f"),
            F.regexp_extract(p[3], "POS(\\d+)", 1).cast("int").alias("g"),
            p[4].alias("word"),
        )

    return F.transform(words_of(text), one)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """``(sent_id, states)``."""
    return read_lines(spark, path).where("trim(line) <> ''").select(F.col("line_id").alias("sent_id"), state_structs(F.col("line")).alias("states"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``(sent_id, tags)`` of lines like ``[1, 2, 3]``."""
    numbers = F.regexp_extract_all("line", F.lit("-?\\d+"), F.lit(0))
    return read_lines(spark, path).where("line like '%[%'").select(F.col("line_id").alias("sent_id"), F.transform(numbers, lambda n: n.cast("int")).alias("tags"))


def read_line_trees(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``(tree_id, tree)``, blank lines dropped; with ``limit`` the first so many."""
    rows = read_lines(spark, path).where("line like '%(%'").select(F.col("line_id").alias("tree_id"), F.trim("line").alias("tree"))
    return rows.orderBy("tree_id").limit(limit) if limit else rows


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """``(file, sent_id, tok_id, fields)``: blocks between blank lines, with any line end; comments and multiword ranges dropped.

    sent_id is the line_id of the block's first line. A file is read in splits; the number of blank lines before a split comes from sums over
    splits, so no file is sorted in one task.
    """
    rows = read_lines(spark, path).withColumn("split", F.shiftright("line_id", 33)).withColumn("blank", F.col("line").rlike("^[ \t\r]*$").cast("int"))
    sums = rows.groupBy("file", "split").agg(F.sum("blank").alias("inside"))  # one row a split
    before = F.coalesce(F.sum("inside").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("blank").over(W.partitionBy("file", "split").orderBy("line_id"))
    placed = rows.withColumn("within", within).join(sums.withColumn("before", before), ["file", "split"])
    line = F.regexp_replace("line", "\r$", "")
    fields = F.when(F.instr("row", "\t") > 0, F.split("row", "\t")).otherwise(F.split("row", " +"))
    toks = placed.select("file", "line_id", (F.col("before") + F.col("within")).alias("block"), line.alias("row")).where("row rlike '^[0-9]+[\t ]'")
    first = F.min("line_id").over(W.partitionBy("file", "block"))
    return toks.select("file", first.alias("sent_id"), F.regexp_extract("row", "^[0-9]+", 0).cast("int").alias("tok_id"), fields.alias("fields"))


def read_delimited(spark: SparkSession, path: str, n_fields: int, delimiter: str = "\t") -> tuple[DataFrame, DataFrame]:
    """``(rows, rejected)`` of whole files of delimited records; a quoted field may span lines.

    One file is one task's work: records are assembled quote-aware in file order, and a quote that is never closed costs only its line.
    ``rows(file, record_no, fields)``; ``rejected(file, record_no, raw, reason)``.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = badrows.Reader(delimiter)

        def whole(record: str) -> bool:
            try:
                return len(reader.split(record.removesuffix("\r"))) == n_fields
            except badrows.Rejected:
                return False

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                for no, raw in enumerate(badrows.assemble_records(lines[:-1] if lines[-1] == "" else lines, whole)):
                    fields, reason = None, None
                    try:
                        fields = reader.split(raw.removesuffix("\r"))
                        if len(fields) != n_fields:
                            raise badrows.Rejected(badrows.COLUMNS)
                    except badrows.Rejected as e:
                        fields, reason = None, str(e)
                    for c, v in zip(out, (file, no, raw, fields, reason), strict=True):
                        c.append(v)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["file", "record_no", "raw", "fields", "reason"])

    parsed = files.mapInArrow(parse, "file string, record_no bigint, raw string, fields array<string>, reason string")
    return parsed.where("reason is null").select("file", "record_no", "fields"), parsed.where("reason is not null").drop("fields")


def read_ltf(spark: SparkSession, path: str) -> DataFrame:
    """``(seg_id, words, tags)`` of annotation XML, one document a file; the default tag is UNK, a slash in a tag is escaped.

    A document that is not well-formed is read up to the fault.
    """
    schema = "_id string, TOKEN array<struct<_VALUE: string, _id: string, _pos: string>>"
    segs = spark.read.format("xml").option("rowTag", "SEG").schema(schema).load(path)
    tag = lambda x: F.replace(F.coalesce(x["_pos"], F.lit("UNK")), F.lit("/"), F.lit("\\/"))
    return segs.select(F.col("_id").alias("seg_id"), F.transform("TOKEN", lambda x: x["_VALUE"]).alias("words"), F.transform("TOKEN", tag).alias("tags"))


def read_korean_treebank(spark: SparkSession, path: str) -> DataFrame:
    """``(file, tree)`` of EUC-KR files: comment lines dropped, lines joined to trees, word/tag turned to tag/word, traces dropped."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The text reader knows no such encoding: files are read whole and decoded in one narrow pass.
        for batch in batches:
            lines = [(f, i, x) for f, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, x in enumerate(b.decode("euc-kr", "replace").splitlines())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in lines], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["file", "line_id", "line"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(decode, "file string, line_id bigint, line string").where("not line like ';;%' and trim(line) <> ''")
    joined = joined_brackets(rows, "file", "line_id", "line").select("file", F.col("joined").alias("tree"))
    swapped = F.regexp_replace("tree", "([^\\s()/]+)/([^\\s()/]+)", "$2/$1")
    return joined.select("file", F.trim(F.regexp_replace(F.regexp_replace(swapped, "\\(?[^\\s()]*\\*[^\\s()]*\\)?", ""), " +", " ")).alias("tree"))


def read_conditional_model(spark: SparkSession, path: str) -> DataFrame:
    """``(id, cond, out, p)`` of lines ``ID cond : out = p``; a line without a colon has no condition."""
    pattern = "^(\\S+) +(?:(.*?) +: +)?(.*?) += +(\\S+)\\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    get = lambda i: F.regexp_extract("value", pattern, i)
    return rows.select(get(1).alias("id"), words_of(get(2)).alias("cond"), words_of(get(3)).alias("out"), get(4).cast("double").alias("p"))


def read_model_dump(spark: SparkSession, path: str, categories: int | None = None) -> DataFrame:
    """``(out, cond, depth, p)`` of lines ``P( o | cond, d ) = p``; with ``categories`` outcomes beyond are dropped."""
    pattern = "P\\( *(\\S+) *\\| *([^,)]*?) *(?:, *(\\d+))? *\\) *= *(\\S+)"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    get = lambda i: F.regexp_extract("value", pattern, i)
    out = rows.select(get(1).alias("out"), get(2).alias("cond"), get(3).try_cast("int").alias("depth"), get(4).cast("double").alias("p"))
    return out if categories is None else out.where(F.coalesce(F.col("out").try_cast("int"), F.lit(0)) <= categories)


def read_dump_tuples(spark: SparkSession, path: str) -> DataFrame:
    """Fields of lines that start with a bracket, quotes removed."""
    rows = spark.read.text(path).where("value like '(%'")
    return rows.select(F.transform(F.split(F.regexp_replace("value", "^\\(|\\)[,;]?\\s*$", ""), ","), lambda x: F.trim(F.regexp_replace(x, "^ *'|' *$", ""))).alias("fields"))


def read_table_with_header(spark: SparkSession, path: str) -> DataFrame:
    """Tab separated table with a header line, gzip or plain."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def read_reports(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``(file, value)``: the number after = in the first line of each file that has the key."""
    rows = read_lines(spark, path).where(F.contains("line", F.lit(key)))
    first = rows.groupBy("file").agg(F.min_by("line", "line_id").alias("line"))
    return first.select("file", F.regexp_extract("line", "= *(-?[0-9.]+)", 1).try_cast("double").alias("value"))


# Writers


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """``word id`` lines sorted by word."""
    dictionary.orderBy("word").select(F.concat_ws(" ", "word", F.col("id").cast("string"))).write.mode("overwrite").text(path)


def distributions(counts: DataFrame, least: float = 1e-6, words: DataFrame | None = None) -> DataFrame:
    """``counts(model, depth, c1, c2, out, cnt)`` normalised, small ones dropped, outcomes replaced by words."""
    keys = ["model", "depth", "c1", "c2"]
    total = counts.groupBy(*keys).agg(F.sum("cnt").alias("total"))
    p = counts.join(total, keys).withColumn("p", F.try_divide(F.col("cnt"), F.col("total"))).where(F.col("p") >= least)
    if words is None:
        return p.select(*keys, F.col("out").cast("string").alias("out"), "p")
    return p.join(words, p.out == words.id).select(*keys, F.col("word").alias("out"), "p")


def append_series(series: DataFrame, path: str) -> None:
    """Metric values, one folder an iteration."""
    series.write.mode("append").partitionBy("iter").parquet(path)


def write_checkpoint(rules: DataFrame, path: str, iteration: int) -> None:
    """Iteration N as ``iter=N``; of older ones only the last is kept."""
    spark = rules.sparkSession
    rules.write.mode("overwrite").parquet(f"{path}/iter={iteration}")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("iter="))
    for old in [i for i in found if i < iteration][:-1]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/iter={old}"), True)


def last_checkpoint(spark: SparkSession, path: str) -> int | None:
    """The last iteration written whole."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("iter=")]
    whole = [int(p.getName().split("=")[1]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p.toString()}/_SUCCESS"))]
    return max(whole, default=None)


def chain_view(chain: DataFrame, rules: list[str]) -> DataFrame:
    """``chain(iter, rule, p)`` with one column for each of the rules listed."""
    return chain.groupBy("iter").pivot("rule", rules).agg(F.first("p"))


def scalar_series(wide: DataFrame, step: str = "iter") -> DataFrame:
    """A wide table as ``(step, name, value)``."""
    names = [c for c in wide.columns if c != step]
    typed = wide.select(step, *(F.col(c).cast("double").alias(c) for c in names))
    return typed.unpivot([step], names, "name", "value").withColumnRenamed(step, "step")


def segments(steps: DataFrame) -> DataFrame:
    """Q14: spans between decisions without fork and join of ``steps(sent_id, pos, f, j)``, and the whole sentence as segment -1."""
    cut = ((F.col("f") == 0) & (F.col("j") == 0)).cast("int")
    group = F.coalesce(F.sum(cut).over(W.partitionBy("sent_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = [F.min("pos").alias("begin"), F.max("pos").alias("end")]
    parts = steps.withColumn("segment", group).groupBy("sent_id", "segment").agg(*ends)
    return parts.unionByName(steps.groupBy("sent_id").agg(*ends).withColumn("segment", F.lit(-1).cast("bigint")))


def gaussian_lines(gaussian: DataFrame) -> DataFrame:
    """``(pos, dim, line)`` of ``gaussian(pos, dim, mean, sd)``; dim -1 is the heading of a tag, and every line has its own heading before it."""
    number = lambda c: F.format_string("%.6f", c.cast("double"))
    value = F.concat(F.lit("P( "), F.col("dim").cast("string"), F.lit(" | POS"), F.col("pos").cast("string"), F.lit(" ) ~ N("), number(F.col("mean")), F.lit(", "), number(F.col("sd")), F.lit(")"))
    head = F.concat(F.lit("## Writing pos_ind="), F.col("pos").cast("string"), F.lit(", dim = "), F.col("dim").cast("string"))
    tags = gaussian.select("pos").distinct().select("pos", F.lit(-1).alias("dim"), F.concat(F.lit("## writing pos_ind="), F.col("pos").cast("string")).alias("line"))
    return tags.unionByName(gaussian.select("pos", F.col("dim").cast("int"), F.concat(head, F.lit("\n"), value).alias("line")))


def write_gaussian(gaussian: DataFrame, path: str) -> None:
    """The lines in order of tag and dimension."""
    gaussian_lines(gaussian).orderBy("pos", "dim").select("line").write.mode("overwrite").text(path)


def read_gaussian(spark: SparkSession, path: str) -> DataFrame:
    """The reverse of S19: ``(pos, dim, mean, sd)``."""
    pattern = r"^P\( (\d+) \| POS(\d+) \) ~ N\((\S+), (\S+)\)$"
    get = lambda i, t: F.regexp_extract("value", pattern, i).cast(t)
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(get(2, "int").alias("pos"), get(1, "int").alias("dim"), get(3, "double").alias("mean"), get(4, "double").alias("sd"))


def write_token_attributes(tokens: DataFrame, path: str) -> None:
    """Tokens ``(seg_id, pos, word, a, b, g, f, j)`` as annotation XML, a segment a row, the state's parts as attributes of its tokens."""
    part = F.struct("pos", *(F.col(c).cast("string").alias(f"_{c}") for c in "abgfj"), F.col("word").alias("_VALUE"))
    segs = tokens.groupBy(F.col("seg_id").cast("string").alias("_id")).agg(F.array_sort(F.collect_list(part)).alias("t"))
    rows = segs.select("_id", F.transform("t", lambda x: F.struct(*(x[f"_{c}"].alias(f"_{c}") for c in "abgfj"), x["_VALUE"].alias("_VALUE"))).alias("TOKEN"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "LTF").option("rowTag", "SEG").save(path)


def write_annotations(spans: DataFrame, path: str) -> None:
    """Spans as annotation XML."""
    rows = spans.select(F.concat_ws("-", F.lit("ann"), F.col("sent_id").cast("string"), F.col("segment").cast("string")).alias("_id"), F.col("begin").alias("_start"), F.col("end").alias("_end"))
    rows.write.mode("overwrite").format("xml").option("rootTag", "ANNOTATIONS").option("rowTag", "ANNOTATION").save(path)


def write_trees(node_table: DataFrame, path: str) -> None:
    """One bracketed tree a line, in order of tree_id."""
    trees.written_trees(node_table).orderBy("tree_id").select("tree").write.mode("overwrite").text(path)


def read_config(text: str) -> dict[str, dict[str, str]]:
    """Sections and values of an INI text."""
    c = configparser.ConfigParser()
    c.read_string(text)
    return {s: dict(c.items(s)) for s in c.sections()}


def config_entries(lines: DataFrame, line: str) -> DataFrame:
    """``key`` and ``value`` of the lines of INI texts that set one; comments, sections and other lines dropped."""
    value = F.col(line)
    rows = lines.where(F.contains(value, F.lit("=")) & ~F.startswith(value, F.lit("#")) & ~F.startswith(value, F.lit("[")))
    return rows.withColumn("key", F.trim(F.split(value, "=")[0])).withColumn("value", F.trim(F.regexp_replace(value, "^[^=]*=", "")))


def config_text(config: dict[str, dict[str, object]]) -> str:
    """The reverse."""
    return "\n".join(f"[{s}]\n" + "".join(f"{k} = {v}\n" for k, v in values.items()) for s, values in config.items())
