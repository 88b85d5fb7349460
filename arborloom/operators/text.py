"""Corpus preparation: projections, filters, dictionary encoding, set operations (P, T, W01, X of the blueprint).

All operators are DataFrame in, DataFrame out; null texts stay null, null arrays have no tokens. Tokens are split at
blanks, tabs and line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborloom.session import small_side, written

BLANK = "[ \t\n\r]+"


def words_of(text: Column) -> Column:
    """Tokens of a text."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, line_no, line)``: the lines of texts that are not blank (P12), numbered from 0 before dropping."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(~F.col("line").rlike("^[ \t\r]*$"))


def tokens(sentences: DataFrame, key: str = "sent_id", words: str = "words") -> DataFrame:
    """``(key, pos, tok)`` from an array column."""
    return sentences.select(key, F.posexplode(words).alias("pos", "tok"))


def fold_case(text: Column) -> Column:
    """If there are at least as many slash pieces as blank pieces, only what follows the slash; else all without a slash."""
    tagged = F.size(F.split(text, "/")) >= F.size(F.split(text, " "))
    after = lambda w: F.concat(F.regexp_extract(w, "^([^/]*/)?", 0), F.lower(F.regexp_replace(w, "^[^/]*/", "")))
    plain = lambda w: F.when(F.instr(w, "/") == 0, F.lower(w)).otherwise(w)
    pieces = F.split(text, " ")
    return F.array_join(F.when(tagged, F.transform(pieces, after)).otherwise(F.transform(pieces, plain)), " ")


def strip_tags(text: Column) -> Column:
    """Words without ``tag/``."""
    return F.regexp_replace(text, "(^| )[^ /]+/", "$1")


def tree_words(tree: Column) -> Column:
    """The words of a bracketed tree."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(tree, "\\([^ ()]*", ""), "\\)", ""), " +", " "))


def tree_tags(tree: Column) -> Column:
    """The labels over words, up to the first dash."""
    return F.array_join(F.transform(F.regexp_extract_all(tree, F.lit("\\(([^ ()]+) [^ ()]+\\)"), F.lit(1)), lambda t: F.split(t, "-")[0]), " ")


def tree_tagwords(tree: Column) -> Column:
    """``tag/word`` of the leaves."""
    leaf = "\\(([^ ()]+) ([^ ()]+)\\)"
    pairs = F.zip_with(
        F.regexp_extract_all(tree, F.lit(leaf), F.lit(1)), F.regexp_extract_all(tree, F.lit(leaf), F.lit(2)), lambda t, w: F.concat(F.split(t, "-")[0], F.lit("/"), w)
    )
    return F.array_join(pairs, " ")


def collapse_numbers(text: Column) -> Column:
    """Words after a slash that have a digit become number_token."""
    return F.regexp_replace(text, "/[^ /]*[0-9][^ /]*", "/number_token")


def wiki_lines(text: Column) -> Column:
    """Encyclopedic text as lines of spaced tokens: no brackets, one sentence a line, numbers apart from labels."""
    t = F.regexp_replace(text, "\\([^()]*\\)|\\[[^\\[\\]]*\\]", "")
    t = F.regexp_replace(t, "\\. +", " .\n")
    t = F.regexp_replace(t, "([0-9])([A-Za-z])", "$1 $2")
    t = F.regexp_replace(t, '([,"])', " $1 ")
    t = F.regexp_replace(t, " +", " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")


#: Signs that bracketed formats reserve, and the names they are written by.
ESCAPES = (
    ("(", "-LRB-"), (")", "-RRB-"), ("<", "-LTB-"), (">", "-RTB-"), ("[", "-LSB-"), ("]", "-RSB-"), ("{", "-LCB-"), ("}", "-RCB-"), ("^", "-CARAT-"), ("_", "-UNDERSCORE-"),
)


def escape_brackets(text: Column) -> Column:
    """Brackets and signs that bracketed formats reserve, by name."""
    for sign, name in ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def escaped(text: str) -> str:
    """P23 on one text, for kernels."""
    for sign, name in ESCAPES:
        text = text.replace(sign, name)
    return text


def right_branching(words: Column) -> Column:
    """``(X (X w1)(X (X w2) ... (X wn)))``."""
    n = F.size(words)
    leaf = lambda w: F.concat(F.lit("(X "), w, F.lit(")"))
    head = F.array_join(F.transform(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), lambda w: F.concat(F.lit("(X "), leaf(w))), "")
    return F.concat(head, leaf(F.element_at(words, -1)), F.repeat(F.lit(")"), n - 1))


def left_branching(words: Column) -> Column:
    """The mirror of P15."""
    n = F.size(words)
    leaf = lambda w: F.concat(F.lit("(X "), w, F.lit(")"))
    tail = F.array_join(F.transform(F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda w: F.concat(leaf(w), F.lit(")"))), "")
    return F.concat(F.repeat(F.lit("(X "), n - 1), leaf(words[0]), tail)


def branching_dependencies(toks: DataFrame, right: bool = True) -> DataFrame:
    """Head of a token is the one before (right) or after it (left); the outermost has ROOT."""
    w = W.partitionBy("sent_id").orderBy("pos")
    head = F.lag("tok").over(w) if right else F.lead("tok").over(w)
    return toks.select("sent_id", "pos", F.col("tok").alias("dependent"), F.coalesce(head, F.lit("ROOT")).alias("head"))


def word_counts(toks: DataFrame) -> DataFrame:
    """A01."""
    return toks.groupBy("tok").agg(F.count("*").alias("cnt"))


def top_words(toks: DataFrame, k: int) -> DataFrame:
    """The k most frequent words; ties by word."""
    return word_counts(toks).orderBy(F.desc("cnt"), "tok").limit(k)


def within_vocabulary(sentences: DataFrame, vocabulary: DataFrame, key: str = "sent_id", words: str = "words") -> DataFrame:
    """P10: sentences all of whose words are in ``vocabulary(tok)``.

    Distinct words of the corpus that are not in it are found once; only sentences with one of those are shuffled out.
    """
    toks = tokens(sentences, key, words).select(key, "tok").distinct()
    out = toks.join(small_side(vocabulary.select("tok").distinct()), "tok", "left_anti").select(key).distinct()
    return sentences.join(out, key, "left_anti")


def rare_to_unknown(toks: DataFrame, threshold: int, unknown: str = "unk") -> DataFrame:
    """Words seen fewer than ``threshold`` times become ``unk``.

    The frequent words are the smaller table: they are joined, broadcast where small; a word in
    every row is no hot key of a shuffle as long as the table is small, beyond it the join is left to adaptive execution.
    """
    frequent = word_counts(toks).where(F.col("cnt") >= threshold).select("tok", F.lit(True).alias("known"))
    return toks.join(small_side(frequent), "tok", "left").withColumn("tok", F.when(F.col("known"), F.col("tok")).otherwise(F.lit(unknown))).drop("known")


def ordered_lists(toks: DataFrame, key: str = "sent_id", value: str = "tok", out: str = "toks") -> DataFrame:
    """Tokens back to one array a sentence, in order."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return toks.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias(out))


def numbered(df: DataFrame, *order: str | Column, out: str = "id", start: int = 1) -> DataFrame:
    """Dense numbers in a global order without a single task: ranges are sorted side by side and offset by the counts before them."""
    local = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
    ranged = written(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), local.alias("_local")), "numbered")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_local") + start).drop("_part", "_local", "_before")


def first_occurrence_dictionary(toks: DataFrame) -> DataFrame:
    """Ids from 1 in order of first occurrence (sent_id, pos)."""
    first = toks.groupBy("tok").agg(F.min(F.struct("sent_id", "pos")).alias("first"))
    return numbered(first, "first").select("tok", F.col("id").cast("bigint"))


def encoded(toks: DataFrame, dictionary: DataFrame, unknown: int | None = None) -> DataFrame:
    """Ids of words; without ``unknown`` words that are not in the dictionary are dropped."""
    found = toks.join(small_side(dictionary), "tok", "inner" if unknown is None else "left")
    return found if unknown is None else found.withColumn("id", F.coalesce("id", F.lit(unknown)))


def joined_until(rows: DataFrame, key: str, order: str, text: str, last: Column) -> DataFrame:
    """Lines of a document joined with blanks until one is ``last``."""
    w = W.partitionBy(key).orderBy(order)
    group = F.coalesce(F.sum(last.cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.withColumn("part", group).groupBy(key, "part").agg(F.array_join(parts, " ").alias("joined"))


def joined_brackets(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Lines joined until as many brackets are closed as were opened."""
    depth = F.length(F.regexp_replace(text, "[^(]", "")) - F.length(F.regexp_replace(text, "[^)]", ""))
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    balanced = rows.withColumn("balance", F.sum(depth).over(w))
    return joined_until(balanced, key, order, text, F.col("balance") == 0)


def dense_counts(df: DataFrame, condition: str, outcome: str) -> DataFrame:
    """Counts of every condition with every outcome, absent pairs with 0.

    Both key sets are value sets (tags, corpora), never row sets.
    """
    counts = df.groupBy(condition, outcome).agg(F.count("*").alias("cnt"))
    keys = counts.select(condition).distinct().crossJoin(counts.select(outcome).distinct())
    return keys.join(counts, [condition, outcome], "left").fillna(0, ["cnt"])


def _ranked(rows: DataFrame, order: str, value: str, out: str, width: int) -> DataFrame:
    """Rank of each row among those of its value, by ``order``: ranges of ``order`` are ranked side by side and offset by the counts before them."""
    ranged = rows.select(F.col(order).alias(out), value, F.floor(F.col(order) / width).alias("range"))
    counts = ranged.groupBy(value, "range").agg(F.count("*").alias("inside"))
    before = F.coalesce(F.sum("inside").over(W.partitionBy(value).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy(value, "range").orderBy(out))
    return ranged.withColumn("within", within).join(counts.withColumn("before", before), [value, "range"]).select(out, value, (F.col("before") + F.col("within")).alias("rank"))


def in_reference_order(rows: DataFrame, reference: DataFrame, order: str, value: str, width: int = 1_000_000) -> DataFrame:
    """Each row with the reference row of the same value and the same rank among its equals.

    ``order`` is a number; a frequent value is ranked in ranges of ``width`` numbers and joined by value and rank, so it is in no single task.
    """
    return _ranked(rows, order, value, "row_order", width).join(_ranked(reference, order, value, "ref_order", width), [value, "rank"])


def leftovers(rows: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """Values of which one side has more: ``(value, n_rows, n_ref)``; a reference queue used up in order leaves none."""
    a = rows.groupBy(value).agg(F.count("*").alias("n_rows"))
    b = reference.groupBy(value).agg(F.count("*").alias("n_ref"))
    return a.join(b, value, "full").fillna(0, ["n_rows", "n_ref"]).where("n_rows <> n_ref")


#: Signs of page junk and of equations in trees.
JUNK, EQUATION = ("(?i)redirect", "ARTICLE"), ("Equation", "#)")


def shallow_tree(tree: Column, depth: int) -> Column:
    """Whether a tree with depth-tagged labels goes to embedding depth 1 or 2 only and is no page junk."""
    fits = ~tree.rlike("-d[3-4]") & ~tree.rlike(JUNK[0]) & ~F.contains(tree, F.lit(JUNK[1]))
    if depth == 1:
        return fits & F.contains(tree, F.lit("-d2")) & ~F.contains(tree, F.lit("d2 ("))
    return fits & ~F.contains(tree, F.lit(EQUATION[0])) & ~F.contains(tree, F.lit(EQUATION[1]))


def tag_morphs(form: Column, lemma: Column, tag: Column) -> Column:
    """P20: ``tag/word`` of a token; a lemma of several morphs joined by plus signs gives one for each, with the tag of the same place.

    Further tags are not used, a morph without a tag has an empty one; empty morphs at the end are dropped. Null lemma: ``tag/form``.
    """
    morphs = F.split(F.regexp_replace(lemma, "\\++$", ""), "\\+")
    tags = F.split(tag, "\\+")
    pairs = F.transform(morphs, lambda m, i: F.concat(F.coalesce(F.get(tags, i), F.lit("")), F.lit("/"), m))
    return F.when(F.contains(lemma, F.lit("+")), pairs).otherwise(F.array(F.concat(tag, F.lit("/"), form)))


def expand_morphs(tree: Column) -> Column:
    """A leaf ``a/T1+b/T2`` becomes the preterminals ``(T1 a) (T2 b)``, a leaf ``a/T`` one; a leaf with a part without a tag stays.

    Works leaf by leaf, whatever their length; the last slash of a part divides word and tag. Blanks between brackets are brought to one form.
    """
    pieces = F.regexp_extract_all(tree, F.lit("[()]|[^\\s()]+"), F.lit(0))
    tagged = lambda m: m.rlike("^.+/[^/]+$")
    one = lambda m: F.regexp_replace(m, "^(.+)/([^/]+)$", "($2 $1)")
    morphs = lambda x: F.split(x, "\\+")
    label = lambda i: (i > 0) & (F.get(pieces, i - 1) == "(")
    made = lambda x, i: F.when(~label(i) & F.forall(morphs(x), tagged), F.array_join(F.transform(morphs(x), one), " ")).otherwise(x)
    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(pieces, made), " "), "\\( ", "("), " \\)", ")")


def state_stream(text: Column, what: str) -> Column:
    """The POS, ACT or AWA values of a state sequence."""
    return F.array_join(F.regexp_extract_all(text, F.lit(f"({what}\\d+)"), F.lit(1)), " ")


def code_places(html: Column) -> Column:
    """``code place`` pairs of two-cell table rows whose first cell holds codes with a colon; several places by semicolon."""
    cells = "<td[^>]*>\\s*((?:[a-z-]+\\|)*[a-z-]+):\\s*</td>\\s*<td[^>]*>([^<]+)</td>"
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(cells), F.lit(1)).alias("c"), F.regexp_extract_all(html, F.lit(cells), F.lit(2)).alias("p"))
    each = lambda x: F.flatten(F.transform(F.split(x["c"], "\\|"), lambda c: F.transform(F.split(x["p"], " *[;/] *"), lambda p: F.struct(c.alias("code"), F.trim(p).alias("place")))))
    return F.flatten(F.transform(pairs, each))
