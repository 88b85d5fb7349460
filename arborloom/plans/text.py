"""Queries of corpus preparation, each with its SQL twin."""

from pyspark.sql import functions as F

from arborloom.operators import text as t
from arborloom.plans import query
from arborloom.plans.base import CT, EV, EVT, LN, PAIR, TOK, TW, conll, doc_lines, int_sentences, int_tokens, word_sentences, word_tags, word_tokens
from arborloom.session import read_table


@query("doc_lines", f"WITH {LN} SELECT doc_id, line_no, CAST(length(line) AS INTEGER) AS n FROM ln")
def q_doc_lines(spark, sf):
    """Lines of documents that are not blank."""
    return doc_lines(spark, sf).select("doc_id", "line_no", F.length("line").alias("n"))


@query("corpus_stats", f"""WITH {EV}, x AS (SELECT corpus, sent_id, len(toks) AS n, unnest(toks) AS tok FROM ev)
  SELECT corpus, count(DISTINCT sent_id) AS n_sents, count(*) AS n_tokens, CAST(max(n) AS INTEGER) AS max_len, count(DISTINCT tok) AS vocabulary FROM x GROUP BY corpus""")
def q_corpus_stats(spark, sf):
    """Sentences, tokens, longest sentence and vocabulary of each corpus."""
    ev = int_sentences(spark, sf)
    size = ev.groupBy("corpus").agg(F.count("*").alias("n_sents"), F.sum(F.size("toks")).alias("n_tokens"), F.max(F.size("toks")).alias("max_len"))
    kinds = ev.select("corpus", F.explode("toks").alias("tok")).distinct().groupBy("corpus").agg(F.count("*").alias("vocabulary"))
    return size.join(kinds, size.corpus.eqNullSafe(kinds.corpus)).drop(kinds.corpus)


_FOLD = """CASE WHEN len(string_split({s}, '/')) >= len(string_split({s}, ' '))
    THEN array_to_string(list_transform(string_split({s}, ' '), lambda p: CASE WHEN contains(p, '/') THEN p[:instr(p, '/')] || lower(p[instr(p, '/') + 1:]) ELSE lower(p) END), ' ')
    ELSE array_to_string(list_transform(string_split({s}, ' '), lambda p: CASE WHEN contains(p, '/') THEN p ELSE lower(p) END), ' ') END"""


@query("lowercase_words", f"WITH {TW}, j AS (SELECT sent_id, array_to_string(words, ' ') AS s FROM tw) SELECT sent_id, {_FOLD.format(s='s')} AS folded FROM j")
def q_lowercase_words(spark, sf):
    """P01 on sentences of words, some of which have a slash or a blank."""
    return word_sentences(spark, sf).select("sent_id", t.fold_case(F.array_join("words", " ")).alias("folded"))


@query("lowercase_tagwords", f"WITH {PAIR}, j AS (SELECT sent_id, pos, tag || '/' || word AS s FROM pr) SELECT sent_id, pos, {_FOLD.format(s='s')} AS folded FROM j")
def q_lowercase_tagwords(spark, sf):
    """P01 on tag/word tokens."""
    return word_tags(spark, sf).select("sent_id", "pos", t.fold_case(F.concat("tag", F.lit("/"), "word")).alias("folded"))


@query("strip_tags", f"WITH {PAIR} SELECT sent_id, pos, regexp_replace(tag || '/' || word, '(^| )[^ /]+/', '\\1', 'g') AS stripped FROM pr")
def q_strip_tags(spark, sf):
    """P02."""
    return word_tags(spark, sf).select("sent_id", "pos", t.strip_tags(F.concat("tag", F.lit("/"), "word")).alias("stripped"))


@query("number_collapse", f"""WITH {PAIR} SELECT sent_id, pos, regexp_replace(tag || '/' || word, '/[^ /]*[0-9][^ /]*', '/number_token', 'g') AS collapsed FROM pr""")
def q_number_collapse(spark, sf):
    """P06."""
    return word_tags(spark, sf).select("sent_id", "pos", t.collapse_numbers(F.concat("tag", F.lit("/"), "word")).alias("collapsed"))


for _name, _cond, _what in (("len_max20", "n <= 20", "P07"), ("len_min3", "n >= 3", "P08"), ("len_gt3", "n > 3", "P08, second rule")):

    def _by_length(spark, sf, cond=_cond):
        return int_sentences(spark, sf).select("sent_id", F.size("toks").alias("n")).where(cond)

    _by_length.__doc__ = f"{_what}: sentences by length."
    query(_name, f"WITH {EV} SELECT sent_id, CAST(len(toks) AS INTEGER) AS n FROM ev WHERE {_cond.replace('n ', 'len(toks) ')}")(_by_length)


@query("conll_length_band", f"WITH {CT} SELECT sent_id, max(tok_id) AS n FROM ct GROUP BY sent_id HAVING max(tok_id) BETWEEN 3 AND 15")
def q_conll_length_band(spark, sf):
    """Sentences whose last token id is in a band."""
    return conll(spark, sf).groupBy("sent_id").agg(F.max("tok_id").alias("n")).where("n between 3 and 15")


@query("vocab_top1000", f"WITH {TOK} SELECT tok, count(*) AS cnt FROM tok GROUP BY tok ORDER BY cnt DESC, tok LIMIT 1000")
def q_vocab_top1000(spark, sf):
    """The 1000 most frequent words."""
    return t.top_words(word_tokens(spark, sf), 1000)


@query("vocab_filter", f"""WITH {TOK}, v AS (SELECT tok FROM tok GROUP BY tok ORDER BY count(*) DESC, tok LIMIT 1000)
  SELECT sent_id, CAST(len(words) AS INTEGER) AS n FROM tw WHERE sent_id NOT IN (SELECT sent_id FROM tok WHERE tok NOT IN (SELECT tok FROM v))""")
def q_vocab_filter(spark, sf):
    """Sentences all of whose words are in the vocabulary."""
    kept = t.within_vocabulary(word_sentences(spark, sf), t.top_words(word_tokens(spark, sf), 1000))
    return kept.select("sent_id", F.size("words").alias("n"))


@query("rare_to_unk", f"""WITH {TOK}, c AS (SELECT tok, count(*) AS cnt FROM tok GROUP BY tok)
  SELECT sent_id, list(CASE WHEN cnt < 2 THEN 'unk' ELSE tok.tok END ORDER BY pos) AS toks FROM tok JOIN c ON c.tok = tok.tok GROUP BY sent_id""")
def q_rare_to_unk(spark, sf):
    """P32 with threshold 2."""
    return t.ordered_lists(t.rare_to_unknown(word_tokens(spark, sf), 2))


_DICT = f"WITH {TOK}, f AS (SELECT tok, min({{'s': sent_id, 'p': pos}}) AS first FROM tok GROUP BY tok), d AS (SELECT tok, row_number() OVER (ORDER BY first) AS id FROM f)"


@query("dict_table", _DICT + " SELECT tok, id FROM d")
def q_dict_table(spark, sf):
    """Ids in order of first occurrence."""
    return t.first_occurrence_dictionary(word_tokens(spark, sf))


@query("dict_encode", _DICT + " SELECT sent_id, list(id ORDER BY pos) AS ids FROM tok JOIN d ON d.tok = tok.tok GROUP BY sent_id")
def q_dict_encode(spark, sf):
    """Sentences as ids."""
    toks = word_tokens(spark, sf)
    return t.ordered_lists(t.encoded(toks, t.first_occurrence_dictionary(toks)), value="id", out="ids")


@query("encode_unk", f"""WITH {TOK}, v AS (SELECT tok FROM tok GROUP BY tok HAVING count(*) >= 2), d AS (SELECT word AS tok, min(id) AS id FROM word_dict JOIN v ON v.tok = word GROUP BY word)
  SELECT sent_id, list(coalesce(d.id, 0) ORDER BY pos) AS ids FROM tok LEFT JOIN d ON d.tok = tok.tok GROUP BY sent_id""")
def q_encode_unk(spark, sf):
    """Ids from the dictionary of the words seen twice and more; others are 0."""
    toks = word_tokens(spark, sf)
    seen = t.word_counts(toks).where("cnt >= 2").select("tok")
    known = read_table(spark, sf, "word_dict").where("word <> ''").groupBy(F.col("word").alias("tok")).agg(F.min("id").alias("id")).join(seen, "tok", "left_semi")
    return t.ordered_lists(t.encoded(toks, known, unknown=0), value="id", out="ids")


@query("word_freq_sorted", f"WITH {EVT} SELECT tok, count(*) AS cnt FROM evt WHERE tok IS NOT NULL GROUP BY tok")
def q_word_freq_sorted(spark, sf):
    """Token frequencies, ascending."""
    return int_tokens(spark, sf).where("tok is not null").groupBy("tok").agg(F.count("*").alias("cnt")).orderBy("cnt", "tok")


@query("corpora_union", f"""WITH {EV}, {TW}, u AS (SELECT 'ints' AS kind, corpus, len(toks) AS n FROM ev UNION ALL SELECT 'words', corpus, len(words) FROM tw)
  SELECT kind, corpus, count(*) AS n_sents, CAST(sum(n) AS BIGINT) AS n_tokens FROM u GROUP BY kind, corpus""")
def q_corpora_union(spark, sf):
    """X01."""
    a = int_sentences(spark, sf).select(F.lit("ints").alias("kind"), "corpus", F.size("toks").alias("n"))
    b = word_sentences(spark, sf).select(F.lit("words").alias("kind"), "corpus", F.size("words").alias("n"))
    return a.unionByName(b).groupBy("kind", "corpus").agg(F.count("*").alias("n_sents"), F.sum("n").alias("n_tokens"))


@query("shuffle_head", f"WITH {EV} SELECT sent_id FROM ev ORDER BY md5(CAST(sent_id AS VARCHAR)), sent_id LIMIT 5000")
def q_shuffle_head(spark, sf):
    """The first 5000 of a reproducible shuffle."""
    return int_sentences(spark, sf).select("sent_id").orderBy(F.md5(F.col("sent_id").cast("string")), "sent_id").limit(5000)


@query("first_lines", f"WITH {LN} SELECT doc_id, line_no, line FROM ln ORDER BY doc_id, line_no LIMIT 100")
def q_first_lines(spark, sf):
    """The first 100 lines."""
    return doc_lines(spark, sf).orderBy("doc_id", "line_no").limit(100)


@query("rb_brackets", f"""WITH {TW} SELECT sent_id, array_to_string(list_transform(words[:-2], lambda w: '(X (X ' || w || ')'), '') || '(X ' || words[-1] || ')' || repeat(')', len(words) - 1) AS tree
  FROM tw WHERE len(words) > 0""")
def q_rb_brackets(spark, sf):
    """P15, R15."""
    return word_sentences(spark, sf).where("size(words) > 0").select("sent_id", t.right_branching(F.col("words")).alias("tree"))


@query("lb_brackets", f"""WITH {TW} SELECT sent_id, repeat('(X ', len(words) - 1) || '(X ' || words[1] || ')' || array_to_string(list_transform(words[2:], lambda w: '(X ' || w || '))'), '') AS tree
  FROM tw WHERE len(words) > 0""")
def q_lb_brackets(spark, sf):
    """P16."""
    return word_sentences(spark, sf).where("size(words) > 0").select("sent_id", t.left_branching(F.col("words")).alias("tree"))


@query("rb_deps", f"WITH {TOK} SELECT sent_id, pos, tok AS dependent, coalesce(lag(tok) OVER (PARTITION BY sent_id ORDER BY pos), 'ROOT') AS head FROM tok")
def q_rb_deps(spark, sf):
    """P17, W02."""
    return t.branching_dependencies(word_tokens(spark, sf))


@query("lb_deps", f"WITH {TOK} SELECT sent_id, pos, tok AS dependent, coalesce(lead(tok) OVER (PARTITION BY sent_id ORDER BY pos), 'ROOT') AS head FROM tok")
def q_lb_deps(spark, sf):
    """P18, W02."""
    return t.branching_dependencies(word_tokens(spark, sf), right=False)


@query("conll_words", f"WITH {CT} SELECT sent_id, list(form ORDER BY tok_id) AS words, list(coalesce(tag, 'UNK') ORDER BY tok_id) AS tags FROM ct WHERE form IS NOT NULL GROUP BY sent_id")
def q_conll_words(spark, sf):
    """Token rows as sentences."""
    rows = conll(spark, sf).where("form is not null").select("sent_id", "tok_id", "form", F.coalesce("tag", F.lit("UNK")).alias("tag"))
    s = rows.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("tok_id", "form", "tag"))).alias("s"))
    return s.select("sent_id", F.col("s.form").alias("words"), F.col("s.tag").alias("tags"))


@query("morph_split", f"""WITH {CT}, m AS (SELECT sent_id, tok_id, form, replace(coalesce(lemma, form), '-', '+') AS lemma, tag || '+X+' || tag AS tags FROM ct WHERE form IS NOT NULL AND tag IS NOT NULL),
  p AS (SELECT sent_id, tok_id, CASE WHEN contains(lemma, '+') THEN list_transform(string_split(regexp_replace(lemma, '\\++$', ''), '+'), lambda w, i: coalesce(string_split(tags, '+')[i], '') || '/' || w) ELSE [tags || '/' || form] END AS t FROM m)
  SELECT sent_id, tok_id, CAST(unnest(range(len(t))) AS INTEGER) AS part_no, unnest(t) AS tagword FROM p""")
def q_morph_split(spark, sf):
    """P20: a lemma of several morphs gives several tag/word pairs; hyphens of lemmas stand for the plus signs that few of these have."""
    rows = conll(spark, sf).where("form is not null and tag is not null")
    lemma, tags = F.replace(F.coalesce("lemma", "form"), F.lit("-"), F.lit("+")), F.concat("tag", F.lit("+X+"), "tag")
    return rows.select("sent_id", "tok_id", F.posexplode(t.tag_morphs(F.col("form"), lemma, tags)).alias("part_no", "tagword"))


@query("expand_morphs", f"""WITH {PAIR}, w AS (SELECT sent_id, pos, tag, word FROM pr WHERE NOT regexp_matches(word, '[()/+\\s]') AND NOT regexp_matches(tag, '[()/+\\s]') AND tag <> '')
  SELECT sent_id, pos, '(NP (' || tag || ' ' || word || ') (' || tag || 'S ' || word || 'x) (' || tag || ' ' || word || '))' AS tree FROM w""")
def q_expand_morphs(spark, sf):
    """Leaves of two morphs and of one, made from every word that has no reserved sign."""
    w = word_tags(spark, sf).where(~F.col("word").rlike("[()/+\\s]") & ~F.col("tag").rlike("[()/+\\s]") & (F.col("tag") != ""))
    leaf = F.concat(F.lit("(NP "), "word", F.lit("/"), "tag", F.lit("+"), "word", F.lit("x/"), "tag", F.lit("S "), "word", F.lit("/"), "tag", F.lit(")"))
    return w.select("sent_id", "pos", t.expand_morphs(leaf).alias("tree"))


@query("paste_columns", f"""WITH {TOK}, {CT}, f AS (SELECT sent_id, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY tok_id) - 1 AS INTEGER) AS pos, form FROM ct)
  SELECT tok.sent_id, tok.pos, tok.tok, f.form FROM tok JOIN f ON f.sent_id = tok.sent_id AND f.pos = tok.pos""")
def q_paste_columns(spark, sf):
    """Two tables put side by side by sentence and position."""
    from pyspark.sql import Window as W

    rank = (F.row_number().over(W.partitionBy("sent_id").orderBy("tok_id")) - 1).alias("pos")
    return word_tokens(spark, sf).select("sent_id", "pos", "tok").join(conll(spark, sf).select("sent_id", rank, "form"), ["sent_id", "pos"])


@query("ref_semi", f"WITH {TOK} SELECT DISTINCT tok FROM tok WHERE tok IN (SELECT form FROM conll_tokens)")
def q_ref_semi(spark, sf):
    """J04."""
    forms = read_table(spark, sf, "conll_tokens").select(F.col("form").alias("tok")).distinct()
    return word_tokens(spark, sf).select("tok").distinct().join(forms, "tok", "left_semi")


@query("ref_anti", f"WITH {TOK} SELECT DISTINCT tok FROM tok WHERE tok NOT IN (SELECT form FROM conll_tokens WHERE form IS NOT NULL)")
def q_ref_anti(spark, sf):
    """J05, X04."""
    forms = read_table(spark, sf, "conll_tokens").select(F.col("form").alias("tok")).distinct()
    return word_tokens(spark, sf).select("tok").distinct().join(forms, "tok", "left_anti")


@query("ref_ordered", f"""WITH {TOK}, {CT},
  a AS (SELECT sent_id * 1000 + pos AS o, tok AS v FROM tok), b AS (SELECT sent_id * 1000 + tok_id AS o, form AS v FROM ct WHERE form IS NOT NULL),
  ra AS (SELECT o, v, row_number() OVER (PARTITION BY v ORDER BY o) AS r FROM a), rb AS (SELECT o, v, row_number() OVER (PARTITION BY v ORDER BY o) AS r FROM b)
  SELECT ra.o AS row_order, ra.v AS v, CAST(ra.r AS INTEGER) AS rank, rb.o AS ref_order FROM ra JOIN rb ON ra.v = rb.v AND ra.r = rb.r""")
def q_ref_ordered(spark, sf):
    """The n-th occurrence of a word with the n-th in the reference."""
    a = word_tokens(spark, sf).select((F.col("sent_id") * 1000 + F.col("pos")).alias("o"), F.col("tok").alias("v"))
    b = conll(spark, sf).where("form is not null").select((F.col("sent_id") * 1000 + F.col("tok_id")).alias("o"), F.col("form").alias("v"))
    return t.in_reference_order(a, b, "o", "v").select("row_order", "v", F.col("rank").cast("int").alias("rank"), "ref_order")


@query("ref_leftovers", f"""WITH {TOK}, {CT}, a AS (SELECT tok AS v, count(*) AS n FROM tok GROUP BY tok), b AS (SELECT form AS v, count(*) AS m FROM ct WHERE form IS NOT NULL GROUP BY form)
  SELECT coalesce(a.v, b.v) AS v, coalesce(n, 0) AS n_rows, coalesce(m, 0) AS n_ref FROM a FULL JOIN b ON a.v = b.v WHERE coalesce(n, 0) <> coalesce(m, 0)""")
def q_ref_leftovers(spark, sf):
    """Words that one side has more often, which an ordered reference would report as an error."""
    a = word_tokens(spark, sf).select(F.col("tok").alias("v"))
    return t.leftovers(a, conll(spark, sf).where("form is not null").select(F.col("form").alias("v")), "v")


@query("word_links", """SELECT w.tag, count(*) AS n_tokens, count(DISTINCT d.id) AS n_ids FROM (SELECT DISTINCT sent_id, tok_id, form, tag FROM conll_tokens) w
  JOIN (SELECT DISTINCT id, word FROM word_dict) d ON d.word = w.form JOIN (SELECT DISTINCT id FROM word_vectors) v ON v.id = d.id GROUP BY w.tag""")
def q_word_links(spark, sf):
    """Chained inner joins, token to word to vector."""
    vectors = read_table(spark, sf, "word_vectors").select("id").distinct()
    known = read_table(spark, sf, "word_dict").select("id", F.col("word").alias("form")).distinct().join(vectors, "id")
    # Tokens are counted by form and tag first: a frequent word is one row of the join.
    toks = read_table(spark, sf, "conll_tokens").select("sent_id", "tok_id", "form", "tag").distinct().groupBy("form", "tag").agg(F.count("*").alias("c"))
    return toks.join(known, "form").groupBy("tag").agg(F.sum("c").alias("n_tokens"), F.countDistinct("id").alias("n_ids"))


@query("top_words_per_tag", f"""WITH {PAIR}, c AS (SELECT tag, word, count(*) AS cnt FROM pr GROUP BY tag, word)
  SELECT tag, word, cnt, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY cnt DESC, word) AS r FROM c) WHERE r <= 10""")
def q_top_words_per_tag(spark, sf):
    """T02."""
    from pyspark.sql import Window as W

    c = word_tags(spark, sf).groupBy("tag", "word").agg(F.count("*").alias("cnt"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("tag").orderBy(F.desc("cnt"), "word"))).where("rank <= 10")


@query("top_probs_per_tag", f"""WITH {PAIR}, c AS (SELECT tag, word, count(*) AS cnt FROM pr GROUP BY tag, word), p AS (SELECT tag, word, cnt / sum(cnt) OVER (PARTITION BY tag) AS p FROM c)
  SELECT tag, word, round(p, 6) AS p, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY p DESC, word) AS r FROM p) WHERE r <= 20""")
def q_top_probs_per_tag(spark, sf):
    """T03."""
    from pyspark.sql import Window as W

    c = word_tags(spark, sf).groupBy("tag", "word").agg(F.count("*").alias("cnt"))
    totals = c.groupBy("tag").agg(F.sum("cnt").alias("total"))
    ranked = c.withColumn("rank", F.row_number().over(W.partitionBy("tag").orderBy(F.desc("cnt"), "word"))).where("rank <= 20")
    return ranked.join(totals, "tag").select("tag", "word", F.round(F.col("cnt") / F.col("total"), 6).alias("p"), "rank")


@query("wiki_normalise", """WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g'), '\\. +', ' .' || chr(10), 'g'),
    '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([,"])', ' \\1 ', 'g'), ' +', ' ', 'g') AS x FROM documents WHERE source = 'wiki' AND text IS NOT NULL),
  b AS (SELECT doc_id, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS l FROM a)
  SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS line FROM b""")
def q_wiki_normalise(spark, sf):
    """P14 over the encyclopedic documents."""
    wiki = read_table(spark, sf, "documents").where("source = 'wiki' and text is not null")
    return wiki.select("doc_id", F.posexplode(t.wiki_lines(F.col("text"))).alias("line_no", "line"))


@query("escape_brackets", f"""WITH {TOK} SELECT sent_id, pos, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(tok,
  '(', '-LRB-'), ')', '-RRB-'), '<', '-LTB-'), '>', '-RTB-'), '[', '-LSB-'), ']', '-RSB-'), '{{', '-LCB-'), '}}', '-RCB-'), '^', '-CARAT-'), '_', '-UNDERSCORE-') AS escaped FROM tok""")
def q_escape_brackets(spark, sf):
    """P23."""
    return word_tokens(spark, sf).select("sent_id", "pos", t.escape_brackets(F.col("tok")).alias("escaped"))


@query("sentence_joiner", f"""WITH {LN}, g AS (SELECT doc_id, line_no, line, coalesce(sum(CASE WHEN regexp_matches(line, '\\.[ \\t\\r]*$') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM ln)
  SELECT doc_id, CAST(part AS BIGINT) AS part, string_agg(line, ' ' ORDER BY line_no) AS joined FROM g GROUP BY doc_id, part""")
def q_sentence_joiner(spark, sf):
    """Lines joined until one ends with a period."""
    return t.joined_until(doc_lines(spark, sf), "doc_id", "line_no", "line", F.col("line").rlike("\\.[ \t\r]*$"))


@query("bracket_joiner", f"""WITH {LN}, t AS (SELECT ln.doc_id, line_no, line FROM ln JOIN documents d ON d.doc_id = ln.doc_id WHERE d.fmt = 'linetrees'),
  b AS (SELECT *, sum(length(regexp_replace(line, '[^(]', '', 'g')) - length(regexp_replace(line, '[^)]', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY line_no) AS balance FROM t),
  g AS (SELECT *, coalesce(sum(CASE WHEN balance = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM b)
  SELECT doc_id, CAST(part AS BIGINT) AS part, string_agg(line, ' ' ORDER BY line_no) AS joined FROM g GROUP BY doc_id, part""")
def q_bracket_joiner(spark, sf):
    """Tree lines joined until brackets balance."""
    trees = read_table(spark, sf, "documents").where("fmt = 'linetrees'")
    return t.joined_brackets(t.lines(trees), "doc_id", "line_no", "line")


@query("common_words", f"""WITH {TOK}, a AS (SELECT tok, count(*) AS n FROM tok GROUP BY tok), b AS (SELECT form AS tok, count(*) AS n FROM (SELECT DISTINCT sent_id, tok_id, form FROM conll_tokens) GROUP BY form)
  SELECT a.tok, least(a.n, b.n) AS cnt FROM a JOIN b ON a.tok = b.tok""")
def q_common_words(spark, sf):
    """Multiset intersection by counts."""
    a = t.word_counts(word_tokens(spark, sf))
    b = read_table(spark, sf, "conll_tokens").select("sent_id", "tok_id", F.col("form").alias("tok")).distinct().groupBy("tok").agg(F.count("*").alias("m"))
    return a.join(b, "tok").select("tok", F.least("cnt", "m").alias("cnt"))


@query("dense_completion", f"""WITH {PAIR}, c AS (SELECT corpus, tag, count(*) AS cnt FROM pr WHERE corpus IS NOT NULL GROUP BY corpus, tag),
  k AS (SELECT DISTINCT a.corpus, b.tag FROM c a CROSS JOIN c b) SELECT k.corpus, k.tag, coalesce(c.cnt, 0) AS cnt FROM k LEFT JOIN c ON c.corpus = k.corpus AND c.tag = k.tag""")
def q_dense_completion(spark, sf):
    """X06, X07."""
    return t.dense_counts(word_tags(spark, sf).where("corpus is not null"), "corpus", "tag")


@query("grid_cross", """SELECT a.a AS startabp, CAST(b.b AS INTEGER) AS depth, c.c AS alpha FROM (SELECT unnest([4, 8, 15]) AS a) a CROSS JOIN (SELECT unnest(range(1, 4)) AS b) b
  CROSS JOIN (SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS c) c""")
def q_grid_cross(spark, sf):
    """A grid of parameters, exploded from literals."""
    row = spark.range(1).select(F.explode(F.array(*map(F.lit, (4, 8, 15)))).alias("startabp"))
    row = row.select("startabp", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("depth"))
    return row.select("startabp", "depth", F.explode(F.array(*map(F.lit, (0.1, 0.5, 1.0)))).alias("alpha"))


@query("next_tokens", f"WITH {EVT} SELECT sent_id, pos, tok, coalesce(lead(tok) OVER (PARTITION BY sent_id ORDER BY pos), -1) AS target FROM evt")
def q_next_tokens(spark, sf):
    """Next-token targets; -1 at the end."""
    from pyspark.sql import Window as W

    return int_tokens(spark, sf).select("sent_id", "pos", "tok", F.coalesce(F.lead("tok").over(W.partitionBy("sent_id").orderBy("pos")), F.lit(-1)).alias("target"))


@query("length_buckets", f"WITH {EV} SELECT CAST(len(toks) AS INTEGER) AS n, count(*) AS n_sents FROM ev GROUP BY len(toks)")
def q_length_buckets(spark, sf):
    """Sentences by length."""
    return int_sentences(spark, sf).groupBy(F.size("toks").alias("n")).agg(F.count("*").alias("n_sents"))


@query("matrix_rows", f"""WITH {EVT} SELECT sent_id, pos, tok + 1 AS col FROM evt WHERE tok IS NOT NULL UNION ALL SELECT sent_id, CAST(len(toks) AS INTEGER), 1 FROM ev""")
def q_matrix_rows(spark, sf):
    """One row a token, shifted by 1, and a separator row of 1 after each sentence."""
    toks = int_tokens(spark, sf).where("tok is not null").select("sent_id", "pos", (F.col("tok") + 1).alias("col"))
    ends = int_sentences(spark, sf).select("sent_id", F.size("toks").alias("pos"), F.lit(1).alias("col"))
    return toks.unionByName(ends)


@query("prune_short", f"WITH {EV}, k AS (SELECT sent_id, len(toks) AS n FROM ev WHERE len(toks) > 2) SELECT sent_id, row_number() OVER (ORDER BY sent_id) AS new_id FROM k")
def q_prune_short(spark, sf):
    """Rows dropped by a condition and the rest numbered again."""
    kept = int_sentences(spark, sf).where("size(toks) > 2").select("sent_id")
    return t.numbered(kept, "sent_id", out="new_id").select("sent_id", F.col("new_id").cast("bigint"))


@query("cumulative_lengths", f"WITH {EV} SELECT corpus, sent_id, CAST(sum(len(toks)) OVER (PARTITION BY corpus ORDER BY sent_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM ev WHERE corpus IS NOT NULL")
def q_cumulative_lengths(spark, sf):
    """Running token count of each corpus; ranges of sent_id are summed first, so no corpus is sorted in one task."""
    from pyspark.sql import Window as W

    ev = int_sentences(spark, sf).where("corpus is not null").select("corpus", "sent_id", F.size("toks").alias("n"), F.floor(F.col("sent_id") / 4096).alias("block"))
    sums = ev.groupBy("corpus", "block").agg(F.sum("n").alias("inside"))
    before = F.coalesce(F.sum("inside").over(W.partitionBy("corpus").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("n").over(W.partitionBy("corpus", "block").orderBy("sent_id"))
    return ev.withColumn("within", within).join(sums.withColumn("before", before), ["corpus", "block"]).select("corpus", "sent_id", (F.col("before") + F.col("within")).alias("upto"))
