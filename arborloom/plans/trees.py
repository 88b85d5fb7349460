"""Queries over the bracketed trees among the documents and over branching baselines of sentences."""

from pyspark.sql import functions as F

from arborloom.operators import metrics, trees
from arborloom.operators import text as t
from arborloom.plans import query
from arborloom.plans.base import CT, LN, TOK, conll, word_sentences
from arborloom.session import read_table

_TREES = LN + """, tr AS (SELECT ln.doc_id * 100000 + line_no AS tree_id, line AS tree FROM ln JOIN (SELECT doc_id, fmt FROM documents) d ON d.doc_id = ln.doc_id
  WHERE d.fmt = 'linetrees' AND starts_with(line, '(')),
tk AS (SELECT tree_id, tree, regexp_extract_all(tree, '[()]|[^\\s()]+') AS l FROM tr),
bal AS (SELECT tree_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM tk),
run AS (SELECT *, sum(CASE x WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY tree_id ORDER BY i) AS d, lag(x) OVER (PARTITION BY tree_id ORDER BY i) AS before,
  lead(x) OVER (PARTITION BY tree_id ORDER BY i) AS after FROM bal),
ok AS (SELECT tree_id FROM run GROUP BY tree_id HAVING arg_max(d, i) = 0 AND min(CASE WHEN i < (SELECT 1) THEN 1 ELSE d END) >= 0 AND count(*) FILTER (WHERE d = 0 AND x <> ')') = 0 AND count(*) FILTER (WHERE d = 0) = 1)"""


#: Nodes of balanced trees: brackets matched by level, leaves counted, parents the last open bracket one level up.
_NODES = _TREES + """, tt AS (SELECT run.* FROM run JOIN ok ON ok.tree_id = run.tree_id),
br AS (SELECT tree_id, i, x, lv, lead(i) OVER (PARTITION BY tree_id, lv ORDER BY i) AS e FROM (SELECT tree_id, i, x, CASE x WHEN '(' THEN d ELSE d + 1 END AS lv FROM tt WHERE x IN ('(', ')'))),
lf AS (SELECT tree_id, i, x AS word, row_number() OVER (PARTITION BY tree_id ORDER BY i) - 1 AS k FROM tt WHERE x NOT IN ('(', ')') AND before <> '('),
op AS (SELECT br.tree_id, br.i, br.e, br.lv AS depth, la.x AS label, lf.word, row_number() OVER (PARTITION BY br.tree_id ORDER BY br.i) - 1 AS node_id
  FROM br JOIN tt la ON la.tree_id = br.tree_id AND la.i = br.i + 1 LEFT JOIN lf ON lf.tree_id = br.tree_id AND lf.i = br.i + 2 WHERE br.x = '('),
nd AS (SELECT op.*, (SELECT min(k) FROM lf WHERE lf.tree_id = op.tree_id AND lf.i > op.i) AS l, (SELECT max(k) FROM lf WHERE lf.tree_id = op.tree_id AND lf.i < op.e) AS r, up.node_id AS parent_id
  FROM op ASOF LEFT JOIN op up ON op.tree_id = up.tree_id AND op.depth = up.depth + 1 AND op.i > up.i),
kd AS (SELECT *, row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY i) - 1 AS child_ix FROM nd)"""


def line_trees(spark, sf):
    """One tree a line of the documents laid out as line trees."""
    docs = read_table(spark, sf, "documents").where("fmt = 'linetrees' and text is not null")
    return t.lines(docs).where("line like '(%'").select((F.col("doc_id") * 100000 + F.col("line_no")).alias("tree_id"), F.col("line").alias("tree"))


def nodes(spark, sf):
    return trees.read_trees(line_trees(spark, sf))


@query("tree_words", f"WITH {_TREES} SELECT tree_id, trim(regexp_replace(regexp_replace(regexp_replace(tree, '\\([^ ()]*', '', 'g'), '\\)', '', 'g'), ' +', ' ', 'g')) AS words FROM tr")
def q_tree_words(spark, sf):
    """P03."""
    return line_trees(spark, sf).select("tree_id", t.tree_words(F.col("tree")).alias("words"))


@query("tree_tags", f"WITH {_TREES} SELECT tree_id, array_to_string(list_transform(regexp_extract_all(tree, '\\(([^ ()]+) [^ ()]+\\)', 1), lambda x: string_split(x, '-')[1]), ' ') AS tags FROM tr")
def q_tree_tags(spark, sf):
    """P04."""
    return line_trees(spark, sf).select("tree_id", t.tree_tags(F.col("tree")).alias("tags"))


@query("tree_tagwords", f"""WITH {_TREES} SELECT tree_id, array_to_string(list_transform(regexp_extract_all(tree, '\\([^ ()]+ [^ ()]+\\)'),
  lambda x: string_split(string_split(x[2:-2], ' ')[1], '-')[1] || '/' || string_split(x[2:-2], ' ')[2]), ' ') AS tagwords FROM tr""")
def q_tree_tagwords(spark, sf):
    """P05."""
    return line_trees(spark, sf).select("tree_id", t.tree_tagwords(F.col("tree")).alias("tagwords"))


@query("tree_shape", f"""WITH {_TREES} SELECT run.tree_id, count(*) FILTER (WHERE x = '(') AS n_nodes, count(*) FILTER (WHERE x NOT IN ('(', ')') AND before <> '(') AS n_leaves,
  CAST(max(d) - 1 AS INTEGER) AS depth FROM run JOIN ok ON ok.tree_id = run.tree_id GROUP BY run.tree_id""")
def q_tree_shape(spark, sf):
    """Nodes, leaves and depth of each balanced tree."""
    return nodes(spark, sf).groupBy("tree_id").agg(F.count("*").alias("n_nodes"), F.count("word").alias("n_leaves"), F.max("depth").alias("depth"))


@query("tree_labels", f"""WITH {_TREES} SELECT run.x AS label, count(*) AS cnt, count(*) FILTER (WHERE after NOT IN ('(', ')')) AS n_lexical FROM run JOIN ok ON ok.tree_id = run.tree_id WHERE before = '(' AND x <> '(' GROUP BY run.x""")
def q_tree_labels(spark, sf):
    """A28 input: labels of nodes and how many stand over a word."""
    return nodes(spark, sf).groupBy("label").agg(F.count("*").alias("cnt"), F.count("word").alias("n_lexical"))


@query("tree_roundtrip", f"WITH {_TREES} SELECT tr.tree_id, regexp_replace(tree, '\\s+$', '') AS tree FROM tr JOIN ok ON ok.tree_id = tr.tree_id")
def q_tree_roundtrip(spark, sf):
    """Trees read and written again."""
    return trees.written_trees(nodes(spark, sf))


@query("tree_productions", f"""WITH {_NODES} SELECT lhs, rhs, is_lex, count(*) AS cnt FROM (
    SELECT any_value(p.label) AS lhs, list(c.label ORDER BY c.i) AS rhs, false AS is_lex FROM kd c JOIN kd p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id GROUP BY c.tree_id, c.parent_id
    UNION ALL SELECT label, [word], true FROM kd WHERE word IS NOT NULL) GROUP BY ALL""")
def q_tree_productions(spark, sf):
    """Counts of rules."""
    p = trees.productions(nodes(spark, sf))
    return p.groupBy("lhs", "rhs", "is_lex").agg(F.count("*").alias("cnt"))


_LEX = f"WITH {_TREES} SELECT before_label AS lhs, x AS word, count(*) AS cnt FROM (SELECT tree_id, x, before AS before_label, lag(x, 2) OVER (PARTITION BY tree_id ORDER BY i) AS open FROM run) r JOIN ok ON ok.tree_id = r.tree_id WHERE open = '(' AND x NOT IN ('(', ')') AND before_label NOT IN ('(', ')') GROUP BY before_label, x"


@query("lexical_rules", _LEX)
def q_lexical_rules(spark, sf):
    """A08, lexical part."""
    return trees.productions(nodes(spark, sf)).where("is_lex").groupBy("lhs", F.col("rhs")[0].alias("word")).agg(F.count("*").alias("cnt"))


@query("tree_spans", f"""WITH {_NODES} SELECT label, n_leaves, count(*) AS cnt, count(DISTINCT span) AS n_kinds FROM (
    SELECT any_value(kd.label) AS label, CAST(any_value(kd.r - kd.l) + 1 AS INTEGER) AS n_leaves, string_agg(lf.word, ' ' ORDER BY lf.k) AS span
    FROM kd JOIN lf ON lf.tree_id = kd.tree_id AND lf.k BETWEEN kd.l AND kd.r WHERE kd.r > kd.l GROUP BY kd.tree_id, kd.node_id) GROUP BY label, n_leaves""")
def q_tree_spans(spark, sf):
    """Spans of more than one leaf, and how many of them differ in their words, by label and length."""
    s = trees.spans(nodes(spark, sf)).withColumn("n_leaves", (F.col("r") - F.col("l") + 1).cast("int"))
    return s.groupBy("label", "n_leaves").agg(F.count("*").alias("cnt"), F.countDistinct("span").alias("n_kinds"))


@query("branching_score", f"""WITH {_NODES}, nk AS (SELECT tree_id, parent_id, count(*) AS n FROM kd WHERE parent_id IS NOT NULL GROUP BY ALL),
  two AS (SELECT kd.*, coalesce(n, 0) = 2 AS two FROM kd LEFT JOIN nk ON nk.tree_id = kd.tree_id AND nk.parent_id = kd.node_id),
  s AS (SELECT count(*) FILTER (WHERE c.two AND c.child_ix = 0) AS n_left, count(*) FILTER (WHERE c.two AND c.child_ix = 1) AS n_right FROM two c JOIN two p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id AND p.two)
  SELECT n_left, n_right, round(n_right / (n_left + n_right), 6) AS right_share FROM s""")
def q_branching_score(spark, sf):
    """Right children that branch against left ones."""
    b = trees.branching(nodes(spark, sf))
    return b.withColumn("right_share", F.round(F.try_divide(F.col("n_right"), F.col("n_left") + F.col("n_right")), 6))


@query("center_embedded", f"""WITH {_NODES} SELECT DISTINCT b.tree_id FROM kd b JOIN kd c ON c.tree_id = b.tree_id AND c.parent_id = b.node_id AND c.child_ix = 0
  JOIN kd d ON d.tree_id = c.tree_id AND d.parent_id = c.node_id AND d.child_ix = 1 WHERE b.child_ix = 1 AND b.parent_id IS NOT NULL""")
def q_center_embedded(spark, sf):
    """E10."""
    return trees.center_embedded(nodes(spark, sf))


@query("unary_collapsed", f"""WITH {_NODES}, nk AS (SELECT tree_id, parent_id, count(*) AS n FROM kd WHERE parent_id IS NOT NULL GROUP BY ALL),
  k AS (SELECT kd.tree_id, kd.i, kd.e, kd.label, kd.word, kd.l, kd.r, row_number() OVER (PARTITION BY kd.tree_id ORDER BY kd.i) - 1 AS id FROM kd
    LEFT JOIN nk ON nk.tree_id = kd.tree_id AND nk.parent_id = kd.node_id WHERE coalesce(n, 0) <> 1),
  p AS (SELECT k.tree_id, k.id, max(u.id) AS parent FROM k JOIN k u ON u.tree_id = k.tree_id AND u.i < k.i AND u.e > k.e GROUP BY k.tree_id, k.id)
  SELECT k.tree_id, CAST(k.id AS INTEGER) AS node_id, CAST(coalesce(parent, -1) AS INTEGER) AS parent_id,
    CAST(row_number() OVER (PARTITION BY k.tree_id, coalesce(parent, -1) ORDER BY k.i) - 1 AS INTEGER) AS child_ix, label, word, CAST(l AS INTEGER) AS l, CAST(r AS INTEGER) AS r
  FROM k LEFT JOIN p ON p.tree_id = k.tree_id AND p.id = k.id""")
def q_unary_collapsed(spark, sf):
    """R07, P19."""
    return trees.without_unary(nodes(spark, sf)).select("tree_id", "node_id", "parent_id", "child_ix", "label", "word", "l", "r")


@query("label_entropy", f"""WITH {_TREES}, c AS (SELECT run.x AS label, count(*) AS cnt, count(*) FILTER (WHERE after IN ('(', ')')) AS n_phrase FROM run JOIN ok ON ok.tree_id = run.tree_id WHERE before = '(' AND x <> '(' GROUP BY run.x)
  SELECT round(-sum(cnt / t * ln(cnt / t)), 6) AS entropy, round(count(*) FILTER (WHERE n_phrase = cnt) / count(*), 6) AS phrase_only_share FROM c, (SELECT sum(cnt) AS t FROM c)""")
def q_label_entropy(spark, sf):
    """Entropy of labels in nats; share of labels never over a word."""
    c = nodes(spark, sf).groupBy("label").agg(F.count("*").alias("cnt"), F.count("word").alias("n_lexical"))
    total = c.agg(F.sum("cnt").alias("t"))
    p = F.col("cnt") / F.col("t")
    return c.join(F.broadcast(total)).agg(F.round(-F.sum(p * F.ln(p)), 6).alias("entropy"), F.round(F.avg((F.col("n_lexical") == 0).cast("double")), 6).alias("phrase_only_share"))


def _branch_spans(spark, sf, right):
    """Spans of right or left branching trees of the tagged sentences, by hash; the label is the length class of the span."""
    s = word_sentences(spark, sf).where("size(words) > 1").select(F.col("sent_id").alias("tree_id"), F.transform("words", lambda w: F.xxhash64(w)).alias("v"), F.size("words").alias("n"))
    span = F.slice("v", F.col("i") + 1, F.col("n") - F.col("i")) if right else F.slice("v", F.lit(1), F.col("n") - F.col("i"))
    return s.select("tree_id", "v", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("i")).select(
        "tree_id", F.concat(F.lit("L"), ((F.col("n") - F.col("i")) % 4).cast("string")).alias("label"), (F.col("n") - F.col("i")).alias("size"), trees.span_key(span).alias("span")
    )


_SPANS = TOK + """, s0 AS (SELECT sent_id AS tree_id, words, len(words) AS n FROM tw WHERE len(words) > 1), s AS (SELECT *, unnest(range(n - 1)) AS i FROM s0),
  rb AS (SELECT tree_id, 'L' || ((n - i) % 4) AS label, array_to_string(words[i + 1:], ' ') AS span FROM s), lb AS (SELECT tree_id, 'L' || ((n - i) % 4) AS label, array_to_string(words[:n - i], ' ') AS span FROM s),
  m AS (SELECT coalesce(a.tree_id, b.tree_id) AS tree_id, coalesce(n_sys, 0) AS n_sys, coalesce(n_gold, 0) AS n_gold, least(coalesce(n_sys, 0), coalesce(n_gold, 0)) AS n_match
    FROM (SELECT tree_id, span, count(*) AS n_sys FROM lb GROUP BY ALL) a FULL JOIN (SELECT tree_id, span, count(*) AS n_gold FROM rb GROUP BY ALL) b ON a.tree_id = b.tree_id AND a.span = b.span)"""


@query("bracket_f1", f"WITH {_SPANS} SELECT CAST(sum(n_sys) AS BIGINT) AS n_sys, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_match) AS BIGINT) AS n_match, round(sum(n_match) / sum(n_sys), 6) AS precision, round(sum(n_match) / sum(n_gold), 6) AS recall, round(2 * sum(n_match) / (sum(n_sys) + sum(n_gold)), 6) AS f1 FROM m")
def q_bracket_f1(spark, sf):
    """Unlabelled scores of left against right branching trees."""
    m = metrics.span_matches(_branch_spans(spark, sf, False), _branch_spans(spark, sf, True), ["tree_id", "span"])
    return metrics.bracket_scores(m)



def _scores(x: str, kept: str) -> str:
    """Label scores over the trees kept, under names that end with x."""
    return f"""ls{x} AS (SELECT tree_id, span, label, count(*) AS n_s FROM lb WHERE {kept} GROUP BY ALL), gs{x} AS (SELECT tree_id, span, label AS phrase, count(*) AS n_g FROM rb WHERE {kept} GROUP BY ALL),
  h{x} AS (SELECT label, phrase, sum(least(n_s, n_g)) AS n_match FROM ls{x} a JOIN gs{x} b ON a.tree_id = b.tree_id AND a.span = b.span GROUP BY label, phrase),
  sc{x} AS (SELECT h.label, h.phrase, CAST(n_match AS BIGINT) AS n_match, CAST(n_sys AS BIGINT) AS n_sys, CAST(n_gold AS BIGINT) AS n_gold, round(2 * (n_match / n_sys) * (n_match / n_gold) / (n_match / n_sys + n_match / n_gold), 6) AS f1
    FROM h{x} h JOIN (SELECT label, sum(n_s) AS n_sys FROM ls{x} GROUP BY label) a ON a.label = h.label JOIN (SELECT phrase, sum(n_g) AS n_gold FROM gs{x} GROUP BY phrase) b ON b.phrase = h.phrase)"""


def _greedy(x: str) -> str:
    """Labels added to each phrase type while the joint F1 grows."""
    f = "2 * (m + c.n_match) / (s + c.n_sys + gold)"
    return f"""g{x} AS (SELECT DISTINCT phrase, n_gold AS gold, CAST([] AS VARCHAR[]) AS chosen, 0::BIGINT AS m, 0::BIGINT AS s, 0.0::DOUBLE AS best FROM sc{x}
    UNION ALL SELECT phrase, gold, list_append(chosen, label), m + n_match, s + n_sys, f FROM (
      SELECT g.*, c.label, c.n_match, c.n_sys, {f} AS f, row_number() OVER (PARTITION BY g.phrase ORDER BY {f} DESC, c.f1 DESC, c.label) AS k
      FROM g{x} g JOIN sc{x} c ON c.phrase = g.phrase AND NOT list_contains(chosen, c.label)) WHERE k = 1 AND f > best),
  gr{x} AS (SELECT phrase, arg_max(chosen, len(chosen)) AS chosen, round(max(best), 6) AS f1 FROM g{x} GROUP BY phrase)"""


_LABELS = f"{_SPANS}, {_scores('', 'true')}"


@query("phrase_recall", f"""WITH {_SPANS}, ls AS (SELECT tree_id, span, count(*) AS n_s FROM lb GROUP BY ALL), gs AS (SELECT tree_id, span, label AS phrase, count(*) AS n_g FROM rb GROUP BY ALL)
  SELECT phrase, CAST(sum(n_g) AS BIGINT) AS n_gold, CAST(sum(least(n_g, coalesce(n_s, 0))) AS BIGINT) AS n_match, round(sum(least(n_g, coalesce(n_s, 0))) / sum(n_g), 6) AS recall
  FROM gs LEFT JOIN ls ON ls.tree_id = gs.tree_id AND ls.span = gs.span GROUP BY phrase""")
def q_phrase_recall(spark, sf):
    """Recall of each gold phrase type, whatever the system's label."""
    return metrics.phrase_recall(_branch_spans(spark, sf, False), _branch_spans(spark, sf, True))


@query("bracket_f1_cut", f"""WITH {_SPANS}, sz AS (SELECT sent_id AS tree_id, len(words) AS n FROM tw) SELECT CAST(sum(n_sys) AS BIGINT) AS n_sys, CAST(sum(n_gold) AS BIGINT) AS n_gold, CAST(sum(n_match) AS BIGINT) AS n_match,
  round(sum(n_match) / sum(n_sys), 6) AS precision, round(sum(n_match) / sum(n_gold), 6) AS recall, round(2 * sum(n_match) / (sum(n_sys) + sum(n_gold)), 6) AS f1 FROM m JOIN sz ON sz.tree_id = m.tree_id WHERE sz.n <= 10""")
def q_bracket_f1_cut(spark, sf):
    """E03 with a cutoff length of 10 words."""
    m = metrics.span_matches(_branch_spans(spark, sf, False), _branch_spans(spark, sf, True), ["tree_id", "span"])
    size = word_sentences(spark, sf).select(F.col("sent_id").alias("tree_id"), F.size("words").alias("n"))
    return metrics.bracket_scores(m.join(size.where("n <= 10"), "tree_id"))


@query("label_f1", f"WITH {_LABELS} SELECT label, phrase, n_match, n_sys, n_gold, f1 FROM sc")
def q_label_f1(spark, sf):
    """E05."""
    return metrics.label_scores(_branch_spans(spark, sf, False), _branch_spans(spark, sf, True))


@query("best_label", f"WITH {_LABELS} SELECT phrase, arg_max(label, {{'f': f1, 'l': label}}) AS label, max(f1) AS f1 FROM sc GROUP BY phrase")
def q_best_label(spark, sf):
    """E06."""
    return metrics.best_labels(q_label_f1(spark, sf))


@query("ranked_labels", f"WITH {_LABELS} SELECT phrase, label, f1, CAST(row_number() OVER (PARTITION BY phrase ORDER BY f1 DESC, label) AS INTEGER) AS rank FROM sc")
def q_ranked_labels(spark, sf):
    """Labels of each phrase type in the order of their F1."""
    return metrics.ranked_labels(q_label_f1(spark, sf)).select("phrase", "label", "f1", "rank")


@query("greedy_labels", f"WITH RECURSIVE {_LABELS}, {_greedy('')} SELECT phrase, array_to_string(list_sort(chosen), ',') AS labels, f1 FROM gr")
def q_greedy_labels(spark, sf):
    """E07."""
    return metrics.greedy_labels(q_label_f1(spark, sf))


_PAIRS = _SPANS + """, pa AS (SELECT tree_id, CAST(sum(n_match) AS BIGINT) AS m_a, CAST(sum(n_sys) AS BIGINT) AS s_a, CAST(sum(n_gold) AS BIGINT) AS g FROM m GROUP BY tree_id),
  pq AS (SELECT tree_id, m_a, s_a, CAST(floor(g * (1 + tree_id % 3) / 3) AS BIGINT) AS m_b, g AS s_b, g FROM pa)"""


_GAPS = _PAIRS + """, tr AS (SELECT *, unnest(range(201)) AS i FROM pq), x1 AS (SELECT *, (tree_id % 2147483647 * 48271 + i * 69621 + 1) % 2147483647 AS x FROM tr),
  c AS (SELECT *, i > 0 AND (x * x % 2147483647 * 16807 + x) % 2147483647 % 2 = 1 AS swap FROM x1),
  sm AS (SELECT i, sum(CASE WHEN swap THEN m_b ELSE m_a END) AS ma, sum(CASE WHEN swap THEN s_b ELSE s_a END) AS sa, sum(CASE WHEN swap THEN m_a ELSE m_b END) AS mb, sum(CASE WHEN swap THEN s_a ELSE s_b END) AS sb, sum(g) AS g FROM c GROUP BY i),
  gp AS (SELECT i, abs(2 * ma / (sa + g) - 2 * mb / (sb + g)) AS gap FROM sm), o AS (SELECT gap AS observed FROM gp WHERE i = 0)"""


def _two_systems(spark, sf):
    m = metrics.span_matches(_branch_spans(spark, sf, False), _branch_spans(spark, sf, True), ["tree_id", "span"])
    p = m.groupBy("tree_id").agg(F.sum("n_match").alias("m_a"), F.sum("n_sys").alias("s_a"), F.sum("n_gold").alias("g"))
    return p.withColumn("m_b", F.floor(F.col("g") * (1 + F.col("tree_id") % 3) / 3)).withColumn("s_b", F.col("g"))


@query("perm_test", f"""WITH {_GAPS} SELECT round(max(observed), 6) AS observed, round((1 + count(*) FILTER (WHERE gap > observed + 1e-12)) / (1 + count(*)), 6) AS p_value,
  round((1 + count(*) FILTER (WHERE gap > observed + 1e-12)) / count(*), 6) AS p_compatible FROM gp, o WHERE i > 0""")
def q_perm_test(spark, sf):
    """Permutation test with coins by congruence, 200 permutations."""
    return metrics.permutation_test(_two_systems(spark, sf), 200)


@query("running_p_values", f"WITH {_GAPS} SELECT CAST(i AS BIGINT) AS i, round((1 + sum(CASE WHEN gap > observed + 1e-12 THEN 1 ELSE 0 END) OVER (ORDER BY i)) / (1 + i), 6) AS p_value FROM gp, o WHERE i > 0")
def q_running_p(spark, sf):
    """The p-value after each permutation."""
    return metrics.running_p_values(_two_systems(spark, sf), 200)


@query("dependency_units", f"""WITH {CT}, s AS (SELECT sent_id, count(*) AS n, count(*) FILTER (WHERE coalesce(head, 0) = 0) AS n_roots FROM ct GROUP BY sent_id)
  SELECT sent_id, n AS n_words, n_roots FROM s WHERE n_roots <> 1""")
def q_dependency_units(spark, sf):
    """Sentences that no tree can cover, as they have no outermost head or several."""
    s = conll(spark, sf).groupBy("sent_id").agg(F.count("*").alias("n_words"), F.sum((F.coalesce("head", F.lit(0)) == 0).cast("bigint")).alias("n_roots"))
    return s.where("n_roots <> 1")


#: Trees of dependency sentences: a head's span is that of all words below it; every span must be whole, under one outermost head.
_DEPS = CT + """, dp AS (SELECT sent_id, tok_id, coalesce(form, '_') AS form, coalesce(tag, 'X') AS tag, coalesce(head, 0) AS head FROM ct),
nm AS (SELECT sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY tok_id NULLS FIRST, form, tag, head) AS i, form, tag, head, count(*) OVER (PARTITION BY sent_id) AS n FROM dp),
an AS (SELECT sent_id, i AS node, i AS up FROM nm UNION SELECT an.sent_id, node, nm.head FROM an JOIN nm ON nm.sent_id = an.sent_id AND nm.i = an.up WHERE nm.head > 0),
sp AS (SELECT sent_id, up AS j, min(node) AS lo, max(node) AS hi, count(*) AS c FROM an GROUP BY ALL),
bad AS (SELECT sent_id FROM nm GROUP BY sent_id HAVING count(*) FILTER (WHERE head = 0) <> 1 OR max(head) > count(*) OR min(head) < 0 UNION SELECT sent_id FROM sp WHERE hi - lo + 1 <> c
  UNION SELECT nm.sent_id FROM nm JOIN sp ON sp.sent_id = nm.sent_id AND sp.j = nm.i WHERE head = 0 AND c <> n),
oc AS (SELECT sent_id, lo, count(*) AS opens FROM sp WHERE c > 1 GROUP BY ALL), cc AS (SELECT sent_id, hi, count(*) AS closes FROM sp WHERE c > 1 GROUP BY ALL),
tx AS (SELECT nm.sent_id, string_agg(repeat('(X ', coalesce(opens, 0)) || '(' || tag || ' ' || replace(replace(form, '(', '-LRB-'), ')', '-RRB-') || ')' || repeat(')', coalesce(closes, 0)), ' ' ORDER BY i) AS tree
  FROM nm LEFT JOIN oc ON oc.sent_id = nm.sent_id AND oc.lo = nm.i LEFT JOIN cc ON cc.sent_id = nm.sent_id AND cc.hi = nm.i GROUP BY nm.sent_id)"""


@query("dependency_trees", f"WITH RECURSIVE {_DEPS} SELECT sent_id, CASE WHEN sent_id IN (SELECT sent_id FROM bad) THEN '(TOP (S error))' ELSE tree END AS tree FROM tx")
def q_dependency_trees(spark, sf):
    """Constituency trees of dependency sentences."""
    rows = conll(spark, sf).select("sent_id", "tok_id", F.coalesce("form", F.lit("_")).alias("form"), F.coalesce("tag", F.lit("X")).alias("tag"), F.coalesce("head", F.lit(0)).alias("head"))
    s = rows.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("tok_id", "form", "tag", "head"))).alias("s"))
    s = s.select("sent_id", F.col("s.form").alias("words"), F.col("s.tag").alias("tags"), F.col("s.head").alias("heads"))
    return trees.mapped(s, trees.dependency_tree, "tree", "words", "tags", "heads").select("sent_id", "tree")


@query("depth_counts", """WITH e AS (SELECT user_id AS sent_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos, CAST(event_id % 2 AS INTEGER) AS f, CAST(event_id // 2 % 2 AS INTEGER) AS j FROM events),
  d AS (SELECT *, sum(CASE WHEN f = 1 AND j = 0 THEN 1 WHEN f = 0 AND j = 1 THEN -1 ELSE 0 END) OVER (PARTITION BY sent_id ORDER BY pos) AS depth FROM e)
  SELECT CAST(depth AS BIGINT) AS depth, count(*) AS cnt FROM d GROUP BY depth""")
def q_depth_counts(spark, sf):
    """Depths reached by fork and join decisions."""
    from pyspark.sql import Window as W

    e = read_table(spark, sf, "events")
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = e.select(F.col("user_id").alias("sent_id"), pos.alias("pos"), (F.col("event_id") % 2).alias("f"), (F.expr("event_id div 2") % 2).alias("j"))
    return trees.running_depth(steps).groupBy("depth").agg(F.count("*").alias("cnt"))


@query("toy_trees", """SELECT id AS tree_id, CASE WHEN id % 2 = 0 THEN '(S (A w' || id || ') (B (C w' || (id + 1) || ') (D w' || (id + 2) || ')))' ELSE
  '(S (A (B w' || id || ') (C w' || (id + 1) || ')) (D (E (F w' || (id + 2) || ') (G w' || (id + 3) || ')) (H (I w' || (id + 4) || ') (J (K w' || (id + 5) || ') (L w' || (id + 6) || ')))))' END AS tree FROM range(200) t(id)""")
def q_toy_trees(spark, sf):
    """R16."""
    return spark.range(200).select(F.col("id").alias("tree_id"), trees.gold_toy_trees(F.col("id")).alias("tree"))


@query("head_dependencies", f"""WITH RECURSIVE {_NODES}, pr AS (SELECT any_value(p.label) AS lhs, list(c.label ORDER BY c.i) AS rhs FROM kd c JOIN kd p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id GROUP BY c.tree_id, c.parent_id),
  rc AS (SELECT lhs, rhs, count(*) AS cnt FROM pr GROUP BY ALL), rp AS (SELECT lhs, rhs, cnt / sum(cnt) OVER (PARTITION BY lhs) AS p FROM rc),
  hm AS (SELECT lhs, child, round(sum(p / n), 9) AS p FROM (SELECT lhs, p, len(rhs) AS n, unnest(rhs) AS child FROM rp) GROUP BY lhs, child),
  hc AS (SELECT tree_id, parent_id, node_id FROM (SELECT c.tree_id, c.parent_id, c.node_id, row_number() OVER (PARTITION BY c.tree_id, c.parent_id ORDER BY hm.p DESC, c.child_ix) AS k
    FROM kd c JOIN kd p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id JOIN hm ON hm.lhs = p.label AND hm.child = c.label) WHERE k = 1),
  hd AS (SELECT tree_id, node_id, l + 1 AS leaf FROM kd WHERE word IS NOT NULL UNION ALL SELECT hc.tree_id, hc.parent_id, hd.leaf FROM hd JOIN hc ON hc.tree_id = hd.tree_id AND hc.node_id = hd.node_id)
  SELECT kd.tree_id, CAST(a.leaf AS INTEGER) AS dependent, CAST(coalesce(b.leaf, 0) AS INTEGER) AS head FROM kd JOIN hd a ON a.tree_id = kd.tree_id AND a.node_id = kd.node_id
  LEFT JOIN hd b ON b.tree_id = kd.tree_id AND b.node_id = kd.parent_id WHERE b.leaf IS NULL OR b.leaf <> a.leaf""")
def q_head_dependencies(spark, sf):
    """Dependencies of the line trees under the head model of their own rules, of any arity."""
    from arborloom.operators import grammar

    rules = trees.productions(nodes(spark, sf)).where(~F.col("is_lex")).groupBy("lhs", "rhs").agg(F.count("*").alias("cnt"))
    # Rounded, so that equal shares are equal whatever the order of their sums.
    return trees.dependencies_of(line_trees(spark, sf), grammar.head_model_of(rules).withColumn("p", F.round("p", 9)))


@query("tree_head_model", f"""WITH {_NODES}, pr AS (SELECT any_value(p.label) AS lhs, list(c.label ORDER BY c.i) AS rhs FROM kd c JOIN kd p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id GROUP BY c.tree_id, c.parent_id),
  rc AS (SELECT lhs, rhs, count(*) AS cnt FROM pr GROUP BY ALL), rp AS (SELECT lhs, rhs, cnt / sum(cnt) OVER (PARTITION BY lhs) AS p FROM rc)
  SELECT lhs, child, round(sum(p / n), 6) AS p FROM (SELECT lhs, p, len(rhs) AS n, unnest(rhs) AS child FROM rp) GROUP BY lhs, child""")
def q_tree_head_model(spark, sf):
    """A12 over the line trees: share of each child label of each phrase, rules of any arity."""
    from arborloom.operators import grammar

    rules = trees.productions(nodes(spark, sf)).where(~F.col("is_lex")).groupBy("lhs", "rhs").agg(F.count("*").alias("cnt"))
    return grammar.head_model_of(rules).select("lhs", "child", F.round("p", 6).alias("p"))


@query("held_out_recall", f"""WITH RECURSIVE {_SPANS}, {_scores('d', 'tree_id < 1000')}, {_greedy('d')}, {_scores('t', 'tree_id >= 1000')},
  hit AS (SELECT t.phrase, sum(n_match) AS n_match, max(n_gold) AS n_gold FROM sct t JOIN (SELECT phrase, unnest(chosen) AS label FROM grd) c ON c.phrase = t.phrase AND c.label = t.label GROUP BY t.phrase)
  SELECT d.phrase, array_to_string(list_sort(chosen), ',') AS labels, f1, coalesce(CAST(n_match AS BIGINT), 0) AS n_match, coalesce(n_gold, 0) AS n_gold, round(n_match / nullif(n_gold, 0), 6) AS recall FROM grd d LEFT JOIN hit ON hit.phrase = d.phrase""")
def q_held_out(spark, sf):
    """Labels chosen on the first sentences, scored on the rest."""
    return metrics.held_out_recall(_branch_spans(spark, sf, False), _branch_spans(spark, sf, True), 1000)


@query("tree_ancestors", f"""WITH {_NODES} SELECT n.tree_id, CAST(n.node_id AS INTEGER) AS node_id, CAST(n.depth - a.depth AS INTEGER) AS distance, CAST(a.node_id AS INTEGER) AS ancestor_id
  FROM kd n JOIN kd a ON a.tree_id = n.tree_id AND a.i < n.i AND a.e > n.e""")
def q_ancestors(spark, sf):
    """R09."""
    return trees.ancestors(nodes(spark, sf))


@query("html_code_pairs", """SELECT code, r_name AS place, count(*) AS n FROM (SELECT n.n_name, r.r_name, unnest(string_split(regexp_replace(lower(n.n_name), '[^a-z|]', '-', 'g') || '|' || regexp_replace(lower(r.r_name), '[^a-z|]', '-', 'g'), '|')) AS code
  FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey) GROUP BY ALL""")
def q_html_pairs(spark, sf):
    """Code and place pairs scraped from table rows of pages; the pages are made from the nations and their regions."""
    n, r = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    code = lambda c: F.regexp_replace(F.lower(c), "[^a-z|]", "-")
    row = F.concat(F.lit("<tr><td>"), code("n_name"), F.lit("|"), code("r_name"), F.lit(":</td> <td class='x'> "), F.col("r_name"), F.lit(" </td></tr>"))
    pages = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.array_join(F.collect_list(row), "\n").alias("html"))  # a page a region: 25 rows in all
    return pages.select(F.explode(t.code_places(F.col("html"))).alias("x")).select("x.*").groupBy("code", "place").agg(F.count("*").alias("n"))


_ESCAPED = "regexp_replace(tok.tok, '[ :]', '_', 'g')"
for _sign, _name in t.ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, '{_sign}', '{_name}')"


@query("incremental_parse", f"""WITH {TOK}, r AS (SELECT tok.sent_id, tok.corpus, pos, len(words) AS n, {_ESCAPED} AS w FROM tok JOIN tw ON tw.sent_id = tok.sent_id AND tw.corpus IS NOT DISTINCT FROM tok.corpus AND tw.words[tok.pos + 1] = tok.tok WHERE len(words) > 1),
  k AS (SELECT DISTINCT sent_id, corpus, n, pos, (pos + 1) || CASE WHEN pos < n - 1 THEN ' 0;1_/1_' ELSE ' 1;-.0/-.0' END || ';-.0/-.0;-.0/-.0;-.0/-.0;1_;{trees.RELATIONS} ' || w AS line FROM r)
  SELECT sent_id, (n + 1) || ' 1;-.0/-.0;-.0/-.0;-.0/-.0;-.0/-.0;99_;{trees.RELATIONS} null' || chr(10) || string_agg(line, chr(10) ORDER BY pos DESC) || chr(10) || '{trees.FIRST_STATE}' || chr(10) || '{trees.DIVIDER}' AS parse
  FROM k GROUP BY sent_id, corpus, n""")
def q_incremental(spark, sf):
    """S30 over every sentence: right branching parses in the incremental format."""
    s = word_sentences(spark, sf).where("size(words) > 1")
    n = F.size("words")
    # Right branching: the first word opens 1/1, every later one is joined below it, the last closes.
    state = lambda w, i: F.concat(F.when(i > 1, F.lit("+")).otherwise(F.lit("-")), F.when(i == 0, F.lit("::ACT0/AWA0::")).otherwise(F.lit("::ACT1/AWA1::")), F.when(i < n - 1, F.lit("+")).otherwise(F.lit("-")), F.lit("::POS1::"), F.regexp_replace(w, "[ :]", "_"))
    states = s.select("sent_id", F.array_join(F.transform("words", state), " ").alias("states"))
    return trees.incremental_parses(states).select("sent_id", "parse")
