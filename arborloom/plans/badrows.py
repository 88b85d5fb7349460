"""Queries of problem 3: lines that do not parse."""

from pyspark.sql import functions as F

from arborloom.operators import badrows
from arborloom.plans import query
from arborloom.session import read_table


def _parsed(spark, sf_dir):
    return badrows.parse_lines(read_table(spark, sf_dir, "conll_raw"), read_table(spark, sf_dir, "tagset"))


#: The same rules as patterns: a field is quoted as a whole or has no quote.
_FIELD = '"(?:[^"]|"")*"|[^"\\t]*'
_SQL = f"""WITH t AS (SELECT line_id, file, line_no, CASE WHEN raw LIKE '%' || chr(13) THEN raw[:-2] ELSE raw END AS s FROM conll_raw),
  a AS (SELECT *, regexp_full_match(s, '(?:{_FIELD})(?:\\t(?:{_FIELD}))*') AS fine, regexp_extract_all(chr(9) || s, '\\t({_FIELD})', 1) AS parts
    FROM t WHERE s IS NOT NULL AND NOT regexp_full_match(s, ' *') AND NOT starts_with(s, '#')),
  b AS (SELECT line_id, file, line_no, fine, list_transform(parts, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM a),
  c AS (SELECT *, CASE WHEN NOT fine THEN 'quoting' WHEN len(f) <> 7 THEN 'columns'
      WHEN NOT regexp_full_match(f[1], '[1-9][0-9]{{0,2}}') OR NOT regexp_full_match(f[7], '0|[1-9][0-9]{{0,2}}') OR f[1] = f[7] OR f[4] NOT IN (SELECT tag FROM tagset WHERE tag IS NOT NULL)
        OR f[2] = '' OR f[3] = '' OR len(list_filter(f, lambda x: regexp_matches(x, '[\\x00-\\x08\\x0A-\\x1F\\x7F\\x{{FFFD}}]'))) > 0 THEN 'value' END AS reason FROM b)"""


@query("p3_found", _SQL + " SELECT line_id, reason FROM c WHERE reason IS NOT NULL UNION ALL SELECT line_id, 'columns' FROM t WHERE s IS NULL")
def p3_found(spark, sf_dir):
    """The lines that do not parse, with the first reason that applies."""
    return badrows.rejected(_parsed(spark, sf_dir))


@query("p3_tokens", _SQL + """ SELECT line_id, file, line_no, CAST(f[1] AS INTEGER) AS tok_id, f[2] AS form, f[3] AS lemma, f[4] AS tag, f[5] AS feature, f[6] AS relation,
  CAST(f[7] AS INTEGER) AS head FROM c WHERE reason IS NULL""")
def p3_tokens(spark, sf_dir):
    """The valid token lines, typed."""
    return badrows.tokens(_parsed(spark, sf_dir))


@query("p3_report", _SQL + """, k AS (SELECT file, CASE WHEN s IS NULL THEN 'bad' WHEN regexp_full_match(s, ' *') THEN 'blank' WHEN starts_with(s, '#') THEN 'comment' END AS kind,
    CASE WHEN s IS NULL THEN 'columns' END AS reason FROM t WHERE s IS NULL OR regexp_full_match(s, ' *') OR starts_with(s, '#')
    UNION ALL SELECT file, CASE WHEN reason IS NULL THEN 'token' ELSE 'bad' END, reason FROM c)
  SELECT file, kind, reason, count(*) AS n_lines FROM k GROUP BY ALL""")
def p3_report(spark, sf_dir):
    """Lines by file, kind and reason."""
    return _parsed(spark, sf_dir).groupBy("file", "kind", "reason").agg(F.count("*").alias("n_lines"))
