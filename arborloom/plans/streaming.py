"""Event-time extensions over the event table, run as batch."""

from arborloom.plans import query
from arborloom.session import read_table
from arborloom.streaming import lines


@query("ext_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def q_tumbling(spark, sf):
    """Extension: hourly counts."""
    return lines.tumbling_counts(read_table(spark, sf, "events").where("ts is not null"))


@query("ext_session_windows", """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS head FROM events WHERE ts IS NOT NULL),
  g AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def q_sessions(spark, sf):
    """Extension: user sessions with a gap of 30 minutes."""
    return lines.session_counts(read_table(spark, sf, "events").where("ts is not null"))
