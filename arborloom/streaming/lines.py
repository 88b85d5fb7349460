"""Structured Streaming: sentences parsed as they arrive (K01), and event-time windows as extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborloom.operators.inference import Chain, inferred


def parsed_lines(spark: SparkSession, folder: str, chain: Chain, vocabulary: dict[str, int], unknown: int = 0) -> DataFrame:
    """Files of sentences in a folder, each line encoded with a small vocabulary and parsed; a stateless stream.

    The key of a line is a hash of it; an empty line gives an empty parse (D16).
    """
    lookup = F.create_map(*(F.lit(x) for kv in vocabulary.items() for x in kv)) if vocabulary else F.create_map().cast("map<string,int>")
    words = F.filter(F.split("value", "[ \t\r]+"), lambda w: w != "")
    lines = spark.readStream.text(folder)
    coded = lines.select(F.xxhash64("value").alias("sent_id"), F.transform(words, lambda w: F.coalesce(F.try_element_at(lookup, w), F.lit(unknown))).alias("obs"))
    return inferred(coded, chain, "viterbi")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts and values by event type and tumbling window; works on a stream (with watermark) or a table."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Extension: sessions of users."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )
