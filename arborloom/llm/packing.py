"""Filling fixed-capacity containers: minimum bin slack over the histogram of item lengths.

A bin's content matters only through its lengths, and there are at most ``capacity`` of those. So the items
are first reduced to counts by length (one small shuffle); per container kind, minimum bin slack runs over
these counts: the largest length left seeds a bin, a bitset subset-sum dynamic programme over the lengths
available finds the fullest feasible combination with it, and the combination is removed as often as
the counts allow (the fullest combination stays the fullest while it is feasible, so this equals bin-by-bin
filling). The resulting plan is bounded by capacity, not by the data; items then find their bin
from their rank among the items of their length.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborloom.session import BROADCAST_ROWS, ship_code, small_side, written

#: Items of one length of one run that one task numbers; longer lists are split by a hash of the id.
ROWS_PER_SALT = 500_000


def _added(reach: int, length: int, copies: int, mask: int) -> int:
    """Totals that can be reached with up to ``copies`` of a further length, by binary splitting."""
    step = 1
    while copies > 0:
        take = min(step, copies)
        reach |= (reach << (length * take)) & mask
        copies -= take
        step *= 2
    return reach


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths that fills ``room`` best, large lengths first among equals.

    Bitset subset-sum dynamic programme: bit ``x`` of a layer tells that total ``x`` can be reached with the
    lengths so far. Of n layers every sqrt(n)-th is kept and those between are made again on the way back, so the
    memory is room * sqrt(n) / 4 bytes (some 0.25 GB at a room of a million).
    """
    mask = (1 << (room + 1)) - 1
    used = [(length, min(counts[length], room // length)) for length in lengths if length <= room]
    stride = max(1, math.isqrt(len(used)))
    kept, reach = {}, 1
    for k, (length, copies) in enumerate(used):
        if k % stride == 0:
            kept[k] = reach
        reach = _added(reach, length, copies, mask)
    left, out = reach.bit_length() - 1, {}
    for first in range((len(used) - 1) // stride * stride, -1, -stride) if used else ():
        part = used[first : first + stride]
        layers = [kept[first]]
        for length, copies in part[:-1]:
            layers.append(_added(layers[-1], length, copies, mask))
        for below, (length, copies) in zip(reversed(layers), reversed(part), strict=True):
            m = min(copies, left // length)
            while not below >> (left - m * length) & 1:
                m -= 1
            if m:
                out[length] = m
                left -= m * length
    return out


def minimum_bin_slack(capacity: int, counts: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Bins as ``(copies by length, number of such bins)``; every item of ``counts`` (by length) is used once."""
    counts = {k: v for k, v in counts.items() if v > 0}
    lengths, bins = sorted(counts), []
    while lengths:
        seed = lengths[-1]
        counts[seed] -= 1
        content = fullest(capacity - seed, lengths, counts)
        counts[seed] += 1
        content[seed] = content.get(seed, 0) + 1
        times = min(counts[k] // m for k, m in content.items())
        for k, m in content.items():
            counts[k] -= m * times
        lengths = [k for k in lengths if counts[k]]
        bins.append((content, times))
    return bins


def sequence_lengths(sequences: DataFrame) -> DataFrame:
    """``(sent_id, corpus, n)``, once per sent_id: of repeated rows the earliest loaded counts, null times last."""
    late = F.coalesce("loaded_at", F.lit("9999-12-31").cast("timestamp"))
    return (
        sequences.where(F.col("sent_id").isNotNull())
        .select(F.col("sent_id").cast("bigint"), F.struct(late.alias("late"), "corpus", F.size("toks").alias("n")).alias("row"))
        .groupBy("sent_id")
        .agg(F.min("row").alias("row"))
        .where("row.n > 0 and row.corpus is not null")
        .select("sent_id", "row.corpus", F.col("row.n").alias("n"))
    )


def gpu_runs(runs: DataFrame) -> DataFrame:
    """``(run, corpus, cap)`` of runs on a GPU with a capacity of at least 1."""
    return (
        runs.where("gpu = 1 and gpu_batch_size > 0 and corpus is not null and run is not null")
        .groupBy("run")
        .agg(F.min(F.struct("corpus", F.col("gpu_batch_size").alias("cap"))).alias("r"))
        .select("run", "r.corpus", "r.cap")
    )


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """The bins of one run; first: rank of the first item of this length in these bins."""
    run, cap = rows["run"].iloc[0], int(rows["cap"].iloc[0])
    out, rank, at = [], {}, 0
    for content, times in minimum_bin_slack(cap, {int(k): int(v) for k, v in zip(rows["len"], rows["cnt"], strict=True)}):
        for length, m in content.items():
            first = rank.get(length, 0)
            out.append((run, length, first, m, at))
            rank[length] = first + m * times
        at += times
    return pd.DataFrame(out, columns=["run", "len", "first", "copies", "bin"])


def pack(sequences: DataFrame, runs: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``(run, capacity, bin, sent_id, piece, n_pieces, start, len)``: where each piece of each sentence goes.

    A sentence is cut only if it alone is longer than a bin: into full pieces and a remainder. Bins are
    numbered from 0 within a run. Defined results: sentences with null or empty toks, a null corpus or a
    null sent_id fill nothing; runs without a GPU, capacity, corpus or name fill nothing; repeated rows count
    once; sentences of equal length are placed by hash and id; empty tables give no bins; further columns
    are ignored. Bounds: per run, at most ``capacity`` lengths reach one task.
    """
    ship_code(sequences.sparkSession)
    spread = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lengths = written(sequence_lengths(sequences), "lengths")
    kinds = small_side(gpu_runs(runs))
    full, rest = F.expr("n div cap"), F.expr("n % cap")
    histogram = written(
        lengths.groupBy("corpus", "n")
        .agg(F.count("*").alias("cnt"))
        .join(kinds, "corpus")
        .select(
            "run",
            "cap",
            F.explode(F.array(F.struct(F.col("cap").alias("len"), (full * F.col("cnt")).alias("cnt")), F.struct(rest.cast("int").alias("len"), "cnt"))).alias("x"),
        )
        .where("x.len > 0 and x.cnt > 0")
        .groupBy("run", "cap", "x.len")
        .agg(F.sum("x.cnt").alias("cnt")),
        "histogram",
    )
    # An explicit number of partitions, so that the runs are planned side by side.
    plan = written(histogram.repartition(spread, "run").groupBy("run").applyInPandas(_plan, "run string, len int, first bigint, copies int, bin bigint"), "bins")
    by_length = plan.groupBy("run", "len").agg(F.array_sort(F.collect_list(F.struct("first", "copies", "bin"))).alias("bins"))
    salts = histogram.select("run", "len", F.ceil(F.col("cnt") / rows_per_salt).cast("int").alias("n_salts"))
    pieces = (
        lengths.join(kinds, "corpus")
        .withColumn("n_pieces", F.expr("cast((n + cap - 1) div cap as int)"))
        .withColumn("piece", F.explode(F.expr("sequence(0, n_pieces - 1)")))
        .withColumn("start", F.col("piece") * F.col("cap"))
        .withColumn("len", F.least("cap", F.col("n") - F.col("start")))
        .join(small_side(salts), ["run", "len"])
        .withColumn("salt", F.expr("cast(pmod(xxhash64(sent_id), n_salts) as int)"))
        .select("run", F.col("cap").alias("capacity"), "sent_id", "piece", "n_pieces", "start", "len", "salt")
    )
    before = (
        pieces.groupBy("run", "len", "salt")
        .agg(F.count("*").alias("c"))
        .withColumn("before", F.sum("c").over(W.partitionBy("run", "len").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)))
        .select("run", "len", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    )
    rank = F.row_number().over(W.partitionBy("run", "len", "salt").orderBy("sent_id", "piece")) - 1
    return (
        pieces.withColumn("rank", rank)
        .join(small_side(before), ["run", "len", "salt"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .join(small_side(by_length, BROADCAST_ROWS // 4), ["run", "len"])
        .withColumn("b", F.expr("element_at(bins, size(filter(bins, b -> b.first <= rank)))"))
        .select("run", "capacity", F.expr("b.bin + (rank - b.first) div b.copies").alias("bin"), "sent_id", "piece", "n_pieces", "start", "len")
    )


def cut_sequences(placed: DataFrame) -> DataFrame:
    """``(run, sent_id)`` of the sentences that had to be cut and all of whose pieces have their place in a bin."""
    pieces = placed.where("n_pieces > 1").groupBy("run", "sent_id", "n_pieces").agg(F.count("bin").alias("n_placed"))
    return pieces.where("n_placed = n_pieces").select("run", "sent_id")


def batches(placed: DataFrame) -> DataFrame:
    """The bins of each run and how full they are."""
    return (
        placed.groupBy("run", "capacity", "bin")
        .agg(F.count("*").alias("n_items"), F.sum("len").alias("used"))
        .withColumn("room", F.col("capacity") - F.col("used"))
        .withColumn("fill", F.round(F.col("used") / F.col("capacity"), 6))
    )


def totals(placed: DataFrame) -> DataFrame:
    """By run: sentences, pieces and tokens placed, bins over their capacity and bins in use."""
    bins = placed.groupBy("run", "capacity", "bin").agg(F.sum("len").alias("used"), F.count("*").alias("n"))
    per = bins.groupBy("run", "capacity").agg(
        F.sum("n").alias("n_pieces"), F.sum("used").alias("tokens"), F.sum((F.col("used") > F.col("capacity")).cast("bigint")).alias("overfull"), F.count("*").alias("n_bins")
    )
    sentences = placed.where("piece = 0").groupBy("run").agg(F.count("*").alias("n_sentences"))
    return per.join(sentences, "run").select("run", "capacity", "n_sentences", "n_pieces", "tokens", "overfull", "n_bins")


def lower_bound(capacity: int, counts: dict[int, int]) -> int:
    """No packing needs fewer bins: for every size k, items over capacity - k stand alone, those over half the
    capacity have a bin each, and the others of at least k fill what room is left (the L2 bound)."""
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in range(capacity // 2 + 1):
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        large = {n: c for n, c in counts.items() if capacity / 2 < n <= capacity - k}
        small = sum(n * c for n, c in counts.items() if k <= n <= capacity / 2)
        room = sum((capacity - n) * c for n, c in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - room) // capacity)))
    return best
