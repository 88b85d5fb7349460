"""Frequency of every distinct term: a global integer dictionary, encoded blocks, count arrays summed by identifier range.

One pass gathers the distinct terms of each block of records; spread over ranges by a hash and numbered in byte order within each, they
are the global dictionary (identifier = range * 2**32 + position), written once. A second pass encodes blocks with it and accumulates arrays of
occurrences and of record presence by identifier; a block sends on what is not 0, and arrays are summed by identifier range. A term leaves a block
at most once, however frequent it is. A dictionary beyond the bound for broadcasts stays where its ranges are: then blocks are counted by their
own numbers, sent to the ranges of their terms, and encoded there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborloom.session import dropped, once_each, ship_code, written

#: Terms and bytes that a block holds before its arrays are sent on.
BLOCK_TERMS, BLOCK_BYTES = 2_000_000, 256 << 20
#: Terms that one identifier range should hold.
TERMS_PER_RANGE = 200_000
#: Terms and bytes of a dictionary that is sent to all tasks.
SENT_TERMS, SENT_BYTES = 1_000_000, 32 << 20

Batches = Iterator[pa.RecordBatch]


def _blocks(batches: Batches) -> Iterator[tuple[pa.DictionaryArray, np.ndarray, int]]:
    """Blocks of records as (terms encoded by a dictionary of the block, record of each term, number of records)."""
    held: list[tuple[pa.Array, np.ndarray]] = []
    records, terms, size = 0, 0, 0

    def coded() -> pa.DictionaryArray:
        flat = pa.chunked_array([x for x, _ in held], pa.large_string()).combine_chunks()
        out = flat.dictionary_encode()
        return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out

    for batch in batches:
        lists = batch.column("words")
        flat = lists.flatten().cast(pa.large_string())
        keep = pc.fill_null(pc.not_equal(flat, ""), False)
        parent = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False) + records
        held.append((flat.filter(keep), parent[keep.to_numpy(zero_copy_only=False)]))
        records, terms, size = records + len(lists), terms + len(flat), size + flat.nbytes
        if terms >= BLOCK_TERMS or size >= BLOCK_BYTES:
            yield coded(), np.concatenate([p for _, p in held]), records
            held, records, terms, size = [], 0, 0, 0
    if held:
        yield coded(), np.concatenate([p for _, p in held]), records


def _arrays(ids: np.ndarray, record: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Count arrays over ``size`` numbers: occurrences, and records that have it."""
    occurrences = np.bincount(ids, minlength=size)
    pairs = np.unique(record * max(size, 1) + ids)
    return occurrences, np.bincount(pairs % max(size, 1), minlength=size)


def _distinct(batches: Batches) -> Batches:
    """The distinct terms of blocks; a row with a null term tells the block's number of records."""
    for coded, _, records in _blocks(batches):
        words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
        yield from pa.table([words, pa.array([0] * len(coded.dictionary) + [records], pa.int64())], names=["word", "n"]).to_batches()


def _numbered(table: pa.Table) -> pa.Table:
    """The terms of one range in byte order."""
    words = table.column("word").combine_chunks()
    words = words.take(pc.array_sort_indices(words))
    first = int(table.column("range")[0].as_py()) << 32
    return pa.table({"term_id": first + np.arange(len(words)), "word": words})


def _summed(table: pa.Table) -> pa.Table:
    """The arrays of one identifier range."""
    place = table.column("term_id").to_numpy() & 0xFFFFFFFF
    sums = [np.bincount(place, weights=table.column(c).to_numpy()) for c in ("occurrences", "records")]
    at = np.flatnonzero(sums[0])
    first = int(table.column("term_id")[0].as_py()) >> 32 << 32
    return pa.table({"term_id": first + at, "occurrences": sums[0][at].astype(np.int64), "records": sums[1][at].astype(np.int64)})


def _encoded_there(words: pa.Table, counts: pa.Table) -> pa.Table:
    """Blocks' counts of one range encoded with its part of the dictionary and summed."""
    where = pc.index_in(counts.column("word").combine_chunks(), words.column("word").combine_chunks()).to_numpy()
    sums = [np.bincount(where, weights=counts.column(c).to_numpy(), minlength=words.num_rows).astype(np.int64) for c in ("occurrences", "records")]
    return pa.table({"term_id": words.column("term_id"), "word": words.column("word"), "occurrences": sums[0], "records": sums[1]})


def distinct_records(df: DataFrame, key: str, words: str, loaded: str) -> DataFrame:
    """``(key, words)`` once per key: of repeated rows the earliest loaded, null times last, then the content decides.

    Only the rows of repeated keys are shuffled.
    """
    late = F.coalesce(loaded, F.lit("9999-12-31").cast("timestamp"))
    rows = df.select(key, late.alias("late"), F.col(words).alias("words"))
    pick = lambda d: d.groupBy(key).agg(F.min(F.struct("late", "words")).alias("r")).select(key, "r.late", "r.words")
    return once_each(rows, key, pick).select(key, "words")


def dictionary(filled: DataFrame) -> tuple[DataFrame, int, int]:
    """The global dictionary ``(term_id, word)`` of ``filled(words)``, written; its ranges and the number of records."""
    spark = filled.sparkSession
    words = written(filled.mapInArrow(_distinct, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    size, records = words.agg(F.count("word"), F.sum("n")).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TERMS_PER_RANGE))
    ranged = words.where("word is not null").select(F.expr(f"pmod(xxhash64(word), {ranges})").alias("range"), "word")
    table = written(ranged.groupBy("range").applyInArrow(_numbered, "term_id bigint, word string"), "dictionary")
    dropped(words)
    table._arborloom_terms = size
    return table, ranges, int(records or 0)


def term_counts(records: DataFrame, sent: tuple[int, int] = (SENT_TERMS, SENT_BYTES)) -> tuple[DataFrame, int]:
    """Counts of every term of ``records(words ARRAY<STRING>)``, and the number of records with a non-empty array.

    ``(term_id, word, occurrences, records)``. Defined results: null and empty arrays are no records; null and
    empty terms are skipped (a record of only those still is a record); terms are compared byte by byte as stored;
    an empty table gives no terms and 0 records; terms of any length are kept whole. ``sent``: terms and bytes of a dictionary that
    goes to all tasks.
    """
    spark = records.sparkSession
    ship_code(spark)
    filled = records.select(F.col("words").cast("array<string>").alias("words")).where(F.size("words") > 0)
    table, ranges, n = dictionary(filled)
    size = table.agg(F.sum(F.octet_length("word"))).first()[0] or 0 if table._arborloom_terms <= sent[0] else sent[1] + 1
    if size <= sent[1]:
        held = table.toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((held.column("word").combine_chunks().cast(pa.large_string()), held.column("term_id").to_numpy()))

        def encoded(batches: Batches) -> Batches:
            words, ids = shared.value
            for coded, record, _ in _blocks(batches):
                place = pc.index_in(coded.dictionary, words).to_numpy()[coded.indices.to_numpy()]
                occurrences, present = _arrays(place.astype(np.int64), record, len(ids))
                at = np.flatnonzero(occurrences)
                yield from pa.table([pa.array(ids[at]), pa.array(occurrences[at]), pa.array(present[at])], names=["term_id", "occurrences", "records"]).to_batches()

        parts = filled.mapInArrow(encoded, "term_id bigint, occurrences bigint, records bigint")
        sums = parts.groupBy(F.shiftright("term_id", 32).alias("range")).applyInArrow(_summed, "term_id bigint, occurrences bigint, records bigint")
        return sums.join(table, "term_id").select("term_id", "word", "occurrences", "records"), n

    def counted(batches: Batches) -> Batches:
        for coded, record, _ in _blocks(batches):
            ids = coded.indices.to_numpy().astype(np.int64)
            occurrences, present = _arrays(ids, record, len(coded.dictionary))
            yield from pa.table([coded.dictionary.cast(pa.string()), pa.array(occurrences), pa.array(present)], names=["word", "occurrences", "records"]).to_batches()

    parts = filled.mapInArrow(counted, "word string, occurrences bigint, records bigint").withColumn("range", F.expr(f"pmod(xxhash64(word), {ranges})"))
    words = table.withColumn("range", F.shiftright("term_id", 32))
    return words.groupBy("range").cogroup(parts.groupBy("range")).applyInArrow(_encoded_there, "term_id bigint, word string, occurrences bigint, records bigint"), n


def marked(counts: DataFrame, n_records: int, min_occurrences: int = 3, min_records: int = 2, common_share: int = 10) -> DataFrame:
    """``mark``: rare, common (in more than one in ``common_share`` records) or null."""
    rare = (F.col("occurrences") < min_occurrences) | (F.col("records") < min_records)
    common = F.col("records") * common_share > F.lit(n_records)
    return counts.withColumn("mark", F.when(rare, "rare").when(common, "common"))


def marked_words(tagwords: DataFrame) -> DataFrame:
    """Terms of ``tagwords(sent_id, words, loaded_at)`` with counts and marks; each sent_id counts once."""
    counts, n = term_counts(distinct_records(tagwords, "sent_id", "words", "loaded_at"))
    return marked(counts, n)
