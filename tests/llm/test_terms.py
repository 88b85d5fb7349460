import random
from collections import Counter

import pyarrow as pa
import pytest

from arborloom.llm import terms


def brute(rows):
    seen, occ, rec, n = set(), Counter(), Counter(), 0
    for sid, words in rows:
        if sid in seen or not words:
            continue
        seen.add(sid)
        n += 1
        kept = [w for w in words if w]
        occ.update(kept)
        rec.update(set(kept))
    return occ, rec, n


@pytest.mark.parametrize("sent", [(100, 10_000), (3, 10_000), (100, 5)])
@pytest.mark.parametrize("block", [(2_000_000, 1 << 28), (7, 1 << 28), (2_000_000, 100)])
def test_counts_equal_brute_force_in_any_blocks(spark, monkeypatch, sent, block):
    rng = random.Random(3)
    pool = ["a", "b", "A", "ä", "ä", "", None, "x y", "z/" * 50, "🙂"]
    rows = [(i, [rng.choice(pool) for _ in range(rng.randrange(9))] or None) for i in range(500)]
    rows += rows[:40] + [(1000, []), (1001, [None, ""])]
    df = spark.createDataFrame(rows, "sent_id bigint, words array<string>").selectExpr("*", "cast(null as timestamp) loaded_at", "1 as word")
    occ, rec, n = brute(rows)
    held = [pa.RecordBatch.from_arrays([pa.array([w for _, w in rows[a : a + 50] if w], pa.list_(pa.string()))], names=["words"]) for a in range(0, 540, 50)]
    monkeypatch.setattr(terms, "BLOCK_TERMS", block[0])
    monkeypatch.setattr(terms, "BLOCK_BYTES", block[1])
    assert sum(len(record) for _, record, _ in terms._blocks(iter(held))) == sum(1 for _, ws in rows[:540] for w in ws or () if w)
    counts, total = terms.term_counts(terms.distinct_records(df, "sent_id", "words", "loaded_at"), sent)
    got = counts.collect()
    assert total == n
    assert {r.word: (r.occurrences, r.records) for r in got} == {w: (occ[w], rec[w]) for w in occ}
    assert len({r.term_id for r in got}) == len(got)


def test_marks_and_empty(spark):
    rows = [(i, ["the"] + (["odd"] if i == 3 else []) + (["mid"] if i < 4 else [])) for i in range(50)]
    df = spark.createDataFrame(rows, "sent_id bigint, words array<string>").selectExpr("*", "current_timestamp() loaded_at")
    assert {r.word: r.mark for r in terms.marked_words(df).collect()} == {"the": "common", "odd": "rare", "mid": None}
    assert terms.marked_words(df.limit(0)).count() == 0
