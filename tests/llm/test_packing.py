import random

import pytest

from arborloom.llm import packing


@pytest.mark.parametrize("seed", range(8))
def test_fullest_equals_brute_force(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(6)}
    items = [k for k, v in counts.items() for _ in range(v)]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums}
    for room in range(0, 60, 3):
        got = packing.fullest(room, sorted(counts), counts)
        assert sum(k * v for k, v in got.items()) == max(s for s in sums if s <= room)
        assert all(v <= counts[k] for k, v in got.items())


def test_many_lengths_and_few_kept_layers():
    rng = random.Random(9)
    lengths = sorted(rng.sample(range(40, 2000), 120))
    counts = {n: rng.randrange(1, 3) for n in lengths}
    for room in (39, 1999, 30_000, sum(n * c for n, c in counts.items())):
        got = packing.fullest(room, lengths, counts)
        total = sum(n * c for n, c in got.items())
        reach = 1
        for n, c in counts.items():
            for _ in range(c):
                reach |= reach << n
        assert total == max(x for x in (*range(max(0, room - 2000), room + 1), 0) if x <= room and reach >> x & 1)
        assert all(c <= counts[n] for n, c in got.items())


def test_bins_use_every_item_once():
    rng = random.Random(1)
    counts = {k: rng.randrange(1, 200) for k in range(1, 65)}
    bins = packing.minimum_bin_slack(64, counts)
    used = {}
    for content, times in bins:
        assert sum(k * v for k, v in content.items()) <= 64
        for k, v in content.items():
            used[k] = used.get(k, 0) + v * times
    assert used == counts
    assert sum(t for _, t in bins) <= 1.01 * packing.lower_bound(64, counts) + 1


def test_pack(spark):
    rng = random.Random(5)
    rows = [(i, [1] * rng.randrange(0, 40), rng.choice(["a", "a", "a", "b", None])) for i in range(800)]
    rows += [(900, [1] * 95, "a"), (901, None, "a"), (None, [1], "a"), (902, [1] * 64, "a")] + rows[:50]
    seqs = spark.createDataFrame(rows, "sent_id bigint, toks array<int>, corpus string").selectExpr("*", "cast(null as timestamp) loaded_at", "3 as len")
    runs = spark.createDataFrame(
        [("r1", "a", 1, 32), ("r2", "a", 1, 50), ("r3", "b", 0, 32), ("r4", "b", 1, None), ("r5", None, 1, 9), ("r6", "none", 1, 9), ("r7", "b", 1, 7)],
        "run string, corpus string, gpu int, gpu_batch_size int",
    ).selectExpr("*", "1 as bin")
    placed = packing.pack(seqs, runs, rows_per_salt=7).collect()
    cap = {"r1": 32, "r2": 50, "r7": 7}
    bins, whole = {}, {}
    for p in placed:
        bins[p.run, p.bin] = bins.get((p.run, p.bin), 0) + p.len
        whole.setdefault((p.run, p.sent_id), []).append((p.start, p.len))
    n = {r[0]: (len(r[1]), r[2]) for r in rows if r[0] is not None and r[1]}
    assert set(whole) == {(r, i) for r, c in (("r1", "a"), ("r2", "a"), ("r7", "b")) for i, (_, k) in n.items() if k == c}
    for (run, i), parts in whole.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n[i][0]
        assert len(parts) == -(-at // cap[run])
    assert all(v <= cap[r] for (r, _), v in bins.items())
    for r in cap:
        assert {b for x, b in bins if x == r} == set(range(sum(x == r for x, _ in bins)))
    df = packing.pack(seqs, runs)
    t = {r.run: r for r in packing.totals(df).collect()}
    assert all(t[r].overfull == 0 and t[r].n_bins == len({b for x, b in bins if x == r}) and t[r].tokens == sum(v for (x, _), v in bins.items() if x == r) for r in cap)
    assert {tuple(x) for x in packing.cut_sequences(df).collect()} == {k for k, v in whole.items() if len(v) > 1}
    assert packing.pack(seqs.limit(0), runs).count() == 0
    assert packing.pack(seqs, runs.limit(0)).count() == 0
