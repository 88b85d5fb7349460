import numpy as np
import pyarrow as pa
import pytest

from arborloom.llm import clusters as cl
from arborloom.session import read_table

VEC = "id int, vec array<float>"


def planted(rng, sizes, noise, width=64, cosine=0.88):
    centres = rng.normal(size=(len(sizes), width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = []
    for k, n in enumerate(sizes):
        e = rng.normal(size=(n, width))
        e -= (e @ centres[k])[:, None] * centres[k]
        e /= np.linalg.norm(e, axis=1, keepdims=True)
        x = cosine * centres[k] + np.sqrt(1 - cosine**2) * e
        rows += list(x * rng.uniform(0.5, 9, size=(n, 1)))
    rows += list(rng.normal(size=(noise, width)))
    label = [k for k, n in enumerate(sizes) for _ in range(n)] + [-1] * noise
    order = rng.permutation(len(rows))
    return [rows[i].tolist() for i in order], [label[i] for i in order]


def sets_of(rows):
    got = {}
    for r in rows:
        got.setdefault(r.cluster_id, set()).add(r.id)
    return got


def truth_of(label, sizes):
    want = {}
    for i, k in enumerate(label):
        if k >= 0 and sizes[k] >= 10:
            want.setdefault(k, set()).add(i)
    return want


@pytest.mark.parametrize("sizes, noise", [([200, 90, 40, 15, 12, 6], 150), ([30, 14], 60)])
def test_planted_clusters_are_found(spark, sizes, noise):
    vecs, label = planted(np.random.default_rng(4), sizes, noise)
    rows = [(i, v) for i, v in enumerate(vecs)]
    nan, inf = [float("nan")] * 64, [float("inf")] + [1.0] * 63
    rows += rows[:60] + [(None, vecs[0]), (9001, None), (9002, [0.0] * 64), (9003, nan), (9004, inf), (9005, [1.0] * 63), (9006, [None] * 64), (9007, [])]
    df = spark.createDataFrame(rows, VEC).selectExpr("*", "1 as cell", "2 as centre", "3 as n")
    members, _ = cl.clusters(df)
    got, want = sets_of(members.collect()), truth_of(label, sizes)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(c == min(ids) for c, ids in got.items())
    words = df.selectExpr("id", "concat('w', id) as word")
    d = {r.cluster_id: r for r in cl.described(members, words).collect()}
    assert {c: r["size"] for c, r in d.items()} == {c: len(ids) for c, ids in got.items()}
    for c, r in d.items():
        assert 1 <= len(r.typical) <= 5 and all(int(w[1:]) in got[c] for w in r.typical)


def test_small_clusters_among_noise(spark):
    sizes = [10] * 20 + [20] * 10
    vecs, label = planted(np.random.default_rng(6), sizes, 3000, cosine=0.8)
    got = sets_of(cl.clusters(spark.createDataFrame(list(enumerate(vecs)), VEC))[0].collect())
    want = truth_of(label, sizes)
    exact = {frozenset(x) for x in got.values()} & {frozenset(x) for x in want.values()}
    assert len(exact) >= 0.9 * len(want)


def exhaustive(x, least=10, within=0.75):
    """Every vector that is in no group found before as a start: the mean of all near it, moved until it stays."""
    found, free = [], np.ones(len(x), bool)
    for i in range(len(x)):
        near = x @ x[i] >= 0.55 if free[i] else np.empty(0, bool)
        if near.sum() < least // 2:
            continue
        m = x[near].mean(axis=0)
        for _ in range(60):
            m /= np.linalg.norm(m)
            inside = x @ m >= within
            if inside.sum() < least // 2:
                break
            new = x[inside].mean(axis=0)
            if np.abs(new / np.linalg.norm(new) - m).max() < 1e-6:
                break
            m = new
        inside = x @ (m / np.linalg.norm(m)) >= within
        if inside.sum() >= least:
            free &= ~inside
            found.append(np.flatnonzero(inside))
    return found


def test_recall_against_exhaustive_search(spark):
    table = read_table(spark, "/root/testdata/sf0.1", "word_vectors")
    rows = {r.id: np.frombuffer(r.vec, np.float32) for r in cl.unit_vectors(table, "id", "vec", 64).collect()}
    ids = np.array(sorted(rows))
    truth = [set(ids[x].tolist()) for x in exhaustive(np.stack([rows[i] for i in ids]))]
    got = list(sets_of(cl.clusters(table)[0].collect()).values())
    hit = sum(max(len(t & g) / len(t | g) for g in got) >= 0.9 for t in truth)
    assert truth and hit >= 0.9 * len(truth) and abs(len(got) - len(truth)) <= 0.1 * len(truth)


def means_of(x):
    return cl.Means(np.arange(len(x)), np.ones(len(x), np.int64), np.asarray(x, np.float32))


def test_a_dropped_centre_excludes_nothing(spark):
    rng = np.random.default_rng(2)
    e = np.eye(64)
    a, b, turn = e[0], 0.75 * e[0] + np.sqrt(1 - 0.75**2) * e[1], np.sqrt(1 - 0.75**2) * e[0] - 0.75 * e[1]
    rest = rng.normal(size=(24, 64)) * (np.arange(64) > 1)
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    lean = [0.9 * a + 0.3 * e[1]] * 6 + [0.9 * a - 0.2 * e[1]] * 8 + [0.9 * b + 0.2 * turn] * 5 + [0.9 * b - 0.2 * turn] * 5
    x = np.array(lean)
    x += np.sqrt(1 - (x * x).sum(axis=1, keepdims=True)) * rest
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<float>")
    means = means_of([a, b])
    assert sorted(r["count"] for r in cl.nearest(df, means, 64, 0.75, 0.7).groupBy("centre").count().collect()) == [5, 8]
    members, kept = cl.assigned(df, means, 64, 0.75, 0.7, 10)
    assert kept.count == 1 and {r.id for r in members.collect()} >= set(range(14))
    assert cl.assigned(df, means, 64, 0.75, 0.7, 30)[0] is None


def test_passes_that_do_not_converge_say_so(spark, monkeypatch):
    monkeypatch.setattr(cl, "PASSES", 1)
    vecs, _ = planted(np.random.default_rng(4), [30], 20)
    units = cl.unit_vectors(spark.createDataFrame(list(enumerate(vecs)), VEC), "id", "vec", 64)
    with pytest.warns(UserWarning, match="still move"):
        cl.settled(units, means_of([np.frombuffer(r.vec, np.float32) for r in units.limit(3).collect()]), 64, 0.6, 0.75, 10)


def test_nothing_to_find(spark):
    df = spark.createDataFrame([], VEC)
    assert cl.clusters(df)[0].count() == 0
    same = spark.createDataFrame([(i, [1.0] * 64) for i in range(900)], VEC)  # more than a task sends on singly
    assert {r.cluster_id for r in cl.clusters(same)[0].collect()} == {0}


def test_labels_reach_the_end_of_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)] + [(99,)], "node bigint")
    edges = spark.createDataFrame([((i * 7) % 40, ((i + 1) * 7) % 40) for i in range(39)], "a bigint, b bigint")
    assert {(r.node, r.label) for r in cl.least_labels(nodes, edges).collect()} == {(i, 0) for i in range(40)} | {(99, 99)}
    assert {(r.node, r.label) for r in cl.least_labels(nodes, edges.limit(0)).collect()} == {(i, i) for i in [*range(40), 99]}


def test_blocks_of_means_give_one_answer(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<float>")
    sums = spark.createDataFrame([(i, 2 + i % 3, v.tolist()) for i, v in enumerate(x[:9])], "centre bigint, n bigint, vec array<double>")
    one, some = cl.Means.of(sums, 8, 1), cl.Means.of(sums, 8, 1, block=2)
    assert one.table is None and some.table is not None and some.count == 9
    want = sorted((r.id, r.centre) for r in cl.nearest(df, one, 8, 0.3, 0.7).collect())
    assert sorted((r.id, r.centre) for r in cl.nearest(df, some, 8, 0.3, 0.7, block=2).collect()) == want
    assert sorted(r.id for r in cl.outside(df, some, 8, 0.5).collect()) == sorted(r.id for r in cl.outside(df, one, 8, 0.5).collect())
    assert cl._still(some, some) and not cl._still(some, some.without(np.array([3])))
    doubled = sums.unionByName(sums.withColumn("centre", sums.centre + 100))
    monkeypatch.setattr(cl, "BLOCK", 20)
    assert cl.distinct_means(cl.Means.of(doubled, 8, 1, block=4), 8).count == cl.distinct_means(cl.Means.of(doubled, 8, 1), 8).count
    assert sorted((r.id, r.centre) for r in cl.nearest(df, some.plus(cl.Means.of(sums, 8, 99), 8), 8, 0.3).collect())


def test_matrix_of_slices():
    a = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], pa.list_(pa.float32()))
    assert cl.matrix_of(a.slice(1), 2).tolist() == [[3.0, 4.0], [5.0, 6.0]]
    assert cl.lists_of(np.arange(6.0).reshape(3, 2)).to_pylist() == [[0, 1], [2, 3], [4, 5]]
    assert len(cl.lists_of(np.empty((0, 4)))) == 0
    x = np.arange(6, dtype=np.float32).reshape(3, 2)
    assert cl.matrix_of(cl.bytes_of(x).slice(1), 2).tolist() == [[2.0, 3.0], [4.0, 5.0]] and len(cl.matrix_of(cl.bytes_of(x[:0]), 2)) == 0


def unit_rows(spark, seed, sizes, noise):
    vecs, _ = planted(np.random.default_rng(seed), sizes, noise, cosine=0.8)
    units = cl.unit_vectors(spark.createDataFrame(list(enumerate(vecs)), VEC), "id", "vec", 64)
    rows = {r.id: np.frombuffer(r.vec, np.float32) for r in units.collect()}
    return units, np.stack([rows[i] for i in sorted(rows)])


def test_vectors_are_compared_once_with_means_that_stay_in_place(spark):
    units, x = unit_rows(spark, 8, [40, 30, 20, 12], 200)
    starts = means_of(x[np.random.default_rng(1).choice(len(x), 30, replace=False)])
    lists = cl.Lists.of(units, starts, 64)
    got = cl.settled(lists, starts, 64, 0.6, 0.75, 10)
    want = cl.settled(units, starts, 64, 0.6, 0.75, 10)  # every pass over all means
    assert want.count and np.array_equal(got.ids, want.ids) and np.array_equal(got.n, want.n) and np.allclose(got.x, want.x, atol=1e-6)
    before = lists.compared
    assert np.array_equal(cl.settled(lists, got, 64, 0.75, 0.75, 10).n, want.n)
    assert lists.compared == before  # nothing moved, so no vector is compared with all means again
    assert sorted(r.id for r in lists.outside(got, 0.75).collect()) == sorted(r.id for r in cl.outside(units, got, 64, 0.75).collect())


def test_means_that_turn_far_or_come_late_are_listed(spark):
    units, x = unit_rows(spark, 9, [40, 30, 20], 100)
    rng = np.random.default_rng(3)
    lists = cl.Lists.of(units, means_of(x[rng.choice(len(x), 5, replace=False)]), 64)
    turned = means_of(x[rng.choice(len(x), 5, replace=False)])
    late = lists.number(means_of(x[rng.choice(len(x), 4, replace=False)]))
    both = cl.Means(np.concatenate([turned.ids, late.ids]), np.ones(9, np.int64), np.concatenate([turned.x, late.x]))
    got = sorted((r.id, r.centre, round(r.cosine, 9)) for r in lists.nearest(both, 0.75, 0.7, 11).collect())
    assert got == sorted((r.id, r.centre, round(r.cosine, 9)) for r in cl.nearest(units, both, 64, 0.75, 0.7).collect()) and got
    assert lists.table.count() == len(x) and lists.compared >= 9


@pytest.mark.parametrize("rows, columns", [(0, 5), (5, 0), (3, 3), (1100, 4200)])
def test_products_by_tiles(rows, columns):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(rows, 8)).astype(np.float32), rng.normal(size=(columns, 8)).astype(np.float32)
    c = x @ y.T
    got = set(zip(*(p.tolist() for p in cl.near_pairs(x, y, 6.0)), strict=True))
    assert got ^ set(zip(*(p.tolist() for p in np.nonzero(c >= 6)), strict=True)) <= set(zip(*np.nonzero(np.abs(c - 6) < 1e-4), strict=True))
    best, where = cl.nearest_row(x, y)
    assert np.allclose(best, c.max(axis=1, initial=-2.0), atol=1e-4) and all(abs(c[i, w] - b) < 1e-4 for i, (b, w) in enumerate(zip(best, where, strict=True)) if columns and b > -2)


def test_groups_of_too_few_are_tried_once(spark, monkeypatch):
    """Groups below ten are settled in one round, not in each; they end the rounds sooner and no cluster is lost by it."""
    sizes = [40] * 3 + [12] * 3 + [6] * 60
    vecs, label = planted(np.random.default_rng(7), sizes, 300, cosine=0.95)
    tried, settled = [], cl.settled
    monkeypatch.setattr(cl, "settled", lambda units, means, *a: tried.append(means.count) or settled(units, means, *a))
    got = sets_of(cl.clusters(spark.createDataFrame(list(enumerate(vecs)), VEC))[0].collect())
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, truth_of(label, sizes).values()))
    assert tried[1] >= 50 and len(tried) > 2 and max(tried[2:]) < 20


def test_only_groups_of_too_few_leave(spark):
    sizes = [30, 12, 10, 9, 6, 4]
    vecs, label = planted(np.random.default_rng(5), sizes, 200, cosine=0.9)
    units = cl.unit_vectors(spark.createDataFrame(list(enumerate(vecs)), VEC), "id", "vec", 64)
    x = np.array(vecs) / np.linalg.norm(vecs, axis=1, keepdims=True)
    centres = np.array([x[np.array(label) == k].sum(axis=0) for k in range(6)])
    starts = means_of(centres / np.linalg.norm(centres, axis=1, keepdims=True))
    gone = {r.id for r in cl.too_small(units, starts, 64, 0.75, 10).collect()}
    assert gone == {i for i, k in enumerate(label) if k >= 3}
    assert cl.too_small(units, means_of(np.empty((0, 64))), 64, 0.75, 10).count() == 0
