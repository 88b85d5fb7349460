import pytest
from pyspark.sql import functions as F

from arborloom.functions import scalars
from arborloom.operators import metrics, tables, text, trees


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_conditional_tables(spark):
    t = spark.createDataFrame([("a", "x", 0.25), ("a", "y", 0.75), ("ab", "x", 1.0), (None, "z", 0.5), ("", "w", 0.0)], "cond string, out string, p double")
    assert tuple(tables.entries(t).first()) == (3, 5)
    assert {r.cond for r in tables.without_conditions(t, "b").collect()} == {"a", None, ""}
    assert {r.line for r in tables.printed(t, "R").collect()} == {"R a : x = 0.25", "R a : y = 0.75", "R ab : x = 1.0", "R z = 0.5"}
    assert [(r.cond, r.out) for r in tables.descending(t).collect()] == [(None, "z"), ("", "w"), ("a", "y"), ("a", "x"), ("ab", "x")]
    keys = spark.createDataFrame([("a", "x"), ("q", "x")], "cond string, out string")
    assert rows(tables.looked_up(keys, t, ["cond", "out"])) == [("a", "x", 0.25), ("q", "x", 0.0)]
    fresh = spark.createDataFrame([("a", "x", 1.0), ("n", "m", 1.0)], "cond string, out string, p double")
    assert ("a", "x", 0.4375) in rows(tables.damped(t.where("cond = 'a'"), fresh, ["cond", "out"], 0.25)) and ("n", "m", 0.25) in rows(tables.damped(t.where("cond = 'a'"), fresh, ["cond", "out"], 0.25))


def test_counts(spark):
    c = spark.createDataFrame([("a", 2), ("b", 1)], "k string, cnt bigint")
    assert rows(tables.counted_up(c, spark.createDataFrame([("a", -2), ("c", 3)], "k string, cnt bigint"), ["k"])) == [("b", 1), ("c", 3)]
    with pytest.raises(Exception, match="negative"):
        tables.counted_up(c, spark.createDataFrame([("b", -2)], "k string, cnt bigint"), ["k"]).collect()


def test_series_and_steps(spark):
    s = spark.createDataFrame([(10, 1.0), (2, 2.0), (5, 3.0)], "iter int, value double")
    assert [r.iter for r in tables.after_burn_in(s, 3).collect()] == [5, 10] and [r.iter for r in tables.after_burn_in(s, 1, 9).collect()] == [2, 5]
    steps = spark.createDataFrame([(1, p, 6, f, j) for p, (f, j) in enumerate([(1, 0), (1, 0), (1, 0), (0, 0), (1, 1), (0, 1)])], "sent_id int, pos int, n int, f int, j int")
    assert rows(tables.center_events(steps, "sent_id")) == [(1, 1)]
    o = tables.branching_odds(steps, "sent_id").first()
    assert (o.deep_share, o.left_share) == (2 / 6, 0.5)
    assert tuple(tables.used_states(steps, "pos", 5).first()) == (5, 0, 6, True) and not tables.used_states(steps, "pos", 4).first().valid
    lengths = spark.createDataFrame([(7, 3, 3), (8, 3, 0), (9, 10_003, 10_000)], "sent_id bigint, upto bigint, n bigint")
    at = spark.createDataFrame([(0,), (2,), (3,), (9_000,), (10_003,)], "ix bigint")
    assert rows(tables.located(lengths, at)) == [(0, 7, 0), (2, 7, 2), (3, 9, 0), (9_000, 9, 8_997)]


def test_log_arrays(spark):
    r = spark.range(1).select(
        scalars.normalised_from_log(F.array(F.lit(-400.0), F.lit(-400.0), F.lit(None).cast("double"))).alias("a"), scalars.as_log(F.lit(0.0)).alias("b"),
        scalars.from_log(scalars.as_log(F.lit(0.25))).alias("c"), scalars.from_log(F.lit(None).cast("double")).alias("d"), scalars.lgamma(F.lit(5.0)).alias("e"), scalars.lgamma(F.lit(-1.0)).alias("f"),
        scalars.dirichlet_constant(F.array(F.lit(1.0), F.lit(2.0)), 1.0).alias("g"), scalars.dirichlet_constant(F.lit(None).cast("array<double>"), 1.0).alias("h"),
    ).first()
    assert r.a == [0.5, 0.5, 0.0] and r.b is None and r.c == pytest.approx(0.25) and r.d == 0.0 and r.e == pytest.approx(3.1780538) and r.f is None
    assert r.g == pytest.approx(0.6931472 - 3.1780538) and r.h is None


def test_ranks_in_ranges_and_leftovers(spark):
    a = spark.createDataFrame([(i, "the") for i in range(0, 50, 5)] + [(3, "x")], "o bigint, v string")
    b = spark.createDataFrame([(i, "the") for i in range(100, 112)] + [(7, "y")], "o bigint, v string")
    got = {(r.row_order, r.ref_order, r["rank"]) for r in text.in_reference_order(a, b, "o", "v", width=7).collect()}
    assert got == {(5 * k, 100 + k, k + 1) for k in range(10)}
    assert rows(text.leftovers(a, b, "v")) == [("the", 10, 12), ("x", 1, 0), ("y", 0, 1)]


def test_scorer_settings(spark):
    n = trees.read_trees(spark.createDataFrame([(1, "(S (NP (D a) (N b)) (PU .))"), (2, "(S (NP (D a) (N b)) (VP (V c) (N d)))")], "tree_id bigint, tree string"))
    s = trees.spans(n)
    assert metrics.scored_spans(n, s).count() == 5 and {r.tree_id for r in metrics.scored_spans(n, s, cutoff=2, deleted=("PU",)).collect()} == {1}
    assert {r.label for r in metrics.scored_spans(n, s, deleted=("NP",)).collect()} == {"S", "VP"}
    leaves = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "tree_id bigint, leaf_ix int, word string")
    other = spark.createDataFrame([(1, 0, "a"), (2, 0, "x")], "tree_id bigint, leaf_ix int, word string")
    assert {r.tree_id for r in metrics.within_errors(leaves, other).collect()} == {1, 2}
    with pytest.raises(ValueError):
        metrics.within_errors(leaves, other, most=1)


def test_cleaned_and_proper_trees(spark):
    df = spark.createDataFrame([(1, "(S (NP (-NONE- *)) (VP (V Runs) (NP (N Dogs))) (. .))"), (2, "(S (. .))"), (3, "(S (A"), (4, None)], "tree_id bigint, tree string").selectExpr("*", "1 as label")
    assert rows(trees.cleaned(df)) == [(1, "(VP (V runs) (N dogs))")]
    p = trees.proper_trees(spark.createDataFrame([(1, "((a b) (c))")], "tree_id bigint, tree string"))
    assert [(r.node_id, r.parent_id, r.word) for r in p.orderBy("node_id").collect()] == [(0, -1, None), (1, 0, None), (2, 1, "a"), (3, 1, "b"), (4, 0, "c")]


def test_permutations_do_not_depend_on_partitions(spark):
    p = spark.createDataFrame([(i, i % 5, 6, (i + 2) % 5, 6, 6) for i in range(300)], "tree_id bigint, m_a bigint, s_a bigint, m_b bigint, s_b bigint, g bigint")
    one, two = (sorted(map(tuple, metrics.permutation_sums(p.repartition(k), 50).collect())) for k in (1, 7))
    assert one == two and len(one) == 51
    last = metrics.running_p_values(p, 50).where("i = 50").first().p_value
    assert last == metrics.permutation_test(p, 50).first().p_value
    assert 0.4 < metrics.coins(__import__("numpy").arange(1000), 20).mean() < 0.6
