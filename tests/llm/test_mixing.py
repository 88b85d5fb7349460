import random

from arborloom.llm import mixing

DOCS = "doc_id bigint, text string, source string"


def corpus(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(1, 60), "big" if i % 3 else rng.choice(["mid", "small", "other", None])) for i in range(900)]
    rows += [(None, "x", "big"), (1000, None, "big"), (1001, "", "mid")] + rows[:30]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as key", "2 as bucket", "3 as weight")


def test_shares_and_limits(spark):
    targets = spark.createDataFrame(
        [("big", 0.5, 1), ("mid", 0.3, 4), ("small", 0.2, 3), ("absent", 0.1, 2), (None, 0.1, 2), ("other", None, 1)],
        "source string, weight double, max_repeats int",
    )
    labels = spark.createDataFrame([(i, 1 + i % 5) for i in range(0, 900, 7)] + [(3, None)], "doc_id bigint, quality int")
    chosen, shares = mixing.mix(corpus(spark), targets, labels)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    limit = {"big": 1, "mid": 4, "small": 3}
    assert all(1 <= r.repeats <= limit[r.source] for r in rows)
    for s in limit:
        assert len({r.repeats for r in rows if r.source == s}) <= 2
    got = {r.source: r for r in shares.collect()}
    assert [s for s, r in got.items() if r.binding] == ["mid"]
    assert all(r.repeats_kept and r.budget_kept and r.once for r in mixing.kept_bounds(chosen, shares).collect())
    assert got["absent"].tokens == 0 and set(got) == {"big", "mid", "small", "absent"}
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(got[s].share - w) < 0.005
        assert abs(got[s].tokens - got[s].budget) <= 40
    assert sorted(map(tuple, mixing.mix(corpus(spark), targets, labels)[0].collect())) == sorted(map(tuple, rows))


def test_quality_raises_the_chance(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s") for i in range(4000)], DOCS)
    labels = spark.createDataFrame([(i, 5 if i % 2 else 1) for i in range(4000)], "doc_id bigint, quality int")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, weight double, max_repeats int")
    rows = mixing.mix(docs, targets, labels, total=4000)[0].collect()
    assert 990 <= len(rows) <= 1010
    assert sum(r.doc_id % 2 for r in rows) > 3 * sum(1 - r.doc_id % 2 for r in rows)


def test_budgets_and_empty(spark):
    assert mixing.budgets({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 3)}) == {"a": 30, "b": 30}
    assert mixing.budgets({}, {"a": (1.0, 1)}) == {}
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, weight double, max_repeats int")
    docs = spark.createDataFrame([], DOCS)
    chosen, shares = mixing.mix(docs, targets)
    assert chosen.count() == 0 and [r.tokens for r in shares.collect()] == [0]
