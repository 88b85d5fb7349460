import numpy as np
import pytest

from arborloom.operators import trees as t


def test_reader_and_writer(spark):
    texts = ["(3 (2 (1 x) (1 y)) (2 z))", "(S w)", "((A a) (B b))", "(A (B b)", "A b)", "", None, "(A (B b)) (C c)", "(X a (Y b) c)"]
    df = spark.createDataFrame(list(enumerate(texts)), "tree_id bigint, tree string")
    nodes = t.read_trees(df)
    got = {r.tree_id: r.tree for r in t.written_trees(nodes).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: "( (A a) (B b))", 8: "(X (a a) (Y b) (c c))"}
    rows = {(r.label, r.l, r.r, r.depth) for r in nodes.where("tree_id = 0").collect()}
    assert rows == {("3", 0, 2, 0), ("2", 0, 1, 1), ("1", 0, 0, 2), ("1", 1, 1, 2), ("2", 2, 2, 1)}
    assert {(r.label, r.span) for r in t.spans(nodes, text=True).where("tree_id = 0").collect()} == {("3", "x y z"), ("2", "x y")}
    same = t.spans(t.read_trees(spark.createDataFrame([(1, "(S (A x) (B y))"), (2, "(Z (N (A x) (B y)) (C z))"), (3, "(S (A y) (B x))")], "tree_id bigint, tree string")))
    by = {(r.tree_id, r.label): r.span for r in same.collect()}
    assert by[1, "S"] == by[2, "N"] and len(set(by.values())) == 3
    rules = {(r.lhs, tuple(r.rhs), r.is_lex) for r in t.productions(nodes).where("tree_id = 0").collect()}
    assert rules == {("3", ("2", "2"), False), ("2", ("1", "1"), False), ("1", ("x",), True), ("1", ("y",), True), ("2", ("z",), True)}


def test_unary_chains_collapse(spark):
    df = spark.createDataFrame([(1, "(A (B (C (D d) (E (F f)))))")], "tree_id bigint, tree string")
    out = t.without_unary(t.read_trees(df)).orderBy("node_id").collect()
    assert [(r.label, r.parent_id, r.child_ix) for r in out] == [("C", -1, 0), ("D", 0, 0), ("F", 0, 1)]


def test_states_to_tree():
    assert t.state_tree(t.parse_states("-::ACT0/AWA0::+::POS1::x -::ACT2/AWA1::-::POS1::y -::ACT3/AWA2::-::POS2::z")) == "(3 (2 (1 x) (1 y)) (2 z))"
    deep = "-::ACT0/AWA0::+::POS1::a -::ACT4/AWA3::+::POS1::b -::ACT4/AWA3;ACT2/AWA5::-::POS5::c +::ACT4/AWA6::-::POS6::d"
    assert t.state_tree(t.parse_states(deep)) == "(4 (1 a) (3 (2 (1 b) (5 c)) (6 d)))"
    assert t.state_tree([(1, 1, 0, 0, 7, "w")]) == "(7 w)"
    for bad in ([(0, 0, 1, 1, 1, "a"), (0, 1, 0, 0, 1, "b")], [(1, 0, 2, 1, 1, "a"), (1, 0, 2, 1, 1, "b")]):
        with pytest.raises(ValueError):
            t.state_tree(bad)


def reduced(words, tags, heads):
    """Heads take all their dependents, side by side, again and again."""
    nodes = [(i, f"({t} {w})", False) for i, (w, t) in enumerate(zip(words, tags), 1)]
    left = {i: sum(h == i for h in heads) for i in range(len(words) + 1)}
    if any(not 0 <= h <= len(words) for h in heads):
        return "(TOP (S error))"
    moved = True
    while moved and len(nodes) > 1:
        moved = False
        for k, (i, _, done) in enumerate(nodes):
            if done or not left[i]:
                continue
            a, b = k, k
            ready = lambda m: heads[nodes[m][0] - 1] == i and (nodes[m][2] or not left[nodes[m][0]])  # noqa: B023, E731
            while a > 0 and ready(a - 1):
                a -= 1
            while b + 1 < len(nodes) and ready(b + 1):
                b += 1
            if b - a == left[i]:
                nodes[a : b + 1] = [(i, "(X " + " ".join(n[1] for n in nodes[a : b + 1]) + ")", True)]
                moved = True
                break
    return nodes[0][1] if len(nodes) == 1 and heads[nodes[0][0] - 1] == 0 else "(TOP (S error))"


def test_dependencies_to_tree(spark):
    assert t.dependency_tree(["a", "b", "c"], ["D", "N", "V"], [2, 3, 0]) == "(X (X (D a) (N b)) (V c))"
    assert t.dependency_tree(["a", "b", "c"], ["D", "N", "V"], [2, 0, 2]) == "(X (D a) (N b) (V c))"
    assert t.dependency_tree(["a", "b"], ["X", "Y"], [2, 1]) == t.dependency_tree(["a", "b"], ["X", "Y"], [0, 0]) == t.dependency_tree(["a"], ["X"], [5]) == "(TOP (S error))"
    assert t.dependency_tree(["(a"], ["X"], [0]) == "(X -LRB-a)" and t.dependency_tree([], [], []) == "(TOP (S error))"
    rng = np.random.default_rng(3)
    seen = set()
    for _ in range(400):
        n = int(rng.integers(1, 7))
        heads = [int(h) for h in rng.integers(0, n + 1, n)]
        words, tags = [f"w{i}" for i in range(n)], [f"T{i}" for i in range(n)]
        got = t.dependency_tree(words, tags, heads)
        assert got == reduced(words, tags, heads)
        seen.add(got == "(TOP (S error))")
    assert seen == {True, False}
    df = spark.createDataFrame([(["a", "b"], ["X", "Y"], [2, 0]), (None, None, None)], "w array<string>, t array<string>, h array<int>")
    assert [r.tree for r in t.mapped(df, t.dependency_tree, "tree", "w", "t", "h").collect()] == ["(X (X a) (Y b))", None]


def test_random_trees_are_binary_and_seeded():
    a = t.random_binary_tree(list("abcdef"), list("UVWXYZ"), 5)
    assert a == t.random_binary_tree(list("abcdef"), list("UVWXYZ"), 5)
    rows = t.read_tree(a)
    assert sum(r[4] is not None for r in rows) == 6 and all(r[8] in (0, 2) for r in rows)


def test_repair(spark):
    p = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "tree_id bigint, leaf_ix int, word string")
    g = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (2, 0, "C"), (2, 1, "D")], "tree_id bigint, leaf_ix int, word string")
    assert sorted(map(tuple, t.repaired(p, g).collect())) == [(1, 0, "A"), (1, 1, "B"), (2, 0, "z")]


def test_heads_navigation_and_incremental_parse(spark):
    model = {("S", "VP"): 0.9, ("S", "NP"): 0.1, ("NP", "N"): 0.7, ("NP", "D"): 0.3, ("VP", "V"): 1.0}
    tree = "(S (NP (D the) (N dog)) (VP (V barks)))"
    assert t.head_dependencies(tree, model) == [(1, 2), (2, 3), (3, 0)]
    assert t.head_dependencies("(S (NP) (VP (V barks)))", model) == [(1, 0)] and t.head_dependencies("(S)", model) == []
    nodes = t.read_trees(spark.createDataFrame([(1, tree)], "tree_id bigint, tree string"))
    got = {(r.node_id, r.distance, r.ancestor_id) for r in t.ancestors(nodes).collect()}
    assert {x for x in got if x[0] == 3} == {(3, 1, 1), (3, 2, 0)} and {x for x in got if x[0] == 5} == {(5, 1, 4), (5, 2, 0)}
    assert {(r.node_id, r.next_id) for r in t.siblings(nodes).collect()} == {(1, 4), (4, None), (2, 3), (3, None), (5, None)}
    assert t.covering(nodes, 0, 1).first().node_id == 1
    m = spark.createDataFrame([(a, b, p) for (a, b), p in model.items()], "lhs string, child string, p double")
    assert t.dependencies_of(spark.createDataFrame([(1, tree)], "tree_id bigint, tree string"), m).count() == 3
    steps = t.parse_states("-::ACT0/AWA0::+::POS1::x -::ACT2/AWA1::-::POS1::y -::ACT3/AWA2::-::POS2::z")
    lines = t.incremental_parse(steps)
    assert lines[0] == "4 1;-.0/-.0;-.0/-.0;-.0/-.0;-.0/-.0;99_;0/0/0,0/0/0,0/0/0,0/0/0 null" and lines[-2:] == [t.FIRST_STATE, t.DIVIDER]
    assert lines[-3] == "1 0;2_/1_;-.0/-.0;-.0/-.0;-.0/-.0;1_;0/0/0,0/0/0,0/0/0,0/0/0 x"
    rows = spark.createDataFrame([(1, "-::ACT0/AWA0::+::POS1::(x -::ACT2/AWA1::-::POS1::y_^"), (2, None), (3, "x")], "id int, states string")
    got = {r.id: r.parse for r in t.incremental_parses(rows).collect()}
    assert got[1].split("\n")[1].endswith(" y-UNDERSCORE--CARAT-") and got[1].split("\n")[2].endswith(" -LRB-x") and got[2] is None and got[3] is None


def test_text_forms(spark):
    from pyspark.sql import functions as F

    from arborloom.operators import text as x

    r = spark.range(1).select(
        x.expand_morphs(F.lit("(NP a/NN+b/PAN)")).alias("a"), x.expand_morphs(F.lit(f"(S (NP a/{'N' * 45}+b/P) (VP c/V d (X e/f/G)))")).alias("h"),
        x.tag_morphs(F.lit("ab"), F.lit("a+b++"), F.lit("N")).alias("i"), x.tag_morphs(F.lit("ab"), F.lit(None).cast("string"), F.lit("N+V")).alias("j"),
        x.escape_brackets(F.lit("(<[{^_}]>)")).alias("k"), t.labelled(F.lit("((a b) c)")).alias("l"), x.state_stream(F.lit("-::ACT0/AWA1::+::POS3::w -::ACT2/AWA2::-::POS4::v"), "POS").alias("b"),
        x.shallow_tree(F.lit("(S-d1 (A-d2 x))"), 1).alias("c"), x.shallow_tree(F.lit("(S-d3 x)"), 2).alias("d"),
        x.code_places(F.lit("<tr><td>eng|fra:</td> <td>Paris; Lyon</td></tr>")).alias("e"), x.fold_case(F.lit("N/The v/Old")).alias("f"), x.fold_case(F.lit("The Old a/B")).alias("g"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.f, r.g) == ("(NP (NN a) (PAN b))", "POS3 POS4", True, False, "N/the v/old", "the old a/B")
    assert r.h == f"(S (NP ({'N' * 45} a) (P b)) (VP (V c) d (X (G e/f))))" and r.i == ["N/a", "/b"] and r.j == ["N+V/ab"]
    assert r.k == "-LRB--LTB--LSB--LCB--CARAT--UNDERSCORE--RCB--RSB--RTB--RRB-"
    assert r.l == "(X (X (X a) (X b)) (X c))"
    assert [tuple(p) for p in r.e] == [("eng", "Paris"), ("eng", "Lyon"), ("fra", "Paris"), ("fra", "Lyon")]
