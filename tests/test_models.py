import itertools
import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arborloom.functions import scalars
from arborloom.operators import generate, grammar, inference, metrics, sampler, states, trees
from arborloom.plans.grammar import hmm, toy


def test_delta_and_gamma_of_one_category():
    p = np.zeros((2, 2, 2))
    p[1, 1, 1] = 0.3
    a, b = grammar.delta(p, np.array([0, 0.7]), 1)
    assert a[0, 1] == pytest.approx(0.886076, abs=1e-6) and b[0, 1] == pytest.approx(0.7)
    assert grammar.gamma(p, a, b)[0][0, 1, 1, 1] == pytest.approx(0.21)


def test_component_models_are_distributions():
    c = grammar.components(*toy(), 3)
    assert [len(x) for x in c[:5]] == [3] * 5
    for x in c:
        s = x.sum(axis=-1)
        assert np.all((np.abs(s - 1) < 1e-9) | (s == 0))
        assert not x[..., -1].any() or x.shape[-1] == 2


@pytest.mark.parametrize("depth", [1, 2])
def test_transitions_stay_in_the_enumerated_states(spark, depth):
    c = grammar.components(*toy(), depth)
    size = c.pos.shape[0]
    valid = {r.state for r in states.valid_states(spark, size, depth).collect()}
    rows = states.transitions(spark, c).collect()
    mass = {}
    for r in rows:
        mass[r.prev] = mass.get(r.prev, 0) + r.p
        if r.nxt != states.end_index(size, depth):
            tags = np.flatnonzero(states.tag_given_state(c, np.array([r.nxt]))[0])
            assert all(r.nxt * size + g in valid for g in tags)
    assert all(m <= 1 + 1e-9 for m in mass.values()) and mass[0] == 1
    # States that can be reached pass their whole mass on.
    reach, todo = set(), [0]
    nxt = {}
    for r in rows:
        nxt.setdefault(r.prev, []).append(r.nxt)
    while todo:
        for v in nxt.get(todo.pop(), []):
            if v != states.end_index(size, depth):
                for g in np.flatnonzero(states.tag_given_state(c, np.array([v]))[0]):
                    if v * size + g not in reach:
                        reach.add(int(v * size + g))
                        todo.append(int(v * size + g))
    assert reach and all(mass[s] == pytest.approx(1, abs=1e-6) for s in reach)


def test_chain_against_all_paths():
    ch = hmm()
    a, e, start = np.array([[0.6, 0.4], [0.3, 0.7]]), np.array([[0.9, 0.2], [0.1, 0.8]]), [0.5, 0.5]
    for obs in ([0], [0, 1, 1], [1, 0, 1, 1, 0]):
        ps = {}
        for path in itertools.product((0, 1), repeat=len(obs)):
            p = start[path[0]] * e[obs[0], path[0]]
            for i in range(1, len(obs)):
                p *= a[path[i - 1], path[i]] * e[obs[i], path[i]]
            ps[path] = p
        assert ch.forward(obs)[1] == pytest.approx(math.log10(sum(ps.values())))
        best = max(ps, key=ps.get)
        assert tuple(ch.viterbi(obs)[0]) == best and ch.viterbi(obs)[1] == pytest.approx(math.log10(ps[best]))
        assert tuple(ch.viterbi(obs, 2, 2)[0]) == best
        sparse = hmm()
        sparse.dense = None
        assert sparse.viterbi(obs) == ch.viterbi(obs)
        draws = [tuple(ch.sample(obs, np.random.default_rng(i))[0]) for i in range(3000)]
        for path, p in ps.items():
            assert draws.count(path) / 3000 == pytest.approx(p / sum(ps.values()), abs=0.04)


def test_inference_rows(spark):
    df = spark.createDataFrame([(1, [0, 1, 1]), (2, []), (3, None), (4, [0, 9])], "sent_id bigint, obs array<int>")
    got = {r.sent_id: r for r in inference.inferred(df, hmm(), "viterbi").collect()}
    assert got[1].path == [0, 1, 1] and got[2].path == [] and got[3].success and not got[4].success and got[4].error
    one = sorted(map(tuple, inference.inferred(df, hmm(), "sample", seed=1).select("sent_id", "path").collect()))
    assert one == sorted(map(tuple, inference.inferred(df.repartition(7), hmm(), "sample", seed=1).select("sent_id", "path").collect()))


@pytest.mark.parametrize("depth", [1, 2])
def test_training_gives_trees_of_the_sentences(spark, tmp_path, depth):
    rows = [(i, [1 + (i + k) % 4 for k in range(2 + i % 4)]) for i in range(30)]
    sents = spark.createDataFrame(rows, "sent_id bigint, toks array<int>")
    s = sampler.Settings(categories=2, depth=depth, iterations=2, output=str(tmp_path))
    rules, series = sampler.train(sents, 4, s)
    assert [i for i, _ in series] == [0, 1] and all(p < 0 for _, p in series)
    total = {r.lhs: r.p for r in rules.groupBy("lhs").sum("p").withColumnRenamed("sum(p)", "p").collect()}
    assert all(v == pytest.approx(1) for v in total.values())
    counts = spark.read.parquet(f"{tmp_path}/iter=1")
    words = counts.where("is_lex and lhs > 0").groupBy().sum("cnt").first()[0]
    assert words == sum(len(t) for _, t in rows)
    assert sampler.train(sents, 4, s, resume=1)[1][0][0] == 2
    assert sampler.train(sents.limit(0), 4, s)[1] == []


def test_state_paths_and_trees_agree():
    steps = [(1, 0, 4, 3, 1, "a"), (1, 0, 2, 5, 1, "b"), (0, 1, 0, 6, 5, "c"), (0, 1, 0, 0, 6, "d")]
    tree = trees.state_tree(steps)
    r = sampler.rules_of(tree)
    assert r[4, "1", "3", False] == 1 and r[3, "2", "6", False] == 1 and r[0, "4", "0", False] == 1 and r[0, "-ROOT-", None, True] == 1


def test_measures(spark):
    f = lambda a, b: spark.createDataFrame(list(zip(a, b)), "g int, s int")
    row = lambda a, b: metrics.v_measure(metrics.information(f(a, b), "g", "s")).first()
    assert (row([0, 0, 1, 1], [0, 0, 1, 1]).v, row([0, 0, 1, 1], [0, 0, 1, 1]).vi) == (1, 0)
    r = row([0, 0, 1, 1], [0, 0, 0, 1])
    assert (r.homogeneity, r.completeness, r.v, r.vi) == (0.311278, 0.383689, 0.343711, 1.188722) or abs(r.v - 0.343711) < 2e-6
    assert row([0, 0], [0, 0]).v is None
    assert [x.p for x in metrics.distribution(spark.createDataFrame([(0,), (0,), (1,), (3,)], "id int"), "id").orderBy("id").collect()] == [0.5, 0.25, 0, 0.25]


def test_generated_trees(spark):
    g = generate.random_grammar(3, 5, seed=2)
    assert all(sum(w for _, w in rules) == pytest.approx(1) for rules in g.values())
    rows = generate.sampled_trees(spark, g, 40, seed=1).collect()
    assert len(rows) == 40 and all(trees.read_tree(r.tree) for r in rows)
    assert sorted(map(tuple, generate.sampled_trees(spark, g, 40, seed=1).collect())) == sorted(map(tuple, rows))


def test_layered_grammar(spark):
    g = generate.layered_grammar(2, 3, 2, 6, seed=1, branching=0.7, recursion=0.4, termination=0.2)
    assert all(sum(w for _, w in options) == pytest.approx(1) for options in g.values())
    share = lambda c, f: sum(w for rhs, w in g[c] if f(rhs))
    assert share("B1", lambda r: r[0][0] == "P" and r[1][0] == "P") == pytest.approx(0.2) and share("A2", lambda r: r[0][0] == "A" and r[1][0] == "B") == pytest.approx(0.8 * 0.4)
    rows = generate.sampled_trees(spark, g, 60, seed=5, most_depth=1, layered=9)
    n = trees.read_trees(rows)
    assert generate.embedding_depth(n).where("depth > 1").count() == 0 and n.select("tree_id").distinct().count() == 60
    assert n.agg(F.max("depth")).first()[0] <= 11
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, generate.sampled_trees(spark, g, 60, seed=5, most_depth=1, layered=9).repartition(3).collect()))
    model = spark.createDataFrame([("R", ["T"], ["x", "-"], 1.0), ("R", ["x"], ["a"], 0.5), ("R", ["x"], ["x", "x"], 0.5), ("Q", ["x"], ["z"], 1.0)], "id string, cond array<string>, out array<string>, p double")
    assert generate.rules_of_model(model) == {"T": [(("x",), 1.0)], "x": [(("a",), 0.5), (("x", "x"), 0.5)]}


def test_alpha_step_stays_inside():
    rng = np.random.default_rng(0)
    a = 0.2
    for _ in range(50):
        a = sampler.alpha_step(a, [(4, float(np.log(rng.dirichlet([0.5] * 4)).sum())) for _ in range(3)], 0.05, 0.4, rng, sd=0.1)
        assert 0.05 < a < 0.4


def test_scalars(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(
        scalars.deepest(F.array(F.lit(2), F.lit(1), F.lit(0))).alias("a"), scalars.deepest(F.array(F.lit(0), F.lit(0))).alias("b"), scalars.deepest(F.array(F.lit(2), F.lit(1))).alias("c"),
        scalars.file_label(F.lit(0.25)).alias("d"), scalars.first_non_negative(F.array(F.lit(-1), F.lit(0))).alias("e"), scalars.lgamma(F.lit(5.0)).alias("f"), scalars.harmonic(F.lit(0.0), F.lit(0.5)).alias("g"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, round(r.f, 6), r.g) == (1, -1, 1, "0p25", 1, 3.178054, 0)
    assert scalars.range_values("1:0.5:2") == [1, 1.5, 2] and scalars.range_values("3") == [3] and scalars.range_values("1:3") == [1, 2, 3]


def test_pruned_forward_and_more_scalars(spark):
    from pyspark.sql import functions as F

    assert hmm().forward([0, 1, 1], prune=1e9)[1] == pytest.approx(hmm().forward([0, 1, 1])[1])
    assert hmm().forward([0, 1, 1], prune=2)[1] < hmm().forward([0, 1, 1])[1]
    r = spark.range(1).select(scalars.dirichlet_constant(F.array(F.lit(1.0), F.lit(2.0)), 1.0).alias("a"), scalars.tempered(F.array(F.lit(0.2), F.lit(0.8)), 0.5).alias("b")).first()
    assert r.a == pytest.approx(math.lgamma(2) + math.lgamma(3) - math.lgamma(5)) and r.b == pytest.approx([0.04 / 0.68, 0.64 / 0.68])


def test_series(spark):
    chain = spark.createDataFrame([(i, f"r{k}", 0.1 * k + 0.01 * i * (k % 2)) for i in range(6) for k in range(3)], "iter int, rule string, p double")
    assert metrics.posterior_components(chain, ["r0", "r1", "r2"], 2).count() == 6
    s = spark.createDataFrame([("a", 1, "f1", 0.5), ("a", 1, "vi", 2.0), ("a", 2, "f1", 0.6)], "run string, iter int, metric string, value double")
    assert sorted(map(tuple, metrics.collected(s, ["f1", "vi"]).collect())) == [("a", 1, 0.5, 2.0), ("a", 2, 0.6, None)]
    best = spark.createDataFrame([("a", 1, -5.0), ("b", 2, -3.0), ("b", 4, -3.0)], "run string, iter int, logprob double")
    assert tuple(sampler.best_of(best).first()) == ("b", 2, -3.0)


def test_log_gamma_and_gammas():
    x = np.array([1e-3, 0.5, 1, 2.5, 7.99, 8, 100, 1e6])
    assert np.allclose(scalars.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12) and np.isnan(scalars.log_gamma(np.array([0.0, -1.0]))).all()
    keys = np.arange(40_000)
    for shape in (0.3, 1.0, 6.5):
        g = scalars.gammas(keys, np.full(len(keys), shape))
        assert (g > 0).all() and abs(g.mean() / shape - 1) < 0.03 and abs(g.var() / shape - 1) < 0.08
        assert (scalars.gammas(keys[::-1], np.full(len(keys), shape))[::-1] == g).all()
    u, z = scalars.uniforms(keys, 3), scalars.normals(keys, 2)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.01 and abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02


def test_blocks_equal_single_sentences():
    rng = np.random.default_rng(1)
    a = rng.dirichlet(np.ones(5), 5) * (rng.random((5, 5)) > 0.4)
    prev, nxt = np.nonzero(a)
    for dense in (True, False):
        c = inference.Chain(rng.dirichlet(np.ones(5)), prev, nxt, a[prev, nxt], rng.random(5), rng.random((4, 5)), np.arange(5))
        if not dense:
            c.dense = None
        obs = rng.integers(0, 4, (60, 6))
        obs[3, 2] = 9
        alphas, log, dead = c.forward_block(obs)
        path, best, gone = c.viterbi_block(obs)
        for i, o in enumerate(obs.tolist()):
            if dead[i] >= 0:
                with pytest.raises(ValueError):
                    c.forward(o)
                assert gone[i] >= 0
                continue
            assert c.forward(o)[1] == pytest.approx(log[i]) and np.allclose(c.forward(o)[0][-1], alphas[-1][i])
            assert c.viterbi(o) == (path[i].tolist(), pytest.approx(best[i]))
            p = np.log10(c.start[path[i][0]] * c.emission[o[0], path[i][0]])
            for k in range(1, len(o)):
                p += np.log10(a[path[i][k - 1], path[i][k]] * c.emission[o[k], path[i][k]])
            assert p + np.log10(c.end[path[i][-1]]) == pytest.approx(best[i])
        length = np.sort(rng.integers(1, 7, 60))[::-1]
        mixed = np.where(np.arange(6) < length[:, None], obs, -1)
        (_, log2, dead2), (path2, best2, gone2) = c.forward_block(mixed, length=length), c.viterbi_block(mixed, length=length)
        some, _, _ = c.sample_block(mixed, lambda t: np.full(len(obs), 0.3), length)
        for i, n in enumerate(length.tolist()):
            o = mixed[i, :n].tolist()
            if dead2[i] >= 0:
                assert gone2[i] >= 0
                continue
            assert c.forward(o)[1] == pytest.approx(log2[i]) and c.viterbi(o) == (path2[i, :n].tolist(), pytest.approx(best2[i]))
            assert some[i, :n].tolist() == c.sample_block(np.array([o]), lambda t: np.full(1, 0.3))[0][0].tolist()
        drawn, _, lost = c.sample_block(obs, lambda t: np.full(len(obs), 0.3))
        assert all((a[r[:-1], r[1:]] > 0).all() for r, x in zip(drawn, lost) if x < 0)


def test_state_orders(spark):
    s = spark.createDataFrame([(1, [2, 0], [3, 0], 0, 4), (0, [2, 5], [3, 1], 1, 4)], "j int, a array<int>, b array<int>, f int, g int").select(F.struct("*").alias("s"))
    got = s.select(*(states.state_text(F.col("s"), o).alias(o) for o in ("jabfg", "fjabg", "whole"))).collect()
    assert [tuple(r) for r in got] == [
        ("+::ACT2/AWA3::-::POS4", "-::+::ACT2/AWA3::POS4", "J+::ACT2/AWA3::ACT0/AWA0::F-::POS4"), ("-::ACT2/AWA3;ACT5/AWA1::+::POS4", "+::-::ACT2/AWA3;ACT5/AWA1::POS4", "J-::ACT2/AWA3::ACT5/AWA1::F+::POS4"),
    ]
    with pytest.raises(ValueError):
        states.state_text(F.col("s"), "x")


def test_trainer_options(spark):
    rng = np.random.default_rng(2)
    sents = spark.createDataFrame([(i, [int(x) for x in rng.integers(1, 4, 4)]) for i in range(30)], "sent_id bigint, toks array<int>")
    seen = []
    how = sampler.Settings(
        categories=2, iterations=7, restarts=2, start="left_branching", sample_alpha=True, alpha_array=True, init_anneal=0.5, anneal_length=4, anneal_phases=2, best_of_phase=True,
        cooling_start=6, cooling_length=1, cooling_target=3.0, checkpoint=lambda it, rules: seen.append((it, rules.count())),
    )
    rules, series = sampler.train(sents, 3, how)
    assert [i for i, _ in series] == list(range(7)) and [i for i, _ in seen] == list(range(7))
    assert {r.lhs: round(r.m, 6) for r in rules.groupBy("lhs").agg(F.sum("p").alias("m")).collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    assert [sampler.annealing_value(i, how) for i in (0, 2, 4, 5)] == [0.5, 0.75, 1.0, 3.0]
    scaled = sampler.train(sents, 3, sampler.Settings(categories=2, iterations=1, alpha_scale=0.05))
    assert len(scaled[1]) == 1 and sampler.scaled_alphas(120, 30, 3, 2, 0.05) == (0.05 * 90 / 8, 0.05 * 120 / 6)
    for bad in (0.0, 1.5, 0.9):
        with pytest.raises(ValueError):
            sampler.scaled_alphas(1200, 30, 3, 2, bad)


@pytest.mark.parametrize("toks", [[[7] * 40, [7] * 25], [[7, None]], [[None, None]], []])
def test_alpha_split_of_any_corpus(spark, tmp_path, toks):
    """Many words of one type, null words, no words: the figures SQL gives, also over 1."""
    from arborloom.plans import ORACLES, QUERIES

    rows = [(i, t, [1] * len(t), "c") for i, t in enumerate(toks)]
    spark.createDataFrame(rows, "sent_id bigint, toks array<int>, tags array<int>, corpus string").write.parquet(f"{tmp_path}/ev_seqs.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW ev_seqs AS SELECT * FROM '{tmp_path}/ev_seqs.parquet/*.parquet'")
    assert [str(tuple(r)) for r in QUERIES["alpha_split"](spark, str(tmp_path)).collect()] == [str(r) for r in con.execute(ORACLES["alpha_split"]).fetchall()]


def test_large_model_of_rules(spark):
    """40,000 words of one category: the time grows with the rules, not with their square; each node draws as ``Generator.choice`` does."""
    words = spark.range(40_000).select(F.lit("R").alias("id"), F.array(F.lit("x")).alias("cond"), F.array(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("out"), (F.lit(0.6) / 40_000).alias("p"))
    inner = spark.createDataFrame([("R", ["T"], ["x"], 1.0), ("R", ["x"], ["x", "x"], 0.4)], "id string, cond array<string>, out array<string>, p double")
    began = time.perf_counter()
    rules = generate.rules_of_model(words.unionByName(inner))
    assert time.perf_counter() - began < 20 and len(rules["x"]) == 40_001 and sum(w for _, w in rules["x"]) == pytest.approx(1)

    def plain(symbol, rng, depth=0):
        options = [r for r in rules[symbol] if depth < 4 or len(r[0]) == 1]
        p = np.array([w for _, w in options])
        rhs = options[int(rng.choice(len(options), p=p / p.sum()))][0]
        return f"({symbol} {' '.join(plain(x, rng, depth + 1) if x in rules else x for x in rhs)})"

    made = generate.sampled_trees(spark, rules, 12, seed=3, most_depth=4).collect()
    assert [r.tree for r in made] == [plain("T", np.random.Generator(np.random.Philox(key=[3, r.tree_id]))) for r in made]


def test_model_of_more_rules_than_are_held(spark, monkeypatch):
    """Trees come from blocks of rules as from a dictionary of all of them, whatever the size of a block; rules of one symbol that is a category, of
    several words, written twice and with an empty right side among them.
    """
    rng = np.random.default_rng(3)
    rows = [("R", [c], [f"w{k}"], float(rng.random())) for c in ("x", "y") for k in range(150)]
    rows += [("R", ["x"], ["x", "y"], 40.0), ("R", ["x"], ["y"], 9.0), ("R", ["y"], ["w7", "x"], 60.0), ("R", ["y"], ["v", "w"], 5.0), ("R", ["y"], ["w3", "-"], 3.0), ("R", ["x"], ["-"], 2.0)]
    rows += [("R", ["T"], ["x", "-"], 1.0), ("R", ["T"], ["z"], 0.5), ("R", ["z"], ["x", "x"], 1.0), rows[5], ("R", ["y"], ["q"], 0.0), ("Q", ["x"], ["other"], 9.0)]
    model = spark.createDataFrame(rows, "id string, cond array<string>, out array<string>, p double")
    want = {tuple(r) for r in generate.sampled_trees(spark, generate.rules_of_model(model), 60, seed=4, most_depth=5).collect()}
    monkeypatch.setattr(generate, "MOST_RULES", 10)
    for block in (1, 7, 4096):
        monkeypatch.setattr(generate, "BLOCK", block)
        got = generate.trees_of_model(model, 60, seed=4, most_depth=5).collect()
        assert len(got) == 60 and {tuple(r) for r in got} == want
    assert generate.trees_of_model(model.where("id = 'Q'"), 5, seed=1).count() == 0


def test_words_beyond_the_lexicon_held(spark, monkeypatch):
    """Words over MOST_WORDS are joined with their sentences; a key twice, a row twice, long and empty sentences draw as with the whole lexicon held."""
    rng = np.random.default_rng(6)
    rows = [(i % 37, [int(x) for x in rng.integers(1, 9, int(rng.integers(1, 7)))]) for i in range(40)]
    sents = spark.createDataFrame([*rows, rows[0], (50, []), (51, [1, 1, 1])], "sent_id bigint, toks array<int>")
    how = sampler.Settings(categories=2, iterations=3, restarts=1, start="right_branching")
    table = lambda d: {(r.lhs, r.r1, r.r2, r.is_lex): r.p for r in d.collect()}
    whole, series = sampler.train(sents, 8, how)
    whole = table(whole)
    for most in (0, 3, 7):
        monkeypatch.setattr(sampler, "MOST_WORDS", most)
        part, again = sampler.train(sents, 8, how)
        assert table(part) == pytest.approx(whole) and [p for _, p in again] == pytest.approx([p for _, p in series])


def test_settings_of_a_config():
    from arborloom.sources.formats import read_config

    text = "[io]\noutput_dir = out\n[params]\nstartabp = 4\ndepth=2\nMAP = true\nburnin = 3\nsample_iters=5\nnum_samples=2\nalpha_pcfg_range = 0.1,0.9\nother = 1\nsuper_cooling_start_iter = 9\ninit_strategy = gold_pos\n"
    s = sampler.settings_of(read_config(text))
    assert (s.output, s.categories, s.depth, s.best_of_phase, s.iterations, s.alpha_low, s.alpha_high, s.cooling_start, s.start) == ("out", 4, 2, True, 13, 0.1, 0.9, 0, "gold_pos")
    assert sampler.settings_of(read_config(text + "super_cooling = 1\n")).cooling_start == 9 and sampler.settings_of({}) == sampler.Settings()


@pytest.mark.parametrize("name", list(sampler.STRATEGIES))
def test_strategies(spark, name):
    sents = spark.createDataFrame([(1, [1, 2, 3], [2, 1, 2]), (2, [3], [1]), (3, [], []), (4, None, None)], "sent_id bigint, toks array<int>, tags array<int>")
    counts = sampler.strategy_counts(sents, name, 2, 3, "tags").collect()
    assert sum(r.cnt for r in counts if r.is_lex) == 4 + 2 and sum(r.cnt for r in counts if not r.is_lex) == 2 + 2
    if name == "gold_pos":
        assert {(r.lhs, r.r1, r.cnt) for r in counts if r.is_lex and r.lhs} == {(2, "1", 1), (1, "2", 1), (2, "3", 1), (1, "3", 1)}
    with pytest.raises(ValueError):
        sampler.strategy_counts(sents, "no", 2, 3)
