"""Queries of rule tables, component models, states, inference and sampling."""

import numpy as np
from pyspark.sql import functions as F

from arborloom.functions import scalars
from arborloom.operators import generate, grammar, inference, sampler, states, tables
from arborloom.plans import query
from arborloom.plans.base import EV, EVT, TOK, int_sentences, word_tokens
from arborloom.session import read_table, written

_RULES = TOK + """, cc AS (SELECT sent_id, pos, tok, 1 + length(tok) % 5 AS c, 1 + length(lead(tok) OVER (PARTITION BY sent_id ORDER BY pos)) % 5 AS nxt FROM tok),
  ru AS (SELECT CAST(c AS INTEGER) AS lhs, tok AS r1, NULL::VARCHAR AS r2, true AS is_lex FROM cc UNION ALL SELECT c, c::VARCHAR, nxt::VARCHAR, false FROM cc WHERE nxt IS NOT NULL
    UNION ALL SELECT 0, c::VARCHAR, '0', false FROM cc WHERE pos = 0 UNION ALL SELECT 0, '-ROOT-', NULL, true FROM cc WHERE pos = 0),
  rc AS (SELECT CAST(lhs AS INTEGER) AS lhs, r1, r2, is_lex, count(*) AS cnt FROM ru GROUP BY ALL), rp AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY lhs) AS p FROM rc)"""


def rules(spark, sf):
    return grammar.branching_rules(word_tokens(spark, sf))


@query("rule_counts_rb", f"WITH {_RULES} SELECT * FROM rc")
def q_rule_counts(spark, sf):
    """A08."""
    return rules(spark, sf)


@query("rule_probs", f"WITH {_RULES} SELECT lhs, r1, r2, is_lex, cnt, round(p, 9) AS p FROM rp")
def q_rule_probs(spark, sf):
    """A09."""
    return grammar.conditional(rules(spark, sf)).select("lhs", "r1", "r2", "is_lex", "cnt", F.round("p", 9).alias("p"))


@query("rule_shares", f"WITH {_RULES} SELECT lhs, r1, r2, is_lex, round(cnt / (SELECT sum(cnt) FROM rc), 9) AS p FROM rc")
def q_rule_shares(spark, sf):
    """A10, A13."""
    return grammar.marginal(rules(spark, sf)).select("lhs", "r1", "r2", "is_lex", F.round("p", 9).alias("p"))


@query("tree_loglik", f"WITH {_RULES} SELECT round(sum(cnt * log10(p)), 4) AS loglik FROM rp WHERE lhs <> 0")
def q_tree_loglik(spark, sf):
    """A24."""
    return grammar.log_likelihood(rules(spark, sf)).select(F.round("loglik", 4).alias("loglik"))


@query("parent_totals", f"""WITH {_RULES} SELECT lhs, CAST(sum(cnt) AS BIGINT) AS total, CAST(coalesce(sum(cnt) FILTER (WHERE is_lex), 0) AS BIGINT) AS lexical,
  round(coalesce(sum(cnt) FILTER (WHERE is_lex), 0) / sum(cnt), 6) AS lexical_mass FROM rc GROUP BY lhs""")
def q_parent_totals(spark, sf):
    """A11, A25."""
    return grammar.parent_totals(rules(spark, sf))


_HEAD = _RULES + """, ch AS (SELECT lhs, p, r1 AS child FROM rp WHERE NOT is_lex UNION ALL SELECT lhs, p, r2 FROM rp WHERE NOT is_lex),
  hm AS (SELECT ch.lhs, child, sum(p / 2) / any_value(t) AS p FROM ch JOIN (SELECT lhs, sum(p) AS t FROM rp WHERE NOT is_lex GROUP BY lhs) w ON w.lhs = ch.lhs GROUP BY ch.lhs, child)"""


@query("head_model", f"WITH {_HEAD} SELECT lhs, child, round(p, 6) AS p FROM hm")
def q_head_model(spark, sf):
    """A12."""
    return grammar.head_model(rules(spark, sf)).select("lhs", "child", F.round("p", 6).alias("p"))


@query("head_argmax", f"WITH {_HEAD} SELECT lhs, arg_max(child, {{'p': round(p, 9), 'c': child}}) AS child FROM hm GROUP BY lhs")
def q_head_argmax(spark, sf):
    """The most probable child of each parent; ties by the larger name."""
    return grammar.head_model(rules(spark, sf)).groupBy("lhs").agg(F.max_by("child", F.struct(F.round("p", 9), F.col("child"))).alias("child"))


@query("starving_category", f"""WITH {_RULES}, pc AS (SELECT lhs, sum(cnt) AS c FROM rc WHERE lhs <> 0 GROUP BY lhs)
  SELECT arg_min(lhs, {{'c': c, 'l': lhs}}) AS category, arg_max(lhs, {{'c': c, 'l': lhs}}) AS donor, min(c) < 0.005 * sum(c) / (count(*) - 1) AS starves FROM pc""")
def q_starving(spark, sf):
    """A26."""
    return grammar.starving(rules(spark, sf))


@query("posterior_mean", f"""WITH {_RULES}, ps AS (SELECT lhs, r1, r2, is_lex, cnt + CASE WHEN lhs = 0 THEN 1.0 ELSE 0.2 END AS post FROM rc)
  SELECT lhs, r1, r2, is_lex, round(post / sum(post) OVER (PARTITION BY lhs), 9) AS p FROM ps""")
def q_posterior_mean(spark, sf):
    """Mean of the Dirichlet posterior over the rules seen."""
    post = rules(spark, sf).withColumn("cnt", F.col("cnt") + F.when(F.col("lhs") == 0, 1.0).otherwise(0.2))
    return grammar.conditional(post).select("lhs", "r1", "r2", "is_lex", F.round("p", 9).alias("p"))


@query("dirichlet_mass", f"WITH {_RULES} SELECT lhs, count(*) AS n, 1.0::DOUBLE AS mass FROM rc GROUP BY lhs")
def q_dirichlet_mass(spark, sf):
    """An annealed draw has every rule of its posterior and sums to 1 in each category."""
    post = rules(spark, sf).select("lhs", "r1", "r2", "is_lex", (F.col("cnt") + 0.2).alias("post"), F.lit(0.2).alias("prior"))
    drawn = grammar.dirichlet_draw(post, 5, 0, 0.5, "prior")
    return drawn.groupBy("lhs").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("mass"))


@query("dirichlet_draw")
def q_dirichlet(spark, sf):
    """A seeded draw."""
    post = rules(spark, sf).select("lhs", "r1", "r2", "is_lex", (F.col("cnt") + 0.2).alias("post"))
    return grammar.dirichlet_draw(post, seed=5, iteration=0)


@query("rule_enumeration", """WITH c AS (SELECT unnest(range(1, 5)) AS x), w AS (SELECT unnest(range(1, 8)) AS x)
  SELECT 0::BIGINT AS lhs, x::VARCHAR AS r1, '0' AS r2, false AS is_lex, x - 1 AS ix FROM c UNION ALL SELECT 0, '-ROOT-', NULL, true, 4
  UNION ALL SELECT a.x, l.x::VARCHAR, r.x::VARCHAR, false, (l.x - 1) * 4 + r.x - 1 FROM c a, c l, c r UNION ALL SELECT a.x, w.x::VARCHAR, NULL, true, 16 + w.x - 1 FROM c a, w""")
def q_rule_enumeration(spark, sf):
    """M02 with 4 categories and 7 words."""
    return grammar.rule_enumeration(spark, 4, 7)


@query("rules_sorted", f"WITH {_RULES} SELECT lhs, r1, r2, round(p, 9) AS p, row_number() OVER (ORDER BY lhs DESC, cnt DESC, r1, r2 NULLS FIRST) AS place FROM rp")
def q_rules_sorted(spark, sf):
    """Rules by category and probability, descending; places numbered without a single task."""
    from arborloom.operators.text import numbered

    p = grammar.conditional(rules(spark, sf))
    ordered = numbered(p, F.desc("lhs"), F.desc("cnt"), F.asc("r1"), F.asc_nulls_first("r2"), out="place")
    return ordered.select("lhs", "r1", "r2", F.round("p", 9).alias("p"), F.col("place").cast("bigint"))


@query("anneal_schedule", "SELECT i AS iter, CASE WHEN i >= 10 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE + floor(i / 2) * ((1.0::DOUBLE - 0.5::DOUBLE) / 5) END AS coefficient FROM range(0, 13) t(i)")
def q_anneal(spark, sf):
    """M08."""
    return spark.range(13).select(F.col("id").alias("iter"), scalars.annealing(F.col("id"), 10, 0.5, 1.0, 5).alias("coefficient"))


#: A grammar of two categories and ROOT: binary rules and lexical mass.
TOY = {(1, 1, 2): 0.3, (1, 2, 2): 0.1, (2, 1, 1): 0.2, (2, 2, 1): 0.1, (0, 1, 0): 0.5, (0, 2, 0): 0.3}
MASS = [0.2, 0.6, 0.7]
DEPTH, STEPS = 2, 12


def toy() -> tuple[np.ndarray, np.ndarray]:
    p = np.zeros((3, 3, 3))
    for k, v in TOY.items():
        p[k] = v
    return p, np.array(MASS)


def _delta_sql() -> str:
    names = [f"{k}{x}{d}" for k in "ab" for x in range(3) for d in range(DEPTH)]
    start = ", ".join(f"{MASS[int(n[1])]}::DOUBLE AS {n}" for n in names)

    def step(n: str) -> str:
        k, x, d = n[0], int(n[1]), int(n[2])
        base = f"{MASS[x]}::DOUBLE"
        if k == "b" and d + 1 == DEPTH:
            return base
        e = d if k == "a" else d + 1
        return base + "".join(f" + {v}::DOUBLE * a{left}{e} * b{r}{d}" for (a, left, r), v in TOY.items() if a == x)

    return f"WITH RECURSIVE dl AS (SELECT 1 AS i, {start} UNION ALL SELECT i + 1, {', '.join(step(n) for n in names)} FROM dl WHERE i < {STEPS - 1}), fin AS (SELECT * FROM dl WHERE i = {STEPS - 1})"


@query("delta", _delta_sql() + " " + " UNION ALL ".join(f"SELECT {d} AS depth, {x} AS category, round(a{x}{d}, 9) AS delta_a, round(b{x}{d}, 9) AS delta_b FROM fin" for x in range(3) for d in range(DEPTH)))
def q_delta(spark, sf):
    """M09."""
    a, b = grammar.delta(*toy(), DEPTH, STEPS)
    rows = [(d, x, round(float(a[d, x]), 9), round(float(b[d, x]), 9)) for d in range(DEPTH) for x in range(3)]
    return spark.createDataFrame(rows, "depth int, category int, delta_a double, delta_b double")


@query("gamma", _delta_sql() + " " + " UNION ALL ".join(
    f"SELECT {d} AS depth, {a} AS lhs, {left} AS l, {r} AS r, round({v}::DOUBLE * a{left}{d} * b{r}{d} / a{a}{d}, 9) AS gamma_a, "
    + (f"round({v}::DOUBLE * a{left}{d + 1} * b{r}{d} / b{a}{d}, 9)" if d + 1 < DEPTH else "0.0::DOUBLE") + " AS gamma_b FROM fin"
    for (a, left, r), v in TOY.items() for d in range(DEPTH)))
def q_gamma(spark, sf):
    """M10."""
    p, mass = toy()
    ga, gb = grammar.gamma(p, *grammar.delta(p, mass, DEPTH, STEPS))
    rows = [(d, *k, round(float(ga[(d, *k)]), 9), round(float(gb[(d, *k)]), 9)) for k in TOY for d in range(DEPTH)]
    return spark.createDataFrame(rows, "depth int, lhs int, l int, r int, gamma_a double, gamma_b double")


@query("components")
def q_components(spark, sf):
    """Component models of the toy grammar in long form."""
    return grammar.component_table(spark, grammar.components(*toy(), DEPTH))


@query("symbolic_export")
def q_symbolic(spark, sf):
    """The same in the parser's naming."""
    return grammar.as_condition_table(q_components(spark, sf), 3)


@query("transitions")
def q_transitions(spark, sf):
    """M12-M14 at depth 2."""
    return states.transitions(spark, grammar.components(*toy(), DEPTH))


@query("transition_sums")
def q_transition_sums(spark, sf):
    """Outgoing mass of each state."""
    return q_transitions(spark, sf).groupBy("prev").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("mass"))


@query("state_decode", """SELECT i AS state, CAST(i // 128 AS INTEGER) AS j, [CAST(i // 32 % 4 AS INTEGER)] AS a, [CAST(i // 8 % 4 AS INTEGER)] AS b, CAST(i // 4 % 2 AS INTEGER) AS f, CAST(i % 4 AS INTEGER) AS g FROM range(256) t(i)""")
def q_state_decode(spark, sf):
    """All states of 4 categories at depth 1."""
    return spark.range(256).select(F.col("id").alias("state"), states.decode(F.col("id"), 4, 1).alias("s")).select("state", "s.*")


@query("state_roundtrip", "SELECT i AS state, i AS again FROM range(4096) t(i)")
def q_state_roundtrip(spark, sf):
    """encoding a decoded state, depth 2."""
    s = states.decode(F.col("id"), 4, 2)
    return spark.range(4096).select(F.col("id").alias("state"), states.encode(s["j"], s["a"], s["b"], s["f"], s["g"], 4, 2).cast("bigint").alias("again"))


@query("valid_states", """WITH s AS (SELECT i, i // 128 AS j, i // 32 % 4 AS a, i // 8 % 4 AS b, i // 4 % 2 AS f, i % 4 AS g FROM range(256) t(i))
  SELECT i AS state FROM s WHERE i = 0 OR (g BETWEEN 1 AND 2 AND ((a = 0 AND b = 0 AND f = 1 AND j = 0) OR (a BETWEEN 1 AND 2 AND b BETWEEN 1 AND 2 AND (f = 1 OR g = b))))""")
def q_valid_states(spark, sf):
    """O3, M12."""
    return states.valid_states(spark, 4, 1)


def hmm() -> inference.Chain:
    """Two states, two observations."""
    a = np.array([[0.6, 0.4], [0.3, 0.7]])
    prev, nxt = np.nonzero(a)
    return inference.Chain([0.5, 0.5], prev, nxt, a[prev, nxt], [1, 1], [[0.9, 0.2], [0.1, 0.8]], [0, 1])


def _observed(spark, sf):
    return int_sentences(spark, sf).select("sent_id", F.transform("toks", lambda t: t % 2).alias("obs"))


_OBS = EV + ", o AS (SELECT sent_id, CAST(unnest(range(len(toks))) AS INTEGER) AS t, unnest(toks) % 2 AS x FROM ev), b AS (SELECT sent_id, t, CASE WHEN x = 0 THEN 0.9::DOUBLE ELSE 0.1 END AS b0, CASE WHEN x = 0 THEN 0.2::DOUBLE ELSE 0.8 END AS b1 FROM o)"


@query("forward_filter", f"""WITH RECURSIVE {_OBS}, r AS (SELECT sent_id, t, 0.5 * b0 / (0.5 * b0 + 0.5 * b1) AS a0, log10(0.5 * b0 + 0.5 * b1) AS lp FROM b WHERE t = 0
  UNION ALL SELECT r.sent_id, b.t, (a0 * 0.6 + (1 - a0) * 0.3) * b0 / ((a0 * 0.6 + (1 - a0) * 0.3) * b0 + (a0 * 0.4 + (1 - a0) * 0.7) * b1), lp + log10((a0 * 0.6 + (1 - a0) * 0.3) * b0 + (a0 * 0.4 + (1 - a0) * 0.7) * b1)
  FROM r JOIN b ON b.sent_id = r.sent_id AND b.t = r.t + 1)
  SELECT sent_id, round(arg_max(lp, t), 6) AS log10p, round(arg_max(a0, t), 6) AS filter0 FROM r GROUP BY sent_id""")
def q_forward(spark, sf):
    """Q03 over every sentence."""
    r = inference.inferred(_observed(spark, sf), hmm(), "forward")
    return r.select("sent_id", F.round("log10p", 6).alias("log10p"), F.round(F.col("last")[0], 6).alias("filter0"))


@query("viterbi", f"""WITH RECURSIVE {_OBS}, r AS (SELECT sent_id, t, log10(0.5 * b0) AS v0, log10(0.5 * b1) AS v1, '0' AS p0, '1' AS p1 FROM b WHERE t = 0
  UNION ALL SELECT r.sent_id, b.t, greatest(v0 + log10(0.6), v1 + log10(0.3)) + log10(b0), greatest(v0 + log10(0.4), v1 + log10(0.7)) + log10(b1),
    CASE WHEN v0 + log10(0.6) >= v1 + log10(0.3) THEN p0 ELSE p1 END || '0', CASE WHEN v0 + log10(0.4) >= v1 + log10(0.7) THEN p0 ELSE p1 END || '1' FROM r JOIN b ON b.sent_id = r.sent_id AND b.t = r.t + 1),
  z AS (SELECT sent_id, arg_max({{'a': v0, 'b': v1, 'p': p0, 'q': p1}}, t) AS x FROM r GROUP BY sent_id)
  SELECT sent_id, round(greatest(x.a, x.b), 6) AS log10p, CASE WHEN x.a >= x.b THEN x.p ELSE x.q END AS path FROM z""")
def q_viterbi(spark, sf):
    """Q08, Q06: probability and states of the best path of every sentence."""
    r = inference.inferred(_observed(spark, sf), hmm(), "viterbi")
    return r.select("sent_id", F.round("log10p", 6).alias("log10p"), F.array_join(F.col("path").cast("array<string>"), "").alias("path"))


@query("beam_viterbi")
def q_beam(spark, sf):
    """Q09, T07."""
    return inference.inferred(_observed(spark, sf), hmm(), "beam").select("sent_id", "path", "log10p", "success")


@query("backward_sample")
def q_backward(spark, sf):
    """Seeded posterior samples."""
    return inference.inferred(_observed(spark, sf), hmm(), "sample", seed=3).select("sent_id", "path", "log10p")


def compiled_chain(spark, sf) -> inference.Chain:
    """A chain of 2 categories at depth 2 (122 states) with a lexicon over all token ids: more states than the beams."""
    words = int_sentences(spark, sf).select(F.max(F.array_max("toks"))).first()[0] or 1
    rng = np.random.default_rng(4)
    full = np.zeros((3, 3, 3))
    full[1:, 1:, 1:] = 0.45 * rng.dirichlet(np.ones(4), 2).reshape(2, 2, 2)
    full[0, 1:, 0] = 0.5 * rng.dirichlet(np.ones(2))
    c = grammar.components(full, np.array([0.5, 0.55, 0.55]), 2)
    lex = np.zeros((words + 1, 4))
    lex[:, 1:3] = rng.dirichlet(np.ones(words + 1), 2).T
    t = states.transitions(spark, c).toPandas()  # bounded by the state space
    return inference.chain_of(c, lex, t["prev"].to_numpy(), t["nxt"].to_numpy(), t["p"].to_numpy())


_KNOWN = EV + ", k AS (SELECT sent_id, len(toks) AS n FROM ev WHERE len(list_filter(toks, lambda x: x IS NULL OR x < 0)) = 0)"


@query("beam_compiled", f"WITH {_KNOWN} SELECT sent_id, CAST(n AS INTEGER) AS n, true AS not_better FROM k")
def q_beam_compiled(spark, sf):
    """Beams of 100 and 50 over a compiled grammar of more states than that, and the exact path: as long, and never less probable."""
    s = int_sentences(spark, sf).where("not exists(toks, x -> x is null or x < 0)").select("sent_id", "toks").distinct()
    chain = compiled_chain(spark, sf)
    beam = inference.inferred(s, chain, "beam", obs="toks").select("sent_id", F.col("log10p").alias("b"), F.size("path").alias("n"))
    best = inference.inferred(s, chain, "viterbi", obs="toks").select("sent_id", "log10p")
    return beam.join(best, "sent_id").select("sent_id", "n", (F.coalesce("b", F.lit(float("-inf"))) <= F.col("log10p") + 1e-9).alias("not_better"))


@query("gaussian_draw")
def q_gaussian(spark, sf):
    """A seeded posterior draw for every label and dimension of the embeddings."""
    e = read_table(spark, sf, "embeddings").select(F.col("label").alias("tag"), F.posexplode("embedding").alias("dim", "x")).withColumn("v", F.col("x").cast("double"))
    m = e.groupBy("tag", "dim").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), (F.var_pop("v") * F.count("*")).alias("ss"))
    return sampler.gaussian_draw(m, seed=2, iteration=0)


@query("sample_trees")
def q_sample_trees(spark, sf):
    """Trees of a random grammar."""
    return generate.sampled_trees(spark, generate.random_grammar(4, 8, seed=1), 500, seed=9)


@query("layered_trees", "SELECT id AS tree_id, true AS shallow FROM range(400) t(id)")
def q_layered(spark, sf):
    """Trees of a layered random grammar, embedded twice at most."""
    from arborloom.operators.trees import read_trees

    made = generate.sampled_trees(spark, generate.layered_grammar(3, 3, 4, 20, seed=3), 400, seed=4, most_depth=2, layered=12)
    return generate.embedding_depth(read_trees(made)).select("tree_id", (F.col("depth") <= 2).alias("shallow"))


@query("model_trees", f"WITH {_RULES} SELECT DISTINCT CAST(lhs AS VARCHAR) AS label, true AS known FROM rp WHERE lhs > 0")
def q_model_trees(spark, sf):
    """Trees from the conditional model of the corpus' own rules; every label drawn is one of the model's."""
    from arborloom.operators.trees import read_trees

    counts = written(rules(spark, sf), "rules")
    p = grammar.conditional(counts).where("lhs > 0 or r1 <> '-ROOT-'")
    out = F.when(F.col("is_lex"), F.array(F.concat(F.lit("w"), F.regexp_replace("r1", "[^\\p{L}\\p{N}]", "_")))).when(F.col("lhs") == 0, F.array("r1")).otherwise(F.array("r1", "r2"))
    model = p.select(F.lit("R").alias("id"), F.array(F.when(F.col("lhs") == 0, F.lit("T")).otherwise(F.col("lhs").cast("string"))).alias("cond"), out.alias("out"), "p")
    labels = read_trees(generate.trees_of_model(model, 400, seed=2)).where("label <> 'T'").select("label").distinct()
    mine = counts.where("lhs > 0").select(F.col("lhs").cast("string").alias("label")).distinct().withColumn("known", F.lit(True))
    return mine.join(labels.withColumn("drawn", F.lit(True)), "label", "full").select("label", F.coalesce("known", F.lit(False)).alias("known"))


@query("train_small")
def q_train(spark, sf):
    """Two passes of the sampler over the sentences of the tag sequences; tokens are the tags."""
    s = read_table(spark, sf, "ev_seqs").where("sent_id is not null and size(tags) > 0").select("sent_id", "tags").distinct()
    sents = s.select("sent_id", F.filter("tags", lambda t: t.isNotNull() & (t > 0)).alias("toks")).where("size(toks) > 1")
    rules_, _ = sampler.train(sents, 17, sampler.Settings(categories=2, depth=1, iterations=2))
    return rules_


@query("train_words", "SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS lhs, 1.0::DOUBLE AS mass")
def q_train_words(spark, sf):
    """The sampler over the words of the corpus with two restarts, a start by strategy and a moving alpha for each category: the
    probabilities of the rules of every category sum to 1.
    """
    s = int_sentences(spark, sf).where("not exists(toks, x -> x is null or x < 0)").select("sent_id", F.transform("toks", lambda x: x + 1).alias("toks")).distinct()
    words = s.select(F.max(F.array_max("toks"))).first()[0] or 1
    how = sampler.Settings(categories=3, depth=1, iterations=3, restarts=2, start="right_branching", sample_alpha=True, alpha_array=True)
    rules_, _ = sampler.train(s, words, how)
    return rules_.groupBy("lhs").agg(F.round(F.sum("p"), 6).alias("mass"))


@query("alpha_split", f"""WITH {EV}, c AS (SELECT sum(len(toks)) AS w, count(*) AS s FROM ev), v AS (SELECT count(DISTINCT x) AS t FROM (SELECT unnest(toks) AS x FROM ev) WHERE x IS NOT NULL)
  SELECT round(0.1 * (w - s) / 9 / 3, 6) AS binary_alpha, round(0.1 * w / t / 3, 6) AS lexical_alpha FROM c, v""")
def q_alpha_split(spark, sf):
    """Pseudo-counts of binary and lexical rules from the size of the corpus."""
    ev = int_sentences(spark, sf)
    r = ev.agg(F.sum(F.size("toks")).alias("w"), F.count("*").alias("s")).first()
    types = ev.select(F.explode("toks").alias("x")).where("x is not null").distinct().count()
    b, lexical = (None, None) if r.w is None else (round(x, 6) for x in sampler.spread_alphas(r.w, r.s, types, 3, 0.1))
    return spark.createDataFrame([(b, lexical)], "binary_alpha double, lexical_alpha double")


@query("strategy_start", f"""WITH {EV}, k AS (SELECT sent_id, toks FROM ev WHERE len(list_filter(toks, lambda x: x IS NULL)) = 0), n AS (SELECT sum(len(toks)) AS w, count(*) AS s FROM (SELECT DISTINCT sent_id, toks FROM k))
  SELECT true AS is_lex, CAST(w + s AS BIGINT) AS cnt FROM n UNION ALL SELECT false, CAST(w AS BIGINT) FROM n""")
def q_strategy(spark, sf):
    """Rules of left branching trees with random categories: a lexical one a word, a binary one an inner node, two of ROOT a sentence."""
    s = int_sentences(spark, sf).where("not exists(toks, x -> x is null)").select("sent_id", "toks").distinct()
    return sampler.strategy_counts(s, "left_branching", 3, 5).groupBy("is_lex").agg(F.sum("cnt").alias("cnt"))


@query("damped_update", f"""WITH {_RULES}, t AS (SELECT lhs, sum(cnt) AS s, count(*) AS k FROM rc GROUP BY lhs)
  SELECT rc.lhs, r1, r2, is_lex, round(0.75 * cnt / s + 0.25 / k, 9) AS p FROM rc JOIN t ON t.lhs = rc.lhs""")
def q_damped(spark, sf):
    """F16: a quarter of the way from the rule probabilities to even ones."""
    r = rules(spark, sf).withColumn("r2", F.coalesce("r2", F.lit("")))
    old = grammar.conditional(r)
    even = grammar.conditional(r.withColumn("cnt", F.lit(1)))
    on = ["lhs", "r1", "r2", "is_lex"]
    return tables.damped(old, even, on, 0.25).select("lhs", "r1", F.nullif("r2", F.lit("")).alias("r2"), "is_lex", F.round("p", 9).alias("p"))


@query("condition_entries", f"WITH {_RULES} SELECT count(DISTINCT lhs) AS n_conditions, count(*) AS n_entries FROM rc WHERE lhs <> 3")
def q_entries(spark, sf):
    """size of the rule table without one condition."""
    r = rules(spark, sf).withColumn("cond", F.col("lhs").cast("string"))
    return tables.entries(tables.without_conditions(r, "3"))


@query("located_tokens", f"""WITH {EV}, s AS (SELECT corpus, sent_id, len(toks) AS n, sum(len(toks)) OVER (ORDER BY sent_id) AS upto FROM (SELECT sent_id, any_value(corpus) AS corpus, any_value(toks) AS toks FROM ev GROUP BY sent_id)),
  i AS (SELECT unnest(range(0, (SELECT CAST(sum(n) AS BIGINT) FROM s), 1000)) AS ix) SELECT CAST(ix AS BIGINT) AS ix, sent_id, CAST(ix - (upto - n) AS BIGINT) AS pos FROM i JOIN s ON ix >= upto - n AND ix < upto""")
def q_located(spark, sf):
    """Every thousandth running token number brought back to its sentence and place."""
    from pyspark.sql import Window as W

    ev = int_sentences(spark, sf).groupBy("sent_id").agg(F.first(F.size("toks")).alias("n"))
    block = F.floor(F.col("sent_id") / 4096)
    sums = ev.groupBy(block.alias("block")).agg(F.sum("n").alias("inside"))
    before = F.coalesce(F.sum("inside").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a block of 4,096 sentences
    within = F.sum("n").over(W.partitionBy("block").orderBy("sent_id"))
    lengths = ev.withColumn("block", block).withColumn("within", within).join(sums.withColumn("before", before), "block").select("sent_id", "n", (F.col("before") + F.col("within")).alias("upto"))
    total = ev.agg(F.sum("n")).first()[0] or 0
    return tables.located(lengths, spark.range(0, total, 1000).withColumnRenamed("id", "ix"))


@query("normalised_logs", f"WITH {_RULES} SELECT lhs, r1, r2, round(p, 9) AS p FROM rp WHERE NOT is_lex AND lhs > 0")
def q_normalised_logs(spark, sf):
    """Logs of rule counts brought back to probabilities; the lexical share is put back after."""
    r = rules(spark, sf).where("lhs > 0")
    share = r.groupBy("lhs").agg((F.sum(F.when(~F.col("is_lex"), F.col("cnt"))) / F.sum("cnt")).alias("share"))
    items = F.array_sort(F.collect_list(F.struct("r1", "r2", scalars.as_log(F.col("cnt").cast("double")).alias("x"))))  # categories squared a row
    logs = r.where(~F.col("is_lex")).groupBy("lhs").agg(items.alias("i")).withColumn("p", scalars.normalised_from_log(F.transform("i", lambda x: x["x"])))
    rows = logs.select("lhs", F.explode(F.arrays_zip("i", "p")).alias("z")).join(share, "lhs")
    return rows.select("lhs", "z.i.r1", "z.i.r2", F.round(F.col("z.p") * F.col("share"), 9).alias("p"))


@query("token_hmm_mass", f"WITH {EVT} SELECT CAST(tok % 2 AS INTEGER) AS obs, count(*) AS cnt FROM evt GROUP BY 1")
def q_obs(spark, sf):
    """Observations of the toy chain."""
    return _observed(spark, sf).select(F.explode("obs").alias("obs")).groupBy("obs").agg(F.count("*").alias("cnt"))


@query("scalar_functions", """SELECT id, round(CASE WHEN id = 0 THEN -1.0 WHEN abs(-id - (-1.0)) > 20 THEN greatest(-id::DOUBLE, -1.0) ELSE greatest(-id::DOUBLE, -1.0) + log10(1 + 10 ** (-abs(-id + 1.0))) END, 6) AS log_add,
  round((40 - 0)::DOUBLE / 3 / (40 - id + 1) * 10, 6) AS scaled FROM range(40) t(id)""")
def q_scalars(spark, sf):
    """F02, F07."""
    x = F.when(F.col("id") > 0, -F.col("id").cast("double"))
    return spark.range(40).select("id", F.round(scalars.log_add(x, F.lit(-1.0)), 6).alias("log_add"), F.round(scalars.inverse_gap(F.col("id").cast("double"), F.lit(0), F.lit(40), 10.0), 6).alias("scaled"))
