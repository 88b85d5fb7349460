"""The sampling loop: states, trees, rule counts, posterior draws, checkpoints."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborloom.functions.scalars import gammas, normals
from arborloom.operators import grammar, inference, states
from arborloom.operators.trees import read_tree, state_tree


@dataclass
class Settings:
    """Trainer parameters (S28): sizes, schedule, prior, annealing, restarts and start.

    ``alpha_scale`` over 0 spreads a share of the corpus' nodes over the rules as pseudo-counts in place of ``alpha`` (M03); ``sample_alpha`` moves alpha
    by a Metropolis step before each draw, with ``alpha_array`` one for every category. The first ``restarts`` passes each start from a draw of the prior and
    the best of them goes on. ``best_of_phase`` takes the best grammar of an annealing phase over to the next one. From ``cooling_start`` on the coefficient rises from 1
    to ``cooling_target`` within ``cooling_length`` passes. ``start`` names a strategy for the first rule counts (STRATEGIES) or is empty.
    """

    categories: int = 3
    depth: int = 1
    alpha: float = 0.2
    alpha_low: float = 0.01
    alpha_high: float = 1.0
    alpha_scale: float = 0.0
    alpha_array: bool = False
    sample_alpha: bool = False
    iterations: int = 5
    batch_size: int = 0
    seed: int = 1
    burnin: int = 0
    init_anneal: float = 1.0
    final_anneal: float = 1.0
    anneal_length: int = 0
    anneal_phases: int = 1
    restarts: int = 0
    best_of_phase: bool = False
    cooling_start: int = 0
    cooling_length: int = 1
    cooling_target: float = 1.0
    start: str = ""
    output: str | None = None
    report: Callable[[int, float], None] | None = field(default=None, compare=False)
    checkpoint: Callable[[int, DataFrame], None] | None = field(default=None, compare=False)


#: Names of trainer parameters in config files, and the settings they set.
NAMES = {
    "startabp": "categories", "depth": "depth", "init_alpha": "alpha", "alpha_scale": "alpha_scale", "sample_alpha_flag": "sample_alpha", "alpha_array_flag": "alpha_array",
    "burnin": "burnin", "batch_size": "batch_size", "seed": "seed", "init_anneal_likelihood": "init_anneal", "final_anneal_likelihood": "final_anneal",
    "anneal_length": "anneal_length", "anneal_likelihood_phase": "anneal_phases", "MAP": "best_of_phase", "random_restarts": "restarts", "init_strategy": "start",
    "super_cooling_start_iter": "cooling_start", "super_cooling_length": "cooling_length", "super_cooling_target_ac": "cooling_target",
}


def settings_of(config: dict[str, dict[str, str]]) -> Settings:
    """Settings from the sections of a config file (keys in any case); keys that the trainer does not have are left alone.

    The passes are the burn-in and ``num_samples`` times ``sample_iters``; ``alpha_pcfg_range`` gives both bounds; super-cooling counts only with its flag.
    """
    given = {k.lower(): v for k, v in config.get("params", {}).items()}
    truth = lambda v: v.strip().lower() in ("1", "true", "yes", "on")
    out = Settings(output=config.get("io", {}).get("output_dir"))
    for name, own in NAMES.items():
        if name.lower() in given:
            now, v = getattr(out, own), given[name.lower()]
            setattr(out, own, truth(v) if isinstance(now, bool) else type(now)(float(v)) if isinstance(now, (int, float)) else v)
    if "alpha_pcfg_range" in given:
        out.alpha_low, out.alpha_high = (float(x) for x in given["alpha_pcfg_range"].strip("[] ").split(","))
    if "sample_iters" in given:
        out.iterations = out.burnin + int(float(given["sample_iters"])) * int(float(given.get("num_samples", "1")))
    if not truth(given.get("super_cooling", "0")):
        out.cooling_start = 0
    return out


def spread_alphas(words: int, sentences: int, types: int, categories: int, scale: float) -> tuple[float, float]:
    """Pseudo-count of each binary and each lexical rule: ``scale`` times the inner nodes and the words, spread over the rules of all categories.

    Both are figures of the corpus, whatever their size; without types the lexical one is infinite, without words not a number.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        return scale * (words - sentences) / categories**2 / categories, float(np.float64(scale * words) / types / categories)


def scaled_alphas(words: int, sentences: int, types: int, categories: int, scale: float) -> tuple[float, float]:
    """``spread_alphas`` as a prior of the trainer, which takes no lexical pseudo-count over 1."""
    if not 0 < scale <= 1:
        raise ValueError("the scale must be over 0 and at most 1")
    binary, lexical = spread_alphas(words, sentences, types, categories, scale)
    if lexical > 1:
        raise ValueError("a lexical pseudo-count over 1: lower the scale")
    return binary, lexical


def strategy_counts(sentences: DataFrame, name: str, categories: int, seed: int, tags: str | None = None) -> DataFrame:
    """Rule counts of first trees by strategy: ``left_branching`` and ``right_branching`` with random categories, or ``gold_pos``: random binary trees
    whose preterminals are the numbers in the column ``tags``. Draws are keyed by (seed, sentence), counts summed in each batch first.
    """
    if name not in STRATEGIES:
        raise ValueError(f"no such strategy: {name}; there are {', '.join(STRATEGIES)}")
    if name == "gold_pos" and not tags:
        raise ValueError("gold_pos needs a column of tags")
    build = STRATEGIES[name]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for key, words, gold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words:
                    rng = np.random.Generator(np.random.Philox(key=[seed, key & (2**64 - 1)]))
                    total.update(rules_of(build(words, categories, rng, gold)))
            yield _counted_batch(total)

    rows = sentences.select("sent_id", "toks", (F.col(tags) if tags else F.lit(None).cast("array<int>")).alias("tags"))
    return rows.mapInArrow(f, COUNTS).groupBy("lhs", "r1", "r2", "is_lex").agg(F.sum("cnt").alias("cnt"))


def _leaf(word: int, categories: int, rng: np.random.Generator, tag: int | None = None) -> str:
    return f"({int(rng.integers(1, categories + 1)) if tag is None else tag} {word})"


def left_branching_tree(words: list[int], categories: int, rng: np.random.Generator, gold: list[int] | None = None) -> str:
    """A left branching tree with random categories."""
    tree = _leaf(words[0], categories, rng)
    for w in words[1:]:
        tree = f"({int(rng.integers(1, categories + 1))} {tree} {_leaf(w, categories, rng)})"
    return tree


def right_branching_tree(words: list[int], categories: int, rng: np.random.Generator, gold: list[int] | None = None) -> str:
    """The mirror."""
    tree = _leaf(words[-1], categories, rng)
    for w in words[-2::-1]:
        tree = f"({int(rng.integers(1, categories + 1))} {_leaf(w, categories, rng)} {tree})"
    return tree


def gold_tag_tree(words: list[int], categories: int, rng: np.random.Generator, gold: list[int] | None = None) -> str:
    """A random binary tree with given preterminals; words are divided at a random place, again and again."""
    leaves = [_leaf(w, categories, rng, t) for w, t in zip(words, gold or [1] * len(words), strict=True)]
    parts, out = [(0, len(words), False)], []
    while parts:
        a, b, closing = parts.pop()
        if closing:
            out.append(")")
        elif b - a == 1:
            out.append(leaves[a])
        else:
            cut = int(rng.integers(a + 1, b))
            out.append(f"({int(rng.integers(1, categories + 1))}")
            parts += [(a, b, True), (cut, b, False), (a, cut, False)]
    return " ".join(out)


STRATEGIES = {"left_branching": left_branching_tree, "right_branching": right_branching_tree, "gold_pos": gold_tag_tree}
COUNTS = "lhs int, r1 string, r2 string, is_lex boolean, cnt bigint"


def _counted_batch(total: Counter) -> pa.RecordBatch:
    keys = list(total)
    columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.bool_()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([total[k] for k in keys], pa.int64())], names=["lhs", "r1", "r2", "is_lex", "cnt"])


def steps_of(path: list[int], words: list[int], size: int, depth: int) -> list[tuple[int, int, int, int, int, str]]:
    """Steps of ``state_tree`` from state indexes: j, a and b come from the next state, the last has j = 1."""
    n = size**depth

    def parts(x: int) -> tuple[int, int, int, int, int]:
        rest, g = divmod(x, size)
        rest, f = divmod(rest, 2)
        rest, b = divmod(rest, n)
        j, a = divmod(rest, n)
        low = lambda code: next((d for d in (code // size**k % size for k in range(depth)) if d), 0)
        return j, low(a), low(b), f, g

    own = [parts(x) for x in path]
    after = [*own[1:], (1, 0, 0, 0, 0)]
    return [(o[3], x[0], x[1], x[2], o[4], str(w)) for o, x, w in zip(own, after, words, strict=True)]


def rules_of(tree: str) -> Counter:
    """Rules of one tree with ROOT's two."""
    rows, out = read_tree(tree), Counter()
    children: dict[int, list[str]] = {}
    for r in rows:
        children.setdefault(r[1], []).append(r[3])
    for r in rows:
        if r[4] is not None:
            out[int(r[3]), r[4], None, True] += 1
        elif len(kids := children.get(r[0], [])) == 2:
            out[int(r[3]), kids[0], kids[1], False] += 1
    if rows:
        out[0, rows[0][3], "0", False] += 1
        out[0, "-ROOT-", None, True] += 1
    return out


def counted(parses: DataFrame, size: int, depth: int) -> DataFrame:
    """Rule counts of sampled state paths ``(sent_id, path, toks)``; summed in each batch first, failed parses left out."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for path, words in zip(batch.column("path").to_pylist(), batch.column("toks").to_pylist(), strict=True):
                if path:
                    try:
                        total.update(rules_of(state_tree(steps_of(path, words, size, depth))))
                    except ValueError:
                        continue
            yield _counted_batch(total)

    rows = parses.where("success").select("path", "toks").mapInArrow(f, COUNTS)
    return rows.groupBy("lhs", "r1", "r2", "is_lex").agg(F.sum("cnt").alias("cnt"))


#: Words of a lexicon that the kernel holds (categories x words numbers), further ones being joined with their sentences; transitions of a chain.
MOST_WORDS, MOST_TRANSITIONS = 2_000_000, 50_000_000


def lexical(rules: DataFrame) -> DataFrame:
    """``(lhs, w, p)`` of the rules of words."""
    return rules.where("is_lex and lhs > 0").select(F.col("lhs").cast("int").alias("lhs"), F.col("r1").cast("int").alias("w"), F.col("p").cast("double").alias("p"))


def lexical_mass(rules: DataFrame, categories: int) -> np.ndarray:
    """Sum of p over the words of each category, as wide as a row of the lexicon."""
    out = np.zeros(categories + 2)
    for r in lexical(rules).groupBy("lhs").agg(F.sum("p").alias("p")).collect():  # one row a category
        out[r.lhs] = r.p
    return out


def late_words(rules: DataFrame, categories: int, words: int) -> DataFrame | None:
    """``(w, e)``: emissions by category of the words beyond MOST_WORDS; none if there are no such words."""
    if words <= MOST_WORDS:
        return None
    mass = np.maximum(lexical_mass(rules, categories), 1e-300)
    cells = [F.coalesce(F.sum(F.when(F.col("lhs") == c, F.col("p") / float(mass[c]))), F.lit(0.0)) for c in range(categories + 2)]
    return lexical(rules).where(F.col("w") > MOST_WORDS).groupBy("w").agg(F.array(*cells).alias("e"))


def compiled(spark: SparkSession, rules: DataFrame, categories: int, words: int, depth: int) -> tuple[grammar.Components, inference.Chain]:
    """Rules with p to component models and their chain. The transition table is bounded by the state space, not by the data; its bound is checked.

    The chain holds the words up to MOST_WORDS; ``late_words`` has the emissions of the others.
    """
    held = min(words, MOST_WORDS)
    p, mass = grammar.dense(rules, categories)
    c = grammar.components(p, mass, depth)
    lex = np.zeros((held + 1, categories + 2))
    table = lexical(rules).where(F.col("w") <= held).toArrow()
    lex[table.column("w").to_numpy(), table.column("lhs").to_numpy()] = table.column("p").to_numpy()
    lex /= np.maximum(lex.sum(axis=0, keepdims=True) if held == words else lexical_mass(rules, categories), 1e-300)
    t = states.transitions(spark, c).limit(MOST_TRANSITIONS + 1).toArrow()
    if t.num_rows > MOST_TRANSITIONS:
        raise ValueError(f"more than {MOST_TRANSITIONS} transitions: lower the depth or the categories")
    return c, inference.chain_of(c, lex, *(t.column(x).to_numpy() for x in ("prev", "nxt", "p")))


def prior_of(s: Settings, alphas: dict[int, float], scaled: tuple[float, float] | None) -> Column:
    """The prior of a rule: 1 for ROOT, else scaled, by category, or one number."""
    if scaled:
        return F.when(F.col("lhs") == 0, F.lit(1.0)).when(F.col("is_lex"), F.lit(scaled[1])).otherwise(F.lit(scaled[0]))
    if s.alpha_array:
        out = F.when(F.col("lhs") == 0, F.lit(1.0))
        for c in range(1, s.categories + 1):
            out = out.when(F.col("lhs") == c, F.lit(alphas[c]))
        return out
    return F.when(F.col("lhs") == 0, F.lit(1.0)).otherwise(F.lit(alphas[1]))


def moved_alphas(rules: DataFrame, s: Settings, alphas: dict[int, float], it: int) -> dict[int, float]:
    """One Metropolis step of alpha, or of each category's; a distribution enters with its size and its sum of logs alone."""
    stats = {r.lhs: (r.k, r.s) for r in rules.where("lhs > 0").groupBy("lhs").agg(F.count("*").alias("k"), F.sum(F.ln("p")).alias("s")).collect()}  # one row a category
    rng = np.random.default_rng([s.seed, it, 7])
    if s.alpha_array:
        return {c: alpha_step(a, [stats[c]] if c in stats else [], s.alpha_low, s.alpha_high, rng) for c, a in alphas.items()}
    one = alpha_step(alphas[1], list(stats.values()), s.alpha_low, s.alpha_high, rng)
    return dict.fromkeys(alphas, one)


def train(sentences: DataFrame, words: int, s: Settings, resume: int | None = None) -> tuple[DataFrame, list[tuple[int, float]]]:
    """The rule table of the last iteration and the log10 probability of each pass.

    ``sentences(sent_id, toks)`` with tokens 1 .. words. Each pass draws a grammar from its posterior, compiles it, samples a tree
    for every sentence of the batch window (wrapping round) and counts rules. With ``output`` each iteration is written there as
    ``iter=N`` (S22, S24; S23 resumes after the iteration given). An empty table ends after the first draw. Tables that no later pass reads are removed.
    """
    from arborloom.operators.text import numbered
    from arborloom.session import dropped, written

    spark = sentences.sparkSession
    keys = written(grammar.rule_enumeration(spark, s.categories, words).withColumn("lhs", F.col("lhs").cast("int")), "rules")
    base = sentences.select("sent_id", "toks").where("size(toks) > 0")
    base = written(numbered(base, "sent_id", out="ix") if s.batch_size else base, "sentences")
    n, tokens = base.agg(F.count("*"), F.coalesce(F.sum(F.size("toks")), F.lit(0))).first()
    scaled = scaled_alphas(tokens, n, words, s.categories, s.alpha_scale) if s.alpha_scale and n else None
    alphas = dict.fromkeys(range(1, s.categories + 1), s.alpha)
    none = spark.createDataFrame([], COUNTS)
    first = 0 if resume is None else resume + 1
    if resume is not None:
        counts = spark.read.parquet(f"{s.output}/iter={resume}").select("lhs", "r1", "r2", "is_lex", "cnt").where("cnt > 0")
    elif s.start:
        counts = written(strategy_counts(base, s.start, s.categories, s.seed), "counts")
    else:
        counts = none
    series: list[tuple[int, float]] = []
    rules: DataFrame = none.withColumn("p", F.lit(0.0))
    best: tuple[float, DataFrame, DataFrame] | None = None  # log probability, rules and counts of the best restart or phase
    for it in range(first, first + s.iterations):
        restarting = it < s.restarts
        coefficient = 1.0 if restarting else annealing_value(it - s.restarts, s)
        jump = s.best_of_phase and not restarting and it > s.restarts and coefficient != annealing_value(it - s.restarts - 1, s)
        if best and (it == s.restarts or jump):
            rules, counts, best = best[1], best[2], None  # the best restart, or the best of the phase, goes on as it is
        else:
            if s.sample_alpha and series:
                alphas = moved_alphas(rules, s, alphas, it)
            seen = none if restarting and not s.start else counts
            posterior = grammar.with_prior(keys, seen, prior_of(s, alphas, scaled)).withColumn("prior", prior_of(s, alphas, scaled))
            rules = written(grammar.dirichlet_draw(posterior, s.seed, it, coefficient, "prior").drop("prior"), "draw")
        if n == 0:
            break
        _, chain = compiled(spark, rules, s.categories, words, s.depth)
        window = base
        if s.batch_size and s.batch_size < n:
            lo = it * s.batch_size % n
            window = base.where(F.pmod(F.col("ix") - lo - 1, F.lit(n)) < s.batch_size)
        parses = inference.inferred(window, chain, "sample", obs="toks", seed=s.seed, iteration=it, keep=True, late=late_words(rules, s.categories, words))
        kept = written(parses.select("sent_id", "path", "log10p", "success", F.col("obs").alias("toks")), "parses")
        logprob = float(kept.agg(F.sum("log10p")).first()[0] or 0.0)
        series.append((it, logprob))
        counts = written(counted(kept, s.categories + 2, s.depth), "counts")
        dropped(kept)
        if (restarting or s.best_of_phase) and (best is None or logprob > best[0]):
            best = (logprob, rules, counts)
        if s.output:
            full = rules.join(counts, (rules.lhs == counts.lhs) & (rules.r1 == counts.r1) & rules.r2.eqNullSafe(counts.r2) & (rules.is_lex == counts.is_lex), "left")
            full.select(rules["*"], F.coalesce(counts.cnt, F.lit(0)).alias("cnt")).write.mode("overwrite").parquet(f"{s.output}/iter={it}")
        if s.report:
            s.report(it, logprob)
        if s.checkpoint:
            s.checkpoint(it, rules)
    return rules, series


def annealing_value(it: int, s: Settings) -> float:
    """M08 on the driver: the stepwise schedule, then 1, then the rise of super-cooling."""
    if s.cooling_start and it + s.restarts >= s.cooling_start:
        return 1.0 + (s.cooling_target - 1.0) * min(1.0, (it + s.restarts - s.cooling_start) / max(1, s.cooling_length))
    if not s.anneal_length or it >= s.anneal_length:
        return 1.0
    phase = it // max(1, s.anneal_length // s.anneal_phases)
    return s.init_anneal + phase * (s.final_anneal - s.init_anneal) / s.anneal_phases


def alpha_step(alpha: float, distributions: list[tuple[int, float]], low: float, high: float, rng: np.random.Generator, sd: float = 0.01) -> float:
    """One Metropolis step of a Dirichlet parameter over distributions given by (size, sum of ln p); both sums run over the same ones."""

    def logp(a: float) -> float:
        return sum(math.lgamma(a * k) - k * math.lgamma(a) + (a - 1) * s for k, s in distributions)

    new = rng.normal(alpha, sd)
    while not low < new < high:
        new = rng.normal(alpha, sd)
    return new if logp(new) - logp(alpha) > math.log(rng.random()) else alpha


def gaussian_draw(moments: DataFrame, seed: int, iteration: int) -> DataFrame:
    """Posterior mean and deviation of ``moments(tag, dim, n, mean, sd, ss)``: normal prior (0, 0.16), gamma prior (4, 4).

    A tag with one vector or none starts again with deviation 2.
    """

    def f(keys: pa.Array, n: pa.Array, mean: pa.Array, sd: pa.Array, ss: pa.Array) -> pa.Array:
        k, c, m, d, q = (x.to_numpy(zero_copy_only=False) for x in (keys, n, mean, sd, ss))
        z = normals(k, 0)
        fresh = (c <= 1) | ~(d > 0)
        with np.errstate(all="ignore"):
            var = 1 / (1 / 0.16**2 + c / d**2)
            precision = gammas(k, np.where(fresh, 4.0, 4 + c / 2)) / (4 + 0.5 * q)
            out = np.stack([np.where(fresh, 0.16 * z, var * c * m / d**2 + np.sqrt(var) * z), np.where(fresh, 2.0, 1 / np.sqrt(precision))], axis=1)
        return pa.ListArray.from_arrays(np.arange(0, 2 * len(k) + 1, 2, dtype=np.int32), pa.array(out.ravel()))

    key = F.xxhash64(F.lit(seed), F.lit(iteration), "tag", "dim")
    cells = F.arrow_udf(f, "array<double>")(key, F.col("n").cast("bigint"), F.col("mean").cast("double"), F.col("sd").cast("double"), F.col("ss").cast("double"))
    return moments.withColumn("d", cells).select("tag", "dim", F.col("d")[0].alias("mean"), F.col("d")[1].alias("sd"))


def best_of(series: DataFrame) -> DataFrame:
    """``series(run, iter, logprob)``: the run and iteration of the highest log probability; ties: the earliest."""
    return series.agg(F.max_by(F.struct("run", "iter"), F.struct("logprob", -F.col("iter"))).alias("b"), F.max("logprob").alias("logprob")).select("b.run", "b.iter", "logprob")
