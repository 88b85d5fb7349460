"""Random grammars and trees drawn from them (M23, M24, R14 of the blueprint), one Arrow row a tree, keyed by (seed, tree)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborloom.session import dropped, ship_code, written


def random_grammar(categories: int, words: int, seed: int, branching: tuple[float, float, float, float] = (0.2, 0.3, 0.1, 0.4)) -> dict[str, list[tuple[tuple[str, ...], float]]]:
    """Rules by category, p summing to 1: root, and for each category left branching, right branching, recursive and terminating rules
    in the given shares; the words of a category come from stick breaking.
    """
    rng = np.random.default_rng(seed)
    names = [f"C{i}" for i in range(1, categories + 1)]
    out = {"T": [((c,), float(w)) for c, w in zip(names, rng.dirichlet(np.ones(categories)), strict=True)]}
    for i, c in enumerate(names):
        others = [x for x in names if x != c] or [c]
        pick = lambda: others[int(rng.integers(len(others)))]  # noqa: B023, E731
        left, right, both, end = branching
        sticks, rest = [], 1.0
        for _ in range(words):
            b = rng.beta(1, 3)
            sticks.append(rest * b)
            rest *= 1 - b
        sticks[-1] += rest
        rules = [((c, pick()), left), ((pick(), c), right), ((c, c), both)]
        rules += [((f"w{i}_{k}",), end * s) for k, s in enumerate(sticks)]
        out[c] = rules
    return out


def layered_grammar(
    active: int, awaited: int, tags: int, words: int, seed: int, branching: float = 0.5, recursion: float = 0.1, termination: float = 0.4, one_word: float = 0.1
) -> dict[str, list[tuple[tuple[str, ...], float]]]:
    """Active (A..), awaited (B..) and word (P..) categories under the root T.

    A phrase has rules of four classes, each class with shares drawn at random: both children phrases (``recursion``), the left one
    (``branching``), the right one, none (``termination``); termination takes its share first, then recursion, then branching. The root goes to
    a word category with ``one_word``. Words come from stick breaking.
    """
    rng = np.random.default_rng(seed)
    a, b, p = ([f"{x}{i}" for i in range(1, n + 1)] for x, n in (("A", active), ("B", awaited), ("P", tags)))

    def spread(outcomes: list[tuple[str, ...]], mass: float) -> list[tuple[tuple[str, ...], float]]:
        weight = rng.random(len(outcomes))
        return [(o, float(mass * w)) for o, w in zip(outcomes, weight / weight.sum(), strict=True)]

    pairs = lambda x, y: [(i, j) for i in x for j in y]
    out = {"T": spread([(x,) for x in a], 1 - one_word) + spread([(x,) for x in p], one_word)}
    go_on = 1 - termination
    for c in (*a, *b):
        out[c] = (
            spread(pairs(p, p), termination) + spread(pairs(a, b), go_on * recursion)
            + spread(pairs(a, p), go_on * (1 - recursion) * branching) + spread(pairs(p, b), go_on * (1 - recursion) * (1 - branching))
        )
    for i, c in enumerate(p):
        beta = rng.beta(1, 3, words)
        beta[-1] = 1.0
        sticks = beta * np.concatenate([[1.0], np.cumprod(1 - beta)[:-1]])
        out[c] = [((f"w{i}_{k}",), float(x)) for k, x in enumerate(sticks)]
    return out


def expand_layered(rules: dict, rng: np.random.Generator, most_depth: int, most_recursion: int) -> str:
    """A tree of a layered grammar, without recursion in Python.

    A left child of a right child lies one embedding deeper; at ``most_depth`` awaited phrases take only rules whose left child is a word, and from
    ``most_recursion`` levels on every phrase ends in two words.
    """
    out: list[str] = []
    stack: list = [("T", 0, 0, False)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        symbol, depth, level, right = item
        options = rules.get(symbol)
        if options is None:
            out.append(f" {symbol}")
            continue
        if symbol[0] in "AB" and level >= most_recursion:
            options = [r for r in options if all(x[0] == "P" for x in r[0])]
        elif symbol[0] == "B" and depth >= most_depth:
            options = [r for r in options if r[0][0][0] == "P"]
        w = np.array([x for _, x in options])
        rhs = options[int(rng.choice(len(options), p=w / w.sum()))][0]
        out.append(f" ({symbol}")
        stack.append(")")
        if len(rhs) == 1:
            stack.append((rhs[0], depth, level + 1, right))
        else:
            stack += [(rhs[1], depth, level + 1, True), (rhs[0], depth + right, level + 1, False)]
    return "".join(out).strip()


def embedding_depth(nodes: DataFrame) -> DataFrame:
    """``(tree_id, depth)``: the most phrases that are left children of right children on the way to any node of a tree (a node table)."""
    from arborloom.operators.trees import ancestors

    turn = nodes.where("child_ix = 0 and word is null").select("tree_id", "node_id", F.col("parent_id")).join(nodes.where("child_ix = 1").select("tree_id", F.col("node_id").alias("parent_id")), ["tree_id", "parent_id"])
    turns = turn.select("tree_id", "node_id")
    above = ancestors(nodes).join(turns.withColumnRenamed("node_id", "ancestor_id"), ["tree_id", "ancestor_id"]).select("tree_id", "node_id")
    deep = above.unionByName(turns).groupBy("tree_id", "node_id").agg(F.count("*").alias("d")).groupBy("tree_id").agg(F.max("d").alias("depth"))
    return nodes.select("tree_id").distinct().join(deep, "tree_id", "left").select("tree_id", F.coalesce("depth", F.lit(0)).alias("depth"))


#: Rules of a conditional model that are held as a dictionary; ``trees_of_model`` has no such bound.
MOST_RULES = 1_000_000
#: Rules of one category that are looked up together.
BLOCK = 4096


def rules_of_model(model: DataFrame, name: str = "R") -> dict[str, list[tuple[tuple[str, ...], float]]]:
    """The rules of a conditional model ``(id, cond, out, p)`` with arrays cond and out; at most MOST_RULES, checked."""
    rows = model.where((F.col("id") == name) & (F.col("p") > 0)).select(F.array_join("cond", " ").alias("c"), "out", "p").limit(MOST_RULES + 1).toArrow()
    if rows.num_rows > MOST_RULES:
        raise ValueError(f"a model of more than {MOST_RULES} rules")
    out: dict[str, list] = {}
    for c, rhs, p in sorted(zip(*(x.to_pylist() for x in rows.columns), strict=True), key=lambda r: r[:2]):
        out.setdefault(c, []).append((tuple(x for x in rhs if x != "-"), float(p)))
    totals = {c: sum(x for _, x in options) for c, options in out.items()}
    return {c: [(rhs, w / totals[c]) for rhs, w in options if rhs] for c, options in out.items()}


def _outcomes(options: list[tuple[tuple[str, ...], float]]) -> tuple[list[tuple[str, ...]], np.ndarray]:
    """Right sides and their running probability, from which a draw takes one search."""
    p = np.array([w for _, w in options])
    upto = np.cumsum(p / p.sum())
    return [rhs for rhs, _ in options], upto / upto[-1]


def prepared(rules: dict) -> dict[str, tuple]:
    """For each symbol the outcomes of all its rules and of its terminating ones, made once for all nodes that ``expand`` draws."""
    return {c: (_outcomes(options), _outcomes([r for r in options if len(r[0]) == 1] or options)) for c, options in rules.items()}


def expand(rules: dict[str, tuple], symbol: str, rng: np.random.Generator, most_depth: int, depth: int = 0) -> str:
    """A bracketed tree of a symbol, from ``prepared`` rules; beyond ``most_depth`` only terminating rules are drawn."""
    right_sides, upto = rules[symbol][depth >= most_depth]
    rhs = right_sides[int(upto.searchsorted(rng.random(), side="right"))]
    parts = [expand(rules, x, rng, most_depth, depth + 1) if x in rules else x for x in rhs]
    return f"({symbol} {' '.join(parts)})"


def sampled_trees(spark: SparkSession, rules: dict, n: int, seed: int, start: str = "T", most_depth: int = 12, layered: int = 0) -> DataFrame:
    """``(tree_id, tree)`` for tree ids 0 .. n - 1; ``layered``: the levels of a layered grammar, whose embedding is bounded by ``most_depth``."""
    rules = rules if layered else prepared(rules)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = (np.random.Generator(np.random.Philox(key=[seed, i])) for i in ids)
            trees = [expand_layered(rules, rng, most_depth, layered) if layered else expand(rules, start, rng, most_depth) for rng in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees, pa.string())], names=["tree_id", "tree"])

    return spark.range(n).select(F.col("id").alias("tree_id")).mapInArrow(f, "tree_id bigint, tree string")


def _blocks(model: DataFrame, name: str) -> DataFrame:
    """``(block, c, rules, upto, ends)``: the rules of each category by their right sides, in blocks of at most BLOCK.

    ``upto`` and ``ends`` are running sums within a block, of all rules and of those of one symbol. Only sums are kept for a category, so a
    frequent one is no hot task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last = TaskContext.get().partitionId() << 32, None
        rules, p = [], []

        def block() -> pa.RecordBatch:
            sums = [np.cumsum(p), np.cumsum(np.where([len(r) == 1 for r in rules], p, 0.0))]
            columns = [[number], [last], [rules], *([x.tolist()] for x in sums)]
            kinds = [pa.int64(), pa.string(), pa.list_(pa.list_(pa.string())), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["block", "c", "rules", "upto", "ends"])

        for batch in batches:
            for c, out, w in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if rules and (c != last or len(rules) == BLOCK):
                    yield block()
                    number, rules, p = number + 1, [], []
                if rhs := [x for x in out if x != "-"]:
                    last = c
                    rules.append(rhs)
                    p.append(w)
        if rules:
            yield block()

    rows = model.where((F.col("id") == name) & (F.col("p") > 0)).select(F.array_join("cond", " ").alias("c"), "out", F.col("p").cast("double").alias("p"))
    ordered = rows.repartitionByRange("c", "out").sortWithinPartitions("c", "out")
    return ordered.mapInArrow(pack, "block bigint, c string, rules array<array<string>>, upto array<double>, ends array<double>")


def _index(blocks: DataFrame) -> dict[str, tuple]:
    """For each category its blocks, the sums of all its rules and of those of one symbol up to each block (two rows, 0 first), and its phrase rules:
    where they begin and end in either row, and their right sides. Of rules over words nothing is kept.
    """
    heads: dict[str, list] = {}
    ends = [F.element_at(x, -1) for x in ("upto", "ends")]
    for c, first, block, *sums in zip(*(x.to_pylist() for x in blocks.select("c", F.col("rules")[0], "block", *ends).toArrow().columns), strict=True):
        heads.setdefault(c, []).append((first, block, sums))
    names = set(heads)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block, rules, *sums in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for i, rhs in enumerate(rules):
                    if any(x in names for x in rhs):
                        found.append((block, rhs, *((s[i - 1] if i else 0.0) for s in sums), *(s[i] for s in sums)))
            columns = zip(*found, strict=True) if found else [[]] * 6
            kinds = [pa.int64(), pa.list_(pa.string()), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["block", "rhs", "a0", "a1", "b0", "b1"])

    inside: dict[int, list] = {}
    inner = blocks.select("block", "rules", "upto", "ends").mapInArrow(phrases, "block bigint, rhs array<string>, a0 double, a1 double, b0 double, b1 double")
    for block, *rule in zip(*(x.to_pylist() for x in inner.toArrow().columns), strict=True):
        inside.setdefault(block, []).append(rule)
    out = {}
    for c, parts in heads.items():
        parts.sort(key=lambda x: x[:2])
        upto = np.concatenate([np.zeros((2, 1)), np.cumsum([s for *_, s in parts], axis=0).T], axis=1)
        # A rule begins and ends in a block where _words finds it, in the same floating-point numbers.
        held = [(rhs, upto[:, k] + a, upto[:, k] + b) for k, (_, block, _) in enumerate(parts) for rhs, *ab in inside.get(block, ()) for a, b in [(ab[:2], ab[2:])]]
        held.sort(key=lambda r: (r[1][0], r[2][0]))
        begin, end = (np.array([r[k] for r in held]).reshape(-1, 2).T for k in (1, 2))
        out[c] = ([block for _, block, _ in parts], upto, begin, end, [r[0] for r in held])
    return out


def _grown(index: dict[str, tuple], start: str, rng: np.random.Generator, most_depth: int) -> tuple[list[str], list[tuple]]:
    """A tree as ``expand`` draws it, without its words: the texts around them, and for each word ``(block, row of sums, sum before the block, sum drawn)``."""
    texts, asked, stack = [""], [], [(start, 0)]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            texts[-1] += item
            continue
        symbol, depth = item
        blocks, upto, begin, end, rules = index[symbol]
        row = int(depth >= most_depth and upto[1, -1] > 0)
        x = min(rng.random() * upto[row, -1], np.nextafter(upto[row, -1], 0))
        texts[-1] += f"({symbol} "
        stack.append(")")
        # Rules of no width in this row begin and end at one place, so the last one that ends beyond x is the one to look at.
        at = int(end[row].searchsorted(x, side="right"))
        if at < len(rules) and begin[row, at] <= x:
            for k, child in reversed(list(enumerate(rules[at]))):
                stack.append((child, depth + 1) if child in index else child)
                if k:
                    stack.append(" ")
        else:
            block = int(upto[row].searchsorted(x, side="right")) - 1
            asked.append((blocks[block], row, float(upto[row, block]), float(x)))
            texts.append("")
    return texts, asked


def _words(rows: DataFrame) -> DataFrame:
    """``(tree_id, pos, text)``: the rules drawn; each block comes before the draws from it, which go by in batches."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, sums, at = [], (), None
        for batch in batches:
            block, tree = batch.column("block").to_pylist(), batch.column("tree_id").to_pylist()
            row, before, x, pos = (batch.column(k).to_pylist() for k in ("row", "before", "x", "pos"))
            out = []
            for i, (b, t) in enumerate(zip(block, tree, strict=True)):
                if t < 0:
                    rules, sums, at = batch.column("rules")[i].as_py(), tuple(batch.column(k)[i].values.to_numpy() for k in ("upto", "ends")), b
                    continue
                if b != at:
                    raise ValueError(f"block {b} is missing")
                out.append((t, pos[i], " ".join(rules[int((before[i] + sums[row[i]]).searchsorted(x[i], side="right"))])))
            columns = zip(*out, strict=True) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["tree_id", "pos", "text"])

    return rows.repartition("block").sortWithinPartitions("block", "tree_id").mapInArrow(f, "tree_id bigint, pos int, text string")


def trees_of_model(model: DataFrame, n: int, seed: int, name: str = "R", start: str = "T", most_depth: int = 12) -> DataFrame:
    """``(tree_id, tree)`` drawn from a conditional model ``(id, cond, out, p)`` of any number of rules.

    The trees are those of ``sampled_trees`` with ``rules_of_model``. Tasks hold the categories and the rules that lead to categories; a draw that
    falls on words only is looked up in the blocks of all rules. Without rules of ``start`` there are no trees.
    """
    spark = model.sparkSession
    ship_code(spark)
    blocks = written(_blocks(model, name), "blocks")
    index = _index(blocks)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = pa.struct([("block", pa.int64()), ("row", pa.int32()), ("before", pa.float64()), ("x", pa.float64())])
        for batch in batches:
            made = [_grown(index, start, np.random.Generator(np.random.Philox(key=[seed, i])), most_depth) for i in batch.column(0).to_pylist()]
            asked = [[dict(zip(("block", "row", "before", "x"), a, strict=True)) for a in tree] for _, tree in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in made], pa.list_(pa.string())), pa.array(asked, pa.list_(draw))], names=["tree_id", "texts", "asked"])

    ids = spark.range(n if start in index else 0).select(F.col("id").alias("tree_id"))
    grown = written(ids.mapInArrow(f, "tree_id bigint, texts array<string>, asked array<struct<block:bigint,row:int,before:double,x:double>>"), "grown")
    draws = grown.select("tree_id", F.posexplode("asked").alias("pos", "a")).select("tree_id", "pos", "a.*")
    words = written(_words(blocks.drop("c").withColumn("tree_id", F.lit(-1).cast("bigint")).unionByName(draws, allowMissingColumns=True)), "words")
    dropped(blocks)
    said = words.groupBy("tree_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("said"))
    text = F.array_join(F.zip_with("texts", F.coalesce("said", F.array().cast("array<string>")), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return grown.join(said, "tree_id", "left").select("tree_id", text.alias("tree"))


def relabelled(nodes: DataFrame, source: str, target: str, seed: int) -> DataFrame:
    """Half of the nodes of a label, by a hash coin, get another label."""
    coin = F.pmod(F.xxhash64(F.lit(seed), "tree_id", "node_id"), F.lit(2)) == 1
    return nodes.withColumn("label", F.when((F.col("label") == source) & coin, target).otherwise(F.col("label")))
