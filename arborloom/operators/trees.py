"""Trees as bracket strings and as node tables (R, P19-P24, A14-A16, E09-E11 of the blueprint).

``nodes(tree_id, node_id, parent_id, child_ix, label, word, l, r, depth, n_children)``: preorder ids from 0, leaf span l..r with both ends,
root parent -1; word is set on preterminals (a label over one word). One tree is read in one Arrow row;
tables of trees are never grouped by anything larger than a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborloom.operators.text import escaped
from arborloom.session import ship_code

_TOKEN = re.compile(r"[()]|[^\s()]+")
NODES = "tree_id bigint, node_id int, parent_id int, child_ix int, label string, word string, l int, r int, depth int, n_children int"


def read_tree(text: str) -> list[list]:
    """Rows ``[node_id, parent_id, child_ix, label, word, l, r, depth, n_children]``; a tree that does not balance has none.

    ``(L w)`` is a preterminal; ``(L (..) (..))`` a phrase; a word beside phrases becomes a node labelled like itself; an outer
    bracket without a label gets the label "".
    """
    rows: list[list] = []
    stack: list[int] = []
    leaf, done, fresh = 0, False, False

    def release(at: int) -> None:
        """A word that turns out not to be alone under its label becomes a node of its own."""
        if rows[at][4] is not None:
            word, rows[at][4], rows[at][8] = rows[at][4], None, 1
            rows.append([len(rows), at, 0, word, word, leaf - 1, leaf - 1, len(stack), 0])

    for token in _TOKEN.findall(text):
        if token == "(":
            if done:
                return []
            parent = stack[-1] if stack else -1
            ix = 0
            if parent >= 0:
                release(parent)
                ix = rows[parent][8]
                rows[parent][8] += 1
            stack.append(len(rows))
            rows.append([len(rows), parent, ix, "", None, leaf, -1, len(stack) - 1, 0])
            fresh = True
        elif token == ")":
            if not stack:
                return []
            rows[stack.pop()][6] = leaf - 1
            done, fresh = not stack, False
        elif not stack:
            return []
        elif fresh:
            rows[stack[-1]][3], fresh = token, False
        else:
            top = rows[stack[-1]]
            if top[8] == 0 and top[4] is None:
                top[4] = token
                leaf += 1
            else:
                release(stack[-1])
                rows.append([len(rows), stack[-1], top[8], token, token, leaf, leaf, len(stack), 0])
                top[8] += 1
                leaf += 1
    return rows if done else []


def read_trees(trees: DataFrame, key: str = "tree_id", tree: str = "tree") -> DataFrame:
    """The node table of ``trees(key, tree)``. Null and unbalanced trees have no nodes."""
    ship_code(trees.sparkSession)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree_id", "node_id", "parent_id", "child_ix", "label", "word", "l", "r", "depth", "n_children"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 4]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in read_tree(text) if text else ():
                    columns[0].append(k)
                    for c, v in zip(columns[1:], row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return trees.select(F.col(key).cast("bigint"), F.col(tree)).mapInArrow(f, NODES)


def written_trees(nodes: DataFrame) -> DataFrame:
    """Bracket strings from nodes, in preorder: each node closes itself and the phrases that end with it."""
    w = W.partitionBy("tree_id").orderBy("node_id")
    after = F.coalesce(F.lead("depth").over(w), F.lit(0))
    text = F.concat(F.lit("("), F.col("label"), F.when(F.col("word").isNotNull(), F.concat(F.lit(" "), F.col("word"))).otherwise(F.lit("")), F.repeat(F.lit(")"), F.greatest(F.col("depth") - after + 1, F.lit(0))))
    parts = nodes.withColumn("text", text)
    return parts.groupBy("tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), " ").alias("tree"))


def productions(nodes: DataFrame) -> DataFrame:
    """``(tree_id, node_id, lhs, rhs, is_lex)``: children labels in order, or the word."""
    child = nodes.select("tree_id", F.col("parent_id").alias("node_id"), "child_ix", F.col("label").alias("child"))
    rhs = child.where("node_id >= 0").groupBy("tree_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("child_ix", "child"))), lambda x: x["child"]).alias("rhs"))
    phrases = nodes.select("tree_id", "node_id", F.col("label").alias("lhs")).join(rhs, ["tree_id", "node_id"]).withColumn("is_lex", F.lit(False))
    words = nodes.where("word is not null").select("tree_id", "node_id", F.col("label").alias("lhs"), F.array("word").alias("rhs"), F.lit(True).alias("is_lex"))
    return phrases.unionByName(words)


def spans(nodes: DataFrame, text: bool = False) -> DataFrame:
    """``(tree_id, label, span)`` of every node over more than one leaf; span stands for its words.

    The words of a tree are hashed once each; a span is the 128-bit hash of their hashes, so no text is multiplied by the depth of a tree. With ``text``
    spans are the words themselves, joined by blanks.
    """
    value = F.col("word") if text else F.xxhash64("word")
    leaves = nodes.where("word is not null").groupBy("tree_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l", value.alias("v")))), lambda x: x["v"]).alias("leaves"))
    part = F.slice("leaves", F.col("l") + 1, F.col("r") - F.col("l") + 1)
    span = F.array_join(part, " ") if text else span_key(part)
    return nodes.where("r > l").join(leaves, "tree_id").select("tree_id", "label", "l", "r", span.alias("span"))


def span_key(hashes: Column) -> Column:
    """128 bits that stand for a sequence of hashes of words."""
    return F.struct(F.xxhash64(hashes).alias("h1"), F.xxhash64(F.lit(1), hashes).alias("h2"))


def _per_tree(nodes: DataFrame, columns: list[str], schema: str, f) -> DataFrame:
    """``f(rows)`` gives the result rows of each tree, its nodes being in preorder; one pass over sorted partitions, one tree in memory."""
    names = ["tree_id", *columns]

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split(" ")[0] for x in schema.split(", ")]
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        types = [kinds[x.split(" ")[1]] for x in schema.split(", ")]
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            a = 0
            while a < len(rows):
                b = a
                while b < len(rows) and rows[b][0] == rows[a][0]:
                    b += 1
                out += [(rows[a][0], *r) for r in f([r[1:] for r in rows[a:b]])]
                a = b
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=fields)

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            if not held:
                continue
            cut = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] != held[-1][0]), -1) + 1
            if cut:
                yield flush(held[:cut])
                held = held[cut:]
        if held:
            yield flush(held)

    ship_code(nodes.sparkSession)
    return nodes.select(*names).repartition("tree_id").sortWithinPartitions("tree_id", "node_id").mapInArrow(g, schema)


def without_unary(nodes: DataFrame) -> DataFrame:
    """Phrases over one phrase give way to it; a chain keeps its lowest node. One stack pass a tree."""

    def collapse(rows: list[tuple]) -> list[tuple]:
        out: list[list] = []
        stack: list[tuple[int, int]] = []  # depth of a kept node and its new number
        children: list[int] = []
        for _, label, word, l, r, depth, n in rows:  # noqa: E741
            while stack and stack[-1][0] >= depth:
                stack.pop()
            if n == 1:
                continue
            parent = stack[-1][1] if stack else -1
            ix = 0
            if parent >= 0:
                ix = children[parent]
                children[parent] += 1
            out.append((len(out), parent, ix, label, word, l, r))
            children.append(0)
            stack.append((depth, len(out) - 1))
        return out

    schema = "tree_id bigint, node_id int, parent_id int, child_ix int, label string, word string, l int, r int"
    return _per_tree(nodes, ["node_id", "label", "word", "l", "r", "depth", "n_children"], schema, collapse)


def punctuation_free_length(nodes: DataFrame, punctuation: list[str]) -> DataFrame:
    """Leaves whose label is not punctuation."""
    return nodes.where("word is not null").groupBy("tree_id").agg(F.sum((~F.col("label").isin(punctuation)).cast("bigint")).alias("n"))


def branching(nodes: DataFrame) -> DataFrame:
    """Over binary nodes, how often the left and the right child are binary too."""
    child = nodes.select("tree_id", F.col("parent_id").alias("node_id"), "child_ix", (F.col("n_children") == 2).cast("bigint").alias("two"))
    both = nodes.where("n_children = 2").select("tree_id", "node_id").join(child, ["tree_id", "node_id"])
    return both.agg(F.sum(F.when(F.col("child_ix") == 0, F.col("two"))).alias("n_left"), F.sum(F.when(F.col("child_ix") == 1, F.col("two"))).alias("n_right"))


def center_embedded(nodes: DataFrame) -> DataFrame:
    """Trees in which some node's right child has a left child that has a right child."""
    at = lambda ix, up, me: nodes.where(f"child_ix = {ix}").select("tree_id", F.col("parent_id").alias(up), F.col("node_id").alias(me))
    path = at(1, "a", "b").join(at(0, "b", "c"), ["tree_id", "b"]).join(at(1, "c", "d"), ["tree_id", "c"])
    return path.select("tree_id").distinct()


def running_depth(steps: DataFrame) -> DataFrame:
    """``steps(sent_id, pos, f, j)``: depth after each step, +1 on a fork without a join, -1 on a join without a fork."""
    delta = F.when((F.col("f") == 1) & (F.col("j") == 0), 1).when((F.col("f") == 0) & (F.col("j") == 1), -1).otherwise(0)
    w = W.partitionBy("sent_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("depth", F.sum(delta).over(w))


def repaired(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Leaves ``(tree_id, leaf_ix, word)`` overwritten by gold ones where both trees have as many; others stay."""
    n = lambda d, c: d.groupBy("tree_id").agg(F.count("*").alias(c))
    same = n(predicted, "n").join(n(gold, "m"), "tree_id").where("n = m").select("tree_id", F.lit(True).alias("same"))
    g = gold.select("tree_id", "leaf_ix", F.col("word").alias("gold_word")).join(same, "tree_id")
    return predicted.join(g, ["tree_id", "leaf_ix"], "left").select("tree_id", "leaf_ix", F.coalesce("gold_word", "word").alias("word"))


def state_tree(steps: list[tuple[int, int, int, int, int, str]]) -> str:
    """The bracket tree of steps ``(f, j, a, b, g, word)``, j, a and b being those decided after the word.

    The stack holds trees whose last place is open, as text before it, brackets to close after it and the label
    expected there. A word without a fork fills the open place of the topmost tree and so completes it. What is complete then
    starts a new tree ``a`` (no join) or goes under the label expected by the tree below (join); either leaves a place for ``b``.
    A sequence that does not end with one complete tree raises ValueError.
    """
    if len(steps) == 1:
        return f"({steps[0][4]} {steps[0][5]})"
    stack: list[tuple[str, int, int]] = []
    for k, (f, j, a, b, g, word) in enumerate(steps):
        part = f"({g} {word})"
        if f == 0:
            if not stack:
                raise ValueError("no open place")
            before, closing, _ = stack.pop()
            part = before + part + ")" * closing
            if j == 1 and not stack:
                if k + 1 < len(steps):
                    raise ValueError("words after the end")
                return part
        if j == 1:
            if not stack:
                raise ValueError("nothing to join")
            before, closing, expected = stack.pop()
            stack.append((f"{before}({expected} {part} ", closing + 1, b))
        else:
            stack.append((f"({a} {part} ", 1, b))
    raise ValueError("open places at the end")


def parse_states(text: str) -> list[tuple[int, int, int, int, int, str]]:
    """Steps of a state sequence ``j::ACTa/AWAb;..::f::POSg::word ..`` with j, a, b moved to the word before.

    a and b are the deepest filled ones; after the last word j is 1.
    """
    raw = []
    for piece in text.split(" "):
        j, stack, f, g, word = re.split(":+", piece, maxsplit=4)
        a, b = 0, 0
        for pair in stack.split(";"):
            x, y = pair.split("/")
            a, b = int(x.removeprefix("ACT")) or a, int(y.removeprefix("AWA")) or b
        raw.append((int(j == "+"), a, b, int(f == "+"), int(g.removeprefix("POS")), word))
    after = [*raw[1:], (1, 0, 0, 0, 0, "")]
    return [(f, nxt[0], nxt[1], nxt[2], g, word) for (_, _, _, f, g, word), nxt in zip(raw, after, strict=True)]


def dependency_tree(words: list[str], tags: list[str], heads: list[int]) -> str:
    """Constituency tree of a dependency sentence: a head with all its dependents beside it becomes a flat ``(X ..)``.

    Brackets in words are written by name. A sentence in which some head cannot have all its dependents side by side (crossing, cyclic or several
    outermost heads, heads out of range) gives ``(TOP (S error))``. One pass over the heads, whatever their order.
    """
    n = len(words)
    error = "(TOP (S error))"
    below: list[list[int]] = [[] for _ in range(n + 1)]
    for i, h in enumerate(heads, 1):
        if not 0 <= h <= n:
            return error
        below[h].append(i)
    if len(below[0]) != 1:
        return error
    order = [below[0][0]]
    for i in order:
        order.extend(below[i])
    if len(order) != n:
        return error
    first, last, text = list(range(n + 1)), list(range(n + 1)), [""] * (n + 1)
    for i in reversed(order):
        leaf = f"({tags[i - 1]} {words[i - 1].replace('(', '-LRB-').replace(')', '-RRB-')})"
        if not below[i]:
            text[i] = leaf
            continue
        parts = sorted([(first[d], last[d], text[d]) for d in below[i]] + [(i, i, leaf)])
        if any(a[1] + 1 != b[0] for a, b in zip(parts, parts[1:], strict=False)):
            return error
        first[i], last[i] = parts[0][0], parts[-1][1]
        text[i] = f"(X {' '.join(p[2] for p in parts)})"
    return text[order[0]]


def mapped(df: DataFrame, f, out: str, *columns: str) -> DataFrame:
    """``out`` = f over the values of the columns of each row, Arrow batch by batch; an error or a null argument gives null."""

    def g(*arrays: pa.Array) -> pa.Array:
        made = []
        for values in zip(*(a.to_pylist() for a in arrays), strict=True):
            try:
                made.append(None if any(v is None for v in values) else f(*values))
            except (ValueError, IndexError, KeyError):
                made.append(None)
        return pa.array(made, pa.string())

    ship_code(df.sparkSession)
    return df.withColumn(out, F.arrow_udf(g, "string")(*map(F.col, columns)))


def random_binary_tree(words: list[str], tags: list[str], seed: int) -> str:
    """A random binary tree over tagged words; the label of a phrase is one of its children's."""
    rng = np.random.Generator(np.random.Philox(key=seed & (2**64 - 1)))
    nodes = [(t, f"({t} {w})") for w, t in zip(words, tags, strict=True)]
    while len(nodes) > 1:
        i = int(rng.integers(len(nodes) - 1))
        (la, a), (lb, b) = nodes[i], nodes[i + 1]
        label = (la, lb)[int(rng.integers(2))]
        nodes[i : i + 2] = [(label, f"({label} {a} {b})")]
    return nodes[0][1]


def gold_toy_trees(n: Column) -> Column:
    """Template trees of 3 and 7 words, by turns."""
    three = F.format_string("(S (A w%d) (B (C w%d) (D w%d)))", n, n + 1, n + 2)
    seven = F.format_string("(S (A (B w%d) (C w%d)) (D (E (F w%d) (G w%d)) (H (I w%d) (J (K w%d) (L w%d)))))", *(n + i for i in range(7)))
    return F.when(n % 2 == 0, three).otherwise(seven)


def ancestors(nodes: DataFrame) -> DataFrame:
    """``(tree_id, node_id, distance, ancestor_id)``: the nodes above each node, from the stack of one pass a tree."""

    def above(rows: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        stack: list[tuple[int, int]] = []
        for node, depth in rows:
            while stack and stack[-1][0] >= depth:
                stack.pop()
            out += [(node, depth - d, a) for d, a in stack]
            stack.append((depth, node))
        return out

    return _per_tree(nodes, ["node_id", "depth"], "tree_id bigint, node_id int, distance int, ancestor_id int", above)


def siblings(nodes: DataFrame) -> DataFrame:
    """Each node with the next one under the same parent, null at the last."""
    w = W.partitionBy("tree_id", "parent_id").orderBy("child_ix")
    return nodes.where("parent_id >= 0").select("tree_id", "node_id", F.lead("node_id").over(w).alias("next_id"))


def covering(nodes: DataFrame, l: int, r: int) -> DataFrame:  # noqa: E741
    """The lowest node of each tree over the leaves l .. r."""
    return nodes.where((F.col("l") <= l) & (F.col("r") >= r)).groupBy("tree_id").agg(F.max_by("node_id", F.struct("depth", "node_id")).alias("node_id"))


def head_dependencies(text: str, model: dict[tuple[str, str], float]) -> list[tuple[int, int]]:
    """``(dependent, head)`` leaf numbers from 1; the head of a phrase is its most probable child (the first of equals), ROOT is 0."""
    rows = read_tree(text)
    children: dict[int, list[int]] = {}
    for r in rows:
        children.setdefault(r[1], []).append(r[0])
    head: dict[int, int] = {}
    for r in reversed(rows):
        if r[4] is not None:
            head[r[0]] = r[5] + 1
        elif kids := [k for k in children.get(r[0], []) if k in head]:  # a label over nothing has no head
            head[r[0]] = head[max(kids, key=lambda k: (model.get((r[3], rows[k][3]), 0.0), -k))]
    out = {}
    for r in rows:
        if r[0] in head:
            above = head[r[1]] if r[1] >= 0 else 0
            if head[r[0]] != above and head[r[0]] not in out:
                out[head[r[0]]] = above
    return sorted(out.items())


def dependencies_of(trees: DataFrame, model: DataFrame, key: str = "tree_id", tree: str = "tree") -> DataFrame:
    """R12 over a table: ``(tree_id, dependent, head)``; ``model(lhs, child, p)`` is one row a pair of labels (at most 1,000,000, checked)."""
    rows = model.select("lhs", "child", "p").limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("a head model of more than 1,000,000 pairs")
    table = {(str(r[0]), str(r[1])): float(r[2]) for r in rows}

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, d, h) for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) if x for d, h in head_dependencies(x, table)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["tree_id", "dependent", "head"])

    ship_code(trees.sparkSession)
    return trees.select(F.col(key).cast("bigint"), tree).mapInArrow(f, "tree_id bigint, dependent int, head int")


#: Fixed values of the incremental-parse format: divider, first state, empty level and relations.
DIVIDER, EMPTY_LEVEL, RELATIONS = "----------", "-.0/-.0", "0/0/0,0/0/0,0/0/0,0/0/0"
FIRST_STATE = f"0 0;BOG.0/BOG.0;{EMPTY_LEVEL};{EMPTY_LEVEL};{EMPTY_LEVEL};-.0;{RELATIONS}"


def incremental_parse(steps: list[tuple[int, int, int, int, int, str]], levels: int = 4) -> list[str]:
    """The parse of a sentence, last line first: a closing row, a row a word, the first state and a divider.

    A row has its number, 0 if the word forks else 1, the stack of incomplete ``a/b`` before the next word, the tag, relations and the word;
    reserved signs in words are written by name.
    """
    stack: list[str] = []
    lines = [DIVIDER, FIRST_STATE]
    for k, (f, j, a, b, g, word) in enumerate(steps, 1):
        if f == 0 and stack:
            stack.pop()
        if j == 1 and stack:
            stack[-1] = f"{stack[-1].split('/')[0]}/{b}_"
        elif j == 0:
            stack.append(f"{a}_/{b}_")
        shown = [*stack, *[EMPTY_LEVEL] * (levels - len(stack))]
        lines.append(f"{k} {int(f == 0)};{';'.join(shown)};{g}_;{RELATIONS} {escaped(word)}")
    lines.append(f"{len(steps) + 1} 1;{';'.join([EMPTY_LEVEL] * levels)};99_;{RELATIONS} null")
    return lines[::-1]


def incremental_parses(states: DataFrame, text: str = "states", levels: int = 4) -> DataFrame:
    """S30 over a table: ``parse``, the lines of the state sequence in ``text``; null where it cannot be read."""
    return mapped(states, lambda x: "\n".join(incremental_parse(parse_states(x), levels)), "parse", text)


def labelled(tree: Column) -> Column:
    """The label X for every bracket and every word of a tree that has no labels."""
    opened = F.regexp_replace(F.regexp_replace(tree, "\\(\\s*", "( "), "\\)", " )")
    words = F.regexp_replace(opened, "(?<=\\s)([^()\\s]+)", "(X $1)")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(words, "\\( ", "(X "), "\\s+\\)", ")"), "\\s+", " ")


def proper_trees(trees: DataFrame, key: str = "tree_id", tree: str = "tree") -> DataFrame:
    """P19 over a table: bracketings without labels, or with words alone, as trees of X without unary chains (a node table)."""
    return without_unary(read_trees(trees.withColumn(tree, labelled(F.col(tree))), key, tree))


#: Fixed values of P25: preterminals of punctuation that go, and the tags of empty nodes.
PUNCTUATION = (",", ".", "``", "`", "--", "-RRB-", "-LRB-", "-LCB-", "-RCB-", "''", "'", "...", "?", "!", ":", ";")
EMPTY_TAG = "-NONE-"


def cleaned(trees: DataFrame, key: str = "tree_id", tree: str = "tree") -> DataFrame:
    """P25: ``(key, tree)`` for evaluation: empty nodes and traces dropped, lower case, unary chains collapsed, punctuation dropped, collapsed again.

    Trees that do not balance, and those of which nothing is left, have no row.
    """

    def clean(text: str) -> str | None:
        children: dict[int, list] = {}
        rows = read_tree(text)
        for r in rows:
            children.setdefault(r[1], []).append(r)

        made: dict[int, str | None] = {}
        for r in reversed(rows):
            label, word = r[3], r[4]
            if word is not None:
                gone = label == EMPTY_TAG or word.startswith("*") or word in PUNCTUATION
                made[r[0]] = None if gone else f"({label} {word.lower()})"
                continue
            kept = [x for x in (made[c[0]] for c in children.get(r[0], [])) if x]
            made[r[0]] = None if not kept else kept[0] if len(kept) == 1 else f"({label} {' '.join(kept)})"
        return made.get(0) if rows else None

    return mapped(trees.select(F.col(key).alias("_key"), F.col(tree).alias("_tree")), clean, "_clean", "_tree").where("_clean is not null").select(F.col("_key").alias(key), F.col("_clean").alias(tree))
