"""Similarity clusters by grid density: quantise features, count cells, join adjacent dense cells, propagate least labels.

The features of a direction are its coordinates in a randomly turned frame, quantised to the two largest with their signs: that is its cell.
The further coordinates, by size, order the vectors of a cell, so that a full cell falls into finer ones of at most CHUNK vectors wherever vectors are
dense, by one rule at every number of rows. Cells are counted in SQL; a cell is dense if one of its vectors has enough others near it. Dense cells whose
means point into one cell of a turned frame and one way are adjacent; the least cell label is propagated over adjacent cells until nothing changes.
The components' means are settled to their fixed points by exact passes, and the vectors near them leave. The rest is quantised in further frames with a
lower density until a round of frames shows no new cluster; what lies around a dense cell of too few vectors leaves this search too. Membership is tested
exactly against all means, as the definition of a cluster asks: every vector is compared with every mean once and keeps the means it may come near; a mean
that turns too far from the place of that comparison is compared again.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborloom.session import BROADCAST_ROWS, dropped, named, removed, ship_code, small_side, written

#: Rounds: vectors near the densest one of a dense cell, and frames. The last kind of round is repeated until it shows nothing new.
ROUNDS = ((16, 1), (3, 8))
#: Largest coordinates that name a cell, and those that order the vectors of a cell.
COORDINATES, FINE = 2, 6
#: Vectors of the finest cells: those compared with each other.
CHUNK = 64
#: Rows of one cell that a task sends on; of more, neighbours in the order are averaged first.
LOCAL = 256
#: Cosine of neighbours in a cell: two members within 0.75 of a mean have 0.56 on average, of a million random directions of width 64 about
#: one has it with a given vector.
NEIGHBOUR = 0.55
#: Cosine with a component's mean in the first settling pass; of the means of adjacent cells; of means that are one cluster's.
NEAR, ADJACENT, ONE = 0.6, 0.8, 0.85
#: Turned frames in which means of dense cells are compared.
FRAMES = 6
#: Means that a task holds at once (16 MB); of more, passes go by blocks.
BLOCK = 65_536
#: Passes end where no mean moves; each raises the sum of the cosines beyond the bound, so only ties in rounding reach this number.
PASSES = 200
#: Cosine of means whose members may exclude each other.
OVERLAP = 0.5
#: Cosine from which on a vector lists a mean. A mean that has turned by less than the angle between this cosine and a bound is listed by all vectors within the bound.
LISTED = 0.5
#: Parts in which a written table is replaced, so that only one of them is there twice.
PARTS = 4

Batches = Iterator[pa.RecordBatch]


def _tiles(x: np.ndarray, y: np.ndarray, rows: int = 512, columns: int = 2048) -> Iterator[tuple[int, int, np.ndarray]]:
    """Products of the rows of x and y in pieces that stay in the cache: first row of each and the piece."""
    parts = [(b, np.ascontiguousarray(y[b : b + columns].T)) for b in range(0, len(y), columns)]
    for a in range(0, len(x), rows):
        for b, y_t in parts:
            yield a, b, x[a : a + rows] @ y_t


def near_pairs(x: np.ndarray, y: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of x and y whose product is the bound or more, by row of x, then of y."""
    rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b, c in _tiles(x, y):
        hit = (c >= bound).ravel()
        whole = len(hit) // 8 * 8
        at = (np.flatnonzero(hit[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()  # hits are few: eight are looked at in one
        at = np.concatenate([at[hit[at]], whole + np.flatnonzero(hit[whole:])])
        rows.append(a + at // c.shape[1])
        columns.append(b + at % c.shape[1])
    row, column = np.concatenate(rows), np.concatenate(columns)
    order = np.lexsort((column, row))
    return row[order], column[order]


def nearest_row(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the largest product with a row of y, and which (of equal ones the first)."""
    best, where = np.full(len(x), -2.0, np.float32), np.zeros(len(x), np.int64)
    for a, b, c in _tiles(x, y):
        top = c.max(axis=1)
        more = np.flatnonzero(top > best[a : a + len(c)])
        best[a + more], where[a + more] = top[more], b + c[more].argmax(axis=1)
    return best, where


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column of one width, or of a column of the bytes of such rows."""
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if not len(column):
        return np.empty((0, width), np.float32)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(-1, width)


def bytes_of(x: np.ndarray) -> pa.Array:
    """A column of the bytes of the rows of a matrix: cheaper to write, read and send than lists."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x, np.float32).tobytes())])


def _kind(units: DataFrame) -> str:
    return units.schema["vec"].dataType.simpleString()


def lists_of(x: np.ndarray) -> pa.ListArray:
    """A list column of the rows of a matrix."""
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)[: len(x) + 1], pa.array(np.ascontiguousarray(x).ravel()))


def unit_vectors(vectors: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """``(id, vec)`` scaled to norm 1, once per id, of vectors of the width with finite entries, not all zero; vec is the bytes of 32-bit floats.

    Only the vectors of repeated ids are shuffled.
    """

    def scale(batches: Batches) -> Batches:
        for batch in batches:
            x = matrix_of(batch.column("vec"), width).astype(np.float64)
            with np.errstate(all="ignore"):
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            ok = np.isfinite(x).all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(ok)), bytes_of(x[ok])], names=["id", "vec"])

    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast("array<float>").alias("vec"))
    repeated = small_side(written(rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id"), "repeated"))
    usable = rows.where(F.col("id").isNotNull() & (F.size("vec") == width) & ~F.exists("vec", lambda v: v.isNull()))
    once, again = (usable.join(repeated, "id", how).mapInArrow(scale, "id bigint, vec binary") for how in ("left_anti", "left_semi"))
    # Of different vectors of one id a usable one counts, the least.
    return once.unionByName(again.groupBy("id").agg(F.min("vec").alias("vec")))


def turned(frame: int, width: int, seed: int) -> np.ndarray:
    """The random rotation of a frame."""
    q, r = np.linalg.qr(np.random.default_rng([seed, frame]).normal(size=(width, width)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def cell_codes(x: np.ndarray, frame: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and order within the cell of directions: the largest coordinates with their signs, and the next ones by size."""
    y = x @ turned(frame, x.shape[1], seed)
    m = min(COORDINATES + FINE, x.shape[1])
    top = np.argpartition(-np.abs(y), m - 1, axis=1)[:, :m]
    top = np.take_along_axis(top, np.argsort(-np.abs(np.take_along_axis(y, top, 1)), axis=1, kind="stable"), 1)
    signed = (top * 2 + (np.take_along_axis(y, top, 1) < 0)).astype(np.int64)
    base = 2 * x.shape[1]
    cell = np.full(len(x), frame, np.int64)
    for c in np.sort(signed[:, :COORDINATES], axis=1).T:
        cell = cell * base + c
    fine = np.zeros(len(x), np.int64)
    for c in signed[:, COORDINATES:].T:
        fine = fine * base + c
    return cell, fine


def quantised(units: DataFrame, frames: range, width: int, seed: int) -> DataFrame:
    """``(cell, fine, n, q)``: each vector once a frame, its features as 8-bit numbers.

    Pre-aggregated: of a cell with more than LOCAL rows in a task, vectors next to each other in the order become one row of weight n.
    """

    def f(batches: Batches) -> Batches:
        held, size = [], 0

        def flush() -> Batches:
            x = np.concatenate(held)
            for frame in frames:
                cell, fine = cell_codes(x, frame, seed)
                order = np.lexsort((fine, cell))
                cell, fine, v = cell[order], fine[order], x[order]
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                count = np.diff(np.append(first, len(cell)))
                step = np.repeat(-(-count // LOCAL), count)
                head = np.flatnonzero((np.arange(len(cell)) - np.repeat(first, count)) % step == 0)
                n = np.diff(np.append(head, len(cell)))
                q = np.rint(np.add.reduceat(v, head) / n[:, None] * 127).astype(np.int8)
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(q), [None, pa.py_buffer(q.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell[head]), pa.array(fine[head]), pa.array(n), data], names=["cell", "fine", "n", "q"])

        for batch in batches:
            if batch.num_rows:
                held.append(matrix_of(batch.column("vec"), width))
                size += batch.num_rows
            if size >= 50_000:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return units.select("vec").mapInArrow(f, "cell bigint, fine bigint, n bigint, q binary")


def _peaks(x: np.ndarray, n: np.ndarray, need: int) -> list[tuple[int, np.ndarray]]:
    """``(weight, sum)`` of the densest vectors' neighbourhoods, the densest first, none counted twice."""
    near = x @ x.T >= NEIGHBOUR
    free, out = np.ones(len(x), bool), []
    while True:
        weight = (near & free) @ n * free
        at = int(weight.argmax())
        if weight[at] < need:
            return out
        taken = near[at] & free
        taken[at] = True
        out.append((int(weight[at]), (x[taken] * n[taken, None]).sum(axis=0)))
        free &= ~taken


def _one_way(peaks: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """Neighbourhoods of the finer parts of one cell, those that point one way summed."""
    n, s = np.array([p[0] for p in peaks]), np.array([p[1] for p in peaks])
    u = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-30)
    near, free, out = u @ u.T >= ADJACENT, np.ones(len(n), bool), []
    for i in np.argsort(-n, kind="stable"):
        if free[i]:
            taken = near[i] & free
            taken[i] = True
            out.append((int(n[taken].sum()), s[taken].sum(axis=0)))
            free &= ~taken
    return out


def dense_cells(cells: DataFrame, need: int, width: int) -> DataFrame:
    """``(node, n, vec)``: cells counted, and of those with ``need`` vectors the parts in which one has so many near it; vec is their sum."""
    whole = W.partitionBy("cell").orderBy("fine").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    counted = cells.withColumn("c", F.sum("n").over(whole)).where(F.col("c") >= need).drop("c")

    def dense(cell: np.ndarray, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        count = np.diff(np.append(first, len(cell)))
        inside = np.arange(len(cell)) - np.repeat(first, count)
        head = np.flatnonzero(inside % CHUNK == 0)
        size = np.diff(np.append(head, len(cell)))
        found: dict[int, list] = {}
        for k in np.unique(size):
            at = head[size == k]
            for a in range(0, len(at), max(1, 400_000 // int(k * k))):  # bounds the products held at once
                part = at[a : a + max(1, 400_000 // int(k * k))]
                rows = part[:, None] + np.arange(k)
                v = x[rows]
                weight = ((v @ v.transpose(0, 2, 1) >= NEIGHBOUR) * n[rows][:, None, :]).sum(axis=2)
                for i in np.flatnonzero((weight >= need).any(axis=1)):
                    found.setdefault(int(cell[part[i]]), []).extend(_peaks(v[i], n[rows[i]], need))
        out = [(c << 24 | i, *p) for c, peaks in found.items() for i, p in enumerate(_one_way(peaks))]
        sums = np.array([o[2] for o in out], np.float32).reshape(-1, width)
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), lists_of(sums)], names=["node", "n", "vec"])

    def f(batches: Batches) -> Batches:
        held: tuple[np.ndarray, ...] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.float32))
        for batch in batches:
            if not batch.num_rows:
                continue
            q = np.frombuffer(b"".join(batch.column("q").to_pylist()), np.int8).reshape(-1, width).astype(np.float32) / 127
            new = (batch.column("cell").to_numpy(), batch.column("n").to_numpy(), q)
            held = tuple(np.concatenate(p) for p in zip(held, new, strict=True))
            last = int(np.searchsorted(held[0], held[0][-1])) if held[0][0] != held[0][-1] else 0
            if last >= 100_000:  # whole cells; the last one may go on
                yield dense(*(p[:last] for p in held))
                held = tuple(p[last:] for p in held)
        if len(held[0]):
            yield dense(*held)

    return counted.select("cell", "n", "q").mapInArrow(f, "node bigint, n bigint, vec array<float>")


def adjacent(dense: DataFrame, width: int, seed: int) -> DataFrame:
    """``(a, b)``: dense cells whose means point into one cell of a turned frame and have the cosine ADJACENT; each with the least such node."""

    def keyed(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("vec"), width)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            for frame in range(FRAMES):
                cell, fine = cell_codes(x, frame + 1, seed + 1)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fine), batch.column("node"), lists_of(x)], names=["cell", "fine", "node", "vec"])

    def links(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            cell, node = t.column("cell").to_numpy(), t.column("node").to_numpy()
            x = matrix_of(t.column("vec").combine_chunks(), width)
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            count = np.diff(np.append(first, len(cell)))
            a, b = [], []
            for h, k in zip(first[count > 1], count[count > 1], strict=True):
                for lo in range(h, h + k, 1024):
                    hi = min(lo + 1024, h + k)
                    near = x[lo:hi] @ x[lo:hi].T >= ADJACENT
                    least = np.where(near, node[lo:hi], np.iinfo(np.int64).max).min(axis=1)
                    least = np.minimum(least, node[lo:hi])
                    a.append(node[lo:hi][least < node[lo:hi]])
                    b.append(least[least < node[lo:hi]])
            join = lambda p: pa.array(np.concatenate(p) if p else np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([join(a), join(b)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 200_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    schema = "cell bigint, fine bigint, node bigint, vec array<float>"
    rows = dense.select("node", "vec").mapInArrow(keyed, schema).repartition("cell").sortWithinPartitions("cell", "fine", "node")
    return rows.mapInArrow(links, "a bigint, b bigint")


def least_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, label)``: the least node that can be reached over ``edges(a, b)``, by propagation to convergence."""
    found = Observation()
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both.observe(found, F.count("*").alias("c")), "edges")
    labels, held, changed = nodes.select("node", F.col("node").alias("label")), None, found.get["c"]
    # A small graph goes to all tasks.
    side = F.broadcast if changed <= BROADCAST_ROWS and nodes.count() <= BROADCAST_ROWS else lambda d: d
    while changed:
        near = both.join(side(labels), both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(side(near), labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        # A jump to the label of one's label halves the way that is left.
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("further"))
        ends = step.join(side(jump), "new", "left").select("node", F.least("new", F.coalesce("further", "new")).alias("to"), "label")
        moves = Observation()
        moved = written(ends.observe(moves, F.coalesce(F.sum((F.col("to") < F.col("label")).cast("bigint")), F.lit(0)).alias("c")), "labels")
        labels, changed = moved.select("node", F.col("to").alias("label")), moves.get["c"]
        if held is not None:
            dropped(held)
        held = moved
    dropped(both)
    return labels if held is None else named(labels, held)


def _summed(parts: DataFrame, key: str, width: int, partial: bool = True) -> DataFrame:
    """Sums of ``parts(key, n, vec)`` by key: in each task first, unless ``parts`` are sums of tasks, then by key."""

    def f(batches: Batches) -> Batches:
        held: list[tuple] = []
        size = 0

        def merged() -> tuple:
            k, n, s = (np.concatenate(p) for p in zip(*held, strict=True))
            order = np.argsort(k, kind="stable")
            k, n, s = k[order], n[order], s[order]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            return k[head], np.add.reduceat(n, head), np.add.reduceat(s, head)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(key).to_numpy(), batch.column("n").to_numpy(), matrix_of(batch.column("vec"), width).astype(np.float64)))
                size += batch.num_rows
            if size > 100_000:
                held = [merged()]
                size = 0
        if held:
            k, n, s = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), lists_of(s)], names=[key, "n", "vec"])

    schema = f"{key} bigint, n bigint, vec array<double>"
    vec = F.col("vec") if _kind(parts) == "binary" else F.col("vec").cast("array<double>")
    cells = parts.select(F.col(key).cast("bigint").alias(key), F.col("n").cast("bigint").alias("n"), vec.alias("vec"))
    return (cells.mapInArrow(f, schema) if partial else cells).repartition(key).mapInArrow(f, schema)


class Means:
    """Mean directions ``(centre, n, vec)`` of clusters: one array of at most BLOCK of them, or a written table read by such blocks."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray, table: DataFrame | None = None, count: int | None = None):
        self.ids, self.n, self.x, self.table = ids, n, x, table
        self.count = len(ids) if count is None else count

    @staticmethod
    def of(sums: DataFrame, width: int, least: int, block: int = BLOCK) -> Means:
        """Directions of sums of at least ``least`` vectors that are not null."""
        kept = sums.where(F.col("n") >= least)
        rows = kept.limit(block + 1).toArrow()
        if rows.num_rows <= block:
            return Means._arrays(rows, width)
        table = written(kept, "means")
        return Means(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.float32), table, table.count())

    @staticmethod
    def _arrays(rows: pa.Table, width: int) -> Means:
        rows = rows.combine_chunks().sort_by("centre")
        s = matrix_of(rows.column("vec").combine_chunks(), width).astype(np.float64) if rows.num_rows else np.empty((0, width))
        size = np.linalg.norm(s, axis=1, keepdims=True)
        ok = size[:, 0] > 0
        return Means(rows.column("centre").to_numpy()[ok], rows.column("n").to_numpy()[ok], (s / np.maximum(size, 1e-300))[ok].astype(np.float32))

    def blocks(self, width: int, block: int = BLOCK) -> Iterator[Means]:
        if self.table is None:
            if len(self.ids):
                yield self
            return
        parts = -(-self.count // block) + 1
        for b in range(parts):
            part = Means._arrays(self.table.where(F.pmod(F.xxhash64("centre"), F.lit(parts)) == b).toArrow(), width)
            if len(part.ids):
                yield part

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.table is not None:
            return self.table
        return spark.createDataFrame(pa.table({"centre": self.ids, "n": self.n, "vec": lists_of(self.x.astype(np.float64))}))

    def without(self, gone: np.ndarray) -> Means:
        if self.table is None:
            keep = ~np.isin(self.ids, gone)
            return Means(self.ids[keep], self.n[keep], self.x[keep])
        left = written(self.table.where(~F.col("centre").isin(gone.tolist())), "means")
        return Means(self.ids, self.n, self.x, left, left.count())

    def plus(self, other: Means, width: int) -> Means:
        """Both, numbered anew; a single array where it is no larger than a block."""
        if self.table is None and other.table is None and len(self.ids) + len(other.ids) <= BLOCK:
            return Means(np.arange(len(self.ids) + len(other.ids)), np.concatenate([self.n, other.n]), np.concatenate([self.x, other.x]))
        spark = (self.table if self.table is not None else other.table).sparkSession if (self.table is not None or other.table is not None) else SparkSession.active()
        both = self.frame(spark).withColumn("centre", F.col("centre") * 2).unionByName(other.frame(spark).withColumn("centre", F.col("centre") * 2 + 1))
        return Means.of(both, width, 0)


def _larger(part: Means) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Which of (ids, n, directions) have a larger mean of ``part`` at cosine ONE or more; of equal numbers the least id is the larger."""

    def f(ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), bool)
        i, j = near_pairs(x, part.x, ONE)
        out[i[(part.n[j] > n[i]) | ((part.n[j] == n[i]) & (part.ids[j] < ids[i]))]] = True
        return out

    return f


def distinct_means(means: Means, width: int) -> Means:
    """Means without those near a larger one; what is lost of a real cluster by that is loose again and found by the next round."""
    if means.table is None:
        gone = _larger(means)(means.ids, means.n, means.x)
        return Means(means.ids[~gone], means.n[~gone], means.x[~gone])
    rows = means.table
    for part in means.blocks(width):
        near = _larger(part)

        def keep(batches: Batches, near=near) -> Batches:
            for batch in batches:
                x = matrix_of(batch.column("vec"), width)
                x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).astype(np.float32)
                yield batch.filter(pa.array(~near(batch.column("centre").to_numpy(), batch.column("n").to_numpy(), x)))

        rows = rows.mapInArrow(keep, "centre bigint, n bigint, vec array<double>")
    return Means.of(rows, width, 0)


def nearest(units: DataFrame, means: Means, width: int, bound: float, other: float | None = None, block: int = BLOCK) -> DataFrame:
    """``(id, vec, centre, cosine)`` of vectors within the cosine bound of a mean; with ``other``: whose cosine with every further mean is below it."""

    def narrow(part: Means):
        ids, x_t = part.ids, part.x.T.astype(np.float64)
        rows = max(16, (4 << 20) // max(1, len(ids)))

        def f(batches: Batches) -> Batches:
            for batch in batches:
                x = matrix_of(batch.column("vec"), width)
                best, second, where = np.full(len(x), -2.0), np.full(len(x), -2.0), np.zeros(len(x), np.int64)
                for a in range(0, len(x), rows):  # bounds the products held at once
                    c = x[a : a + rows].astype(np.float64) @ x_t
                    at = c.argmax(axis=1)
                    best[a : a + rows], where[a : a + rows] = c[np.arange(len(c)), at], at
                    if other is not None and c.shape[1] > 1:
                        c[np.arange(len(c)), at] = -2.0
                        second[a : a + rows] = c.max(axis=1)
                made = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(ids[where]), pa.array(best), pa.array(second)], names=["id", "vec", "centre", "cosine", "second"])
                yield made.filter(pa.array(best >= min(bound, other or bound)))

        return units.mapInArrow(f, f"id bigint, vec {_kind(units)}, centre bigint, cosine double, second double")

    parts = [narrow(p) for p in means.blocks(width, block)]
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        best = F.max(F.struct("cosine", "centre", "second", "vec")).alias("b")
        rank = F.sort_array(F.collect_list("cosine"), asc=False).alias("all")  # one entry a block of means
        found = found.groupBy("id").agg(best, rank).select(
            "id", "b.vec", "b.centre", "b.cosine", F.greatest("b.second", F.coalesce(F.try_element_at("all", F.lit(2)), F.lit(-2.0))).alias("second")
        )
    found = found.where(F.col("cosine") >= bound)
    return (found if other is None else found.where(F.col("second") < other)).drop("second")


def outside(units: DataFrame, means: Means, width: int, bound: float) -> DataFrame:
    """The vectors within the cosine bound of no mean; a narrow pass for each block of means."""
    for part in means.blocks(width):

        def f(batches: Batches, y=part.x) -> Batches:
            for batch in batches:
                yield batch.filter(pa.array(nearest_row(matrix_of(batch.column("vec"), width), y)[0] < bound))

        units = units.mapInArrow(f, f"id bigint, vec {_kind(units)}")
    return units


def _still(a: Means, b: Means) -> bool:
    """Whether two steps of means are the same."""
    if a.table is None and b.table is None:
        return np.array_equal(a.ids, b.ids) and bool(np.abs(a.x - b.x).max(initial=0) < 1e-6)
    if a.count != b.count or a.table is None or b.table is None:
        return False
    unit = lambda t, name: t.select("centre", F.transform("vec", lambda v: v / F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, w: s + w * w))).alias(name))
    both = unit(a.table, "x").join(unit(b.table, "y"), "centre", "full")
    same = F.forall(F.zip_with("x", "y", lambda x, y: F.abs(x - y)), lambda d: d < 1e-6)
    return not both.where(~F.coalesce(same, F.lit(False))).limit(1).count()


def _add(n: np.ndarray, s: np.ndarray, which: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
    """Number and sum of the rows of x added to those of ``which``."""
    order = np.argsort(which, kind="stable")
    if len(order):
        at, first, count = np.unique(which[order], return_index=True, return_counts=True)
        n[at] += sign * count
        s[at] += sign * np.add.reduceat(x[order].astype(np.float64), first)


def member_sums(units: DataFrame, means: Means, width: int, bound: float) -> DataFrame:
    """``(centre, n, vec)``: number and sum of the vectors nearest each mean within the bound; of one block summed in the pass that compares them."""
    if means.table is not None:
        return _summed(nearest(units, means, width, bound).select("centre", F.lit(1).alias("n"), "vec"), "centre", width)
    ids, y = means.ids, means.x

    def f(batches: Batches) -> Batches:
        n, s = np.zeros(len(ids), np.int64), np.zeros((len(ids), width))
        for batch in batches:
            x = matrix_of(batch.column("vec"), width)
            best, at = nearest_row(x, y)
            hit = np.flatnonzero(best >= bound)
            _add(n, s, at[hit], x[hit])
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(n[at]), lists_of(s[at])], names=["centre", "n", "vec"])

    return _summed(units.select("vec").mapInArrow(f, "centre bigint, n bigint, vec array<double>"), "centre", width, partial=False)


class Lists:
    """Vectors with the numbers of the means they may be near, ``table(id, vec, near)``; near is the bytes of 32-bit numbers.

    ``places`` holds by number where each mean was when all vectors were last compared with it: those at cosine LISTED list it. So a mean at less than
    the angle between LISTED and a bound from its place is listed by all vectors within the bound (angles of directions satisfy the triangle
    inequality), and passes look at listed means only, with the results of passes over all of them. Without places (means of more than
    one block) passes go over all means.
    """

    def __init__(self, table: DataFrame, places: np.ndarray | None, width: int):
        self.table, self.places, self.width = table, places, width
        self.compared = 0 if places is None else len(places)
        self.last: tuple[Means, float] | None = None  # the step that the sums are of
        self.n, self.s = np.zeros(self.compared, np.int64), np.zeros((self.compared, width))

    @staticmethod
    def of(units: DataFrame, means: Means, width: int) -> Lists:
        """All vectors compared with all means, whose ids are their numbers."""
        if means.table is not None:
            return Lists(written(units, "units"), None, width)
        return Lists(written(Lists._listed(units, means.ids, means.x, width), "listed"), means.x.copy(), width)

    @staticmethod
    def _listed(units: DataFrame, numbers: np.ndarray, y: np.ndarray, width: int) -> DataFrame:
        more = "near" in units.columns
        numbers = numbers.astype(np.int32)

        def f(batches: Batches) -> Batches:
            for batch in batches:
                x = matrix_of(batch.column("vec"), width)
                row, at = near_pairs(x, y, LISTED)
                number = numbers[at]
                if more:
                    listed, before = _pairs(batch.column("near"))
                    both = np.unique(np.concatenate([listed, row]) << 32 | np.concatenate([before, number]).astype(np.int64))
                    row, number = both >> 32, (both & 0xFFFFFFFF).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)) * 4)]).astype(np.int32)
                near = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(number.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), near], names=["id", "vec", "near"])

        return units.mapInArrow(f, f"id bigint, vec {_kind(units)}, near binary")

    def vectors(self) -> DataFrame:
        return self.table.select("id", "vec")

    def joined(self, means: Means, late: list[Means]) -> Means:
        """The means and those found late, listed; without places numbered anew."""
        if self.places is not None and all(m.table is None for m in (means, *late)) and len(self.places) + sum(m.count for m in late) <= BLOCK:
            late = [Means(*(np.concatenate(p) for p in zip(*((m.ids, m.n, m.x) for m in late), strict=True)))]  # one comparison for all of them
        else:
            self.places = None
        for new in late:
            if self.places is not None:
                new = self.number(new)
                means = Means(np.concatenate([means.ids, new.ids]), np.concatenate([means.n, new.n]), np.concatenate([means.x, new.x]))
            else:
                means = means.plus(new, self.width)
        return means

    def loose(self, means: Means, bound: float) -> DataFrame:
        """``(id, vec)`` of the vectors within the bound of no mean, written."""
        return written(outside(self.vectors(), means, self.width, bound) if self.places is None else self.outside(means, bound), "loose")

    def number(self, means: Means) -> Means:
        """New means with the numbers that follow, listed."""
        numbers = len(self.places) + np.arange(len(means.ids))
        self._compare(numbers, means.x)
        return Means(numbers, means.n, means.x)

    def _compare(self, numbers: np.ndarray, x: np.ndarray) -> None:
        """All vectors compared with means at ``x``; the table is replaced part by part."""
        top = int(numbers.max()) + 1
        fresh = top - len(self.places)
        if fresh > 0:
            self.places = np.concatenate([self.places, np.zeros((fresh, self.width), np.float32)])
            self.n, self.s = np.concatenate([self.n, np.zeros(fresh, np.int64)]), np.concatenate([self.s, np.zeros((fresh, self.width))])
        self.places[numbers] = x
        self.compared += len(numbers)
        spark, old, files = self.table.sparkSession, self.table, sorted(self.table.inputFiles())
        size, new = -(-len(files) // PARTS), None
        for a in range(0, len(files), size or 1):
            part = spark.read.schema(old.schema).parquet(*files[a : a + size])
            new = written(Lists._listed(part, numbers, x, self.width), "listed", new)
            removed(spark, files[a : a + size])
        if new is not None:
            self.table = new
            dropped(old)

    def reach(self, means: Means, bound: float) -> None:
        """Means that have turned too far from their places are compared again; former entries stay."""
        cosine = np.einsum("ij,ij->i", means.x.astype(np.float64), self.places[means.ids].astype(np.float64))
        far = np.arccos(np.clip(cosine, -1, 1)) > np.arccos(LISTED) - np.arccos(bound) - 1e-3
        if far.any():
            self._compare(means.ids[far], means.x[far])

    def _place(self, means: Means) -> np.ndarray:
        place = np.full(len(self.places), -1, np.int64)
        place[means.ids] = np.arange(len(means.ids))
        return place

    def step(self, means: Means, bound: float, least: int) -> Means:
        """The means of the vectors nearest each mean within the bound, those of ``least`` or more; only changes since the last step are summed."""
        self.reach(means, bound)
        width, count = self.width, len(self.places)
        steps = [(self._place(m), m.ids, m.x, b, sign) for m, b, sign in (*(((*self.last, -1),) if self.last else ()), (means, bound, 1))]

        def f(batches: Batches) -> Batches:
            n, s, t = np.zeros(count, np.int64), np.zeros((count, width)), np.zeros(count, bool)
            for batch in batches:
                x = matrix_of(batch.column("vec"), width)
                row, number = _pairs(batch.column("near"))
                homes = []
                for place, ids, y, b, _ in steps:
                    best, at, _ = _best_listed(x, row, number, place, y)
                    homes.append(np.where(best >= b, ids[at] if len(ids) else -1, -1))
                for home, (*_, sign) in zip(homes, steps, strict=True):
                    hit = np.flatnonzero((home >= 0) & ((home != homes[0]) | (home != homes[-1]) | (len(homes) == 1)))
                    _add(n, s, home[hit], x[hit], sign)
                    t[home[hit]] = True
            at = np.flatnonzero(t)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), lists_of(s[at])], names=["centre", "n", "vec"])

        # A task sends on a sum for each mean, so tasks are few.
        tasks = self.table.select("vec", "near").coalesce(4 * self.table.sparkSession.sparkContext.defaultParallelism)
        got = _summed(tasks.mapInArrow(f, "centre bigint, n bigint, vec array<double>"), "centre", width, partial=False).toArrow().combine_chunks()
        if got.num_rows:
            at = got.column("centre").to_numpy()
            self.n[at] += got.column("n").to_numpy()
            self.s[at] += matrix_of(got.column("vec").combine_chunks(), width)
        self.last = (means, bound)
        size = np.linalg.norm(self.s, axis=1)
        at = np.flatnonzero((self.n >= least) & (size > 0))
        return Means(at, self.n[at].copy(), (self.s[at] / size[at, None]).astype(np.float32))

    def outside(self, means: Means, bound: float) -> DataFrame:
        """``(id, vec)`` of the vectors within the bound of no mean."""
        self.reach(means, bound)
        place, y, width = self._place(means), means.x, self.width

        def f(batches: Batches) -> Batches:
            for batch in batches:
                best, _, _ = _best_listed(matrix_of(batch.column("vec"), width), *_pairs(batch.column("near")), place, y)
                yield batch.select(["id", "vec"]).filter(pa.array(best < bound))

        return self.table.mapInArrow(f, f"id bigint, vec {_kind(self.table)}")

    def nearest(self, means: Means, bound: float, other: float, seed: int) -> DataFrame:
        """``(id, centre, cosine, cell)`` of the vectors within the bound of a mean whose cosine with every further mean is below ``other``."""
        self.reach(means, min(bound, other))
        place, ids, y, width = self._place(means), means.ids, means.x, self.width

        def f(batches: Batches) -> Batches:
            for batch in batches:
                x = matrix_of(batch.column("vec"), width)
                best, at, second = _best_listed(x, *_pairs(batch.column("near")), place, y)
                hit = np.flatnonzero((best >= bound) & (second < other))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(hit)), pa.array(ids[at[hit]]), pa.array(best[hit]), pa.array(cell_codes(x[hit], 1, seed)[0])], names=["id", "centre", "cosine", "cell"]
                )

        return self.table.mapInArrow(f, "id bigint, centre bigint, cosine double, cell bigint")


def _pairs(near: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of a column of listed numbers."""
    if not len(near):
        return np.empty(0, np.int64), np.empty(0, np.int32)
    ends = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(near) + 1]
    data = np.frombuffer(near.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return np.repeat(np.arange(len(near)), np.diff(ends) // 4), data.copy().view(np.int32)


def _best_listed(x: np.ndarray, row: np.ndarray, number: np.ndarray, place: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x the largest product with a listed row of y, which (of equal ones the first), and the second largest; -2 without."""
    best, where, second = np.full(len(x), -2.0), np.zeros(len(x), np.int64), np.full(len(x), -2.0)
    kept = place[number] >= 0
    row, at = row[kept], place[number[kept]]
    if len(row):
        c = np.empty(len(row))
        for a in range(0, len(row), 16_384):  # bounds the copies held at once
            s = slice(a, a + 16_384)
            c[s] = np.einsum("ij,ij->i", x[row[s]].astype(np.float64), y[at[s]].astype(np.float64))
        order = np.lexsort((at, -c, row))
        row, at, c = row[order], at[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        best[row[first]], where[row[first]] = c[first], at[first]
        next_ = first + 1
        next_ = next_[(next_ < len(row))]
        next_ = next_[row[next_] == row[next_ - 1]]
        second[row[next_]] = c[next_]
    return best, where, second


def settled(units: DataFrame | Lists, means: Means, width: int, bound: float, within: float, least: int) -> Means:
    """Means moved to those of their members by exact passes, the first with ``bound``, and those with ``least`` members."""
    need, previous = max(1, least // 2), None
    lists = units if isinstance(units, Lists) else None
    for _ in range(PASSES):
        if not means.count:
            break
        if lists is not None and lists.places is not None:
            means = lists.step(means, bound, need)
        else:
            means = Means.of(member_sums(units if lists is None else lists.vectors(), means, width, bound), width, need)
        means = distinct_means(means, width)
        if bound == within and previous is not None and _still(previous, means):
            break
        previous, bound, need = means, within, least
    else:
        warnings.warn(f"means still move after {PASSES} passes", stacklevel=2)
    return means


def assigned(units: DataFrame | Lists, means: Means, width: int, within: float, apart: float, least: int, seed: int = 11) -> tuple[DataFrame | None, Means]:
    """``(id, centre, cosine, cell)`` of the members, and the means that have ``least`` or more; no table if none has.

    A mean with fewer is dropped and excludes no vector, so the rest is assigned again until none is dropped. Of
    means that may exclude each other's members the one with the fewest goes first.
    """
    while means.count:
        if isinstance(units, Lists) and units.places is not None:
            near = units.nearest(means, within, apart, seed)
        else:
            cell = F.arrow_udf(lambda column: pa.array(cell_codes(matrix_of(column, width), 1, seed)[0]), "bigint")
            near = nearest(units.vectors() if isinstance(units, Lists) else units, means, width, within, apart).select("id", "centre", "cosine", cell("vec").alias("cell"))
        members = written(near, "members")
        counts = members.groupBy("centre").agg(F.count("*").alias("c"))
        few = means.frame(members.sparkSession).join(counts, "centre", "left").where(F.coalesce("c", F.lit(0)) < least).select("centre", F.coalesce("c", F.lit(0)).alias("n"), "vec")
        weak = Means.of(few.orderBy("n", "centre").limit(BLOCK), width, 0)  # at most a block of them is dropped at once
        if not weak.count:
            return members, means
        dropped(members)
        order = np.argsort(weak.n, kind="stable")[:8192]  # the weakest first; the others follow in later passes
        x = weak.x[order]
        # Of means that overlap the weakest goes; a mean goes if no weaker one overlaps with it.
        means = means.without(weak.ids[order][~np.tril(x @ x.T >= OVERLAP, -1).any(axis=1)])
    return None, means


def too_small(loose: DataFrame, starts: Means, width: int, within: float, least: int) -> DataFrame:
    """``(id)`` of the vectors within the bound of a start that has fewer than ``least`` vectors at cosine NEIGHBOUR or more, written.

    Members of one cluster are about as near to each other, so what surrounds such a start is a group of too few.
    """
    pairs = loose.sparkSession.createDataFrame([], "centre bigint, id bigint, inside boolean")
    for part in starts.blocks(width):

        def f(batches: Batches, ids=part.ids, y=part.x) -> Batches:
            for batch in batches:
                x = matrix_of(batch.column("vec"), width)
                row, at = near_pairs(x, y, NEIGHBOUR)
                inside = np.concatenate([np.empty(0, bool), *(np.einsum("ij,ij->i", x[row[a : a + 16_384]], y[at[a : a + 16_384]]) >= within for a in range(0, len(row), 16_384))])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), batch.column("id").take(pa.array(row)), pa.array(inside)], names=["centre", "id", "inside"])

        pairs = pairs.unionByName(loose.mapInArrow(f, "centre bigint, id bigint, inside boolean"))
    pairs = written(pairs, "pairs")
    few = pairs.groupBy("centre").agg(F.count("*").alias("c")).where(F.col("c") < least)
    found = written(pairs.where("inside").join(few, "centre", "left_semi").select("id").distinct(), "few")
    dropped(pairs)
    return found


def _replaced(table: DataFrame, by: DataFrame) -> DataFrame:
    """``by`` written, and the table it was made of removed."""
    new = written(by, "loose")
    dropped(table)
    return new


def clusters(
    vectors: DataFrame, key: str = "id", vec: str = "vec", width: int = 64, least: int = 10, within: float = 0.75, apart: float = 0.7, seed: int = 11,
    rounds: tuple[tuple[int, int], ...] = ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """``(members, means)``: ``members(id, cluster_id, cosine, cell)`` and ``means(cluster_id, mean)``, the final mean directions.

    cluster_id is the least id of the cluster. A member's cosine with its cluster's mean direction is ``within`` or more and
    with every other's below ``apart``; clusters have ``least`` ids or more. Defined results: null ids, null vectors, null,
    NaN or infinite entries, other widths and all zeros are left out; an id counts once; equal vectors share their
    fate; an empty table has no clusters; further columns are ignored.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    units = unit_vectors(vectors, key, vec, width)
    means = Means(np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.float32))
    whole, loose, late, few, frame, level = None, units, [], [], 1, 0
    while True:
        need, frames = rounds[level]
        dense = written(dense_cells(quantised(loose, range(frame, frame + frames), width, seed), need, width), "dense")
        labels = least_labels(dense, adjacent(dense, width, seed))
        parts = dense.join(labels, "node").select(F.col("label").alias("centre"), "n", "vec")
        starts = distinct_means(Means.of(_summed(parts, "centre", width), width, need), width)
        frame += frames
        dropped(dense)
        dropped(labels)
        if whole is None:
            if starts.table is None:
                starts = Means(np.arange(len(starts.ids)), starts.n, starts.x)
            whole = Lists.of(units, starts, width)
            means = settled(whole, starts, width, NEAR, within, least)
            loose = whole.loose(means, within)
        else:
            found = settled(loose, starts, width, NEAR, within, least)
            if found.count:  # these rounds go on over the vectors that are left; the means found join the others after the last
                late.append(found)
                loose = _replaced(loose, outside(loose, found, width, within))
                # Dense cells of too few vectors leave as well, else each round would settle all of them again.
                few.append(too_small(loose, starts, width, within, least))
                loose = _replaced(loose, loose.join(small_side(few[-1]), "id", "left_anti"))
            elif late:
                before, tried = means.count, loose
                means = settled(whole, whole.joined(means, late), width, within, within, least)
                loose, late = whole.loose(means, within), []
                for gone in few:
                    loose = _replaced(loose, loose.join(small_side(gone), "id", "left_anti"))
                # The number of means rises from time to time, so the rounds end; without a vector that the last round had not, it holds for these as well.
                freed = loose.select("id").join(tried.select("id"), "id", "left_anti").limit(1).count()
                dropped(tried)
                if not freed or means.count <= before:
                    break
            else:
                break
        level = min(level + 1, len(rounds) - 1)
    members, means = assigned(whole, means, width, within, apart, least, seed)
    for table in (whole.table, loose, *few):
        dropped(table)
    if members is None:
        return spark.createDataFrame([], "id bigint, cluster_id bigint, cosine double, cell bigint"), spark.createDataFrame([], "cluster_id bigint, mean array<float>")
    names = small_side(members.groupBy("centre").agg(F.min("id").alias("cluster_id")))
    return members.join(names, "centre").select("id", "cluster_id", "cosine", "cell"), means.frame(spark).join(names, "centre").select("cluster_id", F.col("vec").alias("mean"))


def described(members: DataFrame, words: DataFrame, typical: int = 5) -> DataFrame:
    """``(cluster_id, size, mean_cosine, typical)``: size and most typical words, from the cluster's densest cell."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.round(F.avg("cosine"), 6).alias("mean_cosine"))
    cells = members.groupBy("cluster_id", "cell").agg(F.count("*").alias("c"))
    densest = cells.groupBy("cluster_id").agg(F.max(F.struct("c", "cell")).alias("d")).select("cluster_id", "d.cell")
    # The most typical of a cell by partial aggregation: a bounded list for each cluster.
    inside = members.join(small_side(densest), ["cluster_id", "cell"])
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("cosine"), "id"))
    top = inside.withColumn("rank", rank).where(F.col("rank") <= typical)
    text = words.where("id is not null").groupBy("id").agg(F.min("word").alias("word"))
    named = top.join(text, "id", "left").groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "word"))).alias("t"))
    return size.join(named, "cluster_id", "left").select(
        "cluster_id", "size", "mean_cosine", F.transform("t", lambda x: F.coalesce(x["word"], x["id"].cast("string"))).alias("typical")
    )
