"""Sequence inference over sparse chains: forward filter, backward sampling, Viterbi, beam Viterbi (Q01-Q09 of the blueprint).

A ``Chain`` is a bounded parameter object, captured by the Arrow kernel as a broadcast variable; sentences stay where they are. Random draws
are keyed by (seed, iteration, sentence), so results do not depend on partitioning.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborloom.functions.scalars import uniforms
from arborloom.operators.grammar import Components
from arborloom.operators.states import Rows, end_index, tag_given_state
from arborloom.session import ship_code

#: Filter entries (sentences x length x states) or transitions (sentences x transitions) of a block of sentences taken side by side.
BLOCK_CELLS = 4_000_000


class Chain:
    """A hidden Markov chain with sparse transitions.

    start: probability of the first state; prev, nxt, p: transitions; end: probability of ending after a state; emission[o]: probability of
    observation o by emission class; kind: emission class of each state; name: what a state is called in results.
    late: rows of emission of the observations from len(emission) on, where a batch brings its own.
    """

    late: np.ndarray | None = None

    def __init__(self, start, prev, nxt, p, end, emission, kind, name=None):
        self.start, self.end = np.asarray(start, float), np.asarray(end, float)
        order = np.argsort(nxt, kind="stable")
        self.prev, self.nxt, self.p = np.asarray(prev)[order], np.asarray(nxt)[order], np.asarray(p, float)[order]
        self.head = np.flatnonzero(np.concatenate([[True], self.nxt[1:] != self.nxt[:-1]])) if len(self.nxt) else np.empty(0, int)
        self.into = self.nxt[self.head]
        self.emission, self.kind = np.asarray(emission, float), np.asarray(kind)
        self.name = np.arange(len(self.start)) if name is None else np.asarray(name)
        #: Log transitions as a matrix where there are few states.
        self.dense = None
        if len(self.start) <= 64:
            with np.errstate(divide="ignore"):
                self.dense = np.full((len(self.start),) * 2, -np.inf)
                self.dense[self.prev, self.nxt] = np.log10(self.p)
            self.matrix = np.zeros((len(self.start),) * 2)
            self.matrix[self.prev, self.nxt] = self.p

    def emit(self, o: np.ndarray) -> np.ndarray:
        """Emission of a column of observations by state; an observation that the chain does not know has none."""
        known = (o >= 0) & (o < len(self.emission))
        out = self.emission[np.where(known, o, 0)][:, self.kind] * known[:, None]
        if self.late is not None:
            at = np.flatnonzero(o >= len(self.emission))
            out[at] = self.late[o[at] - len(self.emission)][:, self.kind]
        return out

    def step(self, alpha: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return alpha @ self.matrix
        out = np.zeros((len(alpha), len(self.start)))
        if len(self.head):
            out[:, self.into] = np.add.reduceat(alpha[:, self.prev] * self.p, self.head, axis=1)
        return out

    def forward_block(self, obs: np.ndarray, prune: float = 0.0, length: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Q03, Q06: over sentences side by side, the longest first (rows of ``obs``, used up to ``length``): filters after each observation of the
        sentences that go on, log10 of the probability with the end, and where each sentence loses all mass (-1: nowhere; its length: at the end).

        Q07: with ``prune`` states under the largest over ``prune`` are dropped after each observation.
        """
        length = np.full(len(obs), obs.shape[1]) if length is None else length
        alphas, log, dead = [], np.zeros(len(obs)), np.full(len(obs), -1)
        for t in range(obs.shape[1]):
            n = int(np.searchsorted(-length, -t))  # sentences longer than t
            alpha = (self.start if t == 0 else self.step(alphas[-1][:n])) * self.emit(obs[:n, t])
            total = alpha.sum(axis=1)
            dead[:n][(dead[:n] < 0) & ~(total > 0)] = t
            if prune:
                alpha = np.where(alpha >= alpha.max(axis=1, keepdims=True) / prune, alpha, 0.0)
                total = alpha.sum(axis=1)
            safe = np.where(total > 0, total, 1.0)
            alphas.append(alpha / safe[:, None])
            log[:n] += np.log10(safe)
            ends = np.flatnonzero(length[:n] == t + 1)
            last = alphas[-1][ends] @ self.end
            dead[ends[(dead[ends] < 0) & ~(last > 0)]] = t + 1
            log[ends] += np.log10(np.where(last > 0, last, 1.0))
        return alphas, log, dead

    def sample_block(self, obs: np.ndarray, draw: Callable[[int], np.ndarray], length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Q04, Q05: states drawn backwards from the posterior; ``draw(t)`` gives a number in (0, 1) for each sentence."""
        length = np.full(len(obs), obs.shape[1]) if length is None else length
        alphas, log, dead = self.forward_block(obs, length=length)
        path = np.zeros(obs.shape, np.int64)
        weight = np.empty((0, len(self.end)))
        for t in range(obs.shape[1] - 1, -1, -1):
            n = len(alphas[t])
            weight = np.concatenate([weight, np.broadcast_to(self.end, (n - len(weight), len(self.end)))])
            mass = np.cumsum(alphas[t] * weight, axis=1)
            s = np.minimum((mass <= draw(t)[:n, None] * mass[:, -1:]).sum(axis=1), mass.shape[1] - 1)
            path[:n, t] = s
            if self.dense is not None:
                weight = self.matrix[:, s].T
            else:
                lo, hi = np.searchsorted(self.nxt, s), np.searchsorted(self.nxt, s, side="right")
                k = hi - lo
                at = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())
                weight = np.zeros((n, len(self.start)))
                weight[np.repeat(np.arange(n), k), self.prev[at]] = self.p[at]
        return path, log, dead

    def viterbi_block(self, obs: np.ndarray, first_beam: int = 0, beam: int = 0, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Q08; with beams (T07, Q09) only so many best states go on after the first and the later observations. Ties: the lowest state."""
        length = np.full(len(obs), obs.shape[1]) if length is None else length
        back: list[np.ndarray] = []
        size = len(self.start)
        score, best, last = np.empty((0, size)), np.full(len(obs), -np.inf), np.zeros(len(obs), np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            p, end = np.log10(self.p), np.log10(self.end)
            for t in range(obs.shape[1]):
                n = int(np.searchsorted(-length, -t))
                e = np.log10(self.emit(obs[:n, t]))
                score = score[:n]
                if t == 0:
                    score = np.log10(self.start) + e
                elif self.dense is not None:
                    w = score[:, :, None] + self.dense
                    link = w.argmax(axis=1)
                    back.append(link)
                    score = np.take_along_axis(w, link[:, None, :], 1)[:, 0] + e
                else:
                    into, link = np.full((n, size), -np.inf), np.zeros((n, size), np.int64)
                    if len(self.head):
                        w = score[:, self.prev] + p
                        top = np.maximum.reduceat(w, self.head, axis=1)
                        same = w == np.repeat(top, np.diff(np.append(self.head, w.shape[1])), axis=1)
                        into[:, self.into] = top
                        link[:, self.into] = np.minimum.reduceat(np.where(same, self.prev, size - 1), self.head, axis=1)
                    back.append(link)
                    score = into + e
                limit = first_beam if t == 0 else beam
                if limit and limit < size:
                    floor = np.partition(score, size - limit, axis=1)[:, size - limit, None]
                    score = np.where(score >= floor, score, -np.inf)
                ends = np.flatnonzero(length[:n] == t + 1)
                final = score[ends] + end
                best[ends], last[ends] = final.max(axis=1, initial=-np.inf), final.argmax(axis=1) if len(ends) else 0
        path = np.zeros(obs.shape, np.int64)
        for t in range(obs.shape[1] - 1, -1, -1):
            n = int(np.searchsorted(-length, -t))
            go_on = int(np.searchsorted(-length, -(t + 1)))
            path[go_on:n, t] = last[go_on:n]
            if go_on:
                path[:go_on, t] = back[t][np.arange(go_on), path[:go_on, t + 1]]
        return path, best, np.where(best > -np.inf, -1, length)

    def _one(self, obs: list[int]) -> np.ndarray:
        return np.array(obs, np.int64).reshape(1, -1)

    def forward(self, obs: list[int], prune: float = 0.0) -> tuple[list[np.ndarray], float]:
        """Q03 for one sentence; no mass raises ValueError."""
        if not obs:
            return [], 0.0
        alphas, log, dead = self.forward_block(self._one(obs), prune)
        if dead[0] >= 0:
            raise ValueError(reason(int(dead[0]), len(obs)))
        return [a[0] for a in alphas], float(log[0])

    def sample(self, obs: list[int], rng: np.random.Generator) -> tuple[list[int], float]:
        """Q04, Q05 for one sentence."""
        path, log, dead = self.sample_block(self._one(obs), lambda t: rng.random(1))
        if dead[0] >= 0:
            raise ValueError(reason(int(dead[0]), len(obs)))
        return path[0].tolist(), float(log[0])

    def viterbi(self, obs: list[int], first_beam: int = 0, beam: int = 0) -> tuple[list[int], float]:
        """Q08, Q09 for one sentence."""
        path, log, dead = self.viterbi_block(self._one(obs), first_beam, beam) if obs else ([], [0.0], [0])
        if dead[0] >= 0:
            raise ValueError("no path")
        return path[0].tolist(), float(log[0])


def reason(at: int, length: int) -> str:
    """Why a sentence has no parse."""
    return "the end has no mass" if at >= length else f"observation {at} has no mass"


def chain_of(c: Components, lex: np.ndarray, prev: np.ndarray, nxt: np.ndarray, p: np.ndarray) -> Chain:
    """The chain of a depth-bounded model from its transition table (without g) and lex[word, category].

    States are pairs of a factored state and a tag with p(tag | state) > 0 (M15, M16); Q01: a word's emission is that of the tag.
    """
    rows = Rows(c)
    size, depth = rows.size, rows.depth
    end = end_index(size, depth)
    ends = nxt == end
    v = np.unique(nxt[~ends])
    g = tag_given_state(c, v)
    at, tag = np.nonzero(g > 0)
    full = v[at] * size + tag
    order = np.argsort(full)
    full, at, tag = full[order], at[order], tag[order]
    place = {int(x): i for i, x in enumerate(full)}
    by_v = np.searchsorted(v[at], v), np.searchsorted(v[at], v, side="right")
    keep = np.array([int(x) in place for x in prev]) & ~ends
    src = np.array([place[int(x)] for x in prev[keep]], int)
    dst_v = np.searchsorted(v, nxt[keep])
    count = by_v[1][dst_v] - by_v[0][dst_v]
    to = np.repeat(by_v[0][dst_v] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    weight = np.repeat(p[keep], count) * g[at[to], tag[to]]
    stop = np.zeros(len(full))
    for x, q in zip(prev[ends], p[ends], strict=True):
        if int(x) in place:
            stop[place[int(x)]] += q
    first = nxt[prev == 0]
    start = np.where(np.isin(v[at], first), g[at, tag], 0)
    return Chain(start, np.repeat(src, count), to, weight, stop, lex, tag, full)


def gaussian_lexicon(vectors: dict[int, np.ndarray], mean: np.ndarray, sd: np.ndarray, words: int) -> np.ndarray:
    """An emission table lex[word, category] from vectors by word and the diagonal normals of the categories, mean[category, dim] and sd likewise.

    Each word's densities are scaled to at most 1, which takes a constant from the log probability of a sentence and changes no path; words
    without a vector are alike under all categories.
    """
    out = np.ones((words + 1, len(mean)))
    for word, v in vectors.items():
        z = (np.asarray(v, float) - mean) / sd
        log = (-0.5 * z * z - np.log(sd)).sum(axis=1)
        out[word] = np.exp(log - log.max())
    return out


def inferred(sentences: DataFrame, chain: Chain, how: str, key: str = "sent_id", obs: str = "obs", seed: int = 0, iteration: int = 0, first_beam: int = 100, beam: int = 50, keep: bool = False, late: DataFrame | None = None) -> DataFrame:
    """``(key, log10p, path, last, success, error)`` by ``how``: forward, sample, viterbi or beam.

    A sentence without a parse has success false and the reason (K05); null and empty sentences have an empty path and probability 1. ``path``
    holds state names (null for forward), ``last`` the last filter (forward only). Q06: the sentences of a batch are taken through the chain side by side, the
    longest first, in blocks of BLOCK_CELLS filter entries; rows stay where they are. With ``keep`` the observations come along, as ``obs``.
    ``late(w, e)`` has the emissions by class of observations that the chain does not hold: only sentences with such are shuffled, to be joined with them.
    """
    ship_code(sentences.sparkSession)
    sent, joined = sentences.sparkSession.sparkContext.broadcast(chain), late is not None

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Chain = sent.value
        wide = len(c.start) ** 2 if c.dense is not None else len(c.prev)
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy()
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            if joined:
                c, flat = _with_late(sent.value, flat, first, batch.column(2))
            n = len(keys)
            log, ok, errors = np.zeros(n), np.ones(n, bool), [None] * n
            paths: list = [None if how == "forward" else [] for _ in range(n)]
            lasts: list = [None] * n
            order = np.argsort(-size, kind="stable")[: int((size > 0).sum())]  # the longest first
            a = 0
            while a < len(order):
                longest = int(size[order[a]])
                per = max(1, BLOCK_CELLS // max(longest * len(c.start), wide))
                at = order[a : a + per]
                a += per
                n_of = size[at]
                obs = np.full((len(at), longest), -1, np.int64)
                inside = np.arange(longest) < n_of[:, None]
                obs[inside] = flat[np.repeat(first[at] - (np.cumsum(n_of) - n_of), n_of) + np.arange(n_of.sum())]
                if how == "forward":
                    alphas, part, dead = c.forward_block(obs, length=n_of)
                    for i, k in enumerate(at):
                        lasts[k] = alphas[n_of[i] - 1][i]
                elif how == "sample":
                    base = uniforms(keys[at], seed * 1_000_003 + iteration).view(np.uint64)
                    path, part, dead = c.sample_block(obs, lambda t: uniforms(base, t), n_of)  # noqa: B023
                else:
                    path, part, dead = c.viterbi_block(obs, *((first_beam, beam) if how == "beam" else (0, 0)), length=n_of)
                log[at] = part
                if how != "forward":
                    named = c.name[path]
                    for i, k in enumerate(at):
                        paths[k] = named[i, : n_of[i]]
                for i in np.flatnonzero(dead >= 0):
                    k = at[i]
                    ok[k], errors[k], lasts[k] = False, "no path" if how in ("viterbi", "beam") else reason(int(dead[i]), int(n_of[i])), None
                    paths[k] = None if how == "forward" else []
            columns = [batch.column(0), pa.array(log, mask=~ok), pa.array(paths, pa.list_(pa.int64())), pa.array(lasts, pa.list_(pa.float64())), pa.array(ok), pa.array(errors, pa.string())]
            names = ["key", "log10p", "path", "last", "success", "error"]
            yield pa.RecordBatch.from_arrays([*columns, lists] if keep else columns, names=[*names, "obs"] if keep else names)

    schema = "key bigint, log10p double, path array<bigint>, last array<double>, success boolean, error string" + (", obs array<int>" if keep else "")
    rows = sentences.select(F.col(key).cast("bigint").alias("key"), F.col(obs).cast("array<int>").alias("obs"))
    if late is not None:
        rows = _joined_late(rows, len(chain.emission), late)
    return rows.mapInArrow(f, schema).withColumnRenamed("key", key)


def _joined_late(rows: DataFrame, edge: int, late: DataFrame) -> DataFrame:
    """``rows(key, obs)`` with ``late``: place and emissions of the observations from ``edge`` on; rows without such stay where they are."""
    kind = "array<struct<pos: int, e: array<double>>>"
    has = F.coalesce(F.exists("obs", lambda x: F.coalesce(x >= edge, F.lit(False))), F.lit(False))
    far = rows.where(has).withColumn("_k", F.coalesce("key", F.lit(0))).withColumn("_h", F.xxhash64("obs"))
    words = far.select("_k", "_h", F.posexplode("obs").alias("pos", "w")).where(F.col("w") >= edge).join(late, "w")
    # A set, since a row may be there twice.
    found = words.groupBy("_k", "_h").agg(F.collect_set(F.struct("pos", "e")).cast(kind).alias("late"))
    return rows.where(~has).withColumn("late", F.lit(None).cast(kind)).unionByName(far.join(found, ["_k", "_h"], "left").select("key", "obs", "late"))


def _with_late(chain: Chain, flat: np.ndarray, first: np.ndarray, column: pa.Array) -> tuple[Chain, np.ndarray]:
    """The chain with the emissions that a batch brings, and the observations numbered after its own; one without emissions is unknown (-1)."""
    edge = len(chain.emission)
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cells = column.flatten()
    out = copy.copy(chain)
    out.late = pc.struct_field(cells, "e").flatten().to_numpy(zero_copy_only=False).reshape(-1, chain.emission.shape[1])
    numbered = np.where(flat < edge, flat, -1).astype(np.int64)
    numbered[np.repeat(first, count) + pc.struct_field(cells, "pos").to_numpy(zero_copy_only=False).astype(np.int64)] = edge + np.arange(len(cells))
    return out, numbered
