"""Abusive, hateful or sexual passages: a factorization machine over hashed terms, learnt from judged documents.

Text is brought to one look (width, look-alike letters, unseen signs, accents), lower-cased, and spellings meant to
hide a word are undone: digits for letters, signs inside words, doubled letters, letters set apart. Passages are
sentences, whatever the layout. A passage's terms and pairs of neighbouring terms are hashed; its score is the
factorization machine's: a weight for each term plus the interactions of all pairs of terms, so that an insult
together with someone it is aimed at counts for more than both alone. A document's score is that of its worst passage, and
so it is learnt: readers judge documents, and the gradient goes to the passage that decides. All of it is numpy over
whole Arrow batches, with no call per row or word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborloom.llm import canonical
from arborloom.session import ship_code

BITS = 20
FACTORS = 4
#: Judged documents the model is fitted to at most, chosen by a hash of the id.
FIT_DOCUMENTS = 10_000
#: A term is used if so many of the documents fitted to have it, whatever their number.
LEAST_DOCUMENTS = 3
EPOCHS, WARM = 24, 6
#: Added to every score: the bounded loss and the smoothed targets hold scores low, held-out judgements are right from -0.5 on.
LIFT = 0.5
#: Pull of weights and factors to 0.
SHRINK = 2.0
#: Characters that one step of the kernel handles.
STEP = 4_000_000

#: Digits and signs written for letters; signs written inside words; ends of passages.
WRITTEN_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INSIDE = "._*-'’+~"
ENDS = ".!?\n…¡¿。！？"

#: By layout, what replaces markup so that the words of a passage stand in a row.
LAYOUTS = {
    "conll": ((r"(?m)^[0-9]+\t([^\t\n]*)\t[^\n]*$", r"\1"), (r"\r?\n(\r?\n)+", " … "), (r"\n", " ")),
    "tagwords": ((r"(?m)(^|[ \t])[A-Z]+/", r"\1"),),
    "linetrees": ((r"\([^\s()]+", " "), (r"\)", " ")),
    "ltf": ((r"</SEG>", "\n"), (r"<[^>]*>", " ")),
}


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about STEP bytes; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before, a = np.append(0, np.cumsum(sizes)), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(before, before[a] + STEP, side="right")) - 1)
        yield a, b
        a = b


def plain(texts: pa.Array, layouts: pa.Array) -> pa.Array:
    """Texts without the markup of their layout; null texts become empty."""
    out = pc.fill_null(texts, "")
    for layout, rules in LAYOUTS.items():
        mask = pc.fill_null(pc.equal(layouts, layout), False)
        part = out.filter(mask)
        if len(part):
            for pattern, by in rules:
                part = pc.replace_substring_regex(part, pattern, by)
            out = pc.replace_with_mask(out, mask, part)
    return out


@lru_cache(1)
def _classes() -> tuple[np.ndarray, ...]:
    """Lower case, letters, letters written otherwise, inside signs and ends, by code point."""
    n = 0x110000
    lower, letter, other = np.arange(n, dtype=np.int32), np.zeros(n, bool), np.arange(n, dtype=np.int32)
    inside, end = np.zeros(n, bool), np.zeros(n, bool)
    for cp in range(0x20000):
        c = chr(cp)
        if c.isalpha():
            letter[cp] = True
            if len(c.lower()) == 1:
                lower[cp] = ord(c.lower())
    letter[0x20000:0x32000] = True
    for a, b in WRITTEN_FOR.items():
        other[ord(a)] = ord(b)
    inside[[ord(c) for c in INSIDE]] = True
    end[[ord(c) for c in ENDS]] = True
    return lower, letter, other, inside, end


_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, np.uint64(0x100000001B3))]), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _beside(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The flag of the point before and of the point after."""
    before, after = np.zeros_like(flag), np.zeros_like(flag)
    before[1:], after[:-1] = flag[:-1], flag[1:]
    return before, after


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, passage, row)`` of each term of plain texts; passages are numbered through, in order."""
    texts = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    points, starts = canonical.code_points(texts)
    t = canonical.tables()
    # To the look tables a line end is a blank; here it ends a passage, and the one added ends each row (no sign inside words).
    points, starts = canonical._expand(np.where(points == 10, ord("!"), points), starts, t)
    lower, letter, other, inside, end = _classes()
    points, starts = canonical._drop(points, starts, t.ccc[points] > 0)
    points = lower[points]
    before, after = _beside(letter[points])
    swap = (other[points] != points) & (before | after)
    points[swap] = other[points[swap]]
    before, after = _beside(letter[points])
    points, starts = canonical._drop(points, starts, inside[points] & before & after)
    is_letter = letter[points]
    same = np.zeros(len(points), bool)
    same[1:] = (points[1:] == points[:-1]) & is_letter[1:]
    points, starts = canonical._drop(points, starts, same)
    is_letter = letter[points]
    before, after = _beside(is_letter)
    first, last = np.flatnonzero(is_letter & ~before), np.flatnonzero(is_letter & ~after) + 1
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    chars = np.flatnonzero(is_letter)
    size = last - first
    offset = np.cumsum(size) - size
    at = chars - np.repeat(first, size)
    part = _mix(points[chars].astype(np.uint64) + np.uint64(7)) * _POWERS[np.minimum(at, 255)]
    hashed = np.add.reduceat(part, offset)
    passage = np.cumsum(end[points])[first]
    row = np.searchsorted(starts, first, side="right") - 1
    # Three and more single letters, one sign apart, are one word.
    single = size == 1
    if single.any():
        joined = np.zeros(len(first), bool)
        joined[1:] = single[1:] & single[:-1] & (first[1:] - last[:-1] == 1) & (row[1:] == row[:-1]) & ~end[points[last[:-1]]]
        run = np.cumsum(~joined) - 1
        long = np.bincount(run)[run] >= 3
        if long.any():
            letters = points[first]
            doubled = np.zeros(len(first), bool)
            doubled[1:] = joined[1:] & (letters[1:] == letters[:-1])
            use = np.flatnonzero(long & ~doubled)
            head = use[np.concatenate([[True], run[use][1:] != run[use][:-1]])]
            where = np.searchsorted(use, head)
            rank = np.arange(len(use)) - np.repeat(where, np.diff(np.append(where, len(use))))
            part = _mix(letters[use].astype(np.uint64) + np.uint64(7)) * _POWERS[np.minimum(rank, 255)]
            hashed[head] = np.add.reduceat(part, where)
            keep = ~long
            keep[head] = True
            hashed, passage, row = hashed[keep], passage[keep], row[keep]
    return _mix(hashed), passage, row


def features(texts: pa.Array, layouts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, passage, row)`` of the terms and pairs of neighbouring terms of each passage, in order."""
    hashed, passage, row = terms(plain(texts, layouts))
    pair = np.zeros(len(hashed), np.uint64)
    pair[:-1] = _mix(hashed[:-1] * np.uint64(3) + hashed[1:] * np.uint64(0x9E3779B97F4A7C15))
    ok = np.zeros(len(hashed), bool)
    ok[:-1] = passage[1:] == passage[:-1]
    mask = np.uint64((1 << BITS) - 1)
    both = np.stack([hashed & mask, pair & mask], axis=1).astype(np.int32).ravel()
    keep = np.stack([np.ones(len(ok), bool), ok], axis=1).ravel()
    return both[keep], np.repeat(passage, 2)[keep], np.repeat(row, 2)[keep]


class Machine:
    """The model: bias, weights and factors of the terms in use; ``place`` maps buckets to them (0: not in use)."""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray, bucket: np.ndarray):
        self.bias, self.weight, self.factor = bias, weight, factor
        self.place = np.zeros(1 << BITS, np.int32)
        self.place[bucket] = np.arange(1, len(bucket) + 1)

    def scores(self, bucket: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the first feature of each passage that has a term in use, and the passages' scores."""
        f = self.place[bucket]
        used = np.flatnonzero(f)
        if not len(used):
            return used, np.empty(0, np.float32)
        f, p = f[used], passage[used]
        head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        v = self.factor[f]
        s = np.add.reduceat(v, head)
        q = np.add.reduceat((v * v).sum(axis=1), head)
        return used[head], self.bias + np.add.reduceat(self.weight[f], head) + 0.5 * ((s * s).sum(axis=1) - q)


def fit(bucket: np.ndarray, passage: np.ndarray, doc: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 3, interactions: bool = True) -> Machine:
    """Learn from documents ``doc`` with targets between 0 and 1; features are in order of document and passage.

    Without ``interactions`` the factors stay 0: a linear model, for comparison.
    """
    n = len(target)
    pairs = np.unique(doc.astype(np.int64) << BITS | bucket)
    b, d = pairs & ((1 << BITS) - 1), pairs >> BITS
    seen = np.bincount(b, minlength=1 << BITS)
    use = np.flatnonzero(seen >= LEAST_DOCUMENTS)
    place = np.zeros(1 << BITS, np.int64)
    place[use] = np.arange(1, len(use) + 1)
    size = len(use) + 1
    rng = np.random.default_rng(seed)
    weight, factor = np.zeros(size), rng.normal(scale=0.02 * interactions, size=(size, FACTORS))
    factor[0] = 0
    # Start: shrunken log odds of a term's documents, so that the passages that decide are found at once.
    hit = np.bincount(place[b], weights=target[d], minlength=size)
    of = np.bincount(place[b], minlength=size)
    rate = (target.sum() + 1) / (n + 2)
    weight[1:] = 0.5 * np.log(((hit + 8 * rate) / (of - hit + 8 * (1 - rate)))[1:] * (1 - rate) / rate)
    weight[0] = 0
    f = place[bucket]
    keep = f > 0
    f, passage, doc = f[keep], passage[keep], doc[keep]
    if not len(f):
        return Machine(float(np.log(rate / (1 - rate))), weight.astype(np.float32), factor.astype(np.float32), use)
    head = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    length = np.diff(np.append(head, len(f)))
    doc_of = doc[head]
    doc_head = np.flatnonzero(np.concatenate([[True], doc_of[1:] != doc_of[:-1]]))
    doc_size = np.diff(np.append(doc_head, len(doc_of)))
    smooth = np.clip(target, 0.03, 0.97)
    bias, acc_w, acc_v, acc_b = float(np.log(rate / (1 - rate))), np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for epoch in range(epochs):
        v = factor[f]
        s = np.add.reduceat(v, head)
        q = np.add.reduceat(v * v, head)
        z = bias + np.add.reduceat(weight[f], head) + 0.5 * (s * s - q).sum(axis=1)
        # The deciding passage of each document, and of clean documents a second one by chance.
        noisy = z + (rng.exponential(1.0, len(z)) if epoch % 2 else 0) * (target[doc_of] < 0.5)
        order = np.lexsort((-noisy, doc_of))
        top = order[doc_head]
        second = order[np.minimum(doc_head + 1, len(order) - 1)][(doc_size > 1) & (target[doc_of[doc_head]] < 0.5)]
        chosen = np.concatenate([top, second])
        p, want = 1 / (1 + np.exp(-np.clip(z[chosen], -30, 30))), target[doc_of[chosen]]
        g = p - smooth[doc_of[chosen]]
        if epoch >= WARM:
            # Readers err: a judgement counts as much as the model can believe it (a bounded loss).
            g *= np.where(want > 0.5, p, np.where(want < 0.5, 1 - p, 1.0))
        span = length[chosen]
        at = np.repeat(head[chosen] - (np.cumsum(span) - span), span) + np.arange(span.sum())
        ff, gg = f[at], np.repeat(g, span)
        rate_now = 0.25 if epoch < epochs * 2 // 3 else 0.1
        gw = np.bincount(ff, weights=gg, minlength=size) + SHRINK * weight
        acc_w += gw * gw
        weight -= rate_now * gw / np.sqrt(acc_w)
        gv = np.repeat(s[chosen], span, axis=0) - factor[ff]
        for k in range(FACTORS if interactions else 0):
            gk = np.bincount(ff, weights=gg * gv[:, k], minlength=size) + SHRINK * factor[:, k]
            acc_v[:, k] += gk * gk
            factor[:, k] -= 0.5 * rate_now * gk / np.sqrt(acc_v[:, k])
        gb = g.sum()
        acc_b += gb * gb
        bias -= rate_now * gb / np.sqrt(acc_b)
        weight[0], factor[0] = 0, 0
    return Machine(float(bias), weight.astype(np.float32), factor.astype(np.float32), use)


def judged(labels: DataFrame) -> DataFrame:
    """``(doc_id, target)``: the share of readers who found a document toxic; gaps are left out."""
    return labels.where("doc_id is not null and toxic is not null").groupby("doc_id").agg(F.avg((F.col("toxic") > 0).cast("double")).alias("target"))


def fitted(documents: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> Machine:
    """The machine fitted to at most ``most`` judged documents, chosen by a hash of the id; fitted in one task.

    Without judged documents every score is the bias alone.
    """
    chosen = judged(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text", "fmt").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch.column("text")):
                part = batch.slice(a, b - a)
                bucket, passage, row = features(part.column("text"), part.column("fmt"))
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (bucket, passage)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("target"), *lists], names=["doc_id", "target", "bucket", "passage"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("doc_id") if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            m = Machine(-20.0, np.zeros(1, np.float32), np.zeros((1, FACTORS), np.float32), np.empty(0, np.int64))
        else:
            lists = table.column("bucket").combine_chunks()
            size = pc.list_value_length(lists).to_numpy()
            doc = np.repeat(np.arange(table.num_rows), size)
            passage = table.column("passage").combine_chunks().flatten().to_numpy()
            # Passages were numbered by batch: number them through.
            new = np.concatenate([[True], (passage[1:] != passage[:-1]) | (doc[1:] != doc[:-1])]) if len(passage) else np.empty(0, bool)
            m = fit(lists.flatten().to_numpy(), np.cumsum(new), doc, table.column("target").to_numpy())
            m.bias += LIFT
        use = np.flatnonzero(m.place)
        cells = [pa.array([m.bias]), pa.array([use.tolist()], pa.list_(pa.int32())), pa.array([m.weight.tolist()], pa.list_(pa.float32())), pa.array([m.factor.ravel().tolist()], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(cells, names=["bias", "bucket", "weight", "factor"])

    found = rows.mapInArrow(extract, "doc_id bigint, target double, bucket array<int>, passage array<int>").repartition(1)
    r = found.mapInArrow(learn, "bias double, bucket array<int>, weight array<float>, factor array<float>").first()
    return Machine(r.bias, np.array(r.weight, np.float32), np.array(r.factor, np.float32).reshape(-1, FACTORS), np.array(r.bucket, np.int64))


def scored(documents: DataFrame, machine: Machine) -> DataFrame:
    """``(doc_id, source, score, passages)``: the probability of the worst passage and the number of passages over one half.

    Defined results: null, empty and blank texts score 0 with no passages; a null layout is plain text; every row gives
    one row; texts are scored whole; an empty table gives none; further columns are ignored.
    """
    ship_code(documents.sparkSession)
    parts = (machine.bias, machine.weight, machine.factor, np.flatnonzero(machine.place))
    sent = documents.sparkSession.sparkContext.broadcast(parts)  # at most 2**BITS terms
    held: list[Machine] = []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held[0] if held else held.append(Machine(*sent.value)) or held[0]
        for batch in batches:
            n = batch.num_rows
            best, count = np.full(n, -30.0), np.zeros(n, np.int64)
            for a, b in steps(batch.column("text")):
                bucket, passage, row = features(batch.column("text").slice(a, b - a), batch.column("fmt").slice(a, b - a))
                at, z = m.scores(bucket, passage)
                np.maximum.at(best, row[at] + a, z)
                count += np.bincount(row[at[z > 0]] + a, minlength=n)
            p = np.where(best > -30, 1 / (1 + np.exp(-np.clip(best, -30, 30))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(p), pa.array(count)], names=["doc_id", "source", "score", "passages"])

    rows = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"), F.col("fmt").cast("string"))
    return rows.mapInArrow(score, "doc_id bigint, source string, score double, passages bigint")


def rates(scores: DataFrame) -> DataFrame:
    """Documents, documents with such passages and their rate, by source."""
    return scores.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.sum((F.col("passages") > 0).cast("bigint")).alias("n_found"),
        F.round(F.avg((F.col("passages") > 0).cast("double")), 6).alias("rate"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )
