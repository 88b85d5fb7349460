import random

import numpy as np
import pyarrow as pa

from arborloom.llm import toxicity as tx

INSULTS, AIMS, SAFE = ["rotten", "filthy", "useless"], ["you", "they"], ["river", "tower", "garden", "market", "book"]


def passage(rng, bad):
    noise = " ".join(rng.choice(SAFE) for _ in range(4))
    if bad:
        return f"{noise} {rng.choice(INSULTS)} {rng.choice(SAFE)} {rng.choice(AIMS)} {rng.choice(SAFE)}"
    # An insult or an aim alone is harmless.
    return f"{noise} {rng.choice(INSULTS if rng.random() < 0.5 else AIMS)} {rng.choice(SAFE)}"


def corpus(n, seed, wrong=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        parts = [passage(rng, False) for _ in range(rng.randrange(1, 6))]
        if bad:
            parts[rng.randrange(len(parts))] = passage(rng, True)
        rows.append((i, ". ".join(parts) + ".", bad, bad ^ (rng.random() < wrong)))
    return rows


DOCS = "doc_id bigint, text string, source string, fmt string"


def test_interactions_are_learnt_on_held_out_documents(spark):
    train, test = corpus(1500, 1, wrong=0.05), corpus(600, 2)
    docs = spark.createDataFrame([(i, t, "s", "prose") for i, t, _, _ in train], DOCS)
    labels = spark.createDataFrame([(i, int(y), "r") for i, _, _, y in train], "doc_id bigint, toxic int, reader string")
    machine = tx.fitted(docs, labels)
    held = spark.createDataFrame([(i, t, "s" if i % 2 else None, "prose") for i, t, _, _ in test], DOCS)
    got = {r.doc_id: r for r in tx.scored(held, machine).collect()}
    right = sum((got[i].passages > 0) == bad for i, _, bad, _ in test)
    assert right / len(test) > 0.9
    assert {r.source: r.n_docs for r in tx.rates(tx.scored(held, machine)).collect()} == {"s": 300, None: 300}


def test_interactions_find_what_a_linear_model_misses():
    """Insults with an aim are bad, insults alone and aims alone are not, and passages are long: weights alone cannot tell."""
    rng = random.Random(8)

    def made(n):
        texts, bad = [], []
        for _ in range(n):
            kind = rng.randrange(4)
            words = [rng.choice(SAFE) for _ in range(6)]
            if kind & 1:
                words[1] = rng.choice(INSULTS)
            if kind & 2:
                words[4] = rng.choice(AIMS)
            texts.append(" ".join(words))
            bad.append(kind == 3)
        return texts, np.array(bad)

    texts, bad = made(3000)
    b, p, r = tx.features(pa.array(texts), pa.nulls(len(texts), pa.string()))
    held, want = made(1000)
    hb, hp, hr = tx.features(pa.array(held), pa.nulls(len(held), pa.string()))
    right = {}
    for how in (True, False):
        m = tx.fit(b, p, r, bad.astype(float), interactions=how)
        at, z = m.scores(hb, hp)
        best = np.full(len(held), -30.0)
        np.maximum.at(best, hr[at], z)
        # The best threshold for each, so that only the order of the scores counts.
        right[how] = max(((best > c) == want).mean() for c in np.unique(best))
    assert right[True] > 0.97 and right[True] >= right[False]


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "s", "prose"), (3, " \n\t ", "s", None), (4, "word. " * 50_000, "s", "lines"), (None, "x", "s", "prose"), (4, "word", "s", "prose")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as score", "2 as target")
    empty = spark.createDataFrame([], "doc_id bigint, toxic int, reader string")
    machine = tx.fitted(docs, empty)
    got = tx.scored(docs, machine).collect()
    assert len(got) == len(rows) and all(r.passages == 0 for r in got)
    assert [r.score for r in got if r.doc_id in (1, 2, 3)] == [0.0] * 3
    assert tx.scored(docs.limit(0), machine).count() == 0


def buckets(text, layout="prose"):
    b, p, _ = tx.features(pa.array([text]), pa.array([layout]))
    out = {}
    for x, y in zip(b.tolist(), p.tolist(), strict=True):
        out.setdefault(y, []).append(x)
    return list(out.values())


def test_hidden_spellings_are_undone():
    want = buckets("pathetic wanker here")
    for text in ("PATHETIC wanker here", "p a t h e t i c wanker here", "pathet1c w@nker here", "path.etic wan_ker here", "pathhhetic wаnkеr here", "pa​thetic ｗａｎｋｅｒ héré"):
        assert buckets(text) == want, text


def test_layouts_give_the_same_passages():
    want = buckets("the old man. he left")
    conll = "1\tThe\tthe\tX\t_\t_\t0\n2\told\told\tX\t_\t_\t0\n3\tman\tman\tX\t_\t_\t0\n4\t.\t.\tX\t_\t_\t0\n\n1\tHe\the\tX\t_\t_\t0\n2\tleft\tleft\tX\t_\t_\t0"
    assert buckets(conll, "conll") == want
    assert buckets("DET/The ADJ/old NOUN/man X/.\nPRON/He VERB/left", "tagwords") == want
    assert buckets("(1 (2 The) (3 (4 old) (5 man)))\n(7 (3 He) (2 left))", "linetrees") == want
    assert buckets('<SEG id="a"><TOKEN pos="X">The</TOKEN><TOKEN>old</TOKEN><TOKEN>man</TOKEN></SEG><SEG><TOKEN>He</TOKEN><TOKEN>left</TOKEN></SEG>', "ltf") == want


def test_rows_do_not_run_together():
    b, p, r = tx.features(pa.array(["a b", None, "c d", ""]), pa.nulls(4, pa.string()))
    assert sorted(set(r.tolist())) == [0, 2] and len(set(p.tolist())) == 2
    assert b[r == 2].tolist() == buckets("c d")[0]


def test_machine_equals_the_plain_formula():
    rng = np.random.default_rng(0)
    m = tx.Machine(-1.0, np.append(0, rng.normal(size=6)).astype(np.float32), np.vstack([np.zeros(4), rng.normal(size=(6, 4))]).astype(np.float32), np.arange(10, 16))
    bucket, passage = np.array([10, 11, 99, 12, 13, 13, 15]), np.array([0, 0, 0, 1, 1, 1, 2])
    _, z = m.scores(bucket, passage)
    for k in range(3):
        f = [x - 9 for x in bucket[passage == k].tolist() if 10 <= x < 16]
        want = m.bias + sum(m.weight[i] for i in f) + sum(m.factor[f[i]] @ m.factor[f[j]] for i in range(len(f)) for j in range(i))
        assert abs(z[k] - want) < 1e-4
