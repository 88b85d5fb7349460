import random

import pyarrow as pa
import pytest

from arborloom.llm import encoding as en

PATH = f"{en.TOKENIZERS}/{en.VOCABULARY}"
PIECES = ["a", "b", "ab", " ", "  ", "\n", "'", "'s", "'r", "e", "1", "!", "é", "日本", "\x1c", "　", "ll", "'l", "the", "re", "<|endoftext|>", "🙂"]


@pytest.fixture(scope="module")
def e():
    return en.encoder(PATH)


def parts(e, text, size):
    cut = en.chunks(text, size)
    assert "".join(c for c, _ in cut) == text
    ids, bounds = e.encode(pa.array([c for c, _ in cut]))
    return [(c, ids[bounds[i] : bounds[i + 1]].tolist(), s) for i, (c, s) in enumerate(cut)]


def test_batches_and_trees_equal_the_tokenizer(e):
    rng = random.Random(0)
    for _ in range(1500):
        pool = rng.sample(PIECES, rng.choice([2, 4, len(PIECES)]))
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 200)))
        want = e.bpe.encode_ordinary(text)
        assert e.encode(pa.array([text]))[0].tolist() == want
        assert en.concatenated(parts(e, text, rng.choice([3, 8, 20, 50])), e) == want


def test_long_unsplit_text(e):
    for text in ("abcde" * 20_000, "日本語" * 10_000, "a" * 70_001, "'" * 40_000):
        assert en.concatenated(parts(e, text, 4096), e) == e.bpe.encode_ordinary(text)


def test_table(spark, e):
    rng = random.Random(1)
    texts = [None, "", " ", "\n", "plain words  and more ", "<|endoftext|>", "x" * 9000, "".join(rng.choice(PIECES) for _ in range(8000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "\n"), (None, "y " * 3000), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as key", "2 as ids", "3 as row")
    got = en.with_ids(df, "doc_id", "text", long_text=1000, chunk=500).collect()
    want = [(i, [] if t is None else e.bpe.encode_ordinary(t)) for i, t in rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(want, key=str)
    assert en.with_ids(df.limit(0), "doc_id", "text").count() == 0


def test_counts(spark, e):
    df = spark.createDataFrame([("one two",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(en.token_counts()("text")).collect()] == [2, 0, 0]
