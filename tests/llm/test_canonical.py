import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborloom.llm import canonical as c

ODD = "aàáạ̣́̂̈её ᄀ가각ᆨᅡﬁﬃＡａ１²₂​\xad　 KΩÅℝſtά̓ḍ̇োো𝖺𝐀ｶﾞ①½שּׁ\U0002f800﻿같"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from(ODD) | st.characters(codec="utf-8"), max_size=12), max_size=8))
def test_kernel_equals_the_plain_statement(texts):
    got = c.canonical_array(pa.array(texts, pa.string())).to_pylist()
    assert got == [None if t is None else c.canonical_string(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(ODD), max_size=12))
def test_form_of_a_form_is_itself(text):
    once = c.canonical_array(pa.array([text])).to_pylist()
    assert c.canonical_array(pa.array(once)).to_pylist() == once
    assert unicodedata.is_normalized("NFC", once[0])


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("ｗｏｒｄ", "word", True), ("wo​rd", "word", True), ("café", "café", True), ("сrеtіn", "cretin", True),
        (" word　", "word", True), ("a b", "a b", True), ("ﬁn", "fin", True), ("𝖺𝖻", "ab", True), ("K", "K", True),
        ("각", "각", True), ("cafe", "café", False), ("Word", "word", False), ("m²", "m2", False), ("h₂", "h2", False),
        ("a b", "ab", False), ("O", "0", False), ("l", "1", False), ("Γ", "Г", True), ("Π", "П", True), ("Φ", "Ф", True), ("κ", "к", True), ("ρ", "p", True),
        ("υ", "u", True), ("հ", "h", True), ("ո", "n", True), ("ꓐꓮꓠ", "BAN", True), ("ⲟⲣ", "op", True), ("co‐op", "co-op", True), ("Ꭰ", "D", True), ("Ꮐ", "G", True),
        ("Γ", "Τ", False), ("π", "п", False), ("co–op", "co-op", False), ("ά", "α", False),
    ],
)
def test_looks(a, b, same):
    x, y = c.canonical_array(pa.array([a, b])).to_pylist()
    assert (x == y) is same


def test_marks_without_end_and_slices():
    deep = "a" + "́" * 500 + "̣" * 500
    arr = pa.array(["x", None, deep, "", "  "])
    assert c.canonical_array(arr.slice(1)).to_pylist() == [None, c.canonical_string(deep), "", ""]
    long = "е́" * 200_000
    assert c.canonical_array(pa.array([long])).to_pylist() == ["é" * 200_000]


def test_classes_stand_for_themselves():
    assert not set(c.LOOK_ALIKES) & set(c.CLASSES) and all(len(x) == 1 for x in [*c.LOOK_ALIKES, *c.CLASSES])


def test_steps_do_not_change_the_result(monkeypatch):
    texts = pa.array(["ｗ" * 9, None, "", "é", " е​ "] * 20)
    want = c.canonical_array(texts).to_pylist()
    monkeypatch.setattr(c, "STEP", 10)
    assert c.canonical_array(texts).to_pylist() == want


def test_pairs_and_classes(spark):
    rows = [(1, "café"), (2, "café"), (2, "café"), (3, "cafe"), (4, None), (5, ""), (6, "ｃａｆｅ"), (None, "cafe"), (7, "cafe")]
    words = spark.createDataFrame(rows, "id int, word string").selectExpr("*", "1 as canonical", "2 as n")
    assert sorted(map(tuple, c.look_alike_pairs(words).collect())) == [(1, 2), (3, 6), (3, 7), (6, 7)]
    assert {(r.id, r.class_id) for r in c.look_alike_classes(words).collect()} == {(1, 1), (2, 1), (3, 3), (6, 3), (7, 3)}
    assert c.look_alike_pairs(words.limit(0)).count() == 0
