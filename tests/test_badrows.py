import pytest

from arborloom.operators import badrows as b

TAGS = frozenset({"NOUN", "VERB"})
OK = "1\tw\tw\tNOUN\t_\t_\t2"


@pytest.mark.parametrize(
    "raw, kind, reason",
    [
        (None, "bad", "columns"), ("", "blank", None), ("   ", "blank", None), ("\r", "blank", None), ("# x \"", "comment", None),
        (OK, "token", None), (OK + "\r", "token", None), (OK + "\t_", "bad", "columns"), ("1 w w NOUN _ _ 2", "bad", "columns"),
        ("\t\t\t\t\t\t", "bad", "value"), ("\t\t", "bad", "columns"),
        ('1\t"w"\tw\tNOUN\t_\t_\t2', "token", None), ('1\t"a\tb"\tw\tNOUN\t_\t_\t2', "token", None), ('1\t"a""b"\tw\tNOUN\t_\t_\t2', "token", None),
        ('1\t"w\tw\tNOUN\t_\t_\t2', "bad", "quoting"), ('1\t"w"x\tw\tNOUN\t_\t_\t2', "bad", "quoting"), ('1\tw"x\tw\tNOUN\t_\t_\t2', "bad", "quoting"),
        ('1\tw"x', "bad", "quoting"), ('1\t""\tw\tNOUN\t_\t_\t2', "bad", "value"), ('1\t"""" \tw\tNOUN\t_\t_\t2', "bad", "quoting"),
        ("01\tw\tw\tNOUN\t_\t_\t2", "bad", "value"), ("1000\tw\tw\tNOUN\t_\t_\t2", "bad", "value"), ("0\tw\tw\tNOUN\t_\t_\t2", "bad", "value"),
        ("1\tw\tw\tNOUN\t_\t_\t0", "token", None), ("1\tw\tw\tNOUN\t_\t_\t1", "bad", "value"), ("1\tw\tw\tnoun\t_\t_\t2", "bad", "value"),
        ("1\tw\tw\tNOUN\t_\t_\t+2", "bad", "value"), ("1\tw\tw\tNOUN\t_\t_\t２", "bad", "value"), ("1\tw\t\tNOUN\t_\t_\t2", "bad", "value"),
        ("1\tw\x07\tw\tNOUN\t_\t_\t2", "bad", "value"), ("1\tw\tw\tNOUN\t\x7f\t_\t2", "bad", "value"), ("1\tw�\tw\tNOUN\t_\t_\t2", "bad", "value"),
        ('1\t"w\r"\tw\tNOUN\t_\t_\t2', "bad", "value"), ("1\tw\rx\tw\tNOUN\t_\t_\t2", "bad", "value"), (OK + "\r\r", "bad", "value"),
    ],
)
def test_lines(raw, kind, reason):
    got = b.parse_line(raw, TAGS)
    assert got[:2] == (kind, reason)


def test_table(spark):
    long = "1\t" + "w" * 300_000 + "\tw\tNOUN\t_\t_\t2"
    rows = [(1, "f", 1, OK), (2, "f", 2, None), (3, None, None, "x"), (None, "f", 3, OK), (1, "f", 1, OK), (4, "f", 4, long), (5, "f", 5, '1\t"' + "x" * 200_000)]
    lines = spark.createDataFrame(rows, "line_id bigint, file string, line_no int, raw string").selectExpr("*", "1 as kind", "2 as reason", "3 as tag")
    tags = spark.createDataFrame([("NOUN", 1), (None, 2), ("NOUN", 1)], "tag string, tag_no int")
    parsed = b.parse_lines(lines, tags)
    assert sorted(map(tuple, b.rejected(parsed).collect())) == [(2, "columns"), (3, "columns"), (5, "quoting")]
    good = b.tokens(parsed).collect()
    assert len(good) == 4 and max(len(r.form) for r in good) == 300_000
    assert b.rejected(b.parse_lines(lines.limit(0), tags)).count() == 0
    assert b.tokens(b.parse_lines(lines, tags.limit(0))).count() == 0


def test_records_over_lines():
    assert list(b.assemble_records(iter(['a\t"b', 'c"\td', "e", 'f"g']))) == ['a\t"b\nc"\td', "e", 'f"g']
    # A quote that is never closed, or closed by a line that makes no whole record, costs its own line only.
    assert list(b.assemble_records(iter(['"a', "b", "c"]))) == ['"a', "b", "c"]
    lines = ['x\t"a', "1\t2", '3\t"4', '5"', '"', "6\t7"]
    two = lambda r: len(b.split_record(r)) == 2

    def whole(r):
        try:
            return two(r)
        except b.Rejected:
            return False

    assert list(b.assemble_records(iter(lines), whole)) == ['x\t"a', "1\t2", '3\t"4\n5"', '"', "6\t7"]


def test_one_reader_for_many_records():
    r = b.Reader()
    assert r.split("a\tb") == ["a", "b"] and r.split("") == [""] and r.split('"a\nb"\t') == ["a\nb", ""]
    for bad in ('"a', '"a"b', 'a"b', 'x\t"'):
        with pytest.raises(b.Rejected):
            r.split(bad)
        assert r.split("c\td") == ["c", "d"]
