import pytest

from arborloom.operators import trees
from arborloom.sources import formats as s


def put(tmp_path, name, text, encoding="utf-8"):
    p = tmp_path / name
    p.write_bytes(text.encode(encoding))
    return str(p)


def test_int_corpus(spark, tmp_path):
    rows = s.read_int_corpus(spark, put(tmp_path, "a.txt", "2/7 1/4 2/9\n7 4 9\n")).orderBy("sent_id").collect()
    assert [(r.toks, r.tags) for r in rows] == [([7, 4, 9], [2, 1, 2]), ([7, 4, 9], [0, 0, 0])]
    with pytest.raises(Exception, match="more than one slash"):
        s.read_int_corpus(spark, put(tmp_path, "b.txt", "1/2/3\n")).collect()


def test_dictionary_and_vectors(spark, tmp_path):
    d = s.read_dictionary(spark, put(tmp_path, "d", "river 12\ntwo words 3\n"))
    assert sorted(map(tuple, d.collect())) == [("river", 12), ("two words", 3)]
    v = s.read_word_vectors(spark, put(tmp_path, "v", "3 2\nriver 1 2\nriver 0.5 0\nother 1 1\nriver 1 2 3\n"), d, 2)
    assert [(r.id, r.vec) for r in v.collect()] == [(12, [1.5, 2.0])]
    s.write_dictionary(d, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["river 12", "two words 3"]


def test_states_samples_trees(spark, tmp_path):
    r = s.read_states(spark, put(tmp_path, "s", "-::ACT0/AWA0::+::POS1::x +::ACT2/AWA1;ACT3/AWA4::-::POS2::y\n")).first()
    assert [tuple(x) for x in r.states] == [(0, [0], [0], 1, 1, "x"), (1, [2, 3], [1, 4], 0, 2, "y")]
    assert [x.tags for x in s.read_samples(spark, put(tmp_path, "t", "[1, 2, 3]\nx\n")).collect()] == [[1, 2, 3]]
    assert [x.tree for x in s.read_line_trees(spark, put(tmp_path, "l", "(A b)\n\n(C d)\n"), 1).collect()] == ["(A b)"]


def test_conll_and_delimited(spark, tmp_path):
    text = "# c\n1\ta\ta\n2-3\tx\tx\n2\tb\tb\n\n1\tc\tc\n"
    rows = s.read_conll(spark, put(tmp_path, "c.conll", text)).orderBy("sent_id", "tok_id").collect()
    assert [(r.tok_id, r.fields[1]) for r in rows] == [(1, "a"), (2, "b"), (1, "c")] and len({r.sent_id for r in rows}) == 2
    good, bad = s.read_delimited(spark, put(tmp_path, "q.tsv", 'a\t"b\nc"\nd\te\nf\ng"\th\n'), 2)
    assert sorted(tuple(r.fields) for r in good.collect()) == [("a", "b\nc"), ("d", "e")]
    # The open quote of the last line reaches the end of the file.
    assert [r.reason for r in bad.orderBy("record_no").collect()] == ["columns", "quoting"]
    good, bad = s.read_delimited(spark, put(tmp_path, "r.tsv", 'a\tb\nc\t"d\ne\tf\ng\th\n'), 2)
    assert sorted(tuple(r.fields) for r in good.collect()) == [("a", "b"), ("e", "f"), ("g", "h")]
    assert [(r.raw, r.reason) for r in bad.collect()] == [('c\t"d', "quoting")]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_conll_line_ends(spark, tmp_path, end):
    text = "1\ta\n2\tb\n \n\n1\tc\n".replace("\n", end)
    rows = s.read_conll(spark, put(tmp_path, "e.conll", text)).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault(r.sent_id, []).append((r.tok_id, r.fields[1]))
    assert sorted(map(sorted, blocks.values())) == [[(1, "a"), (2, "b")], [(1, "c")]]


def test_xml_and_korean(spark, tmp_path):
    x = put(tmp_path, "a.xml", '<LTF><SEG id="s1"><TOKEN id="t1" pos="N">w</TOKEN><TOKEN id="t2" pos="A/B">v</TOKEN></SEG><SEG id="s2"><TOKEN id="t3">u</TOKEN></SEG></LTF>')
    segs = s.read_ltf(spark, x)
    assert len(segs.collect()) == 2
    k = s.read_korean_treebank(spark, put(tmp_path, "k.fid", ";; note\n(S (NP 나/NPN)\n (VP *T* 가/VV))\n", "euc-kr"))
    assert [r.tree for r in k.collect()] == ["(S (NP NPN/나) (VP VV/가))"]


def test_models_and_reports(spark, tmp_path):
    m = s.read_conditional_model(spark, put(tmp_path, "m", "R 5 : 4 3 = 0.25\nT x = 1\nnoise\n"))
    assert sorted((r.id, r.cond, r.out, r.p) for r in m.collect()) == [("R", ["5"], ["4", "3"], 0.25), ("T", [], ["x"], 1.0)]
    d = s.read_model_dump(spark, put(tmp_path, "dump", "P( 3 | 1, 0 ) = 0.5\nP( 9 | 1, 0 ) = 0.1\nP( w | 2 ) = 1\n"), 5)
    assert sorted((r.out, r.cond, r.depth, r.p) for r in d.collect()) == [("3", "1", 0, 0.5), ("w", "2", None, 1.0)]
    assert s.read_dump_tuples(spark, put(tmp_path, "sql", "INSERT\n(12,0,'Title',x),\n")).first().fields == ["12", "0", "Title", "x"]
    r = s.read_reports(spark, put(tmp_path, "last_sample20.txt", "x\nF = 12.5\nF = 3\n"), "F")
    assert [(y.value, y.iter) for y in s.with_iteration(r).collect()] == [(12.5, 20)]
    assert s.read_table_with_header(spark, put(tmp_path, "t.tsv", "iter\tlogprob\n1\t-2.5\n")).first().logprob == -2.5


def test_writers(spark, tmp_path):
    path = str(tmp_path / "ck")
    for i in range(4):
        s.write_checkpoint(spark.createDataFrame([(0, i)], "lhs int, n int"), path, i)
    assert s.last_checkpoint(spark, path) == 3
    assert sorted(p.name for p in (tmp_path / "ck").iterdir() if p.name.startswith("iter=")) == ["iter=2", "iter=3"]
    assert s.last_checkpoint(spark, str(tmp_path / "none")) is None
    s.append_series(spark.createDataFrame([(1, "v", 0.5)], "iter int, metric string, value double"), str(tmp_path / "series"))
    assert spark.read.parquet(str(tmp_path / "series")).first().value == 0.5
    counts = spark.createDataFrame([("F", 0, 1, -1, 0, 3), ("F", 0, 1, -1, 1, 1)], "model string, depth int, c1 int, c2 int, out int, cnt bigint")
    assert sorted((r.out, r.p) for r in s.distributions(counts).collect()) == [("0", 0.75), ("1", 0.25)]
    chain = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0)], "iter int, rule string, p double")
    assert sorted(map(tuple, s.chain_view(chain, ["a", "b"]).collect())) == [(1, 0.5, 0.5), (2, 1.0, None)]
    assert s.scalar_series(s.chain_view(chain, ["a", "b"])).count() == 4
    steps = spark.createDataFrame([(1, 0, 1, 0), (1, 1, 0, 0), (1, 2, 0, 1)], "sent_id bigint, pos int, f int, j int")
    seg = s.segments(steps)
    assert sorted((r.segment, r.begin, r.end) for r in seg.collect()) == [(-1, 0, 2), (0, 0, 1), (1, 2, 2)]
    s.write_annotations(seg, str(tmp_path / "xml"))
    nodes = trees.read_trees(spark.createDataFrame([(2, "(A b)"), (1, "(C d)")], "tree_id bigint, tree string"))
    s.write_trees(nodes, str(tmp_path / "trees"))
    assert [r.value for r in spark.read.text(str(tmp_path / "trees")).collect()] == ["(C d)", "(A b)"]
    cfg = {"io": {"input_file": "x"}, "params": {"depth": 2}}
    assert s.read_config(s.config_text(cfg)) == {"io": {"input_file": "x"}, "params": {"depth": "2"}}
