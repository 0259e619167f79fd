"""Steps that read the nodes once give what their joins give."""

import pytest
from pyspark.sql import functions as F

from xylem.operators import Selection, select
from xylem.operators.selection import attribute
from xylem.sources.shred import FRAME, NAMED, WRITTEN, parse, shred

DOCS = [
    ("1", '<a k="r"><b k="x" v="1">t<b k="y" v="2"><c>u</c></b><c>v</c><c/></b><b v="3"/><b k="x" v="4"/></a>'),
    ("2", "<a><c>w</c></a>"), ("3", "<b><b/><a/><b><b/></b></b>"), ("4", "<a/>"),
]


@pytest.fixture(scope="module")
def root(spark):
    return select(shred(spark.createDataFrame(DOCS, "doc_id string, xml string")))


def rows(s: Selection, *more: str) -> list:
    return sorted(tuple(r) for r in s.rows.select("doc_id", "pre", "name", F.to_json("attrs"), "num", F.col("at").cast("string"), *more).collect())


def joined(s: Selection) -> Selection:
    return Selection(s.nodes, s.rows, once=s.once)


PICKS = {"roots": lambda s: s, "all b": lambda s: s.find("b"), "children": lambda s: s.children(), "tested": lambda s: s.find("c").has_text(), "all": lambda s: s.depth_first(), "levels": lambda s: s.breadth_first()}


@pytest.mark.parametrize("pick", PICKS)
def test_parents_and_values_of_children(root, pick):
    s = PICKS[pick](root)
    assert s.plain
    assert rows(s.parent()) == rows(joined(s).parent())
    for one in (lambda x: x.with_count("b", "n"), lambda x: x.with_sum("b", "n", attribute="v"), lambda x: x.with_child_text("c", "n")):
        assert rows(one(s), "n") == rows(one(joined(s)), "n")


def test_parents_come_once_at_their_first_child(root):
    assert [(d, p) for d, p, *_ in rows(root.find("c").parent())] == [("1", 1), ("1", 2), ("2", 0)]
    twice = root.find("b").union(root.find("c")).parent()
    assert {(d, p): at for d, p, _, _, _, at in rows(twice)}[("1", 1)] == rows(root.find("b").union(root.find("c")).parent().where(F.col("pre") == 1))[0][-1]


def test_counts_of_roots(root):
    assert {r["doc_id"]: r["n"] for r in root.with_count("b", "n").rows.collect()} == {"1": 3, "2": 0, "3": 2, "4": 0}


def test_last_value_of_a_key_stands(root):
    s = root.find("b")
    got = {r["doc_id"]: r["map"] for r in s.to_map(attribute("k"), attribute("v")).collect()}
    assert got == {"1": {"x": "4", "y": "2"}}
    whole = {r["doc_id"]: r["map"] for r in s.to_map(attribute("k"), F.col("attrs")).collect()}
    assert whole["1"]["x"] == {"k": "x", "v": "4"}


def test_attributes_of_documents_that_have_nodes(root):
    got = {r["doc_id"]: r["values"] for r in root.find("b").distinct_attributes("k", every=False).collect()}
    assert got == {"1": ["x", "y"], "3": []}
    assert len(root.find("b").distinct_attributes("k").collect()) == 4


def test_columns_of_the_shredder(spark):
    docs = spark.createDataFrame([*DOCS, ("5", "<x")], "doc_id string, xml string")
    whole, few = shred(docs, mode="PERMISSIVE"), shred(docs, mode="PERMISSIVE", columns=["attrs", "text"])
    assert few.columns == [*[c for c in whole.columns if c in (*FRAME, "text", "text_only", "attrs", "_error", "num", "bool")]]
    same = lambda df: sorted(repr(tuple(r)) for r in df.select(*few.columns).collect())
    assert same(few) == same(whole)
    assert "text" not in shred(docs, columns=[]).columns
    with pytest.raises(ValueError, match="nonsense"):
        shred(docs, columns=["nonsense"])


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_documents_in_one_aggregation(root):
    for pick in PICKS.values():
        s = pick(root)
        assert sorted(map(tuple, s.count().collect())) == sorted(map(tuple, joined(s).count().collect()))
    none = root.find("d").count()
    assert "Join" not in plan(none) and sorted(map(tuple, none.collect())) == [(str(k), 0) for k in range(1, 5)]
    assert root.nodes.where("depth > 0").count() and not select(root.nodes.where("depth > 0")).find("b").count().collect()


def test_documents_are_written_without_a_join(spark):
    docs = spark.createDataFrame([*DOCS, ("5", '<r a="&lt;"><x><y><z/>u</y></x><x>&amp;</x><y/>t</r>')], "doc_id string, xml string")
    s = select(shred(docs))
    got = [tuple(map(str, r)) for r in s.to_xml_strings().orderBy("doc_id").collect()]
    assert got == [tuple(map(str, r)) for r in joined(s).to_xml_strings().orderBy("doc_id").collect()]
    assert got[4][1:] == ("[0]", '<r a="&lt;">t<x><y>u<z/></y></x><x>&amp;</x><y/></r>')
    assert got == [tuple(map(str, r)) for r in select(shred(docs, columns=["text", "attrs"], frame=WRITTEN)).to_xml_strings().orderBy("doc_id").collect()]
    long = s.to_xml_strings(self_closing=False).where("doc_id = '4'").first()["xml"]
    assert long == "<a></a>" and "Join" not in plan(s.to_xml_strings())


def test_records_are_read_once_and_spread_before_they_are_shredded(spark):
    from xylem.plans import QUERIES

    got = plan(QUERIES["records_of_nodes"](spark, "/root/testdata/sf0.001"))
    assert got.count("MapInArrow") == 1 and got.count("SortMergeJoin") == 1
    assert "REPARTITION_BY_NUM" in got.split("MapInArrow")[1]


def test_frames_of_the_shredder(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, xml string")
    few = shred(docs, columns=[], frame=NAMED)
    assert few.columns == [c for c in FRAME if c in NAMED]
    assert sorted(map(tuple, select(few).find("b").count().collect())) == sorted(map(tuple, select(shred(docs)).find("b").count().collect()))
    with pytest.raises(ValueError, match="nonsense"):
        shred(docs, columns=[], frame=["nonsense"])


def test_places_from_numbers_of_children():
    got = parse("d", "<a><b><c/><b/></b><!-- k --><c>t</c><b><b><c/></b>u</b></a>")
    assert [(r["pre"], r["end_pre"], r["parent_pre"], r["depth"], r["ord"], r["ord_same_name"], r["n_siblings"], r["n_children"], r["path"], r["anc_pres"]) for r in got] == [
        (0, 7, None, 0, 0, 0, 1, 3, "a", []), (1, 3, 0, 1, 0, 0, 3, 2, "a/b", [0]), (2, 2, 1, 2, 0, 0, 2, 0, "a/b/c", [1, 0]), (3, 3, 1, 2, 1, 0, 2, 0, "a/b/b", [1, 0]),
        (4, 4, 0, 1, 1, 0, 3, 0, "a/c", [0]), (5, 7, 0, 1, 2, 1, 3, 1, "a/b", [0]), (6, 7, 5, 2, 0, 0, 1, 1, "a/b/b", [5, 0]), (7, 7, 6, 3, 0, 0, 1, 0, "a/b/b/c", [6, 5, 0])]
    deep = parse("d", "<r>" * 2000 + "</r>" * 2000)
    assert deep[-1]["anc_pres"] == [*range(1998, -1, -1)] and {r["end_pre"] for r in deep} == {1999}


def test_nodes_are_parsed_without_a_python_call_each():
    import sys

    from xylem.sources.shred import _Builder

    calls = 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    b = _Builder(True)
    sys.setprofile(seen)
    b.read("d", "<r>" + "<i>1</i>" * 1000 + "</r>")
    b.batch(None)
    sys.setprofile(None)
    assert calls < 1000
