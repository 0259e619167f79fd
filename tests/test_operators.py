"""Single operators on small documents."""

import json
import re

import pytest
from pyspark.sql import functions as F

from xylem.functions import values as V
from xylem.operators import mutate, select
from xylem.operators.selection import attribute
from xylem.sources import bind as B
from xylem.sources import schema, soap
from xylem.sources.shred import parse, shred

BOOKS = """<?xml version="1.0"?><!DOCTYPE bookstore><bookstore xml:lang="en"><!-- list -->
<book id="1" category="fiction"><title>A &amp; B</title><price>10.5</price><year>007</year></book>
<book id="2" category="web"><title><![CDATA[<x>]]></title><price>20</price><ok>TRUE</ok></book>
<p>one <b>two</b> three</p></bookstore>"""
PREFIXED = '<a:r xmlns:a="urn:a" xmlns="urn:d"><i a:k="v">1</i><a:j/><i xmlns="">2</i></a:r>'


def docs(spark, *xml):
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(xml)], "doc_id string, xml string")


@pytest.fixture(scope="module")
def books(spark):
    return shred(docs(spark, BOOKS)).cache()


def column(df, name):
    return [r[name] for r in df.orderBy("doc_id", "at").collect()]


def test_node_values(books):
    rows = {(r.path, r.pre): r for r in books.collect()}
    assert [r.text for r in rows.values() if r.name == "title"] == ["A & B", "<x>"]
    assert [r.num for r in rows.values() if r.name == "year"] == [None]
    assert [r.bool for r in rows.values() if r.name == "ok"] == [True]
    mixed = next(r for r in rows.values() if r.name == "p")
    assert mixed.text_nodes == ["one", "three"] and mixed.num is None
    root = rows["bookstore", 0]
    assert root.comments == ["list"] and root.lang == "en" and root.end_pre == len(rows) - 1


def test_malformed_modes(spark):
    bad = docs(spark, "<a><b></a>", "<a/>", "", None)
    rows = shred(bad, mode="PERMISSIVE").collect()
    assert sorted((r.doc_id, r._error is None) for r in rows) == [("0", False), ("1", True), ("2", False), ("3", False)]
    assert [r.doc_id for r in shred(bad, mode="DROPMALFORMED").collect()] == ["1"]
    with pytest.raises(Exception, match=r"document \d"):
        shred(bad).collect()
    with pytest.raises(ValueError, match="mode must be"):
        shred(bad, mode="x")


def test_parse_depth_limit():
    assert [n["name"] for n in parse("d", "<a><b><c/></b></a>", max_depth=1)] == ["a", "b"]


def test_axes_and_order(books):
    s = select(books)
    assert column(s.find("book").children_named("price").rows, "num") == [10.5, 20.0]
    assert column(s.find("price").closest("book").map(i=attribute("id")).withColumn("at", F.col("pos")), "i") == ["1", "2"]
    assert column(s.find("title").ancestors().rows, "name") == ["book", "bookstore", "book"]
    assert column(s.find("b").axis("preceding", "title").rows, "text") == ["A & B", "<x>"]
    assert column(s.breadth_first().take(4).rows, "name") == ["bookstore", "book", "book", "p"]
    assert s.find("title").descendants().rows.count() == 0
    with pytest.raises(ValueError, match="Did you mean 'child'"):
        s.axis("chld")


def test_nested_contexts_keep_repeats(spark):
    s = select(shred(docs(spark, "<a><a><b/></a></a>")))
    assert s.find("a").find("b").rows.count() == 2
    assert s.find("a").axis("descendant", "b").rows.count() == 1


def test_path_first_step_matches_self(books):
    s = select(books)
    assert s.path("bookstore", "book").rows.count() == 2
    assert s.path("book").rows.count() == 2
    assert s.path("//book", attribute("id") == "2", "..").rows.count() == 1


def test_filters(books):
    s = select(books).find("book")
    assert column(s.where_attribute_matches("category", "F*n").rows, "pre") == [1]
    assert s.where_attribute_matches("category", re.compile("^w.b$")).rows.count() == 1
    assert s.where_matches({"attributes.id": "1", "children.length": lambda n: n == 3}).rows.count() == 1
    assert s.where_index(lambda i: i == 1).has_attributes("id", "category").rows.count() == 1
    assert select(books).find("year").has_numeric_value().rows.count() == 0
    assert select(books).find("year").sum().first()["sum"] == 7.0


def test_empty_selection_aggregates(books):
    s = select(books).find("none")
    assert s.count().first()["count"] == 0 and s.sum().first()["sum"] == 0.0 and s.min().first()["min"] is None
    assert s.all(F.lit(False)).first()["all"] and s.texts().first()["texts"] == [] and s.to_json().first()["json"] is None


def test_slices(spark):
    s = select(shred(docs(spark, "<r>" + "".join(f"<i>{k}</i>" for k in range(6)) + "</r>"))).find("i")
    got = lambda x: column(x.rows, "num")
    assert got(s.take(2)) == [0, 1] and got(s.take(-2)) == [0, 1, 2, 3] and got(s.skip(-2)) == [4, 5]
    assert got(s.slice(-3, -1)) == [3, 4] and got(s.even()) == [0, 2, 4] and got(s.nth_child(-1)) == []
    assert got(s.reverse().take(2)) == [5, 4] and got(s.sort_by_value(False).take(1)) == [5]
    assert s.at(-1).first()["num"] == 5 and s.last().first()["num"] == 5
    with pytest.raises(ValueError):
        s.range(3, 2)
    with pytest.raises(ValueError):
        s.percentile(101)


def test_namespaces(spark):
    s = select(shred(docs(spark, PREFIXED)))
    assert s.find("i").rows.count() == 2 and s.namespace_uri("urn:d").rows.count() == 1
    assert s.with_namespaces({"q": "urn:a"}).find("q:j").rows.count() == 1
    assert s.find("j").get_prefix_for_namespace("urn:a").first()["prefix"] == "a"
    assert s.get_prefix_for_namespace("urn:d").first()["prefix"] is None
    with pytest.raises(ValueError, match="unknown namespace alias"):
        s.with_namespaces({}).find("z:i")


def test_json_and_text(books):
    out = json.loads(select(books).find("book").to_json().first()["json"])
    assert out[0] == {"@attributes": {"id": "1", "category": "fiction"}, "title": "A & B", "price": 10.5, "year": "007"}
    assert out[1]["ok"] is True
    lines = select(books).find("price").print_lines().first()["text"]
    assert lines == "    price = 10.5\n    price = 20"
    assert select(books).find("p").all_text().first()["all_text"].startswith("onethree")


def test_xml_round_trip(spark):
    text = '<r a="1&amp;&quot;"><x>1 &lt; 2</x><y/></r>'
    out = select(shred(docs(spark, text))).to_xml().first()["xml"]
    assert out == text


def test_mutation_encodes_anew(spark):
    n = shred(docs(spark, "<r><i>1</i><i>2</i><j><k/></j></r>"))
    n = mutate.append_child(select(n).find("j"), "new", F.lit("5"), {"z": F.lit("q")})
    n = mutate.replace_elements(select(n).find("i").take(1), "first", "9")
    assert select(n).to_xml().first()["xml"] == '<r><first>9</first><i>2</i><j><k/><new z="q">5</new></j></r>'
    n = mutate.remove_elements(select(n).find("i"))
    assert [(r.name, r.pre, r.end_pre, r.parent_pre, r.ord, r.n_children) for r in n.orderBy("pre").collect()] == [
        ("r", 0, 4, None, 0, 2), ("first", 1, 1, 0, 0, 0), ("j", 2, 4, 0, 1, 2), ("k", 3, 3, 2, 0, 0), ("new", 4, 4, 2, 1, 0)]
    n = mutate.update_elements(select(n).find("j"), name="J", attributes={"u": "1"})
    assert n.where("name = 'new'").first()["path"] == "r/J/new"
    n = mutate.remove_attr(select(n).find("J"), "u")
    assert n.where("name = 'J'").first()["attrs"] == {}


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_value_rules(spark):
    lit = F.lit
    assert one(spark, V.parse_float(lit("12abc"))) == 12.0 and one(spark, V.parse_float(lit("x"))) is None
    assert one(spark, V.number_text(lit(20.0))) == "20" and one(spark, V.number_text(lit(float("nan")))) == "NaN"
    assert one(spark, V.number_text(lit(0.5))) == "0.5" and one(spark, V.number_text(lit(15000000.5))) == "15000000.5"
    assert one(spark, V.substring(lit("12345"), 0, 3)) == "12" and one(spark, V.substring(lit("12345"), 2)) == "2345"
    assert one(spark, V.translate_in_turn(lit("abc"), "ab", "ba")) == "aac"
    assert one(spark, V.round_half_up(lit(-2.5))) == -2.0 and one(spark, V.divide(lit(1.0), lit(0.0))) == float("inf")
    assert one(spark, V.compare(lit("30"), "=", lit("30.0"))) is False and one(spark, V.compare(lit("9"), "<", lit("10"))) is True
    assert one(spark, V.normalize_space(lit("  a   b "))) == "a b" and one(spark, V.string_length(lit("🙂"))) == 2
    assert one(spark, V.like(lit("a\n"), re.compile("^a$"))) is False
    assert one(spark, V.escape_attribute(lit("<\t\"'&"))) == "&lt;&#9;&quot;&apos;&amp;"


RECORD = B.Record("p", (
    B.Member("id", "int", "attribute", required=True), B.Member("n", "decimal", facets=B.Facets(total_digits=3, min_exclusive=0.0)),
    B.Member("t", facets=B.Facets(min_length=2, max_length=3, white_space="collapse")), B.Member("k", fixed="x"),
    B.Member("v", "int", repeated=True, max_occurs=2), B.Member("flag", "boolean")))


def test_binding(spark):
    df = docs(spark, '<p id="1"><n>1.50</n><t> ab  c </t><v>1</v><v>2</v><v>3</v><flag>1</flag></p>', '<p><n>-1</n><t>a</t><flag>maybe</flag></p>')
    rows = B.bind(df, "xml", RECORD).orderBy("doc_id").collect()
    assert rows[0].record.id == 1 and rows[0].record.t == "ab c" and rows[0].record.v == [1, 2, 3] and rows[0].record.flag is True and rows[0].record.k == "x"
    assert {tuple(v) for v in rows[0].violations} == {("maxLength", "t"), ("maxOccurs", "v")}
    assert {tuple(v) for v in rows[1].violations} == {("required", "id"), ("minExclusive", "n"), ("minLength", "t"), ("dataType", "flag")}
    with pytest.raises(Exception, match="maxLength"):
        B.bind(df.where("doc_id = '0'"), "xml", RECORD, mode="strict").collect()
    assert "violations" not in B.bind(df, "xml", RECORD, mode="off").columns


def test_member_options(spark):
    record = B.Record("p", (
        B.Member("a", "int", nillable=True, default="7"), B.Member("b", ignored=True), B.Member("c", read=F.upper, write=F.lower),
        B.Member("d", kind="dynamic"), B.Member("e", "int", nillable=True, required=True)))
    xsi = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
    df = docs(
        spark, f'<p {xsi}><a xsi:nil="true"/><b>x</b><c>up</c><d><y k="1">t</y><z/><y>u</y></d><e xsi:nil="1"/></p>', "<p><a>5</a><e>6</e></p>", "<p><c>q</c></p>")
    got = B.bind(df, "xml", record).cache()
    rows = got.orderBy("doc_id").collect()
    assert [r.record.a for r in rows] == [None, 5, 7] and [r.record.e for r in rows] == [None, 6, None]
    assert rows[0].record.c == "UP" and "b" not in rows[0].record.asDict()
    assert [[tuple(v) for v in r.violations] for r in rows] == [[], [], [("required", "e")]]
    tree = B.subtree(got, "doc_id", "record.d").orderBy("pre").collect()
    assert [(r.doc_id, r.local_name, r.text or "") for r in tree] == [("0", "d", ""), ("0", "y", "t"), ("0", "z", ""), ("0", "y", "u")]
    assert B.subtree(got, "doc_id", "record.d", max_depth=0).count() == 1
    again = B.bind(B.unbind(got.select("doc_id", "record"), "record", record), "xml", record).orderBy("doc_id").collect()
    assert [(r.record.a, r.record.c, r.record.e) for r in again] == [(r.record.a, r.record.c, r.record.e) for r in rows]
    assert [r.local_name for r in B.subtree(spark.createDataFrame(again[:1], "doc_id string, record struct<a:int,c:string,d:string,e:int>, xml string, violations array<struct<rule:string,member:string>>"), "doc_id", "record.d").orderBy("pre").collect()] == ["d", "y", "z", "y"]


def test_records_of_nodes_with_other_prefixes(spark):
    record = B.Record("p:r", (B.Member("p:v", "int", column="v"), B.Member("id", "int", "attribute")))
    df = docs(spark, '<r xmlns="u" id="1"><v>1</v></r>', '<x:r xmlns:x="u" id="2"><x:v>2</x:v></x:r>', '<o:r xmlns:o="other" id="3"><o:v>3</o:v></o:r>')
    nodes = B.with_prefixes(shred(df), {"u": "p"})
    rows = B.bind_selection(select(nodes).where(F.col("name") == "p:r"), record).orderBy("doc_id").collect()
    assert [(r.doc_id, r.record.id, r.record.v, r.violations) for r in rows] == [("0", 1, 1, []), ("1", 2, 2, [])]
    plain = B.Record("r", (B.Member("v", "int"), B.Member("id", "int", "attribute")))
    typed = spark.createDataFrame([("k", (4, 9))], "key string, rec struct<v:int,id:int>")
    tree = B.record_nodes(typed, "key", "rec", plain).orderBy("pre").collect()
    assert [(r.doc_id, r.name, r.text or "", r.attrs) for r in tree] == [("k", "r", "", {"id": "9"}), ("k", "v", "4", {})]


def test_union_and_property_types(spark):
    assert one(spark, B.union_value(F.lit("1.5"))).number == 1.5 and one(spark, B.union_value(F.lit("True"))).boolean is True
    assert one(spark, B.property_coerce(F.lit("x"), "number")) == 0.0 and one(spark, B.property_coerce(F.lit("1"), "boolean")) is True


def test_prolog():
    assert B.prolog(standalone=True, doctype=("r", None, "r.dtd")) == '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<!DOCTYPE r SYSTEM "r.dtd">\n'


WSDL = """<definitions xmlns="http://schemas.xmlsoap.org/wsdl/" xmlns:s="http://schemas.xmlsoap.org/wsdl/soap/" name="svc">
<portType name="P"><operation name="Get"><input message="In"/><output message="Out"/></operation></portType>
<binding name="B" type="P"><operation name="Get"><s:operation soapAction="urn:get" style="document"/></operation></binding></definitions>"""


def test_schema_tables(spark):
    xsd = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:include schemaLocation="https://x/y.xsd"/>
    <xs:element name="a" abstract="true"/><xs:element name="b" substitutionGroup="a" type="xs:int"/><xs:complexType name="t"><xs:complexContent><xs:extension base="u"/></xs:complexContent></xs:complexType>
    <xs:element name="k"><xs:unique name="once"/></xs:element></xs:schema>"""
    n = schema.schema_nodes(docs(spark, xsd, WSDL)).cache()
    assert schema.substitutions(n).first().asDict() == {"doc_id": "0", "head": "a", "member": "b"}
    assert schema.external(n).first()["remote"] is True
    assert [(r.name, r.derived_by, r.base) for r in schema.types(n).collect()] == [("t", "extension", "u")]
    assert [r.construct for r in schema.notes(n).collect()] == ["unique"]
    op = schema.operations(n).first()
    assert (op.port_type, op.operation, op.input, op.output, op.action, op.style) == ("P", "Get", "In", "Out", "urn:get", "document")
    assert schema.sanitised("1-a b") == "_1_a_b" and schema.java_pattern("[a-z-[aeiou]]") == "[a-z&&[^aeiou]]"


def test_struct_of_schema(spark):
    xsd = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="p"><xs:complexType><xs:sequence>
    <xs:element name="n" type="xs:int"/><xs:element name="s" type="xs:string" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""
    kind = schema.struct_of(spark, xsd)
    assert kind.simpleString() == "struct<p:struct<n:int,s:array<string>>>"


def test_soap_header_attributes():
    assert soap.header_attributes("1.1", "s", True, "me") == ' s:mustUnderstand="1" s:actor="me"'
    assert soap.header_attributes("1.2", "s", True, "me", True) == ' s:mustUnderstand="true" s:role="me" s:relay="true"'


def test_stream_of_documents(spark, tmp_path):
    from xylem.streaming import document_stream, node_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text("<a><b>1</b></a>")
    out = node_stream(document_stream(spark, str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("nodes_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("nodes_out").count() == 2


def test_numbers_are_worked_out_after_what_is_kept(spark):
    """Typed values cost two patterns a node, where only those that a query asks for need them."""
    kept = []
    n = shred(docs(spark, "<r><i>1</i><i>true</i></r>"), keep=lambda parsed: kept.append(parsed) or parsed)
    assert "num" not in kept[0].columns and "pre" in kept[0].columns
    assert [(r.num, r.bool) for r in n.orderBy("pre").collect()] == [(None, None), (1.0, None), (None, True)]


def test_batches_of_good_and_bad_documents():
    from xylem.sources.shred import _Builder

    b = _Builder(True)
    b.read("a", '<a xml:lang="en"><b k="1">x</b><!-- c --><b/></a>')
    with pytest.raises(ValueError, match="mismatched"):
        b.read("b", '<a xmlns="u"><c>text<![CDATA[ more ]]></a>')
    b.error("b", "mismatched")
    b.read("c", '<p:a xmlns:p="u"><p:d/></p:a>')
    got = [(r["doc_id"], r["pre"], r["end_pre"], r["name"], r["ns_uri"], r["lang"], r["n_siblings"], r["comments"], r["_error"]) for r in b.batch(None).to_pylist()]
    assert got == [
        ("a", 0, 2, "a", None, "en", 1, ["c"], None), ("a", 1, 1, "b", None, "en", 2, [], None), ("a", 2, 2, "b", None, "en", 2, [], None),
        ("c", 0, 1, "p:a", "u", None, 1, [], None), ("c", 1, 1, "p:d", "u", None, 1, [], None), ("b", None, None, None, None, None, None, None, "mismatched")]
    assert b.batch(None).num_rows == 0


def test_small_tables_are_spread_before_they_are_parsed(spark):
    from xylem.plans import queries

    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").coalesce(1)
    assert queries.namespaced(customers).rdd.getNumPartitions() > 1 and queries.letters(customers).rdd.getNumPartitions() > 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_below_the_roots_neither_joins_nor_windows(spark, books):
    s = select(books)
    assert s.depth_first().once and s.descendants().distinct().once and not s.find("b").closest("p").once
    for x in (s.depth_first(), s.children(), s.descendants().distinct(), s.breadth_first()):
        assert "Join" not in plan(x.rows) and "Window" not in plan(x.rows)
    by_join = s.where(F.lit(True))  # all roots too, but not known to be
    for step in ("children", "descendants", "depth_first", "breadth_first"):
        a, b = getattr(s, step)().rows.select("pre", "at").collect(), getattr(by_join, step)().rows.select("pre", "at").collect()
        assert sorted((r.pre, r["at"]) for r in a) == sorted((r.pre, r["at"]) for r in b)


def test_mode_of_equally_frequent_numbers_is_the_first_seen(spark):
    texts = ["<r><i>3</i><i>1</i><i>1</i><i>3</i><i>2</i></r>", "<r><i>2</i><i>1</i><i>1</i></r>", "<r><j/></r>", "<r><i>x</i></r>"]
    got = select(shred(docs(spark, *texts))).find("i").mode().orderBy("doc_id").collect()
    assert [r.mode for r in got] == [3.0, 1.0, None, None]


def test_aggregates_of_one_selection_need_one_join(spark):
    from xylem.plans import QUERIES

    for name in ("median_mode_variance", "texts_values", "all_any_exists", "first_last_at"):
        assert plan(QUERIES[name](spark, "/root/testdata/sf0.001")).split("InMemoryRelation")[0].count("SortMergeJoin") == 1, name


def test_first_last_at_of_short_and_empty_lists(spark):
    s = select(shred(docs(spark, "<r><i>1</i><i>2</i></r>", "<r><i>5</i></r>", "<r/>"))).find("i")
    assert [sorted((r.doc_id, r.num) for r in x.collect()) for x in (s.first(), s.last(), s.at(1), s.at(-2))] == [[("0", 1.0), ("1", 5.0)], [("0", 2.0), ("1", 5.0)], [("0", 2.0)], [("0", 1.0)]]


def test_files_of_records_are_bounded(spark, tmp_path):
    from xylem.sources.shred import read_xml, write_records

    write_records(spark.range(25).repartition(1), f"{tmp_path}/x", "row", records_per_file=10)
    found = select(read_xml(spark, f"{tmp_path}/x")).find("row").count().collect()
    assert sorted(r["count"] for r in found) == [5, 10, 10]
