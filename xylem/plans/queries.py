"""Queries: documents made from tables, shredded, and run through the operators; with SQL on the tables as oracle.

The node tables of the five corpora last asked for are persisted, so that queries over one corpus share the shredding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import Selection, aggregates, mutate, output, select
from ..operators.selection import attribute, named
from ..sources import bind as B
from ..sources import corpora, schema, soap
from ..sources.shred import shred
from ..sources.store import growing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HELD = 5
_held: dict[tuple[str, str, str], tuple[DataFrame, DataFrame]] = {}  # nodes, and what of them is persisted; in order of last use


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f
    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def namespaced(customer: DataFrame, repeated: bool = False) -> DataFrame:
    """Documents with prefixes and default namespaces; repeated: with declarations on every element."""
    again = {"xmlns_n": F.lit("urn:customer"), "xmlns_x": F.lit("urn:extra")} if repeated else {}
    lang = F.when(F.col("c_nationkey") % 2 == 0, "en-GB").otherwise("de")
    key = corpora.leaf("key", F.col("c_nationkey"), **({"xmlns": F.lit("urn:region")} if repeated else {}))
    vip = corpora.leaf("x:vip", F.lit("yes"), since=F.lit("1"), **again)
    body = F.concat(
        corpora.leaf("n:name", F.col("c_name"), **again), corpora.element("region", key, xmlns=F.lit("urn:region")), F.when(F.col("c_custkey") % 3 == 0, vip).otherwise(""),
        corpora.leaf("plain", F.col("c_custkey"), xml_lang=F.lit("fr"), **({"xmlns": F.lit("")} if repeated else {})))
    root = corpora.element("n:customer", body, xmlns_n=F.lit("urn:customer"), xmlns_x=F.lit("urn:extra"), xml_lang=lang)
    return corpora.spread(customer, "c_custkey").select(F.col("c_custkey").cast("string").alias("doc_id"), root.alias("xml"))


def letters(customer: DataFrame) -> DataFrame:
    """Documents of mixed content, with prolog, CDATA and comments."""
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE letter>\n')
    body = F.concat(
        F.lit("<!-- "), F.col("c_mktsegment"), F.lit(" -->Dear "), corpora.leaf("b", F.col("c_name")), F.lit(", you owe "), corpora.leaf("i", corpora.money(F.col("c_acctbal"))), F.lit("<![CDATA[< all >]]><!-- end -->"))
    return corpora.spread(customer, "c_custkey").select(F.col("c_custkey").cast("string").alias("doc_id"), F.concat(head, corpora.element("letter", body, id=F.col("c_custkey"))).alias("xml"))


def supplier_documents(supplier: DataFrame) -> DataFrame:
    """A document for each nation with its suppliers; every fifth has no judgement."""
    active = F.when(F.col("s_suppkey") % 5 != 0, corpora.leaf("active", F.when(F.col("s_suppkey") % 2 == 1, "true").otherwise("FALSE"))).otherwise("")
    one = corpora.element("supplier", F.concat(corpora.leaf("name", F.col("s_name")), active, corpora.leaf("acctbal", corpora.money(F.col("s_acctbal")))), id=F.col("s_suppkey"))
    inner = corpora.gathered(supplier, "s_nationkey", "s_suppkey", one)
    return inner.select(F.col("_k").cast("string").alias("doc_id"), corpora.element("suppliers", F.col("_inner"), nation=F.col("_k")).alias("xml"))


def documents(spark: SparkSession, d: str, corpus: str) -> DataFrame:
    return {
        "customers": lambda: corpora.customer_documents(table(spark, d, "customer"), table(spark, d, "orders")),
        "orders": lambda: corpora.order_documents(table(spark, d, "lineitem")),
        "conversations": lambda: corpora.conversation_documents(table(spark, d, "conversations")),
        "parts": lambda: corpora.part_documents(table(spark, d, "part")),
        "namespaced": lambda: namespaced(table(spark, d, "customer")),
        "repeated": lambda: namespaced(table(spark, d, "customer"), True),
        "letters": lambda: letters(table(spark, d, "customer")),
        "suppliers": lambda: supplier_documents(table(spark, d, "supplier")),
    }[corpus]()


def nodes(spark: SparkSession, d: str, corpus: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, d, corpus)
    if key not in _held:
        made = documents(spark, d, corpus)
        for old in list(_held)[: max(0, len(_held) - HELD + 1)]:
            if old[0] == key[0]:
                _held[old][1].unpersist()
            del _held[old]
        kept: list[DataFrame] = []
        _held[key] = shred(made, keep=lambda parsed: kept.append(parsed.persist(StorageLevel.MEMORY_AND_DISK)) or kept[0]), kept[0]
    _held[key] = _held.pop(key)
    return _held[key][0]


def sel(spark: SparkSession, d: str, corpus: str) -> Selection:
    return select(nodes(spark, d, corpus))


def passing(spark: SparkSession, d: str, corpus: str, *columns: str) -> Selection:
    """A selection over nodes that are parsed as they are read and kept nowhere, with the frame and the named columns only.

    For queries that read their nodes once or twice: to keep all columns of all nodes takes longer than to parse again.
    """
    return select(shred(documents(spark, d, corpus), columns=columns))


def keyed(df: DataFrame, key: str, *cols) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias(key), *cols)


def order_ids(s: Selection) -> DataFrame:
    return keyed(s.map(id=attribute("id").cast("bigint")), "custkey", F.col("pos").cast("bigint").alias("pos"), "id")


# Documents by customer ----------------------------------------------------------------------------------------------

ORD = "(SELECT *, CAST(o_totalprice AS DECIMAL(15,2)) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


@query(f"""SELECT c_custkey AS custkey, round(CAST(coalesce(sum(total), 0) AS DOUBLE), 2) AS total
    FROM customer LEFT JOIN {ORD} o ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def find_where_sum(spark, d):
    out = sel(spark, d, "customers").find("order").where_attribute("status", "F").children_named("total").sum()
    return keyed(out, "custkey", F.round("sum", 2).alias("total"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Sums over an attribute filter and a child step, for each document."""
    return find_where_sum(spark, d)


@query("SELECT c_custkey AS custkey, 2 + count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def child_axis(spark, d):
    return keyed(sel(spark, d, "customers").children().count(), "custkey", F.col("count").alias("n"))


@query("SELECT c_custkey AS custkey, 2 + 3 * count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def descendant_axis(spark, d):
    return keyed(sel(spark, d, "customers").descendants().count(), "custkey", F.col("count").alias("n"))


@query("SELECT o_custkey AS custkey, 1 + count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def ancestor_axis(spark, d):
    out = sel(spark, d, "customers").find("total").ancestors().count()
    return keyed(out.where(F.col("count") > 0), "custkey", F.col("count").alias("n"))


@query("SELECT o_custkey AS custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS pos, o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey")
def closest_named(spark, d):
    return order_ids(sel(spark, d, "customers").find("date").closest("order"))


@query("SELECT o_custkey AS custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS pos, o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 150000", "parent_axis")
def parent_axis(spark, d):
    return order_ids(passing(spark, d, "customers", "attrs", "text").find("total").where_value_greater_than(150000).parent())


@query(f"SELECT o_custkey AS custkey, pos, o_orderkey AS id FROM {ORD} JOIN customer ON c_custkey = o_custkey WHERE pos = 1 OR pos = n")
def first_last_child(spark, d):
    s = sel(spark, d, "customers")
    last = s.last_child().where(F.col("name") == "order")
    first = s.child_at(2)
    both = first.union(last).rows
    pos = F.col("ord") - 1
    return keyed(both, "custkey", pos.cast("bigint").alias("pos"), attribute("id").cast("bigint").alias("id"))


@query(f"SELECT o_custkey AS custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS pos, o_orderkey AS id FROM {ORD} JOIN customer ON c_custkey = o_custkey WHERE total > 150000 AND o_orderstatus <> 'P'")
def xp_compare(spark, d):
    s = sel(spark, d, "customers").path("customer", "order").with_child_text("total", "t")
    return order_ids(s.where(V.compare(F.col("t"), ">", F.lit("150000")), V.compare(attribute("status"), "!=", F.lit("P"))))


@query(f"SELECT o_custkey AS custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS pos, o_orderkey AS id FROM {ORD} JOIN customer ON c_custkey = o_custkey WHERE (o_orderstatus = 'F' OR total < 50000) AND NOT contains(o_orderpriority, 'LOW')")
def xp_bool(spark, d):
    s = sel(spark, d, "customers").path("//order").with_child_text("total", "t")
    test = (V.compare(attribute("status"), "=", F.lit("F")) | V.compare(F.col("t"), "<", F.lit("50000"))) & ~attribute("priority").contains("LOW")
    return order_ids(s.where(test))


@query(f"SELECT o_custkey AS custkey, o_orderkey AS id, round(CAST(total AS DOUBLE) * 2 - 1, 2) AS twice, CAST(o_orderkey % 7 AS DOUBLE) AS rest, floor(CAST(total AS DOUBLE) / 3 + 0.5) AS third FROM {ORD} JOIN customer ON c_custkey = o_custkey")
def xp_arith(spark, d):
    s = sel(spark, d, "customers").path("//order").with_child_text("total", "t")
    x, i = V.parse_float(F.col("t")), V.parse_float(attribute("id"))
    return keyed(s.rows, "custkey", i.cast("bigint").alias("id"), F.round(x * 2 - 1, 2).alias("twice"), V.modulo(i, F.lit(7.0)).alias("rest"), V.round_half_up(V.divide(x, F.lit(3.0))).alias("third"))


@query("SELECT o_custkey AS custkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 10")
def xp_count(spark, d):
    s = passing(spark, d, "customers").with_count("order", "n")
    return keyed(s.where(F.col("n") > 10).rows, "custkey", "n")


@query(f"SELECT o_custkey AS custkey, CAST(sum(o_orderkey) AS DOUBLE) AS ids FROM {ORD} JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING sum(o_orderkey) > 50000")
def xp_sum(spark, d):
    s = passing(spark, d, "customers", "attrs", "text").with_sum("order", "ids", attribute="id")
    return keyed(s.where(F.col("ids") > 50000).rows, "custkey", "ids")


@query("""SELECT c_custkey AS custkey, CAST(1 AS BIGINT) AS pos, 'acctbal' AS name, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS text FROM customer
    UNION ALL SELECT c_custkey, 2, 'name', c_name FROM customer""")
def xp_union(spark, d):
    s = sel(spark, d, "customers")
    out = s.find("acctbal").union(s.find("name"), s.find("acctbal")).map(name=F.col("name"), text=F.col("text"))
    return keyed(out, "custkey", F.col("pos").cast("bigint").alias("pos"), "name", "text")


@query(f"SELECT o_custkey AS custkey, pos, n, o_orderkey AS id FROM {ORD} JOIN customer ON c_custkey = o_custkey WHERE pos = 2 OR pos = n")
def xp_position_last(spark, d):
    s = sel(spark, d, "customers").path("//order").with_position("pos", "n").where((F.col("pos") == 2) | (F.col("pos") == F.col("n")))
    return keyed(s.rows, "custkey", F.col("pos").cast("bigint").alias("pos"), F.col("n").cast("bigint").alias("n"), attribute("id").cast("bigint").alias("id"))


@query("SELECT CAST(s_nationkey AS BIGINT) AS nation, s_suppkey AS id FROM supplier WHERE s_suppkey % 5 = 0")
def xp_no_child(spark, d):
    return keyed(sel(spark, d, "suppliers").find("supplier").having_child("active", negate=True).rows, "nation", attribute("id").cast("bigint").alias("id"))


@query("""SELECT c_custkey AS custkey, CAST(length(c_name) AS INTEGER) AS len, substr(c_name, 1, 4) AS head, substr(c_name, 1, 2) AS clamped,
    CASE WHEN strpos(c_name, '#') > 0 THEN substr(c_name, 1, strpos(c_name, '#') - 1) ELSE '' END AS before,
    CASE WHEN strpos(c_name, '#') > 0 THEN substr(c_name, strpos(c_name, '#') + 1) ELSE '' END AS after,
    replace(replace(c_name, 'C', 'u'), 'u', 'C') AS swapped, c_name || '-' || c_mktsegment AS joined, starts_with(c_name, 'Cust') AS starts, ends_with(c_name, '7') AS ends FROM customer""")
def xp_string_functions(spark, d):
    s = sel(spark, d, "customers").with_child_text("name", "t")
    t = F.col("t")
    return keyed(
        s.rows, "custkey", V.string_length(t).alias("len"), V.substring(t, 1, 4).alias("head"), V.substring(t, 0, 3).alias("clamped"), V.substring_before(t, "#").alias("before"),
        V.substring_after(t, "#").alias("after"), V.translate_in_turn(t, "Cu", "uC").alias("swapped"), V.concat(t, F.lit("-"), attribute("seg")).alias("joined"), t.startswith("Cust").alias("starts"), t.endswith("7").alias("ends"))


@query("""SELECT CAST(p_partkey // 50 AS BIGINT) AS run, count(*) FILTER (p_size > 25) AS above, count(*) FILTER (p_size < 10) AS below, count(*) FILTER (p_size BETWEEN 10 AND 20) AS between_,
    count(*) FILTER (p_size = 7) AS equal_, 2 * count(*) AS numeric_ FROM part GROUP BY 1""")
def num_filters(spark, d):
    sizes = sel(spark, d, "parts").find("size")
    parts = {"above": sizes.where_value_greater_than(25), "below": sizes.where_value_less_than(10), "between_": sizes.where_value_between(10, 20), "equal_": sizes.where_value_equals(7), "numeric_": sel(spark, d, "parts").descendants().has_numeric_value()}
    out = None
    for name, s in parts.items():
        one = s.count().withColumnRenamed("count", name)
        out = one if out is None else out.join(one, "doc_id")
    return keyed(out, "run", *parts)


@query("""SELECT CAST(p_partkey // 50 AS BIGINT) AS run, p_partkey AS id FROM part WHERE p_name ILIKE '%a%' AND p_brand LIKE 'Brand#1%' AND NOT contains(p_type, 'STEEL')""")
def text_attr_filters(spark, d):
    s = sel(spark, d, "parts").find("part").has_attributes("id", "brand").where_attribute_matches("brand", "brand#1*").where_attribute_predicate("type", lambda x: ~x.contains("STEEL"))
    s = s.with_child_text("name", "t").where(V.like(F.col("t"), "*a*"))
    return keyed(s.rows, "run", attribute("id").cast("bigint").alias("id"))


@query("SELECT CAST(p_partkey // 50 AS BIGINT) AS run, count(*) AS parts, 3 * count(*) AS leaves, count(*) AS at_path, 3 * count(*) AS deep FROM part GROUP BY 1")
def structure_filters(spark, d):
    s = sel(spark, d, "parts").descendants()
    parts = {"parts": s.has_children().where_child_count(lambda n: n == 3), "leaves": s.is_leaf().at_depth(2), "at_path": s.where_path("parts/part/size"), "deep": s.where_path_matches("parts/part/*").min_depth(2).max_depth(2)}
    out = None
    for name, x in parts.items():
        one = x.count().withColumnRenamed("count", name)
        out = one if out is None else out.join(one, "doc_id")
    return keyed(out, "run", *parts)


@query(f"SELECT o_custkey AS custkey, o_orderstatus AS status, count(*) AS n, round(CAST(sum(o_orderkey) AS DOUBLE), 2) AS ids FROM {ORD} JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def group_by_attribute(spark, d):
    out = sel(spark, d, "customers").find("order").group_by_attribute("status", n=F.count(F.lit(1)), ids=F.sum(attribute("id").cast("double")))
    return keyed(out, "custkey", F.col("key").alias("status"), "n", F.round("ids", 2).alias("ids"))


@query("""WITH n AS (SELECT c_custkey AS k, count(o_orderkey) AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT k AS custkey, 0 AS depth, CAST(1 AS BIGINT) AS n FROM n UNION ALL SELECT k, 1, 2 + c FROM n UNION ALL SELECT k, 2, 2 * c FROM n WHERE c > 0""")
def group_by_depth(spark, d):
    out = sel(spark, d, "customers").depth_first().group_by_depth(n=F.count(F.lit(1)))
    return keyed(out, "custkey", F.col("key").alias("depth"), "n")


@query("""WITH n AS (SELECT c_custkey AS k, count(o_orderkey) AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT k AS custkey, u.name AS name, CASE WHEN u.name IN ('customer', 'name', 'acctbal') THEN 1 ELSE c END AS n FROM n, (VALUES ('customer'), ('name'), ('acctbal'), ('order'), ('total'), ('date')) u(name) WHERE c > 0 OR u.name IN ('customer', 'name', 'acctbal')""")
def group_by_name(spark, d):
    return keyed(sel(spark, d, "customers").breadth_first().group_by_name(n=F.count(F.lit(1))), "custkey", F.col("key").alias("name"), "n")


@query("""WITH f AS (SELECT o_custkey AS k, o_orderpriority AS v, min(o_orderkey) AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
    SELECT k AS custkey, string_agg(v, '|' ORDER BY m) AS priorities FROM f GROUP BY 1""")
def distinct_attrs(spark, d):
    out = passing(spark, d, "customers", "attrs").find("order").distinct_attributes("priority", every=False)
    return keyed(out.where(F.size("values") > 0), "custkey", F.array_join("values", "|").alias("priorities"))


@query(f"SELECT custkey, pos, id FROM (SELECT o_custkey AS custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY total DESC, o_orderkey) AS pos, o_orderkey AS id FROM {ORD} JOIN customer ON c_custkey = o_custkey) WHERE pos <= 3")
def sort_take(spark, d):
    s = sel(spark, d, "customers").find("order").with_child_text("total", "t")
    return order_ids(s.sort_by(V.parse_float(F.col("t")).desc()).take(3))


@query(f"SELECT o_custkey AS custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS pos, o_orderkey AS id FROM {ORD} JOIN customer ON c_custkey = o_custkey WHERE pos > 2 AND pos <= n - 1")
def slice_negative(spark, d):
    return order_ids(sel(spark, d, "customers").find("order").slice(2, -1))


@query(f"SELECT o_custkey AS custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY pos DESC) AS pos, o_orderkey AS id FROM {ORD} JOIN customer ON c_custkey = o_custkey WHERE (n - pos) % 2 = 1")
def reverse_odd(spark, d):
    return order_ids(sel(spark, d, "customers").find("order").reverse().odd())


@query(f"SELECT custkey, CAST(row_number() OVER (PARTITION BY custkey ORDER BY m) AS BIGINT) AS pos, m AS id FROM (SELECT o_custkey AS custkey, o_orderstatus, min(o_orderkey) AS m FROM {ORD} JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)")
def distinct_by(spark, d):
    return order_ids(sel(spark, d, "customers").find("order").distinct_by(attribute("status")))


@query(f"SELECT o_custkey AS custkey, CAST(1 AS BIGINT) AS pos, o_orderkey AS id FROM {ORD} JOIN customer ON c_custkey = o_custkey WHERE pos = 3")
def nth_and_range(spark, d):
    s = passing(spark, d, "customers", "attrs").find("order")
    return order_ids(s.range(1, 4).skip(1).nth_child(0))


@query("""WITH n AS (SELECT c_custkey AS k, count(o_orderkey) AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT k AS custkey, 3 + 3 * c AS "count", 2 + 2 * c AS with_text, 1 + c AS with_attributes, 1 + c AS with_children, 2 + 2 * c AS leaf_nodes, CASE WHEN c > 0 THEN 3 ELSE 2 END AS depths FROM n""")
def stats(spark, d):
    out = sel(spark, d, "customers").depth_first().stats()
    return keyed(out, "custkey", "count", "with_text", "with_attributes", "with_children", "leaf_nodes", F.size("depths").alias("depths"))


@query("""SELECT CAST(p_partkey // 50 AS BIGINT) AS run, string_agg('    size = ' || p_size, chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1""")
def print_lines(spark, d):
    return keyed(sel(spark, d, "parts").find("size").print_lines(), "run", "text")


@query(f"""SELECT o_custkey AS custkey, '[' || string_agg('{{"@attributes":{{"id":"' || o_orderkey || '","status":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}},"date":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}}', ',' ORDER BY o_orderkey) || ']' AS json
    FROM {ORD} JOIN customer ON c_custkey = o_custkey WHERE n > 1 GROUP BY 1""")
def to_json(spark, d):
    n = nodes(spark, d, "customers").where(~F.col("name").isin("total", "name", "acctbal"))
    out = select(n).find("order").to_json(flatten_single=True)
    return keyed(out.where(F.col("json").startswith("[")), "custkey", "json")


@query(f"SELECT o_custkey AS custkey, count(DISTINCT o_orderstatus) AS n, max(CASE WHEN pos = n THEN o_orderkey END) AS last FROM {ORD} JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def to_map_reduce(spark, d):
    s = passing(spark, d, "customers", "attrs").find("order")
    got = s.per_document(  # as to_map and reduce give them one by one, in one aggregation
        every=False, map=output.mapped(attribute("status"), attribute("id")), last=output.folded(F.lit(0).cast("bigint"), lambda acc, x: x, attribute("id").cast("bigint")))
    return keyed(got.where(F.size("map") > 0), "custkey", F.size("map").cast("bigint").alias("n"), "last")


# Documents by order -------------------------------------------------------------------------------------------------

@query("""WITH q AS (SELECT l_orderkey AS k, CAST(CAST(l_quantity AS DECIMAL(15,2)) AS DOUBLE) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
    m AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, min(i)) AS r FROM q GROUP BY k, v)
    SELECT q.k AS orderkey, median(q.v) AS median, round(var_pop(q.v), 4) AS variance, round(stddev_pop(q.v), 4) AS deviation, round(quantile_cont(q.v, 0.9), 4) AS p90, max(m.v) AS mode,
    min(q.v) AS low, max(q.v) AS high, round(avg(q.v), 4) AS mean FROM q JOIN m ON m.k = q.k AND m.r = 1 GROUP BY 1""")
def median_mode_variance(spark, d):
    s = sel(spark, d, "orders").find("qty")
    x = aggregates.value()  # as the methods of these names give them one by one, in one aggregation
    one = s.per_document(
        median=F.median(x), variance=F.var_pop(x), standard_deviation=F.stddev_pop(x), percentile=F.percentile(x, 0.9), min=F.min(x), max=F.max(x), average=F.avg(x), mode=aggregates.most_frequent(aggregates.in_order(x)))
    return keyed(
        one, "orderkey", "median", F.round("variance", 4).alias("variance"), F.round("standard_deviation", 4).alias("deviation"), F.round("percentile", 4).alias("p90"), "mode",
        F.col("min").alias("low"), F.col("max").alias("high"), F.round("average", 4).alias("mean"))


@query("SELECT l_orderkey AS orderkey, string_agg(CAST(CAST(l_discount AS DECIMAL(15,2)) AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS texts, CAST(count(*) AS INTEGER) AS n, max(l_returnflag) = min(l_returnflag) AS alike FROM lineitem GROUP BY 1")
def texts_values(spark, d):
    s = sel(spark, d, "orders")
    disc, item, ordered = named("disc"), named("item"), aggregates.in_order
    got = s.depth_first().where_any(disc, item).per_document(
        texts=ordered(F.when(disc & (F.col("text") != ""), F.col("text"))), values=ordered(F.when(disc, aggregates.value())), flags=F.array_distinct(ordered(F.when(item, attribute("flag")))))
    return keyed(got, "orderkey", F.array_join("texts", " ").alias("texts"), F.size("values").alias("n"), (F.size("flags") == 1).alias("alike"))


@query("SELECT l_orderkey AS orderkey, bool_and(l_quantity > 5) AS all_, bool_or(l_quantity > 45) AS any_, bool_or(l_returnflag = 'R') AS exists_ FROM lineitem GROUP BY 1")
def all_any_exists(spark, d):
    s = sel(spark, d, "orders")
    qty, returned = named("qty"), named("item") & (attribute("flag") == "R")
    out = s.depth_first().where_any(qty, returned).per_document(
        all_=F.bool_and(F.when(qty, F.col("num") > 5)), any_=F.bool_or(F.when(qty, F.col("num") > 45)), exists_=F.coalesce(F.bool_or(returned), F.lit(False)))
    return keyed(out, "orderkey", F.coalesce("all_", F.lit(True)).alias("all_"), F.coalesce("any_", F.lit(False)).alias("any_"), F.coalesce("exists_", F.lit(False)).alias("exists_"))


# Documents by conversation ------------------------------------------------------------------------------------------

@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations QUALIFY next_turn IS NOT NULL")
def next_sibling(spark, d):
    s = sel(spark, d, "conversations").find("turn")
    out = s.next_sibling().rows
    return keyed(out, "conv_id", (attribute("n").cast("bigint") * 0 + F.element_at("at", 1) - 1).alias("turn"), attribute("n").cast("bigint").alias("next_turn"))


@query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS last_turn FROM conversations QUALIFY last_turn IS NOT NULL")
def previous_sibling(spark, d):
    out = sel(spark, d, "conversations").find("turn").previous_sibling().rows
    return keyed(out, "conv_id", (F.element_at("at", 1) - 1).alias("turn"), attribute("n").cast("bigint").alias("last_turn"))


@query("SELECT conv_id, count(*) - 1 AS siblings, count(*) AS with_self FROM conversations GROUP BY 1")
def siblings(spark, d):
    s = sel(spark, d, "conversations").find_first("turn")
    out = s.siblings_named("turn").count().withColumnRenamed("count", "siblings").join(s.siblings_including_self().count().withColumnRenamed("count", "with_self"), "doc_id")
    return keyed(out, "conv_id", "siblings", "with_self")


@query("""SELECT conv_id, count(*) FILTER (r > 2) AS following, count(*) FILTER (r < 2) AS preceding, count(*) FILTER (r > 2) AS later, count(*) FILTER (r < 2) AS earlier
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1""")
def following_preceding(spark, d):
    s = sel(spark, d, "conversations").find("turn").nth_child(1)
    parts = {"following": s.following_nodes(), "preceding": s.preceding_nodes(), "later": s.axis("following-sibling", "turn"), "earlier": s.axis("preceding", "turn")}
    out = None
    for name, x in parts.items():
        one = x.count().withColumnRenamed("count", name)
        out = one if out is None else out.join(one, "doc_id")
    return keyed(out, "conv_id", *parts)


@query("SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS len FROM conversations WHERE role = 'user' AND text IS NOT NULL AND length(trim(text)) > 0")
def escaped_texts(spark, d):
    s = sel(spark, d, "conversations").find("turn").where_attribute("role", "user").has_text()
    return keyed(s.rows, "conv_id", attribute("n").cast("bigint").alias("turn"), attribute("role").alias("role"), F.char_length("raw_text").cast("bigint").alias("len"))


# Namespaces ---------------------------------------------------------------------------------------------------------

@query("SELECT c_custkey AS custkey, c_name AS name, CAST(c_nationkey AS VARCHAR) AS region, CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END AS prefixed, 2 AS defaulted, 'urn:extra' AS extra, 'n|x' AS prefixes FROM customer")
def namespaces(spark, d):
    s = sel(spark, d, "namespaced")
    ctx = s.with_namespaces({"a": "urn:customer"}).with_alias("r", "urn:region")
    one = lambda x, name: x.rows.select("doc_id", F.col("text").alias(name))
    out = one(ctx.find("a:name"), "name").join(one(ctx.find("r:key"), "region"), "doc_id")
    out = out.join(s.has_namespace().count().withColumnRenamed("count", "prefixed"), "doc_id").join(s.default_namespace().count().withColumnRenamed("count", "defaulted"), "doc_id")
    out = out.join(s.resolve_namespace("x").withColumnRenamed("uri", "extra"), "doc_id").join(s.find("plain").get_namespace_prefixes(), "doc_id")
    return keyed(out, "custkey", "name", "region", F.col("prefixed").cast("int").alias("prefixed"), F.col("defaulted").cast("int").alias("defaulted"), "extra", F.array_join("prefixes", "|").alias("prefixes"))


@query("SELECT c_custkey AS custkey, CAST(CASE WHEN c_nationkey % 2 = 0 THEN 4 + (c_custkey % 3 = 0)::INTEGER ELSE 0 END AS BIGINT) AS english, CAST(1 AS BIGINT) AS french FROM customer")
def lang_filter(spark, d):
    s = sel(spark, d, "namespaced").depth_first()
    en, fr = s.where(V.lang_is(F.col("lang"), "EN")).count(), s.where(V.lang_is(F.col("lang"), "fr")).count()
    return keyed(en.withColumnRenamed("count", "english").join(fr.withColumnRenamed("count", "french"), "doc_id"), "custkey", "english", "french")


@query("""SELECT c_custkey AS custkey, u.k AS key, u.n FROM customer, (VALUES ('n', CAST(2 AS BIGINT)), ('(no-namespace)', CAST(3 AS BIGINT)), ('x', CAST(1 AS BIGINT))) u(k, n) WHERE u.k <> 'x' OR c_custkey % 3 = 0""")
def group_by_namespace(spark, d):
    return keyed(sel(spark, d, "namespaced").depth_first().group_by_namespace(n=F.count(F.lit(1))), "custkey", "key", "n")


# Changes and XML output ---------------------------------------------------------------------------------------------

@query("""SELECT CAST(p_partkey // 50 AS BIGINT) AS run, '<parts run="' || (p_partkey // 50) || '">' || string_agg('<part id="' || p_partkey || '" brand="' || p_brand || '" type="' || p_type || '"><name>' || p_name || '</name><size>' || p_size || '</size><price>' || CAST(p_retailprice AS DECIMAL(15,2)) || '</price></part>', '' ORDER BY p_partkey) || '</parts>' AS xml FROM part GROUP BY p_partkey // 50""")
def serialise_roundtrip(spark, d):
    return keyed(sel(spark, d, "parts").to_xml(), "run", "xml")


@query("SELECT CAST(p_partkey // 50 AS BIGINT) AS run, p_partkey AS id, CASE WHEN p_size > 25 THEN 'yes' END AS big, CASE WHEN p_size > 25 THEN 'part' || p_partkey ELSE p_type END AS type FROM part")
def set_attr(spark, d):
    n = nodes(spark, d, "parts")
    n = mutate.set_attr(select(n).find("size").where_value_greater_than(25).parent(), "big", "yes")
    n = mutate.set_attr(select(n).find("part").has_attribute("big"), "type", F.concat(F.lit("part"), attribute("id")))
    return keyed(select(n).find("part").rows, "run", attribute("id").cast("bigint").alias("id"), attribute("big").alias("big"), attribute("type").alias("type"))


@query("SELECT CAST(p_partkey // 50 AS BIGINT) AS run, p_partkey AS id, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS place, CAST(3 * row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 2 AS BIGINT) AS pre FROM part WHERE p_size <= 25")
def remove_elements(spark, d):
    n = nodes(spark, d, "parts")
    n = mutate.remove_elements(select(n).find("size").where_value_greater_than(25).parent())
    n = mutate.remove_elements(select(n).find("price"))
    return keyed(select(n).find("part").rows, "run", attribute("id").cast("bigint").alias("id"), F.col("ord").cast("bigint").alias("place"), "pre")


@query("""SELECT CAST(p_partkey // 50 AS BIGINT) AS run, p_partkey AS id, string_agg(name, ',' ORDER BY i) AS children, max(CASE WHEN name = 'tag' THEN text END) AS tag FROM (
    SELECT p_partkey, unnest([0, 1, 2, 3]) AS i, unnest(['label', 'size', 'price', 'tag']) AS name, unnest([p_name, CAST(p_size AS VARCHAR), '', p_brand]) AS text FROM part) GROUP BY 1, 2""")
def append_rename(spark, d):
    n = nodes(spark, d, "parts")
    n = mutate.append_child(select(n).find("part"), "tag", attribute("brand"))
    n = mutate.update_elements(select(n).find("name"), name="label")
    kids = select(n).find("part").children().rows.groupBy("doc_id", "parent_pre").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda s: s["name"]), ",").alias("children"), F.max(F.when(F.col("path") == "parts/part/tag", F.col("text"))).alias("tag"))
    owner = select(n).find("part").rows.select("doc_id", F.col("pre").alias("parent_pre"), attribute("id").cast("bigint").alias("id"))
    return keyed(kids.join(growing(owner), ["doc_id", "parent_pre"]), "run", "id", "children", "tag")


@query("SELECT CAST(p_partkey // 50 AS BIGINT) AS run, count(*) AS cleared, CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE p_size END) AS DOUBLE) AS total FROM part GROUP BY 1")
def set_text_clear(spark, d):
    n = mutate.set_text(sel(spark, d, "parts").find("size").where_value_greater_than(25), "1")
    total = select(n).find("size").sum()
    cleared = select(mutate.clear_children(select(n).find("part"))).find("part").is_leaf().count()
    return keyed(cleared.join(total, "doc_id"), "run", F.col("count").alias("cleared"), F.col("sum").alias("total"))


# Typed records ------------------------------------------------------------------------------------------------------

ORDER = B.Record("order", (
    B.Member("id", "long", "attribute", "order_id", required=True),
    B.Member("status", "string", "attribute", enum_map={"F": "filled", "O": "open"}, facets=B.Facets(enum=("F", "O"))),
    B.Member("total", "decimal", column="total", facets=B.Facets(max_inclusive=150000.0, fraction_digits=1)),
    B.Member("date", "date", column="day", required=True, facets=B.Facets(pattern=r"\d{4}-\d{2}-\d{2}", min_inclusive="1993-01-01")),
    B.Member("note", "string", default="none"),
    B.Member("codes", "int", listed=True),
    B.Member("urgent", "boolean", choice="speed"), B.Member("slow", "boolean", choice="speed"),
), choices_required=("speed",))


def order_texts(spark: SparkSession, d: str) -> DataFrame:
    o = corpora.spread(table(spark, d, "orders"), "o_orderkey")
    speed = F.when(F.col("o_orderpriority").startswith("1"), "<urgent>1</urgent>").when(F.col("o_orderpriority").startswith("2"), "<urgent>true</urgent><slow>0</slow>").otherwise("")
    body = F.concat(
        corpora.leaf("total", corpora.money(F.col("o_totalprice"))), F.when(F.col("o_orderkey") % 5 != 0, corpora.leaf("date", F.date_format("o_orderdate", "yyyy-MM-dd"))).otherwise(""),
        corpora.leaf("codes", F.concat_ws(" ", F.col("o_orderkey") % 3, F.col("o_orderkey") % 4)), speed)
    return o.select(F.col("o_orderkey").alias("k"), corpora.element("order", body, id=F.col("o_orderkey"), status=F.col("o_orderstatus")).alias("xml"))


@query("""SELECT o_orderkey AS k, o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, round(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE), 2) AS total,
    CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, 'none' AS note, CAST(o_orderkey % 3 + o_orderkey % 4 AS BIGINT) AS codes,
    CASE WHEN o_orderpriority[1] IN ('1', '2') THEN true END AS urgent FROM orders""")
def typed_bind(spark, d):
    r = B.bind(order_texts(spark, d), "xml", ORDER).select("k", "record.*")
    return r.select("k", "order_id", "status", F.round(F.col("total").cast("double"), 2).alias("total"), F.date_format("day", "yyyy-MM-dd").alias("day"), "note", F.aggregate("codes", F.lit(0), lambda a, x: a + x).cast("bigint").alias("codes"), "urgent")


@query("""SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status:enumeration' END, CASE WHEN CAST(o_totalprice AS DECIMAL(15,2)) > 150000 THEN 'total:maxInclusive' END,
    CASE WHEN CAST(o_totalprice AS DECIMAL(15,2)) * 10 <> floor(CAST(o_totalprice AS DECIMAL(15,2)) * 10) THEN 'total:fractionDigits' END, CASE WHEN o_orderkey % 5 = 0 THEN 'day:required' END,
    CASE WHEN o_orderkey % 5 <> 0 AND CAST(o_orderdate AS DATE) < DATE '1993-01-01' THEN 'day:minInclusive' END, CASE WHEN o_orderpriority[1] = '2' THEN 'speed:choice' END, CASE WHEN o_orderpriority[1] NOT IN ('1', '2') THEN 'speed:choiceRequired' END) AS found FROM orders""")
def violations(spark, d):
    r = B.bind(order_texts(spark, d), "xml", ORDER)
    return r.select("k", F.array_join(F.transform("violations", lambda v: F.concat(v["member"], F.lit(":"), v["rule"])), ",").alias("found"))


@query("SELECT c_custkey AS k, c_name AS name, round(c_acctbal, 2) AS balance FROM customer")
def typed_write(spark, d):
    rec = B.Record("customer", (B.Member("key", "long", "attribute"), B.Member("name"), B.Member("balance", "decimal(15,2)")))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(15,2)").alias("balance")).alias("r"))
    xml = B.unbind(rows, "r", rec).select("k", "xml")
    return B.bind(xml, "xml", rec).select("k", "record.name", F.round(F.col("record.balance").cast("double"), 2).alias("balance"))


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def dangling_refs(spark, d):
    known = sel(spark, d, "customers").where_attribute("seg", "BUILDING").rows.select(attribute("id").cast("bigint").alias("c"))
    return table(spark, d, "orders").join(growing(known), F.col("o_custkey") == F.col("c"), "left_anti").select(F.col("o_orderkey").alias("id"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, CASE WHEN n_nationkey % 2 = 0 THEN '1.1' ELSE '1.2' END AS dialect, 'Client' AS code, n_name AS reason, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'r' END AS actor, 'why' AS detail FROM nation")
def soap_fault(spark, d):
    n = table(spark, d, "nation")
    old = F.concat(F.lit("<soap:Fault><faultcode>Client</faultcode>"), corpora.leaf("faultstring", F.col("n_name")), F.lit("<detail><why>x</why></detail></soap:Fault>"))
    new = F.concat(F.lit("<soap:Fault><soap:Code><soap:Value>Client</soap:Value></soap:Code><soap:Reason>"), corpora.leaf("soap:Text", F.col("n_name")), F.lit("</soap:Reason><soap:Role>r</soap:Role><soap:Detail><why>x</why></soap:Detail></soap:Fault>"))
    xml = F.when(F.col("n_nationkey") % 2 == 0, soap.envelope(old, "1.1")).otherwise(soap.envelope(new, "1.2"))
    out = soap.faults(shred(n.select(F.col("n_nationkey").alias("doc_id"), xml.alias("xml"))))
    return keyed(out, "nation", "dialect", "code", "reason", "actor", F.col("detail_name").alias("detail"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS nation, '1.2' AS dialect, '<name>' || n_name || '</name>' AS body, '<token>' || n_regionkey || '</token>' AS header FROM nation")
def soap_payload(spark, d):
    n = table(spark, d, "nation")
    xml = soap.envelope(corpora.leaf("name", F.col("n_name")), "1.2", "env", [corpora.leaf("token", F.col("n_regionkey"))])
    got = shred(n.select(F.col("n_nationkey").alias("doc_id"), xml.alias("xml")))
    body, head = soap.payloads(got), soap.payloads(got, "Header").select("doc_id", F.col("xml").alias("header"))
    return keyed(body.join(head, "doc_id"), "nation", "dialect", F.col("xml").alias("body"), "header")


@query("SELECT page_id, page_id % 2 = 0 AS well_formed FROM pages")
def pages_wellformed(spark, d):
    """Raw pages, none of which is well-formed, and by turns documents made of their addresses."""
    pages = table(spark, d, "pages")
    xml = F.when(F.col("page_id") % 2 == 0, corpora.leaf("page", F.col("url"), id=F.col("page_id"))).otherwise(F.col("html"))
    out = shred(pages.select("page_id", xml.alias("xml")), "page_id", "xml", mode="PERMISSIVE")
    return out.groupBy(F.col("doc_id").cast("bigint").alias("page_id")).agg(F.bool_and(F.col("_error").isNull()).alias("well_formed"))


@query("""SELECT * FROM (SELECT CAST(p_partkey // 50 AS BIGINT) AS run, u.owner, u.base, u.facet, CASE u.facet WHEN 'enumeration' THEN string_agg(p_brand, '|' ORDER BY p_partkey) ELSE max(u.v) END AS vals
    FROM part, (VALUES ('code', 'xs:string', 'enumeration', ''), ('code', 'xs:string', 'maxLength', '9'), ('digits', 'xs:decimal', 'pattern', '[0-9]{3}')) u(owner, base, facet, v) GROUP BY p_partkey // 50, 2, 3, 4)""")
def schema_facets(spark, d):
    from .methods import part_schemas

    n = schema.schema_nodes(part_schemas(spark, d))
    return keyed(schema.facets(n), "run", "owner", "base", "facet", F.array_join("values", "|").alias("vals"))
