"""Results of selections: projections, folds, JSON, text, XML and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.store import growing, materialise


def quoted(x: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(x))
    return F.substr(array, F.lit(2), F.char_length(array) - 2)


def _attr_text(skip_xmlns: bool = False) -> Column:
    entries = F.map_entries(F.map_filter("attrs", lambda k, v: ~k.startswith("xmlns")) if skip_xmlns else F.col("attrs"))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), V.escape_attribute(e["value"]), F.lit('"'))), "")


def serialise(rows: DataFrame, keys: list[str], declaration: bool = False, self_closing: bool = True) -> DataFrame:
    """IO12, IO14: XML of the node rows of each key, from start and end tags in interval order, in one shuffle.

    A node's text comes before its children.
    """
    empty = (F.col("n_children") == 0) & (V.text_or_empty(F.col("text")) == "") & F.lit(self_closing)
    open_ = F.concat(F.lit("<"), "name", _attr_text(), F.when(empty, F.lit("/>")).otherwise(F.concat(F.lit(">"), V.escape_text(F.col("text")))))
    close = F.when(empty, F.lit("")).otherwise(F.concat(F.lit("</"), "name", F.lit(">")))
    tag = lambda a, b, c, x: F.struct(F.col(a).alias("a"), F.lit(b).alias("b"), c.cast("long").alias("c"), x.alias("x"))
    first, last = tag("pre", 0, F.lit(0), F.col("_open")), tag("end_pre", 1, -F.col("pre"), F.col("_close"))
    whole = tag("pre", 0, F.lit(0), F.concat("_open", "_close"))  # of a node without children
    tags = rows.withColumns({"_open": open_, "_close": close}).select(*keys, F.explode(F.when(F.col("n_children") > 0, F.array(first, last)).otherwise(F.array(whole))).alias("t"))
    body = F.array_join(F.sort_array(F.collect_list("t"))["x"], "")
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n' if declaration else "")
    return tags.groupBy(*keys).agg(F.concat(head, body).alias("xml"))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def folded(start: Column, merge: Callable[[Column, Column], Column], x: Column) -> Column:
    """A left fold in selection order, as an aggregate."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("at").alias("at"), x.alias("x"))))
    return F.aggregate(pairs, start, lambda acc, p: merge(acc, p["x"]))


def mapped(key: Column, val: Column) -> Column:
    """A map, as an aggregate; the last value of a key stands. Empty where no key is."""
    pairs = F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("k"), F.col("at").alias("at"), val.alias("v"))))
    placed = lambda ps: F.array_sort(F.transform(ps, lambda p, i: F.struct(p["k"].alias("k"), p["at"].alias("at"), i.alias("i"))))
    lasts = lambda by: F.filter(by, lambda o, i: ~F.get(by, i + 1)["k"].eqNullSafe(o["k"]))
    return _let(pairs, lambda ps: F.map_from_entries(F.transform(_let(placed(ps), lasts), lambda o: F.struct(o["k"].alias("key"), F.get(ps, o["i"])["v"].alias("value")))))


class Output:
    """Methods of a selection."""

    def map(self, **columns: Column) -> DataFrame:
        """OU01: columns of each selected node, with doc_id and its place."""
        return self.with_position("pos").rows.select("doc_id", F.col("pos"), *[c.alias(k) for k, c in columns.items()])

    def each(self, do: Callable) -> None:
        """OU02: calls a function with each selected row, on executors."""
        self.rows.foreach(do)

    def reduce(self, start: Column, merge: Callable[[Column, Column], Column], x: Column, name: str = "value") -> DataFrame:
        """OU03: a left fold in selection order."""
        return self.per_document(**{name: folded(start, merge, x)}).withColumn(name, F.coalesce(name, start))

    def to_map(self, key: Column, val: Column | None = None) -> DataFrame:
        """OU04: a map for each document that has a key; the last value of a key stands."""
        return self.per_document(False, map=mapped(key, F.col("text") if val is None else val)).where(F.size("map") > 0)

    def to_json(self, include_attributes: bool = True, include_metadata: bool = False, flatten_single: bool = True, simplify_leaves: bool = True) -> DataFrame:
        """OU05: doc_id and json; levels are folded into their parents from the deepest up, each written to the shared
        folder. null where nothing is selected."""
        sub = materialise(self.axis("descendant-or-self").rows.select("doc_id", "pre", "parent_pre", "depth", "ord", "name", "path", "text", "num", "bool", "attrs"), "json-nodes")
        deepest = sub.agg(F.max("depth")).first()[0] or 0
        number = V.number_text(F.col("num"))
        scalar = F.when(F.col("num").isNotNull(), number).when(F.col("bool").isNotNull(), F.col("bool").cast("string")).when(F.col("text").isNotNull(), quoted(F.col("text")))
        attrs = F.when((F.size("attrs") > 0) & F.lit(include_attributes), F.concat(F.lit('"@attributes":'), F.to_json("attrs")))
        meta = F.when(F.lit(include_metadata), F.concat(F.lit('"@metadata":'), F.to_json(F.struct("name", "depth", "path"))))
        text_part = F.when(V.text_or_empty(F.col("text")) != "", F.concat(F.lit('"#text":'), quoted(F.col("text"))))
        value_part = F.when(F.col("num").isNotNull(), F.concat(F.lit('"#value":'), number))
        bool_part = F.when(F.col("bool").isNotNull(), F.concat(F.lit('"#boolean":'), F.col("bool").cast("string")))
        obj = lambda *parts: F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), ","), F.lit("}"))
        leaf = F.coalesce(scalar, F.when(attrs.isNotNull(), obj(attrs)), F.lit("null")) if simplify_leaves else obj(attrs, meta, text_part, value_part, bool_part)
        done = None
        for depth in range(deepest, -1, -1):
            level = sub.where(F.col("depth") == depth)
            if done is None:
                level = level.withColumn("kids", F.lit(None).cast("string"))
            else:
                items = done.groupBy("doc_id", "parent_pre", "name").agg(
                    F.min("ord").alias("o"), F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda s: s["json"]).alias("js"))
                one = F.when((F.col("n") == 1) & F.lit(flatten_single), F.element_at("js", 1)).otherwise(F.concat(F.lit("["), F.array_join("js", ","), F.lit("]")))
                items = items.withColumn("entry", F.concat(quoted(F.col("name")), F.lit(":"), one))
                kids = items.groupBy(F.col("doc_id").alias("_d"), F.col("parent_pre").alias("_p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "entry"))), lambda s: s["entry"]), ",").alias("kids"))
                level = level.join(kids, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left").drop("_d", "_p")
            done_here = level.withColumn("json", F.when(F.col("kids").isNull(), leaf).otherwise(obj(attrs, meta, F.col("kids"), text_part))).select("doc_id", "pre", "parent_pre", "ord", "name", "json")
            done = materialise(done_here, "json")  # a level is read twice: by the one above and by what is selected
            tops = self.rows.where(F.col("depth") == depth).select("doc_id", "pre", "at").join(done.select("doc_id", "pre", "json"), ["doc_id", "pre"])
            found = tops if depth == deepest else found.unionByName(tops)  # noqa: F821
        sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("at", "json"))), lambda s: s["json"])
        out = found.groupBy("doc_id").agg(sorted_.alias("js"))
        whole = F.concat(F.lit("["), F.array_join("js", ","), F.lit("]"))
        json = F.when((F.size("js") == 1) & F.lit(flatten_single), F.element_at("js", 1)).otherwise(whole)
        docs = self.nodes.where(F.col("parent_pre").isNull()).select("doc_id")
        return growing(docs.join(out.select("doc_id", json.alias("json")), "doc_id", "left"))

    def print_lines(self, include_attributes: bool = True, include_values: bool = True) -> DataFrame:
        """OU06: doc_id and an indented text of the selected nodes."""
        attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), " ")
        line = F.concat(
            F.repeat(F.lit("  "), F.col("depth")), "name", F.when((F.size("attrs") > 0) & F.lit(include_attributes), F.concat(F.lit(" ["), attrs, F.lit("]"))).otherwise(""),
            F.when((V.text_or_empty(F.col("text")) != "") & F.lit(include_values), F.concat(F.lit(" = "), "text")).otherwise(""))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda s: s["line"]), "\n")
        return self.rows.groupBy("doc_id").agg(body.alias("text"))

    def stats(self) -> DataFrame:
        """OU07."""
        return self.rows.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("count"), F.count_if(V.text_or_empty(F.col("text")) != "").alias("with_text"), F.count_if(F.size("attrs") > 0).alias("with_attributes"),
            F.count_if(F.col("n_children") > 0).alias("with_children"), F.count_if(F.col("n_children") == 0).alias("leaf_nodes"),
            F.array_sort(F.collect_set("prefix")).alias("namespaces"), F.array_sort(F.collect_set("depth")).alias("depths"))

    def to_xml_strings(self, declaration: bool = False, self_closing: bool = True) -> DataFrame:
        """MU08: the XML of each selected node's subtree."""
        if self.rooted:
            return serialise(self.nodes, ["doc_id"], declaration, self_closing).select("doc_id", F.array(F.lit(0).cast("long")).alias("at"), "xml")
        sub = self._below().rows
        sub = sub.withColumn("at", F.slice("at", F.lit(1), F.size("at") - 1))
        return serialise(sub, ["doc_id", "at"], declaration, self_closing)

    def to_xml(self, declaration: bool = False, self_closing: bool = True) -> DataFrame:
        """MU09: the XML of the first selected node of each document."""
        return (self if self.rooted else self.take(1)).to_xml_strings(declaration, self_closing).select("doc_id", "xml")
