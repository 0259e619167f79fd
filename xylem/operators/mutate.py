"""Changes of node tables. A table is never changed in place: each function returns a new one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.store import growing, materialise
from .selection import Selection


def _marked(sel: Selection) -> DataFrame:
    """The node table with `_sel`, whether a node is selected."""
    chosen = sel.rows.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p")).distinct().withColumn("_hit", F.lit(True))
    out = sel.nodes.join(growing(chosen), (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left")
    return out.withColumn("_sel", F.coalesce("_hit", F.lit(False))).drop("_d", "_p", "_hit")


def _changed(sel: Selection, **columns: Column) -> DataFrame:
    rows = _marked(sel)
    fresh = {f"_new_{k}": F.when(F.col("_sel"), v).otherwise(F.col(k)) for k, v in columns.items()}
    rows = rows.withColumns(fresh)
    return rows.withColumns({k: F.col(f"_new_{k}") for k in columns}).drop("_sel", *fresh)


def without_key(m: str, key: str) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def set_attr(sel: Selection, name: str, value: Column | str) -> DataFrame:
    """MU01, MU15: value may be a column of the node."""
    value = F.lit(value) if isinstance(value, str) else value
    return _changed(sel, attrs=F.map_concat(without_key("attrs", name), F.create_map(F.lit(name), value.cast("string"))))


def remove_attr(sel: Selection, name: str) -> DataFrame:
    """MU02, MU16."""
    return _changed(sel, attrs=without_key("attrs", name))


def set_text(sel: Selection, text: Column | str) -> DataFrame:
    """MU03: the typed values follow the text."""
    text = F.lit(text) if isinstance(text, str) else text
    return _changed(sel, text=text, raw_text=text, num=V.typed_number(text), bool=V.typed_boolean(text))


def set_namespace_declaration(sel: Selection, prefix: str, uri: str) -> DataFrame:
    """MU17: an empty prefix is the default namespace."""
    name = f"xmlns:{prefix}" if prefix else "xmlns"
    put = lambda column, key: F.map_concat(without_key(column, key), F.create_map(F.lit(key), F.lit(uri)))
    return _changed(sel, xmlns=put("xmlns", prefix), attrs=put("attrs", name))


def update_elements(sel: Selection, *, name: str | None = None, namespace_uri: str | None = None, text: Column | str | None = None, attributes: dict[str, str] | None = None) -> DataFrame:
    """MU04, MU14: what is given is changed; a new name is carried into the paths below."""
    changes: dict[str, Column] = {}
    if namespace_uri is not None:
        changes["ns_uri"] = F.lit(namespace_uri)
    if text is not None:
        t = F.lit(text) if isinstance(text, str) else text
        changes |= {"text": t, "raw_text": t, "num": V.typed_number(t), "bool": V.typed_boolean(t)}
    if attributes:
        kept = F.map_filter("attrs", lambda k, v: ~k.isin(list(attributes)))
        changes["attrs"] = F.map_concat(kept, F.create_map(*[F.lit(x) for kv in attributes.items() for x in kv]))
    if name is not None:
        changes |= {"name": F.lit(name)}
    nodes = _changed(sel, **changes)
    return nodes if name is None else _paths(nodes)


def _paths(nodes: DataFrame) -> DataFrame:
    """Recomputes paths from names, by an equi-join on exploded ancestors."""
    nodes = growing(nodes)
    names = nodes.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("name").alias("_name"))
    up = nodes.select("doc_id", "pre", F.posexplode(F.concat(F.array("pre"), "anc_pres")).alias("level", "anc"))
    met = up.join(names, (F.col("doc_id") == F.col("_d")) & (F.col("anc") == F.col("_p")))
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "_name")), False), lambda s: s["_name"]), "/")
    paths = met.groupBy("doc_id", "pre").agg(path.alias("_path"))
    return nodes.join(paths, ["doc_id", "pre"]).withColumn("path", F.col("_path")).select(*nodes.columns)


def reencode(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Node rows anew from `_uid`, `_ups` (uids of ancestors, nearest first) and `_key`, which orders a document.

    Every count and place is recomputed by windows and joins within documents. Rows are written to the shared folder
    between steps, so that changes on changes do not repeat the work.
    """
    rows = rows.withColumn("pre", F.row_number().over(W.partitionBy("doc_id").orderBy("_key")).cast("long") - 1)
    rows = materialise(rows, "keyed")
    ids = rows.select(F.col("doc_id").alias("_d"), F.col("_uid").alias("_u"), F.col("pre").alias("_new"))
    up = rows.select("doc_id", F.col("pre").alias("_pre"), F.posexplode("_ups").alias("_level", "_anc"))
    up = up.join(ids, (F.col("doc_id") == F.col("_d")) & (F.col("_anc") == F.col("_u")))
    chains = up.groupBy("doc_id", "_pre").agg(F.transform(F.array_sort(F.collect_list(F.struct("_level", "_new"))), lambda s: s["_new"]).alias("_chain"))
    below = up.groupBy("doc_id", F.col("_new").alias("_pre")).agg(F.count(F.lit(1)).alias("_below"), F.count_if(F.col("_level") == 0).cast("int").alias("_kids"))
    out = rows.withColumn("_pre", F.col("pre")).join(chains, ["doc_id", "_pre"], "left").join(growing(below), ["doc_id", "_pre"], "left")
    out = out.withColumns({
        "anc_pres": F.coalesce("_chain", F.array().cast("array<bigint>")), "end_pre": F.col("pre") + F.coalesce("_below", F.lit(0)), "n_children": F.coalesce("_kids", F.lit(0))})
    out = out.withColumns({"parent_pre": F.try_element_at("anc_pres", F.lit(1)), "depth": F.size("anc_pres")})
    by_parent = W.partitionBy("doc_id", "parent_pre")
    out = out.withColumns({
        "ord": F.row_number().over(by_parent.orderBy("pre")) - 1, "n_siblings": F.count(F.lit(1)).over(by_parent).cast("int"),
        "ord_same_name": F.row_number().over(W.partitionBy("doc_id", "parent_pre", "name").orderBy("pre")) - 1})
    return _paths(materialise(out.select(*columns), "encoded"))


def _keyed(nodes: DataFrame) -> DataFrame:
    key = F.struct(F.col("pre").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("d"))
    return nodes.withColumns({"_uid": F.col("pre"), "_ups": F.col("anc_pres"), "_key": key})


def _without_subtrees(sel: Selection, whole: bool) -> DataFrame:
    """Nodes that lie in no selected subtree; with whole, the selected nodes go too."""
    gone = sel.rows.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p")).distinct()
    line = F.concat(F.array("pre"), F.col("anc_pres")) if whole else F.col("anc_pres")
    lines = sel.nodes.select("doc_id", "pre", F.explode(line).alias("_anc"))
    hit = lines.join(growing(gone), (F.col("doc_id") == F.col("_d")) & (F.col("_anc") == F.col("_p"))).select("doc_id", "pre").distinct()
    return sel.nodes.join(growing(hit), ["doc_id", "pre"], "left_anti").select(*sel.nodes.columns)


def remove_elements(sel: Selection) -> DataFrame:
    """MU05, MU12, MU13: selected nodes and what is below them; roots stay."""
    return reencode(_keyed(_without_subtrees(sel.where(F.col("parent_pre").isNotNull()), True)), sel.nodes.columns)


def clear_children(sel: Selection) -> DataFrame:
    """MU07."""
    return reencode(_keyed(_without_subtrees(sel, False)), sel.nodes.columns)


def child_row(parent: Callable[[str], Column], name: str, text: Column, attributes: dict[str, Column], namespace_uri: str | None) -> dict[str, Column]:
    """MU11: the columns of a new leaf below a node."""
    prefix, _, local = name.rpartition(":")
    pairs = [x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))]
    empty = F.create_map().cast("map<string,string>")
    return {
        "name": F.lit(name), "prefix": F.lit(prefix or None).cast("string"), "local_name": F.lit(local), "ns_uri": F.lit(namespace_uri).cast("string"),
        "text": text, "raw_text": text, "text_only": F.lit(True), "attrs": F.create_map(*pairs) if pairs else empty, "xmlns": empty, "ns_scope": parent("ns_scope"), "lang": parent("lang"),
        "path": F.concat(parent("path"), F.lit("/" + name)), "text_nodes": F.array().cast("array<string>"), "comments": F.array().cast("array<string>"), "_error": F.lit(None).cast("string"),
        "num": V.typed_number(text), "bool": V.typed_boolean(text),
    }


def append_child(sel: Selection, name: str, text: Column | str | None = None, attributes: dict[str, Column] | None = None, namespace_uri: str | None = None) -> DataFrame:
    """MU06, MU10: a new last child of each selected node; text and attributes may be columns of that node."""
    text = (F.lit(text) if text is None or isinstance(text, str) else text).cast("string")
    parents = sel.distinct().rows.drop("at")
    key = F.struct(F.col("end_pre").alias("a"), F.lit(1).alias("b"), (-F.col("depth")).cast("long").alias("c"), F.lit(0).cast("long").alias("d"))
    fresh = child_row(F.col, name, text, attributes or {}, namespace_uri)
    born = parents.select(
        "doc_id", (-F.col("pre") - 1).alias("_uid"), F.concat(F.array("pre"), F.col("anc_pres")).alias("_ups"), key.alias("_key"), *[v.alias(k) for k, v in fresh.items()])
    return reencode(_keyed(sel.nodes).unionByName(born, allowMissingColumns=True), sel.nodes.columns)


def replace_elements(sel: Selection, name: str, text: Column | str | None = None, attributes: dict[str, Column] | None = None) -> DataFrame:
    """MU18: a new leaf in the place of each selected node that has a parent."""
    text = (F.lit(text) if text is None or isinstance(text, str) else text).cast("string")
    chosen = sel.distinct().where(F.col("parent_pre").isNotNull())
    kept = _keyed(_without_subtrees(chosen, True))
    key = F.struct(F.col("pre").alias("a"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("d"))
    fresh = child_row(F.col, name, text, attributes or {}, None)
    born = chosen.rows.select("doc_id", F.col("pre").alias("_uid"), F.col("anc_pres").alias("_ups"), key.alias("_key"), *[v.alias(k) for k, v in fresh.items()])
    return reencode(kept.unionByName(born, allowMissingColumns=True), sel.nodes.columns)
