"""SOAP envelopes as columns: wrapping bodies, and reading bodies, headers and faults from node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.selection import select

# The namespaces of the two dialects.
DIALECTS = {
    "1.1": "http://schemas.xmlsoap.org/soap/envelope/",
    "1.2": "http://www.w3.org/2003/05/soap-envelope",
}


def dialect_of(namespace: Column) -> Column:
    """SO05: the version of an envelope's namespace."""
    out = F.lit(None).cast("string")
    for version, uri in DIALECTS.items():
        out = F.when(namespace == uri, version).otherwise(out)
    return out


def header_attributes(version: str, prefix: str, must_understand: bool = False, actor: str | None = None, relay: bool = False) -> str:
    """Attributes of a header block in a dialect."""
    out = ""
    if must_understand:
        out += f' {prefix}:mustUnderstand="{"1" if version == "1.1" else "true"}"'
    if actor:
        out += f' {prefix}:{"actor" if version == "1.1" else "role"}="{actor}"'
    return out + (f' {prefix}:relay="true"' if relay and version == "1.2" else "")


def envelope(body: Column, version: str = "1.1", prefix: str = "soap", headers: list[Column] | None = None) -> Column:
    """SO01: the XML of an envelope around the XML of a body and of header blocks."""
    head = F.concat(F.lit(f"<{prefix}:Header>"), *headers, F.lit(f"</{prefix}:Header>")) if headers else F.lit("")
    return F.concat(F.lit(f'<{prefix}:Envelope xmlns:{prefix}="{DIALECTS[version]}">'), head, F.lit(f"<{prefix}:Body>"), F.coalesce(body, F.lit("")), F.lit(f"</{prefix}:Body></{prefix}:Envelope>"))


def _part(nodes: DataFrame, name: str, depth: int) -> DataFrame:
    return nodes.where((F.col("local_name") == name) & (F.col("depth") == depth) & F.col("ns_uri").isin(list(DIALECTS.values())))


def payloads(nodes: DataFrame, part: str = "Body") -> DataFrame:
    """SO02, SO03: doc_id, dialect, place, name and XML of each child of the body (or header) of each envelope."""
    top = select(nodes).where((F.col("local_name") == "Envelope") & F.col("ns_uri").isin(list(DIALECTS.values())))
    holder = top.children().where((F.col("local_name") == part) & F.col("ns_uri").isin(list(DIALECTS.values())))
    kids = holder.children()
    xml = kids.to_xml_strings()
    meta = kids.rows.select("doc_id", "at", "ord", "local_name", "ns_uri")
    kind = top.rows.select("doc_id", dialect_of(F.col("ns_uri")).alias("dialect"))
    return meta.join(xml, ["doc_id", "at"]).join(kind, "doc_id").select("doc_id", "dialect", "ord", "local_name", "ns_uri", "xml")


def faults(nodes: DataFrame) -> DataFrame:
    """SO04: doc_id and the fault of each envelope that holds one: code, reason, actor and the detail's first child."""
    fault = _part(nodes, "Fault", 2).select("doc_id", F.col("pre").alias("f_pre"), F.col("end_pre").alias("f_end"), dialect_of(F.col("ns_uri")).alias("dialect"))
    inside = nodes.join(fault, "doc_id").where((F.col("pre") > F.col("f_pre")) & (F.col("pre") <= F.col("f_end")))
    old, new = F.col("dialect") == "1.1", F.col("dialect") == "1.2"
    rel = F.col("depth") - 3
    pick = lambda c11, c12, x=F.col("text"): F.min_by(F.when((old & c11) | (new & c12), x), F.when((old & c11) | (new & c12), F.col("pre")))
    at = lambda d, n: (rel == d) & (F.col("local_name") == n)
    under = lambda parent, n: (rel == 1) & (F.col("local_name") == n) & F.col("path").rlike(f"[:/]{parent}/[^/]*$")
    below_detail = (rel == 1) & F.col("path").rlike("[:/][dD]etail/[^/]*$")
    return inside.groupBy("doc_id", "dialect").agg(
        pick(at(0, "faultcode"), under("Code", "Value")).alias("code"), pick(at(0, "faultstring"), under("Reason", "Text")).alias("reason"),
        pick(at(0, "faultactor"), at(0, "Role")).alias("actor"), pick(below_detail, below_detail, F.col("local_name")).alias("detail_name"))


__all__ = ["DIALECTS", "dialect_of", "envelope", "faults", "header_attributes", "payloads"]
