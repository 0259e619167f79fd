"""Schemas of the XML schema language: Spark types by Spark's own reader, and facets, enumerations, operations and
coverage notes as tables that are selected from the schema's own node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.selection import attribute, select
from .bind import XSD_TYPES
from .shred import shred
from .store import growing

XSD = "http://www.w3.org/2001/XMLSchema"
WSDL = "http://schemas.xmlsoap.org/wsdl/"

# The constraining facets of the schema language, and what is read but not carried into types.
FACETS = ["length", "minLength", "maxLength", "pattern", "enumeration", "whiteSpace", "minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "totalDigits", "fractionDigits"]
NOTED = ["key", "keyref", "unique", "notation"]


def struct_of(spark: SparkSession, xsd: str) -> T.StructType:
    """CG08, CG09, CG11: the StructType of a schema text, by the reader that Spark's XML source has."""
    reader = spark._jvm.org.apache.spark.sql.execution.datasources.xml.XSDToSchema
    return T._parse_datatype_json_string(reader.read(xsd).json())


def ddl_of(spark: SparkSession, xsd: str) -> str:
    """CG18: the schema as DDL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in struct_of(spark, xsd))


def schema_nodes(schemas: DataFrame) -> DataFrame:
    """CG01, IO18: the node table of (doc_id, xml) schema or WSDL texts."""
    return shred(schemas, mode="PERMISSIVE")


def _xs(nodes: DataFrame, *names: str):
    return select(nodes)._search((F.col("ns_uri") == XSD) & F.col("local_name").isin(*names))


def _owner(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds `owner`: the name of the nearest named ancestor of each row."""
    up = rows.select("doc_id", F.col("pre").alias("_pre"), F.posexplode("anc_pres").alias("_level", "_anc"))
    named = nodes.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), attribute("name").alias("_name")).where(F.col("_name").isNotNull())
    near = up.join(growing(named), (F.col("doc_id") == F.col("_d")) & (F.col("_anc") == F.col("_p"))).groupBy("doc_id", "_pre").agg(F.min_by("_name", "_level").alias("owner"))
    near = near.withColumnsRenamed({"doc_id": "_doc", "_pre": "_node"})
    return rows.join(growing(near), (F.col("pre") == F.col("_node")) & (F.col("doc_id") == F.col("_doc")), "left").drop("_doc", "_node")


def elements(nodes: DataFrame) -> DataFrame:
    """CG02, CG05, CG12, CG14: elements and attributes with type, occurrence and default.

    compositor is the nearest sequence, choice or all around an element. place counts an owner's elements in the order of
    the schema, whatever compositors they are nested in: those of a nested choice stand where the choice does. Within a
    choice or an all that order binds no document.
    """
    rows = _owner(nodes, _xs(nodes, "element", "attribute").rows)
    around = rows.select("doc_id", F.col("pre").alias("_pre"), F.posexplode("anc_pres").alias("_level", "_anc"))
    model = _xs(nodes, "sequence", "choice", "all").rows.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("local_name").alias("_model"))
    near = around.join(growing(model), (F.col("doc_id") == F.col("_d")) & (F.col("_anc") == F.col("_p"))).groupBy(F.col("doc_id").alias("_doc"), F.col("_pre").alias("_node")).agg(F.min_by("_model", "_level").alias("compositor"))
    rows = rows.join(growing(near), (F.col("pre") == F.col("_node")) & (F.col("doc_id") == F.col("_doc")), "left").drop("_doc", "_node")
    rows = rows.withColumn("place", F.when(F.col("compositor").isNotNull(), F.row_number().over(W.partitionBy("doc_id", "owner", F.col("compositor").isNotNull()).orderBy("pre"))))
    many = attribute("maxOccurs")
    return rows.select(
        "doc_id", "pre", "owner", "compositor", "place", F.col("local_name").alias("kind"), F.coalesce(attribute("name"), attribute("ref")).alias("name"), attribute("type").alias("type"),
        F.coalesce(attribute("minOccurs").cast("int"), F.lit(1)).alias("min_occurs"), F.when(many != "unbounded", many.try_cast("int")).when(many.isNull(), 1).alias("max_occurs"),
        F.coalesce(attribute("nillable") == "true", F.lit(False)).alias("nillable"), attribute("default").alias("default"), attribute("fixed").alias("fixed"),
        attribute("use").alias("use"), attribute("substitutionGroup").alias("substitution_group"), F.coalesce(attribute("abstract") == "true", F.lit(False)).alias("abstract"))


def types(nodes: DataFrame) -> DataFrame:
    """CG03: named and anonymous types with their base and how they derive from it."""
    kinds = _owner(nodes, _xs(nodes, "complexType", "simpleType").rows)
    steps = _xs(nodes, "extension", "restriction", "list", "union").rows
    base = steps.select(F.col("doc_id").alias("_d"), F.explode("anc_pres").alias("_anc"), F.col("local_name").alias("derived_by"), F.coalesce(attribute("base"), attribute("itemType"), attribute("memberTypes")).alias("base"), F.col("pre").alias("_at"))
    met = kinds.join(growing(base), (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_anc")), "left")
    return met.groupBy("doc_id", "pre", F.coalesce(attribute("name"), F.col("owner")).alias("name"), F.col("local_name").alias("kind")).agg(F.min_by("derived_by", "_at").alias("derived_by"), F.min_by("base", "_at").alias("base"))


def facets(nodes: DataFrame) -> DataFrame:
    """CG04: (owner, base, facet, values) of each restriction; several patterns of one step are alternatives."""
    rows = _owner(nodes, _xs(nodes, *FACETS).rows)
    up = nodes.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), attribute("base").alias("base"))
    rows = rows.join(growing(up), (F.col("doc_id") == F.col("_d")) & (F.col("parent_pre") == F.col("_p")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pre", attribute("value").alias("v")))), lambda s: s["v"])
    return rows.groupBy("doc_id", "parent_pre", "owner", "base", F.col("local_name").alias("facet")).agg(listed.alias("values")).drop("parent_pre")


def enumerations(nodes: DataFrame) -> DataFrame:
    """CG20: a row for each token of each enumerated type."""
    return facets(nodes).where(F.col("facet") == "enumeration").select("doc_id", "owner", F.posexplode("values").alias("place", "token"))


def lexical_overrides(nodes: DataFrame) -> DataFrame:
    """CG10: number types with a pattern, whose values stay text, so that their written form is kept (`000`, `1.50`)."""
    patterned = facets(nodes).where(F.col("facet") == "pattern").select("doc_id", F.col("owner").alias("name"), "base", F.col("values").alias("patterns"))
    return patterned.where(F.element_at(F.split("base", ":"), -1).isin(*[k for k, v in XSD_TYPES.items() if v not in ("string", "boolean", "date", "timestamp", "array<string>")]))


def external(nodes: DataFrame) -> DataFrame:
    """CG06: include, import and redefine references; remote places are marked, not fetched."""
    where = attribute("schemaLocation")
    return _xs(nodes, "include", "import", "redefine").rows.select("doc_id", F.col("local_name").alias("kind"), attribute("namespace").alias("namespace"), where.alias("location"), F.coalesce(where.rlike("^https?://"), F.lit(False)).alias("remote"))


def substitutions(nodes: DataFrame) -> DataFrame:
    """CG13: heads of substitution groups and their members."""
    return elements(nodes).where(F.col("substitution_group").isNotNull()).select("doc_id", F.element_at(F.split("substitution_group", ":"), -1).alias("head"), F.col("name").alias("member"))


def notes(nodes: DataFrame) -> DataFrame:
    """CG21: constructs that no type carries."""
    rows = _xs(nodes, *NOTED).rows.select("doc_id", F.col("local_name").alias("construct"), attribute("name").alias("name"))
    barred = elements(nodes).where(F.col("use") == "prohibited").select("doc_id", F.lit("prohibited attribute").alias("construct"), "name")
    return rows.unionByName(barred)


def operations(nodes: DataFrame) -> DataFrame:
    """CG07, CG24: operations of a WSDL with messages, fault and action."""
    ops = select(nodes)._search((F.col("ns_uri") == WSDL) & (F.col("local_name") == "operation")).rows
    up = nodes.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("local_name").alias("holder"), attribute("name").alias("port_type"))
    ops = ops.join(growing(up), (F.col("doc_id") == F.col("_d")) & (F.col("parent_pre") == F.col("_p"))).drop("_d", "_p")
    ops = ops.select("doc_id", F.col("pre").alias("o_pre"), "holder", "port_type", attribute("name").alias("operation"))
    kids = nodes.select(F.col("doc_id").alias("_d"), F.col("parent_pre").alias("_p"), F.col("local_name").alias("part"), attribute("message").alias("message"), attribute("soapAction").alias("action"), attribute("style").alias("style"))
    met = ops.join(growing(kids), (F.col("doc_id") == F.col("_d")) & (F.col("o_pre") == F.col("_p")), "left")
    pick = lambda part, x: F.max(F.when(F.col("part") == part, F.col(x)))
    ports = met.where(F.col("holder") == "portType").groupBy("doc_id", "port_type", "operation").agg(pick("input", "message").alias("input"), pick("output", "message").alias("output"), pick("fault", "message").alias("fault"))
    bindings = met.where(F.col("holder") == "binding").groupBy("doc_id", "operation").agg(pick("operation", "action").alias("action"), pick("operation", "style").alias("style"))
    return ports.join(growing(bindings), ["doc_id", "operation"], "left")


def sanitised(name: str) -> str:
    """CG15: a column name of letters, digits and underscores that doesn't begin with a digit."""
    out = "".join(c if c.isalnum() else "_" for c in name).strip("_") or "_"
    return f"_{out}" if out[0].isdigit() else out


def java_pattern(pattern: str) -> str:
    r"""CG16: a schema pattern for Java's expressions: \i and \c are spelt out, class subtraction is an intersection."""
    out = pattern.replace(r"\i", r"[\p{L}_:]").replace(r"\c", r"[\p{L}\p{N}_:.\-·]")
    import re

    return re.sub(r"-\[([^\]]*)\]\]", r"&&[^\1]]", out)
