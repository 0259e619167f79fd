"""Typed records: XML to and from Spark schemas, with defaults, coercions and constraints.

A `Record` lists members; it gives a StructType for Spark's own `from_xml`, the expressions that finish the bound
values, an array of violations, and the struct that `to_xml` writes. Everything is column expressions.

Members are found by their written name. Where documents differ in prefixes, `with_prefixes` brings their node tables
to one prefix for each namespace first.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.selection import Selection
from .shred import shred
from .store import growing

XSI = "http://www.w3.org/2001/XMLSchema-instance"
NIL = "@_xsi:nil"

# Spark types of the schema language's built-in types.
XSD_TYPES = {
    "string": "string", "normalizedString": "string", "token": "string", "language": "string", "Name": "string", "NCName": "string", "NMTOKEN": "string", "ID": "string",
    "IDREF": "string", "ENTITY": "string", "NOTATION": "string", "anyURI": "string", "QName": "string", "anySimpleType": "string", "time": "string", "duration": "string",
    "gYear": "string", "gYearMonth": "string", "gMonth": "string", "gMonthDay": "string", "gDay": "string", "base64Binary": "string", "hexBinary": "string",
    "byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "unsignedByte": "smallint", "unsignedShort": "int", "unsignedInt": "bigint",
    "unsignedLong": "decimal(20,0)", "integer": "decimal(38,0)", "nonNegativeInteger": "decimal(38,0)", "positiveInteger": "decimal(38,0)",
    "nonPositiveInteger": "decimal(38,0)", "negativeInteger": "decimal(38,0)", "decimal": "decimal(38,18)", "float": "float", "double": "double",
    "boolean": "boolean", "date": "date", "dateTime": "timestamp", "NMTOKENS": "array<string>", "IDREFS": "array<string>", "ENTITIES": "array<string>",
}


@dataclass(frozen=True)
class Facets:
    """VA01-VA07: constraints of a value; None is no constraint."""

    pattern: str | None = None
    enum: tuple[str, ...] | None = None
    length: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    min_inclusive: float | str | None = None
    max_inclusive: float | str | None = None
    min_exclusive: float | str | None = None
    max_exclusive: float | str | None = None
    total_digits: int | None = None
    fraction_digits: int | None = None
    white_space: str = "preserve"


@dataclass(frozen=True)
class Member:
    """BI02-BI08, BI12: an element, attribute, text, list or dynamic member of a record.

    An ignored member is neither read nor written (BI08). `read` and `write` are applied to the bound and to the
    written value (BI12). A nillable element is null where it has xsi:nil, and is written so (BI21). A dynamic member
    holds an element of any content as XML (BI07), which `subtree` turns into nodes.
    """

    name: str
    type: str = "string"
    kind: str = "element"  # element, attribute, text, dynamic
    column: str | None = None
    required: bool = False
    default: str | None = None
    fixed: str | None = None
    repeated: bool = False
    wrapper: str | None = None  # of a repeated element
    listed: bool = False  # values apart by white space
    record: Record | None = None
    enum_map: dict[str, str] | None = None
    choice: str | None = None
    min_occurs: int = 0
    max_occurs: int | None = None
    facets: Facets = field(default_factory=Facets)
    ignored: bool = False
    nillable: bool = False
    read: Callable[[Column], Column] | None = None
    write: Callable[[Column], Column] | None = None

    @property
    def out(self) -> str:
        return self.column or self.name

    @property
    def tag(self) -> str:
        return {"attribute": f"@_{self.name}", "text": "#text"}.get(self.kind, self.name)


@dataclass(frozen=True)
class Record:
    """BI01, BI09: a complex type."""

    name: str
    members: tuple[Member, ...]
    choices_required: tuple[str, ...] = ()

    @property
    def used(self) -> list[Member]:
        return [m for m in self.members if not m.ignored]

    def raw_schema(self) -> T.StructType:
        """Everything as text, as it is written."""
        fields = []
        for m in self.used:
            kind: T.DataType = m.record.raw_schema() if m.record else T.StringType()
            if m.nillable:
                kind = T.StructType([T.StructField("#text", kind), T.StructField(NIL, T.StringType())])
            if m.repeated:
                kind = T.ArrayType(kind)
                if m.wrapper:
                    kind = T.StructType([T.StructField(m.name, kind)])
            fields.append(T.StructField(m.wrapper if m.repeated and m.wrapper else m.tag, kind, metadata=json.loads(json.dumps({"required": m.required, "kind": m.kind}))))
        return T.StructType(fields)


def white_space(x: Column, rule: str) -> Column:
    """VA07: preserve, replace or collapse."""
    if rule == "preserve":
        return x
    x = F.translate(x, "\t\r\n", "   ")
    return x if rule == "replace" else F.trim(F.regexp_replace(x, " {2,}", " "))


def coerce(x: Column, type_: str) -> Column:
    """VA09: a text as a type, null where it isn't one."""
    spark = XSD_TYPES.get(type_, type_)
    if spark == "boolean":
        return F.when(x.isin("true", "1"), True).when(x.isin("false", "0"), False)
    return x if spark == "string" else x.try_cast(spark)


def property_coerce(x: Column, type_: str) -> Column:
    """VA10: by a default's type: what is no number is 0, what isn't true is false."""
    if type_ == "boolean":
        return F.coalesce(x.isin("true", "1"), F.lit(False))
    return F.coalesce(x.try_cast("double"), F.lit(0.0)) if type_ == "number" else x.cast("string")


def union_value(x: Column) -> Column:
    """VA11: struct of the first of number, boolean and text that fits."""
    number = x.try_cast("double")
    truth = F.when(number.isNull(), F.when(F.lower(x).isin("true", "false"), F.lower(x) == "true"))
    return F.struct(number.alias("number"), truth.alias("boolean"), F.when(number.isNull() & truth.isNull(), x).alias("text"))


def list_value(x: Column, type_: str = "string") -> Column:
    """VA08: a text's items."""
    return F.transform(F.filter(F.split(F.trim(x), r"\s+"), lambda i: i != ""), lambda i: coerce(i, type_))


def violations(x: Column, m: Member) -> list[tuple[str, Column]]:
    """VA01-VA06: rule names and the conditions under which a raw text violates them."""
    f, out = m.facets, []
    spark = XSD_TYPES.get(m.type, m.type)
    size = F.octet_length(F.unbase64(x)) if m.type == "base64Binary" else F.char_length(x) / 2 if m.type == "hexBinary" else F.size(list_value(x)) if m.listed else F.char_length(x)
    if f.pattern is not None:
        out.append(("pattern", ~x.rlike(rf"\A(?:{f.pattern})\z")))
    if f.enum is not None:
        out.append(("enumeration", ~x.isin(*f.enum)))
    out += [(rule, bad(size, v)) for rule, v, bad in (("length", f.length, lambda a, b: a != b), ("minLength", f.min_length, lambda a, b: a < b), ("maxLength", f.max_length, lambda a, b: a > b)) if v is not None]
    typed = x if spark == "string" else coerce(x, m.type)
    number = x.try_cast("decimal(38,10)")
    for rule, v, bad in (("minInclusive", f.min_inclusive, lambda a, b: a < b), ("maxInclusive", f.max_inclusive, lambda a, b: a > b), ("minExclusive", f.min_exclusive, lambda a, b: a <= b), ("maxExclusive", f.max_exclusive, lambda a, b: a >= b)):
        if v is not None:
            out.append((rule, bad(typed, F.lit(v).cast(spark)) if isinstance(v, str) else bad(number, F.lit(v).cast("decimal(38,10)"))))
    digits = F.regexp_replace(F.regexp_replace(x, r"^[-+]?0*", ""), r"(\.\d*?)0*$", "$1")
    if f.total_digits is not None:
        out.append(("totalDigits", F.char_length(F.replace(digits, F.lit("."), F.lit(""))) > f.total_digits))
    if f.fraction_digits is not None:
        out.append(("fractionDigits", F.char_length(F.regexp_extract(digits, r"\.(\d*)$", 1)) > f.fraction_digits))
    if m.fixed is not None:
        number_fixed = F.lit(m.fixed).try_cast("double")
        out.append(("fixedValue", ~F.coalesce(x.try_cast("double") == number_fixed, x == m.fixed)))
    return out


def each(items: Column, f, *args) -> Column:
    """f(item, *args) of each item."""
    return F.transform(items, lambda i: f(i, *args))


def _field(base: Column, m: Member) -> Column:
    if m.repeated and m.wrapper:
        return base[m.wrapper][m.name]
    return base[m.tag]["#text"] if m.nillable else base[m.tag]


def _nil(base: Column, m: Member) -> Column:
    """BI21: whether a nillable member has xsi:nil."""
    return F.coalesce(base[m.tag][NIL].isin("true", "1"), F.lit(False)) if m.nillable else F.lit(False)


def bound(base: Column, record: Record) -> Column:
    """BI13-BI19: a raw struct as the record's typed struct."""
    fields = []
    for m in record.used:
        x = _field(base, m)
        if m.kind == "dynamic":
            value = F.when(x.isNotNull(), F.concat(F.lit(f"<{m.name}>"), x, F.lit(f"</{m.name}>")))
        elif m.record:
            value = each(x, bound, m.record) if m.repeated else F.when(x.isNotNull(), bound(x, m.record))
        elif m.repeated:
            value = each(x, lambda i, m: coerce(white_space(i, m.facets.white_space), m.type), m)
        else:
            text = white_space(x, m.facets.white_space)
            for given in (m.default, m.fixed):
                if given is not None:
                    text = F.coalesce(text, F.lit(given))
            if m.enum_map:
                back = [F.lit(v) for token, member in m.enum_map.items() for v in (token, member)]
                text = F.coalesce(F.try_element_at(F.create_map(*back), text), text)
            value = list_value(text, m.type) if m.listed else coerce(text, m.type)
            value = F.when(~_nil(base, m), value) if m.nillable else value
        if m.read:
            value = each(value, m.read) if m.repeated else m.read(value)
        fields.append(value.alias(m.out))
    return F.struct(*fields)


def checked(base: Column, record: Record, strict_empty: bool = False) -> Column:
    """VA12-VA15, BI20: array<struct<rule, member>> of what a raw struct violates."""
    found = []
    for m in record.used:
        x = _field(base, m)
        if m.repeated:
            n = F.when(x.isNull(), 0).otherwise(F.size(x))
            low = max(m.min_occurs, 1) if m.required else m.min_occurs
            found += [("minOccurs", m, n < low)] if low else []
            found += [("maxOccurs", m, n > m.max_occurs)] if m.max_occurs is not None else []
            continue
        if m.required and m.default is None and m.fixed is None:
            found.append(("required", m, ~_nil(base, m) & (x.isNull() | ((x == "") if strict_empty and not m.record else F.lit(False)))))
        if not m.record and m.kind != "dynamic":
            text = white_space(x, m.facets.white_space)
            found += [(rule, m, F.coalesce(bad, F.lit(False)) & x.isNotNull()) for rule, bad in violations(text, m)]
            if XSD_TYPES.get(m.type, m.type) != "string" and not m.listed:
                found.append(("dataType", m, x.isNotNull() & coerce(text, m.type).isNull()))
    groups: dict[str, list[Member]] = {}
    for m in record.used:
        if m.choice:
            groups.setdefault(m.choice, []).append(m)
    entry = lambda rule, name, bad: F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("member")))
    entries = [entry(rule, m.out, bad) for rule, m, bad in found]
    for group, members in groups.items():
        n = sum((F.when(F.coalesce(_field(base, m).cast("string"), F.lit("")) != "", 1).otherwise(0) for m in members), F.lit(0))
        entries.append(entry("choice", group, n > 1))
        if group in record.choices_required:
            entries.append(entry("choiceRequired", group, n == 0))
    if not entries:
        return F.array().cast("array<struct<rule:string,member:string>>")
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def bind(df: DataFrame, xml: str, record: Record, mode: str = "warn", strict_empty: bool = False) -> DataFrame:
    """IO15: adds `record`, the typed struct of a column of XML, and `violations`.

    mode: warn keeps the violations as a column, strict raises on the first, off leaves them out. Malformed XML
    gives a null record.
    """
    options = {"attributePrefix": "@_", "valueTag": "#text", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}
    raw = df.withColumn("_raw", F.from_xml(F.col(xml), record.raw_schema(), options))
    out = raw.withColumn("record", F.when(F.col("_raw").isNotNull(), bound(F.col("_raw"), record)))
    if mode != "off":
        out = out.withColumn("violations", checked(F.col("_raw"), record, strict_empty))
        if mode == "strict":
            first = F.concat(F.element_at("violations", 1)["rule"], F.lit(": "), F.element_at("violations", 1)["member"])
            out = out.withColumn("record", F.when(F.size("violations") > 0, F.raise_error(first)).otherwise(F.col("record")))
    return out.drop("_raw")


def bind_subtypes(df: DataFrame, xml: str, base: Record, subtypes: dict[str, Record], mode: str = "warn") -> DataFrame:
    """BI22: adds to `bind`'s columns `subtype`, the known local name that the root's xsi:type gives, and `subtypes`, a
    struct with one member for each of them: the record of that subtype, null for documents of another.

    The prefix of xsi and of the type's name are the document's own. An unknown type has the base's record only.
    """
    written_type = F.regexp_extract(F.col(xml), r"""\A\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<[^>]*?\s[\w.-]+:type\s*=\s*["'](?:[^"':]*:)?([^"']*)["']""", 1)
    out = bind(df, xml, base, mode).withColumn("subtype", F.when(written_type.isin(*subtypes), written_type))
    options = {"attributePrefix": "@_", "valueTag": "#text", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}
    parts = []
    for name, record in subtypes.items():
        raw = F.from_xml(F.when(F.col("subtype") == name, F.col(xml)), record.raw_schema(), options)
        parts.append(F.when(raw.isNotNull(), bound(raw, record)).alias(name))
    return out.withColumn("subtypes", F.struct(*parts))


def declared(nodes: DataFrame) -> DataFrame:
    """BI28: a node table whose elements declare only what is not in scope already: `xmlns` attributes that repeat the
    parent's scope go, and an empty default namespace stays only where it ends one."""
    up = nodes.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("ns_scope").alias("_scope"))
    met = nodes.join(growing(up), (F.col("doc_id") == F.col("_d")) & (F.col("parent_pre") == F.col("_p")), "left")
    key = lambda k: F.when(k == "xmlns", "").otherwise(F.substr(k, F.lit(7)))
    known = lambda k, v: F.coalesce(F.try_element_at("_scope", key(k)), F.lit("")) == v
    needed = F.map_filter("attrs", lambda k, v: ~((k == "xmlns") | k.startswith("xmlns:")) | ~known(k, v))
    return met.withColumn("attrs", needed).withColumn("xmlns", F.map_filter("xmlns", lambda k, v: F.coalesce(F.try_element_at("_scope", k), F.lit("")) != v)).select(*nodes.columns)


def written(base: Column, record: Record) -> Column:
    """BI26, BI27: a typed struct as the struct that `to_xml` writes. Dynamic members are put in by `unbind`."""
    fields = []
    if any(m.nillable for m in record.used):
        fields.append(F.lit(XSI).alias("@_xmlns:xsi"))
    for m in record.used:
        if m.kind == "dynamic":
            continue
        x = base[m.out]
        if m.write:
            x = each(x, m.write) if m.repeated else m.write(x)
        if m.record:
            value = each(x, written, m.record) if m.repeated else F.when(x.isNotNull(), written(x, m.record))
        elif m.listed:
            value = F.array_join(x.cast("array<string>"), " ")
        else:
            value = x if m.repeated else x.cast("string")
            if m.enum_map:
                there = [F.lit(v) for token, member in m.enum_map.items() for v in (member, token)]
                value = F.coalesce(F.try_element_at(F.create_map(*there), value), value)
        if m.repeated and m.wrapper:
            fields.append(F.struct(value.alias(m.name)).alias(m.wrapper))
        elif m.nillable:
            fields.append(F.struct(value.alias("#text"), F.when(x.isNull(), "true").alias(NIL)).alias(m.tag))
        else:
            fields.append(value.alias(m.tag))
    return F.struct(*fields)


def unbind(df: DataFrame, column: str, record: Record, xml: str = "xml", prolog: str = "") -> DataFrame:
    """IO16, IO17: adds the XML of a typed struct, after a prolog. Dynamic members come last, as they are."""
    options = {"attributePrefix": "@_", "valueTag": "#text", "rowTag": record.name, "indent": "", "validateName": "false"}
    body = F.to_xml(written(F.col(column), record), options)
    dynamic = [F.coalesce(F.col(column)[m.out], F.lit("")) for m in record.used if m.kind == "dynamic"]
    if dynamic:
        end, body = f"</{record.name}>", F.regexp_replace(body, r"\s+\z", "")
        body = F.when(body.endswith(end), F.concat(F.left(body, F.char_length(body) - len(end)), *dynamic, F.lit(end))).otherwise(
            F.concat(F.regexp_replace(body, r"/>\z", ">"), *dynamic, F.lit(end)))
    return df.withColumn(xml, F.concat(F.lit(prolog), body))


def prolog(version: str = "1.0", encoding: str = "UTF-8", standalone: bool | None = None, instructions: tuple[tuple[str, str], ...] = (), doctype: tuple[str, str | None, str | None] | None = None) -> str:
    """IO17: declaration, processing instructions and document type (name, public id, system id)."""
    lines = [f'<?xml version="{version}" encoding="{encoding}"' + ("" if standalone is None else f' standalone="{"yes" if standalone else "no"}"') + "?>"]
    lines += [f"<?{target} {data}?>" for target, data in instructions]
    if doctype:
        name, public, system = doctype
        where = f' PUBLIC "{public}" "{system or ""}"' if public else f' SYSTEM "{system}"' if system else ""
        lines.append(f"<!DOCTYPE {name}{where}>")
    return "\n".join(lines) + "\n"


def subtree(df: DataFrame, key: str, xml: str, **options) -> DataFrame:
    """BI07, BI25: the node table of a dynamic member, in document order; rows without it have no nodes.

    options: those of `shred`, such as max_depth.
    """
    return shred(df.select(F.col(key).alias("doc_id"), F.col(xml).alias("xml")).where(F.col("xml").isNotNull()), **options)


def with_prefixes(nodes: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """BI24: names of elements get the prefix given for their namespace (empty: none), so that records find them
    by namespace and local name. Other names stay."""
    prefix = F.col("prefix")
    for uri, own in prefixes.items():
        prefix = F.when(F.col("ns_uri") == uri, F.lit(own or None)).otherwise(prefix)
    out = nodes.withColumn("prefix", prefix)
    return out.withColumn("name", F.when(F.col("prefix").isNull(), F.col("local_name")).otherwise(F.concat("prefix", F.lit(":"), "local_name")))


def bind_selection(selection: Selection, record: Record, mode: str = "warn") -> DataFrame:
    """MU21: doc_id, at and the typed record of each selected node's subtree."""
    out = bind(selection.to_xml_strings(), "xml", record, mode)
    return out.drop("xml")


def record_nodes(df: DataFrame, key: str, column: str, record: Record, **options) -> DataFrame:
    """MU22: the node table of typed structs."""
    return shred(unbind(df.select(F.col(key).alias("doc_id"), column), column, record), **options)
