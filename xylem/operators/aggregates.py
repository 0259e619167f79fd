"""Aggregates and groups of selections: one row for each document, or for each document and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..sources.store import growing


def value() -> Column:
    return F.coalesce(F.col("num"), V.parse_float(F.col("text")))


def in_order(x: Column) -> Column:
    """An array of x in selection order, nulls left out."""
    pairs = F.collect_list(F.when(x.isNotNull(), F.struct(F.col("at").alias("at"), x.alias("x"))))
    return F.transform(F.array_sort(pairs), lambda p: p["x"])


def most_frequent(values: Column) -> Column:
    """The most frequent of an array of numbers; of equally frequent ones, the first in it. One pass over its runs when sorted."""
    start = F.struct(*[F.lit(None).cast(t).alias(k) for k, t in (("v", "double"), ("n", "int"), ("i", "int"), ("best", "double"), ("most", "int"), ("seen", "int"))])

    def step(a: Column, p: Column) -> Column:
        same = a["v"].eqNullSafe(p["v"])
        n, i = F.when(same, a["n"] + 1).otherwise(1), F.when(same, a["i"]).otherwise(p["i"])
        better = a["most"].isNull() | (n > a["most"]) | ((n == a["most"]) & (i < a["seen"]))
        return F.struct(
            p["v"].alias("v"), n.alias("n"), i.alias("i"), F.when(better, p["v"]).otherwise(a["best"]).alias("best"), F.when(better, n).otherwise(a["most"]).alias("most"), F.when(better, i).otherwise(a["seen"]).alias("seen"))

    placed = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.cast("int").alias("i"))))
    return F.aggregate(placed, start, step, lambda a: a["best"])


class Aggregates:
    """Methods of a selection; documents with no selected node have a row too, unless a method is told otherwise."""

    def per_document(self, every: bool = True, **columns: Column) -> DataFrame:
        """doc_id and aggregates of each document; null or what coalesce gives where nothing is selected.

        every: whether documents with no selected node have a row. For them the nodes are read a second time.
        """
        got = self.rows.groupBy("doc_id").agg(*[c.alias(k) for k, c in columns.items()])
        if not every:
            return growing(got)
        docs = self.nodes.where(F.col("parent_pre").isNull()).select("doc_id")
        return growing(docs.join(got, "doc_id", "left"))

    def _filled(self, name: str, column: Column, missing) -> DataFrame:
        return self.per_document(**{name: column}).withColumn(name, F.coalesce(name, F.lit(missing)))

    def first(self) -> DataFrame:
        """AG01: the first row of each document."""
        return self.take(1).rows

    def last(self) -> DataFrame:
        """AG02."""
        return self.slice(-1).rows

    def at(self, i: int) -> DataFrame:
        """AG03: negative numbers count from the end."""
        return (self.slice(i, i + 1) if i >= 0 else self.slice(i, i + 1 or None)).rows

    def to_rows(self) -> DataFrame:
        """AG04: the node rows in document and selection order."""
        return self.rows.orderBy("doc_id", "at")

    def count(self) -> DataFrame:
        """AG05: of a plain selection in one reading of the nodes, without a join."""
        if not self.plain:
            return self._filled("count", F.count(F.lit(1)), 0)
        test, root = self.plain[0], F.col("parent_pre").isNull()
        got = self.nodes.where(test | root).groupBy("doc_id").agg(F.count_if(test).alias("count"), F.bool_or(root).alias("_whole"))
        return growing(got.where("_whole").select("doc_id", "count"))

    def exists(self) -> DataFrame:
        """AG06."""
        return self.count().select("doc_id", (F.col("count") > 0).alias("exists"))

    def all(self, test: Column) -> DataFrame:
        """AG07."""
        return self._filled("all", F.bool_and(test), True)

    def any(self, test: Column) -> DataFrame:
        """AG08."""
        return self._filled("any", F.bool_or(test), False)

    def texts(self) -> DataFrame:
        """AG09."""
        return self.per_document(texts=in_order(F.when(F.col("text") != "", F.col("text")))).withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))

    def values(self) -> DataFrame:
        """AG10."""
        return self.per_document(values=in_order(value())).withColumn("values", F.coalesce("values", F.array().cast("array<double>")))

    def attributes(self, name: str, every: bool = True) -> DataFrame:
        """AG11."""
        x = F.try_element_at("attrs", F.lit(name))
        return self.per_document(every, values=in_order(x)).withColumn("values", F.coalesce("values", F.array().cast("array<string>")))

    def distinct_attributes(self, name: str, every: bool = True) -> DataFrame:
        """AG12: in order of first sight."""
        out = self.attributes(name, every)
        return out.withColumn("values", F.array_distinct("values"))

    def sum(self) -> DataFrame:
        """AG13: 0 for nothing."""
        return self._filled("sum", F.sum(value()), 0.0)

    def average(self) -> DataFrame:
        """AG14: 0 for nothing."""
        return self._filled("average", F.avg(value()), 0.0)

    def min(self) -> DataFrame:
        """AG15."""
        return self.per_document(min=F.min(value()))

    def max(self) -> DataFrame:
        """AG16."""
        return self.per_document(max=F.max(value()))

    def median(self) -> DataFrame:
        """AG17."""
        return self.per_document(median=F.median(value()))

    def mode(self) -> DataFrame:
        """AG18: the most frequent; of equally frequent ones, the first seen."""
        return self.per_document(mode=most_frequent(in_order(value())))

    def variance(self) -> DataFrame:
        """AG19: of the population."""
        return self.per_document(variance=F.var_pop(value()))

    def standard_deviation(self) -> DataFrame:
        """AG20."""
        return self.per_document(standard_deviation=F.stddev_pop(value()))

    def percentile(self, p: float) -> DataFrame:
        """AG21: interpolated linearly."""
        if not 0 <= p <= 100:
            raise ValueError("a percentile is between 0 and 100")
        return self.per_document(percentile=F.percentile(value(), p / 100))

    def attribute_maps(self) -> DataFrame:
        """AG22."""
        return self.rows.select("doc_id", "at", "attrs")

    def text_nodes(self) -> DataFrame:
        """AG23."""
        return self.rows.select("doc_id", "at", F.coalesce("text_nodes", F.array()).alias("text_nodes"))

    def all_text_nodes(self) -> DataFrame:
        """AG24: one row for each text run."""
        return self.rows.select("doc_id", "at", F.posexplode("text_nodes").alias("place", "text"))

    def all_text(self) -> DataFrame:
        """AG25: for each selected node its own text and then its children's, in pre-order."""
        own = F.col("text")
        sub = self._below()
        rows = sub.rows.select("doc_id", F.slice("at", F.lit(1), F.size("at") - 1).alias("at"), "pre", own.alias("own"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", V.text_or_empty(F.col("own")).alias("own")))), lambda s: s["own"]), "")
        return rows.groupBy("doc_id", "at").agg(joined.alias("all_text"))

    def comments(self) -> DataFrame:
        """AG26."""
        return self.rows.select("doc_id", "at", F.coalesce("comments", F.array()).alias("comments"))

    def all_comments(self) -> DataFrame:
        """AG27."""
        return self.rows.select("doc_id", "at", F.posexplode("comments").alias("place", "comment"))

    def _self_then_below(self, test: Column):
        below = self.descendants().where(test)
        front = lambda rows, k: rows.withColumn("at", F.concat(F.array(F.lit(k).cast("long")), "at"))
        return self._with(front(self.where(test).rows, 0).unionByName(front(below.rows, 1)))

    def has_mixed_content(self):
        """AG28: selected nodes with text runs, then such descendants; not deduped."""
        return self._self_then_below(F.size("text_nodes") > 0)

    def has_comments(self):
        """AG29."""
        return self._self_then_below(F.size("comments") > 0)

    def group_by(self, key: Column, **columns: Column) -> DataFrame:
        """AG34: doc_id, key and aggregates (by default the count), and `seen`, the key's place of first sight."""
        columns = columns or {"count": F.count(F.lit(1))}
        return self.rows.groupBy("doc_id", key.alias("key")).agg(*[c.alias(k) for k, c in columns.items()], F.min("at").alias("seen"))

    def group_by_name(self, **columns: Column) -> DataFrame:
        """AG30."""
        return self.group_by(F.col("name"), **columns)

    def group_by_namespace(self, **columns: Column) -> DataFrame:
        """AG31."""
        return self.group_by(F.coalesce("prefix", F.lit("(no-namespace)")), **columns)

    def group_by_attribute(self, name: str, **columns: Column) -> DataFrame:
        """AG32."""
        x = F.try_element_at("attrs", F.lit(name))
        return self.group_by(F.when(V.text_or_empty(x) != "", x).otherwise("(no-value)"), **columns)

    def group_by_depth(self, **columns: Column) -> DataFrame:
        """AG33."""
        return self.group_by(F.col("depth"), **columns)
