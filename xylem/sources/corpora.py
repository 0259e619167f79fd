"""XML documents made from relational tables by column expressions; many documents of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import escape_attribute, escape_text
from .store import growing


def spread(df: DataFrame, key: str) -> DataFrame:
    """df by its key over as many tasks as a shuffle has: a small file becomes large texts, parsed at far greater cost."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def money(x: Column) -> Column:
    return x.cast("decimal(15,2)").cast("string")


def element(name: str, content: Column, /, **attrs: Column) -> Column:
    """One element as text; content is XML already."""
    head = [x for k, v in attrs.items() for x in (F.lit(f' {k.replace("_", ":")}="'), escape_attribute(v), F.lit('"'))]
    return F.concat(F.lit(f"<{name}"), *head, F.lit(">"), content, F.lit(f"</{name}>"))


def leaf(name: str, value: Column, /, **attrs: Column) -> Column:
    return element(name, escape_text(value), **attrs)


def gathered(df: DataFrame, key: str, order: str | list[str], xml: Column) -> DataFrame:
    """key and the XML of its rows in order. Rows are shuffled, not their texts, and texts are made by as many tasks as a shuffle has."""
    rows = spread(df, key).select(F.col(key).alias("_k"), F.struct(F.struct(*([order] if isinstance(order, str) else order)).alias("o"), xml.alias("x")).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "")
    return rows.groupBy("_k").agg(joined.alias("_inner"))


def customer_documents(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """A document for each customer with their orders."""
    order = element(
        "order", F.concat(leaf("total", money(F.col("o_totalprice"))), leaf("date", F.date_format("o_orderdate", "yyyy-MM-dd"))),
        id=F.col("o_orderkey"), status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"))
    inner = gathered(orders, "o_custkey", "o_orderkey", order)
    body = F.concat(leaf("name", F.col("c_name")), leaf("acctbal", money(F.col("c_acctbal"))), F.coalesce("_inner", F.lit("")))
    joined = customer.join(growing(inner), customer["c_custkey"] == inner["_k"], "left")
    return joined.select(F.col("c_custkey").cast("string").alias("doc_id"), element("customer", body, id=F.col("c_custkey"), seg=F.col("c_mktsegment"), nation=F.col("c_nationkey")).alias("xml"))


def order_documents(lineitem: DataFrame) -> DataFrame:
    """A document for each order with its items."""
    item = element(
        "item", F.concat(leaf("qty", money(F.col("l_quantity"))), leaf("price", money(F.col("l_extendedprice"))), leaf("disc", money(F.col("l_discount")))),
        no=F.col("l_linenumber"), flag=F.col("l_returnflag"))
    inner = gathered(lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], item)
    return inner.select(F.col("_k").cast("string").alias("doc_id"), element("order", F.col("_inner"), id=F.col("_k")).alias("xml"))


def conversation_documents(conversations: DataFrame) -> DataFrame:
    """A document for each conversation with its turns."""
    turn = leaf("turn", F.col("text"), n=F.col("turn"), role=F.col("role"))
    inner = gathered(conversations, "conv_id", "turn", turn)
    return inner.select(F.col("_k").cast("string").alias("doc_id"), element("conv", F.col("_inner"), id=F.col("_k")).alias("xml"))


def part_documents(part: DataFrame, per_document: int = 50) -> DataFrame:
    """A document for each run of part keys."""
    one = element("part", F.concat(leaf("name", F.col("p_name")), leaf("size", F.col("p_size")), leaf("price", money(F.col("p_retailprice")))), id=F.col("p_partkey"), brand=F.col("p_brand"), type=F.col("p_type"))
    inner = gathered(part.withColumn("_run", F.floor(F.col("p_partkey") / per_document)), "_run", "p_partkey", one)
    return inner.select(F.col("_k").cast("string").alias("doc_id"), element("parts", F.col("_inner"), run=F.col("_k")).alias("xml"))
