"""Sharding by a k-d tree over document metadata.

Dimensions: size, share of multi-byte characters, language and source, each as 16 bits. A language or source stands at
the middle of its bytes in order of frequency. Equal texts are a group, which has the least language and source of its
rows, so that copies lie together in every dimension. A node that is to hold k shards is split at the weighted quantile
k1 / k of its bytes (the median for even k) along its widest dimension, widths being shares of the root's, until each
leaf has the target bytes. Groups of one value are in the order of their text's digest. The nodes of a level are split
together.

The law is `bytes`: shards are near equal, and equal texts share a shard. Where both can't hold, the law goes first: a
group that weighs more than `whole` of a shard's target is dealt by ids (column `parted`), smaller ones never are.

The tree is built over groups, not documents. Quantiles are found by histograms of 2**12 bins a node (2**15 in the last
round): first of the dimension's upper bits, then inside the bin that holds the cut. What comes to the driver are these
histograms, at most a bin for each of so many and of the nodes that are split, and the nodes' extents.

Nulls and odd rows: a null text has no bytes, and every row weighs 8 more; a null language or source is one more, least
of all; a null id counts as one id, and rows of one id and text, which nothing tells apart, are never parted; repeated
rows are rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialise, text_bytes

DIMS = ("d_size", "d_script", "d_lang", "d_source")
WIDTHS = (12, 12, 12, 12, 15)  # bits of the key that a round settles: 16 of the dimension, 32 of the text, 15 of the id
ROWS = 1_000_000  # of a part of a shard that is numbered by one task


@dataclass(frozen=True)
class ShardParams:
    shards: int = 24
    slack: float = 0.0025  # of a shard's target that a cut may be off
    whole: float = 0.15  # of a shard's target up to which equal texts are never parted


@dataclass
class Node:
    first: int
    shards: int
    dim: str | None = None
    cut: int | None = None
    children: list = field(default_factory=list)


def _hash_bits(col: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(col), 64 - bits)


def metadata(docs: DataFrame) -> DataFrame:
    """What is needed of each document."""
    raw = text_bytes(F.col("text"))
    n = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    chars = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(
        "doc_id", (n + 8).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("text_key"),
        F.least(F.log2((n + 1).cast("double")) * 1638, F.lit(65535.0)).cast("long").alias("d_size"),
        (F.when(n > 0, (n - chars) / n).otherwise(0.0) * 65535).cast("long").alias("d_script"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        _hash_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 15).alias("by_id"),
    )


def placed(groups: DataFrame, column: str) -> DataFrame:
    """Adds d_<column>: the middle of a value's bytes, values in order of their bytes, in 16 bits. One row for each value is sorted."""
    per = groups.groupBy(column).agg(F.sum("bytes").alias("_b"))
    order = W.orderBy(F.desc("_b"), column)
    middle = (F.sum("_b").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_b") / 2) / F.sum("_b").over(W.partitionBy())
    return groups.join(per.select(column, (middle * 65535).cast("long").alias(f"d_{column}")), column)


def text_groups(meta: DataFrame, target: float, p: ShardParams) -> DataFrame:
    """(text_key, part, bytes, dimensions) of each group of equal texts, heavy ones parted by id."""
    per = meta.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.first("d_size").alias("d_size"), F.first("d_script").alias("d_script"))
    per = materialise(placed(placed(per, "lang"), "source"), "shard-groups")
    heavy = per.where(F.col("bytes") > p.whole * target)  # fewer than shards / whole rows
    parts = meta.join(F.broadcast(heavy.select("text_key")), "text_key").groupBy("text_key", F.col("by_id").alias("part")).agg(F.sum("size").alias("bytes"))
    parts = parts.join(F.broadcast(heavy.drop("bytes")), "text_key")
    columns = ["text_key", "part", "bytes", *DIMS]
    return materialise(per.where(F.col("bytes") <= p.whole * target).withColumn("part", F.lit(0).cast("long")).select(*columns).unionByName(parts.select(*columns)), "shard-parts")


def _key(dim: str) -> Column:
    """Dimension, then text hash, then part, in 63 bits."""
    text = F.shiftrightunsigned("text_key", 32)
    return F.shiftleft(F.col(dim), 47).bitwiseOR(F.shiftleft(text, 15)).bitwiseOR(F.col("part"))


def _route(node: Node, leaf) -> Column:
    if node.cut is None:
        return leaf(node)
    return F.when(_key(node.dim) < node.cut, _route(node.children[0], leaf)).otherwise(_route(node.children[1], leaf))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.cut is None else [x for c in node.children for x in _leaves(c)]


def _split_level(groups: DataFrame, root: Node, target: float, whole: dict, p: ShardParams) -> None:
    """Splits each leaf of more than one shard. whole: the root's extents, found on the first level."""
    todo = {n.first: n for n in _leaves(root) if n.shards > 1}
    rows = groups.withColumn("node", _route(root, lambda n: F.lit(n.first))).where(F.col("node").isin(list(todo)))
    extent = [F.struct(F.min(d).alias("lo"), F.max(d).alias("hi")).alias(d) for d in DIMS]
    goal, low, left = {}, {}, {}
    for r in rows.groupBy("node").agg(F.sum("bytes").alias("bytes"), *extent).collect():
        node, wide = todo[r["node"]], {d: r[d]["hi"] - r[d]["lo"] for d in DIMS}
        if not whole:
            whole.update(wide)
        node.dim = max(DIMS, key=lambda d: (wide[d] / max(1, whole[d]), -DIMS.index(d)))
        goal[node.first], low[node.first], left[node.first] = float(r["bytes"]) * (node.shards // 2) / node.shards, 0, 0
    for n in [k for k in todo if k not in goal]:  # no rows at all
        todo[n].dim, todo[n].cut = DIMS[0], 1
        _part(todo.pop(n))
    open_, shift = set(todo), 63
    for width in WIDTHS:
        if not open_:
            break
        shift -= width
        here = rows.where(F.col("node").isin(list(open_))).withColumn("key", _case({n: _key(todo[n].dim) for n in open_}))
        if shift + width < 63:
            here = here.where(F.shiftright("key", shift + width) == _case({n: F.lit(low[n] >> (shift + width)) for n in open_}))
        hist = here.groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups")).toPandas().sort_values(["node", "bin"])
        for n, bins in hist.groupby("node"):
            after = left[n] + bins["bytes"].cumsum()
            at = int((after.to_numpy() >= goal[n]).argmax())
            before, here_bytes, bin_ = float(after.iloc[at] - bins["bytes"].iloc[at]), float(bins["bytes"].iloc[at]), int(bins["bin"].iloc[at])
            over, under = before + here_bytes - goal[n], goal[n] - before
            low[n], left[n] = bin_ << shift, before
            if bins["groups"].iloc[at] == 1 or min(over, under) <= p.slack * target or shift == 0:
                todo[n].cut = low[n] if under <= over else (bin_ + 1) << shift
                open_.discard(n)
    for node in todo.values():
        _part(node)


def _case(values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(F.col("node") == k, v).otherwise(out)
    return out


def _part(node: Node) -> None:
    half = node.shards // 2
    node.children = [Node(node.first, half), Node(node.first + half, node.shards - half)]


def build_tree(groups: DataFrame, target: float, p: ShardParams) -> Node:
    root, whole = Node(0, p.shards), {}
    while target and any(n.shards > 1 for n in _leaves(root)):
        _split_level(groups, root, target, whole, p)
    return root


def numbered(df: DataFrame, subs: int) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard, by numbering parts of a shard and adding the parts' offsets."""
    df = df.withColumn("sub", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(subs)))
    sizes = df.groupBy("shard", "sub").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("shard").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", "sub", before.alias("offset"))  # at most shards * subs rows, a row for some ROWS documents
    order = F.row_number().over(W.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size"))
    return df.withColumn("at", order - 1).join(offsets, ["shard", "sub"]).withColumn("slot", (F.col("at") + F.col("offset")).cast("long"))


def shard_documents(docs: DataFrame, params: ShardParams | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and parted of every document."""
    p = params or ShardParams()
    meta = materialise(metadata(docs), "shard-meta")
    whole = meta.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    target = (whole["b"] or 0) / p.shards
    groups = text_groups(meta, target, p)
    root = build_tree(groups, target, p)
    routed = groups.select("text_key", "part", _route(root, lambda n: F.lit(n.first)).cast("int").alias("shard"))
    heavy = meta.groupBy("text_key").agg(F.sum("size").alias("b")).where(F.col("b") > p.whole * target).select("text_key", F.lit(True).alias("parted"))
    rows = meta.join(F.broadcast(heavy), "text_key", "left").withColumn("parted", F.coalesce("parted", F.lit(False)))
    rows = rows.withColumn("part", F.when(F.col("parted"), F.col("by_id")).otherwise(0)).join(routed, ["text_key", "part"])
    out = numbered(rows, max(16, -(-whole["n"] // (ROWS * p.shards))))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "parted")
