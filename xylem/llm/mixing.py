"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source gets a target number of words (water-filling by weight under a ceiling of `most` times its size).
Within a source, documents of size class k = floor(log2(size)) expect min(most, c * 2**(-k * tilt)) copies, c being
such that the expected words meet the target. The whole part of that number is taken for certain; the fraction is
the document's inclusion probability p. Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u made of a digest of
their id and text, and taken in that order until the source's words are met: a sample of fixed size, counted in words.

The cut is found by a histogram of ranks (2**16 bins a source) and a window over the distinct (id, text) of the one bin
that holds it, so that no task sees a whole source. Its result is one threshold per source; the last pass is a map.
Only where the cut falls among rows of one id and text, however many, those rows are numbered, by input partition.

Nulls and odd rows: a null text has size 0; documents of size 0 are never taken; a null source is a source,
last in order; a null id ranks as an empty one; rows of one id with other texts rank apart; of rows of one id and text as
many are taken as meet the target (which of them, if other columns differ, is not defined); an empty table gives an empty result. Columns of the input that aren't named here pass through `mix_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # repeating, over sources in code point order
    share: float = 1.5  # of all words
    most: int = 2  # times that a document or a source can be taken
    tilt: float = 0.125  # how much shorter documents are preferred
    bins: int = 65536
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def waterfill(df: DataFrame, part: list[str], weight: str, cap: str, total: str, out: str) -> DataFrame:
    """Adds column `out`: total shared out by weight, no row above its cap, what exceeds a cap shared among the others.

    In order of cap / weight, a row is capped if its cap is at most what its weight would draw from what is left.
    One row per source (or per source and size class, at most 64) comes here, never documents.
    """
    order = W.partitionBy(*part).orderBy(F.col(cap) / F.col(weight), F.col(weight))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.col(total) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(weight).over(onward)
    df = df.withColumn("_level", level).withColumn("_capped", F.col(cap) <= F.col("_level") * F.col(weight))
    water = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(W.partitionBy(*part))
    df = df.withColumn("_water", water)
    return df.withColumn(out, F.when(F.col("_capped"), F.col(cap)).otherwise(F.col("_water") * F.col(weight))).drop("_level", "_capped", "_water")


def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on source, null being a source."""
    return left.join(right.withColumnRenamed("source", "_right"), F.col("source").eqNullSafe(F.col("_right")), how).drop("_right")


def size_class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def _tag(p: MixParams, doc_id: Column, text: Column) -> Column:
    """A digest of id, seed and text, which other engines can compute alike."""
    inner = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{p.seed}:"), inner).cast("binary"))


def _rank(tag: Column, chance: Column) -> Column:
    """The Pareto ranking variable; null where a document can't be in the sample. u is the tag's first 52 bits."""
    u = (F.conv(F.substring(tag, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.when(chance > 0, (u / (1 - u)) / (chance / F.greatest(1 - chance, F.lit(1e-12))))


def source_targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """(source, source_size, target) from (source, size) rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in p.weights]), (place % len(p.weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(p.most))
    per = per.withColumn("_total", F.sum("source_size").over(W.partitionBy()) * p.share)
    return waterfill(per, [], "_w", "_cap", "_total", "target").select("source", "source_size", "target")


def mix_plan(sizes: DataFrame, p: MixParams) -> DataFrame:
    """One row per (source, size class): targets, certain copies, inclusion probability and the source's cut."""
    targets = source_targets(sizes, p)
    classes = sizes.withColumn("cls", size_class(F.col("size"))).groupBy("source", "cls").agg(F.sum("size").alias("_s"))
    classes = by_source(classes, targets)
    classes = classes.withColumn("_a", F.pow(F.lit(2.0), F.col("cls") * -p.tilt) * F.greatest("_s", F.lit(1e-9))).withColumn("_cap", F.col("_s") * float(p.most))
    classes = waterfill(classes, ["source"], "_a", "_cap", "target", "_t")
    copies = F.least(F.when(F.col("_s") > 0, F.col("_t") / F.col("_s")).otherwise(0.0), F.lit(float(p.most)))
    classes = classes.withColumn("_copies", copies).withColumn("certain", F.floor(F.col("_copies") + 1e-9).cast("int"))
    classes = classes.withColumn("chance", F.greatest(F.col("_copies") - F.col("certain"), F.lit(0.0)))
    classes = materialise(classes.select("source", "cls", "source_size", "target", "certain", "chance", "_s"), "mix-classes")
    left = classes.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("_s"))).alias("left"))

    ranked = with_plan(sizes, classes.withColumnsRenamed({c: f"_{c}" for c in classes.columns})).where(F.col("_rank").isNotNull() & (F.col("size") > 0))
    ranked = ranked.select("source", "size", "_tag", "_rank", _bin(p).alias("bin"))
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(W.partitionBy("source").orderBy("bin"))
    bins = by_source(bins.withColumn("after", running), left)
    cut = bins.where(F.col("after") > F.col("left")).groupBy("source").agg(
        F.min("bin").alias("bin"), F.min_by(F.col("left") - (F.col("after") - F.col("words")), "bin").alias("rest"))
    cut = materialise(cut, "mix-cut")
    inside = by_source(ranked, cut.withColumnRenamed("bin", "_at")).where(F.col("bin") == F.col("_at"))
    inside = inside.groupBy("source", "_rank", "_tag", "size", "rest").agg(F.count(F.lit(1)).alias("rows"))
    w = W.partitionBy("source").orderBy("_rank", "_tag").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("rows") * F.col("size")).over(w), F.lit(0))
    inside = inside.withColumn("fit", F.least(F.floor((F.col("rest") - before) / F.col("size") + 0.5), F.col("rows"))).where(F.col("fit") >= 1)
    last = inside.groupBy("source").agg(F.max(F.struct("_rank", "_tag", "fit", "rows")).alias("last"))
    last = last.select("source", F.struct("last._rank", "last._tag").alias("last"), F.col("last.fit").alias("fit"), F.col("last.rows").alias("rows"))
    ends = by_source(cut.select("source", F.col("bin").alias("cut_bin")), last, "left")
    plan = by_source(classes.drop("_s"), ends, "left")
    return materialise(plan.withColumnsRenamed({c: f"_{c}" for c in plan.columns}), "mix-plan")


def _bin(p: MixParams) -> Column:
    return F.floor(F.col("_rank") / (1 + F.col("_rank")) * p.bins).cast("int")


def with_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins the plan's few rows to documents with `size` and `_tag` and ranks them."""
    out = df.join(plan, df["source"].eqNullSafe(plan["_source"]) & (size_class(df["size"]) == plan["_cls"]))
    return out.withColumn("_rank", _rank(F.col("_tag"), F.col("_chance")))


def with_copies(df: DataFrame, plan: DataFrame, p: MixParams) -> DataFrame:
    """Adds `_copies`: how often each document is taken."""
    out, here = with_plan(df, plan), F.struct("_rank", "_tag")
    at_cut = F.col("_rank").isNotNull() & (F.col("size") > 0) & (_bin(p) == F.col("_cut_bin"))
    parted = F.coalesce(at_cut & (here == F.col("_last")) & (F.col("_fit") < F.col("_rows")), F.lit(False))
    taken = F.col("_rank").isNotNull() & (F.col("_cut_bin").isNull() | (_bin(p) < F.col("_cut_bin")) | (at_cut & F.coalesce(here <= F.col("_last"), F.lit(False))))
    copies = F.when(F.col("size") > 0, F.col("_certain") + taken.cast("int")).otherwise(0)
    if plan.where("_fit < _rows").isEmpty():
        return out.withColumn("_copies", copies)
    tied = materialise(out.where(parted).withColumn("_part", F.spark_partition_id()), "mix-ties")
    parts = tied.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("_here"))
    before = F.coalesce(F.sum("_here").over(W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), before.alias("_before"))
    number = F.row_number().over(W.partitionBy("_source", "_part").orderBy("_tag"))
    tied = tied.withColumn("_number", number).join(parts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    tied = tied.withColumn("_copies", F.col("_certain") + (F.col("_number") + F.col("_before") <= F.col("_fit")).cast("int"))
    return out.where(~parted).withColumn("_copies", copies).unionByName(tied.select(*out.columns, "_copies"))


def mix_counts(docs: DataFrame, params: MixParams | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    p = params or MixParams()
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _tag(p, F.col("doc_id"), F.col("text")).alias("_tag")), "mix-sizes")
    out = with_copies(sizes, mix_plan(sizes, p), p)
    return out.select("doc_id", "size", F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, params: MixParams | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    p = params or MixParams()
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _tag(p, F.col("doc_id"), F.col("text")).alias("_tag")), "mix-sizes")
    plan = mix_plan(sizes, p)
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "source", word_count(F.col("text")).alias("size"), _tag(p, F.col("doc_id"), F.col("text")).alias("_tag"))
    out = with_copies(inner, plan, p).where(F.col("_copies") > 0)
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
