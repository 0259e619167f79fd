"""URL filters by a path-template tree. DataFrame functions only: no Python runs on executors.

Every URL is cut into a host and path segments. Per host, a tree of path templates grows level by level, as deep as
the paths go; a path that is alone below its node ends there, since nothing more can be told from it:
1. segments of a variable shape (numbers, hex strings, dates, UUIDs) become placeholders;
2. a node with very many distinct children turns its rare children into ``*``;
3. children whose labelled block rate can't be told from that of their siblings are merged into ``*``.
Rows that a rule judges are the labels. A template is rejected if its blocked share among labelled rows,
smoothed towards its host's and the host's towards the corpus's, reaches `reject_at`.

URLs are first reduced to distinct (host, shape) rows with counts, by partial aggregation, so that a host
with a third of all rows costs as many rows as it has distinct shapes. Joins on a node are salted by segment, and
the shapes of very many rows are joined to them by broadcast (at most 10,000 can be that frequent).

Nulls and odd rows: a null URL or one without ``://`` has an empty host and path, template ``/`` and no rule.
An empty table gives an empty result; repeated rows are judged alike and each is returned; further columns
of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_above, join_heavy, materialise, salts

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Judges the URLs of a host and all its subdomains whose path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TemplateParams:
    fan_out: int = 32  # children beyond which rare ones are generalised
    rare_share: float = 0.05  # of the parent's rows
    z: float = 2.0  # standard errors within which two block rates count as alike
    smoothing: float = 5.0  # pseudo rows of the prior
    reject_at: float = 0.7
    salts: int = 16


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, verdict> of the longest fitting rule; of equally long ones, the first in code point order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def segment_shape(segment: Column) -> Column:
    """A placeholder for a segment of a variable shape, else the segment itself."""
    shape = F.regexp_replace(segment, r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "{uuid}")
    shape = F.regexp_replace(shape, r"^\d{4}-\d{2}-\d{2}$", "{date}")
    shape = F.regexp_replace(shape, r"^(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{8,}$", "{hex}")
    return F.regexp_replace(shape, r"\d+", "{n}")


def shapes_of(path: Column) -> Column:
    """All segments as shapes."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), segment_shape)


def _grow(nodes: DataFrame, level: int, p: TemplateParams) -> DataFrame:
    """Replaces element `level` of each row's template by `*` where the level's statistics call for it."""
    here = F.get("shape", F.lit(level))
    rows = nodes.withColumn("part", here).where(F.col("part").isNotNull())
    child = rows.groupBy("host", "template", "part").agg(*[F.sum(c).alias(c) for c in ("n", "lab", "blk")])
    child = child.withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(p.salts)))
    parent = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f"p_{c}") for c in ("n", "lab", "blk")])
    parent = parent.withColumn("salt", salts(p.salts))
    rate = F.col("p_blk") / F.greatest(F.col("p_lab"), F.lit(1))
    gap = F.abs(F.col("blk") - rate * F.col("lab"))
    alike = gap * gap <= p.z * p.z * F.greatest(rate * (1 - rate), F.lit(0.01)) * F.col("lab")
    rare = (F.col("k") > p.fan_out) & (F.col("n") < p.rare_share * F.col("p_n"))
    choice = child.join(parent, ["host", "template", "salt"]).select(
        "host", "template", "part", "salt",
        F.when((F.col("k") > 1) & (rare | alike), F.lit("*")).otherwise(F.col("part")).alias("chosen"),
    )
    keyed = nodes.withColumn("part", here).withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(p.salts)))
    return keyed.join(choice, ["host", "template", "part", "salt"], "left").select(
        "host", "shape", F.when(F.col("chosen").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "chosen")).alias("template"), "n", "lab", "blk",
    )


def learn_templates(pages: DataFrame, p: TemplateParams) -> DataFrame:
    """(host, shape, template, n, reject and its grounds) for every distinct (host, shape) of (host, shape, verdict) rows."""
    nodes = pages.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("verdict").alias("lab"), F.count_if(F.col("verdict") == "block").alias("blk"),
    ).select("host", "shape", F.lit("").alias("template"), "n", "lab", "blk")
    nodes = growing = materialise(nodes, "url-nodes")
    done, level = [nodes.where(F.size("shape") == 0)], 0
    growing = growing.where(F.size("shape") > 0)
    while not growing.isEmpty():
        grown = materialise(_grow(growing, level, p), "url-level")
        level += 1
        tail = F.concat("template", F.lit("/"), F.array_join(F.slice("shape", level + 1, F.greatest(F.size("shape") - level, F.lit(1))), "/"))
        deeper = F.size("shape") > level
        below = grown.where(deeper).groupBy("host", "template").agg(F.count(F.lit(1)).alias("below")).where("below > 1").select("host", "template")
        growing = materialise(grown.where(deeper).join(below, ["host", "template"], "left_semi"), "url-growing")
        done.append(grown.where(~deeper))
        done.append(grown.where(deeper).join(below, ["host", "template"], "left_anti").withColumn("template", tail))
    nodes = materialise(reduce(DataFrame.unionByName, done), "url-templates")
    per = nodes.groupBy("host", "template").agg(F.sum("lab").alias("lab"), F.sum("blk").alias("blk"))
    host = per.groupBy("host").agg(F.sum("lab").alias("h_lab"), F.sum("blk").alias("h_blk"))
    whole = host.agg(F.sum("h_lab").alias("a_lab"), F.sum("h_blk").alias("a_blk")).first()
    prior = float(((whole["a_blk"] or 0) + 1) / ((whole["a_lab"] or 0) + 2))
    purity_h = (F.col("h_blk") + p.smoothing * prior) / (F.col("h_lab") + p.smoothing)
    purity = (F.col("blk") + p.smoothing * F.col("purity_h")) / (F.col("lab") + p.smoothing)
    judged = per.join(host.select("host", purity_h.alias("purity_h")), "host").select(
        "host", "template", "lab", "blk", purity.alias("purity"), (purity >= p.reject_at).alias("reject"))
    return nodes.select("host", "shape", "template", "n").join(judged, ["host", "template"])


def filter_urls(pages: DataFrame, rules: list[Rule], params: TemplateParams | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, labelled, blocked and purity of every row of pages."""
    p = params or TemplateParams()
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cut = cut.withColumn("judged", match_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shapes_of(F.col("path")))
    cut = cut.select("page_id", "host", "path", "shape", F.col("judged.rule").alias("rule"), F.col("judged.verdict").alias("verdict"))
    learned = materialise(learn_templates(cut, p), "url-learned")
    out = join_heavy(cut, learned, ["host", "shape"], F.col("n") > heavy_above(pages.count()))
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("template") == "", F.lit("/")).otherwise(F.col("template")).alias("template"),
        F.col("lab").alias("labelled"), F.col("blk").alias("blocked"), F.round("purity", 6).alias("purity"),
    )
