"""Connected components of an edge table by alternating large and small stars.

Nulls and odd rows: edges with a null end or of a node with itself are left out; repeated edges count once, in either
direction; an empty table has no components; further columns are ignored. Node ids are longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, heavy_above, join_heavy, materialise


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star step on n (a, b) edges: neighbours are linked to the least neighbour of their common node.

    Least neighbours are found by partial aggregation; the few nodes of very many edges are joined by broadcast.
    """
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("degree"))
    met = join_heavy(both, least, ["a"], F.col("degree") > heavy_above(2 * n))
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp) of every node of (a, b) edges; comp is the least id of the node's component.

    Rounds end when a step changes no edge; they are logarithmic in the longest path.
    """
    edges = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where(F.col("a") != F.col("b")).distinct(), "edges")
    state, n = None, edges.count()
    for _ in range(rounds if n else 0):
        fresh = materialise(_star(_star(edges, True, n), False, n), "edges")
        row = fresh.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        discard(edges)
        edges, n = fresh, row["n"]
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    else:
        if n:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
