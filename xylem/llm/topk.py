"""Exact top-k search by inner product: tiled matrix products.

Queries and candidates are dealt into tiles of bounded size; each pair of a query tile and a candidate tile is one
group, whose product is computed in blocks of queries and reduced to the best k of each query by partial selection.
The tiles' lists are merged in a tree of bounded fan-in. Components are floor(scale * x) as integers, so that scores
are exact: products run in double precision while every sum stays below 2**53, in 64-bit integers while below 2**63, and
else in Python's. A score is a long: a listed score beyond 63 bits raises an error, and so does a component whose scaled
value is.

Nulls and odd rows: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows with a
null id; vectors of fewer components count as padded by zeros, and an empty one scores 0; equal scores go to the
smaller id; a query id is searched once, by the least vector of its rows, and none of its rows is its candidate; other
repeated rows are candidates each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TopKParams:
    k: int = 20
    scale: float = 64.0
    query_tile: int = 16384
    shard: int = 8192
    block: int = 256
    fan_in: int = 16


def whole_vector(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, finite)


def _floor(x: Column) -> Column:
    return F.when(F.abs(x) < float(1 << 63), F.floor(x)).otherwise(F.raise_error(F.lit("a scaled component is beyond 63 bits")).cast("long"))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def best_of(queries: np.ndarray, query_ids: np.ndarray, cands: np.ndarray, ids: np.ndarray, k: int, block: int):
    """(query id, candidate id, score) arrays of the best k candidates of each query, its own row excepted."""
    order = np.argsort(ids, kind="stable")
    cands, ids = cands[order], ids[order]
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(cands).max(initial=0)) * max(1, queries.shape[1])
    exact = np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
    right = cands.astype(exact).T
    out = []
    for at in range(0, len(queries), block):
        score = queries[at : at + block].astype(exact) @ right
        score = score if exact is object else score.astype(np.int64)
        own = query_ids[at : at + block, None] == ids[None, :]
        for row, (q, s) in enumerate(zip(query_ids[at : at + block], score, strict=True)):
            s, c = s[~own[row]], ids[~own[row]]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > least)
                keep = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])  # ids rise: ties to the smaller
                s, c = s[keep], c[keep]
            if exact is object and any(abs(x) >= 1 << 63 for x in s):
                raise ValueError(f"a score of query {q} is beyond 63 bits")
            out.append((np.full(len(s), q), c, s.astype(np.int64)))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def top_k(vectors: DataFrame, is_query: Column, params: TopKParams | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the best k other rows for each row where is_query holds."""
    p = params or TopKParams()
    rows = vectors.where(F.col("vec_id").isNotNull() & whole_vector(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: _floor(x.cast("double") * p.scale)).alias("v"), is_query.alias("q"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    q_tiles, tiles = -(-int(n["q"]) // p.query_tile) or 1, -(-int(n["n"]) // p.shard) or 1
    deal = lambda of: F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    asked = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"), deal(q_tiles).alias("qt"), every(tiles).alias("ct"))
    cands = rows.select(F.col("vec_id").alias("cand_id"), F.col("v").alias("cand"), every(q_tiles).alias("qc"), deal(tiles).alias("cc"))

    def product(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        width = max([0, *map(len, left["query"]), *map(len, right["cand"])])
        q, c, s = best_of(_matrix(left["query"], width), left["query_id"].to_numpy(np.int64), _matrix(right["cand"], width), right["cand_id"].to_numpy(np.int64), p.k, p.block)
        return pd.DataFrame({"query_id": q, "vec_id": c, "score": s, "tile": np.full(len(q), key[1], dtype=np.int32)})

    found = queries.groupBy("qt", "ct").cogroup(cands.groupBy("qc", "cc")).applyInPandas(product, "query_id long, vec_id long, score long, tile int")
    while True:
        tiles = -(-tiles // p.fan_in)
        found = found.withColumn("tile", (F.col("tile") / p.fan_in).cast("int"))
        w = W.partitionBy("query_id", "tile").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= p.k)
        if tiles <= 1:
            return found.select("query_id", "rank", "vec_id", "score")
