"""The subpackage's queries, with production parameters over whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, jpeg, mixing, ngram_join, quality, sharding, token_counts, topk, toxicity, url_filters

RULES = [
    url_filters.Rule("org", "/", "allow"),
    url_filters.Rule("example.org", "/es/", "block"),
    url_filters.Rule("example.org", "/en/1", "block"),
    url_filters.Rule("com", "/fr/", "allow"),
    url_filters.Rule("com", "/de/", "block"),
]
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.store_texts(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_similar(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_toxicity, op3_media_columns, op4_mixing, op5_sharding, op6_ngram_join, op7_token_counts, op8_quality, op9_topk, op10_byte_bpe)
}


URL_SQL = r"""
        WITH RECURSIVE u AS (
          SELECT page_id,
                 coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages
        ), r AS (
          SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
                         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
                         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
                         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
                 list_filter(string_split(path, '/'), lambda x: x <> '') AS seg
          FROM u
        ), j AS MATERIALIZED (
          SELECT page_id, host, path, rule,
                 CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict,
                 list_transform(seg, lambda x:
                   CASE WHEN regexp_full_match(x, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') THEN '{uuid}'
                        WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN '{date}'
                        WHEN regexp_full_match(x, '[0-9a-fA-F]{8,}') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-fA-F]') THEN '{hex}'
                        ELSE regexp_replace(x, '[0-9]+', '{n}', 'g') END) AS shape
          FROM r
        ), n0 AS MATERIALIZED (
          SELECT host, shape, count(*) AS n, count(verdict) AS lab, count(*) FILTER (verdict = 'block') AS blk FROM j GROUP BY 1, 2
        ), grown AS (  -- level by level: a row's next segment, its node's and its siblings' counts, and what the segment becomes
          SELECT host, shape, '' AS template, n, lab, blk, 0 AS level FROM n0
          UNION ALL
          SELECT host, shape, template || '/' || CASE
                   WHEN k > 1 AND ((k > 32 AND n_part < 0.05::DOUBLE * n_all)
                        OR abs(blk_part - rate * lab_part) * abs(blk_part - rate * lab_part) <= 4 * greatest(rate * (1 - rate), 0.01::DOUBLE) * lab_part)
                   THEN '*' ELSE part END, n, lab, blk, level + 1
          FROM (
            SELECT *, count(DISTINCT part) OVER a AS k, sum(n) OVER a AS n_all, sum(n) OVER c AS n_part, sum(lab) OVER c AS lab_part, sum(blk) OVER c AS blk_part,
                   sum(blk) OVER a / CAST(greatest(sum(lab) OVER a, 1) AS DOUBLE) AS rate
            FROM (SELECT *, shape[level + 1] AS part FROM grown WHERE level < len(shape))
            WINDOW a AS (PARTITION BY host, template), c AS (PARTITION BY host, template, part)
          )
        ), done AS MATERIALIZED (SELECT * FROM grown WHERE level = len(shape)),
        per AS (
          SELECT host, template, sum(lab) AS lab, sum(blk) AS blk FROM done GROUP BY 1, 2
        ), h AS (
          SELECT host, (sum(blk) + 5.0::DOUBLE * (SELECT (sum(blk) + 1) / CAST(sum(lab) + 2 AS DOUBLE) FROM per)) / (sum(lab) + 5.0::DOUBLE) AS purity_h
          FROM per GROUP BY 1
        ), q AS (
          SELECT per.*, (blk + 5.0::DOUBLE * purity_h) / (lab + 5.0::DOUBLE) AS purity FROM per JOIN h USING (host)
        )
        SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN purity >= 0.7::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
               CASE WHEN q.template = '' THEN '/' ELSE q.template END AS template,
               CAST(q.lab AS BIGINT) AS labelled, CAST(q.blk AS BIGINT) AS blocked, round(purity, 6) AS purity
        FROM j JOIN done ON done.host = j.host AND done.shape = j.shape JOIN q ON q.host = done.host AND q.template = done.template
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": URL_SQL,
    "op4_mixing": r"""
        WITH d AS MATERIALIZED (
          SELECT doc_id, source, size, CAST(floor(log2(greatest(size, 1))) AS INTEGER) AS cls, tag
          FROM (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17:' || md5(coalesce(text, ''))) AS tag, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)
        ), p AS (
          SELECT source, CAST(sum(size) AS DOUBLE) AS s, [3.0::DOUBLE, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY 1
        ), l AS (
          SELECT source, s, w, 2 * s AS cap,
                 (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY 2 * s / w, w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM p
        ), t AS (  -- targets of sources
          SELECT source, s, CASE WHEN cap <= level * w THEN cap ELSE w * max(level) FILTER (cap > level * w) OVER () END AS target FROM l
        ), c AS (
          SELECT source, cls, CAST(sum(size) AS DOUBLE) AS s FROM d GROUP BY 1, 2
        ), a AS (
          SELECT c.*, t.s AS source_size, t.target, 2 * c.s AS cap, pow(2.0, cls * -0.125) * greatest(c.s, 1e-9) AS w
          FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
        ), b AS (
          SELECT *, (target - coalesce(sum(cap) OVER (PARTITION BY source ORDER BY cap / w, w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(w) OVER (PARTITION BY source ORDER BY cap / w, w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM a
        ), e AS (  -- expected copies of a size class
          SELECT *, CASE WHEN s > 0 THEN least((CASE WHEN cap <= level * w THEN cap ELSE w * max(level) FILTER (cap > level * w) OVER (PARTITION BY source) END) / s, 2.0) ELSE 0 END AS copies
          FROM b
        ), f AS (
          SELECT source, cls, source_size, target, CAST(floor(copies + 1e-9) AS INTEGER) AS certain, greatest(copies - floor(copies + 1e-9), 0) AS chance,
                 target - sum(floor(copies + 1e-9) * s) OVER (PARTITION BY source) AS rest
          FROM e
        ), g AS (
          SELECT d.*, f.source_size, f.target, f.certain, f.rest,
                 CASE WHEN chance > 0 AND size > 0 THEN (u / (1 - u)) / (chance / greatest(1 - chance, 1e-12)) END AS rank
          FROM (SELECT *, (CAST(CAST('0x' || substr(tag, 1, 13) AS UBIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u FROM d) d
          JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.cls = f.cls
        ), h AS (  -- each source's documents in order of rank, up to its target
          SELECT *, sum(size) FILTER (rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, tag ROWS UNBOUNDED PRECEDING) AS after FROM g
        )
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
               CAST(CASE WHEN size > 0 THEN size * (certain + CASE WHEN rank IS NOT NULL AND after - size / 2.0 <= rest THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
        FROM h
    """,
    "op6_ngram_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents WHERE doc_id IS NOT NULL
        ), s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                 ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1
        ), p AS (
          SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
        ), l AS (
          SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.c + y.c - k)
        ), r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
        ), t AS (SELECT text, count(*) AS copies FROM w GROUP BY 1)
        SELECT w.doc_id, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.a = w.doc_id) AS links, t.copies
        FROM w JOIN t ON t.text = w.text
    """,
    "op9_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id
          WHERE q.vec_id % 20 = 0
        ), r AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
