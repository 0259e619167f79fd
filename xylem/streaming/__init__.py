"""Streams of XML documents: the shredder keeps no state, so per-document operators run unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shred import shred


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, xml, arrived) of whole files as they come into a folder."""
    raw = spark.readStream.option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xml"), F.col("_metadata.file_modification_time").alias("arrived"))


def node_stream(docs: DataFrame, **options) -> DataFrame:
    """The node rows of a stream of documents, malformed ones marked."""
    return shred(docs, mode=options.pop("mode", "PERMISSIVE"), **options)


def windowed_counts(rows: DataFrame, time: str, size: str, late: str, key: Column) -> DataFrame:
    """Counts by key and event-time window; rows later than `late` behind the watermark are not counted."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), key.alias("key")).count()
