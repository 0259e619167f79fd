"""Intermediate node tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def growing(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting on both sides.

    Spark guesses the size of a few columns from that of a whole compressed file or cache, and would send millions of
    rows to the driver to broadcast them. The hint holds through projections, filters and groups up to the next join.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The session's folder that driver and executors share. In local mode (tests) one is made where it names none."""
    folder = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SHARED_DIR} must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SHARED_DIR, folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it again."""
    path = f"{shared_folder(df.sparkSession)}/xylem-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return growing(df.sparkSession.read.schema(df.schema).parquet(path))
