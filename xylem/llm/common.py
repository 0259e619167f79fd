"""What several operators share: intermediate tables in the cluster's shared folder, label folds, bounded caches."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR = "spark.checkpoint.dir"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode (tests) one is made where the session names none."""
    found = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SHARED_DIR} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SHARED_DIR, found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: a cut lineage that outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/xylem-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialise` wrote and that nothing will read any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of at most `size` in the actions within, whatever the length of texts; then the session's own again."""
    own = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, own)


def heavy_above(rows: int) -> int:
    """Rows of one key beyond which `join_heavy` treats it apart: at most 10,000 keys can have so many of `rows`."""
    return max(1000, rows // 10_000)


def join_heavy(big: DataFrame, small: DataFrame, on: list[str], heavy: Column) -> DataFrame:
    """Inner join in which keys with very many rows in `big` don't meet in one task.

    small has a row for each key, and is written first. Its rows where `heavy` holds, at most 10,000 by `heavy_above`,
    are broadcast; the others are joined by a shuffle. Mostly there are none, and the join is a plain one.
    """
    small = materialise(small, "keys")
    hot = small.where(heavy)
    if hot.isEmpty():
        return big.join(small, on)
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(~heavy), on)
    return big.join(F.broadcast(hot), on).unionByName(rest)


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text modulo `of`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def known_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label) outside the held-out fold. Labels that are null or not 0/1, and those of a null id, are none; an id
    with several rows keeps its largest label."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, text, label): at most per_class known labels of each class with their texts.

    The rows of smallest hash are taken, from the label table alone; the bounded id list is then broadcast,
    so that the corpus is read once and not shuffled.
    """
    known = known_labels(labels, label, folds, held_out).withColumn("order", F.xxhash64("doc_id"))
    sides = [known.where(F.col("label") == y).orderBy("order", "doc_id").limit(per_class) for y in (0, 1)]
    ids = sides[0].unionAll(sides[1]).select("doc_id", "label")
    text = docs.select("doc_id", "text").where(fold(F.col("doc_id"), folds) != held_out)
    return text.join(F.broadcast(ids), "doc_id")


def class_rates(labels: DataFrame, label: str, folds: int, held_out: int) -> tuple[int, int]:
    """Known labels of 0 and 1."""
    found = known_labels(labels, label, folds, held_out).agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).first()
    return int(found["n0"] or 0), int(found["n1"] or 0)


class Cache(dict):
    """A dict that makes missing values by a function.

    Keys of more than `longest` characters are not held, and it starts afresh when it holds `most`, so that its size has a bound.
    """

    def __init__(self, make, most: int = 150_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def salts(n: int) -> Column:
    """One row for each salt 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
