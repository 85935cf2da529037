"""Helpers that the corpus operators share: staging, bounded broadcasts, Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_dir  # noqa: F401

#: A word is a run of characters other than ASCII white space (0x20, 0x09-0x0D).
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of whole texts that go to a Python worker at once: bounds its memory even for very long texts.
TEXT_BATCH = 512
#: Bytes of a staged table that a task reads at least, where there are more tasks than cores.
PACK = 8 << 20
#: Bytes of a staged table that one task reads: joins and groups of such tables alone need no exchange.
ONE = 1 << 18


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared place, whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def packed(df: DataFrame) -> DataFrame:
    """df cut to the shared folder and read by as many tasks as the cores or its bytes (PACK a task) ask for, if that is fewer; up to ONE bytes by one.

    A small result of a shuffle has as many parts as the session has shuffle partitions; read so, each later step over it
    would take a task and a file for a few rows. No order of rows is kept, as after any shuffle."""
    out = cut(df)
    spark, rdd = df.sparkSession, out._jdf.queryExecution().logical().rdd()
    place = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    tasks = 1 if size <= ONE else max(spark.sparkContext.defaultParallelism, size // PACK)
    # A single part is said to be one, else the next join or group would deal it out.
    return out.coalesce(tasks) if tasks == 1 or tasks < rdd.getNumPartitions() else out


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small (Spark bounds their bytes besides); a lower setting of the session stays.

    Plans read the setting when they run, which is later than they are made, so it stays set for the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key) or 0)
    if now <= 0 or now > TEXT_BATCH:
        spark.conf.set(key, str(TEXT_BATCH))


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has no more than so many rows; reads no more than it needs to tell."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df marked for a broadcast if it has at most so many (narrow) rows, else as the hashed side of a shuffle."""
    return F.broadcast(df) if at_most(df, rows) else df.hint("shuffle_hash")


def lower_ascii(col):
    """A-Z lower-cased, all else untouched."""
    return F.translate(col, UPPER, LOWER)


def words(col):
    """The words of a text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(col, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df
