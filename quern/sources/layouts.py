"""Tables laid out for what is asked of them: partitioned folders that queries prune, buckets that join without a shuffle, ORC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition that one file takes at most.
FILE_ROWS = 5_000_000


def write_partitioned(df: DataFrame, path: str, by: list[str], kind: str = "parquet") -> None:
    """Write df in a folder for each value of `by` (null is one), in Parquet or ORC.

    Rows go to their folder's writers first, so a folder has few files; one of very many rows is dealt over several by a hash of its
    rows, and none is written over FILE_ROWS rows to a file. Readers skip folders that a filter, or the other side of a join, leaves out."""
    keys = [f"_by{i}" for i in range(len(by))]
    sizes = df.groupBy(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys))).agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_files"))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in by]
    dealt = df.join(sizes, [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(by, keys)], "left").withColumn("_file", F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.col("_files"))).drop("_files", *keys)
    dealt.repartition(*by, "_file").drop("_file").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(*by).format(kind).save(path)


def read_partitioned(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).load(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, kind: str = "parquet") -> DataFrame:
    """Save df as a table of so many buckets by key, sorted in each, and read it: tables of as many buckets join and group by the key without a shuffle.

    Rows go to their bucket's writer first, so a bucket is one file. A key that holds many rows makes its bucket as large; such a table is better left to adaptive joins."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format(kind).saveAsTable(table)
    return df.sparkSession.table(table)
