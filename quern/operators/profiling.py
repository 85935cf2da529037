"""Samples: values of many columns in one pass, and an exact number of rows without a sort."""

from __future__ import annotations

import hashlib
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import query

#: Bits of a hash that a round of selection tells apart; bits of the hash.
STEP, BITS = 12, 60


def _least(k: int):
    """All columns of a partition to (at, h, value): of each the k distinct values with the least MD5."""

    def run(batches):
        kept: dict[str, dict[str, str]] = {}
        for batch in batches:
            for name, column in zip(batch.schema.names, batch.columns):
                own = kept.setdefault(name, {})
                new = {v: hashlib.md5(v.encode()).hexdigest() for v in column.unique().to_pylist() if v is not None and v not in own}
                kept[name] = {v: h for h, v in nsmallest(k, ((h, v) for v, h in (own | new).items()))}
        flat = [(c, h, v) for c, own in kept.items() for v, h in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], pa.string()) for i in range(3)], names=["at", "h", "value"])

    return run


def sampled_values(tables: dict[str, DataFrame], k: int = 5) -> DataFrame:
    """(table, column, rank, value): of each column the k distinct values, as strings, with the least MD5; nulls are no values.

    A table is read once for all its columns. A task keeps k values a column, the least of those are the column's, so what
    moves doesn't grow with the rows and the sample is the same however they are dealt. A column of nulls alone has no row."""
    found = None
    for name, df in tables.items():
        strings = df.toDF(*map(str, range(len(df.columns))))  # by place, for a name may hold a dot
        found_here = strings.select(*(F.col(c).cast("string") for c in strings.columns)).mapInArrow(_least(k), "at string, h string, value string")
        one = found_here.select(F.lit(name).alias("table"), F.get(F.array(*map(F.lit, df.columns)), F.col("at").cast("int")).alias("column"), "h", "value")
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("table", "column").orderBy("h", "value"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("table", "column", F.col("rank").cast("long").alias("rank"), "value")


def hashed(*cols) -> F.Column:
    """A hash of 60 bits that SQL can say as well: the first fifteen digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c for c in cols))), 1, BITS // 4), 16, 10).cast("long")


def least_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows of df (all, if it has fewer): those whose hashed unique key is least; the same for every partitioning.

    The n-th hash is found by histograms: of 2 ** STEP ranges the one that holds it is parted again, until its rows share one
    hash or fit. The driver holds one histogram; no round moves or sorts rows. Equal hashes are taken by key."""
    rows = df.withColumn("_h", hashed(F.lit(seed), key))
    low, left, width = 0, max(0, n), BITS
    while True:
        width = max(0, width - STEP)
        inside = rows.select("_h").where((F.col("_h") >= low) & (F.col("_h") < low + (1 << min(BITS, width + STEP))))
        counts = {r["at"]: r["n"] for r in inside.groupBy(F.shiftright(F.col("_h") - low, width).alias("at")).agg(F.count("*").alias("n")).collect()}  # 2 ** STEP rows at most
        at, over = 0, False
        for at in sorted(counts):
            if left < counts[at]:
                over = True
                break
            left -= counts[at]
        if not over:  # the range ends with the n-th row, or df does
            low += 1 << min(BITS, width + STEP)
            break
        low += at << width
        if left == 0 or width == 0:
            break
    whole = rows.where(F.col("_h") < low)
    if left:
        ties = rows.where(F.col("_h") == low).withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy(key))).where(F.col("_r") <= left).drop("_r")
        whole = whole.unionByName(ties)
    return whole.drop("_h")


def exact_split(df: DataFrame, key: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(first, rest): round(share * rows) rows drawn by hash, and the others; key is unique and not null."""
    first = least_rows(df, key, round(share * df.count()), seed)
    return first, df.join(first.select(key), key, "left_anti")


_SAMPLED = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]}
_ONE_SQL = "SELECT '{t}' AS \"table\", '{c}' AS \"column\", value, row_number() OVER (ORDER BY md5(value)) AS rank FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL)"


@query("SELECT * FROM (" + " UNION ALL ".join(_ONE_SQL.format(t=t, c=c) for t, cs in _SAMPLED.items() for c in cs) + ") WHERE rank <= 5")
def column_samples(t) -> DataFrame:
    """Five values of each of fourteen columns of three tables, a pass over each."""
    return sampled_values({name: getattr(t, name).select(*cols) for name, cols in _SAMPLED.items()})


_HASH_SQL = "CAST('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)"


@query(f"SELECT doc_id, CASE WHEN r <= round(0.9 * n) THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY {_HASH_SQL}, doc_id) AS r, count(*) OVER () AS n FROM documents)")
def exact_train_test(t) -> DataFrame:
    """Documents parted into exactly nine tenths and the rest."""
    train, test = exact_split(t.documents.select("doc_id"), "doc_id", 0.9)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
