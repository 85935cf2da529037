"""An inverted file of vectors: lists around centroids of a distributed k-means, a few of them asked for each query."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, shared_dir
from .linking import nearest
from .registry import query

#: Lists at most (their centroids are held by every task); rows and queries that meet in one task; rounds of k-means.
LISTS, ROWS, QUERIES, ROUNDS = 4096, 1 << 15, 2048, 6
#: Sums of coordinates are whole numbers of this part, so they don't depend on the order of rows.
UNIT = 1 << 32


def _matrix(column) -> np.ndarray:
    rows = np.array(column.to_pylist(), np.float64)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300) if len(rows) else rows


def _summed(centres):
    """(did, vec) to (list, at, s): sums of the unit vectors nearest to each centre, by coordinate, added up within a task; at -1 counts them."""

    def run(batches):
        c = centres.value
        total = np.zeros((len(c), c.shape[1] + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                own = np.argmax(x @ c.T, axis=1)
                np.add.at(total, own, np.concatenate((np.round(x * UNIT).astype(np.int64), np.ones((len(x), 1), np.int64)), axis=1))
        held = np.flatnonzero(total[:, -1])
        at = np.tile(np.r_[np.arange(c.shape[1]), -1], len(held)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, c.shape[1] + 1).astype(np.int32)), pa.array(at), pa.array(total[held].ravel())], names=["list", "at", "s"])

    return run


def centroids(rows: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of `lists` groups of rows (did, vec) by direction, each of all rows; the driver holds them, LISTS at most.

    They begin at the rows whose hashed ids are least; a group that loses all rows keeps its place. Sums are exact, so the same
    rows give the same centroids however they are dealt."""
    first = rows.orderBy(F.xxhash64("did"), "did").limit(min(lists, LISTS)).select("vec").toArrow()
    centres = _matrix(first.column("vec"))
    for _ in range(rounds if len(centres) else 0):
        held = rows.sparkSession.sparkContext.broadcast(centres)
        sums = rows.select("did", "vec").mapInArrow(_summed(held), "list int, at int, s long").groupBy("list", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("double").alias("s")).where("at >= 0").toArrow()
        moved = centres.copy()
        place, at, s = (sums.column(c).to_numpy() for c in ("list", "at", "s"))
        moved[place, at] = s
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-300)
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    return centres


@dataclass
class VectorIndex:
    rows: DataFrame
    sizes: DataFrame
    centres: np.ndarray


def build_vectors(rows: DataFrame, path: str, lists: int | None = None) -> None:
    """Write an inverted file over rows (did, vec) below path: `lists` (list, part, did, vec) and `centroids`.

    By default as many lists as the root of the rows, LISTS at most. A list of over ROWS rows is kept in parts. Null vectors are in no list.
    """
    spark = rows.sparkSession
    rows = rows.where("vec IS NOT NULL").select("did", F.col("vec").cast("array<double>").alias("vec"))
    lists = lists or max(1, min(LISTS, math.isqrt(rows.count())))
    centres = centroids(rows, lists)
    held = spark.sparkContext.broadcast(centres)

    def dealt(batches):
        for batch in batches:
            own = np.argmax(_matrix(batch.column(1)) @ held.value.T, axis=1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["did", "vec", "list"])

    kind = dict(rows.dtypes)["did"]
    listed = cut(rows.mapInArrow(dealt, f"did {kind}, vec array<double>, list int"))
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"))
    placed = listed.join(F.broadcast(parts), "list").select("list", F.pmod(F.xxhash64("did"), "parts").cast("int").alias("part"), "did", "vec")  # LISTS rows at most
    placed.repartitionByRange("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{path}/lists")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centroids")


def load_vectors(spark: SparkSession, path: str) -> VectorIndex:
    rows, centres = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/centroids").toArrow().sort_by("list")
    return VectorIndex(rows, rows.groupBy("list").agg((F.max("part") + 1).alias("parts")), np.array(centres.column("centre").to_pylist(), np.float64))


def tuned_probes(index: VectorIndex, k: int, recall: float = 0.95, sample: int = 64) -> int:
    """The least number of lists that holds this share of the k true neighbours of a sample of the index's own rows, at most `sample` of them; all lists are asked to find these."""
    if not len(index.centres):
        return 1
    q = index.rows.orderBy(F.xxhash64("did", F.lit(1)), "did").limit(sample).select(F.col("did").alias("qid"), "vec")
    true = probe_vectors(index, q, k, probes=len(index.centres)).select("qid", "did").join(index.rows.select("did", "list"), "did").join(q, "qid").select("vec", "list").toArrow()  # k * sample rows
    if not true.num_rows:
        return 1
    near = np.argsort(-(_matrix(true.column("vec")) @ index.centres.T), axis=1)
    place = np.sort(np.argmax(near == true.column("list").to_numpy()[:, None], axis=1))
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1


def probe_vectors(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, digits: int = 6) -> DataFrame:
    """(qid, did, score, rank): of the `probes` lists nearest to each query (qid, vec) the k rows with the largest product; own ids left out, ties by did.

    By default as many lists as tuned_probes finds; with all of them the answer is exact. A part of a list and some QUERIES of those that ask it meet as two
    matrices in one task, which returns k rows a query, so lists and queries of any size are dealt out. Null vectors are near nothing."""
    centres = index.centres
    held = queries.sparkSession.sparkContext.broadcast(centres)
    probes = min(len(centres), probes or tuned_probes(index, k))
    kind, own = dict(queries.dtypes)["qid"], dict(index.rows.dtypes)["did"]

    def asks(batches):
        for batch in batches:
            if batch.num_rows:
                best = np.argpartition(-(_matrix(batch.column(1)) @ held.value.T), probes - 1, axis=1)[:, :probes]
                yield pa.RecordBatch.from_arrays([c.take(pa.array(np.repeat(np.arange(batch.num_rows), probes))) for c in batch.columns] + [pa.array(best.ravel().astype(np.int32))], names=["qid", "vec", "list"])

    if not len(centres):
        return queries.join(index.rows, F.lit(False)).select("qid", "did", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    asked = cut(queries.where("vec IS NOT NULL").select("qid", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(asks, f"qid {kind}, vec array<double>, list int"))
    slices = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("slices"))
    shape = F.broadcast(cut(slices.join(index.sizes, "list")))  # LISTS rows at most
    q = asked.join(shape, "list").select("list", F.pmod(F.xxhash64("qid"), "slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "qid", "vec")
    r = index.rows.join(shape, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "part", "did", "vec")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        qids, dids, out = left.column("qid").to_pylist(), right.column("did").to_numpy(), []
        if qids and len(dids):
            scores = np.round(np.array(left.column("vec").to_pylist()) @ np.array(right.column("vec").to_pylist()).T, digits)
            for i, qid in enumerate(qids):
                top = np.lexsort((dids, -scores[i]))[: k + 1]
                out += [(qid, dids[j], scores[i][j]) for j in top if dids[j] != qid][:k]
        return pa.table([pa.array([x[n] for x in out], t) for n, t in enumerate((left.schema.field("qid").type, right.schema.field("did").type, pa.float64()))], names=["qid", "did", "score"])

    keys = ["list", "slice", "part"]
    found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(best, f"qid {kind}, did {own}, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "did"))).where(F.col("rank") <= k)


@query()
def ivf_topk(t) -> DataFrame:
    """The five nearest vectors of every fiftieth, by an inverted file over all; tests hold its recall against knn_topk."""
    import uuid

    path = f"{shared_dir(t.spark)}/vectors-{uuid.uuid4().hex}"
    e = t.embeddings.select(F.col("vec_id").alias("did"), F.col("embedding").alias("vec"))
    build_vectors(e, path)
    found = probe_vectors(load_vectors(t.spark, path), e.where("did % 50 = 0").withColumnRenamed("did", "qid"), 5)
    return found.select("qid", "did", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT qid, name, rank FROM (SELECT q.vec_id AS qid, 'v' || c.vec_id AS name, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) DESC, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id) WHERE rank <= 3")
def ranked_catalog(t) -> DataFrame:
    """Vector linking: every fiftieth vector asks a catalog of all others."""
    c = t.embeddings.select(F.col("vec_id").alias("did"), F.col("embedding").alias("vec"))
    found = nearest(c, c.where("did % 50 = 0").withColumnRenamed("did", "qid"), 3)
    return found.select("qid", F.concat(F.lit("v"), F.col("did").cast("string")).alias("name"), F.col("rank").cast("long").alias("rank"))
