"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task contracts at once: bounds its memory.
CHUNK = 1 << 16


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _find(parent: dict, x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = x = parent[up]
    return x


def _join(parent: dict, batch: pa.RecordBatch) -> None:
    for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        u, v = _find(parent, u), _find(parent, v)
        if u != v:
            parent[max(u, v)] = min(u, v)


def contract(batches):
    """(u, v) to as few (u, v) with the same components: each CHUNK of edges becomes stars around its smallest nodes."""

    def stars(parent: dict) -> pa.RecordBatch:
        us = [u for u in parent if _find(parent, u) != u]
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array([_find(parent, u) for u in us], pa.int64())], names=["u", "v"])

    parent, seen = {}, 0
    for batch in batches:
        _join(parent, batch)
        seen += batch.num_rows
        if seen >= CHUNK:
            yield stars(parent)
            parent, seen = {}, 0
    yield stars(parent)


def roots(batches):
    """(u, v) to (node, root) of each node, for a task that has all edges."""
    parent: dict = {}
    for batch in batches:
        _join(parent, batch)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([_find(parent, x) for x in nodes], pa.int64())], names=["node", "root"])


def _whole(edges: DataFrame) -> DataFrame:
    """components() of CHUNK edges at most: one task joins them, and no round has to confirm what it found."""
    return cut(edges.coalesce(1).mapInArrow(roots, "node long, root long")).coalesce(1)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node that it reaches.

    Tasks contract what edges they hold before these are shuffled, as a partial aggregate does. Neither star
    gathers a node's neighbours: each takes their minimum with a partial aggregate and joins it back, so a hub is
    a skewed join that adaptive execution splits. Self links and null ends are ignored; no links give no rows.
    Every round is cut to the shared folder; rounds grow with the logarithm of the nodes. A round's tasks follow the
    edges, CHUNK to a task, so a few edges don't pass through as many files as the session has shuffle partitions.
    As soon as no more than CHUNK edges are left, one task ends the job: each exchange of a round costs the driver
    a thread and a plan, however few rows it has.
    """
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    count = ends.count()
    if count <= CHUNK:
        return _whole(ends)
    tasks = 1 + count // CHUNK
    edges = cut(ends.coalesce(tasks).mapInArrow(contract, "u long, v long"))
    state = _state(edges)
    while state[0] > CHUNK:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        return _whole(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
