"""Queries over layouts: pruned partitions, co-located buckets, ORC."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import layouts
from .registry import query


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) IN (SELECT year(max(o_orderdate)) FROM orders WHERE o_orderstatus = 'F') GROUP BY o_orderpriority""")
def partition_pruning(t) -> DataFrame:
    """Orders kept by year, of which only the last with finished orders is read: the year comes from the other side of a join."""
    path = f"{shared_dir(t.spark)}/layout-{uuid.uuid4().hex}"
    layouts.write_partitioned(t.orders.withColumn("year", F.year("o_orderdate")), path, ["year"])
    last = t.orders.where("o_orderstatus = 'F'").agg(F.year(F.max("o_orderdate")).alias("year"))
    facts = layouts.read_partitioned(t.spark, path)
    return facts.join(F.broadcast(last), "year").groupBy("o_orderpriority").agg(F.count("*").alias("n"))  # one row


@query("SELECT o_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY o_orderkey")
def bucketed_join(t) -> DataFrame:
    """Orders and their lines, kept in as many buckets by the order: neither the join nor the grouping shuffles."""
    name = uuid.uuid4().hex
    orders = layouts.write_bucketed(t.orders.select("o_orderkey", "o_orderstatus"), f"orders_{name}", "o_orderkey", 8)
    lines = layouts.write_bucketed(t.lineitem.select("l_orderkey", "l_quantity"), f"lines_{name}", "l_orderkey", 8)
    joined = orders.where("o_orderstatus = 'O'").hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(15,2)")).cast("double").alias("quantity"))


@query("SELECT event_type, count(*) AS n, count(props) AS with_props, max(value) AS most FROM events GROUP BY event_type")
def orc_round_trip(t) -> DataFrame:
    """Events by type, written as ORC in a folder for each type and read back."""
    path = f"{shared_dir(t.spark)}/orc-{uuid.uuid4().hex}"
    layouts.write_partitioned(t.events, path, ["event_type"], "orc")
    return layouts.read_partitioned(t.spark, path, "orc").groupBy("event_type").agg(F.count("*").alias("n"), F.count("props").alias("with_props"), F.max("value").alias("most"))
