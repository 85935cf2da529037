"""Scans, projections, filters, joins, aggregates, windows, sorts and set operations over a retail star.

Facts and large dimensions are joined plainly: Catalyst broadcasts a side whose size it knows to be small and
sorts or hashes otherwise, and adaptive execution splits skewed keys. Money is summed as decimals, exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .registry import query


def money(col):
    return F.col(col).cast("decimal(15,2)") if isinstance(col, str) else col.cast("decimal(15,2)")


def total(col):
    """An exact sum of money as a double."""
    return F.sum(money(col)).cast("double")


_SUM = "CAST(sum(CAST({0} AS DECIMAL(15,2))) AS DOUBLE)"


@query(f"""SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter, {_SUM.format('l_extendedprice')} AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def revenue_by_year_quarter(t) -> DataFrame:
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.groupBy(F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("long").alias("quarter")).agg(total("l_extendedprice").alias("revenue"))


@query(f"""SELECT {_SUM.format('l_extendedprice')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE year(o_orderdate) = 1998 AND quarter(o_orderdate) = 2""")
def revenue_one_quarter(t) -> DataFrame:
    """The year and quarter are given as a range of dates, which reaches the scan."""
    d = t.orders.where("o_orderdate >= date '1998-04-01' AND o_orderdate < date '1998-07-01'")
    return t.lineitem.join(d, F.col("l_orderkey") == F.col("o_orderkey")).agg(total("l_extendedprice").alias("revenue"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def scan_project(t) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT * FROM supplier")
def star_all(t) -> DataFrame:
    return t.supplier.select("*")


#: What a star stands for, by table.
STAR = {"part": ("p_partkey", "p_name", "p_brand", "p_type"), "customer": ("c_custkey", "c_name", "c_mktsegment"), "supplier": ("s_suppkey", "s_name")}


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part")
def star_expand(t) -> DataFrame:
    return t.part.select(*STAR["part"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq_str(t) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 15")
def filter_eq_int(t) -> DataFrame:
    return t.part.where(F.col("p_size") == 15).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 910 AND p_size >= 3 AND p_size <= 40 AND p_retailprice < 1500")
def filter_range(t) -> DataFrame:
    p = F.col("p_retailprice")
    return t.part.where((p > 910) & (F.col("p_size") >= 3) & (F.col("p_size") <= 40) & (p < 1500)).select("p_partkey", "p_retailprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -700.00")
def filter_neg_decimal(t) -> DataFrame:
    return t.customer.where(F.col("c_acctbal") < F.lit(-700.00)).select("c_custkey", "c_acctbal")


@query("""SELECT DISTINCT o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey""")
def filter_col_neq(t) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return d.where("c_nationkey <> s_nationkey").select("o_custkey").distinct()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (nullif(l_discount, 0) IS NULL OR l_tax = 0) AND l_quantity > 45")
def filter_or_null(t) -> DataFrame:
    return t.lineitem.where((F.nullif("l_discount", F.lit(0.0)).isNull() | (F.col("l_tax") == 0)) & (F.col("l_quantity") > 45)).select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL")
def filter_not_null(t) -> DataFrame:
    return t.lineitem.where(F.nullif("l_discount", F.lit(0.0)).isNotNull()).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'E%'")
def like_prefix(t) -> DataFrame:
    return t.part.where(F.col("p_type").like("E%")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%#1%'")
def like_infix(t) -> DataFrame:
    return t.part.where(F.col("p_brand").like("%#1%")).select("p_partkey", "p_brand")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%build%'")
def ilike_infix(t) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").ilike("%build%")).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(t) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND NOT o_orderstatus = 'F'")
def between_not(t) -> DataFrame:
    return t.orders.where(F.col("o_totalprice").between(1000, 50000) & ~(F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_join(t) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_join(t) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT count(*) AS \"TOTAL CUSTOMER\" FROM customer")
def quoted_alias(t) -> DataFrame:
    return t.customer.agg(F.count("*").alias("TOTAL CUSTOMER"))


@query("SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS promo FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL AND l_orderkey < 500")
def drop_null_rows(t) -> DataFrame:
    return t.lineitem.where("l_orderkey < 500").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("promo")).na.drop(subset=["promo"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def head_n(t) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(25)


@query(f"SELECT p_brand, {_SUM.format('l_extendedprice')} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY p_brand")
def join_fact_dim(t) -> DataFrame:
    return t.lineitem.join(t.part.where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(total("l_extendedprice").alias("revenue"))


@query("SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
def join_dim_first(t) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name").distinct()


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_snowflake(t) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query(f"""SELECT r_name, p_brand, count(*) AS n, {_SUM.format('l_extendedprice')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY r_name, p_brand""")
def join_star(t) -> DataFrame:
    o = t.orders.where("o_orderdate >= date '1997-01-01' AND o_orderdate < date '1998-01-01'")
    d = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    d = d.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy("r_name", "p_brand").agg(F.count("*").alias("n"), total("l_extendedprice").alias("revenue"))


@query("""SELECT s_suppkey, n_name AS supplier_nation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate > DATE '1998-06-01')""")
def join_role_key(t) -> DataFrame:
    """A dimension by the role it plays: the supplier's nation, not the customer's."""
    late = t.lineitem.where("l_shipdate > date '1998-06-01'")
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(late, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", F.col("n_name").alias("supplier_nation"))


@query("""SELECT DISTINCT p_partkey, p_name FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_shipdate > DATE '1998-09-01') ON p_partkey = l_partkey WHERE l_partkey IS NULL OR l_quantity = 1""")
def join_left_missing(t) -> DataFrame:
    late = t.lineitem.where("l_shipdate > date '1998-09-01'")
    return t.part.join(late, F.col("p_partkey") == F.col("l_partkey"), "left").where("l_partkey IS NULL OR l_quantity = 1").select("p_partkey", "p_name").distinct()


@query("SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 250000) RIGHT JOIN (SELECT * FROM customer WHERE c_custkey <= 200) ON o_custkey = c_custkey")
def join_right(t) -> DataFrame:
    return t.orders.where("o_totalprice > 250000").join(t.customer.where("c_custkey <= 200"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@query("SELECT n_name, count(c_custkey) AS customers, count(n_name) AS n FROM nation FULL JOIN (SELECT * FROM customer WHERE c_acctbal < 0) ON n_nationkey = c_nationkey GROUP BY n_name")
def join_full(t) -> DataFrame:
    return t.nation.join(t.customer.where("c_acctbal < 0"), F.col("n_nationkey") == F.col("c_nationkey"), "full").groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.count("n_name").alias("n"))


@query(f"""WITH cy AS (SELECT {_SUM.format('o_totalprice')} AS revenue FROM orders WHERE year(o_orderdate) = 1997),
py AS (SELECT {_SUM.format('o_totalprice')} AS revenue FROM orders WHERE year(o_orderdate) = 1996)
SELECT round(cy.revenue - py.revenue, 2) AS change, round(100 * (cy.revenue / py.revenue - 1), 4) AS growth_pct FROM cy, py""")
def cte_yoy_change(t) -> DataFrame:
    """Two one-row aggregates, paired: the only cross join, of a row with a row."""
    year = lambda y, n: t.orders.where(f"o_orderdate >= date '{y}-01-01' AND o_orderdate < date '{y + 1}-01-01'").agg(total("o_totalprice").alias(n))
    return year(1997, "cy").crossJoin(year(1996, "py")).select(F.round(F.col("cy") - F.col("py"), 2).alias("change"), F.round(100 * (F.try_divide("cy", "py") - 1), 4).alias("growth_pct"))


@query("SELECT count(*) AS total_customers FROM customer")
def count_all(t) -> DataFrame:
    return t.customer.agg(F.count("*").alias("total_customers"))


@query(f"SELECT {_SUM.format('o_totalprice')} AS revenue, count(*) AS n FROM orders WHERE o_orderdate > DATE '2100-01-01'")
def sum_empty(t) -> DataFrame:
    """Over no rows a sum is null and a count is 0."""
    return t.orders.where("o_orderdate > date '2100-01-01'").agg(total("o_totalprice").alias("revenue"), F.count("*").alias("n"))


@query(f"SELECT {_SUM.format('l_extendedprice')} AS revenue FROM lineitem WHERE l_returnflag = 'R'")
def sum_money(t) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").agg(total("l_extendedprice").alias("revenue"))


@query("SELECT round(avg(l_quantity), 6) AS avg_quantity FROM lineitem")
def avg_qty(t) -> DataFrame:
    return t.lineitem.agg(F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("avg_quantity"))


@query("SELECT count(DISTINCT o_custkey) AS customers FROM orders")
def count_distinct(t) -> DataFrame:
    return t.orders.agg(F.countDistinct("o_custkey").alias("customers"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority")
def count_distinct_grouped(t) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"))


@query("""SELECT p_type, round(CAST(sum(CASE WHEN nullif(l_discount, 0) IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS promo_ratio
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type""")
def promo_ratio(t) -> DataFrame:
    sold = F.when(F.nullif("l_discount", F.lit(0.0)).isNotNull(), 1).otherwise(0)
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.round(F.sum(sold).cast("double") / F.count("*"), 6).alias("promo_ratio"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def group_one(t) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_two(t) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("avg_qty"))


@query(f"SELECT CAST(month(o_orderdate) AS BIGINT) AS month, count(*) AS n, {_SUM.format('o_totalprice')} AS revenue, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def group_multi_agg(t) -> DataFrame:
    return t.orders.groupBy(F.month("o_orderdate").cast("long").alias("month")).agg(F.count("*").alias("n"), total("o_totalprice").alias("revenue"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@query(f"SELECT c_name, {_SUM.format('o_totalprice')} AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def group_hidden_key(t) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_name").agg(total("o_totalprice").alias("spent")).select("c_name", "spent")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(CAST(o_totalprice AS DECIMAL(15,2))) > 1500000")
def having_sum(t) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("s")).where("s > 1500000").select("o_custkey")


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_one(t) -> DataFrame:
    return t.orders.select("o_orderpriority").distinct()


@query("SELECT DISTINCT l_returnflag, l_linestatus, nullif(l_tax, 0) AS tax FROM lineitem")
def distinct_multi(t) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", F.nullif("l_tax", F.lit(0.0)).alias("tax")).distinct()


@query("""SELECT 'p_brand' AS column_name, array_to_string((list(DISTINCT p_brand ORDER BY p_brand))[1:15], '|') AS sample FROM part
UNION ALL SELECT 'p_type', array_to_string((list(DISTINCT p_type ORDER BY p_type))[1:15], '|') FROM part
UNION ALL SELECT 'p_size', array_to_string((list(DISTINCT CAST(p_size AS VARCHAR) ORDER BY CAST(p_size AS VARCHAR)))[1:15], '|') FROM part""")
def sample_values(t) -> DataFrame:
    """The first fifteen distinct values, as text, of columns: values are made distinct before they meet."""
    cols = ["p_brand", "p_type", "p_size"]
    pairs = t.part.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols))).alias("x"))
    distinct = pairs.select("x.*").where("v IS NOT NULL").distinct()
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy("column_name").orderBy("v"))).where("r <= 15")
    return ranked.groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("v")), "|").alias("sample"))


@query("SELECT event_type, round(avg(value), 4) AS mean_value, round(stddev_samp(value), 4) AS std_value FROM events GROUP BY event_type")
def mean_std(t) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.stddev_samp("value"), 4).alias("std_value"))


@query("SELECT round(avg(CAST(quality AS DOUBLE)), 6) AS rate, round(avg(CASE WHEN toxic = 1 THEN CAST(quality AS DOUBLE) END), 6) AS rate_toxic FROM labels")
def rate_masked(t) -> DataFrame:
    q = F.col("quality").cast("double")
    return t.labels.agg(F.round(F.avg(q), 6).alias("rate"), F.round(F.avg(F.when(F.col("toxic") == 1, q)), 6).alias("rate_toxic"))


@query("SELECT count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) AS total, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 4) AS good_pct FROM labels")
def count_if_report(t) -> DataFrame:
    good = F.count_if(F.col("quality") == 1)
    return t.labels.agg(good.alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count("*").alias("total"), F.round(100 * good / F.count("*"), 4).alias("good_pct"))


@query("SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def latency_buckets(t) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy(F.when(v < 10, "low").when(v < 50, "middle").otherwise("high").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(t) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY text, lang")
def dedupe_keep_first(t) -> DataFrame:
    """The row of the smallest id of each text: a partial aggregate instead of a window over copies."""
    return t.documents.groupBy("text", "lang").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "lang")


def ntiles(df: DataFrame, n: int, key: str, order: list[tuple[str, bool]]) -> DataFrame:
    """df with `tile`: NTILE(n) over the whole table by (column, descending) of order, nulls last, then by the unique key; no task gathers the table.

    Only key and order are sorted: range-partitioned, written once (ranges are sampled, so they differ each time they are
    planned), counted by partition, and numbered from their partition's offset. The other columns are joined by the key."""
    columns = list(dict.fromkeys([*(c for c, _ in order), key]))
    by = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order] + [F.col(key).asc_nulls_last()]
    ranged = cut(df.select(*columns).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    placed = numbered.join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_at") + F.col("_before") - 1)
    base, extra = F.floor(F.col("_total") / n), F.col("_total") % n
    tile = F.when(F.col("_at") < extra * (base + 1), F.floor(F.col("_at") / (base + 1))).otherwise(extra + F.floor((F.col("_at") - extra * (base + 1)) / F.greatest(base, F.lit(1)))) + 1
    tiled = placed.withColumn("tile", tile.cast("long"))
    if set(df.columns) == set(columns):
        return tiled.select(*df.columns, "tile")
    return df.join(tiled.select(F.col(key).alias("_key"), "tile"), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


@query("SELECT c_custkey, ntile(4) OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS customer_segment FROM customer")
def ntile4(t) -> DataFrame:
    d = t.customer.select("c_custkey", "c_acctbal")
    return ntiles(d, 4, "c_custkey", [("c_acctbal", True)]).select("c_custkey", F.col("tile").alias("customer_segment"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def top1_per_group(t) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


@query("SELECT s_nationkey, s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS rnk, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC) AS dense FROM supplier")
def rank_per_group(t) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc_nulls_last())
    return t.supplier.select("s_nationkey", "s_suppkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"))


@query("SELECT o_orderkey, CAST(o_orderdate - lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS days FROM (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders)")
def lag_days(t) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.date_diff(F.col("o_orderdate").cast("date"), F.lag(F.col("o_orderdate").cast("date")).over(w)).cast("long").alias("days"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def topk_desc(t) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(10)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name")
def sort_all(t) -> DataFrame:
    return t.nation.select("n_nationkey", "n_name").orderBy(F.col("n_name").asc_nulls_last())


@query("SELECT p_partkey, l_orderkey, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey ORDER BY p_retailprice ASC, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def sort_mixed(t) -> DataFrame:
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return d.orderBy(F.col("p_retailprice").asc_nulls_last(), F.col("l_extendedprice").desc_nulls_last(), "l_orderkey", "l_linenumber").limit(10).select("p_partkey", "l_orderkey", "l_extendedprice")


@query(f"SELECT p_brand, {_SUM.format('l_extendedprice')} AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY total DESC, p_brand LIMIT 5")
def sort_agg_alias(t) -> DataFrame:
    d = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(total("l_extendedprice").alias("total"))
    return d.orderBy(F.col("total").desc_nulls_last(), "p_brand").limit(5)


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, year LIMIT 1")
def argmax_group(t) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "year").limit(1)


@query("SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS promo FROM lineitem ORDER BY nullif(l_discount, 0) ASC NULLS LAST, l_orderkey, l_linenumber LIMIT 20")
def nulls_last_sort(t) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("promo")).orderBy(F.col("promo").asc_nulls_last(), "l_orderkey", "l_linenumber").limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def page_after(t) -> DataFrame:
    """Keyset paging: the rows after a token."""
    return t.orders.where("o_orderkey > 1000").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(50)


@query("SELECT doc_id, 0 AS priority FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1 FROM labels WHERE quality = 1")
def bag_union_priority(t) -> DataFrame:
    first = t.documents.where("lang = 'en'").select("doc_id", F.lit(0).alias("priority"))
    return first.unionByName(t.labels.where("quality = 1").select("doc_id", F.lit(1).alias("priority")))


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 0")
def set_intersect(t) -> DataFrame:
    return t.documents.select("doc_id").intersect(t.labels.where("quality = 0").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(t) -> DataFrame:
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id")).distinct()


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)")
def scalar_subquery(t) -> DataFrame:
    mean = t.orders.agg((F.lit(1.9) * F.avg("o_totalprice")).alias("m"))
    return t.orders.crossJoin(F.broadcast(mean)).where("o_totalprice > m").select("o_orderkey")  # one row


@query("WITH RECURSIVE r AS (SELECT 1::BIGINT AS n UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n, n * n AS square FROM r")
def recursive_cte(t) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE r(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n, n * n AS square FROM r")
