"""Grouping sets, frames, inexact joins, paging and sampling: what plain SQL has beside the everyday operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .registry import query


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(t) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS no_flag FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(t) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return t.lineitem.groupingSets([[flag], [status], []], flag, status).agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("long").alias("no_flag"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(avg(value) FILTER (WHERE value > 10), 6) AS mean_above FROM events GROUP BY event_type")
def ordered_set_aggregates(t) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return t.events.groupBy("event_type").agg(p(0.5).alias("median"), p(0.9).alias("p90"), F.round(F.avg(F.when(F.col("value") > 10, F.col("value"))), 6).alias("mean_above"))


@query("""SELECT o_orderkey, lead(o_orderkey) OVER w AS next_order, first_value(o_orderkey) OVER w AS first_order,
last_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_order,
round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lead_first_last(t) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lead("o_orderkey").over(w).alias("next_order"), F.first("o_orderkey").over(w).alias("first_order"),
                           F.last("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last_order"),
                           F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.cume_dist().over(w), 6).alias("cume"))


@query("""SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three,
count(*) OVER (w RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS in_30_days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""".replace("(w RANGE", "(PARTITION BY o_custkey ORDER BY o_orderdate RANGE"))
def moving_frames(t) -> DataFrame:
    own = Window.partitionBy("o_custkey")
    rows = own.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    days = own.orderBy(F.col("o_orderdate").cast("timestamp_ltz").cast("long")).rangeBetween(-30 * 86400, 0)
    return t.orders.select("o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(15,2)")).over(rows).cast("double").alias("last_three"), F.count("*").over(days).alias("in_30_days"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, order: str) -> DataFrame:
    """left with `value`: that of the key's latest row of right at or before left's `at`; null if none, ties by the larger `order`.

    Both sides go to one place by their key, are sorted by time, and the last value is carried on: no pair of rows is made."""
    none = F.lit(None)
    types = dict(right.dtypes)
    a = left.withColumn("_side", F.lit(1)).withColumn("_o", none.cast(types[order])).withColumn("_v", none.cast(f"struct<v: {types[value]}>"))
    b = right.select(*(F.col(c) if c in (key, at) else none.cast(dict(left.dtypes)[c]).alias(c) for c in left.columns), F.lit(0).alias("_side"), F.col(order).alias("_o"), F.struct(F.col(value).alias("v")).alias("_v"))
    w = Window.partitionBy(key).orderBy(at, "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(w)["v"])
    return both.where("_side = 1").drop("_side", "_o", "_v")


@query("""SELECT p.event_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def as_of_join(t) -> DataFrame:
    """The user's last view before each purchase."""
    bought = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = t.events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"))
    return as_of(bought, seen, "user_id", "ts", "last_view", "last_view").select("event_id", "last_view")


#: Rows of a cell that meet as many of the other side in one place; pairs that a task compares, about.
CELL_ROWS, CELL_PAIRS = 512, 1 << 22


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """Pairs of rows whose whole numbers a and b differ by at most width: an equi-join on cells of that width, of which a row of right stands in three.

    A first pass counts both sides of each cell. A crowded cell is laid out as a grid of CELL_ROWS by as many rows, and the grids go to as many tasks as the pairs
    ask for, so more pairs make more tasks and no longer ones."""
    sides = left.withColumn("_cell", F.floor(F.col(a) / width)), right.withColumn("_cell", F.explode(F.array(*(F.floor(F.col(b) / width) + d for d in (-1, 0, 1)))))
    counts = sides[0].groupBy("_cell").agg(F.count("*").alias("_m")).join(sides[1].groupBy("_cell").agg(F.count("*").alias("_n")), "_cell")
    shape = cut(counts.select("_cell", *(F.ceil(F.col(n) / CELL_ROWS).cast("int").alias(n) for n in ("_m", "_n")), (F.col("_m") * F.col("_n")).alias("_pairs")))
    tasks = (shape.agg(F.sum("_pairs")).first()[0] or 0) // CELL_PAIRS + 1
    l, r = (d.join(shape.drop("_pairs"), "_cell").withColumn(f"_{own}", F.pmod(F.xxhash64(*d.columns), F.col(mine)).cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(its) - 1)))
            .drop("_m", "_n").repartition(int(tasks), "_cell", "_i", "_j") for d, own, mine, other, its in ((sides[0], "i", "_m", "j", "_n"), (sides[1], "j", "_n", "i", "_m")))
    return l.join(r.hint("shuffle_hash"), ["_cell", "_i", "_j"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_cell", "_i", "_j")


@query("""SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS c FROM customer) JOIN (SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS s FROM supplier) ON abs(c - s) <= 20""")
def band_join_balance(t) -> DataFrame:
    c = t.customer.select("c_custkey", F.floor("c_acctbal").alias("c"))
    s = t.supplier.select("s_suppkey", F.floor("s_acctbal").alias("s"))
    return band_join(c, s, "c", "s", 20).select("c_custkey", "s_suppkey")


@query("SELECT n_name, b.bucket, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (VALUES ('debt', -1e9, 0.0), ('some', 0.0, 5000.0), ('rich', 5000.0, 1e9)) AS b(bucket, lo, hi) ON c_acctbal >= lo AND c_acctbal < hi GROUP BY n_name, b.bucket")
def range_join_buckets(t) -> DataFrame:
    """A join by range with a table of three rows."""
    b = t.spark.createDataFrame([("debt", -1e9, 0.0), ("some", 0.0, 5000.0), ("rich", 5000.0, 1e9)], "bucket string, lo double, hi double")
    d = t.customer.join(F.broadcast(b), (F.col("c_acctbal") >= F.col("lo")) & (F.col("c_acctbal") < F.col("hi"))).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.groupBy("n_name", "bucket").agg(F.count("*").alias("n"))


@query("SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(t) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("two"))


@query("SELECT doc_id, source, quality FROM documents NATURAL JOIN labels WHERE quality = 1")
def natural_join(t) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels.where("quality = 1"), "doc_id").select("doc_id", "source", "quality")


@query("SELECT doc_id, w.pos, w.word FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE n_chars < 200) d, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word) w")
def lateral_words(t) -> DataFrame:
    return t.documents.where("n_chars < 200").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "word")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def offset_page(t) -> DataFrame:
    return t.orders.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").offset(20).limit(10).select("o_orderkey")


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5")
def limit_with_ties(t) -> DataFrame:
    """The fifth largest value, then all that reach it: no window over the whole table."""
    least = t.part.select("p_size").orderBy(F.col("p_size").desc_nulls_last()).limit(5).agg(F.min("p_size").alias("least"))
    return t.part.join(F.broadcast(least), F.col("p_size") >= F.col("least")).select("p_partkey", "p_size")


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 25)")
def limit_any(t) -> DataFrame:
    """Which rows a LIMIT without an order gives is open; how many is not."""
    return t.orders.limit(25).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(t) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp_ltz"))).alias("d"), F.col("o_orderkey").alias("k"))).alias("o_orderkey"))


@query("SELECT doc_id FROM documents WHERE substr(md5('42:' || doc_id), 1, 2) < '1a'")
def seeded_sample(t) -> DataFrame:
    """About a tenth of the rows, by a seed and the id: the same in every run and for every partitioning."""
    return t.documents.where(F.substring(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary")), 1, 2) < "1a").select("doc_id")


@query("SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) AS place FROM benchmark")
def seeded_shuffle(t) -> DataFrame:
    """The place of each item in a shuffle by seed; places of the whole table come from ranges, not from one task."""
    from .relational import ntiles

    d = t.benchmark.select("item_id", F.md5(F.concat(F.lit("42:"), F.col("item_id").cast("string")).cast("binary")).alias("h"))
    total = d.count()
    return ntiles(d, max(1, total), "item_id", [("h", False)]).select("item_id", F.col("tile").alias("place"))


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(CAST(embedding[1] AS DOUBLE), 1) DESC, vec_id) AS r FROM embeddings) WHERE r <= 3")
def argsort_ties(t) -> DataFrame:
    """Top three by a coarse score: of equal scores the smaller id first."""
    w = Window.partitionBy("label").orderBy(F.round(F.col("embedding")[0].cast("double"), 1).desc(), "vec_id")
    return t.embeddings.withColumn("r", F.row_number().over(w)).where("r <= 3").select("label", "vec_id")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'q' || doc_id ELSE coalesce(source, '?') END AS name FROM documents WHERE len(string_split(text, ' ')) <= 100 AND regexp_matches(text, '^[A-Z]')")
def length_filter(t) -> DataFrame:
    """Rows of at most so many tokens whose text begins as asked."""
    d = t.documents.where((F.size(F.split("text", " ")) <= 100) & F.rlike("text", F.lit("^[A-Z]")))
    return d.select("doc_id", F.when(F.col("lang") == "en", F.concat(F.lit("q"), F.col("doc_id").cast("string"))).otherwise(F.coalesce("source", F.lit("?"))).alias("name"))


#: Left intervals of a key and bin that one task compares.
CROWD = 1 << 14


def overlapping(left: DataFrame, right: DataFrame, width: int, keys: tuple = ()) -> DataFrame:
    """(keys.., left_id, right_id) of each left and right interval (id, lo, hi; whole numbers, hi left out) with equal keys that share a point.

    Intervals are laid in bins of `width`; a pair is made where the later of both starts, so it comes once however many bins it shares. A bin of over CROWD left
    intervals is dealt over parts, each of which sees all of its right ones. Empty intervals and nulls overlap with nothing."""
    on = [*keys, "bin"]

    def laid(df: DataFrame, side: str) -> DataFrame:
        bins = F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))
        return df.where("lo < hi").select(*keys, F.col("id").alias(f"{side}_id"), F.col("lo").alias(f"{side}_lo"), F.col("hi").alias(f"{side}_hi"), F.explode(bins).alias("bin"))

    a, b = laid(left, "left"), laid(right, "right")
    crowds = a.groupBy(*on).agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    a = a.join(crowds, on, "left").withColumn("part", F.pmod(F.xxhash64("left_id"), parts).cast("int")).drop("parts")
    b = b.join(crowds, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    first = F.floor(F.greatest("left_lo", "right_lo") / width) == F.col("bin")
    return a.join(b, [*on, "part"]).where((F.col("left_lo") < F.col("right_hi")) & (F.col("right_lo") < F.col("left_hi")) & first).select(*keys, "left_id", "right_id")


@query("""SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view'
AND epoch_us(a.ts) < epoch_us(b.ts) + 12 * 3600000000 AND epoch_us(b.ts) < epoch_us(a.ts) + 24 * 3600000000""")
def interval_overlap(t) -> DataFrame:
    """Purchases of a user, open for a day, and views of the same user, open for half a day, that overlap."""
    at = F.unix_micros(F.col("ts").cast("timestamp_ltz"))
    spans = lambda kind, hours: t.events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), at.alias("lo"), (at + hours * 3_600_000_000).alias("hi"))
    return overlapping(spans("purchase", 24), spans("view", 12), 12 * 3_600_000_000, ("user_id",))


def over_groups(df: DataFrame, by: list[str], order: list, before: int, after: int, **aggregates) -> DataFrame:
    """df with aggregates over a frame of whole groups of peers: those of `before` groups back to `after` groups on, as GROUPS BETWEEN says.

    Peers (rows that `order` can't tell apart) are numbered by a dense rank, and the frame is a range of these numbers; both windows share one exchange and sort."""
    numbered = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)))
    frame = Window.partitionBy(*by).orderBy("_g").rangeBetween(-before, after)
    return numbered.withColumns({name: f.over(frame) for name, f in aggregates.items()}).drop("_g")


@query("""SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER w AS DOUBLE) AS near_total, count(*) OVER w AS near_orders
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority DESC GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def groups_frames(t) -> DataFrame:
    """Orders of a customer with the priorities next to theirs; ties are one group."""
    out = over_groups(t.orders, ["o_custkey"], [F.desc("o_orderpriority")], 1, 1, near_total=F.sum(F.col("o_totalprice").cast("decimal(15,2)")), near_orders=F.count("*"))
    return out.select("o_orderkey", F.col("near_total").cast("double").alias("near_total"), "near_orders")
