"""Every query that has SQL against DuckDB on the small tables; gateway, matching, files, text by hand-made cases."""

import math
import os

import duckdb
import pytest

from quern.operators import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    at = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(at) == cols
    want = sorted(tuple(plain(r[at[c]]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_plans(spark):
    plan = lambda n: QUERIES[n](spark, DIR)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in plan("filter_eq_str")
    assert "BroadcastHashJoin" in plan("join_fact_dim") and "Cartesian" not in plan("join_star")
    assert "TakeOrderedAndProject" in plan("topk_desc") and "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in plan("scan_project")


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from quern.functions import text as x
    from quern.functions.keywords import corrected

    d = spark.createDataFrame([("Đường Nguyễn_Huệ 12",), (None,), ("",)], "s string")
    got = d.select(x.strip_accents("s"), x.strip_accents_d("s"), x.schema_tokens(F.col("s")), x.normal_transcript("s")).collect()
    assert got[0][0] == "Đuong Nguyen_Hue 12" and got[0][1] == "Duong Nguyen_Hue 12" and got[0][2] == ["uong", "nguyen", "hue", "12"] and got[0][3].endswith("mười hai") and got[1][0] is None
    assert [x.vietnamese_number(n) for n in (0, 5, 10, 15, 21, 105, 1005, 2_000_000)] == ["không", "năm", "mười", "mười lăm", "hai mươi mốt", "một trăm lẻ năm", "một nghìn không trăm lẻ năm", "hai triệu"]
    assert corrected("sellect name form t groub bai x") == "SELECT name FROM t GROUP BY x" and corrected("") == "" and corrected(None) is None
    w = spark.createDataFrame([("a b c", "a x c"), ("", "a"), ("a", None)], "r string, h string").select(x.word_error_rate(F.col("r"), F.col("h"))).collect()
    assert [round(r[0], 4) for r in w] == [0.3333, 1.0, 1.0]
    v = spark.createDataFrame([([1.0, -2.0],), ([0.0, 0.0],)], "a array<double>").select(x.peak_normal(F.col("a"))).collect()
    assert [r[0] for r in v] == [[0.5, -1.0], [0.0, 0.0]]


def test_rewrites():
    from quern.plans import rewrite as r

    answer = "Here:\n```sql\nWITH a AS (SELECT 1) SELECT * FROM a; -- x\n```"
    assert r.extract(answer) == "WITH a AS (SELECT 1) SELECT * FROM a" and r.extract(answer, "select").startswith("SELECT 1") and r.extract("SQL: select 1;", "labelled") == "select 1" and r.extract(None) == ""
    assert r.single_prefixes("sr_sr_return_amt") == "sr_return_amt" and r.top_to_limit("SELECT TOP 5 a FROM t;") == "SELECT a FROM t LIMIT 5" and r.year_to_extract("YEAR(d)") == "EXTRACT(YEAR FROM d)"
    assert r.rename_columns("inv_quantity, inv_quantity_on_hand, d_quarter, sr_net_loss") == "inv_quantity_on_hand, inv_quantity_on_hand, d_qoy, sr_net_loss" and "sr_return_amt" in r.rename_columns("sr_net_loss", harmful=True)
    assert r.star_expanded("SELECT * FROM part p WHERE 1=1", {"part": ["a", "b"]}) == "SELECT p.a, p.b FROM part p WHERE 1=1" and r.limited("select 1", 3) == "select 1 LIMIT 3"
    assert r.canonical("SELECT  a FROM t WHERE x = 'A  B';") == r.canonical("select a from t where x='A  B'") != r.canonical("select a from t where x='a  b'")


def test_gateway(spark):
    from quern.plans import gateway as g
    from quern.sources.files import attach, catalog, describe, list_tables

    assert "orders" in attach(spark, DIR) and "orders" in list_tables(spark) and describe(spark, "orders")["o_orderkey"] == "bigint" and catalog(spark, ["nation"]).count() == len(spark.table("nation").columns)
    assert g.guard_text("-- drop\nSELECT 1") and not g.guard_text("SELECT 'drop'") and g.guard_plan(spark, "SELECT 'drop' AS w") and not any(g.guard_plan(spark, s) for s in ("DROP TABLE a", "INSERT INTO a VALUES (1)", "SET x=1", "SHOW TABLES", "CREATE TABLE a (b int)", "not sql"))
    assert g.tables_of(spark, "WITH x AS (SELECT * FROM orders) SELECT * FROM x, nation") == {"orders", "nation"} and g.whitelisted(spark, "SELECT * FROM orders", {"ORDERS"})
    # A literal or an alias that looks like a WITH hides no table; a WITH hides one only where it applies.
    assert g.tables_of(spark, "SELECT ', orders as (' AS x, o_orderkey FROM orders") == {"orders"} and not g.whitelisted(spark, "SELECT ', orders as (' AS x, o_orderkey FROM orders", {"nation"})
    assert g.tables_of(spark, "SELECT * FROM (WITH orders AS (SELECT 1 AS a) SELECT * FROM orders) x, orders") == {"orders"}
    assert g.tables_of(spark, "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a WHERE 1 IN (SELECT c_custkey FROM customer)") == {"b", "customer"}
    assert not any(g.guard_plan(spark, s) for s in ("SELECT java_method('java.lang.System', 'exit', 0)", "SELECT 1 FROM nation WHERE n_name = (SELECT reflect('java.util.UUID', 'randomUUID'))", "SELECT * FROM parquet.`/etc/x`", "WITH a AS (SELECT try_reflect('a', 'b') AS x) SELECT * FROM a", "SELECT TRANSFORM (n_name) USING 'cat' FROM nation"))
    assert g.guard_plan(spark, "SELECT 1 UNION SELECT 2") and g.guard_plan(spark, "SELECT * FROM range(3)") and g.guard_plan(spark, "SELECT 'java_method' AS w")
    kinds = {"SELECT FROM": "binder", "SELECT * FROM nothere": "catalog", "SELECT nocol FROM orders": "binder", "SELECT * FRM orders x y": "parser", "SELECT o_custkey, count(*) FROM orders": "binder"}
    for sql, kind in kinds.items():
        assert g.error_class(g.analysed(spark, sql)) == kind, sql
    assert g.error_detail(g.analysed(spark, "SELECT o_custke FROM orders"))["kind"] == "column_not_found" and g.retryable("Parser Error: x") and not g.retryable("timeout")
    ok = g.run(spark, "SELECT n_name FROM nation ORDER BY n_name", limit=3)
    assert ok.status == "ok" and len(ok.rows) == 3 and g.run(spark, "").status == "INVALID_SQL" and g.run(spark, "SELECT * FROM orders", valid={"nation"}).status == "INVALID_SQL" and g.run(spark, "SELECT raise_error('x')").status == "exec_error"
    sql, error, n = g.repair(spark, "SELECT TOP 2 o_o_orderkey FROM orders")
    assert error is None and "LIMIT 2" in sql
    assert g.fixed("SELECT c.c_gender FROM customer c", {}) == "SELECT cd.cd_gender FROM customer c JOIN customer_demographics cd ON c.c_current_cdemo_sk = cd.cd_demo_sk"
    assert [r[0] for r in g.page(spark.table("nation").select("n_nationkey"), "n_nationkey", 3, 2).collect()] == [4, 5]


def test_matches(spark):
    from quern.plans.evaluate import empty_class, match_bag_or_ordered, match_rounded_set, match_set_or_subset

    d = lambda rows, cols="a int, b string": spark.createDataFrame(rows, cols)
    one, twice, more = d([(1, "x"), (2, "y")]), d([(2, "y"), (1, "x"), (1, "x")]), d([(1, "x", 5), (2, "y", 6)], "A int, B string, c int")
    assert match_set_or_subset(one, twice) and not match_bag_or_ordered(one, twice) and match_set_or_subset(one, more) and not match_rounded_set(one, more)
    none = d([]), d([], "q double, r int, s int")
    assert match_set_or_subset(*none) and match_bag_or_ordered(*none)
    f = lambda *xs: d([(x,) for x in xs], "x double")
    assert match_rounded_set(f(1.001), f(1.002)) and not match_bag_or_ordered(f(1.001), f(1.002)) and match_bag_or_ordered(f(1.0, 2.0), f(2.0, 1.0)) and not match_bag_or_ordered(f(1.0, 2.0), f(2.0, 1.0), "select x from t order by x")
    assert not match_bag_or_ordered(d([(1,)], "a int"), d([("1",)], "a string")) and match_bag_or_ordered(d([(1,)], "a int"), d([(1.0,)], "a double"))
    many = spark.range(1000).selectExpr("id % 7 AS k", "id")
    assert match_bag_or_ordered(many.orderBy("k", "id"), many.repartition(5).orderBy("k", "id"), "select 1 order by 1") and not match_bag_or_ordered(many.orderBy("k", "id"), many.orderBy("id"), "select 1 order by 1")
    assert empty_class(d([(None, None)])) == "empty" and empty_class(d([])) == "empty" and empty_class(one) == "rows"


def test_files(spark, tmp_path):
    from quern.sources import files as f

    (tmp_path / "q.csv").write_text('ID,Transcription,SQL Ground Truth\n1,"ask, now","SELECT ""A B""\nFROM t"\ngen_2,other,SELECT 1\n3,,SELECT 2\n')
    rows = f.questions(f.csv(spark, str(tmp_path / "q.csv"), "`ID` string, `Transcription` string, `SQL Ground Truth` string")).collect()
    assert [(r["id"], r["sql"]) for r in rows] == [("1", 'SELECT "A B"\nFROM t'), ("gen_2", "SELECT 1")]
    (tmp_path / "e.json").write_text('{"default": [{"question": "q", "sql": "s"}, {"question": "z"}], "k": []}')
    assert [tuple(r) for r in f.examples(spark, str(tmp_path / "e.json"), "none").collect()] == [("none", 0, "q", "s")]
    (tmp_path / "d.txt").write_text("# c\na|INT|first\nbad|x\nb|DATE|second|part\n")
    assert [tuple(r) for r in f.descriptors(spark, str(tmp_path / "d.txt")).collect()] == [("a", "INT", "first"), ("b", "DATE", "second|part")]
    (tmp_path / "n.txt").write_text("Orders\n\n-- x\n# y\n nation \n")
    assert [r[0] for r in f.names(spark, str(tmp_path / "n.txt")).collect()] == ["orders", "nation"] and f.text_or("d", "/nowhere") == "d"
    (tmp_path / "s.json").write_text('{"t": {"c": ["x", "y"]}}')
    assert [tuple(r) for r in f.samples(spark, str(tmp_path / "s.json")).collect()] == [("t", "c", ["x", "y"])]


def test_stream(spark, tmp_path):
    from quern.streaming.windows import tumbling_counts

    batch = spark.read.parquet(f"{DIR}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").count() == tumbling_counts(batch).count()


def test_ntiles_of_wide_tables(spark):
    """More rows than range bounds are sampled from, with a payload: tiles are exact."""
    from quern.operators.relational import ntiles

    wide = spark.range(2_000_000).selectExpr("id", "id % 1000 AS v", "repeat('x', 40) AS payload", "id * 3 AS other")
    got = ntiles(wide, 4, "id", [("v", True)]).groupBy("tile").agg({"*": "count", "v": "max"}).orderBy("tile").collect()
    assert [(r["tile"], r["count(1)"]) for r in got] == [(k, 500_000) for k in (1, 2, 3, 4)] and [r["max(v)"] for r in got] == [999, 749, 499, 249]
    few = ntiles(spark.range(5).selectExpr("id", "CAST(NULL AS INT) AS v"), 3, "id", [("v", False)]).orderBy("id").collect()
    assert [r["tile"] for r in few] == [1, 1, 2, 2, 3]


def test_validation(spark):
    from quern.plans.evaluate import revalidated, validation_report
    from quern.sources.files import attach

    attach(spark, DIR)
    each, report = validation_report(spark, [("a", "SELECT 1 AS x"), ("b", "SELECT * FROM nation WHERE 1 = 0"), ("c", "SELECT NULL AS x"), ("d", "SELECT nocol FROM nation"), ("e", "SELEC 1")])
    assert {r["id"]: r["outcome"] for r in each.collect()} == {"a": "rows", "b": "empty", "c": "empty", "d": "binder", "e": "parser"}
    assert {(r["outcome"], r["n"], r["percent"], *r["examples"]) for r in report.collect()} == {("rows", 1, 20.0, "a"), ("empty", 2, 40.0, "b", "c"), ("binder", 1, 20.0, "d"), ("parser", 1, 20.0, "e")}
    got = revalidated(spark, [("1", "SELECT * FROM nation"), ("2", "SELECT * FROM region"), ("3", "SELECT nocol FROM nation")], {"nation": ["n_name"], "region": ["no_such"]})
    assert [tuple(r) for r in got.collect()] == [("1", "SELECT n_name FROM nation", True, "OK"), ("2", "SELECT * FROM region", False, "OK"), ("3", "SELECT nocol FROM nation", False, "ERROR")]


def test_augmentation(spark):
    from pyspark.sql import functions as F

    from quern.operators.corpus import CATEGORIES, STATES, augmented

    asked, sql = "Tìm khách hàng tại CA quý 2 năm 1999 Books", "SELECT 1 WHERE s = 'CA' AND d_year = 1999 AND d.d_qoy = 2 AND i = 'Books'"
    pairs = spark.range(300).select("id", F.concat(F.lit(asked + " "), F.col("id").cast("string"), F.lit("x")).alias("question"), F.lit(sql).alias("sql"))
    found = augmented(pairs)
    rows, kinds = found.collect(), {}
    assert sorted(rows) == sorted(augmented(pairs.repartition(3)).collect()) and "Python" not in found._jdf.queryExecution().toString()
    for r in rows:
        own, q, s = f"{asked} {r['id']}x", r["question"], r["sql"]
        kinds[r["kind"]] = kinds.get(r["kind"], 0) + 1
        if r["kind"] == "original":
            assert (q, s) == (own, sql)
        if r["kind"] == "values":
            state = next(x for x in STATES if f"'{x}'" in s)
            assert state != "CA" and f"tại {state} " in q and "1999" not in q + s and "= 2 " not in s and "quý 2" not in q and "Books" in q
        if r["kind"] == "category":
            assert next(x for x in CATEGORIES if f"'{x}'" in s) in q and "Books" not in q + s and "CA" in q
        if r["kind"] in ("paraphrase", "typo"):
            assert s == sql and q != own
        if r["kind"] == "typo":
            assert abs(len(q) - len(own)) < 12
    assert kinds["original"] == kinds["values"] == kinds["category"] == 300 and 50 < kinds["typo"] < 130 and 100 < kinds["paraphrase"] <= 300
    odd = spark.createDataFrame([(1, "xyz", "SELECT 1"), (2, "", "q"), (3, None, "q"), (4, "Women", "SELECT 'Women'")], "id long, question string, sql string")
    got = {(r["id"], r["kind"]): (r["question"], r["sql"]) for r in augmented(odd).where("kind <> 'typo'").collect()}
    assert set(got) == {(1, "original"), (2, "original"), (4, "original"), (4, "category")} and "Women" not in "".join(got[4, "category"])


def test_more_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from quern.functions.text import asr_report, transcripts
    from quern.sources import files as f

    (tmp_path / "b.json").write_text('[{"text": "one", "sql": "s"}, {"id": "x", "question": "two"}, {"id": "none"}]')
    assert [tuple(r) for r in f.benchmark_json(spark, str(tmp_path / "no.json"), str(tmp_path / "b.json")).collect()] == [("q0", "one", "s"), ("x", "two", None)]
    f.write_index(spark.range(3), str(tmp_path / "i"))
    assert f.read_index(spark, str(tmp_path / "older"), str(tmp_path / "i")).count() == 3
    with pytest.raises(FileNotFoundError):
        f.read_index(spark, str(tmp_path / "older"))
    days = f.date_dim(spark, "1998-01-01", "1998-12-31").collect()
    assert len(days) == 365 and days[0]["d_day_name"] == "Thursday" and sum(r["d_weekend"] == "Y" for r in days) == 104 and days[-1]["d_qoy"] == 4
    fact = f.sales(spark, 5000)
    assert fact.collect() == f.sales(spark, 5000).repartition(3).orderBy("ss_ticket_number").collect() and 50 < fact.where("ss_item_sk IS NULL").count() < 200
    assert fact.join(f.date_dim(spark, "1998-01-01", "2002-12-31"), F.col("ss_sold_date_sk") == F.col("d_date_sk")).count() == 5000
    assert "|g  |2    |" in f.grouped_text(spark.range(2).groupBy(F.lit("g").alias("g")).count(), "g")
    f.write_csv(spark.createDataFrame([("a,b", 'say "x"')], "p string, q string"), str(tmp_path / "c"))
    assert [tuple(r) for r in f.csv(spark, str(tmp_path / "c"), "p string, q string").collect()] == [("a,b", 'say "x"')]
    f.write_jsonl(spark.createDataFrame([("é", None)], "p string, q string"), str(tmp_path / "l"))
    assert any("é" in x.read_text() for x in (tmp_path / "l").glob("*.json")) and [tuple(r) for r in f.jsonl(spark, str(tmp_path / "l"), "p string, q string").collect()] == [("é", None)]
    heard = transcripts(spark.createDataFrame([(1, bytearray(b"sellect x form t")), (2, None)], "k int, content binary"), lambda b: b.decode()).orderBy("k").collect()
    assert heard[0]["text"] == "sellect x form t" and heard[0]["sql_text"] == "SELECT x FROM t" and heard[1]["text"] is None
    got = asr_report(spark.createDataFrame([("m", "số 5", "Số năm!")], "model string, reference string, hypothesis string"), normal=True).collect()
    assert got[0]["mean_wer"] == 0.0


def test_nearest_in_blocks(spark):
    from quern.operators.linking import nearest

    e = spark.read.parquet(f"{DIR}/embeddings.parquet").selectExpr("vec_id AS did", "embedding AS vec")
    q = e.where("did % 10 = 0").selectExpr("did AS qid", "vec")
    key = lambda d: sorted((r["qid"], r["rank"], r["did"]) for r in d.collect())
    assert key(nearest(e, q, 4, block=3)) == key(nearest(e.repartition(5), q, 4)) and len(key(nearest(e, q, 4))) == 4 * q.count()
    assert nearest(e, q.limit(0), 4).count() == 0
