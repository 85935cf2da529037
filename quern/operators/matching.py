"""Queries over the library's evaluation, rewriting, guarding and retrieval functions, each with the SQL that says the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, word_tokens
from ..plans import evaluate, gateway, rewrite
from ..sources import files
from . import linking
from .linking import _BM25_SQL
from .registry import query

_A = "SELECT c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 1) + 0.0321 AS m FROM customer GROUP BY c_nationkey"
_B = "SELECT c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 1) + 0.0321 + 0.0001 AS m FROM customer GROUP BY c_nationkey"
_SAME = "(NOT EXISTS (SELECT * FROM {0} EXCEPT {2} SELECT * FROM {1}) AND NOT EXISTS (SELECT * FROM {1} EXCEPT {2} SELECT * FROM {0}))"


def _two(t) -> tuple[DataFrame, DataFrame]:
    g = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), (F.round(F.avg("c_acctbal"), 1) + 0.0321).alias("m"))
    return g, g.withColumn("m", F.col("m") + 0.0001)


def _row(t, **cases: bool) -> DataFrame:
    return t.spark.createDataFrame([tuple(cases.values())], ", ".join(f"{k} boolean" for k in cases))


@query(f"""WITH a AS ({_A}), b AS ({_B}), c AS (SELECT k FROM a), d AS (SELECT * FROM a UNION ALL SELECT * FROM a) SELECT {_SAME.format('a', 'a', '')} AS itself, {_SAME.format('a', 'b', '')} AS near,
(SELECT count(*) FROM c) = (SELECT count(*) FROM a) AND {_SAME.format('c', '(SELECT k FROM a)', '')} AS subset, {_SAME.format('a', 'd', '')} AS twice""")
def match_set(t) -> DataFrame:
    """Rows as sets; or as many rows, and equal in the first result's columns."""
    a, b = _two(t)
    m = evaluate.match_set_or_subset
    return _row(t, itself=m(a, a), near=m(a, b), subset=m(a.select("k"), a), twice=m(a, a.unionAll(a)))


@query(f"WITH a AS ({_A}), b AS ({_B}), x AS (SELECT round(k, 2), round(n, 2), round(m, 2) FROM a), y AS (SELECT round(k, 2), round(n, 2), round(m, 2) FROM b), z AS (SELECT k, n, m + 1 FROM x AS x(k, n, m)) SELECT {_SAME.format('x', 'y', '')} AS near, {_SAME.format('x', 'z', '')} AS far")
def match_round2(t) -> DataFrame:
    a, b = _two(t)
    return _row(t, near=evaluate.match_rounded_set(a, b), far=evaluate.match_rounded_set(a, a.withColumn("m", F.col("m") + 1)))


@query(f"WITH a AS ({_A}), b AS ({_B}), d AS (SELECT * FROM a UNION ALL SELECT * FROM a) SELECT {_SAME.format('a', 'a', 'ALL')} AS itself, {_SAME.format('a', 'b', 'ALL')} AS near, {_SAME.format('a', 'd', 'ALL')} AS twice")
def match_bag(t) -> DataFrame:
    a, b = _two(t)
    m = evaluate.match_bag_or_ordered
    return _row(t, itself=m(a, a), near=m(a, b), twice=m(a, a.unionAll(a)))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY n_name) AS at, n_name FROM nation), b AS (SELECT row_number() OVER (ORDER BY n_name DESC) AS at, n_name FROM nation)
SELECT NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM a) AS same_order, NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) AS other_order""")
def match_ordered(t) -> DataFrame:
    n = t.nation.select("n_name")
    m = lambda x, y: evaluate.match_bag_or_ordered(x, y, "SELECT n_name FROM nation ORDER BY n_name")
    return _row(t, same_order=m(n.orderBy("n_name"), n.repartition(3).orderBy("n_name")), other_order=m(n.orderBy("n_name"), n.orderBy(F.desc("n_name"))))


@query("""SELECT 'all' AS name, CASE WHEN EXISTS (SELECT * FROM nation) THEN 'rows' ELSE 'empty' END AS class UNION ALL
SELECT 'none', CASE WHEN EXISTS (SELECT * FROM nation WHERE n_name = '') THEN 'rows' ELSE 'empty' END UNION ALL SELECT 'nulls', CASE WHEN (SELECT max(c_acctbal) FROM customer WHERE c_custkey < 0) IS NULL THEN 'empty' ELSE 'rows' END""")
def empty_or_null_class(t) -> DataFrame:
    cases = {"all": t.nation, "none": t.nation.where("n_name = ''"), "nulls": t.customer.where("c_custkey < 0").agg(F.max("c_acctbal"))}
    return t.spark.createDataFrame([(k, evaluate.empty_class(d)) for k, d in cases.items()], "name string, class string")


@query("""SELECT event_type AS condition, count(*) AS n, round(avg((value > 1)::INT), 6) AS valid_rate, round(avg((value > 2)::INT), 6) AS execution_rate, round(avg((value > 10)::INT), 6) AS accuracy,
round(avg(CASE WHEN value > 1 THEN (value > 10)::INT END), 6) AS accuracy_valid, round(avg((value > 20)::INT), 6) AS exact_rate, round(avg(value), 4) AS mean_latency_ms, count(*) FILTER (WHERE user_id % 3 = 0) AS repairs FROM events GROUP BY event_type""")
def eval_rollup(t) -> DataFrame:
    v = F.col("value")
    r = t.events.select(F.col("event_type").alias("condition"), (v > 1).alias("valid"), (v > 2).alias("executed"), (v > 10).alias("matched"), (v > 20).alias("exact"), (F.col("user_id") % 3 == 0).alias("repaired"), v.alias("latency_ms"))
    return evaluate.rollup(r, ["condition"])


_STATEMENTS = [("q1", "SELECT n_name FROM nation"), ("q2", "SELECT nocol FROM nation"), ("q3", "SELECT * FROM nothere"), ("q4", "SELEC 1"), ("q5", "SELECT * FROM nation WHERE n_name = ''"), ("q6", "SELECT n_regionkey, count(n_name) FROM nation"), ("q7", "SELECT max(n_name) AS m FROM nation WHERE n_nationkey < 0"), ("q8", "SELECT * FROM nation;")]


@query("SELECT * FROM (VALUES ('rows', 2::BIGINT, 25.0::DOUBLE, 'q1|q8'), ('binder', 2, 25.0, 'q2|q6'), ('catalog', 1, 12.5, 'q3'), ('parser', 1, 12.5, 'q4'), ('empty', 2, 25.0, 'q5|q7')) AS v(outcome, n, percent, examples)")
def validation_summary(t) -> DataFrame:
    files.attach(t.spark, t.sf_dir, ["nation"])
    return evaluate.validation_report(t.spark, _STATEMENTS)[1].select("outcome", "n", "percent", F.array_join("examples", "|").alias("examples"))


@query("SELECT * FROM (VALUES ('1', 'SELECT n_name FROM nation', true, 'OK'), ('2', 'SELECT * FROM nation n', false, 'OK'), ('3', 'SELECT nocol FROM nation', false, 'ERROR')) AS v(id, sql, changed, status)")
def truth_revert(t) -> DataFrame:
    """Stars expanded where the statement still binds; the second list names a column that the table lacks."""
    files.attach(t.spark, t.sf_dir, ["nation"])
    one = evaluate.revalidated(t.spark, [("1", "SELECT * FROM nation"), ("3", "SELECT nocol FROM nation")], {"nation": ["n_name"]})
    return one.unionAll(evaluate.revalidated(t.spark, [("2", "SELECT * FROM nation n")], {"nation": ["nocol"]}))


def _made(t, patterns: list[str], name: str) -> DataFrame:
    """(id, name): a text of one of the patterns for each item of the benchmark, with the item's number for @."""
    return t.benchmark.select(F.col("item_id").alias("id"), F.replace(F.element_at(F.array(*map(F.lit, patterns)), (F.col("item_id") % len(patterns) + 1).cast("int")), F.lit("@"), F.col("item_id").cast("string")).alias(name))


def _made_sql(patterns: list[str], name: str) -> str:
    return "SELECT item_id AS id, replace([" + ", ".join("'" + x.replace("'", "''") + "'" for x in patterns) + f"][item_id % {len(patterns)} + 1], '@', CAST(item_id AS VARCHAR)) AS {name} FROM benchmark"


def _text_udf(f):
    """A function of one text as a column function, Arrow batches at a time."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f)

    return run


_RAW = ["SELECT TOP 5 ss_ss_item_sk FROM x@", "-- note\nSELECT d_quarter FROM d@;", "SELECT inv_quantity, inv_quantity_on_hand FROM i WHERE a = @", "SELECT @", "SELECT top (3) a@ FROM t LIMIT 9", "SELECT YEAR(d) FROM t@"]


@query("WITH v AS (" + _made_sql(_RAW, "raw") + r"""),
a AS (SELECT *, trim(regexp_replace(raw, '(^|\n)\s*(--|#)[^\n]*', '', 'g'), chr(10)) AS s FROM v), b AS (SELECT id, raw, regexp_replace(s, 'ss_ss_', 'ss_', 'g') AS s FROM a),
c AS (SELECT id, raw, regexp_replace(replace(replace(regexp_replace(s, '\bd_quarter\b', 'd_qoy', 'g'), 'inv_quantity_on_hand', 'inv_quantity'), 'inv_quantity', 'inv_quantity_on_hand'), ';$', '') AS s FROM b)
SELECT id, raw, CASE WHEN regexp_matches(s, '(?i)^select top') THEN regexp_replace(s, '(?i)^select top \(?\d+\)? ', 'SELECT ') || CASE WHEN regexp_matches(s, '(?i)\blimit\b') THEN '' ELSE ' LIMIT ' || regexp_extract(s, '(?i)top \(?(\d+)', 1) END ELSE s END || ';' AS sql FROM c""")
def rewrite_sql(t) -> DataFrame:
    return _made(t, _RAW, "raw").withColumn("sql", _text_udf(lambda s: rewrite.repaired(s)[0])("raw"))


_ANSWERS = ["```sql\nSELECT @;\n```", "SQL: select @; more", "Sure. WITH a AS (SELECT @) SELECT * FROM a;", "no statement @", "text ```\nselect @\n``` tail", ""]


@query("WITH v AS (" + _made_sql(_ANSWERS, "answer") + r"""), b AS (SELECT id, answer, trim(CASE WHEN regexp_matches(answer, '(?s)```(?:sql)?\s*(.*?)```') THEN regexp_extract(answer, '(?s)```(?:sql)?\s*(.*?)```', 1) ELSE answer END, chr(10) || ' ') AS body FROM v),
f AS (SELECT *, CASE WHEN regexp_matches(body, '(?i)\b(select|with)\b') THEN regexp_extract(body, '(?is)\b(?:select|with)\b.*') ELSE body END AS rest FROM b)
SELECT id, trim(split_part(body, ';', 1)) AS fenced, trim(split_part(regexp_replace(body, '(?i)^sql\s*:\s*', ''), ';', 1)) AS labelled,
trim(split_part(regexp_extract(body, '(?is)\bselect\b.*'), ';', 1)) AS from_select, CASE WHEN contains(rest, ';') THEN split_part(rest, ';', 1) || ';' ELSE rest END AS from_first FROM f""")
def extract_sql(t) -> DataFrame:
    """Four ways to find the statement in an answer."""
    ways = {"fenced": "fenced", "labelled": "labelled", "from_select": "select", "from_first": "first"}
    return _made(t, _ANSWERS, "answer").select("id", *(_text_udf(lambda s, way=way: rewrite.extract(s, way))("answer").alias(name) for name, way in ways.items()))


#: Statements (a name of the nation's stands for @), what binding them says and whether the guard lets them through.
_CLASSED = [
    ("SELECT '@' AS name FROM nation", "none", True), ("SELECT nocol FROM nation WHERE n_name = '@'", "binder", True), ("SELECT '@' FROM nothere", "catalog", True),
    ("SELEC '@'", "parser", False), ("SELECT '@', no_such_function(1)", "catalog", False), ("SELECT '@' FROM nation WINDOW w AS (ORDER BY java_method('a', 'b'))", "none", False),
]


@query("SELECT n_name AS name, v.n AS n, v.kind AS kind, v.permitted AS permitted FROM nation, (VALUES " + ", ".join(f"({n}, '{k}', {str(p).lower()})" for n, (_, k, p) in enumerate(_CLASSED)) + ") AS v(n, kind, permitted)")
def error_class(t) -> DataFrame:
    """What the gateway says of statements over the names of a table: the class of what binding raises, and whether it is a permitted query."""
    files.attach(t.spark, t.sf_dir, ["nation"])
    names = [r[0] for r in t.nation.select("n_name").collect()]  # as many as there are nations
    said = [(name, n, sql.replace("@", name)) for name in names for n, (sql, _, _) in enumerate(_CLASSED)]
    rows = [(name, n, gateway.error_class(gateway.analysed(t.spark, sql)), gateway.guard_plan(t.spark, sql)) for name, n, sql in said]
    return t.spark.createDataFrame(rows, "name string, n int, kind string, permitted boolean")


_VALID, _TRAINING = ["nation", "region", "orders"], ["SELECT * FROM nation", "SELECT @ FROM Nation JOIN other ON 1 = 1", "SELECT @", "select @ from orders o join region r on true"]


@query("WITH v AS (" + _made_sql(_TRAINING, "sql") + r"""), n AS (SELECT sql, regexp_extract_all(lower(sql), '\b(?:from|join)\s+([a-z_]+)', 1) AS names FROM v)
SELECT sql, len(list_filter(names, lambda x: x NOT IN ('nation', 'region', 'orders'))) = 0 AS valid, len(string_split(sql, ' ')) <= 4 AS short FROM n""")
def valid_statements(t) -> DataFrame:
    """Statements that name known tables alone, and are short enough for training."""
    return rewrite.training_filter(_made(t, _TRAINING, "sql"), _VALID, 4)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name LIMIT 3")
def top_to_limit(t) -> DataFrame:
    files.attach(t.spark, t.sf_dir, ["nation"])
    return t.spark.sql(rewrite.top_to_limit("SELECT TOP 3 n_nationkey, n_name FROM nation ORDER BY n_name"))


@query("SELECT n_name FROM nation WHERE n_regionkey = 1")
def unneeded_join(t) -> DataFrame:
    """A left join that nothing reads from, on a unique key, goes from the plan: only one table is scanned."""
    regions = t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name")).distinct()
    one = rewrite.without_unneeded_join(t.nation, regions, F.col("n_regionkey") == F.col("k"), ["n_name"], ["k"], F.col("n_regionkey") == 1)
    return one


@query("WITH c AS (SELECT item_id AS id, length(text) AS golden FROM benchmark WHERE item_id % 2 = 0) SELECT item_id AS id, coalesce(golden, -1) AS golden FROM benchmark LEFT JOIN c ON item_id = id")
def golden_cache(t) -> DataFrame:
    """Questions with their precomputed results, by id; what is missing has the default."""
    cache = t.benchmark.where("item_id % 2 = 0").select(F.col("item_id").alias("id"), F.length("text").cast("long").alias("golden"))
    return t.benchmark.select(F.col("item_id").alias("id")).join(cache, "id", "left").select("id", F.coalesce("golden", F.lit(-1).cast("long")).alias("golden"))


_WORDS = {"first": ["the", "and"], "second": ["ing", "tion"], "third": ["que", "der"]}
_WORDS_SQL = ", ".join(f"('{k}', '{w}')" for k, ws in _WORDS.items() for w in ws)
_TOKENS_SQL = r"unnest(list_distinct(list_filter(string_split(array_to_string(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9_]+'), '_'), '_'), lambda x: len(x) > 1)))"


@query(f"""WITH q AS (SELECT item_id AS id, {_TOKENS_SQL} AS token FROM benchmark), w(tbl, token) AS (VALUES {_WORDS_SQL}), s AS (SELECT id, tbl, count(*) AS score FROM q JOIN w USING (token) GROUP BY 1, 2),
r AS (SELECT id, tbl, row_number() OVER (PARTITION BY id ORDER BY score DESC, tbl DESC) AS rank FROM s) SELECT id, tbl AS "table", rank FROM r WHERE rank <= 2""")
def lexical_tables(t) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    words = t.spark.createDataFrame([(k, w) for k, ws in _WORDS.items() for w in ws], "table string, token string")
    return linking.ranked_tables(q, words, 2).select("id", "table", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH f AS (SELECT item_id AS id, v.tbl, v.rank FROM benchmark, (VALUES ('third', 1), ('other', 2)) AS v(tbl, rank)), p(tbl, pos) AS (VALUES ('first', 0), ('second', 1), ('third', 2)), w(tbl, kw) AS (VALUES {_WORDS_SQL}),
b AS (SELECT DISTINCT item_id AS id, w.tbl, pos FROM benchmark JOIN w ON contains(lower(text), kw) JOIN p USING (tbl)), u AS (SELECT id, tbl, 0 AS side, rank AS place FROM f UNION ALL SELECT id, tbl, 1, pos FROM b),
g AS (SELECT id, tbl, min(side * 100 + place) AS o FROM u GROUP BY 1, 2) SELECT id, tbl AS "table", rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, tbl) AS rank FROM g) WHERE rank <= 3""")
def merged_ranking(t) -> DataFrame:
    """Vector ranks first, then keyword hits in the catalog's order, once each."""
    q = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    forward = q.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("table"), F.lit(r).alias("rank")) for n, r in (("third", 1), ("other", 2))))).alias("x")).select("id", "x.*")
    backward = linking.keyword_hits(q, linking.lexicon(t.spark, _WORDS)).select("id", F.col("target").alias("table"), "pos")
    return linking.merged_tables(forward, backward, 3).select("id", "table", F.col("rank").cast("long").alias("rank"))


_LIBRARY = [("first", 0, "Q a", "S1"), ("first", 1, "Q b", "S2"), ("second", 0, "Q c", "S3"), ("second", 1, "Q d", "S4"), ("none", 0, "Q e", "S5")]


@query(f"""WITH w(target, pos, kw) AS (VALUES {", ".join(f"('{k}', {i}, '{w}')" for i, (k, ws) in enumerate(_WORDS.items()) for w in ws)}), h AS (SELECT item_id AS id, target, pos, count(DISTINCT kw) AS hits FROM benchmark JOIN w ON contains(lower(text), kw) GROUP BY 1, 2, 3),
c AS (SELECT id, target, row_number() OVER (PARTITION BY id ORDER BY hits DESC, pos) AS rank FROM h), l(cat, pos, question, sql) AS (VALUES {", ".join(str(x) for x in _LIBRARY)}),
e AS (SELECT id, question, sql, row_number() OVER (PARTITION BY id ORDER BY rank, pos) AS place FROM c JOIN l ON target = cat WHERE rank <= 2) SELECT id, string_agg(question || '=' || sql, ';' ORDER BY place) AS examples FROM e WHERE place <= 3 GROUP BY id""")
def fewshot_pick(t) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    picked = linking.picked_examples(linking.classified(q, linking.lexicon(t.spark, _WORDS)), t.spark.createDataFrame(_LIBRARY, "category string, pos int, question string, sql string"))
    return picked.select("id", F.array_join(F.transform("examples", lambda e: F.concat(e["question"], F.lit("="), e["sql"])), ";").alias("examples"))


@query("SELECT lang AS category, pos, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos < 3")
def fewshot_static(t) -> DataFrame:
    """The first n of a keyed list: three documents of each language."""
    return linking.first_examples(t.documents.select(F.col("lang").alias("category"), "doc_id"), "doc_id", 3)


_COLS = {"part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "nation": ["n_nationkey", "n_name"]}
_ESSENTIAL, _SUGGEST = ["p_partkey", "n_nationkey"], {"p_brand": ["the"], "p_size": ["and"], "n_name": ["tion"], "x_other": ["the"]}


@query(f"""WITH cat(tbl, o, col) AS (VALUES {", ".join(f"('{k}', {i}, '{c}')" for k, cs in _COLS.items() for i, c in enumerate(cs))}), w(col, kw) AS (VALUES {", ".join(f"('{c}', '{x}')" for c, xs in _SUGGEST.items() for x in xs)}),
s AS (SELECT DISTINCT item_id AS id, col FROM benchmark JOIN w ON contains(lower(text), kw)), k AS (SELECT b.item_id AS id, tbl, o, cat.col FROM benchmark b, cat WHERE cat.col IN ('p_partkey', 'n_nationkey') OR EXISTS (SELECT 1 FROM s WHERE s.id = b.item_id AND s.col = cat.col))
SELECT id, tbl AS "table", string_agg(col, ',' ORDER BY o) AS columns FROM k GROUP BY id, tbl""")
def relevant_columns(t) -> DataFrame:
    q = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    chosen = q.select("id", F.explode(F.array(*map(F.lit, _COLS))).alias("table"))
    cat = t.spark.createDataFrame([(k, i, c) for k, cs in _COLS.items() for i, c in enumerate(cs)], "table string, ordinal int, column string")
    suggested = linking.keyword_hits(q, linking.lexicon(t.spark, _SUGGEST)).select("id", F.col("target").alias("column"))
    essential = t.spark.createDataFrame([(c,) for c in _ESSENTIAL], "column string")
    return linking.relevant_columns(chosen, cat, essential, suggested).select("id", "table", F.array_join("columns", ",").alias("columns"))


@query("""SELECT item_id AS id, 'RULES' || chr(10) || chr(10) || 'part(p_partkey, p_name)' || chr(10) || '-- JOIN x ON y' || chr(10) || '-- ! careful' || chr(10) || chr(10) || 'Q: Q a' || chr(10) || 'SQL: S1' || chr(10) || chr(10) || 'QUESTION:' || chr(10) || text || chr(10) || chr(10) || 'SQL:' AS prompt FROM benchmark""")
def prompt_text(t) -> DataFrame:
    """Rules, schema with joins and warnings, examples and the question."""
    q = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    cols = q.select("id", F.lit("part").alias("table"), F.array(F.lit("p_partkey"), F.lit("p_name")).alias("columns"))
    joins = q.select("id", F.lit(1).alias("ra"), F.lit(2).alias("rb"), F.lit("JOIN x ON y").alias("join"))
    context = linking.context_text(cols, joins, linking.rule_warnings(q, [("", [], "careful")]))
    examples = q.select("id", F.array(F.struct(F.lit(1).alias("at"), F.lit("Q a").alias("question"), F.lit("S1").alias("sql"))).alias("examples"))
    return linking.prompts(q, context, examples, "RULES")


@query("SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS term FROM documents) GROUP BY term")
def index_terms(t) -> DataFrame:
    """The document frequencies of an index, written as Parquet and read back."""
    import uuid

    from ..session import shared_dir

    top = f"{shared_dir(t.spark)}/index-{uuid.uuid4().hex}"
    terms = t.documents.select(F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    files.write_index(terms, top)
    return files.read_index(t.spark, top)


@query("SELECT vec_id, CAST(round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) AS DOUBLE) AS dot FROM embeddings")
def unit_vectors(t) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(cosine(F.col("embedding"), F.col("embedding")), 4).alias("dot"))


@query("SELECT event_type, strftime(max(ts), '%Y%m%d_%H%M%S') AS stamp, left(max(props), 4) AS cut FROM events GROUP BY event_type")
def stamped_names(t) -> DataFrame:
    """Time stamps for file names, and messages cut short."""
    return t.events.groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyyMMdd_HHmmss").alias("stamp"), F.substring(F.max("props"), 1, 4).alias("cut"))


@query(r"""WITH w AS (SELECT 'm' || item_id % 3 AS model, 3 + item_id % 3 AS k, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM benchmark),
r AS (SELECT model, CASE WHEN n = 0 THEN 1.0 ELSE (n // k)::DOUBLE / n END AS wer FROM w) SELECT model, count(*) AS n, round(avg(wer), 6) AS mean_wer, round(stddev_samp(wer), 6) AS std_wer FROM r GROUP BY model""")
def asr_benchmark(t) -> DataFrame:
    """Error rates by model; each leaves out every third, fourth or fifth word of what is said."""
    from ..functions.text import asr_report

    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    heard = F.array_join(F.filter(words, lambda w, i: (i + 1) % F.col("k") != 0), " ")
    said = t.benchmark.select("text", (F.col("item_id") % 3 + 3).cast("int").alias("k"), F.concat(F.lit("m"), (F.col("item_id") % 3).cast("string")).alias("model"))
    d = said.select("model", F.col("text").alias("reference"), heard.alias("hypothesis"))
    return asr_report(d).select("model", "n", F.round("mean_wer", 6).alias("mean_wer"), F.round("std_wer", 6).alias("std_wer"))
