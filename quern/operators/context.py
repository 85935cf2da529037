"""Schema texts for questions: kinds and keys of columns, samples, warnings, and the forms that training data and prompts take.

Catalogs, samples and rules are configuration tables of the size of a schema; questions are a table of any size, and stay one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import warehouse
from .linking import inferred_joins, lexicon
from .registry import query


def column_kind(column: Column) -> Column:
    """A column's type by its name."""
    kind = F.lit("VARCHAR")
    for part, name in reversed(warehouse.KIND_BY_PART):
        kind = F.when(F.contains(column, F.lit(part)), name).otherwise(kind)
    for end, name in reversed(warehouse.KIND_BY_END):
        kind = F.when(F.endswith(column, F.lit(end)), name).otherwise(kind)
    return kind


def key_note(table: Column, column: Column) -> Column:
    """PRIMARY KEY of a surrogate key that begins with its table's first two letters, else what it refers to, else empty.

    By that rule web_open_date_sk is a key of web_site, and inventory's references are keys: kept, for results depend on it."""
    pairs = [F.lit(x) for k, v in warehouse.FOREIGN.items() for x in (k, f"FK -> {v}")]
    own = F.endswith(column, F.lit("_sk")) & F.startswith(column, F.substring(table, 1, 2))
    return F.when(own, "PRIMARY KEY").otherwise(F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit("")))


def _any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def invented_columns(questions: DataFrame, rules=warehouse.INVENTED) -> DataFrame:
    """(id, warnings): what a question tempts to make up, in the rules' order."""
    q = F.lower("question")
    fired = [F.when(_any(q, one) & (_any(q, two) if two else F.lit(True)), F.lit(text)) for one, two, text in rules]
    return questions.select("id", F.array_compact(F.array(*fired)).alias("warnings"))


def _fits(q: Column, words: list[str]) -> Column:
    return _any(q, words) if words else F.lit(True)


def channel(question: Column, rules=warehouse.WARNINGS) -> Column:
    """The sales channel that a question names: that of the first named rule that fits it, null if none."""
    q = F.lower(question)
    return F.coalesce(*(F.when(_fits(q, words), name) for name, words, _ in rules if name), F.lit(None).cast("string"))


def column_warnings(questions: DataFrame, rules=warehouse.WARNINGS) -> DataFrame:
    """(id, warnings): the lines of all rules (name, words, lines) that fit a question, in their order; of the named ones only the first.

    A null question gets the lines of rules without words."""
    q = F.lower(F.coalesce("question", F.lit("")))
    named = channel(F.coalesce("question", F.lit("")), rules)
    lines = [F.when((named == name) if name else _fits(q, words), F.array(*map(F.lit, text))) for name, words, text in rules]
    return questions.select("id", F.flatten(F.array_compact(F.array(*lines))).alias("warnings"))


def relevant_samples(questions: DataFrame, selected: DataFrame, samples: DataFrame, words: dict[str, list[str]] = warehouse.SAMPLED, most: int = 5) -> DataFrame:
    """(id, samples): lines of values of the columns that a question's words call for, tables by rank; no row for a question without any.

    selected: (id, table, rank); samples: (table, column, values)."""
    lex = lexicon(questions.sparkSession, words).select(F.col("target").alias("column"), "keyword").distinct()
    hits = questions.join(F.broadcast(lex), F.contains(F.lower("question"), F.col("keyword"))).select("id", "column").distinct()
    shown = F.array_join(F.transform(F.slice("values", 1, most), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    rows = selected.join(F.broadcast(samples.where(F.size("values") > 0)), "table").join(hits, ["id", "column"])
    lines = rows.groupBy("id", "table", "rank").agg(F.array_join(F.array_sort(F.collect_list(F.concat("column", F.lit(": "), shown))), "\n  ").alias("cols"))
    return lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("table", F.lit(":\n  "), "cols").alias("t")))), lambda x: x["t"]), "\n").alias("samples"))


def column_lines(catalog: DataFrame, descriptions: DataFrame | None = None, linked: DataFrame | None = None) -> DataFrame:
    """(table, ordinal, column, line): name, kind, and key note or description as a comment. With linked (id, column), a row for
    each id, and a description alone is shown only for linked columns.

    catalog: (table, ordinal, column); descriptions: (column, description)."""
    rows = catalog.select("table", "ordinal", "column", column_kind(F.col("column")).alias("kind"), key_note(F.col("table"), F.col("column")).alias("note"))
    if descriptions is not None:
        rows = rows.join(F.broadcast(descriptions.select("column", "description")), "column", "left")
    else:
        rows = rows.withColumn("description", F.lit(None).cast("string"))
    if linked is not None:
        ids = linked.select("id").distinct()
        rows = ids.crossJoin(F.broadcast(rows))  # the catalog, which has the size of a schema, for each question
        rows = rows.join(linked.select("id", "column").distinct().withColumn("_l", F.lit(True)), ["id", "column"], "left")
    else:
        rows = rows.withColumn("_l", F.lit(True))
    text = F.nullif(F.concat_ws(" | ", F.nullif("note", F.lit("")), F.when((F.col("note") != "") | F.col("_l"), F.nullif("description", F.lit("")))), F.lit(""))
    line = F.concat(F.lit("  "), "column", F.lit(" "), "kind", F.coalesce(F.concat(F.lit("   -- "), text), F.lit("")))
    return rows.select(*(["id"] if linked is not None else []), "table", "ordinal", "column", line.alias("line"))


def table_texts(lines: DataFrame, aliases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(.., table, text) of column lines: a heading with the table's alias and a line for each column in order."""
    by = by or []
    rows = lines.groupBy(*by, "table").agg(F.array_sort(F.collect_list(F.struct("ordinal", "line"))).alias("l")).join(F.broadcast(aliases), "table", "left")
    head = F.concat(F.lit("TABLE "), "table", F.lit(" (alias: "), F.coalesce("alias", "table"), F.lit(")"))
    return rows.select(*by, "table", F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def full_schema(catalog: DataFrame, aliases: DataFrame, compact: bool = False) -> DataFrame:
    """(schema): one row with all tables by name; compact: table(column, ..) lines."""
    if compact:
        texts = catalog.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("ordinal", "column"))).alias("c"))
        texts = texts.select("table", F.concat("table", F.lit("("), F.array_join(F.transform("c", lambda x: x["column"]), ", "), F.lit(")")).alias("text"))
    else:
        texts = table_texts(column_lines(catalog), aliases)
    return texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", "text"))), lambda x: x["text"]), "\n" if compact else "\n\n").alias("schema"))


def described_schema(catalog: DataFrame, edges: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(table, text): columns with what they mean, then the tables that an edge leads to."""
    cols = catalog.join(F.broadcast(descriptions), "column", "left")
    line = F.concat(F.lit("  "), "column", F.coalesce(F.concat(F.lit(": "), "description"), F.lit("")))
    texts = cols.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("l"))
    ways = edges.select(F.col("left_table").alias("table"), F.concat(F.lit("  -> "), "right_table", F.lit(" ON "), "on").alias("way"))
    ways = ways.groupBy("table").agg(F.array_sort(F.collect_list("way")).alias("ways"))
    return texts.join(F.broadcast(ways), "table", "left").select("table", F.concat_ws("\n", "table", F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.array_join("ways", "\n")).alias("text"))


def training_context(questions: DataFrame, selected: DataFrame, catalog: DataFrame, aliases: DataFrame, edges: DataFrame, linked: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(id, context): aliases, schema with kinds and keys, the first three joins, meanings, columns not to use, and warnings, each under its heading.

    selected: (id, table, rank). A question has a handful of tables; parts that are empty are left out."""
    use = selected.join(F.broadcast(aliases), "table", "left").withColumn("alias", F.coalesce("alias", "table"))
    named = use.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("  "), "table", F.lit(" = "), "alias").alias("l")))), lambda x: x["l"]), "\n").alias("p1"))
    lines = column_lines(catalog, descriptions).select("table", "ordinal", "column")
    own = selected.join(F.broadcast(lines), "table").join(linked.select("id", "column").distinct().withColumn("_l", F.lit(True)), ["id", "column"], "left").join(F.broadcast(descriptions), "column", "left")
    note = key_note(F.col("table"), F.col("column"))
    text = F.nullif(F.concat_ws(" | ", F.nullif(note, F.lit("")), F.when((note != "") | F.col("_l"), F.nullif("description", F.lit("")))), F.lit(""))
    own = own.withColumn("line", F.concat(F.lit("  "), "column", F.lit(" "), column_kind(F.col("column")), F.coalesce(F.concat(F.lit("   -- "), text), F.lit(""))))
    tables = table_texts(own, aliases, ["id", "rank"])
    schema = tables.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("p2"))
    joins = inferred_joins(selected, edges).groupBy("id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ra", "rb", "join"))), 1, 3), lambda x: F.concat(F.lit("  "), x["join"])), "\n").alias("p3"))
    means = own.where("description <> ''").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ordinal", F.concat(F.lit("  "), "column", F.lit(": "), "description").alias("l")))), lambda x: x["l"]), "\n").alias("p4"))
    listed = lambda d, name: d.select("id", F.nullif(F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("  - "), w)), "\n"), F.lit("")).alias(name))
    rows = questions.select("id").distinct()
    for part in (named, schema, joins, means, listed(invented_columns(questions), "p5"), listed(column_warnings(questions), "p6")):
        rows = rows.join(part, "id", "left")
    heads = ("TABLE ALIASES (USE EXACTLY):", None, "JOIN HINTS:", "COLUMN MEANINGS:", "DO NOT USE (columns do not exist!):", "IMPORTANT:")
    parts = [F.concat(F.lit(f"{h}\n" if h else ""), F.col(f"p{k}")) for k, h in enumerate(heads, 1)]
    return rows.select("id", F.concat_ws("\n\n", *parts).alias("context"))


def enhanced_context(contexts: DataFrame, joins: DataFrame, warnings: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(id, context): schema, join hints, warnings and samples, each under its heading where there is one. joins: (id, ra, rb, join)."""
    hints = joins.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ra", "rb", "join"))), lambda x: x["join"]), "\n").alias("j"))
    rows = contexts.join(hints, "id", "left").join(warnings.select("id", F.nullif(F.array_join("warnings", "\n"), F.lit("")).alias("w")), "id", "left")
    rows = rows.join(samples, "id", "left") if samples is not None else rows.withColumn("samples", F.lit(None).cast("string"))
    parts = [F.concat(F.lit(f"{h}:\n"), F.col(c)) for h, c in (("SCHEMA", "context"), ("JOIN HINTS", "j"), ("IMPORTANT", "w"), ("DATA SAMPLES (use exact values)", "samples"))]
    return rows.select("id", F.concat_ws("\n\n", *parts).alias("context"))


# Queries. Questions are the benchmark's items with a clause that names what the rules look for; the catalog is the driver's tables.
_CLAUSES = ["doanh thu web năm 2001 theo bang", "online catalog discount", "cửa hàng bang nào, đơn hàng store", "giới tính khách sinh năm 1980", "nothing of the kind", "giá niêm yết danh mục, tồn kho"]
_Q_SQL = "q AS (SELECT item_id AS id, lower(['" + "', '".join(_CLAUSES) + "'][item_id % 6 + 1] || ' ' || text) AS question FROM benchmark)"
_SCHEMA = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "inventory": ["inv_date_sk", "inv_item_sk", "inv_quantity"],
    "web_site": ["web_site_sk", "web_open_date_sk", "web_name"], "store_sales": ["ss_sold_date_sk", "ss_item_sk", "ss_list_price", "ss_year", "ss_ticket_id"],
}
_CAT_SQL = "cat(tbl, ordinal, col) AS (VALUES " + ", ".join(f"('{t}', {i}, '{c}')" for t, cs in _SCHEMA.items() for i, c in enumerate(cs)) + ")"
_DESC = {"c_acctbal": "balance of the account", "inv_quantity": "pieces at hand", "ss_item_sk": "what was sold"}
_ALIAS = {"customer": "c", "nation": "n", "inventory": "inv", "web_site": "web", "store_sales": "ss"}


def _questions(t) -> DataFrame:
    clause = F.element_at(F.array(*map(F.lit, _CLAUSES)), (F.col("item_id") % 6 + 1).cast("int"))
    return t.benchmark.select(F.col("item_id").alias("id"), F.concat(clause, F.lit(" "), "text").alias("question"))


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(tb, i, c) for tb, cs in _SCHEMA.items() for i, c in enumerate(cs)], "table string, ordinal int, column string")


def _pairs(spark: SparkSession, d: dict, names: str) -> DataFrame:
    return spark.createDataFrame(list(d.items()), names)


def _when_any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(question, '{w}')" for w in words) + ")" if words else "true"


_KIND_SQL = "CASE " + " ".join(f"WHEN ends_with(col, '{e}') THEN '{k}'" for e, k in warehouse.KIND_BY_END) + " " + " ".join(f"WHEN contains(col, '{p}') THEN '{k}'" for p, k in warehouse.KIND_BY_PART) + " ELSE 'VARCHAR' END"
_NOTE_SQL = "CASE WHEN ends_with(col, '_sk') AND starts_with(col, substr(tbl, 1, 2)) THEN 'PRIMARY KEY' " + " ".join(f"WHEN col = '{k}' THEN 'FK -> {v}'" for k, v in warehouse.FOREIGN.items()) + " ELSE '' END"


@query(f"WITH {_CAT_SQL} SELECT tbl AS \"table\", col AS \"column\", {_KIND_SQL} AS kind, {_NOTE_SQL} AS note FROM cat")
def column_notes(t) -> DataFrame:
    c = _catalog(t.spark)
    return c.select("table", "column", column_kind(F.col("column")).alias("kind"), key_note(F.col("table"), F.col("column")).alias("note"))


_INVENTED_SQL = ", ".join(f"CASE WHEN {_when_any(a)} AND {_when_any(b)} THEN '{text}' END" for a, b, text in warehouse.INVENTED)


@query(f"WITH {_Q_SQL} SELECT id, array_to_string(list_filter([{_INVENTED_SQL}], lambda x: x IS NOT NULL), '|') AS warnings FROM q")
def hallucination_warnings(t) -> DataFrame:
    return invented_columns(_questions(t)).select("id", F.array_join("warnings", "|").alias("warnings"))


def _quoted(lines: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in lines) + "]"


def _lines_sql(rules) -> str:
    """An expression for what column_warnings gives, with the named rule that fits first in `channel`."""
    return "flatten([" + ", ".join(f"CASE WHEN {f'channel = {chr(39)}{n}{chr(39)}' if n else _when_any(ws)} THEN {_quoted(x)} ELSE CAST([] AS VARCHAR[]) END" for n, ws, x in rules) + "])"


_CHANNEL_SQL = "CASE " + " ".join(f"WHEN {_when_any(ws)} THEN '{n}'" for n, ws, _ in warehouse.WARNINGS if n) + " END"


@query(f"WITH {_Q_SQL} SELECT id, channel, array_to_string({_lines_sql(warehouse.WARNINGS)}, '|') AS warnings FROM (SELECT *, {_CHANNEL_SQL} AS channel FROM q)")
def channel_warning(t) -> DataFrame:
    q = _questions(t)
    return column_warnings(q).join(q.select("id", channel(F.col("question")).alias("channel")), "id").select("id", "channel", F.array_join("warnings", "|").alias("warnings"))


@query(f"WITH {_Q_SQL} SELECT id, array_to_string({_lines_sql(warehouse.SHORT_WARNINGS)}, '|') AS warnings FROM q")
def short_warnings(t) -> DataFrame:
    return column_warnings(_questions(t), warehouse.SHORT_WARNINGS).select("id", F.array_join("warnings", "|").alias("warnings"))


_SAMPLES = [("date_dim", "d_year", ["1998", "1999", "2000", "2001", "2002", "2003"]), ("date_dim", "d_moy", ["1", "2"]), ("store", "s_state", ["TN", "CA"]), ("item", "i_category", ["Books", "Music"]), ("item", "i_brand", [])]
_SAMPLES_SQL = ", ".join(f"('{a}', '{b}', " + (f"['{chr(39).join([''])}" + "', '".join(c) + "']" if c else "CAST([] AS VARCHAR[])") + ")" for a, b, c in _SAMPLES)
_WORDS_SQL = ", ".join(f"('{c}', '{w}')" for c, ws in warehouse.SAMPLED.items() for w in ws)


@query(f"""WITH {_Q_SQL}, s(tbl, col, vals) AS (VALUES {_SAMPLES_SQL}), w(col, kw) AS (VALUES {_WORDS_SQL}),
h AS (SELECT DISTINCT id, s.tbl, s.col, vals FROM q JOIN w ON contains(question, kw) JOIN s ON s.col = w.col WHERE len(vals) > 0),
l AS (SELECT id, tbl, string_agg(col || ': ' || array_to_string(list_transform(vals[1:5], lambda v: '''' || v || ''''), ', '), chr(10) || '  ' ORDER BY col) AS cols FROM h GROUP BY id, tbl)
SELECT id, string_agg(tbl || ':' || chr(10) || '  ' || cols, chr(10) ORDER BY CASE tbl WHEN 'store' THEN 1 WHEN 'date_dim' THEN 2 ELSE 3 END) AS samples FROM l GROUP BY id""")
def sample_relevance(t) -> DataFrame:
    q, ranks = _questions(t), [("store", 1), ("date_dim", 2), ("item", 3)]
    chosen = q.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("table"), F.lit(r).alias("rank")) for n, r in ranks))).alias("x")).select("id", "x.*")
    return relevant_samples(q, chosen, t.spark.createDataFrame(_SAMPLES, "table string, column string, values array<string>"))


@query(f"""WITH {_CAT_SQL}, l AS (SELECT tbl, ordinal, '  ' || col || ' ' || {_KIND_SQL} || CASE WHEN {_NOTE_SQL} <> '' THEN '   -- ' || {_NOTE_SQL} ELSE '' END AS line FROM cat),
a(tbl, alias) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _ALIAS.items())})
SELECT string_agg(text, chr(10) || chr(10) ORDER BY tbl) AS schema FROM (SELECT tbl, 'TABLE ' || tbl || ' (alias: ' || any_value(alias) || ')' || chr(10) || string_agg(line, chr(10) ORDER BY ordinal) AS text FROM l JOIN a USING (tbl) GROUP BY tbl)""")
def schema_text(t) -> DataFrame:
    return full_schema(_catalog(t.spark), _pairs(t.spark, _ALIAS, "table string, alias string"))


@query(f"WITH {_CAT_SQL} SELECT string_agg(line, chr(10) ORDER BY tbl) AS schema FROM (SELECT tbl, tbl || '(' || string_agg(col, ', ' ORDER BY ordinal) || ')' AS line FROM cat GROUP BY tbl)")
def compact_schema(t) -> DataFrame:
    return full_schema(_catalog(t.spark), _pairs(t.spark, _ALIAS, "table string, alias string"), compact=True)


_EDGES_SQL = "e(l, r, cond) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in warehouse.EDGES) + ")"
_DESC_SQL = "d(col, description) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _DESC.items()) + ")"


def _edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(warehouse.EDGES, "left_table string, right_table string, on string")


@query(f"""WITH {_CAT_SQL}, {_DESC_SQL}, {_EDGES_SQL}, x AS (SELECT tbl, string_agg('  ' || col || coalesce(': ' || description, ''), chr(10) ORDER BY ordinal) AS cols FROM cat LEFT JOIN d USING (col) GROUP BY tbl),
w AS (SELECT l AS tbl, string_agg('  -> ' || r || ' ON ' || cond, chr(10) ORDER BY '  -> ' || r || ' ON ' || cond) AS ways FROM e GROUP BY l)
SELECT tbl AS "table", tbl || chr(10) || cols || coalesce(chr(10) || ways, '') AS text FROM x LEFT JOIN w USING (tbl)""")
def described_tables(t) -> DataFrame:
    return described_schema(_catalog(t.spark), _edges(t.spark), _pairs(t.spark, _DESC, "column string, description string"))


@query(f"""WITH {_EDGES_SQL}, s AS (SELECT item_id AS id, tbl, rank FROM benchmark, (VALUES ('store_sales', 1), ('customer', 2), ('customer_address', 3), ('item', 4), ('web_sales', 5)) AS v(tbl, rank) WHERE (item_id + rank) % 3 <> 0)
SELECT a.id, 'JOIN ' || b.tbl || ' ON ' || cond AS "join" FROM s a JOIN s b ON a.id = b.id AND a.rank < b.rank JOIN e ON (a.tbl = l AND b.tbl = r) OR (b.tbl = l AND a.tbl = r)""")
def join_inference(t) -> DataFrame:
    """Over the 45 edges of the warehouse, for each item and the tables dealt to it."""
    names = F.array(*(F.struct(F.lit(n).alias("table"), F.lit(k).alias("rank")) for k, n in enumerate(["store_sales", "customer", "customer_address", "item", "web_sales"], 1)))
    chosen = t.benchmark.select(F.col("item_id").alias("id"), F.explode(names).alias("x")).select("id", "x.*").where((F.col("id") + F.col("rank")) % 3 != 0)
    return inferred_joins(chosen, _edges(t.spark)).select("id", "join")


@query(f"""WITH {_Q_SQL} SELECT id, question LIKE '%giới tính%' AS gender, 2 AS tables, 5 AS parts, channel, array_to_string(list_transform({_lines_sql(warehouse.WARNINGS)}, lambda x: '  - ' || x), chr(10)) AS important
FROM (SELECT *, {_CHANNEL_SQL} AS channel FROM q)""")
def training_prompt(t) -> DataFrame:
    """Facts of the whole context text: which parts it has is read back from it."""
    q = _questions(t)
    chosen = q.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("table"), F.lit(k).alias("rank")) for k, n in ((1, "store_sales"), (2, "inventory"))))).alias("x")).select("id", "x.*")
    linked = q.select("id", F.lit("ss_item_sk").alias("column"))
    c = training_context(q, chosen, _catalog(t.spark), _pairs(t.spark, _ALIAS, "table string, alias string"), _edges(t.spark).limit(0).unionByName(t.spark.createDataFrame([("store_sales", "inventory", "ss_item_sk = inv_item_sk")], "left_table string, right_table string, on string")), linked, _pairs(t.spark, _DESC, "column string, description string"))
    has = lambda s: F.contains("context", F.lit(s))
    parts = sum((has(h).cast("int") for h in ("TABLE ALIASES (USE EXACTLY):\n  store_sales = ss\n  inventory = inv", "TABLE store_sales (alias: ss)", "JOIN HINTS:\n  JOIN inventory ON ss_item_sk = inv_item_sk", "COLUMN MEANINGS:\n  ss_item_sk: what was sold\n  inv_quantity: pieces at hand", "IMPORTANT:")), F.lit(0))
    tables = F.size(F.split("context", "TABLE (?!ALIASES)")) - 1
    named = F.nullif(F.regexp_extract("context", "CHANNEL: '(\\w+)", 1), F.lit(""))
    important = F.element_at(F.split("context", "IMPORTANT:\n"), -1)
    return c.select("id", has("c_gender → dùng cd_gender").alias("gender"), tables.alias("tables"), parts.alias("parts"), named.alias("channel"), important.alias("important"))
