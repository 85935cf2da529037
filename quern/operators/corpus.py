"""Question and conversation corpora: chat records, splits, augmentation, matches and error rates as queries."""

from __future__ import annotations

from functools import reduce
from itertools import product
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_accents, word_error_rate, word_tokens
from .profiling import hashed
from .registry import query


def chat_rows(pairs: DataFrame, system: str, source: str) -> DataFrame:
    """(messages, metadata) of (question, context, sql): the form that trainers read."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user = F.concat(F.coalesce("context", F.lit("")), F.lit("\n\nQUESTION:\n"), "question", F.lit("\n\nSQL:"))
    return pairs.select(F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", F.col("sql"))).alias("messages"), F.struct("question", F.lit(source).alias("source")).alias("metadata"))


def question_of(prompt):
    """The question inside of a prompt."""
    return F.trim(F.regexp_extract(prompt, r"(?s)QUESTION:\n(.*?)\n\nSQL:", 1))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both, with priority 0 for the first and 1 for the second."""
    return first.withColumn("priority", F.lit(0)).unionByName(second.withColumn("priority", F.lit(1)))


def cleaned(pairs: DataFrame) -> DataFrame:
    """(id, question, sql): trimmed, SQL ended by `;`, the smallest id of each SQL kept; rows without either go."""
    sql = F.concat(F.regexp_replace(F.trim("sql"), r"[;\s]+$", ""), F.lit(";"))
    rows = pairs.select("id", F.trim("question").alias("question"), sql.alias("sql")).where("question <> '' AND sql <> ';'")
    return rows.groupBy("sql").agg(F.min_by(F.struct("id", "question"), F.struct("id", "question")).alias("x")).select("x.id", "x.question", "sql")


def split(df: DataFrame, key: str, test_percent: int = 10, seed: int = 42) -> DataFrame:
    """df with `part`: train or test, by a hash of the key; the same in every run and for every partitioning."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(100)) < test_percent, "test").otherwise("train"))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)


# Phrases and what may stand for them, and values that augmentation puts for one another.
PHRASES = {
    "liệt kê": ["cho tôi xem", "hiển thị", "tìm giúp tôi", "lấy danh sách", "truy vấn"],
    "tìm": ["lọc ra", "tìm kiếm", "cho biết", "xác định"],
    "bao nhiêu": ["có bao nhiêu", "tổng số", "đếm xem có", "số lượng"],
    "doanh thu": ["doanh số", "tổng bán hàng", "revenue", "lợi nhuận bán hàng"],
    "tổng": ["cộng tất cả", "sum", "tính tổng"],
    "khách hàng": ["người mua", "customer", "người dùng"],
    "sản phẩm": ["mặt hàng", "hàng hóa", "items", "món đồ"],
    "mua": ["đặt hàng", "order", "giao dịch"],
    "năm": ["trong năm", "vào năm"],
    "quý": ["trong quý", "quý số"],
    "tại": ["ở", "thuộc", "nằm ở"],
    "cao nhất": ["lớn nhất", "top", "đứng đầu", "nhiều nhất"],
    "thấp nhất": ["nhỏ nhất", "ít nhất", "cuối bảng"],
}
STATES = ["CA", "TX", "NY", "FL", "IL", "GA", "NC", "VA", "MO", "KY", "IA", "KS"]
YEARS = ["1998", "1999", "2000", "2001", "2002"]
QUARTERS = ["1", "2", "3", "4"]
CATEGORIES = ["Books", "Children", "Electronics", "Home", "Jewelry", "Men", "Music", "Shoes", "Sports", "Women"]
#: Phrases drawn for a paraphrase; questions of a hundred that get slips of the pen, and slips of a thousand letters.
PATTERNS, TYPO_PERCENT, TYPO_PERMILLE = 2, 30, 50


class Slot(NamedTuple):
    """A kind of value that a question and its SQL name alike: what stands before and after it in either, as patterns."""

    kind: str
    name: str
    values: list[str]
    question: tuple[str, str]
    sql: tuple[str, str]

    def pattern(self, side: tuple[str, str], value: str) -> str:
        return f"(?i)({side[0]}){value}({side[1]})"


#: Slots by the kind of variant that changes them; those of a kind change together.
SLOTS = [
    Slot("values", "state", STATES, (r"\b", r"\b"), ("'", "'")),
    Slot("values", "year", YEARS, (r"\b", r"\b"), (r"\b", r"\b")),
    Slot("values", "quarter", QUARTERS, (r"quý\s*", r"\b"), (r"\bd_qoy\s*=\s*", r"\b")),
    Slot("category", "category", CATEGORIES, (r"\b", r"\b"), ("'", "'")),
]


def _draw(seed: int, *of) -> Column:
    """A number drawn from a hash of a seed and some columns, one that SQL can draw as well."""
    return hashed(F.lit(seed), *of)


def _choice(options: Column, draw: Column) -> Column:
    return F.element_at(options, (F.pmod(draw, F.size(options)) + 1).cast("int"))


def _put(text: Column, side: tuple[str, str], old: Column, new: Column) -> Column:
    """text with `new` wherever `old` stands between the patterns of a side; as it is where old is null."""
    pattern = F.concat(F.lit(f"(?i)(?<before>{side[0]})"), old, F.lit(f"(?<after>{side[1]})"))
    return F.when(old.isNull(), text).otherwise(F.regexp_replace(text, pattern, F.concat(F.lit("${before}"), new, F.lit("${after}"))))


def with_slots(kind: str, seed: int, slots=SLOTS) -> tuple[Column, Column]:
    """(question, sql) with another value in every slot of this kind that either names: the first of its values that is there gives way to a drawn one in both."""
    question, sql = F.col("question"), F.col("sql")
    for slot in (s for s in slots if s.kind == kind):
        old = F.coalesce(*(F.when(F.rlike("question", F.lit(slot.pattern(slot.question, v))) | F.rlike("sql", F.lit(slot.pattern(slot.sql, v))), v) for v in slot.values))
        new = _choice(F.array_remove(F.array(*map(F.lit, slot.values)), old), _draw(seed, F.lit(slot.name), "question"))
        question, sql = _put(question, slot.question, old, new), _put(sql, slot.sql, old, new)
    return question, sql


def paraphrase(seed: int, phrases=PHRASES) -> Column:
    """The question with the first place of some drawn phrases put differently, whatever its case; phrases that it doesn't have change nothing."""
    table = F.array(*(F.struct(_draw(seed, F.lit(old), "question").alias("draw"), F.lit(old).alias("old"), F.array(*map(F.lit, new)).alias("new")) for old, new in phrases.items()))
    drawn = F.slice(F.array_sort(table), 1, PATTERNS)
    return F.aggregate(drawn, F.col("question"), lambda text, x: F.regexp_replace(text, F.concat(F.lit("(?is)^(.*?)"), x["old"]), F.concat(F.lit("$1"), _choice(x["new"], x["draw"].bitwiseXOR(F.lit(seed))))))


def slips(seed: int, percent: int = TYPO_PERCENT, permille: int = TYPO_PERMILLE) -> Column:
    """Some questions with letters swapped with the next, doubled or left out: one at least, and a share of the others."""
    chars, n, draw = F.split("question", ""), F.length("question"), _draw(seed, F.lit("slip"), "question")

    def hit(i: Column) -> Column:
        return ((i == F.pmod(draw, n)) | (F.pmod(F.xxhash64(draw, i), F.lit(1000)) < permille)) & F.rlike(F.get(chars, i), F.lit(r"\p{L}"))

    kind = lambda i: F.pmod(F.xxhash64(draw, i, F.lit(1)), F.lit(3))
    swaps = lambda i: (i >= 0) & (i < n - 1) & hit(i) & (kind(i) == 0)
    letter = lambda c, i: F.when(swaps(i - 1), F.get(chars, i - 1)).when(swaps(i), F.get(chars, i + 1)).when(hit(i) & (kind(i) == 1), F.concat(c, c)).when(hit(i) & (kind(i) == 2), "").otherwise(c)
    return F.when((F.pmod(F.shiftright(draw, 20), F.lit(100)) < percent) & (n > 0), F.array_join(F.transform(chars, letter), "")).otherwise(F.col("question"))


def augmented(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """(id, kind, question, sql): each pair itself, then a paraphrase, other values, another category and slips of the pen, each only if it differs.

    Draws come from a hash of the question, so reruns agree; all is one projection in the JVM. Rows with a null go."""
    variants = [("original", F.col("question"), F.col("sql")), ("paraphrase", paraphrase(seed), F.col("sql")), *((k, *with_slots(k, seed)) for k in dict.fromkeys(s.kind for s in SLOTS)), ("typo", slips(seed), F.col("sql"))]
    made = F.array(*(F.struct(F.lit(k).alias("kind"), q.alias("question"), s.alias("sql")) for k, q, s in variants))
    rows = pairs.select("id", "question", "sql").na.drop()
    each = rows.select("id", F.col("question").alias("_q"), F.col("sql").alias("_s"), F.explode(made).alias("v")).select("id", "_q", "_s", "v.*")
    return each.where((F.col("kind") == "original") | (F.col("question") != F.col("_q")) | (F.col("sql") != F.col("_s"))).drop("_q", "_s")


@query("SELECT conv_id, count(*) AS n_messages, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def chat_records(t) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("chat"))


@query("SELECT CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1') THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM documents GROUP BY 1")
def corpus_split(t) -> DataFrame:
    part = F.when(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1"), "test").otherwise("train")
    return t.documents.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


_ASKED, _ASKED_SQL = "Tìm khách hàng tại CA quý 2 năm 1999, Books: ", "SELECT c FROM s WHERE ca_state = 'CA' AND d_year = 1999 AND d.d_qoy = 2 AND i_category = 'Books';"


@query()
def augment_fanout(t) -> DataFrame:
    d = t.benchmark.select(F.col("item_id").alias("id"), F.concat(F.lit(_ASKED), "text").alias("question"), F.lit(_ASKED_SQL).alias("sql"))
    return augmented(d)


def _slots_sql() -> str:
    """What with_slots gives for every pair of d (id, question, sql), for each kind."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    steps, names = ["d AS (SELECT item_id AS id, " + text(_ASKED) + " || text AS question, " + text(_ASKED_SQL) + " AS sql FROM benchmark)"], []
    for kind in dict.fromkeys(s.kind for s in SLOTS):
        last = f"{kind}_0"
        steps.append(f"{last} AS (SELECT id, question AS first, sql AS first_sql, question, sql FROM d)")
        for n, slot in enumerate((s for s in SLOTS if s.kind == kind), 1):
            old = "CASE " + " ".join(f"WHEN regexp_matches(first, {text(slot.pattern(slot.question, v))}) OR regexp_matches(first_sql, {text(slot.pattern(slot.sql, v))}) THEN '{v}'" for v in slot.values) + " END"
            draw = f"CAST('0x' || substr(md5('42|{slot.name}|' || first), 1, 15) AS BIGINT)"
            others = "list_filter([" + ", ".join(text(v) for v in slot.values) + "], lambda x: x <> old)"
            steps.append(f"{kind}_{n}o AS (SELECT *, {old} AS old FROM {last})")
            steps.append(f"{kind}_{n}n AS (SELECT *, ({others})[{draw} % {len(slot.values) - 1} + 1] AS new FROM {kind}_{n}o)")
            put = lambda c, side: f"CASE WHEN old IS NULL THEN {c} ELSE regexp_replace({c}, {text(f'(?i)({side[0]})')} || old || {text(f'({side[1]})')}, '\\1' || new || '\\2', 'g') END"
            steps.append(f"{kind}_{n} AS (SELECT id, first, first_sql, {put('question', slot.question)} AS question, {put('sql', slot.sql)} AS sql FROM {kind}_{n}n)")
            last = f"{kind}_{n}"
        names.append(f"SELECT id, '{kind}' AS kind, question, sql FROM {last} WHERE question <> first OR sql <> first_sql")
    return "WITH " + ",\n".join(steps) + "\nSELECT id, 'original' AS kind, question, sql FROM d UNION ALL " + " UNION ALL ".join(names)


@query(_slots_sql())
def augment_rules(t) -> DataFrame:
    """Every pair itself, with other values and with another category: what was drawn, in question and SQL alike."""
    d = t.benchmark.select(F.col("item_id").alias("id"), F.concat(F.lit(_ASKED), "text").alias("question"), F.lit(_ASKED_SQL).alias("sql"))
    return augmented(d).where(F.col("kind").isin("original", *(s.kind for s in SLOTS)))


def template_pairs(templates: list[tuple[str, str, dict[str, list[str]]]]) -> list[tuple[str, str]]:
    """(question, sql) of each template (with {slots}) and each choice of its slots' values, in order."""
    found = []
    for question, sql, slots in templates:
        for values in product(*slots.values()):
            chosen = dict(zip(slots, values))
            found.append((question.format(**chosen), sql.format(**chosen)))
    return found


def filled(question: str, sql: str, values: DataFrame) -> DataFrame:
    """(question, sql) of a template for each row of values, whose columns are the template's {slots}."""
    put = lambda text: reduce(lambda c, name: F.replace(c, F.lit("{" + name + "}"), F.col(name).cast("string")), values.columns, F.lit(text))
    return values.select(put(question).alias("question"), put(sql).alias("sql"))


@query("""WITH a AS (SELECT 'How many orders had the status ' || s || ' in ' || y || '?' AS question, 'SELECT count(*) AS n FROM orders WHERE o_orderstatus = ' || chr(39) || s || chr(39) || ' AND year(o_orderdate) = ' || y || ';' AS sql FROM (SELECT DISTINCT o_orderstatus AS s, year(o_orderdate) AS y FROM orders)
UNION ALL SELECT 'List customers of the segment ' || m, 'SELECT c_custkey FROM customer WHERE c_mktsegment = ' || chr(39) || m || chr(39) || ';' FROM (SELECT DISTINCT c_mktsegment AS m FROM customer))
SELECT 'system=You write SQL.|user=' || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'SQL:|assistant=' || sql AS messages, question, 'template' AS source FROM a""")
def template_corpus(t) -> DataFrame:
    """Pairs from templates with values of the tables, as chat records; the question is found again in the prompt."""
    orders = filled("How many orders had the status {s} in {y}?", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = '{s}' AND year(o_orderdate) = {y};", t.orders.select(F.col("o_orderstatus").alias("s"), F.year("o_orderdate").alias("y")).distinct())
    segments = filled("List customers of the segment {m}", "SELECT c_custkey FROM customer WHERE c_mktsegment = '{m}';", t.customer.select(F.col("c_mktsegment").alias("m")).distinct())
    rows = chat_rows(orders.unionByName(segments).withColumn("context", F.lit("")), "You write SQL.", "template")
    shown = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")
    return rows.select(shown.alias("messages"), question_of(F.col("messages")[1]["content"]).alias("question"), F.col("metadata.source").alias("source"))


@query("SELECT min(item_id) AS id, trim(text) AS question, regexp_replace(trim(text), '[;\\s]+$', '') || ';' AS sql FROM benchmark GROUP BY text HAVING trim(text) <> ''")
def cleaned_pairs(t) -> DataFrame:
    """Trimmed, ended by `;`, one pair of each SQL."""
    d = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.col("text").alias("sql"))
    return cleaned(merged(d, d.withColumn("id", F.col("id") + 1_000_000)).drop("priority"))


@query(r"""SELECT item_id AS id, CASE WHEN n = 0 THEN 1.0 ELSE round((n // 4)::DOUBLE / n, 6) END AS wer FROM (SELECT item_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM benchmark)""")
def wer_rows(t) -> DataFrame:
    """The word error rate of every item against itself without every fourth word: no alignment takes fewer edits than words are missing."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    heard = F.array_join(F.filter(words, lambda w, i: (i + 1) % 4 != 0), " ")
    return t.benchmark.select(F.col("item_id").alias("id"), F.round(word_error_rate(F.col("text"), heard), 6).alias("wer"))


@query()
def keyword_fix(t) -> DataFrame:
    """Transcripts that say an item's first words among misheard keywords."""
    from ..functions.keywords import sql_keywords

    few = F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " ")
    d = t.benchmark.select(F.col("item_id").alias("id"), F.concat(F.lit("sellect "), few, F.lit(" form customer wher age > "), F.col("item_id").cast("string"), F.lit(" groub bai region")).alias("heard"))
    return d.select("id", "heard", sql_keywords("heard").alias("said"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS n_tokens, length(strip_accents(text)) AS n_plain FROM documents")
def tokenize_unicode(t) -> DataFrame:
    return t.documents.select("doc_id", F.size(word_tokens(F.col("text"))).cast("long").alias("n_tokens"), F.length(strip_accents("text")).cast("long").alias("n_plain"))


_A = "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey"
_B = "SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey"


@query(f"""WITH a AS ({_A}), b AS ({_B}) SELECT
NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) AND NOT EXISTS (SELECT * FROM b EXCEPT SELECT * FROM a) AS by_set,
NOT EXISTS (SELECT k FROM a EXCEPT SELECT k FROM b) AND NOT EXISTS (SELECT k FROM b EXCEPT SELECT k FROM a) AS by_key,
true AS itself""")
def match_results(t) -> DataFrame:
    """Are two results equal as sets; three cases in one row."""
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))

    def apart(x, y):  # rows of one that the other lacks
        return x.distinct().exceptAll(y.distinct()).unionByName(y.distinct().exceptAll(x.distinct())).agg((F.count("*") == 0).alias("same"))

    ka, kb = a.select("k"), b.select("k")
    return apart(a, b).select(F.col("same").alias("by_set")).crossJoin(apart(ka, kb).select(F.col("same").alias("by_key"))).crossJoin(apart(a, a).select(F.col("same").alias("itself")))  # one row each


@query("SELECT event_type AS condition, count(*) AS n, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(value), 4) AS mean_latency_ms FROM events GROUP BY event_type")
def eval_summary(t) -> DataFrame:
    from ..plans.evaluate import rollup

    true = F.lit(True)
    r = t.events.select(F.col("event_type").alias("condition"), true.alias("valid"), true.alias("executed"), (F.col("value") > 10).alias("matched"), true.alias("exact"), F.lit(False).alias("repaired"), F.col("value").alias("latency_ms"))
    return rollup(r, ["condition"]).select("condition", "n", "accuracy", "mean_latency_ms")


_SQL_TEXTS = ["SELECT * FROM a@", "DROP TABLE a@", "WITH x AS (SELECT @) SELECT * FROM x", "SELECT 'drop' AS w FROM a@", "update a set b = @", "-- note\nSELECT @", "SELECT created@ FROM a"]


@query(r"SELECT id, s, regexp_matches(lower(trim(regexp_replace(s, '--[^\n]*', ' ', 'g'), E' \n\t')), '^(select|with)\b') AND NOT regexp_matches(lower(regexp_replace(s, '--[^\n]*', ' ', 'g')), '\b(insert|update|delete|drop|create|alter|truncate|merge|grant|revoke|attach|copy|pragma)\b') AS ok FROM (SELECT item_id AS id, replace(["
       + ", ".join("'" + s.replace("'", "''") + "'" for s in _SQL_TEXTS) + f"][item_id % {len(_SQL_TEXTS)} + 1], '@', CAST(item_id AS VARCHAR)) AS s FROM benchmark)")
def guard_sql(t) -> DataFrame:
    """Statements by the guard that goes by words."""
    from ..plans.gateway import guard_text

    @F.pandas_udf("boolean")
    def permitted(texts: pd.Series) -> pd.Series:
        return texts.map(guard_text)

    made = F.replace(F.element_at(F.array(*map(F.lit, _SQL_TEXTS)), (F.col("item_id") % len(_SQL_TEXTS) + 1).cast("int")), F.lit("@"), F.col("item_id").cast("string"))
    return t.benchmark.select(F.col("item_id").alias("id"), made.alias("s")).withColumn("ok", permitted("s"))
