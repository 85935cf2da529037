"""A guarded door for SQL text: read-only check, whitelist, limit, timeout, error classes, repair."""

from __future__ import annotations

import hashlib
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from . import rewrite

# Words that a read-only statement may not hold, strict and lenient.
FORBIDDEN = "insert update delete drop create alter truncate merge grant revoke attach copy pragma".split()
FORBIDDEN_FEW = "insert update delete drop create alter".split()
#: Parts of an error text for which another attempt is worth while.
RETRYABLE = ("binder error", "parser error", "catalog error", "not found", "does not exist", "syntax error")


def guard_text(sql: str, forbidden=FORBIDDEN) -> bool:
    """Read-only by its words: begins with SELECT or WITH and holds no forbidden word, not even in a literal."""
    bare = re.sub(r"--[^\n]*", " ", sql or "").strip().lower()
    return bool(re.match(r"(select|with)\b", bare)) and not re.search(rf"\b({'|'.join(forbidden)})\b", bare)


def _parsed(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


class _Parsed:
    """Walks a parsed statement: every plan and expression in it, whichever member holds it."""

    def __init__(self, jvm):
        for own, name in (("tree", "org.apache.spark.sql.catalyst.trees.TreeNode"), ("plan", "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"), ("product", "scala.Product"), ("many", "scala.collection.Iterable")):
            setattr(self, own, jvm.java.lang.Class.forName(name).isInstance)

    def _elements(self, x):
        """What a value holds: the members of a product, the elements of a collection, nothing for all else."""
        members = x.productIterator() if self.product(x) else x.iterator() if self.many(x) else None
        while members is not None and members.hasNext():
            yield members.next()

    def walk(self, x, known: frozenset = frozenset()):
        """(is a plan, class, node, names); names are those that a WITH around the node defines.

        A name that a WITH defines hides a table within that WITH, from its definition on; in a recursive one in its own definition too."""
        if not hasattr(x, "getClass"):  # strings, numbers and null come as Python's
            return
        if self.tree(x):
            name = x.getClass().getSimpleName()
            yield self.plan(x), name, x, known
            if name == "UnresolvedWith":
                relations = x.cteRelations()
                for i in range(relations.size()):
                    own, body = relations.apply(i)._1().lower(), relations.apply(i)._2()
                    yield from self.walk(body, known | {own} if x.allowRecursion() else known)
                    known = known | {own}
                yield from self.walk(x.child(), known)
                return
        for member in self._elements(x):
            yield from self.walk(member, known)


# What a query may be made of: plans of reading statements as the parser names them. All else is refused, commands and scripts among it.
_QUERY = frozenset(
    "Project Filter Aggregate Join AsOfJoin LateralJoin Sort GlobalLimit LocalLimit Offset Tail Distinct Union Intersect Except SetOperation SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedInlineTable "
    "UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedHint UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedOrdinal OneRowRelation OneRowRelation$ WithWindowDefinition Generate Expand Pivot UnresolvedPivot Unpivot Sample Window LocalRelation Range UnionLoop".split()
)
# Groups of built-in functions that a query may call, as Spark documents them, and what it may call of the others.
_FUNCTIONS = frozenset("agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate string struct table url variant window xml".split())
_OTHERS = frozenset({"typeof", "raise_error", "assert_true", "uuid", "monotonically_increasing_id", "coalesce", "count", "current_catalog", "current_database", "current_schema"})
#: Expressions whose meaning isn't in the statement's text.
_OPAQUE = ("ExpressionWithUnresolvedIdentifier", "NamedParameter", "PosParameter", "UnresolvedPlanId")
#: A relation of this schema is a file, not a table.
FILES = ("parquet", "orc", "csv", "json", "text", "binaryfile", "avro", "xml", "jdbc")


def _call_names(name: str, node) -> list[str]:
    """The name parts of the function that a node calls; none if it calls none."""
    if name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
        parts = node.nameParts() if name == "UnresolvedFunction" else node.name()
        return [parts.apply(i).lower() for i in range(parts.size())]
    return [node.name().funcName().lower()] if name == "UnresolvedGenerator" else []


def _permitted(spark: SparkSession, parts: list[str], more: frozenset) -> bool:
    """Whether a function is built in and of a permitted group, or one that the caller names."""
    if parts[-1] in more or len(parts) == 1 and parts[0] in _OTHERS:
        return True
    if len(parts) > 1 and parts[:-1] not in (["builtin"], ["system", "builtin"]):
        return False
    identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[-1])
    state = spark._jsparkSession.sessionState()
    for registry in (state.functionRegistry(), state.tableFunctionRegistry()):
        info = registry.lookupFunction(identifier)
        if info.isDefined():
            return info.get().getSource() == "built-in" and info.get().getGroup().removesuffix("_funcs") in _FUNCTIONS
    return False


def _read_tables(walked) -> set[str]:
    found = set()
    for _, name, node, known in walked:
        if name == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            parts = [parts.apply(i).lower() for i in range(parts.size())]
            if len(parts) > 1 or parts[0] not in known:
                found.add(tuple(parts))
    return found


def permitted_tables(spark: SparkSession, sql: str, functions=()) -> set[str] | None:
    """The tables (lower-cased) that a statement reads, or None if it isn't a permitted query.

    Permitted is what is made of the plans of _QUERY alone, reads no files by their path, and calls built-in functions of permitted groups or those
    named. The statement is parsed, not run, and every member of its tree is looked at: subqueries, WITH, window definitions, hints. Words in literals don't matter."""
    try:
        walked = list(_Parsed(spark._jvm).walk(_parsed(spark, sql.strip().rstrip(";"))))
    except Exception:
        return None
    more = frozenset(f.lower() for f in functions)
    for is_plan, name, node, _ in walked:
        if is_plan and name not in _QUERY or name in _OPAQUE:
            return None
        parts = _call_names(name, node)
        if parts and not _permitted(spark, parts, more):
            return None
    tables = _read_tables(walked)
    if any(len(r) > 1 and (r[0] in FILES or "/" in r[-1]) for r in tables):
        return None
    return {".".join(r) for r in tables}


def guard_plan(spark: SparkSession, sql: str, functions=()) -> bool:
    """Read-only by its parsed plan, see permitted_tables."""
    return permitted_tables(spark, sql, functions) is not None


def tables_of(spark: SparkSession, sql: str) -> set[str]:
    """Tables that a statement reads (lower-cased), without the names that its own WITH clauses define where these apply."""
    return {".".join(r) for r in _read_tables(_Parsed(spark._jvm).walk(_parsed(spark, sql.strip().rstrip(";"))))}


def named_tables(sql: str) -> set[str]:
    """Names after FROM and JOIN, as text has them."""
    return {m.lower() for m in re.findall(r"\b(?:from|join)\s+([a-z_]+)", sql, re.I)}


def whitelisted(spark: SparkSession, sql: str, valid: set[str]) -> bool:
    """Whether a statement is a permitted query over these tables alone."""
    tables = permitted_tables(spark, sql)
    return tables is not None and tables <= {v.lower() for v in valid}


def error_class(error: Exception | None) -> str:
    """none, parser, catalog, binder or exec_error of what Spark raised."""
    if error is None:
        return "none"
    name = (error.getCondition() if isinstance(error, PySparkException) else None) or ""
    if name.startswith("PARSE_"):
        return "parser"
    if name.startswith(("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_ROUTINE")):
        return "catalog"
    if name.startswith(("UNRESOLVED_COLUMN", "MISSING_GROUP_BY", "MISSING_AGGREGATION", "AMBIGUOUS_REFERENCE", "_LEGACY_ERROR_TEMP_1034", "UNSUPPORTED_EXPR_FOR_OPERATOR", "DATATYPE_MISMATCH", "INVALID_USAGE", "UNSUPPORTED_FEATURE")):
        return "binder"
    return "exec_error"


def error_detail(error: Exception) -> dict:
    """Kind, object and suggestions: column_not_found, table_not_found, group_by_missing, having_window or other."""
    name = (error.getCondition() if isinstance(error, PySparkException) else None) or ""
    p = (error.getMessageParameters() if isinstance(error, PySparkException) else None) or {}
    kind = next((k for n, k in (("UNRESOLVED_COLUMN", "column_not_found"), ("TABLE_OR_VIEW", "table_not_found"), ("MISSING_", "group_by_missing"), ("_LEGACY_ERROR_TEMP_1034", "having_window")) if name.startswith(n)), "other")
    return {"kind": kind, "object": (p.get("objectName") or p.get("relationName") or "").replace("`", ""), "suggestions": re.findall(r"`([^`]+)`(?=,|$)", p.get("proposal", ""))}


def retryable(message: str) -> bool:
    return any(x in (message or "").lower() for x in RETRYABLE)


def analysed(spark: SparkSession, sql: str) -> Exception | None:
    """None if the statement binds; else why not. Spark's EXPLAIN returns errors as rows, analysis raises them."""
    try:
        _ = spark.sql(sql.strip().rstrip(";")).schema
    except Exception as e:
        return e
    return None


@dataclass
class Answer:
    query_id: str
    sql: str
    status: str
    rows: list
    columns: list[str]
    seconds: float
    error: str = ""
    bytes: int = 0


def scanned_bytes(df: DataFrame) -> int:
    """Bytes that a query is estimated to read: of each table what is left of its size by the columns (and, with statistics, the filters) that the optimizer has put on it."""

    def of(node) -> int:
        below = node.children()
        chain = node
        while chain.nodeName() in ("Project", "Filter") and chain.children().size() == 1:
            chain = chain.children().head()
        if chain.children().isEmpty():
            return int(str(node.stats().sizeInBytes()))
        return sum(of(below.apply(i)) for i in range(below.size()))

    return of(df._jdf.queryExecution().optimizedPlan())


@dataclass
class Audit:
    """Appends a row (at, user, sql_hash, query_id, elapsed_ms, bytes, rows, status) for each statement to a folder of JSON files; rows wait until `every` are there or flush()."""

    spark: SparkSession
    path: str
    user: str
    every: int = 1
    kept: list = field(default_factory=list)

    KIND = "at timestamp, user string, sql_hash string, query_id string, elapsed_ms long, bytes long, rows long, status string"

    def add(self, answer: Answer) -> None:
        self.kept.append((datetime.now(timezone.utc), self.user, hashlib.sha256(answer.sql.encode()).hexdigest(), answer.query_id, round(answer.seconds * 1000), answer.bytes, len(answer.rows), answer.status))
        if len(self.kept) >= self.every:
            self.flush()

    def flush(self) -> None:
        if self.kept:
            self.spark.createDataFrame(self.kept, self.KIND).coalesce(1).write.mode("append").json(self.path)
            self.kept = []

    def table(self) -> DataFrame:
        return self.spark.read.json(self.path, schema=self.KIND)


def run(spark: SparkSession, sql: str, valid: set[str] | None = None, limit: int = 1000, timeout_s: float = 60.0, max_bytes: int | None = None, audit: Audit | None = None) -> Answer:
    """Guard, limit and run a statement; it is cancelled after timeout_s. status: ok, INVALID_SQL, TOO_LARGE, timeout or an error class.

    TOO_LARGE is a statement that is estimated to read more than max_bytes; it isn't run. With an audit every call leaves a row, refused ones too."""
    answer = _run(spark, sql, valid, limit, timeout_s, max_bytes)
    if audit:
        audit.add(answer)
    return answer


def _run(spark: SparkSession, sql: str, valid: set[str] | None, limit: int, timeout_s: float, max_bytes: int | None) -> Answer:
    began, key, size = time.time(), uuid.uuid4().hex, 0
    clean = (sql or "").strip().rstrip(";")
    if not clean or not (guard_plan(spark, clean) if valid is None else whitelisted(spark, clean, valid)):
        return Answer(key, clean, "INVALID_SQL", [], [], time.time() - began, "not a permitted read-only statement")
    late = threading.Event()
    sc = spark.sparkContext

    def stop():
        late.set()
        sc.cancelJobGroup(key)

    timer = threading.Timer(timeout_s, stop)
    try:
        sc.setJobGroup(key, clean[:200], interruptOnCancel=True)
        timer.start()
        df = spark.sql(clean)
        size = scanned_bytes(df)
        if max_bytes is not None and size > max_bytes:
            return Answer(key, clean, "TOO_LARGE", [], [], time.time() - began, f"it reads about {size} bytes, more than {max_bytes}", size)
        df = df.limit(limit)
        return Answer(key, clean, "ok", df.collect(), df.columns, time.time() - began, bytes=size)  # limit rows at most
    except Exception as e:
        return Answer(key, clean, "timeout" if late.is_set() else error_class(e), [], [], time.time() - began, str(e)[:100], size)
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def page(df: DataFrame, key: str, after=None, size: int = 100) -> DataFrame:
    """The rows after a token, by a unique key."""
    rows = df if after is None else df.where(df[key] > after)
    return rows.orderBy(key).limit(size)


#: Columns that belong to another table than the alias says: (alias, column) to (alias, table, join column of each).
MOVED = {("c", "c_gender"): ("cd", "customer_demographics", "cd_gender", "c.c_current_cdemo_sk = cd.cd_demo_sk"), ("c", "c_credit_rating"): ("cd", "customer_demographics", "cd_credit_rating", "c.c_current_cdemo_sk = cd.cd_demo_sk")}
#: Facts, their alias and the column that dates them.
DATED = {"store_sales": ("ss", "ss_sold_date_sk"), "web_sales": ("ws", "ws_sold_date_sk"), "catalog_sales": ("cs", "cs_sold_date_sk")}


def fixed(sql: str, detail: dict) -> str:
    """The statement with what its error asks for: a column's own table, or the date dimension, joined in."""
    for (alias, column), (other, table, name, on) in MOVED.items():
        if re.search(rf"\b{alias}\.{column}\b", sql):
            sql = re.sub(rf"\b{alias}\.{column}\b", f"{other}.{name}", sql)
            if not re.search(rf"\bjoin\s+{table}\b", sql, re.I):
                sql = re.sub(rf"(\bfrom\s+customer\s+(?:as\s+)?{alias}\b)", rf"\1 JOIN {table} {other} ON {on}", sql, count=1, flags=re.I)
    if detail.get("object", "").startswith("d.") and not re.search(r"\bdate_dim\b", sql, re.I):
        for fact, (alias, key) in DATED.items():
            m = re.search(rf"\bfrom\s+{fact}\b(?:\s+(?:as\s+)?(?!where\b|join\b)(\w+))?", sql, re.I)
            if m:
                return sql[: m.start()] + f"FROM {fact} {m[1] or alias} JOIN date_dim d ON {m[1] or alias}.{key} = d.d_date_sk" + sql[m.end() :]
    return sql


def repair(spark: SparkSession, sql: str, attempts: int = 3, generate_fn: Callable[[str, str], str] | None = None) -> tuple[str, Exception | None, int]:
    """Rewrite until the statement binds: fixed rewrites, then what the error asks for, then generate_fn(sql, error)."""
    sql, error = rewrite.repaired(sql)[0], None
    for n in range(attempts + 1):
        error = analysed(spark, sql)
        if error is None or n == attempts:
            return sql, error, n
        new = fixed(sql, error_detail(error))
        if new == sql and generate_fn:
            new = rewrite.repaired(rewrite.extract(generate_fn(sql, str(error)), "first"))[0]
        if new == sql:
            return sql, error, n
        sql = new
    return sql, error, attempts
