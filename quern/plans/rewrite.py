"""SQL text from model output: extraction, repair of common slips, dialect rewrites. Pure functions of strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column names that models get wrong, and what they mean in the warehouse.
RENAMES = {"d_quarter": "d_qoy", "d_weekday": "d_day_name", "d_wday": "d_day_name", "ca_email_address": "c_email_address", "ca_birth_country": "c_birth_country", "cd_preferred_cust_flag": "c_preferred_cust_flag", "cd_salutation": "c_salutation"}
#: A rename that changes what a query means, for the column exists: only on request.
HARMFUL = {"sr_net_loss": "sr_return_amt"}

_FENCE = re.compile(r"```(?:sql)?\s*(.*?)```", re.S | re.I)
_START = re.compile(r"\b(?:select|with)\b", re.I)


def extract(text: str | None, variant: str = "fenced") -> str:
    """The statement in a model's answer.

    fenced: a fenced block or all, cut at the first `;`. labelled: so, without a leading `sql:`. first: from the
    first SELECT or WITH on, its `;` kept. select: from the first SELECT to `;`, which loses a leading WITH."""
    m = _FENCE.search(text or "")
    body = (m[1] if m else text or "").strip()
    if variant == "first":
        at = _START.search(body)
        body = body[at.start() :] if at else body
        return body[: body.index(";") + 1] if ";" in body else body
    if variant == "select":
        at = re.search(r"\bselect\b", body, re.I)
        body = body[at.start() :] if at else ""
    elif variant == "labelled":
        body = re.sub(r"^sql\s*:\s*", "", body, flags=re.I)
    return body.split(";")[0].strip()


def strip_lines(sql: str) -> str:
    """Without blank lines and lines that are comments."""
    return "\n".join(x for x in sql.splitlines() if x.strip() and not x.strip().startswith(("--", "#")))


def single_prefixes(sql: str) -> str:
    """sr_sr_x to sr_x, for prefixes of one to three letters."""
    return re.sub(r"\b([a-z]{1,3})_\1_(\w+)", r"\1_\2", sql)


def top_to_limit(sql: str) -> str:
    """SELECT TOP n to a LIMIT at the end, unless there is one."""
    m = re.search(r"\bselect\s+(distinct\s+)?top\s*\(?\s*(\d+)\s*\)?\s+", sql, re.I)
    if not m:
        return sql
    body = sql[: m.start()] + "SELECT " + (m[1] or "") + sql[m.end() :]
    return body if re.search(r"\blimit\b", body, re.I) else f"{body.rstrip().rstrip(';').rstrip()} LIMIT {m[2]}"


def year_to_extract(sql: str) -> str:
    return re.sub(r"\bYEAR\s*\(([^)]+)\)", r"EXTRACT(YEAR FROM \1)", sql, flags=re.I)


def rename_columns(sql: str, renames: dict[str, str] = RENAMES, harmful: bool = False) -> str:
    for old, new in {**renames, **(HARMFUL if harmful else {})}.items():
        sql = re.sub(rf"\b{old}\b", new, sql)
    return re.sub(r"\binv_quantity(?!_on_hand)\b", "inv_quantity_on_hand", sql)


def terminated(sql: str) -> str:
    sql = sql.rstrip()
    return sql if sql.endswith(";") else sql + ";"


def limited(sql: str, n: int) -> str:
    """With LIMIT n, unless the text has a LIMIT anywhere."""
    return sql if re.search(r"\blimit\b", sql, re.I) else f"{sql.rstrip().rstrip(';').rstrip()} LIMIT {n}"


def star_expanded(sql: str, columns: dict[str, list[str]]) -> str:
    """Each SELECT * with the columns listed for the first table; unlisted tables stay."""
    m = re.search(r"\bfrom\s+([a-z_]\w*)(?:\s+(?:as\s+)?(?!where\b|join\b|inner\b|left\b|right\b|full\b|cross\b|on\b|order\b|group\b|limit\b)([a-z_]\w*))?", sql, re.I)
    if not m or m[1].lower() not in columns:
        return sql
    prefix = f"{m[2]}." if m[2] else ""
    return re.sub(r"\bselect\s+\*", "SELECT " + ", ".join(prefix + c for c in columns[m[1].lower()]), sql, flags=re.I)


def canonical(sql: str) -> str:
    """For comparison of texts: lower-cased outside of literals, blanks collapsed, no final `;`."""
    parts = re.split(r"('(?:[^']|'')*')", sql.strip().rstrip(";"))
    return "".join(p if i % 2 else re.sub(r"\s*([,()=<>+*/-])\s*", r"\1", re.sub(r"\s+", " ", p)).lower() for i, p in enumerate(parts)).strip()


def repaired(sql: str) -> tuple[str, list[str]]:
    """The statement after all rewrites, and which of them changed it."""
    done = []
    for name, f in (("lines", strip_lines), ("prefix", single_prefixes), ("columns", rename_columns), ("top", top_to_limit)):
        new = f(sql)
        if new != sql:
            done.append(name)
        sql = new
    return terminated(sql), done


def training_filter(statements: DataFrame, valid: list[str], most: int) -> DataFrame:
    """(sql, valid, short): whether a statement names known tables alone (after FROM and JOIN, as text has them), and has at most so many tokens."""
    names = F.regexp_extract_all(F.lower("sql"), F.lit(r"\b(?:from|join)\s+([a-z_]+)"), F.lit(1))
    known = F.array(*(F.lit(v.lower()) for v in valid))
    return statements.select("sql", F.forall(names, lambda n: F.array_contains(known, n)).alias("valid"), (F.size(F.split("sql", " ")) <= most).alias("short"))


def without_unneeded_join(left: DataFrame, right: DataFrame, on: Column, wanted: list[str], unique: list[str], where: Column | None = None) -> DataFrame:
    """The wanted columns of left LEFT JOIN right: without the join, if right's key is unique and nothing wanted is right's.

    unique: right's columns that the condition compares; that they are a key is looked up in right, by counts that are partial aggregates."""
    rows = left if where is None else left.where(where)
    if unique and all(c in left.columns for c in wanted) and right.na.drop(subset=unique).groupBy(*unique).count().where("count > 1").isEmpty():
        return rows.select(*wanted)
    return rows.join(right, on, "left").select(*wanted)
