"""Result pages by key over a pinned result, named by signed tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


class ForgedToken(ValueError):
    """A token that wasn't given out, or was for another key order."""


def _signed(secret: bytes, state: dict) -> str:
    body = base64.urlsafe_b64encode(json.dumps(state, separators=(",", ":")).encode())
    return (body + b"." + base64.urlsafe_b64encode(hmac.digest(secret, body, hashlib.sha256))).decode()


def _opened(secret: bytes, token: str) -> dict:
    body, _, mark = token.encode().partition(b".")
    if not hmac.compare_digest(mark, base64.urlsafe_b64encode(hmac.digest(secret, body, hashlib.sha256))):
        raise ForgedToken("the token's signature doesn't fit")
    return json.loads(base64.urlsafe_b64decode(body))


def pin(df: DataFrame) -> str:
    """Write a result once, so that all its pages are of the same rows; returns its name."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{shared_dir(df.sparkSession)}/pinned-{name}")
    return name


def after(df: DataFrame, keys: list[tuple[str, bool]], last: list[str | None]) -> Column:
    """Whether a row comes after these key values (as strings) in the order of keys (column, descending): nulls are least, as Spark's plain sort has them."""
    types, found, same = dict(df.dtypes), F.lit(False), F.lit(True)
    for (name, descending), text in zip(keys, last):
        column, value = F.col(f"`{name}`"), F.lit(text).cast(types[name])
        if text is None:
            beyond = F.lit(False) if descending else column.isNotNull()
        else:
            beyond = (column < value) | column.isNull() if descending else column > value
        found = found | (same & F.coalesce(beyond, F.lit(False)))
        same = same & column.eqNullSafe(value)
    return found


def result_page(spark: SparkSession, name: str, keys: list[tuple[str, bool]], secret: bytes, token: str | None = None, size: int = 100) -> tuple[DataFrame, str | None]:
    """(rows, token of the next page) of a pinned result, in the order of keys (column, descending), which together are unique; the last page's token is None.

    A page is what comes after the token's key values, so it is found by a filter and a top-n and no page is counted through. A token names the result, the
    order and the last row; it is signed, so one that is changed or meant for another order is refused."""
    order = [[c, bool(d)] for c, d in keys]
    df = spark.read.parquet(f"{shared_dir(spark)}/pinned-{name}")
    if token is not None:
        state = _opened(secret, token)
        if state["result"] != name or state["order"] != order:
            raise ForgedToken("the token is of another result or order")
        df = df.where(after(df, keys, state["last"]))
    ordered = [F.col(f"`{c}`").desc_nulls_last() if d else F.col(f"`{c}`").asc_nulls_first() for c, d in keys]
    page = df.orderBy(*ordered).limit(size)
    rows = page.select(*(F.col(f"`{c}`").cast("string") for c, _ in keys)).collect()  # size rows at most
    following = _signed(secret, {"result": name, "order": order, "last": list(rows[-1])}) if len(rows) == size else None
    return page, following
