"""Joins of strings within an edit distance: deletion neighbourhoods as keys for words, segments for long strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from .registry import query

#: Characters of a left string that is joined by deletions; a longer one would have too many.
LONG = 24


def _shorter(words: Column) -> Column:
    """The strings of an array and all that one deletion makes of them."""

    def each(w: Column) -> Column:
        n = F.length(w)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))

    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, each))))


def deletions(word: Column, most: int) -> Column:
    """All strings that up to `most` deletions make of a word. Two words within edit distance d share one of d deletions each."""
    out = F.array(word)
    for _ in range(most):
        out = _shorter(out)
    return out


def _segments(word: str, most: int) -> Column:
    """Keys (length, place, text) of the most + 1 segments of a string: of as many edits one at least stays whole."""
    step = f"length({word}) * i div {most + 1}"
    end = f"length({word}) * (i + 1) div {most + 1}"
    return F.expr(f"transform(sequence(0, {most}), i -> concat_ws('|', length({word}), i, substring({word}, cast({step} AS int) + 1, cast({end} - {step} AS int))))")


def _windows(word: str, most: int) -> Column:
    """The keys of _segments that a string within distance `most` of the other can have: its parts there, shifted by so many at most."""
    start, end = f"l * i div {most + 1}", f"l * (i + 1) div {most + 1}"
    part = f"substring({word}, cast({start} AS int) + s + 1, cast({end} - {start} AS int))"
    keys = f"transform(filter(sequence(-{most}, {most}), s -> {start} + s >= 0), s -> concat_ws('|', l, i, {part}))"
    return F.expr(f"array_distinct(flatten(flatten(transform(sequence(greatest(0, length({word}) - {most}), length({word}) + {most}), l -> transform(sequence(0, {most}), i -> {keys})))))")


def similar_strings(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """(a, b, distance) of the distinct strings of left (a) and right (b) within so many insertions, deletions and substitutions.

    Left strings of up to LONG characters meet right ones at the strings that deletions make of both, longer ones where a
    segment is whole; lengths are compared before the distance is, and both stay in the JVM. What meets doesn't grow with all pairs but
    with strings that are alike. Nulls are like nothing; the empty string is like those of `most` characters."""
    a, b = left.where("a IS NOT NULL").select("a").distinct(), right.where("b IS NOT NULL").select("b").distinct()
    short = a.where(F.length("a") <= LONG).select("a", F.explode(deletions(F.col("a"), most)).alias("key"))
    far = a.where(F.length("a") > LONG).select("a", F.explode(_segments("a", most)).alias("key"))
    of_short = b.where(F.length("b") <= LONG + most).select("b", F.explode(deletions(F.col("b"), most)).alias("key"))
    of_far = b.where(F.length("b") > LONG - most).select("b", F.explode(_windows("b", most)).alias("key"))
    near = F.abs(F.length("a") - F.length("b")) <= most
    met = short.join(of_short, "key").where(near).select("a", "b").unionByName(far.join(of_far, "key").where(near).select("a", "b")).distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")


_WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')"


@query(f"""WITH a AS (SELECT DISTINCT unnest({_WORDS_SQL}) AS a FROM benchmark), b AS (SELECT DISTINCT unnest({_WORDS_SQL}) AS b FROM documents)
SELECT a, min(CASE WHEN a = b THEN 0 ELSE 1 END)::BIGINT AS distance, count(*) AS similar FROM (SELECT a, b FROM a JOIN b ON abs(length(a) - length(b)) <= 1 AND (left(a, length(a) // 2) = left(b, length(a) // 2)
OR right(a, length(a) - length(a) // 2) = right(b, length(a) - length(a) // 2))) WHERE a = b OR list_bool_or([left(a, i) = left(b, i) AND (length(a) = length(b) AND substr(a, i + 2) = substr(b, i + 2)
OR length(a) < length(b) AND substr(a, i + 1) = substr(b, i + 2) OR length(a) > length(b) AND substr(a, i + 2) = substr(b, i + 1)) for i in range(0, length(a) + 1)]) GROUP BY a""")
def similar_tokens(t) -> DataFrame:
    """Distinct words of the benchmark with the number of distinct words of documents within one edit."""
    words = lambda df, name: df.select(F.explode(F.array_distinct(word_tokens(F.col("text")))).alias(name))
    found = similar_strings(words(t.benchmark, "a"), words(t.documents, "b"), 1)
    return found.groupBy("a").agg(F.min("distance").cast("long").alias("distance"), F.count("*").alias("similar"))
