"""Removal of passages that repeat between documents, by content-defined chunks and by runs of lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, text_batches

#: Lines that the rolling hash covers; one boundary in so many lines; lines of a chunk.
WINDOW, DIVISOR, LEAST, MOST = 2, 3, 2, 16
#: A single line of so many words is a passage by itself: it is cut out before and after.
LONG_LINE = 50
#: Spans that a task sends on at once.
SPANS = 1 << 16
_MASK, _BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15
#: base ** WINDOW, to take the oldest line out of the rolling hash
_LEAVES = pow(_BASE, WINDOW, 1 << 64)


def chunks(text: bytes) -> list[tuple[int, int]]:
    """Line spans [start, end) of a text's chunks.

    A polynomial hash rolls over the hashes of the last WINDOW lines; where it is divisible by DIVISOR a chunk
    of at least LEAST lines ends, so a boundary depends on nearby lines alone and edits elsewhere don't move it.
    """
    lines = text.split(b"\n")
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    out, start, roll = [], 0, 0
    for i, h in enumerate(hashes):
        roll = (roll * _BASE + h) & _MASK
        if i >= WINDOW:
            roll = (roll - hashes[i - WINDOW] * _LEAVES) & _MASK
        if len(lines[i]) >= 2 * LONG_LINE - 1 and len(lines[i].split()) >= LONG_LINE:
            if start < i:
                out.append((start, i))
            out.append((i, i + 1))
            start = i + 1
        elif i + 1 - start >= LEAST and ((roll >> 32) % DIVISOR == 0 or i + 1 - start >= MOST):
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def _parts(text: bytes) -> list[tuple[int, bytes, bool]]:
    """(lines, bytes, may be removed) of each chunk; only several lines or one long line may go, blank ones never."""
    lines = text.split(b"\n")
    found = []
    for a, b in chunks(text):
        part = b"\n".join(lines[a:b])
        found.append((b - a, part, (b - a > 1 or len(part.split()) >= LONG_LINE) and not part.isspace() and part != b""))
    return found


def _shortest(words: list[int]):
    """From each line that has words, the span [start, end) of the shortest run of lines with LONG_LINE words or more."""
    a = total = 0
    for b, n in enumerate(words):
        total += n
        while total >= LONG_LINE:
            if words[a]:
                yield a, b + 1
            total, a = total - words[a], a + 1


def _runs(lines: list[bytes]) -> set[tuple[int, int]]:
    """Spans of the shortest runs of LONG_LINE words or more that start at each line or end at each line.

    They cover any longer stretch of lines from its first line with a word to its last: those by start leave at most a rest
    of fewer words, which is in the run that ends at the last line.
    """
    words = [len(x.split()) for x in lines]
    return {*_shortest(words), *((len(words) - b, len(words) - a) for a, b in _shortest(words[::-1]))}


def _spans(text: bytes, runs: bool) -> Iterator[tuple[int, int, memoryview]]:
    """(start, end, bytes) of the spans of lines that go where they repeat: chunks that may be removed and, if asked for, runs; bytes are views of the text, for spans overlap."""
    lines = text.split(b"\n")
    at, i = [0], 0
    for x in lines:
        i += len(x) + 1
        at.append(i)
    spans, i = _runs(lines) if runs else set(), 0
    for n, _, may in _parts(text):
        if may:
            spans.add((i, i + n))
        i += n
    whole = memoryview(text)
    for a, b in sorted(spans):
        yield a, b, whole[at[a] : at[b] - 1]


def _span_rows(runs):
    """(id, th, text) to one row of (id, th, a, b, h) for each span that goes where it repeats; h: 128 bits of hash."""

    def rows(found) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=["id", "th", "a", "b", "h"])

    def run(batches):
        for batch in batches:
            found = []
            for key, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                for x, y, part in _spans(text or b"", runs):
                    found.append((key, th, x, y, xxhash.xxh3_128_digest(part)))
                    if len(found) == SPANS:
                        yield rows(found)
                        found = []
            yield rows(found)

    return run


def _span_texts(batches):
    """(text, places) to (h, part) of the spans at these places; part is packed, for runs of a text overlap."""
    for batch in batches:
        h, parts = [], []
        for text, at in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
            lines = (text or b"").split(b"\n")
            for x in at:
                part = b"\n".join(lines[x["a"] : x["b"]])
                h.append(xxhash.xxh3_128_digest(part)), parts.append(zlib.compress(part, 1))
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(parts, pa.binary())], names=["h", "part"])


def _kept_texts(batches):
    """The last two columns are the text and the spans to remove; they become the new text and what was done."""
    for batch in batches:
        k = batch.num_columns - 2
        out, n, total, gone_c, gone_l = [], [], [], [], []
        for text, at in zip(batch.column(k).cast(pa.binary()).to_pylist(), batch.column(k + 1).to_pylist()):
            lines, found = (text or b"").split(b"\n"), chunks(text or b"")
            gone = {i for x in at or () for i in range(x["a"], min(x["b"], len(lines)))}
            out.append(None if text is None else b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            n.append(len(found) if text is not None else 0), total.append(len(lines) if text is not None else 0)
            gone_c.append(sum(gone.issuperset(range(a, b)) for a, b in found) if gone else 0), gone_l.append(len(gone))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:k], pa.array(out, pa.binary()).cast(pa.string()), *(pa.array(x, pa.int64()) for x in (n, total, gone_c, gone_l))],
            names=[*batch.schema.names[:k], "text", "n_chunks", "n_lines", "removed_chunks", "removed_lines"],
        )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): rows are told apart by their id and the hash of their text."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """(id, th, a, b) of every span of lines to remove: a repeat of a span that stands first at a smaller (id, th, a); th: the text's hash.

    Spans are chunks and, with runs, the shortest runs of LONG_LINE words from and to each line. In the text where a
    span stands first, a repeat that overlaps it stays. Hashes are counted over all documents with partial aggregates. Of a
    hash that occurs again, the bytes of all its occurrences are compared (by their least and greatest); were two
    texts to share a hash, none of them would be removed. Texts without an id come after all others.
    """
    text_batches(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    # Not staged: the spans are found again for the join, for with runs they are many.
    found = rows.mapInArrow(_span_rows(runs), "id long, th long, a int, b int, h binary").withColumn("last", F.col("id").isNull())
    first = F.min(F.struct("last", "id", "th", "a"))
    again = found.groupBy("h").agg(F.count("*").alias("c"), first.alias("keep")).where("c > 1").select("h", "keep")
    goes = F.expr("NOT (id <=> keep.id) OR th <> keep.th OR a >= keep.a + b - a")
    spots = cut(found.join(again, "h").select("id", "th", "a", "b", "h", goes.alias("goes")))
    # By id and text: the copies of a text are dealt over all tasks.
    at = spots.groupBy(F.col("id").alias("at_id"), F.col("th").alias("at_th")).agg(F.collect_set(F.struct("a", "b")).alias("at"))
    texts = rows.join(at.hint("shuffle_hash"), F.expr("th = at_th AND id <=> at_id")).select("text", "at").mapInArrow(_span_texts, "h binary, part binary")
    same = texts.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo = hi").select("h")
    return spots.where("goes").join(same, "h").select("id", "th", "a", "b").distinct()


def _gone(docs: DataFrame, id_col: str, text_col: str, runs: bool) -> DataFrame:
    """(id, th, at): the spans to remove from each text; a list holds at most the spans of one."""
    return cut(repeated_spans(docs, id_col, text_col, runs).groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("at")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """(id, text, n_chunks, n_lines, removed_chunks, removed_lines), a row for each row of docs, in its rest of the text.

    Chunks of several lines, or of one line of 50 words or more, that occur at more than one place of the whole
    table stay at the first place (by id, then the hash of the text, then position) and go elsewhere. With runs, so does
    every stretch of lines of 50 words or more, wherever chunks end; blank lines around it stay. removed_chunks counts chunks
    that went whole. Null texts stay null with zero counts. Rows that share an id but not the text are places of their own;
    rows that share both, or a text and no id, are one place and are treated alike; rows without an id come last. A
    document that loses everything keeps an empty text. An empty table gives no rows. Extra columns of docs are ignored.
    """
    gone = _gone(docs, id_col, text_col, runs).toDF("gone_id", "gone_th", "at")
    joined = _keyed(docs, id_col, text_col).join(gone.hint("shuffle_hash"), F.expr("th = gone_th AND id <=> gone_id"), "left").select("id", "text", "at")
    out = joined.mapInArrow(_kept_texts, "id long, text string, n_chunks long, n_lines long, removed_chunks long, removed_lines long")
    return out.withColumnRenamed("id", id_col)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), runs=True)
    return kept.select(
        "doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def line_dedup(docs: DataFrame, runs: bool = False) -> DataFrame:
    """docs with repeated passages removed from text, and n_chars (if there is one) that fits where something went; no row goes.

    The columns stay as they are, whatever the others are called; null texts stay null, and rows are told apart as in
    without_repeats. An empty table stays empty.
    """
    gone = _gone(docs, "doc_id", "text", runs).toDF("gone_id", "gone_th", "gone_at")
    # Columns go by their places meanwhile, so that no name clashes.
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    joined = rows.join(gone.hint("shuffle_hash"), (F.xxhash64(F.col(names["text"]).cast("string")) == F.col("gone_th")) & F.col(names["doc_id"]).cast("long").eqNullSafe(F.col("gone_id")), "left")
    others = [c for c in rows.columns if c != names["text"]]
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in others)
    out = joined.select(*others, F.col(names["text"]).cast("string").alias("text"), "gone_at").mapInArrow(
        _kept_texts, f"{kinds}, text string, n_chunks long, n_lines long, removed_chunks long, removed_lines long"
    )
    if "n_chars" in names:
        size = names["n_chars"]
        out = out.withColumn(size, F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col(size)).cast(dict(rows.dtypes)[size]))
    return out.select(*(F.col("text" if c == "text" else n).alias(c) for c, n in names.items()))
