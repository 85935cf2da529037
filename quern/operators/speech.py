"""Word errors of transcripts by kind: substitutions, insertions and deletions of a least alignment, confusions, rates of a model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sound import sounds, wav
from .registry import query

#: Words of a hypothesis whose columns are kept at once; for a longer one, columns are made again a block at a time.
BLOCK = 4096
#: Rows of an Arrow batch whose texts a task holds as Python strings at once.
SLICE = 512


def _columns(masks: list[int], words: list[int], up: int, down: int, full: int, kept: list | None = None) -> tuple[int, int]:
    """The edit table's columns of some words, from the column before them: bits over the reference's words, where costs rise from the word before and where they fall.

    kept gets for each column where costs rise, and where a cell costs what its diagonal neighbour does."""
    for w in words:
        same = masks[w]
        level = ((((same & up) + up) ^ up) | same | down) & full
        rises = (down | full ^ (level | up)) << 1 | 1
        up, down = ((up & level) << 1 | full & ~(level | rises)) & full, rises & level
        if kept is not None:
            kept.append((up, level))
    return up, down


def aligned(ref: list[str], hyp: list[str]) -> tuple[int, int, int, list[tuple[str, str]]]:
    """(substitutions, insertions, deletions, [(word, heard)]) of a least alignment; of equals it keeps a pair before it drops, and drops before it adds, seen from the end.

    The edit table goes by columns of whole numbers, a bit for each word of the reference, so a word of the hypothesis takes a few operations on them."""
    index: dict[str, int] = {}
    a, b = ([index.setdefault(w, len(index)) for w in x] for x in (ref, hyp))
    i, j, subs, adds, drops, heard = len(a), len(b), 0, 0, 0, []
    full, own, masks = (1 << i) - 1, [[] for _ in index], [0] * len(index)
    for at, w in enumerate(a):
        own[w].append(at)
    for w, ats in enumerate(own):
        if len(ats) < 2:  # most words: no buffer for a single bit
            masks[w] = 1 << ats[0] if ats else 0
            continue
        bits = bytearray(ats[-1] // 8 + 1)
        for at in ats:
            bits[at >> 3] |= 1 << (at & 7)
        masks[w] = int.from_bytes(bits, "little")
    up, down, starts = full, 0, []
    for at in range(0, j, BLOCK):
        starts.append((up, down))
        if at + BLOCK < j:
            up, down = _columns(masks, b[at : at + BLOCK], up, down, full)
    while j and i:
        first = (j - 1) // BLOCK * BLOCK
        (up, down), columns = starts[first // BLOCK], []
        _columns(masks, b[first:j], up, down, full, columns)
        while i and j > first:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                continue
            up, level = columns[j - 1 - first]
            if not level >> (i - 1) & 1:
                i, j, subs = i - 1, j - 1, subs + 1
                heard.append((ref[i], hyp[j]))
            elif up >> (i - 1) & 1:
                i, drops = i - 1, drops + 1
            else:
                j, adds = j - 1, adds + 1
    return subs, adds + j, drops + i, heard[::-1]


def _error_rows(batches):
    for batch in (b.slice(at, SLICE) for b in batches for at in range(0, max(1, b.num_rows), SLICE)):
        found = []
        for ref, hyp in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (ref or "").split()
            found.append((len(words), *aligned(words, (hyp or "").split())))
        cols = list(zip(*found)) or [()] * 5
        pairs = pa.array([[{"word": w, "heard": h} for w, h in x] for x in cols[4]], pa.list_(pa.struct([("word", pa.string()), ("heard", pa.string())])))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pairs], names=["id", "words", "substitutions", "insertions", "deletions", "confusions"])


def word_errors(pairs: DataFrame) -> DataFrame:
    """(id, words, substitutions, insertions, deletions, confusions) of (id, reference, hypothesis), a row for each row; words are parted by white space.

    A null text has no words. Repeated rows are rated each; an empty table gives no rows; other columns are ignored. A task holds two bits for each word of the
    reference and of a BLOCK of the hypothesis."""
    kind = dict(pairs.dtypes)["id"]
    return pairs.select("id", "reference", "hypothesis").mapInArrow(_error_rows, f"id {kind}, words long, substitutions long, insertions long, deletions long, confusions array<struct<word: string, heard: string>>")


def error_rates(errors: DataFrame, *by: str) -> DataFrame:
    """(by.., n, micro_wer, macro_wer, substitutions, insertions, deletions): micro is all edits over all words, macro the mean of the texts' own rates (1 where a text has no words)."""
    edits = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    own = F.when(F.col("words") == 0, F.lit(1.0)).otherwise(edits / F.col("words"))
    sums = errors.groupBy(*by).agg(F.count("*").alias("n"), F.sum(edits).alias("_e"), F.sum("words").alias("_w"), F.avg(own).alias("macro_wer"), *(F.sum(c).alias(c) for c in ("substitutions", "insertions", "deletions")))
    return sums.withColumn("micro_wer", F.when(F.col("_w") > 0, F.col("_e") / F.col("_w"))).drop("_e", "_w")


def confusions(errors: DataFrame) -> DataFrame:
    """(word, heard, n): how often a word was taken for another."""
    return errors.select(F.explode("confusions").alias("c")).groupBy("c.word", "c.heard").agg(F.count("*").alias("n"))


def _altered(text):
    """Every 41st word left out, every 29th replaced and every 53rd said twice: what a careless ear makes of a text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    heard = F.transform(words, lambda w, i: F.when(i % 41 == 40, F.array().cast("array<string>")).when(i % 29 == 28, F.array(F.lit("#"))).when(i % 53 == 52, F.array(w, w)).otherwise(F.array(w)))
    return F.array_join(F.flatten(heard), " ")


def _heard(t) -> DataFrame:
    return word_errors(t.documents.select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("reference"), _altered(F.col("text")).alias("hypothesis")))


@query()
def word_error_kinds(t) -> DataFrame:
    """Errors of every text against an altered form of itself."""
    return _heard(t).select("id", "words", "substitutions", "insertions", "deletions", F.size("confusions").cast("long").alias("confused"))


def _wav_rows(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else wav(np.array(x)) for x in batch.column(1).to_pylist()], pa.binary())], names=["id", "content"])


@query("""SELECT vec_id, 16000 AS rate, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: power(round(CAST(x AS DOUBLE) * 32767) / 32768, 2))), 4) AS energy FROM embeddings""")
def sound_energy(t) -> DataFrame:
    """Each vector as sound: written as WAV bytes, read back as samples, with their energy."""
    files = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")).mapInArrow(_wav_rows, "id long, content binary")
    energy = F.aggregate("samples", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return sounds(files).select(F.col("id").alias("vec_id"), "rate", F.size("samples").cast("long").alias("n"), F.round(energy, 4).alias("energy"))
