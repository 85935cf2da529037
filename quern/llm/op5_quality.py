"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, small_side, text_batches
from .shingles import WordHashes, splitmix, stream

#: Hashed features; the counts and the weights have so many entries, whatever the corpus.
DIMENSIONS = 1 << 18
#: Labelled rows that the hinge-loss fit sees, of them the share kept for calibration; log-count ratios use all labelled rows.
SAMPLE, CALIBRATE = 4000, 0.3
#: At or above this score a document counts as good.
ACCEPT = 0.3
LABELS_AT_ONCE = 1_000_000

_RUN = re.compile(rb"(.)\1*", re.S)
_CLASSES = bytes(
    ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c for c in range(256)
)


class Shapes(dict):
    """Hashes of word shapes: letters, capitals and digits as classes, other characters as they are, runs cut to two."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        shape = _RUN.sub(lambda m: m[0][:2] if m[1] not in b"xX9" else m[1], word.translate(_CLASSES))
        h = self[word] = xxhash.xxh3_64_intdigest(shape)
        return h


class Featurizer:
    """The sorted distinct feature numbers of a text: word 1- and 2-grams, and 1- to 3-grams of shapes and repetition."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.words, self.shapes = dimensions, WordHashes(), Shapes()
        self.f = stream(21, 3) | np.uint64(1)
        self.kinds = stream(22, 8)

    def __call__(self, text: bytes | None) -> np.ndarray:
        found = text.split() if text else []
        n = len(found)
        if not n:
            return np.empty(0, np.int32)
        w = np.fromiter(map(self.words.__getitem__, text.lower().split()), np.uint64, n)
        s = np.fromiter(map(self.shapes.__getitem__, found), np.uint64, n)
        same = np.zeros(n, np.uint64)
        same[1:] = w[1:] == w[:-1]
        s = splitmix(s + same)
        f, k = self.f, self.kinds
        grams = [w * f[0] + k[0], s * f[0] + k[1]]
        if n > 1:
            grams += [w[:-1] * f[0] + w[1:] * f[1] + k[2], s[:-1] * f[0] + s[1:] * f[1] + k[3]]
        if n > 2:
            grams.append(s[:-2] * f[0] + s[1:-1] * f[1] + s[2:] * f[2] + k[4])
        # The shape grams of a text are few, its words many.
        return np.unique((splitmix(np.concatenate(grams)) % np.uint64(self.dimensions)).astype(np.int32))


@dataclass
class Model:
    """P(good) = 1 / (1 + exp(-(slope * margin + shift))); margin = weights . indicators / norm."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        if not len(features):
            return self.bias
        return float(self.weights[features].sum() / np.sqrt(max(self.squares[features].sum(), 1e-12)) + self.bias)

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features) + self.shift, -50, 50))))


def _count_rows(dimensions: int):
    """(quality, text) to one row of (feature, good, bad) for each feature that a partition has."""

    def run(batches):
        features, seen = Featurizer(dimensions), np.zeros((2, dimensions), np.int64)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                seen[y][features(text)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[1][at]), pa.array(seen[0][at])], names=["feature", "good", "bad"])

    return run


def _feature_rows(dimensions: int):
    def run(batches):
        features = Featurizer(dimensions)
        for batch in batches:
            sets = [features(t).tobytes() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["id", "quality", "features"])

    return run


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dimensions: int, c: float = 1.0, epochs: int = 15, least: float = 1e-3) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + c * sum of hinge losses, by coordinate descent in the dual; the bias is a feature of value 1. Ends when no step of a round reaches `least`."""
    w, bias, alpha, rng = np.zeros(dimensions), 0.0, np.zeros(len(y)), np.random.default_rng(5)
    norm = np.array([float(v @ v) + 1 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < least:
            break
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton's method with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        q = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - t) * margins).sum() + 1e-6 * a, (p - t).sum()
        haa, hab, hbb = (q * margins * margins).sum() + 1e-6, (q * margins).sum(), q.sum() + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, quality, text) of the documents that the fit may see: labelled, and not of the held-out fifth."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    sure = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("hi")).where("quality = hi").select(F.col("doc_id").alias("id"), F.col("quality").cast("int"))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.join(small_side(sure, LABELS_AT_ONCE), "id").select("id", "quality", "text")


def fit(docs: DataFrame, labels: DataFrame, dimensions: int = DIMENSIONS, sample: int = SAMPLE) -> Model:
    """Fit on labels.quality. Log-count ratios come from all labelled rows outside the held-out fifth; the
    hinge-loss fit and its calibration from the `sample` of them with the least hashed ids."""
    text_batches(docs.sparkSession)
    train = training_rows(docs, labels)
    counts = train.select("quality", "text").mapInArrow(_count_rows(dimensions), "feature int, good long, bad long")
    # At most `dimensions` rows, whatever the corpus.
    table = counts.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    at = table.column("feature").to_numpy()
    good, bad = np.ones(dimensions), np.ones(dimensions)
    good[at] += table.column("good").to_numpy()
    bad[at] += table.column("bad").to_numpy()
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    picked = cut(train.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample))
    found = train.join(F.broadcast(picked), "id").mapInArrow(_feature_rows(dimensions), "id long, quality int, features binary").toArrow().to_pylist()
    found.sort(key=lambda x: (xxhash.xxh64_intdigest(str(x["id"])), x["features"]))
    rows = [np.frombuffer(x["features"], np.int32) for x in found]
    y = np.array([2 * x["quality"] - 1 for x in found], float)
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the prior alone
        share = (1 + (y > 0).sum()) / (2 + len(y))
        return Model(np.zeros(dimensions), np.ones(dimensions), 0.0, 1.0, float(np.log(share / (1 - share))))
    squares = ratio * ratio
    values = [ratio[r] / np.sqrt(max(squares[r].sum(), 1e-12)) for r in rows]
    own = max(1, int(len(rows) * (1 - CALIBRATE)))
    if len(set(y[own:].tolist())) < 2 or len(set(y[:own].tolist())) < 2:
        own = len(rows)
    w, bias = dual_descent(rows[:own], values[:own], y[:own], dimensions)
    model = Model(w * ratio, squares, bias, 1.0, 0.0)
    held = range(own, len(rows)) if own < len(rows) else range(len(rows))
    model.slope, model.shift = platt(np.array([model.margin(rows[i]) for i in held]), y[list(held)])
    return model


def _score_rows(shared, dimensions: int):
    def run(batches):
        features, model = Featurizer(dimensions), shared.value
        for batch in batches:
            scores = [model.score(features(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, dimensions: int = DIMENSIONS, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs, from the whole text alone.

    score is the calibrated probability of label 1; null and empty texts get the score of a text without
    features. held_out: crc32 of the id as text is divisible by five (false for a null id); labels of such
    documents are never seen. Labels that are null, neither 0 nor 1, or contradict each other are not used;
    without labels of both classes every score is the (smoothed) share of good labels. Repeated rows get equal
    scores; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, dimensions, sample))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score_rows(shared, dimensions), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def _accept_rows(shared, dimensions: int, text_at: int):
    def run(batches):
        features, model = Featurizer(dimensions), shared.value
        for batch in batches:
            keep = [model.score(features(t)) >= ACCEPT for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects; it learns from the labelled rows of docs. Columns go by their places, so a name may hold a dot."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels))
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(_accept_rows(shared, DIMENSIONS, docs.columns.index("text")), plain.schema).toDF(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))
