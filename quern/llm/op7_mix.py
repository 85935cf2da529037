"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import ntiles
from .common import WORD, cut, read

#: Sources weigh these, repeating, in order of their names.
WEIGHTS = (1.0, 2.0, 3.0)
#: No source and no document is taken more often than this.
MOST = 3
#: Documents whose fractions one task pairs at a time; residuals that meet at a node of the tree.
LEAF, FAN_IN = 1024, 256
SEED = 20


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size): shares of the total by weight, none above most times its size.

    A target is min(most * size, level * weight) at the level where targets add up to the total. The level is raised
    by what the sources below it can't take until no more of them are full: each round is an aggregate, and the place of a
    source in the order of names comes from ranges, so sources may be many.
    """
    placed = ntiles(sources.select("source", "source_size"), max(1, sources.count()), "source", [("source", False)])
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("tile") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = cut(placed.select("source", "source_size", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    total, level, full, held = s.agg(F.sum("source_size")).first()[0] or 0, 0.0, F.lit(False), -1
    while True:
        taken, open_, n = s.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w"))), F.count_if(full)).first()
        if n == held or not open_:
            break
        level, held = (total - (taken or 0.0)) / open_, n
        full = F.col("cap") < F.lit(level) * F.col("w")
    return s.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def _uniform(ids: np.ndarray, level: int) -> np.ndarray:
    """A number in [0, 1) for each id and tree level, the same in every run."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((SEED + 1000 * level) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivotal(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions p in [0, 1] to 0 or 1 in pairs; the expected words (sum of p * size) stay as they are.

    Of a pair, words move from one document to the other until one fraction is 0 or 1; the direction is drawn
    so that each fraction keeps its mean. Returns the fractions and the index of the one left open, or -1.
    """
    p, eps, held = p.copy(), 1e-12, -1
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        j, (a, b) = held, (float(size[held]), float(size[i]))
        up = min((1 - p[j]) * a, p[i] * b)  # words that may move from i to j
        down = min(p[j] * a, (1 - p[i]) * b)  # and from j to i
        move = up if u[i] * (up + down) < down else -down
        p[j] += move / a
        p[i] -= move / b
        for k in (j, i):
            if p[k] <= eps or p[k] >= 1 - eps:
                p[k] = round(p[k])
        open_ = [k for k in (j, i) if 0 < p[k] < 1]
        held = open_[0] if open_ else -1
    return p, held


def _reduce(level: int, last: bool):
    """Round one group of a source: all but one document are done; at the root the last one is drawn too."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Long documents first: what is open at the end is short, and so is the way to the target.
        order = np.lexsort((group["key"].to_numpy(), _uniform(group["key"].to_numpy(), level), -group["size"].to_numpy()))
        group = group.iloc[order].reset_index(drop=True)
        p, held = pivotal(group["p"].to_numpy(float), group["size"].to_numpy(), _uniform(group["key"].to_numpy(), level + 500))
        if last and held >= 0:
            p[held] = float(_uniform(group["key"].to_numpy()[held : held + 1], 900)[0] < p[held])
            held = -1
        group["p"] = p
        group["open"] = np.arange(len(group)) == held
        return group

    return run


_KIND = "grp long, doc_id long, key long, size long, source string, source_size long, target double, whole long, p double, open boolean"


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, leaf: int = LEAF) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source), a row for each row of docs.

    size counts the words of the text (null: 0). A source's target is spread evenly over its documents: each is
    copied floor(target / source_size) times, and once more with the rest as probability, rounded by pivotal
    sampling that keeps a source's words. Groups of about `leaf` documents, dealt by a hash of the id, leave one
    open document each; those meet again `FAN_IN` groups at a time until the root draws the last, so a source of
    any size is rounded by a tree of small tasks and ends within one document of its target. taken = copies *
    size, at most `most` times it.

    Draws depend on ids alone, so reruns agree. A null source is one source, the last; rows without an id are drawn by
    their text. Documents without words take none. Repeated rows are drawn each for itself; an empty table gives
    no rows; extra columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("key"),
                           F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    goals = cut(targets(sums, weights, most).join(sums.select(F.col("source").alias("s2"), "docs"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    n_sources, largest = goals.agg(F.count("*"), F.max("docs")).first()
    side = F.broadcast(goals) if n_sources <= 100_000 else goals
    g = side.select(F.col("source").alias("s2"), "source_size", "target", F.ceil(F.col("docs") / leaf).alias("leaves"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    level = rows.join(g, F.col("source").eqNullSafe(F.col("s2"))).select(
        F.pmod(F.xxhash64(F.lit(SEED), "key"), F.col("leaves")).cast("long").alias("grp"), "doc_id", "key", "size", "source", "source_size", "target",
        F.least(F.floor(ratio + 1e-12), F.lit(most)).cast("long").alias("whole"), F.when(F.col("size") > 0, F.greatest(ratio - F.floor(ratio + 1e-12), F.lit(0.0))).otherwise(F.lit(0.0)).alias("p"))
    done, groups, depth = None, max(1, math.ceil((largest or 0) / leaf)), 0
    while True:
        last = groups == 1
        out = level.groupBy("source", "grp").applyInPandas(_reduce(depth, last), _KIND)
        if last:
            return _taken(out if done is None else done.unionByName(out))
        out = cut(out)
        closed = out.where("not open")
        done = closed if done is None else done.unionByName(closed)
        groups, depth = math.ceil(groups / FAN_IN), depth + 1
        level = out.where("open").withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("long")).drop("open")


def _taken(rounded: DataFrame) -> DataFrame:
    copies = F.col("whole") + F.round("p").cast("long")
    return rounded.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
