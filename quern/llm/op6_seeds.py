"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, cut, lower_ascii, read, words

#: 1: the word at this place counts; 0: any word may stand there. All begin with two words that count: places
#: whose two words begin no seed are passed over before the masks are hashed.
MASKS = ("111011", "1101101", "1110101")
#: For items shorter than a window, where a few substitutions can hit every spaced mask: three words in a row, which any
#: item keeps that has at most PERCENT substituted.
SHORT = "111"
#: Items of fewer words are looked for nowhere: they stand in clean texts too.
FEWEST = 6
#: Aligned words that are held against each other, and of a hundred of them how many must be equal.
WINDOW, PERCENT = 13, 80
#: Hashed seeds that are broadcast at once (about 40 MB); a larger benchmark is taken in blocks of items.
SEEDS_AT_ONCE = 500_000
#: Alignments, or documents to drop, that are broadcast (narrow rows).
ROWS_AT_ONCE = 1_000_000
#: Places of a text that are hashed at once: bounds memory for very long texts.
PLACES = 1 << 15


def _hash(mask: str, k: int) -> Column:
    """The hash of the words that mask k asks for from a place on; null where it runs over the end."""
    picked = [F.col(f"w{j}") for j, bit in enumerate(mask) if bit == "1"]
    return F.when(F.col(f"w{len(mask) - 1}").isNotNull(), F.xxhash64(F.lit(k), *picked))


def _places(rows: DataFrame, key: list[str], ws: str, masks) -> DataFrame:
    """(key.., i, w0, w1, ..): hashes of the words from each place i on, as many as the longest mask asks for, null beyond the end.

    Only the key goes along with places, not the text: the work is in proportion to the words."""
    wide = max(map(len, masks))
    hashed = rows.select(*key, F.transform(ws, lambda w: F.xxhash64(w)).alias("wh"))
    # Outer generators: of the others Spark filters what is empty first, and would find all words and places twice.
    parts = hashed.select(*key, "wh", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("wh") - 1, F.lit(0)), F.lit(PLACES))).alias("c"))
    parts = parts.select(*key, "c", F.slice("wh", F.col("c") + 1, F.lit(PLACES + wide - 1)).alias("wh"))
    last = F.greatest(F.least(F.size("wh") - 1, F.lit(PLACES - 1)), F.lit(0))
    at = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i + F.col("c")).alias("i"), *(F.get(F.col("wh"), i + j).alias(f"w{j}") for j in range(wide))))
    return parts.select(*key, F.explode_outer(at).alias("x")).select(*key, "x.*")


def seeds(items: DataFrame, masks=MASKS, window: int = WINDOW) -> DataFrame:
    """(item, p, start, h): every masked hash of every item, with its place and the hash of its first two words; items has item and ws (its words).

    Items shorter than the window also have a seed of SHORT at each place."""
    places = _places(items.withColumn("n", F.size("ws")), ["item", "n"], "ws", (*masks, SHORT))
    hashes = [_hash(m, k) for k, m in enumerate(masks)] + [F.when(F.col("n") < window, _hash(SHORT, len(masks)))]
    found = places.select("item", F.col("i").alias("p"), _hash("11", 0).alias("start"), F.explode(F.array_compact(F.array(*hashes))).alias("h"))
    return found


def contaminated(docs: DataFrame, items: DataFrame, masks=MASKS, window: int = WINDOW, percent: int = PERCENT,
                 id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item, window_matches, aligned_matches, offset) of every document and item that overlap.

    A document and an item overlap if some mask finds the same words in both at one alignment, and at that
    alignment a run of `window` places (the whole item, if it is shorter) has at least `percent` of a hundred
    equal words: substituted words are tolerated, up to one in five. Words are runs of non-space characters
    with A-Z lower-cased, over whole texts. Of several alignments of a pair the one with the best window, then
    most equal words, then the smallest offset (place in the document less place in the item) is returned. An
    alignment is verified once, however many masks hit it.

    Documents that overlap with nothing give no row, nor do null or empty texts or items of fewer than FEWEST words.
    Documents without id are one document, with a null id; items without id are none. Repeated rows give one
    row, rows that share an id one for each item. An empty table gives no rows. Extra columns are ignored.
    """
    found = _overlaps(docs, items, masks, window, percent, id_col, item_col, text_col)
    best = found.groupBy("id", "item").agg(F.max(F.struct("best", "total", (-F.col("d")).alias("d"))).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("x.best").cast("long").alias("window_matches"),
                       F.col("x.total").cast("long").alias("aligned_matches"), (-F.col("x.d")).cast("long").alias("offset"))


def _overlaps(docs: DataFrame, items: DataFrame, masks, window: int, percent: int, id_col: str, item_col: str, text_col: str) -> DataFrame:
    """(id, th, item, d, best, total) of the alignments that hold; th: the hash of the document's text."""
    if any(not m.startswith("11") for m in (*masks, SHORT)):
        raise ValueError("a mask begins with two words that count")
    tests = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), words(lower_ascii(F.col(text_col).cast("string"))).alias("ws")).distinct()
    tests = cut(tests.where(F.size("ws") >= FEWEST))
    blocks = max(1, -(-seeds(tests, masks, window).count() // SEEDS_AT_ONCE))
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), lower_ascii(text).alias("low"))
    parts = [tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else tests for b in range(blocks)]
    return reduce(DataFrame.unionByName, [_against(rows, part, masks, window, percent) for part in parts])


def _against(rows: DataFrame, tests: DataFrame, masks, window: int, percent: int) -> DataFrame:
    table = F.broadcast(cut(seeds(tests, masks, window)))
    at = _places(rows.select("th", words(F.col("low")).alias("words")), ["th"], "words", (*masks, SHORT))
    at = at.withColumn("start", _hash("11", 0)).join(F.broadcast(table.select("start").distinct()), "start")
    hashes = F.array_compact(F.array(*(_hash(m, k) for k, m in enumerate((*masks, SHORT)))))
    hits = at.select("th", "i", F.explode(hashes).alias("h")).join(table.select("h", "item", "p"), "h")
    # What masks hit at one alignment meets here, partly in the task that found it; texts stay where they are.
    hits = cut(hits.select("th", "item", (F.col("i") - F.col("p")).alias("d")).distinct())
    listed = hits.groupBy("th").agg(F.collect_list(F.struct("item", "d")).alias("at"))  # of one text
    listed = F.broadcast(listed) if at_most(hits, ROWS_AT_ONCE) else listed.hint("shuffle_hash")
    texts = rows.join(listed, "th").select("id", "th", words(F.col("low")).alias("words"), "at")
    pair = texts.select("id", "th", "words", F.explode("at").alias("x")).select("id", "th", "words", "x.*").join(F.broadcast(tests), "item")
    lo, n = F.greatest(F.lit(0), -F.col("d")), F.size("ws")
    length = F.greatest(F.least(n, F.size("words") - F.col("d")) - lo, F.lit(0))
    same = F.zip_with(F.slice("words", F.col("d") + lo + 1, length), F.slice("ws", lo + 1, length), lambda x, y: F.when(x == y, 1).otherwise(0))
    span = F.least(F.lit(window), n)

    def score(same: Column) -> Column:
        # Each window by its places, not by a slice: a slice would copy the whole of the array.
        inside = lambda s: F.aggregate(F.sequence(s, s + span - 1), F.lit(0), lambda a, j: a + F.get(same, j))
        sums = F.when(F.size(same) >= span, F.transform(F.sequence(F.lit(0), F.size(same) - span), inside))
        return F.struct(F.array_max(sums).alias("best"), F.aggregate(same, F.lit(0), lambda a, x: a + x).alias("total"))

    # An array of one, so that the flags are made once and not for each use of them.
    scored = F.filter(F.transform(F.array(same), score), lambda x: 100 * x["best"] >= percent * span)
    return pair.select("id", "th", "item", "d", F.explode_outer(scored).alias("x")).where("x IS NOT NULL").select("id", "th", "item", "d", "x.best", "x.total")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text overlaps with an item of the benchmark; all columns stay as they are.

    A row goes by its own text, with or without an id; null and empty texts stay; an empty benchmark drops nothing, an
    empty table stays empty."""
    gone = cut(_overlaps(docs, items, MASKS, WINDOW, PERCENT, "doc_id", "item_id", "text").select("id", "th").distinct())
    gone = F.broadcast(gone) if at_most(gone, ROWS_AT_ONCE) else gone.hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["th"]), "left_anti")


def op6_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
