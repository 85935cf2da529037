"""Collocations of a language: pieces with multiplicities, n-grams counted in duckdb per hash bucket, parts looked up by shuffled requests."""

from __future__ import annotations

import tempfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, text_batches
from .shingles import splitmix, stream

_U = np.uint64
#: Words of a phrase; occurrences that a candidate needs; share of its occurrences inside a longer one that drops it; phrases a language returns.
MOST_WORDS, LEAST, INSIDE_PERCENT, FIRST, SCALE = 3, 10, 50, 2000, 1_000_000
#: Words whose n-grams a task counts before it sends them; words of a piece before it is parted; bytes of pieces that a task holds to find equal ones.
CHUNK, LONG_PIECE, HELD = 1 << 19, 4096, 16 << 20
#: What a bucket's counting may take in memory before it goes to disk.
COUNT_MEMORY = "300MB"
#: Buckets of n-grams for each shuffle partition: a bucket of all n-grams of a partition of text is larger than such a partition.
PARTS = 4
#: Parts that a language's ranking is dealt over before its first phrases meet.
SALTS = 32

_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_ENDS))


def _piece_rows(most: int, long: int):
    """(lang, text) to (lang, piece, starts, m): the pieces of texts, words parted by one blank, m times each.

    starts is the number of words at which an n-gram of the row begins. A piece of over `long` words is parted
    into rows that overlap by most - 1 words, so each n-gram begins in one row.
    """

    def rows(count: Counter):
        keys, names = list(count), ("lang", "piece", "starts", "m")
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int64()), pa.array(list(count.values()), pa.int64())], names=names)

    def run(batches):
        count, held = Counter(), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for part in (text or b"").translate(_FOLD).split(b"\n"):
                    found = part.split()
                    n = len(found)
                    if n <= long:
                        if n:
                            key = (lang, b" ".join(found), n)
                            if key not in count:
                                held += len(key[1]) + 200
                            count[key] += 1
                        continue
                    for a in range(0, n, long):
                        key = (lang, b" ".join(found[a : a + long + most - 1]), min(long, n - a))
                        held += len(key[1]) + 200
                        count[key] += 1
                if held > HELD:
                    yield rows(count)
                    count, held = Counter(), 0
        if count:
            yield rows(count)

    return run


def pieces(docs: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(lang, piece, starts, m): the distinct pieces of all texts with the number of times each occurs, see _piece_rows."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_piece_rows(most, LONG_PIECE), "lang string, piece binary, starts long, m long").groupBy("lang", "piece", "starts").agg(F.sum("m").alias("m"))


def _section(lang: str, counts: np.ndarray, lens: np.ndarray, text: bytes) -> bytes:
    """n-grams of a language: the sizes of what follows, the language, a count and a length each, all texts."""
    name = lang.encode()
    sizes = np.array([len(name), len(counts), len(text)], "<u4")
    return b"".join((sizes.tobytes(), name, counts.astype("<i8").tobytes(), lens.astype("<u4").tobytes(), text))


def _sections(blob: bytes):
    """(language, counts, n-grams) of each section of a compressed bucket."""
    data, at = zstandard.ZstdDecompressor().decompress(blob), 0
    while at < len(data):
        name, n, text = np.frombuffer(data, "<u4", 3, at).tolist()
        at += 12
        lang, at = data[at : at + name].decode(), at + name
        counts, lens = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n)
        at += 12 * n
        ends = np.zeros(n + 1, np.int32)
        np.cumsum(lens, out=ends[1:])
        yield lang, counts, pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(data[at : at + text]))
        at += text


def _chunk_rows(lang: str, texts: list[bytes], starts: np.ndarray, m: np.ndarray, most: int, buckets: int):
    """(bucket, section) of the n-grams of a chunk of pieces, with their counts; the n-gram of no words counts all words."""
    text = b" ".join(texts)
    found = text.split(b" ")
    n, buf = len(found), np.frombuffer(text, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    size = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
    piece, last = np.repeat(np.arange(len(texts)), size), np.cumsum(size)
    first = last - size
    words = pa.array(found, pa.binary()).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    order = sorted(range(len(distinct)), key=distinct.__getitem__)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids = place[words.indices.to_numpy()]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(distinct[i]) for i in order), _U, len(order))[ids]
    at = np.flatnonzero(np.arange(n) - first[piece] < starts[piece])
    yield zlib.crc32(lang.encode()) % buckets, _section(lang, np.array([m @ starts]), np.array([0]), b"")
    key, factors, h = np.zeros(n, np.int64), stream(11, most) | _U(1), np.zeros(n, _U)
    for k in range(1, most + 1):
        at = at[at + k <= last[piece[at]]]
        if not len(at):
            return
        # of a longer key only its rank among its kind is kept, so that it fits 64 bits with the next word
        if k == 1:
            key, h = ids.copy(), hashes * factors[0]
        else:
            fresh, rank = np.zeros(n, np.int64), np.zeros(n, _U)
            fresh[at] = key[at] * len(order) + ids[at + k - 1]
            rank[at] = h[at] + hashes[at + k - 1] * factors[k - 1]
            key, h = fresh, rank
        own = at[np.argsort(key[at], kind="stable")]
        sorted_keys = key[own]
        new = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))
        cuts = np.flatnonzero(new)
        counts, one = np.add.reduceat(m[piece[own]], cuts), own[cuts]
        key[own] = np.cumsum(new) - 1
        bucket = (splitmix(h[one]) % _U(buckets)).astype(np.int64)
        dealt = np.argsort(bucket, kind="stable")
        one, counts, bucket = one[dealt], counts[dealt], bucket[dealt]
        lens = ends[one + k - 1] - begins[one]
        stops = np.cumsum(lens)
        grams = buf[np.repeat(begins[one] - (stops - lens), lens) + np.arange(int(stops[-1]))]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(bucket[a]), _section(lang, counts[a:b], lens[a:b], grams[stops[a] - lens[a] : stops[b - 1]].tobytes())


def _gram_rows(most: int, buckets: int, chunk: int):
    """Pieces to (bucket, data), counted within chunks of so many words: a row for each bucket that a chunk has n-grams for."""

    def run(batches):
        held: dict[str, list] = {}
        total = 0

        def flushed():
            parts: dict[int, list[bytes]] = {}
            for lang, rows in held.items():
                for bucket, section in _chunk_rows(lang, [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), most, buckets):
                    parts.setdefault(bucket, []).append(section)
            pack = zstandard.ZstdCompressor(1).compress
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([pack(b"".join(x)) for x in parts.values()], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(row[0], []).append(row[1:])
                total += row[2]
                if total >= chunk:
                    yield flushed()
                    held, total = {}, 0
        if held:
            yield flushed()

    return run


def _counted_rows(least: int):
    """(bucket, data) to (lang, gram, f): one duckdb aggregation a task, which goes to a scratch folder of its own beyond COUNT_MEMORY."""
    kind = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches):
        import duckdb

        def parts():
            for batch in batches:
                for lang, counts, grams in (x for data in batch.column(1) for x in _sections(data.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(counts), np.int8))), grams, pa.array(counts)], schema=kind)

        with tempfile.TemporaryDirectory(prefix="grams-") as scratch, duckdb.connect(config={"memory_limit": COUNT_MEMORY, "temp_directory": scratch, "threads": 1, "preserve_insertion_order": False}) as con:
            con.register("parts", pa.RecordBatchReader.from_batches(kind, parts()))
            sql = f"SELECT lang, gram, sum(n)::BIGINT AS f FROM parts GROUP BY lang, gram HAVING sum(n) >= {int(least)} OR gram = ''"
            yield from con.sql(sql).to_arrow_reader(1 << 16)

    return run


def counted(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST) -> DataFrame:
    """(lang, gram, f): the n-grams of up to `most` words that occur `least` times or more in a language, and under '' all its words.

    Equal pieces are one row with a multiplicity. Tasks count the n-grams of chunks of them, so a frequent n-gram is a
    few rows of each task, pack them by hash bucket and send them; a bucket's exact sums are made out-of-core.
    """
    buckets = PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces(docs, most).mapInArrow(_gram_rows(most, buckets, CHUNK), "bucket int, data binary")
    return rows.repartition(buckets, "bucket").mapInArrow(_counted_rows(least), "lang string, gram string, f long")


def _words(gram, a, n):
    return F.array_join(F.slice(F.split(gram, " "), a, n), " ")


def collocations(docs: DataFrame, most: int = MOST_WORDS, least: int = LEAST, inside: int = INSIDE_PERCENT, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first phrases, by score, occurrences and phrase.

    Candidates are phrases of 2 to `most` words with `least` occurrences or more; score, l and r are of the lowest-scoring
    cut. Each candidate sends requests for the counts of its parts to where those are, and sums meet at the candidate again
    (a part of very many candidates is split as a skewed join). Those that lie inside a longer candidate with `inside` percent of
    their occurrences go. Ranks are taken within SALTS parts of a language before they meet.

    Null texts are empty, a null lang is 'und'. A language without candidates and an empty table give no rows; repeated rows count each;
    texts of any length are taken in parts of LONG_PIECE words; extra columns are ignored.
    """
    counts = cut(counted(docs, most, least))
    size = F.size(F.split("gram", " "))
    candidates = counts.where("gram != ''").select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), size.alias("words")).where("words > 1")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = {"l": _words("phrase", F.lit(1), F.col("k")), "r": _words("phrase", F.col("k") + 1, F.col("words"))}
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), part.alias("gram")) for s, part in parts.items()))).alias("of")
    requests = cuts.select("lang", "phrase", "a", "k", sides).select("lang", "phrase", "a", "k", "of.*")
    found = requests.hint("merge").join(counts, ["lang", "gram"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    per_cut = [F.struct(F.expr(f"CAST({SCALE} * (CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l{k} AS DECIMAL(19,0)) * CAST(r{k} AS DECIMAL(19,0))) AS BIGINT)").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, most)]
    joined = found.groupBy("lang", "phrase").agg(F.max("a").alias("a"), *(F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}") for k in range(1, most) for s in "lr"))
    scored = joined.select("lang", "phrase", "a", F.array_min(F.filter(F.array(*per_cut), lambda x: x["score"].isNotNull())).alias("at")).select("lang", "phrase", "a", "at.score", "at.l", "at.r")
    longer = candidates.where("words > 2").select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("n"))
    longer = longer.select("lang", "phrase", "a", "n", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1)).alias("i"))
    longer = longer.select("lang", _words("phrase", F.col("i"), F.col("n")).alias("phrase"), F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where((100 * big("most") < inside * big("a")) | F.col("most").isNull()).drop("most")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    totals = counts.where("gram = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents", "lang", "text"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= 10),
cand AS (SELECT lang, k AS words, g, string_split(g, ' ') AS w, f AS a FROM f WHERE k > 1),
parts AS (SELECT lang, g, a, t.k, array_to_string(w[1:t.k], ' ') AS first, array_to_string(w[t.k + 1:], ' ') AS rest FROM cand JOIN (VALUES (1), (2)) AS t(k) ON t.k < words),
cuts AS (
  SELECT p.lang, p.g, p.a, p.k, l.f AS l, r.f AS r, (1000000::HUGEINT * p.a * p.a) // (l.f::HUGEINT * r.f) AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.g = p.first JOIN f r ON r.lang = p.lang AND r.g = p.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_of AS (
  SELECT lang, g, max(a) AS most
  FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g, a FROM cand WHERE words = 3) GROUP BY lang, g),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_of i ON i.lang = b.lang AND i.g = b.g WHERE i.most IS NULL OR 100 * i.most < 50 * b.a),
ranked AS (
  SELECT lang, g AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank
  FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
