"""How far the sources of a language differ in their terms: dense tiles for terms of many groups, posting pairs for rare ones."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, text_batches

#: Documents that a kept term needs; scale of a share; terms a group returns; a term is heavy in more than one of so many groups of its language.
DOCS, SCALE, FIRST, HEAVY = 3, 1_000_000_000, 200, 8
#: Groups of a side of a tile; numbers of a tile; entries a task counts before it sends them; pair sums it holds.
SIDE, CELLS, HELD, SUMS = 256, 1 << 20, 400_000, 500_000

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _term_rows(most: int):
    """(lang, source, text) to (lang, source, term, c, d): occurrences and documents, added up within a task until it holds `most` terms; '' stands for the group itself."""

    def rows(count):
        parts = [(lang, source, [*c, b""], [*c.values(), 0], [*map(d.__getitem__, c), 0]) for (lang, source), (c, d) in count.items()]
        text = lambda i: pa.concat_arrays([pa.repeat(pa.scalar(p[i], pa.string()), len(p[2])) for p in parts])
        column = lambda i, kind: pa.concat_arrays([pa.array(p[i], kind) for p in parts])
        return pa.RecordBatch.from_arrays([text(0), text(1), column(2, pa.binary()), column(3, pa.int64()), column(4, pa.int64())], names=["lang", "source", "term", "c", "d"])

    def run(batches):
        count: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                c, d = count.setdefault((lang, source), (Counter(), Counter()))
                found = _TERM.findall((text or b"").lower())
                held -= len(c)
                c.update(found)
                d.update(set(found))
                held += len(c)
                if held >= most:
                    yield rows(count)
                    count, held = {}, 0
        if count:
            yield rows(count)

    return run


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, d): occurrences of a term in a group and documents of the group that hold it; a row with an empty term for every group.

    A term of a language is in one place afterwards: a row from each task for each source that has it there, however often it occurs."""
    text_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(_term_rows(HELD), "lang string, source string, term binary, c long, d long").select("lang", "source", F.col("term").cast("string").alias("term"), "c", "d")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def share(count, total, kept):
    """p = 1 + floor(SCALE * (count + 1) / (total + kept)), exact."""
    return F.expr(f"CAST(1 + {SCALE} * (CAST({count} AS DECIMAL(19,0)) + 1) DIV (CAST({total} AS DECIMAL(19,0)) + {kept}) AS BIGINT)")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class Groups:
    """The sources of each language in order, with the share of a term that they lack."""

    def __init__(self, rows):
        self.names, base = defaultdict(list), defaultdict(list)
        for lang, source, p0 in rows:
            self.names[lang].append(source)
            base[lang].append(p0)
        self.base = {k: np.array(v, np.int64) for k, v in base.items()}


def _sums(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["lang", "g", "h", "v"])


def _dense_rows(groups: Groups, size: int):
    """Sorted (lang, a, b, tile, term, side, g, p) to what heavy terms change in each pair of a's and b's groups: a tile is a matrix of groups by terms, the sums of a pair of sides are held until it ends."""

    def blocks(lang, a, b):
        base = groups.base[lang]
        return base[a * size : (a + 1) * size], base[b * size : (b + 1) * size]

    def added(key, total, terms, sides, g, p):
        lang, a, b, _ = key
        base_a, base_b = blocks(lang, a, b)
        _, t = np.unique(terms, return_inverse=True)
        width = int(t.max()) + 1
        left, right = np.repeat(base_a[:, None], width, 1), np.repeat(base_b[:, None], width, 1)
        for side, m, at in ((0, left, a), (1, right, b)):
            own = (sides == side) | (a == b)
            m[g[own] - at * size, t[own]] = p[own]
        for i in range(len(left)):
            total[i] += _f(left[i][None, :], right).sum(axis=1) - width * _f(base_a[i], base_b)

    def out(lang, a, b, total):
        return _sums((lang, a * size + i, b * size + j, int(total[i, j])) for i in range(total.shape[0]) for j in range(total.shape[1]) if a != b or i != j)

    def run(batches):
        pair = total = tile = None
        held: list = []

        def finish():
            if tile is not None:
                terms, sides, g, p = (np.concatenate(x) for x in zip(*held))
                added(tile, total, terms, sides, g, p)

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, (a, b, tiles) = batch.column(0).to_pylist(), (batch.column(i).to_numpy() for i in (1, 2, 3))
            codes = batch.column(0).dictionary_encode().indices.to_numpy()
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5, 6, 7)]
            new = np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in (codes, a, b, tiles)], axis=0))))
            for s, e in zip(new, [*new[1:], len(a)]):
                key = (lang[s], int(a[s]), int(b[s]), int(tiles[s]))
                if key != tile:
                    finish()
                    held, tile = [], key
                    if key[:3] != pair:
                        if pair is not None:
                            yield out(*pair, total)
                        pair = key[:3]
                        total = np.zeros([len(x) for x in blocks(*pair)], np.int64)
                held.append([x[s:e] for x in cols])
        finish()
        if pair is not None:
            yield out(*pair, total)

    return run


def _rare_rows(groups: Groups):
    """(lang, g, p, m) to what m rare terms of share p in group g change in each pair of g; p = 0 stands for the sum of m terms that all groups lack."""

    def run(batches):
        for batch in batches:
            for lang, g, p, m in zip(*(c.to_pylist() for c in batch.columns)):
                base = groups.base[lang]
                lacking = _f(base[g], base)
                to = m * (lacking if p == 0 else _f(p, base) - lacking)
                rows = [(lang, g, h, v) for h, v in enumerate(to.tolist()) if h != g]
                if p:
                    back = m * (_f(base, p) - _f(base, base[g]))
                    rows += [(lang, h, g, v) for h, v in enumerate(back.tolist()) if h != g]
                yield _sums(rows)

    return run


def _pair_rows(groups: Groups):
    """Rare postings (lang, term, g, p), those of a term together, to corrections for pairs of groups that both hold a term."""

    def run(batches):
        sums: dict[tuple, int] = defaultdict(int)
        rest = None

        def added(lang: str, terms, g, p):
            base, reach = groups.base[lang], 1
            while reach < len(g):
                i = np.flatnonzero(terms[reach:] == terms[:-reach])
                if not len(i):
                    return
                j = i + reach
                for x, y in ((i, j), (j, i)):
                    v = _f(p[x], p[y]) - _f(p[x], base[g[y]]) - _f(base[g[x]], p[y]) + _f(base[g[x]], base[g[y]])
                    pairs, at = np.unique(g[x].astype(np.int64) * len(base) + g[y], return_inverse=True)
                    total = np.zeros(len(pairs), np.int64)
                    np.add.at(total, at, v)
                    for k, w in zip(pairs.tolist(), total.tolist()):
                        sums[lang, *divmod(k, len(base))] += w
                reach += 1

        def whole(table: pa.Table):
            lang = table.column(0).combine_chunks().dictionary_encode()
            codes, (terms, g, p) = lang.indices.to_numpy(), (table.column(i).to_numpy() for i in (1, 2, 3))
            new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True])))
            for s, e in zip(new[:-1], new[1:]):
                added(lang.dictionary[int(codes[s])].as_py(), terms[s:e], g[s:e], p[s:e])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            last = rest.slice(rest.num_rows - 1)
            ended = (rest.column(1).to_numpy() != last.column(1)[0].as_py()) | (np.array(rest.column(0).to_pylist(), object) != last.column(0)[0].as_py())
            n = int(ended.sum())  # rows are sorted, so those of the last term are at the end
            if n:
                whole(rest.slice(0, n))
                rest = rest.slice(n)
            if len(sums) >= SUMS:
                yield _sums((*k, v) for k, v in sums.items())
                sums.clear()
        if rest is not None:
            whole(rest)
        if sums:
            yield _sums((*k, v) for k, v in sums.items())

    return run


def audit(docs: DataFrame, least: int = DOCS, first: int = FIRST) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of docs.

    Part `pair`: each other source of the language with the sum of f = floor((p - q)^2 / q) over the kept terms, p the
    group's share of a term and q the other's. Part `term`: the group's `first` terms that it uses more than its language does.

    Terms of more than one in HEAVY of a language's groups are laid in tiles, matrices of at most SIDE groups by so many terms that
    CELLS numbers are reached, of which each task adds up those of a pair of sides. Any other term is a number for each share that a
    group has of it, and one for each pair of its few groups, added up within tasks. Both are what a term changes against the sum that a pair
    has where all terms are lacking. All is 64-bit integers whose sums are exact as long as a language's kept terms are under two thousand million.
    The groups of a language (not its terms) are sent to all tasks: `pair` returns more rows than that.

    Null text, lang and source are ''. A group without terms is still compared; a language of one source has no `pair`, one without
    kept terms gives 0 for all. Repeated rows are documents of their own; an empty table gives no rows; extra columns are ignored.
    """
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"total": F.sum("c").over(of_term), "k": F.count("*").over(of_term), "d": F.sum("d").over(of_term)})
    counts = cut(counts.where((F.col("d") >= least) | (F.col("term") == "")).drop("d"))
    postings = counts.where("term != ''")
    sizes = postings.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    langs = postings.select("lang", "term", "total").groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "v", "all"])
    groups = cut(groups.withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")).withColumn("s", F.count("*").over(Window.partitionBy("lang")).cast("int")))
    spark = docs.sparkSession
    base = groups.where("v > 0 AND s > 1").select("lang", "source", share("0", "n", "v").alias("p0")).orderBy("lang", "source")
    sides = Groups(base.toLocalIterator())
    shares = cut(postings.join(groups.select("lang", "source", "g", "s", "n", "v", "all"), ["lang", "source"]).select("lang", "source", "term", "k", "g", "s", share("c", "n", "v").alias("p"), share("total", "all", "v").alias("q")))

    over = shares.where("p > q").select("lang", "source", "term", F.expr("(p - q) * (p - q) DIV q").alias("value"))
    best = over.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= first)
    terms = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    several, heavy = shares.where("s > 1"), F.col("k") * HEAVY > F.col("s")
    blocks = F.ceil(F.col("s") / SIDE).cast("int")
    block, width = F.floor(F.col("g") / SIDE).cast("int"), F.greatest(F.lit(16), F.lit(CELLS) / (2 * F.least(F.col("s"), F.lit(SIDE))))
    wide = several.where(heavy).join(langs.select("lang", "v"), "lang").select("lang", F.xxhash64("term").alias("term"), "g", "p", block.alias("at"), blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("v") / width)).cast("int").alias("tiles"))
    # a posting is in the left side of the pairs (at, b) and in the right side of the pairs (b, at), once where both are one
    of = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.when(b == F.col("at"), F.array(F.struct(b.alias("a"), b.alias("b"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("at").alias("a"), b.alias("b"), F.lit(0).alias("side")), F.struct(b.alias("a"), F.col("at").alias("b"), F.lit(1).alias("side")))))))
    tiled = wide.select("lang", "term", "g", "p", F.pmod("term", "tiles").cast("int").alias("tile"), of.alias("of")).select("lang", "of.a", "of.b", "tile", "term", "of.side", "g", "p")
    sums = "lang string, g int, h int, v long"
    dense = tiled.repartition(parts, "lang", "a", "b", "tile").sortWithinPartitions("lang", "a", "b", "tile").mapInArrow(_dense_rows(sides, SIDE), sums)

    rare = several.where(~heavy)
    lacking = groups.where("v > 0 AND s > 1").select("lang", "g", F.lit(0).cast("long").alias("p"), F.col("v").alias("m"))
    single = rare.groupBy("lang", "g", "p").agg(F.count("*").alias("m"))
    alone = single.unionByName(lacking).repartition(parts, "lang", "g", "p").mapInArrow(_rare_rows(sides), sums)
    together = rare.where("k > 1").select("lang", F.xxhash64("term").alias("h"), "term", "g", "p").repartition(parts, "lang", "term").sortWithinPartitions("lang", "term").select("lang", "h", "g", "p").mapInArrow(_pair_rows(sides), sums)

    names = groups.select("lang", "source", "g", "s")
    every = names.where("s > 1").select("lang", "g", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("h")).where("g != h").withColumn("v", F.lit(0).cast("long"))
    added = dense.unionByName(alone).unionByName(together).unionByName(every).groupBy("lang", "g", "h").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("long").alias("value"))
    pairs = added.join(names.drop("s"), ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents", "lang", "source", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
o AS (SELECT id, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         (1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v))::BIGINT AS p
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
lt AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term),
ln AS (SELECT lang, sum(c) AS n FROM c GROUP BY lang),
lp AS (SELECT lt.lang, lt.term, (1 + (1000000000::HUGEINT * (lt.c + 1)) // (ln.n + v.v))::BIGINT AS q FROM lt JOIN ln ON ln.lang = lt.lang JOIN v ON v.lang = lt.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p)::HUGEINT * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
allpairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (
  SELECT p.lang, p.source, p.term AS item, ((p.p - q)::HUGEINT * (p.p - q) // q)::BIGINT AS value
  FROM p JOIN lp ON lp.lang = p.lang AND lp.term = p.term WHERE p.c > 0 AND p.p > lp.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM terms)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)))::INT AS rank FROM allpairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, rank::INT AS rank FROM ranked WHERE rank <= 200
"""
