"""Near-duplicate documents: MinHash signatures, banding, signature and full-set verification, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, packed, read, small_side, text_batches
from .components import components
from .shingles import Shingler, splitmix, stream

#: Links below this miss probability at the threshold itself; bands and rows follow from it.
MISS = 3e-7
#: Node ids that may be broadcast: 16 MB of longs.
BROADCAST_ROWS = 1_000_000
#: Rows of pairs or components that may be broadcast to what they are joined to: a few MB of the driver.
KNOWN_ROWS = 1 << 16
#: Agreement of signatures that makes two sets one family; any value gives the same links, with more or fewer pairs looked at.
FAMILY = 0.4
#: Counters of the sketch of shingle frequencies.
SLOTS = 1 << 19
#: Rounds of new centres within a family before pairs are made; any number gives the same components.
CENTRES = 3
#: Bands, and minima of each, of what a member has apart from its family's consensus; they bring likely links together, any number gives the same components.
KEYS, KEY_ROWS = 16, 3
#: Rows of a round of centres to a task.
PART_ROWS = 1 << 17
#: Members of a family that meet its consensus in one place.
FAMILY_ROWS = 1 << 12
#: Bits of a bucket's map of tokens; any number gives the same pairs, with more or fewer tokens looked up.
TOKEN_BITS = 4096
#: Longs of a parity sketch.
PARITIES = 8
_BLOCK = 1024


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows) so that a pair of just this similarity shares no band with probability under MISS."""
    s = percent / 100
    rows = 6 if s >= 0.85 else 5
    return math.ceil(math.log(MISS) / math.log(1 - s**rows)), rows


def feature_rows(percent: int, k: int):
    """Arrow batches of (rid, text, id) to (rid, id, n, fp, bands, sig): set size, set fingerprint, band keys, low bytes of the minima."""
    bands, rows = bands_for(percent)

    def run(batches):
        shingles, n_hash = Shingler(k), bands * rows
        factor, shift = (stream(11, n_hash) | np.uint64(1))[:, None], stream(12, n_hash)[:, None]
        mixers = stream(13, rows) | np.uint64(1)
        salt = stream(14, bands)
        room = np.empty((n_hash, _BLOCK), np.uint64)
        for batch in batches:
            n, fps, keys, sigs = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text)
                n.append(len(s))
                if not len(s):
                    fps.append(None), keys.append(None), sigs.append(None)
                    continue
                x, low = s >> np.uint64(32), None
                for i in range(0, len(x), _BLOCK):
                    part = x[i : i + _BLOCK]
                    out = room[:, : len(part)]
                    np.multiply(factor, part, out=out)
                    np.add(out, shift, out=out)
                    now = out.min(axis=1)
                    low = now if low is None else np.minimum(low, now)
                low >>= np.uint64(32)
                keys.append(splitmix((low.reshape(bands, rows) * mixers).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                sigs.append(splitmix(low).astype(np.uint8).tobytes())
                fps.append(xxhash.xxh3_128_digest(s.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["rid", "id", "n", "fp", "bands", "sig"],
            )

    return run


def set_rows(k: int):
    def run(batches):
        shingles = Shingler(k)
        for batch in batches:
            sets = [shingles(t).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def alike_signatures(percent: int):
    """Pairs whose signatures agree in FAMILY of their places, with likely: about as often as the threshold asks, less five standard deviations."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            s = percent / 100
            share = np.array([np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) for x, y in zip(a, b)])
            likely = share >= s - 5 * math.sqrt(s * (1 - s) / (len(a[0]) if a else 1))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likely, pa.bool_())], names=["a", "b", "likely"])
            yield out.filter(pa.array(likely | (share >= FAMILY), pa.bool_()))

    return run


def alike_sets(percent: int):
    """Keep pairs with 100 * intersection >= percent * union, by the whole sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def count_rows(batches):
    """(node, shingles) to one row of (slot, c) for each slot of the frequency sketch that a partition fills."""
    seen = np.zeros(SLOTS, np.int64)
    for batch in batches:
        all_sets = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
        seen += np.bincount((all_sets % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["slot", "c"])


def parities(s: np.ndarray) -> np.ndarray:
    """The parity sketch of a set: bit b tells whether an odd number of its members fall on b.

    The sketches of two sets differ in no more bits than the sets have members that the other lacks.
    """
    bits = np.bincount((s % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


_PARITIES = [f"p{j}" for j in range(PARITIES)]
_OUTSIDE = ", ".join(["c long, x long, fam long, n long, i long, held boolean, tokens array<long>", *(f"{p} long" for p in _PARITIES)])


def outside_rows(percent: int, shared, smallest: bool):
    """(c, x, fam, sets of c and x) to (c, x, fam, n, i, held, tokens, sketch); i: shingles that x shares with c; held: the two are linked.

    tokens has those shingles of x outside c that may matter: the rarest so many that a link must share one. Any
    link of x has percent of its shingles; more where c is the smallest set of its group (smallest).
    """

    def run(batches):
        often = shared.value
        for batch in batches:
            tokens, counts, sketches = [], [], []
            for c, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                c, x = np.frombuffer(c, np.uint64), np.frombuffer(x, np.uint64)
                out = np.setdiff1d(x, c, assume_unique=True)
                both = len(x) - len(out)
                need = -(-percent * (len(x) + len(c)) // (100 + percent)) if smallest else -(-percent * len(x) // 100)
                least = max(1, need - both)
                rare = np.lexsort((out, often[(out % np.uint64(SLOTS)).astype(np.int64)]))[: max(0, len(out) - least + 1)]
                tokens.append(out[rare].view(np.int64))
                counts.append((len(x), both, 100 * both >= percent * len(c) + percent * len(out)))
                sketches.append(parities(x))
            if not tokens:
                continue
            n, i, held = zip(*counts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(n, pa.int64()), pa.array(i, pa.int64()), pa.array(held, pa.bool_()), pa.array(tokens, pa.list_(pa.int64())), *(pa.array(p) for p in np.array(sketches).T)],
                names=["c", "x", "fam", "n", "i", "held", "tokens", *_PARITIES],
            )

    return run


def shingle_counts(batches):
    """(fam, shingles) to (fam, t, c): in how many sets of a family a shingle is, added up within a batch."""
    for batch in batches:
        sets = batch.column(1).to_pylist()
        owner = np.repeat(batch.column(0).to_numpy(), [len(x) // 8 for x in sets])
        t = np.frombuffer(b"".join(sets), np.uint64).view(np.int64)
        order = np.lexsort((t, owner))
        owner, t = owner[order], t[order]
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (t[1:] != t[:-1])))) if len(t) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(t[first]), pa.array(np.diff(np.append(first, len(t))))], names=["fam", "t", "c"])


_APART = ", ".join(["c long, x long, n long, slack long, tokens array<long>, keys array<long>", *(f"{p} long" for p in _PARITIES)])


def apart_rows(percent: int, shared):
    """(fam, x, members, consensus, set of x) to (c, x, n, slack, tokens, keys, sketch): c is the family; tokens are the shingles that x or the consensus lacks, the rarest of the family first; keys are bands of their minima.

    slack is what x may differ from the consensus and still be linked with a set that differs from it as little: of two sets whose slacks add up to 0 or more
    the differences can't be too many, so they are linked.
    """

    def run(batches):
        often, held, consensus = shared.value, None, None
        factor, shift, mixers, salt = (stream(21, KEYS * KEY_ROWS) | np.uint64(1))[:, None], stream(22, KEYS * KEY_ROWS)[:, None], stream(23, KEY_ROWS) | np.uint64(1), stream(24, KEYS)
        for batch in batches:
            tokens, keys, sketches, n, slack = [], [], [], [], []
            fams, members = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, x in enumerate(batch.column(4).to_pylist()):
                if fams[i] != held:
                    held, consensus = fams[i], np.sort(np.array(batch.column(3)[i].as_py(), np.int64).view(np.uint64))
                x = np.frombuffer(x, np.uint64)
                more, less = np.setdiff1d(x, consensus, assume_unique=True), np.setdiff1d(consensus, x, assume_unique=True)
                seen = lambda t: often[(t % np.uint64(SLOTS)).astype(np.int64)]
                differ = np.concatenate((more, less))
                rank = np.concatenate((seen(more), np.maximum(members[i] - seen(less), 0)))
                tokens.append(differ[np.lexsort((differ, rank))].view(np.int64))
                low = ((differ >> np.uint64(32)) * factor + shift).min(axis=1) if len(differ) else np.empty(0, np.uint64)
                keys.append(splitmix((low.reshape(KEYS, KEY_ROWS) * mixers).sum(axis=1, dtype=np.uint64) + salt).view(np.int64) if len(differ) else np.empty(0, np.int64))
                n.append(len(x)), slack.append((100 - percent) * len(x) - (100 + percent) * len(differ)), sketches.append(parities(x))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(slack, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), *(pa.array(p) for p in np.array(sketches).T)],
                    names=["c", "x", "n", "slack", "tokens", "keys", *_PARITIES],
                )

    return run


def _few(df: DataFrame, tasks: int | None) -> DataFrame:
    """df in so many parts at most: what follows a shuffle of few rows takes few tasks."""
    return df if tasks is None else df.coalesce(tasks)


def _known(rows: DataFrame) -> DataFrame:
    """Staged rows are broadcast where they are few, so that what they are joined to stays where it lies."""
    return F.broadcast(rows) if at_most(rows, KNOWN_ROWS) else rows


def _sets(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of these nodes (rid), from their texts; cut to the shared folder."""
    return packed(texts.join(small_side(nodes.distinct(), BROADCAST_ROWS), "rid", "left_semi").mapInArrow(set_rows(k), "node long, shingles binary"))


def _signed(pairs: DataFrame, reps: DataFrame, percent: int, tasks: int | None = None) -> DataFrame:
    """Pairs (a, b, likely) of sizes that may hold: likely by their signatures, or of one family."""
    near = reps.select("node", "n", "sig")
    sized = (
        _few(_few(pairs.join(near.toDF("a", "na", "sa"), "a"), tasks).join(near.toDF("b", "nb", "sb"), "b"), tasks)
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .select("a", "b", "sa", "sb")
    )
    return packed(sized.mapInArrow(alike_signatures(percent), "a long, b long, likely boolean"))


def _links(likely: DataFrame, sets: DataFrame, percent: int, tasks: int | None = None) -> DataFrame:
    """The pairs that hold by their whole sets."""
    both = _few(_few(_known(likely).join(sets.toDF("a", "xa"), "a"), tasks).join(sets.toDF("b", "xb"), "b"), tasks).select("a", "b", "xa", "xb")
    return packed(_few(both.mapInArrow(alike_sets(percent), "a long, b long").distinct(), tasks))


def _across(spokes: DataFrame, signed: DataFrame, first: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """(node, root): the components of first, joined by all links within families and buckets that it lacks.

    No pair is made of sets that merely share what their whole group shares.
    - Families are the components of pairs with signatures somewhat alike. What is linked by the distances to the family's consensus
      joins without being compared; the rest meets by the shingles in which it differs from the consensus, see _families and _regrouped.
    - Of different families, pairs are made within a bucket. Its centre c is its smallest set, so x that isn't
      linked with c has |x & c| below what a link of x with any set of at least c's size needs: x and y must
      share as many shingles outside c as that falls short, hence (by the prefix filter) one of the rarest of
      those; rare by a sketch of counts, though any fixed order is right.
    """
    spark = spokes.sparkSession
    families = components(signed).toDF("x", "fam")
    rooted = packed(_rooted(families, first))
    split = rooted.groupBy("fam").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("fam")
    # A family may hold a large part of all rows: what is one row a family goes to it while it is small enough.
    own = packed(rooted.join(small_side(packed(split), BROADCAST_ROWS), "fam").select("x", "fam"))
    label = packed(spokes.join(_known(families), "x", "left").select("c", "x", F.coalesce("fam", "x").alias("fam")))
    mixed = label.groupBy("c").agg(F.min("fam").alias("lo"), F.max("fam").alias("hi")).where("lo <> hi").select("c")
    between = packed(label.join(mixed, "c").select("c", "x", "fam"))
    if own.isEmpty() and between.isEmpty():
        return first
    sets = _sets(between.select(F.explode(F.array("c", "x")).alias("rid")).unionByName(own.select(F.col("x").alias("rid"))), texts, k)
    table = sets.mapInArrow(count_rows, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()  # SLOTS rows at most
    often = np.zeros(SLOTS, np.int64)
    often[table.column("slot").to_numpy()] = table.column("c").to_numpy()
    shared = spark.sparkContext.broadcast(often)
    of_family, joined = _families(own, sets, percent, shared)
    both = between.join(sets.toDF("c", "sc"), "c").join(sets.toDF("x", "sx"), "x").select("c", "x", "fam", "sc", "sx")
    of_bucket = packed(both.mapInArrow(outside_rows(percent, shared, True), _OUTSIDE))
    linked = joined.unionByName(of_bucket.where("held").select(F.col("c").alias("a"), F.col("x").alias("b")))
    # What is joined already goes on as stars.
    second, far = _regrouped(of_family, components(_stars(first).unionByName(linked)), reps, sets, percent)
    of_bucket = _rooted(_foreign(of_bucket), second).withColumn("token", F.explode("tokens")).drop("tokens")
    # Rows of two families meet by the pair of families, so none meets those of its own.
    kinds = packed(of_bucket.select("c", "token", "fam").distinct())
    two_kinds = kinds.withColumnRenamed("fam", "f").join(kinds.withColumnRenamed("fam", "g"), ["c", "token"]).where("f < g")
    lower = of_bucket.withColumnRenamed("fam", "f").join(two_kinds, ["c", "token", "f"]).drop("f").withColumnRenamed("g", "fam")
    pairs = packed(packed(far).unionByName(_met(lower, of_bucket, ["c", "token", "fam"], percent, "true")).distinct())
    if pairs.isEmpty():
        return second
    more = _links(_signed(pairs, reps, percent).where("likely").select("a", "b"), sets, percent)
    if more.isEmpty():
        return second
    return components(_stars(second).unionByName(more))


def _families(own: DataFrame, sets: DataFrame, percent: int, shared) -> tuple[DataFrame, DataFrame]:
    """(members (c, x, n, slack, tokens, keys, sketch) of families c, links (a, b) that follow from their slacks).

    A family's consensus holds the shingles of more than half of its members, so no shingle in which members differ from it is common to most.
    Let d(x) be their number for x. Sets x and y differ in d(x) + d(y) shingles, less two for each that they differ in alike; they are linked where that is
    (100 - percent) of 100 + percent of both sizes at most, hence always if their slacks add up to 0 or more. The member with the largest slack, the star, is so linked
    with whatever anything is linked with in that way. Any other link needs as many shingles in common as both slacks fall short, halved: of each member
    only the rarest tokens stay that such a link must share one of.
    """
    tasks = max(own.sparkSession.sparkContext.defaultParallelism, own.count() // FAMILY_ROWS)
    sized = packed(_few(own.groupBy("fam").agg(F.count("*").alias("members")), tasks))
    held = _few(own.join(sets.toDF("x", "s"), "x"), tasks)
    counts = _few(held.select("fam", "s").mapInArrow(shingle_counts, "fam long, t long, c long").groupBy("fam", "t").agg(F.sum("c").alias("c")), tasks)
    common = _few(counts.join(small_side(sized, BROADCAST_ROWS), "fam"), tasks).where(2 * F.col("c") > F.col("members"))
    heads = _few(common.groupBy("fam").agg(F.collect_list("t").alias("consensus")), tasks)
    heads = packed(_few(sized.join(heads, "fam", "left"), tasks).withColumn("consensus", F.coalesce("consensus", F.array().cast("array<long>"))))
    # A family's consensus is sent to as many places as it has FAMILY_ROWS members.
    parts = F.ceil(F.col("members") / FAMILY_ROWS)
    dealt = held.join(small_side(sized, BROADCAST_ROWS), "fam").select("fam", "x", "s", F.pmod(F.xxhash64("x"), parts).alias("part"))
    placed = heads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    rows = _few(dealt.join(placed, ["fam", "part"]), tasks).select("fam", "x", "members", "consensus", "s")
    apart = packed(rows.mapInArrow(apart_rows(percent, shared), _APART))
    best = packed(apart.groupBy("c").agg(F.max(F.struct("slack", (-F.col("x")).alias("x"))).alias("h")).select("c", F.col("h.slack").alias("most"), (-F.col("h.x")).alias("star")))
    apart = apart.join(small_side(best, BROADCAST_ROWS), "c")
    near = F.col("slack") + F.col("most") >= 0
    links = apart.where(near & (F.col("x") != F.col("star"))).select(F.col("star").alias("a"), F.col("x").alias("b"))
    # One of two members that are still to be linked falls short even with the star.
    short = F.when(near, F.col("most") - F.col("slack")).otherwise(-F.col("most") - F.col("slack"))
    need = F.greatest(F.lit(1), F.ceil(short / (2 * (100 + percent)))).cast("int")
    members = apart.where(F.size("tokens") >= need).select("c", "x", "n", "slack", F.slice("tokens", F.lit(1), F.size("tokens") - need + 1).alias("tokens"), "keys", *_PARITIES)
    return members, links


def _foreign(rows: DataFrame) -> DataFrame:
    """(c, x, fam, n, i, tokens): of each row of a bucket the tokens that rows of its other families may hold, rows with none left out.

    All tokens of the families but the bucket's largest stay; of the largest family's those that a map of the others'
    tokens shows, TOKEN_BITS bits a bucket. It shows each that is there, so no pair of two families is lost, and a
    bucket of one large family with few others makes few rows.
    """
    tops = rows.groupBy("c", "fam").agg(F.count("*").alias("k")).groupBy("c").agg(F.max_by("fam", F.struct("k", "fam")).alias("top"))
    rows = rows.join(small_side(packed(tops), BROADCAST_ROWS), "c")
    others = rows.where("fam <> top").select("c", F.explode("tokens").alias("t"))
    word, bit = f"pmod(t, {TOKEN_BITS}) div 64", "shiftleft(1L, cast(pmod(t, 64) as int))"
    maps = others.groupBy("c", F.expr(word).alias("w")).agg(F.expr(f"bit_or({bit})").alias("b")).groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("map"))
    marked = rows.join(small_side(packed(maps), BROADCAST_ROWS * 64 // TOKEN_BITS), "c", "left")
    shown = F.expr(f"if(fam <> top, tokens, filter(tokens, t -> coalesce(try_element_at(map, {word}), 0L) & {bit} <> 0))")
    return packed(marked.select("c", "x", "fam", "n", "i", shown.alias("tokens")).where("size(tokens) > 0"))


def _rooted(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(_known(groups.toDF("x", "root")), "x", "left").withColumn("root", F.coalesce("root", "x"))


def _unlike(a: str, b: str, percent: int) -> str:
    """That two rows are of different components and of sizes that a link can have."""
    return f"{a.format('root')} <> {b.format('root')} and 100 * least({a.format('n')}, {b.format('n')}) >= {percent} * greatest({a.format('n')}, {b.format('n')})"


def _near(a: str, b: str, percent: int) -> str:
    """That parity sketches allow a link: its sets differ in (100 - percent) of 100 + percent of their sizes, and their sketches in no more."""
    bits = " + ".join(f"bit_count({a.format(p)} ^ {b.format(p)})" for p in _PARITIES)
    return f"{100 + percent} * ({bits}) <= {100 - percent} * ({a.format('n')} + {b.format('n')})"


def _met(one: DataFrame, two: DataFrame, on: list[str], percent: int, more: str) -> DataFrame:
    one, two = (d.toDF(*(c if c in on else f"{c}{s}" for c in d.columns)) for d, s in ((one, "a"), (two, "b")))
    pairs = one.join(two, on).where(f"{_unlike('{}a', '{}b', percent)} and {more}")
    return pairs.select(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b"))


def _regrouped(of_family: DataFrame, groups: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(groups after CENTRES rounds of new centres, pairs (a, b) of a family that are still to be compared).

    Members of a family c meet by shingles in which they differ from its consensus. Shingles that just the same members hold
    (an edit gives up to ten) are one: their class is a hash over who holds them, and were two classes to share a
    hash, more would be compared. Each round gives every class a centre, compares its members of other
    components with that alone, and contracts: rows in proportion to the members. Only what is in different components
    even then is compared in pairs, where parity sketches allow a link. Bands of minima of these shingles are classes as well in the rounds: what shares one is
    mostly linked, so the rounds contract a dense family before pairs are made.
    """
    # Rows of a round are in proportion to the members' shingles; a small family is not dealt over all of the session's partitions.
    tasks = max(of_family.sparkSession.sparkContext.defaultParallelism, of_family.select(F.sum(F.size("tokens") + KEYS)).first()[0] // PART_ROWS if not of_family.isEmpty() else 0)
    held = of_family.select("c", "x", F.explode("tokens").alias("token"))
    lists = _few(held.groupBy("c", "token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("x")).alias("h")).where("m > 1").select("c", "token", F.xxhash64("m", "h").alias("g")), tasks)
    classes = packed(_few(_few(held.join(lists, ["c", "token"]), tasks).select("c", "x", "g").distinct(), tasks))
    members = of_family.select("c", "x", "n", "slack", *_PARITIES)
    bands = of_family.select("c", "x", F.explode("keys").alias("g"))

    def mixed(kinds: DataFrame) -> DataFrame:
        """(c, g, x, ..) of the classes that hold several components."""
        rows = _rooted(kinds, groups)
        several = _few(rows.groupBy("c", "g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("c", "g"), tasks)
        # What members have besides is joined to these rows alone.
        held = packed(_few(rows.join(several, ["c", "g"], "left_semi"), tasks))
        return packed(_few(held.join(members, ["c", "x"]), tasks))

    for turn in range(CENTRES):
        rows = mixed(bands.unionByName(classes))
        if rows.isEmpty():
            break
        # First what is nearest to the consensus, then any.
        rank = F.col("slack") if turn == 0 else F.xxhash64("x", F.lit(turn))
        centres = _few(rows.groupBy("c", "g").agg(F.max_by(F.struct("x", "root", "n", *_PARITIES), F.struct(rank.alias("r"), F.col("x").alias("x"))).alias("h")), tasks)
        spokes = _few(rows.join(centres, ["c", "g"]), tasks).where(f"{_unlike('{}', 'h.{}', percent)} and {_near('{}', 'h.{}', percent)}")
        pairs = _few(spokes.select(F.least("x", "h.x").alias("a"), F.greatest("x", "h.x").alias("b")).distinct(), tasks)
        found = _links(_signed(pairs, reps, percent, tasks).where("likely").select("a", "b"), sets, percent, tasks)
        if found.isEmpty():
            break
        groups = components(_stars(groups).unionByName(found))
    rows = mixed(classes)
    slim = rows.drop("slack")
    return groups, _met(slim, slim, ["c", "g"], percent, f"xa < xb and {_near('{}a', '{}b', percent)}")


def _stars(groups: DataFrame) -> DataFrame:
    return groups.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _rid(key, text):
    """The node of a row: its id; rows without one need a node of their own: negative, by their text."""
    return F.coalesce(key.cast("long"), -(F.abs(F.xxhash64(text.cast("string")) % F.lit(1 << 62)) + (1 << 61)))


def _decided(docs: DataFrame, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, n, component, kept) of each row."""
    text_batches(docs.sparkSession)
    texts = docs.select(_rid(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    feats = packed(texts.mapInArrow(feature_rows(percent, k), "rid long, id long, n long, fp binary, bands array<long>, sig binary"))
    reps = packed(
        feats.where("fp is not null").groupBy("fp").agg(F.min("rid").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    member = reps.select("node", "n", "copies", F.explode("bands").alias("band"))
    # A bucket's centre is its smallest set, of those the one with most copies.
    rank = F.col("n") * (1 << 20) - F.least("copies", F.lit((1 << 20) - 1))
    shared = member.groupBy("band").agg(F.count("*").alias("members"), F.min_by("node", rank).alias("c")).where("members > 1").select("band", "c")
    spokes = packed(member.join(shared, "band").where("node <> c").select("c", F.col("node").alias("x")).distinct())
    plain = texts.select("rid", "text")
    signed = _signed(spokes.toDF("a", "b"), reps, percent)
    likely = signed.where("likely").select("a", "b")
    links = _links(likely, _sets(likely.select(F.explode(F.array("a", "b")).alias("rid")), plain, k), percent)
    groups = _across(spokes, signed, components(links), reps, plain, percent, k)
    # Classes (equal sets) to components, then components to their smallest real id.
    classes = feats.where("fp is not null").groupBy("fp").agg(F.min("rid").alias("node"), F.min("id").alias("low"))
    classes = classes.join(_known(groups), "node", "left").select("fp", "low", F.coalesce("root", "node").alias("root"))
    names = classes.groupBy("root").agg(F.min("low").alias("component"))
    by_set = classes.join(names, "root").select("fp", "component", "root")
    found = feats.select("rid", "id", "n", "fp").join(by_set, "fp", "left")
    name = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component"))
    alone = F.col("fp").isNull() | F.col("component").isNull() & (F.col("rid") == F.col("root"))
    kept = F.when(F.col("id").isNull(), alone).otherwise(F.col("id").eqNullSafe(name))
    return found.select("rid", "id", "n", name.alias("component"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of docs.

    Documents whose sets of k-word shingles have 100 * intersection >= percent * union are linked. Equal sets
    are one class with one representative (the smallest id), so copies never meet in pairs. Representatives
    that share a band are compared with the smallest set of their bucket; members of one bucket that are then
    in different components are compared wherever they can be alike (see _across). Every link is confirmed on
    the full sets of 64-bit shingle fingerprints.

    Null or wordless texts: n_shingles 0, linked with nothing, kept. Rows that share an id are one document.
    A null id never names a component: such a row gets the smallest non-null id of its component, or null
    where all its component is without ids, of which one text is kept. Other columns of docs are ignored; an
    empty table gives no rows.
    """
    return _decided(docs, percent, k, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """docs without what near_duplicates doesn't keep; all columns stay as they are.

    Wordless and null texts stay. Rows without an id go where a row with one is like them; of a group without ids one
    text stays. Rows that share an id, or no id and a text, stay or go together. An empty table stays empty.
    """
    gone = packed(_decided(docs, percent, k, "doc_id", "text").where("not kept").select("rid").distinct())
    gone = small_side(gone, BROADCAST_ROWS)
    return docs.join(gone, _rid(docs["doc_id"], docs["text"]) == gone["rid"], "left_anti")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (
  SELECT s.doc_id, s.sh, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.c, s.sh) AS rk
  FROM s JOIN (SELECT sh, count(*) AS c FROM s GROUP BY sh) f USING (sh)),
prefix AS (SELECT r.doc_id, r.sh FROM rare r JOIN n USING (doc_id) WHERE r.rk <= n.n - CAST(ceil(0.85 * n.n - 0.000001) AS BIGINT) + 1),
cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.sh = b.sh AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)),
inter AS (
  SELECT c.a, c.b, count(*) AS i FROM cand c JOIN s p ON p.doc_id = c.a JOIN s q ON q.doc_id = c.b AND q.sh = p.sh GROUP BY c.a, c.b),
link AS (
  SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, e.b FROM reach r JOIN sym e ON e.a = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = d.doc_id
"""
