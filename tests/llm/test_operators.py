"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return df.selectExpr("*", "'x' AS id", "1 AS n", "2 AS size", "'y' AS component_id") if extra else df


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "Sigma", "tau,", "rho."]) + str(rng.randrange(60)) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 40, 120, 400])) for _ in range(25)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for k in range(40):  # near copies with one to six changed words
        ws = base[k % 6 + 5].split()
        for _ in range(rng.randrange(1, 7)):
            ws[rng.randrange(len(ws))] = f"new{rng.randrange(1000)}"
        rows.append((100 + k, " ".join(ws), "s0"))
    rows += [(200, base[4].upper(), "s1"), (201, None, None), (202, "", "s1"), (203, " \n\t", "s2"), (204, prose(rng, 30_000), "s2"), (5, base[5], "s2"), (None, base[7], None), (None, "only here and nowhere else at all", None)]
    return rows


def shingles(t):
    w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    from quern.llm.op2_minhash import near_duplicates

    rows = corpus()
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    want = []
    for a, (key, _, _) in enumerate(rows):
        ids = [k for b, (k, _, _) in enumerate(rows) if find(b) == find(a) and k is not None]
        name = min(ids) if ids else None
        want.append((key, len(sets[a]), name if sets[a] else key, key == (name if sets[a] else key)))
    got = [tuple(r) for r in near_duplicates(docs(spark, rows, extra=True), percent).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_of_a_family(spark, percent):
    """Copies of one text by edits from a small pool: most pairs share edits, links beside the original are near the threshold."""
    from quern.llm.op2_minhash import near_duplicates

    rng = random.Random(17)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    pool = [(4 * k + 2, f"e{k}") for k in range(36)]
    rows = [(0, " ".join(base), "s")]
    for k in range(1, 160):
        ws = list(base)
        for at, word in rng.sample(pool, rng.randrange(2, 7)):
            ws[at] = word
        rows.append((k, " ".join(ws), "s"))
    sets, root = {k: shingles(t) for k, t, _ in rows}, {k: k for k, _, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows), percent).collect()}
    assert got == {x: find(x) for x in sets}
    assert 1 < len(set(got.values())) < len(got)


def test_pairs_of_a_family_grow_as_its_rows(spark, monkeypatch):
    """Near copies by edits from a small pool: the pairs that are left after the rounds of centres."""
    from quern.llm import op2_minhash as module

    made, met = [], module._met

    def counted(one, two, on, percent, more):
        pairs = met(one, two, on, percent, more)
        if on == ["c", "g"]:
            made[-1] += pairs.count()
        return pairs

    monkeypatch.setattr(module, "_met", counted)
    for size in (150, 600):
        rng = random.Random(17)
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        pool, rows = [(4 * k + 2, f"e{k}") for k in range(36)], [(0, " ".join(base), "s")]
        for k in range(1, size):
            ws = list(base)
            for at, word in rng.sample(pool, rng.randrange(2, 7)):
                ws[at] = word
            rows.append((k, " ".join(ws), "s"))
        made.append(0)
        module.near_duplicates(docs(spark, rows), 80).count()
    assert made[1] <= 4 * max(made[0], size), made


def test_parity_sketches():
    """Sketches never differ in more places than the sets."""
    from quern.llm.op2_minhash import parities
    from quern.llm.shingles import stream

    rng = random.Random(19)
    for size in (1, 30, 400, 5000):
        a = stream(rng.randrange(1 << 30), size)
        b = np.unique(np.concatenate([a[rng.randrange(size) :], stream(rng.randrange(1 << 30), rng.randrange(60))]))
        unlike = sum(int(x).bit_count() for x in (parities(a) ^ parities(b)).view(np.uint64))
        assert unlike <= len(np.setxor1d(a, b)) and not (parities(a) ^ parities(a)).any()


def test_tokens_that_families_share(spark, monkeypatch):
    """Whatever two families of a bucket share stays, with maps that hold all bits as well."""
    from quern.llm import op2_minhash as module

    rng = random.Random(23)
    rows = []
    for c in range(6):
        for x in range(40):
            fam = 0 if x < 30 or c == 5 else rng.randrange(1, 4)
            rows.append((c, 100 * c + x, fam, 9, 3, sorted({rng.randrange(-300, 300) for _ in range(rng.randrange(8))}), False))
    rows.append((9, 1, 1, 9, 3, [], False))
    table = spark.createDataFrame(rows, "c long, x long, fam long, n long, i long, tokens array<long>, held boolean")
    shared = {(c, x, t) for c, x, f, _, _, ts, _ in rows for t in ts if any(d == c and g != f and t in us for d, _, g, _, _, us, _ in rows)}
    sizes = []
    for bits in (64, 4096):
        monkeypatch.setattr(module, "TOKEN_BITS", bits)
        got = {(r["c"], r["x"], t) for r in module._foreign(table).collect() for t in r["tokens"]}
        assert shared <= got <= {(c, x, t) for c, x, _, _, _, ts, _ in rows for t in ts}
        assert not any(c in (5, 9) for c, _, _ in got)
        sizes.append(len(got))
    assert sizes[1] < sizes[0]


def test_near_duplicates_of_nothing(spark):
    from quern.llm.op2_minhash import near_duplicates

    assert near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [1 << 16, 1])
def test_components(spark, monkeypatch, chunk):
    """chunk 1: no task holds all edges, so stars have to join what tasks have contracted."""
    from quern.llm import components as module
    from quern.llm.components import components

    monkeypatch.setattr(module, "CHUNK", chunk)
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    assert got == {x: find(x) for x in root}


def test_few_edges_and_small_tables_need_no_exchange(spark, monkeypatch):
    """Each exchange costs the driver a thread and a plan: near_dedup went over its memory by them."""
    from quern.llm import components as module
    from quern.llm.common import packed

    def no_round(edges):
        raise AssertionError("a round over edges that one task holds")

    monkeypatch.setattr(module, "_state", no_round)
    links = spark.createDataFrame([(5, 4), (4, 9), (9, 5), (2, 7), (3, 3), (None, 1)], "a long, b long").repartition(4)
    assert sorted(map(tuple, module.components(links).collect())) == [(2, 2), (4, 4), (5, 4), (7, 2), (9, 4)]
    assert module.components(links.limit(0)).collect() == []
    small = packed(spark.range(100).selectExpr("id % 7 AS k", "id AS v").repartition(4))
    both = small.join(packed(small.groupBy("k").count()), "k")
    assert "hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
    assert both.count() == 100


def overlaps(rows, items):
    """Brute force over all alignments: {(id, item): (best window, equal words, -offset)} and the texts that overlap."""
    from quern.llm.op6_seeds import MASKS, SHORT

    want, bad = {}, set()
    for key, text, _ in rows:
        d = (text or "").lower().split()
        for item, t in items:
            ws = (t or "").lower().split()
            masks = MASKS if len(ws) >= 13 else (*MASKS, SHORT)
            for off in range(-len(ws), len(d)) if len(ws) >= 6 and item is not None else ():
                lo, hi = max(0, -off), min(len(ws), len(d) - off)
                same = [ws[j] == d[j + off] for j in range(lo, hi)]
                span = min(13, len(ws))
                hit = any(all(same[s + j] for j, bit in enumerate(m) if bit == "1") for m in masks for s in range(len(same) - len(m) + 1))
                if not hit or len(same) < span:
                    continue
                best = max(sum(same[s : s + span]) for s in range(len(same) - span + 1))
                if 100 * best >= 80 * span:
                    want[key, item] = max(want.get((key, item), (0, 0, -(10**6))), (best, sum(same), -off))
                    bad.add((key, text))
    return want, bad


@pytest.mark.parametrize("places", [1 << 15, 7])
def test_decontamination(spark, monkeypatch, places):
    """places 7: texts are hashed in several parts, so masks run over their ends."""
    from quern.llm import op6_seeds as module
    from quern.llm.op6_seeds import contaminated, decontaminate

    monkeypatch.setattr(module, "PLACES", places)
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 10, 25, 50])))) for i in range(12)] + [(90, "two words"), (91, None), (None, "w1 w2 w3 w4 w5 w6 w7")]
    rows = []
    for k in range(60):
        ws = [f"w{rng.randrange(300)}" for _ in range(80)]
        if k % 2:
            planted = items[k % 12][1].upper().split()
            for _ in range(k % 12):
                planted[rng.randrange(len(planted))] = "changed"
            at = rng.choice([0, 5, 70])
            ws[at : at + len(planted)] = planted
        rows.append((k, " ".join(ws), "s"))
    rows += [(None, items[0][1], "s"), (None, "a text of its own without an id", "s"), (300, None, "s"), (301, "", "s"), rows[1], (0, items[1][1], "s")]
    want, bad = overlaps(rows, items)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["window_matches"], r["aligned_matches"], -r["offset"]) for r in contaminated(docs(spark, rows, extra=True), table).collect()}
    assert got == want and want
    left = decontaminate(docs(spark, rows), table)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted([(r["doc_id"], r["text"]) for r in left.collect()], key=str) == sorted([(k, t) for k, t, _ in rows if (k, t) not in bad], key=str)


def test_decontamination_of_short_items(spark):
    """Items of 6 to 12 words are found with every substitution that their share allows."""
    from quern.llm.op6_seeds import contaminated

    items, rows = [], []
    for n in range(6, 13):
        ws = [f"i{n}x{j}" for j in range(n)]
        items.append((n, " ".join(ws)))
        for a in range(n):
            for b in range(a, n if n >= 10 else a + 1):
                rows.append((len(rows), "lead " + " ".join("other" if j in (a, b) else w for j, w in enumerate(ws)) + " tail", str(n)))
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, int(n)) for k, _, n in rows}


def test_decontamination_of_long_items(spark):
    """A verbatim item of 5,000 words takes seconds: an alignment is verified once."""
    import time

    from quern.llm.op6_seeds import contaminated, decontaminate

    text = " ".join(f"v{i * 7919 % 4001}" for i in range(5000))
    table, began = spark.createDataFrame([(1, text)], "item_id long, text string"), time.time()
    got = contaminated(docs(spark, [(3, text, "s"), (4, "quite " + text, "s"), (5, "clean", "s")]), table).collect()
    assert sorted((r["doc_id"], r["aligned_matches"], r["offset"]) for r in got) == [(3, 5000, 0), (4, 5000, 1)] and time.time() - began < 30
    none = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs(spark, []), table).count() == 0 and decontaminate(docs(spark, [(1, "a", "s")]), none).count() == 1


def line_chunks(text):
    """Chunks by the definition, stated anew: a boundary where the hash of the two lines up to it, as one number, has the right remainder."""
    import xxhash

    lines = text.split("\n")
    h = [xxhash.xxh3_64_intdigest(x.encode()) for x in lines]
    many = [len(x.split()) >= 50 for x in lines]
    out, held = [], []
    for i in range(len(lines)):
        if many[i]:
            out += [held] if held else []
            out, held = [*out, [i]], []
            continue
        held.append(i)
        window = (h[i] + (h[i - 1] * 0x9E3779B97F4A7C15 if i else 0)) % 2**64
        if len(held) >= 2 and ((window >> 32) % 3 == 0 or len(held) >= 16):
            out, held = [*out, held], []
    return [["\n".join(lines[i] for i in c), len(c)] for c in [*out, *([held] if held else [])]]


def deduplicated(rows):
    """(id, rest of the text) of each row, by brute force over the chunks of all texts."""
    may = lambda part, n: bool(part.split()) and (n > 1 or len(part.split()) >= 50)
    rank, seen, out = lambda key, text: (key is None, key or 0, signed_hash(text)), {}, []
    for key, text, _ in rows:
        for i, (part, n) in enumerate(line_chunks(text or "")):
            if may(part, n):
                seen.setdefault(part, set()).add((rank(key, text), i))
    for key, text, _ in rows:
        kept = [p for i, (p, n) in enumerate(line_chunks(text or "")) if not may(p, n) or min(seen[p]) == (rank(key, text), i)]
        out.append((key, None if text is None else "\n".join(kept)))
    return out


def signed_hash(text):
    """Spark's xxhash64 of a text, which orders rows that share an id."""
    import xxhash

    return 0 if text is None else np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).astype(np.int64).item()


def test_line_dedup(spark):
    from quern.llm.op10_lines import line_dedup, without_repeats

    rng = random.Random(2)
    line = lambda: " ".join(f"x{rng.randrange(10_000)}" for _ in range(rng.choice([2, 8, 15])))
    shared, long_line = [line() for _ in range(14)], " ".join(f"long{i}" for i in range(60))
    rows = []
    for k in range(30):
        ls = [line() for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(ls) + 1)
        ls[at:at] = shared if k % 3 == 0 else [long_line] if k % 3 == 1 else []
        rows.append((k, "\n".join(ls), "s"))
    rows += [(50, None, "s"), (51, "", "s"), (None, "\n".join(shared), "s"), (None, "\n".join([*shared, "end"]), "s"), (52, "\n\n\n\n", "s"), (53, "\n\n\n\n", "s"), rows[0]]
    # Rows that share an id but not the text: what is unique stays.
    rows += [(60, "alpha beta\ngamma delta", "s"), (61, "alpha beta\ngamma delta", "s"), (61, "unique one\nunique two", "s"), (3, "other text\nof its own", "s")]
    want = deduplicated(rows)
    got = [(r["doc_id"], r["text"]) for r in without_repeats(docs(spark, rows, extra=True)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(long_line in (t or "") for _, t in got) == 1 and (61, "unique one\nunique two") in got and (61, "") in got
    again = line_dedup(docs(spark, rows))
    assert again.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted([(r[0], r[1]) for r in again.collect()], key=str) == sorted(want, key=str)
    clash = docs(spark, rows).selectExpr("1 AS n_lines", "doc_id", "2 AS n_chunks", "text", "3 AS removed_lines", "4 AS _at", "5 AS gone_at", "'z' AS c1", "6 AS `a.b`", "lang", "7 AS th")
    out = line_dedup(clash)
    assert out.columns == clash.columns and out.dtypes == clash.dtypes
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str) == sorted(want, key=str) and {(r["n_lines"], r["a.b"], r["c1"], r["th"]) for r in out.collect()} == {(1, 6, "z", 7)}
    assert without_repeats(docs(spark, [])).count() == 0 and line_dedup(docs(spark, [])).count() == 0


def test_chunks_resist_shifts():
    """Lines put in before a passage move no boundary but those next to it; boundaries are as stated."""
    from quern.llm.op10_lines import chunks

    rng = random.Random(31)
    for _ in range(50):
        lines = [f"line {rng.randrange(10**6)}" for _ in range(60)]
        text, shifted = "\n".join(lines), "\n".join([f"new {i}" for i in range(rng.randrange(1, 9))] + lines)
        for t in (text, shifted):
            ls = t.split("\n")
            assert [["\n".join(ls[a:b]), b - a] for a, b in chunks(t.encode())] == line_chunks(t)
        ends = lambda t: {t.split("\n")[b - 1] for _, b in chunks(t.encode())}
        assert len(ends(text) - ends(shifted)) <= 3


def test_line_runs(spark):
    from quern.llm.op10_lines import line_dedup, without_repeats

    rng, n = random.Random(12), iter(range(10**6))
    line = lambda k: " ".join(f"y{next(n)}" for _ in range(k))
    shared = [[line(k) for k in ks] for ks in ([30, 25], [49, 1], [20, 20, 20], [30, 30, 5], [5, 0, 45, 4], [9] * 12, [1] * 70, [10, 60], [60, 10, 10])]
    rows = []
    for k in range(60):
        blocks = [[line(rng.choice([0, 2, 8, 15]))] for _ in range(rng.randrange(6))]
        for _ in range(k % 3):  # whole: a part of under 50 words could be a chunk that goes too
            blocks.insert(rng.randrange(len(blocks) + 1), rng.choice(shared))
        rows.append((k, "\n".join(x for b in blocks for x in b), "s"))
    rows += [(70, "\n".join([line(49)] * 3), "s"), (71, "\n".join([*shared[0], "between", *shared[0]]), "s"), (72, "\n".join([*shared[1], *shared[2]]), "s"), (None, rows[2][1], "s"), (73, None, "s"), (74, "", "s"), rows[5]]

    def stretches(text):
        ls = (text or "").split("\n")
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if ls[a].split() and ls[b - 1].split() and sum(len(x.split()) for x in ls[a:b]) >= 50:
                    yield a, b, "\n".join(ls[a:b])

    first, want = {}, []
    place = lambda key, text: (key is None, key or 0, signed_hash(text))
    for key, text, _ in rows:
        for a, _, part in stretches(text):
            first[part] = min(first.get(part, ((True, 10**9, 0), 0)), (place(key, text), a))
    for key, text, _ in rows:
        gone = set()
        for a, b, part in stretches(text):
            k, at = first[part]
            if k != place(key, text) or a >= at + b - a:
                gone.update(range(a, b))
        want.append((key, None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)))
    got = without_repeats(docs(spark, rows), runs=True).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=str) == sorted(want, key=str)
    assert sorted([(r[0], r[1]) for r in line_dedup(docs(spark, rows), runs=True).collect()], key=str) == sorted(want, key=str)


def test_mix(spark):
    from quern.llm.op7_mix import mixed

    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50, 200])), f"s{min(rng.randrange(9), 4)}") for i in range(3000)] + [(5000, None, None), (5001, "one two", None), (None, "a b c", "s1"), (7, "x y", "s9")]
    out = mixed(docs(spark, rows), leaf=64)
    got = out.collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight, total = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values())
    full, target = set(), {}
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 200
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixed(docs(spark, rows).repartition(7), leaf=64).collect()))
    assert mixed(docs(spark, [])).count() == 0


def test_pivotal_keeps_means():
    from quern.llm.op7_mix import pivotal

    rng = np.random.default_rng(1)
    size, p, n = rng.integers(1, 50, 40), np.full(40, 0.3), 3000
    sums = np.zeros(40)
    for _ in range(n):
        q, held = pivotal(p, size, rng.random(40))
        assert abs((q * size).sum() - (p * size).sum()) < 1e-6 and sum(0 < x < 1 for x in q) == (held >= 0)
        sums += q
    assert np.abs(sums / n - 0.3).max() < 0.05


def test_quality(spark):
    from quern.llm.op5_quality import accept, scored

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words) if good else " ".join(w + "%%%" for w in words), "s"))
        labels.append((i, int(good), 0))
    labels += [(None, 1, 0), (1, 1 - labels[1][1], 0), (2, None, 0)]
    rows += [(900, None, "s"), (901, "", "s"), (None, "w1 w2", "s"), rows[3]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = scored(docs(spark, rows, extra=True), table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], labels[r["doc_id"]][1]) for r in got if r["held_out"] and r["doc_id"] is not None and 2 < r["doc_id"] < 400]
    assert np.mean([a == b for a, b in held]) > 0.95
    kept = accept(docs(spark, rows), table)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == sum(r["predicted"] for r in got)
    assert scored(docs(spark, []), table.limit(0)).count() == 0
    assert scored(docs(spark, rows[:3]), table.limit(0)).count() == 3


def test_media(spark):
    from quern.llm import op4_media as m

    rows = [(1, "abc", "s"), (2, None, "s"), (3, "é" * 96, "s"), (4, "x" * 193, "s"), (None, "abc", "s")]
    got = {r["id"]: r for r in m.text_images(docs(spark, rows, extra=True)).collect()}
    for key, text, _ in rows:
        data = (text or "").encode()
        want = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert m.decode(bytes(got[key]["media"])).tobytes() == want and got[key]["n_bytes"] == len(data)
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (7, 5), (40, 33)):
        p = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert np.array_equal(m.decode(m.encode_bmp(p)), p) and np.array_equal(m.decode(m.encode_ppm(p)), p)
        a, b = 4, 3
        want = np.zeros((a, b, 3))
        for i in range(a):
            for j in range(b):
                y = np.clip(np.minimum((i + 1) * h / a, np.arange(h) + 1) - np.maximum(i * h / a, np.arange(h)), 0, None)
                x = np.clip(np.minimum((j + 1) * w / b, np.arange(w) + 1) - np.maximum(j * w / b, np.arange(w)), 0, None)
                want[i, j] = np.einsum("i,j,ijc->c", y, x, p.astype(float)) * a * b / (h * w)
        assert np.abs(m.area_resize(p, a, b).astype(float) - want).max() <= 0.51
    assert m.decode(b"P2 # c\n2 1\n15\n0 15\n").ravel().tolist() == [0, 255] and m.decode(b"P1\n2 1\n1 0\n").ravel().tolist() == [0, 255]
    assert [m.decode(x) for x in (None, b"", b"P6\n9 9\n255\nxx", b"BM", b"hello")] == [None] * 5
    out = m.media_columns(spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "k long, b binary"), "k", "b").collect()
    assert [r["tile"] for r in out] == [None, None]


def test_licenses(spark):
    from quern.llm.op3_license import TEMPLATES, align, license_spans

    rng = random.Random(6)
    noise = lambda n: " ".join(rng.choice(["the", "of", "and", "in", "qux", "zap", "license"]) for _ in range(n))
    mit = TEMPLATES["MIT"].replace("substantial ", "")
    rows = [(1, f"{noise(300)} {mit} {noise(50)}", "s"), (2, "Released under the MIT License. Released under the MIT License.", "s"), (3, noise(3000), "s"), (4, None, "s"), (5, "", "s"), (6, "x\nLicensed under CC BY-NC 4.0.\ny", "s")]
    got = {}
    for r in license_spans(docs(spark, rows, extra=True)).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["start_word"]))
    assert got == {1: [("MIT", 300)], 2: [("MIT-short", 0), ("MIT-short", 5)], 6: [("CC-BY-NC-4.0-short", 1)]}
    for _ in range(200):  # pairs are equal words and rise in both
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(12))] for _ in "ab")
        found = align(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_null_instruction(spark):
    from quern.llm.op9_chat import canonical_turns

    rows = [(1, '{"instruction": null, "input": "in", "output": "out"}'), (2, '{"instruction": "do", "input": "in", "output": "out"}'), (3, '{"instruction": null, "input": null, "output": "out"}')]
    got = {r["k"]: (r["layout"], r["turns"][0]["text"]) for r in canonical_turns(spark.createDataFrame(rows, "k long, record string")).collect()}
    assert got == {1: ("instruction_input", "\n\nin"), 2: ("instruction_input", "do\n\nin"), 3: ("instruction_input", "")}


def test_adjacent_licenses():
    from quern.llm.op3_license import COVERAGE, TEMPLATES, Scanner, tokens

    rng, scan = random.Random(3), Scanner(TEMPLATES, COVERAGE)
    for name in ("Apache-2.0", "BSD-2-Clause", "GPL-3.0", "ISC", "MIT"):
        words = tokens(TEMPLATES[name])
        for copies in (2, 3, 4, 6):
            for parted in (0, 3):
                text = " ".join([" ".join(words + ["qux"] * parted)] * copies)
                assert [x[:4] for x in scan(text)] == [(name, i * (len(words) + parted), i * (len(words) + parted) + len(words), len(words)) for i in range(copies)]
        for _ in range(20):  # one word of each copy but its ends changed
            notices = [[*words] for _ in range(rng.randrange(3, 7))]
            for ws in notices:
                ws[rng.randrange(1, len(ws) - 1)] = "qux"
            got = scan(" ".join(w for ws in notices for w in ws))
            # A notice may lend a word to its neighbour where that lacks it; each is found for itself.
            assert [(x[0], (x[1] + x[2]) // 2 // len(words)) for x in got] == [(name, i) for i in range(len(notices))]


def test_warc(spark, tmp_path):
    from quern.llm.op8_warc import read_archives, write_archives

    rows = [(i, f"http://h/{i}\r\nX: y é" if i % 7 else None, f"<p>{i % 10}</p>" * (i % 10 + 1)) for i in range(400)] + [(1000, "u", None), (1001, "u", ""), (None, "u", "<p>0</p>"), (10**12, "u", "far" * 1000), (10**12, "u", "far" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS shard", "2 AS digest")
    files = []
    for k in range(2):
        top = str(tmp_path / f"a{k}")
        m = write_archives(pages.repartition(3 + 2 * k), top, shard_bytes=900, file_bytes=2000)
        files.append(sorted((r["file"], r["sha1"], r["records"]) for r in m.collect()))
    assert files[0] == files[1] and len(files[0]) > 5 and sum(f[2] for f in files[0]) == len(rows)
    top_of = {}
    for i, _, h in rows:
        if i is not None:
            top_of[h or ""] = max(i, top_of.get(h or "", -1))
    want = []
    for i, _, h in rows:
        data, t = (h or "").encode(), top_of[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == t else "revisit", None if i == t else t, data if i == t else None))
    back = read_archives(spark, top)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in back.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    empty = str(tmp_path / "none")
    write_archives(pages.limit(0), empty)
    assert read_archives(spark, empty).count() == 0


def test_chats(spark):
    from pyspark.sql import functions as F

    from quern.llm.op9_chat import CONTROL, ESCAPE, canonical_turns, formatted, gathered, loss_text, turns_of

    texts = ["plain", "", None, ESCAPE, ESCAPE * 3, *CONTROL, "<" + ESCAPE + "/s>", "<<s>s>", "a<|end|><|turn|>x<|text|>y", "[[INST]" + ESCAPE, "🙂</s>é" * 50]
    rows = [(c, t, "assistant" if (c + t) % 2 else "user", texts[(c * 3 + t) % len(texts)]) for c in range(20) for t in range(6)] + [(None, 0, None, "x"), (30, None, "user", "n"), (30, 1, "assistant", "m"), (30, 1, "assistant", "m")]
    chats = formatted(canonical_turns(gathered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS v", "2 AS record"))))
    got = {r["conv_id"]: r for r in chats.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, role or "", text or "") for k, t, role, text in rows if k == c))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(b, x) for _, b, x in own]
        assert got[c]["learnt"] == "".join(x for _, b, x in own if b == "assistant")
        bare = got[c]["formatted"]
        assert not any(m in bare for m in CONTROL[3:]) and bare.count("<|end|>") == len(own)
    js = ['{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', '{"instruction":"a","output":"b"}', '{"instruction":"a","input":"c","output":"b"}',
          '{"prompt":"a","completion":"b"}', '{"question":"a","answer":"b"}', '{"messages":[]}', '{"other":1}', "not json", None]
    out = {r["k"]: r for r in canonical_turns(spark.createDataFrame(list(enumerate(js)), "k long, record string")).collect()}
    turns = lambda k: out[k]["turns"] and [tuple(t) for t in out[k]["turns"]]
    assert all(turns(k) == [("user", "a"), ("assistant", "b")] for k in (0, 1, 2, 4, 5)) and turns(3)[0] == ("user", "a\n\nc") and out[6]["turns"] == []
    assert all(out[k]["layout"] is None and out[k]["turns"] is None for k in (7, 8, 9))


def test_urls(spark):
    from quern.llm.op1_urls import judged, likelihoods

    cases = [("http://A.Example.COM/en/7x", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"), ("x://net/de/1?q", "net", "/de/1", "net/de/", "allow"),
             ("http://example.net/de/88#a", "example.net", "/de/88", "example.net/de/8", "block"), ("http://myexample.com/en/7", "myexample.com", "/en/7", "com/en/", "block"), ("http://h?x", "h", "", None, None), ("no scheme/en/", "", "", None, None), (None, "", "", None, None)]
    rows = [(i, u) for i, (u, *_) in enumerate(cases)] + [(100 + i, f"http://spam{i % 9}.com/en/buy{i}") for i in range(300)] + [(500 + i, f"http://good.net/de/read{i}") for i in range(300)] + [(900, "http://spam1.info/buy55"), (901, "http://good.info/read7"), (None, "http://h?x")]
    got = {r["page_id"]: r for r in judged(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS score")).collect()}
    assert len(got) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule) and (verdict is None or got[i]["verdict"] == verdict)
    assert got[900]["verdict"] == "block" and got[901]["verdict"] == "allow"
    assert judged(spark.createDataFrame([], "page_id long, url string")).count() == 0
    # Chances of what may follow a context add up to at most one.
    table = spark.createDataFrame([("ab", 3, 1), ("ac", 1, 0), ("bb", 0, 2), ("bc", 2, 2)], "gram string, a long, b long")
    assert {r["gram"] for r in likelihoods(table, 1).collect()} == {"ab", "ac", "bb", "bc"}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    top = str(tmp_path)
    # Rows that share an id are one document and stay together; here each id stands once.
    rows = list({r[0]: r for r in corpus(8) if r[0] is not None}.values())
    docs(spark, rows).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, rows[12][1])], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    current = spark.read.parquet(f"{top}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, top)
        assert current.columns == list(corpus_pipeline.COLUMNS), name
    out = corpus_pipeline.run(spark, top)
    assert out.count() == out.select("doc_id").distinct().count() and 12 not in {r["doc_id"] for r in out.collect()}


def test_licenses_from_every_start():
    """Planted notices, edited, glued, nested in noise or back to back: each is found about where it stands, and nothing else."""
    from quern.llm.op3_license import COVERAGE, TEMPLATES, Scanner, align, core, tokens

    rng, scan = random.Random(23), Scanner(TEMPLATES, COVERAGE)
    common = sorted({w for t in TEMPLATES.values() for w in tokens(t)} & set("the of and or to in any this is for a software license".split()))
    long = [n for n in TEMPLATES if not n.endswith("short")]
    for trial in range(60):
        words, want = [rng.choice([*common, "qux", "zap"]) for _ in range(rng.randrange(12))], []
        for _ in range(rng.randrange(1, 6)):
            name = rng.choice(long) if trial % 2 else long[trial % len(long)]
            own = tokens(TEMPLATES[name])
            for _ in range(rng.randrange(len(own) // 12)):  # substitutions, a gap, an insertion
                at = rng.randrange(1, len(own) - 1)
                own[at : at + 1] = rng.choice([["qux"], [], [own[at], "zap"]])
            want.append((name, len(words), len(words) + len(own)))
            words += own + ["qux"] * rng.choice([0, 0, 3])
        got = scan(" ".join(words))
        assert [x[0] for x in got] == [x[0] for x in want], (trial, got, want)
        assert all(abs(g[1] - w[1]) <= 12 and abs(g[2] - w[2]) <= 12 for g, w in zip(got, want)), (trial, got, want)
    mit = TEMPLATES["MIT"]
    for text, copies in (("the " + mit + mit, 2), (mit * 5, 5), (f"the {mit} {mit}", 2), (f"{mit} {TEMPLATES['ISC']} {mit}", 3)):
        assert len(scan(text)) == copies
    # The core of an alignment is the stretch with the best score of all stretches.
    for _ in range(200):
        a, b = ([rng.choice("abcdefghijklm") for _ in range(rng.randrange(30))] for _ in "ab")
        pairs = align(a, b)
        value = lambda p: len(p) - 0.25 * sum(x[0] - y[0] + x[1] - y[1] - 2 for x, y in zip(p[1:], p)) if p else 0
        assert value(core(pairs)) == max([value(pairs[i:j]) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1)], default=0)


def test_licenses_of_nothing(spark):
    from quern.llm.op3_license import license_spans

    assert license_spans(docs(spark, [])).count() == 0
    assert license_spans(docs(spark, [(None, "Released under the MIT License.", "s"), (None, None, "s")], extra=True)).count() == 1


def test_urls_against_brute_force(spark):
    """Counts, smoothing, scores, threshold and verdicts stated anew, over all URLs."""
    import math

    import xxhash

    from quern.llm.op1_urls import judged

    rng = random.Random(77)
    urls = [f"http://{rng.choice(['a', 'bb', 'shop'])}{rng.randrange(9)}.{rng.choice(['com', 'net', 'info'])}/{rng.choice(['en', 'de'])}/{rng.choice(['buy', 'read'])}{rng.randrange(40)}" for _ in range(500)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(900, None), (901, ""), (902, "no scheme"), (None, urls[3])]
    texts = [u or "" for _, u in rows]

    def label(u):
        if "://" not in u:
            return None
        host, _, path = u.split("://", 1)[1].lower().partition("/")
        return 0 if host.endswith(".com") and path.startswith("en/") else 1 if host.endswith(".net") and path.startswith("de/") else None

    held = lambda u: np.uint64(xxhash.xxh64_intdigest(u.encode(), seed=42)).astype(np.int64).item() % 10 == 0
    places = lambda u: [("\x02" * 4 + u.lower() + "\x03")[i : i + 5] for i in range(len(u) + 1)]
    counts = {0: {}, 1: {}}  # by label: the times that each string of up to five characters ends a place
    for u in texts:
        y = label(u)
        if y is not None and not held(u):
            for g in places(u):
                for k in range(1, 6):
                    counts[y][g[-k:]] = counts[y].get(g[-k:], 0) + 1
    follows = {y: {} for y in counts}
    for y, c in counts.items():
        for s, n in c.items():
            total, kinds = follows[y].get(s[:-1], (0, 0)) if len(s) > 0 else (0, 0)
            follows[y][len(s), s[:-1]] = (follows[y].get((len(s), s[:-1]), (0, 0))[0] + n, follows[y].get((len(s), s[:-1]), (0, 0))[1] + 1)

    def chance(y, g):
        p = 1 / 256
        for k in range(1, 6):
            total, kinds = follows[y].get((k, g[-k:][:-1]), (0, 0))
            if total:
                p = (counts[y].get(g[-k:], 0) + kinds * p) / (total + kinds)
        return p

    score = {u: round(sum(math.log(chance(1, g)) - math.log(chance(0, g)) for g in places(u)) / len(places(u)), 9) for u in set(texts)}
    cut_at, best = 0.0, 1.0
    judges = [(math.floor(min(max(score[u], -2), 1.999) * 100), label(u)) for u in texts if label(u) is not None and held(u)]
    good, bad = sum(y for _, y in judges), sum(1 - y for _, y in judges)
    assert good and bad
    for b in sorted({b for b, _ in judges}):
        rate = sum(y for x, y in judges if x > b) / good + sum(1 - y for x, y in judges if x <= b) / bad
        if rate > best + 1e-12:
            best, cut_at = rate, (b + 1) / 100
    got = judged(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        u = text[r["page_id"]] or ""
        assert abs(r["score"] - score[u]) < 1e-6
        if label(u) is not None:
            assert r["verdict"] == ("allow" if label(u) else "block")
        elif abs(score[u] - cut_at) > 1e-6:
            assert r["verdict"] == ("allow" if score[u] >= cut_at else "block"), u
    # Chances of all that may follow a context add up to at most one.
    seen = {g[-1] for u in texts for g in places(u)}
    assert all(sum(chance(y, ctx + x) for x in seen) <= 1 + 1e-9 for y in (0, 1) for ctx in ("http", "://a", "zzzz", ".com"))


def test_media_digests(spark, tmp_path):
    """The query's rows by hashlib and zlib, from the texts."""
    from quern.llm import op4_media as m

    rows = [(1, "abc", "s"), (2, None, "s"), (3, "", "s"), (4, "é" * 96, "s"), (5, "x" * 193, "s"), (6, "🙂 long " * 30_000, "s"), (7, "abc", "t")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in m.op4_media(spark, str(tmp_path)).collect()}
    stored = {r["id"]: bytes(r["media"]) for r in m.text_images(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for key, text, _ in rows:
        data = (text or "").encode()
        payload = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        r, media = got[key], stored[key]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert media.startswith(b"P6") and media.endswith(payload) and len(media) < len(payload) + 30
        width, height = map(int, re.match(rb"P6\s+(\d+)\s+(\d+)\s+255\s", media).groups())
        grey = np.frombuffer(payload, np.uint8).reshape(height, width, 3)
        assert r["feature"] == m.difference_hash(grey) and r["tile_sha256"] == hashlib.sha256(m.npy(m.area_resize(grey, m.TILE, m.TILE))).hexdigest()
    assert got[1]["feature"] == got[7]["feature"] and got[1]["media_sha256"] == got[7]["media_sha256"]


def test_dual_descent():
    """Against projected gradients on the dual, run long: the same objective and weights."""
    from quern.llm.op5_quality import dual_descent

    rng = np.random.default_rng(3)
    for c in (0.3, 1.0):
        n, dim = 40, 25
        rows = [np.sort(rng.choice(dim, 6, replace=False)).astype(np.int32) for _ in range(n)]
        values, y = [rng.normal(size=6) for _ in range(n)], np.sign(rng.normal(size=n))
        x = np.zeros((n, dim + 1))
        for i, (r, v) in enumerate(zip(rows, values)):
            x[i, r], x[i, dim] = v, 1
        q = (x * y[:, None]) @ (x * y[:, None]).T
        a, step = np.zeros(n), 1 / np.linalg.eigvalsh(q)[-1]
        for _ in range(50_000):
            a = np.clip(a + step * (1 - q @ a), 0, c)
        want = (a * y) @ x
        w, bias = dual_descent(rows, values, y, dim, c, epochs=20_000, least=1e-9)
        value = lambda u: u @ u / 2 + c * np.maximum(0, 1 - y * (x @ u)).sum()
        assert abs(value(np.append(w, bias)) - value(want)) < 1e-4 and np.abs(np.append(w, bias) - want).max() < 1e-3
        rough = value(np.append(*dual_descent(rows, values, y, dim, c)))
        assert value(want) - 1e-6 <= rough <= 1.02 * value(want)


def test_log_count_ratios(spark):
    """Of all labelled rows outside the held-out fifth, by brute force."""
    from quern.llm.op5_quality import Featurizer, fit

    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" + ("!" if i % 3 else "") for _ in range(rng.randrange(1, 30))), "s") for i in range(200)]
    labels = [(i, int(i % 3 > 0)) for i in range(150)] + [(3, 1), (160, None), (None, 1)]
    model, f = fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")), Featurizer()
    good, bad = np.ones(f.dimensions), np.ones(f.dimensions)
    for i, text, _ in rows[:150]:
        if i != 3 and zlib.crc32(str(i).encode()) % 5:
            (good if i % 3 else bad)[f(text.encode())] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    assert np.allclose(model.squares, ratio * ratio)


def test_chat_layouts(spark):
    """Conversations come in several layouts, and columns keep their names and values."""
    from quern.llm.op9_chat import STEP, canonical_turns, formatted, gathered

    kinds = {1: ["user", "assistant"], 2: ["system", "user", "assistant"], 3: ["user", "assistant", "user"], 4: ["tool", "assistant"], 5: ["assistant"], 6: ["user", "assistant"] * (STEP + 7)}
    rows = [(c, i, r, f"t{i}" * (i % 5)) for c, rs in kinds.items() for i, r in enumerate(rs)]
    out = canonical_turns(gathered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert {r["conv_id"]: r["layout"] for r in out.collect()} == {1: "prompt_response", 2: "system_prompt", 3: "dialogue", 4: "messages", 5: "dialogue", 6: "dialogue"}
    for r in formatted(out).collect():
        at, want = 1, []
        for i, role in enumerate(kinds[r["conv_id"]]):
            head, body = len("<|turn|>") + len(role) + len("<|text|>"), len(f"t{i}" * (i % 5))
            want += [(at + head, body)] if role == "assistant" else []
            at += head + body + len("<|end|>")
        assert [tuple(s) for s in r["loss"]] == want and len(r["formatted"]) == at - 1
    clash = spark.createDataFrame([(1, '{"prompt": "a", "response": "b"}')], "k long, record string").selectExpr("k", "record", "7 AS v", "8 AS c0", "9 AS row", "10 AS layout", "11 AS parts0", "12 AS `x.y`")
    got = formatted(canonical_turns(clash)).collect()[0]
    assert (got["v"], got["c0"], got["row"], got["parts0"], got["x.y"], got["layout"]) == (7, 8, 9, 11, 12, "prompt_response") and got["formatted"].startswith("<|turn|>user<|text|>a")
    empty = gathered(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty.count() == 0 and formatted(canonical_turns(empty)).count() == 0
    none = formatted(canonical_turns(spark.createDataFrame([(1, '{"messages": []}'), (2, "no")], "k long, record string"))).orderBy("k").collect()
    assert none[0]["formatted"] == "" and none[0]["loss"] == [] and none[1]["formatted"] is None and none[1]["loss"] is None


def test_shard_bounds(spark):
    """By running sums over the sorted ids, however the table is split."""
    from quern.llm.op8_warc import bounds

    rng = random.Random(41)
    rows = [(rng.randrange(-500, 500) * 10**15, b"x" * rng.randrange(60)) for _ in range(700)] + [(None, b"none")]
    sizes = {}
    for i, p in rows:
        if i is not None:
            sizes[i] = sizes.get(i, 0) + len(p)
    want, total, held = [], 0, -1
    for i in sorted(sizes):
        if total // 400 != held:
            want.append(i)
            held = total // 400
        total += sizes[i]
    d = spark.createDataFrame(rows, "page_id long, payload binary")
    assert bounds(d.repartition(7), 400) == bounds(d, 400) == want and bounds(d.limit(0), 400) == []


def test_targets_of_many_sources(spark):
    from quern.llm.op7_mix import targets

    rng = random.Random(6)
    sizes = {f"s{k:04d}": int(10 ** rng.uniform(0, 5)) for k in range(1500)}
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight, total, full = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}, sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        over = {s for s in sizes if s not in full and 3 * sizes[s] < level * weight[s]}
        if not over:
            break
        full |= over
    assert full and all(abs(got[s] - min(3 * sizes[s], level * weight[s])) < 1e-6 for s in sizes)
