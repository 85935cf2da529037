"""Collocations, byte-level BPE and the audit of sources: brute force, a second implementation and odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard

from quern.llm import op11_phrases as phrases
from quern.llm import op12_bpe as bpe
from quern.llm import op13_audit as sources

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
KIND = "doc_id long, text string, lang string, source string, n_chars long, a array<int>, `a.b` string, term string, piece string, g int, k int"


def invented(n, seed=1, langs=("en", "de", None, ""), groups=7):
    """Rows with few words, so phrases repeat, copies, nulls and odd characters."""
    r = random.Random(seed)
    words = ["Of", "the", "THE", "new", "York", "é", "x y", "don't", "a_b", "9", "İ", "zz"] + [f"w{i}" for i in range(12)]
    rows = []
    for i in range(n):
        parts = [r.choice(words[:6]) if r.random() < 0.6 else r.choice(words) for _ in range(r.choice([0, 1, 5, 40]))]
        text = "".join(w + r.choice([" ", "  ", "\t", ". ", ", ", "\n", " ", " "]) for w in parts)
        rows.append((i, None if r.random() < 0.05 else text, r.choice(langs), r.choice([None, *(f"s{j}" for j in range(groups))]), 0))
    return rows + rows[: n // 5]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_phrases(rows, most, least, inside, first):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in candidates.items():
            score, _, left, right = min(((1_000_000 * a * a) // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            longer = (b for h, b in candidates.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))))
            if not any(100 * b >= inside * a for b in longer):
                rows.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize("most,least,first", [(3, 4, 2000), (4, 3, 15), (2, 5, 3)])
def test_phrases_by_brute_force(spark, monkeypatch, most, least, first):
    monkeypatch.setattr(phrases, "LONG_PIECE", 9)  # long pieces are parted, chunks are small
    monkeypatch.setattr(phrases, "CHUNK", 200)
    rows = invented(300)
    docs = spark.createDataFrame(rows, DOCS)
    found = phrases.collocations(docs.repartition(5), most, least, first=first)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows, most, least, 50, first)


def test_phrases_of_long_and_odd_texts(spark):
    rows = [(1, "b a " * 30_000, "en", None, 0), (None, "b a " * 10, "en", None, 0), (3, None, None, None, 0), (4, "", "de", None, 0), (5, " .\t! ", "fr", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute_phrases(rows, 3, 10, 50, 2000)
    assert phrases.collocations(docs.limit(0)).collect() == []
    wide = spark.createDataFrame([(*r, [1], "x", "y", "z", 1, 2) for r in rows[1:]], KIND)
    assert sorted(map(tuple, phrases.collocations(wide).collect())) == brute_phrases(rows[1:], 3, 10, 50, 2000)
    # products of counts beyond 64 bits
    parts = [phrases._section("é", np.array([1 << 62]), np.array([2]), b"ab"), phrases._section("", np.array([3, 4]), np.array([0, 1]), b"c")]
    found = [(lang, n.tolist(), g.to_pylist()) for lang, n, g in phrases._sections(zstandard.ZstdCompressor().compress(b"".join(parts)))]
    assert found == [("é", [1 << 62], ["ab"]), ("", [3, 4], ["", "c"])]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec()


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})


def test_perfect_hash(codec):
    slots = codec.hash(codec.tokens)
    assert sorted(slots.tolist()) == list(range(len(codec.tokens)))
    for n in (0, 1, 2, 7, 100):
        keys = [f"k{i}".encode() for i in range(n)]
        assert sorted(bpe.PerfectHash(keys)(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


def test_ids_are_those_of_the_library(codec, reference):
    r = random.Random(3)
    pool = [chr(i) for i in [*range(0x300), 0x558, 0x1C89, 0x10D4A, 0x11DE0, 0x3000, 0x2028, 0x1F600, 0x4E00, 0x323B0, 0x16EA0, 0xE000]]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["".join(r.choice("ab  \n'st1.") for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["", "a" * 6000, " " * 5000, "é" * 3000, "<|endoftext|>", "ab" * 3000 + "\n \n x", "don't we'll I'M"]
    assert [x.tolist() for x in codec.encode(texts)] == reference.encode_ordinary_batch(texts)


def test_windows_do_not_change_ids(codec, monkeypatch):
    texts = ["one two  three\n\n4 five's " * 50, "x", "", "yy zz " * 400]
    whole = [x.tolist() for x in codec.encode(texts)]
    monkeypatch.setattr(bpe, "WHOLE", 100)
    monkeypatch.setattr(bpe, "WINDOW", 17)
    assert [x.tolist() for x in codec.encode(texts)] == whole


def test_encode_and_decode_frames(spark, codec, reference):
    rows = [(1, "Some text.", "en", None, 0), (1, "Some text.", "en", None, 0), (None, "näh", None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0)]
    docs = spark.createDataFrame([(*r, [1], "x", "y", "z", 1, 2) for r in rows], KIND)
    got = bpe.decode(bpe.encode(docs, codec), codec).collect()
    want = [(i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in got), key=key) == sorted(want, key=key) and all(r["n_tokens"] * 4 == len(r["ids"]) for r in got)
    plain = bpe.encode(docs, codec, packed=False).where("doc_id = 1").first()
    assert plain["ids"] == reference.encode_ordinary("Some text.")
    assert bpe.decode(bpe.encode(docs.limit(0), codec), codec).collect() == []


def test_bpe_query(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {}
    for r in docs.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in bpe.op12_bpe(spark, "/root/testdata/sf0.001").collect()} == want


def brute_audit(rows, least, first):
    docs = [("" if x[2] is None else x[2], "" if x[3] is None else x[3], re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(x[1]))) for x in rows]
    groups, df, count = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang].add(source)
        df[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang, own in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        total = {s: sum(count[lang, s][t] for t in kept) for s in own}
        share = {s: {t: 1 + 10**9 * (count[lang, s][t] + 1) // (total[s] + v) for t in kept} for s in own}
        everything = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in own) + 1) // (sum(total.values()) + v) for t in kept}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in own:
            pairs = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in own if o != s)
            out += [(lang, s, "pair", o.decode(), -x, i) for i, (x, o) in enumerate(pairs, 1)]
            terms = sorted((-f(share[s][t], everything[t]), t.encode()) for t in kept if count[lang, s][t] and share[s][t] > everything[t])
            out += [(lang, s, "term", t.decode(), -x, i) for i, (x, t) in enumerate(terms[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize("heavy,side,cells", [(8, 256, 1 << 20), (2, 3, 64), (1, 2, 1), (1000, 5, 256)])
def test_audit_by_brute_force(spark, monkeypatch, heavy, side, cells):
    for name, value in (("HEAVY", heavy), ("SIDE", side), ("CELLS", cells), ("HELD", 40), ("SUMS", 5)):
        monkeypatch.setattr(sources, name, value)
    rows = invented(250, seed=heavy, groups=13)
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, sources.audit(docs.repartition(4), 3, 6).collect())) == brute_audit(rows, 3, 6)


def test_audit_of_odd_tables(spark):
    rows = [(1, "a b", "x", "s", 0), (2, None, "x", "t", 0), (3, "", "x", "t", 0), (4, "a a", "y", None, 0), (5, None, None, None, 0), (6, "b É b" * 2000, "z", "u", 0), (7, "b", "z", "u", 0), (7, "b", "z", "v", 0)]
    wide = spark.createDataFrame([(*r, [1], "x", "y", "z", 1, 2) for r in rows], KIND)
    assert sorted(map(tuple, sources.audit(wide).collect())) == brute_audit(rows, 3, 200)
    assert sources.audit(wide.limit(0)).collect() == []
    assert sorted(map(tuple, sources.audit(wide, 1).collect())) == brute_audit(rows, 1, 200)
