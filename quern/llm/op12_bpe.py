"""Byte-level BPE of whole texts: a minimal perfect hash for pre-tokens of the vocabulary, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_batches
from .shingles import splitmix

_U = np.uint64
#: Keys a bucket of the perfect hash holds on average; pre-tokens that are resolved at once; characters of a text that is split at once;
#: remembered misses, twice; bytes of a pre-token whose links are lists.
BUCKET, WINDOW, WHOLE, REMEMBERED, SHORT = 4, 1 << 18, 1 << 22, 300_000, 4096

#: Letters and numbers that `regex` knows and the tables of Unicode 16 don't, as ranges of code points.
NEWER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 "
    "16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


#: Fixed value: the first code point of NEWER_LETTERS.
NEWER = "\u0558"


def compiled(pattern: str) -> tuple[re.Pattern, regex.Pattern, regex.Pattern]:
    """The pattern for ASCII texts, for texts without code points from NEWER on, and for any: there \\p{L} and \\p{N} are those of Unicode 16, which the library that defines the ids goes by."""

    def without(kind: str, newer: str) -> str:
        return rf"[\p{{{kind}}}--[" + "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in newer.split()) + "]]"

    inside, found = False, []
    for x in re.findall(r"\\p\{[LN]\}|\\.|.", pattern, re.S):
        inside = x == "[" or inside and x != "]"
        own = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(x)
        found.append((own if inside else f"[{own}]") if own else x)
    return (
        re.compile("".join(found), re.A), regex.compile(pattern),
        regex.compile(pattern.replace(r"\p{L}", without("L", NEWER_LETTERS)).replace(r"\p{N}", without("N", NEWER_NUMBERS)), regex.V1),
    )


def load_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64, blank, rank; a line each) in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"the ranks of {path} aren't 0, 1, 2, ...")
    return [token for _, token in pairs]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), _U, len(keys))


class PerfectHash:
    """A minimal perfect hash by displacement: n distinct keys to the slots 0 .. n - 1, a number a bucket.

    Buckets are placed from the largest down: the first displacement that sends all keys of a bucket to free slots is
    kept. A bucket of one key keeps its slot itself, as a negative number, so the last free slots need no search.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)
        h = _hashes(keys)
        if len(np.unique(h)) < self.n:
            raise ValueError("keys must be distinct")
        free = np.ones(max(1, self.n), bool)
        order = np.argsort(h % _U(self.buckets), kind="stable")
        sizes = np.bincount((h % _U(self.buckets)).astype(np.int64), minlength=self.buckets)
        ends = np.cumsum(sizes)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] == 0:
                break
            own = h[order[ends[b] - sizes[b] : ends[b]]]
            if len(own) == 1:
                slot = int(np.argmax(free))
                self.shift[b], free[slot] = -1 - slot, False
                continue
            for first in range(0, 1 << 40, 64):
                at = self._slots(own[None, :], np.arange(first, first + 64, dtype=np.int64)[:, None])
                fits = free[at].all(axis=1)
                for k in np.flatnonzero(fits):
                    if len(set(at[k].tolist())) == len(own):
                        self.shift[b], free[at[k]] = first + int(k), False
                        break
                else:
                    continue
                break

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (splitmix(h ^ splitmix(shift.astype(_U) + _U(1))) % _U(max(1, self.n))).astype(np.int64)

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; a string that isn't a key gets the slot of some key, so the caller compares."""
        h = _hashes(keys)
        shift = self.shift[(h % _U(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(h, np.maximum(shift, 0)))


class Codec:
    """Encodes and decodes by a rank file's byte strings, which must hold every single byte."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern, self.hash = tokens, pattern, PerfectHash(tokens)
        self.slots = np.zeros(len(tokens), np.int64)
        self.slots[self.hash(tokens)] = np.arange(len(tokens))
        self._ready()

    def _ready(self):
        self.ranks, self.known, self.older = dict(zip(self.tokens, range(len(self.tokens)))), {}, {}
        self.packed = [x.tobytes() for x in np.arange(len(self.tokens), dtype="<u4")]
        self.ascii, self.plain, self.exact = compiled(self.pattern)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("tokens", "pattern", "hash", "slots")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a pre-token outside the vocabulary: of all neighbours the pair of least rank, the leftmost of equals, is merged until none has a rank."""
        n, get = len(piece), self.ranks.get
        after, before = range(1, n + 1), range(-1, n - 1)
        # the rank of the part that starts here with its successor
        pair = [get(piece[i:j], -1) for i, j in zip(range(n - 1), range(2, n + 1))] + [-1]
        if n > SHORT:
            after, before, pair = array("q", after), array("q", before), array("q", pair)
        else:
            after, before = list(after), list(before)
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i = top % n
            if pair[i] != top // n:
                continue  # one of the two has been merged since
            gone = after[i]
            pair[gone], after[i] = -1, (end := after[gone])
            r = -1
            if end < n:
                before[end] = i
                r = get(piece[i : after[end]], -1)
                if r >= 0:
                    heappush(heap, r * n + i)
            pair[i], j = r, before[i]
            if j >= 0:
                pair[j] = r = get(piece[j:end], -1)
                if r >= 0:
                    heappush(heap, r * n + j)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def resolved(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token: its own where the vocabulary has it, else what merging leaves."""
        ids, out = self.slots[self.hash(pieces)].tolist(), []
        for piece, i in zip(pieces, ids):
            if self.tokens[i] == piece:
                out.append(self.packed[i])
                continue
            found = self.known.get(piece)
            if found is None:
                found = self.older.get(piece) or np.array(self.merged(piece), "<u4").tobytes()
                if len(piece) <= 256:
                    if len(self.known) >= REMEMBERED:
                        self.known, self.older = {}, self.known
                    self.known[piece] = found
            out.append(found)
        return out

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text; those of a long one in windows, so its memory stays near that of its ids."""
        split = self.ascii if text.isascii() else self.plain if max(text) < NEWER else self.exact
        if len(text) <= WHOLE:
            yield split.findall(text)
            return
        found = (m.group() for m in split.finditer(text))
        while window := list(islice(found, WINDOW)):
            yield window

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        done: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0
        for row, text in enumerate(texts):
            for window in self.parts(text):
                held.append((row, window))
                size += len(window)
                if size >= WINDOW:
                    self._flush(held, size, done)
                    held, size = [], 0
        self._flush(held, size, done)
        return [np.concatenate(x) if x else np.empty(0, "<u4") for x in done]

    def _flush(self, held, size: int, done) -> None:
        distinct = pa.array(list(chain.from_iterable(w for _, w in held)), pa.large_string()).dictionary_encode()
        codes, ids = distinct.indices.to_numpy(), self.resolved(distinct.dictionary.cast(pa.large_binary()).to_pylist())
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        starts, n = np.cumsum(lens) - lens, lens[codes]
        ends = np.cumsum(n)
        out = flat[np.repeat(starts[codes] - (ends - n), n) + np.arange(int(n.sum()))]
        at = 0
        for row, window in held:
            a, at = (ends[at - 1] if at else 0), at + len(window)
            done[row].append(out[a : ends[at - 1] if at else 0])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(ranks: str | None = None, pattern: str | None = None) -> Codec:
    """The codec of a rank file and a pre-token pattern; by default the public byte-level vocabulary of 50,256."""
    import public_tokenizers

    return Codec(load_ranks(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, own: Codec | None = None, packed: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids), a row for each row of docs: the ids of the whole text.

    ids are little-endian unsigned 32-bit numbers in one binary, or array<int> with packed=False. Pre-tokens are
    encoded one by one and special tokens are ordinary text. Each task reads the vocabulary (its size is the rank
    file's) from the plan, splits texts by the pattern, looks the distinct pre-tokens of a window up by the perfect hash and
    merges what it doesn't hold. No shuffle. A null text is an empty one and has no ids; repeated rows and null ids pass
    through; an empty table gives no rows; extra columns are ignored.
    """
    own = own or codec()
    text_batches(docs.sparkSession)
    kind = pa.binary() if packed else pa.list_(pa.int32())

    def run(batches):
        for batch in batches:
            ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() if packed else x.astype(np.int32) for x in ids], kind)], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, ids {'binary' if packed else 'array<int>'}")


def decode(encoded: DataFrame, own: Codec | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the bytes that packed ids stand for. Null ids are none; an id outside the vocabulary fails the job."""
    own = own or codec()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.decode(x or b"") for x in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    text_batches(encoded.sparkSession)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each text's ids and of the bytes that they decode to."""
    own = codec()
    back = decode(encode(read(spark, sf_dir, "documents", "doc_id", "text"), own), own)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
