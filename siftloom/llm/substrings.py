"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``window`` consecutive words.  Its minimiser is the least hash of the
``m``-word runs in it, so consecutive windows often share one: they travel as
one packed string (a super-k-mer) to the bucket of that minimiser, where equal
windows meet.  The bucket sorts its windows and counts them exactly, as bytes.

Equal strings are counted together before the shuffle.  A minimiser that very
many different strings share, as a licence line makes it, would fill one bucket:
such hot minimisers are found on a sample of the texts, and their windows travel
singly, dealt by their own hash.  The sample only routes; counts never use it.

Before that, minimisers are counted.  One that is met once has no window that
could be met twice, so its string stays at home: the others are marked in a
bitmap of bounded size.  Where the bitmap fills up more strings travel than need
to, and the result is the same.

What a bucket has found (which windows of a string are repeated) goes back to
the texts by the strings' 128-bit hashes, and the texts are known by theirs, so
copies share one answer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, M = 35, 4
#: One of so many texts is looked at for hot minimisers; strings that make one hot; hot ones listed at most (8 bytes each).
SAMPLE, HOT_STRINGS, HOT_MOST = 16, 4096, 50_000
#: Bits of the bitmap for each minimiser that is met more than once, and the logarithm of its size at least and at most (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 16, 28
MIX = 0x9E3779B97F4A7C15


class Pieces:
    """The super-k-mers of one text."""

    def __init__(self, text: bytes | None, window: int = WINDOW, m: int = M):
        self.words = (text or b"").split()
        self.window = window
        n = len(self.words) - window + 1
        self.runs: list[tuple[int, int, int, bool]] = []
        if n < 1:
            return
        self.joined = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1
        self.ends = ends.tolist()
        self.starts = [0, *(ends[:-1] + 1).tolist()]
        h = np.fromiter(map(crc32, self.words), np.uint64, len(self.words))
        runs = h[: len(h) - m + 1].copy()
        for i in range(1, m):
            runs *= np.uint64(0x9E3779B97F4A7C15)
            runs ^= h[i : len(h) - m + 1 + i]
        runs ^= runs >> np.uint64(31)
        runs *= np.uint64(0xBF58476D1CE4E5B9)
        runs ^= runs >> np.uint64(29)
        low, have, need = runs, 1, window - m + 1
        while have < need:
            step = min(have, need - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        edges = [0, *(np.nonzero(low[1:] != low[:-1])[0] + 1).tolist(), n]
        again = len(np.unique(runs)) < len(runs)
        for a, b in zip(edges, edges[1:]):
            v = low[a]
            twice = again and int((runs[a : b + need - 1] == v).sum()) > 1
            self.runs.append((a, b, int(v.astype(np.int64)), twice))

    def span(self, first: int, last: int) -> bytes:
        """The windows first to last - 1 as one string."""
        return self.joined[self.starts[first] : self.ends[last + self.window - 2]]

    def strings(self, routing: "Routing") -> Iterator[tuple[int, int, bytes, bool]]:
        """(first window, route, packed string, whether its minimiser is in it twice) of strings that can have repeated windows; windows of hot minimisers come singly."""
        hot, bits, shift = routing.hot, routing.bits, 64 - routing.size
        for a, b, v, twice in self.runs:
            i = (v * MIX & (1 << 64) - 1) >> shift
            if not bits[i >> 3] >> (i & 7) & 1:
                continue
            if v in hot:
                for i in range(a, b):
                    s = self.span(i, i + 1)
                    yield i, xxhash.xxh64_intdigest(s) - (1 << 63), s, False
            else:
                yield a, v, self.span(a, b), twice


def repeated(strings: dict[bytes, int], twice: bool, window: int = WINDOW) -> dict[bytes, np.ndarray]:
    """strings: packed strings of one bucket, with counts.  Which windows of each occur twice or more, for strings that have such.

    twice: whether a string may repeat a window in itself.
    """
    if len(strings) == 1 and not twice:
        (s, n), = strings.items()
        return {s: np.ones(s.count(b" ") + 2 - window, bool)} if n > 1 else {}
    windows, owner = [], []
    for s, n in strings.items():
        ends = [i for i, c in enumerate(s) if c == 32] + [len(s)]
        starts = [0, *(e + 1 for e in ends[:-1])]
        for i in range(len(ends) - window + 1):
            windows.append(s[starts[i] : ends[i + window - 1]])
            owner.append((s, i, n))
    order = sorted(range(len(windows)), key=windows.__getitem__)
    out: dict[bytes, np.ndarray] = {}
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and windows[order[end]] == windows[order[at]]:
            end += 1
        if end - at > 1 or owner[order[at]][2] > 1:
            for k in order[at:end]:
                s, i, _ = owner[k]
                if s not in out:
                    out[s] = np.zeros(s.count(b" ") + 2 - window, bool)
                out[s][i] = True
        at = end
    return out


def _ids(x: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(x)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def hot_minimisers(docs: DataFrame, window: int = WINDOW) -> frozenset:
    """Minimisers of about HOT_STRINGS different strings or more, the hottest HOT_MOST of them, from one in SAMPLE texts."""

    def run(c):
        seen = {(v, p.span(a, b)) for t in c["text"] for p in [Pieces(t, window)] for a, b, v, _ in p.runs}
        count: dict[int, int] = {}
        for v, _ in seen:
            count[v] = count.get(v, 0) + 1
        some = [(v, n) for v, n in count.items() if n > 1]
        return {"v": [v for v, _ in some], "n": [n for _, n in some]}

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text")
    got = common.arrow_map(sample, run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_STRINGS // SAMPLE)
    return frozenset(r[0] for r in got.orderBy(F.desc("n"), "v").limit(HOT_MOST).collect())


class Routing:
    """Hot minimisers, and a bitmap (of 2 to the power size bits) of those that are met more than once."""

    def __init__(self, hot: frozenset, bits: bytes, size: int):
        self.hot, self.bits, self.size = hot, bits, size


def routing(docs: DataFrame, window: int = WINDOW) -> Routing:
    """docs: text.  Minimisers are counted over all texts, as often as they stand in a string."""

    def count(c):
        n: dict[int, int] = {}
        for t in c["text"]:
            for _, _, v, twice in Pieces(t, window).runs:
                n[v] = n.get(v, 0) + 1 + twice
        return {"v": list(n), "n": list(n.values())}

    often = common.arrow_map(docs.select("text"), count, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).where("n > 1").select("v")
    often = common.kept(often, "minimisers")
    size = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * often.count()).bit_length()))
    block = min(16, size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(MIX) >> np.uint64(64 - size)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> block), pa.array((at & (1 << block) - 1).astype(np.int32))], ["block", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            at, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(at).tolist():
                got.setdefault(k, np.zeros(1 << block, bool))[bit[at == k]] = True
        packed = [np.packbits(v, bitorder="little").tobytes() for v in got.values()]
        yield pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.int64()), pa.array(packed, pa.binary())], ["block", "bits"])

    # blocks of 8 KB, 32 MB of them at most
    blocks = often.mapInArrow(place, "block long, bit int").distinct().repartition("block").mapInArrow(fill, "block long, bits binary")
    bits = bytearray(1 << size - 3)
    for r in blocks.collect():
        bits[r.block << block - 3 : r.block + 1 << block - 3] = r.bits
    return Routing(hot_minimisers(docs, window), bytes(bits), size)


def marks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: text.  For each text (by its 128-bit hash k1, k2) that has repeated windows: found, an array of (first, mask)."""
    held = docs.sparkSession.sparkContext.broadcast(routing(docs, window))

    def pack(c):
        count: dict[tuple[int, bytes], list] = {}
        for t in c["text"]:
            for _, route, s, twice in Pieces(t, window).strings(held.value):
                got = count.setdefault((route, s), [0, twice])
                got[0] += 1
        return {"route": [k[0] for k in count], "s": [k[1] for k in count], "n": [v[0] for v in count.values()], "twice": [v[1] for v in count.values()]}

    def places(c):
        out = [], [], [], [], []
        for t in dict.fromkeys(c["text"]):
            k = _ids(t or b"")
            for first, _, s, _ in Pieces(t, window).strings(held.value):
                for column, v in zip(out, (*k, *_ids(s), first)):
                    column.append(v)
        return dict(zip(("k1", "k2", "s1", "s2", "first"), out))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["q1", "q2", "mask"]

        def flush(strings, twice, out):
            for s, mask in repeated(strings, twice, window).items():
                out.append((*_ids(s), np.packbits(mask).tobytes()))

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], names)

        now, strings, twice, out, n_last = None, {}, False, [], 0
        for b in batches:
            for route, s, n, t in zip(*(b.column(i).to_pylist() for i in range(4))):
                if route != now:
                    if strings and (len(strings) > 1 or twice or n_last > 1):
                        flush(strings, twice, out)
                    now, strings, twice = route, {}, False
                n_last = strings[s] = strings.get(s, 0) + n
                twice = twice or t
            if len(out) > 5000:
                yield batch(out)
                out = []
        if strings:
            flush(strings, twice, out)
        yield batch(out)

    packed = common.arrow_map(docs.select("text"), pack, "route long, s binary, n long, twice boolean")
    found = packed.repartition("route").sortWithinPartitions("route").mapInArrow(bucket, "q1 long, q2 long, mask binary")
    at = common.arrow_map(docs.select("text"), places, "k1 long, k2 long, s1 long, s2 long, first int")
    j = at.join(found, (F.col("s1") == F.col("q1")) & (F.col("s2") == F.col("q2")))
    return j.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "mask")).alias("found"))


def cover(n_words: int, found: list[dict], window: int = WINDOW) -> np.ndarray:
    """Which words lie in a repeated window."""
    step = np.zeros(n_words + 1, np.int64)
    for f in found:
        at = f["first"] + np.nonzero(np.unpackbits(np.frombuffer(f["mask"], np.uint8)))[0]
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: doc_id, text; other columns are ignored.

    One row for each row of docs: doc_id, n_words, n_removed, kept_text.  Each
    word in a window that starts anywhere else too, in the same text included,
    is removed; windows are those of the input.  A text without removed words
    keeps its white space; else what is kept is joined by single spaces.  A null,
    empty or short text has no window and stays (null as empty); rows repeated
    lose every window they have, like other copies; a null doc_id is kept; an
    empty table gives no rows.
    """
    out = _cut(docs.select("doc_id", "text"), window)
    return out.select("doc_id", "n_words", "n_removed", F.col("text").alias("kept_text"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns: text without the repeated windows, and n_chars, if there, its new length."""
    out = _cut(docs, window)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """docs with text replaced and n_words, n_removed added; its columns travel in one struct, so none can clash."""
    found = marks(docs, window).withColumnsRenamed({"k1": "f1", "k2": "f2"})
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "text")
    row = rows.schema["row"]

    def keys(c):
        k = [_ids(t or b"") for t in c["text"]]
        return c | {"k1": [x[0] for x in k], "k2": [x[1] for x in k]}

    def cut(c):
        out = [], [], []
        for t, f in zip(c["text"], c["found"]):
            words = (t or b"").split()
            drop = cover(len(words), f, window) if f else np.zeros(len(words), bool)
            n = int(drop.sum())
            for column, v in zip(out, (len(words), n, b" ".join([w for w, d in zip(words, drop) if not d]) if n else t or b"")):
                column.append(v)
        return {"row": c["row"], "n_words": out[0], "n_removed": out[1], "text": out[2]}

    long, text = T.LongType(), T.StringType()
    keyed = common.arrow_map(rows, keys, T.StructType([row, T.StructField("text", text), T.StructField("k1", long), T.StructField("k2", long)]))
    j = keyed.join(found, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left").select("row", "text", "found")
    done = common.arrow_map(j, cut, T.StructType([row, T.StructField("n_words", long), T.StructField("n_removed", long), T.StructField("text", text)]))
    names = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return done.select(*names, F.col("n_words").alias("n_words"), F.col("n_removed").alias("n_removed"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(common.documents(spark, sf_dir))

    def digest(c):
        kept = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in c["kept_text"]]
        return {"doc_id": c["doc_id"], "n_words": c["n_words"], "n_removed": c["n_removed"], "kept_sha256": kept}

    return common.arrow_map(out, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
