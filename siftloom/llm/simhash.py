"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits differ in at most ``2 * half`` bits exactly if some
value is within ``half`` bits of both.  So every distinct fingerprint emits all
values (variants) within ``half`` of it, variants are shuffled, and fingerprints
that meet in one are linked.

With half = 2 a fingerprint has 2,081 variants.  They are shuffled by their
``b`` low bits: a fingerprint goes once to each of the 1 + b + b(b-1)/2 values
that these bits can take within half, and what is left of its ball is spelled out
after the shuffle, a bucket at a time.  The variants met are the same; the bytes
moved are those of some dozens of rows instead of 2,081.  b grows with the
logarithm of the number of fingerprints, so a bucket holds about FILL of them.

All fingerprints that meet in a variant are pairwise within 2 * half bits, so
each is linked to the first of them only: no pairs of a group are listed.  A
bucket gives a spanning forest of what it has found, and components joins the
forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components

#: Fingerprints for each bucket of variants, and variants that are sorted at once.
FILL, AT_ONCE = 1500, 6_000_000


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) of all width-word shingles, A-Z lower-cased; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(width, len(words))
    digest = xxhash.xxh64_digest
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    s, e = starts[:n].tolist(), ends[k - 1 :].tolist()
    for i in range(0, n, 1 << 16):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(s[i : i + (1 << 16)], e[i : i + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """docs: doc_id, text.  One row for each row of docs: doc_id, fp (the bits as a signed long)."""

    def run(c):
        fp = np.fromiter((fingerprint(t, width) for t in c["text"]), np.uint64, len(c["text"])).view(np.int64)
        return {"doc_id": c["doc_id"], "fp": fp.tolist()}

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def masks(bits: range, most: int) -> list[np.ndarray]:
    """For each number of flips up to most: the words with so many of these bits set."""
    return [np.array([sum(1 << i for i in c) for c in combinations(bits, n)], dtype=np.uint64) for n in range(most + 1)]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node reachable from each of n nodes over the links a-b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def met(fps: np.ndarray, base: np.ndarray, left: np.ndarray, free: list[np.ndarray]) -> np.ndarray:
    """Roots of fps by what meets in one bucket.

    base: each fingerprint with its low bits set to the bucket's; left: flips
    that remain; free: masks over the other bits.  Variants are sorted AT_ONCE
    at a time, dealt by a hash of theirs if there are more.
    """
    ways = [np.concatenate(free[: k + 1]) for k in range(len(free))]
    total = sum(int((left == k).sum()) * len(w) for k, w in enumerate(ways))
    passes = -(-total // AT_ONCE)
    link_a, link_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for p in range(passes):
        values, who = [], []
        for k, w in enumerate(ways):
            at = np.nonzero(left == k)[0]
            for i in range(0, len(at), 512):
                ix = at[i : i + 512]
                v, src = (base[ix][:, None] ^ w[None, :]).ravel(), np.repeat(ix.astype(np.int32), len(w))
                if passes > 1:
                    mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == p
                    v, src = v[mine], src[mine]
                values.append(v)
                who.append(src)
        v, src = np.concatenate(values), np.concatenate(who)
        order = np.argsort(v)
        v, src = v[order], src[order]
        same = np.nonzero(v[1:] == v[:-1])[0] + 1
        if not len(same):
            continue
        first = np.arange(len(v))
        first[same] = 0
        first = np.maximum.accumulate(first)
        pairs = np.unique(src[first[same]].astype(np.int64) * len(fps) + src[same])
        link_a.append(pairs // len(fps))
        link_b.append(pairs % len(fps))
    a, b = np.concatenate(link_a), np.concatenate(link_b)
    ok = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * (len(free) - 1)
    return forest(a[ok], b[ok], len(fps))


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """distinct: fp, each value once.  u, v: links that connect all fingerprints within radius bits, directly or through others."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it is flipped on either side")
    half = radius // 2
    n = distinct.count()
    b = max(1, min(24, math.ceil(math.log2(max(2, n / FILL)))))
    low = np.uint64((1 << b) - 1)
    near = masks(range(b), half)
    flips = np.concatenate([np.full(len(m), k, np.int64) for k, m in enumerate(near)])
    near = np.concatenate(near)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 4096):
                x = fp[i : i + 4096]
                bucket = (x[:, None] & low) ^ near[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel().astype(np.int64)), pa.array(np.repeat(x, len(near)).view(np.int64)), pa.array(np.tile(flips, len(x)).astype(np.int8))], ["bucket", "fp", "flips"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = masks(range(b, 64), half)

        def bucket(parts: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(parts)
            fps = rows[:, 1].copy().view(np.uint64)
            root = met(fps, (fps & ~low) | rows[:, 0].view(np.uint64), half - rows[:, 2], free)
            at = np.nonzero(root != np.arange(len(fps)))[0]
            return pa.RecordBatch.from_arrays([pa.array(rows[at, 1]), pa.array(rows[root[at], 1])], ["u", "v"])

        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            edges = np.nonzero(np.diff(rows[:, 0]))[0] + 1
            for part in np.split(rows, edges):
                if held and len(part) and held[0][0, 0] != part[0, 0]:
                    yield bucket(held)
                    held = []
                held.append(part)
        if held:
            yield bucket(held)

    dealt = distinct.select("fp").mapInArrow(deal, "bucket long, fp long, flips byte")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """docs: doc_id, text; other columns are ignored.

    One row for each row of docs: doc_id, fp, root (the least fingerprint of the
    component) and component_id (the smallest doc_id that is reachable over links
    of at most radius bits, itself included).  A
    null, empty or blank text has fingerprint 0, linked like any other; repeated
    rows are equal and so in one component; a null doc_id is never smallest,
    and a component of none but null ids has a null component_id; an empty table
    gives no rows.
    """
    rows = common.kept(fingerprints(docs, width), "fingerprints")
    distinct = common.kept(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components.components(links(distinct, radius)).select(F.col("node"), F.col("root"))
    by_fp = common.kept(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    by_root = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = by_fp.select(F.col("fp").alias("of_fp"), "root").join(by_root, "root")
    return rows.join(by_fp, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component the document of the smallest doc_id, once.

    Of a component of null ids alone one row of its least fingerprint stays.
    """
    rows = common.kept(near_duplicates(docs, radius, width), "components")
    ids = rows.where("component_id is not null").select(F.col("component_id").alias("stays")).distinct()
    named = docs.where("doc_id is not null").join(ids, F.col("doc_id") == F.col("stays"), "left_semi").dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id is null")
    if rows.where("component_id is null").limit(1).count():
        fps = rows.where("component_id is null").groupBy("root").agg(F.min("fp").alias("stays"))
        texts = nameless.select("text").distinct()
        marked = common.arrow_map(texts.withColumn("doc_id", F.lit(0)), lambda c: {"t": c["text"], "fp": np.fromiter((fingerprint(t, width) for t in c["text"]), np.uint64, len(c["text"])).view(np.int64)}, "t string, fp long")
        first = marked.join(fps, F.col("fp") == F.col("stays"), "left_semi").groupBy("fp").agg(F.min_by("t", F.coalesce("t", F.lit(""))).alias("t"))
        return named.unionByName(nameless.join(first, F.col("text").eqNullSafe(F.col("t")), "left_semi").dropDuplicates(["text"]))
    return named


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
