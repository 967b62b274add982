"""Near copies by SimHash and the similarity of their shingle sets.

Two texts are near copies if the Jaccard similarity of their sets of width-word
shingles is at least ``least``.  SimHashes of 64 bits are then about ten bits
apart, too wide a ball to spell out.  So the SimHash of a set is longer and is cut
into blocks: texts whose fingerprints are within two bits of each other in any
block are candidates, found as in simhash by the variants within one bit, which
are dealt by their low bits and spelled out behind the shuffle.  Blocks have a few
bits more than the logarithm of the number of texts, and there are as many as it
takes to miss a pair at 0.8 with a probability of MISS only.  What meets in a
variant must also be within FAR of the SKETCH bits that belong to no block, six
standard deviations beyond 0.8.

A bucket gives a spanning forest of its candidates, no pairs.  Each component of
candidates then meets with its shingle sets, each set once, and is searched
exactly from text to text, so no group of near copies is listed by pairs.
Components of more than GROUP_BYTES are dealt by pairs of parts.  Equal texts count once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, simhash

#: Probability that a pair at 0.8 is no candidate; share of the bits in which such a pair differs; bits a block has beyond the logarithm.
MISS, DIFFERS, SPARE = 3e-6, math.acos(0.8 / 0.9) / math.pi, 6
SKETCH, FAR = 128, 44
#: Entries in a bucket of variants; bytes that a text sends in one round; bytes of the sets of a group.
FILL, ROUND_BYTES, GROUP_BYTES = 500_000, 1024, 32 << 20
#: Texts with candidates that are broadcast at most (16 bytes each); beyond, the texts are shuffled to meet them.
MOST_MEMBERS = 1_000_000
ENTRY = np.dtype([("t", "<i8"), ("sketch", "<u8", (SKETCH // 64,)), ("value", "<u4")])
SEEDS = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Blocks:
    """How a fingerprint is cut: n blocks of bits each, dealt by their low bits."""

    bits: int
    n: int
    low: int

    @property
    def words(self) -> int:
        return -(-(SKETCH + self.bits * self.n) // 64)

    @property
    def each_round(self) -> int:
        return max(1, ROUND_BYTES // (ENTRY.itemsize * (1 + self.low)))


def blocks(texts: int) -> Blocks:
    bits = min(32, max(12, math.ceil(math.log2(max(2, texts))) + SPARE))
    within = sum(math.comb(bits, k) * DIFFERS**k * (1 - DIFFERS) ** (bits - k) for k in range(3))
    low = 0
    while texts * (1 + low) > FILL << low:
        low += 1
    return Blocks(bits, math.ceil(math.log(MISS) / math.log1p(-within)), low)


def key(text: bytes | None) -> int:
    """The text's words, A-Z lower-cased, as a signed hash."""
    return xxhash.xxh3_64_intdigest(b" ".join((text or b"").lower().split())) - (1 << 63)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted hashes of the different width-word shingles, A-Z lower-cased; of all words if they are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n))


def hashed(s: np.ndarray, words: int) -> np.ndarray:
    """The bits, as 0 and 1, that each shingle votes with."""
    x = (s[:, None] ^ SEEDS[:words]) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    return np.unpackbits(x.view(np.uint8).reshape(len(s), -1), axis=1)


def fingerprint(s: np.ndarray, words: int) -> bytes:
    """The SimHash of a set of shingles: bits that more than half of them have, at a tie those of the least."""
    ones = np.zeros(64 * words, np.int64)
    for i in range(0, len(s), 255):  # sums of up to 255 fit into a byte, so eight bits are added at once
        ones += np.add.reduce(hashed(s[i : i + 255], words).view(np.uint64), axis=0).view(np.uint8)
    return np.packbits((2 * ones > len(s)) | ((2 * ones == len(s)) & (hashed(s[:1], words)[0] == 1))).tobytes()


def signatures(docs: DataFrame, width: int, words: int) -> DataFrame:
    """doc_id, t (hash of the words), fp (the SimHash of so many 64-bit words, null without words)."""

    def run(c):
        out = {"doc_id": c["doc_id"], "t": list(map(key, c["text"])), "fp": []}
        known: dict[int, bytes | None] = {}
        for t, text in zip(out["t"], c["text"]):
            if t not in known:
                s = shingles(text, width)
                known[t] = fingerprint(s, words) if len(s) else None
            out["fp"].append(known[t])
        return out

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id long, t long, fp binary")


def entries(t: np.ndarray, fps: list[bytes], how: Blocks, these: range) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of t in these blocks, and what goes there."""
    raw = np.frombuffer(b"".join(fps), np.uint8).reshape(len(t), -1)
    bits = np.unpackbits(raw, axis=1)[:, SKETCH + how.bits * these[0] : SKETCH + how.bits * (these[-1] + 1)].reshape(len(t), len(these), how.bits)
    value = np.zeros((len(t), len(these), 32), np.uint8)
    value[:, :, : how.bits] = bits
    value = np.packbits(value, axis=2, bitorder="little").view("<u4")
    near = np.array([0] + [1 << i for i in range(how.low)], np.int64)
    bucket = (np.array(these)[:, None] << how.low) | ((value.astype(np.int64) & ((1 << how.low) - 1)) ^ near)
    out = np.empty(bucket.shape, ENTRY)
    out["t"] = t[:, None, None]
    out["sketch"] = np.ascontiguousarray(raw[:, : SKETCH // 8]).view("<u8")[:, None, None, :]
    out["value"] = value
    return bucket.ravel(), out.ravel()


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64) <= FAR


def trees(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that are alike, directly or through others."""
    left, a, b = np.arange(len(sketch)), [], []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            hit = alike(sketch[left], sketch[x])
            new, left = left[hit], left[~hit]
            stack.extend(new)
            a.append(np.full(len(new), x))
            b.append(new)
    none = [np.empty(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def met(e: np.ndarray, bucket: int, how: Blocks) -> np.ndarray:
    """Roots of the entries of a bucket by the variants in which they meet."""
    low = np.uint64((1 << how.low) - 1)
    value = e["value"].astype(np.uint64)
    base = (value & ~low) | (np.uint64(bucket) & low)
    spare = np.nonzero((value ^ base) == 0)[0]  # the others have had their flip
    flip = np.array([1 << i for i in range(how.low, how.bits)], np.uint64)
    passes = -(-(len(e) + len(spare) * len(flip)) // simhash.AT_ONCE)
    link_a, link_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for p in range(passes):
        values, who = [], []
        for f in [np.uint64(0), *flip]:
            ix = spare if f else np.arange(len(e))
            v = base[ix] ^ f
            if passes > 1:
                mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == p
                v, ix = v[mine], ix[mine]
            values.append(v)
            who.append(ix)
        v, src = np.concatenate(values), np.concatenate(who)
        order = np.argsort(v)
        v, src = v[order], src[order]
        starts = np.r_[0, np.nonzero(v[1:] != v[:-1])[0] + 1]
        size = np.diff(np.r_[starts, len(v)])
        for d in range(1, 9):  # all pairs of groups of up to nine
            at = starts[(size > d) & (size <= 9)]
            at = np.concatenate([at + k for k in range(9 - d)] or [at])
            at = at[at + d < len(v)]
            at = at[v[at] == v[at + d]]
            a, b = src[at], src[at + d]
            ok = alike(e["sketch"][a], e["sketch"][b])
            link_a.append(a[ok])
            link_b.append(b[ok])
        for i, n in zip(starts[size > 9].tolist(), size[size > 9].tolist()):
            here = src[i : i + n]
            a, b = trees(e["sketch"][here])
            link_a.append(here[a])
            link_b.append(here[b])
    return simhash.forest(np.concatenate(link_a), np.concatenate(link_b), len(e))


def grouped(f: Callable[[tuple, list[tuple]], pa.RecordBatch], keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over the rows of each key: the first columns, by which rows are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part in common.cut(batch):
                for r in zip(*(c.to_pylist() for c in part.columns)):
                    if held and r[:keys] != now:
                        yield f(now, held)
                        held = []
                    now = r[:keys]
                    held.append(r[keys:])
        if held:
            yield f(now, held)

    return run


def linked(t: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    at = np.nonzero(root != np.arange(len(t)))[0]
    return pa.RecordBatch.from_arrays([pa.array(t[root[at]]), pa.array(t[at])], ["u", "v"])


def candidates(distinct: DataFrame, how: Blocks) -> list[DataFrame]:
    """distinct: t, fp, each t once.  u, v: links that connect all candidates, from one round of blocks each."""

    def deal(these: range) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 8192):
                    part = batch.slice(i, 8192)
                    bucket, e = entries(part.column(0).to_numpy(), part.column(1).to_pylist(), how, these)
                    order = np.argsort(bucket, kind="stable")
                    bucket, e = bucket[order], e[order]
                    edges = np.r_[0, np.nonzero(np.diff(bucket))[0] + 1, len(e)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array([e[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["bucket", "entries"])

        return run

    def meet(of: tuple, rows: list[tuple]) -> pa.RecordBatch:
        e = np.frombuffer(b"".join(r[0] for r in rows), ENTRY)
        e = e[np.argsort(e["t"])]
        return linked(e["t"], met(e, of[0], how))

    def one(first: int) -> DataFrame:
        dealt = distinct.where("fp is not null").select("t", "fp").mapInArrow(deal(range(first, min(how.n, first + how.each_round))), "bucket long, entries binary")
        return common.kept(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(grouped(meet, 1), "u long, v long").distinct(), "candidates")

    return [one(i) for i in range(0, how.n, how.each_round)]


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The least set reachable from each over pairs of similarity least or more; every such pair counts."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    root, left, indexed = np.arange(n), np.ones(n, bool), n
    for i in range(n):
        if not left[i]:
            continue
        left[i], stack = False, [i]
        while stack and (there := int(left.sum())):
            if 2 * there < indexed:  # sets that are reached need no look again
                live = left[owner]
                hashes, owner, indexed = hashes[live], owner[live], there
            x = stack.pop()
            a, b = np.searchsorted(hashes, sets[x]), np.searchsorted(hashes, sets[x], "right")
            at = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange(int((b - a).sum()))
            both = np.bincount(owner[at], minlength=n)
            new = np.nonzero(left & (both >= least * (size[x] + size - both)))[0]
            left[new] = False
            root[new] = i
            stack.extend(new.tolist())
    return root


def verified(members: DataFrame, docs: DataFrame, width: int, least: float) -> DataFrame:
    """members: node, root of the components of candidates.  u, v: links that connect the texts of a component that are similar."""
    texts = common.arrow_map(docs.select("text"), lambda c: {"t": list(map(key, c["text"])), "text": c["text"]}, "t long, text string")
    texts = texts.join(common.small(members, MOST_MEMBERS), F.col("t") == F.col("node")).groupBy("root", "t").agg(F.first("text").alias("text"))
    sets = common.kept(common.arrow_map(texts, lambda c: {"root": c["root"], "t": c["t"], "s": [shingles(x, width).tobytes() for x in c["text"]]}, "root long, t long, s binary"), "shingles")
    # no more groups than the bytes of all sets hold GROUP_BYTES are dealt by parts, so the list of them is small
    parts = sets.groupBy("root").agg(F.ceil(F.sum(F.length("s")) / GROUP_BYTES).cast("int").alias("parts")).where("parts > 1")
    mine, other = F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = sets.join(F.broadcast(parts), "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).select("root", mine.alias("mine"), other.alias("other"), "t", "s")
    dealt = dealt.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "t", "s")

    def search(of: tuple, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort()
        return linked(np.array([r[0] for r in rows], np.int64), similar([np.frombuffer(r[1], np.uint64) for r in rows], least))

    out = common.kept(dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(grouped(search, 3), "u long, v long"), "similar")
    common.dropped(sets)
    return out


def roots(distinct: DataFrame, docs: DataFrame, width: int, least: float, how: Blocks) -> DataFrame:
    """distinct: t, fp, each t once.  node, root of the texts that have near copies."""
    found = candidates(distinct, how)
    members = common.kept(components.components(reduce(DataFrame.unionByName, found)), "members")
    common.dropped(*found)
    return components.components(verified(members, docs, width, least))


def one_of_each(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component of near copies the document of the smallest doc_id, once.

    Components are joined by pairs of similarity least or more.  Texts without
    words are one component; of a component of null ids alone one row stays.
    """
    how = blocks(docs.count())
    rows = common.kept(signatures(docs, width, how.words), "signatures")
    distinct = common.kept(rows.groupBy("t").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")), "distinct")
    common.dropped(rows)
    near = roots(distinct, docs, width, least, how)
    by_t = distinct.select("t", "least").join(near, F.col("t") == F.col("node"), "left").select("t", "least", F.coalesce("root", "t").alias("root"))
    groups = common.kept(by_t.groupBy("root").agg(F.min("least").alias("stays"), F.min("t").alias("least_t")), "groups")
    named = docs.where("doc_id is not null").join(groups.select("stays"), F.col("doc_id") == F.col("stays"), "left_semi").dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id is null")
    lone = groups.where("stays is null").select("least_t")
    if not lone.limit(1).count():
        return named
    marked = common.arrow_map(nameless.select("text").distinct(), lambda c: {"of_text": c["text"], "t": list(map(key, c["text"]))}, "of_text string, t long")
    first = marked.join(lone, F.col("t") == F.col("least_t"), "left_semi").groupBy("t").agg(F.min_by("of_text", F.coalesce("of_text", F.lit(""))).alias("of_text"))
    return named.unionByName(nameless.join(first, F.col("text").eqNullSafe(F.col("of_text")), "left_semi").dropDuplicates(["text"]))
