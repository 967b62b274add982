"""Restaurants of the words that follow each word, for all pairs of words of all training texts.

A pair is a word and the one before it.  Pairs of two frequent words are counted
and looked up in the class table that all tasks have, which is a cache: no pair
is without a count of its own.  All others are dealt into parts, with the texts
they stand in: by the word before, so its restaurant is whole in one part, or by
the pair if that word is frequent, so no part has a frequent word's restaurant;
of those only two numbers each go through the driver.

A pair of n customers at t tables, in a restaurant of C customers at T, has the
probability (n - d t + (strength + d T) q) / (strength + C).  q is what the
parent predicts: the class after the last frequent word, and for words that are
not frequent their share of that class.

What travels are packed arrays of a slice of texts for one part, sums of a part
for one slice, and for words that no list holds the two coefficients of the
probability, dealt by the word to where its share is.  Words are known by their
number in the list, others by 63 bits of a hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pitman_yor import Draws, Tables, seat_alone

#: Tokens of a part, about; parts at least.
PART, LEAST_PARTS = 250_000, 64
#: Bytes of texts in a slice, about; their tokens are worked on at once.
SLICE = 3 << 20
#: Rows of a slice that are no part: its documents, its different texts, pairs of two frequent words.
DOCS, TEXTS, CACHED = -1, -2, -3
#: Rows of values: sums for the texts of a slice, base sums with them, shares of words.
SUMS, SHARES, OPEN = -4, -5, -6
KINDS = {
    DOCS: ("<i8", "u1", "u1", "<i4"),  # doc_id, null, train, text
    TEXTS: ("<i8", "<i8", "<f8"),  # tokens, known, base
    CACHED: ("<i4", "<i4", "<i4"),  # text, pair of classes, weight
    SUMS: ("<i4", "<f8", "<f8", "<i4"),  # text, score, base, known
    SHARES: ("<i8", "<i8", "<f8"),  # word, c, log_b
    OPEN: ("<i8", "<f8", "<f8", "<i8", "<i4"),  # word, own, back, slice, text
    0: ("<i8", "<i8", "<i4", "<i4", "<i4"),  # before, word, last frequent, text, weight
    1: ("<i8", "<i8", "<i4", "<i4", "<i4", "<i8"),  # the same, slice
}
MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "slice long, part int, blob binary"


def pack(kind: int, *arrays) -> bytes:
    """Arrays of one length, byte by byte in planes."""
    planes = [np.ascontiguousarray(a, t).view(np.uint8).reshape(len(a), np.dtype(t).itemsize).T.tobytes() for a, t in zip(arrays, KINDS[kind], strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(kind: int, blob: bytes) -> list[np.ndarray]:
    types = [np.dtype(t) for t in KINDS[kind]]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at, out = len(raw) // sum(t.itemsize for t in types), 0, []
    for t in types:
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).reshape(n))
        at += n * t.itemsize
    return out


def joined(kind: int, blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(unpack(kind, b) for b in blobs))] if blobs else [np.empty(0, t) for t in KINDS[kind]]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * MIX
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    return (x >> np.uint64(8)).astype(np.int64) % parts


def number(word: bytes, index: dict[bytes, int]) -> int:
    """Of a word in the list its place, of another a hash below 0."""
    at = index.get(word, -1)
    return at if at >= 0 else -1 - (xxhash.xxh64_intdigest(word) >> 1)


def listed(columns: dict) -> pa.Array:
    """One list of the rows of columns."""
    x = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def sorted_by(rows: DataFrame, key: str, f: Callable, schema: str) -> DataFrame:
    """f(key, its rows as (part, slice, blob)) for each key, in a task that has all of them; f yields rows as tuples."""
    types = common.arrow_schema(rows.sparkSession, schema)
    names = types.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(k, held):
            for row in f(k, held):
                yield pa.RecordBatch.from_pydict({n: v if isinstance(v, pa.Array) else [v] for n, v in zip(names, row)}, schema=types)

        now, held = None, []
        for b in batches:
            for s, p, blob in zip(*(c.to_pylist() for c in b.columns)):
                k = p if key == "part" else s
                if held and k != now:
                    yield from done(now, held)
                    held = []
                now = k
                held.append((p, s, blob))
        if held:
            yield from done(now, held)

    return rows.select("slice", "part", "blob").repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def dealt(docs: DataFrame, held, kinds: int, parts: int, log_base: Callable, ends: int, steps: Callable, tokens: Callable) -> DataFrame:
    """docs: doc_id, text, train.  The packed rows of each slice: its documents, texts, cached pairs, and others by part.

    Equal texts of a slice stand once, with as many customers as are trained on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, at_slice = held.value, TaskContext.get().partitionId() << 32
        n_list = len(w.kind) - 1
        base_of, end_base = np.concatenate([log_base(w.c), [0.0]]), float(log_base(ends))
        seen = np.concatenate([w.c > 0, [False]])
        for b in batches:
            for part in common.cut(b, SLICE):
                if not part.num_rows:
                    continue
                col, texts, copies = common.columns(part), {}, Counter()
                for text, train in zip(col["text"], col["train"]):
                    texts.setdefault(text or b"", len(texts))
                    copies[text or b""] += train
                us, ws, hs, classes, which, counts = [], [], [], [], [], []
                for text, i in texts.items():
                    words = tokens(text)
                    at = w.find(words)
                    cls = np.where(at >= 0, w.kind[at], 0)
                    for j in np.nonzero(at < 0)[0].tolist():
                        at[j] = number(words[j], w.index)
                    h, k = steps(cls, kinds)
                    us.append(np.concatenate([[n_list], at]))
                    ws.append(np.concatenate([at, [n_list]]))
                    hs.append(h)
                    classes.append(k)
                    which.append(np.full(len(k), i, np.int32))
                    listed = at[at >= 0]
                    counts.append((len(words) + 1, int(seen[listed].sum()) + (ends > 0), float(base_of[listed].sum()) + end_base))
                u, word, h, k, text = (np.concatenate(x) for x in (us, ws, hs, classes, which))
                weight = np.array([copies[t] for t in texts], np.int32)[text]
                frequent = (u >= 0) & ((u == n_list) | (w.kind[np.maximum(u, 0)] > 0))
                cached = frequent & (k > 0)
                places = [texts[t or b""] for t in col["text"]]
                rows = [
                    (DOCS, pack(DOCS, np.array([x or 0 for x in col["doc_id"]], np.int64), np.array([x is None for x in col["doc_id"]]), np.array(col["train"], bool), np.array(places, np.int32))),
                    (TEXTS, pack(TEXTS, *(np.array(x) for x in zip(*counts)))),
                    (CACHED, pack(CACHED, text[cached], (h * kinds + k)[cached], weight[cached])),
                ]
                u, word, h, text, weight, frequent = (x[~cached] for x in (u, word, h, text, weight, frequent))
                route = mixed(u)
                route[frequent] = mixed(route[frequent] ^ word[frequent].astype(np.uint64))
                to = part_of(route, parts)
                order = np.lexsort((word, u, to))
                to = to[order]
                u, word, h, text, weight = (x[order] for x in (u, word, h, text, weight))
                edges = [0, *(np.nonzero(np.diff(to))[0] + 1).tolist(), len(to)]
                for a, z in zip(edges, edges[1:]):
                    if z > a:
                        rows.append((int(to[a]), pack(0, *(x[a:z] for x in (u, word, h, text, weight)))))
                at_slice += 1
                yield pa.RecordBatch.from_arrays([pa.array([at_slice] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "part", "blob"])

    return common.kept(docs.select("doc_id", "text", "train").mapInArrow(run, SCHEMA), "dealt")


class Part:
    """The occurrences of a part in the order of their pairs, and its pairs."""

    def __init__(self, arrays: list[np.ndarray], w, kinds: int):
        self.u, self.word, self.h, self.text, self.weight, self.slice = arrays
        self.n_list = len(w.kind) - 1
        u, word = self.u, self.word
        n = len(u)
        new = np.ones(n, bool)
        new[1:] = (u[1:] != u[:-1]) | (word[1:] != word[:-1])
        self.pair = np.cumsum(new) - 1  # of each occurrence
        self.first = np.nonzero(new)[0]  # of each pair
        self.n = np.add.reduceat(self.weight.astype(np.int64), self.first)
        pu, pw = u[self.first], word[self.first]
        #: the class of a pair's word, and the context in the class table if its first word is frequent, else -1
        self.cls = np.where(pw < 0, 0, np.where(pw == self.n_list, 1, w.kind[np.maximum(pw, 0)]))
        kind = np.where(pu < 0, 0, w.kind[np.maximum(pu, 0)])
        self.context = np.where(pu == self.n_list, kinds, np.where(kind > 0, kind, -1))
        edge = np.ones(len(pu), bool)
        edge[1:] = pu[1:] != pu[:-1]
        self.rest = np.cumsum(edge) - 1
        self.keys = mixed(mixed(pu) ^ pw.astype(np.uint64))

    def totals(self, x: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Sums of x over the restaurant of each pair; those of frequent words are shared ones."""
        own = np.bincount(self.rest, weights=x)[self.rest]
        return np.where(self.context >= 0, shared[self.context], own)

    def tables(self, q: np.ndarray, d: float, strength: float, shared: np.ndarray, sweeps: int, burn_in: int) -> np.ndarray:
        """Tables of each pair, averaged over the sweeps past burn_in, on the totals of one table for each pair."""
        t = np.minimum(self.n, 1).astype(np.float64)
        at = np.nonzero(self.n > 1)[0]
        if not len(at):
            return t
        n, p = self.n[at], q[at]
        new = (strength + d * self.totals(t, shared)[at]) * p
        draws = Draws(self.keys[at])
        seated, total = Tables(n, seat_alone(n, new, d, draws), draws), np.zeros(len(at))
        for i in range(sweeps):
            seated.sweep(new, p, d, draws)
            if i >= burn_in:
                total += seated.count()
        t[at] = total / (sweeps - burn_in)
        return t


def gathered(rows: DataFrame, held, kinds: int) -> DataFrame:
    """One row for each part: its occurrences in the order of their pairs (blob); and with one table for each pair
    what it hands on: customers of the class table (pairs), of words (words), customers and tables of the restaurants
    of frequent words (hot), pairs of one and of two customers."""

    def f(part, found):
        arrays = joined(0, [b for _, _, b in found])
        arrays.append(np.repeat([s for _, s, _ in found], [len(unpack(0, b)[0]) for _, _, b in found]).astype(np.int64))
        # the order within a pair is that of the last frequent words, so slices don't matter
        order = np.lexsort((arrays[5], -np.minimum(arrays[4], 1), arrays[2], arrays[1], arrays[0]))
        p = Part([x[order] for x in arrays], held.value, kinds)
        # a pair's table was opened by its first customer
        opener = np.full(len(p.first), len(p.u))
        customers = np.nonzero(p.weight > 0)[0]
        np.minimum.at(opener, p.pair[customers], customers)
        learned = p.n > 0
        cells, n_cells = np.unique(p.h[opener[learned]].astype(np.int64) * kinds + p.cls[learned], return_counts=True)
        words, n_words = np.unique(p.word[p.first][learned & (p.cls == 0)], return_counts=True)
        hot = learned & (p.context >= 0)
        c, t = np.bincount(p.context[hot], weights=p.n[hot]).astype(np.int64), np.bincount(p.context[hot])
        some = np.nonzero(t)[0]
        rows_of = lambda *x: listed(dict(zip(("k", "n", "t"), x)))
        yield part, pack(1, p.u, p.word, p.h, p.text, p.weight, p.slice), rows_of(cells, n_cells), rows_of(words, n_words), rows_of(some, c[some], t[some]), int((p.n == 1).sum()), int((p.n == 2).sum())

    schema = "part int, blob binary, pairs array<struct<k:long,n:long>>, words array<struct<k:long,n:long>>, hot array<struct<k:long,n:long,t:long>>, n1 long, n2 long"
    return common.kept(sorted_by(rows.where("part >= 0"), "part", f, schema), "parts")


def cached_pairs(rows: DataFrame) -> DataFrame:
    """k, n: customers of pairs of two frequent words."""

    def run(c):
        _, pair, weight = joined(CACHED, c["blob"])
        n = np.bincount(pair, weights=weight).astype(np.int64)
        some = np.nonzero(n)[0]
        return {"k": some, "n": n[some]}

    return common.arrow_map(rows.where(F.col("part") == CACHED).select("blob"), run, "k long, n long")


def exploded(parts: DataFrame, name: str) -> DataFrame:
    return parts.select(F.explode(name).alias("x")).select("x.*")


class Model:
    """What a task needs to give probabilities: the list of words with their shares, the class table, totals of the restaurants of frequent words."""

    def __init__(self, words, matrix, customers: np.ndarray, tables: np.ndarray, d: float, strength: float, usual: float):
        self.words, self.matrix, self.customers, self.tables, self.d, self.strength, self.usual = words, matrix, customers, tables, d, strength, usual


def values(part: Part, model: Model, w, m: np.ndarray, sweeps: int, burn_in: int, shares: np.ndarray):
    """Of each occurrence what the parent predicts (for words without a share: of their class), and of each pair its tables."""
    word, cls = part.word, part.cls[part.pair]
    q = 10.0 ** m[part.h, cls].astype(np.float64)
    listed = (word >= 0) & (cls == 0)
    q[listed] *= shares[word[listed]]
    # new tables of words without a share are drawn with the usual one of such words
    mean = np.bincount(part.pair, weights=np.where(word < 0, q * model.usual, q) * part.weight) / np.maximum(part.n, 1)
    if_frequent = np.where(part.context >= 0, 10.0 ** m[np.maximum(part.context, 0), part.cls].astype(np.float64), 1.0)
    mean = mean / if_frequent  # after a frequent word the class table has drawn the class
    return q, part.tables(mean, model.d, model.strength, model.tables, sweeps, burn_in)


def hot_tables(parts: DataFrame, model: Model, kinds: int, sweeps: int, burn_in: int) -> np.ndarray:
    """Sampled tables of the restaurants of frequent words."""

    def run(c):
        out = np.zeros(kinds + 1)
        w, m, shares = model.words.value, model.matrix.value, 10.0 ** model.words.value.log_b
        for blob in c["blob"]:
            arrays = unpack(1, blob)
            u = arrays[0]
            frequent = (u >= 0) & ((u == len(w.kind) - 1) | (w.kind[np.maximum(u, 0)] > 0))
            if frequent.any():
                p = Part([x[frequent] for x in arrays], w, kinds)
                out += np.bincount(p.context, weights=values(p, model, w, m, sweeps, burn_in, shares)[1], minlength=kinds + 1)
        some = np.nonzero(out)[0]
        return {"k": some, "t": out[some]}

    out = np.zeros(kinds + 1)
    for k, t in common.arrow_map(parts.select("blob"), run, "k long, t double").groupBy("k").agg(F.sum("t")).collect():
        out[k] = t
    return out


def scored(parts: DataFrame, model: Model, drawn: np.ndarray, kinds: int, n_parts: int, sweeps: int, burn_in: int) -> DataFrame:
    """Sums for the texts of each slice (part SUMS), and what waits for the share of a word (by part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m, d = model.words.value, model.matrix.value, model.d
        shares = 10.0 ** w.log_b
        for b in batches:
            for blob in b.column(0).to_pylist():
                p = Part(unpack(1, blob), w, kinds)
                q, t = values(p, model, w, m, sweeps, burn_in, shares)
                below = model.strength + p.totals(p.n, model.customers)
                own, back = (p.n - d * t) / below, (model.strength + d * p.totals(t, drawn)) / below
                own, back = own[p.pair], back[p.pair]
                # after a frequent word: the class by the class table, the word by the restaurant
                after = p.context[p.pair] >= 0
                own[after] *= 10.0 ** m[p.h[after], 0].astype(np.float64)
                back *= q
                waits = p.word < 0
                rows = []
                s, text, v = p.slice[~waits], p.text[~waits], np.log10(own[~waits] + back[~waits])
                rows += sums(s, text, v, np.zeros(len(v)), np.zeros(len(v), np.int32))
                x = [a[waits] for a in (p.word, own, back, p.slice, p.text)]
                to = part_of(mixed(x[0]), n_parts)
                order = np.argsort(to, kind="stable")
                to, x = to[order], [a[order] for a in x]
                edges = [0, *(np.nonzero(np.diff(to))[0] + 1).tolist(), len(to)]
                rows += [(-1, int(to[a]), pack(OPEN, *(y[a:z] for y in x))) for a, z in zip(edges, edges[1:]) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["slice", "part", "blob"])

    return common.kept(parts.select("blob").mapInArrow(run, SCHEMA), "sums")


def sums(s: np.ndarray, text: np.ndarray, score: np.ndarray, base: np.ndarray, known: np.ndarray) -> list[tuple]:
    """Rows of sums for the texts of each slice."""
    order = np.lexsort((text, s))
    s, text, score, base, known = (x[order] for x in (s, text, score, base, known))
    if not len(s):
        return []
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    first = np.nonzero(new)[0]
    score, base, known = (np.add.reduceat(x, first) for x in (score, base, known))
    s, text = s[first], text[first]
    edges = [0, *(np.nonzero(np.diff(s))[0] + 1).tolist(), len(s)]
    return [(int(s[a]), SUMS, pack(SUMS, text[a:z], score[a:z], base[a:z], known[a:z])) for a, z in zip(edges, edges[1:])]


def closed(waiting: DataFrame, table: DataFrame, index, n_parts: int, log_base: Callable) -> DataFrame:
    """waiting: rows of scored by part.  table: word, c, log_b of all words.  Sums for the texts of each slice."""

    def deal(c):
        known = index.value.index
        x = [(number(w, known), n, s) for w, n, s in zip(c["word"], c["c"], c["log_b"]) if w not in known]
        if not x:
            return {"slice": [], "part": [], "blob": []}
        word, n, s = (np.array(y) for y in zip(*x))
        to = part_of(mixed(word), n_parts)
        order = np.argsort(to, kind="stable")
        to, word, n, s = to[order], word[order], n[order], s[order]
        edges = [0, *(np.nonzero(np.diff(to))[0] + 1).tolist(), len(to)]
        spans = list(zip(edges, edges[1:]))
        return {"slice": [-2] * len(spans), "part": [int(to[a]) for a, _ in spans], "blob": [pack(SHARES, word[a:z], n[a:z], s[a:z]) for a, z in spans]}

    def f(part, found):
        word, c, log_b = joined(SHARES, [b for _, s, b in found if s == -2])
        order = np.argsort(word)
        word, c, log_b = word[order], c[order], log_b[order]
        for _, s, blob in found:
            if s == -2:
                continue
            w, own, back, at_slice, text = unpack(OPEN, blob)
            at = np.searchsorted(word, w)
            # a share may underflow where nothing else counts: its logarithm is kept
            with np.errstate(divide="ignore"):
                v = np.where(own > 0, np.log10(own + back * 10.0 ** log_b[at]), np.log10(back) + log_b[at])
            yield from sums(at_slice, text, v, log_base(c[at]), (c[at] > 0).astype(np.int32))

    rows = waiting.where("part >= 0").unionByName(common.arrow_map(table.select("word", "c", "log_b"), deal, SCHEMA))
    return sorted_by(rows, "part", f, SCHEMA)


def documents(rows: DataFrame, matrix) -> DataFrame:
    """rows: all rows by slice.  One row for each document."""

    def f(at_slice, found):
        of = lambda kind: joined(kind, [b for p, _, b in found if p == kind])
        n, known, base = of(TEXTS)
        text, pair, _ = of(CACHED)
        score = np.bincount(text, weights=matrix.value.ravel()[pair].astype(np.float64), minlength=len(n))
        text, more, more_base, more_known = of(SUMS)
        score = score + np.bincount(text, weights=more, minlength=len(n))
        base = base + np.bincount(text, weights=more_base, minlength=len(n))
        known = known + np.bincount(text, weights=more_known, minlength=len(n)).astype(np.int64)
        doc_id, null, train, at = of(DOCS)
        yield (listed({"doc_id": pa.array(doc_id, mask=null > 0), "train": train > 0, "n_tokens": n[at], "n_known": known[at], "base_score": base[at], "score": score[at]}),)

    schema = "docs array<struct<doc_id:long,train:boolean,n_tokens:long,n_known:long,base_score:double,score:double>>"
    return sorted_by(rows, "slice", f, schema).select(F.explode("docs").alias("x")).select("x.*")
