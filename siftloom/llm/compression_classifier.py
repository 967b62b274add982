"""A quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good and one from
text labelled bad.  Every whole text is cut into pieces of PIECE bytes and each
piece is compressed with both.  What the bad dictionary costs more, for each
byte, is high for good text.  A logistic function, fitted on labelled rows that
the dictionaries have not seen, turns these differences into a probability.

Only the fit uses a sample: at most ``dict_rows + fit_rows`` labelled rows of
each class, the first by a hash of doc_id.  Every document is scored.
"""

from __future__ import annotations

import math
import random

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PIECE, LEVEL, DICT_BYTES = 1024, 3, 112_640
#: Bytes that a text counts more than it has, so that a few bytes decide little.
SMOOTH = 64


def train_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary from the texts; too few of them are the dictionary themselves."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    random.Random(7).shuffle(pieces)
    try:
        return zstandard.train_dictionary(size, pieces, k=1000, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:size] or b"\n"


def own_lines(good: list[bytes], bad: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Both without the lines that either class has: licence lines and the like say nothing."""
    both = {x for t in good for x in t.split(b"\n")} & {x for t in bad for x in t.split(b"\n")}
    drop = lambda texts: [b"\n".join(x for x in t.split(b"\n") if x not in both) for t in texts]
    return drop(good), drop(bad)


class Sizes:
    """Features of a text from its sizes under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (self.compressor(d) for d in (good, bad))

    @staticmethod
    def compressor(content: bytes):
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress

    def features(self, text: bytes | None) -> list[float]:
        text = text or b""
        good = bad = 0
        least = 1.0
        for i in range(0, len(text), PIECE):
            p = text[i : i + PIECE]
            g, b = len(self.good(p)), len(self.bad(p))
            good, bad = good + g, bad + b
            if not i or len(p) > PIECE // 2:
                least = min(least, (b - g) / (len(p) + SMOOTH))
        n = len(text) + SMOOTH
        return [10 * (bad - good) / (bad + good + SMOOTH), 10 * (bad - good) / n, 10 * min(least, 1.0) if text else 0.0]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Weights of a logistic regression, the bias first, by Newton's method."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        h = a.T @ (a * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weight * (p - y)) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


class Model:
    """good and bad: dictionaries; weights of the logistic function. Without both classes the score is the share of good rows."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float] | None, prior: float):
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior

    def scorer(self):
        if self.weights is None:
            return lambda text: self.prior
        sizes, w = Sizes(self.good, self.bad), self.weights

        def score(text: bytes | None) -> float:
            z = w[0] + sum(a * b for a, b in zip(w[1:], sizes.features(text)))
            return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))

        return score


def train(docs: DataFrame, labels: DataFrame, dict_rows: int = 1500, fit_rows: int = 3000) -> Model:
    """docs: doc_id, text; labels: doc_id, quality.  Rows without a label or an id are not learned from.

    Only dict_rows and fit_rows bound what is learned from; texts count whole.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    if len(counts) < 2:
        return Model(b"\n", b"\n", None, prior)
    order = (F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id"))
    most = dict_rows + fit_rows
    # at most 2 * most rows, whatever the input; ids only, so this is safe to broadcast
    picked = [rows.where(F.col("quality") == q).orderBy(*order).limit(most) for q in (0, 1)]
    ids = [(int(r[0]), q, i) for q, df in enumerate(picked) for i, r in enumerate(df.select("doc_id").collect())]
    n = [sum(1 for r in ids if r[1] == q) for q in (0, 1)]
    cut = [dict_rows if n[q] >= 2 * dict_rows else max(1, n[q] // 2) for q in (0, 1)]
    ids = spark.createDataFrame([(d, q, i < cut[q]) for d, q, i in ids], "s_id long, quality int, for_dict boolean")
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("s_id"))
    sample = common.kept(sample.select("doc_id", "quality", "for_dict", "text"), "sample")
    got = sample.where("for_dict").select("quality", F.encode("text", "UTF-8"), "doc_id").orderBy("doc_id").collect()
    good, bad = ([bytes(r[1]) for r in got if r[0] == q and r[1]] for q in (1, 0))
    good, bad = own_lines(good, bad)
    good, bad = train_dictionary(good), train_dictionary(bad)

    def features(c):
        f = Sizes(good, bad).features
        return {"quality": c["quality"], "x": [f(t) for t in c["text"]]}

    got = common.arrow_map(sample.where(~F.col("for_dict")).select("quality", "text"), features, "quality int, x array<double>").collect()
    y = np.array([r[0] for r in got], dtype=float)
    if len(set(y.tolist())) < 2:
        return Model(good, bad, None, prior)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    return Model(good, bad, fit(np.array([r[1] for r in got]), y, weight * len(y) / weight.sum()), prior)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs: doc_id, text; other columns are ignored.

    One row for each row of docs: doc_id, score, predicted.  A null text scores
    as an empty one; equal texts score equally; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES at most

    def run(c):
        score = held.value.scorer()
        s = [score(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "score": s, "predicted": [int(v >= threshold) for v in s]}

    return common.arrow_map(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores threshold or more."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = None
        for b in batches:
            score = score or held.value.scorer()
            for part in common.cut(b):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                yield part.filter(pa.array([score(t) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~common.held_out(F.col("doc_id"), 5)))
    out = classify(docs, model)
    return out.select("doc_id", common.held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")
