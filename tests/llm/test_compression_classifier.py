import math
import random

import pytest
from pyspark.sql import functions as F

from siftloom.llm import common, compression_classifier as cc
from helpers import EDGE, docs


def corpus(n=240, seed=3):
    """Good texts of one vocabulary in sentences, bad ones of another or of shouting, and their labels."""
    r = random.Random(seed)
    words = lambda k, s: ["".join(random.Random(f"{s}{i}").choice("abcdefghijklmnop") for _ in range(3 + i % 5)) for i in range(k)]
    good, bad = words(300, "g"), words(60, "b")
    texts, labels = [], []
    for i in range(n):
        if i % 2:
            texts.append(". ".join(" ".join(r.choice(good) for _ in range(9)).capitalize() for _ in range(r.randint(2, 9))))
        else:
            texts.append(" ".join(r.choice(bad).upper() + "!!" * (r.random() < 0.3) for _ in range(r.randint(10, 90))))
        labels.append((i, i % 2))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus()
    df, l = docs(spark, list(enumerate(texts))), spark.createDataFrame(labels, "doc_id long, quality int")
    model = cc.train(df, l.where(~common.held_out(F.col("doc_id"), 5)))
    held = {r.doc_id for r in df.where(common.held_out(F.col("doc_id"), 5)).select("doc_id").collect()}
    got = {r.doc_id: r for r in cc.classify(df, model).collect()}
    assert len(held) > 20 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    right = sum(got[i].predicted == y for i, y in labels if i in held)
    assert right / len(held) > 0.95
    # a score is a probability: its mean is near the share of good ones
    assert abs(sum(got[i].score for i in held) / len(held) - sum(y for i, y in labels if i in held) / len(held)) < 0.1
    kept = cc.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_features_against_plain_sizes():
    import zstandard

    good, bad = b"the tide comes in " * 50, b"BUY NOW " * 50
    text = ("the tide comes in and goes out. " * 90).encode()
    sizes = []
    for d in (good, bad):
        c = zstandard.ZstdCompressor(level=cc.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False)
        sizes.append(sum(len(c.compress(text[i : i + cc.PIECE])) for i in range(0, len(text), cc.PIECE)))
    f = cc.Sizes(good, bad).features(text)
    assert f[0] == pytest.approx(10 * (sizes[1] - sizes[0]) / (sum(sizes) + cc.SMOOTH)) and f[0] > 0 > cc.Sizes(bad, good).features(text)[0]


def test_edges(spark):
    texts, labels = corpus(80)
    long = "BUY NOW!! " * 40_000
    rows = list(enumerate(texts)) + [(1000 + (i or 0), t) for i, t in EDGE] + [(None, texts[1]), (2000, texts[1]), (2001, long)]
    df = docs(spark, rows)
    l = spark.createDataFrame(labels + [(None, 1), (3, 0), (7, 5), (9, None)], "doc_id long, quality int")
    out = cc.classify(df, cc.train(df, l)).collect()
    assert len(out) == len(rows) and all(math.isfinite(r.score) for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[None] == by[2000] == by[1] and by[1002] == by[1001]  # equal texts; null as empty
    assert cc.classify(docs(spark, []), cc.train(df, l)).count() == 0
    # one class or none: the share of good rows
    assert {r.score for r in cc.classify(df, cc.train(df, l.where("quality = 1"))).collect()} == {1.0}
    assert {r.score for r in cc.classify(df, cc.train(df, l.where("false"))).collect()} == {0.5}


def test_logistic_fit():
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(size=(4000, 2))
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    w = cc.fit(x, y, np.ones(4000))
    assert np.allclose(w, [0.5, 2, -1], atol=0.2)
