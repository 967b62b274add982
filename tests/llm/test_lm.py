import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftloom.llm import common, lm
from helpers import EDGE, docs, prose


def plain_base(rows):
    """rows: (doc_id, text, train).  (n_tokens, n_known, train_tokens, base_score) of each."""
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None] for _, t, _ in rows]
    c = Counter(w for x, (_, _, train) in zip(toks, rows) if train for w in x)
    n, v = sum(c.values()), len(c)
    return [(len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) for x in toks]


def test_spelled_contexts():
    words = [b"ab", b"\xc3\xa9", b"xyzw"]
    contexts, dish, first = lm.spelled(words, 3)
    assert dish.tolist() == [97, 98, 256, 0xC3, 0xA9, 256, 120, 121, 122, 119, 256] and first.tolist() == [0, 3, 6]
    digits = lambda x, n: [x // 258**k % 258 for k in range(n)]
    assert digits(contexts[3][2], 3) == [98, 97, 257] and digits(contexts[3][6], 3) == [257] * 3
    assert digits(contexts[3][10], 3) == [119, 122, 121] and contexts[1][1] == 97 and contexts[0].sum() == 0


def test_steps_look_past_rare_words():
    context, cls = lm.steps(np.array([5, 0, 0, 7, 0]), 9)
    assert context.tolist() == [9, 5, 5, 5, 7, 7] and cls.tolist() == [5, 0, 0, 7, 0, 1]
    assert [x.tolist() for x in lm.steps(np.array([], np.int64), 9)] == [[9], [1]]


@pytest.mark.parametrize("top", [60, 5])
def test_scores(spark, top):
    texts = prose(11, 120, words=40, vocabulary=150)
    rows = EDGE + [(100 + i, t) for i, t in enumerate(texts)] + [(900, "Zzz qqq unseenword"), (100, texts[0])]
    df = docs(spark, rows).withColumn("train", ~common.held_out(F.col("doc_id"), 3))
    got = lm.score(df, hot=20, top=top, chars=2).collect()
    train = {r.doc_id: r.train for r in df.select("doc_id", "train").collect()}
    want = plain_base([(i, t, train[i]) for i, t in rows])
    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str)
    assert have == sorted(((i, *w[:3], round(w[3], 6)) for (i, _), w in zip(rows, want)), key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = [r.score for r in got if r.doc_id in (6, 9)]
    assert max(same) - min(same) < 1e-9


def test_held_out_perplexity_gains_from_contexts_and_spelling(spark):
    """Words that follow one another, and unseen words made of seen syllables."""
    r = random.Random(14)
    syllables = ["ka", "lo", "mi", "ter", "vun"]
    follow = {w: r.sample(range(40), 3) for w in range(40)}
    texts = []
    for _ in range(150):
        w, out = r.randrange(40), []
        for _ in range(40):
            w = r.choice(follow[w])
            out.append(f"w{w}" if r.random() < 0.9 else "".join(r.choice(syllables) for _ in range(4)))
        texts.append(" ".join(out))
    df = docs(spark, list(enumerate(texts))).withColumn("train", F.col("doc_id") % 5 != 0)
    ppl = {x.train: x for x in lm.perplexity(lm.score(df, hot=30, top=100, chars=2)).collect()}
    assert ppl[False].perplexity < 0.5 * ppl[False].base_perplexity


def test_the_word_probabilities_sum_to_at_most_one(spark):
    texts = prose(12, 60, vocabulary=80)
    df = docs(spark, [(i, t) for i, t in enumerate(texts)]).withColumn("train", F.lit(True))
    vocab = common.kept(lm.vocabulary(df), "v")
    model, chars = lm.spelling(vocab, 2), 2
    hot = {w: 1 for w in sorted({w for t in texts for w in lm.tokens(t.encode())})[:10]}
    rows = lm.rare_words(vocab, model, chars, hot).collect()
    total = sum(10**r.log_b for r in rows if r.log_b is not None)
    assert 0.5 < total <= 1.001 and all((r.log_b is None) == (r.word.encode() in hot) for r in rows)


def test_partitions_do_not_change_scores(spark):
    texts = prose(17, 90, words=30, vocabulary=200)
    df = docs(spark, EDGE[:-1] + [(100 + i, t) for i, t in enumerate(texts)]).withColumn("train", ~common.held_out(F.col("doc_id"), 4))
    runs = []
    for n, shuffles in ((1, "3"), (7, "5")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        try:
            runs.append(sorted(((r.doc_id, r.n_tokens, round(r.score, 9), round(r.base_score, 9)) for r in lm.score(df.repartition(n), hot=20, top=50).collect()), key=str))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1]


def test_class_probabilities_sum_to_one(spark):
    r = random.Random(5)
    kinds = 9
    pairs = Counter(r.choice([0, 3, 9]) * kinds + min(8, int(r.expovariate(0.4))) for _ in range(900))
    m = 10.0 ** lm.class_matrix(spark.createDataFrame(list(pairs.items()), "pair long, n long"), kinds)
    assert m.shape == (10, 9) and np.allclose(m.sum(axis=1), 1, atol=1e-4)
    for u in (0, 3, 9):
        n = np.array([pairs[u * kinds + k] for k in range(kinds)])
        assert np.abs(m[u] - n / n.sum()).max() < 0.03


def test_no_training_texts_and_no_texts(spark):
    df = docs(spark, [(1, "a b"), (2, None)]).withColumn("train", F.lit(False))
    got = lm.score(df).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got) and len(got) == 2
    assert lm.score(docs(spark, []).withColumn("train", F.lit(True))).count() == 0


def test_pairs_outside_the_list_have_counts_of_their_own(spark):
    """Words that are always followed by one word each, with a list that holds almost none of them."""
    r = random.Random(23)
    follow = r.sample(range(200), 200)
    texts = []
    for _ in range(300):
        w, out = r.randrange(200), []
        for _ in range(30):
            out.append(f"w{w}")
            w = follow[w] if r.random() < 0.9 else r.randrange(200)
        texts.append(" ".join(out))
    df = docs(spark, list(enumerate(texts))).withColumn("train", F.col("doc_id") % 5 != 0)
    for hot, top in ((4, 100), (0, 4)):
        ppl = {x.train: x for x in lm.perplexity(lm.score(df, hot=hot, top=top, chars=2)).collect()}
        assert ppl[False].perplexity < 10 < 100 < ppl[False].base_perplexity, (hot, top)


@pytest.mark.parametrize("hot,top", [(3, 20), (3, 5)])
def test_next_word_probabilities_sum_to_at_most_one(spark, hot, top):
    """Texts of one word more: the difference of the scores is what that word and the end have."""
    texts = ["a b c d a b", "b c a e f", "a c g h", "c c b a", "d e f g"]
    words = sorted({w for t in texts for w in t.split()})
    rows = [(i, t, True) for i, t in enumerate(texts)]
    rows += [(100 + i, f"{u} {w}", False) for i, (u, w) in enumerate((u, w) for u in words for w in words)]
    rows += [(1000 + i, w, False) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {x.doc_id: 10**x.score for x in lm.score(df, hot=hot, top=top).collect()}
    # of a start: each word with the end, and each two words with the end
    assert 0.05 < sum(got[i] for i in got if i >= 100) <= 1.001
