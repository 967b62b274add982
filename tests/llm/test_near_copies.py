import random

import numpy as np

import corpus_pipeline
from siftloom.llm import common, components, near_copies, simhash
from helpers import EDGE, docs, prose


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def plain_groups(texts, least=0.8):
    s, root = [sets(t) for t in texts], list(range(len(texts)))
    for i in range(len(s)):
        for j in range(i):
            if len(s[i] & s[j]) >= least * len(s[i] | s[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def near(r, text, changes):
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_every_pair_of_similarity_08_is_joined(spark):
    r = random.Random(5)
    texts = prose(5, 60, words=150)
    texts += [near(r, t, r.choice([1, 2, 3, 4, 6])) for t in texts for _ in range(2)]
    hot = prose(6, 1, words=200)[0]
    texts += [near(r, hot, r.choice([1, 2, 3, 5])) for _ in range(80)]
    r.shuffle(texts)
    root = plain_groups(texts)
    df = docs(spark, list(enumerate(texts)))
    got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted(set(root))
    assert len(simhash.one_of_each(df).collect()) > len(got)  # four bits of 64 lose copies


def test_edge_cases(spark):
    got = [r.doc_id for r in near_copies.one_of_each(docs(spark, EDGE + [(None, "null id has words too"), (None, None)])).collect()]
    assert sorted(got, key=str) == sorted([1, 4, 6, 7, 8, None], key=str)
    assert near_copies.one_of_each(docs(spark, [])).count() == 0


def test_fingerprints_are_simhashes_of_shingle_sets():
    s = near_copies.shingles(b"a b c d e f g h i a b c d e f", 5)
    got = np.unpackbits(np.frombuffer(near_copies.fingerprint(s, 4), np.uint8))
    votes = near_copies.hashed(s, 4).astype(int)
    assert got.tolist() == [int(2 * v.sum() > len(s) or (2 * v.sum() == len(s) and v[0] == 1)) for v in votes.T]


def test_groups_are_searched_whole_and_in_parts(spark, monkeypatch):
    r = random.Random(8)
    texts = prose(8, 20, words=60)
    texts += [near(r, t, r.choice([1, 2, 4, 8])) for t in texts for _ in range(4)]
    texts = list({near_copies.key(t.encode()): t for t in texts}.values())
    root = plain_groups(texts)
    s = [near_copies.shingles(t.encode(), 5) for t in texts]
    want = [root.index(g) for g in root]
    assert near_copies.similar(s, 0.8).tolist() == want
    df, t = docs(spark, list(enumerate(texts))), [near_copies.key(x.encode()) for x in texts]
    members = spark.createDataFrame([(x, 7) for x in t], "node long, root long")  # one component of candidates
    monkeypatch.setattr(near_copies, "GROUP_BYTES", sum(8 * len(x) for x in s) // 5)
    links = near_copies.verified(members, df, 5, 0.8)
    root = {x: x for x in t}
    root |= {x.node: x.root for x in components.components(links).collect()}
    assert [[root[x] == root[y] for y in t] for x in t] == [[x == y for y in want] for x in want]


def test_rows_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = [near(r, " ".join(base), 6) for _ in range(400)]  # near to the least text or to each other at about 0.7
    most, kept = [], common.kept

    def counted(df, name):
        out = kept(df, name)
        most.append((out.count(), name))
        return out

    monkeypatch.setattr(common, "kept", counted)
    got = near_copies.one_of_each(docs(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(set(plain_groups(texts)))
    assert max(most)[0] <= 20 * len(texts), max(most)


def test_what_a_text_sends_grows_slowly():
    sent = lambda texts: (how := near_copies.blocks(texts)).n * (1 + how.low) * near_copies.ENTRY.itemsize
    assert sent(220_000) <= 1.5 * sent(44_000)
    assert sent(13_000_000) <= 25 * sent(44_000)  # more bits a block, so more blocks, and nine copies


def test_a_bucket_in_passes_finds_the_same(monkeypatch):
    r = random.Random(10)
    texts = prose(10, 150, words=60)
    texts += [near(r, t, r.choice([1, 2, 4])) for t in texts for _ in range(3)]
    how = near_copies.Blocks(16, 4, 2)
    t = np.arange(len(texts))
    bucket, e = near_copies.entries(t, [near_copies.fingerprint(near_copies.shingles(x.encode(), 5), how.words) for x in texts], how, range(how.n))
    some = np.unique(bucket)
    want = [near_copies.met(e[bucket == b], int(b), how).tolist() for b in some]
    monkeypatch.setattr(simhash, "AT_ONCE", 500)
    assert [near_copies.met(e[bucket == b], int(b), how).tolist() for b in some] == want
    assert sum(x != list(range(len(x))) for x in want) > 4


def test_sets_are_shuffled_once(spark, monkeypatch):
    texts = prose(11, 40, words=60)
    members = spark.createDataFrame([(near_copies.key(x.encode()), 7) for x in texts], "node long, root long").distinct()
    plans, kept = {}, common.kept

    def looked(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(common, "kept", looked)
    near_copies.verified(members, docs(spark, list(enumerate(texts))), 5, 0.8)
    assert "strategy=broadcast" in plans["similar"] and "strategy=broadcast" in plans["shingles"]
