import random
from collections import Counter

import corpus_pipeline
from siftloom.llm import mixing, simhash
from helpers import EDGE, docs, prose
from test_near_copies import plain_groups
from test_substrings import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, tmp_path):
    """Good prose with copies and shared passages, bad runs of one word, and labels for most."""
    r = random.Random(31)
    texts = prose(31, 160, words=70)
    texts[10] += " " + " ".join(texts[11].split()[:60])
    texts[60] = texts[61] + " tail " + texts[62]
    bad = [" ".join([w] * 60 + ["!!", "###"] * 20) for w in ("of", "the", "sale", "win", "x9") for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts + bad)] + [(None, "a text without an id " * 2), (None, "a text without an id " * 2), (3, texts[3]), (5000, None), (5001, "")]
    df = docs(spark, rows).select(*COLUMNS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < len(texts)), 0) for i in range(len(texts) + len(bad)) if r.random() < 0.8]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return len(texts)


def test_stages_against_brute_force(spark, tmp_path):
    n_good = corpus(spark, tmp_path)
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in now.collect()]
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(path := f"{tmp_path}/out-{k}")
        now = spark.read.parquet(path)
        after = now.collect()
        if k < 4:
            assert now.columns == COLUMNS, name
        if k == 0:
            assert not Counter(map(tuple, after)) - Counter(before)
            ids = [r.doc_id for r in after if r.doc_id is not None]
            assert sum(i < n_good for i in set(ids)) > 0.95 * n_good and sum(n_good <= i < 5000 for i in ids) < 3
        elif k == 1:
            # the stage takes five words and a similarity of 0.8, as its contract says, not the fingerprints of op3
            root = plain_groups([b[1] for b in before])
            groups = {}
            for b, g in zip(before, root):
                groups.setdefault(g, []).append(b)
            left = Counter()
            for r in after:
                mine = [g for g, members in groups.items() if r.text in [b[1] for b in members]]
                assert len(mine) == 1
                ids = [b[0] for b in groups[mine[0]] if b[0] is not None]
                assert r.doc_id == (min(ids) if ids else None)
                left[mine[0]] += 1
            assert set(left) == set(groups) and set(left.values()) == {1}
        elif k == 2:
            want = plain([b[1] for b in before], 35)
            have = {r.doc_id: r for r in after}
            assert len(after) == len(before)
            for b, (_, n, words) in zip(before, want):
                assert have[b[0]].text == (" ".join(words) if n else b[1] or "") and have[b[0]].lang == b[2]
                assert not n or have[b[0]].n_chars == len(have[b[0]].text)
            assert any(n for _, n, _ in want)
        elif k == 3:
            sizes = {b[0]: len(b[1].encode().split()) for b in before}
            total = {r.doc_id: 0 for r in after}
            for r in after:
                total[r.doc_id] += len(r.text.encode().split())
            want = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
            assert {i: n for i, n in want.items() if n} == {i: n for i, n in total.items() if n}
            assert all(n <= 2 * sizes[i] for i, n in total.items())
        else:
            assert Counter(r.doc_id for r in after) == Counter(b[0] for b in before) and all(r.round_trip and r.n_ids == len(r.ids) for r in after)


def test_one_of_each_on_edge_cases(spark):
    got = [r.doc_id for r in simhash.one_of_each(docs(spark, EDGE + [(None, "null id has words too"), (None, None)])).collect()]
    assert sorted(got, key=str) == sorted([1, 4, 6, 7, 8, None], key=str)
    assert simhash.one_of_each(docs(spark, [])).count() == 0
