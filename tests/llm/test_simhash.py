import random

import numpy as np
import xxhash

from siftloom.llm import components, simhash
from helpers import EDGE, docs, prose


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(set(fps))
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def check(spark, rows):
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(fps, 4)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f, least.get(root[f])) for (i, _), f in zip(rows, fps)), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want


def test_fingerprint():
    for t in [None, "", " \n", "A", "A b C", "a b c d", "É ÉA zz\x0bq w e", *prose(1, 30)]:
        assert simhash.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)
    long = " ".join(prose(2, 3000))
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)


def test_edges_and_prose(spark):
    check(spark, EDGE + [(100 + i, t) for i, t in enumerate(prose(3, 150))])


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_connect_all_within_radius(spark, monkeypatch):
    """A dense group, chains and strangers; small buckets and several passes over one."""
    monkeypatch.setattr(simhash, "FILL", 20)
    monkeypatch.setattr(simhash, "AT_ONCE", 50_000)
    r = random.Random(5)
    centre = r.getrandbits(64)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    fps = {centre} | {flip(centre, r.randint(1, 3)) for _ in range(150)} | {r.getrandbits(64) for _ in range(200)}
    for x in list(fps)[:60]:
        for n in (1, 2, 3, 4, 5):
            fps.add(flip(x, n))
    x = r.getrandbits(64)
    for _ in range(30):
        fps.add(x := flip(x, 4))
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long").repartition(3))
    got = {a.node % 2**64: a.root % 2**64 for a in components.components(links).collect()}
    want = plain_components(list(fps), 4)
    groups = lambda m: sorted(sorted(f for f in fps if m.get(f, f) == k) for k in {m.get(f, f) for f in fps})
    assert groups(got) == groups(want)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 300)]
    rows = path + star + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(300)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
