import random
import re
from collections import Counter

import pytest

from siftloom.llm import substrings
from helpers import EDGE, docs, prose


def plain(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        drop = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(drop), [x for j, x in enumerate(w) if j not in drop]))
    return out


def texts(seed):
    r = random.Random(seed)
    base = prose(seed, 60, words=60)
    line = " ".join(prose(seed + 1, 1, words=30)[:1])
    out = list(base)
    for t in base[:25]:  # shared passages in other surroundings, one line that many have
        w = t.split()
        a = r.randrange(len(w))
        out.append(" ".join(prose(r.random(), 1, 20)[:1]) + " \t" + " ".join(w[a : a + r.randint(10, 60)]) + "\n" + line)
    out += ["x " * 100, "a b " * 50, "a b c d e f g " * 20 + "z", " ".join(map(str, range(80))), " ".join(map(str, range(40, 80))) + " end"]
    return out


@pytest.mark.parametrize("window,hot", [(35, 4096), (12, 32)])
def test_against_brute_force(spark, monkeypatch, window, hot):
    monkeypatch.setattr(substrings, "HOT_STRINGS", hot)
    monkeypatch.setattr(substrings, "SAMPLE", 4096 // 16 if hot == 4096 else 2)
    rows = EDGE + [(100 + i, t) for i, t in enumerate(texts(window))]
    if hot == 32:
        assert substrings.hot_minimisers(docs(spark, [(i, f"{i} " + " ".join("abcdefghijklm") + f" {i} {i}") for i in range(200)]), window)
        rows += [(1000 + i, f"{i} q{i} " + " ".join("abcdefghijklm") + f" {i} {i}") for i in range(200)]
    got = substrings.dedup_substrings(docs(spark, rows), window).collect()
    want = plain([t for _, t in rows], window)
    have = sorted(((r.doc_id, r.n_words, r.n_removed, re.findall(r"[^\x20\x09-\x0D]+", r.kept_text)) for r in got), key=str)
    assert have == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=str)
    untouched = {r.doc_id: r.kept_text for r in got if not r.n_removed}
    assert all(untouched[i] == (t or "") for i, t in rows if i in untouched and i is not None and i != 6)


def test_empty_table(spark):
    assert substrings.dedup_substrings(docs(spark, [])).count() == 0
