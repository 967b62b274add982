import random
from collections import defaultdict

import pytest

from siftloom.llm import mixing
from helpers import EDGE, docs, prose


def filled(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Water-filling by rounds: what a full source can't take is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target = sum(sizes.values()) * share, dict.fromkeys(order, 0.0)
    open_ = set(order)
    while open_ and left > 1e-9:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + each * weight[s] >= most * sizes[s]}
        if not full:
            for s in open_:
                target[s] += each * weight[s]
            break
        for s in full:
            left -= most * sizes[s] - target[s]
            target[s] = most * sizes[s]
        open_ -= full
    return target


@pytest.mark.parametrize("case", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 10, "d": 3}, {"a": 1, "b": 1000, None: 50}, {"b": 0, "a": 7}, {"é": 5, "z": 5, "Z": 90}, {"only": 11}])
def test_targets_by_rounds(spark, case):
    df = spark.createDataFrame(list(case.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(filled(case))


def test_words_taken(spark):
    r = random.Random(5)
    rows = EDGE + [(100 + i, t) for i, t in enumerate(prose(7, 200))] + [(None, f"no id {i} {'w ' * (i % 5)}") for i in range(40)] + [(7, "same id other text"), (7, "same id text other")]
    r.shuffle(rows)
    df = docs(spark, rows)
    runs = []
    for n in (1, 6):
        got = mixing.mix(df.repartition(n)).collect()
        assert len(got) == len(rows)
        runs.append(sorted(((x.doc_id, x.source, x.size, x.taken) for x in got), key=str))
        sizes, taken = defaultdict(int), defaultdict(int)
        for x in got:
            sizes[x.source] += x.size
            taken[x.source] += x.taken
            assert 0 <= x.taken <= 2 * x.size
        want = filled(sizes)
        assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert runs[0] == runs[1]


def test_null_ids_do_not_share_a_bin(spark):
    df = docs(spark, [(None, f"text {i}") for i in range(300)])
    got = mixing.mix(df, carry=("text",)).collect()
    by_source = defaultdict(set)
    for x in got:
        by_source[x.source].add(x.taken)
    assert len(got) == 300 and any(len(v) > 1 for v in by_source.values())


def test_empty_table_and_texts(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert {(x.size, x.taken) for x in mixing.mix(docs(spark, [(1, None), (2, " ")])).collect()} == {(0, 0)}
