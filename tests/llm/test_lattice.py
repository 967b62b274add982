import random

import pytest

from siftloom.llm import lattice
from helpers import EDGE, docs, prose

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")

TEXTS = ["", " ", "    ", "   a", "a   ", "a\nb \n c", "<s> <0x0A> <unk>", "x\0y", "é\U0001f600 \U0001f600é", "　a 　 b", "Hello world, this is SentencePiece.", "1234567890 12 3.14", "a▁b ▁", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 60, "supercalifragilistic" * 5, "x" * 70 + " y", " " * 40 + "z", "internationalization the and of"]


def library(texts):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH).encode(texts)


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_like_the_library(spark, monkeypatch, most):
    monkeypatch.setattr(lattice, "MOST_WORDS", most)
    rows = EDGE + [(100 + i, t) for i, t in enumerate(TEXTS + prose(21, 60) + prose(22, 5, vocabulary=9))] + [(100, TEXTS[10])]
    got = lattice.sentencepiece(docs(spark, rows), PATH).collect()
    want = sorted(((i, x) for (i, _), x in zip(rows, library([t or "" for _, t in rows]))), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    assert all(r.n_ids == len(r.ids) and r.round_trip == (r.doc_id != 100 + TEXTS.index("a▁b ▁")) for r in got)


def test_both_folds_agree(spark, monkeypatch):
    m = lattice.model(PATH)
    df = docs(spark, list(enumerate(TEXTS + prose(23, 40))))
    a = sorted(map(tuple, lattice.encoded_words(df, m).collect()))
    monkeypatch.setattr(lattice, "BITS", 3)
    b = sorted(map(tuple, lattice.encoded_words(df, m).collect()))
    assert a == b and len(a) > 100


def test_parts_and_words_are_the_whole_text():
    m = lattice.model(PATH)
    for t in TEXTS + prose(29, 20) + ["\n a\n  b ", "  ", " x  y ", "a  ", "\u3000  \u3000"]:
        assert [w for p in m.parts(t) for w in m.words_of(p)] == m.words(t)


def test_a_very_long_word(spark):
    """A run without spaces is one word; its fold stays near linear."""
    r = random.Random(8)
    text = "".join(r.choice("abcdeinrst") for _ in range(60_000))
    assert lattice.sentencepiece(docs(spark, [(1, text)]), PATH).first().ids == library([text])[0]


def test_words_are_not_shuffled_for_their_group(spark):
    m = lattice.model(PATH)
    words = lattice.distinct_words(docs(spark, [(1, "a b")]), spark.sparkContext.broadcast(m))
    plan = lattice.merge_fold(lattice.lattice(words, m))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_decode_like_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    lib, m = SentencePieceProcessor(model_file=PATH), lattice.model(PATH)
    r = random.Random(2)
    cases = [lib.encode(t) for t in TEXTS] + [[259, 259], [0, 1, 2], [3 + 0xC3, 3 + 0xA9], [r.randrange(259, 32000) for _ in range(30)]]
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(cases)] + [(-1, None, "x")], "doc_id long, ids array<int>, decoded string")
    got = {x.doc_id: x.decoded for x in lattice.decode(df, m).collect()}
    assert got.pop(-1) == ""
    del got[len(TEXTS) + 1]  # the library writes a sign for an unknown id
    assert all(got[i] == lib.decode(cases[i]) for i in got)


def test_viterbi_against_all_paths(spark):
    r = random.Random(4)
    alphabet = "abc"
    names = {"".join(r.choice(alphabet + lattice.SPACE) for _ in range(r.randint(1, 4))) for _ in range(40)}
    names = [n for n in names if lattice.SPACE not in n[1:]]
    m = lattice.Model.of_pieces([(p, -r.random() * 9, i + 5) for i, p in enumerate(sorted(names))], {}, True)
    score = {p: s for p, s, _ in m.pieces}
    low = min(score.values()) - 10

    def best(word):
        paths = {0: (0.0, [])}
        for e in range(1, len(word) + 1):
            options = [(paths[s][0] + (score[word[s:e]] if word[s:e] in score else low), [*paths[s][1], word[s:e]]) for s in range(max(0, e - 4), e) if word[s:e] in score or e - s == 1]
            paths[e] = max(options, key=lambda o: o[0])
        return paths[len(word)]

    texts = [" ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(5)) for _ in range(40)]
    for row in lattice.encode(docs(spark, list(enumerate(texts))), m).collect():
        want = [i for w in m.words(row.text) for p in best(w)[1] for i in m.part_ids(p)]
        assert row.ids == want


def test_empty_table(spark):
    assert lattice.sentencepiece(docs(spark, []), PATH).count() == 0


def test_substrings_meet_pieces_by_a_long(spark):
    m = lattice.model(PATH)
    words = lattice.distinct_words(docs(spark, [(1, "a b")]), spark.sparkContext.broadcast(m))
    plan = lattice.lattice(words, m)._jdf.queryExecution().sparkPlan().toString()
    join = next(x for x in plan.splitlines() if "Join" in x)
    assert "[h#" in join and "[piece#" not in join, join


def test_pieces_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lattice.F, "xxhash64", lambda c: lattice.F.lit(7).cast("long"))
    m = lattice.model(PATH)
    m = lattice.Model.of_pieces([x for x in m.pieces if len(x[0]) < 3][:300], m.byte_ids, False)
    words = spark.createDataFrame([(w, 1) for w in ["▁the", "▁in", "▁", "▁xyz"]], "word string, c long")
    got = {r.word: sorted(r.edges) for r in lattice.lattice(words, m).collect()}
    assert got == {w: sorted(m.ranks[w[i : i + 2]] | i << 8 for i in range(len(w) - 1) if w[i : i + 2] in m.ranks) for w in got}
    assert len(got) == 4 and any(got.values())
