import random
import re

from pyspark.sql import functions as F

from siftloom.llm.quality_rules import MEASURES, quality_rules, thresholds
from helpers import EDGE, docs, prose


def test_polluted_source_does_not_lift_its_fence(spark):
    """Three in ten texts of one source are symbols; the other sources of its language, or the other languages, are clean."""
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    clean = lambda: " ".join(r.choice(vocab) for _ in range(40))
    junk = lambda: " ".join(r.choice(vocab) + "###" for _ in range(40))
    rows = [(i, "en", f"s{i % 4}", clean()) for i in range(1200)]
    rows += [(2000 + i, "en", "bad", junk() if i % 10 < 3 else clean()) for i in range(300)]
    rows += [(3000 + i, "de", "only", junk() if i % 10 < 3 else clean()) for i in range(300)]
    got = {x.doc_id: x.kept for x in quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert got == {i: "###" not in t for i, _, _, t in rows}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The counted measures, by the words of the contract."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    in_repeat = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(in_repeat)


def test_measures_against_plain(spark):
    texts = [t for _, t in EDGE] + prose(41, 40, words=30, vocabulary=12) + ["a b c d e " * 4, "x\nx\n\nx\n y\n y", "one two three four five six one two three four five", "# *$ %&|<> \U0001f600 é　b", "\n".join(["same line here"] * 5)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "a b c")]
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        p = plain(t)
        want.append((i, *p, p[0] < 10 or 100 * p[4] > 20 * p[0]))
    assert got == sorted(want, key=str)


def test_fences_against_exact_quartiles(spark):
    """Sketched quartiles lie within the sketch's rank error of the exact ones."""
    r = random.Random(9)
    rows = [(i, "en", "s", r.gauss(0.2, 0.05)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, x double")
    df = df.select("doc_id", "lang", "source", *(F.col("x").alias(m) for m in MEASURES))
    got = thresholds(df, spread=6.0).first()
    values = sorted(x for *_, x in rows)
    at = lambda q, e: values[min(3999, max(0, int((q + e) * 4000)))]
    for m, slack in MEASURES.items():
        low = at(0.5, -0.02) + 6 * (at(0.75, -0.02) - at(0.25, 0.02)) + slack
        high = at(0.5, 0.02) + 6 * (at(0.75, 0.02) - at(0.25, -0.02)) + slack
        assert low <= got[f"{m}_high"] <= high


def test_small_groups_take_a_merged_fence(spark):
    """A source of few rows has its language's verdicts; a language of few rows those over all."""
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(900)]
    clean = lambda: " ".join(r.choice(vocab) for _ in range(40))
    rows = [(i, "en", "big", clean()) for i in range(400)] + [(1000, "en", "tiny", clean()), (1001, "en", "tiny", clean().replace(" ", "## ")), (1002, None, None, clean()), (1003, None, None, clean().replace(" ", "$$ "))]
    got = {x.doc_id: x.kept for x in quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert got[1000] and not got[1001] and got[1002] and not got[1003]


def test_empty_table(spark):
    assert quality_rules(docs(spark, [])).count() == 0
