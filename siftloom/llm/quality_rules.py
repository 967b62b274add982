"""Quality rules whose thresholds come from the data.

Each document is measured once.  KLL sketches of five measures are built per
(lang, source) with partial aggregation on the map side, merged into sketches
per language and over all rows, and read as quartiles.  A measure beyond
``median + spread * (q3 - q1) + slack`` of its group rejects the document.  A
group of fewer than ``least_rows`` documents uses its language's merged sketch,
and a language of fewer the merged sketch over all rows.  A group's own fence is
never looser than its language's, nor, for measures that do not hang on the
language, a fence looser than that over all rows: no group lifts its own.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: Measures with the slack that is added to a fence: the least distance from the median that counts.
MEASURES = {"symbol_ratio": 0.15, "dup_line_ratio": 0.4, "exclaim_ratio": 0.25, "upper_ratio": 0.25, "word_length": 3.0}
#: Measures for which all languages are alike.
ANY_LANGUAGE = ("symbol_ratio", "dup_line_ratio", "exclaim_ratio")
SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{m} double" for m in MEASURES)


def repeat_words(words: list[bytes], k: int = 5) -> int:
    """Words that lie in a k-word window which occurs twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(k))))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + k - max(i, end)
            end = i + k
    return total


def measures(text: bytes | None) -> tuple:
    text = text or b""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "surrogatepass")) - sum(text.count(c) for c in common.WHITE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    upper = len(text) - len(text.translate(None, UPPER))
    per_word = max(n, 1)
    return n, chars, symbols, dup, repeat_words(words), symbols / per_word, dup / max(len(lines), 1), text.count(b"!") / per_word, upper / max(chars, 1), chars / per_word


def measured(docs: DataFrame) -> DataFrame:
    """The measures of every document, one row for each row of docs."""

    def run(c):
        out = list(zip(*map(measures, c["text"])))
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES]
        return {"doc_id": c["doc_id"], "lang": c["lang"], "source": c["source"]} | dict(zip(names, out))

    return common.arrow_map(docs.select("doc_id", "lang", "source", "text"), run, SCHEMA)


def thresholds(rows: DataFrame, spread: float = 6.0, least_rows: int = 200) -> DataFrame:
    """Per (lang, source): low and high bounds of each measure, from mergeable sketches."""
    sketch = rows.groupBy("lang", "source").agg(F.count("*").alias("rows"), *(F.kll_sketch_agg_double(m).alias(m) for m in MEASURES))
    sketch = common.kept(sketch, "sketches")
    merged = [F.sum("rows").alias("rows"), *(F.kll_merge_agg_double(m).alias(m) for m in MEASURES)]
    by_lang, over_all = sketch.groupBy("lang").agg(*merged), sketch.agg(*merged)

    def fences(df: DataFrame, tag: str) -> DataFrame:
        out = [F.col("rows").alias(f"rows_{tag}")]
        for m, slack in MEASURES.items():
            q = [F.kll_sketch_get_quantile_double(m, F.lit(x)) for x in (0.25, 0.5, 0.75)]
            out += [(q[1] - spread * (q[2] - q[0]) - slack).alias(f"{m}_low_{tag}"), (q[1] + spread * (q[2] - q[0]) + slack).alias(f"{m}_high_{tag}")]
        return df.select(*(c for c in ("lang", "source") if c in df.columns), *out)

    a, b, c = fences(sketch, "own"), fences(by_lang, "lang"), fences(over_all, "all")
    b = b.withColumnRenamed("lang", "its_lang")
    # over_all is a single row, so this is a broadcast of one row and not a product of two tables
    j = a.join(b, F.col("lang").eqNullSafe(F.col("its_lang"))).join(F.broadcast(c), F.lit(True))

    def pick(m: str, side: str):
        own, lang, every = (F.col(f"{m}_{side}_{tag}") for tag in ("own", "lang", "all"))
        tight = F.least if side == "high" else F.greatest
        large = F.col("rows_lang") >= least_rows
        got = F.when(F.col("rows_own") >= least_rows, tight(own, lang)).when(large, lang).otherwise(every)
        return tight(got, every) if m in ANY_LANGUAGE else got

    return j.select("lang", "source", *(pick(m, s).alias(f"{m}_{s}") for m in MEASURES for s in ("low", "high")))


def quality_rules(docs: DataFrame, spread: float = 6.0, least_rows: int = 200) -> DataFrame:
    """docs: doc_id, lang, source, text; other columns are ignored.

    One row for each row of docs (repeated rows stay repeated) with the measures,
    base_failed and kept.  A null or empty text has no words and fails the base
    rule; null lang or source form groups of their own; an empty table gives no
    rows; measures that tie share a threshold and a verdict.
    """
    rows = common.kept(measured(docs), "measures")
    t = thresholds(rows, spread, least_rows).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    t = common.small(common.kept(t, "thresholds"), 20_000)
    j = rows.join(t, rows.lang.eqNullSafe(F.col("t_lang")) & rows.source.eqNullSafe(F.col("t_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = F.lit(False)
    for m in MEASURES:
        odd = odd | (F.col(m) > F.col(f"{m}_high"))
    odd = odd | (F.col("word_length") < F.col("word_length_low"))
    return j.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(odd, F.lit(False)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
