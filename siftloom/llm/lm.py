"""Scores of texts by a hierarchical Pitman-Yor language model.

Tokens are words, A-Z lower-cased, and an end after each text.  A token is drawn
from the restaurant of the word before it (or of the start), whatever word that
is; see word_contexts.  Its parent draws in two steps:

* a class from the restaurant of the last frequent word before it (or of the
  start), whose parent is the restaurant without context.  Classes are the
  ``hot`` most frequent words, the end, and one for all other words;
* a word of that other class from one restaurant over all such words, whose
  parent spells: restaurants of the last CHARS bytes, whose parents are those of
  fewer bytes, down to a uniform choice.  So unseen words have a probability.

For two frequent words the class restaurant is the restaurant of the word before.
Other restaurants hand one customer on for each pair, its table's first.

All counts cover all pairs of all training texts.  Restaurants are seated where
their rows are: those of the words by word before, those of the classes by
context, with what all of them share (tables of each class, at most hot + 2
numbers) summed between rounds; the restaurant of words by word, on totals of the
round before.  Draws depend on the pair, the context or the word alone, so
partitions don't change scores.  The spelling restaurants, whose pairs are bounded
by the bytes (no more than 258 * 258 * 257 with CHARS = 2, whatever the input),
are seated on the driver.

The list of the TOP most frequent words that every task has is a cache: pairs with
other words are counted like any others, and their scores wait for the share of
the word, which lies in the table of all words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, word_contexts
from .pitman_yor import Draws, Hierarchy, Tables, discount, one_restaurant, seat_alone

HOT, TOP, CHARS = 2000, 200_000, 2
RARE, END = 0, 1
#: Digits of a spelling context: bytes, end of a word (256), before a word (257).
DIGIT, STOP, START = 258, 256, 257
#: Distinct words that a task counts before it sends them on.
FLUSH = 300_000


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def vocabulary(docs: DataFrame) -> DataFrame:
    """docs: text, train.  word, c (in training texts), c_all: every distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {True: Counter(), False: Counter()}

        def batch() -> pa.RecordBatch:
            words = list(counts[True].keys() | counts[False].keys())
            c = [counts[True][w] for w in words]
            every = [a + counts[False][w] for a, w in zip(c, words)]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(every, pa.int64())], ["word", "c", "c_all"])
            counts[True].clear()
            counts[False].clear()
            return out

        for b in batches:
            for part in common.cut(b):
                col = common.columns(part)
                for text, train in zip(col["text"], col["train"]):
                    counts[train].update(tokens(text))
                if len(counts[True]) + len(counts[False]) > FLUSH:
                    yield batch()
        yield batch()

    rows = docs.select("text", "train").mapInArrow(run, "word string, c long, c_all long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def spelled(words: list[bytes], chars: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Contexts of 0 to chars bytes, what follows (STOP after a word), and where each word starts."""
    flat = np.frombuffer(b"\n".join(words) + b"\n", np.uint8).astype(np.int64)
    dish = np.where(flat == 10, STOP, flat)
    before = np.concatenate([[START], np.where(flat == 10, START, flat)[:-1]])
    contexts, now = [np.zeros(len(flat), np.int64)], before
    for k in range(chars):
        contexts.append(contexts[-1] + now * DIGIT**k)
        now = np.where(now == START, START, np.concatenate([[START], now[:-1]]))
    return contexts, dish, np.nonzero(before == START)[0]


def spelling(vocab: DataFrame, chars: int = CHARS):
    """The averaged spelling model, from every distinct training word once."""

    def run(c):
        words = [w for w in c["word"] if w]
        if not words:
            return {"gram": [], "n": []}
        contexts, dish, _ = spelled(words, chars)
        gram, n = np.unique(contexts[-1] * DIGIT + dish, return_counts=True)
        return {"gram": gram, "n": n}

    got = common.arrow_map(vocab.where("c > 0").select("word"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
    return Hierarchy(gram // DIGIT, gram % DIGIT, n, STOP + 1, chars, DIGIT, seed=1).average(8, 4)


def spell_log10(model, chars: int, words: list[bytes]) -> np.ndarray:
    if not words:
        return np.empty(0)
    contexts, dish, first = spelled(words, chars)
    return np.add.reduceat(np.log10(model.probability(contexts, dish)), first)


def steps(classes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and class of each token of a text with these classes, its end included: the context is the last class before it other than RARE."""
    seq = np.concatenate([[start], classes, [END]])
    last = np.maximum.accumulate(np.where(seq != RARE, np.arange(len(seq)), 0))
    return seq[last[:-1]], seq[1:]


class Words:
    """What a task knows of the most frequent words."""

    def __init__(self, index: dict[bytes, int], kind: np.ndarray, c: np.ndarray, log_b: np.ndarray | None):
        self.index, self.kind, self.c, self.log_b = index, kind, c, log_b

    def find(self, words: list[bytes]) -> np.ndarray:
        get = self.index.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def frequent(vocab: DataFrame, top: int) -> DataFrame:
    """The words with the highest c_all, at most top of them: all with counts above the least that fits."""
    by_count = vocab.where("c_all > 1").groupBy("c_all").count()
    # each distinct count has a word at least, so top + 1 of them decide
    total, least = 0, None
    for r in by_count.orderBy(F.desc("c_all")).limit(top + 1).collect():
        if total + r[1] > top:
            break
        total, least = total + r[1], r[0]
    if least is None:
        return vocab.limit(0)
    return vocab.where(F.col("c_all") >= least)


def class_matrix(pairs: DataFrame, kinds: int, rounds: int = 2, sweeps: int = 8, burn_in: int = 4, strength: float = 1.0) -> np.ndarray:
    """log10 of the averaged probability of each class (column) after each context (row).

    A context's restaurant is seated in one task, from its at most kinds pairs,
    with what the shared parent predicts.  Between rounds the parent gets the
    restaurants' tables as its customers and is seated anew.
    """
    pairs = common.kept(pairs.select(F.expr(f"pair div {kinds}").alias("context"), (F.col("pair") % kinds).cast("int").alias("dish"), "n"), "pairs")
    n1, n2 = pairs.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    d = float(min(0.95, max(0.1, n1 / (n1 + 2 * n2)))) if n1 else 0.5
    grouped = pairs.groupBy("context")

    def rows(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
        dish, n = t.column("dish").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(dish)
        return t.column("context")[0].as_py(), dish[order].astype(np.int64), n[order]

    def parent(customers: dict[int, int]) -> np.ndarray:
        dish = np.array(sorted(customers), np.int64)
        c, one = np.array([customers[x] for x in dish.tolist()], np.int64), np.full(len(customers), 1 / kinds)
        if not len(dish):
            return np.full(kinds, 1 / kinds)
        d1 = discount(c)
        t = one_restaurant(c, one, d1, strength, np.random.default_rng([2, kinds]), sweeps, burn_in) / (sweeps - burn_in)
        p = np.full(kinds, (strength + d1 * t.sum()) / kinds)
        p[dish] += c - d1 * t
        return p / (strength + c.sum())

    def tables_on(p: np.ndarray, k: int):
        def tables(t: pa.Table) -> pa.Table:
            context, dish, n = rows(t)
            got = one_restaurant(n, p[dish], d, strength, np.random.default_rng([3, k, context]), sweeps, burn_in)
            return pa.table({"dish": pa.array(dish, pa.int32()), "tables": pa.array(got, pa.int64())})

        return tables

    def predicted_on(p: np.ndarray):
        def predicted(t: pa.Table) -> pa.Table:
            context, dish, n = rows(t)
            tables = one_restaurant(n, p[dish], d, strength, np.random.default_rng([3, rounds, context]), sweeps, burn_in) / (sweeps - burn_in)
            row = (strength + d * tables.sum()) * p
            row[dish] += n - d * tables
            return pa.table({"context": pa.array([context], pa.int64()), "row": pa.array([np.log10(row / (strength + n.sum())).astype("<f4").tobytes()], pa.binary())})

        return predicted

    p = parent({r[0]: r[1] for r in pairs.groupBy("dish").count().collect()})
    for k in range(rounds):
        got = grouped.applyInArrow(tables_on(p, k), "dish int, tables long").groupBy("dish").agg(F.sum("tables")).collect()
        p = parent({r[0]: max(1, round(r[1] / (sweeps - burn_in))) for r in got})
    out = np.tile(np.log10(p).astype(np.float32), (kinds + 1, 1))
    for context, row in grouped.applyInArrow(predicted_on(p), "context long, row binary").toLocalIterator():
        out[context] = np.frombuffer(row, "<f4")
    return out


def rare_words(vocab: DataFrame, model, chars: int, hot: dict[bytes, int], strength: float = 10.0, rounds: int = 2, sweeps: int = 8, burn_in: int = 4) -> DataFrame:
    """word, c, c_all, log_b: log10 of a word's probability among the words of no class of their own, hot ones left as null.

    Each round seats every word anew and sweeps its tables, on the total of
    tables of the round before; the last round's samples are averaged.
    """
    sc = vocab.sparkSession.sparkContext
    held = sc.broadcast((model, chars, frozenset(hot)))

    def spell(c):
        m, k, known = held.value
        s = spell_log10(m, k, c["word"])
        return c | {"spell": s, "hot": [w in known for w in c["word"]]}

    rows = common.kept(common.arrow_map(vocab.select("word", "c", "c_all"), spell, "word string, c long, c_all long, spell double, hot boolean"), "spelled")
    some = rows.where("not hot and c > 0")
    n, n1, n2, customers = (x or 0 for x in some.agg(F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.sum("c")).first())
    d = float(min(0.95, max(0.1, n1 / (n1 + 2 * n2)))) if n1 else 0.5

    def seatings(c, tables: float, k: int) -> np.ndarray:
        """Tables of each word, the sum over the samples."""
        count, p = np.array(c["c"], np.int64), 10.0 ** np.array(c["spell"])
        keys = np.fromiter((xxhash.xxh64_intdigest(w, k) for w in c["word"]), np.uint64, len(count))
        new = (strength + d * tables) * p
        t = seat_alone(count, new, d, Draws(keys))
        draws = Draws(keys[count > 1] ^ Draws.STEP)
        seated, total = Tables(count, t, draws), np.zeros(len(count), np.int64)
        for i in range(sweeps):
            seated.sweep(new[seated.pairs], np.zeros(len(seated.pairs)), d, draws)
            if i >= burn_in:
                t[seated.pairs] = seated.count()
                total += t
        return total

    tables = float(n)
    for k in range(rounds):
        round_ = common.arrow_map(some.select("word", "c", "spell"), lambda c, t=tables, k=k: {"t": [int(seatings(c, t, k).sum())]}, "t long")
        tables = float((round_.agg(F.sum("t")).first()[0] or 0) / (sweeps - burn_in))

    def final(c):
        t = seatings(c, tables, rounds) / (sweeps - burn_in)
        count = np.array(c["c"], np.int64)
        p = (count - d * t + (strength + d * tables) * 10.0 ** np.array(c["spell"])) / (strength + customers)
        log_b = np.log10(np.maximum(p, 1e-300))
        # a word so long that its probability underflows keeps its logarithm
        log_b = np.where(p > 1e-290, log_b, np.array(c["spell"]) + np.log10((strength + d * tables) / (strength + customers)))
        return {"word": c["word"], "c": c["c"], "c_all": c["c_all"], "log_b": [None if h else float(v) for h, v in zip(c["hot"], log_b)]}

    out = common.kept(common.arrow_map(rows, final, "word string, c long, c_all long, log_b double"), "words")
    common.dropped(rows)
    return out


def score(docs: DataFrame, hot: int = HOT, top: int = TOP, chars: int = CHARS, strength: float = 1.0, sweeps: int = 8, burn_in: int = 4) -> DataFrame:
    """docs: doc_id, text, train; other columns are ignored.

    One row for each row of docs: doc_id, train, n_tokens, n_known,
    train_tokens, base_score and score, log10 probabilities of the text under the
    smoothed unigram model and the Pitman-Yor model.  A null or empty text is its
    end alone; equal texts have equal scores; repeated rows are learned from as
    often as they stand; without training texts all classes are alike; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("train", F.lit(True)).alias("train"))
    vocab = common.kept(vocabulary(docs), "vocabulary")
    rows, ends = (x or 0 for x in docs.agg(F.count("*"), F.count_if("train")).first())
    in_words, distinct, in_all, n_words = (x or 0 for x in vocab.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("c_all"), F.count("*")).first())
    n_train, n_distinct = in_words + ends, distinct + (ends > 0)
    log_base = lambda c: np.log10((c + 0.1) / (n_train + 0.1 * (n_distinct + 1)))
    parts = max(word_contexts.LEAST_PARTS, -(-(in_all + rows) // word_contexts.PART))

    got = frequent(vocab, top).toArrow()
    listed = sorted(zip((w.encode() for w in got.column("word").to_pylist()), got.column("c").to_pylist()))  # numbers don't depend on partitions
    words, c = [w for w, _ in listed], np.array([n for _, n in listed], np.int64)
    order = sorted((i for i in range(len(words)) if c[i]), key=lambda i: (-c[i], words[i]))[:hot]
    kind = np.zeros(len(words) + 1, np.int64)
    kind[order] = np.arange(len(order)) + 2
    kind[-1] = END
    kinds = len(order) + 2
    index = {w: i for i, w in enumerate(words)}
    held = spark.sparkContext.broadcast(Words(index, kind, c, None))

    dealt = word_contexts.dealt(docs, held, kinds, parts, log_base, ends, steps, tokens)
    seated = word_contexts.gathered(dealt, held, kinds)
    texts = common.kept(dealt.where("part < 0"), "texts")
    common.dropped(dealt)
    exploded = lambda name: word_contexts.exploded(seated, name)
    pairs = word_contexts.cached_pairs(texts).unionByName(exploded("pairs")).groupBy(F.col("k").alias("pair")).agg(F.sum("n").alias("n"))
    matrix = spark.sparkContext.broadcast(class_matrix(pairs, kinds))

    numbered = common.arrow_map(vocab, lambda x: x | {"k": [word_contexts.number(w, held.value.index) for w in x["word"]]}, "word string, c long, c_all long, k long")
    customers = exploded("words").groupBy(F.col("k").alias("of_k")).agg(F.sum("n").alias("n"))
    # the restaurant of words has the tables of those below as its customers; c_all is where the counts of tokens travel
    vocab = numbered.join(customers, F.col("k") == F.col("of_k"), "left").select("word", F.coalesce("n", F.lit(0)).alias("c"), F.col("c").alias("c_all"))
    table = rare_words(vocab, spelling(vocab.where("c_all > 0").select("word", F.lit(1).alias("c")), chars), chars, {words[i]: 1 for i in order}).select("word", F.col("c_all").alias("c"), "log_b")

    def of_list(x):
        at = [(held.value.index[w], s) for w, s in zip(x["word"], x["log_b"]) if w in held.value.index]
        return {"i": [i for i, _ in at], "log_b": [s or 0.0 for _, s in at]}

    got = common.arrow_map(table.select("word", "log_b"), of_list, "i long, log_b double").toArrow()
    log_b = np.zeros(len(words) + 1)
    log_b[got.column("i").to_numpy()] = got.column("log_b").to_numpy()
    rest = 1 - float((10.0**log_b)[:-1][kind[:-1] == RARE].sum())
    usual = max(rest, 1e-9) / max(1, n_words - len(words))
    n1, n2 = (x or 0 for x in seated.agg(F.sum("n1"), F.sum("n2")).first())
    d = float(min(0.95, max(0.1, n1 / (n1 + 2 * n2)))) if n1 else 0.5
    n_hot, t_hot = np.zeros(kinds + 1), np.zeros(kinds + 1)
    for k, n, t in exploded("hot").groupBy("k").agg(F.sum("n"), F.sum("t")).collect():
        n_hot[k], t_hot[k] = n, t
    whole = spark.sparkContext.broadcast(Words(index, kind, c, log_b))
    model = word_contexts.Model(whole, matrix, n_hot, t_hot, d, strength, usual)
    drawn = word_contexts.hot_tables(seated, model, kinds, sweeps, burn_in)
    sums = word_contexts.scored(seated, model, drawn, kinds, parts, sweeps, burn_in)
    common.dropped(seated)
    last = word_contexts.closed(sums, table, held, parts, log_base)
    # sums are read twice: those that wait go through the shares of their words before the last shuffle
    last = common.kept(last, "last")
    every = texts.unionByName(sums.where("part < 0")).unionByName(last)
    return word_contexts.documents(every, matrix).select("doc_id", "train", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Of the rows that were learned from and of those that were not: train, n_tokens, base_perplexity, perplexity."""
    ppl = lambda name: F.pow(F.lit(10.0), -F.sum(name) / F.sum("n_tokens"))
    return scored.groupBy("train").agg(F.sum("n_tokens").alias("n_tokens"), ppl("base_score").alias("base_perplexity"), ppl("score").alias("perplexity"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = score(docs.select("doc_id", "text", (~common.held_out(F.col("doc_id"), 10)).alias("train")))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
