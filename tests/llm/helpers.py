"""Small tables for the tests of the llm operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string"

#: null and empty and blank texts, ties, repeated rows, null ids, languages and sources, odd white space
EDGE = [(1, None), (2, ""), (3, "  \n\t \x0b "), (4, "one"), (5, "One"), (6, "a b c d"), (6, "a b c d"), (7, "x y　z  w"), (None, "null id has words too"), (8, "éß \U0001f600 tab\there"), (9, "a b c d")]


def docs(spark, rows):
    """rows: (doc_id, text); the columns score and bucket are extra ones with names that operators use inside."""
    return spark.createDataFrame([(i, t, [None, "en", "de"][k % 3], [None, "s1", "s0", "s2"][k % 4], len(t or ""), 0.5, "b") for k, (i, t) in enumerate(rows)], SCHEMA)


def prose(seed, n, words=40, vocabulary=300):
    """n texts of random words, with exact and near copies among them."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    out = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 2 * words))) for _ in range(n)]
    for _ in range(n // 4):
        t = r.choice(out).split(" ")
        if r.random() < 0.7:
            t[r.randrange(len(t))] = r.choice(vocab)
        out.append(" ".join(t))
    return out
