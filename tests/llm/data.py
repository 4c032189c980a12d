"""Made texts for the tests of this folder."""

import random

EDGES = [None, "", " ", "\n\n\n", "?!", "ünï çødé ÄÖ", "a" * 5000, "one\ntwo\nthree\nfour"]


def prose(rng: random.Random, words: int, vocabulary: int = 4000) -> str:
    """Sentences of invented words, frequent ones first as in real text."""
    out = []
    for _ in range(words):
        n = int(vocabulary * rng.random() ** 3)
        out.append(f"{'bcdfgklmnprst'[n % 13]}{'aeiou'[n % 5]}{n}")
    text = ""
    for i, w in enumerate(out):
        text += ("" if not i else ". " if i % 11 == 0 else " ") + w
    return text + "."


def frame(spark, rows, extra=True):
    """(doc_id, text) rows, with columns of which the names clash with those that operators use."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(i, t, f"x{n}", n, float(n), "s") for n, (i, t) in enumerate(rows)], "doc_id long, text string, _id string, _k int, shard double, `a.b` string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)
