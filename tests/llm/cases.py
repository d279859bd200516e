"""Small tables with the awkward cases that every operator must answer."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, body string, h1 long, n long, file string"


def documents(spark, texts, langs=None):
    """Documents 0, 1, ... with columns whose names the operators use inside."""
    rows = [(i, t, (langs or {}).get(i, "en"), "src", None if t is None else len(t), "k", 1, "b", 2, 3, "f") for i, t in enumerate(texts)]
    return frame(spark, rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def awkward(seed=3, long_words=20_000):
    """Null, empty, blank, one-word, repeated, mixed-case, non-ASCII, punctuation-only and very long texts."""
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "EPSILON", "一", "x1", "the", "of", "l'eau"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    body = text(60)
    return [
        None, "", " \t\n ", "word", "WORD", "two words", "...!?", "—", body, body, body.upper(), body + " more", text(long_words),
        "line one is long enough to count\nshort\n\nline one is long enough to count", "\n\n\n", "a b c\x0bd\x1ce", "K kelvin K ſ İ", "0 1 2 3", text(9), text(10), text(11),
    ]


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
