"""License scans: a positional index of rare licence words, joined by relative position."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.text import ascii_lower
from waymark.session import cut

#: Label and words of each template; the first four are the base phrases. Fixed values.
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
TEMPLATES = {
    "agpl": "gnu affero general public license",
    "lgpl": "gnu lesser general public license",
    "mpl": "mozilla public license",
    "epl": "eclipse public license",
    "bsd": "redistribution and use in source and binary forms",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy",
    "apache-2.0": "licensed under the apache license version 2 0",
    "cc-by-sa": "cc by sa",
    "cc-by-nc": "cc by nc",
    "cc0": "cc0 1 0 universal",
    "unlicense": "free and unencumbered software released into the public domain",
}
#: Template words too common to be indexed; where they stand follows from the other words' places.
COMMON = {"a", "and", "any", "in", "into", "is", "of", "the", "to", "use", "1", "2", "0"}
MANDATORY = {"bsd": "source and binary forms", "mit-text": "free of charge", "unlicense": "public domain", "apache-2.0": "apache license"}
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _postings(phrase: str, all_words: bool) -> list[tuple[str, int]]:
    return [(w, i) for i, w in enumerate(phrase.split()) if all_words or w not in COMMON]


def index() -> list[tuple[str, list[tuple[str, int]], bool]]:
    """(label, postings of indexed words with their relative position, whether it is a base phrase)."""
    return [(k, _postings(v, True), True) for k, v in BASE.items()] + [(k, _postings(v, False), False) for k, v in TEMPLATES.items()]


def _places(hits: Column, word: str, at: int, name: str = "word") -> Column:
    return F.transform(F.filter(hits, lambda x: x[name] == word), lambda x: x["pos"] - at)


def find_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    A file's licence words, with their places, are looked up once. Inverse document frequencies of these words come from all rows.
    A template's postings are intersected by relative position, its rarest word first, so a template without its
    rarest word costs one look; templates that leave out common words then need a mandatory phrase at the right place. The
    score is the largest IDF-weighted share of a template's words that the file has: 1 where a template stands, less than 1 elsewhere.

    A null or empty text has no words and no labels, score 0. Rows are answered each; nothing is grouped by row.
    """
    templates = index()
    vocabulary = sorted({w for _, postings, _ in templates for w, _ in postings} | {w for p in MANDATORY.values() for w in p.split() if w not in COMMON})
    found = docs.select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORDS), F.lit(0)).alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(i.cast("long").alias("pos"), w.alias("word")))
    near = F.filter(placed, lambda x: F.lower(x["word"]).isin(vocabulary))
    following = lambda x: ascii_lower(F.get("words", (x["pos"] + 1).cast("int")))
    exact = F.transform(near, lambda x: F.struct(x["pos"].alias("pos"), ascii_lower(x["word"]).alias("word"), following(x).alias("next")))
    files = cut(found.select("doc_id", F.size("words").cast("long").alias("n_words"), exact.alias("hits")))

    # one row per indexed word, of a fixed list
    counts = files.select(F.explode(F.array_distinct(F.col("hits.word"))).alias("word")).groupBy("word").count().where(F.col("word").isin(vocabulary))
    total = files.count()
    df = {r["word"]: r["count"] for r in counts.collect()}
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}

    hits = F.col("hits")
    starts, shares = {}, []
    for label, postings, _ in templates:
        rarest_first = sorted(postings, key=lambda x: (-idf[x[0]], x[1]))
        empty = F.array().cast("array<bigint>")
        chain = _places(hits, *rarest_first[0])
        for word, at in rarest_first[1:]:
            chain = F.when(F.size(chain) == 0, empty).otherwise(F.array_intersect(chain, _places(hits, word, at)))
        starts[label] = F.array_distinct(chain)
        weight = {w: idf[w] for w, _ in postings}
        have = reduce(lambda a, b: a + b, [F.when(F.array_contains(F.col("hits.word"), w), F.lit(v)).otherwise(F.lit(0.0)) for w, v in sorted(weight.items())])
        shares.append(have / F.lit(sum(weight.values()) or 1.0))
    files = files.select("doc_id", "n_words", "hits", *[c.alias(f"at_{i}") for i, c in enumerate(starts.values())], F.greatest(*shares).alias("share"))
    place = {label: F.col(f"at_{i}") for i, label in enumerate(starts)}
    for label, phrase in MANDATORY.items():
        words = TEMPLATES[label].split()
        first = next(i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        for i, word in enumerate(phrase.split()):
            if word not in COMMON:
                place[label] = F.array_intersect(place[label], _places(hits, word, first + i))
            else:  # not indexed, but known as what follows the word before it
                place[label] = F.array_intersect(place[label], _places(hits, word, first + i - 1, "next"))
    base = F.flatten(F.array(*[place[k] for k in BASE]))
    label = lambda names: F.array_join(F.sort_array(F.filter(F.array(*[F.when(F.size(place[k]) > 0, F.lit(k)) for k in names]), lambda x: x.isNotNull())), ",")
    labels = label([*BASE, *TEMPLATES])
    return files.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        label(BASE).alias("base_labels"), labels.alias("labels"), F.when(labels != "", F.lit(1.0)).otherwise(F.least(F.col("share"), F.lit(0.99))).alias("score"),
    )
