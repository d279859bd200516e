import random
import re

import pytest
from cases import awkward, documents, rows

from waymark.llm import decontaminate

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, items, window):
    split = lambda t: PATTERN.findall((t or "").translate(LOWER))
    windows = {}
    for name, item in items:
        w = split(item)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for i, t in enumerate(texts):
        w, hit, names = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[p : p + size]))) is not None:
                    hit |= set(range(p, p + size))
                    names |= found
        out.append((i, len(w), len(hit), sorted(n for n in names if n is not None)))
    return out


def make(seed, n=60, vocabulary=4):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice("abcdefgh"[:vocabulary]) for _ in range(k))
    items = [(str(i), text(r.randint(0, 12))) for i in range(8)] + [(None, text(6)), ("9", None), ("7", text(5))]
    texts = [text(r.randint(0, 40)) for _ in range(n)] + [items[0][1] * 2, items[3][1].upper()]
    return texts, items


@pytest.mark.parametrize(("seed", "block"), [(1, 10**6), (2, 10), (3, 1)])
def test_equals_brute_force_for_any_block(spark, seed, block):
    texts, items = make(seed)
    got = rows(decontaminate.match_benchmark(documents(spark, texts), spark.createDataFrame(items, "item_id string, text string"), 5, block), "doc_id", "n_words", "n_hit", "items")
    assert sorted(got) == brute(texts, items, 5)


def test_awkward_texts(spark):
    texts = awkward()
    items = [(1, " ".join(texts[8].split()[5:30])), (2, "two words"), (2, "two words"), (3, "—"), (4, "...")]
    got = rows(decontaminate.match_benchmark(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "n_words", "n_hit", "items")
    assert sorted(got) == brute(texts, [(str(n), t) for n, t in items], 10)


def test_removal_cuts_spans_and_drops_covered_documents(spark):
    passage = "One two THREE four five six seven eight nine ten"
    texts = [f"Keep this, and the rest of it: {passage}! And that, with many more words behind the passage.", passage, "clean text", None, ""]
    out = decontaminate.remove_benchmark(documents(spark, texts), spark.createDataFrame([(1, passage.lower())], "item_id long, text string"), max_coverage=0.5)
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["key"]) for r in out.collect()}
    assert got[0][0] == "Keep this, and the rest of it: ! And that, with many more words behind the passage."
    assert got[0][1] == len(got[0][0]) and got[0][2] == "k"
    assert 1 not in got and got[2][0] == "clean text" and got[3][0] is None and got[4][0] == ""
    assert out.columns == documents(spark, texts).columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.match_benchmark(documents(spark, []), none)) == []
    assert rows(decontaminate.match_benchmark(documents(spark, ["a b"]), none), "n_words", "n_hit", "items") == [(2, 0, [])]
    assert rows(decontaminate.remove_benchmark(documents(spark, ["a b"]), none), "text") == [("a b",)]
