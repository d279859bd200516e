import math
import random
import re
from collections import Counter, defaultdict

import pytest
from cases import awkward, documents, frame, rows

from waymark.llm import ngrams
from waymark.llm.text import fold

END, START = "</s>", "<s>"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


class Plain:
    """The same model in dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for t in texts:
            w = [*split(t), END]
            self.words.update(w)
            self.pairs.update(zip([START, *w[:-1]], w, strict=True))
        self.docs, self.n, self.v = len(texts), sum(self.words.values()), len(self.words)
        self.before, self.after = Counter(w for _, w in self.pairs), defaultdict(list)
        for (u, _), c in self.pairs.items():
            self.after[u].append(c)
        self.d = ngrams.discounts(*(sum(c == k for c in self.pairs.values()) for k in (1, 2, 3, 4)))
        self.e = ngrams.discounts(*(sum(c == k for c in self.before.values()) for k in (1, 2, 3, 4)))

    def low(self, w):
        types = len(self.pairs)
        if not types:
            return 1 / (self.v + 1)
        left = sum(self.e[min(c, 3) - 1] for c in self.before.values()) / types
        c = self.before[w]
        return (max(c - (self.e[min(c, 3) - 1] if c else 0), 0) / types) + left / (self.v + 1)

    def prob(self, u, w):
        total = self.docs if u == START else self.words[u]
        if not total:
            return self.low(w)
        c = self.pairs[u, w]
        back = sum(self.d[min(x, 3) - 1] for x in self.after[u]) / total
        return max(c - (self.d[min(c, 3) - 1] if c else 0), 0) / total + back * self.low(w)

    def answer(self, i, text):
        w = [*split(text), END]
        base = sum(math.log10((self.words[x] + 1) / (self.n + self.v + 1)) for x in w)
        score = sum(math.log10(self.prob(u, x)) for u, x in zip([START, *w[:-1]], w, strict=True))
        return i, len(w), sum(self.words[x] > 0 for x in w), self.n, round(base, 6), round(score, 6)


@pytest.mark.parametrize("held", [5_000_000, 50])
def test_equals_plain_model(spark, monkeypatch, held):
    monkeypatch.setattr(ngrams, "HELD", held)
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(words[min(int(r.expovariate(0.1)), 59)] for _ in range(r.randint(0, 30)))
    train, test = [text() for _ in range(80)] + awkward(long_words=500), [text() for _ in range(30)] + awkward(4, 2000) + ["never seen words", "w1 unseen w2"]
    model, plain = ngrams.fit(documents(spark, train)), Plain(train)
    got = [(a, b, c, d, round(e, 6), round(f, 6)) for a, b, c, d, e, f in rows(ngrams.score(documents(spark, test), model))]
    assert sorted(got) == [plain.answer(i, t) for i, t in enumerate(test)]


def test_probabilities_sum_to_one():
    plain = Plain(["a b c a b", "b c d", "a a a", ""])
    for u in ("a", "b", START, "new"):
        assert sum(plain.prob(u, w) for w in [*plain.words, "unknown"]) == pytest.approx(1)


def test_better_than_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = fold("doc_id", 7) == 2
    got = rows(ngrams.score(docs.where(held), ngrams.fit(docs.where(~held))), "base_score", "score")
    assert sum(s for _, s in got) > 0.9 * sum(b for b, _ in got)


def test_empty_tables(spark):
    model = ngrams.fit(documents(spark, []))
    assert rows(ngrams.score(documents(spark, ["a b", None]), model)) == [(0, 3, 0, 0, 0.0, 0.0), (1, 1, 0, 0, 0.0, 0.0)]
    twice = frame(spark, [(i, "a b", None, None, None, "k", 1, "b", 1, 1, "f") for i in (4, 4, None)])
    model = ngrams.fit(twice)
    assert model.tokens == 9 and model.distinct == 3 and model.documents == 3
    assert rows(ngrams.score(documents(spark, []), model)) == []
    assert len(set(rows(ngrams.score(twice, model), "score"))) == 1


def test_mixing_is_reversible():
    import numpy as np

    pairs = np.random.default_rng(0).integers(0, 2**64, 1000, np.uint64)
    assert (ngrams.unmix(ngrams.mix(pairs)) == pairs).all()
