import math
import random
import re

import pyarrow.parquet as pq
from cases import awkward, documents, frame, rows

from waymark.llm import language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(language.training_rows(docs))
    truth = dict(zip(*(pq.read_table(f"{sf}/documents.parquet")[c].to_pylist() for c in ("doc_id", "lang")), strict=True))
    held = docs.where(language.fold("doc_id", 4) == 2)
    found = language.predict(held, model).collect()
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) >= 0.98 * len(found) > 0
    assert all(0 <= r["score"] <= 1 for r in found)


def two(spark, n=30):
    r = random.Random(2)
    words = {"xx": ["kala", "kolo", "kuku"], "yy": ["simi", "susu", "sele"]}
    langs = {i: ("xx", "yy")[i % 2] for i in range(n)}
    return documents(spark, [" ".join(r.choice(words[langs[i]]) for _ in range(20)) for i in range(n)], langs)


def test_backs_off_to_shorter_grams(spark):
    model = language.fit(two(spark))
    scorer = language.Scorer(model)
    assert scorer.find(0, [b"kala", b"kalakolo"])[0].tolist() == [True, False]
    for word, best in ((b"kalakolo", "xx"), (b"sssi", "yy"), (b"ku", "xx"), (b"zk", "xx")):
        assert scorer.langs[int(scorer.look_up([word])[0].argmax())] == best
    assert not scorer.look_up([b"99"]).any()


class Plain:
    """The same model in plain Python, over all rows."""

    def __init__(self, rows):
        self.langs = sorted({lang for _, lang in rows})
        self.n = {}
        for text, lang in rows:
            for word in words_of(text):
                for key in [(0, word)] + [(n, g) for n in range(1, 5) for g in pieces(word, n)]:
                    at = self.n.setdefault(key, dict.fromkeys(self.langs, 0))
                    at[lang] += 1
        self.total = {(n, lang): sum(c[lang] for k, c in self.n.items() if k[0] == n) for n in range(5) for lang in self.langs}

    def logs(self, key):
        return [math.log10((self.n[key][lang] + 0.1) / (self.total[key[0], lang] + 1)) for lang in self.langs]

    def word(self, word):
        if (0, word) in self.n:
            return self.logs((0, word))
        for n in (4, 3, 2, 1):
            known = [self.logs((n, g)) for g in pieces(word, n) if (n, g) in self.n]
            if known:
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return [0.0] * len(self.langs)

    def predict(self, text):
        found = words_of(text)
        if not any(c.isalpha() for c in text or "") or not found:
            return "und", 0.0
        each = [self.word(w) for w in found]
        mean = [sum(x) / len(each) for x in zip(*each, strict=True)]
        share = [10 ** ((m - max(mean)) * min(len(found), 20)) for m in mean]
        best = mean.index(max(mean))
        return self.langs[best], share[best] / sum(share)


def words_of(text):
    return re.findall("(?:[a-z]|[^\\x00-\\x7f])+", (text or "").lower())


def pieces(word, n):
    marked = word if n == 1 else f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def test_equals_a_plain_model(spark):
    r = random.Random(5)
    pools = {"aa": "abcdeé", "bb": "cdefgß", "cc": "efghæi"}
    make = lambda lang, n: " ".join("".join(r.choice(pools[lang]) for _ in range(r.randint(1, 6))) for _ in range(n))
    train = [(make(lang, 30), lang) for _ in range(20) for lang in pools] + [("Cde, FGH! cde", "bb"), ("", "aa")]
    model = language.fit(documents(spark, [t for t, _ in train], dict(enumerate(lang for _, lang in train))))
    plain = Plain(train)
    tests = [make(lang, n) for lang in pools for n in (1, 3, 40)] + awkward() + ["xyz", "^ab$", "ABC cde", "éé ßß", "12", "Å"]
    got = {x["doc_id"]: x for x in language.predict(documents(spark, tests), model).collect()}
    for i, text in enumerate(tests):
        lang, score = plain.predict(text)
        assert abs(got[i]["score"] - score) < 1e-4 and (got[i]["lang_pred"] == lang or score < 0.51), (i, got[i], lang, score)


def test_awkward_texts(spark):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(documents(spark, [*awkward(), "kala", "K12", "12 %"]), language.fit(two(spark))).collect()}
    for i in (0, 1, 2, 6, 7, 14, 17, 23):
        assert got[i] == ("und", 0.0)
    assert got[21][0] == "xx" and got[22][0] in ("xx", "yy") and got[11][0] in ("xx", "yy")


def test_many_unseen_words_pass_a_small_memory(spark, monkeypatch):
    model = language.fit(two(spark))
    r = random.Random(1)
    text = [("ka" + "".join(r.choice("aklou") for _ in range(5))).encode() for _ in range(500)]
    whole = language.Scorer(model).score(text)
    monkeypatch.setattr(language, "CACHE", 7)
    small = language.Scorer(model).score(text)
    assert abs(whole - small).max() < 1e-4


def test_sample_is_bounded(spark):
    docs = two(spark, 400)
    model = language.fit(docs, sample_rows=40)
    assert 0 < model["totals"][0].sum() < 400 * 20 / 2


def test_keeps_rows_and_columns(spark):
    docs = documents(spark, ["kala kolo", None, "", "12", "susu"])
    model = language.fit(two(spark))
    out = language.keep_known(docs, model)
    assert out.schema == docs.schema and sorted(r[0] for r in rows(out, "doc_id")) == [0, 4]


def test_empty_and_unlabelled(spark):
    model = language.fit(frame(spark, [(1, "kala", None, None, None, "k", 1, "b", 1, 1, "f"), (2, None, "xx", None, None, "k", 1, "b", 1, 1, "f")]))
    assert rows(language.predict(documents(spark, ["kala"]), model), "lang_pred", "score") == [("und", 0.0)]
    assert rows(language.predict(documents(spark, []), model)) == []


def test_a_column_named_body_may_hold_numbers(spark):
    from waymark.llm import decontaminate

    docs = spark.createDataFrame([(i, "the same words as every day", "en", 0.5) for i in range(12)], "doc_id long, text string, lang string, body double")
    kept = language.keep_known(docs, language.fit(language.training_rows(docs)))
    assert kept.columns == docs.columns and kept.count() == 12
    items = spark.createDataFrame([(1, "an item of a test")], "item_id long, text string")
    assert decontaminate.remove_benchmark(docs, items).count() == 12
