import random

import pyarrow.parquet as pq
from cases import awkward, documents, frame, rows

from waymark.llm import toxicity
from waymark.llm.text import fold

LABELS = "doc_id long, quality int, toxic int, text string"


def labelled(spark, n=300):
    r = random.Random(3)
    calm, rude = ["sun", "sea", "wind", "hill", "tree", "road"], ["idiot", "scum", "fool"]
    toxic = {i: int(i % 4 == 0) for i in range(n)}
    texts = [" ".join(r.choice(rude) if toxic[i] and r.random() < 0.2 else r.choice(calm) for _ in range(30)) for i in range(n)]
    return documents(spark, texts), spark.createDataFrame([(i, None, t, "x") for i, t in toxic.items()], LABELS), toxic


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    told = pq.read_table(f"{sf}/labels.parquet").to_pydict()
    truth = dict(zip(told["doc_id"], told["toxic"], strict=True))
    found = [(s, truth[i]) for i, s in rows(toxicity.score(docs.where(fold("doc_id", 5) == 0), model), "doc_id", "score") if i in truth]
    assert sum((s >= 0.5) == (t == 1) for s, t in found) >= 0.97 * len(found)
    caught = [s >= 0.5 for s, t in found if t == 1]
    assert sum(caught) >= 0.8 * len(caught) > 0
    assert sum(s >= 0.5 for s, t in found if t == 0) <= 0.01 * len(found)


def test_awkward_texts_have_scores(spark):
    docs, labels, toxic = labelled(spark)
    model = toxicity.fit(docs, labels)
    texts = [*awkward(), "You IDIOT you scum you fool", "sun and sea", "idiot"]
    got = dict(rows(toxicity.score(documents(spark, texts), model), "doc_id", "score"))
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert got[0] == got[1] == got[2] < 0.5 < got[21] and got[22] < 0.5
    right = [(s >= 0.5) == bool(toxic[i]) for i, s in rows(toxicity.score(docs, model), "doc_id", "score")]
    assert sum(right) >= 0.97 * len(right)


def test_one_class_or_none(spark):
    docs, labels, _ = labelled(spark, 60)
    for kept, score in ((labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("false"), 0.0), (labels.selectExpr("doc_id", "quality", "cast(null as int) toxic"), 0.0)):
        assert {s for (s,) in rows(toxicity.score(docs, toxicity.fit(docs, kept)), "score")} == {score}
    assert rows(toxicity.score(documents(spark, []), toxicity.fit(documents(spark, []), labels))) == []


def test_repeated_rows_and_null_ids(spark):
    docs, labels, _ = labelled(spark, 100)
    odd = frame(spark, [(i, "you idiot", None, None, None, "k", 1, "b", 1, 1, "f") for i in (4, 4, None)])
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1, "x"), (3, 1, 7, "x")], LABELS))
    once, again = (rows(toxicity.score(odd, toxicity.fit(docs, given)), "score") for given in (labels, twice))
    assert len(once) == 3 and len(set(once)) == 1 and once == again


def test_samples_are_bounded(spark):
    docs, labels, _ = labelled(spark)
    model = toxicity.fit(docs, labels, sample_rows=20, tuning_rows=20)
    assert model.toxic.documents < 45 and model.ordinary.documents < 45
