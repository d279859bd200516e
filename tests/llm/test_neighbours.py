import numpy as np
import pytest
from cases import rows

from waymark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node long, u long"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 7, 8) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def plain(vectors, ids, every, k):
    x = np.array(vectors, np.float32).astype(float)
    ids = np.array(ids)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def answer(df):
    out = {}
    for q, r, v, s in rows(df.orderBy("query_id", "rank"), "query_id", "rank", "vec_id", "score"):
        out.setdefault(q, []).append((v, s))
        assert r == len(out[q])
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16)) + r.normal(size=(8, 16))[r.integers(0, 8, 1500)]
    x = x * r.uniform(0.5, 2, (1500, 1)) if scaled else x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted, got = plain(x, range(1500), 20, 20), answer(neighbours.nearest_rows(table(spark, x.tolist())))
    assert got.keys() == wanted.keys()
    hits = [len({v for v, _ in got[q]} & {v for v, _ in wanted[q]}) / 20 for q in wanted]
    assert np.mean(hits) >= (0.9 if scaled else 0.97)
    exact = {(q, v): s for q in wanted for v, s in wanted[q]}
    assert all(abs(s - exact[q, v]) < 1e-9 for q in got for v, s in got[q] if (q, v) in exact)
    assert all([s for _, s in g] == sorted((s for _, s in g), reverse=True) for g in got.values())


def test_ties_copies_and_bad_rows(spark):
    good = [[1, 0], [1, 0], [0, 1], [1, 0], [1, 1], [0, 2], [1, 0]]
    bad = [None, [], [0, 0], [None, 1], [float("nan"), 1], [float("inf"), 1], [1, 2, 3]]
    ids = [40, 3, 20, 1, 60, 2, 1] + list(range(100, 107))
    got = answer(neighbours.nearest_rows(table(spark, good + bad, ids), every=20, k=3))
    assert {q: [v for v, _ in g] for q, g in got.items()} == {40: [1, 3, 60], 20: [2, 60, 1], 60: [2, 1, 3]}
    assert got[20][0][1] == 2.0


def test_one_very_common_vector(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 8))
    x[100:400] = x[100]
    got, wanted = answer(neighbours.nearest_rows(table(spark, x.tolist()))), plain(x, range(600), 20, 20)
    assert got.keys() == wanted.keys()
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in wanted[q]}) / 20 for q in wanted]) >= 0.95
    for q in (120, 140, 380):
        assert [v for v, _ in got[q]] == [v for v, _ in wanted[q]]


def test_small_tables(spark):
    assert rows(neighbours.nearest_rows(table(spark, []))) == []
    assert rows(neighbours.nearest_rows(table(spark, [[1.0, 2.0]], [20]))) == []
    got = answer(neighbours.nearest_rows(table(spark, [[1, 0], [2, 0], [3, 0]], [20, 1, 2])))
    assert got == {20: [(2, 3.0), (1, 2.0)]}
