import random

import numpy as np
import pyarrow as pa
import pytest
from cases import awkward, documents, frame, rows
from test_ngrams import split

from waymark.llm import jaccard


def plain_sets(texts, words):
    out = []
    for t in texts:
        w = split(t)
        out.append({tuple(w[i : i + words]) for i in range(max(len(w) - words, 0) + 1)} if w else set())
    return out


def plain_links(sets, percent):
    return [(i, j) for i, a in enumerate(sets) for j in range(i) if (b := sets[j]) and a and 100 * len(a & b) >= percent * len(a | b)]


def plain_groups(texts, words, percent):
    sets = plain_sets(texts, words)
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in plain_links(sets, percent):
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(seed, base_words=(3, 60), n=10, copies=12, vocabulary=40):
    """Chains and stars of copies with a few words changed, cut or added."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = []
    for _ in range(n):
        base = [r.choice(words) for _ in range(r.randint(*base_words))]
        at = list(base)
        for _ in range(r.randint(1, copies)):
            at = list(r.choice((base, at)))
            for _ in range(r.randint(0, 2)):
                p = r.randrange(len(at) + 1)
                at[p : p + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 1)
            texts.append(" ".join(at))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "words", "percent", "size"), [(1, 3, 90, (3, 60)), (2, 5, 80, (5, 60)), (3, 2, 70, (1, 25)), (4, 3, 90, (100, 300)), (5, 1, 60, (1, 12)), (6, 5, 80, (60, 200))])
def test_groups_equal_brute_force(spark, seed, words, percent, size):
    texts = near_copies(seed, size) + awkward(long_words=3000)
    got = sorted(rows(jaccard.similar_groups(documents(spark, texts), words, percent)))
    assert got == plain_groups(texts, words, percent)


def test_links_lose_no_pair(spark):
    texts = list(dict.fromkeys(near_copies(9, (10, 80))))
    pairs, nodes = jaccard.links(documents(spark, texts), 3, 90)
    doc = {r["node"]: r["doc_id"] for r in nodes.collect()}
    sets = plain_sets(texts, 3)
    wanted = {frozenset(p) for p in plain_links(sets, 90) if sets[p[0]] != sets[p[1]]}
    first = {frozenset(s): i for i, s in reversed(list(enumerate(sets)))}
    same = {i: first[frozenset(s)] for i, s in enumerate(sets)}
    got = {frozenset((same[doc[a]], same[doc[b]])) for a, b in rows(pairs)}
    assert got == {frozenset(same[i] for i in p) for p in wanted}


@pytest.mark.parametrize("histogram", [{}, {b: 10**9 for b in range(60)}, {b: 3000 for b in range(60)}])
@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_signature(histogram, percent):
    """For any allocation, also with one-deletion segments, small sets and idle segments."""
    layouts = jaccard.Layouts(percent, histogram, overlap=0.2)
    r = np.random.default_rng(percent)
    for _ in range(400):
        n = int(r.integers(1, 80))
        a = np.unique(r.integers(0, 2**64, n, np.uint64))
        differ = (100 - percent) * 2 * n // (100 + percent)
        b = np.unique(np.concatenate([a[r.integers(0, differ + 1) :], r.integers(0, 2**64, int(r.integers(0, differ + 1)), np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
            assert len(np.intersect1d(layouts.signatures(a, jaccard._values(a)), layouts.signatures(b, jaccard._values(b))))


def test_one_deletion_segments_are_chosen_where_they_pay():
    few, many = jaccard.Layouts(90, dict.fromkeys(range(60), 1)), jaccard.Layouts(90, dict.fromkeys(range(60), 10**12))
    b = few.band(20)
    assert many.band(20) == b and few.allocation(b)[1] == 0 and many.allocation(b)[1] > 0


def test_idle_segments_fall_back_to_other_layouts(monkeypatch):
    layouts = jaccard.Layouts(60)
    monkeypatch.setattr(layouts, "allocation", lambda b: (40, 0, 0))
    few = np.arange(1, 6, dtype=np.uint64)
    assert len(layouts.signatures(few, jaccard._values(few))) > 5 * (jaccard.SEEDS - 1)


def test_sketch_never_exceeds_the_difference():
    r = np.random.default_rng(3)
    for _ in range(100):
        a = np.unique(r.integers(0, 2**64, 200, np.uint64))
        b = np.unique(np.concatenate([a[: r.integers(1, 200)], r.integers(0, 2**64, 30, np.uint64)]))
        odd = jaccard._sketch(jaccard._values(a)).view(np.uint64) ^ jaccard._sketch(jaccard._values(b)).view(np.uint64)
        assert np.bitwise_count(odd).sum() <= len(np.setxor1d(a, b))


def test_shingles_of_slices():
    bodies = pa.array([b"a b c d", None, b"A B", b"a b c", b"b"], pa.binary())
    sets = jaccard.shingle_sets(bodies, 3)
    assert [len(s) for s in sets] == [2, 0, 1, 1, 1] and sets[3][0] in sets[0] and sets[2][0] not in sets[0]


def test_keeps_one_row_of_each_group(spark):
    texts = near_copies(11, (40, 80)) + [None, "", "a"]
    docs = documents(spark, texts)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r[0] for r in rows(out, "doc_id")) == sorted({c for _, _, c in plain_groups(texts, 5, 80)})


def test_null_ids_repeats_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [(i, t, None, None, None, "k", 1, "b", 1, 1, "f") for i, t in ((5, text), (5, text), (None, text + " x"), (9, text), (None, ""), (None, "lone"))])
    got = sorted(map(str, rows(jaccard.similar_groups(docs))))
    assert got == sorted(map(str, [(5, 28, 5), (5, 28, 5), (None, 29, 5), (9, 28, 5), (None, 0, None), (None, 1, None)]))
    assert rows(jaccard.similar_groups(documents(spark, []))) == []


def test_measured_meetings_choose_the_segments(spark):
    """Documents that share half of their shingles without linking: the layout chosen from the sample meets fewer pairs."""
    r = random.Random(6)
    common = [f"c{i}" for i in range(46)]
    texts = [" ".join(common + [f"x{r.random()}" for _ in range(22)]) for _ in range(400)]
    docs = jaccard.documents(documents(spark, texts))
    layouts = jaccard.Layouts(90)
    layouts.met = jaccard._chances(docs, 3, layouts)
    layouts.histogram = {b: 10**6 for b in range(20)}
    sets = jaccard.shingle_sets(pa.array([t.encode() for t in texts], pa.binary()), 3)
    b = layouts.band(len(sets[0]))
    pairs = {}
    for ones in layouts.choices(b):
        layout, holders = layouts.choose(b, ones), {}
        for i, found in enumerate(sets):
            for sig in layout.signatures(found, jaccard._values(found), b).tolist():
                holders.setdefault(sig, []).append(i)
        pairs[ones] = sum(len(h) * (len(h) - 1) // 2 for h in holders.values())
        n = len(sets) * (len(sets) - 1) / 2
        assert layouts.met[b, ones] == pytest.approx(pairs[ones] / n, rel=1e-9)
    assert pairs[0] > 0 and layouts.allocation(b)[1] > 0 and pairs[layouts.allocation(b)[1]] < pairs[0]
    few = jaccard.Layouts(90, {b: 2 for b in range(20)}, met=layouts.met)
    assert few.band(len(sets[0])) == b and few.allocation(b)[1] == 0


def test_busy_keys_are_answered_like_others(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST", 4)
    texts = near_copies(5, (30, 60)) + ["the very same text of a few words"] * 40 + [None, ""] * 5
    assert sorted(rows(jaccard.similar_groups(documents(spark, texts)))) == sorted(plain_groups(texts, 3, 90))
