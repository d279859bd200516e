import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import awkward, documents, frame, rows
from tokenizers import Tokenizer

from waymark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    "H\u0331. h\u0331. H\u0331 e\u0301, E\u0301; <|ENDOFTEXT|> Word. WORD, word! É! élan, a\u0301. it'S. 's, x², ½. ٣. 一。 \u2019. \u0301.",
    "<|endoftext|> a<|startoftext|>b", "it's we'll 12,345 ½ á ́b é x\x85y  ", "don't-stop...now!!", "ΑΣ ΟΔΟΣ", "İstanbul", "a\x00b", "😀😀 é É ﬁ", "​ x"]


def plain(texts):
    tokenizer, out = Tokenizer.from_file(PATH), {}
    for i, t in enumerate(texts):
        out[i] = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    return out


def check_packed(found, capacity):
    by = defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by


@pytest.mark.parametrize(("capacity", "block"), [(2048, 8192), (64, 10), (7, 1)])
def test_pieces_equal_the_whole_tokenizer(spark, capacity, block):
    texts = awkward() + TRICKY + [" ".join(TRICKY)]
    found = packing.pack(packing.tokenize(documents(spark, texts), PATH, capacity, with_ids=True), capacity, block=block).collect()
    expected = {}
    for i, ids in plain(texts).items():
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[i, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part)
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"], list(r["ids"])) for r in found} == expected
    check_packed(found, capacity)


def test_few_sequences_and_their_ids(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 300))) for _ in range(600)]
    packed = packing.pack(packing.tokenize(documents(spark, texts), PATH, 256, with_ids=True), 256)
    found = packed.collect()
    total = sum(x["length"] for x in found)
    assert len(check_packed(found, 256)) <= 1.02 * total / 256 + 1
    whole = {x["sequence_id"]: list(x["ids"]) for x in packing.sequences(packed).collect()}
    assert all(whole[x["sequence_id"]][x["offset"] : x["offset"] + x["length"]] == list(x["ids"]) for x in found)


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_constraint_holds(by):
    r = np.random.default_rng(1)
    length = r.integers(1, 100, 500)
    needs = np.column_stack([length, np.ones_like(length), length**2])
    capacities = np.array([200, 4, 12_000])
    bins, offsets = packing.best_fit(needs, capacities, np.array([1.0, 0.5, 0.5]), by)
    for b in np.unique(bins):
        assert (needs[bins == b].sum(axis=0) <= capacities).all()
        order = np.argsort(offsets[bins == b])
        assert (np.cumsum([0, *length[bins == b][order][:-1]]) == offsets[bins == b][order]).all()
    assert len(np.unique(bins)) <= 1.25 * (needs.sum(axis=0) / capacities).max()


def test_documents_and_cost_decide_between_bins():
    r = np.random.default_rng(2)
    length = np.concatenate([r.integers(1, 2048, 800), r.integers(1, 40, 2000)])
    needs = np.column_stack([length, np.ones_like(length), length**2])
    capacities = np.array([2048, 2048, 2048**2])
    chosen, tokens = (packing.best_fit(needs, capacities, np.array(w))[0] for w in (packing.WEIGHTS, (1.0, 0.0, 0.0)))
    groups = lambda bins: {frozenset(np.flatnonzero(bins == b).tolist()) for b in np.unique(bins)}
    assert groups(chosen) != groups(tokens)
    assert len(np.unique(chosen)) <= 1.01 * length.sum() / 2048 + 1


def test_constraints_through_the_operator(spark):
    texts = ["a b c"] * 40 + ["a " * 60]
    found = packing.pack(packing.tokenize(documents(spark, texts), PATH, 50), 50, max_documents=3, max_cost=50 * 50).collect()
    groups = check_packed(found, 50)
    assert max(map(len, groups.values())) == 3
    assert all(sum(n * n for _, n in parts) <= 2500 for parts in groups.values())


def test_empty_and_repeated(spark):
    assert rows(packing.pack(packing.tokenize(documents(spark, []), PATH))) == []
    twice = frame(spark, [(i, "a b", None, None, None, "k", 1, "b", 1, 1, "f") for i in (4, 4, None)])
    found = packing.pack(packing.tokenize(twice, PATH)).collect()
    assert sorted(str(x["doc_id"]) for x in found) == ["4", "4", "None"] and sorted(x["offset"] for x in found) == [0, 3, 6]


def test_small_memory_of_words_gives_the_same_ids(spark, monkeypatch):
    texts = awkward() + TRICKY
    wanted = [x.tolist() for x in packing.encode(PATH, [None if t is None else t.encode() for t in texts])]
    packing._encoder.cache_clear()
    monkeypatch.setattr(packing, "CACHE", 3)
    for _ in range(3):
        assert [packing.encode(PATH, [None if t is None else t.encode()])[0].tolist() for t in texts] == wanted
    packing._encoder.cache_clear()
