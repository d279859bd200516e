import random
import zlib
from collections import Counter, defaultdict

import pytest
from cases import awkward, documents, frame, rows

from waymark.llm import spelling

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xC0, 0x100))


def brute_counts(docs, min_chars=7, min_count=2, damage=None):
    letters, count = set(ALPHABET) | set(ALPHABET[:26].upper()), Counter()
    for i, text in docs:
        for run in "".join(c if c in letters else " " for c in text or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if damage and (h := zlib.crc32(f"{'' if i is None else i}:{run}".encode())) % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= min_chars and n >= min_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, factor=10):
    near, form = defaultdict(list), {}
    for w in words:
        near[w] = [x for x in words if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= factor * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def answer(df):
    return sorted(rows(df, "word", "form", "root", "n", "n_near", "form_n"))


def table(spark, words):
    return spark.createDataFrame([(w, n, 1, "x") for w, n in words.items()], "word string, n long, id long, nodes string")


@pytest.mark.parametrize("damage", [None, 3])
def test_counts_equal_brute_force(spark, damage):
    texts = awkward() + ["Strasse STRASSE straße Straße ÉTÉÉTÉ éTÉÉTÉ x÷yyyyy×z", "naïve-naïveté naïveté"] * 3
    got = dict(rows(spelling.word_counts(documents(spark, texts), 2, 2, damage), "word", "n"))
    assert got == brute_counts(enumerate(texts), 2, 2, damage) and "étéété" not in got


@pytest.mark.parametrize("section", [7, 100, 50_000])
def test_equals_brute_force(spark, monkeypatch, section):
    r = random.Random(section)
    made = {"".join(r.choice("abÿ") for _ in range(r.randint(1, 6))): r.choice([1, 1, 2, 10, 100, 1000]) for _ in range(250)}
    made |= {"aaaaaaa": 5, "aaaaaa": 50, "aaaaa": 500, "zz" * 3000: 3, "zz" * 3000 + "z": 40}
    monkeypatch.setattr(spelling, "PART_WORDS", section)
    monkeypatch.setattr(spelling, "BORDER_CHARS", 3)
    got = answer(spelling.variants(table(spark, made)))
    assert got == brute(made)
    assert any(f and root != f for _, f, root, *_ in got)


def test_all_letters_in_one_place(spark):
    made = {f"word{c}word": 1 + i for i, c in enumerate(ALPHABET)} | {"wordword": 400}
    assert answer(spelling.variants(table(spark, made))) == brute(made)


def test_one_letter_skipped_in_a_run_is_one_neighbour(spark):
    made = {"aabbccc": 3, "aabbcc": 3, "abbccc": 3, "aabccc": 30}
    assert answer(spelling.variants(table(spark, made))) == brute(made)


def test_chains_of_forms_end_in_their_root(spark):
    made = {"abcdefg"[:k]: 10**k for k in range(1, 8)}
    assert {w: root for w, _, root, *_ in answer(spelling.variants(table(spark, made)))} == dict.fromkeys(made, "abcdefg")


def test_numbers_are_equal_only_for_equal_beginnings():
    words = sorted({"".join(random.Random(i).choices("ab", k=i % 9)) for i in range(400)} - {""})
    for borders in ([], ["ab", "aba", "b", "bb"], words[::7]):
        trie, seen = spelling._Trie(borders), {}
        for w in words:
            nodes = trie.add(spelling.bisect_right(borders, w), w)
            for depth, node in enumerate(nodes):
                assert seen.setdefault(w[:depth], node) == node
        assert len(set(seen.values())) == len(seen)


def test_empty_and_repeated(spark):
    assert rows(spelling.variants(spelling.word_counts(documents(spark, [])))) == []
    twice = frame(spark, [(i, "lengthy words", "en", "s", 1, "k", 1, "b", 1, 1, "f") for i in (1, 1, None)] + [(2, None, "en", "s", 1, "k", 1, "b", 1, 1, "f")])
    assert answer(spelling.variants(spelling.word_counts(twice))) == [("lengthy", None, "lengthy", 3, 0, None)]
