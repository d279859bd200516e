"""Spelling variant grouping: numbered nodes of a forward and a reversed trie find all words one edit apart by integer joins.

A word with code points 0..L-1 has forward nodes P0..PL (of its beginnings) and reversed nodes S0..SL (of its endings). The pair
(P_i, S_i) is the word itself, (P_i, S_i+1) the word with position i skipped. Words that share a skipped pair differ in that
one place; a skipped pair that is another word's whole pair is a deletion here and an insertion there.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.text import slices
from waymark.session import cut, cut_and_measure, spread

MIN_CHARS, MIN_COUNT, FACTOR = 7, 2, 10
DAMAGE = 31  # one run in so many loses a code point, by the checksum of document and run
PART_WORDS, MOST_PARTS = 50_000, 2_000  # words numbered together, and sections of the sorted words at most
BORDER_CHARS, SAMPLES = 64, 20  # of a section's border, and sampled words per section that borders are picked from
HELD = 200_000  # distinct words that a task counts before it passes them on

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_KEYS = "p long, s long, kind tinyint, id long, n long"
_ROOT, _SHARED = 0, 1 << 62  # numbers of the empty beginning, and of nodes that several sections may hold


def spoilt(doc_id: str, run: str, every: int) -> str:
    """The run without one code point, if ``every`` divides the checksum of ``doc_id:run``; else the run."""
    check = zlib.crc32(f"{doc_id}:{run}".encode())
    if check % every:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """(word, n): runs of ``[A-Za-z\\u00C0-\\u00FF]`` of all texts with A-Z lower-cased, counted in their task before the shuffle.

    With ``damage`` a run loses a code point where that number divides the unsigned crc32 of ``doc_id:run`` (a null id is
    empty text). Words have ``min_chars`` code points and ``min_count`` occurrences at least. A null text has none.
    """
    asked = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("binary").alias("body"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= min_chars]
            found = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
            held.clear()
            return found

        for batch in batches:
            for part in slices(batch, 256, 1 << 21):
                for doc_id, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    runs = Counter(_RUN.findall((body or b"").decode().translate(_LOWER)))
                    if damage:
                        for run, n in runs.items():
                            held[spoilt(doc_id, run, damage)] += n
                    else:
                        held.update(runs)
                if len(held) > HELD:
                    yield flush()
        yield flush()

    counted = asked.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


# ---- trie nodes --------------------------------------------------------------------------------------------------------


def _borders(words: DataFrame, n: int) -> list[str]:
    """Sorted strings that cut the words into sections of about ``PART_WORDS``: at most ``MOST_PARTS``, from a bounded sample."""
    parts = min(MOST_PARTS, -(-n // PART_WORDS))
    if parts < 2:
        return []
    step = max(1, n // (SAMPLES * parts))
    picked = words.where(F.pmod(F.xxhash64("word"), F.lit(step)) == 0).select(F.substring("word", 1, BORDER_CHARS).alias("w"))
    found = sorted(r["w"] for r in picked.collect())  # about SAMPLES a section
    return sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []


class _Trie:
    """Numbers the nodes of words that come in sorted order, section by section.

    Only the words next to each other are compared: a node is new where a word leaves its predecessor. Beginnings that a
    border has too may occur in several sections; they are named after the first border that has them.
    """

    def __init__(self, borders: list[str]):
        self.borders, self.part, self.word, self.nodes = borders, -1, "", [_ROOT]
        self.next, self.index, self.shared = 0, 0, {}

    def _enter(self, part: int) -> None:
        self.part, self.word, self.nodes, self.next, self.index = part, "", [_ROOT], (part << 36) + 1, part << 36
        self.shared = {}
        for border in self.borders[max(part - 1, 0) : part + 1]:
            for depth in range(1, len(border) + 1):
                start = border[:depth]
                self.shared[start] = _SHARED + (bisect_left(self.borders, start) << 32) + depth

    def add(self, part: int, word: str) -> list[int]:
        """Node numbers of all beginnings of the word, the empty one first. Valid until the next call."""
        if part != self.part:
            self._enter(part)
        last, nodes, shared = self.word, self.nodes, self.shared
        at, most = 0, min(len(last), len(word))
        while at < most and last[at] == word[at]:
            at += 1
        del nodes[at + 1 :]
        named = at == 0 or nodes[at] >= _SHARED  # beginnings of a shared node are shared too
        for depth in range(at + 1, len(word) + 1):
            node = shared.get(word[:depth]) if named else None
            if node is None:
                named, node = False, self.next
                self.next += 1
            nodes.append(node)
        self.word = word
        self.index += 1
        return nodes


def _sections(words: DataFrame, borders: list[str]) -> DataFrame:
    """The words in sorted order within their sections, each section in one task."""
    n = len(borders) + 1
    placed = _with_part(words, borders).repartitionByRange(n, "part") if n > 1 else words.withColumn("part", F.lit(0)).coalesce(1)
    return placed.sortWithinPartitions("part", "word")


def _with_part(words: DataFrame, borders: list[str]) -> DataFrame:
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in words.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect_right(borders, w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "part"])

    return words.mapInArrow(place, f"{kinds}, part int")


def _forward(words: DataFrame, borders: list[str]) -> DataFrame:
    """(id, word, n, nodes): ids follow the order of the words; nodes of their beginnings."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _Trie(borders)
        for batch in batches:
            for rows in batch_parts(batch):
                ids, flat, sizes = [], [], [0]
                for word, part in zip(rows.column("word").to_pylist(), rows.column("part").to_pylist(), strict=True):
                    flat += trie.add(part, word)
                    sizes.append(len(flat))
                    ids.append(trie.index)
                nodes = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), rows.column("word"), rows.column("n"), nodes], ["id", "word", "n", "nodes"])

    return _sections(words.select("word", "n"), borders).mapInArrow(number, "id long, word string, n long, nodes array<bigint>")


_SKIP, _SKIP_FIRST, _WHOLE = 0, 1, 2  # kinds of pairs; a run of equal letters gives the same word wherever one is skipped


def _pairs(numbered: DataFrame, borders: list[str]) -> DataFrame:
    """Pairs of forward and reversed nodes of every word: each position skipped, and the whole word cut at each position."""
    back = numbered.select(F.reverse("word").alias("word"), "id", "n", "nodes")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _Trie(borders)
        for batch in batches:
            for part in batch_parts(batch):
                p, s, kinds, sizes = [], [], bytearray(), []
                for word, section, nodes in zip(part.column("word").to_pylist(), part.column("part").to_pylist(), part.column("nodes").to_pylist(), strict=True):
                    ends = trie.add(section, word)[::-1]
                    p += nodes[:-1]
                    p += nodes
                    s += ends[1:]
                    s += ends
                    word = word[::-1]
                    kinds += bytes([_SKIP_FIRST if a != b else _SKIP for a, b in zip(" " + word, word)])
                    kinds += bytes([_WHOLE]) * len(nodes)
                    sizes.append(len(nodes) + len(ends) - 1)
                repeat = np.repeat(np.arange(part.num_rows), sizes)
                columns = [pa.array(p, pa.int64()), pa.array(s, pa.int64()), pa.array(np.frombuffer(bytes(kinds), np.int8)), part.column("id").take(pa.array(repeat)), part.column("n").take(pa.array(repeat))]
                yield pa.RecordBatch.from_arrays(columns, ["p", "s", "kind", "id", "n"])

    return _sections(back, borders).mapInArrow(make, _KEYS)


def batch_parts(batch: pa.RecordBatch, rows: int = 4_096) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


# ---- neighbours --------------------------------------------------------------------------------------------------------


def _neighbours(pairs: DataFrame) -> DataFrame:
    """(id, near, best_n, best): what each pair tells of a word: near words by it, and the most frequent of them (smallest id on ties).

    A pair has a word per letter of the alphabet and a whole word at most, so groups are small whatever the vocabulary. Sorted
    groups stream by; the two best of a group answer all its members, no two of which are paired.
    """
    ordered = spread(pairs, "p", "s").sortWithinPartitions("p", "s", F.col("kind") == _WHOLE, F.desc("n"), "id")
    names = ["p", "s", "kind", "id", "n"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            rest = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
            p, s = rest[0], rest[1]
            ends = np.flatnonzero((p[1:] != p[:-1]) | (s[1:] != s[:-1])) + 1
            if len(ends):
                last = int(ends[-1])
                yield _answers(*[x[:last] for x in rest])
                rest = [x[last:] for x in rest]
        if rest:
            yield _answers(*rest)

    return ordered.mapInArrow(meet, "id long, near long, best_n long, best long")


def _answers(p: np.ndarray, s: np.ndarray, kind: np.ndarray, id_: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
    size = np.diff(np.append(np.flatnonzero(new), len(p)))
    busy = np.repeat(size > 1, size)  # most pairs have one word
    p, s, kind, id_, n, new = p[busy], s[busy], kind[busy], id_[busy], n[busy], new[busy]
    if not len(p):
        return pa.RecordBatch.from_pydict({c: pa.array([], pa.int64()) for c in ("id", "near", "best_n", "best")})
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    skip, first, whole = kind != _WHOLE, kind == _SKIP_FIRST, kind == _WHOLE
    skips = np.add.reduceat(skip.astype(np.int64), start)
    out = []

    def tell(rows: np.ndarray, near: np.ndarray | int, best: np.ndarray) -> None:
        out.append((id_[rows], np.broadcast_to(near, len(rows)), n[best], id_[best]))

    # replaced: the first skipped row of a group is its best, the next one the best but for it
    rows = np.flatnonzero(skip & (skips[group] > 1))
    top = start[group[rows]]
    tell(rows, skips[group[rows]] - 1, np.where(rows == top, top + 1, top))
    # a whole word, last of its group, and the words that become it by leaving out a letter
    at = np.full(len(start), -1)
    at[group[whole]] = np.flatnonzero(whole)
    rows = np.flatnonzero(first & (at[group] >= 0))
    tell(rows, 1, at[group[rows]])
    if len(rows):
        groups, firsts, counts = np.unique(group[rows], return_index=True, return_counts=True)
        tell(at[groups], counts, rows[firsts])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["id", "near", "best_n", "best"])


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), whose words are distinct and not null.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. ``form`` is the near word of largest n (ties: smallest in
    code-point order) if that n is at least ``factor`` times the word's (2 or more), else null, and form_n its n. ``root`` follows forms to
    the last; a word without a form is its own. Other columns are ignored; an empty table gives none.

    Nodes are numbered exactly by comparing neighbours of the sorted words, so pairs of numbers are equal only if the strings are.
    """
    table, seen = cut_and_measure(words.select("word", "n"), n=F.count("*"), most=F.max("n"))
    numbered = cut(_forward(table, _borders(table, seen["n"])))
    back = _borders(table.select(F.reverse("word").alias("word")), seen["n"])
    told = _neighbours(_pairs(numbered, back))
    best = F.max(F.struct(F.col("best_n").alias("n"), (-F.col("best")).alias("id")))
    stats = told.groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best"))
    likely = F.col("best.n") >= factor * F.col("n")
    joined = cut(numbered.select("id", "word", "n").join(stats, "id", "left").select("id", "word", "n", "n_near", F.when(likely, -F.col("best.id")).alias("form_id")))
    # Each form has `factor` times the occurrences, so chains are short: each round doubles what a step leaps.
    leaps = cut(joined.where("form_id is not null").select("id", F.col("form_id").alias("root_id")))
    length, most = 1, seen["most"] or 1
    while factor**length < most:
        further = leaps.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        leaps = cut(leaps.join(further, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id")))
        length *= 2
    names = joined.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = joined.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    changed = joined.where("form_id is not null").join(leaps, "id").join(names, "form_id").join(roots, "root_id")
    same = joined.where("form_id is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    found = changed.select("word", "form", "root", "n", "n_near", "form_n").unionByName(same)
    return found.withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
