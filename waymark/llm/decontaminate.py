"""Benchmark decontamination: documents stream through a generalised suffix automaton of the benchmark items."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.text import documents, map_slices, words

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BLOCK_WORDS = 200_000  # item words per automaton: about 160 MB in a worker

MATCH = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


class SuffixAutomaton:
    """All substrings of the items, as states with suffix links.

    ``windows`` are the substrings of ``window`` words; an item of fewer words is one window as a whole.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
        size = len(self.next)
        self.home = [0] * size  # the state that holds the last `window` words of a match that ends here
        self.named: dict[int, set[str | None]] = {}  # items by home state
        self.short: dict[int, list[tuple[int, set[str | None]]]] = {}  # whole short items that end in a state
        for _, item in items:
            assert all(word in self.next[0] for word in item)
        order = sorted(range(1, size), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.home[s] = self.home[up] if self.length[up] >= window else s
        for name, item in items:
            s = 0
            for count, word in enumerate(item, 1):
                s = self.next[s][word]
                if count >= window:
                    self.named.setdefault(self.home[s], set()).add(name)
            if 0 < len(item) < window:
                self.short.setdefault(s, []).append((len(item), {name}))
        far = 1 << 62
        self.least = [far] * size  # shortest match that holds a window when the stream is in this state
        for s in order:
            own = self.short.get(s, [])
            above = self.short.get(self.link[s], [])
            if own or above:
                self.short[s] = own + above
            self.least[s] = min([window if self.length[s] >= window else far, *(k for k, _ in own + above)])

    def _extend(self, last: int, word: bytes) -> int:
        there = self.next[last].get(word)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        if there is not None:
            return self._clone(last, word, there)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            there = self.next[last][word]
            self.link[new] = there if self.length[there] == self.length[last] + 1 else self._clone(last, word, there)
        return new

    def _clone(self, last: int, word: bytes, there: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[there]))
        self.length.append(self.length[last] + 1)
        self.link.append(self.link[there])
        self.link[there] = copy
        while last >= 0 and self.next[last].get(word) == there:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def match(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Word spans [start, end) of all occurrences of windows, merged, and the items they are from."""
        following, link, length, least = self.next, self.link, self.length, self.least
        found: list[tuple[int, int]] = []
        homes: set[int] = set()
        names: set[str | None] = set()
        root = following[0]
        row, s, reach = root, 0, 0
        for i, word in enumerate(text):
            if word in row:
                s = row[word]
                reach += 1
            elif not s:
                continue
            else:
                s = link[s]
                while s > 0 and word not in following[s]:
                    s = link[s]
                if word not in following[s]:
                    row, s, reach = root, 0, 0
                    continue
                reach = length[s] + 1
                s = following[s][word]
            row = following[s]
            if reach >= least[s]:
                longest = 0
                if reach >= self.window:
                    homes.add(self.home[s])
                    longest = self.window
                for k, short in self.short.get(s, ()):
                    if k <= reach:
                        names |= short
                        longest = max(longest, k)
                found.append((i + 1 - longest, i + 1))
        for h in homes:
            names |= self.named[h]
        return _merge(found), names


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> list[list[tuple[str | None, list[bytes]]]]:
    """Items as words, in blocks of at most ``block_words`` words (an item is never cut). Items without words are left out."""
    blocks: list[list[tuple[str | None, list[bytes]]]] = []
    room = 0
    chosen = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("body"))
    for row in chosen.toLocalIterator():
        item = words(bytes(row["body"]) if row["body"] is not None else None)
        if not item:
            continue
        if not blocks or room < len(item):
            blocks.append([])
            room = block_words
        blocks[-1].append((row["item_id"], item))
        room -= len(item)
    return blocks


def match_benchmark(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each document with n_words, n_hit, the ids of items with occurring windows, and the word spans hit.

    The benchmark is the stated query set: its items are read in blocks of ``block_words`` words, each block becomes
    one automaton in the workers, and the documents stream past the blocks one after the other in one stage, without
    a shuffle. Memory per worker is that of one block.

    A null or empty text has no words and no hit. A null item id counts for hits but names no item. Repeated rows
    are answered each. Without items nothing is hit. Columns other than doc_id and text are not read.
    """
    blocks = item_blocks(items, block_words)
    spark = docs.sparkSession
    out = documents(docs)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, body binary, {MATCH}"
    out = out.selectExpr("doc_id", "body", "0L n_words", "0L n_hit", "cast(array() as array<string>) items", "cast(array() as array<struct<start:long,end:long>>) spans")
    for block in blocks or [[]]:
        given = spark.sparkContext.broadcast(block)
        out = map_slices(out, schema, lambda given=given: _matcher(SuffixAutomaton(given.value, window)))
    return out


def _matcher(automaton: SuffixAutomaton):
    kinds = pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def match(batch: pa.RecordBatch) -> pa.RecordBatch:
        before = batch.to_pydict()
        n_words, n_hit, items, spans = [], [], [], []
        for body, had, old in zip(before["body"], before["items"], before["spans"], strict=True):
            text = words(body)
            found, names = automaton.match(text)
            found = _merge(found + [(x["start"], x["end"]) for x in old]) if old else found
            n_words.append(len(text))
            n_hit.append(sum(end - start for start, end in found))
            items.append(sorted({*had, *(x for x in names if x is not None)}))
            spans.append([{"start": start, "end": end} for start, end in found])
        columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, kinds[0]), pa.array(spans, kinds[1])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "n_words", "n_hit", "items", "spans"])

    return match


def remove_benchmark(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, without the spans hit; a document of which more than ``max_coverage`` of the words is hit goes.

    All columns stay; ``n_chars``, where present, is that of the text that is left. Clean rows, and null texts, are as before.
    """
    blocks = item_blocks(items, block_words)
    given = [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]
    names = docs.columns
    at = names.index("text")

    def make():
        automata = [SuffixAutomaton(b.value, window) for b in given]

        def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, keep = [], []
            for body in batch.column(at).cast(pa.binary()).to_pylist():
                text = words(body)
                found = _merge([span for a in automata for span in a.match(text)[0]])
                hit = sum(end - start for start, end in found)
                keep.append(hit <= max_coverage * len(text))
                texts.append(without_spans(body, found).decode() if hit and keep[-1] else None if body is None else body.decode())
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

        return clean

    out = map_slices(docs, docs.schema, make)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def ids_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
