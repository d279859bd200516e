"""Language ID: known words by log frequency per language, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.arrays import by_bucket, map_array, new_folder, write_array
from waymark.llm.text import documents, fold, map_slices
from waymark.session import cut, spread

SAMPLE_ROWS = 40_000  # about so many labelled rows teach the model, the same number of each language where there are as many
GRAM = 4  # characters of the longest n-grams
BITS = 4  # of a hash that choose the file of a word or n-gram
GRAM_ROWS = 8_000  # words whose n-grams a task counts at a time
CACHE, STEP = 200_000, 20_000  # words whose scores a worker remembers, and words that it looks up at a time
EVIDENCE = 20.0  # words that count as independent at most, for the score
UNKNOWN = "und"

_LETTER = re.compile(rb"[A-Za-z]")
_NO_LETTER = bytes(b if b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def _words(body: bytes | None) -> list[bytes]:
    return (body or b"").decode().lower().encode().translate(_NO_LETTER).split()


def _has_letter(body: bytes | None) -> bool:
    return bool(body) and (bool(_LETTER.search(body)) or any(c.isalpha() for c in body.decode()))


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between marks of its ends; the single characters without the marks."""
    marked = word if n == 1 else f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    found: Counter = Counter()
    for body, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for word, n in Counter(_words(body)).items():
            found[lang, word] += n
    keys = list(found)
    columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1].decode() for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])


def fit(train: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Learn from (doc_id, text, lang) rows; rows without a language or text teach nothing.

    A bounded sample teaches: about ``sample_rows`` rows, dealt evenly to the languages, chosen by a hash of the id and text. All words and
    n-grams of the sample's whole texts are counted and written to the shared folder as sorted arrays of 64-bit hashes with their counts
    per language; the driver holds the languages and their totals only.
    """
    labelled = train.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    if not langs:
        return {"langs": [], "totals": np.zeros((GRAM + 1, 0), np.int64), "folder": "", "filled": frozenset()}
    share = -(-sample_rows // len(langs))
    if all(n <= share for n in per_lang.values()):
        chosen = labelled
    else:
        kept = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(int(min(1.0, share / per_lang[lang]) * 2**20)))])
        chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**20)) < F.element_at(kept, F.col("lang")))
    body = chosen.select(F.col("text").cast("binary").alias("body"), "lang")
    counted = map_slices(body, "lang string, word string, n long", lambda: _count_words, rows=1024).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = cut(spread(counted, "word"))
    numbers = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
    grams_of = map_slices(counted, "lang string, size int, key string, n long", lambda: _count_grams, rows=GRAM_ROWS)
    rows = counted.select("lang", F.lit(0).alias("size"), F.col("word").alias("key"), "n").unionByName(grams_of)
    keyed = rows.select(F.element_at(numbers, F.col("lang")).alias("at"), "size", F.xxhash64("key").alias("key"), "n").groupBy("size", "key", "at").agg(F.sum("n").alias("n"))
    slotted = keyed.withColumn("slot", F.col("size") * 2**BITS + F.shiftrightunsigned("key", 64 - BITS).cast("int")).select("slot", "key", "at", "n")
    folder = new_folder(train.sparkSession)
    ready = spread(slotted, "slot").sortWithinPartitions("slot", "key")
    told = by_bucket(ready, "slot int, totals array<long>", lambda c: c["slot"], _writer(folder, len(langs))).collect()  # a row per slot
    totals = np.zeros((GRAM + 1, len(langs)), np.int64)
    for r in told:
        totals[r["slot"] >> BITS] += np.array(r["totals"], np.int64)
    return {"langs": langs, "totals": totals, "folder": folder, "filled": frozenset(r["slot"] for r in told)}


def _count_grams(batch: pa.RecordBatch) -> pa.RecordBatch:
    found: Counter = Counter()
    for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        for size in range(1, GRAM + 1):
            for g in grams(word, size):
                found[lang, size, g] += n
    keys = list(found)
    columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], ["lang", "size", "key", "n"])


def _writer(folder: str, langs: int):
    def write(slot: int, columns: dict[str, np.ndarray]) -> dict:
        keys, at = np.unique(columns["key"], return_inverse=True)
        counts = np.zeros((len(keys), langs), np.int64)
        counts[at, columns["at"]] = columns["n"]
        write_array(folder, f"key{slot}", keys)
        write_array(folder, f"count{slot}", counts)
        return {"slot": pa.array([slot], pa.int32()), "totals": pa.array([counts.sum(axis=0).tolist()], pa.list_(pa.int64()))}

    return write


def _hash(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 42)  # as xxhash64() of the same text


class Scorer:
    """Log frequencies per language of words, looked up or backed off, remembered up to ``CACHE`` words."""

    def __init__(self, model: dict):
        self.langs, self.folder, self.filled = model["langs"], model["folder"], model["filled"]
        self.totals = model["totals"] + 1.0
        self.room = CACHE
        self.rows = np.zeros((self.room, len(self.langs)), np.float32)
        self.seen: dict[bytes, int] = {}
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # at most 2^BITS for words and for each length of n-grams

    def _slot(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        if slot not in self.maps:
            counts = map_array(self.folder, f"count{slot}", np.int64).reshape(-1, len(self.langs))
            self.maps[slot] = map_array(self.folder, f"key{slot}", np.int64), counts
        return self.maps[slot]

    def find(self, size: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words, or n-grams of a size, were learned; their log frequencies)."""
        hashes = np.array([_hash(t) for t in texts], np.uint64)
        known, logs = np.zeros(len(texts), bool), np.zeros((len(texts), len(self.langs)), np.float32)
        slots = (hashes >> np.uint64(64 - BITS)).astype(np.int64) + (size << BITS)
        order = np.argsort(slots, kind="stable")
        edges = np.flatnonzero(np.diff(slots[order], prepend=-1))
        for start, end in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[start:end]
            slot = int(slots[rows[0]])
            if slot not in self.filled:
                continue
            keys, counts = self._slot(slot)
            wanted = hashes[rows].view(np.int64)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            known[rows[hit]] = True
            logs[rows[hit]] = np.log10((counts[at[hit]] + 0.1) / self.totals[size])
        return known, logs

    def look_up(self, found: list[bytes]) -> np.ndarray:
        """Log frequencies of words; an unseen one has the mean of its longest n-grams of which any was seen, or zeros."""
        known, logs = self.find(0, found)
        open_ = np.flatnonzero(~known)
        for n in range(GRAM, 0, -1):
            if not len(open_):
                break
            parts = [grams(found[i].decode(), n) for i in open_]
            owner = np.repeat(open_, [len(p) for p in parts])
            hit, values = self.find(n, [g.encode() for p in parts for g in p])
            hits = np.bincount(owner[hit], minlength=len(found))
            sums = np.zeros((len(found), len(self.langs)))
            np.add.at(sums, owner[hit], values[hit])
            told = open_[hits[open_] > 0]
            logs[told] = sums[told] / hits[told, None]
            open_ = open_[hits[open_] == 0]
        return logs

    def learn(self, found: set[bytes]) -> None:
        """Remember the log frequencies of words that are not remembered yet, as far as they fit."""
        new = sorted(found - self.seen.keys())
        if len(self.seen) + len(new) > self.room:
            self.seen.clear()
            new = sorted(found)[: self.room]
        for start in range(0, len(new), STEP):
            part = new[start : start + STEP]
            base = len(self.seen)
            self.rows[base : base + len(part)] = self.look_up(part)
            self.seen.update(zip(part, range(base, base + len(part)), strict=True))

    def score(self, text: list[bytes]) -> np.ndarray:
        """Mean of the words' log frequencies, per language."""
        total = np.zeros(len(self.langs))
        for start in range(0, len(text), self.room):
            part = text[start : start + self.room]
            try:
                ids = [self.seen[word] for word in part]
            except KeyError:
                self.learn(set(part))
                ids = [self.seen[word] for word in part]
            total += self.rows[ids].sum(axis=0, dtype=np.float64)
        return total / len(text)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was learned. The score is the share of
    the best language, with the evidence of at most ``EVIDENCE`` words; ties go to the first language by name.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)
    return map_slices(documents(docs), f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double", lambda: _predictor(Scorer(given.value)))


def classify(scorer: Scorer, bodies: list[bytes | None]) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    texts = [_words(body) if scorer.langs and _has_letter(body) else [] for body in bodies]
    scorer.learn(set().union(*texts))
    for text in texts:
        if not text:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        mean = scorer.score(text)
        share = np.exp((mean - mean.max()) * np.log(10) * min(len(text), EVIDENCE))
        best = int(np.argmax(mean))
        langs.append(scorer.langs[best])
        scores.append(float(share[best] / share.sum()))
    return langs, scores


def _predictor(scorer: Scorer):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = classify(scorer, batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def training_rows(docs: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    return docs.where(fold("doc_id", parts) != held_out)


def keep_known(docs: DataFrame, model: dict, min_score: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose language is told with at least ``min_score``."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        scorer = Scorer(given.value)

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = classify(scorer, batch.column(at).cast(pa.binary()).to_pylist())
            return batch.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(langs, scores, strict=True)], pa.bool_()))

        return keep

    return map_slices(docs, docs.schema, make)
