"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and stored as sorted hash arrays.

Words are known by their 64-bit hashes. The top bits of a hash are the bucket of its word, and its place among the sorted hashes
of the bucket makes the word's id. A pair of ids, mixed by a bijection so that no word makes a bucket large, is the key of a bigram.
Every bucket is a few files in the shared folder, which workers map into memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.arrays import by_bucket, map_array, new_folder, write_array
from waymark.llm.hashing import token_hashes
from waymark.llm.text import documents, map_slices, slices

END = 0  # hash of the end of a text
START = 2**32 - 1  # the id before the first token
HELD = 5_000_000  # keys held in a task before they are counted and passed on
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 2**64))
_HALF = np.uint64(32)
STATS = ("n1", "n2", "n3", "cont")  # of a word: words seen once, twice, more often after it; words before it


def mix(pairs: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers, as signed ones."""
    x = pairs * _ODD
    x ^= x >> _HALF
    return (x * _ODD).view(np.int64)


def unmix(keys: np.ndarray) -> np.ndarray:
    x = keys.view(np.uint64) * _BACK
    x ^= x >> _HALF
    return x * _BACK


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The top bits of signed keys, ascending with them."""
    return (keys >> (64 - bits)) + (1 << (bits - 1))


@dataclass
class Model:
    folder: str
    bits: int  # of a bucket
    tokens: int = 0
    distinct: int = 0
    documents: int = 0
    filled: frozenset = frozenset()  # buckets of words that have files
    filled_pairs: frozenset = frozenset()  # and of bigrams
    discounts: tuple = (0.0, 0.0, 0.0)
    low_discounts: tuple = (0.0, 0.0, 0.0)
    continuations: int = 0  # distinct bigrams
    low_backoff: float = 1.0
    start: tuple = (0, 0, 0)  # bigrams after START seen once, twice, more often
    _maps: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def array(self, name: str, kind) -> np.ndarray:
        if name not in self._maps:
            self._maps[name] = map_array(self.folder, name, kind)
        return self._maps[name]

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by their hashes; -1: never seen."""
        out = np.full(len(hashes), -1, np.int64)
        for bucket, rows, wanted in self._buckets(hashes):
            if bucket in self.filled:
                keys = self.array(f"w{bucket}", np.int64)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                out[rows] = np.where(keys[at] == wanted, (bucket << (32 - self.bits)) | at, -1)
        return out

    def word_values(self, ids: np.ndarray, name: str, kind) -> np.ndarray:
        """Values of a per-word array by id; 0 for id -1."""
        out = np.zeros(len(ids), kind)
        bucket = np.where(ids < 0, -1, ids >> (32 - self.bits))
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-2))
        for start, end in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[start:end]
            if bucket[rows[0]] >= 0:
                out[rows] = self.array(f"{name}{bucket[rows[0]]}", kind)[ids[rows] & ((1 << (32 - self.bits)) - 1)]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of bigrams by their sorted mixed keys."""
        out = np.zeros(len(keys), np.int64)
        for bucket, rows, wanted in self._buckets(keys):
            if bucket not in self.filled_pairs:
                continue
            for name, counts in (("once", None), ("more", "count")):
                there = self.array(f"{name}{bucket}", np.int64)
                if len(there):
                    at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
                    hit = there[at] == wanted
                    out[rows] += hit if counts is None else np.where(hit, self.array(f"{counts}{bucket}", np.uint32)[at], 0).astype(np.int64)
        return out

    def _buckets(self, keys: np.ndarray):
        if not len(keys):
            return
        order = slice(None) if (keys[:-1] <= keys[1:]).all() else np.argsort(keys)
        ranked = keys[order]
        buckets = bucket_of(ranked, self.bits)
        edges = np.flatnonzero(np.diff(buckets, prepend=-1))
        rows = np.arange(len(keys))[order]
        for start, end in zip(edges, [*edges[1:], len(ranked)], strict=True):
            yield int(buckets[start]), rows[start:end], ranked[start:end]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; plain halves where a count of counts is missing."""
    if not (n1 and n2 and n3 and n4):
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(c - (c + 1) * y * b / a, 0.05), c - 0.05) for c, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def with_ends(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text followed by its end, and where the texts start."""
    found, counts = token_hashes(bodies)
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(found) + len(counts), np.int64)
    out[ends] = END
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = found.view(np.int64)
    return out, ends - counts


def _counted(hold: int, name: str, keys_of):
    """Arrow job that counts the keys of the rows, in each task first, a bounded number at a time."""

    def run(batches):
        held, size = [], 0

        def passed():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], [name, "n"])

        for batch in batches:
            for part in slices(batch, 4096, 1 << 22):
                held.append(keys_of(part.column(1)))
                size += len(held[-1])
                if size > hold:
                    size = 0
                    yield passed()
        if held:
            yield passed()

    return run


def pairs(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(id before, id) of every token as one number."""
    low = ids.astype(np.uint64) & np.uint64(START)
    before = np.roll(low, 1)
    before[starts] = START
    return before << _HALF | low


def _pair_keys(model: Model, bodies: pa.Array) -> np.ndarray:
    hashes, starts = with_ends(bodies)
    distinct, at = np.unique(hashes, return_inverse=True)
    return mix(pairs(model.word_ids(distinct)[at], starts))


def fit(train: DataFrame) -> Model:
    """Count all rows of ``train`` (text; a null text is an empty one) and write the model to the shared folder.

    Three shuffles, of words, of bigrams and of what the bigrams say of each word. Frequent keys are counted
    in each task first, buckets are cut by hash, so a frequent word or pair is one row per task. At most 2^32 - 2
    distinct words. Nothing is pruned.
    """
    spark = train.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(max((4 * parts - 1).bit_length(), 5), 14)
    model = Model(new_folder(spark), bits)
    folder = model.folder
    docs = documents(train)

    def dealt(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(parts, F.shiftright(key, 64 - bits)).sortWithinPartitions(key)

    def write_words(bucket: int, c: dict) -> dict:
        keys, first = np.unique(c["h"], return_index=True)
        if len(keys) >= 1 << (32 - bits):
            raise ValueError("more distinct words than ids")
        counts = np.add.reduceat(c["n"], first)
        write_array(folder, f"w{bucket}", keys)
        write_array(folder, f"c{bucket}", counts)
        return {"bucket": [bucket], "n": [len(keys)], "total": [int(counts.sum())]}

    words = docs.mapInArrow(_counted(HELD, "h", lambda bodies: with_ends(bodies)[0]), "h long, n long")
    made = by_bucket(dealt(words, "h"), "bucket long, n long, total long", lambda c: bucket_of(c["h"], bits), write_words).collect()
    sizes = {r["bucket"]: r["n"] for r in made}  # one row per bucket
    model.filled = frozenset(sizes)
    model.tokens, model.distinct = sum(r["total"] for r in made), sum(sizes.values())
    if not made:
        return model

    def write_pairs(bucket: int, c: dict) -> dict:
        keys, first = np.unique(c["m"], return_index=True)
        counts = np.add.reduceat(c["n"], first)
        once = counts == 1
        write_array(folder, f"once{bucket}", keys[once])
        write_array(folder, f"more{bucket}", keys[~once])
        write_array(folder, f"count{bucket}", counts[~once].astype(np.uint32))
        both = unmix(keys)
        before, after = (both >> _HALF).astype(np.int64), (both & np.uint64(START)).astype(np.int64)
        seen = [before[counts == 1], before[counts == 2], before[counts >= 3], after]
        ids, at = np.unique(np.concatenate(seen), return_inverse=True)
        stats = np.split(at, np.cumsum([len(x) for x in seen])[:-1])
        n1, n2, n3, cont = (np.bincount(x, minlength=len(ids)) for x in stats)
        # besides, under negative ids: counts of counts, and that this bucket has files
        sums = [np.array([(counts == k).sum(), 0]) for k in (1, 2, 3, 4)]
        return {"id": np.concatenate([ids, [-1, -2 - bucket]])} | {name: np.concatenate([v, s]) for name, v, s in zip(STATS, (n1, n2, n3, cont), sums, strict=True)}

    bigrams = docs.mapInArrow(_counted(HELD, "m", lambda bodies: _pair_keys(model, bodies)), "m long, n long")
    stats = by_bucket(dealt(bigrams, "m"), "id long, n1 long, n2 long, n3 long, cont long", lambda c: bucket_of(c["m"], bits), write_pairs)
    per_word = stats.groupBy("id").agg(*[F.sum(c).alias(c) for c in STATS])
    low = (1 << (32 - bits)) - 1

    def write_stats(bucket: int, c: dict) -> dict:
        if bucket not in sizes:
            return {"bucket": c["id"], "what": np.column_stack([c[k] for k in STATS]).tolist()}
        for k in STATS:
            dense = np.zeros(sizes[bucket], np.uint32)
            dense[c["id"] & low] = c[k]
            write_array(folder, f"{k}_{bucket}", dense)
        cont = c["cont"]
        return {"bucket": [bucket], "what": [[int((cont == k).sum()) for k in (1, 2, 3, 4)] + [int((cont >= 3).sum()), int(cont.sum())]]}

    # negative ids, and the id before the first token, share a bucket of their own that writes no files
    slot = F.when((F.col("id") < 0) | (F.col("id") == START), F.lit(-1)).otherwise(F.shiftright("id", 32 - bits)).alias("slot")
    placed = per_word.select(slot, "*").repartition(parts, "slot").sortWithinPartitions("slot", "id")
    told = {r["bucket"]: r["what"] for r in by_bucket(placed, "bucket long, what array<long>", lambda c: c["slot"], write_stats).collect()}  # a row per bucket
    model.filled_pairs = frozenset(-2 - b for b in told if b < -1)
    model.discounts = discounts(*told[-1])
    model.start = tuple(told[START][:3])
    c1, c2, c3, c4, more, model.continuations = (sum(told[b][i] for b in sizes) for i in range(6))
    model.low_discounts = discounts(c1, c2, c3, c4)
    model.low_backoff = sum(d * n for d, n in zip(model.low_discounts, (c1, c2, more), strict=True)) / model.continuations
    end = model.word_ids(np.array([END]))
    model.documents = int(model.word_values(end, "c", np.int64)[0])
    return model


def score_texts(model: Model, bodies: pa.Array) -> dict[str, np.ndarray]:
    """Values of each text. Single words are looked up once per slice, bigrams in the order of their keys."""
    hashes, starts = with_ends(bodies)
    distinct, at = np.unique(hashes, return_inverse=True)
    ids = model.word_ids(distinct)
    count = model.word_values(ids, "c", np.int64)
    n1, n2, n3, cont = (model.word_values(ids, f"{k}_", np.uint32).astype(np.float64) for k in STATS)
    low = np.maximum(cont - discount(cont, model.low_discounts), 0) / max(model.continuations, 1) + model.low_backoff / (model.distinct + 1)
    backoff = (model.discounts[0] * n1 + model.discounts[1] * n2 + model.discounts[2] * n3) / np.maximum(count, 1)
    base = np.log10((count + 1) / (model.tokens + model.distinct + 1))

    total, weight = np.roll(count[at], 1).astype(np.float64), np.roll(backoff[at], 1)
    total[starts] = model.documents
    weight[starts] = sum(d * n for d, n in zip(model.discounts, model.start, strict=True)) / max(model.documents, 1)
    keys, back = np.unique(mix(pairs(ids[at], starts)), return_inverse=True)
    seen = model.pair_counts(keys)[back].astype(np.float64)
    high = np.maximum(seen - discount(seen, model.discounts), 0) / np.maximum(total, 1) + weight * low[at]
    logs = np.log10(np.where(total > 0, high, low[at]))
    return {
        "n_tokens": np.diff([*starts, len(at)]), "n_known": np.add.reduceat((count > 0).astype(np.int64)[at], starts),
        "base_score": np.add.reduceat(base[at], starts), "score": np.add.reduceat(logs, starts),
    }


def discount(counts: np.ndarray, by_count: tuple) -> np.ndarray:
    return np.array([0.0, *by_count])[np.minimum(counts, 3).astype(np.int64)]


_models: dict[str, Model] = {}


def opened(model: Model) -> Model:
    """The model whose maps this worker keeps, for the last few models."""
    if model.folder not in _models:
        while len(_models) >= 4:
            del _models[next(iter(_models))]
        _models[model.folder] = model
    return _models[model.folder]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``score`` is the model's log10 probability of the text and its end; its perplexity is 10 ** (-score / n_tokens). ``base_score`` is that of
    the add-one unigram model of the same counts. A null text is an empty one: its end is its only token. A
    model of no rows gives each token the probability 1 / (0 + 1). Rows are answered each.
    """

    def make():
        mapped = opened(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = score_texts(mapped, batch.column(1))
            n = pa.array(np.full(batch.num_rows, model.tokens, np.int64))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found["n_tokens"]), pa.array(found["n_known"]), n, pa.array(found["base_score"]), pa.array(found["score"])], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return run

    kind = dict(docs.dtypes)["doc_id"]
    return map_slices(documents(docs), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double", make, rows=4096, most_bytes=1 << 22)
