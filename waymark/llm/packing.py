"""Best-fit packing of tokenised documents into sequences under token, document and attention-cost capacities."""

from __future__ import annotations

import os
import string
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.text import documents, map_slices
from waymark.session import cut_and_measure

CAPACITY, END_ID = 2048, 0
#: Of tokens, documents and attention cost in the choice of a bin. Tokens lead; of bins that they fill alike, the one with more documents and cost left
#: over is the worse fit. The two smaller capacities are the most that 2048 tokens can need, so they never cost a sequence.
WEIGHTS = (1.0, 0.25, 0.25)
BLOCK_PIECES = 8_192  # pieces that one task packs together
CACHE = 800_000  # words whose ids a worker remembers: about 150 MB

PIECES = "piece int, start long, length long, ids_crc32 long, task int, row long"

#: Letters up to U+00FF, whose lower case is that of the tokenizer, and ASCII punctuation behind a word.
_LETTERS = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"
_BEFORE_MARKS = r"^(?s:.*)[^!-/:-@\[-`{-~]"
_JOINED = 500  # words encoded as one text


class _Encoder:
    """Token ids of the words of texts, remembered for a bounded number of them.

    Ids lie one after the other in ``ids``, those of slot i from ``starts[i]`` to ``starts[i + 1]``; slot 0 is empty.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)  # ids that end a word
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.starts, self.ids = np.zeros(2, np.int64), np.empty(0, np.uint32)

    def _append(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.starts) - 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32, copy=False)])
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def _encode_words(self, words: list[str]) -> None:
        """Words of letters: many are encoded as one text, in which each ends with an id that closes it."""
        sure, ids, sizes, rest = [], [], [], []
        groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        for group in groups:
            of_group = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[of_group]) + 1
            if len(ends) == len(group) and ends[-1] == len(of_group):
                sure += group
                ids.append(of_group)
                sizes.append(np.diff(ends, prepend=0))
            else:
                rest += group
        if sure:
            self._append(sure, np.concatenate(ids), np.concatenate(sizes))
        if rest:
            self._encode_parts(rest)

    def _encode_parts(self, parts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        self._append(parts, np.array(list(chain.from_iterable(found)), np.uint32), np.array([len(x) for x in found], np.int64))

    def _slots(self, keys: list[str], plain: np.ndarray) -> np.ndarray:
        slots = list(map(self.known.get, keys))
        if None in slots:
            new = [i for i, slot in enumerate(slots) if slot is None]
            if len(self.known) > CACHE:  # begin anew
                self._clear()
                new = range(len(keys))
            words, parts = [keys[i] for i in new if plain[i]], [keys[i] for i in new if not plain[i] and keys[i]]
            if words:
                self._encode_words(words)
            if parts:
                self._encode_parts(parts)
            for i in new:
                slots[i] = self.known[keys[i]]
        return np.array(slots, np.int64)

    def encode(self, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's end."""
        lists = pc.ascii_split_whitespace(pc.fill_null(bodies, b"").cast(pa.string()))
        places = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        parts = coded.dictionary
        word = pc.utf8_rtrim(parts, characters=string.punctuation)
        plain = pc.match_substring_regex(word, _LETTERS)
        mark = pc.if_else(plain, pc.replace_substring_regex(parts, _BEFORE_MARKS, ""), "")
        # a key is a word of letters in lower case, a run of marks, or any other part as it is
        key = pc.if_else(plain, pc.utf8_lower(word), parts)
        both = pa.concat_arrays([key, mark]).dictionary_encode()
        n, codes = len(parts), both.indices.to_numpy()
        of_key = np.zeros(len(both.dictionary), bool)
        of_key[codes[:n][plain.to_numpy(zero_copy_only=False)]] = True
        slots = self._slots(both.dictionary.to_pylist(), of_key)[codes]
        ids, sizes = _take(self.starts, self.ids, np.column_stack([slots[:n], slots[n:]]).ravel())
        starts = np.concatenate([[0], np.cumsum(sizes)])[::2]
        ids, sizes = _take(starts, ids, coded.indices.to_numpy())
        return ids, np.concatenate([[0], np.cumsum(sizes)])[places[1:]]


def _take(starts: np.ndarray, ids: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the slots one after the other, and how many each has."""
    store = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(ids))
    return store.take(pa.array(slots)).flatten().to_numpy(zero_copy_only=False), np.diff(starts)[slots]


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def encode(path: str, bodies: list[bytes | None] | pa.Array) -> list[np.ndarray]:
    """Token ids of each text as unsigned 32-bit numbers.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its blank-separated parts in turn.
    The parts of a slice are dictionary-encoded, its distinct ones cut into a lower-case word and the marks behind it where their ids are
    surely those of the part, the distinct words looked up or encoded once, and the ids of all parts taken at once.
    """
    ids, ends = _encoder(path).encode(bodies if isinstance(bodies, pa.Array) else pa.array(bodies, pa.binary()))
    return np.split(ids, ends[:-1]) if len(ends) else []


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: its ids and a closing ``end_id``, cut every ``capacity`` ids where it is longer.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit numbers; ``with_ids`` adds them as an array. (task, row)
    number the pieces. A null or empty text is its closing id alone. Repeated rows are answered each, as are null ids.
    """
    kind = dict(docs.dtypes)["doc_id"]
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "row"] + ["ids"] * with_ids

    def make():
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0

        def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal n
            at, rows, ids = [], [], []
            for i, found in enumerate(encode(tokenizer, batch.column(1))):
                last = len(found) // capacity  # the closing id is in this piece
                for piece in range(last + 1):
                    start = piece * capacity
                    part = found[start : start + capacity]
                    check = zlib.crc32(part)
                    at.append(i)
                    rows.append((piece, start, len(part) + (piece == last), zlib.crc32(end, check) if piece == last else check))
                    if with_ids:
                        ids.append([*part.tolist(), end_id] if piece == last else part.tolist())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            columns += [pa.array(np.full(len(at), task, np.int32)), pa.array(np.arange(n, n + len(at)))]
            n += len(at)
            columns += [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names)

        return pieces

    return map_slices(documents(docs), f"doc_id {kind}, {PIECES}" + ", ids array<int>" * with_ids, make, rows=8192, most_bytes=1 << 23)


def best_fit(needs: np.ndarray, capacities: np.ndarray, weights: np.ndarray, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each item; ``needs`` has a row of tokens, documents and cost per item.

    Items go largest first into the open bin that holds them in every dimension and has the smallest weighted norm of what is
    left afterwards (``norm``), or the largest weighted dot product of the item with what the bin holds (``dot``); else into a new bin.
    Needs and capacities are compared exactly, as integers.
    """
    n = len(needs)
    scale = weights / np.maximum(capacities, 1).astype(float)
    left = np.empty_like(needs)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    least = needs.min(axis=0) if n else capacities
    ids = np.empty(n, np.int64)  # of the open bins
    open_, made = 0, 0
    for i in np.argsort(-needs[:, 0], kind="stable"):
        need = needs[i]
        rest = left[:open_] - need
        fits = np.flatnonzero((rest >= 0).all(axis=1))
        if len(fits):
            after = rest[fits]
            if by == "norm":
                best = fits[np.argmin(((after * scale) ** 2).sum(axis=1))]
            else:
                best = fits[np.argmax((((capacities - left[fits]) * scale) * (need * scale)).sum(axis=1))]
        else:
            best = open_
            left[best] = capacities
            ids[best] = made
            open_, made = open_ + 1, made + 1
        bins[i], offsets[i] = ids[best], capacities[0] - left[best, 0]
        left[best] -= need
        if (left[best] < least).any():  # nothing fits here any more
            open_ -= 1
            left[best], ids[best] = left[open_], ids[open_]
    return bins, offsets


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, max_documents: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS,
    by: str = "norm", block: int = BLOCK_PIECES,
) -> DataFrame:
    """The pieces with sequence_id and offset.

    A sequence holds at most ``capacity`` tokens, ``max_documents`` pieces and ``max_cost`` attention cost (the sum of squared
    lengths); without the latter two they are ``capacity`` and its square, which tokens keep. ``weights`` are those of the three residuals in the choice of
    a bin, each as a share of its capacity. A piece that fills a sequence alone is placed at once; the others are dealt at random into blocks of about ``block`` pieces,
    so no task gets more, and each block is packed for itself: at most one badly filled sequence per block more than
    packing them all together. A piece over any capacity by itself gets a sequence of its own.
    """
    capacities = np.array([capacity, max_documents or capacity, max_cost or capacity * capacity], np.int64)
    alone = (F.col("length") >= capacity) | (F.col("length") * F.col("length") >= int(capacities[2])) | F.lit(int(capacities[1]) <= 1)
    table, seen = cut_and_measure(pieces.withColumn("_alone", alone), n=F.count_if(~alone))
    blocks = max(1, -(-seen["n"] // block))
    scale = np.array(weights, float)
    whole = table.where("_alone").withColumns({"sequence_id": -1 - (F.shiftleft(F.col("task").cast("long"), 40) + F.col("row")), "offset": F.lit(0).cast("long")})
    rest = table.where("not _alone").withColumn("_block", F.pmod(F.xxhash64("task", "row"), F.lit(blocks)))
    kinds = dict(rest.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("task", "row", "_block")) + ", sequence_id long, offset long"

    def place(group: pa.Table) -> pa.Table:
        order = np.lexsort((group["row"].to_numpy(), group["task"].to_numpy()))
        group = group.take(pa.array(order))
        length = group["length"].to_numpy().astype(np.int64)
        bins, offsets = best_fit(np.column_stack([length, np.ones_like(length), length * length]), capacities, scale, by)
        number = group["_block"].to_numpy().astype(np.int64) * 2**32 + bins
        return pa.table([group["task"], group["row"], group["_block"], pa.array(number), pa.array(offsets)], ["task", "row", "_block", "sequence_id", "offset"])

    placed = rest.select("task", "row", "length", "_block").groupBy("_block").applyInArrow(place, schema).drop("_block")
    joined = rest.drop("_block").join(placed, ["task", "row"])
    return whole.drop("_alone").unionByName(joined.drop("_alone"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed pieces with ids; a sequence is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
