"""Exact Jaccard join of shingle sets by partitioning the universe of shingles (Deng et al., 2015).

Two sets that link differ in at most ``k`` shingles. Hash the shingles into segments: if the allowances of the segments, plus one each,
sum to more than ``k``, some segment differs by no more than its allowance. An allowance of 0 is met by equal subsets of the
segment, one of 1 also by subsets of which one lacks a single shingle (one-deletion neighbourhood). So linked sets share a
signature, a hash of a segment's subset or of the subset without one shingle. Candidates are verified on the whole sets.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.arrays import by_bucket, map_array, new_folder, write_array
from waymark.llm.hashing import spread_bits, token_hashes
from waymark.llm.text import documents, slices
from waymark.operators.components import components
from waymark.session import cut, cut_and_measure

RATIO = 1.5  # of the sizes at the ends of a band
OVERLAP = 0.05  # share of the shingles that two unrelated documents have in common, for costs only, where no sample tells
SAMPLE_SETS = 1_000  # sets whose chance meetings are counted to choose the segments of a band; it steers costs, not results
MOST = 1_000  # a key of more than one in so many rows is joined by broadcast; there are at most so many of them
HELD = 2_000_000  # signatures held in a task before equal ones are combined and passed on
SEEDS = 6  # layouts to fall back on when segments of a document are empty
SEEN = 500_000  # sets that a task remembers, to pass the signatures of copies once
HELD_BYTES = 1 << 26
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(bodies: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, a text of none has none."""
    hashes, counts = token_hashes(bodies)
    ends = np.cumsum(counts)
    rolled = hashes[: max(len(hashes) - words + 1, 0)].copy()
    for j in range(1, words):
        rolled = rolled * _STEP + hashes[j : len(rolled) + j]
    rolled = spread_bits(rolled)
    sets = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= words:
            sets.append(np.unique(rolled[end - n : end - words + 1]))
        elif n:
            whole = reduce(lambda a, b: a * int(_STEP) + b & 2**64 - 1, hashes[end - n : end].tolist())
            sets.append(spread_bits(np.array([whole], np.uint64) + np.array([n], np.uint64) * _ODD))
        else:
            sets.append(hashes[:0])
    return sets


class Layouts:
    """Segments and their allowances for each band of set sizes; a pair meets in the band of its larger set.

    ``histogram`` holds about how many documents each band has, and ``met`` the share of pairs of a band's unlinked sets that share a signature, by
    (band, segments of allowance 1), for the costs. Band b covers sizes low[b] to high[b].
    """

    def __init__(self, percent: int, histogram: dict[int, int] | None = None, overlap: float = OVERLAP, met: dict[tuple[int, int], float] | None = None):
        self.percent, self.histogram, self.overlap, self.met = percent, histogram or {}, overlap, met or {}
        self.low, self.high = [1], [1]
        self._allocated: dict[int, tuple[int, int, int] | None] = {}
        self._keys: dict[tuple[int, int], np.ndarray] = {}

    def band(self, size: int) -> int:
        while self.high[-1] < size:
            self._next_band()
        return bisect_left(self.high, size)

    def _next_band(self) -> None:
        self.low.append(self.high[-1] + 1)
        self.high.append(max(self.low[-1], int(self.low[-1] * RATIO)))

    def bands(self, size: int) -> Iterator[int]:
        """The own band, and those of the larger sets that can link with this one."""
        for b in range(self.band(size), self.band(size * 100 // self.percent) + 1):
            if self.low[b] * self.percent <= size * 100:
                yield b

    def allocation(self, b: int) -> tuple[int, int, int] | None:
        """(segments, those of them with allowance 1, slack) at the least cost; None: only equal sets link.

        The cost is the number of signatures plus the candidates expected of unrelated documents. Segments that are empty
        in both sets agree without telling anything; ``slack`` more segments than needed let as many be so.
        """
        if b not in self._allocated:
            choices = self.choices(b)
            self._allocated[b] = min((self._cost(b, d) for d in choices), key=lambda x: x[0])[1] if choices else None
        return self._allocated[b]

    def differ(self, b: int) -> int:
        """Most shingles by which two linked sets of the band differ."""
        while len(self.high) <= b:
            self._next_band()
        return (100 - self.percent) * 2 * self.high[b] // (100 + self.percent)

    def choices(self, b: int) -> list[int]:
        """Numbers of segments with allowance 1 that are weighed against each other; none where only equal sets link."""
        differ = self.differ(b)
        return sorted({0, (differ + 1) // 4, (differ + 1) // 2}) if differ else []

    def _cost(self, b: int, ones: int) -> tuple[float, tuple[int, int, int]]:
        segments = self.differ(b) + 1 - ones
        n, size = self.histogram.get(b, 0), (self.low[b] + self.high[b]) / 2
        each, slack = size / segments, 0
        signatures = n * (segments - ones + ones * (each + 1))
        chance = (segments - ones) * self.overlap**each + ones * (each + 1) * self.overlap ** max(each - 1, 0)
        chance = self.met.get((b, ones), chance)
        for _ in range(3):  # more segments are emptier; the smallest partners from the band below have the most idle ones
            fewest = self.low[b] * self.percent / 100 / (segments + slack)
            idle = math.exp(-fewest) * (segments + slack - ones + 2 * ones * (1 + fewest))
            slack = math.ceil(idle + math.sqrt(idle)) if idle > 0.05 else 0
        return signatures + n * n / 2 * chance + n * slack, (segments + slack, ones, slack)

    def keys(self, b: int, seed: int, segments: int) -> np.ndarray:
        if (b, seed) not in self._keys:
            self._keys[b, seed] = spread_bits(np.arange(segments, dtype=np.uint64) + np.array([(b << 48) + (seed << 40) + 1], np.uint64) * _ODD)
        return self._keys[b, seed]

    def choose(self, b: int, ones: int) -> "Layouts":
        """These layouts with a given number of segments of allowance 1 in a band."""
        other = Layouts(self.percent)
        other.differ(b)
        other._allocated[b] = self._cost(b, ones)[1]
        return other

    def signatures(self, found: np.ndarray, values: np.ndarray, only: int | None = None) -> np.ndarray:
        """All signatures of a set, in every band where it can meet a partner, or in ``only`` one.

        An empty subset has no signature. A set with more idle segments than the slack allows is also laid out by another seed; so is
        every partner that shares those segments. After the last seed empty subsets have signatures too.
        """
        out = [values[:0]]
        for b in self.bands(len(found)) if only is None else [only]:
            allocated = self.allocation(b)
            if allocated is None:
                continue
            segments, ones, slack = allocated
            for seed in range(SEEDS):
                place = ((spread_bits(found + np.array([seed + 1], np.uint64) * _STEP) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
                counts = np.bincount(place, minlength=segments)
                sums = np.zeros(segments, np.uint64)
                np.add.at(sums, place, values)
                keys = self.keys(b, seed, segments)
                idle = (counts[ones:] == 0).sum() + 2 * (counts[:ones] <= 1).sum()
                last = idle > slack and seed == SEEDS - 1
                out.append((sums + keys)[(counts > 0) | last])
                if ones:
                    near = (place < ones) & ((counts[place] > 1) | last)
                    out.append((sums[place] - values + keys[place])[near])
                if idle <= slack:
                    break
        return np.unique(spread_bits(np.concatenate(out)))


def _values(found: np.ndarray) -> np.ndarray:
    return spread_bits(found ^ _ODD)


def _node(found: np.ndarray, values: np.ndarray) -> int:
    """A hash of the whole set: equal sets are one node."""
    return int(spread_bits(np.array([values.sum(dtype=np.uint64)]) + np.array([len(found)], np.uint64) * _STEP).view(np.int64)[0])


def _sketch(values: np.ndarray) -> np.ndarray:
    """512 parities: as many differ between two sets as shingles do, at most."""
    odd = np.bincount((values >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


class _Signed:
    """Nodes and signatures of the texts of a slice. Of copies in one task only the first has signatures."""

    def __init__(self, words: int, layouts: Layouts):
        self.words, self.layouts, self.seen = words, layouts, set()

    def __call__(self, bodies: pa.Array) -> Iterator[tuple[np.ndarray, int | None, np.ndarray, np.ndarray]]:
        for found in shingle_sets(bodies, self.words):
            values = _values(found)
            node = _node(found, values) if len(found) else None
            fresh = node is not None and node not in self.seen
            if fresh:
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen.add(node)
            yield found, node, values, (self.layouts.signatures(found, values) if fresh else values[:0]).view(np.int64)


def _histogram(docs: DataFrame, layouts: Layouts) -> dict[int, int]:
    """About how many documents a band has, from the texts' lengths; it steers costs, not results."""
    size = F.floor(F.log2(F.greatest(F.octet_length("body") / 6, F.lit(1.0)))).alias("size")
    found: dict[int, int] = {}
    for r in docs.groupBy(size).count().collect():  # at most 32 rows
        bands = range(layouts.band(2 ** (r["size"] or 0)), layouts.band(2 ** ((r["size"] or 0) + 1)))
        for b in bands:
            found[b] = found.get(b, 0) + r["count"] // len(bands)
    return found


def _chances(docs: DataFrame, words: int, layouts: Layouts) -> dict[tuple[int, int], float]:
    """(band, segments of allowance 1) -> share of the pairs of unlinked sets of that band that share a signature so laid out,
    counted on a sample of about ``SAMPLE_SETS`` documents. Pairs whose sketches allow a link do not count: they meet in any layout."""
    total = sum(layouts.histogram.values())
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "body"), F.lit(max(1, total // SAMPLE_SETS))) == 0)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others: dict[tuple[int, int], Layouts] = {}
        for batch in batches:
            for part in slices(batch, 64, 1 << 20):
                out = {"band": [], "ones": [], "n": [], "node": [], "sketch": [], "sigs": []}
                for found in shingle_sets(part.column(1), words):
                    b = layouts.band(len(found)) if len(found) else 0
                    values = _values(found)
                    for ones in layouts.choices(b) if len(found) else ():
                        other = others.setdefault((b, ones), layouts.choose(b, ones))
                        row = (b, ones, len(found), _node(found, values), _sketch(values), other.signatures(found, values, b).view(np.int64))
                        for c, value in zip(out.values(), row, strict=True):
                            c.append(value)
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    rows = cut(picked.mapInArrow(lay_out, "band int, ones int, n long, node long, sketch array<long>, sigs array<long>").dropDuplicates(["band", "ones", "node"]))
    sets = {r["band"]: r["sets"] for r in rows.where("ones = 0").groupBy("band").agg(F.count("*").alias("sets")).collect()}  # a row per band
    opened = rows.select("band", "ones", "n", "node", *[F.col("sketch")[i].alias(f"s{i}") for i in range(8)], F.explode("sigs").alias("sig"))
    side = lambda s: opened.select("band", "ones", "sig", F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", *(f"s{i}" for i in range(8)))])
    apart = side("a").join(side("b"), ["band", "ones", "sig"]).where((F.col("a") < F.col("b")) & ~_close(layouts.percent))
    met = {(r["band"], r["ones"]): r["pairs"] for r in apart.groupBy("band", "ones").agg(F.count("*").alias("pairs")).collect()}  # rows per band
    return {(b, ones): met.get((b, ones), 0) * 2 / (n * (n - 1)) for b, n in sets.items() if n > 1 for ones in layouts.choices(b) if (b, ones) in met or n >= 30}


class _Repeated:
    """The signatures that more than one set has: sorted arrays, mapped into memory."""

    def __init__(self, folder: str, bits: int, filled: frozenset):
        self.folder, self.bits, self.filled, self.maps = folder, bits, filled, {}

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        if not len(keys):
            return out
        order = np.argsort(keys)
        buckets = (keys[order] >> (64 - self.bits)) + (1 << (self.bits - 1))
        edges = np.flatnonzero(np.diff(buckets, prepend=-1))
        for start, end in zip(edges, [*edges[1:], len(order)], strict=True):
            bucket, rows = int(buckets[start]), order[start:end]
            if bucket in self.filled:
                if bucket not in self.maps:
                    self.maps[bucket] = map_array(self.folder, f"sig{bucket}", np.int64)
                there, wanted = self.maps[bucket], keys[rows]
                out[rows] = there[np.minimum(np.searchsorted(there, wanted), len(there) - 1)] == wanted
        return out


_TABLE = "doc_id {}, n long, node long, file string, at long, sketch array<long>, sigs array<long>"


def _candidates(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, str]:
    """A row per document with its set's size and node, and, where the set shares a signature with another, the place of
    the set in the shared folder, its sketch and those signatures."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    given = documents(docs)
    layouts = Layouts(percent)
    layouts.histogram = _histogram(given, layouts)
    layouts.met = _chances(given, words, layouts)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(max((4 * parts - 1).bit_length(), 5), 14)
    folder = new_folder(spark)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed, held, size = _Signed(words, layouts), [], 0

        def passed() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([found, found[n > 1]]))], ["sig"])  # twice is enough

        for batch in batches:
            for part in slices(batch, 1024, 1 << 21):
                held.append(np.concatenate([s for *_, s in signed(part.column(1))]))
                size += len(held[-1])
                if size > HELD:
                    size = 0
                    yield passed()
        if held:
            yield passed()

    dealt = given.mapInArrow(sign, "sig long").repartition(parts, F.shiftright("sig", 64 - bits)).sortWithinPartitions("sig")

    def write(bucket: int, c: dict) -> dict:
        found, n = np.unique(c["sig"], return_counts=True)
        write_array(folder, f"sig{bucket}", found[n > 1])
        return {"bucket": np.array([bucket] * bool((n > 1).any()), np.int64)}

    made = by_bucket(dealt, "bucket long", lambda c: (c["sig"] >> (64 - bits)) + (1 << (bits - 1)), write).collect()  # a row per bucket
    filled = frozenset(r["bucket"] for r in made)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed, known = _Signed(words, layouts), _Repeated(folder, bits, filled)
        held, size, name = [], 0, f"set-{uuid.uuid4().hex}"
        for batch in batches:
            for part in slices(batch, 1024, 1 << 21):
                rows = list(signed(part.column(1)))
                sigs = np.concatenate([s for *_, s in rows])
                shared = known(sigs)
                ends = np.cumsum([len(s) for *_, s in rows])
                out = {"n": [], "node": [], "file": [], "at": [], "sketch": [], "sigs": []}
                for (found, node, values, own), end in zip(rows, ends.tolist(), strict=True):
                    mine = own[shared[end - len(own) : end]]
                    out["n"].append(len(found))
                    out["node"].append(node)
                    out["file"].append(name if len(mine) else None)
                    out["at"].append(size if len(mine) else None)
                    out["sketch"].append(_sketch(values) if len(mine) else None)
                    out["sigs"].append(mine if len(mine) else None)
                    if len(mine):
                        held.append(found)
                        size += len(found)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]], ["doc_id", *out])
                if size * 8 > HELD_BYTES:
                    write_array(folder, name, np.concatenate(held))
                    held, size, name = [], 0, f"set-{uuid.uuid4().hex}"
        if held:
            write_array(folder, name, np.concatenate(held))

    return cut(given.mapInArrow(look, _TABLE.format(kind))), folder


def _verified(pairs: DataFrame, places: DataFrame, folder: str, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link, by the sizes of their whole sets' intersection and union."""
    side = lambda s: places.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "file", "at")])
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(_sizes_fit("n_a", "n_b", percent))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[str, np.ndarray] = {}

        def whole(file: str, at: int, n: int) -> np.ndarray:
            if file not in maps:
                if len(maps) >= 512:
                    maps.clear()
                maps[file] = map_array(folder, file, np.uint64)
            return maps[file][at : at + n]

        for batch in batches:
            c = batch.to_pydict()
            keep = []
            for n_a, file_a, at_a, n_b, file_b, at_b in zip(*(c[x] for x in ("n_a", "file_a", "at_a", "n_b", "file_b", "at_b")), strict=True):
                a, b = whole(file_a, at_a, n_a), whole(file_b, at_b, n_b)
                both = int((b[np.minimum(np.searchsorted(b, a), n_b - 1)] == a).sum())
                keep.append(100 * both >= percent * (n_a + n_b - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "n_a", "file_a", "at_a", "n_b", "file_b", "at_b").mapInArrow(verify, "a long, b long")


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _close(percent: int):
    """Whether the sketches allow the pair to link; never false for a pair that does."""
    odd = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(8)])
    return odd * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def _meetings(members: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that share a signature, are not of one label, and pass the bounds on sizes and sketches."""
    full = members.join(places.select("node", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(8)]), "node")
    side = lambda s: full.select("sig", F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("label", "n", *(f"s{i}" for i in range(8)))])
    both = side("a").join(side("b"), "sig").where((F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & _sizes_fit("n_a", "n_b", percent) & _close(percent))
    return both.select("a", "b").distinct()


def _opened(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, node) of sets that share signatures, and one place per node."""
    shared = table.where("file is not null")
    places = shared.groupBy("node").agg(F.min(F.struct("file", "at", "n", "sketch")).alias("x")).select("node", "x.*")
    return shared.select(F.explode("sigs").alias("sig"), "node"), places


def links(docs: DataFrame, words: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """All links between different sets as (a, b), a < b, and (doc_id, n, node): the set of each document.

    The output of groups of near copies is quadratic in their size; ``similar_groups`` needs no such output.
    """
    table, folder = _candidates(docs, words, percent)
    members, places = _opened(table)
    return _verified(_meetings(members.withColumn("label", F.col("node")), places, percent), places, folder, percent), table.select("doc_id", "n", "node")


def similar_groups(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents joined by links 100 * intersection >= percent * union of their shingle sets.

    component_id is the smallest doc_id reachable by links. A null, empty or blank text has no shingles and links with nothing: it is
    its own component. Documents with equal sets are one node. Rows with one doc_id are answered each; a null id takes
    part but names no component (null where no id is left).

    First the nodes of a signature are verified against its smallest and its largest node, which joins groups of near copies without
    making their pairs. Then all pairs that share a signature and are still apart are verified, unless their sizes or
    sketches rule a link out: no link between two components is left unseen.
    """
    table, folder = _candidates(docs, words, percent)
    members, places = _opened(table)
    ends = members.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    star = members.join(ends, "sig").select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b")))).alias("p"))
    edges = cut(_verified(star.select("p.*").where("a < b").distinct(), places, folder, percent))
    label = cut(components(edges))
    named = members.distinct().join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = named.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("sig")
    more, seen = cut_and_measure(_verified(_meetings(named.join(apart, "sig"), places, percent), places, folder, percent), n=F.count(F.lit(1)))
    if seen["n"]:
        label = components(edges.unionByName(more))
    # the smallest id of each node, then of each group of nodes, then back to the nodes and the documents
    nodes = table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_rows"))
    labelled = cut(nodes.join(label, "node", "left").withColumn("_label", F.coalesce("label", "node")).drop("label"))
    groups = labelled.groupBy("_label").agg(F.min("_least").alias("_first"), F.count("*").alias("_asks"))
    named = _told(labelled, groups, "_label", "_asks").select("node", F.col("_first").alias("component_id"), "_rows")
    answered = _told(table.where("node is not null").select("doc_id", F.col("n").alias("n_shingles"), "node"), named, "node", "_rows").select("doc_id", "n_shingles", "component_id")
    return answered.unionByName(table.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _told(rows: DataFrame, facts: DataFrame, key: str, asks: str) -> DataFrame:
    """Inner join of rows with one fact per key, whose column ``asks`` counts the key's rows. Keys of many rows, ``MOST`` at most, are
    broadcast, so their rows stay where they are."""
    facts, seen = cut_and_measure(facts, total=F.sum(asks))
    busy = F.col(asks) * MOST > (seen["total"] or 0)
    frequent = facts.where(busy).select(F.col(key).alias("_busy"))
    joined = rows.join(F.broadcast(frequent), F.col(key) == F.col("_busy"), "left")
    many = joined.where("_busy is not null").drop("_busy").join(F.broadcast(facts.where(busy)), key)
    return many.unionByName(joined.where("_busy is null").drop("_busy").join(facts.where(~busy), key))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of the smallest doc_id of each group; rows without shingles or an id stay."""
    groups = similar_groups(docs, words, percent)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
