"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Vectors and the finished graph are arrays in the shared folder, mapped into memory by the workers, so that the joins
carry ids and scores only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.arrays import by_bucket, map_array, new_folder, write_array
from waymark.session import cut, cut_and_measure

NEIGHBOURS = 24  # per vector in the graph, and so many more that have it as a neighbour, in each round
OFFERS = 5  # best new pairs that a neighbourhood offers to each of its members in a round
ROUNDS, FEW = 8, 0.02  # rounds at most; they end when fewer than this share of the links changed
BEAM = 256  # nodes that a query keeps
ENTRIES = 64  # nodes where every query starts
FILE_ROWS = 65_536  # vectors in a file
GROUPINGS, GROUP = 4, 8  # random groupings, and vectors in a group, that start out as each other's neighbours


@dataclass
class Vectors:
    """Distinct vectors by id; an id is the number of a file and the row in it."""

    folder: str
    kind: str
    dim: int
    sizes: dict[int, int] = field(default_factory=dict)  # rows by file
    longest: float = 0.0  # largest norm
    far_out: tuple = ()  # ids of the longest vectors, where many large inner products are found
    _maps: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_maps": {}}

    def _file(self, name: str, kind, width: int) -> np.ndarray:
        if name not in self._maps:
            self._maps[name] = map_array(self.folder, name, kind).reshape(-1, width)
        return self._maps[name]

    def _rows(self, ids: np.ndarray, prefix: str, kind, width: int) -> np.ndarray:
        out = np.empty((len(ids), width), kind)
        files = ids >> 32
        for file in np.unique(files).tolist():
            at = np.flatnonzero(files == file)
            out[at] = self._file(f"{prefix}{file}", kind, width)[ids[at] & 0xFFFFFFFF]
        return out

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return self._rows(ids, "x", self.kind, self.dim)

    def neighbours(self, ids: np.ndarray) -> np.ndarray:
        """Rows of neighbour ids, filled up with -1."""
        return self._rows(ids, "g", np.int64, NEIGHBOURS)

    def entries(self) -> np.ndarray:
        """Ids spread over the files: rows are in the order of a hash, so the first ones are a random choice."""
        each = -(-ENTRIES // max(len(self.sizes), 1))
        spread = [(file << 32) | row for file, n in sorted(self.sizes.items()) for row in range(min(each, n))][: max(ENTRIES, each)]
        return np.array([*spread, *self.far_out], np.int64)

    def closeness(self, x: np.ndarray) -> np.ndarray:
        """Inner products of vectors lengthened by one coordinate to a common norm: the largest one is then the nearest."""
        rest = np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))
        return (x @ x.T + np.outer(rest, rest)).astype(np.float32)


def usable(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, embedding) without null ids, and vectors that are null, empty, zero, or hold null or non-finite components."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_column).alias("vec_id"), c.alias("embedding")).where(F.col("vec_id").isNotNull() & c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0))


def store(rows: DataFrame, keep: int) -> tuple[Vectors, DataFrame]:
    """Write the distinct vectors; (node, vec_ids, code) tells the rows of each: the ``keep`` smallest ids, enough for any answer
    of ``keep`` rows. ``code`` is a hash of the vector.

    Vectors of another length than the most frequent one have no inner product with it and take no part.
    """
    spark = rows.sparkSession
    lengths = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    kind = "float64" if "double" in dict(rows.dtypes)["embedding"] else "float32"
    out = Vectors(new_folder(spark), kind, lengths[0]["dim"] if lengths else 1)
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    ranked = rows.where(F.size("embedding") == out.dim).distinct().withColumn("_rank", first).where(F.col("_rank") <= keep)
    classes = ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids"))
    order = F.xxhash64(F.col("vec_ids")[0])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    table, seen = cut_and_measure(classes.select("embedding", "vec_ids", order.alias("h"), norm.alias("norm")), n=F.count(F.lit(1)), longest=F.max(norm))
    out.longest = seen["longest"] or 0.0
    files = max(1, -(-seen["n"] // FILE_ROWS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = table.select(F.pmod("h", F.lit(files)).alias("file"), "h", F.col("vec_ids")[0].alias("rep"), "embedding").repartition(parts, "file").sortWithinPartitions("file", "h", "rep")

    def write(file: int, c: dict) -> dict:
        write_array(out.folder, f"x{file}", np.stack(c["embedding"]).astype(kind))
        return {"node": (file << 32) + np.arange(len(c["rep"])), "rep": c["rep"]}

    ids = cut(by_bucket(placed, "node long, rep long", lambda c: c["file"], write))
    out.sizes = {r["file"]: r["n"] for r in ids.groupBy(F.shiftright("node", 32).alias("file")).agg(F.count("*").alias("n")).collect()}  # a row per file
    named = ids.join(table.select(F.col("vec_ids")[0].alias("rep"), "vec_ids", F.xxhash64("embedding").alias("code")), "rep").select("node", "vec_ids", "code")
    named = cut(named)
    longest = table.orderBy(F.desc("norm"), "h").limit(ENTRIES).select(F.col("vec_ids")[0].alias("rep"))
    out.far_out = tuple(sorted(r["node"] for r in named.join(longest, F.col("vec_ids")[0] == F.col("rep")).select("node").collect()))  # ENTRIES rows
    return out, named


def _grouped(df: DataFrame, key: str, schema: str, function) -> DataFrame:
    """Call ``function(columns of one key's rows)`` for each key, in partitions sorted by the key."""
    names = df.columns
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def whole(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.diff(columns[at])) + 1
            found = [function([c[s:e] for c in columns]) for s, e in zip([0, *edges], [*edges, len(columns[at])], strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], [c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            cut_at = int(np.searchsorted(columns[at], columns[at][-1])) if len(columns[at]) else 0
            if cut_at:
                yield from whole([c[:cut_at] for c in columns])
            held = [c[cut_at:] for c in columns]
        if held and len(held[at]):
            yield from whole(held)

    return df.repartition(parts, key).sortWithinPartitions(key).mapInArrow(run, schema)


def _best(edges: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= NEIGHBOURS).drop("_rank")


_EDGES = "u long, v long, s float"


def descend(vectors: Vectors, nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(u, v, s): the neighbours of each node, by NN-descent.

    All start with neighbours from a few random groups. In each round every node's neighbours, and as many nodes that have it as a
    neighbour, are compared with each other where at least one of the two links is new; each is offered its best finds, where
    they are nearer than its furthest neighbour. All nodes take part; a popular node meets a random choice of those that point to it.
    """
    n = sum(vectors.sizes.values())
    seeds = F.explode(F.array(*map(F.lit, range(GROUPINGS)))).alias("seed")
    start = nodes.select("node", seeds).select("node", F.xxhash64(F.pmod(F.xxhash64("node", "seed"), F.lit(max(1, n // GROUP))), "seed").alias("g"))

    def meet(columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        ids = columns[0]
        close = vectors.closeness(vectors.vectors(ids))
        u, v = np.nonzero(~np.eye(len(ids), dtype=bool))
        return ids[u], ids[v], close[u, v]

    edges = cut(_best(_grouped(start, "g", _EDGES, meet).distinct()).withColumn("new", F.lit(True)))

    def offer(columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        _, members, furthest, new = columns
        ids, at = np.unique(members, return_index=True)
        new = np.logical_or.reduceat(new[np.argsort(members, kind="stable")], np.flatnonzero(np.diff(members[np.argsort(members, kind="stable")], prepend=-1)))
        close = vectors.closeness(vectors.vectors(ids))
        close[~(new[:, None] | new[None, :])] = -np.inf
        np.fill_diagonal(close, -np.inf)
        close[close <= furthest[at][:, None]] = -np.inf
        few = min(OFFERS, len(ids))
        best = np.argpartition(-close, few - 1, axis=1)[:, :few]
        u, place = np.nonzero(np.take_along_axis(close, best, 1) > -np.inf)
        v = best[u, place]
        return ids[u], ids[v], close[u, v]

    for turn in range(rounds):
        furthest = edges.groupBy("u").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("s")).otherwise(F.lit(float("-inf")).cast("float")).alias("furthest"))
        pick = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", "v", F.lit(turn))))
        back = edges.withColumn("_pick", pick).where(F.col("_pick") <= NEIGHBOURS).select(F.col("v").alias("c"), F.col("u").alias("m"), "new")
        both = edges.select(F.col("u").alias("c"), F.col("v").alias("m"), "new").unionByName(back)
        around = both.join(furthest.select(F.col("u").alias("m"), "furthest"), "m").select("c", "m", "furthest", "new")
        offers = _grouped(around, "c", _EDGES, offer).withColumn("new", F.lit(True))
        merged = edges.withColumn("new", F.lit(False)).unionByName(offers).groupBy("u", "v").agg(F.max("s").alias("s"), F.bool_and("new").alias("new"))
        edges, seen = cut_and_measure(_best(merged), changed=F.count_if("new"))
        if seen["changed"] < FEW * n * NEIGHBOURS:
            break
    return edges.select("u", "v", "s")


def write_graph(vectors: Vectors, edges: DataFrame, nodes: DataFrame) -> None:
    """The neighbour lists as arrays beside the vectors."""
    lists = edges.groupBy("u").agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "v")), asc=False), lambda x: x["v"]).alias("vs"))
    every = nodes.select("node").join(lists, F.col("node") == F.col("u"), "left").select(F.shiftright("node", 32).alias("file"), "node", F.coalesce("vs", F.array().cast("array<bigint>")).alias("vs"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def write(file: int, c: dict) -> dict:
        out = np.full((len(c["vs"]), NEIGHBOURS), -1, np.int64)
        for row, found in enumerate(c["vs"]):
            out[row, : len(found)] = found
        write_array(vectors.folder, f"g{file}", out)
        return {"file": [file]}

    by_bucket(every.repartition(parts, "file").sortWithinPartitions("file", "node"), "file long", lambda c: c["file"], write).collect()  # a row per file


def greedy(vectors: Vectors, query: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products), best first, of the best ``beam`` nodes that a greedy walk from ``start`` finds.

    Each step opens the neighbours of all kept nodes that are not open yet; the walk ends when all kept nodes are.
    """
    query = query.astype(np.float64)
    ids = np.unique(start)
    scores = vectors.vectors(ids).astype(np.float64) @ query
    seen, is_open = ids, np.zeros(len(ids), bool)
    while True:
        keep = np.lexsort((ids, -scores))[:beam]
        ids, scores, is_open = ids[keep], scores[keep], is_open[keep]
        closed = ids[~is_open]
        if not len(closed):
            return ids, scores
        is_open[:] = True
        fresh = np.setdiff1d(vectors.neighbours(closed), seen)
        fresh = fresh[fresh >= 0]
        seen = np.union1d(seen, fresh)
        ids = np.concatenate([ids, fresh])
        scores = np.concatenate([scores, vectors.vectors(fresh).astype(np.float64) @ query])
        is_open = np.concatenate([is_open, np.zeros(len(fresh), bool)])


_opened: dict[str, Vectors] = {}


def _mapped(vectors: Vectors) -> Vectors:
    """The index whose maps this worker keeps; those of an earlier one go."""
    if vectors.folder not in _opened:
        _opened.clear()
        _opened[vectors.folder] = vectors
    return _opened[vectors.folder]


def search(vectors: Vectors, nodes: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, exclude: Column | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest found, by inner product in double precision.

    ``queries``: (query_id, embedding, node), where ``node`` is a place to start besides the common entries, or null. Ties go to the smaller
    vec_id. ``exclude`` names rows, by query_id and vec_id, that are no candidates.
    """
    dim = vectors.dim

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _mapped(vectors)
        common = opened.entries()
        for batch in batches:
            given = batch.to_pydict()
            asked, found, scores = [], [], []
            for query_id, vector, node in zip(given["query_id"], given["embedding"], given["node"], strict=True):
                if len(vector) != dim or not len(common):
                    continue
                ids, s = greedy(opened, np.array(vector), common if node is None else np.append(common, node), max(beam, 2 * k))
                # more nodes than k + 1 only where they tie with the last one
                last = s[min(k, len(s) - 1)]
                n = int((s >= last).sum())
                asked.append(np.full(n, query_id, np.int64))
                found.append(ids[:n])
                scores.append(s[:n])
            if asked:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (asked, found, scores)], ["query_id", "node", "score"])

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = queries.select("query_id", "embedding", "node").repartition(parts, "query_id")
    near = spread.mapInArrow(walk, "query_id long, node long, score double").join(nodes, "node").select("query_id", F.explode("vec_ids").alias("vec_id"), "score")
    if exclude is not None:
        near = near.where(~exclude)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_rows(embeddings: DataFrame, every: int = 20, k: int = 20, beam: int = BEAM) -> DataFrame:
    """Each ``every``-th row's ``k`` nearest other rows, from an index of all rows.

    Vectors that are null, empty, zero, hold null or non-finite components, or have no id take no part, nor do those of another length than
    most. Equal vectors are one node; repeated rows are one row. An empty table, or one of a single row, gives no rows.
    """
    rows = usable(embeddings).withColumn("vec_id", F.col("vec_id").cast("long"))
    vectors, nodes = store(rows, k + 1)
    write_graph(vectors, descend(vectors, nodes), nodes)
    queries = rows.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("query_id"), "embedding")
    own = nodes.groupBy("code").agg(F.min("node").alias("node"))
    started = queries.withColumn("code", F.xxhash64("embedding")).join(own, "code", "left")
    return search(vectors, nodes, started, k, beam, exclude=F.col("query_id") == F.col("vec_id"))
