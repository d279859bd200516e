"""Fixed schemas, snapshots, run results and bulk maintenance of the stored tables."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import geo, payload
from waymark.operators import grid, matching, ranks
from waymark.operators.lookups import ADDRESS
from waymark.session import cut, cut_and_measure, cut_large

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCHEMAS = {
    "locations": _schema(
        location_id=_L, lat=_D, lon=_D, street=_S, neighborhood=_S, development=_S, city=_S, postcode=_S, country=_S, created_at=_TS
    ),
    "clusters": _schema(
        cluster_id=_L, name=_S, centroid_lat=_D, centroid_lon=_D, checkpoint_lat=_D, checkpoint_lon=_D,
        checkpoint_description=_S, road_transition_type=_S, created_at=_TS,
    ),
    "presets": _schema(preset_id=_S, name=_S, created_at=_TS),
    "preset_locations": _schema(preset_id=_S, location_id=_L, is_warehouse=_B),
    "location_clusters": _schema(location_id=_L, cluster_id=_L),
    "warehouses": _schema(warehouse_id=_L, preset_id=_S, location_id=_L),
    "security_checkpoints": _schema(
        checkpoint_id=_L, cluster_id=_L, lat=_D, lon=_D, from_road_type=_S, to_road_type=_S, checkpoint_type=_S,
        priority=T.IntegerType(), confidence=_D, created_at=_TS,
    ),
    "route_cache": _schema(cache_key=_S, route_data=_S, created_at=_TS),
    "street_patterns": _schema(stem_pattern=_S, cluster_id=_L, created_at=_TS),
    "vrp_test_results": _schema(
        result_id=_L, snapshot_id=_S, preset_id=_S, algorithm=_S, num_vehicles=T.IntegerType(), test_type=_S,
        total_distance=_D, computation_ms=_D, payload=_S, created_at=_TS,
    ),
}
# Fixed values of new checkpoints.
NEW_FROM_TYPE, NEW_TO_TYPE, NEW_CONFIDENCE, MANUAL_CONFIDENCE = "unclassified", "residential", 0.7, 1.0
OPTIONAL_CHECKPOINT_COLUMNS = {"from_road_type": "string", "to_road_type": "string", "confidence": "double"}
PAYLOAD = "struct<total_distance:double,execution_time_ms:double,computation_time:double,test_info:struct<snapshot_id:string,preset_id:string,algorithm:string,test_type:string,num_vehicles:int>>"


def read_table(spark: SparkSession, root: str, name: str, snapshot: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A stored table with its fixed schema; columns that old files lack read as null."""
    schema = schema or SCHEMAS[name]
    if snapshot is None:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    stamped = T.StructType([*schema.fields, T.StructField("snapshot_id", _S)])
    return spark.read.schema(stamped).parquet(f"{root}/{name}").where(F.col("snapshot_id") == snapshot)


def write_snapshot(tables: dict[str, DataFrame], root: str, snapshot_id: str) -> None:
    """Copy all tables under one snapshot id, one folder per id."""
    for name, df in tables.items():
        df.withColumn("snapshot_id", F.lit(snapshot_id)).write.partitionBy("snapshot_id").mode("append").parquet(f"{root}/{name}")


def missing_tables(present: DataFrame, required: list[str]) -> DataFrame:
    """(snapshot_id, table_name) of the required tables that a snapshot lacks."""
    wanted = present.select("snapshot_id").distinct().withColumn("table_name", F.explode(F.array(*[F.lit(n) for n in required])))
    return wanted.join(present, ["snapshot_id", "table_name"], "left_anti")


def snapshot_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and snapshot, 0 where a snapshot lacks the table, newest snapshot first."""
    counts = [df.groupBy("snapshot_id").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    joined = reduce(DataFrame.unionByName, counts)
    wide = joined.groupBy("snapshot_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("table_name") == n, F.col("n"))), F.lit(0)).alias(n) for n in tables]
    )
    return wide.orderBy(F.desc("snapshot_id"))


def with_optional_columns(cp: DataFrame) -> DataFrame:
    """Checkpoints of an old snapshot with null in place of the columns it lacks."""
    absent = {c: F.lit(None).cast(t) for c, t in OPTIONAL_CHECKPOINT_COLUMNS.items() if c not in cp.columns}
    return cp.withColumns(absent) if absent else cp


# ---- run results -------------------------------------------------------------------------------------------------


def result_rows(runs: DataFrame) -> DataFrame:
    """Scalars pulled out of a run record next to the whole record as JSON."""
    info = F.col("test_info")
    return runs.select(
        "run_id",
        *[info[c].alias(c) for c in ("snapshot_id", "preset_id", "algorithm", "num_vehicles")],
        F.coalesce(info["test_type"], F.lit("static")).alias("test_type"),
        "total_distance",
        F.coalesce("execution_time_ms", "computation_time").alias("computation_ms"),
        F.to_json(F.struct("total_distance", "execution_time_ms", "computation_time", "test_info")).alias("payload"),
    )


def append_results(runs: DataFrame, path: str) -> None:
    result_rows(runs).write.mode("append").parquet(path)


def backfill_results(stored: DataFrame) -> DataFrame:
    """Stored runs with empty columns filled from the record; a broken record leaves them as they are."""
    info = F.from_json("payload", PAYLOAD)["test_info"]
    filled = stored.withColumn("_info", info)
    text = [F.coalesce(payload.blank_to_null(c), F.col("_info")[c]).alias(c) for c in ("algorithm", "test_type")]
    vehicles = F.coalesce(F.nullif("num_vehicles", F.lit(0)), F.col("_info")["num_vehicles"]).alias("num_vehicles")
    rest = [c for c in stored.columns if c not in ("algorithm", "test_type", "num_vehicles", "payload")]
    return filled.select(*rest, *text, vehicles)


# ---- presets and locations -----------------------------------------------------------------------------------------


def preset_key(name, created_at) -> Column:
    return F.md5(F.concat_ws("|", geo.col(name), geo.col(created_at).cast("string")))


def location_key(lat, lon) -> Column:
    """Id of a new location, made from its coordinate text: the same on every executor and run."""
    return F.xxhash64(geo.coord_key(lat, lon))


def ingest_presets(requests: DataFrame, stored: DataFrame | None = None, patterns: DataFrame | None = None, cl: DataFrame | None = None) -> dict[str, DataFrame]:
    """Presets, links, warehouses and locations of many save requests at once.

    ``requests``: name, created_at, is_warehouse, lat, lon and address columns, one row per point. A destination
    that coincides with its warehouse is skipped. With ``stored`` locations the points are found or inserted among them,
    in the order of the presets, warehouse first; ``locations`` is then the whole table after it, with ``change``. With
    ``patterns`` and clusters ``location_clusters`` has the cluster of each inserted destination.
    """
    order = F.struct("created_at", "name", ~F.col("is_warehouse"), "lat", "lon")
    keyed = requests.withColumn("preset_id", preset_key("name", "created_at")).withColumn("request_id", order)
    points = cut_large(keyed.select("preset_id", "name", "created_at", "is_warehouse", "lat", "lon"))  # read for depots, links and presets
    depot = points.where("is_warehouse").groupBy("preset_id").agg(F.min(F.struct("lat", "lon")).alias("w"))

    def without_copies(rows: DataFrame) -> DataFrame:
        on_depot = F.coalesce(geo.near_equal("lat", "lon", F.col("w.lat"), F.col("w.lon")), F.lit(False))
        return rows.join(depot.hint("merge"), "preset_id", "left").where(F.col("is_warehouse") | ~on_depot).drop("w")

    kept = without_copies(keyed)
    address = [c for c in ADDRESS if c in requests.columns]
    if stored is None:
        placed = without_copies(points).withColumn("location_id", location_key("lat", "lon"))
        locations = kept.withColumn("location_id", location_key("lat", "lon")).groupBy("location_id").agg(*[F.min(c).alias(c) for c in ("lat", "lon", *address)])
    else:
        kept = cut(kept)
        placed = kept.join(place_points(stored, kept).select("lat", "lon", "location_id", "is_new"), ["lat", "lon"])
        locations = upsert_locations(stored, kept)
    links = placed.groupBy("preset_id", "location_id").agg(F.max("is_warehouse").alias("is_warehouse"))
    out = {
        "presets": points.select("preset_id", "name", "created_at").distinct(),
        "preset_locations": links,
        "warehouses": links.where("is_warehouse").select("preset_id", "location_id"),
        "locations": locations,
    }
    if stored is not None and patterns is not None and cl is not None:
        fresh = placed.where("is_new and not is_warehouse").groupBy("location_id").agg(F.min_by(F.struct("lat", "lon", "street"), "request_id").alias("p")).select("location_id", "p.*")
        out["location_clusters"] = matching.assign_dynamic(fresh, "location_id", patterns, cl).where("cluster_id is not null").select("location_id", "cluster_id")
    return out


TILE_CELLS, TILE_GROWTH, TILE_POINTS = 64, 8, 50_000  # edge of the first tiles in cells, growth of it per round, points that a tile settles at a time


def _leaders(points: DataFrame, tol: float) -> DataFrame:
    """The points (lat, lon, first) that open a new place when they come one after the other in the order of ``first``.

    Rounds over tiles of cells as wide as the tolerance. A task settles the earliest open points of a tile in their order; a point
    that depends on an earlier open one outside the tile waits. All points within the tolerance of an opened place are then settled. The next
    tiles are larger and shifted, so what waited at a border lies inside; they grow only while each holds all its open points.
    """
    cells = {"_x": F.floor(F.col("lat") / tol), "_y": F.floor(F.col("lon") / tol)}
    keyed = points.withColumn("_key", F.struct("first", "lat", "lon"))
    open_ = cut(ranks.position(keyed, [], "_key", "_order").drop("_key").withColumns(cells))
    found, left, edge, shift = None, 1, TILE_CELLS, False
    schema = f"lat double, lon double, first {dict(points.dtypes)['first']}"
    while left:
        move = edge // 2 if shift else 0
        tile = lambda x, y: [F.floor((x + move) / edge).alias("_tx"), F.floor((y + move) / edge).alias("_ty")]  # noqa: E731,B023
        placed = open_.select("*", *tile(F.col("_x"), F.col("_y")))
        turn = Window.partitionBy("_tx", "_ty").orderBy("_order")
        earliest = placed.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= TILE_POINTS)
        cell = open_.groupBy("_x", "_y").agg(F.min("_order").alias("_order"))
        beside = F.explode(F.array_distinct(F.array(*[F.struct(*tile(F.col("_x") + dx, F.col("_y") + dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))).alias("t")
        ring = cell.select("*", *tile(F.col("_x"), F.col("_y")), beside).where("t._tx <> _tx or t._ty <> _ty").select("t._tx", "t._ty", "_x", "_y", "_order")
        tasks = earliest.select("_tx", "_ty", "_x", "_y", "_order", "lat", "lon", "first", F.lit(True).alias("_own")).unionByName(ring.withColumn("_own", F.lit(False)), allowMissingColumns=True)
        opened, full = cut_and_measure(tasks.groupBy("_tx", "_ty").applyInArrow(_opened_in_tile(tol), schema + ", n long"), n=F.max("n"))
        opened = opened.where("lat is not null").drop("n")
        found = opened if found is None else found.unionByName(opened)
        near = grid.box_pairs(open_.select("lat", "lon"), opened, tol, strict=True).select("lat", "lon").distinct()
        open_, seen = cut_and_measure(open_.join(near, ["lat", "lon"], "left_anti").select(open_.columns), n=F.count(F.lit(1)))
        left, shift = seen["n"], not shift
        if (full["n"] or 0) < TILE_POINTS:
            edge *= TILE_GROWTH
    return found


def _opened_in_tile(tol: float):
    """Function of a tile's open points and of the earliest order of each open cell around it: the places that surely open now."""

    def settle(tile: pa.Table) -> pa.Table:
        own = tile.filter(tile["_own"]).sort_by("_order")
        rows = tile.filter(pc.invert(tile["_own"])).select(["_x", "_y", "_order"])
        outside = {(x, y): order for x, y, order in zip(*(c.to_pylist() for c in rows.columns), strict=True)}
        opened: dict[tuple, tuple] = {}  # a cell holds one place at most
        waiting: dict[tuple, list] = {}
        picked = []
        columns = [own[c].to_pylist() for c in ("_x", "_y", "_order", "lat", "lon")]
        for i, (x, y, order, lat, lon) in enumerate(zip(*columns, strict=True)):
            around = [(x + dx, y + dy) for dx in (0, -1, 1) for dy in (0, -1, 1)]  # its own cell first
            near = lambda p: abs(p[0] - lat) < tol and abs(p[1] - lon) < tol  # noqa: E731,B023
            if any(near(opened[c]) for c in around if c in opened):
                continue
            if any(outside.get(c, order) < order for c in around) or any(map(near, (p for c in around for p in waiting.get(c, ())))):
                waiting.setdefault((x, y), []).append((lat, lon))
            else:
                opened[x, y] = (lat, lon)
                picked.append(i)
        found = own.select(["lat", "lon", "first"]).take(pa.array(picked, pa.int64()))
        size = pa.table({"lat": pa.nulls(1, pa.float64()), "lon": pa.nulls(1, pa.float64()), "first": pa.nulls(1, own.schema.field("first").type), "n": pa.array([len(own)], pa.int64())})
        return pa.concat_tables([found.append_column("n", pa.nulls(len(found), pa.int64())), size])

    return settle


def place_points(loc: DataFrame, incoming: DataFrame, tol: float | None = geo.COORDINATE_TOLERANCE) -> DataFrame:
    """(lat, lon, location_id, is_new, p_lat, p_lon): the location of each incoming coordinate, as if the points came one after the other by request_id.

    A stored location within the tolerance comes first (the lowest id), then the earliest point that was inserted before; else the point is
    inserted. ``tol=None``: equal coordinates only, six digits for new ones. Rows without a coordinate have no place.
    """
    points = cut(incoming.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("request_id").alias("first")))
    if tol is None:
        found = loc.groupBy("lat", "lon").agg(F.min("location_id").alias("location_id"))
    else:
        found = grid.first_within(points, loc, "location_id", tol)
    placed = cut(points.join(found, ["lat", "lon"], "left"))
    free = placed.where("location_id is null").select("lat", "lon", "first")
    if tol is None:
        leader = free.withColumn("_key", geo.coord_key("lat", "lon")).groupBy("_key").agg(F.min(F.struct("first", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))).alias("l"))
        new = free.withColumn("_key", geo.coord_key("lat", "lon")).join(leader, "_key").select("lat", "lon", "l.p_lat", "l.p_lon")
    else:
        pairs = grid.box_pairs(free, _leaders(free, tol), tol, strict=True).where("t_first <= first")
        leader = pairs.groupBy("lat", "lon").agg(F.min(F.struct("t_first", F.col("t_lat").alias("p_lat"), F.col("t_lon").alias("p_lon"))).alias("l"))
        new = leader.select("lat", "lon", "l.p_lat", "l.p_lon")
    fresh = new.select("lat", "lon", location_key("p_lat", "p_lon").alias("location_id"), F.lit(True).alias("is_new"), "p_lat", "p_lon")
    old = placed.where("location_id is not null").select("lat", "lon", "location_id", F.lit(False).alias("is_new"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    return cut(old.unionByName(fresh))


def upsert_locations(loc: DataFrame, incoming: DataFrame, tol: float | None = geo.COORDINATE_TOLERANCE) -> DataFrame:
    """All locations after find-or-insert of the incoming points; ``change`` is kept, updated or inserted.

    Points are placed by ``place_points``. The address of the highest request_id of a place wins: it updates a stored location if street or
    neighborhood differ, where parts it lacks stay, and is that of an inserted one.
    """
    address = [c for c in ADDRESS if c in incoming.columns]
    last = F.max_by(F.struct(*address), "request_id").alias("new")
    placed = incoming.join(place_points(loc, incoming, tol), ["lat", "lon"])
    patch = placed.where("not is_new").groupBy("location_id").agg(last)
    joined = loc.join(patch, "location_id", "left")
    differs = F.col("new").isNotNull() & (~F.col("street").eqNullSafe(F.col("new.street")) | ~F.col("neighborhood").eqNullSafe(F.col("new.neighborhood")))
    stored = joined.select(
        "location_id", "lat", "lon",
        *[F.when(differs, F.coalesce(F.col(f"new.{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in address],
        F.when(differs, "updated").otherwise("kept").alias("change"),
    )
    fresh = placed.where("is_new").groupBy("location_id", F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon")).agg(last)
    return stored.unionByName(fresh.select("location_id", "lat", "lon", *[F.col(f"new.{c}").alias(c) for c in address], F.lit("inserted").alias("change")))


def store_dynamic(points: DataFrame, loc: DataFrame, patterns: DataFrame, cl: DataFrame, tol: float = geo.COORDINATE_TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(new locations, their cluster links) of dynamic points (request_id, lat, lon, street, ...) that no stored location serves."""
    address = [c for c in ADDRESS if c in points.columns]
    placed = points.join(place_points(loc, points, tol).where("is_new"), ["lat", "lon"])
    fresh = cut(placed.groupBy("location_id", F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon")).agg(F.max_by(F.struct(*address), "request_id").alias("a")).select("location_id", "lat", "lon", "a.*"))
    found = matching.assign_dynamic(fresh, "location_id", patterns, cl)
    return fresh, found.where("cluster_id is not null").select("location_id", "cluster_id")


def patch_addresses(loc: DataFrame, patch: DataFrame, overwrite: bool = False) -> DataFrame:
    """Addresses after a patch by location id; ``change`` is kept, patched or inserted.

    Null or empty keeps the old value; with ``overwrite`` the patch replaces every part, and ids that are not stored
    yet are inserted.
    """
    address = [c for c in ADDRESS if c in patch.columns]
    new = patch.select("location_id", F.struct("lat", "lon", *[payload.blank_to_null(c).alias(c) for c in address]).alias("new"))
    joined = loc.select("location_id", F.struct("lat", "lon", *address).alias("old")).join(new, "location_id", "full_outer" if overwrite else "left")
    hit, old = F.col("new").isNotNull(), F.col("old").isNotNull()

    def value(c: str) -> Column:
        chosen = F.when(hit, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if overwrite else F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))
        return chosen.alias(c)

    change = F.when(hit & old, "patched").when(hit, "inserted").otherwise("kept")
    place = [F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")).alias(c) for c in ("lat", "lon")]
    return joined.select("location_id", *place, *[value(c) for c in address], change.alias("change"))


def upsert_links(lc: DataFrame, new: DataFrame) -> DataFrame:
    """Links after replacement: one link per location, the new one wins."""
    return lc.join(new, "location_id", "left_anti").unionByName(new)


# ---- checkpoints ---------------------------------------------------------------------------------------------------


def merge_checkpoints(cp: DataFrame, edits: DataFrame) -> DataFrame:
    """Checkpoints after a bulk save; ``change`` is kept, updated or new.

    Edit ids that start with ``temp-`` are new points; rows without id, lat or lon are skipped.
    """
    usable = edits.where("id is not null and lat is not null and lon is not null").select(
        "id", "cluster_id", "lat", "lon",
        F.coalesce("from_type", F.lit(NEW_FROM_TYPE)).alias("from_road_type"),
        F.coalesce("to_type", F.lit(NEW_TO_TYPE)).alias("to_road_type"),
        F.coalesce("confidence", F.lit(NEW_CONFIDENCE)).alias("confidence"),
    )
    is_new = F.startswith("id", F.lit("temp-"))
    fresh = usable.where(is_new).withColumn("checkpoint_id", F.xxhash64("id", "cluster_id", "lat", "lon")).drop("id")
    moved = usable.where(~is_new).select(F.col("id").try_cast("bigint").alias("checkpoint_id"), F.struct("lat", "lon", "from_road_type", "to_road_type").alias("e"))
    joined = cp.join(moved, "checkpoint_id", "left")
    hit = F.col("e").isNotNull()
    stored = joined.select(
        "checkpoint_id", "cluster_id",
        *[F.when(hit, F.col(f"e.{c}")).otherwise(F.col(c)).alias(c) for c in ("lat", "lon", "from_road_type", "to_road_type")],
        "confidence", F.when(hit, "updated").otherwise("kept").alias("change"),
    )
    return stored.unionByName(fresh.withColumn("change", F.lit("new")))


def replace_checkpoints(cp: DataFrame, generated: DataFrame, regenerate: bool = True) -> DataFrame:
    """Checkpoints after generation: old ones of the generated clusters go, or (not regenerate) stay as 'existing'."""
    columns = ["cluster_id", "lat", "lon", "from_road_type", "to_road_type", "confidence"]
    if regenerate:
        return cp.join(generated, "cluster_id", "left_anti").select(columns).unionByName(generated.select(columns))
    same = F.lit("existing")
    kept = cp.withColumns({"from_road_type": same, "to_road_type": same, "confidence": F.lit(1.0)})
    return kept.select(columns).unionByName(generated.join(cp, "cluster_id", "left_anti").select(columns))


# ---- deletes, retention, sizes -------------------------------------------------------------------------------------


def delete_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def deleted_count(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi").agg(F.count("*").alias("deleted"))


def delete_presets(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Presets, their links and warehouses without the given presets."""
    return {n: delete_by_id(tables[n], ids, "preset_id") for n in ("presets", "preset_locations", "warehouses") if n in tables}


def delete_clusters(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Clusters without the given ones; their checkpoints go with them."""
    return {n: delete_by_id(tables[n], ids, "cluster_id") for n in ("clusters", "security_checkpoints") if n in tables}


def expire(df: DataFrame, now: Column, older_than_s: int, ts: str = "created_at") -> DataFrame:
    """Rows that are not older than the limit; a row exactly at the limit stays."""
    return df.where(payload.age_seconds(now, ts) <= older_than_s)


def expired_counts(tables: dict[str, DataFrame], now: Column, older_than_s: int) -> DataFrame:
    """Removed rows per table."""
    counts = [
        df.agg(F.count_if(payload.age_seconds(now, "created_at") > older_than_s).alias("removed")).withColumn("table_name", F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def table_sizes(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and total characters of one text column per table."""
    sizes = [
        df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters")).withColumn("table_name", F.lit(name))
        for name, (df, text) in tables.items()
    ]
    return reduce(DataFrame.unionByName, sizes)
