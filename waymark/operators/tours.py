"""Tours over many depots at once.

``depots``: instance_id, lat, lon. ``stops``: instance_id, stop_id, lat, lon. Tours come back as rows
(instance_id, vehicle, seq, stop_id, km), never as one list per instance, so an instance may be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import geo
from waymark.operators import ranks
from waymark.session import cut_lean as cut, cut_lean_and_measure as cut_and_measure, spread

BLOCK = 200  # nearest stops that one step of a tour looks at; results do not depend on it
EXACT_NODES = 15  # fixed limit of the exact tour, unless another one is asked for
COVER_BITS = 62  # clusters of an instance that fit a 64-bit number
COVER_CELLS = 500_000  # distances that a task holds of covering tours in step with each other
STEP_CELLS = 500_000  # distances that a task holds of paths that it improves in step with each other
TWO_OPT_BLOCK = 300  # legs of a path that one task improves; longer paths take several rounds


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _between(a: Column, b: Column) -> Column:
    return geo.arc_km(a["lat"], a["lon"], b["lat"], b["lon"])


def _at(lat: str, lon: str) -> Column:
    return F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))


def _arc_km(lat_a: np.ndarray, lon_a: np.ndarray, lat_b: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat_a), np.radians(lat_b)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((np.radians(lon_b) - np.radians(lon_a)) / 2) ** 2
    return 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


# ---- nearest neighbour ----------------------------------------------------------------------------------------------


def _walk(block: Column, depot: Column, anchor: Column, reach: Column, taken: Column, share: Column) -> Column:
    """Nearest-neighbour steps over a block of stops, as long as the block surely holds the nearest one.

    ``reach`` is the distance from the anchor beyond which stops are missing from the block (null: none missing). A
    stop at distance d of a position p is surely the nearest if d + |anchor, p| <= reach. Every vehicle starts at the
    depot and takes ``share`` stops.
    """
    empty = F.array().cast("array<struct<pos:bigint,stop_id:bigint,km:double>>")
    start = F.struct(anchor.alias("at"), taken.alias("taken"), block.alias("left"), empty.alias("out"), F.lit(False).alias("halt"))

    def step(s: Column, _i: Column) -> Column:
        here = F.when(s["taken"] % share == 0, depot).otherwise(s["at"])

        def choose(p: Column) -> Column:
            options = F.transform(
                s["left"], lambda c: F.struct(_between(p, c).alias("km"), c["stop_id"].alias("stop_id"), c["lat"].alias("lat"), c["lon"].alias("lon"))
            )

            def take(best: Column) -> Column:
                sure = reach.isNull() | (best["km"] + _between(anchor, p) <= reach)
                moved = F.struct(
                    F.struct(best["lat"].alias("lat"), best["lon"].alias("lon")).alias("at"),
                    (s["taken"] + 1).alias("taken"),
                    F.filter(s["left"], lambda c: c["stop_id"] != best["stop_id"]).alias("left"),
                    F.concat(s["out"], F.array(F.struct(s["taken"].alias("pos"), best["stop_id"].alias("stop_id"), best["km"].alias("km")))).alias("out"),
                    F.lit(False).alias("halt"),
                )
                return F.when(sure & ~s["halt"], moved).otherwise(s.withField("halt", F.lit(True)))

            return _let(F.array_min(options), take)

        return F.when(s["halt"] | (F.size(s["left"]) == 0), s).otherwise(_let(here, choose))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(block), F.lit(1))), start, step)


def _walk_short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole nearest-neighbour tours of packed instances, all instances of one size and share in step with each other."""
    for batch in batches:
        for (n, share), same in batch.groupby(["n", "share"]):
            ids, lat, lon = (np.stack(same[c]) for c in ("ids", "lat", "lon"))
            depot_lat, depot_lon = same["d_lat"].to_numpy(), same["d_lon"].to_numpy()
            row, open_ = np.arange(len(same)), np.ones((len(same), n), bool)
            order, legs = np.empty((len(same), n), np.int64), np.empty((len(same), n))
            for step in range(n):
                if step % share == 0:
                    at_lat, at_lon = depot_lat, depot_lon
                gap = np.where(open_, _arc_km(at_lat[:, None], at_lon[:, None], lat, lon), np.inf)
                best = gap.argmin(axis=1)  # stops come by id, so a tie goes to the lowest
                order[:, step], legs[:, step], open_[row, best] = ids[row, best], gap[row, best], False
                at_lat, at_lon = lat[row, best], lon[row, best]
            yield pd.DataFrame({
                "instance_id": np.repeat(same["instance_id"].to_numpy(), n), "share": share, "pos": np.tile(np.arange(n), len(same)), "stop_id": order.ravel(), "km": legs.ravel(),
            })


def _instances(depots: DataFrame, stops: DataFrame, vehicles: str | None) -> DataFrame:
    """Depots with the number of stops and the stops per vehicle."""
    wanted = F.col(vehicles).cast("bigint") if vehicles else F.lit(1).cast("bigint")
    n = stops.groupBy("instance_id").agg(F.count("*").alias("n"))
    used = F.greatest(F.least(wanted, F.col("n")), F.lit(1))
    return depots.join(n, "instance_id").select(
        "instance_id", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"), "n", F.ceil(F.col("n") / used).cast("bigint").alias("share")
    )


def nearest_tours(depots: DataFrame, stops: DataFrame, vehicles: str | None = None, block: int = BLOCK) -> DataFrame:
    """Nearest-neighbour tours: rows (instance_id, vehicle, seq, stop_id, km), km being the leg that ends at the stop.

    ``vehicles`` names a depot column; each vehicle takes up to ceil(n / vehicles) of the nearest unvisited stops.
    Instances of up to ``block`` stops take one pass. For larger ones each round reads the ``block`` stops nearest to
    the current position and walks on while they surely hold the next stop; the result is the same tour.
    """
    points = stops.select("instance_id", "stop_id", "lat", "lon")
    plan, seen = cut_and_measure(_instances(depots, points, vehicles), long=F.count_if(F.col("n") > block))
    entry = F.struct("stop_id", "lat", "lon")
    depot = _at("d_lat", "d_lon")

    def finish(rows: DataFrame) -> DataFrame:
        vehicle = F.floor(F.col("pos") / F.col("share"))
        return rows.select("instance_id", vehicle.alias("vehicle"), (F.col("pos") - vehicle * F.col("share") + 1).alias("seq"), "stop_id", "km")

    short = plan.where(F.col("n") <= block)
    few = points.join(short.select("instance_id"), "instance_id", "left_semi") if seen["long"] else points
    packed = spread(few, "instance_id").groupBy("instance_id").agg(F.sort_array(F.collect_list(entry)).alias("left"))
    kind = short.schema["instance_id"].dataType.simpleString()
    arrays = packed.select("instance_id", *[F.col(f"left.{c}").alias(n) for c, n in (("stop_id", "ids"), ("lat", "lat"), ("lon", "lon"))])
    walked = arrays.join(short, "instance_id").mapInPandas(_walk_short, f"instance_id {kind}, share bigint, pos bigint, stop_id bigint, km double")
    done = finish(walked)
    if not seen["long"]:
        return done

    state = cut(plan.where(F.col("n") > block).select("*", F.col("d_lat").alias("lat"), F.col("d_lon").alias("lon"), F.lit(0).cast("bigint").alias("taken")))
    rest = cut(points.join(state, "instance_id", "left_semi"))
    placed = None
    while True:
        anchor_lat = F.when(F.col("taken") % F.col("share") == 0, F.col("d_lat")).otherwise(F.col("lat"))
        anchor_lon = F.when(F.col("taken") % F.col("share") == 0, F.col("d_lon")).otherwise(F.col("lon"))
        here = state.where("taken < n").select("instance_id", "d_lat", "d_lon", "n", "share", "taken", anchor_lat.alias("a_lat"), anchor_lon.alias("a_lon"))
        order = Window.partitionBy("instance_id").orderBy("gap", "stop_id")
        near = (
            rest.join(here, "instance_id").withColumn("gap", geo.arc_km("a_lat", "a_lon", "lat", "lon"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block)
        )
        grouped = near.groupBy("instance_id", "d_lat", "d_lon", "n", "share", "taken", "a_lat", "a_lon").agg(
            F.collect_list(entry).alias("left"), F.max("gap").alias("reach")
        )
        reach = F.when(F.col("n") - F.col("taken") > block, F.col("reach"))
        end = _walk(F.col("left"), depot, _at("a_lat", "a_lon"), reach, F.col("taken"), F.col("share"))
        moved = cut(grouped.select("instance_id", "d_lat", "d_lon", "n", "share", end.alias("e")))
        out = moved.select("instance_id", "share", F.explode("e.out").alias("o")).select("instance_id", "share", "o.*")
        placed = out if placed is None else placed.unionByName(out)
        state, seen = cut_and_measure(
            moved.select("instance_id", "d_lat", "d_lon", "n", "share", "e.at.lat", "e.at.lon", "e.taken"), open=F.count_if(F.col("taken") < F.col("n"))
        )
        if not seen["open"]:
            return done.unionByName(finish(placed))
        rest = cut(rest.join(state.where("taken < n"), "instance_id", "left_semi").join(out, ["instance_id", "stop_id"], "left_anti"))


def closed_lengths(depots: DataFrame, stops: DataFrame, tours: DataFrame) -> DataFrame:
    """(instance_id, vehicle, n_stops, km): tour length including the way back to the depot."""
    legs = tours.groupBy("instance_id", "vehicle").agg(
        F.sum("km").alias("out_km"), F.count("*").alias("n_stops"), F.max_by("stop_id", "seq").alias("stop_id")
    )
    last = legs.join(stops.select("instance_id", "stop_id", "lat", "lon"), ["instance_id", "stop_id"])
    home = depots.select("instance_id", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    return last.join(home, "instance_id").select(
        "instance_id", "vehicle", "n_stops", (F.col("out_km") + geo.arc_km("lat", "lon", "d_lat", "d_lon")).alias("km")
    )


# ---- covering tours -------------------------------------------------------------------------------------------------


def _cover(block: Column, cars: Column) -> Column:
    """Greedy covering steps: the cheapest (vehicle, checkpoint) that serves a cluster still needed, while it is sure.

    ``cars``: array of struct(vehicle, lat, lon, seq, a_lat, a_lon, reach): where a vehicle is and how many stops it has; the
    last three as in the nearest-neighbour walk.
    """
    empty = F.array().cast("array<struct<vehicle:int,seq:bigint,stop_id:bigint,km:double>>")
    none = F.array().cast("array<bigint>")
    start = F.struct(cars.alias("cars"), none.alias("done"), empty.alias("out"), F.lit(False).alias("halt"))

    def step(s: Column, _i: Column) -> Column:
        useful = F.filter(block, lambda c: F.size(F.array_except(c["clusters"], s["done"])) > 0)

        def options(v: Column, left: Column) -> Column:
            return F.transform(left, lambda c: F.struct(
                _between(v, c).alias("km"), v["vehicle"].alias("vehicle"), c["stop_id"].alias("stop_id"), v["seq"].alias("seq"),
                c["lat"].alias("lat"), c["lon"].alias("lon"), c["clusters"].alias("clusters"),
            ))

        def take(best: Column) -> Column:
            def sure(v: Column) -> Column:
                anchor = F.struct(v["a_lat"].alias("lat"), v["a_lon"].alias("lon"))
                return v["reach"].isNull() | (best["km"] + _between(anchor, v) <= v["reach"])

            cars = F.transform(s["cars"], lambda v: F.when(
                v["vehicle"] == best["vehicle"], v.withField("lat", best["lat"]).withField("lon", best["lon"]).withField("seq", v["seq"] + 1)
            ).otherwise(v))
            stop = F.struct(best["vehicle"].alias("vehicle"), (best["seq"] + 1).alias("seq"), best["stop_id"].alias("stop_id"), best["km"].alias("km"))
            moved = F.struct(
                cars.alias("cars"), F.array_union(s["done"], best["clusters"]).alias("done"), F.concat(s["out"], F.array(stop)).alias("out"), F.lit(False).alias("halt"),
            )
            return F.when(F.forall(s["cars"], sure), moved).otherwise(s.withField("halt", F.lit(True)))

        def choose(left: Column) -> Column:
            best = F.array_min(F.flatten(F.transform(s["cars"], lambda v: options(v, left))))
            return F.when(F.size(left) == 0, s.withField("halt", F.lit(True))).otherwise(_let(best, take))

        return F.when(s["halt"], s).otherwise(_let(useful, choose))

    return F.aggregate(F.sequence(F.lit(1), F.size(block)), start, step)


def _cover_steps(cars: int, d_lat: np.ndarray, d_lon: np.ndarray, lat: np.ndarray, lon: np.ndarray, serves: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Covering steps of instances with equally many checkpoints, in step with each other: (instances, vehicles, seq, checkpoints, km).

    ``serves``: per instance and checkpoint the clusters, as bits.
    """
    n = lat.shape[1]
    gaps = np.repeat(_arc_km(d_lat[:, None], d_lon[:, None], lat, lon)[:, None, :], cars, axis=1)
    need, seq, rows = np.bitwise_or.reduce(serves, axis=1), np.zeros((len(lat), cars), np.int64), np.arange(len(lat))
    while len(rows := rows[need[rows] != 0]):
        useful = (serves[rows] & need[rows, None]) != 0
        v, k = np.divmod(np.where(useful[:, None, :], gaps[rows], np.inf).reshape(len(rows), -1).argmin(axis=1), n)  # ties: lower vehicle, then lower checkpoint
        seq[rows, v] += 1
        yield rows, v, seq[rows, v], k, gaps[rows, v, k]
        need[rows] &= ~serves[rows, k]
        gaps[rows, v] = _arc_km(lat[rows, k][:, None], lon[rows, k][:, None], lat[rows], lon[rows])


def _cover_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole covering tours of packed instances, stops by id; clusters are bits of a number."""
    for batch in batches:
        instance, ids, clusters = (batch.column(c) for c in ("instance_id", "ids", "clusters"))
        numbers = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cars", "d_lat", "d_lon")}
        lat, lon = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
        stop_ids, own = ids.flatten(), clusters.flatten()
        sizes = pc.list_value_length(ids).to_numpy()
        first = np.cumsum(sizes) - sizes
        # number the clusters of each instance
        stop = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)[stop]
        named = own.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((named, row))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(row[order]) != 0) | (named[order][1:] != named[order][:-1])
        rank = np.cumsum(fresh) - 1
        before = np.zeros(len(sizes) + 1, np.int64)
        np.add.at(before, row[order][fresh] + 1, 1)
        count, before = before[1:], np.cumsum(before)
        bit = np.empty(len(order), np.int64)
        bit[order] = rank - before[row[order]]
        wide = count > COVER_BITS
        serves = np.zeros(len(own), np.int64)
        fits = ~wide[row]
        np.bitwise_or.at(serves, stop[fits], np.int64(1) << bit[fits])
        many = np.zeros(len(own), object)
        for s, b in zip(stop[~fits].tolist(), bit[~fits].tolist()):
            many[s] |= 1 << b
        kinds = np.stack([sizes, numbers["cars"], wide], axis=1)
        for n, cars, far in np.unique(kinds, axis=0).tolist():
            same = np.flatnonzero((kinds == (n, cars, far)).all(axis=1))
            height = max(1, COVER_CELLS // max(n * cars, 1))
            for start in range(0, len(same) if n else 0, height):
                part = same[start : start + height]
                at = first[part][:, None] + np.arange(n)
                out = [[], [], [], [], []]
                for rows, v, seq, k, km in _cover_steps(cars, numbers["d_lat"][part], numbers["d_lon"][part], lat[at], lon[at], (many if far else serves)[at]):
                    for values, value in zip(out, (part[rows], v, seq, at[rows, k], km)):
                        values.append(value)
                if out[0]:
                    rows, v, seq, k, km = (np.concatenate(x) for x in out)
                    yield pa.RecordBatch.from_arrays([instance.take(pa.array(rows)), pa.array(v, pa.int32()), pa.array(seq, pa.int64()), stop_ids.take(pa.array(k)), pa.array(km)], ["instance_id", "vehicle", "seq", "stop_id", "km"])


def covering_tours(depots: DataFrame, served: DataFrame, vehicles: str | None = None, block: int = BLOCK) -> DataFrame:
    """Covering tours: rows (instance_id, vehicle, seq, stop_id, km).

    ``served``: instance_id, stop_id, lat, lon, cluster_id, one row per required cluster that a checkpoint serves.
    Each step takes the cheapest (vehicle, checkpoint) among checkpoints that serve a cluster not yet covered, until
    nothing is left to cover; the depot is no checkpoint. Ties: lower vehicle, then lower checkpoint. Instances of up to ``block``
    checkpoints take one pass. Larger ones are worked in rounds on the checkpoints nearest to each vehicle, with the same result.
    """
    wanted = F.col(vehicles).cast("int") if vehicles else F.lit(1)
    columns = ["instance_id", "vehicle", "seq", "stop_id", "km"]
    rows = served.select("instance_id", "stop_id", "lat", "lon", "cluster_id")
    # only instances of more rows than a block can have more checkpoints
    many, seen = cut_and_measure(rows.groupBy("instance_id").agg(F.count("*").alias("rows")).where(F.col("rows") > block), n=F.count(F.lit(1)))
    large = {"n": 0}
    if seen["n"]:
        wide = rows.join(many, "instance_id", "left_semi").groupBy("instance_id").agg(F.count_distinct("stop_id").alias("n")).where(F.col("n") > block)
        sizes, large = cut_and_measure(wide, n=F.count(F.lit(1)))
    home = depots.select("instance_id", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"), F.greatest(wanted, F.lit(1)).alias("cars"))

    def checkpoints(rows: DataFrame) -> DataFrame:
        return rows.groupBy("instance_id", "stop_id", "lat", "lon").agg(F.collect_set("cluster_id").alias("clusters"))

    stop = F.struct("stop_id", "lat", "lon", "clusters")
    few = rows.join(sizes, "instance_id", "left_anti") if large["n"] else rows
    packed = checkpoints(spread(few, "instance_id").distinct()).groupBy("instance_id").agg(F.sort_array(F.collect_list(stop)).alias("left"))
    arrays = packed.select("instance_id", *[F.col(f"left.{c}").alias(n) for c, n in (("stop_id", "ids"), ("lat", "lat"), ("lon", "lon"), ("clusters", "clusters"))])
    kind = depots.schema["instance_id"].dataType.simpleString()
    done = arrays.join(home, "instance_id").mapInArrow(_cover_short, f"instance_id {kind}, vehicle int, seq bigint, stop_id bigint, km double")
    if not large["n"]:
        return done
    need = cut(rows.join(sizes, "instance_id", "left_semi").distinct())
    car = home.join(sizes, "instance_id").withColumn("vehicle", F.explode(F.sequence(F.lit(0), F.col("cars") - 1)))
    state = cut(car.select("instance_id", "vehicle", F.col("d_lat").alias("lat"), F.col("d_lon").alias("lon"), F.lit(0).cast("bigint").alias("seq")))
    while True:
        checkpoint = checkpoints(need)
        anchored = state.select("instance_id", "vehicle", "seq", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
        order = Window.partitionBy("instance_id", "vehicle").orderBy("gap", "stop_id")
        gaps = checkpoint.join(anchored, "instance_id").withColumn("gap", geo.arc_km("a_lat", "a_lon", "lat", "lon"))
        ranked = cut(gaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block))
        near = ranked.select("instance_id", "stop_id", "lat", "lon", "clusters").dropDuplicates(["instance_id", "stop_id"])
        left = need.groupBy("instance_id").agg(F.count_distinct("stop_id").alias("n"))
        reach = ranked.groupBy("instance_id", "vehicle").agg(F.max("gap").alias("reach")).join(left, "instance_id").select(
            "instance_id", "vehicle", F.when(F.col("n") > block, F.col("reach")).alias("reach")
        )
        team = anchored.join(reach, ["instance_id", "vehicle"]).groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct(
            "vehicle", F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), "seq", "a_lat", "a_lon", "reach"
        ))).alias("cars"))
        grouped = spread(near, "instance_id").groupBy("instance_id").agg(F.collect_list(stop).alias("left")).join(team, "instance_id")
        end = cut(grouped.select("instance_id", _cover(F.col("left"), F.col("cars")).alias("e")))
        done = done.unionByName(end.select("instance_id", F.explode("e.out").alias("o")).select("instance_id", "o.*").select(columns))
        covered = end.select("instance_id", F.explode("e.done").alias("cluster_id"))
        need, seen = cut_and_measure(need.join(covered, ["instance_id", "cluster_id"], "left_anti").select(need.columns), n=F.count(F.lit(1)))
        if not seen["n"]:
            return done
        state = cut(end.select("instance_id", F.explode("e.cars").alias("c")).select("instance_id", "c.vehicle", "c.lat", "c.lon", "c.seq"))


# ---- improvement and exact tours --------------------------------------------------------------------------------------


def _km_matrix(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    return _arc_km(lat[..., :, None], lon[..., :, None], lat[..., None, :], lon[..., None, :])


def in_step(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, rows): paths of one size that are worked in step with each other, in parts whose distances fit ``STEP_CELLS``."""
    for n in np.unique(sizes).tolist():
        same = np.flatnonzero(sizes == n)
        height = max(1, STEP_CELLS // max(n * n, 1))
        for start in range(0, len(same), height):
            yield n, same[start : start + height]


def _untangle(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Orders of paths of one size (a row each) without a pair of legs whose exchange shortens a path; both ends stay."""
    b, n = lat.shape
    order = np.tile(np.arange(n), (b, 1))
    km, rows, place = _km_matrix(lat, lon), np.arange(b if n > 3 else 0), np.arange(n)
    while len(rows):
        own = order[rows]
        d = km[rows[:, None, None], own[:, :, None], own[:, None, :]]
        leg = np.diagonal(d, 1, 1, 2)
        # gain of reversing i..j: legs (i-1, i) and (j, j+1) become (i-1, j) and (i, j+1)
        gain = leg[:, : n - 2, None] + leg[:, None, 1:] - d[:, : n - 2, 1 : n - 1] - d[:, 1 : n - 1, 2:]
        gain[:, *np.tril_indices(n - 2)] = 0.0
        flat = gain.reshape(len(rows), -1)
        best = flat.argmax(axis=1)
        better = flat[np.arange(len(rows)), best] > 1e-12
        rows, (i, j) = rows[better], (x[:, None] for x in np.divmod(best[better], n - 2))
        order[rows] = np.take_along_axis(own[better], np.where((place > i) & (place <= j + 1), i + j + 2 - place, place), axis=1)
    return order


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _untangled(lat: pd.Series, lon: pd.Series) -> pd.Series:
    out = np.empty(len(lat), object)
    for _, rows in in_step(lat.map(len).to_numpy()):
        for row, order in zip(rows, _untangle(*(np.stack(c.iloc[rows]) for c in (lat, lon)))):
            out[row] = order
    return pd.Series(out)


def _untangle_blocks(rows: DataFrame, block: int, shift: int) -> DataFrame:
    """Local optima of blocks of ``block`` consecutive legs, whose end points stay."""
    slot = F.floor((F.col("seq") + shift) / block)
    ends = F.array_distinct(F.array(slot, F.floor((F.col("seq") + shift - 1) / block)))
    keyed = rows.withColumn("slot", F.explode(F.when(F.col("seq") > 0, ends).otherwise(F.array(slot))))
    packed = spread(keyed, "route_id", "slot").groupBy("route_id", "slot").agg(F.sort_array(F.collect_list(F.struct("seq", "node_id", "lat", "lon"))).alias("p"))
    ordered = packed.withColumn("order", _untangled("p.lat", "p.lon"))
    moved = ordered.select("route_id", "p", F.posexplode("order").alias("k", "was")).withColumn("base", F.get("p", F.lit(0))["seq"])
    # the row on a border is given out by the block that it closes, not by the one that it opens
    return moved.where((F.col("k") > 0) | (F.col("base") <= 0) | ((F.col("base") + shift) % block != 0)).select(
        "route_id", (F.col("base") + F.col("k")).alias("seq"), *[F.get("p", F.col("was"))[c].alias(c) for c in ("node_id", "lat", "lon")]
    )


def improving_moves(rows: DataFrame, finest_km: float = 0.01) -> DataFrame:
    """For each leg ``a`` of a path the leg ``b`` behind it whose exchange shortens the path most: (route_id, a, b, gain).

    Exchanging legs a < b for the legs between their starts and between their ends gains only if the starts are closer
    than leg a is long, or the ends closer than leg b is long. So each leg looks into the grid cells around its start,
    and around its end, whose size is the leg's length: no other pair can gain.
    """
    legs = ranks.consecutive(rows, ["route_id"], "seq", "lat", "lon").withColumn("leg", geo.arc_km("lat", "lon", "next_lat", "next_lon"))
    legs = cut(legs.withColumn("level", F.greatest(F.ceil(F.log2(F.greatest("leg", F.lit(1e-12)) / finest_km)), F.lit(0)).cast("int")))
    levels = legs.select("route_id", "level").distinct()
    own = ["seq", "leg", "lat", "lon", "next_lat", "next_lon"]

    def cells(lat: str, lon: str) -> list[Column]:
        return [F.floor(c / (F.lit(finest_km) * F.pow(F.lit(2.0), F.col("level")))).alias(f"c{i}") for i, c in enumerate(geo.unit_xyz(lat, lon))]

    def pairs(lat: str, lon: str) -> DataFrame:
        centres = legs.where("leg > 0").select("route_id", "level", *[F.col(c).alias(f"x_{c}") for c in own], *cells(lat, lon))
        for c in ("c0", "c1", "c2"):
            centres = centres.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        targets = legs.drop("level").join(levels, "route_id").select("route_id", "level", *[F.col(c).alias(f"y_{c}") for c in own], *cells(lat, lon))
        return centres.join(targets, ["route_id", "level", "c0", "c1", "c2"])

    gain = F.col("x_leg") + F.col("y_leg") - geo.arc_km("x_lat", "x_lon", "y_lat", "y_lon") - geo.arc_km("x_next_lat", "x_next_lon", "y_next_lat", "y_next_lon")
    at_starts = pairs("lat", "lon").where("x_seq < y_seq").select("route_id", F.col("x_seq").alias("a"), F.col("y_seq").alias("b"), gain.alias("gain"))
    at_ends = pairs("next_lat", "next_lon").where("y_seq < x_seq").select("route_id", F.col("y_seq").alias("a"), F.col("x_seq").alias("b"), gain.alias("gain"))
    found = at_starts.unionByName(at_ends).where("gain > 1e-9")
    best = found.groupBy("route_id", "a").agg(F.max(F.struct("gain", (-F.col("b")).alias("b"))).alias("m"))
    return best.select("route_id", "a", (-F.col("m.b")).alias("b"), F.col("m.gain").alias("gain"))


def _apart(moves: DataFrame, top: int) -> DataFrame:
    """Moves that do not overlap, among them the best of each route.

    A move belongs to the smallest aligned interval of 2^level legs that holds both its legs. It is taken if it is the best in
    its interval and better than what belongs to the intervals around that.
    """
    size = F.length(F.ltrim(F.conv(F.col("a").bitwiseXOR(F.col("b")).cast("string"), 10, 2), F.lit("0")))
    placed = cut(moves.withColumn("level", size.cast("int")).withColumn("move", F.struct("gain", "a", "b")))
    at = lambda level: F.call_function("shiftright", F.col("a"), level)
    around = placed.withColumn("up", F.explode(F.sequence(F.col("level"), F.lit(top)))).withColumn("node", at(F.col("up")))
    inside = around.groupBy("route_id", "up", "node").agg(F.max("move").alias("inside"), F.max(F.when(F.col("up") == F.col("level"), F.col("move"))).alias("own"))
    seen = around.join(inside, ["route_id", "up", "node"])
    beaten = F.when(F.col("up") == F.col("level"), F.col("inside") > F.col("move")).otherwise(F.coalesce(F.col("own") > F.col("move"), F.lit(False)))
    return seen.groupBy("route_id", "a", "b").agg(F.bool_or(beaten).alias("beaten")).where("not beaten").select("route_id", "a", "b")


def two_opt(paths: DataFrame, block: int = TWO_OPT_BLOCK) -> DataFrame:
    """Paths (route_id, seq from 0, node_id, lat, lon) after 2-opt; the first and last row of a route stay.

    Every path ends in a local optimum: no exchange of two legs shortens it. A path of up to ``block`` legs gets there in
    one task. A longer one is improved in blocks of consecutive legs; then the exchanges left between blocks are found
    by a grid join, those that do not overlap are made, and both repeat until none is left. No task holds a whole long path.
    """
    paths = cut(paths.select("route_id", F.col("seq").cast("bigint").alias("seq"), "node_id", "lat", "lon"))
    sizes = paths.groupBy("route_id").agg(F.max("seq").alias("legs"))
    longest = sizes.agg(F.max("legs")).first()[0] or 0
    if longest <= block:
        return _untangle_blocks(paths, block, 0)
    short = paths.join(sizes.where(F.col("legs") <= block), "route_id", "left_semi")
    rows = cut(paths.join(sizes.where(F.col("legs") > block), "route_id", "left_semi"))
    turn, top = 0, int(longest).bit_length()
    while True:
        rows = cut(_untangle_blocks(rows, block, (block // 2) * (turn % 2)))
        turn += 1
        moves, seen = cut_and_measure(improving_moves(rows), n=F.count(F.lit(1)))
        if not seen["n"]:
            return _untangle_blocks(short, block, 0).unionByName(rows)
        turned = _apart(moves, top).select("route_id", F.explode(F.sequence(F.col("a") + 1, F.col("b"))).alias("seq"), (F.col("a") + 1 + F.col("b")).alias("both"))
        rows = cut(rows.join(turned, ["route_id", "seq"], "left").withColumn("seq", F.coalesce(F.col("both") - F.col("seq"), F.col("seq"))).drop("both"))


def _least(offers: np.ndarray) -> np.ndarray:
    """Least value along the middle axis; works in the array. Few instances side by side are taken by halves of the axis."""
    width = offers.shape[1]
    if offers.shape[2] >= 32:
        return offers.min(axis=1)
    while width > 1:
        half = (width + 1) // 2
        np.minimum(offers[:, : width - half], offers[:, half:width], out=offers[:, : width - half])
        width = half
    return offers[:, 0]


def _best_orders(km: np.ndarray, early: np.ndarray, late: np.ndarray, closed: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Order and length of the shortest way from the first to the last node over all others, for a stack of matrices.

    Dynamic programming over subsets, one subset size at a time for the whole stack. ``early`` and ``late`` are
    positions of which the first must come before the second (-1: no condition). ``closed``: no conditions, and both ends are one place;
    then ways over half of the nodes meet, as each can be walked backwards.
    """
    b, n = len(km), km.shape[1] - 2
    inner, stack = np.ascontiguousarray(km[:, 1:-1, 1:-1].transpose(1, 2, 0)), np.arange(b)
    best = np.full((1 << n, n, b), np.inf)  # by subset and last node, instances side by side
    for j in range(n):
        best[1 << j, j] = np.where((late == j) & (early >= 0), np.inf, km[:, 0, j + 1])
    masks = np.arange(1 << n)
    sizes = sum((masks >> j) & 1 for j in range(n))

    def onward(size: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Subsets of a size without node j, and the shortest ways over each of them on to it."""
        free = masks[(sizes == size) & ((masks >> j) & 1 == 0)]
        offers = best[free]
        offers += inner[:, j]
        return free, _least(offers)

    def back(mask: np.ndarray, last: np.ndarray, steps: int) -> np.ndarray:
        """The nodes of the best ways, from the last one to the first: the best value came from the node before."""
        order = [last]
        for _ in range(steps - 1):
            mask = mask ^ (1 << last)
            last = (best[mask, :, stack] + inner[:, last, stack].T).argmin(axis=1)
            order.append(last)
        return np.array(order).T

    closed = closed and n > 3
    top = (n + 1) // 2 if closed else n
    for size in range(1, top):
        for j in range(n):
            free, value = onward(size, j)
            held = (late == j) & (early >= 0)
            if held.any():
                value[held & ((free[:, None] >> np.maximum(early, 0)) & 1 == 0)] = np.inf
            best[free | 1 << j, j] = value
    if not closed:
        total = best[-1].T + km[:, 1:-1, -1]
        last = total.argmin(axis=1)
        return back(np.full(b, (1 << n) - 1), last, n)[:, ::-1], total.min(axis=1)
    least, subset, after = np.full(b, np.inf), np.zeros(b, int), np.zeros(b, int)
    for j in range(n):
        free, value = onward(top, j)
        value += best[(1 << n) - 1 - free, j]
        at = value.argmin(axis=0)
        lower = value[at, stack] < least
        least, subset, after = np.where(lower, value[at, stack], least), np.where(lower, free[at], subset), np.where(lower, j, after)
    before = (best[subset, :, stack] + inner[:, after, stack].T).argmin(axis=1)
    return np.concatenate([back(subset, before, top)[:, ::-1], back((1 << n) - 1 - subset, after, n - top)], axis=1), least


def _subset_tours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shortest orders of the rows of each batch, rows of one size together."""
    for batch in batches:
        for n, same in batch.groupby(batch["ids"].map(len)):
            height = max(8, min(256, 2_000_000 // ((1 << n) * n)))
            for first in range(0, len(same), height):
                part = same.iloc[first : first + height]
                lat = np.array([[a, *m, b] for a, m, b in zip(part["s_lat"], part["lat"], part["e_lat"])])
                lon = np.array([[a, *m, b] for a, m, b in zip(part["s_lon"], part["lon"], part["e_lon"])])
                early, late = part["pickup"].to_numpy(), part["dropoff"].to_numpy()
                closed = bool((early < 0).all() and (lat[:, 0] == lat[:, -1]).all() and (lon[:, 0] == lon[:, -1]).all())
                order, km = _best_orders(_km_matrix(lat, lon), early, late, closed)
                ids = [np.asarray(i)[o].tolist() for i, o in zip(part["ids"], order)]
                yield pd.DataFrame({"instance_id": part["instance_id"].to_numpy(), "ids": ids, "km": km})


def exact_orders(instances: DataFrame) -> DataFrame:
    """Shortest order of up to 15 stops between a start and an end: (instance_id, ids, km).

    ``instances``: instance_id, s_lat, s_lon, e_lat, e_lon, ids, lat, lon (arrays), pickup, dropoff (positions in the
    arrays of which the first must come before the second, or -1).
    """
    kind = instances.schema["instance_id"].dataType.simpleString()
    return instances.mapInPandas(_subset_tours, f"instance_id {kind}, ids array<bigint>, km double")


def exact_tours(depots: DataFrame, stops: DataFrame, max_nodes: int = EXACT_NODES) -> tuple[DataFrame, DataFrame]:
    """(shortest closed tours as rows instance_id, ids, km; error rows of instances with more than ``max_nodes`` stops).

    Time and memory per instance grow with 2^n: ``max_nodes`` is the limit that the caller wants to pay for.
    """
    sizes = stops.groupBy("instance_id").agg(F.count("*").alias("n"))
    small = stops.join(sizes.where(F.col("n") <= max_nodes), "instance_id", "left_semi")
    packed = spread(small, "instance_id").groupBy("instance_id").agg(F.sort_array(F.collect_list(F.struct("stop_id", "lat", "lon"))).alias("p"))
    instances = packed.join(depots.select("instance_id", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon")), "instance_id").select(
        "instance_id", F.col("d_lat").alias("s_lat"), F.col("d_lon").alias("s_lon"), F.col("d_lat").alias("e_lat"), F.col("d_lon").alias("e_lon"),
        F.col("p.stop_id").alias("ids"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), F.lit(-1).alias("pickup"), F.lit(-1).alias("dropoff"),
    )
    errors = sizes.where(F.col("n") > max_nodes).select(
        "instance_id", F.format_string("%d stops; the exact tour takes at most " + str(max_nodes), "n").alias("error")
    )
    return exact_orders(instances), errors


# ---- lengths, matrices ------------------------------------------------------------------------------------------------


def closed_paths(depots: DataFrame, stops: DataFrame, tours: DataFrame) -> DataFrame:
    """Tours as paths with the depot at both ends: route_id (instance:vehicle), seq from 0, node_id (null: depot)."""
    route = F.concat_ws(":", F.col("instance_id").cast("string"), F.col("vehicle").cast("string"))
    tours = cut(tours)
    middle = tours.join(stops.select("instance_id", "stop_id", "lat", "lon"), ["instance_id", "stop_id"]).select(
        "instance_id", route.alias("route_id"), "seq", F.col("stop_id").alias("node_id"), "lat", "lon"
    )
    last = tours.groupBy("instance_id", route.alias("route_id")).agg((F.max("seq") + 1).alias("end"))
    ends = last.join(depots.select("instance_id", "lat", "lon"), "instance_id").select(
        "instance_id", "route_id", F.explode(F.array(F.lit(0).cast("bigint"), F.col("end"))).alias("seq"), F.lit(None).cast("bigint").alias("node_id"), "lat", "lon"
    )
    return middle.unionByName(ends)


def path_lengths(paths: DataFrame, legs: DataFrame | None = None) -> DataFrame:
    """(route_id, km) of paths (route_id, seq, node_id, lat, lon): great-circle, or from ``legs`` (from_node, to_node, km).

    A leg that the table lacks makes the path infinitely long.
    """
    pairs = ranks.consecutive(paths, ["route_id"], "seq", "node_id", "lat", "lon")
    if legs is None:
        priced = pairs.withColumn("km", geo.arc_km("lat", "lon", "next_lat", "next_lon"))
    else:
        known = legs.select(F.col("from_node").alias("node_id"), F.col("to_node").alias("next_node_id"), F.col("km").alias("leg_km"))
        priced = pairs.join(known, ["node_id", "next_node_id"], "left").withColumn("km", F.coalesce("leg_km", F.lit(float("inf"))))
    return priced.groupBy("route_id").agg(F.sum("km").alias("km"))


def distance_matrix(nodes: DataFrame, width: int = 50) -> DataFrame:
    """(instance_id, i, part, km): row i of the matrix of an instance in parts of ``width`` columns.

    ``nodes``: instance_id, idx from 0, lat, lon. A matrix is quadratic by nature and meant for small instances; the
    tours above work from coordinates and never build one. Columns are packed, so there is no row per pair.
    """
    part = F.floor(F.col("idx") / width).alias("part")
    columns = nodes.groupBy("instance_id", part).agg(F.sort_array(F.collect_list(F.struct("idx", "lat", "lon"))).alias("to"))
    rows = nodes.select("instance_id", F.col("idx").alias("i"), "lat", "lon").join(columns, "instance_id")
    here = F.struct("lat", "lon")
    return rows.select("instance_id", "i", "part", F.transform("to", lambda c: _between(here, c)).alias("km"))
