"""Areas of point groups: convex hulls built block by block, and distances to them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.session import spread

BLOCK = 1_000  # points, or blocks of the step before, that one reduction takes together
RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _turn(a: tuple, b: tuple, c: tuple):
    """Positive if a, b, c turn left."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _half_hull(points: list[tuple]) -> list[int]:
    """Positions of one side of the hull of sorted points, without its end (Andrew's monotone chain)."""
    chain = []
    for i, p in enumerate(points):
        while len(chain) > 1 and not _turn(points[chain[-2]], points[chain[-1]], p) > 0:
            chain.pop()
        chain.append(i)
    return chain[:-1]


def _flat(rows: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All points of the lists, with the number and the first position of each list's."""
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return rows.flatten(), sizes, np.cumsum(sizes) - sizes


def _axes(points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """x and y of points, not a number where null."""
    return tuple(pc.struct_field(points, a).to_numpy(zero_copy_only=False).astype(np.float64) for a in "xy")


@F.arrow_udf(RING)
def _hull(rows: pa.Array) -> pa.Array:
    points, sizes, first = _flat(rows)
    x, y = (v.tolist() for v in _axes(points))
    picked, ends = [], [0]
    for n, at in zip(sizes.tolist(), first.tolist(), strict=True):
        if n < 3:
            picked.extend(range(at, at + n))
        else:
            own = list(zip(x[at : at + n], y[at : at + n], strict=True))
            picked.extend(at + i for i in _half_hull(own))
            picked.extend(at + n - 1 - i for i in _half_hull(own[::-1]))
        ends.append(len(picked))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points.take(pa.array(picked, pa.int64())), mask=pc.is_null(rows))


def hull_ring(points: Column) -> Column:
    """Counter-clockwise hull of an array of distinct sorted struct(x, y); fewer than three points stay as they are."""
    return _hull(points)


def convex_hulls(points: DataFrame, by: str, key: str) -> DataFrame:
    """(by, ring): hull of the points of every group.

    The points of a group are spread over blocks of about 1,000 by hash; each block is reduced to its own hull, then
    blocks of blocks, so the last step sees only corner points, however many points a group has.
    """
    parts = points.groupBy(by).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    corner = points.select(by, F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p"), F.xxhash64(key).alias("block"))
    corner = corner.join(parts, by)

    def hulls(df: DataFrame, *keys: str) -> DataFrame:
        return spread(df, by, *keys).groupBy(by, *keys).agg(hull_ring(F.sort_array(F.collect_set("p"))).alias("ring"))

    for _ in range(2):
        blocked = corner.withColumn("block", F.pmod("block", F.col("parts")))
        reduced = hulls(blocked, "parts", "block").select(by, "parts", "block", F.explode("ring").alias("p"))
        corner = reduced.withColumn("parts", F.ceil(F.col("parts") / BLOCK))
    return hulls(corner)


def ring_area(ring: Column) -> Column:
    """Area by the shoelace formula, in square degrees."""
    doubled = F.transform(ring, lambda p, i: p["x"] * _next(ring, i)["y"] - _next(ring, i)["x"] * p["y"])
    return F.abs(F.aggregate(doubled, F.lit(0.0), lambda s, v: s + v)) / 2


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


@F.arrow_udf(T.DoubleType())
def _ring_gap(rings: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
    points, sizes, first = _flat(rings)
    out = np.full(len(rings), np.nan)
    some = sizes > 0
    if some.any():
        ax, ay = _axes(points)
        following = np.arange(1, len(ax) + 1)
        following[(first + sizes - 1)[some]] = first[some]
        x, y = (np.repeat(p.to_numpy(zero_copy_only=False).astype(np.float64), sizes) for p in (px, py))
        with np.errstate(invalid="ignore", divide="ignore"):
            dx, dy = ax[following] - ax, ay[following] - ay
            length = dx * dx + dy * dy
            share = np.where(length > 0, ((x - ax) * dx + (y - ay) * dy) / length, 0.0)
            at = np.minimum(np.maximum(share, 0.0), 1.0)
            gx, gy = x - ax - at * dx, y - ay - at * dy
            left = dx * (y - ay) - dy * (x - ax) >= 0
            out[some] = np.fmin.reduceat(np.sqrt(gx * gx + gy * gy), first[some])
        inside = np.logical_and.reduceat(left, first[some]) & (sizes[some] >= 3)
        out[np.flatnonzero(some)[inside]] = 0.0
    return pa.array(out, mask=np.isnan(out))


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the area of a ring, 0 inside; the ring may be a single point or a line.

    In batches of numpy columns: a test of some ten sides per pair costs far less than as an expression over arrays.
    """
    return _ring_gap(ring, x, y)


def cluster_areas(members: DataFrame, centers: DataFrame, hull_radius: float, point_radius: float) -> DataFrame:
    """(cluster_id, ring, radius, n_members): hull of the members, or the centre alone for fewer than three of them.

    The area meant is everything nearer to the ring than the radius.
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_members"))
    hull = convex_hulls(members, "cluster_id", "location_id")
    middle = F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))
    enough = F.col("n_members") >= 3
    joined = centers.select("cluster_id", "lat", "lon").join(sizes, "cluster_id").join(hull, "cluster_id")
    return joined.select(
        "cluster_id", F.when(enough, F.col("ring")).otherwise(middle).alias("ring"),
        F.when(enough, hull_radius).otherwise(point_radius).alias("radius"), "n_members",
    )


def widened(areas: DataFrame, degrees: float) -> DataFrame:
    return areas.withColumn("radius", F.col("radius") + degrees)


def points_in_areas(points: DataFrame, key: str, areas: DataFrame, cell: float = 0.02) -> DataFrame:
    """(cluster_id, key, lat, lon) of the points inside each area: cells of the area's box, the box, then the exact test.

    Cells double in size until an area's box has at most about eight of them per side, so a wide area costs no more cells than a
    small one; a point is looked up once per size in use.
    """
    values = lambda axis: F.transform("ring", lambda p: p[axis])
    low = {a: F.array_min(values(a)) - F.col("radius") for a in "xy"}
    high = {a: F.array_max(values(a)) + F.col("radius") for a in "xy"}
    side = F.greatest(*[high[a] - low[a] for a in "xy"])
    sized = areas.withColumn("_level", F.greatest(F.ceil(F.log2(side / (8 * cell))), F.lit(0)).cast("int"))
    width = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    boxes = sized
    for a in "xy":
        boxes = boxes.withColumns({f"_low{a}": low[a], f"_high{a}": high[a]})
        boxes = boxes.withColumn(f"_{a}", F.explode(F.sequence(F.floor(low[a] / width), F.floor(high[a] / width))))
    levels = sorted(r["_level"] for r in sized.select("_level").distinct().collect()) or [0]  # a row per size
    placed = points.select(key, "lat", "lon", F.explode(F.array(*map(F.lit, levels))).alias("_level"))
    placed = placed.withColumns({"_x": F.floor(F.col("lon") / width), "_y": F.floor(F.col("lat") / width)})
    at = ["_level", "_x", "_y"]
    near = spread(placed, *at).join(spread(boxes, *at).hint("merge"), at)  # the exact test costs much per row, so all tasks share it
    for a, c in (("x", "lon"), ("y", "lat")):
        near = near.where(F.col(c).between(F.col(f"_low{a}") - 1e-9, F.col(f"_high{a}") + 1e-9))
    return near.where(ring_distance(F.col("ring"), F.col("lon"), F.col("lat")) < F.col("radius")).select("cluster_id", key, "lat", "lon")
