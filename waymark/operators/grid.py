"""Tolerance, box and nearest joins as equi joins on grid cells.

A predicate such as ``abs(a - b) < tol`` alone would plan as a nested loop over both tables. Here both sides get
the number of their grid cell, the cells are joined by hash or sort, and the exact predicate filters the result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.session import cut_large_lean as cut, cut_large_lean_and_measure as cut_and_measure


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def sites(df: DataFrame, key: str, *extra) -> DataFrame:
    """One row per distinct coordinate with the lowest key and the number of rows: copies collapse before a join."""
    return df.groupBy("lat", "lon").agg(F.min(key).alias(key), F.count("*").alias("copies"), *extra)


def box_pairs(points: DataFrame, targets: DataFrame, half_width: float, strict: bool = False) -> DataFrame:
    """Pairs whose coordinates differ by at most ``half_width`` degrees on both axes.

    Both inputs have ``lat`` and ``lon``; target columns come back with the prefix ``t_``. A point reaches at most
    two cells per axis, so it is copied at most four times; a target stays in its one cell.
    """
    cell = 2 * half_width

    def reach(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - half_width) / cell), F.floor((F.col(c) + half_width) / cell))

    left = points.withColumn("_x", F.explode(reach("lat"))).withColumn("_y", F.explode(reach("lon")))
    right = (
        prefixed(targets, "t_")
        .withColumn("_x", F.floor(F.col("t_lat") / cell))
        .withColumn("_y", F.floor(F.col("t_lon") / cell))
    )
    exact = (
        geo.near_equal("lat", "lon", "t_lat", "t_lon", half_width)
        if strict
        else geo.in_box("t_lat", "t_lon", "lat", "lon", half_width)
    )
    return left.join(right, ["_x", "_y"]).where(exact).drop("_x", "_y")


FINE = 20  # levels below the cell of a box count


def box_sums(points: DataFrame, targets: DataFrame, half_width: float, *sums: str) -> DataFrame:
    """(lat, lon, sums...) per distinct coordinate of ``points``: the columns of the targets in the inclusive box around it added up, 0 if there is none.

    Cells carry the sums and the bounds of their targets. A box takes a cell whole that lies inside, leaves out one that lies
    outside, reads one at its edge that has few targets, and opens a crowded one into its cells ``DESCENT`` levels below. So a box costs about as many rows as
    cells lie along its edge, however many targets it holds.
    """
    base = 2 * half_width / 2**FINE
    home = lambda c: F.floor(c / base)
    t = cut(targets.select(F.col("lat").alias("_tlat"), F.col("lon").alias("_tlon"), *sums).withColumns({"_hx": home(F.col("_tlat")), "_hy": home(F.col("_tlon"))}))
    p = cut(points.where("lat is not null and lon is not null").select("lat", "lon").distinct())
    cells = ["_cx", "_cy"]

    def at(df: DataFrame, level: int) -> DataFrame:
        return df.withColumns({c: F.call_function("shiftright", F.col(h), F.lit(level)) for c, h in zip(cells, ("_hx", "_hy"))})

    def boxes(level: int) -> DataFrame:
        spans = [f("_t" + c).alias(f"_{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))]
        return at(t, level).groupBy(*cells).agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in sums], *spans)

    ends = {c: (F.col(c) - half_width, F.col(c) + half_width) for c in ("lat", "lon")}
    apart = reduce(lambda a, b: a | b, [(F.col(f"_high_{c}") < lo) | (F.col(f"_low_{c}") > hi) for c, (lo, hi) in ends.items()])
    inside = reduce(lambda a, b: a & b, [(F.col(f"_low_{c}") >= lo) & (F.col(f"_high_{c}") <= hi) for c, (lo, hi) in ends.items()])
    reach = lambda c: F.explode(F.sequence(*[F.call_function("shiftright", home(e), F.lit(FINE)) for e in ends[c]]))
    level, found = FINE, []
    met = p.withColumn("_cx", reach("lat")).withColumn("_cy", reach("lon")).join(boxes(level), cells)
    while True:
        kind = F.when(inside, "whole").when((F.col("_n") <= CROWDED) | F.lit(level == 0), "read").otherwise("open")
        rows, seen = cut_and_measure(met.where(~apart).withColumn("_kind", kind).select("lat", "lon", *cells, "_n", *sums, "_kind"), open=F.count_if(F.col("_kind") == "open"))
        found.append(rows.where("_kind = 'whole'").select("lat", "lon", *sums))
        near = geo.in_box("_tlat", "_tlon", "lat", "lon", half_width)
        found.append(rows.where("_kind = 'read'").select("lat", "lon", *cells).join(at(t, level), cells).where(near).select("lat", "lon", *sums))
        if not seen["open"]:
            break
        below = max(level - DESCENT, 0)
        up = {b: F.call_function("shiftright", F.col(c), F.lit(level - below)) for b, c in zip(("_bx", "_by"), cells)}
        opened = rows.where("_kind = 'open'").select("lat", "lon", F.col("_cx").alias("_bx"), F.col("_cy").alias("_by"))
        met = opened.join(boxes(below).withColumns(up), ["_bx", "_by"])
        level = below
    total = reduce(DataFrame.unionByName, found).groupBy("lat", "lon").agg(*[F.sum(c).alias(c) for c in sums])
    return p.join(total, ["lat", "lon"], "left").select("lat", "lon", *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])


def first_within(points: DataFrame, targets: DataFrame, target_key: str, tol: float = geo.COORDINATE_TOLERANCE) -> DataFrame:
    """Distinct coordinates of ``points`` with the lowest target key inside the tolerance (no row if none)."""
    places = points.select("lat", "lon").distinct()
    pairs = box_pairs(places, sites(targets, target_key), tol, strict=True)
    return pairs.groupBy("lat", "lon").agg(F.min(f"t_{target_key}").alias(target_key))


def _around(df: DataFrame, cells: list[str]) -> DataFrame:
    """Copy every row to its own cell and those that touch it."""
    for c in cells:
        df = df.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return df


def _at_level(cells: list[str], level: str, names: list[str]) -> list[Column]:
    return [F.call_function("shiftright", F.col(c), F.col(level)).alias(n) for c, n in zip(cells, names)]


CROWDED = 8  # targets of a cell from which it is divided
FINEST = {True: 1e-6, False: 1e-4}  # edge of the finest cells: degrees on a plane, km on the sphere
STEP = 3  # levels that a crowded cell is divided at a time
DESCENT = 2  # levels between a cell that a search opens and the cells it meets there


def _start_level(targets: DataFrame, planar: bool) -> int:
    """Level whose cells are about as wide as the mean distance between neighbouring targets, from one small aggregate."""
    row = targets.agg(
        F.count("*").alias("n"), F.min("_tlat").alias("a"), F.max("_tlat").alias("b"), F.min("_tlon").alias("c"), F.max("_tlon").alias("d")
    ).first()
    degrees = 0.01
    if row["n"] and row["n"] > 1:
        degrees = max(math.sqrt(max(row["b"] - row["a"], 1e-4) * max(row["d"] - row["c"], 1e-4) / row["n"]), 1e-5)
    size = degrees if planar else math.radians(degrees) * geo.EARTH_KM
    return max(math.ceil(math.log2(size / FINEST[planar])), 0)


def nearest(
    points: DataFrame, point_key: str, targets: DataFrame, target_key: str, by: list[str] | None = None, planar: bool = False, within: float | None = None
) -> DataFrame:
    """The nearest target of every point: (by..., point_key, target_key, km), ties by lowest target key.

    Distance is great-circle ``km``, or with ``planar`` straight ``degrees``; ``by`` restricts the search to targets
    of the same group, ``within`` to those no farther away; a point without any has no row. Cells lie on a sphere, so
    neither poles nor the date line need care, and double per level.

    Copies at one coordinate, of points and of targets, are one place. Each occupied cell names one of its targets. Cells start at the
    mean spacing of the targets; crowded ones are divided until they hold few, wherever they lie. The named targets of the
    cells around a point bound its distance; only points without any are looked up on coarser levels. Then the point meets
    the cells around it that are just as wide as this bound. Cells carry the bounds of their targets: one that is farther than the nearest
    target named so far is closed, one with few targets is read, and a crowded one is replaced by its cells ``DESCENT`` levels
    below, which again are closed or opened. So a point far from a town opens only the cells on its near side, and a
    target is copied only to the levels that some point asks for. ``within`` is such a bound for all points, so none is looked for.
    """
    by = by or []
    t0 = cut(targets.groupBy(*by, F.col("lat").alias("_tlat"), F.col("lon").alias("_tlon")).agg(F.min(target_key).alias("_t")))
    p0 = cut(points.where("lat is not null and lon is not null").select(*by, "lat", "lon").distinct())
    base = FINEST[planar]
    top = max(math.ceil(math.log2((720 if planar else 2 * geo.EARTH_KM) / base)) + 1, 1)
    dims = "xy" if planar else "xyz"
    cells, home, block = ([f"_{kind}{d}" for d in dims] for kind in "chb")
    gap = geo.degree_distance if planar else geo.arc_km
    name = "degrees" if planar else "km"

    def home_cells(df: DataFrame, lat: str, lon: str) -> DataFrame:
        axes = [F.col(lat), F.col(lon)] if planar else geo.unit_xyz(lat, lon)
        return df.withColumns({n: F.floor(c / base) for n, c in zip(home, axes)})

    def on_levels(df: DataFrame, levels: list[int], *keep: str) -> DataFrame:
        leveled = df.withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
        return leveled.select(*by, *keep, "_level", *_at_level(home, "_level", cells))

    def occupied(df: DataFrame, levels: list[int]) -> DataFrame:
        return on_levels(df, levels, "_t", "_tlat", "_tlon").groupBy(*by, "_level", *cells).agg(F.count("*").alias("_n"), F.min(F.struct("_t", "_tlat", "_tlon")).alias("_named"))

    t, p = home_cells(t0, "_tlat", "_tlon"), home_cells(p0, "lat", "lon")

    def bounded(asked: DataFrame, named: DataFrame, on: list[int]) -> DataFrame:
        """Points with the distance to the nearest named target in the cells around them, on any of the levels."""
        around = _around(named.select(*by, "_level", *cells, "_named"), cells)
        met = on_levels(asked, on, "lat", "lon").join(around, [*by, "_level", *cells])
        return met.groupBy(*by, "lat", "lon").agg(F.min(gap("lat", "lon", "_named._tlat", "_named._tlon")).alias("_bound"))

    if within is None:
        start = min(_start_level(t0, planar), top)
        levels = list(range(start, min(start + 2, top) + 1))
        cover, seen = cut_and_measure(occupied(t, levels), crowded=F.count_if((F.col("_n") > CROWDED) & (F.col("_level") == start)))
        last, low = cover, start
        while seen["crowded"] and low > 0:
            crowded = last.where((F.col("_n") > CROWDED) & (F.col("_level") == low)).select(*by, *cells)
            finer = list(range(max(low - STEP, 0), low))
            inside = t.withColumns({c: F.call_function("shiftright", F.col(h), F.lit(low)) for c, h in zip(cells, home)}).join(crowded, [*by, *cells], "left_semi").drop(*cells)
            low = finer[0]
            last, seen = cut_and_measure(occupied(inside, finer), crowded=F.count_if((F.col("_n") > CROWDED) & (F.col("_level") == low)))
            cover, levels = cover.unionByName(last), finer + levels
        bound, seen = cut_and_measure(p.join(bounded(p, cover, levels), [*by, "lat", "lon"], "left"), open=F.count_if(F.col("_bound").isNull()))
        if seen["open"] and levels[-1] < top:
            coarser = list(range(levels[-1] + 1, top + 1))
            open_ = bound.where("_bound is null").drop("_bound")
            bound = cut(bound.where("_bound is not null").unionByName(open_.join(bounded(open_, occupied(t, coarser), coarser), [*by, "lat", "lon"])))
    else:
        bound = p.withColumn("_bound", F.lit(float(within)))
    wide = F.greatest(F.ceil(F.log2(F.greatest("_bound", F.lit(base)) * (1 + 1e-9) / base)), F.lit(0))
    level = F.least(wide, F.lit(top)).cast("int").alias("_level")
    placed = cut(bound.where("_bound is not null").select(*by, "lat", "lon", "_bound", *home, level).select(*by, "lat", "lon", "_bound", "_level", *_at_level(home, "_level", block)))
    ends = [(f"_low{d}", f"_high{d}") for d in dims]

    def boxes(on: list[int]) -> DataFrame:
        """Occupied cells with the bounds of their targets, their number and a named one."""
        axes = [F.col("_tlat"), F.col("_tlon")] if planar else geo.unit_xyz("_tlat", "_tlon")
        spans = [c for a, (lo, hi) in zip(axes, ends) for c in (F.min(a).alias(lo), F.max(a).alias(hi))]
        return on_levels(t, on, "_t", "_tlat", "_tlon").groupBy(*by, "_level", *cells).agg(F.count("*").alias("_n"), F.min(F.struct("_t", "_tlat", "_tlon")).alias("_named"), *spans)

    def open_only_near(met: DataFrame) -> DataFrame:
        """Of the cells that a point has met those whose bounds are no farther than the nearest target named so far."""
        axes = [F.col("lat"), F.col("lon")] if planar else geo.unit_xyz("lat", "lon")
        apart = [F.greatest(F.col(lo) - a, a - F.col(hi), F.lit(0.0)) for a, (lo, hi) in zip(axes, ends)]
        reach = F.col("_bound") if planar else F.sin(F.least(F.col("_bound") / (2 * geo.EARTH_KM), F.lit(math.pi / 2))) * (2 * geo.EARTH_KM)
        near = F.col("_apart") <= reach * (1 + 1e-9) + 1e-9
        told = F.min("_gap").over(Window.partitionBy(*by, "lat", "lon"))
        measured = met.withColumns({"_apart": F.sqrt(sum(x * x for x in apart)), "_gap": gap("lat", "lon", "_named._tlat", "_named._tlon")})
        kept = measured.where(near).select(*by, "lat", "lon", "_bound", "_level", *cells, "_n", "_apart", "_gap")  # the rest is not sorted by point
        return kept.withColumn("_bound", F.least("_bound", told)).where(near).drop("_apart", "_gap")

    def levels_of(df: DataFrame) -> list[int]:
        return sorted(r["_level"] for r in df.select("_level").distinct().collect())  # a row per level

    wanted = placed.select(*by, "_level", *block).distinct()
    asked = levels_of(wanted) or [0]
    around = _around(wanted.select("*", *[F.col(b).alias(c) for b, c in zip(block, cells)]), cells).join(boxes(asked), [*by, "_level", *cells])
    opened = open_only_near(placed.join(around, [*by, "_level", *block]))
    crowd = (F.col("_n") > CROWDED) & (F.col("_level") > 0)
    small = None
    while True:
        opened, seen = cut_and_measure(opened, crowded=F.count_if(crowd))
        done = opened.where(~crowd)
        small = done if small is None else small.unionByName(done)
        if not seen["crowded"]:
            break
        parents = opened.where(crowd).select(*by, "lat", "lon", "_bound", F.greatest(F.col("_level") - DESCENT, F.lit(0)).cast("int").alias("_level"), (F.col("_level") - F.greatest(F.col("_level") - DESCENT, F.lit(0))).cast("int").alias("_up"), *[F.col(c).alias(b) for b, c in zip(block, cells)])
        asked = levels_of(parents)
        inner = boxes(asked)  # each cell below its parent, which lies DESCENT levels up or, of the finest cells, less
        steps = parents.select("_level", "_up").distinct()  # a row per level
        inner = inner.join(F.broadcast(steps), "_level").withColumns({b: F.call_function("shiftright", F.col(c), F.col("_up")) for b, c in zip(block, cells)})
        opened = open_only_near(parents.join(inner, [*by, "_level", "_up", *block]))
    targets_of = on_levels(t, levels_of(small) or [0], "_t", "_tlat", "_tlon")
    best = (
        small.join(targets_of, [*by, "_level", *cells])
        .groupBy(*by, "lat", "lon")
        .agg(F.min(F.struct(gap("lat", "lon", "_tlat", "_tlon").alias("gap"), F.col("_t").alias("t"))).alias("best"))
    )
    if within is not None:
        best = best.where(F.col("best.gap") <= within)
    found = points.select(*by, point_key, "lat", "lon").join(best.hint("merge"), [*by, "lat", "lon"])
    return found.select(*by, point_key, F.col("best.t").alias(target_key), F.col("best.gap").alias(name))
