"""Density clustering of points: points closer than eps to a core point share its group."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators.components import components
from waymark.session import cut_large as cut, cut_large_and_measure as cut_and_measure

FINE = 4  # a cell edge is cut into this many parts for the search of linked cells
FEW_PAIRS = 64  # of points of two parts, which are compared at once


def _gap_sq(a: str, b: str, axes: list[str]) -> Column:
    total = F.lit(0.0)
    for n in axes:
        d = F.col(f"{a}{n}") - F.col(f"{b}{n}")
        total = total + d * d
    return total


def _around(df: DataFrame, cells: list[str], to: list[str], reach: int) -> DataFrame:
    """Copy every row to all cells at most ``reach`` steps away."""
    for c, n in zip(cells, to):
        df = df.withColumn(n, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach)))
    return df


def _linked_cells(pairs: DataFrame, placed: DataFrame, axes: list[str], edge: float, eps: float, close: Callable[[str, str], Column]) -> DataFrame:
    """The pairs (cell_id, o_cell) of cells of which two points are close.

    Cells are split into parts, each spoken for by one of its points: a close pair of these links the cells, and parts too far apart for any
    pair are dropped. Where neither decides, parts of few points are compared exactly and the others are split in halves again, so two
    crowded cells cost about as many rows as parts lie at the distance ``eps``, not the product of their points.
    """
    step, last = edge / FINE, edge / 2**30  # parts as small as the last step are as exact as their coordinates
    split = lambda to: F.concat_ws(":", *[F.floor(F.col(a) / to) for a in axes])
    speaker = [F.count("*").alias("n"), F.min_by(F.struct(*axes), "site").alias("p")]
    as_other = [F.col("n").alias("o_n"), *[F.col(a).alias(f"o{a}") for a in axes]]
    parts = placed.groupBy("cell_id", split(step).alias("fine")).agg(*speaker).select("cell_id", "fine", "n", "p.*")
    other = parts.select(F.col("cell_id").alias("o_cell"), F.col("fine").alias("o_fine"), *as_other)
    asked, links = pairs.join(parts, "cell_id").join(other, "o_cell"), []
    while True:
        near = _gap_sq("", "o", axes) <= (eps + 2 * step * math.sqrt(len(axes))) ** 2
        met = cut(asked.where(near).select("cell_id", "fine", "n", "o_cell", "o_fine", "o_n", close("", "o").alias("linked")))
        sure = met.where("linked").select("cell_id", "o_cell").distinct()
        few = (F.col("n") * F.col("o_n") <= FEW_PAIRS) | F.lit(step <= last)
        open_, seen = cut_and_measure(met.join(sure, ["cell_id", "o_cell"], "left_anti").withColumn("few", few), crowded=F.count_if(~few))
        at = placed.withColumn("fine", split(step))
        to = at.select(F.col("cell_id").alias("o_cell"), F.col("fine").alias("o_fine"), *[F.col(a).alias(f"o{a}") for a in axes])
        checked = open_.where("few").join(at, ["cell_id", "fine"]).join(to, ["o_cell", "o_fine"]).where(close("", "o"))
        links += [sure, checked.select("cell_id", "o_cell")]
        if not seen["crowded"]:
            return reduce(DataFrame.unionByName, links).distinct()
        parts = placed.groupBy("cell_id", split(step).alias("fine"), split(step / 2).alias("finer")).agg(*speaker).select("cell_id", "fine", "finer", "n", "p.*")
        other = parts.select(F.col("cell_id").alias("o_cell"), F.col("fine").alias("o_fine"), F.col("finer").alias("o_finer"), *as_other)
        crowded = open_.where("not few").select("cell_id", "fine", "o_cell", "o_fine")
        asked = crowded.join(parts, ["cell_id", "fine"]).join(other, ["o_cell", "o_fine"]).drop("fine", "o_fine").withColumnsRenamed({"finer": "fine", "o_finer": "o_fine"})
        step /= 2


def density_groups(
    points: DataFrame,
    key: str,
    eps_m: float,
    min_samples: int = 1,
    by: list[str] | None = None,
    planar: bool = False,
) -> DataFrame:
    """(by..., key, group_id, is_noise): the group is named by its lowest core key; noise points stay alone.

    ``planar=False``: great-circle distance <= eps. ``planar=True``: straight distance in degrees < eps / 111000.
    Equal coordinates collapse to one site first, numbered once and written. Cells are so small that all points of one cell are neighbours,
    so a crowded cell needs no pairs: its points are core by count, and the components run over cells.
    """
    by = by or []
    eps = geo.metres_to_degrees(eps_m) if planar else geo.chord_km(eps_m / 1000)
    coords = [F.col("lat"), F.col("lon")] if planar else geo.unit_xyz("lat", "lon")
    dims = len(coords)
    axes = [f"_a{i}" for i in range(dims)]
    cells = [f"_c{i}" for i in range(dims)]
    edge = eps / math.sqrt(dims) * (1 - 1e-9)
    reach = math.ceil(math.sqrt(dims) + 1e-9)
    limit = eps * eps

    def close(a: str, b: str) -> Column:
        return _gap_sq(a, b, axes) < limit if planar else _gap_sq(a, b, axes) <= limit * (1 + 1e-12)

    site = cut(
        points.groupBy(*by, "lat", "lon")
        .agg(F.min(key).alias("first"), F.count("*").alias("copies"))
        .withColumn("site", F.monotonically_increasing_id())
        .withColumns(dict(zip(axes, coords)))
        .withColumns({c: F.floor(F.col(a) / edge) for c, a in zip(cells, axes)})
    )
    small = site.select(*by, "site", "first", "copies", *axes, *cells)
    near_cells = [f"n{c}" for c in cells]
    as_near = [F.col(c).alias(n) for c, n in zip(cells, near_cells)]
    as_other = [F.col(a).alias(f"o{a}") for a in axes]

    if min_samples <= 1:
        core = small
    else:
        weighed = small.join(small.groupBy(*by, *cells).agg(F.sum("copies").alias("crowd")), [*by, *cells])
        sparse = weighed.where(F.col("crowd") < min_samples)
        other = small.select(*by, *as_near, F.col("copies").alias("o_copies"), *as_other)
        counted = (
            _around(sparse, cells, near_cells, reach)
            .join(other, [*by, *near_cells])
            .where(close("", "o"))
            .groupBy("site")
            .agg(F.sum("o_copies").alias("seen"))
            .where(F.col("seen") >= min_samples)
        )
        dense = weighed.where(F.col("crowd") >= min_samples)
        core = dense.unionByName(sparse.join(counted.hint("merge"), "site", "left_semi")).drop("crowd")

    tagged = cut(core.join(core.groupBy(*by, *cells).agg(F.min("site").alias("cell_id")).hint("merge"), [*by, *cells]))
    cell = tagged.select(*by, *cells, "cell_id").distinct()
    pairs = (
        _around(cell, cells, near_cells, reach)
        .join(cell.select(*by, *as_near, F.col("cell_id").alias("o_cell")), [*by, *near_cells])
        .where("cell_id < o_cell")
        .select("cell_id", "o_cell")
    )
    links = cut(_linked_cells(pairs, tagged.select("cell_id", "site", *axes), axes, edge, eps, close))
    label = components(links, "cell_id", "o_cell").withColumnRenamed("node", "cell_id")
    labelled = tagged.join(label, "cell_id", "left").select("site", "first", F.coalesce("label", "cell_id").alias("label"))
    names = labelled.groupBy("label").agg(F.min("first").alias("group_id"))
    core_group = labelled.join(names.hint("merge"), "label").select("site", "group_id")
    if min_samples <= 1:
        grouped = core_group
    else:
        core_other = tagged.join(core_group, "site").select(*by, *as_near, *as_other, "group_id")
        border = (
            _around(small.join(tagged, "site", "left_anti"), cells, near_cells, reach)
            .join(core_other.hint("merge"), [*by, *near_cells])
            .where(close("", "o"))
            .groupBy("site")
            .agg(F.min("group_id").alias("group_id"))
        )
        grouped = core_group.unionByName(border)
    by_place = site.select(*by, "lat", "lon", "site").join(grouped, "site", "left").drop("site")
    return points.select(*by, key, "lat", "lon").join(by_place.hint("merge"), [*by, "lat", "lon"]).select(
        *by, key, F.coalesce("group_id", F.col(key)).alias("group_id"), F.col("group_id").isNull().alias("is_noise")
    )
