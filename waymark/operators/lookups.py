"""Filters, projections and joins over locations, links, clusters, presets and checkpoints."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.streets import cluster_name, has_suffix, normalize_street, street_stem
from waymark.operators import grid
from waymark.session import cut, cut_and_measure

FINEST_BOX = 1e-6  # degrees: boxes of a search for the nearest sites are not halved below it

ADDRESS = ["street", "neighborhood", "development", "city", "postcode", "country"]


# ---- predicates and projections -------------------------------------------------------------------------------


def find_by_coordinates(points: DataFrame, loc: DataFrame, tol: float = geo.COORDINATE_TOLERANCE) -> DataFrame:
    """Every point with the lowest location inside the tolerance, null if there is none."""
    found = grid.first_within(points, loc, "location_id", tol)
    return points.join(found, ["lat", "lon"], "left")


def count_in_box(centers: DataFrame, key: str, loc: DataFrame, half_width: float) -> DataFrame:
    """Locations inside the box around every center, from counts of cells: no pair is built for a location well inside."""
    places = loc.groupBy("lat", "lon").agg(F.count("*").alias("n_inside"))
    counts = grid.box_sums(centers, places, half_width, "n_inside")
    return centers.select(key, "lat", "lon").join(counts, ["lat", "lon"], "left").select(key, F.coalesce("n_inside", F.lit(0)).alias("n_inside"))


def search(loc: DataFrame, terms: list[str]) -> DataFrame:
    """Rows whose street, neighborhood or development holds a term of at least three letters, any case."""
    usable = [t for t in terms if len(t) >= 3]
    text = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("street", "neighborhood", "development")]

    def holds(term: Column) -> Column:
        return F.contains(text[0], term) | F.contains(text[1], term) | F.contains(text[2], term)

    listed = F.array(*[F.lit(t.lower()) for t in usable])
    return loc.select("*", F.explode(F.filter(listed, holds)).alias("term"))


def pattern_matches(loc: DataFrame, pattern: str) -> DataFrame:
    return loc.where(F.contains(F.lower("street"), F.lit(pattern.lower())) & (F.col("street") != ""))


def ieq(a, b) -> Column:
    """Equality that ignores case."""
    return F.lower(geo.col(a)) == F.lower(geo.col(b))


def destinations(pl: DataFrame) -> DataFrame:
    return pl.where(~F.coalesce("is_warehouse", F.lit(False)))


def warehouses(pl: DataFrame) -> DataFrame:
    return pl.where("is_warehouse")


def others(df: DataFrame, key: str, excluded: DataFrame, text: str) -> DataFrame:
    """Rows with non-empty text whose key is not excluded."""
    return df.where((F.col(text) != "") & F.col(text).isNotNull()).join(excluded.select(key), key, "left_anti")


def at_warehouse(pl: DataFrame, loc: DataFrame) -> DataFrame:
    """Destinations of every preset with a flag: lies on the preset's warehouse."""
    place = loc.select("location_id", "lat", "lon")
    depot = warehouses(pl).join(place, "location_id").select("preset_id", F.col("lat").alias("w_lat"), F.col("lon").alias("w_lon"))
    flag = F.coalesce(geo.near_equal("lat", "lon", "w_lat", "w_lon"), F.lit(False))
    return destinations(pl).join(place, "location_id").join(depot, "preset_id", "left").select(
        "preset_id", "location_id", flag.alias("at_warehouse")
    )


def with_defaults(loc: DataFrame, lc: DataFrame, cl: DataFrame) -> DataFrame:
    """Display rows: empty text for missing address parts, a name for every cluster, [0, 0] for a missing centroid."""
    joined = loc.join(lc, "location_id", "left").join(cl, "cluster_id", "left")
    number = F.coalesce(F.col("cluster_id").cast("string"), F.lit("unknown"))
    return joined.select(
        "location_id",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("street", "neighborhood", "development", "city")],
        F.coalesce("name", F.concat(F.lit("Cluster "), number)).alias("cluster_name"),
        F.coalesce("centroid_lat", F.lit(0.0)).alias("centroid_lat"),
        F.coalesce("centroid_lon", F.lit(0.0)).alias("centroid_lon"),
    )


def checkpoint_view(cp: DataFrame) -> DataFrame:
    return cp.select(
        F.col("checkpoint_id").alias("id"), "lat", "lon",
        F.col("from_road_type").alias("from_type"), F.col("to_road_type").alias("to_type"), "confidence",
    )


def split_valid(rows: DataFrame, lat: str = "lat", lon: str = "lon") -> tuple[DataFrame, DataFrame]:
    """(rows with numeric coordinates, the rest)."""
    parsed = rows.withColumns({lat: F.col(lat).try_cast("double"), lon: F.col(lon).try_cast("double")})
    ok = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return parsed.where(ok), parsed.where(~ok)


def checkpoints_for(cp: DataFrame, keys: DataFrame, key: str = "cluster_id") -> DataFrame:
    return cp.join(keys.select(key), key, "left_semi")


# ---- joins ----------------------------------------------------------------------------------------------------


def cluster_members(loc: DataFrame, lc: DataFrame) -> DataFrame:
    return loc.join(lc, "location_id")


def all_locations(loc: DataFrame, lc: DataFrame) -> DataFrame:
    return loc.join(lc, "location_id", "left")


def clusters_by_street(loc: DataFrame, lc: DataFrame, cl: DataFrame) -> DataFrame:
    """One cluster per lower-case street: that of the lowest clustered location there."""
    known = cluster_members(loc.where(F.col("street") != "").select("location_id", "street"), lc).join(cl.select("cluster_id", "name"), "cluster_id")
    return known.groupBy(F.lower("street").alias("street_key")).agg(
        F.min_by(F.struct("cluster_id", "name"), "location_id").alias("c"), F.count("*").alias("n_clustered")
    ).select("street_key", "c.cluster_id", F.col("c.name").alias("cluster_name"), "n_clustered")


def street_patterns(loc: DataFrame, lc: DataFrame) -> DataFrame:
    """Registered stems: one cluster per stem, the lowest."""
    stems = cluster_members(loc.select("location_id", street_stem(normalize_street("street")).alias("stem_pattern")), lc)
    return stems.where(F.col("stem_pattern") != "").groupBy("stem_pattern").agg(F.min("cluster_id").alias("cluster_id"))


def exact_street_match(loc: DataFrame, lc: DataFrame, cl: DataFrame) -> DataFrame:
    """Unclustered locations with the cluster of an equal street, any case."""
    free = loc.select("location_id", "street").where(F.col("street") != "").join(lc, "location_id", "left_anti")
    return free.withColumn("street_key", F.lower("street")).join(clusters_by_street(loc, lc, cl), "street_key").select(
        "location_id", "cluster_id", "cluster_name"
    )


def stem_match(loc: DataFrame, patterns: DataFrame, cl: DataFrame) -> DataFrame:
    """Locations whose suffixed street has a registered stem, with that stem's cluster."""
    normal = normalize_street("street")
    suffixed = loc.where(has_suffix(normal)).select("location_id", street_stem(normal).alias("stem_pattern"))
    return suffixed.join(patterns, "stem_pattern").join(cl.select("cluster_id", F.col("name").alias("cluster_name")), "cluster_id")


def preset_warehouses(pl: DataFrame, loc: DataFrame) -> DataFrame:
    return warehouses(pl).select("preset_id", "location_id").join(loc, "location_id")


def preset_destinations(pl: DataFrame, loc: DataFrame, lc: DataFrame, cl: DataFrame) -> DataFrame:
    return (
        destinations(pl).select("preset_id", "location_id").join(loc, "location_id")
        .join(lc, "location_id", "left").join(cl.select("cluster_id", F.col("name").alias("cluster_name")), "cluster_id", "left")
    )


def non_warehouse_locations(loc: DataFrame, pl: DataFrame, lc: DataFrame, cl: DataFrame) -> DataFrame:
    """Each location once with its optional cluster, without those that are the warehouse of any preset."""
    return (
        loc.join(warehouses(pl), "location_id", "left_anti")
        .join(lc, "location_id", "left").join(cl.select("cluster_id", F.col("name").alias("cluster_name")), "cluster_id", "left")
    )


def preset_clusters(pl: DataFrame, lc: DataFrame, cl: DataFrame) -> DataFrame:
    return pl.select("preset_id", "location_id").join(lc, "location_id").select("preset_id", "cluster_id").distinct().join(cl, "cluster_id")


def checkpoints_with_cluster(cp: DataFrame, cl: DataFrame) -> DataFrame:
    named = cp.join(cl.select("cluster_id", F.col("name").alias("cluster_name")), "cluster_id")
    return named.orderBy("cluster_id", "checkpoint_id")


def clustered_sites(loc: DataFrame, lc: DataFrame) -> DataFrame:
    """One row per coordinate: lowest location, number of locations, of clustered ones, lowest cluster."""
    linked = loc.select("location_id", "lat", "lon").join(lc, "location_id", "left")
    return grid.sites(linked, "location_id", F.count("cluster_id").alias("n_clustered"), F.min("cluster_id").alias("cluster_id"))


def nearby(loc: DataFrame, lc: DataFrame, radius: float = 0.002) -> DataFrame:
    """Sites of clustered locations in the box around every site, with the squared distance in degrees.

    Locations at one coordinate share their neighbours, so the pairs are between coordinates, not between rows;
    ``neighbour_count`` says how many clustered locations stand there (for the site itself: besides one of its own).
    """
    s = clustered_sites(loc, lc)
    return _neighbours(grid.box_pairs(s.select("location_id", "lat", "lon", "copies"), s.where("n_clustered > 0"), radius))


def _neighbours(pairs: DataFrame) -> DataFrame:
    same = F.col("location_id") == F.col("t_location_id")
    return pairs.where(~same | (F.col("copies") > 1)).select(
        "location_id",
        F.col("t_location_id").alias("neighbour_id"),
        F.when(same, F.col("t_n_clustered") - 1).otherwise(F.col("t_n_clustered")).alias("neighbour_count"),
        F.col("t_cluster_id").alias("neighbour_cluster"),
        geo.degree_distance_sq("lat", "lon", "t_lat", "t_lon").alias("distance_sq"),
    )


def neighbour_counts(loc: DataFrame, lc: DataFrame, radius: float = 0.002) -> DataFrame:
    """(location_id, n_neighbours): per site the clustered locations in the box around it, besides one of its own; sites with none are left out."""
    s = cut(clustered_sites(loc, lc))
    counts = grid.box_sums(s, s.where("n_clustered > 0").select("lat", "lon", "n_clustered"), radius, "n_clustered")
    own = F.when(F.col("own") > 0, 1).otherwise(0)
    joined = s.select("location_id", "lat", "lon", F.col("n_clustered").alias("own")).join(counts, ["lat", "lon"])
    return joined.select("location_id", (F.col("n_clustered") - own).alias("n_neighbours")).where("n_neighbours > 0")


def nearest_k(loc: DataFrame, lc: DataFrame, k: int, radius: float = 0.002) -> DataFrame:
    """The k nearest neighbour sites of every site inside the box, nearest first.

    A box is halved while more than ``16 * k`` sites lie in it and k besides the site itself still do. The k nearest are then no
    farther than its corner, so only the sites in the box as wide as that are ranked, not all of a crowded box.
    """
    s = cut(clustered_sites(loc, lc))
    t = s.where("n_clustered > 0")
    open_, half, parts = s, radius, []
    while True:
        counts = grid.box_sums(open_, t.select("lat", "lon", F.lit(1).cast("bigint").alias("n_sites")), half, "n_sites")
        asked, seen = cut_and_measure(open_.join(counts, ["lat", "lon"]), many=F.count_if(F.col("n_sites") > 16 * k))
        wide = min(2 * half * math.sqrt(2) * (1 + 1e-9), radius)  # the box before still held k others
        done = asked.where(F.col("n_sites") <= 16 * k) if half > FINEST_BOX else asked
        enough = done.where(F.col("n_sites") > k)
        few = done.where(F.col("n_sites") <= k)
        for rows, reach in ((enough, min(half * math.sqrt(2) * (1 + 1e-9), radius)), (few, wide if half < radius else radius)):
            parts.append(grid.box_pairs(rows.select("location_id", "lat", "lon", "copies"), t, reach).where(geo.in_box("t_lat", "t_lon", "lat", "lon", radius)))
        if not seen["many"] or half <= FINEST_BOX:
            break
        open_, half = asked.where(F.col("n_sites") > 16 * k).drop("n_sites"), half / 2
    pairs = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("location_id").orderBy("distance_sq", "neighbour_id")
    return _neighbours(pairs).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cluster_centers(loc: DataFrame, lc: DataFrame, cl: DataFrame) -> DataFrame:
    """Mean coordinate and number of the members of every cluster that has any."""
    means = lc.join(loc.select("location_id", "lat", "lon"), "location_id").groupBy("cluster_id").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("location_count")
    )
    return means.join(cl.select("cluster_id", "name"), "cluster_id")


def nearest_center(points: DataFrame, key: str, centers: DataFrame) -> DataFrame:
    return grid.nearest(points, key, centers, "cluster_id")


def street_peers(loc: DataFrame, lc: DataFrame, column: str = "street") -> DataFrame:
    """For every location with text: how many others share it, and the lowest other clustered one with its cluster.

    The two lowest clustered members per text are enough to leave out the location itself, so no pairs are built.
    """
    linked = loc.where(F.col(column) != "").select("location_id", column).join(lc, "location_id", "left")
    entry = F.struct("location_id", "cluster_id")
    clustered = F.col("cluster_id").isNotNull()
    first = linked.groupBy(column).agg(F.count("*").alias("n"), F.min(F.when(clustered, entry)).alias("first"))
    second = (
        linked.where(clustered).join(first.select(column, F.col("first.location_id").alias("f")), column)
        .where(F.col("location_id") != F.col("f")).groupBy(column).agg(F.min(entry).alias("second"))
    )
    peer = F.when(F.col("first.location_id") == F.col("location_id"), F.col("second")).otherwise(F.col("first"))
    return linked.select("location_id", column).join(first, column).join(second, column, "left").select(
        "location_id", (F.col("n") - 1).alias("n_peers"), peer["location_id"].alias("peer_id"), peer["cluster_id"].alias("peer_cluster")
    )


def join_by_coord_key(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Equi join on the coordinate text; columns of ``b`` get the prefix ``t_``."""
    left = a.withColumn("coord_key", geo.coord_key("lat", "lon", digits))
    right = grid.prefixed(b, "t_").withColumn("coord_key", geo.coord_key("t_lat", "t_lon", digits))
    return left.join(right, "coord_key")


def cluster_at(points: DataFrame, loc: DataFrame, lc: DataFrame) -> DataFrame:
    """Cluster of the lowest linked location at exactly the same coordinate; null if none."""
    at = loc.select("location_id", "lat", "lon").join(lc, "location_id").groupBy("lat", "lon").agg(F.min_by("cluster_id", "location_id").alias("cluster_id"))
    return points.join(at, ["lat", "lon"], "left")


def missing(required: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(covered, keys, "left_anti")


def required_clusters(pl: DataFrame, lc: DataFrame) -> DataFrame:
    """(preset_id, cluster_id) of the clusters in which a preset has destinations."""
    return destinations(pl).select("preset_id", "location_id").join(lc, "location_id").select("preset_id", "cluster_id").distinct()


def covering_checkpoints(cp: DataFrame, required: DataFrame) -> DataFrame:
    return checkpoints_for(cp, required)


def pair_ends(pairs: DataFrame) -> DataFrame:
    """Two rows per dynamic pair: its pickup and its drop-off."""
    def end(name: str) -> DataFrame:
        return pairs.select("pair_id", F.lit(name).alias("role"), F.col(f"{name}_lat").alias("lat"), F.col(f"{name}_lon").alias("lon"))

    return end("pickup").unionByName(end("dropoff"))


def candidate_checkpoints(pairs: DataFrame, cp: DataFrame) -> DataFrame:
    """Candidate checkpoints of both ends of pairs whose ends carry clusters; null ids if a cluster has none."""
    ends = pairs.select(
        "pair_id",
        F.explode(F.array(
            F.struct(F.lit("pickup").alias("role"), F.col("pickup_cluster").alias("cluster_id")),
            F.struct(F.lit("dropoff").alias("role"), F.col("dropoff_cluster").alias("cluster_id")),
        )).alias("e"),
    ).select("pair_id", "e.*")
    return ends.join(cp.select("cluster_id", "checkpoint_id", "lat", "lon"), "cluster_id", "left")


def stops_to_points(stops: DataFrame, places: DataFrame, depots: DataFrame) -> DataFrame:
    """Stop indexes of routes as coordinates, with the depot before the first and after the last stop.

    An index without a place is dropped. ``stops``: route_id, seq, stop; ``places``: stop, lat, lon; ``depots``: route_id, lat, lon.
    """
    middle = stops.join(places, "stop").select("route_id", "seq", "lat", "lon", F.lit("stop").alias("type"))
    last = stops.groupBy("route_id").agg((F.max("seq") + 1).alias("end"))
    ends = depots.join(last, "route_id").select(
        "route_id", F.explode(F.array(F.lit(0).cast("bigint"), F.col("end").cast("bigint"))).alias("seq"), "lat", "lon", F.lit("depot").alias("type")
    )
    return middle.unionByName(ends)


def runs_by_id(runs: DataFrame, ids: DataFrame) -> DataFrame:
    return runs.join(ids.select("run_id"), "run_id")


def new_cluster_names(loc: DataFrame) -> DataFrame:
    return loc.select("location_id", cluster_name("street").alias("cluster_name"))
