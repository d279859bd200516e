"""Aggregates, rankings and reports over locations, clusters, presets, checkpoints, routes and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.streets import section_identifier
from waymark.operators import grid, lookups, ranks
from waymark.operators.density import density_groups

# Fixed value: centre of the map if no preset has a warehouse.
DEFAULT_CENTER = (3.127993, 101.466972)
PAGE = 1000  # keys per nested page, so that no list grows with its group


# ---- presets, clusters, locations -------------------------------------------------------------------------------


def preset_sizes(presets: DataFrame, pl: DataFrame) -> DataFrame:
    """Number of locations per preset, 0 if it has none."""
    n = pl.groupBy("preset_id").agg(F.count("location_id").alias("n"))
    return presets.join(n, "preset_id", "left").withColumn("location_count", F.coalesce("n", F.lit(0))).drop("n")


def destination_counts(presets: DataFrame, pl: DataFrame) -> DataFrame:
    """Destinations per preset; a preset without any is not listed."""
    n = lookups.destinations(pl).groupBy("preset_id").agg(F.count("*").alias("destination_count"))
    return presets.join(n, "preset_id")


def shared_cluster_counts(loc: DataFrame, lc: DataFrame, column: str) -> DataFrame:
    """For every location: distinct clusters of the other locations with the same text in ``column``, any case."""
    text = loc.where(F.col(column) != "").select("location_id", F.lower(column).alias("text")).join(lc, "location_id", "left")
    per_cluster = text.where("cluster_id is not null").groupBy("text", "cluster_id").agg(F.count("*").alias("n"))
    per_text = per_cluster.groupBy("text").agg(F.count("*").alias("n_clusters"))
    alone = per_cluster.where("n = 1").select("text", "cluster_id", F.lit(1).alias("own"))
    joined = text.join(per_text, "text", "left").join(alone, ["text", "cluster_id"], "left")
    return joined.select("location_id", (F.coalesce("n_clusters", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("n_clusters"))


def clustering_stats(loc: DataFrame, lc: DataFrame) -> DataFrame:
    linked = loc.select("location_id").join(lc, "location_id", "left")
    return linked.agg(
        F.count("*").alias("total_locations"),
        F.countDistinct("cluster_id").alias("num_clusters"),
        F.count_if(F.col("cluster_id").isNull()).alias("noise_points"),
    )


def _paged(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Rows with the page of 1,000 that their position in the group falls into."""
    return ranks.position(rows, [group], key, "_pos").withColumn("page", F.floor((F.col("_pos") - 1) / PAGE)).drop("_pos")


def nested_by_cluster(loc: DataFrame, lc: DataFrame, cl: DataFrame) -> DataFrame:
    """Locations nested under their cluster or 'noise', in pages of 1,000 locations."""
    bucket = F.coalesce(F.col("cluster_id").cast("string"), F.lit("noise"))
    rows = _paged(loc.select("location_id", "lat", "lon", "street").join(lc, "location_id", "left").withColumn("bucket", bucket), "bucket", "location_id")
    pages = rows.groupBy("bucket", "cluster_id", "page").agg(
        F.sort_array(F.collect_list(F.struct("location_id", "lat", "lon", "street"))).alias("locations")
    )
    return pages.join(cl.select("cluster_id", F.col("name").alias("cluster_name")), "cluster_id", "left")


def common_section_nearby(points: DataFrame, key: str, loc: DataFrame, half_width: float = 0.003) -> DataFrame:
    """Most common section near each point and the most common subsection within it; ties by text."""
    named = loc.where(F.col("street") != "").select("lat", "lon", section_identifier("street").alias("s")).select("lat", "lon", "s.*")
    places = named.where("section is not null").groupBy("lat", "lon", "section", "subsection").agg(F.count("*").alias("n"))
    near = grid.box_pairs(points.select(key, "lat", "lon"), places, half_width)
    parts = near.groupBy(key, F.col("t_section").alias("section"), F.col("t_subsection").alias("subsection")).agg(F.sum("t_n").alias("n"))
    sections = parts.groupBy(key, "section").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("subsection").isNotNull(), F.struct((-F.col("n")).alias("n"), "subsection"))).alias("best"),
    )
    top = sections.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "section", "best")).alias("top"))
    return top.select(key, "top.section", F.col("top.best.subsection").alias("subsection"))


def common_neighborhood_nearby(points: DataFrame, key: str, loc: DataFrame, half_width: float = 0.003) -> DataFrame:
    places = loc.where((F.col("street") != "") & (F.col("neighborhood") != "")).groupBy("lat", "lon", "neighborhood").agg(F.count("*").alias("n"))
    near = grid.box_pairs(points.select(key, "lat", "lon"), places, half_width)
    counted = near.groupBy(key, F.col("t_neighborhood").alias("neighborhood")).agg(F.sum("t_n").alias("n"))
    top = counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "neighborhood")).alias("top"))
    return top.select(key, "top.neighborhood")


def preset_records(presets: DataFrame, pl: DataFrame, loc: DataFrame) -> DataFrame:
    """Preset with its warehouse coordinate (null if none) and pages of destination coordinates."""
    place = loc.select("location_id", "lat", "lon")
    depot = lookups.preset_warehouses(pl, place).groupBy("preset_id").agg(
        F.min_by(F.struct("lat", "lon"), "location_id").alias("warehouse")
    )
    pages = (
        _paged(lookups.destinations(pl).join(place, "location_id"), "preset_id", "location_id")
        .groupBy("preset_id", "page").agg(F.sort_array(F.collect_list(F.struct("location_id", "lat", "lon"))).alias("destinations"))
    )
    return presets.join(depot, "preset_id", "left").join(pages, "preset_id", "left")


def cluster_records(cl: DataFrame, cp: DataFrame) -> DataFrame:
    """Cluster with pages of its checkpoints; a cluster without checkpoints has one row with a null page."""
    pages = _paged(cp, "cluster_id", "checkpoint_id").groupBy("cluster_id", "page").agg(
        F.sort_array(F.collect_list(F.struct("checkpoint_id", "lat", "lon", "from_road_type", "to_road_type", "confidence"))).alias("checkpoints")
    )
    return cl.join(pages, "cluster_id", "left")


def latest_center(presets: DataFrame, pl: DataFrame, loc: DataFrame) -> DataFrame:
    """Warehouse coordinate of the newest preset, else the fixed centre."""
    latest = presets.agg(F.max(F.struct("created_at", "preset_id")).alias("p")).select("p.preset_id")
    at = latest.join(lookups.preset_warehouses(pl, loc), "preset_id").agg(F.min_by(F.struct("lat", "lon"), "location_id").alias("w"))
    lat, lon = DEFAULT_CENTER
    return at.select(F.coalesce("w.lat", F.lit(lat)).alias("lat"), F.coalesce("w.lon", F.lit(lon)).alias("lon"))


def furthest_member(loc: DataFrame, lc: DataFrame) -> DataFrame:
    """Per cluster the member furthest (in degrees) from the mean of the members; ties by lowest location."""
    members = lookups.cluster_members(loc.select("location_id", "lat", "lon"), lc)
    means = members.groupBy("cluster_id").agg(F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    far = members.join(means, "cluster_id").withColumn("degrees", geo.degree_distance("lat", "lon", "mean_lat", "mean_lon"))
    best = far.groupBy("cluster_id").agg(F.max(F.struct("degrees", (-F.col("location_id")).alias("o"), "lat", "lon")).alias("b"))
    return best.select("cluster_id", (-F.col("b.o")).alias("location_id"), "b.lat", "b.lon", "b.degrees")


# ---- checkpoints -------------------------------------------------------------------------------------------------


def first_checkpoint(cp: DataFrame) -> DataFrame:
    return cp.groupBy("cluster_id").agg(F.min_by(F.struct("checkpoint_id", "lat", "lon"), "checkpoint_id").alias("c")).select("cluster_id", "c.*")


def consolidate(cp: DataFrame, eps_m: float = 50, min_samples: int = 1) -> DataFrame:
    """(checkpoint_id, consolidated_id): checkpoints closer than eps merge; ids count the groups by first member."""
    groups = density_groups(cp, "checkpoint_id", eps_m, min_samples)
    numbered = ranks.position(groups.select("group_id").distinct(), [], "group_id", "consolidated_id")
    return groups.join(numbered, "group_id").select("checkpoint_id", "consolidated_id")


def consolidated_groups(cp: DataFrame, mapping: DataFrame) -> DataFrame:
    """Centre, size and number of clusters of every consolidated checkpoint; members stay in the mapping table."""
    joined = cp.join(mapping, "checkpoint_id")
    return joined.groupBy("consolidated_id").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("checkpoint_count"),
        F.countDistinct("cluster_id").alias("cluster_count"), F.min("checkpoint_id").alias("first_checkpoint"),
    )


def consolidated_clusters(cp: DataFrame, mapping: DataFrame) -> DataFrame:
    return cp.join(mapping, "checkpoint_id").select("consolidated_id", "cluster_id").distinct()


def first_consolidated(cp: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per cluster the consolidated id of its first checkpoint."""
    return cp.join(mapping, "checkpoint_id").groupBy("cluster_id").agg(F.min_by("consolidated_id", "checkpoint_id").alias("consolidated_id"))


def demand_by_checkpoint(demand: DataFrame, lc: DataFrame, cluster_to_checkpoint: DataFrame, *by) -> DataFrame:
    """Pickups (any case) and deliveries (everything else) per consolidated checkpoint.

    Demand is counted per location before it meets the links, so a busy location costs one row per task.
    """
    pickup = F.lower(F.coalesce("type", F.lit("delivery"))) == "pickup"
    keys = [b if isinstance(b, str) else b[0] for b in by]
    grouped = demand.groupBy("location_id", *[b if isinstance(b, str) else b[1].alias(b[0]) for b in by])
    per_location = grouped.agg(F.count_if(pickup).alias("p"), F.count_if(~pickup).alias("d"))
    return (
        per_location.join(lc, "location_id").join(cluster_to_checkpoint, "cluster_id")
        .groupBy("consolidated_id", *keys).agg(
            F.sum("p").alias("pickup_count"), F.sum("d").alias("delivery_count"), F.countDistinct("location_id").alias("location_count")
        )
    )


def unique_checkpoints(cp: DataFrame) -> DataFrame:
    """Checkpoints merged by 6-digit coordinate: the first id, its coordinate, and how many clusters it serves."""
    keyed = cp.withColumn("coord_key", geo.coord_key("lat", "lon"))
    return keyed.groupBy("coord_key").agg(
        F.min("checkpoint_id").alias("checkpoint_id"), F.min_by("lat", "checkpoint_id").alias("lat"),
        F.min_by("lon", "checkpoint_id").alias("lon"), F.countDistinct("cluster_id").alias("clusters_served"),
    )


# ---- roads and routes --------------------------------------------------------------------------------------------


def edge_ends(edges: DataFrame) -> DataFrame:
    """Every edge once per end, with the end as ``node_id``."""
    return edges.withColumn("node_id", F.explode(F.array("src", "dst")))


def common_road_types(edges: DataFrame) -> DataFrame:
    """The two most common road types at every node; ties by name; the second repeats the first if there is one only."""
    counted = edge_ends(edges).groupBy("node_id", F.coalesce("highway", F.lit("unknown")).alias("highway")).agg(F.count("*").alias("n"))
    ranked = counted.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "highway"))).alias("t"))
    return ranked.select(
        "node_id", F.col("t")[0]["highway"].alias("from_type"), F.coalesce(F.try_element_at("t", F.lit(2)), F.col("t")[0])["highway"].alias("to_type")
    )


def legs(route_stops: DataFrame, *columns: str) -> DataFrame:
    """Consecutive stops of every route with the distance between them."""
    pairs = ranks.consecutive(route_stops, ["route_id"], "seq", "lat", "lon", *columns)
    return pairs.withColumn("km", geo.arc_km("lat", "lon", "next_lat", "next_lon"))


def boundary_crossings(route_stops: DataFrame) -> DataFrame:
    """How often routes cross the border of a cluster at each of its nodes."""
    pairs = legs(route_stops, "checkpoint_id", "cluster_id").where("cluster_id <> next_cluster_id")
    ends = F.explode(F.array(F.struct("cluster_id", "checkpoint_id"), F.struct(F.col("next_cluster_id").alias("cluster_id"), F.col("next_checkpoint_id").alias("checkpoint_id"))))
    return pairs.select(ends.alias("e")).groupBy("e.cluster_id", "e.checkpoint_id").agg(F.count("*").alias("crossings"))


def top_per_group(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of every group; Spark cuts each task's groups to k rows before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def route_lengths(route_stops: DataFrame) -> DataFrame:
    return legs(route_stops).groupBy("run_id", "route_id").agg(F.sum("km").alias("distance_km"))


def run_totals(routes: DataFrame) -> DataFrame:
    return routes.groupBy("run_id").agg(F.sum("distance_km").alias("total_distance"), F.count("*").alias("n_routes"))


def compare_runs(runs: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Per run: distance, time, number of destinations, mean and longest route (0 without routes)."""
    per_run = routes.groupBy("run_id").agg(
        F.sum("distance_km").alias("total_distance"), F.avg("distance_km").alias("avg_route_length"), F.max("distance_km").alias("max_route_length")
    )
    places = stops.groupBy("run_id").agg(F.countDistinct("checkpoint_id").alias("locations_count"))
    joined = runs.join(per_run, "run_id", "left").join(places, "run_id", "left")
    return joined.select(
        "run_id", "computation_ms", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_distance", "avg_route_length", "max_route_length", "locations_count")]
    )


def coverage_report(stops: DataFrame, required: DataFrame) -> DataFrame:
    """Per run and cluster: distinct checkpoints (5 digits), routes that visit it, and Covered, Skipped or Unknown."""
    covered = stops.groupBy("run_id", "cluster_id").agg(
        F.countDistinct(geo.coord_key("lat", "lon", 5)).alias("n_checkpoints"), F.countDistinct("route_id").alias("n_routes")
    )
    lost = lookups.missing(required, covered, ["run_id", "cluster_id"]).select("run_id", "cluster_id", F.lit(True).alias("missing"))
    joined = covered.join(lost, ["run_id", "cluster_id"], "full_outer")
    status = F.when(F.col("missing"), "Skipped").when(F.col("n_checkpoints") > 0, "Covered").otherwise("Unknown")
    return joined.select(
        "run_id", "cluster_id", F.coalesce("n_checkpoints", F.lit(0)).alias("n_checkpoints"), F.coalesce("n_routes", F.lit(0)).alias("n_routes"), status.alias("status")
    )


def destination_centers(pl: DataFrame, loc: DataFrame, lc: DataFrame) -> DataFrame:
    """Mean coordinate of a preset's destinations per cluster."""
    members = lookups.destinations(pl).join(loc.select("location_id", "lat", "lon"), "location_id").join(lc, "location_id")
    return members.groupBy("preset_id", "cluster_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def history_summary(runs: DataFrame) -> DataFrame:
    """Runs per algorithm, vehicles and type with subtotals."""
    typed = runs.withColumn("test_type", F.coalesce("test_type", F.lit("static")))
    return typed.rollup("algorithm", "num_vehicles", "test_type").agg(
        F.count("*").alias("n_runs"), F.avg("total_distance").alias("avg_distance"), F.min("total_distance").alias("min_distance"),
        F.avg("computation_ms").alias("avg_ms"),
    )


def presets_newest_first(presets: DataFrame) -> DataFrame:
    return presets.orderBy(F.desc("created_at"), "preset_id")


def history(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)
