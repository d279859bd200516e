"""Registered queries of the aggregates (A), rankings (W), sorts (T) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import lookups, ranks, reports, roads
from waymark.plans import duck
from waymark.plans.catalog_lookups import pickups
from waymark.plans.registry import register
from waymark.session import cut_and_measure, spread


def _round(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@register(
    "a1_preset_sizes",
    "select preset_id, name, created_at, (select count(*) from preset_locations l where l.preset_id = p.preset_id) as location_count from presets p",
    "presets preset_locations",
)
def _(t):
    return reports.preset_sizes(t.presets, t.preset_locations)


@register(
    "a2_destination_counts",
    "select preset_id, name, created_at, count(*) as destination_count from presets join preset_locations using (preset_id) where not is_warehouse group by all",
    "presets preset_locations",
)
def _(t):
    return reports.destination_counts(t.presets, t.preset_locations)


@register(
    "a3_cluster_centers",
    "select cluster_id, name, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, count(*) as location_count from locations join location_clusters using (location_id) join clusters using (cluster_id) group by 1, 2",
    "locations location_clusters clusters",
)
def _(t):
    return _round(lookups.cluster_centers(t.locations, t.location_clusters, t.clusters), "lat", "lon")


def _shared(column):
    return f"""select a.location_id, count(distinct c.cluster_id) as n_clusters from locations a left join locations b on lower(a.{column}) = lower(b.{column}) and a.location_id <> b.location_id
 left join location_clusters c on c.location_id = b.location_id where a.{column} <> '' group by 1"""


@register("a4_shared_development_clusters", _shared("development"), "locations location_clusters")
def _(t):
    return reports.shared_cluster_counts(t.locations, t.location_clusters, "development")


@register("a4_shared_neighborhood_clusters", _shared("neighborhood"), "locations location_clusters")
def _(t):
    return reports.shared_cluster_counts(t.locations, t.location_clusters, "neighborhood")


@register(
    "a5_clustering_stats",
    "select count(*) as total_locations, count(distinct cluster_id) as num_clusters, count(*) - count(cluster_id) as noise_points from locations left join location_clusters using (location_id)",
    "locations location_clusters",
)
def _(t):
    return reports.clustering_stats(t.locations, t.location_clusters)


@register(
    "a6_nested_by_cluster",
    """select bucket, name as cluster_name, page, count(*) as n, string_agg(cast(location_id as varchar), ',' order by location_id) as ids from (
 select location_id, cluster_id, coalesce(cast(cluster_id as varchar), 'noise') as bucket, (row_number() over (partition by cluster_id order by location_id) - 1) // 1000 as page
 from locations left join location_clusters using (location_id)) left join clusters using (cluster_id) group by 1, 2, 3""",
    "locations location_clusters clusters",
)
def _(t):
    pages = reports.nested_by_cluster(t.locations, t.location_clusters, t.clusters)
    ids = F.array_join(F.transform("locations", lambda x: x["location_id"].cast("string")), ",")
    return pages.select("bucket", "cluster_name", "page", F.size("locations").cast("bigint").alias("n"), ids.alias("ids"))


_BOX = "on l.lat between p.pickup_lat - 3e-3 and p.pickup_lat + 3e-3 and l.lon between p.pickup_lon - 3e-3 and p.pickup_lon + 3e-3"


SECTIONS = f"""select pair_id, section, subsection from (select *, row_number() over (partition by pair_id order by total desc, section, (subsection is null), n desc, subsection) as r from (
 select pair_id, section, subsection, count(*) as n, sum(count(*)) over (partition by pair_id, section) as total from dynamic_pairs p join (
  select lat, lon, coalesce(nullif(upper(regexp_extract(street, '(?i)([A-Z]+[0-9]+)[/\\\\]([0-9]+)[A-Z]?', 1)), ''), nullif(upper(regexp_extract(street, '(?i)([A-Z]+[0-9]+)[^0-9]*$', 1)), '')) as section,
   nullif(regexp_extract(street, '(?i)([A-Z]+[0-9]+)[/\\\\]([0-9]+)[A-Z]?', 2), '') as subsection from locations where street <> '') l {_BOX} where section is not null group by 1, 2, 3)) where r = 1"""
AREAS = f"""select pair_id, neighborhood from (select *, row_number() over (partition by pair_id order by n desc, neighborhood) as r from (
 select pair_id, neighborhood, count(*) as n from dynamic_pairs p join locations l {_BOX} where street <> '' and neighborhood <> '' group by 1, 2)) where r = 1"""


@register("a7_common_section", SECTIONS, "locations dynamic_pairs")
def _(t):
    return reports.common_section_nearby(pickups(t), "pair_id", t.locations)


@register("a8_common_neighborhood", AREAS, "locations dynamic_pairs")
def _(t):
    return reports.common_neighborhood_nearby(pickups(t), "pair_id", t.locations)


@register(
    "a9_common_road_types",
    """select node_id, max(case when r = 1 then highway end) as from_type, coalesce(max(case when r = 2 then highway end), max(case when r = 1 then highway end)) as to_type from (
 select node_id, highway, row_number() over (partition by node_id order by count(*) desc, highway) as r from (
  select src as node_id, highway from road_edges union all select dst, highway from road_edges) group by 1, 2) group by 1""",
    "road_edges",
)
def _(t):
    return reports.common_road_types(t.road_edges)


_LEGS = "legs as (select a.*, b.checkpoint_id as next_checkpoint, b.cluster_id as next_cluster, {} as km from route_stops a join route_stops b on a.route_id = b.route_id and b.seq = a.seq + 1)".format(
    duck.hav("a.lat", "a.lon", "b.lat", "b.lon")
)
_CROSSINGS = """crossings as (select cluster_id, checkpoint_id, count(*) as crossings from (select cluster_id, checkpoint_id from legs where cluster_id <> next_cluster
 union all select next_cluster, next_checkpoint from legs where cluster_id <> next_cluster) group by 1, 2)"""


@register("a10_boundary_crossings", "select * from crossings", "route_stops", f"{_LEGS}, {_CROSSINGS}")
def _(t):
    return reports.boundary_crossings(t.route_stops)


_EPS = 0.05
MAPPING = f"""near as (select a.checkpoint_id as a, b.checkpoint_id as b from security_checkpoints a join security_checkpoints b
 on abs(a.lat - b.lat) < 1e-3 and abs(a.lon - b.lon) < 1e-3 and {duck.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {_EPS}),
 reach(a, b) as (select a, b from near union select r.a, n.b from reach r join near n on n.a = r.b),
 grouped as (select a as checkpoint_id, min(b) as group_id from reach group by 1),
 mapping as (select checkpoint_id, dense_rank() over (order by group_id) as consolidated_id from grouped)"""


def mapping(t):
    return reports.consolidate(t.security_checkpoints)


@register(
    "a11_consolidated_groups",
    """select consolidated_id, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, count(*) as checkpoint_count, count(distinct cluster_id) as cluster_count, min(checkpoint_id) as first_checkpoint
 from security_checkpoints join mapping using (checkpoint_id) group by 1""",
    "security_checkpoints",
    MAPPING,
    recursive=True,
)
def _(t):
    return _round(reports.consolidated_groups(t.security_checkpoints, mapping(t)), "lat", "lon")


_FIRST = """first_consolidated as (select cluster_id, arg_min(consolidated_id, checkpoint_id) as consolidated_id from security_checkpoints join mapping using (checkpoint_id) group by 1)"""


@register(
    "a12_demand_by_checkpoint",
    """select consolidated_id, cast(sum(case when lower(type) = 'pickup' then 1 else 0 end) as bigint) as pickup_count, cast(sum(case when lower(type) <> 'pickup' then 1 else 0 end) as bigint) as delivery_count,
 count(distinct location_id) as location_count from demand join location_clusters using (location_id) join first_consolidated using (cluster_id) group by 1""",
    "security_checkpoints demand location_clusters",
    f"{MAPPING}, {_FIRST}",
    recursive=True,
)
def _(t):
    first = reports.first_consolidated(t.security_checkpoints, mapping(t))
    return reports.demand_by_checkpoint(t.demand, t.location_clusters, first)


@register(
    "a13_unique_checkpoints",
    """select printf('%.6f,%.6f', lat, lon) as coord_key, min(checkpoint_id) as checkpoint_id, round(arg_min(lat, checkpoint_id), 6) as lat, round(arg_min(lon, checkpoint_id), 6) as lon,
 count(distinct cluster_id) as clusters_served from security_checkpoints group by 1""",
    "security_checkpoints",
)
def _(t):
    return _round(reports.unique_checkpoints(t.security_checkpoints), "lat", "lon")


_ROUTES = "routes as (select run_id, route_id, sum(km) as distance_km from legs group by 1, 2)"


def customer_runs(t):
    """One run per customer: its routes are the orders."""
    spent = t.orders.groupBy("o_custkey").agg(F.sum((F.col("o_orderkey") % 900).cast("double")).alias("computation_ms"))
    return t.customer.select(F.col("c_custkey").alias("run_id")).join(spent.withColumnRenamed("o_custkey", "run_id"), "run_id", "left")


@register(
    "a14_compare_runs",
    """select c_custkey as run_id, computation_ms, round(coalesce(total_distance, 0), 6) as total_distance, round(coalesce(avg_len, 0), 6) as avg_route_length, round(coalesce(max_len, 0), 6) as max_route_length,
 coalesce(n, 0) as locations_count from customer left join (select o_custkey, sum(cast(o_orderkey % 900 as double)) as computation_ms from orders group by 1) o on o_custkey = c_custkey
 left join (select run_id, sum(distance_km) as total_distance, avg(distance_km) as avg_len, max(distance_km) as max_len from routes group by 1) r on r.run_id = c_custkey
 left join (select run_id, count(distinct checkpoint_id) as n from route_stops group by 1) s on s.run_id = c_custkey""",
    "route_stops",
    f"{_LEGS}, {_ROUTES}",
)
def _(t):
    rows = reports.compare_runs(customer_runs(t), reports.route_lengths(t.route_stops), t.route_stops)
    return _round(rows, "total_distance", "avg_route_length", "max_route_length")


@register("a15_run_totals", "select run_id, round(sum(distance_km), 6) as total_distance, count(*) as n_routes from routes group by 1", "route_stops", f"{_LEGS}, {_ROUTES}")
def _(t):
    return _round(reports.run_totals(reports.route_lengths(t.route_stops)), "total_distance")


@register(
    "a16_coverage_report",
    """select coalesce(c.run_id, m.run_id) as run_id, coalesce(c.cluster_id, m.cluster_id) as cluster_id, coalesce(n_checkpoints, 0) as n_checkpoints, coalesce(n_routes, 0) as n_routes,
 case when m.run_id is not null then 'Skipped' when n_checkpoints > 0 then 'Covered' else 'Unknown' end as status from (
 select run_id, cluster_id, count(distinct printf('%.5f,%.5f', lat, lon)) as n_checkpoints, count(distinct route_id) as n_routes from route_stops group by 1, 2) c
 full join (select location_id as run_id, cluster_id from location_clusters where not exists (select 1 from route_stops r where r.run_id = location_id and r.cluster_id = location_clusters.cluster_id)) m
 on c.run_id = m.run_id and c.cluster_id = m.cluster_id""",
    "route_stops location_clusters",
)
def _(t):
    return reports.coverage_report(t.route_stops, t.location_clusters.withColumnRenamed("location_id", "run_id"))


@register(
    "a17_destination_centers",
    "select preset_id, cluster_id, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon from preset_locations join locations using (location_id) join location_clusters using (location_id) where not is_warehouse group by 1, 2",
    "preset_locations locations location_clusters",
)
def _(t):
    return _round(reports.destination_centers(t.preset_locations, t.locations, t.location_clusters), "lat", "lon")


@register(
    "a18_history_summary",
    """select algorithm, num_vehicles, test_type, count(*) as n_runs, round(avg(total_distance), 6) as avg_distance, min(total_distance) as min_distance, round(avg(computation_ms), 6) as avg_ms
 from (select algorithm, num_vehicles, coalesce(test_type, 'static') as test_type, total_distance, computation_ms from runs) group by rollup (algorithm, num_vehicles, test_type)""",
    "runs",
)
def _(t):
    return _round(reports.history_summary(t.runs), "avg_distance", "avg_ms")


@register(
    "a19_preset_records",
    """select p.preset_id, round(w.lat, 6) as w_lat, round(w.lon, 6) as w_lon, page, ids from presets p
 left join (select preset_id, lat, lon from links join spots using (location_id) where is_warehouse) w using (preset_id)
 left join (select preset_id, page, string_agg(cast(location_id as varchar), ',' order by location_id) as ids from (select preset_id, location_id, cast(floor((row_number() over (partition by preset_id order by location_id) - 1) / 1000) as bigint) as page from links
  where not is_warehouse) group by 1, 2) d using (preset_id)""",
    "presets preset_locations locations",
    "links as materialized (select * from preset_locations), spots as materialized (select location_id, lat, lon from locations)",
)
def _(t):
    rows = reports.preset_records(t.presets, t.preset_locations, t.locations)
    ids = F.array_join(F.transform("destinations", lambda x: x["location_id"].cast("string")), ",")
    return rows.select("preset_id", F.round("warehouse.lat", 6).alias("w_lat"), F.round("warehouse.lon", 6).alias("w_lon"), "page", ids.alias("ids"))


@register(
    "a20_cluster_records",
    """select cluster_id, name, page, ids from clusters left join (select cluster_id, page, string_agg(cast(checkpoint_id as varchar), ',' order by checkpoint_id) as ids
 from (select cluster_id, checkpoint_id, cast(floor((row_number() over (partition by cluster_id order by checkpoint_id) - 1) / 1000) as bigint) as page from security_checkpoints) group by 1, 2) using (cluster_id)""",
    "clusters security_checkpoints",
)
def _(t):
    ids = F.array_join(F.transform("checkpoints", lambda x: x["checkpoint_id"].cast("string")), ",")
    return reports.cluster_records(t.clusters, t.security_checkpoints).select("cluster_id", "name", "page", ids.alias("ids"))


# ---- rankings ----------------------------------------------------------------------------------------------------


@register("w1_first_checkpoint", "select cluster_id, min(checkpoint_id) as checkpoint_id, round(arg_min(lat, checkpoint_id), 6) as lat, round(arg_min(lon, checkpoint_id), 6) as lon from security_checkpoints group by 1", "security_checkpoints")
def _(t):
    return _round(reports.first_checkpoint(t.security_checkpoints), "lat", "lon")


@register(
    "w2_latest_center",
    """select round(coalesce(max(lat), 3.127993), 6) as lat, round(coalesce(max(lon), 101.466972), 6) as lon from (select preset_id from presets order by created_at desc, preset_id desc limit 1)
 join preset_locations using (preset_id) join locations using (location_id) where is_warehouse""",
    "presets preset_locations locations",
)
def _(t):
    return _round(reports.latest_center(t.presets, t.preset_locations, t.locations), "lat", "lon")


@register(
    "w3_best_in_group",
    "select consolidated_id, checkpoint_id, confidence from (select *, row_number() over (partition by consolidated_id order by confidence desc, checkpoint_id) as r from security_checkpoints join mapping using (checkpoint_id)) where r = 1",
    "security_checkpoints",
    MAPPING,
    recursive=True,
)
def _(t):
    joined = t.security_checkpoints.join(mapping(t), "checkpoint_id")
    best = joined.groupBy("consolidated_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "checkpoint_id")).alias("b"))
    return best.select("consolidated_id", "b.checkpoint_id", (-F.col("b.c")).alias("confidence"))


@register(
    "w4_furthest_member",
    """select cluster_id, arg_min(location_id, (-d, location_id)) as location_id, round(max(d), 6) as degrees from (
 select *, sqrt(pow(lat - avg(lat) over w, 2) + pow(lon - avg(lon) over w, 2)) as d from locations join location_clusters using (location_id) window w as (partition by cluster_id)) group by 1""",
    "locations location_clusters",
)
def _(t):
    return _round(reports.furthest_member(t.locations, t.location_clusters).select("cluster_id", "location_id", "degrees"), "degrees")


@register("w5_consecutive_stops", "select route_id, seq, checkpoint_id, next_checkpoint as next_checkpoint_id, round(km, 6) as km from legs", "route_stops", _LEGS)
def _(t):
    return _round(reports.legs(t.route_stops, "checkpoint_id").select("route_id", "seq", "checkpoint_id", "next_checkpoint_id", "km"), "km")


@register("w6_first_consolidated", "select * from first_consolidated", "security_checkpoints", f"{MAPPING}, {_FIRST}", recursive=True)
def _(t):
    return reports.first_consolidated(t.security_checkpoints, mapping(t))


@register(
    "w7_top_crossings",
    "select cluster_id, checkpoint_id, crossings, r as rank from (select *, row_number() over (partition by cluster_id order by crossings desc, checkpoint_id) as r from crossings) where r <= 2",
    "route_stops",
    f"{_LEGS}, {_CROSSINGS}",
)
def _(t):
    return reports.top_per_group(reports.boundary_crossings(t.route_stops), "cluster_id", [F.desc("crossings"), F.asc("checkpoint_id")], 2)


@register(
    "w8_cumulative_distance",
    "select route_id, seq, round(sum(km) over (partition by route_id order by seq), 6) as travelled from legs",
    "route_stops",
    _LEGS,
)
def _(t):
    rows = ranks.running_sum(reports.legs(t.route_stops), ["route_id"], "seq", F.col("km"), "travelled")
    return _round(rows.select("route_id", "seq", "travelled"), "travelled")


@register(
    "w9_matrix_index",
    """select preset_id, checkpoint_id, row_number() over (partition by preset_id order by checkpoint_id) as idx from (
 select distinct preset_id, checkpoint_id from preset_locations join location_clusters using (location_id) join security_checkpoints using (cluster_id) where not is_warehouse)""",
    "preset_locations location_clusters security_checkpoints",
)
def _(t):
    required = lookups.required_clusters(t.preset_locations, t.location_clusters)
    served = required.join(t.security_checkpoints.select("cluster_id", "checkpoint_id"), "cluster_id").select("preset_id", "checkpoint_id")
    served, seen = cut_and_measure(served, n=F.count(F.lit(1)))
    nodes = spread(served, "preset_id", rows=seen["n"]).distinct()
    return ranks.position(nodes, ["preset_id"], "checkpoint_id", "idx")


@register("w10_consolidated_ids", "select checkpoint_id, consolidated_id from mapping", "security_checkpoints", MAPPING, recursive=True)
def _(t):
    return mapping(t)


# ---- sorts and limits --------------------------------------------------------------------------------------------


@register("t1_presets_newest_first", "select preset_id, name, created_at from presets order by created_at desc, preset_id", "presets")
def _(t):
    return reports.presets_newest_first(t.presets).select("preset_id", "name", "created_at")


@register("t2_run_history", "select run_id, algorithm, created_at from runs order by created_at desc, run_id desc limit 50", "runs")
def _(t):
    return reports.history(t.runs, 50).select("run_id", "algorithm", "created_at")


@register("t3_latest_matches", "select location_id, street from locations where street ilike '%setia%' order by location_id desc limit 20", "locations")
def _(t):
    return lookups.pattern_matches(t.locations, "setia").select("location_id", "street").orderBy(F.desc("location_id")).limit(20)


@register(
    "t4_nearest_k",
    """select location_id, neighbour_id, r as rank from (select a.location_id, b.location_id as neighbour_id,
 row_number() over (partition by a.location_id order by pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2), b.location_id) as r
 from locations a join locations b on b.lat between a.lat - 5e-3 and a.lat + 5e-3 and b.lon between a.lon - 5e-3 and a.lon + 5e-3 and a.location_id <> b.location_id
 join location_clusters c on c.location_id = b.location_id) where r <= 3""",
    "locations location_clusters",
)
def _(t):
    return lookups.nearest_k(t.locations, t.location_clusters, 3, 0.005).select("location_id", "neighbour_id", "rank")


@register("t6_checkpoints_in_order", "select checkpoint_id, cluster_id from security_checkpoints order by cluster_id, checkpoint_id", "security_checkpoints")
def _(t):
    return t.security_checkpoints.select("checkpoint_id", "cluster_id").orderBy("cluster_id", "checkpoint_id")


# ---- set operations ----------------------------------------------------------------------------------------------


@register("u1_distinct_clusters", "select distinct cluster_id from location_clusters", "location_clusters")
def _(t):
    return t.location_clusters.select("cluster_id").distinct()


@register(
    "u2_required_minus_covered",
    "select location_id as run_id, cluster_id from location_clusters except select run_id, cluster_id from route_stops",
    "location_clusters route_stops",
)
def _(t):
    required = t.location_clusters.select(F.col("location_id").alias("run_id"), "cluster_id")
    return required.subtract(t.route_stops.select("run_id", "cluster_id"))


@register(
    "u3_union_of_detectors",
    """select node_id, 'barrier' as method from road_nodes where barrier is not null union all select node_id, 'main_end' from (select src as node_id from road_edges where highway in ('primary', 'secondary')
 union select dst from road_edges where highway in ('primary', 'secondary'))""",
    "road_nodes road_edges",
)
def _(t):
    barrier = t.road_nodes.where("barrier is not null").select("node_id", F.lit("barrier").alias("method"))
    main = reports.edge_ends(t.road_edges.where(geo.is_main_road("highway"))).select("node_id").distinct()
    return barrier.unionByName(main.withColumn("method", F.lit("main_end")))


@register(
    "u4_serves_needed",
    """select location_id, bool_or(s.cluster_id is not null) as served from location_clusters l left join security_checkpoints s using (cluster_id) group by 1""",
    "location_clusters security_checkpoints",
)
def _(t):
    served = t.security_checkpoints.select("cluster_id").distinct().withColumn("hit", F.lit(True))
    needed = t.location_clusters.join(served, "cluster_id", "left").groupBy("location_id").agg(
        F.collect_set("cluster_id").alias("needed"), F.collect_set(F.when(F.col("hit"), F.col("cluster_id"))).alias("serves")
    )
    return needed.select("location_id", F.arrays_overlap("needed", "serves").alias("served"))


@register("u5_neighbours", "select src as node_id, dst as neighbour_id from road_edges union select dst, src from road_edges", "road_edges")
def _(t):
    return roads.neighbours(t.road_edges)


@register(
    "u6_coverage_universe",
    "select run_id, cluster_id from route_stops union select location_id, cluster_id from location_clusters",
    "route_stops location_clusters",
)
def _(t):
    covered = t.route_stops.select("run_id", "cluster_id")
    return covered.unionByName(t.location_clusters.select(F.col("location_id").alias("run_id"), "cluster_id")).distinct()


@register(
    "demand_by_nearest_cluster",
    f"""select cluster_id, cast(sum(case when lower(type) = 'pickup' then 1 else 0 end) as bigint) as pickup_count, cast(sum(case when lower(type) <> 'pickup' then 1 else 0 end) as bigint) as delivery_count
 from demand join (select location_id, arg_min(cluster_id, (km, cluster_id)) as cluster_id from (select l.location_id, c.cluster_id, {duck.hav('l.lat', 'l.lon', 'c.lat', 'c.lon')} as km
 from locations l cross join (select cluster_id, avg(lat) as lat, avg(lon) as lon from locations join location_clusters using (location_id) group by 1) c) group by 1) using (location_id) group by 1""",
    "demand locations location_clusters",
)
def _(t):
    centers = lookups.cluster_centers(t.locations, t.location_clusters, t.clusters)
    near = lookups.nearest_center(t.locations, "location_id", centers).select("location_id", "cluster_id")
    pickup = F.lower("type") == "pickup"
    per_location = t.demand.groupBy("location_id").agg(F.count_if(pickup).alias("p"), F.count_if(~pickup).alias("d"))
    return per_location.join(near, "location_id").groupBy("cluster_id").agg(F.sum("p").alias("pickup_count"), F.sum("d").alias("delivery_count"))
