"""Registered queries of the joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import grid, lookups
from waymark.plans import duck
from waymark.plans.catalog_functions import _SHIFTED, shifted
from waymark.plans.registry import register

_STEM = duck.stem(duck.norm("street"))


@register("j1_cluster_members", "select cluster_id, location_id, street, city from locations join location_clusters using (location_id)", "locations location_clusters")
def _(t):
    return lookups.cluster_members(t.locations, t.location_clusters).select("cluster_id", "location_id", "street", "city")


@register("j2_all_locations", "select location_id, street, cluster_id from locations left join location_clusters using (location_id)", "locations location_clusters")
def _(t):
    return lookups.all_locations(t.locations, t.location_clusters).select("location_id", "street", "cluster_id")


@register(
    "j3_exact_street_match",
    """select location_id, cluster_id, name as cluster_name from locations a join (
 select lower(street) as street_key, arg_min(cluster_id, location_id) as cluster_id, arg_min(name, location_id) as name
 from locations join location_clusters using (location_id) join clusters using (cluster_id) where street <> '' group by 1) b on lower(a.street) = street_key
 where location_id not in (select location_id from location_clusters)""",
    "locations location_clusters clusters",
)
def _(t):
    return lookups.exact_street_match(t.locations, t.location_clusters, t.clusters)


@register(
    "j4_stem_match",
    f"""select location_id, stem_pattern, cluster_id, name as cluster_name from (select location_id, {duck.norm("street")} as normal, {_STEM} as stem_pattern from locations)
 join street_patterns using (stem_pattern) join clusters using (cluster_id) where normal <> stem_pattern""",
    "locations location_clusters clusters",
    duck.street_patterns(),
)
def _(t):
    patterns = lookups.street_patterns(t.locations, t.location_clusters)
    return lookups.stem_match(t.locations, patterns, t.clusters).select("location_id", "stem_pattern", "cluster_id", "cluster_name")


@register("j5_preset_warehouses", "select preset_id, location_id, street from preset_locations join locations using (location_id) where is_warehouse", "locations preset_locations")
def _(t):
    return lookups.preset_warehouses(t.preset_locations, t.locations).select("preset_id", "location_id", "street")


@register(
    "j6_preset_destinations",
    """select preset_id, location_id, cluster_id, name as cluster_name from preset_locations join locations using (location_id) left join location_clusters using (location_id)
 left join clusters using (cluster_id) where not is_warehouse""",
    "locations preset_locations location_clusters clusters",
)
def _(t):
    rows = lookups.preset_destinations(t.preset_locations, t.locations, t.location_clusters, t.clusters)
    return rows.select("preset_id", "location_id", "cluster_id", "cluster_name")


@register(
    "j7_non_warehouse_locations",
    """select location_id, cluster_id, name as cluster_name from locations left join location_clusters using (location_id) left join clusters using (cluster_id)
 where location_id not in (select location_id from preset_locations where is_warehouse)""",
    "locations preset_locations location_clusters clusters",
)
def _(t):
    rows = lookups.non_warehouse_locations(t.locations, t.preset_locations, t.location_clusters, t.clusters)
    return rows.select("location_id", "cluster_id", "cluster_name")


@register(
    "j8_preset_clusters",
    "select distinct preset_id, cluster_id, name from preset_locations join location_clusters using (location_id) join clusters using (cluster_id)",
    "preset_locations location_clusters clusters",
)
def _(t):
    return lookups.preset_clusters(t.preset_locations, t.location_clusters, t.clusters).select("preset_id", "cluster_id", "name")


@register(
    "j9_checkpoints_with_cluster",
    "select checkpoint_id, cluster_id, name as cluster_name, confidence from security_checkpoints join clusters using (cluster_id)",
    "security_checkpoints clusters",
)
def _(t):
    return lookups.checkpoints_with_cluster(t.security_checkpoints, t.clusters).select("checkpoint_id", "cluster_id", "cluster_name", "confidence")


_NEAR = """select a.location_id, b.location_id as neighbour_id, c.cluster_id as neighbour_cluster, pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2) as distance_sq
 from locations a join locations b on b.lat between a.lat - 2e-3 and a.lat + 2e-3 and b.lon between a.lon - 2e-3 and a.lon + 2e-3 and a.location_id <> b.location_id
 join location_clusters c on c.location_id = b.location_id"""


@register(
    "j10_nearby_locations",
    f"select location_id, neighbour_id, neighbour_cluster, round(distance_sq, 12) as distance_sq from ({_NEAR})",
    "locations location_clusters",
)
def _(t):
    rows = lookups.nearby(t.locations, t.location_clusters)
    return rows.select("location_id", "neighbour_id", "neighbour_cluster", F.round("distance_sq", 12).alias("distance_sq"))


_CENTERS = """centers as (select cluster_id, avg(lat) as lat, avg(lon) as lon, count(*) as location_count from locations join location_clusters using (location_id) join clusters using (cluster_id) group by 1)"""


def pickups(t):
    return t.dynamic_pairs.select("pair_id", F.col("pickup_lat").alias("lat"), F.col("pickup_lon").alias("lon"))


@register(
    "j11_nearest_centroid",
    f"""select pair_id, arg_min(cluster_id, (km, cluster_id)) as cluster_id, round(min(km), 6) as km from (
 select pair_id, cluster_id, {duck.hav('pickup_lat', 'pickup_lon', 'lat', 'lon')} as km from dynamic_pairs cross join centers) group by 1""",
    "locations location_clusters clusters dynamic_pairs",
    _CENTERS,
)
def _(t):
    centers = lookups.cluster_centers(t.locations, t.location_clusters, t.clusters)
    return lookups.nearest_center(pickups(t), "pair_id", centers).select("pair_id", "cluster_id", F.round("km", 6).alias("km"))


def _peers(column):
    return f"""select a.location_id, (select count(*) - 1 from locations b where b.{column} = a.{column}) as n_peers, p.peer_id, p.peer_cluster from locations a left join (
 select a.location_id, min(b.location_id) as peer_id, arg_min(c.cluster_id, b.location_id) as peer_cluster from locations a join locations b on a.{column} = b.{column} and a.location_id <> b.location_id
 join location_clusters c on c.location_id = b.location_id group by 1) p using (location_id) where a.{column} <> ''"""


@register("j12_street_peers", _peers("street"), "locations location_clusters")
def _(t):
    return lookups.street_peers(t.locations, t.location_clusters, "street")


@register("j12_neighborhood_peers", _peers("neighborhood"), "locations location_clusters")
def _(t):
    return lookups.street_peers(t.locations, t.location_clusters, "neighborhood")


@register(
    "j13_join_by_coord_key",
    "select request_id, location_id, printf('%.6f,%.6f', s.lat, s.lon) as coord_key from shifted s join locations l on printf('%.6f,%.6f', s.lat, s.lon) = printf('%.6f,%.6f', l.lat, l.lon)",
    "locations",
    _SHIFTED,
)
def _(t):
    rows = lookups.join_by_coord_key(shifted(t), t.locations.select("location_id", "lat", "lon"))
    return rows.select("request_id", F.col("t_location_id").alias("location_id"), "coord_key")


@register(
    "j14_cluster_at_coordinate",
    "select request_id, min(cluster_id) as cluster_id from shifted s left join locations l on s.lat = l.lat and s.lon = l.lon left join location_clusters c on c.location_id = l.location_id group by 1",
    "locations location_clusters",
    _SHIFTED,
)
def _(t):
    return lookups.cluster_at(shifted(t), t.locations, t.location_clusters).select("request_id", "cluster_id")


@register(
    "j16_missing_clusters",
    "select location_id as run_id, cluster_id from location_clusters l where not exists (select 1 from route_stops r where r.run_id = l.location_id and r.cluster_id = l.cluster_id)",
    "location_clusters route_stops",
)
def _(t):
    required = t.location_clusters.withColumnRenamed("location_id", "run_id")
    return lookups.missing(required, t.route_stops, ["run_id", "cluster_id"]).select("run_id", "cluster_id")


@register(
    "j18_required_clusters",
    "select distinct preset_id, cluster_id from preset_locations join location_clusters using (location_id) where not is_warehouse",
    "preset_locations location_clusters",
)
def _(t):
    return lookups.required_clusters(t.preset_locations, t.location_clusters)


@register(
    "j19_covering_checkpoints",
    "select checkpoint_id, cluster_id from security_checkpoints where cluster_id in (select cluster_id from preset_locations join location_clusters using (location_id) where not is_warehouse)",
    "preset_locations location_clusters security_checkpoints",
)
def _(t):
    required = lookups.required_clusters(t.preset_locations, t.location_clusters)
    return lookups.covering_checkpoints(t.security_checkpoints, required).select("checkpoint_id", "cluster_id")


@register(
    "j20_nearest_road_node",
    f"""select location_id, arg_min(node_id, (km, node_id)) as node_id, round(min(km), 6) as km from (
 select location_id, node_id, {duck.hav('l.lat', 'l.lon', 'n.lat', 'n.lon')} as km from locations l cross join road_nodes n) group by 1""",
    "locations road_nodes",
)
def _(t):
    return grid.nearest(t.locations, "location_id", t.road_nodes, "node_id").select("location_id", "node_id", F.round("km", 6).alias("km"))


@register(
    "j21_candidate_checkpoints",
    f"""select pair_id, role, e.cluster_id, checkpoint_id from (
 select pair_id, role, arg_min(cluster_id, (km, cluster_id)) as cluster_id from (
  select pair_id, role, cluster_id, {duck.hav('e.lat', 'e.lon', 'c.lat', 'c.lon')} as km from (
   select pair_id, 'pickup' as role, pickup_lat as lat, pickup_lon as lon from dynamic_pairs union all select pair_id, 'dropoff', dropoff_lat, dropoff_lon from dynamic_pairs) e cross join centers c) group by 1, 2) e
 left join security_checkpoints s on s.cluster_id = e.cluster_id""",
    "locations location_clusters clusters dynamic_pairs security_checkpoints",
    _CENTERS,
)
def _(t):
    pairs = pair_clusters(t)
    return lookups.candidate_checkpoints(pairs, t.security_checkpoints).select("pair_id", "role", "cluster_id", "checkpoint_id")


def pair_clusters(t):
    """Dynamic pairs with the nearest cluster of both ends."""
    centers = lookups.cluster_centers(t.locations, t.location_clusters, t.clusters)
    ends = lookups.pair_ends(t.dynamic_pairs).withColumn("end_id", F.col("pair_id") * 2 + F.when(F.col("role") == "pickup", 0).otherwise(1))
    near = lookups.nearest_center(ends, "end_id", centers)
    split = near.select(F.floor(F.col("end_id") / 2).alias("pair_id"), (F.col("end_id") % 2 == 0).alias("is_pickup"), "cluster_id")
    return split.groupBy("pair_id").agg(
        F.max(F.when(F.col("is_pickup"), F.col("cluster_id"))).alias("pickup_cluster"),
        F.max(F.when(~F.col("is_pickup"), F.col("cluster_id"))).alias("dropoff_cluster"),
    )


@register(
    "j22_stops_to_points",
    """select route_id, seq, round(lat, 6) as lat, round(lon, 6) as lon, 'stop' as type from route_stops
 union all select route_id, unnest([0, max(seq) + 1]), round(any_value(l.lat), 6), round(any_value(l.lon), 6), 'depot' from route_stops r join locations l on l.location_id = r.run_id group by 1""",
    "route_stops locations",
)
def _(t):
    stops = t.route_stops.select("route_id", "seq", F.col("checkpoint_id").alias("stop"))
    places = t.security_checkpoints.select(F.col("checkpoint_id").alias("stop"), "lat", "lon")
    depots = t.route_stops.select("route_id", F.col("run_id").alias("location_id")).distinct().join(t.locations, "location_id").select("route_id", "lat", "lon")
    rows = lookups.stops_to_points(stops, places, depots)
    return rows.select("route_id", "seq", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "type")


@register(
    "j23_runs_by_id",
    "select run_id, algorithm, total_distance from runs where run_id in (select l_orderkey from lineitem where l_returnflag = 'R')",
    "runs",
)
def _(t):
    ids = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id")).distinct()
    return lookups.runs_by_id(t.runs, ids).select("run_id", "algorithm", "total_distance")
