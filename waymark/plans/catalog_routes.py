"""Registered queries of routing (R) and of the distance matrix (J15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import lookups, ranks, reports, tours
from waymark.plans import duck, insertion, scenario
from waymark.plans.catalog_lookups import _CENTERS, pair_clusters
from waymark.plans.catalog_reports import _LEGS
from waymark.plans.registry import register
from waymark.session import cut_lean as cut, release_unread, tables_written


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def static(t):
    return scenario.static_instances(t.preset_locations, t.locations)


_STATIC = """depots as (select preset_id, lat, lon from preset_locations join locations using (location_id) where is_warehouse),
 stops as (select preset_id, location_id as stop_id, lat, lon from preset_locations join locations using (location_id) where not is_warehouse),
 shares as (select preset_id, d.lat as d_lat, d.lon as d_lon, cast(ceil(n / greatest(least({v}, n), 1)) as bigint) as share from depots d join (select preset_id, count(*) as n from stops group by 1) using (preset_id))"""
_KM = duck.hav("w.p_lat", "w.p_lon", "s.lat", "s.lon")


def _walk(vehicles: str = "1", name: str = "walk", shares: str = "shares") -> str:
    """``WITH`` parts that step through the nearest-neighbour tours of all presets."""
    return f"""{name}(preset_id, step, stop_id, lat, lon, km, visited) as (select preset_id, 0::bigint, null::bigint, d_lat, d_lon, 0e0, []::bigint[] from {shares}
 union all select preset_id, step, stop_id, lat, lon, km, visited from (select w.preset_id, w.step + 1 as step, s.stop_id, s.lat, s.lon, {_KM} as km, list_append(w.visited, s.stop_id) as visited,
  row_number() over (partition by w.preset_id order by {_KM}, s.stop_id) as r from (select *, case when step % share = 0 then d_lat else lat end as p_lat, case when step % share = 0 then d_lon else lon end as p_lon from {name} join {shares} using (preset_id)) w
  join stops s on s.preset_id = w.preset_id where not list_contains(w.visited, s.stop_id)) where r = 1)"""


_ONE = f"{_STATIC.format(v=1)}, {_walk()}"
_VEHICLES = "cast(right(preset_id, 1) as int) % 4 + 1"
_MANY = f"{_STATIC.format(v=_VEHICLES)}, {_walk()}"
_SV = "preset_locations locations"


@register(
    "j15_distance_matrix",
    f"""select preset_id as instance_id, i, 0 as part, string_agg(cast(cast(round(km * 1000) as bigint) as varchar), ',' order by j) as metres from (
 select a.preset_id, a.idx as i, b.idx as j, {duck.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km from nodes a join nodes b using (preset_id)) group by 1, 2""",
    _SV,
    """nodes as (select preset_id, lat, lon, case when is_warehouse then 0 else row_number() over (partition by preset_id, is_warehouse order by location_id) end as idx from preset_locations join locations using (location_id))""",
)
def _(t):
    depots, stops = static(t)
    indexed = ranks.position(stops, ["instance_id"], "stop_id", "idx").select("instance_id", "idx", "lat", "lon")
    nodes = depots.select("instance_id", F.lit(0).cast("bigint").alias("idx"), "lat", "lon").unionByName(indexed)
    metres = F.array_join(F.transform("km", lambda k: F.round(k * 1000).cast("bigint").cast("string")), ",")
    return tours.distance_matrix(nodes).select("instance_id", "i", "part", metres.alias("metres"))


@register(
    "r1_prepare_instances",
    """select preset_id as instance_id, idx, stop_id, coalesce(n, 0) as clusters_served from (
 select preset_id, 0 as idx, location_id as stop_id, null as n from preset_locations where is_warehouse
 union all select preset_id, row_number() over (partition by preset_id order by stop_id), stop_id, n from (select preset_id, stop_id, count(distinct cluster_id) as n from served group by 1, 2))""",
    "preset_locations locations location_clusters security_checkpoints",
    """required as (select distinct preset_id, cluster_id from preset_locations join location_clusters using (location_id) where not is_warehouse),
 keyed as (select preset_id, cluster_id, checkpoint_id, lat, lon, printf('%.6f,%.6f', lat, lon) as k from required join security_checkpoints using (cluster_id)),
 served as (select preset_id, min(checkpoint_id) over (partition by preset_id, k) as stop_id, arg_min(lat, checkpoint_id) over (partition by preset_id, k) as lat, arg_min(lon, checkpoint_id) over (partition by preset_id, k) as lon, cluster_id from keyed)""",
)
def _(t):
    out = prepared(t)
    stop = F.col("kind") == "checkpoint"
    rows = scenario.clusters_served(out["nodes"].where(stop), out["served"], "n").unionByName(out["nodes"].where(~stop), allowMissingColumns=True)
    return rows.select("instance_id", "idx", "stop_id", F.coalesce("n", F.lit(0)).alias("clusters_served"))


def prepared(t):
    return scenario.prepare_instances(t.presets, t.preset_locations, t.locations, t.location_clusters, t.security_checkpoints)


@register("r2_nearest_neighbor_tours", "select preset_id as instance_id, step as seq, stop_id, round(km, 6) as km from walk where step > 0", _SV, _ONE, recursive=True)
def _(t):
    return _r(tours.nearest_tours(*static(t)).select("instance_id", "seq", "stop_id", "km"), "km")


@register(
    "r2_closed_tour_lengths",
    f"""select preset_id as instance_id, count(*) as n_stops, round(sum(w.km) + max(case when step = n then {duck.hav('w.lat', 'w.lon', 'd_lat', 'd_lon')} end), 6) as km
 from walk w join shares using (preset_id) join (select preset_id, max(step) as n from walk group by 1) using (preset_id) where step > 0 group by 1""",
    _SV,
    _ONE,
    recursive=True,
)
def _(t):
    depots, stops = static(t)
    return _r(tours.closed_lengths(depots, stops, tours.nearest_tours(depots, stops)).select("instance_id", "n_stops", "km"), "km")


@register(
    "r3_path_lengths",
    """select route_id, round(sum(km), 6) as km, sum(case when checkpoint_id <= next_checkpoint then km else 'infinity'::double end) = 'infinity'::double as unknown from legs group by 1""",
    "route_stops",
    _LEGS,
)
def _(t):
    paths = t.route_stops.select("route_id", "seq", F.col("checkpoint_id").alias("node_id"), "lat", "lon")
    legs = reports.legs(t.route_stops, "checkpoint_id").where("checkpoint_id <= next_checkpoint_id").select(
        F.col("checkpoint_id").alias("from_node"), F.col("next_checkpoint_id").alias("to_node"), "km"
    )
    priced = tours.path_lengths(paths, legs.groupBy("from_node", "to_node").agg(F.min("km").alias("km")))
    flag = priced.select("route_id", (F.col("km") == float("inf")).alias("unknown"))
    return _r(tours.path_lengths(paths).join(flag, "route_id"), "km")


@register("r4_two_opt")
def _(t):
    depots, stops = static(t)
    paths = tours.closed_paths(depots, stops, tours.nearest_tours(depots, stops))
    return _r(tours.path_lengths(tours.two_opt(paths)), "km")


def _steps(source: str) -> str:
    """``WITH`` parts of the shortest way through all points (id, k, lat, lon) of an instance, by the ways through every subset."""
    return f"""legs as materialized (select a.id, a.k as a, b.k as b, b.after, 1 << b.k as bit, {duck.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km from {source} a join {source} b on b.id = a.id and b.k <> a.k),
 ways(id, mask, k, km) as (select id, cast(1 << k as int), k, {duck.hav('s_lat', 's_lon', 'lat', 'lon')} from {source} where after is null union all
 select w.id, cast(w.mask | bit as int), b, min(w.km + l.km) from ways w join legs l on l.id = w.id and l.a = w.k where w.mask & bit = 0 and (after is null or (w.mask >> after) & 1 = 1) group by 1, 2, 3),
 shortest as (select w.id, any_value(n) as n, min(w.km + {duck.hav('p.lat', 'p.lon', 'e_lat', 'e_lon')}) as km from ways w join {source} p on p.id = w.id and p.k = w.k where w.mask = (1 << n) - 1 group by 1)"""


@register("r5_exact_tours")
def _(t):
    exact, errors = tours.exact_tours(*static(t))
    solved = exact.select("instance_id", F.round("km", 6).alias("km"), F.size(F.array_distinct("ids")).cast("bigint").alias("n_stops"), F.lit(None).cast("string").alias("error"))
    n = F.split("error", " ")[0].cast("bigint").alias("n_stops")
    return solved.unionByName(errors.select("instance_id", F.lit(None).cast("double").alias("km"), n, "error"))


def with_vehicles(depots):
    return depots.withColumn("vehicles", F.substring("instance_id", -1, 1).cast("int") % 4 + 1)


@register(
    "r6_multi_vehicle_tours",
    "select preset_id as instance_id, cast(floor((step - 1) / share) as bigint) as vehicle, (step - 1) % share + 1 as seq, stop_id, round(km, 6) as km from walk join shares using (preset_id) where step > 0",
    _SV,
    _MANY,
    recursive=True,
)
def _(t):
    depots, stops = static(t)
    return _r(tours.nearest_tours(with_vehicles(depots), stops, "vehicles"), "km")


_REQUIRED = """required as (select distinct preset_id, cluster_id from preset_locations join location_clusters using (location_id) where not is_warehouse),
 keyed as (select preset_id, cluster_id, checkpoint_id, lat, lon, printf('%.6f,%.6f', lat, lon) as k from required join security_checkpoints using (cluster_id)),
 served as (select preset_id, min(checkpoint_id) as stop_id, arg_min(lat, checkpoint_id) as lat, arg_min(lon, checkpoint_id) as lon, list(distinct cluster_id) as clusters from keyed group by preset_id, k),
 depots as (select preset_id, lat, lon from preset_locations join locations using (location_id) where is_warehouse)"""
_GAP = duck.hav("w.cars[v].lat", "w.cars[v].lon", "s.lat", "s.lon")


def _cover(vehicles: int) -> str:
    cars = "[" + ", ".join(["{'lat': lat, 'lon': lon}"] * vehicles) + "]"
    return f"""{_REQUIRED}, cover(preset_id, step, vehicle, stop_id, km, cars, done) as (select preset_id, 0::bigint, 0, null::bigint, 0e0, {cars}, []::bigint[] from depots
 union all select preset_id, step, vehicle, stop_id, km, cars, done from (select w.preset_id, w.step + 1 as step, v - 1 as vehicle, s.stop_id, {_GAP} as km,
  list_transform(w.cars, lambda c, i: case when i = v then {{'lat': s.lat, 'lon': s.lon}} else c end) as cars, list_concat(w.done, s.clusters) as done,
  row_number() over (partition by w.preset_id order by {_GAP}, v, s.stop_id) as r from cover w join served s using (preset_id), (select cast(unnest(range(1, {vehicles} + 1)) as int) as v)
  where not list_has_all(w.done, s.clusters)) where r = 1)"""


_CV = "preset_locations locations location_clusters security_checkpoints"
_STEPS = "select preset_id as instance_id, vehicle, row_number() over (partition by preset_id, vehicle order by step) as seq, stop_id, round(km, 6) as km from cover where step > 0"


@register("r7_covering_tour", _STEPS, _CV, _cover(1), recursive=True)
def _(t):
    p = prepared(t)
    return _r(tours.covering_tours(p["depots"], p["served"]), "km")


@register("r8_multi_vehicle_covering", _STEPS, _CV, _cover(2), recursive=True)
def _(t):
    p = prepared(t)
    return _r(tours.covering_tours(p["depots"].withColumn("vehicles", F.lit(2)), p["served"], "vehicles"), "km")


@register(
    "r9_algorithm_choice",
    f"""select preset_id as instance_id, case when cast(right(preset_id, 1) as int) % 3 = 0 then 'nearest_neighbor' else 'two_opt' end as algorithm_used, count(*) + 1 as n_nodes, true as not_longer,
 case when cast(right(preset_id, 1) as int) % 3 = 0 then round(sum(w.km) + max(case when step = n then {duck.hav('w.lat', 'w.lon', 'd_lat', 'd_lon')} end), 6) end as km
 from walk w join shares using (preset_id) join (select preset_id, max(step) as n from walk group by 1) using (preset_id) group by 1""",
    _SV,
    _ONE,
    recursive=True,
)
def _(t):
    since = tables_written()
    depots, stops = static(t)
    digit = F.substring("instance_id", -1, 1).cast("int") % 3
    named = depots.withColumn("algorithm", F.when(digit == 0, "nearest_neighbor").when(digit == 1, "two_opt").otherwise("mystery"))
    first = cut(tours.closed_paths(depots, stops, tours.nearest_tours(depots, stops)))
    release_unread(since, depots, first)  # the stops are in the paths
    paths = cut(scenario.solve_static(named, stops, first=first))
    release_unread(since, first, paths)
    km = F.when(F.col("algorithm_used") == "nearest_neighbor", F.round("km", 6))
    return _not_longer(paths, first).withColumn("km", km)


def _not_longer(paths, first):
    """Solved paths with their length, and whether it is at most that of the tours they started from."""
    sizes = paths.groupBy("instance_id", "algorithm_used", "route_id").agg(F.count("*").alias("n_nodes"))
    start = cut(tours.path_lengths(first).withColumnRenamed("km", "first_km"))
    joined = sizes.join(cut(tours.path_lengths(paths)), "route_id").join(start, "route_id")
    return joined.select("instance_id", "algorithm_used", "n_nodes", (F.col("km") <= F.col("first_km") + 1e-9).alias("not_longer"), "km")


@register(
    "r9_checkpoint_solver",
    f"""select preset_id as instance_id, case when cast(right(preset_id, 1) as int) % 2 = 0 then 'heuristic' else 'two_opt' end as algorithm_used, count(*) + 1 as n_nodes, true as not_longer,
 case when cast(right(preset_id, 1) as int) % 2 = 0 or count(*) <= 3 then round(sum(c.km) + max(case when step = n then {duck.hav('s.lat', 's.lon', 'd.lat', 'd.lon')} end), 6) end as km
 from cover c join (select preset_id, max(step) as n from cover group by 1 having max(step) > 0) using (preset_id) join depots d using (preset_id) left join served s on s.preset_id = c.preset_id and s.stop_id = c.stop_id group by 1""",
    _CV,
    _cover(1),
    recursive=True,
)
def _(t):
    since = tables_written()
    p = prepared(t)
    named = p["depots"].withColumn("algorithm", F.when(F.substring("instance_id", -1, 1).cast("int") % 2 == 0, "heuristic").otherwise("two_opt"))
    stops = p["served"].select("instance_id", "stop_id", "lat", "lon").distinct()
    first = cut(tours.closed_paths(p["depots"], stops, tours.covering_tours(p["depots"], p["served"])))
    release_unread(since, named, first)  # the stops are in the paths
    # with one or two stops there is nothing to exchange; longer improved tours have no SQL
    km = F.when((F.col("algorithm_used") == "heuristic") | (F.col("n_nodes") <= 4), F.round("km", 6))
    paths = cut(scenario.solve_checkpoints(named, p["served"], first=first))
    release_unread(since, first, paths)
    return _not_longer(paths, first).withColumn("km", km)


@register(
    "r10_solution_rows",
    """select preset_id as instance_id, vehicle, seq, idx, kind, clusters_served from (
 select preset_id, vehicle, step as seq, idx, 'checkpoint' as kind, len(clusters) as clusters_served from cover join served using (preset_id, stop_id) join (select preset_id, stop_id, row_number() over (partition by preset_id order by stop_id) as idx from served) using (preset_id, stop_id) where step > 0
 union all select preset_id, 0, unnest([0, max(step) + 1]), 0, 'warehouse', 0 from cover group by 1 having max(step) > 0)""",
    _CV,
    _cover(1),
    recursive=True,
)
def _(t):
    p = prepared(t)
    rows = scenario.solution_rows(tours.covering_tours(p["depots"], p["served"]), p["nodes"], p["served"], ())
    return rows.select("instance_id", "vehicle", "seq", "idx", "kind", "clusters_served")


@register(
    "r11_missing_clusters",
    "select preset_id as instance_id, cluster_id from required where (preset_id, cluster_id) not in (select preset_id, cluster_id from keyed)",
    _CV,
    _REQUIRED.replace("join location_clusters using", "join grown using").replace("required as", """grown as (select location_id, cluster_id from location_clusters
 union all select location_id, 1000 + location_id % 7 from locations where location_id % 10 = 9), required as""", 1),
)
def _(t):
    # unclustered locations get new clusters, which have no checkpoint yet
    fresh = t.locations.where("location_id % 10 = 9").selectExpr("location_id", "cast(1000 + location_id % 7 as int) as cluster_id")
    grown = t.location_clusters.select("location_id", F.col("cluster_id").cast("int").alias("cluster_id")).unionByName(fresh)
    p = scenario.prepare_instances(t.presets, t.preset_locations, t.locations, grown, t.security_checkpoints)
    tour = tours.covering_tours(p["depots"], p["served"])
    return scenario.missing_clusters(p["required"], tour, p["served"])


# ---- insertion ---------------------------------------------------------------------------------------------------------


def routes(t):
    return t.route_stops.select("run_id", "route_id", "seq", F.col("checkpoint_id").alias("node_id"), "lat", "lon")


def route_depots(t):
    return t.orders.select(F.col("o_orderkey").alias("route_id"), F.col("o_custkey").alias("location_id")).join(t.locations, "location_id").select("route_id", "lat", "lon")


def requests(t):
    """One request per event: its pair goes into the route with the event's number."""
    return t.dynamic_pairs.select(
        F.col("pair_id").alias("route_id"), "pair_id", (F.col("vehicle_key") % 7).alias("insertion_point"), "pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon"
    )


def planned(t, requests=requests):
    """(routes, depots, requests): the first two written, as an insertion reads them many times; the requests are read off the events."""
    return cut(routes(t)), cut(route_depots(t)), requests(t)


@register(
    "r12_split_routes",
    """select r.route_id, seq, seq <= vehicle_key % 7 as done, null as error from dynamic_pairs p join route_stops r on r.route_id = p.pair_id join (select route_id, max(seq) as n from route_stops group by 1) n on n.route_id = r.route_id where vehicle_key % 7 <= n
 union all select pair_id, null, null, 'Insertion point is out of bounds' from dynamic_pairs left join (select route_id, max(seq) as n from route_stops group by 1) n on n.route_id = pair_id where n is null or vehicle_key % 7 > n""",
    "dynamic_pairs route_stops",
)
def _(t):
    split, errors = scenario.split_routes(routes(t), requests(t))
    none = F.lit(None)
    return split.select("route_id", "seq", "done", none.cast("string").alias("error")).unionByName(
        errors.select("route_id", none.cast("bigint").alias("seq"), none.cast("boolean").alias("done"), "error")
    )


@register(
    "r13_resolve_pairs",
    """select pair_id, a.i as pickup_idx, b.i as dropoff_idx, a.i is null or b.i is null as failed from (select pair_id, printf('%.6f,%.6f', f.lat, f.lon) as p,
  case when vehicle_key % 2 = 0 then printf('%.6f,%.6f', f.lat, f.lon) else printf('%.6f,%.6f', dropoff_lat, dropoff_lon) end as d from dynamic_pairs join (select * from route_stops where seq = 1) f on f.route_id = pair_id)
 left join keys a on a.route_id = pair_id and a.k = p left join keys b on b.route_id = pair_id and b.k = d""",
    "dynamic_pairs route_stops",
    "keys as (select route_id, printf('%.6f,%.6f', lat, lon) as k, min(seq) as i from route_stops group by 1, 2)",
)
def _(t):
    nodes = cut(routes(t).select(F.col("route_id").alias("instance_id"), F.col("seq").alias("idx"), "lat", "lon"))
    first = nodes.where("idx = 1").select("instance_id", "lat", "lon")
    even = F.col("vehicle_key") % 2 == 0
    pairs = t.dynamic_pairs.withColumn("instance_id", F.col("pair_id")).join(first, "instance_id").select(
        "instance_id", "pair_id", F.col("lat").alias("pickup_lat"), F.col("lon").alias("pickup_lon"),
        F.when(even, F.col("lat")).otherwise(F.col("dropoff_lat")).alias("dropoff_lat"), F.when(even, F.col("lon")).otherwise(F.col("dropoff_lon")).alias("dropoff_lon"),
    )
    return scenario.resolve_pairs(pairs, nodes).select("pair_id", "pickup_idx", "dropoff_idx", F.col("error").isNotNull().alias("failed"))


def _h(a, b):
    return duck.hav(f"{a}_lat", f"{a}_lon", f"{b}_lat", f"{b}_lon")


_SLOTS = f"""homes as materialized (select o_orderkey as route_id, lat as h_lat, lon as h_lon from orders join locations on location_id = o_custkey),
 chain as materialized (select route_id, seq, lat, lon from route_stops union all select route_id, 0, h_lat, h_lon from homes where route_id in (select route_id from route_stops)),
 sizes as (select route_id, max(seq) as n from route_stops group by 1),
 gaps as materialized (select c.route_id, pair_id, c.seq - vehicle_key % 7 as slot, c.lat as a_lat, c.lon as a_lon, coalesce(x.lat, h_lat) as b_lat, coalesce(x.lon, h_lon) as b_lon, x.lat is null as last,
  pickup_lat as p_lat, pickup_lon as p_lon, dropoff_lat as q_lat, dropoff_lon as q_lon from chain c join dynamic_pairs on pair_id = c.route_id join sizes s on s.route_id = c.route_id join homes h on h.route_id = c.route_id
  left join route_stops x on x.route_id = c.route_id and x.seq = c.seq + 1 where c.seq >= vehicle_key % 7 and vehicle_key % 7 <= n),
 slots as materialized (select *, {_h('a', 'p')} + {_h('p', 'b')} - {_h('a', 'b')} as add_p, {_h('a', 'q')} + {_h('q', 'b')} - {_h('a', 'b')} as add_q, {_h('a', 'p')} + {_h('p', 'q')} + {_h('q', 'b')} - {_h('a', 'b')} as add_pq from gaps),
 options as (select route_id, pair_id, slot as p, slot as q, add_pq as km from slots union all select a.route_id, a.pair_id, a.slot, b.slot, a.add_p + b.add_q from slots a join slots b on a.route_id = b.route_id and a.slot < b.slot),
 best as (select route_id, pair_id, min(km) as added from options group by 1, 2),
 tail as (select route_id, add_pq as appended from slots where last),
 whole as materialized (select route_id, sum(km) as km from (select a.route_id, {duck.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as km from chain a join chain b on a.route_id = b.route_id and b.seq = a.seq + 1
  union all select r.route_id, {duck.hav('lat', 'lon', 'h_lat', 'h_lon')} from route_stops r join sizes s on s.route_id = r.route_id and n = seq join homes h on h.route_id = r.route_id) group by 1)"""
_IV = "dynamic_pairs route_stops locations"


@register("r14_best_insertion", "select route_id, pair_id, round(added, 6) as added_km from best", _IV, _SLOTS)
def _(t):
    slots = scenario.insertion_slots(*planned(t))
    return _r(scenario.best_insertion(slots).select("route_id", "pair_id", "added_km"), "added_km")


_EXACT = f"""homes as materialized (select o_orderkey as route_id, lat as h_lat, lon as h_lon from orders join locations on location_id = o_custkey),
 asked as materialized (select pair_id || ':' || pair_id as id, pair_id as route_id, vehicle_key % 7 as at_seq, pickup_lat, pickup_lon, dropoff_lat, dropoff_lon, h_lat, h_lon,
   (select count(*) from route_stops r where r.route_id = pair_id and r.seq > vehicle_key % 7) as n_left
  from dynamic_pairs join homes on route_id = pair_id where vehicle_key % 7 <= (select max(seq) from route_stops r where r.route_id = pair_id)),
 starts as (select a.*, coalesce(r.lat, h_lat) as s_lat, coalesce(r.lon, h_lon) as s_lon from asked a left join route_stops r on r.route_id = a.route_id and r.seq = at_seq where n_left <= 8),
 points as materialized (select id, lat, lon, s_lat, s_lon, h_lat as e_lat, h_lon as e_lon, cast(after as int) as after, cast(k as int) as k, cast(n_left + 2 as int) as n from (
  select s.*, r.lat, r.lon, null as after, r.seq - at_seq - 1 as k from starts s join route_stops r on r.route_id = s.route_id and r.seq > at_seq
  union all select *, pickup_lat, pickup_lon, null, n_left from starts union all select *, dropoff_lat, dropoff_lon, n_left, n_left + 1 from starts)), {_steps('points')}"""


@register(
    "r14_exact_reorder",
    """select id as instance_id, round(km, 6) as km, cast(null as varchar) as error from shortest
 union all select id, null, count(*) || ' stops left; the exact order takes at most 8' from asked join route_stops r using (route_id) where r.seq > at_seq group by 1 having count(*) > 8
 union all select pair_id || ':' || pair_id, null, 'Insertion point is out of bounds' from dynamic_pairs left join (select route_id as pair_id, max(seq) as n from route_stops group by 1) using (pair_id) where n is null or vehicle_key % 7 > n""",
    _IV,
    _EXACT,
    recursive=True,
)
def _(t):
    return _r(scenario.best_reorder(*planned(t), 8).select("instance_id", "km", "error"), "km")


@register("r15_append_pair", "select route_id, round(km + appended, 6) as km from tail join whole using (route_id)", _IV, _SLOTS)
def _(t):
    r, d, q = planned(t)
    total = scenario.appended(scenario.insertion_slots(r, d, q)).join(scenario.closed_route_lengths(r, d), "route_id")
    return total.select("route_id", F.round(F.col("km") + F.col("appended_km"), 6).alias("km"))


@register(
    "r16_insert_pairs",
    "select route_id, round(km + least(added, appended), 6) as km, round(km + added, 6) as strategy_a_km, round(km + appended, 6) as strategy_b_km, n + 2 as n_stops from best join tail using (route_id) join whole using (route_id) join sizes using (route_id)",
    _IV,
    _SLOTS,
)
def _(t):
    since = tables_written()
    r, d, q = planned(t)
    rebuilt, report = scenario.insert_pairs(r, d, q)
    release_unread(since, rebuilt, report, d)
    lengths = cut(scenario.closed_route_lengths(rebuilt, d)).join(rebuilt.groupBy("route_id").agg(F.max("seq").alias("n_stops")), "route_id")
    rows = report.drop("km").join(lengths, "route_id").select("route_id", "km", "strategy_a_km", "strategy_b_km", "n_stops")
    return _r(rows, "km", "strategy_a_km", "strategy_b_km")


def _turn(n: int, pairs: str) -> str:
    """``WITH`` parts that place one pair per route into the chain of stops ``chain{n}`` and make ``chain{n + 1}``."""
    return f"""point{n} as materialized (select p.route_id, c.seq as point, pickup_lat as p_lat, pickup_lon as p_lon, dropoff_lat as q_lat, dropoff_lon as q_lon from {pairs} p join chain{n} c on c.route_id = p.route_id and c.was = p.at),
 gaps{n} as materialized (select c.route_id, c.seq - point as slot, c.lat as a_lat, c.lon as a_lon, coalesce(x.lat, h_lat) as b_lat, coalesce(x.lon, h_lon) as b_lon, p_lat, p_lon, q_lat, q_lon
  from chain{n} c join point{n} p on p.route_id = c.route_id join homes h on h.route_id = c.route_id left join chain{n} x on x.route_id = c.route_id and x.seq = c.seq + 1 where c.seq >= point),
 slots{n} as materialized (select route_id, slot, {_h('a', 'p')} + {_h('p', 'b')} - {_h('a', 'b')} as add_p, {_h('a', 'q')} + {_h('q', 'b')} - {_h('a', 'b')} as add_q, {_h('a', 'p')} + {_h('p', 'q')} + {_h('q', 'b')} - {_h('a', 'b')} as add_pq from gaps{n}),
 best{n} as materialized (select route_id, arg_min(struct_pack(p := p, q := q), (km, p, q)) as m from (select route_id, slot as p, slot as q, add_pq as km from slots{n}
  union all select a.route_id, a.slot, b.slot, a.add_p + b.add_q from slots{n} a join slots{n} b on a.route_id = b.route_id and a.slot < b.slot) group by 1),
 chain{n + 1} as materialized (select c.route_id, c.seq + coalesce(cast(c.seq > point + m.p as int), 0) + coalesce(cast(c.seq > point + m.q as int), 0) as seq, lat, lon, was from chain{n} c left join point{n} p on p.route_id = c.route_id left join best{n} b on b.route_id = c.route_id
  union all select route_id, point + m.p + 1, p_lat, p_lon, null from point{n} join best{n} using (route_id) union all select route_id, point + m.q + 2, q_lat, q_lon, null from point{n} join best{n} using (route_id))"""


_TWO = f"""homes as materialized (select o_orderkey as route_id, lat as h_lat, lon as h_lon from orders join locations on location_id = o_custkey),
 chain1 as materialized (select route_id, seq, lat, lon, seq as was from route_stops union all select route_id, 0, h_lat, h_lon, 0 from homes where route_id in (select route_id from route_stops)),
 first_pairs as (select pair_id as route_id, vehicle_key % 7 as at, pickup_lat, pickup_lon, dropoff_lat, dropoff_lon from dynamic_pairs),
 second_pairs as (select pair_id as route_id, vehicle_key % 3 as at, dropoff_lat as pickup_lat, dropoff_lon as pickup_lon, pickup_lat as dropoff_lat, pickup_lon as dropoff_lon from dynamic_pairs),
 {_turn(1, 'first_pairs')}, {_turn(2, 'second_pairs')}"""


@register(
    "r16_insert_several_pairs",
    f"""select a.route_id, round(sum({duck.hav('a.lat', 'a.lon', 'coalesce(b.lat, h_lat)', 'coalesce(b.lon, h_lon)')}), 5) as km, max(a.seq) as n_stops, count(distinct a.seq) as n_places
 from chain3 a join homes h on h.route_id = a.route_id left join chain3 b on b.route_id = a.route_id and b.seq = a.seq + 1 group by 1""",
    _IV,
    _TWO,
)
def _(t):
    since = tables_written()
    r, d, q = planned(t, two_requests)
    rebuilt, _ = scenario.insert_pairs(r, d, q)
    release_unread(since, rebuilt, d)
    sizes = rebuilt.groupBy("route_id").agg(F.max("seq").alias("n_stops"), (F.count_distinct("seq") + 1).alias("n_places"))
    return cut(sizes).join(cut(scenario.closed_route_lengths(rebuilt, d)), "route_id").withColumn("km", F.round("km", 5))


def two_requests(t):
    """A second pair for every route of ``requests``, the other way round."""
    back = {f"{a}_{c}": F.col(f"{b}_{c}") for a, b in (("pickup", "dropoff"), ("dropoff", "pickup")) for c in ("lat", "lon")}
    second = t.dynamic_pairs.select(
        F.col("pair_id").alias("route_id"), (F.col("pair_id") + 10**9).alias("pair_id"), (F.col("vehicle_key") % 3).alias("insertion_point"), *[v.alias(k) for k, v in back.items()]
    )
    return requests(t).unionByName(second)


@register(
    "r16_reoptimised_routes",
    f"""select a.route_id, round(case when n_left <= 8 then coalesce(d.km, 0) + s.km end, 6) as shortest_km, n_left + at_seq + 2 as n_stops, true as not_longer from asked a left join shortest s using (id) left join (
 select c.route_id, sum({duck.hav('c.lat', 'c.lon', 'x.lat', 'x.lon')}) as km from chain c join chain x on x.route_id = c.route_id and x.seq = c.seq + 1 join asked q on q.route_id = c.route_id where c.seq < at_seq group by 1) d on d.route_id = a.route_id""",
    _IV,
    f"{_EXACT}, chain as (select route_id, seq, lat, lon from route_stops union all select route_id, 0, h_lat, h_lon from homes)",
    recursive=True,
)
def _(t):
    rebuilt, report = insertion.reoptimise(*planned(t))
    sizes = rebuilt.groupBy("route_id").agg(F.max("seq").alias("n_stops"))
    rows = report.join(sizes, "route_id").withColumns({"shortest_km": F.when(F.col("exact"), F.col("km")), "not_longer": F.col("km") <= F.col("inserted_km") + 1e-9})
    return _r(rows.select("route_id", "shortest_km", "n_stops", "not_longer"), "shortest_km")


@register(
    "r16_reoptimised_several_pairs",
    f"""select a.route_id, round(sum({duck.hav('a.lat', 'a.lon', 'coalesce(b.lat, h_lat)', 'coalesce(b.lon, h_lon)')}), 5) as inserted_km, max(a.seq) as n_stops, count(distinct a.seq) as n_places, true as not_longer, true as in_order
 from chain3 a join homes h on h.route_id = a.route_id left join chain3 b on b.route_id = a.route_id and b.seq = a.seq + 1
 where a.route_id in (select route_id from point1 union select route_id from point2) group by 1""",
    _IV,
    _TWO,
)
def _(t):
    rebuilt, report = insertion.reoptimise(*planned(t, two_requests))
    at = lambda kind: F.min(F.when(F.col("type") == kind, F.col("seq")))
    pairs = rebuilt.where("pair_id is not null").groupBy("route_id", "pair_id").agg((at("pickup") < at("dropoff")).alias("ok")).groupBy("route_id").agg(F.bool_and("ok").alias("in_order"))
    sizes = rebuilt.groupBy("route_id").agg(F.max("seq").alias("n_stops"), (F.count_distinct("seq") + 1).alias("n_places"))
    rows = report.join(sizes, "route_id").join(pairs, "route_id")
    return rows.select("route_id", F.round("inserted_km", 5).alias("inserted_km"), "n_stops", "n_places", (F.col("km") <= F.col("inserted_km") + 1e-9).alias("not_longer"), "in_order")


_ENDS = f"""{_CENTERS}, ends as materialized (select pair_id, role, s.checkpoint_id as id, s.lat, s.lon from (select pair_id, role, arg_min(cluster_id, (km, cluster_id)) as cluster_id from (
  select pair_id, role, cluster_id, {duck.hav('e.lat', 'e.lon', 'c.lat', 'c.lon')} as km from (
   select pair_id, 'pickup' as role, pickup_lat as lat, pickup_lon as lon from dynamic_pairs union all select pair_id, 'dropoff', dropoff_lat, dropoff_lon from dynamic_pairs) e cross join centers c) group by 1, 2) join security_checkpoints s using (cluster_id)),
 {_SLOTS}, p as materialized (select pair_id, id as p_id, lat as cp_lat, lon as cp_lon from ends where role = 'pickup'), q as materialized (select pair_id, id as q_id, lat as cq_lat, lon as cq_lon from ends where role = 'dropoff'),
 pick as materialized (select g.*, p_id, cp_lat, cp_lon, {_h('a', 'cp')} + {_h('cp', 'b')} - {_h('a', 'b')} as km from gaps g join p using (pair_id)),
 drops as materialized (select g.*, q_id, {_h('a', 'cq')} + {_h('cq', 'b')} - {_h('a', 'b')} as km from gaps g join q using (pair_id)),
 tried as (select x.route_id, x.pair_id, x.km + y.km as km from pick x join drops y on y.route_id = x.route_id and y.slot > x.slot
  union all select x.route_id, x.pair_id, {_h('a', 'cp')} + {_h('cp', 'cq')} + {_h('cq', 'b')} - {_h('a', 'b')} from pick x join q using (pair_id))"""


@register(
    "r16_chosen_checkpoints",
    """select route_id, pair_id, round(min(km), 6) as added_km, cast(null as varchar) as error from tried group by 1, 2 union all
 select pair_id, pair_id, null, 'Insertion point is out of bounds' from dynamic_pairs left join sizes on route_id = pair_id where n is null or vehicle_key % 7 > n union all
 select pair_id, pair_id, null, 'No candidate checkpoint at an end' from dynamic_pairs join sizes on route_id = pair_id where vehicle_key % 7 <= n and not (pair_id in (select pair_id from p) and pair_id in (select pair_id from q))""",
    f"{_IV} location_clusters clusters security_checkpoints",
    _ENDS,
)
def _(t):
    candidates = lookups.candidate_checkpoints(pair_clusters(t), t.security_checkpoints)
    chosen, errors = insertion.choose_ends(*planned(t), candidates)
    rows = chosen.select("route_id", "pair_id", "added_km", F.lit(None).cast("string").alias("error"))
    return _r(rows.unionByName(errors.select("route_id", "pair_id", F.lit(None).cast("double").alias("added_km"), "error")), "added_km")


@register(
    "r17_needed_legs",
    "select distinct printf('route:%.5f,%.5f:%.5f,%.5f', a.lat, a.lon, b.lat, b.lon) as leg_key from route_stops a join route_stops b on a.route_id = b.route_id and b.seq = a.seq + 1",
    "route_stops",
)
def _(t):
    return scenario.needed_legs(t.route_stops).select("leg_key")


@register(
    "r17_route_geometry",
    """select route_id, round(sum(case when known then 1.3 * km else km end), 6) as km, count(*) filter (not known) as legs_missing, 1 + sum(case when known then 2 else 1 end)::bigint as n_points
 from (select *, checkpoint_id <= next_checkpoint as known from legs) group by 1""",
    "route_stops",
    _LEGS,
)
def _(t):
    pairs = reports.legs(t.route_stops, "checkpoint_id").where("checkpoint_id <= next_checkpoint_id")
    middle = F.array((F.col("lat") + F.col("next_lat")) / 2, (F.col("lon") + F.col("next_lon")) / 2)
    known = pairs.select(
        geo.leg_key("lat", "lon", "next_lat", "next_lon").alias("leg_key"), F.array(F.array("lat", "lon"), middle, F.array("next_lat", "next_lon")).alias("geometry"),
        (F.col("km") * 1.3).alias("distance_km"),
    )
    legs = known.groupBy("leg_key").agg(F.min(F.struct("geometry", "distance_km")).alias("l")).select("leg_key", "l.*")
    points, lengths = scenario.route_geometry(t.route_stops, legs)
    return _r(lengths.join(points.groupBy("route_id").agg(F.count("*").alias("n_points")), "route_id"), "km")


_TYPED = """typed as (select r.*, n, case when seq = 1 then case when o_orderstatus = 'F' then 'dropoff' else 'pickup' end when seq = n then case when o_orderstatus = 'F' then 'pickup' else 'dropoff' end else 'stop' end as type
 from route_stops r join (select route_id, max(seq) as n from route_stops group by 1) using (route_id) join orders on o_orderkey = route_id)"""


@register(
    "r18_audit_routes",
    """select run_id, route_id, null as node_id, 'precedence' as rule from typed where type = 'dropoff' and (o_status_f or n = 1) union all select run_id, route_id, null, 'unfinished' from typed where type = 'pickup' and n = 1 union all
 select l.location_id, null, f.first, 'missing' from location_clusters l join (select cluster_id, min(checkpoint_id) as first from security_checkpoints group by 1) f using (cluster_id) where not exists (select 1 from route_stops r where r.run_id = l.location_id and r.checkpoint_id = f.first)
 union all select run_id, route_id, null, 'too long' from whole join (select route_id, min(run_id) as run_id from route_stops group by 1) using (route_id) where km > 120""".replace("o_status_f", "seq = 1"),
    "route_stops location_clusters security_checkpoints dynamic_pairs locations",
    f"{_SLOTS}, {_TYPED}",
)
def _(t):
    stops = cut(t.route_stops.select("run_id", "route_id", "seq", "checkpoint_id", "lat", "lon"))
    size = stops.groupBy("route_id").agg(F.max("seq").alias("n"))
    status = t.orders.select(F.col("o_orderkey").alias("route_id"), (F.col("o_orderstatus") == "F").alias("f"))
    base = stops.join(size, "route_id").join(status, "route_id")
    kind = F.when(F.col("seq") == 1, F.when(F.col("f"), "dropoff").otherwise("pickup")).when(F.col("seq") == F.col("n"), F.when(F.col("f"), "pickup").otherwise("dropoff")).otherwise("stop")
    whole = cut(base.select("run_id", "route_id", "seq", F.col("checkpoint_id").alias("node_id"), F.col("route_id").alias("pair_id"), kind.alias("type"), "lat", "lon"))
    first = reports.first_checkpoint(t.security_checkpoints).select("cluster_id", F.col("checkpoint_id").alias("node_id"))
    mandatory = t.location_clusters.join(first, "cluster_id").select(F.col("location_id").alias("run_id"), "node_id")
    return scenario.audit_routes(whole, mandatory, 120, route_depots(t)).select("run_id", "route_id", "node_id", "rule")


@register(
    "r19_compare_algorithms",
    f"""select instance_id, one_vehicle, two_vehicles, round((one_vehicle - two_vehicles) / nullif(one_vehicle, 0) * 100, 4) as two_vehicles_gain from (select preset_id as instance_id, round(max(case when v = 1 then km end), 6) as one_vehicle, round(max(case when v = 2 then km end), 6) as two_vehicles from (
 select 1 as v, preset_id, sum(w.km) + sum(case when step % share = 0 or step = n then {duck.hav('w.lat', 'w.lon', 'd_lat', 'd_lon')} else 0 end) as km from walk w join shares using (preset_id) join (select preset_id, max(step) as n from walk group by 1) using (preset_id) where step > 0 group by 1, 2
 union all select 2, preset_id, sum(w.km) + sum(case when step % share = 0 or step = n then {duck.hav('w.lat', 'w.lon', 'd_lat', 'd_lon')} else 0 end) from walk2 w join shares2 using (preset_id) join (select preset_id, max(step) as n from walk2 group by 1) using (preset_id) where step > 0 group by 1, 2) group by 1)""",
    _SV,
    f"{_ONE}, {_STATIC.format(v=2).split('shares as')[1].join(['shares2 as', ''])}, {_walk(name='walk2', shares='shares2')}",
    recursive=True,
)
def _(t):
    depots, stops = static(t)
    runs = []
    for name, n in (("one_vehicle", 1), ("two_vehicles", 2)):
        cars = depots.withColumn("vehicles", F.lit(n))
        tour = tours.nearest_tours(cars, stops, "vehicles")
        runs.append(tours.closed_lengths(depots, stops, tour).withColumn("algorithm", F.lit(name)))
    rows = scenario.compare_algorithms(runs[0].unionByName(runs[1]), ["one_vehicle", "two_vehicles"])
    rows = _r(rows, "one_vehicle", "two_vehicles")
    gain = (F.col("one_vehicle") - F.col("two_vehicles")) / F.nullif("one_vehicle", F.lit(0.0)) * 100
    return rows.withColumn("two_vehicles_gain", F.round(gain, 4))
