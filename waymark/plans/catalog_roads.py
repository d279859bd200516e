"""Registered queries of the spatial and road graph operators (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import components, density, grid, hulls, lookups, reports, roads
from waymark.plans import access, duck
from waymark.plans.catalog_functions import _LEVELS
from waymark.plans.registry import register
from waymark.session import cut


def members(t):
    return t.locations.select("location_id", "lat", "lon").join(t.location_clusters, "location_id")


def centers(t):
    return t.clusters.select("cluster_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"))


def both_ways(t):
    """The road edges in both directions."""
    back = t.road_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "highway", "length_m", "access")
    return t.road_edges.unionByName(back)


def depots(t):
    """One depot per region of 25 clusters: the location with the lowest id there."""
    region = F.floor(F.col("location_id") / 1500)
    first = t.locations.groupBy(region.alias("source_id")).agg(F.min_by(F.struct("lat", "lon"), "location_id").alias("p"))
    served = t.clusters.select("cluster_id", F.floor(F.col("cluster_id") / 25).alias("source_id"))
    return served.join(first, "source_id").select("cluster_id", "source_id", "p.lat", "p.lon")


def areas(t):
    return cut(hulls.cluster_areas(members(t), centers(t), roads.AREA_DEGREES, roads.AREA_DEGREES))


# A pair of members is a side of the hull if no member lies to its right, nor on its line beyond it.
_CROSS = "(b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon)"
_HULLS = f"""mem as materialized (select location_id, lat, lon, cluster_id from locations join location_clusters using (location_id)),
 spots as materialized (select distinct cluster_id, lat, lon from mem),
 sizes as materialized (select cluster_id, count(*) as n_members from mem group by 1),
 sides as materialized (select a.cluster_id, a.lat as a_lat, a.lon as a_lon, b.lat as b_lat, b.lon as b_lon from spots a join spots b on a.cluster_id = b.cluster_id and (a.lat <> b.lat or a.lon <> b.lon)
  join spots c on c.cluster_id = a.cluster_id join sizes s on s.cluster_id = a.cluster_id where n_members >= 3 group by all
  having bool_and({_CROSS} > 1e-13 or ({_CROSS} >= -1e-13 and (c.lat - a.lat) * (c.lat - b.lat) + (c.lon - a.lon) * (c.lon - b.lon) <= 0)))"""


@register(
    "g1_cluster_areas",
    "select cluster_id, n_members, round(coalesce(area, 0), 9) as area from sizes join clusters using (cluster_id) left join (select cluster_id, abs(sum(a_lon * b_lat - b_lon * a_lat)) / 2 as area from sides group by 1) using (cluster_id)",
    "locations location_clusters clusters",
    _HULLS,
)
def _(t):
    return areas(t).select("cluster_id", "n_members", F.round(hulls.ring_area(F.col("ring")), 9).alias("area"))


@register(
    "g2_points_in_areas",
    f"""select cluster_id, location_id from (select cluster_id, location_id, bool_and((b_lon - a_lon) * (lat - a_lat) - (b_lat - a_lat) * (lon - a_lon) >= 0) as inside,
  min(sqrt(pow(lon - a_lon - part * (b_lon - a_lon), 2) + pow(lat - a_lat - part * (b_lat - a_lat), 2))) as gap from (select s.*, l.location_id, l.lat, l.lon,
   least(greatest(((l.lon - a_lon) * (b_lon - a_lon) + (l.lat - a_lat) * (b_lat - a_lat)) / (pow(b_lon - a_lon, 2) + pow(b_lat - a_lat, 2)), 0), 1) as part from sides s cross join locations l) group by 1, 2)
 where inside or gap < {roads.AREA_DEGREES} union all select cluster_id, location_id from sizes join clusters using (cluster_id) cross join locations where n_members < 3 and sqrt(pow(lon - centroid_lon, 2) + pow(lat - centroid_lat, 2)) < {roads.AREA_DEGREES}""",
    "locations location_clusters clusters",
    _HULLS,
)
def _(t):
    return hulls.points_in_areas(t.locations, "location_id", areas(t)).select("cluster_id", "location_id")


def network(t, around):
    return roads.network_around(t.road_nodes, both_ways(t), around, centers(t))


@register("g3_network_around")
def _(t):
    part, edges = network(t, areas(t))
    counts = part.groupBy("cluster_id").agg(F.count("*").alias("n_nodes"))
    return counts.join(edges.groupBy("cluster_id").agg(F.count("*").alias("n_edges")), "cluster_id", "left")


@register(
    "g4_enrich_edges",
    f"select src, dst, {_LEVELS} as hierarchy, {_LEVELS} <= 5 as is_main_road, highway in ('residential', 'living_street') as is_residential from road_edges",
    "road_edges",
)
def _(t):
    return roads.enrich_edges(t.road_edges).select("src", "dst", "hierarchy", "is_main_road", "is_residential")


@register("g5_inside_nodes")
def _(t):
    around = areas(t)
    part, _edges = network(t, around)
    return roads.inside_nodes(part, around, members(t))


_INSIDE = """boxes as (select cluster_id, min(lat) as a, max(lat) as b, min(lon) as c, max(lon) as d from locations join location_clusters using (location_id) group by 1),
 inside as (select cluster_id, node_id from boxes join road_nodes on lat between a and b and lon between c and d),
 ends as (select src as node_id, dst as other, highway, access from road_edges union all select dst, src, highway, access from road_edges)"""
_VIEWS = "locations location_clusters road_nodes road_edges"


def inside_boxes(t):
    """Nodes in the bounding box of every cluster's members."""
    def corner(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    box = members(t).groupBy("cluster_id").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    rings = box.select("cluster_id", F.array(corner("c", "a"), corner("d", "a"), corner("d", "b"), corner("c", "b")).alias("ring"), F.lit(1e-12).alias("radius"))
    return hulls.points_in_areas(t.road_nodes, "node_id", rings).select("cluster_id", "node_id")


_BOUNDARY = """boundary as (select distinct i.cluster_id, i.node_id from inside i join ends e on e.node_id = i.node_id left join inside o on o.cluster_id = i.cluster_id and o.node_id = e.other where o.node_id is null)"""


@register("g6_boundary_nodes", "select * from boundary", _VIEWS, f"{_INSIDE}, {_BOUNDARY}")
def _(t):
    return roads.boundary_nodes(inside_boxes(t), t.road_edges)


@register(
    "g7_components",
    "select node_id as node, label from spread",
    "road_edges",
    """links as materialized (select src as a, dst as b from road_edges union select dst, src from road_edges),
 spread(node_id, label) using key (node_id) as (select distinct a, a from links union
  select l.b, min(s.label) from spread s join links l on l.a = s.node_id join recurring.spread r on r.node_id = l.b where s.label < r.label group by 1)""",
    recursive=True,
)
def _(t):
    return components.components(t.road_edges, "src", "dst")


_FLAGS = "flags as (select node_id, bool_or(highway in ('primary', 'secondary')) as main, bool_or(highway in ('residential', 'living_street')) as res, bool_or(coalesce(access = 'private', false)) as restricted from ends group by 1)"


@register("g8_highway_transitions", "select cluster_id, node_id from inside join flags using (node_id) where main and res", _VIEWS, f"{_INSIDE}, {_FLAGS}")
def _(t):
    return roads.highway_transitions(inside_boxes(t), t.road_edges)


@register(
    "g9_barrier_nodes",
    "select cluster_id, node_id from inside join road_nodes using (node_id) left join flags using (node_id) where barrier is not null or restricted",
    _VIEWS,
    f"{_INSIDE}, {_FLAGS}",
)
def _(t):
    return roads.barrier_nodes(inside_boxes(t), t.road_nodes, t.road_edges)


_MAIN = """main as (select distinct node_id, lat, lon from ends join road_nodes using (node_id) where highway in ('primary', 'secondary')),
 close as (select cluster_id, i.node_id, min(sqrt(pow(n.lat - m.lat, 2) + pow(n.lon - m.lon, 2))) as degrees from inside i join road_nodes n using (node_id) cross join main m group by 1, 2)"""


@register(
    "g10_nearest_main_roads",
    "select cluster_id, node_id, round(degrees, 9) as degrees, r as rank from (select *, row_number() over (partition by cluster_id order by round(degrees, 9), node_id) as r from close) where r <= 2",
    _VIEWS,
    f"{_INSIDE}, {_MAIN}",
)
def _(t):
    rows = roads.nearest_main_roads(inside_boxes(t), t.road_nodes, t.road_edges)
    return rows.select("cluster_id", "node_id", F.round("degrees", 9).alias("degrees"), "rank")


@register(
    "t5_two_nearest_main_roads",
    "select cluster_id, count(*) as n from (select *, row_number() over (partition by cluster_id order by round(degrees, 9), node_id) as r from close) where r <= 2 group by 1",
    _VIEWS,
    f"{_INSIDE}, {_MAIN}",
)
def _(t):
    return roads.nearest_main_roads(inside_boxes(t), t.road_nodes, t.road_edges).groupBy("cluster_id").agg(F.count("*").alias("n"))


@register(
    "g11_fallback_checkpoints",
    """select cluster_id, round(arg_min(lat, (-d, location_id)), 6) as lat, round(arg_min(lon, (-d, location_id)), 6) as lon, 'unknown' as from_road_type, 'residential' as to_road_type, 0.3 as confidence from (
 select *, sqrt(pow(lat - avg(lat) over w, 2) + pow(lon - avg(lon) over w, 2)) as d from locations join location_clusters using (location_id) window w as (partition by cluster_id)) group by 1""",
    "locations location_clusters",
)
def _(t):
    rows = access.fallback_checkpoints(t.locations, t.location_clusters)
    return rows.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


def _density_sql(source, key, km, k):
    return f"""pts as (select {key} as id, lat, lon from {source}),
 near as (select a.id as a, b.id as b from pts a join pts b on abs(a.lat - b.lat) < {km} / 100 and abs(a.lon - b.lon) < {km} / 100 and {duck.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {km}),
 core as (select a as id from near group by 1 having count(*) >= {k}),
 reach(a, b) as (select id, id from core union select r.a, n.b from reach r join near n on n.a = r.b join core c on c.id = n.b),
 grp as (select a as id, min(b) as g from reach group by 1),
 border as (select n.a as id, min(g) as g from near n join grp on grp.id = n.b where n.a not in (select id from core) group by 1)"""


@register(
    "g12_density_groups",
    "select id as location_id, coalesce(grp.g, border.g, id) as group_id, coalesce(grp.g, border.g) is null as is_noise from pts left join grp using (id) left join border using (id)",
    "locations",
    _density_sql("locations", "location_id", 0.35, 5),
    recursive=True,
)
def _(t):
    return density.density_groups(t.locations, "location_id", 350, 5)


@register(
    "g13_merge_access_points",
    """select cluster_id, arg_min(id, (-confidence, o, id)) as node_id from (select c.cluster_id, g, s.checkpoint_id as id, confidence, case s.checkpoint_id % 3 when 0 then 1 when 1 then 2 else 3 end as o
 from grp join security_checkpoints s on s.checkpoint_id = grp.id join (select checkpoint_id, cluster_id from security_checkpoints) c using (checkpoint_id)) group by cluster_id, g""",
    "security_checkpoints",
    """near as (select a.checkpoint_id as a, b.checkpoint_id as b from security_checkpoints a join security_checkpoints b on a.cluster_id = b.cluster_id and sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) < 6000 / 111000),
 reach(a, b) as (select a, b from near union select r.a, n.b from reach r join near n on n.a = r.b), grp as (select a as id, min(b) as g from reach group by 1)""",
    recursive=True,
)
def _(t):
    method = F.element_at(F.array(*[F.lit(m) for m in roads.METHODS]), (F.col("checkpoint_id") % 3 + 1).cast("int"))
    points = t.security_checkpoints.select("cluster_id", F.col("checkpoint_id").alias("node_id"), "lat", "lon", method.alias("method"), "confidence")
    return roads.merge_access_points(points, 6000).select("cluster_id", "node_id")


def _goal(t):
    source = depots(t).select("source_id", "lat", "lon").distinct()
    return grid.nearest(source, "source_id", t.road_nodes, "node_id").select("source_id", "node_id")


@register(
    "g14_shortest_paths",
    "select source_id, node_id, metres from walk",
    "locations road_nodes road_edges",
    f"""depots as (select cast(floor(location_id / 1500) as bigint) as source_id, arg_min(lat, location_id) as lat, arg_min(lon, location_id) as lon from locations group by 1),
 goals as (select source_id, arg_min(node_id, (km, node_id)) as node_id from (select source_id, node_id, {duck.hav('d.lat', 'd.lon', 'n.lat', 'n.lon')} as km from depots d cross join road_nodes n) group by 1),
 links as materialized (select src, dst, length_m from road_edges union all select dst, src, length_m from road_edges),
 walk(source_id, node_id, metres) using key (source_id, node_id) as (select source_id, node_id, 0e0 from goals union
  select w.source_id, l.src, min(w.metres + l.length_m) from walk w join links l on l.dst = w.node_id left join recurring.walk r on r.source_id = w.source_id and r.node_id = l.src
  where r.metres is null or w.metres + l.length_m < r.metres group by 1, 2)""",
    recursive=True,
)
def _(t):
    return roads.shortest_paths(t.road_nodes, both_ways(t), _goal(t)).select("source_id", "node_id", "metres")


@register("g15_route_access_points")
def _(t):
    rows = access.route_access_points(members(t), depots(t), t.road_nodes, both_ways(t))
    return rows.withColumns({c: F.round(c, 6) for c in ("lat", "lon", "confidence")})


@register("g16_topology_access_points")
def _(t):
    rows = access.topology_access_points(members(t), centers(t), t.road_nodes, both_ways(t))
    return rows.withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


_TYPES = """types as (select node_id, max(case when r = 1 then highway end) as f, max(case when r = 2 then highway end) as s from (
 select node_id, highway, row_number() over (partition by node_id order by count(*) desc, highway) as r from ends group by 1, 2) group by 1)"""


@register(
    "g17_access_records",
    "select cluster_id, node_id, round(lat, 6) as lat, round(lon, 6) as lon, f as from_road_type, coalesce(s, f) as to_road_type, 'articulation_point' as method, 0.7 as confidence from boundary join road_nodes using (node_id) left join types using (node_id)",
    _VIEWS,
    f"{_INSIDE}, {_BOUNDARY}, {_TYPES}",
)
def _(t):
    found = roads.boundary_nodes(inside_boxes(t), t.road_edges).withColumns({"method": F.lit("articulation_point"), "confidence": F.lit(0.7)})
    return roads.access_records(found, t.road_nodes, t.road_edges).withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@register("g18_generate_checkpoints")
def _(t):
    rows = access.generate_checkpoints(
        t.locations, t.location_clusters, t.clusters, t.road_nodes, both_ways(t), t.security_checkpoints, depots(t), regenerate=True
    )
    return rows.withColumns({c: F.round(c, 6) for c in ("lat", "lon", "confidence")})
