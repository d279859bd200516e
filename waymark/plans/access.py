"""Checkpoint generation for all clusters at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import grid, hulls, reports, roads
from waymark.session import cut_large as cut
from waymark.sources import tables

# Radii in degrees of the area and of the boundary, for a hull and for a lone centre.
ROUTE_BOUNDARY = (0.0005, 0.0015)


def topology_access_points(members: DataFrame, centers: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Access points from the network around each cluster: boundary nodes, road class changes and barriers, merged;
    clusters without any get the two inside nodes nearest to a main road."""
    areas = cut(hulls.cluster_areas(members, centers, roads.AREA_DEGREES, roads.AREA_DEGREES))
    part, network = roads.network_around(nodes, edges, areas, centers)
    network = cut(network)
    inside = cut(roads.inside_nodes(part, areas, members))
    detected = {
        "articulation_point": (roads.boundary_nodes(inside, network), roads.DETECTED),
        "highway_transition": (roads.highway_transitions(inside, network), roads.DETECTED),
        "barrier": (roads.barrier_nodes(inside, nodes, network), roads.BARRIER),
    }
    found = None
    for method, (rows, confidence) in detected.items():
        tagged = rows.withColumns({"method": F.lit(method), "confidence": F.lit(confidence)})
        found = tagged if found is None else found.unionByName(tagged)
    best = cut(roads.merge_access_points(cut(found).join(nodes.select("node_id", "lat", "lon"), "node_id"))).select("cluster_id", "node_id", "method", "confidence")
    without = inside.join(best, "cluster_id", "left_anti")
    near = roads.nearest_main_roads(without, nodes, network).select(
        "cluster_id", "node_id", F.lit("nearest_main_road").alias("method"), F.lit(roads.NEAREST_ROAD).alias("confidence")
    )
    return scoped_records(best.unionByName(near), nodes, network)


def scoped_records(found: DataFrame, nodes: DataFrame, network: DataFrame) -> DataFrame:
    """Access point records with the road types seen in each cluster's own network."""
    ends = reports.edge_ends(network).groupBy("cluster_id", "node_id", F.coalesce("highway", F.lit("unknown")).alias("highway")).agg(F.count("*").alias("n"))
    types = ends.groupBy("cluster_id", "node_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "highway"))).alias("t"))
    joined = found.join(nodes.select("node_id", "lat", "lon"), "node_id").join(types, ["cluster_id", "node_id"], "left")
    first = F.coalesce(F.get("t", F.lit(0))["highway"], F.lit("unknown"))
    return joined.select(
        "cluster_id", "node_id", "lat", "lon", first.alias("from_road_type"),
        F.coalesce(F.get("t", F.lit(1))["highway"], first).alias("to_road_type"), "method", "confidence",
    )


def route_access_points(members: DataFrame, depots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Access points where the shortest ways of a cluster's members to its depot cross the cluster's border.

    ``depots``: cluster_id, source_id, lat, lon. The two nodes crossed most often per cluster are kept; clusters
    without a crossing are left out.
    """
    means = members.groupBy("cluster_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    border = hulls.cluster_areas(members, means, *ROUTE_BOUNDARY).select("cluster_id", "ring", "radius")
    served = members.join(depots.select("cluster_id", "source_id"), "cluster_id")
    source = depots.select("source_id", "lat", "lon").distinct()
    goal = grid.nearest(source, "source_id", nodes, "node_id").select("source_id", "node_id")
    at = grid.nearest(served, "location_id", nodes, "node_id").select("location_id", "node_id")
    starts = served.join(at, "location_id").select("cluster_id", "location_id", "source_id", "node_id")
    paths = roads.shortest_paths(nodes, edges, goal, starts.select("source_id", "node_id"))
    reachable = cut(starts.join(paths.select("source_id", "node_id"), ["source_id", "node_id"], "left_semi"))
    walked = roads.walk_paths(paths, reachable.select(F.col("location_id").alias("route_id"), "source_id", "node_id"))
    steps = walked.join(reachable.select(F.col("location_id").alias("route_id"), "cluster_id"), "route_id")
    passed = steps.groupBy("cluster_id", "node_id").agg(F.lit(1).alias("one")).join(nodes.select("node_id", "lat", "lon"), "node_id").join(border, "cluster_id")
    flag = cut(passed.select("cluster_id", "node_id", (hulls.ring_distance(F.col("ring"), F.col("lon"), F.col("lat")) < F.col("radius")).alias("inside")))
    flagged = steps.join(flag, ["cluster_id", "node_id"]).select("cluster_id", "route_id", "seq", "node_id", "inside")
    following = flagged.select("cluster_id", "route_id", (F.col("seq") - 1).alias("seq"), F.col("node_id").alias("next_node"), F.col("inside").alias("next_inside"))
    crossed = flagged.join(following, ["cluster_id", "route_id", "seq"]).where("inside <> next_inside")
    counted = crossed.groupBy("cluster_id", F.when(F.col("inside"), F.col("node_id")).otherwise(F.col("next_node")).alias("node_id")).agg(F.count("*").alias("crossings"))
    top = reports.top_per_group(counted, "cluster_id", [F.desc("crossings"), F.asc("node_id")], 2)
    routes = reachable.groupBy("cluster_id").agg(F.count("*").alias("routes"))
    found = top.join(routes, "cluster_id").select(
        "cluster_id", "node_id", F.lit("route_crossing").alias("method"), geo.crossing_confidence("crossings", "routes").alias("confidence")
    )
    return roads.access_records(found, nodes, edges)


def fallback_checkpoints(loc: DataFrame, lc: DataFrame) -> DataFrame:
    """The member furthest from the middle of its cluster, for clusters on which nothing else was found."""
    return reports.furthest_member(loc, lc).select(
        "cluster_id", "lat", "lon", F.lit("unknown").alias("from_road_type"), F.lit("residential").alias("to_road_type"), F.lit(roads.FALLBACK).alias("confidence")
    )


def generate_checkpoints(
    loc: DataFrame, lc: DataFrame, cl: DataFrame, nodes: DataFrame, edges: DataFrame, cp: DataFrame,
    depots: DataFrame | None = None, regenerate: bool = True,
) -> DataFrame:
    """Checkpoints of all clusters with members: by routes where a depot is known, else by topology, else the fallback.

    With ``regenerate=False`` clusters that have checkpoints keep them.
    """
    columns = ["cluster_id", "lat", "lon", "from_road_type", "to_road_type", "confidence"]
    members = loc.select("location_id", "lat", "lon").join(lc, "location_id")
    if not regenerate:
        members = members.join(cp, "cluster_id", "left_anti")
    members = cut(members)
    means = members.groupBy("cluster_id").agg(F.avg("lat").alias("m_lat"), F.avg("lon").alias("m_lon"))
    centers = means.join(cl, "cluster_id", "left").select(
        "cluster_id", F.coalesce("centroid_lat", "m_lat").alias("lat"), F.coalesce("centroid_lon", "m_lon").alias("lon")
    )
    found = None
    if depots is not None:
        found = cut(route_access_points(members, depots, nodes, edges).select(columns))
        left = members.join(found, "cluster_id", "left_anti")
    else:
        left = members
    by_topology = cut(topology_access_points(left, centers.join(left, "cluster_id", "left_semi"), nodes, edges).select(columns))
    found = by_topology if found is None else found.unionByName(by_topology)
    rest = members.join(found, "cluster_id", "left_anti")
    found = found.unionByName(fallback_checkpoints(rest, rest.select("location_id", "cluster_id")).select(columns))
    return tables.replace_checkpoints(cp, found, regenerate)
