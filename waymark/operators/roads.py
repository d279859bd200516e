"""Road graph operators. Tables: ``nodes`` (node_id, lat, lon, barrier), ``edges`` (src, dst, highway, length_m, access).

Where an edge or node table carries ``cluster_id`` it is the part of the network around that cluster, and the
operator works on every cluster's part at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import grid, hulls, reports
from waymark.operators.density import density_groups
from waymark.session import cut_large as cut, cut_large_and_measure as cut_and_measure, spread

# Fixed values of the access point search.
AREA_DEGREES, NETWORK_METRES, CENTER_METRES, MERGE_METRES = 0.002, 300, 450, 50
DETECTED, BARRIER, NEAREST_ROAD, FALLBACK = 0.7, 1.0, 0.5, 0.3
METHODS = ["articulation_point", "highway_transition", "barrier"]
BLOCK_DEGREES, BLOCK_NODES, HUB_EDGES = 0.05, 2_000, 1_000


def _scope(df: DataFrame) -> list[str]:
    return ["cluster_id"] if "cluster_id" in df.columns else []


def neighbours(edges: DataFrame) -> DataFrame:
    """(node_id, neighbour_id) in both directions, each once."""
    scope = _scope(edges)
    forward = edges.select(*scope, F.col("src").alias("node_id"), F.col("dst").alias("neighbour_id"))
    return forward.unionByName(edges.select(*scope, F.col("dst").alias("node_id"), F.col("src").alias("neighbour_id"))).distinct()


def enrich_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({
        "hierarchy": geo.road_level("highway"), "is_main_road": geo.is_main_road("highway"), "is_residential": geo.is_residential("highway")
    })


def network_around(nodes: DataFrame, edges: DataFrame, areas: DataFrame, centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within 300 m of every area; around the centre if an area has no node near."""
    near = cut(hulls.points_in_areas(nodes, "node_id", hulls.widened(areas, geo.metres_to_degrees(NETWORK_METRES))))
    lonely = centers.join(near, "cluster_id", "left_anti").select(
        "cluster_id", F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("ring"),
        F.lit(geo.metres_to_degrees(CENTER_METRES)).alias("radius"),
    )
    part = cut(near.unionByName(hulls.points_in_areas(nodes, "node_id", lonely)))
    ends = part.select("cluster_id", "node_id")
    inner = edges.hint("merge").join(ends.withColumnRenamed("node_id", "src"), "src").join(ends.withColumnRenamed("node_id", "dst"), ["cluster_id", "dst"])
    return part, inner


def inside_nodes(part: DataFrame, areas: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, node_id) of the network nodes in each area; if there is none, those nearest to the members."""
    ring = areas.select("cluster_id", "ring", "radius")
    met = spread(part, "cluster_id").join(spread(ring, "cluster_id").hint("merge"), "cluster_id")
    inside = cut(met.where(hulls.ring_distance(F.col("ring"), F.col("lon"), F.col("lat")) < F.col("radius")).select("cluster_id", "node_id"))
    empty = part.select("cluster_id").distinct().join(inside, "cluster_id", "left_anti")
    seekers = members.join(empty, "cluster_id", "left_semi")
    near = grid.nearest(seekers, "location_id", part.join(empty, "cluster_id", "left_semi"), "node_id", by=["cluster_id"])
    return inside.unionByName(near.select("cluster_id", "node_id").distinct())


def boundary_nodes(inside: DataFrame, edges: DataFrame) -> DataFrame:
    """Inside nodes with a neighbour outside."""
    links = neighbours(edges)
    reached = inside.join(links, [*_scope(edges), "node_id"])
    within = inside.select("cluster_id", F.col("node_id").alias("neighbour_id"))
    return reached.join(within, ["cluster_id", "neighbour_id"], "left_anti").select("cluster_id", "node_id").distinct()


def node_flags(edges: DataFrame) -> DataFrame:
    """Per node: touches a main road, a residential road, a restricted road."""
    tags = [c for c in ("access", "motor_vehicle", "vehicle") if c in edges.columns]
    return reports.edge_ends(edges).groupBy(*_scope(edges), "node_id").agg(
        F.bool_or(geo.is_main_road("highway")).alias("main"), F.bool_or(geo.is_residential("highway")).alias("residential"),
        F.bool_or(geo.restricted_access(*tags)).alias("restricted"),
    )


def highway_transitions(inside: DataFrame, edges: DataFrame) -> DataFrame:
    flags = node_flags(edges)
    return inside.join(flags, [*_scope(edges), "node_id"]).where("main and residential").select("cluster_id", "node_id")


def barrier_nodes(inside: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    tagged = inside.join(nodes.select("node_id", "barrier"), "node_id").join(node_flags(edges), [*_scope(edges), "node_id"], "left")
    return tagged.where("barrier is not null or restricted").select("cluster_id", "node_id")


def nearest_main_roads(inside: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 2) -> DataFrame:
    """Per cluster the k inside nodes nearest to an end of a main road."""
    place = nodes.select("node_id", "lat", "lon").distinct()
    scope = _scope(edges)
    inside = cut(inside)
    ends = reports.edge_ends(edges.where(geo.is_main_road("highway"))).select(*scope, "node_id").distinct()
    targets = ends.join(place, "node_id").withColumnRenamed("node_id", "main_node")
    points = inside.join(place, "node_id")
    if not scope:
        points = points.select("node_id", "lat", "lon").distinct()
    near = grid.nearest(points, "node_id", targets, "main_node", by=scope, planar=True)
    ranked = inside.join(near, [*scope, "node_id"])
    return reports.top_per_group(ranked, "cluster_id", [F.asc("degrees"), F.asc("node_id")], k)


def access_records(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Access points from (cluster_id, node_id, method, confidence): coordinate and the two most common road types."""
    types = reports.common_road_types(edges)
    joined = found.join(nodes.select("node_id", "lat", "lon").distinct(), "node_id").join(types, "node_id", "left")
    return joined.select(
        "cluster_id", "node_id", "lat", "lon", F.coalesce("from_type", F.lit("unknown")).alias("from_road_type"),
        F.coalesce("to_type", F.lit("unknown")).alias("to_road_type"), "method", "confidence",
    )


def merge_access_points(points: DataFrame, metres: float = MERGE_METRES) -> DataFrame:
    """Per cluster one access point of those closer than 50 m: highest confidence, then method order, then node."""
    order = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    rank = F.struct((-F.col("confidence")).alias("c"), order.alias("o"), "node_id")
    groups = density_groups(points.select("cluster_id", "node_id", "lat", "lon").distinct(), "node_id", metres, by=["cluster_id"], planar=True)
    joined = points.join(groups.select("cluster_id", "node_id", "group_id"), ["cluster_id", "node_id"])
    best = joined.groupBy("cluster_id", "group_id").agg(F.min_by(F.struct(*points.columns), rank).alias("b"))
    return best.select("b.*")


# ---- shortest paths ------------------------------------------------------------------------------------------------


def _relax(key, state: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Shortest distances inside one block of nodes, and offers to the nodes of other blocks.

    All edges of the block relax at once until no distance falls; as often as a shortest way in the block has edges.
    """
    src, dst, length = (edges[c].to_numpy() for c in ("src", "dst", "length_m"))
    here = edges["src_block"].to_numpy() == key[1]
    ids = np.unique(np.concatenate([state["node_id"].to_numpy(), dst, src[here]])).astype(np.int64)
    metres, following = np.full(len(ids), np.inf), pd.array([pd.NA] * len(ids), dtype="Int64")
    known = np.searchsorted(ids, state["node_id"].to_numpy())
    metres[known], following[known] = state["metres"].to_numpy(), state["next_node"].astype("Int64")
    before = metres.copy()
    order = np.argsort(src[here], kind="stable")
    s, t, w = np.searchsorted(ids, src[here][order]), np.searchsorted(ids, dst[here][order]), length[here][order]
    if len(s):
        first = np.flatnonzero(np.diff(s, prepend=-1))
        while True:
            best = np.minimum.reduceat(metres[t] + w, first)
            lower = best < metres[s[first]]
            if not lower.any():
                break
            metres[s[first][lower]] = best[lower]
        via = np.minimum.reduceat(np.where(metres[t] + w == metres[s], ids[t], np.iinfo(np.int64).max), first)
        fell = metres[s[first]] < before[s[first]]
        following[s[first][fell]] = via[fell]
    reached = np.isfinite(metres)
    inner = pd.DataFrame({"node_id": ids[reached], "metres": metres[reached], "next_node": following[reached], "offered": False})
    out = pd.DataFrame({"node_id": src[~here], "metres": metres[np.searchsorted(ids, dst[~here])] + length[~here], "next_node": pd.array(dst[~here], dtype="Int64"), "offered": True})
    out = out[np.isfinite(out["metres"])].sort_values(["metres", "next_node"]).drop_duplicates("node_id")
    rows = pd.concat([inner, out]) if len(out) else inner
    return rows.assign(source_id=key[0])[["source_id", "node_id", "metres", "next_node", "offered"]]


def shortest_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(source_id, node_id, metres, next_node): shortest way from every node to every source along directed edges.

    With ``wanted`` (source_id, node_id) only those nodes, and the nodes on their ways, are sure to be right: a source goes on
    only with offers shorter than its furthest wanted node, once all of them are reached.

    The graph is cut into blocks of neighbouring nodes, at most about 2,000 each: crowded cells are cut by a finer grid. A round settles all blocks that
    received a better offer, each in one task, and sends offers over the block borders; it takes as many rounds as a
    path crosses borders, not one per edge. Nodes with very many edges take no part in a block's task: their offers
    are a join. Every round is written, so a lost executor costs one round.
    """
    cell = F.struct(*[F.floor(F.col(c) / BLOCK_DEGREES).alias(c) for c in ("lat", "lon")])
    coarse = nodes.select("node_id", "lat", "lon", cell.alias("whole"))
    across = F.ceil(F.sqrt(F.count("*") / BLOCK_NODES)).alias("across")
    fine = F.struct("whole", *[F.floor(F.col(c) / BLOCK_DEGREES * F.col("across")).alias(c) for c in ("lat", "lon")])
    celled = coarse.join(coarse.groupBy("whole").agg(across), "whole").select("node_id", fine.alias("cell"))
    # nodes that lie even closer are dealt by hash
    crowd = celled.groupBy("cell").agg(F.ceil(F.count("*") / (4 * BLOCK_NODES)).alias("parts"))
    part = F.pmod(F.xxhash64("node_id"), F.col("parts"))
    degree = edges.groupBy(F.col("dst").alias("node_id")).agg((F.count("*") > HUB_EDGES).alias("hub"))
    blocks = cut(
        celled.join(crowd, "cell").join(degree, "node_id", "left")
        .select("node_id", F.xxhash64("cell", part).alias("block"), F.coalesce("hub", F.lit(False)).alias("hub"))
    )
    roads, seen = cut_and_measure(
        edges.select("src", "dst", "length_m")
        .join(blocks.select(F.col("node_id").alias("dst"), F.col("block").alias("to_block"), "hub"), "dst")
        .join(blocks.select(F.col("node_id").alias("src"), F.col("block").alias("src_block")), "src"),
        hubs=F.count_if(F.col("hub")),
    )
    has_hubs = seen["hubs"] > 0
    start = sources.select("source_id", "node_id", F.lit(0.0).alias("metres"), F.lit(None).cast("bigint").alias("next_node"), F.lit(True).alias("fresh"), F.lit(True).alias("moved"))
    columns = [*start.columns, "block", "hub"]
    state, seen = cut_and_measure(start.join(blocks, "node_id").select(columns), open=F.count_if(F.col("fresh")))
    while seen["open"]:
        active = state.where("fresh").select("source_id", "block").distinct()
        known = state.join(active, ["source_id", "block"], "left_semi").select("source_id", "block", "node_id", "metres", "next_node")
        to = active.select(F.col("source_id").alias("to_source"), F.col("block").alias("to_block"))
        used = roads.where("not hub").join(to, "to_block").select("to_source", "to_block", "src", "dst", "length_m", "src_block")
        offers = known.groupBy("source_id", "block").cogroup(used.groupBy("to_source", "to_block")).applyInPandas(
            _relax, "source_id bigint, node_id bigint, metres double, next_node bigint, offered boolean"
        )
        if has_hubs:
            hubs = state.where("hub and moved").select("source_id", F.col("node_id").alias("dst"), "metres")
            offers = offers.unionByName(hubs.join(roads.where("hub"), "dst").select(
                "source_id", F.col("src").alias("node_id"), (F.col("metres") + F.col("length_m")).alias("metres"), F.col("dst").alias("next_node"), F.lit(True).alias("offered")
            ))
        old = state.select("source_id", "node_id", "metres", "next_node", F.lit(False).alias("offered"), F.col("metres").alias("before"))
        merged = old.unionByName(offers.withColumn("before", F.lit(None).cast("double"))).groupBy("source_id", "node_id").agg(
            F.min(F.struct("metres", "offered", "next_node")).alias("b"), F.min("before").alias("before")
        )
        moved = F.col("before").isNull() | (F.col("b.metres") < F.col("before"))
        if wanted is not None:
            asked = wanted.select("source_id", "node_id").distinct().join(merged.select("source_id", "node_id", "b.metres"), ["source_id", "node_id"], "left")
            reach = asked.groupBy("source_id").agg(F.when(F.count("*") == F.count("metres"), F.max("metres")).alias("reach"))
            merged = merged.join(reach, "source_id", "left")
            moved = moved & (F.col("reach").isNull() | (F.col("b.metres") < F.col("reach")))
        rows = merged.select("source_id", "node_id", "b.metres", "b.next_node", (moved & F.col("b.offered")).alias("fresh"), moved.alias("moved"))
        state, seen = cut_and_measure(rows.join(blocks, "node_id").select(columns), open=F.count_if(F.col("fresh") | (F.col("hub") & F.col("moved"))))
    return state.select("source_id", "node_id", "metres", "next_node")


def walk_paths(paths: DataFrame, starts: DataFrame) -> DataFrame:
    """(route_id, source_id, seq, node_id): the nodes from every start to its source, by doubling the step."""
    jump = paths.where("next_node is not null").select("source_id", "node_id", F.col("next_node").alias("to"))
    rows = cut(starts.select("route_id", "source_id", F.lit(0).cast("bigint").alias("seq"), "node_id"))
    step = 1
    while True:
        ahead, seen = cut_and_measure(
            rows.join(jump, ["source_id", "node_id"]).select("route_id", "source_id", (F.col("seq") + step).alias("seq"), F.col("to").alias("node_id")),
            n=F.count(F.lit(1)),
        )
        if not seen["n"]:
            return rows
        rows = rows.unionByName(ahead)
        far = jump.select("source_id", F.col("node_id").alias("to"), F.col("to").alias("then"))
        jump = cut(jump.join(far, ["source_id", "to"]).select("source_id", "node_id", F.col("then").alias("to")))
        step *= 2
