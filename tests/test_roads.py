import heapq
import random

import pytest
from helpers import scatter, tuples
from pyspark.sql import functions as F

from waymark.operators import hulls, roads
from waymark.plans import access


def hull(points):
    points = sorted(set(points))
    out = []
    for p in points:
        for q in points:
            if p != q and all((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) >= 0 for r in points):
                out += [p, q]
    return sorted(set(out))


def test_hulls_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hulls, "BLOCK", 4)
    rows = [(i % 3, i, a, b) for i, a, b in scatter(120, 11)] + [(9, 500, 1.0, 2.0), (9, 501, 1.0, 2.0), (8, 600, 1.0, 1.0), (8, 601, 2.0, 2.0), (8, 602, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "c bigint, id bigint, lat double, lon double")
    got = {r["c"]: [(p["x"], p["y"]) for p in r["ring"]] for r in hulls.convex_hulls(df, "c", "id").collect()}
    for c in (0, 1, 2):
        assert sorted(got[c]) == hull([(b, a) for g, _, a, b in rows if g == c])
    assert got[9] == [(2.0, 1.0)] and got[8] == [(1.0, 1.0), (3.0, 3.0)]


def segment_gap(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0
    return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5


def test_points_in_areas(spark):
    square = [(101.0, 3.0), (101.1, 3.0), (101.1, 3.1), (101.0, 3.1)]
    far = spark.createDataFrame([(5, [(100.0, 3.0), (150.0, 40.0)], 0.01)], "cluster_id bigint, ring array<struct<x:double,y:double>>, radius double")
    one = spark.createDataFrame([(1, 40.0, 150.001), (2, 39.0, 150.0)], "id bigint, lat double, lon double")
    assert tuples(hulls.points_in_areas(one, "id", far), "cluster_id", "id") == [(5, 1)]
    rings = spark.createDataFrame(
        [(1, square, 0.01), (2, [(101.2, 3.2)], 0.02), (3, [(101.0, 3.2), (101.1, 3.2)], 0.005)], "cluster_id bigint, ring array<struct<x:double,y:double>>, radius double"
    )
    points = scatter(600, 12, lat=2.95, lon=100.95, span=0.3)
    got = tuples(hulls.points_in_areas(spark.createDataFrame(points, "id bigint, lat double, lon double"), "id", rings), "cluster_id", "id")
    want = []
    for c, ring, radius in ((1, square, 0.01), (2, [(101.2, 3.2)], 0.02), (3, [(101.0, 3.2), (101.1, 3.2)], 0.005)):
        for i, lat, lon in points:
            inside = c == 1 and 101.0 <= lon <= 101.1 and 3.0 <= lat <= 3.1
            if inside or min(segment_gap((lon, lat), ring[k], ring[(k + 1) % len(ring)]) for k in range(len(ring))) < radius:
                want.append((c, i))
    assert got == sorted(want)


def test_ring_test_and_hulls_run_in_batches(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    schema = "ring array<struct<x:double,y:double>>, x double, y double"
    rows = [(square, 1.0, 1.0), (square, 3.0, 1.0), (square, None, 1.0), ([], 1.0, 1.0), (None, 1.0, 1.0), ([(1.0, 1.0)], 1.0, 4.0), ([(0.0, 0.0), (None, 1.0), (4.0, 0.0)], 5.0, 0.0), (square, 2.0, 1.0)]
    tested = spark.createDataFrame(rows, schema).repartition(1).withColumn("d", hulls.ring_distance(F.col("ring"), F.col("x"), F.col("y")))
    assert [r["d"] for r in tested.collect()] == [0.0, 1.0, None, None, None, 3.0, 1.0, 0.0]
    built = tested.withColumn("h", hulls.hull_ring(F.array_sort(F.col("ring"))))
    assert [None if r["h"] is None else [tuple(p) for p in r["h"]] for r in built.limit(6).collect()] == [square, square, square, [], None, [(1.0, 1.0)]]
    assert "ArrowEvalPython" in built._jdf.queryExecution().executedPlan().toString()  # no expression over arrays per row


def grid_roads(spark, n=14, seed=5):
    r = random.Random(seed)
    nodes = [(i * n + j, 3.0 + i * 0.004, 101.4 + j * 0.004, "gate" if (i, j) == (3, 3) else None) for i in range(n) for j in range(n)]
    kinds = ["residential", "service", "primary"]
    edges = []
    for i in range(n):
        for j in range(n):
            for di, dj in ((0, 1), (1, 0)):
                if i + di < n and j + dj < n and r.random() < 0.85:
                    a, b, kind = i * n + j, (i + di) * n + j + dj, "primary" if i == 7 else r.choice(kinds[:2])
                    edges.append((a, b, kind, float(r.randint(100, 900)), "private" if r.random() < 0.02 else None))
                    if r.random() < 0.9:
                        edges.append((b, a, kind, float(r.randint(100, 900)), None))
    return (
        nodes, edges, spark.createDataFrame(nodes, "node_id bigint, lat double, lon double, barrier string"),
        spark.createDataFrame(edges, "src bigint, dst bigint, highway string, length_m double, access string"),
    )


@pytest.mark.parametrize("block, hub", [(0.02, 1000), (0.02, 3)])
def test_shortest_paths(spark, monkeypatch, block, hub):
    monkeypatch.setattr(roads, "BLOCK_DEGREES", block)
    monkeypatch.setattr(roads, "HUB_EDGES", hub)
    nodes, edges, n, e = grid_roads(spark)
    goals = spark.createDataFrame([(1, 0), (2, 100)], "source_id bigint, node_id bigint")
    paths = roads.shortest_paths(n, e, goals)
    got = {(s, v): (m, x) for s, v, m, x in (tuple(r) for r in paths.collect())}
    for source, goal in ((1, 0), (2, 100)):
        dist, heap = {}, [(0.0, goal)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            for a, b, _, length, _ in edges:
                if b == v and a not in dist:
                    heapq.heappush(heap, (d + length, a))
        assert {v: d for v, d in dist.items()} == {v: m for (s, v), (m, _) in got.items() if s == source}
    asked = spark.createDataFrame([(1, 20), (1, 3), (2, 101)], "source_id bigint, node_id bigint")
    part = {(s, v): m for s, v, m, _ in (tuple(r) for r in roads.shortest_paths(n, e, goals, asked).collect())}
    assert all(part[k] == got[k][0] for k in ((1, 20), (1, 3), (2, 101)))
    assert all(part[k] >= got[k][0] for k in part)
    starts = spark.createDataFrame([(7, 1, 150), (8, 2, 3), (9, 1, 0)], "route_id bigint, source_id bigint, node_id bigint")
    walked = tuples(roads.walk_paths(paths, starts), "route_id", "seq", "node_id")
    for route, source, node in ((7, 1, 150), (8, 2, 3), (9, 1, 0)):
        want = [node]
        while got[source, want[-1]][1] is not None:
            want.append(got[source, want[-1]][1])
        assert [v for r, _, v in walked if r == route] == want


def test_checkpoints_for_all_clusters(spark):
    _, edges, n, e = grid_roads(spark)
    rows = [(i, 3.01 + (i % 7) * 0.002, 101.41 + (i // 7) * 0.002) for i in range(35)] + [(100, 3.04, 101.43), (200, 50.0, 10.0), (201, 50.1, 10.1)]
    loc = spark.createDataFrame(rows, "location_id bigint, lat double, lon double")
    lc = spark.createDataFrame([(i, 1 if i < 100 else 2 if i == 100 else 3) for i, *_ in rows], "location_id bigint, cluster_id bigint")
    cl = spark.createDataFrame([(1, 3.016, 101.414), (2, 3.04, 101.43), (3, 50.0, 10.0)], "cluster_id bigint, centroid_lat double, centroid_lon double")
    cp = spark.createDataFrame([(1, 2, 3.0, 101.4, "a", "b", 0.9)], "checkpoint_id bigint, cluster_id bigint, lat double, lon double, from_road_type string, to_road_type string, confidence double")
    depots = spark.createDataFrame([(c, 1, 3.05, 101.45) for c in (1, 2)], "cluster_id bigint, source_id bigint, lat double, lon double")
    topo = access.generate_checkpoints(loc, lc, cl, n, e, cp).groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("confidence").alias("c"), F.max("from_road_type")).collect()
    found = {r["cluster_id"]: r for r in topo}
    assert set(found) == {1, 2, 3} and found[1]["n"] > 2
    assert tuple(found[3])[1:] == (1, 0.3, "unknown")
    routed = access.generate_checkpoints(loc, lc, cl, n, e, cp, depots).where("cluster_id = 1").collect()
    assert 1 <= len(routed) <= 2 and all(0.5 < r["confidence"] <= 0.95 for r in routed)
    kept = access.generate_checkpoints(loc, lc, cl, n, e, cp, regenerate=False).where("cluster_id = 2").collect()
    assert [(r["from_road_type"], r["confidence"]) for r in kept] == [("existing", 1.0)]


def test_nodes_near_members_when_area_is_empty(spark):
    nodes = spark.createDataFrame([(1, 1, 3.003, 101.0), (1, 2, 3.0031, 101.0)], "cluster_id bigint, node_id bigint, lat double, lon double")
    areas = spark.createDataFrame([(1, [(101.0, 3.0)], 0.002)], "cluster_id bigint, ring array<struct<x:double,y:double>>, radius double")
    members = spark.createDataFrame([(1, 5, 3.0, 101.0)], "cluster_id bigint, location_id bigint, lat double, lon double")
    assert tuples(roads.inside_nodes(nodes, areas, members)) == [(1, 1)]
