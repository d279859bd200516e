"""Plans that must stay as they are at size: no relation that grows with the input goes through the driver, and shared steps run once."""

import pytest
from helpers import km, scatter, tuples
from pyspark.sql import functions as F

from waymark.operators import density, grid, hulls, ranks, roads, tours
from waymark.plans import scenario
from waymark.session import cut
from waymark.sources import sample, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, n, seed, key="id"):
    return cut(spark.createDataFrame(scatter(n, seed), f"{key} bigint, lat double, lon double"))


@pytest.mark.parametrize("planar", [True, False])
def test_density_groups_broadcast_nothing(spark, planar):
    assert "Broadcast" not in plan(density.density_groups(points(spark, 60, 1), "id", 350, 5, planar=planar))


def test_nearest_broadcasts_nothing(spark):
    assert "Broadcast" not in plan(grid.nearest(points(spark, 30, 2), "id", points(spark, 30, 3, "node_id"), "node_id"))


def test_areas_broadcast_nothing_and_share_the_exact_test(spark):
    members = points(spark, 40, 4, "location_id").withColumn("cluster_id", F.col("location_id") % 2)
    centers = members.groupBy("cluster_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    areas = cut(hulls.cluster_areas(members, centers, 0.002, 0.002))
    nodes = points(spark, 50, 5, "node_id")
    assert "Broadcast" not in plan(hulls.points_in_areas(nodes, "node_id", areas))
    edges = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    part, _ = roads.network_around(nodes, edges, areas, centers)
    inside = roads.inside_nodes(part, areas, members)
    assert "ring" not in plan(inside)  # written before its rows are used twice


def test_inside_nodes_of_the_nearest_main_roads_are_tested_once(spark):
    nodes = points(spark, 50, 5, "node_id")
    square = [(101.4, 3.0), (101.45, 3.0), (101.45, 3.05), (101.4, 3.05)]
    rings = spark.createDataFrame([(1, square, 0.002)], "cluster_id bigint, ring array<struct<x:double,y:double>>, radius double")
    edges = spark.createDataFrame([(1, 2, "primary"), (3, 4, "residential")], "src bigint, dst bigint, highway string")
    inside = hulls.points_in_areas(nodes, "node_id", rings).select("cluster_id", "node_id")
    rows = roads.nearest_main_roads(inside, nodes, edges)
    assert "ArrowEvalPython" in plan(inside) and "ArrowEvalPython" not in plan(rows)  # written before its rows are used twice
    assert tuples(rows, "cluster_id", "node_id", "degrees", "rank") == [(1, 1, 0.0, 1), (1, 2, 0.0, 2)]


def test_preset_requests_are_read_once(spark):
    rows = [("a", "2024-01-01", True, 3.0, 101.0, "S"), ("a", "2024-01-01", False, 3.00005, 101.0, "S"), ("a", "2024-01-01", False, 3.1, 101.0, "T"), ("b", None, False, 3.2, 101.0, None), ("b", None, None, 3.3, 101.0, "U")]
    requests = spark.createDataFrame(rows, "name string, created_at string, is_warehouse boolean, lat double, lon double, street string")
    out = tables.ingest_presets(requests)
    for name in ("presets", "preset_locations", "warehouses"):
        assert "md5" not in plan(out[name]) and "Broadcast" not in plan(out[name]), name  # from the written points
    links = out["preset_locations"].join(out["presets"], "preset_id").join(out["locations"], "location_id")
    assert tuples(links.fillna(False), "name", "lat", "is_warehouse") == [("a", 3.0, True), ("a", 3.1, False), ("b", 3.2, False), ("b", 3.3, False)]


def test_keyed_sample_tables_are_not_broadcast(spark, tmp_path):
    for name, text in (("nation", "0 as n_nationkey, 'A' as n_name, 0 as n_regionkey"), ("region", "0 as r_regionkey, 'R' as r_name"), ("customer", "id as c_custkey, 0 as c_nationkey, 1.0D as c_acctbal")):
        spark.range(5).selectExpr(*text.split(", ")).limit(1 if name != "customer" else 5).write.parquet(f"{tmp_path}/{name}.parquet")
    load = lambda name: sample.load(spark, str(tmp_path), name)
    joined = load("locations").select("location_id", "lat").join(load("location_clusters"), "location_id")
    assert plan(joined).count("BroadcastHashJoin") == 2  # with nation and region
    assert joined.count() == 5


def test_instances_are_prepared_once(spark):
    make = spark.createDataFrame
    pl = make([("p", 1, False), ("p", 2, False), ("p", 3, True), ("q", 1, False)], "preset_id string, location_id bigint, is_warehouse boolean")
    loc = make([(1, 3.0, 101.0), (2, 3.1, 101.1), (3, 3.2, 101.2)], "location_id bigint, lat double, lon double")
    lc = make([(1, 10), (2, 20)], "location_id bigint, cluster_id bigint")
    cp = make([(5, 10, 3.0, 101.0), (4, 20, 3.0, 101.0000000001), (6, 20, 3.5, 101.5), (7, 20, None, 101.5)], "checkpoint_id bigint, cluster_id bigint, lat double, lon double")
    out = scenario.prepare_instances(make([("p",), ("q",)], "preset_id string"), pl, loc, lc, cp)
    for name in ("depots", "nodes", "served", "required"):
        assert "Join" not in plan(out[name]), name
    assert tuples(out["served"].where("lat is not null"), "instance_id", "stop_id", "cluster_id") == [("p", 4, 10), ("p", 4, 20), ("p", 6, 20)]
    assert tuples(out["required"]) == [("p", 10), ("p", 20)]


def test_covering_of_more_clusters_than_bits(spark):
    depot, stops = (3.0, 101.4), scatter(80, 6)
    rows = [(i, "x", a, b, c) for i, a, b in stops for c in (i, (i * 7) % 80)]
    served = spark.createDataFrame(rows, "stop_id bigint, instance_id string, lat double, lon double, cluster_id bigint")
    depots = spark.createDataFrame([("x", *depot)], "instance_id string, lat double, lon double")
    at, need, left, expected = depot, set(range(80)), {i: (a, b) for i, a, b in stops}, []
    while need:
        left = {i: p for i, p in left.items() if {i, (i * 7) % 80} & need}
        best = min(left, key=lambda i: (km(at, left[i]), i))
        expected.append(best)
        need -= {best, (best * 7) % 80}
        at = left[best]
    assert [r["stop_id"] for r in tours.covering_tours(depots, served).orderBy("seq").collect()] == expected


def test_positions_of_groups_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(ranks, "LARGE", 5)
    df = spark.createDataFrame([(g, k) for g, n in (("a", 20), (None, 7), ("b", 3)) for k in range(n)], "g string, k bigint")
    assert all(r["at"] == r["k"] + 1 for r in ranks.position(df, ["g"], "k", "at").collect())
    assert ranks.position(df, ["g"], "k", "at").count() == 30
