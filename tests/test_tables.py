import datetime as dt
import random
import uuid

import pytest
from helpers import tuples
from pyspark.sql import functions as F

from waymark.functions import payload
from waymark.operators import matching, reports
from waymark.session import scratch_dir
from waymark.sources import tables

LOC = "location_id bigint, lat double, lon double, street string, neighborhood string"


def test_snapshot_round_trip_and_missing_columns(spark):
    root = f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"
    links = spark.createDataFrame([(1, 2), (3, 4)], "location_id bigint, cluster_id bigint")
    old = spark.createDataFrame([(1, 3.0, 101.0)], "location_id bigint, lat double, lon double")
    tables.write_snapshot({"location_clusters": links, "locations": old}, root, "a")
    tables.write_snapshot({"location_clusters": links.limit(1)}, root, "b")
    assert tuples(tables.read_table(spark, root, "location_clusters", "a"), "location_id") == [(1,), (3,)]
    row = tables.read_table(spark, root, "locations", "a").first()
    assert row["lat"] == 3.0 and row["street"] is None
    stats = tables.snapshot_stats({"location_clusters": spark.read.parquet(f"{root}/location_clusters"), "locations": spark.read.parquet(f"{root}/locations")})
    assert [tuple(r) for r in stats.collect()] == [("b", 1, 0), ("a", 2, 1)]


def test_find_or_insert(spark):
    loc = spark.createDataFrame([(1, 3.0, 101.0, "Old", "N"), (2, 4.0, 101.0, "Same", "N")], LOC)
    new = spark.createDataFrame(
        [(10, 3.00005, 101.0, "New", "N"), (11, 4.0, 101.0, "Same", "N"), (12, 5.0, 101.0, "A", None), (13, 5.0, 101.0, "B", None)], LOC.replace("location_id", "request_id")
    )
    got = sorted((r["lat"], r["street"], r["change"]) for r in tables.upsert_locations(loc, new).collect())
    assert got == [(3.0, "New", "updated"), (4.0, "Same", "kept"), (5.0, "B", "inserted")]


def one_by_one(stored, requests, tol=1e-4):
    """(id, lat, lon, street, change) after the requests in turn; new ids are the coordinates."""
    places = [[i, a, b, s, "kept"] for i, a, b, s, _ in sorted(stored)]
    for _, a, b, s, _ in sorted(requests):
        hit = next((p for p in places if abs(p[1] - a) < tol and abs(p[2] - b) < tol), None)
        if hit is None:
            places.append([None, a, b, s, "inserted"])
        else:
            hit[3] = s
            if hit[4] != "inserted":
                hit[4] = "updated"
    return sorted((round(a, 7), round(b, 7), s, c) for _, a, b, s, c in places)


def test_upsert_equals_one_request_after_the_other(spark):
    r = random.Random(8)
    spot = lambda: (3 + r.randint(0, 40) * 3e-5, 101 + r.randint(0, 40) * 3e-5)
    stored = [(i, *spot(), f"old{i}", "N") for i in range(6)]
    requests = [(100 + i, *spot(), f"new{i}", "N") for i in range(150)]
    r.shuffle(requests)
    loc, new = spark.createDataFrame(stored, LOC), spark.createDataFrame(requests, LOC.replace("location_id", "request_id"))
    got = sorted((round(x["lat"], 7), round(x["lon"], 7), x["street"], x["change"]) for x in tables.upsert_locations(loc, new).collect())
    assert got == one_by_one(stored, requests)


def opened_in_turn(points, tol=1e-4):
    cells = {}
    for i, a, b in sorted(points):
        x, y = int(a // tol), int(b // tol)
        if not any(abs(p - a) < tol and abs(q - b) < tol for dx in (-1, 0, 1) for dy in (-1, 0, 1) for p, q in cells.get((x + dx, y + dy), ())):
            cells.setdefault((x, y), []).append((a, b))
    return sorted(p for c in cells.values() for p in c)


def places(spark, points, monkeypatch):
    """Opened places, and the rounds that they took."""
    rounds, measure = [], tables.cut_and_measure
    monkeypatch.setattr(tables, "cut_and_measure", lambda df, **m: (rounds.append(1), measure(df, **m))[1])
    found = tables._leaders(spark.createDataFrame(points, "first bigint, lat double, lon double"), 1e-4)
    return tuples(found, "lat", "lon"), len(rounds) // 2


def test_a_recorded_drive_opens_places_in_few_rounds(spark, monkeypatch):
    drive = [(i, 3 + 9e-5 * i, 101 + 1e-5 * (i % 7)) for i in range(10_000)]
    got, rounds = places(spark, drive, monkeypatch)
    assert got == opened_in_turn(drive) and rounds <= 6


@pytest.mark.parametrize("most", [7, 50_000])
def test_crowded_tiles_open_places_in_turn(spark, monkeypatch, most):
    monkeypatch.setattr(tables, "TILE_POINTS", most)
    monkeypatch.setattr(tables, "TILE_CELLS", 4)
    r = random.Random(most)
    points = [(r.randint(0, 10**6), 3 + r.random() * 4e-3, 101 + r.random() * 4e-3) for _ in range(250)] + [(i, 3.002 + i * 1e-9, 101.002) for i in range(100)]
    got, _ = places(spark, points, monkeypatch)
    assert got == opened_in_turn(points)


def test_presets_use_stored_locations_and_cluster_new_ones(spark):
    stored = spark.createDataFrame([(1, 3.0, 101.0, "Jalan U1/2", "N"), (2, 3.5, 101.0, "", "N")], LOC)
    day = dt.datetime(2024, 1, 1)
    rows = [("a", day, True, 3.00005, 101.0, "Jalan U1/2", "N"), ("a", day, False, 3.5, 101.0, "Street", "N"), ("a", day, False, 3.00002, 101.0, "skip", "N"), ("a", day, False, 4.0, 101.0, "Jalan U1/2a", "N"), ("b", day, True, 3.50001, 101.0, "Other", "N"), ("b", day, False, 4.00003, 101.0, "Jalan U9/9", "N")]
    requests = spark.createDataFrame(rows, "name string, created_at timestamp_ntz, is_warehouse boolean, lat double, lon double, street string, neighborhood string")
    patterns = spark.createDataFrame([("u1/2", 7)], "stem_pattern string, cluster_id bigint")
    cl = spark.createDataFrame([(7, 3.0, 101.0), (8, 4.0, 101.0)], "cluster_id bigint, centroid_lat double, centroid_lon double")
    out = tables.ingest_presets(requests, stored, patterns, cl)
    name = {x["preset_id"]: x["name"] for x in out["presets"].collect()}
    fresh = [x["location_id"] for x in out["locations"].where("change = 'inserted'").collect()]
    assert len(fresh) == 1
    links = {(name[x["preset_id"]], x["location_id"], x["is_warehouse"]) for x in out["preset_locations"].collect()}
    assert links == {("a", 1, True), ("a", 2, False), ("a", fresh[0], False), ("b", 2, True), ("b", fresh[0], False)}
    assert tuples(out["location_clusters"], "location_id", "cluster_id") == [(fresh[0], 7)]
    streets = {x["location_id"]: x["street"] for x in out["locations"].collect()}
    assert streets == {1: "Jalan U1/2", 2: "Other", fresh[0]: "Jalan U9/9"}


def test_patch_keeps_old_value_for_null_and_empty(spark):
    loc = spark.createDataFrame([(1, 3.0, 101.0, "S", "N")], LOC)
    patch = spark.createDataFrame([(1, 3.0, 101.0, "", "M"), (2, 4.0, 101.0, "T", None)], LOC)
    assert tuples(tables.patch_addresses(loc, patch), "location_id", "street", "neighborhood") == [(1, "S", "M")]
    assert tuples(tables.patch_addresses(loc, patch, overwrite=True).fillna("-"), "location_id", "street", "change") == [(1, "-", "patched"), (2, "T", "inserted")]


def test_retention_is_strict_and_ids_are_stable(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2023, 12, 31, 23, 59, 59))], "id bigint, created_at timestamp_ntz")
    assert tuples(tables.expire(rows, now, 86400), "id") == [(1,)]
    iso = [r[0] for r in spark.createDataFrame([(dt.datetime(2024, 1, 1, 2, 3, 4),), (dt.datetime(2024, 1, 1, 2, 3, 4, 50),)], "t timestamp_ntz").select(payload.iso_text("t")).collect()]
    assert iso == ["2024-01-01T02:03:04", "2024-01-01T02:03:04.000050"]


def test_broken_payload_leaves_columns(spark):
    stored = spark.createDataFrame([(1, "", 0, None, '{"test_info":{"algorithm":"a","num_vehicles":3,"test_type":"t"}}'), (2, "b", 2, "u", "{oops")], "run_id bigint, algorithm string, num_vehicles int, test_type string, payload string")
    assert tuples(tables.backfill_results(stored), "run_id", "algorithm", "num_vehicles", "test_type") == [(1, "a", 3, "t"), (2, "b", 2, "u")]


def test_clusters_from_streets(spark):
    rows = [(1, 3.0, 101.0, "Jalan Setia U13/29B", ""), (2, 3.1, 101.0, "JALAN SETIA U13/29B", ""), (3, 3.2, 101.0, "Setia U13/29C", ""), (4, 3.3, 101.0, "Utama U1/2A", ""),
            (5, 3.4, 101.0, "Jln Utama U1/2B", ""), (6, 3.5, 101.0, " ", ""), (7, 3.6, 101.0, "Besar", "")]
    loc = spark.createDataFrame(rows, LOC)
    lc = spark.createDataFrame([(1, 50)], "location_id bigint, cluster_id bigint")
    cl = spark.createDataFrame([(50, "Setia U13/29")], "cluster_id bigint, name string")
    patterns = spark.createDataFrame([("setia u13/29", 50)], "stem_pattern string, cluster_id bigint")
    out = matching.assign_clusters(loc, lc, cl, patterns, spark.createDataFrame([(7,)], "location_id bigint"))
    assert tuples(out, "location_id", "level") == [(1, "linked"), (2, "exact"), (3, "stem"), (4, "new"), (5, "new"), (6, "skipped"), (7, "skipped")]
    ids = {r["location_id"]: r["cluster_id"] for r in out.collect()}
    assert ids[1] == ids[2] == ids[3] == 50 and ids[4] == ids[5] != 50 and ids[7] is None
    assert tuples(matching.new_clusters(out), "stem_pattern", "name", "centroid_lat", "n_members") == [("utama u1/2", "Utama U1/2", 3.3, 2)]


def test_demand_and_coverage(spark):
    cp = spark.createDataFrame([(1, 10, 3.0, 101.0), (2, 20, 3.0002, 101.0), (3, 20, 3.5, 101.0)], "checkpoint_id bigint, cluster_id bigint, lat double, lon double")
    mapping = reports.consolidate(cp)
    assert tuples(mapping) == [(1, 1), (2, 1), (3, 2)]
    lc = spark.createDataFrame([(1, 10), (2, 20)], "location_id bigint, cluster_id bigint")
    demand = spark.createDataFrame([(1, "PICKUP"), (2, None), (2, "x"), (3, "pickup")], "location_id bigint, type string")
    assert tuples(reports.demand_by_checkpoint(demand, lc, reports.first_consolidated(cp, mapping))) == [(1, 1, 2, 2)]
    stops = spark.createDataFrame([(1, 7, 10, 3.0, 101.0), (1, 8, 10, 3.0, 101.0)], "run_id bigint, route_id bigint, cluster_id bigint, lat double, lon double")
    required = spark.createDataFrame([(1, 10), (1, 20)], "run_id bigint, cluster_id bigint")
    assert tuples(reports.coverage_report(stops, required)) == [(1, 10, 1, 2, "Covered"), (1, 20, 0, 0, "Skipped")]
