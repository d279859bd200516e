import math
import random

import pytest
from helpers import km, scatter, tuples
from pyspark.sql import functions as F

from waymark.operators import grid, lookups, matching, ranks

PLACE = "id bigint, lat double, lon double"


def frame(spark, rows, key="id"):
    return spark.createDataFrame(rows, PLACE.replace("id", key, 1))


@pytest.mark.parametrize("world", [False, True])
def test_nearest_equals_brute_force(spark, world):
    r = random.Random(7)
    if world:
        points = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(150)] + [(900, 90.0, 0.0), (901, 0.0, 180.0), (902, 0.0, -179.999)]
        targets = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(40)]
    else:
        points = scatter(200, 1) + [(1000 + i, 3.01, 101.41) for i in range(300)]
        targets = scatter(60, 2) + [(70, 3.01, 101.41), (71, 3.01, 101.41), (72, 40.0, -70.0)]
    got = dict((a, (b, round(d, 6))) for a, b, d in tuples(grid.nearest(frame(spark, points, "p"), "p", frame(spark, targets, "t"), "t")))
    for i, *at in points:
        d, t = min((km(at, b), t) for t, *b in targets)
        assert got[i][1] == round(d, 6)
        assert got[i][0] == t or abs(km(at, targets[[x[0] for x in targets].index(got[i][0])][1:]) - d) < 1e-9
    assert len(got) == len(points)


def test_nearest_in_a_crowded_town(spark):
    r = random.Random(1)
    town = lambda: (3 + r.random() * 0.02, 101 + r.random() * 0.02)
    targets = [(i, *town()) for i in range(1500)] + [(5000 + i, 1 + r.random() * 6, 100 + r.random() * 5) for i in range(100)] + [(9000 + i, 3.01, 101.01) for i in range(200)]
    points = [(i, *town()) for i in range(400)] + [(1000 + i, 3.011, 101.011) for i in range(200)]
    df = grid.nearest(frame(spark, points, "p"), "p", frame(spark, targets, "t"), "t")
    got = {p: (t, round(d, 9)) for p, t, d in tuples(df)}
    assert got == {p: (lambda d, t: (t, round(d, 9)))(*min((km(at, b), t) for t, *b in targets)) for p, *at in points}


def test_nearest_planar_within_groups(spark):
    points = frame(spark, scatter(80, 3), "p").withColumn("g", F.col("p") % 3)
    targets = frame(spark, scatter(30, 4), "t").withColumn("g", F.col("t") % 3)
    got = {(g, p): t for g, p, t, _ in tuples(grid.nearest(points, "p", targets, "t", by=["g"], planar=True))}
    for p, *a in scatter(80, 3):
        options = [(round((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, 15), t) for t, *b in scatter(30, 4) if t % 3 == p % 3]
        assert got[p % 3, p] == min(options)[1]


@pytest.mark.parametrize("strict", [False, True])
def test_box_pairs(spark, strict):
    points, targets, r = scatter(60, 5), scatter(60, 6) + [(99, 3.0, 101.4)], 0.004
    got = tuples(grid.box_pairs(frame(spark, points), frame(spark, targets), r, strict), "id", "t_id")
    if strict:
        want = [(a[0], b[0]) for a in points for b in targets if abs(a[1] - b[1]) < r and abs(a[2] - b[2]) < r]
    else:
        want = [(a[0], b[0]) for a in points for b in targets if a[1] - r <= b[1] <= a[1] + r and a[2] - r <= b[2] <= a[2] + r]
    assert got == sorted(want)


def test_box_sums_of_a_crowded_place(spark, monkeypatch):
    r = random.Random(9)
    town = lambda n: [(3 + r.random() * 0.004, 101.4 + r.random() * 0.004) for _ in range(n)]
    targets = [(1 + i % 3, *at) for i, at in enumerate(town(3000) + [(3.002, 101.402)] * 1 + [(3.0015, 101.4015 + k * 1e-10) for k in range(40)] + [(50.0, 10.0)])]
    points = [(i, *at) for i, at in enumerate(town(60) + [(3.0, 101.4), (3.0035, 101.402), (50.0005, 10.0), (-10.0, 0.0)])]
    rows, measure = [], grid.cut_and_measure

    def watched(df, **measures):
        out, seen = measure(df, **measures)
        rows.append(out.agg(F.sum(F.when(F.col("_kind") == "read", F.col("_n")).otherwise(1))).first()[0] or 0)
        return out, seen

    monkeypatch.setattr(grid, "cut_and_measure", watched)
    got = {(a, b): w for a, b, w in tuples(grid.box_sums(frame(spark, points), spark.createDataFrame(targets, "w bigint, lat double, lon double"), 0.0015, "w"))}
    want = {(a, b): sum(w for w, c, d in targets if a - 0.0015 <= c <= a + 0.0015 and b - 0.0015 <= d <= b + 0.0015) for _, a, b in points}
    assert got == want
    pairs = sum(a - 0.0015 <= c <= a + 0.0015 and b - 0.0015 <= d <= b + 0.0015 for _, a, b in points for _, c, d in targets)
    assert sum(rows) < pairs


def test_nearest_k_and_counts_in_a_crowded_place(spark):
    r = random.Random(2)
    spots = [(3 + r.random() * 0.002, 101.4 + r.random() * 0.002) for _ in range(300)] + [(3.0025, 101.4), (3.5, 101.4), (3.5001, 101.4)] + [(3.001, 101.401)] * 4
    loc = [(i, *at) for i, at in enumerate(spots)]
    df = spark.createDataFrame(loc, "location_id bigint, lat double, lon double")
    links = spark.createDataFrame([(i, i % 5) for i, *_ in loc if i % 4], "location_id bigint, cluster_id bigint")
    near = lookups.nearby(df, links, 0.003).collect()
    ranked = {}
    for x in sorted(near, key=lambda x: (x["location_id"], x["distance_sq"], x["neighbour_id"])):
        ranked.setdefault(x["location_id"], []).append(x["neighbour_id"])
    got = {}
    for a, rank, b in tuples(lookups.nearest_k(df, links, 2, 0.003), "location_id", "rank", "neighbour_id"):
        got.setdefault(a, []).append(b)
    assert got == {a: b[:2] for a, b in ranked.items()}
    total = {}
    for x in near:
        total[x["location_id"]] = total.get(x["location_id"], 0) + x["neighbour_count"]
    assert dict(tuples(lookups.neighbour_counts(df, links, 0.003))) == {a: n for a, n in total.items() if n}


def test_copies_share_their_neighbours(spark):
    loc = [(i, 3.0, 101.4) for i in range(500)] + [(600, 3.0005, 101.4), (700, 3.1, 101.4)]
    df = spark.createDataFrame(loc, "location_id bigint, lat double, lon double")
    links = spark.createDataFrame([(i, i % 2) for i, *_ in loc], "location_id bigint, cluster_id bigint")
    got = tuples(lookups.nearby(df, links), "location_id", "neighbour_id", "neighbour_count")
    assert got == [(0, 0, 499), (0, 600, 1), (600, 0, 500)]


def test_peers_leave_out_the_location_itself(spark):
    loc = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "")], "location_id bigint, street string")
    links = spark.createDataFrame([(1, 10), (3, 30), (4, 40)], "location_id bigint, cluster_id bigint")
    assert tuples(lookups.street_peers(loc, links)) == [(1, 2, 3, 30), (2, 2, 1, 10), (3, 2, 1, 10), (4, 0, None, None)]


def test_positions_of_keys_with_wide_gaps(spark):
    keys = [*range(300), 4 * 10**18, -(2**62), 2**62 + 1, 2**62 + 2]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert tuples(ranks.position(df, [], "k", "n"), "k", "n") == [(k, i + 1) for i, k in enumerate(sorted(keys))]


def test_positions_of_repeated_keys_and_null_groups(spark):
    df = spark.range(100_000).selectExpr("id", "cast(null as int) as g", "7 as k").unionByName(spark.range(10).selectExpr("id", "1 as g", "cast(id as int) as k"))
    for by in ([], ["g"]):
        got = ranks.position(df, by, "k", "n")
        seen = got.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct("n").alias("places"), F.min("n").alias("low"), F.max("n").alias("high"))
        sizes = [100_010] if not by else [10, 100_000]
        assert sorted(tuple(r)[-4:] for r in seen.collect()) == [(s, s, 1, s) for s in sizes]
    assert tuples(got.where("g = 1"), "k", "n") == [(i, i + 1) for i in range(10)]


def test_positions_and_running_values(spark):
    r = random.Random(3)
    rows = [(g, k, r.randint(-50, 50)) for g in range(3) for k in r.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "g int, k bigint, v bigint")
    by_group = {g: sorted((k, v) for a, k, v in rows if a == g) for g in range(3)}
    assert tuples(ranks.position(df, ["g"], "k", "n"), "g", "k", "n") == [(g, k, i + 1) for g in range(3) for i, (k, _) in enumerate(by_group[g])]
    keys = sorted({k for _, k, _ in rows})
    assert tuples(ranks.position(df.select("k").distinct(), [], "k", "n"), "k", "n") == [(k, i + 1) for i, k in enumerate(keys)]
    summed = {(g, k): s for g, k, s in tuples(ranks.running_sum(df, ["g"], "k", F.col("v"), "s", 16), "g", "k", "s")}
    least = {(g, k): s for g, k, s in tuples(ranks.running_min(df.withColumn("w", F.col("v") + 1000), ["g"], "k", F.col("w"), "s", 16).fillna(0), "g", "k", "s")}
    for g, items in by_group.items():
        for i, (k, _) in enumerate(items):
            assert summed[g, k] == sum(v for _, v in items[: i + 1])
            assert least[g, k] == (min(v + 1000 for _, v in items[:i]) if i else 0)


@pytest.mark.parametrize("planar", [False, True])
def test_nearest_of_a_town_seen_from_far_and_near(spark, planar, monkeypatch):
    r = random.Random(5)
    town = lambda: (3 + r.random() * 0.05, 101 + r.random() * 0.05)
    targets = [(i, *town()) for i in range(3000)]
    points = [(i, 3.5 + r.random() * 2, 102 + r.random()) for i in range(300)] + [(1000 + i, *town()) for i in range(100)]
    rows, measure = [], grid.cut_and_measure

    def watched(df, **measures):  # cells that points open, with the targets in them
        out, seen = measure(df, **measures)
        if {"_n", "_bound"} <= set(out.columns):
            rows.append(out.where("_n <= 8").agg(F.sum("_n")).first()[0] or 0)
        return out, seen

    monkeypatch.setattr(grid, "cut_and_measure", watched)
    df = grid.nearest(frame(spark, points, "p"), "p", frame(spark, targets, "t"), "t", planar=planar)
    far = (lambda a, b: math.dist(a, b)) if planar else km
    assert {p: t for p, t, _ in tuples(df)} == {p: min((far(at, b), t) for t, *b in targets)[1] for p, *at in points}
    assert sum(rows) <= 60 * len(points)


def test_addresses_are_looked_for_within_the_ladder_only(spark, monkeypatch):
    r = random.Random(9)
    town = lambda: (3 + r.random() * 0.01, 101 + r.random() * 0.01)
    named = [(i, *town(), "S") for i in range(600)] + [(1000 + i, 3.2 + i * 0.05, 101.2, "S") for i in range(20)]
    rows = named + [(2000, 3.2003, 101.2, ""), (2001, 3.2003, 101.2, None), (2002, None, 101.2, "S"), (2003, *named[0][1:])]
    points = [(i, *town()) for i in range(200)] + [(500 + i, 3.2 + i * 0.05, 101.2 + i * 4e-4) for i in range(20)] + [(900, 40.0, -70.0), (901, None, 101.0), (902, *named[0][1:3])]
    monkeypatch.setattr(grid, "_start_level", lambda *_: pytest.fail("looked for a bound beyond the ladder"))
    addresses = spark.createDataFrame(rows, "location_id bigint, lat double, lon double, street string")
    got = {p: (t, zoom) for p, t, zoom in tuples(matching.lookup_addresses(frame(spark, points, "p"), "p", addresses, "location_id").select("p", F.col("location_id"), "zoom").fillna(-1))}
    want = {}
    for p, *at in points:
        d, t = min((km(at, b[1:3]), b[0]) for b in named) if None not in at else (9, -1)
        zoom = next((z for z, far in matching.ADDRESS_LADDER.items() if d <= far), -1)
        want[p] = (t if zoom > 0 else -1, zoom)
    assert got == want and {z for _, z in got.values()} == {-1, 15, 16, 17, 18}
