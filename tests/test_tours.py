import itertools
import random

import numpy as np
import pytest
from helpers import km, scatter, tuples
from pyspark.sql import functions as F

from waymark.operators import tours
from waymark.plans import scenario
from waymark.session import cut


def data(spark, sizes, seed=1):
    r = random.Random(seed)
    depots, stops = [], []
    for i, n in enumerate(sizes):
        depots.append((f"p{i}", 3.0 + r.random() * 0.2, 101.0 + r.random() * 0.2, r.randint(1, 4)))
        stops += [(f"p{i}", 100 * i + k, 3.0 + r.random() * 0.2, 101.0 + r.random() * 0.2) for k in range(n)]
    return (
        depots, stops, spark.createDataFrame(depots, "instance_id string, lat double, lon double, vehicles int"),
        spark.createDataFrame(stops, "instance_id string, stop_id bigint, lat double, lon double"),
    )


def greedy(depot, stops, vehicles):
    left, out = {s[1]: s[2:] for s in stops}, []
    used = min(vehicles, len(left))
    share = -(-len(left) // used)
    for v in range(used):
        at = depot[1:3]
        for seq in range(1, min(share, len(left)) + 1):
            d, s = min((km(at, p), s) for s, p in left.items())
            at = left.pop(s)
            out.append((depot[0], v, seq, s))
    return out


@pytest.mark.parametrize("block", [200, 3])
@pytest.mark.parametrize("vehicles", [None, "vehicles"])
def test_nearest_tours_do_not_depend_on_the_block(spark, block, vehicles):
    depots, stops, d, s = data(spark, [1, 2, 5, 9])
    got = tuples(tours.nearest_tours(d, s, vehicles, block), "instance_id", "vehicle", "seq", "stop_id")
    want = [row for p in depots for row in greedy(p, [x for x in stops if x[0] == p[0]], p[3] if vehicles else 1)]
    assert got == sorted(want)


def cover(depot, served, vehicles):
    at, need, out, seq = {v: depot[1:3] for v in range(vehicles)}, {c for _, _, _, cs in served for c in cs}, [], {}
    while need:
        d, v, s, p, cs = min((km(at[v], p), v, s, p, cs) for v in at for _, s, p, cs in served if need & set(cs))
        at[v], need = p, need - set(cs)
        seq[v] = seq.get(v, 0) + 1
        out.append((depot[0], v, seq[v], s))
    return out


@pytest.mark.parametrize("block", [200, 2])
@pytest.mark.parametrize("cars", [1, 3])
def test_covering_tours(spark, block, cars):
    r = random.Random(4)
    depots, stops, d, _ = data(spark, [4, 9], 9)
    served = [(s[0], s[1], s[2:], tuple(sorted(r.sample(range(8), r.randint(1, 3))))) for s in stops]
    rows = [(i, s, p[0], p[1], c) for i, s, p, cs in served for c in cs]
    df = spark.createDataFrame(rows, "instance_id string, stop_id bigint, lat double, lon double, cluster_id bigint")
    got = tuples(tours.covering_tours(d.withColumn("vehicles", F.lit(cars)), df, "vehicles", block), "instance_id", "vehicle", "seq", "stop_id")
    assert got == sorted(row for p in depots for row in cover(p, [x for x in served if x[0] == p[0]], cars))


def length(points):
    return sum(km(a, b) for a, b in zip(points, points[1:]))


@pytest.mark.parametrize("block", [1000, 100])
def test_two_opt_leaves_no_improving_pair_on_long_paths(spark, block):
    pts = [(a, b) for _, a, b in scatter(400, 77, span=0.5)]
    path, left = [pts[0]], set(pts[1:])
    while left:
        path.append(min(left, key=lambda p: km(path[-1], p)))
        left.remove(path[-1])
    path += [(a, b) for _, a, b in scatter(12, 5)]
    rows = [("long", i, i, a, b) for i, (a, b) in enumerate(path)] + [("short", i, 1000 + i, a, b) for i, a, b in scatter(30, 8)]
    df = spark.createDataFrame(rows, "route_id string, seq bigint, node_id bigint, lat double, lon double")
    out = cut(tours.two_opt(df, block))
    assert tours.improving_moves(out).count() == 0
    got = sorted(tuple(x) for x in out.where("route_id = 'long'").select("seq", "node_id", "lat", "lon").collect())
    assert [x[0] for x in got] == list(range(len(path))) and sorted(x[1] for x in got) == list(range(len(path)))
    d = tours._km_matrix(np.array([x[2] for x in got]), np.array([x[3] for x in got]))
    leg = np.diagonal(d, 1)
    gain = leg[:-1, None] + leg[None, 1:] - d[:-2, 1:-1] - d[1:-1, 2:]
    assert np.triu(gain, 1).max() <= 1e-9 and leg.sum() < length(path)


@pytest.mark.parametrize("block", [300, 6])
def test_two_opt_keeps_ends_and_stops(spark, block):
    rows = [(f"r{k}", i, i, a, b) for k in range(3) for i, a, b in scatter(20, 30 + k)]
    df = spark.createDataFrame(rows, "route_id string, seq bigint, node_id bigint, lat double, lon double")
    got = sorted(tuple(x) for x in tours.two_opt(df, block).select("route_id", "seq", "node_id", "lat", "lon").collect())
    for k in range(3):
        path = [x for x in got if x[0] == f"r{k}"]
        old = [x for x in rows if x[0] == f"r{k}"]
        assert [x[1] for x in path] == list(range(20)) and sorted(x[2] for x in path) == list(range(20))
        assert path[0][2] == 0 and path[-1][2] == 19
        pts = [x[3:] for x in path]
        assert length(pts) < length([x[3:] for x in old])
        for i in range(1, 18):
            for j in range(i + 1, 19):
                assert length(pts[:i] + pts[i : j + 1][::-1] + pts[j + 1 :]) >= length(pts) - 1e-9


def test_exact_tours_and_limit(spark):
    depots, stops, d, s = data(spark, [1, 2, 4, 6, 16], 3)
    exact, errors = tours.exact_tours(d, s)
    got = {r["instance_id"]: (r["km"], list(r["ids"])) for r in exact.collect()}
    assert [r["instance_id"] for r in errors.collect()] == ["p4"] and set(got) == {"p0", "p1", "p2", "p3"}
    for p in depots[:4]:
        own = [x for x in stops if x[0] == p[0]]
        best = min(length([p[1:3], *[x[2:] for x in o], p[1:3]]) for o in itertools.permutations(own))
        assert abs(got[p[0]][0] - best) < 1e-9
        place = {x[1]: x[2:] for x in own}
        assert abs(length([p[1:3], *[place[i] for i in got[p[0]][1]], p[1:3]]) - best) < 1e-9


def routes_and_requests(spark):
    r = random.Random(6)
    routes, depots, requests = [], [], []
    for k in range(8):
        depots.append((k, 3 + r.random() * 0.1, 101 + r.random() * 0.1))
        n = r.randint(1, 6)
        routes += [(k, i, 10 * k + i, 3 + r.random() * 0.1, 101 + r.random() * 0.1) for i in range(1, n + 1)]
        requests.append((k, 500 + k, min(k % 4, n), *[v for _ in range(2) for v in (3 + r.random() * 0.1, 101 + r.random() * 0.1)]))
    requests.append((99, 599, 0, 3.0, 101.0, 3.0, 101.0))
    requests_bad = [*requests, (0, 600, 9, 3.0, 101.0, 3.0, 101.0)]
    where = "route_id bigint, lat double, lon double"
    req = "route_id bigint, pair_id bigint, insertion_point bigint, pickup_lat double, pickup_lon double, dropoff_lat double, dropoff_lon double"
    return (
        routes, depots, requests, spark.createDataFrame(routes, "route_id bigint, seq bigint, node_id bigint, lat double, lon double"),
        spark.createDataFrame(depots, where), spark.createDataFrame(requests, req), spark.createDataFrame(requests_bad, req),
    )


def test_insertion_equals_brute_force(spark):
    routes, depots, requests, r, d, q, bad = routes_and_requests(spark)
    rebuilt, report = scenario.insert_pairs(r, d, q)
    got = {x["route_id"]: x for x in report.collect()}
    paths = {}
    for x in rebuilt.orderBy("seq").collect():
        paths.setdefault(x["route_id"], []).append(x)
    reordered = {x["instance_id"]: x for x in scenario.best_reorder(r, d, bad, 4).collect()}
    assert set(reordered) == {f"{x[0]}:{x[1]}" for x in [*requests, (0, 600)]}
    exact = {x["instance_id"]: x["km"] for x in scenario.best_reorder(r, d, q).collect()}
    for k, pair in ((99, 599), (0, 600)):
        assert reordered[f"{k}:{pair}"]["km"] is None and "out of bounds" in reordered[f"{k}:{pair}"]["error"]
    for k, lat, lon in depots:
        home, own = (lat, lon), [x[3:] for x in routes if x[0] == k]
        _, pair, at, *ends = next(x for x in requests if x[0] == k)
        p, e = tuple(ends[:2]), tuple(ends[2:])
        options = []
        for i in range(at, len(own) + 1):
            for j in range(i, len(own) + 1):
                options.append(length([home, *own[:i], p, *own[i:j], e, *own[j:], home]))
        assert abs(got[k]["km"] - min(options)) < 1e-9 and abs(got[k]["strategy_b_km"] - options[-1]) < 1e-9
        assert [x["seq"] for x in paths[k]] == list(range(1, len(own) + 3))
        assert abs(length([home, *[(x["lat"], x["lon"]) for x in paths[k]], home]) - min(options)) < 1e-9
        kinds = [x["type"] for x in paths[k]]
        assert kinds.index("pickup") < kinds.index("dropoff")
        start = own[at - 1] if at else home
        left_over = len(own) - at
        assert ("takes at most 4" in (reordered[f"{k}:{pair}"]["error"] or "")) == (left_over > 4)
        if left_over <= 5:
            left = own[at:] + [p, e]
            best = min(
                length([start, *[left[i] for i in o], home]) for o in itertools.permutations(range(len(left))) if o.index(len(left) - 2) < o.index(len(left) - 1)
            )
            assert abs(exact[f"{k}:{pair}"] - best) < 1e-9
    _, errors = scenario.split_routes(r, bad)
    assert tuples(errors, "route_id", "pair_id") == [(0, 600), (99, 599)]


def test_several_pairs_in_one_route(spark):
    routes, depots, requests, r, d, q, _ = routes_and_requests(spark)
    rng = random.Random(12)
    more = [(k, 200 + 100 * m + k, rng.randint(0, 1), *[v for _ in range(2) for v in (3 + rng.random() * 0.1, 101 + rng.random() * 0.1)]) for k in range(6) for m in range(3)]
    rebuilt, report = scenario.insert_pairs(r, d, q.unionByName(spark.createDataFrame(more, q.schema)))
    paths = {}
    for x in rebuilt.orderBy("seq").collect():
        paths.setdefault(x["route_id"], []).append(x)
    told = {(x["route_id"], x["pair_id"]): x for x in report.collect()}
    assert len(told) == 8 + 18
    for k, lat, lon in depots:
        home, path = (lat, lon), [(x[3:], x[1]) for x in routes if x[0] == k]
        for _, pair, at, *ends in sorted(x for x in requests + more if x[0] == k):
            p, e = (tuple(ends[:2]), None), (tuple(ends[2:]), None)
            place = next(i for i, x in enumerate(path) if x[1] == at) + 1 if at else 0
            whole = lambda stops: length([home, *[x[0] for x in stops], home])
            options = [path[:i] + [p] + path[i:j] + [e] + path[j:] for i in range(place, len(path) + 1) for j in range(i, len(path) + 1)]
            assert abs(told[k, pair]["before_km"] - whole(path)) < 1e-9
            path = min(options, key=whole)
            assert abs(told[k, pair]["km"] - whole(path)) < 1e-9
        assert [x["seq"] for x in paths[k]] == list(range(1, len(path) + 1))
        assert [(x["lat"], x["lon"]) for x in paths[k]] == [x[0] for x in path]


def test_audit_keeps_runs_apart(spark):
    rows = [(run, 10 * run, seq, seq, 7, kind, 3.0 + 0.1 * seq, 101.0) for run in (1, 2) for seq, kind in ((1, "pickup"), (2, "dropoff"))] + [(3, 30, 1, 1, 7, "pickup", 3.0, 101.0)]
    routes = spark.createDataFrame(rows, "run_id bigint, route_id bigint, seq bigint, node_id bigint, pair_id bigint, type string, lat double, lon double")
    must = spark.createDataFrame([(1, 1)], "run_id bigint, node_id bigint")
    depots = spark.createDataFrame([(10, 3.1, 101.0), (20, 4.1, 101.0), (30, 3.0, 101.0)], "route_id bigint, lat double, lon double")
    found = {(x["route_id"], x["rule"]) for x in scenario.audit_routes(routes, must, 100, depots).collect()}
    assert found == {(30, "unfinished"), (20, "too long")}


def test_checkpoint_solver(spark):
    r = random.Random(4)
    depots, stops, d, _ = data(spark, [4, 9, 12], 9)
    rows = [(s[0], s[1], s[2], s[3], k) for k, s in enumerate(stops)]
    served = spark.createDataFrame(rows, "instance_id string, stop_id bigint, lat double, lon double, cluster_id bigint")
    plain, better = (scenario.solve_checkpoints(d.withColumn("algorithm", F.lit(a)), served) for a in ("anything", "two_opt"))
    a, b = ({x["route_id"]: x["km"] for x in tours.path_lengths(p).collect()} for p in (plain, better))
    assert set(a) == set(b) and all(b[k] <= a[k] + 1e-9 for k in a) and sum(b.values()) < sum(a.values())
    assert {x["algorithm_used"] for x in plain.collect()} == {"heuristic"}
    assert tours.improving_moves(better.select("route_id", "seq", "node_id", "lat", "lon")).count() == 0


def test_audit_finds_all_kinds(spark):
    rows = [
        (1, 1, 1, 11, 7, "pickup", 3.0, 101.0), (1, 1, 2, 12, 7, "dropoff", 3.1, 101.0), (1, 2, 1, 13, 8, "dropoff", 3.0, 101.0), (1, 2, 2, 14, 8, "pickup", 3.0, 101.0),
        (1, 3, 1, 15, 9, "dropoff", 3.0, 101.0), (1, 3, 2, 16, 10, "stop", 9.0, 101.0),
    ]
    routes = spark.createDataFrame(rows, "run_id bigint, route_id bigint, seq bigint, node_id bigint, pair_id bigint, type string, lat double, lon double")
    must = spark.createDataFrame([(1, 11), (1, 99)], "run_id bigint, node_id bigint")
    found = {(x["route_id"], x["node_id"], x["rule"]) for x in scenario.audit_routes(routes, must, 100).collect()}
    assert found == {(2, None, "precedence"), (3, None, "precedence"), (None, 99, "missing"), (3, None, "too long")}


def test_matrix_parts(spark):
    rows = [("a", i, 3 + i * 0.01, 101.0) for i in range(5)]
    nodes = spark.createDataFrame(rows, "instance_id string, idx bigint, lat double, lon double")
    parts = {(r["i"], r["part"]): r["km"] for r in tours.distance_matrix(nodes, 2).collect()}
    for i in range(5):
        line = [v for p in range(3) for v in parts[i, p]]
        assert all(abs(line[j] - km(rows[i][2:], rows[j][2:])) < 1e-9 for j in range(5))
