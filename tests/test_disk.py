"""What jobs leave on disk while they run: shuffles behind written tables, and steps' own tables, go at once."""

import pathlib
import time

from helpers import scatter, tuples
from pyspark.sql import functions as F

from waymark import session
from waymark.operators import ranks, tours
from waymark.plans import insertion, scenario


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "shuffle_" in f}


def tables(spark):
    return {p.name for p in pathlib.Path(session.scratch_dir(spark)).glob("waymark-*") if p.is_dir()}


def instances(spark, presets=6):
    """Presets with a warehouse and three clusters each, of 2 to 4 checkpoints; cluster 3 shares a spot with cluster 2."""
    make = spark.createDataFrame
    loc = make([(i, a, b) for i, a, b in scatter(10, 1)], "location_id bigint, lat double, lon double")
    lc = make([(i, i % 4) for i in range(9)], "location_id bigint, cluster_id bigint")
    pl = make([(f"p{p}", (p + k) % 9, False) for p in range(presets) for k in range(3)] + [(f"p{p}", 9, True) for p in range(presets)], "preset_id string, location_id bigint, is_warehouse boolean")
    spots = scatter(12, 2)
    cp = make([(i, i % 4, a, b) for i, a, b in spots] + [(20, 3, spots[2][1], spots[2][2])], "checkpoint_id bigint, cluster_id bigint, lat double, lon double")
    return make([(f"p{p}",) for p in range(presets)], "preset_id string"), pl, loc, lc, cp


def test_a_lean_cut_leaves_no_shuffle(spark):
    before = shuffled(spark)
    df = session.cut_lean(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20  # they are deleted beside what the driver does
    while shuffled(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled(spark) - before and spark.conf.get(session.FREED, None) in (None, "false")
    more, seen = session.cut_lean_and_measure(df.join(df.withColumnRenamed("count", "n"), "k"), rows=F.count(F.lit(1)))
    assert df.count() == 7 and seen["rows"] == 7 and more.count() == 7


def test_unread_tables_of_a_step_go(spark):
    before, since = tables(spark), session.tables_written()
    a = session.cut_lean(spark.range(5).toDF("k"))
    b = session.cut_lean(a.withColumn("n", F.lit(1)))
    c = session.cut_lean(b.where("k > 2"))
    assert session.release_unread(since, c.hint("merge"), a.join(spark.range(2).toDF("k"), "k")) == 1
    assert len(tables(spark) - before) == 2
    assert c.count() == 2 and a.count() == 5


def test_prepared_instances_keep_three_tables(spark):
    before = tables(spark)
    out = scenario.prepare_instances(*instances(spark))
    assert len(tables(spark) - before) == 3  # depots, required clusters, stops
    n = scenario.clusters_served(out["nodes"].where("kind = 'checkpoint'"), out["served"], "n")
    direct = out["served"].groupBy("instance_id", "stop_id").agg(F.count_distinct("cluster_id").alias("n"))
    assert tuples(n, "instance_id", "stop_id", "n") == tuples(direct, "instance_id", "stop_id", "n")
    assert {r["n"] for r in n.collect()} == {1, 2}


def test_presets_beyond_the_limit_have_the_same_stops(spark, monkeypatch):
    given = instances(spark)
    rows = lambda: tuples(scenario.prepare_instances(*given)["nodes"], "instance_id", "idx", "stop_id", "lat", "lon")
    whole = rows()
    monkeypatch.setattr(ranks, "LARGE", 8)
    monkeypatch.setattr(scenario, "PAGE", 2)
    assert rows() == whole


def test_covering_tours_write_no_copy_of_the_stops(spark):
    out = scenario.prepare_instances(*instances(spark))
    before = tables(spark)
    tour = tours.covering_tours(out["depots"], out["served"])
    assert len(tables(spark) - before) == 1  # the instances with many rows, none here
    assert scenario.missing_clusters(out["required"], tour, out["served"]).count() == 0
    rows = scenario.solution_rows(tour, out["nodes"], out["served"])
    assert "lat" in rows.columns and "lat" not in scenario.solution_rows(tour, out["nodes"], out["served"], ()).columns
    assert {r["clusters_served"] for r in rows.where("kind = 'checkpoint'").collect()} <= {1, 2}


def planned(spark):
    """Four routes of five stops with a request each, routes 0 and 1 with two, and a route without one."""
    make = spark.createDataFrame
    routes = make([(r, k + 1, 10 * r + k, a, b) for r in range(5) for k, a, b in scatter(5, r)], "route_id bigint, seq bigint, node_id bigint, lat double, lon double")
    depots = make([(r, 3.0, 101.4) for r in range(5)], "route_id bigint, lat double, lon double")
    asked = [(r, r + 100 * n, r % 3, *scatter(1, 50 + r + n)[0][1:], *scatter(1, 90 + r + n)[0][1:]) for r in range(4) for n in range(2 if r < 2 else 1)]
    return routes, depots, make(asked, "route_id bigint, pair_id bigint, insertion_point bigint, pickup_lat double, pickup_lon double, dropoff_lat double, dropoff_lon double")


def test_inserted_pairs_leave_the_routes_and_their_report(spark):
    before = tables(spark)
    rebuilt, report = scenario.insert_pairs(*planned(spark))
    assert len(tables(spark) - before) == 3  # the routes and a table of each of two rounds
    assert rebuilt.count() == 5 * 5 + 2 * 6 and report.count() == 6
    assert all(r["km"] >= r["before_km"] - 1e-9 and r["strategy_a_km"] <= r["strategy_b_km"] + 1e-9 for r in report.collect())


def test_reoptimised_routes_leave_the_routes_and_their_report(spark):
    before = tables(spark)
    rebuilt, report = insertion.reoptimise(*planned(spark))
    assert len(tables(spark) - before) == 3  # the routes, what was inserted, and which were solved exactly
    assert rebuilt.count() == 5 * 5 + 2 * 6
    assert tuples(report, "route_id", "n_pairs", "exact") == [(0, 2, False), (1, 2, False), (2, 1, True), (3, 1, True)]


def test_chosen_checkpoints_leave_candidates_and_choice(spark):
    routes, depots, requests = planned(spark)
    candidates = spark.createDataFrame([(p, role, i, a, b) for p in (2, 3) for role in ("pickup", "dropoff") for i, a, b in scatter(3, p)], "pair_id bigint, role string, checkpoint_id bigint, lat double, lon double")
    before = tables(spark)
    chosen, errors = insertion.choose_ends(routes, depots, requests, candidates)
    assert len(tables(spark) - before) == 2
    assert tuples(chosen, "route_id", "pair_id") == [(2, 2), (3, 3)] and errors.count() == 4


def test_solvers_leave_the_first_and_the_improved_paths(spark):
    out = scenario.prepare_instances(*instances(spark))
    named = out["depots"].withColumn("algorithm", F.lit("two_opt"))
    stops = out["served"].select("instance_id", "stop_id", "lat", "lon").distinct()
    first = session.cut_lean(tours.closed_paths(out["depots"], stops, tours.covering_tours(out["depots"], out["served"])))
    whole = tuples(scenario.solve_checkpoints(named, out["served"]).where("node_id is not null"), "instance_id", "seq", "node_id")
    for solve in (lambda: scenario.solve_checkpoints(named, out["served"], first=first), lambda: scenario.solve_static(named, stops, first=first)):
        before = tables(spark)
        paths = solve()
        assert len(tables(spark) - before) == 1  # the improved paths
        assert tuples(paths.where("node_id is not null"), "instance_id", "seq", "node_id") == whole
