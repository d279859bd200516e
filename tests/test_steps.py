"""Steps that work many rows together give the results of each row alone; tables that several steps read are written once."""

import itertools
import random

import numpy as np
from helpers import tuples

from waymark import session
from waymark.operators import tours
from waymark.plans import insertion, scenario


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def places(rows, n, seed):
    r = np.random.default_rng(seed)
    return 3 + r.random((rows, n)) * 0.2, 101 + r.random((rows, n)) * 0.2


def lengths(lat, lon, order):
    at = np.arange(len(lat))[:, None]
    return tours._km_matrix(lat, lon)[at, order[:, :-1], order[:, 1:]].sum(axis=1)


def test_paths_in_step_are_those_of_each_alone():
    lat, lon = places(12, 9, 1)
    rng = random.Random(2)
    pair, role = np.full(lat.shape, -1), np.zeros(lat.shape, int)
    for row in range(6):
        a, b = sorted(rng.sample(range(1, 8), 2))
        pair[row, [a, b]], role[row, [a, b]] = 7, (1, 2)
    orders, changed = insertion._improve_in_step(lat, lon, pair, role)
    for row, (order, moved) in enumerate(zip(orders, changed)):
        alone, same = insertion._improve(lat[row], lon[row], pair[row], role[row])
        assert alone.tolist() == order.tolist() and same == moved
        assert sorted(order) == list(range(9)) and order[0] == 0 and order[-1] == 8
        if row < 6:
            assert [role[row, i] for i in order if role[row, i]] == [1, 2]
    stay = np.tile(np.arange(9), (12, 1))
    assert (lengths(lat, lon, orders)[changed] < lengths(lat, lon, stay)[changed]).all()
    whole = tours._untangle(lat, lon)
    for row, order in enumerate(whole):
        assert tours._untangle(lat[[row]], lon[[row]])[0].tolist() == order.tolist()
        for i, j in itertools.combinations(range(1, 8), 2):
            other = np.concatenate([order[:i], order[i : j + 1][::-1], order[j + 1 :]])
            assert lengths(lat[[row]], lon[[row]], other[None])[0] >= lengths(lat[[row]], lon[[row]], order[None])[0] - 1e-9


def test_ways_that_meet_are_the_shortest():
    for n in (4, 5, 6):
        lat, lon = places(4, n + 2, n)
        lat[:, -1], lon[:, -1] = lat[:, 0], lon[:, 0]
        order, km = tours._best_orders(tours._km_matrix(lat, lon), np.full(4, -1), np.full(4, -1), closed=True)
        for row in range(4):
            tries = np.array([[0, *[i + 1 for i in p], n + 1] for p in itertools.permutations(range(n))])
            best = lengths(np.tile(lat[row], (len(tries), 1)), np.tile(lon[row], (len(tries), 1)), tries).min()
            own = np.array([[0, *(order[row] + 1), n + 1]])
            assert abs(km[row] - best) < 1e-9 and abs(lengths(lat[[row]], lon[[row]], own)[0] - best) < 1e-9


def test_static_instances_are_written(spark):
    pl = spark.createDataFrame([("p", 1, False), ("p", 2, True), ("q", 1, False)], "preset_id string, location_id bigint, is_warehouse boolean")
    loc = spark.createDataFrame([(1, 3.0, 101.0), (2, 3.1, 101.1)], "location_id bigint, lat double, lon double")
    depots, stops = scenario.static_instances(pl, loc)
    assert "Join" not in plan(depots) and "Join" not in plan(stops)
    assert tuples(depots) == [("p", 3.1, 101.1)] and tuples(stops) == [("p", 1, 3.0, 101.0)]


def test_parts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    df = spark.range(95)
    assert session.spread(df, "id").rdd.getNumPartitions() == 4
    assert session.spread(df, "id", rows=95).rdd.getNumPartitions() == 10
