import math
import random

import pytest
from helpers import km, scatter, tuples
from pyspark.sql import functions as F

from waymark.operators import density
from waymark.operators.components import components
from waymark.operators.density import density_groups


def labels(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((n, find(n)) for n in parent)


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(300)],
    [(500, i) for i in range(200)] + [(700, 701), (701, 702)],
    [(random.Random(i).randint(0, 120), random.Random(-i - 1).randint(0, 120)) for i in range(90)],
    [(5, 5)],
], ids=["chain", "hub", "random", "loop"])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert tuples(components(df)) == labels(edges)


def brute_density(points, near, k):
    hood = {i: [j for j, b in points.items() if near(a, b)] for i, a in points.items()}
    core = {i for i in points if len(hood[i]) >= k}
    name = dict(labels([(i, j) for i in core for j in hood[i] if j in core]))
    out = []
    for i in points:
        options = [name[j] for j in hood[i] if j in core]
        out.append((i, name[i] if i in core else min(options) if options else i, i not in core and not options))
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3, 6])
def test_density_on_the_sphere(spark, k):
    rows = scatter(250, 8, span=0.03) + [(1000 + i, 3.01, 101.41) for i in range(40)] + [(2000, 3.01, 101.411), (2001, 3.0101, 101.4125)]
    df = spark.createDataFrame(rows, "id bigint, lat double, lon double")
    points = {i: at for i, *at in rows}
    got = tuples(density_groups(df, "id", 150, k), "id", "group_id", "is_noise")
    assert got == brute_density(points, lambda a, b: km(a, b) <= 0.15, k)


def test_density_per_group_in_degrees(spark):
    rows = [(i % 2, i, a, b) for i, a, b in scatter(160, 9, span=0.02)]
    df = spark.createDataFrame(rows, "g bigint, id bigint, lat double, lon double")
    got = tuples(density_groups(df, "id", 111, 1, by=["g"], planar=True), "id", "group_id", "is_noise")
    want = []
    for g in (0, 1):
        want += brute_density({i: at for h, i, *at in rows if h == g}, lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 < 1e-6, 1)
    assert got == sorted(want)


def test_same_key_in_two_groups(spark):
    rows = [(0, 1, 3.0, 101.0), (0, 2, 3.0, 101.0001), (1, 1, 3.0, 101.0), (1, 3, 3.1, 101.0)]
    df = spark.createDataFrame(rows, "g bigint, id bigint, lat double, lon double")
    got = tuples(density_groups(df, "id", 50, 1, by=["g"], planar=True), "g", "id", "group_id")
    assert got == [(0, 1, 1), (0, 2, 1), (1, 1, 1), (1, 3, 3)]


@pytest.mark.parametrize("gap", [0.99, 1.01])
def test_two_crowded_cells_about_eps_apart(spark, monkeypatch, gap):
    """Points of two discs whose nearest ends are just closer or just farther than eps."""
    r = random.Random(3)
    metre = 1 / 111_195
    left, right = [(3.0, 101.4 - 9e-6)], [(3.0, 101.4 - 9e-6 + gap * 100 * metre / math.cos(math.radians(3.0)))]
    while len(left) < 1500:
        y, x = r.uniform(-8, 8), r.uniform(0, 16)
        left.append((3.0 + y * metre, 101.4 - 9e-6 - (x + abs(y)) * metre))
        right.append((3.0 + y * metre, right[0][1] + (x + abs(y)) * metre))
    rows, measure = [], density.cut_and_measure

    def watched(df, **measures):
        out, seen = measure(df, **measures)
        rows.append(out.agg(F.sum(F.when(F.col("few"), F.col("n") * F.col("o_n")).otherwise(1))).first()[0] or 0)
        return out, seen

    monkeypatch.setattr(density, "cut_and_measure", watched)
    df = spark.createDataFrame([(i, *at) for i, at in enumerate(left + right)], "id bigint, lat double, lon double")
    found = tuples(density_groups(df, "id", 100, 1), "group_id")
    assert len(set(found)) == (1 if gap < 1 else 2)
    assert sum(rows) < 20 * len(left)
