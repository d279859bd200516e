import re

import pytest

import __spark_entry__ as entry
from tools.check import compare

QUICK = [
    "x1_normalize_street", "x13_haversine_km", "f1_near_equal", "f9_at_warehouse", "j3_exact_street_match", "j12_street_peers", "a1_preset_sizes", "a10_boundary_crossings",
    "a13_unique_checkpoints", "w8_cumulative_distance", "t2_run_history", "u5_neighbours", "s9_upsert_locations", "s12_merge_checkpoints", "c1_assign_clusters",
    "g8_highway_transitions", "r3_path_lengths", "r14_best_insertion", "r18_audit_routes",
]
INVENTORY = (
    [f"s{i}" for i in range(1, 18)] + [f"f{i}" for i in range(1, 15)] + [f"j{i}" for i in range(1, 24)] + [f"a{i}" for i in range(1, 21)] + [f"w{i}" for i in range(1, 11)]
    + [f"t{i}" for i in range(1, 7)] + [f"u{i}" for i in range(1, 7)] + [f"x{i}" for i in range(1, 25)] + [f"g{i}" for i in range(1, 19)] + [f"c{i}" for i in range(1, 8)]
    + [f"r{i}" for i in range(1, 20)] + [f"z{i}" for i in range(1, 4)]
)


def test_every_item_is_registered():
    names = {re.match(r"[a-z]+\d+", n).group(0) for n in entry.queries() if re.match(r"[a-z]+\d+_", n)}
    assert sorted(set(INVENTORY) - names) == []
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_rows_equal_sql(spark, name):
    state, n, _, _, note = compare(spark, "/root/testdata/sf0.001", name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "ok" or (state == "EMPTY" and n == 0 and not note), note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
