"""Registered queries of the sources, sinks and table maintenance (S)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import geo
from waymark.plans.registry import register
from waymark.session import scratch_folder
from waymark.sources import tables

def now():
    return F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")


def _fresh(t, name):
    return scratch_folder(t.spark, name)


@register("s1_read_table", "select o_orderkey, o_custkey, o_totalprice, o_orderdate from orders")
def _(t):
    schema = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz")
    return tables.read_table(t.spark, t.sf_dir, "orders.parquet", schema=schema)


def snapshot_tables(t):
    return {n: getattr(t, n) for n in ("locations", "clusters", "security_checkpoints", "preset_locations")}


@register(
    "s2_write_snapshot",
    """select 'locations' as table_name, count(*) as n from locations union all select 'clusters', count(*) from clusters union all select 'security_checkpoints', count(*) from security_checkpoints
 union all select 'preset_locations', count(*) from preset_locations""",
    "locations clusters security_checkpoints preset_locations",
)
def _(t):
    root = _fresh(t, "snapshot")
    tables.write_snapshot(snapshot_tables(t), root, "2024-01-01")
    counts = [
        tables.read_table(t.spark, root, n, "2024-01-01").agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in snapshot_tables(t)
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register(
    "s3_missing_tables",
    """select snapshot_id, table_name from (select distinct date_trunc('hour', ts) as snapshot_id from events), (select unnest(['view', 'signup', 'purchase', 'error', 'click']) as table_name)
 except select date_trunc('hour', ts), event_type from events""",
)
def _(t):
    present = t.events.select(F.date_trunc("hour", "ts").alias("snapshot_id"), F.col("event_type").alias("table_name")).distinct()
    rows = tables.missing_tables(present, ["view", "signup", "purchase", "error", "click"])
    return rows.withColumn("snapshot_id", F.col("snapshot_id").cast("timestamp_ntz"))


@register(
    "s4_snapshot_stats",
    """select strftime(m, '%Y-%m') as snapshot_id, cast(coalesce(sum(p), 0) as bigint) as presets, cast(coalesce(sum(r), 0) as bigint) as runs from (
 select date_trunc('month', created_at) as m, 1 as p, null as r from presets union all select date_trunc('month', created_at), null, 1 from runs) group by 1""",
    "presets runs",
)
def _(t):
    stamped = {n: getattr(t, n).withColumn("snapshot_id", F.date_format("created_at", "yyyy-MM")) for n in ("presets", "runs")}
    return tables.snapshot_stats(stamped)


@register(
    "s5_optional_columns",
    """select checkpoint_id, cluster_id, from_road_type, to_road_type, confidence, 'new' as snapshot_id from security_checkpoints
 union all select checkpoint_id, cluster_id, null, null, null, 'old' from security_checkpoints""",
    "security_checkpoints",
)
def _(t):
    cp = t.security_checkpoints
    old = tables.with_optional_columns(cp.select("checkpoint_id", "cluster_id")).withColumn("snapshot_id", F.lit("old"))
    new = tables.with_optional_columns(cp.drop("lat", "lon")).withColumn("snapshot_id", F.lit("new"))
    return new.unionByName(old)


def run_records(t):
    """Run records as the solvers return them."""
    odd = F.col("run_id") % 2 == 1
    info = F.struct(
        F.date_format("created_at", "yyyy-MM").alias("snapshot_id"), "preset_id", "algorithm", "test_type", "num_vehicles"
    )
    return t.runs.select(
        "run_id", "total_distance", F.when(odd, F.col("computation_ms")).alias("execution_time_ms"),
        (F.col("computation_ms") / 2).alias("computation_time"), info.alias("test_info"),
    )


_RESULTS = """results as (select run_id, strftime(created_at, '%Y-%m') as snapshot_id, preset_id, algorithm, num_vehicles, coalesce(test_type, 'static') as test_type, total_distance,
 case when run_id % 2 = 1 then computation_ms else computation_ms / 2 end as computation_ms from runs)"""


@register("s6_append_results", "select * from results", "runs", _RESULTS)
def _(t):
    path = _fresh(t, "results")
    tables.append_results(run_records(t), path)
    return t.spark.read.parquet(path).drop("payload")


@register("s7_read_results", "select run_id, algorithm, num_vehicles, test_type from results", "runs", _RESULTS)
def _(t):
    stored = tables.result_rows(run_records(t)).withColumn("algorithm", F.when(F.col("run_id") % 3 == 0, "").otherwise(F.col("algorithm")))
    stored = stored.withColumn("num_vehicles", F.when(F.col("run_id") % 5 == 0, 0).otherwise(F.col("num_vehicles")))
    return tables.backfill_results(stored).select("run_id", "algorithm", "num_vehicles", "test_type")


def preset_requests(t):
    """Save requests: every preset's warehouse and destinations, and once more a point next to the warehouse."""
    points = t.preset_locations.join(t.locations, "location_id").join(t.presets, "preset_id")
    near = points.where("is_warehouse").withColumns({"lat": F.col("lat") + 5e-5, "is_warehouse": F.lit(False)})
    return points.unionByName(near).select(F.col("preset_id").alias("name"), "created_at", "is_warehouse", "lat", "lon", "street", "city")


@register(
    "s8_ingest_presets",
    "select preset_id as name, count(*) as n_links, count(*) filter (is_warehouse) as n_warehouses from preset_locations group by 1",
    "preset_locations",
)
def _(t):
    out = tables.ingest_presets(preset_requests(t))
    links = out["preset_locations"].groupBy("preset_id").agg(F.count("*").alias("n_links"), F.count_if(F.col("is_warehouse")).alias("n_warehouses"))
    return links.join(out["presets"], "preset_id").select("name", "n_links", "n_warehouses")


def incoming_points(t):
    """Points to store: each location again, moved by nothing, a little, or too far, in part with a new street."""
    step = (F.col("location_id") % 3) * 6e-5
    street = F.when(F.col("location_id") % 2 == 0, F.concat("street", F.lit(" X"))).otherwise(F.col("street"))
    return t.locations.select(
        F.col("location_id").alias("request_id"), (F.col("lat") + step).alias("lat"), (F.col("lon") + step).alias("lon"), street.alias("street"), "neighborhood"
    )


@register(
    "s9_upsert_locations",
    """select round(lat, 6) as lat, round(lon, 6) as lon, street, neighborhood, change from (
 select l.lat, l.lon, coalesce(n.street, l.street) as street, l.neighborhood, case when n.location_id is null then 'kept' else 'updated' end as change from locations l left join (
  select location_id, street || ' X' as street from locations where location_id % 2 = 0 and location_id % 3 <> 2) n using (location_id)
 union all select lat + 12e-5, lon + 12e-5, case when location_id % 2 = 0 then street || ' X' else street end, neighborhood, 'inserted' from locations where location_id % 3 = 2)""",
    "locations",
)
def _(t):
    rows = tables.upsert_locations(t.locations.select("location_id", "lat", "lon", "street", "neighborhood"), incoming_points(t))
    return rows.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "street", "neighborhood", "change")


@register(
    "s9_upsert_locations_exact",
    "select change, count(*) as n from (select case when location_id % 3 <> 0 then 'kept' when location_id % 2 = 0 then 'updated' else 'kept' end as change from locations union all select 'inserted' from locations where location_id % 3 <> 0) group by 1",
    "locations",
)
def _(t):
    rows = tables.upsert_locations(t.locations.select("location_id", "lat", "lon", "street", "neighborhood"), incoming_points(t), tol=None)
    return rows.groupBy("change").agg(F.count("*").alias("n"))


def _patch(t):
    moved = (F.col("location_id") + F.when(F.col("location_id") % 4 == 3, 1_000_000_000).otherwise(0)).alias("location_id")
    new = [F.when(F.col("location_id") % 3 == 0, "").otherwise(F.concat(c, F.lit("!"))).alias(c) for c in ("street", "city")]
    return t.locations.where("street <> '' and neighborhood <> ''").select(moved, "lat", "lon", *new)


_PATCH = """patch as (select location_id + case when location_id % 4 = 3 then 1000000000 else 0 end as location_id, case when location_id % 3 = 0 then null else street || '!' end as street,
 case when location_id % 3 = 0 then null else city || '!' end as city from locations where street <> '' and neighborhood <> '')"""


@register(
    "s10_patch_addresses",
    """select l.location_id, coalesce(p.street, l.street) as street, coalesce(p.city, l.city) as city, case when p.location_id is null then 'kept' else 'patched' end as change
 from locations l left join patch p using (location_id)""",
    "locations",
    _PATCH,
)
def _(t):
    return tables.patch_addresses(t.locations, _patch(t)).select("location_id", "street", "city", "change")


@register(
    "s10_overwrite_addresses",
    """select coalesce(l.location_id, p.location_id) as location_id, case when p.location_id is not null then p.street else l.street end as street, case when p.location_id is not null then p.city else l.city end as city,
 case when p.location_id is null then 'kept' when l.location_id is null then 'inserted' else 'patched' end as change from locations l full join patch p on l.location_id = p.location_id""",
    "locations",
    _PATCH,
)
def _(t):
    return tables.patch_addresses(t.locations, _patch(t), overwrite=True).select("location_id", "street", "city", "change")


@register(
    "s11_upsert_links",
    """select location_id, cluster_id from location_clusters where location_id not in (select location_id from preset_locations where is_warehouse)
 union all select distinct location_id, 0 from preset_locations where is_warehouse""",
    "location_clusters preset_locations",
)
def _(t):
    new = t.preset_locations.where("is_warehouse").select("location_id").distinct().withColumn("cluster_id", F.lit(0).cast("bigint"))
    return tables.upsert_links(t.location_clusters, new)


@register(
    "s12_merge_checkpoints",
    """select cluster_id, round(lat, 6) as lat, from_road_type, to_road_type, confidence, change from (
 select cluster_id, case when checkpoint_id % 2 = 0 then lat + 1e-3 else lat end as lat, case when checkpoint_id % 2 = 0 then 'unclassified' else from_road_type end as from_road_type,
  case when checkpoint_id % 2 = 0 then 'service' else to_road_type end as to_road_type, confidence, case when checkpoint_id % 2 = 0 then 'updated' else 'kept' end as change from security_checkpoints
 union all select cluster_id, lat + 1e-3, 'unclassified', 'service', 7e-1, 'new' from security_checkpoints where checkpoint_id % 2 = 1)""",
    "security_checkpoints",
)
def _(t):
    cp = t.security_checkpoints
    key = F.col("checkpoint_id").cast("string")
    edits = cp.select(
        F.when(F.col("checkpoint_id") % 2 == 0, key).otherwise(F.concat(F.lit("temp-"), key)).alias("id"), "cluster_id", (F.col("lat") + 1e-3).alias("lat"), "lon",
        F.lit(None).cast("string").alias("from_type"), F.lit("service").alias("to_type"), F.lit(None).cast("double").alias("confidence"),
    )
    broken = edits.withColumn("lat", F.lit(None).cast("double"))
    rows = tables.merge_checkpoints(cp, edits.unionByName(broken))
    return rows.select("cluster_id", F.round("lat", 6).alias("lat"), "from_road_type", "to_road_type", "confidence", "change")


def _generated(t):
    fields = {"from_road_type": F.lit("primary"), "to_road_type": F.lit("residential"), "confidence": F.lit(0.5)}
    return t.clusters.where("name like 'Taman%'").select("cluster_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon")).withColumns(fields)


@register(
    "s13_replace_checkpoints",
    """select mode, cluster_id, from_road_type, confidence from (
 select 'regenerate' as mode, cluster_id, from_road_type, confidence from security_checkpoints where cluster_id not in (select cluster_id from clusters where name like 'Taman%')
 union all select 'regenerate', cluster_id, 'primary', 0.5 from clusters where name like 'Taman%'
 union all select 'keep', cluster_id, 'existing', 1.0 from security_checkpoints
 union all select 'keep', cluster_id, 'primary', 0.5 from clusters where name like 'Taman%' and cluster_id not in (select cluster_id from security_checkpoints))""",
    "security_checkpoints clusters",
)
def _(t):
    out = [tables.replace_checkpoints(t.security_checkpoints, _generated(t), r).withColumn("mode", F.lit(m)) for m, r in (("regenerate", True), ("keep", False))]
    return out[0].unionByName(out[1]).select("mode", "cluster_id", "from_road_type", "confidence")


@register(
    "s14_delete_presets",
    """select 'presets' as table_name, count(*) as n from presets p join supplier on split_part(preset_id, '-', 1) = cast(s_suppkey as varchar) where s_acctbal >= 0
 union all select 'preset_locations', count(*) from preset_locations join supplier on split_part(preset_id, '-', 1) = cast(s_suppkey as varchar) where s_acctbal >= 0
 union all select 'clusters', count(*) from clusters where name not like 'Taman%' union all select 'security_checkpoints', count(*) from security_checkpoints where cluster_id in (select cluster_id from clusters where name not like 'Taman%')""",
    "presets preset_locations clusters security_checkpoints",
)
def _(t):
    indebted = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("owner"))
    ids = t.presets.withColumn("owner", F.substring_index("preset_id", "-", 1)).join(indebted, "owner").select("preset_id")
    left = tables.delete_presets({"presets": t.presets, "preset_locations": t.preset_locations}, ids)
    left |= tables.delete_clusters({"clusters": t.clusters, "security_checkpoints": t.security_checkpoints}, t.clusters.where("name like 'Taman%'"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@register(
    "s15_delete_by_id",
    "select 'left' as what, count(*) as n from runs where run_id not in (select l_orderkey from lineitem where l_returnflag = 'R') union all select 'deleted', count(*) from runs where run_id in (select l_orderkey from lineitem where l_returnflag = 'R')",
    "runs",
)
def _(t):
    ids = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"))
    left = tables.delete_by_id(t.runs, ids, "run_id").agg(F.count("*").alias("n")).select(F.lit("left").alias("what"), "n")
    gone = tables.deleted_count(t.runs, ids, "run_id").select(F.lit("deleted").alias("what"), F.col("deleted").alias("n"))
    return left.unionByName(gone)


@register(
    "s16_expire",
    "select 'kept' as what, run_id as n from runs where epoch(timestamp '2002-01-01 00:00:00') - epoch(created_at) <= 94608000 union all select 'removed', count(*) from runs where epoch(timestamp '2002-01-01 00:00:00') - epoch(created_at) > 94608000 union all select 'removed presets', count(*) from presets where epoch(timestamp '2002-01-01 00:00:00') - epoch(created_at) > 94608000",
    "runs presets",
)
def _(t):
    limit = 3 * 365 * 86400
    kept = tables.expire(t.runs, now(), limit).select(F.lit("kept").alias("what"), F.col("run_id").alias("n"))
    removed = tables.expired_counts({"removed": t.runs, "removed presets": t.presets}, now(), limit)
    return kept.unionByName(removed.select(F.col("table_name").alias("what"), F.col("removed").alias("n")))


@register(
    "s17_table_sizes",
    "select 'events' as table_name, count(*) as n_rows, cast(coalesce(sum(length(props)), 0) as bigint) as characters from events union all select 'documents', count(*), cast(coalesce(sum(length(text)), 0) as bigint) from documents",
)
def _(t):
    docs = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")
    return tables.table_sizes({"events": (t.events, "props"), "documents": (docs, "text")})
