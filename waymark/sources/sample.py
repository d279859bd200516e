"""Sample geography derived from the order tables, as SQL that Spark and DuckDB read alike.

The given tables hold no coordinates or streets. Every view below derives them from whole tables, without subsets:
1,500 customers, 2,000 parts and 100 suppliers make one region of 25 tiles (one per nation), and further keys open
further regions, so density and group sizes stay the same while the number of rows, clusters and regions grows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIXED_TABLES = ["region", "nation"]  # of the same few rows at every size
KEYED_TABLES = ["customer", "part"]  # many rows of few bytes on disk: as broadcast relations they would fill the driver
BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _region(key: str, per_region: int) -> str:
    return f"cast(floor({key} / {per_region}) as bigint)"


def _lat0(reg: str) -> str:
    return f"3e0 + ({reg} % 200) * 25e-2"


def _lon0(reg: str) -> str:
    return f"1014e-1 + (cast(floor({reg} / 200) as bigint) % 250) * 3e-1"


def _jitter(key: str, factor: int, modulus: int, span: str = "36e-3") -> str:
    return f"(({key} * {factor}) % {modulus}) / {modulus}e0 * {span}"


_lat_jitter = partial(_jitter, factor=7919, modulus=10007)
_lon_jitter = partial(_jitter, factor=104729, modulus=10009)

_C = _region("c_custkey", 1500)
_S = _region("s_suppkey", 100)
_E = _region("event_id", 10000)
_PAIR = "(s_suppkey - s_suppkey % 2)"

_STREET = f"""concat(case c_custkey % 6 when 0 then 'Jalan ' when 1 then 'Jln ' when 2 then 'Lorong ' when 3 then 'Persiaran ' when 4 then 'jln. ' else '' end,
 case c_custkey % 5 when 0 then 'Setia ' when 1 then 'Taman Utama ' when 2 then 'Bandar A Baru ' when 3 then 'Nusantara ' else '' end,
 case when c_custkey % 11 = 10 then 'Besar' else concat('U', cast(c_custkey % 13 + 13 * {_C} as [S]),
 case c_custkey % 4 when 1 then '-' when 2 then ' ' else '/' end, cast(c_custkey % 40 as [S]),
 case when c_custkey % 27 = 26 then '' else chr(cast(65 + c_custkey % 27 as int)) end) end)"""

VIEWS = {
    "locations": f"""
select c_custkey as location_id, {_lat0(_C)} + floor(c_nationkey / 5) * 4e-2 + {_lat_jitter("c_custkey")} as lat,
 {_lon0(_C)} + (c_nationkey % 5) * 4e-2 + {_lon_jitter("c_custkey")} as lon, {_STREET} as street,
 case c_custkey % 4 when 0 then 'Setia Alam' when 1 then 'Taman Utama' when 2 then '' else n_name end as neighborhood,
 case c_custkey % 5 when 0 then concat('Setia ', cast({_C} as [S])) when 1 then concat('Taman Utama ', cast({_C} as [S]))
  when 2 then concat('BANDAR BARU ', cast({_C} as [S])) when 3 then concat('bandar baru ', cast({_C} as [S])) else null end as development,
 r_name as city, cast(40000 + c_custkey % 900 as [S]) as postcode, 'Malaysia' as country
from {{customer}} join {{nation}} on c_nationkey = n_nationkey join {{region}} on n_regionkey = r_regionkey""",
    "location_clusters": f"""
select c_custkey as location_id, {_C} * 25 + c_nationkey as cluster_id from {{customer}} where c_acctbal >= 0""",
    "clusters": f"""
select reg * 25 + n_nationkey as cluster_id,
 case n_nationkey % 3 when 0 then concat('Setia ', n_name, ' U', cast(n_nationkey as [S]), '/', cast(reg as [S])) when 1 then concat(n_name, ' SS', cast(n_nationkey as [S]), '/2A')
  else concat('Taman ', n_name) end as name,
 {_lat0("reg")} + floor(n_nationkey / 5) * 4e-2 + 18e-3 + ((n_nationkey * 37) % 25) * 1e-4 as centroid_lat,
 {_lon0("reg")} + (n_nationkey % 5) * 4e-2 + 18e-3 + ((n_nationkey * 11) % 25) * 1e-4 as centroid_lon
from (select distinct {_C} as reg, c_nationkey from {{customer}}) c join {{nation}} on c_nationkey = n_nationkey""",
    "security_checkpoints": f"""
select s_suppkey as checkpoint_id, {_S} * 25 + s_nationkey as cluster_id,
 {_lat0(_S)} + floor(cast(floor({_PAIR} / 2) as bigint) % 25 / 5) * 4e-2 + {_lat_jitter(_PAIR)} + (s_suppkey % 2) * 2e-4 as lat,
 {_lon0(_S)} + (cast(floor({_PAIR} / 2) as bigint) % 5) * 4e-2 + {_lon_jitter(_PAIR)} as lon,
 case s_suppkey % 3 when 0 then 'secondary' when 1 then 'tertiary' else 'unknown' end as from_road_type, 'residential' as to_road_type,
 case s_suppkey % 4 when 0 then 1e0 when 1 then 7e-1 when 2 then 5e-1 else 3e-1 end as confidence
from {{supplier}}""",
    "road_nodes": f"""
select p_partkey as node_id, {_lat0(_region("p_partkey", 2000))} + floor(p_partkey % 2000 / 50) * 5e-3 as lat,
 {_lon0(_region("p_partkey", 2000))} + (p_partkey % 50) * 5e-3 as lon, case when p_size = 50 then 'gate' end as barrier
from {{part}}""",
    "road_edges": f"""
select a.p_partkey as src, b.p_partkey as dst,
 case when a.p_partkey % 8 = 0 then 'secondary' when a.p_size % 3 = 0 then 'living_street' else 'residential' end as highway,
 cast(500 + (a.p_partkey * 31) % 97 as double) as length_m, case when a.p_size = 1 then 'private' end as access
from {{part}} a join {{part}} b on b.p_partkey = a.p_partkey + 50
where {_region("a.p_partkey", 2000)} = {_region("b.p_partkey", 2000)}
union all
select a.p_partkey, b.p_partkey,
 case when floor(a.p_partkey % 2000 / 50) % 8 = 0 then 'primary' when a.p_size % 3 = 0 then 'service' else 'residential' end,
 cast(500 + (a.p_partkey * 31) % 97 as double), case when a.p_size = 1 then 'private' end
from {{part}} a join {{part}} b on b.p_partkey = a.p_partkey + 1
where floor(a.p_partkey / 50) = floor(b.p_partkey / 50)""",
    "presets": """
select preset_id, name, min(month_start) as created_at from (
 select concat(cast(l_suppkey as [S]), '-', cast(year(l_shipdate) * 100 + month(l_shipdate) as [S])) as preset_id, s_name as name, date_trunc('month', l_shipdate) as month_start
 from {lineitem} join {supplier} on l_suppkey = s_suppkey) p group by preset_id, name""",
    "preset_locations": f"""
select distinct concat(cast(l_suppkey as [S]), '-', cast(year(l_shipdate) * 100 + month(l_shipdate) as [S])) as preset_id,
 {_region("l_suppkey", 100)} * 1500 + o_custkey % 1500 as location_id, false as is_warehouse
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey
where {_region("l_suppkey", 100)} * 1500 + o_custkey % 1500 <> {_region("l_suppkey", 100)} * 1500 + l_suppkey % 100
union all
select distinct concat(cast(l_suppkey as [S]), '-', cast(year(l_shipdate) * 100 + month(l_shipdate) as [S])),
 {_region("l_suppkey", 100)} * 1500 + l_suppkey % 100, true from {{lineitem}}""",
    "dynamic_pairs": f"""
select event_id as pair_id, ts, user_id as vehicle_key,
 concat('Jalan Setia U', cast(event_id % 13 + 13 * {_E} as [S]), '/', cast(event_id % 40 as [S]), chr(cast(65 + event_id % 26 as int))) as pickup_street,
 {_lat0(_E)} + {_lat_jitter("event_id", span="2e-1")} as pickup_lat, {_lon0(_E)} + {_lon_jitter("event_id", span="2e-1")} as pickup_lon,
 {_lat0(_E)} + {_jitter("event_id", 15485863, 10007, "2e-1")} as dropoff_lat, {_lon0(_E)} + {_jitter("event_id", 32452843, 10009, "2e-1")} as dropoff_lon
from {{events}}""",
    "demand": """
select l_orderkey * 10 + l_linenumber as demand_id, l_shipdate as ts, o_custkey as location_id, case when l_returnflag = 'R' then 'Pickup' else 'delivery' end as type
from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "runs": """
select o_orderkey as run_id, cast(o_custkey as [S]) as preset_id,
 case o_orderstatus when 'O' then 'nearest_neighbor' when 'F' then 'two_opt' else 'heuristic' end as algorithm,
 cast(substring(o_orderpriority, 1, 1) as int) as num_vehicles, case when o_orderkey % 7 = 0 then null else 'static' end as test_type,
 o_totalprice as total_distance, cast(o_orderkey % 900 as double) as computation_ms, o_orderdate as created_at from {orders}""",
    "route_stops": f"""
select o_custkey as run_id, l_orderkey as route_id, l_suppkey as checkpoint_id, c.cluster_id, c.lat, c.lon,
 cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as bigint) as seq
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey join {{security_checkpoints}} c on c.checkpoint_id = l_suppkey""",
}


def _needs(text: str) -> list[str]:
    return [n for n in [*BASE_TABLES, *VIEWS] if "{" + n + "}" in text]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view of the tables in ``sf_dir``."""
    if name in BASE_TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in FIXED_TABLES:
            return F.broadcast(table)
        return table.hint("merge") if name in KEYED_TABLES else table
    text = VIEWS[name].replace("[S]", "string")
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in _needs(text)})


def with_views(*names: str) -> str:
    """The ``WITH`` list of the named views and those they need, for DuckDB."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for n in _needs(VIEWS[name]):
                add(n)
            ordered.append(name)

    for name in names:
        add(name)
    tables = {n: n for n in [*BASE_TABLES, *VIEWS]}
    parts = [f"{n} as ({VIEWS[n].replace('[S]', 'varchar').format(**tables)})" for n in ordered]
    return ", ".join(parts)
