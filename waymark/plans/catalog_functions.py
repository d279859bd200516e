"""Registered queries of the column functions (X) and of the filters and projections (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import geo, payload, streets
from waymark.operators import lookups
from waymark.plans import duck
from waymark.plans.registry import register
from waymark.session import cut_and_measure, spread


def _r(c, alias):
    return F.round(c, 6).alias(alias)


# ---- street text ----------------------------------------------------------------------------------------------


@register("x1_normalize_street", f"select location_id, {duck.norm('street')} as normal from locations", "locations")
def _(t):
    return t.locations.select("location_id", streets.normalize_street("street").alias("normal"))


@register("x2_street_stem", f"select location_id, {duck.stem(duck.norm('street'))} as stem from locations", "locations")
def _(t):
    return t.locations.select("location_id", streets.street_stem(streets.normalize_street("street")).alias("stem"))


@register(
    "x3_section_identifier",
    r"""select location_id, coalesce(nullif(upper(regexp_extract(street, '(?i)([A-Z]+[0-9]+)[/\\]([0-9]+)[A-Z]?', 1)), ''),
 nullif(upper(regexp_extract(street, '(?i)([A-Z]+[0-9]+)[^0-9]*$', 1)), '')) as section,
 nullif(regexp_extract(street, '(?i)([A-Z]+[0-9]+)[/\\]([0-9]+)[A-Z]?', 2), '') as subsection from locations""",
    "locations",
)
def _(t):
    return t.locations.select("location_id", streets.section_identifier("street").alias("s")).select("location_id", "s.*")


@register("x4_development_name", f"select location_id, dev_name from {duck.development_rows('locations')}", "locations")
def _(t):
    return t.locations.select("location_id", streets.development_name("street", "neighborhood").alias("dev_name"))


_C1 = duck.sub(duck.sub(duck.sub("street", r"(?i)\s+[A-Z]\s+", " "), r"(?i)\s+[A-Z]$"), r"(?i)^\s*[A-Z]\s+")


@register(
    "x5_clean_street",
    rf"""select location_id, {duck.trim(duck.sub("case when hit then concat_ws(' ', pre, section, suf) else s end", r"\s+", " "))} as clean from (
 select location_id, s, regexp_matches(s, '[A-Za-z]+[0-9]+/[0-9]+') as hit,
  {duck.sub(duck.sub(duck.trim("regexp_extract(s, '(?i)^(.*?)([A-Z]+[0-9]+)/([0-9]+[A-Z]?)(.*)$', 1)"), r"\s+", "  "), r"(?i)\s[A-Z](\s|$)", " ")} as pre,
  regexp_extract(s, '(?i)([A-Z]+[0-9]+/[0-9]+[A-Z]?)', 1) as section,
  {duck.sub(duck.trim("regexp_extract(s, '(?i)^(.*?)([A-Z]+[0-9]+)/([0-9]+[A-Z]?)(.*)$', 4)"), r"(?i)^\s*[A-Z]\s+")} as suf
 from (select location_id, {_C1} as s from locations))""",
    "locations",
)
def _(t):
    return t.locations.select("location_id", streets.clean_street("street").alias("clean"))


@register(
    "x6_street_parts",
    f"select location_id, development, section, subsection, block from {duck.parts('street', '(select location_id, street from locations)')}",
    "locations",
)
def _(t):
    return t.locations.select("location_id", streets.street_parts("street").alias("p")).select("location_id", "p.*")


def _keys(source):
    return f"""select location_id, street, normal, nullif({duck.stem("normal")}, normal) as stem, nullif(development, '') as development, nullif(section, '') as section,
 nullif(regexp_extract(subsection, '^([0-9]+)', 1), '') as number from {duck.parts("normal", f"(select location_id, street, {duck.norm('street')} as normal from {source})")}"""


@register(
    "x7_streets_match",
    """select a.location_id, b.location_id as other_id, case when a.normal = b.normal then 'exact' when a.stem = b.stem then 'stem'
 when a.development <> b.development then null when a.development = b.development and a.section = b.section then 'development'
 when a.section = b.section and a.number = b.number then 'section' end as level
from keys a join (select 1 as d union all select 65 union all select 520) o on true join keys b on b.location_id = a.location_id + o.d""",
    "locations",
    f"keys as ({_keys('locations')})",
)
def _(t):
    a = t.locations.select("location_id", "street", F.explode(F.array(*[F.col("location_id") + d for d in (1, 65, 520)])).alias("other_id"))
    b = t.locations.select(F.col("location_id").alias("other_id"), F.col("street").alias("other_street"))
    return a.join(b, "other_id").select("location_id", "other_id", streets.streets_match("street", "other_street").alias("level"))


@register(
    "x8_cluster_name",
    f"""select location_id, {duck.title("case when section <> '' then concat(case when development <> '' then development || ' ' else '' end, section, '/', regexp_replace(subsection, '([0-9]+)[a-zA-Z]$', '\\1')) else " + duck.stem("normal") + " end")} as cluster_name
 from {duck.parts("normal", f"(select location_id, {duck.norm('street')} as normal from locations)")}""",
    "locations",
)
def _(t):
    return lookups.new_cluster_names(t.locations)


@register("x9_title_case", f"select location_id, {duck.title('street')} as title from locations", "locations")
def _(t):
    return t.locations.select("location_id", streets.title_case("street").alias("title"))


@register(
    "x10_coord_key",
    "select location_id, printf('%.6f,%.6f', lat, lon) as key6, printf('%.5f,%.5f', lat, lon) as key5 from locations",
    "locations",
)
def _(t):
    return t.locations.select("location_id", geo.coord_key("lat", "lon").alias("key6"), geo.coord_key("lat", "lon", 5).alias("key5"))


@register(
    "x11_leg_key",
    "select pair_id, printf('route:%.5f,%.5f:%.5f,%.5f', pickup_lat, pickup_lon, dropoff_lat, dropoff_lon) as leg_key from dynamic_pairs",
    "dynamic_pairs",
)
def _(t):
    return t.dynamic_pairs.select("pair_id", geo.leg_key("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon").alias("leg_key"))


@register(
    "x12_param_hash",
    """select run_id, md5(concat('{"algorithm":"', algorithm, '","num_vehicles":', cast(num_vehicles as varchar), ',"preset_id":"', preset_id, '","test_type":',
 case when test_type is null then 'null' else '"' || test_type || '"' end, '}')) as param_hash from runs""",
    "runs",
)
def _(t):
    hashed = payload.param_hash(algorithm="algorithm", num_vehicles="num_vehicles", preset_id="preset_id", test_type="test_type")
    return t.runs.select("run_id", hashed.alias("param_hash"))


@register(
    "x13_haversine_km",
    f"select pair_id, round({duck.hav('pickup_lat', 'pickup_lon', 'dropoff_lat', 'dropoff_lon')}, 6) as km from dynamic_pairs",
    "dynamic_pairs",
)
def _(t):
    return t.dynamic_pairs.select("pair_id", _r(geo.haversine_km("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon"), "km"))


@register(
    "x14_degree_distance",
    """select pair_id, round(sqrt(pow(pickup_lat - dropoff_lat, 2) + pow(pickup_lon - dropoff_lon, 2)), 6) as degrees,
 round(pow(pickup_lat - dropoff_lat, 2) + pow(pickup_lon - dropoff_lon, 2), 6) as squared,
 round(50 / 111000, 9) as merge_degrees, round(50 / 111111, 9) as consolidate_degrees from dynamic_pairs""",
    "dynamic_pairs",
)
def _(t):
    ends = ("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon")
    return t.dynamic_pairs.select(
        "pair_id", _r(geo.degree_distance(*ends), "degrees"), _r(geo.degree_distance_sq(*ends), "squared"),
        F.round(F.lit(geo.metres_to_degrees(50)), 9).alias("merge_degrees"),
        F.round(F.lit(geo.metres_to_degrees(50, geo.MERGE_METRES_PER_DEGREE)), 9).alias("consolidate_degrees"),
    )


@register(
    "x15_int_metres",
    f"select pair_id, cast(trunc({duck.hav('pickup_lat', 'pickup_lon', 'dropoff_lat', 'dropoff_lon')} * 1000) as bigint) as metres from dynamic_pairs",
    "dynamic_pairs",
)
def _(t):
    km = geo.haversine_km("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon")
    return t.dynamic_pairs.select("pair_id", geo.int_metres(km).alias("metres"))


_LEVELS = """case coalesce(highway, 'unclassified') when 'motorway' then 1 when 'trunk' then 2 when 'primary' then 3 when 'secondary' then 4 when 'tertiary' then 5
 when 'unclassified' then 6 when 'residential' then 7 when 'living_street' then 7 when 'service' then 8 when 'track' then 9 when 'path' then 10
 when 'footway' then 11 when 'pedestrian' then 11 when 'cycleway' then 12 else 9 end"""


@register(
    "x16_road_hierarchy",
    f"select src, dst, level, level <= 5 as main, highway in ('residential', 'living_street') as residential from (select *, {_LEVELS} as level from road_edges)",
    "road_edges",
)
def _(t):
    return t.road_edges.select(
        "src", "dst", geo.road_level("highway").alias("level"), geo.is_main_road("highway").alias("main"), geo.is_residential("highway").alias("residential")
    )


@register(
    "x17_restricted_access",
    "select src, dst, coalesce(access in ('private', 'residents', 'no', 'destination'), false) as restricted from road_edges",
    "road_edges",
)
def _(t):
    return t.road_edges.select("src", "dst", geo.restricted_access("access").alias("restricted"))


@register(
    "x18_crossing_confidence",
    """select checkpoint_id, round(least(0.95, 0.5 + 0.5 * n / total), 6) as confidence from
 (select checkpoint_id, cluster_id, count(distinct route_id) as n from route_stops group by 1, 2) a join
 (select cluster_id, count(distinct route_id) as total from route_stops group by 1) b using (cluster_id)""",
    "route_stops",
)
def _(t):
    stops, seen = cut_and_measure(t.route_stops.select("cluster_id", "checkpoint_id", "route_id"), n=F.count(F.lit(1)))
    visits = spread(stops, "route_id", rows=seen["n"]).distinct()
    per_checkpoint = visits.groupBy("cluster_id", "checkpoint_id").agg(F.count("*").alias("n"))
    per_cluster = visits.select("cluster_id", "route_id").distinct().groupBy("cluster_id").agg(F.count("*").alias("total"))
    return per_checkpoint.join(per_cluster, "cluster_id").select("checkpoint_id", _r(geo.crossing_confidence("n", "total"), "confidence"))


@register(
    "x19_json_payload",
    """select run_id, concat('{"preset_id":"', preset_id, '","algorithm":"', algorithm, '","num_vehicles":', cast(num_vehicles as varchar), '}') as payload, algorithm, num_vehicles from runs""",
    "runs",
)
def _(t):
    text = t.runs.select("run_id", F.to_json(F.struct("preset_id", "algorithm", "num_vehicles")).alias("payload"))
    parsed = F.from_json("payload", "preset_id string, algorithm string, num_vehicles int")
    return text.select("run_id", "payload", F.get_json_object("payload", "$.algorithm").alias("algorithm"), parsed["num_vehicles"].alias("num_vehicles"))


@register(
    "x20_age_seconds",
    """select event_id, cast(epoch(timestamp '2024-02-01 00:00:00') - epoch(date_trunc('second', ts)) as bigint) as age_s,
 case when extract('microsecond' from ts) % 1000000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as iso from events""",
)
def _(t):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return t.events.select("event_id", payload.age_seconds(now, "ts").alias("age_s"), payload.iso_text("ts").alias("iso"))


@register(
    "x21_swap_axes",
    "select pair_id, round(pickup_lat, 6) as y1, round(pickup_lon, 6) as x1, round(dropoff_lat, 6) as y2, round(dropoff_lon, 6) as x2 from dynamic_pairs",
    "dynamic_pairs",
)
def _(t):
    line = F.array(F.array("pickup_lon", "pickup_lat"), F.array("dropoff_lon", "dropoff_lat"))
    s = t.dynamic_pairs.select("pair_id", geo.swap_axes(line).alias("p"))
    return s.select("pair_id", *[_r(F.col("p")[i][j], f"{n}{i + 1}") for i in (0, 1) for j, n in ((0, "y"), (1, "x"))])


@register(
    "x22_address_choice",
    """select location_id, coalesce(nullif(u, ''), nullif(r, '')) as street, case when nullif(u, '') is not null then 'user' when nullif(r, '') is not null then 'reference' else 'suggestion' end as source,
 nullif(u, '') is null and nullif(r, '') is null as needs_user_input from (select location_id, neighborhood as u, development as r from locations)""",
    "locations",
)
def _(t):
    return t.locations.select("location_id", streets.address_choice("neighborhood", "development").alias("a")).select("location_id", "a.*")


@register(
    "x23_name_to_development",
    "select cluster_id, case when contains(name, '/') then array_to_string(string_split(split_part(name, '/', 1), ' ')[1:-2], ' ') else name end as development from clusters",
    "clusters",
)
def _(t):
    return t.clusters.select("cluster_id", streets.name_to_development("name").alias("development"))


@register(
    "x24_display_stem",
    r"""select location_id, coalesce(nullif(trim(regexp_replace(trim(street), '(\s+(U[0-9]+|[0-9]+)/\S*|\s+[0-9]+[A-Z]?\s*|\s+/\s*\S+)$', '')), ''), nullif(trim(street), '')) as display_stem from locations""",
    "locations",
)
def _(t):
    return t.locations.select("location_id", streets.display_stem("street").alias("display_stem"))


# ---- filters and projections ----------------------------------------------------------------------------------

_SHIFTED = "shifted as (select location_id as request_id, lat + (location_id % 3) * 6e-5 as lat, lon + (location_id % 3) * 6e-5 as lon from locations)"


def shifted(t):
    step = (F.col("location_id") % 3) * 6e-5
    return t.locations.select(F.col("location_id").alias("request_id"), (F.col("lat") + step).alias("lat"), (F.col("lon") + step).alias("lon"))


@register(
    "f1_near_equal",
    """select request_id, min(location_id) as location_id from shifted s left join locations l on abs(s.lat - l.lat) < 0.0001 and abs(s.lon - l.lon) < 0.0001 group by 1""",
    "locations",
    _SHIFTED,
)
def _(t):
    return lookups.find_by_coordinates(shifted(t), t.locations).select("request_id", "location_id")


@register(
    "f2_in_box",
    """select checkpoint_id, count(location_id) as n_inside from security_checkpoints c left join locations l
 on l.lat between c.lat - 3e-3 and c.lat + 3e-3 and l.lon between c.lon - 3e-3 and c.lon + 3e-3 group by 1""",
    "locations security_checkpoints",
)
def _(t):
    return lookups.count_in_box(t.security_checkpoints, "checkpoint_id", t.locations, 0.003)


@register(
    "f3_search",
    """select location_id, term from locations, (select 'utama' as term union all select 'setia al' union all select 'nation_1') q
 where contains(lower(coalesce(street, '')), term) or contains(lower(coalesce(neighborhood, '')), term) or contains(lower(coalesce(development, '')), term)""",
    "locations",
)
def _(t):
    return lookups.search(t.locations, ["Utama", "setia al", "NATION_1", "ab"]).select("location_id", "term")


@register("f4_pattern_matches", "select location_id, street from locations where street ilike '%nusantara u%' and street <> ''", "locations")
def _(t):
    return lookups.pattern_matches(t.locations, "Nusantara U").select("location_id", "street")


@register(
    "f5_ieq",
    """select a.location_id, lower(a.street) = lower(b.street) as street, lower(a.development) = lower(b.development) as development, lower(a.neighborhood) = lower(b.neighborhood) as neighborhood
 from locations a join locations b on b.location_id = a.location_id + 1""",
    "locations",
)
def _(t):
    names = ["street", "development", "neighborhood"]
    b = t.locations.select((F.col("location_id") - 1).alias("location_id"), *[F.col(c).alias(f"b_{c}") for c in names])
    return t.locations.join(b, "location_id").select("location_id", *[lookups.ieq(c, f"b_{c}").alias(c) for c in names])


@register(
    "f6_destinations",
    "select preset_id, location_id, 'destination' as role from preset_locations where not coalesce(is_warehouse, false) union all select preset_id, location_id, 'warehouse' from preset_locations where is_warehouse",
    "preset_locations",
)
def _(t):
    pl = t.preset_locations
    return lookups.destinations(pl).select("preset_id", "location_id", F.lit("destination").alias("role")).unionByName(
        lookups.warehouses(pl).select("preset_id", "location_id", F.lit("warehouse").alias("role"))
    )


@register(
    "f7_others",
    "select location_id, neighborhood from locations where neighborhood <> '' and location_id not in (select location_id from preset_locations where is_warehouse)",
    "locations preset_locations",
)
def _(t):
    return lookups.others(t.locations, "location_id", lookups.warehouses(t.preset_locations), "neighborhood").select("location_id", "neighborhood")


@register(
    "f8_clustered_neighbours",
    """select a.location_id, count(*) as n_neighbours from locations a join locations b on b.lat between a.lat - 2e-3 and a.lat + 2e-3 and b.lon between a.lon - 2e-3 and a.lon + 2e-3
 and a.location_id <> b.location_id join location_clusters c on c.location_id = b.location_id group by 1""",
    "locations location_clusters",
)
def _(t):
    return lookups.neighbour_counts(t.locations, t.location_clusters)


@register(
    "f9_at_warehouse",
    """select preset_id, location_id, coalesce(abs(lat - w_lat) < 0.0001 and abs(lon - w_lon) < 0.0001, false) as at_warehouse from (
 select *, max(case when is_warehouse then lat end) over (partition by preset_id) as w_lat, max(case when is_warehouse then lon end) over (partition by preset_id) as w_lon
 from preset_locations join locations using (location_id)) where not is_warehouse""",
    "locations preset_locations",
)
def _(t):
    return lookups.at_warehouse(t.preset_locations, t.locations)


@register(
    "f10_with_defaults",
    """select location_id, coalesce(street, '') as street, coalesce(neighborhood, '') as neighborhood, coalesce(development, '') as development, coalesce(city, '') as city,
 coalesce(name, 'Cluster ' || coalesce(cast(cluster_id as varchar), 'unknown')) as cluster_name, round(coalesce(centroid_lat, 0), 6) as centroid_lat, round(coalesce(centroid_lon, 0), 6) as centroid_lon
 from locations left join location_clusters using (location_id) left join clusters using (cluster_id)""",
    "locations location_clusters clusters",
)
def _(t):
    rows = lookups.with_defaults(t.locations, t.location_clusters, t.clusters)
    return rows.withColumns({c: F.round(c, 6) for c in ("centroid_lat", "centroid_lon")})


@register(
    "f11_checkpoint_view",
    "select checkpoint_id as id, round(lat, 6) as lat, round(lon, 6) as lon, from_road_type as from_type, to_road_type as to_type, confidence from security_checkpoints",
    "security_checkpoints",
)
def _(t):
    return lookups.checkpoint_view(t.security_checkpoints).withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


@register(
    "f12_address_line",
    "select location_id, regexp_replace(concat(coalesce(neighborhood, ''), ', ', coalesce(postcode, ''), ' ', coalesce(development, '')), '^[, ]+|[, ]+$', '', 'g') as address from locations",
    "locations",
)
def _(t):
    return t.locations.select("location_id", geo.address_line("neighborhood", "postcode", "development").alias("address"))


_RAW = "case when c_acctbal < 0 then 'n/a' when c_mktsegment = 'MACHINERY' then null else cast(c_custkey as {}) end as lat, '101.5' as lon"


@register(
    "f13_split_valid",
    f"select c_custkey, case when try_cast(lat as double) is not null then 'valid' else 'invalid' end as state from (select c_custkey, {_RAW.format('varchar')} from customer)",
)
def _(t):
    raw = t.customer.select("c_custkey", *[F.expr(e) for e in _RAW.format("string").replace(", '101.5'", "| '101.5'").split("| ")])
    valid, invalid = lookups.split_valid(raw)
    return valid.select("c_custkey", F.lit("valid").alias("state")).unionByName(invalid.select("c_custkey", F.lit("invalid").alias("state")))


@register(
    "f14_checkpoints_for",
    "select checkpoint_id, cluster_id from security_checkpoints where cluster_id in (select cluster_id from location_clusters)",
    "security_checkpoints location_clusters",
)
def _(t):
    return lookups.checkpoints_for(t.security_checkpoints, t.location_clusters).select("checkpoint_id", "cluster_id")
