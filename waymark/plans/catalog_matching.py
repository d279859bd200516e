"""Registered queries of location clustering (C) and of the street comparison join (J17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import lookups, matching
from waymark.plans import duck
from waymark.plans.catalog_functions import _keys
from waymark.plans.catalog_reports import AREAS, SECTIONS
from waymark.plans.registry import register

_KEYS = f"keys as ({_keys('locations')})"
_DEPOTS = "depots as (select distinct location_id from preset_locations where is_warehouse)"
_ASSIGNED = f"""exact as (select lower(street) as street_key, arg_min(cluster_id, location_id) as exact_id from locations join location_clusters using (location_id) where street <> '' group by 1),
 assigned as (select l.location_id, l.lat, l.lon, l.street, coalesce(k.stem, k.normal) as stem, case when c.cluster_id is not null then 'linked' when trim(l.street) = '' or d.location_id is not null then 'skipped'
  when exact_id is not null then 'exact' when p.cluster_id is not null then 'stem' else 'new' end as level, coalesce(c.cluster_id, case when d.location_id is null then coalesce(exact_id, p.cluster_id) end) as cluster_id
 from locations l join keys k using (location_id) left join location_clusters c using (location_id) left join depots d using (location_id)
 left join exact on street_key = lower(l.street) left join street_patterns p on p.stem_pattern = k.stem)"""
_VIEWS = "locations location_clusters preset_locations"


def depots(t):
    return t.preset_locations.where("is_warehouse").select("location_id").distinct()


def assigned(t):
    patterns = lookups.street_patterns(t.locations, t.location_clusters)
    return matching.assign_clusters(t.locations, t.location_clusters, t.clusters, patterns, depots(t))


@register(
    "c1_assign_clusters",
    "select location_id, level, stem, cluster_id from assigned",
    _VIEWS,
    f"{_KEYS}, {_DEPOTS}, {duck.street_patterns()}, {_ASSIGNED}",
)
def _(t):
    known = F.when(F.col("level") != "new", F.col("cluster_id"))
    return assigned(t).select("location_id", "level", "stem", known.alias("cluster_id"))


_NAME = duck.title("case when section <> '' then concat(case when development <> '' then development || ' ' else '' end, section, '/', regexp_replace(subsection, '([0-9]+)[a-zA-Z]$', '\\1')) else " + duck.stem("normal") + " end")
_FIRSTS = f"""(select stem, count(*) as n_members, round(arg_min(lat, location_id), 6) as centroid_lat, {duck.norm('arg_min(street, location_id)')} as normal
 from assigned where level = 'new' group by 1)"""


@register(
    "c2_new_clusters",
    f"select stem as stem_pattern, n_members, centroid_lat, {_NAME} as name from {duck.parts('normal', _FIRSTS)}",
    _VIEWS,
    f"{_KEYS}, {_DEPOTS}, {duck.street_patterns()}, {_ASSIGNED}",
)
def _(t):
    rows = matching.new_clusters(assigned(t))
    return rows.select("stem_pattern", "n_members", F.round("centroid_lat", 6).alias("centroid_lat"), "name")


_LEVEL = """case when a.normal = b.normal then 'exact' when a.stem = b.stem then 'stem' when a.development <> b.development then null
 when a.development = b.development and a.section = b.section then 'development' when a.section = b.section and a.number = b.number then 'section' end"""
_FREE = f"""free as (select * from keys where location_id not in (select location_id from location_clusters) and street <> ''),
 known as (select * from keys join location_clusters using (location_id) where street <> ''),
 pairs as (select a.location_id, b.location_id as other_id, b.cluster_id, lower(a.street) = lower(b.street) as same_street, coalesce(a.stem = b.stem, false) as same_stem, {_LEVEL} as level from free a cross join known b)"""


@register(
    "j17_component_matches",
    """select f.location_id, count(other_id) as component_matches, min(other_id) as first_match from free f left join pairs p on p.location_id = f.location_id and level is not null group by 1""",
    "locations location_clusters",
    f"{_KEYS}, {_FREE}",
)
def _(t):
    return matching.component_matches(t.locations, t.location_clusters).select("location_id", "component_matches", "first_match")


@register(
    "c3_match_diagnostics",
    """select f.location_id, count(*) filter (same_street) as exact_matches, count(*) filter (same_stem) as stem_matches, count(*) filter (level is not null) as component_matches,
 coalesce(any_value(d.n), 0) as development_clusters, coalesce(any_value(n.n), 0) as neighborhood_clusters from free f left join pairs p using (location_id)
 join locations l using (location_id) left join (select lower(development) as k, count(distinct cluster_id) as n from locations join location_clusters using (location_id) where development <> '' group by 1) d on d.k = lower(l.development)
 left join (select lower(neighborhood) as k, count(distinct cluster_id) as n from locations join location_clusters using (location_id) where neighborhood <> '' group by 1) n on n.k = lower(l.neighborhood) group by 1""",
    "locations location_clusters",
    f"{_KEYS}, {_FREE}",
)
def _(t):
    return matching.match_diagnostics(t.locations, t.location_clusters, t.clusters)


def pickup_points(t):
    return t.dynamic_pairs.select("pair_id", F.col("pickup_lat").alias("lat"), F.col("pickup_lon").alias("lon"), F.col("pickup_street").alias("street"))


@register(
    "c4_assign_dynamic",
    f"""select pair_id, coalesce(stem_id, near_id) as cluster_id, case when stem_id is not null then 'stem' else 'centroid' end as via from (
 select pair_id, min(s.cluster_id) as stem_id from dynamic_pairs left join street_patterns s on s.stem_pattern = {duck.stem(duck.norm('pickup_street'))} group by 1) join (
 select pair_id, arg_min(cluster_id, (km, cluster_id)) as near_id from (select pair_id, cluster_id, {duck.hav('pickup_lat', 'pickup_lon', 'centroid_lat', 'centroid_lon')} as km from dynamic_pairs cross join clusters) group by 1) using (pair_id)""",
    "locations location_clusters clusters dynamic_pairs",
    duck.street_patterns(),
)
def _(t):
    patterns = lookups.street_patterns(t.locations, t.location_clusters)
    return matching.assign_dynamic(pickup_points(t), "pair_id", patterns, t.clusters)


@register(
    "c5_recluster",
    "select location_id, case when trim(street) = '' or d.location_id is not null then null else coalesce(stem, normal) end as stem from keys left join depots d using (location_id)",
    "locations preset_locations",
    f"{_KEYS}, {_DEPOTS}",
)
def _(t):
    rows = matching.recluster(t.locations, t.clusters, depots(t))
    return rows.select("location_id", F.when(F.col("level") == "new", F.col("stem")).alias("stem"))


@register(
    "c6_lookup_addresses",
    f"""select p.pair_id, n.location_id, n.zoom from dynamic_pairs p left join (select pair_id, location_id, case when km <= 0.05 then 18 when km <= 0.1 then 17 when km <= 0.2 then 16 when km <= 0.4 then 15 end as zoom from (
 select pair_id, arg_min(location_id, (km, location_id)) as location_id, min(km) as km from (select pair_id, location_id, {duck.hav('pickup_lat', 'pickup_lon', 'lat', 'lon')} as km
  from dynamic_pairs join locations on lat between pickup_lat - 1e-2 and pickup_lat + 1e-2 and lon between pickup_lon - 1e-2 and pickup_lon + 1e-2 where street <> '') group by 1) where km <= 0.4) n using (pair_id)""",
    "locations dynamic_pairs",
)
def _(t):
    rows = matching.lookup_addresses(pickup_points(t).drop("street"), "pair_id", t.locations, "location_id")
    return rows.select("pair_id", "location_id", "zoom")


@register(
    "c7_suggest_addresses",
    """select p.pair_id, section, subsection, coalesce(neighborhood, case when contains(h.name, '/') then array_to_string(string_split(split_part(h.name, '/', 1), ' ')[1:-2], ' ') else h.name end, '') as neighborhood
 from dynamic_pairs p left join sections using (pair_id) left join areas using (pair_id) left join (select pair_id, arg_min(name, (pow(centroid_lat - pickup_lat, 2) + pow(centroid_lon - pickup_lon, 2), cluster_id)) as name
 from dynamic_pairs join clusters on centroid_lat between pickup_lat - 5e-3 and pickup_lat + 5e-3 and centroid_lon between pickup_lon - 5e-3 and pickup_lon + 5e-3 group by 1) h using (pair_id)""",
    "locations dynamic_pairs clusters",
    f"sections as ({SECTIONS}), areas as ({AREAS})",
)
def _(t):
    return matching.suggest_addresses(pickup_points(t).drop("street"), "pair_id", t.locations, t.clusters).drop("country")
