"""Routing scenarios: preparing instances, solving them, inserting new pairs into planned routes, comparing runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.operators import lookups, ranks, tours
from waymark.session import cut_lean as cut, cut_lean_and_measure as cut_and_measure, release_unread, spread, tables_written

PAGE = 1000
# Fixed value: the longest route that a solver accepts.
ROUTE_CAP_KM = 100_000


# ---- instances -------------------------------------------------------------------------------------------------------


def prepare_instances(presets: DataFrame, pl: DataFrame, loc: DataFrame, lc: DataFrame, cp: DataFrame) -> dict[str, DataFrame]:
    """Routing instances of all presets.

    ``nodes``: instance_id, idx, kind, stop_id, lat, lon with the warehouse at 0 and the checkpoints of the required
    clusters, merged by six-digit coordinate, from 1; ``served``: which required cluster each checkpoint serves;
    ``errors``: presets without warehouse.
    """
    since = tables_written()
    depot = cut(lookups.preset_warehouses(pl, loc).groupBy("preset_id").agg(F.min_by(F.struct("location_id", "lat", "lon"), "location_id").alias("w")))
    depots = depot.select(F.col("preset_id").alias("instance_id"), "w.location_id", "w.lat", "w.lon")
    required = cut(lookups.required_clusters(pl, lc).join(depot, "preset_id", "left_semi"))
    keyed = cut(cp.select("cluster_id", "checkpoint_id", "lat", "lon", geo.coord_key("lat", "lon").alias("coord_key")))
    # a number stands for the text of a coordinate, which every preset would carry through the shuffle
    spots = cut(keyed.where("coord_key is not null").select("coord_key").distinct().withColumn("spot", F.monotonically_increasing_id()))
    numbered = ranks.position(keyed.join(spots, "coord_key", "left").drop("coord_key"), ["cluster_id"], "checkpoint_id", "at")
    placed = cut(_merged_stops(required, numbered))
    release_unread(since, depots, required, placed)
    served = placed.where("keyed").select("instance_id", "stop_id", "lat", "lon", F.explode("clusters").alias("cluster_id"))
    nodes = depots.select(
        "instance_id", F.lit(0).cast("bigint").alias("idx"), F.lit("warehouse").alias("kind"), F.col("location_id").alias("stop_id"), "lat", "lon"
    ).unionByName(placed.select("instance_id", "idx", F.lit("checkpoint").alias("kind"), "stop_id", "lat", "lon"))
    errors = presets.join(depot, "preset_id", "left_anti").select(F.col("preset_id").alias("instance_id"), F.lit("Warehouse not found").alias("error"))
    return {"depots": depots, "nodes": nodes, "served": served, "required": required, "errors": errors}


def _merged_stops(required: DataFrame, numbered: DataFrame) -> DataFrame:
    """The checkpoints of the required clusters of each preset, one per spot, numbered by id: instance_id, idx, stop_id, lat, lon, clusters, keyed.

    ``numbered``: cluster_id, checkpoint_id, lat, lon, spot, at (place in the cluster). The checkpoints of a cluster go to its presets in pages,
    one cluster after the other, which packs well. The rows of a preset come together before they are merged, so one shuffle carries them and
    the merged stops are numbered where they are; presets of more than ``ranks.LARGE`` rows are spread by spot too.
    """
    item = ["spot", "checkpoint_id", "lat", "lon"]
    pages = cut(numbered.groupBy("cluster_id", F.floor((F.col("at") - 1) / PAGE).alias("page")).agg(F.sort_array(F.collect_list(F.struct("at", *item))).alias("s"))).hint("merge")
    own = pages.groupBy("cluster_id").agg(F.sum(F.size("s")).alias("n"))
    seen = Observation()
    sizes = required.join(own, "cluster_id").groupBy("preset_id").agg(F.sum("n").alias("n")).observe(seen, F.sum("n").alias("rows"), F.count_if(F.col("n") > ranks.LARGE).alias("large"))
    large = cut(sizes.where(F.col("n") > ranks.LARGE).select("preset_id"))
    found = required.join(pages, "cluster_id").select("preset_id", "cluster_id", *[F.col(f"s.{c}").alias(c) for c in item])
    place = F.min_by(F.struct("checkpoint_id", "lat", "lon"), "checkpoint_id")

    def merged(packed: DataFrame) -> DataFrame:
        rows = packed.select("preset_id", "cluster_id", F.explode(F.arrays_zip(*item)).alias("c")).select("preset_id", "cluster_id", "c.*")
        stops = rows.groupBy("preset_id", "spot").agg(place.alias("c"), F.collect_set("cluster_id").alias("clusters"))
        return stops.select(F.col("preset_id").alias("instance_id"), F.col("c.checkpoint_id").alias("stop_id"), "c.lat", "c.lon", "clusters", F.col("spot").isNotNull().alias("keyed"))

    few = found.join(large, "preset_id", "left_anti") if seen.get["large"] else found
    number = F.row_number().over(Window.partitionBy("instance_id").orderBy("stop_id")).cast("bigint")
    stops = merged(spread(few, "preset_id", rows=seen.get["rows"] or 0)).withColumn("idx", number)
    if not seen.get["large"]:
        return stops
    return stops.unionByName(ranks.position(merged(found.join(large, "preset_id", "left_semi")), ["instance_id"], "stop_id", "idx"))


def static_instances(pl: DataFrame, loc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(depots, stops) of all presets for delivery tours over their destinations; written, as tours read them several times."""
    place = loc.select("location_id", "lat", "lon")
    depots = cut(lookups.preset_warehouses(pl, place).select(F.col("preset_id").alias("instance_id"), "lat", "lon"))
    stops = lookups.destinations(pl).join(place, "location_id").select(
        F.col("preset_id").alias("instance_id"), F.col("location_id").alias("stop_id"), "lat", "lon"
    )
    return depots, cut(stops.join(depots.select("instance_id"), "instance_id", "left_semi"))


# ---- solving ---------------------------------------------------------------------------------------------------------


def solve_static(depots: DataFrame, stops: DataFrame, vehicles: str | None = None, first: DataFrame | None = None) -> DataFrame:
    """Tours by each instance's ``algorithm``: nearest_neighbor, or two_opt which also stands in for unknown names.

    ``first``: the closed paths of the nearest-neighbour tours, from a caller that has written them. Returns paths with the depot at both ends: instance_id, route_id, seq, node_id, lat, lon, algorithm_used.
    """
    chosen = F.when(F.col("algorithm") == "nearest_neighbor", F.col("algorithm")).otherwise("two_opt")
    named = depots.select("instance_id", chosen.alias("algorithm_used"))
    if first is None:
        first = cut(tours.closed_paths(depots, stops, tours.nearest_tours(depots, stops, vehicles)))
    tagged = first.join(named, "instance_id")
    since = tables_written()
    improved = cut(tours.two_opt(tagged.where("algorithm_used = 'two_opt'")))
    release_unread(since, improved)
    owner = tagged.where("algorithm_used = 'two_opt'").select("route_id", "instance_id", "algorithm_used").distinct()
    return tagged.where("algorithm_used <> 'two_opt'").unionByName(improved.join(owner, "route_id"))


def solve_checkpoints(depots: DataFrame, served: DataFrame, vehicles: str | None = None, first: DataFrame | None = None) -> DataFrame:
    """Covering tours by each instance's ``algorithm``: the covering heuristic, improved by 2-opt for two_opt.

    ``first``: the closed paths of the covering tours, from a caller that has written them. Returns paths with the depot at both ends: instance_id, route_id, seq, node_id, lat, lon, algorithm_used.
    """
    chosen = F.when(F.col("algorithm") == "two_opt", F.col("algorithm")).otherwise("heuristic")
    if first is None:
        stops = served.select("instance_id", "stop_id", "lat", "lon").distinct()
        first = cut(tours.closed_paths(depots, stops, tours.covering_tours(depots, served, vehicles)))
    tagged = first.join(depots.select("instance_id", chosen.alias("algorithm_used")), "instance_id")
    since = tables_written()
    improved = cut(tours.two_opt(tagged.where("algorithm_used = 'two_opt'")))
    release_unread(since, improved)
    owner = tagged.where("algorithm_used = 'two_opt'").select("route_id", "instance_id", "algorithm_used").distinct()
    return tagged.where("algorithm_used <> 'two_opt'").unionByName(improved.join(owner, "route_id"))


def clusters_served(stops: DataFrame, served: DataFrame, out: str) -> DataFrame:
    """``stops`` (instance_id, stop_id, ...) with the number of clusters that each serves, null if ``served`` lacks it.

    Both go through one shuffle by instance and page of ids: the stops of an instance stay beside each other, which packs well, and no
    task holds a whole instance.
    """
    named = served.select("instance_id", "stop_id", F.col("cluster_id").alias("_cluster"), F.lit(True).alias("_serves"))
    both = stops.withColumn("_serves", F.lit(False)).unionByName(named.where("instance_id is not null and stop_id is not null"), allowMissingColumns=True)
    same = Window.partitionBy("instance_id", "_page", "stop_id")
    n = F.when(F.bool_or("_serves").over(same), F.size(F.collect_set("_cluster").over(same)).cast("bigint"))
    counted = spread(both.withColumn("_page", F.floor(F.col("stop_id") / PAGE)), "instance_id", "_page").withColumn(out, n)
    return counted.where("not _serves").drop("_serves", "_cluster", "_page")


def solution_rows(tour: DataFrame, nodes: DataFrame, served: DataFrame, place: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Path rows of solved instances: the depot at both ends, and the number of required clusters each stop serves.

    ``place``: what else of the nodes the rows tell; a caller that leaves it out spares its way through the shuffles.
    """
    tour = cut(tour.select("instance_id", "vehicle", "seq", "stop_id"))
    kind = nodes.select("instance_id", "stop_id", "idx", *place, "kind")
    middle = clusters_served(cut(tour.join(kind.where("kind = 'checkpoint'"), ["instance_id", "stop_id"])), served, "clusters_served")
    ends = tour.groupBy("instance_id", "vehicle").agg((F.max("seq") + 1).alias("end")).join(kind.where("idx = 0"), "instance_id")
    columns = ["instance_id", "vehicle", "seq", "idx", "kind", *place, "clusters_served"]
    outer = ends.withColumn("seq", F.explode(F.array(F.lit(0).cast("bigint"), F.col("end")))).withColumn("clusters_served", F.lit(0).cast("bigint"))
    return middle.select(columns).unionByName(outer.select(columns)).withColumn("is_dynamic", F.lit(False))


def solution_records(rows: DataFrame) -> DataFrame:
    """Nested records per vehicle, in pages of 1,000 path points."""
    point = F.struct("seq", "lat", "lon", "kind", "idx", "is_dynamic", "clusters_served")
    page = F.floor(F.col("seq") / PAGE).alias("page")
    return rows.groupBy("instance_id", "vehicle", page).agg(F.sort_array(F.collect_list(point)).alias("path"))


def missing_clusters(required: DataFrame, tour: DataFrame, served: DataFrame) -> DataFrame:
    """Required clusters that no visited checkpoint serves."""
    visited = cut(tour.select("instance_id", "stop_id").distinct())
    covered = cut(served.join(visited, ["instance_id", "stop_id"], "left_semi").select("instance_id", "cluster_id"))
    wanted = required.select(F.col("preset_id").alias("instance_id"), "cluster_id")
    return wanted.join(covered, ["instance_id", "cluster_id"], "left_anti")


# ---- inserting a pair into a planned route -----------------------------------------------------------------------------


def split_routes(routes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stops with a flag ``done``, error rows): routes cut at the insertion point of each request.

    ``routes``: route_id, seq from 1, node_id, lat, lon; ``requests``: route_id, pair_id, insertion_point. The first
    ``insertion_point`` stops are done; a point behind the last stop is an error.
    """
    lengths = routes.groupBy("route_id").agg(F.max("seq").alias("n"))
    known = requests.join(lengths, "route_id", "left")
    bad = known.where(F.col("n").isNull() | (F.col("insertion_point") > F.col("n")) | (F.col("insertion_point") < 0))
    good = known.where("insertion_point between 0 and n")
    errors = bad.select("route_id", "pair_id", F.lit("Insertion point is out of bounds").alias("error"))
    split = routes.join(good.select("route_id", "pair_id", "insertion_point"), "route_id")
    return split.withColumn("done", F.col("seq") <= F.col("insertion_point")), errors


def resolve_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with the index of both checkpoints by six-digit coordinate, and an error where one is not a node."""
    known = nodes.select("instance_id", geo.coord_key("lat", "lon").alias("k"), "idx").groupBy("instance_id", "k").agg(F.min("idx").alias("idx"))

    def end(name: str) -> DataFrame:
        return known.withColumnsRenamed({"k": f"{name}_key", "idx": f"{name}_idx"})

    keyed = pairs.withColumns({f"{n}_key": geo.coord_key(f"{n}_lat", f"{n}_lon") for n in ("pickup", "dropoff")})
    joined = keyed.join(end("pickup"), ["instance_id", "pickup_key"], "left").join(end("dropoff"), ["instance_id", "dropoff_key"], "left")
    lost = F.col("pickup_idx").isNull() | F.col("dropoff_idx").isNull()
    return joined.withColumn("error", F.when(lost, "Checkpoint is not a node of the instance"))


def _km(a: str, b: str) -> Column:
    return geo.arc_km(f"{a}_lat", f"{a}_lon", f"{b}_lat", f"{b}_lon")


def remaining_legs(routes: DataFrame, depots: DataFrame, requests: DataFrame) -> DataFrame:
    """The legs (a, b) after the insertion point of each request, the way back to the depot included.

    ``slot`` 0 follows the current place (the depot before the first stop), the last one precedes the depot.
    """
    split, _ = split_routes(routes, requests)
    here = split.select("route_id", "pair_id", "insertion_point", "seq", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon")).where("seq >= insertion_point")
    home = depots.select("route_id", F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"))
    start = requests.where("insertion_point = 0").join(routes.select("route_id").distinct(), "route_id", "left_semi").join(home, "route_id").select(
        "route_id", "pair_id", "insertion_point", F.lit(0).cast("bigint").alias("seq"), F.col("h_lat").alias("a_lat"), F.col("h_lon").alias("a_lon")
    )
    following = routes.select("route_id", (F.col("seq") - 1).alias("seq"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
    legs = here.unionByName(start).join(following, ["route_id", "seq"], "left").join(home, "route_id")
    return legs.select(
        "route_id", "pair_id", "insertion_point", (F.col("seq") - F.col("insertion_point")).alias("slot"), "a_lat", "a_lon",
        F.coalesce("n_lat", "h_lat").alias("b_lat"), F.coalesce("n_lon", "h_lon").alias("b_lon"), F.col("n_lat").isNull().alias("last"),
    )


def insertion_slots(routes: DataFrame, depots: DataFrame, requests: DataFrame) -> DataFrame:
    """The gaps after the insertion point into which a pickup or drop-off can go, with their extra kilometres.

    One row per remaining leg. ``requests`` also carries pickup and drop-off coordinates.
    """
    ends = requests.select(
        "route_id", "pair_id", *[F.col(f"{n}_{c}").alias(f"{e}_{c}") for n, e in (("pickup", "p"), ("dropoff", "q")) for c in ("lat", "lon")]
    )
    gaps = remaining_legs(routes, depots, requests).join(ends, ["route_id", "pair_id"])
    old = _km("a", "b")
    return gaps.select(
        "route_id", "pair_id", "insertion_point", "slot",
        (_km("a", "p") + _km("p", "b") - old).alias("add_pickup"), (_km("a", "q") + _km("q", "b") - old).alias("add_dropoff"),
        (_km("a", "p") + _km("p", "q") + _km("q", "b") - old).alias("add_both"), old.alias("leg_km"), "last",
    )


def best_insertion(slots: DataFrame) -> DataFrame:
    """Per route and pair the cheapest slots with the pickup before the drop-off: pickup_slot, dropoff_slot, added_km.

    For every drop-off slot the best earlier pickup slot is a running minimum, so no pairs of slots are built. Ties
    go to the earlier slots.
    """
    before = ranks.running_min(slots, ["route_id", "pair_id"], "slot", F.struct("add_pickup", F.col("slot").alias("pickup_slot")), "best_pickup")
    apart = F.when(
        F.col("best_pickup").isNotNull(),
        F.struct((F.col("best_pickup.add_pickup") + F.col("add_dropoff")).alias("km"), F.col("best_pickup.pickup_slot").alias("p"), F.col("slot").alias("q")),
    )
    together = F.struct(F.col("add_both").alias("km"), F.col("slot").alias("p"), F.col("slot").alias("q"))
    best = before.groupBy("route_id", "pair_id", "insertion_point").agg(F.min(F.least(together, apart)).alias("b"))
    return best.select("route_id", "pair_id", "insertion_point", F.col("b.p").alias("pickup_slot"), F.col("b.q").alias("dropoff_slot"), F.col("b.km").alias("added_km"))


def appended(slots: DataFrame) -> DataFrame:
    """Extra kilometres of going to pickup and drop-off after all remaining stops."""
    return slots.where("last").select("route_id", "pair_id", F.col("add_both").alias("appended_km"))


def closed_route_lengths(routes: DataFrame, depots: DataFrame) -> DataFrame:
    """(route_id, km) of planned routes with the legs from and to the depot."""
    home = depots.select("route_id", F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon"))
    inner = ranks.consecutive(routes, ["route_id"], "seq", "lat", "lon").withColumn("km", geo.arc_km("lat", "lon", "next_lat", "next_lon")).select("route_id", "km")
    last = routes.groupBy("route_id").agg(F.max("seq").alias("n"))
    outer = routes.join(last, "route_id").where("seq = 1 or seq = n").join(home, "route_id")
    sides = F.when(F.col("n") == 1, 2).otherwise(1)
    legs = inner.unionByName(outer.select("route_id", (geo.arc_km("lat", "lon", "d_lat", "d_lon") * sides).alias("km")))
    return legs.groupBy("route_id").agg(F.sum("km").alias("km"))


def insert_pairs(routes: DataFrame, depots: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rebuilt routes, report): the pairs of each route placed one after the other by pair_id, each at its cheapest place.

    An insertion point counts stops of the route as given: what was inserted before does not shift it. Every stop stays, in its
    order. The report has the length before a pair, with it (``km``, the inserted route A) and with the pair appended at the end (B).
    Appending is one of the places that are compared, so A is never longer than B and is always taken. Requests with a
    point outside of their route are left out; ``split_routes`` reports them. One round per pair of the route that has most.
    """
    placed, report = place_pairs(routes, depots, requests)
    return placed.drop("was", "pair_id"), report


def place_pairs(routes: DataFrame, depots: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``insert_pairs``; the routes also tell each stop's former place (``was``) and each new stop's ``pair_id``."""
    since = tables_written()
    order = Window.partitionBy("route_id").orderBy("pair_id")
    _, wrong = split_routes(routes, requests)
    turns, seen = cut_and_measure(requests.join(wrong, ["route_id", "pair_id"], "left_anti").withColumn("turn", F.row_number().over(order)), n=F.max("turn"))
    none = F.lit(None).cast("bigint")
    current = routes.select("route_id", "seq", "lat", "lon", F.lit("stop").alias("type"), F.lit(False).alias("is_dynamic"), F.col("seq").alias("was"), none.alias("pair_id"))
    reports: list[DataFrame] = []
    for turn in range(1, (seen["n"] or 0) + 1):
        here = turns.where(F.col("turn") == turn).withColumn("was", F.col("insertion_point"))
        at = current.where("was is not null").select("route_id", "was", F.col("seq").alias("place"))
        placed = here.join(at, ["route_id", "was"], "left").withColumn("insertion_point", F.coalesce("place", F.lit(0).cast("bigint"))).drop("place", "turn")
        lengths = cut(closed_route_lengths(current, depots))
        slots = cut(insertion_slots(current.drop("pair_id"), depots, placed.drop("was")).drop("leg_km"))
        plan = cut(best_insertion(slots).join(appended(slots), ["route_id", "pair_id"]))
        release_unread(since, turns, current, lengths, plan, *reports)
        best = cut(plan.join(lengths, "route_id").join(placed.drop("insertion_point"), ["route_id", "pair_id"]))
        moved = current.join(best.select("route_id", "insertion_point", F.col("pickup_slot").alias("p"), F.col("dropoff_slot").alias("q")), "route_id", "left")
        after = [F.coalesce((F.col("seq") > F.col("insertion_point") + F.col(c)).cast("bigint"), F.lit(0)) for c in ("p", "q")]
        old = moved.withColumn("seq", F.col("seq") + after[0] + after[1]).select(current.columns)
        new = [
            best.select(
                "route_id", (F.col("insertion_point") + F.col(f"{name}_slot") + offset).alias("seq"), F.col(f"{name}_lat").alias("lat"), F.col(f"{name}_lon").alias("lon"),
                F.lit(name).alias("type"), F.lit(True).alias("is_dynamic"), none.alias("was"), F.col("pair_id").cast("bigint").alias("pair_id"),
            )
            for name, offset in (("pickup", 1), ("dropoff", 2))
        ]
        current = cut(old.unionByName(new[0]).unionByName(new[1]))
        reports.append(cut(best.select("route_id", "pair_id", F.col("was").alias("insertion_point"), "km", "added_km", "appended_km")))
        release_unread(since, turns, current, *reports)
    if reports:
        a = F.col("km") + F.col("added_km")
        told = reduce(DataFrame.unionByName, reports)
        report = told.select("route_id", "pair_id", "insertion_point", F.col("km").alias("before_km"), a.alias("strategy_a_km"), (F.col("km") + F.col("appended_km")).alias("strategy_b_km"), a.alias("km"))
        release_unread(since, current, report)
    else:
        empty = "insertion_point bigint, before_km double, strategy_a_km double, strategy_b_km double, km double"
        report = requests.select("route_id", "pair_id", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in empty.split(", ")]).where("false")
    return current, report


def best_reorder(routes: DataFrame, depots: DataFrame, requests: DataFrame, limit: int = 10) -> DataFrame:
    """Exact order of the remaining stops and the pair, pickup first: a row (instance_id, ids, km, error) for every request.

    ids are node ids, -1 the pickup and -2 the drop-off; km from the current place to the depot. Time and memory grow with 2^n:
    requests with more than ``limit`` stops left get an error that names the limit, those outside of their route an error too.
    """
    split, wrong = split_routes(routes, requests)
    instance = F.concat_ws(":", F.col("route_id").cast("string"), F.col("pair_id").cast("string")).alias("instance_id")
    sizes = split.groupBy("route_id", "pair_id").agg(F.count_if(~F.col("done")).alias("n"))
    packed = split.where("not done").join(sizes.where(F.col("n") <= limit), ["route_id", "pair_id"], "left_semi").groupBy("route_id", "pair_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "node_id", "lat", "lon"))).alias("r")
    )
    left = sizes.where(F.col("n") <= limit).join(packed, ["route_id", "pair_id"], "left")
    at = split.where("seq = insertion_point").select("route_id", "pair_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    home = depots.select("route_id", F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon"))
    joined = left.join(requests, ["route_id", "pair_id"]).join(home, "route_id").join(at, ["route_id", "pair_id"], "left")
    stops = lambda c, kind: F.coalesce(F.col(f"r.{c}"), F.array().cast(f"array<{kind}>"))
    instances = joined.select(
        instance, F.coalesce("c_lat", "e_lat").alias("s_lat"), F.coalesce("c_lon", "e_lon").alias("s_lon"), "e_lat", "e_lon",
        F.concat(stops("node_id", "bigint"), F.array(F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint"))).alias("ids"),
        F.concat(stops("lat", "double"), F.array("pickup_lat", "dropoff_lat")).alias("lat"), F.concat(stops("lon", "double"), F.array("pickup_lon", "dropoff_lon")).alias("lon"),
        F.col("n").cast("int").alias("pickup"), (F.col("n") + 1).cast("int").alias("dropoff"),
    )
    solved = tours.exact_orders(instances).withColumn("error", F.lit(None).cast("string"))
    none = [F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("double").alias("km")]
    large = sizes.where(F.col("n") > limit).select(instance, *none, F.format_string(f"%d stops left; the exact order takes at most {limit}", "n").alias("error"))
    return solved.unionByName(large).unionByName(wrong.select(instance, *none, "error"))


# ---- legs, audit, comparison -------------------------------------------------------------------------------------------


def needed_legs(routes: DataFrame) -> DataFrame:
    """The distinct legs that a set of routes needs, by key."""
    pairs = ranks.consecutive(routes, ["route_id"], "seq", "lat", "lon")
    keyed = pairs.withColumn("leg_key", geo.leg_key("lat", "lon", "next_lat", "next_lon"))
    return keyed.groupBy("leg_key").agg(F.min(F.struct("lat", "lon", "next_lat", "next_lon")).alias("l")).select("leg_key", "l.*")


def route_geometry(routes: DataFrame, legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, lengths): geometry of routes as rows (route_id, leg, pos, lat, lon) without repeated joints.

    ``legs``: leg_key, geometry (array of [lat, lon]), distance_km. A leg that is not known becomes a straight line with
    great-circle length.
    """
    pairs = ranks.consecutive(routes, ["route_id"], "seq", "lat", "lon")
    keyed = pairs.withColumn("leg_key", geo.leg_key("lat", "lon", "next_lat", "next_lon")).join(legs, "leg_key", "left")
    line = F.coalesce("geometry", F.array(F.array("lat", "lon"), F.array("next_lat", "next_lon")))
    points = keyed.select("route_id", F.col("seq").alias("leg"), F.posexplode(line).alias("pos", "p")).where("pos > 0 or leg = 1")
    km = F.coalesce("distance_km", geo.arc_km("lat", "lon", "next_lat", "next_lon"))
    lengths = keyed.groupBy("route_id").agg(F.sum(km).alias("km"), F.count_if(F.col("geometry").isNull()).alias("legs_missing"))
    return points.select("route_id", "leg", "pos", F.col("p")[0].alias("lat"), F.col("p")[1].alias("lon")), lengths


def audit_routes(routes: DataFrame, mandatory: DataFrame, cap_km: float = ROUTE_CAP_KM, depots: DataFrame | None = None) -> DataFrame:
    """Violations (run_id, route_id, pair_id, node_id, rule) of planned routes.

    ``routes``: run_id, route_id, seq, node_id, pair_id, type, lat, lon; ``mandatory``: run_id, node_id; ``depots``: route_id, lat, lon.
    Rules: within a run the pickup of a pair precedes its drop-off on the same route (precedence), every pickup has a
    drop-off (unfinished), every mandatory node is visited (missing), no route is too long, with the legs from and to its depot where depots are given.
    """
    pick = routes.where("type = 'pickup'").select("run_id", "pair_id", F.col("route_id").alias("p_route"), F.col("seq").alias("p_seq"))
    dropped = routes.where("type = 'dropoff'")
    pair = F.col("pair_id").cast("bigint")
    none = F.lit(None).cast("bigint")
    wrong = dropped.join(pick, ["run_id", "pair_id"], "left").where("p_route is null or p_route <> route_id or p_seq >= seq").select("run_id", "route_id", pair.alias("pair_id"), none.alias("node_id"), F.lit("precedence").alias("rule"))
    open_ = pick.join(dropped, ["run_id", "pair_id"], "left_anti").select("run_id", F.col("p_route").alias("route_id"), pair.alias("pair_id"), none.alias("node_id"), F.lit("unfinished").alias("rule"))
    lost = mandatory.join(routes, ["run_id", "node_id"], "left_anti").select("run_id", none.alias("route_id"), none.alias("pair_id"), "node_id", F.lit("missing").alias("rule"))
    lengths = tours.path_lengths(routes) if depots is None else closed_route_lengths(routes, depots)
    owner = routes.groupBy("route_id").agg(F.min("run_id").alias("run_id"))
    long = lengths.where(F.col("km") > cap_km).join(owner, "route_id").select("run_id", "route_id", none.alias("pair_id"), none.alias("node_id"), F.lit("too long").alias("rule"))
    return wrong.unionByName(open_).unionByName(lost).unionByName(long)


def compare_algorithms(lengths: DataFrame, algorithms: list[str]) -> DataFrame:
    """Per instance the length by algorithm and the improvement of each over the first, in percent."""
    wide = lengths.groupBy("instance_id").agg(*[F.sum(F.when(F.col("algorithm") == a, F.col("km"))).alias(a) for a in algorithms])
    base = algorithms[0]
    gains = [((F.col(base) - F.col(a)) / F.nullif(F.col(base), F.lit(0.0)) * 100).alias(f"{a}_gain") for a in algorithms[1:]]
    return wide.select("*", *gains)
