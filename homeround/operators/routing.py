"""Routes: matrices, metrics, diagnostics, sequencing, snapshots, execution, history, sharing."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeround.functions.geo import haversine_m
from homeround.operators import tours
from homeround.storage import written

#: What to do about each diagnostic.
ACTIONS = {
    "INCOMPATIBLE_WINDOWS": ["widen window", "split route", "drop stop", "edit order"],
    "INSUFFICIENT_SHIFT": ["split route", "drop stop", "widen window"],
    "ISOLATED_STOP": ["widen window", "drop stop", "split route"],
}


def resolve_locations(stops: DataFrame, addresses: DataFrame) -> DataFrame:
    """The stop's own location, else the patient's active address; a route with any stop left out gets STOP_LOCATION_MISSING."""
    a = addresses.where("is_active").select("patient_id", F.col("longitude").alias("__x"), F.col("latitude").alias("__y"))
    rows = stops.join(a, "patient_id", "left").withColumns({"longitude": F.coalesce("longitude", "__x"), "latitude": F.coalesce("latitude", "__y")}).drop("__x", "__y")
    lost = F.max(F.col("longitude").isNull() | F.col("latitude").isNull()).over(Window.partitionBy("route_id"))
    return rows.withColumn("reason", F.when(lost, "STOP_LOCATION_MISSING"))


def geodesic_matrix(nodes: DataFrame, speed_kmh: float = 30.0) -> DataFrame:
    """All ordered pairs of a route's nodes in long form; distances are great circles, marked as fallback."""
    a = nodes.select("route_id", F.col("node").alias("i"), F.col("longitude").alias("ax"), F.col("latitude").alias("ay"))
    b = nodes.select("route_id", F.col("node").alias("j"), F.col("longitude").alias("bx"), F.col("latitude").alias("by"))
    far = haversine_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return a.join(b, "route_id").select("route_id", "i", "j", (far / (speed_kmh / 3.6)).alias("duration_s"), far.alias("distance_m"), F.lit(True).alias("fallback"))


def matrix_completeness(matrix: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per route: whether every one of N x N cells is there and sound, and the first bad cell."""
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) < 0)
    bad = odd("duration_s") | odd("distance_m")
    per = matrix.groupBy("route_id").agg(F.count("*").alias("cells"), F.count_if(bad).alias("bad"), F.min(F.when(bad, F.struct("i", "j"))).alias("first_bad"))
    return per.join(sizes, "route_id").withColumn("complete", (F.col("cells") == F.col("n") * F.col("n")) & (F.col("bad") == 0))


def matrix_hash(nodes: DataFrame, profile: str, version: str) -> DataFrame:
    """SHA-256 of profile, version and the ordered coordinates at five decimals."""
    shown = F.struct("node", F.format_string("%.5f,%.5f", "latitude", "longitude").alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda s: s["p"]), ";")
    return nodes.groupBy("route_id").agg(text.alias("p")).select("route_id", F.sha2(F.concat(F.lit(f"{profile}|{version}|"), "p"), 256).alias("matrix_hash"))


def stop_fingerprint(stops: DataFrame) -> DataFrame:
    """Hash of a route's stops whatever their order."""
    item = F.format_string("%d:%.5f,%.5f:%d", "patient_id", "latitude", "longitude", "service_minutes")
    return stops.groupBy("route_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), ";"), 256).alias("fingerprint"))


def arcs_of_order(order: DataFrame) -> DataFrame:
    """Consecutive (i, j) of a visiting order, or of one order a variant if there is such a column."""
    by = [c for c in ("route_id", "variant") if c in order.columns]
    w = Window.partitionBy(*by).orderBy("position")
    return order.select(*by, "position", F.col("node").alias("i"), F.lead("node").over(w).alias("j")).where("j is not null")


def _measured(arcs: DataFrame, matrix: DataFrame, per_km: float, per_hour: float) -> DataFrame:
    """Arcs (route_id, i, j, others) with the sums of their cells and how many cells they have.

    Arcs and cells are stacked, not joined: where both are dealt by route they meet without a shuffle.
    """
    key = ["route_id", "i", "j"]
    values = {"duration_s": F.col("duration_s"), "distance_m": F.col("distance_m"), "cost": arc_cost(F.col("distance_m"), F.col("duration_s"), F.lit(per_km), F.lit(per_hour))}
    cells = matrix.select(*key, *[v.cast("double").alias(c) for c, v in values.items()], F.lit(1).alias("__cell")).where("i is not null and j is not null and route_id is not null")
    w = Window.partitionBy(*key)
    both = arcs.unionByName(cells, allowMissingColumns=True)
    return both.withColumns({c: F.sum(c).over(w) for c in values} | {"__cells": F.count("__cell").over(w)}).where("__cell is null").drop("__cell")


def arc_cost(distance_m: Column, duration_s: Column, per_km: Column, per_hour: Column) -> Column:
    return distance_m / 1000 * per_km + duration_s / 3600 * per_hour


def route_totals(order: DataFrame, matrix: DataFrame, stops: DataFrame, per_km: float = 0.3, per_hour: float = 12.0) -> DataFrame:
    """Seconds, metres and cost along an order, half-even, and seconds of service; one row a variant if the order has such a column."""
    by = [c for c in ("route_id", "variant") if c in order.columns]
    arcs = _measured(arcs_of_order(order).select(*by, "i", "j"), matrix, per_km, per_hour).where("__cells > 0")
    sums = arcs.groupBy(*by).agg(
        F.bround(F.sum("duration_s")).cast("long").alias("travel_seconds"), F.bround(F.sum("distance_m")).cast("long").alias("distance_m"), F.bround(F.sum("cost"), 4).alias("cost")
    )
    service = stops.groupBy("route_id").agg((F.sum("service_minutes") * 60).alias("service_seconds"))
    return sums.join(service, "route_id")


def tour_cost(order: DataFrame, matrix: DataFrame, per_km: float = 0.3, per_hour: float = 12.0) -> DataFrame:
    """Cost of each route's closed tour: the arcs of the order and the one back to its first node; 0 for a single node."""
    w = Window.partitionBy("route_id").orderBy("position")
    start = F.first("node").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    arcs = order.select("route_id", F.col("node").alias("i"), F.coalesce(F.lead("node").over(w), start).alias("j"))
    return _measured(arcs, matrix, per_km, per_hour).groupBy("route_id").agg(F.bround(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"))


def original_order(optimized: DataFrame, stops: DataFrame) -> DataFrame:
    """Patients in the order before sequencing, from (route_id, nodes) of the tour and its stops in visiting order; empty where their numbers differ.

    The stop at place p of the tour is the tour's p-th node; nodes count stops as they were before.
    """
    now = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "patient_id"))), lambda s: s["patient_id"])
    both = stops.groupBy("route_id").agg(now.alias("now")).join(optimized.select("route_id", "nodes"), "route_id")
    back = F.transform(F.array_sort(F.zip_with("nodes", "now", lambda n, p: F.struct(n.alias("node"), p.alias("patient_id")))), lambda s: s["patient_id"])
    return both.select("route_id", F.when(F.size("nodes") == F.size("now"), back).otherwise(F.slice("now", 1, 0)).alias("patients"))


def savings(original: DataFrame, optimized: DataFrame) -> DataFrame:
    o = optimized.select("route_id", F.col("travel_seconds").alias("t"), F.col("distance_m").alias("d"), F.col("cost").alias("c"))
    both = original.join(o, "route_id")
    saved = F.col("travel_seconds") - F.col("t")
    return both.select(
        "route_id", (F.col("distance_m") - F.col("d")).alias("distance_saved"), saved.alias("seconds_saved"), F.bround(F.col("cost") - F.col("c"), 4).alias("cost_saved"),
        F.when(F.col("travel_seconds") == 0, 0.0).otherwise(F.bround(saved * 100.0 / F.col("travel_seconds"), 2)).alias("percent"),
    )


def actual_metrics(stops: DataFrame, planned: DataFrame) -> DataFrame:
    """From reports: travel is last less first visit less service of completed stops, never negative; cost in proportion to the plan."""
    seen = F.col("status").isin("completed", "failed") & F.col("completed_at").isNotNull()
    per = stops.groupBy("route_id").agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(seen).alias("visited"),
        F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("service_minutes") * 60)), F.lit(0)).alias("service_seconds"),
        (F.max(F.when(seen, F.unix_seconds(F.col("completed_at").cast("timestamp")))) - F.min(F.when(seen, F.unix_seconds(F.col("completed_at").cast("timestamp"))))).alias("elapsed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(seen, F.struct("completed_at", "sequence")))), lambda s: s["sequence"]), ",").alias("visited_order"),
    )
    travel = F.when(F.col("visited") >= 2, F.greatest(F.col("elapsed") - F.col("service_seconds"), F.lit(0))).otherwise(0)
    per = per.withColumn("travel_seconds", travel).join(planned.select("route_id", F.col("travel_seconds").alias("plan_s"), F.col("cost").alias("plan_cost")), "route_id", "left")
    cost = F.when(F.col("plan_s") > 0, F.bround(F.col("plan_cost") * F.col("travel_seconds") / F.col("plan_s"), 4)).otherwise(0.0)
    return per.withColumns({"estimated_cost": cost, "distance_m": F.lit(0), "distance_source": F.lit("unavailable")}).drop("elapsed")


def deviation(actual: DataFrame, planned: DataFrame) -> DataFrame:
    p = planned.select("route_id", F.col("travel_seconds").alias("p"), F.col("distance_m").alias("pd"))
    both = actual.join(p, "route_id")
    delta = F.col("travel_seconds") - F.col("p")
    return both.select(
        "route_id", delta.alias("seconds_delta"), F.when(F.col("distance_source") == "unavailable", 0).otherwise(F.col("distance_m") - F.col("pd")).alias("distance_delta"),
        F.when(F.col("p") == 0, 0.0).otherwise(F.bround(delta * 100.0 / F.col("p"), 2)).alias("percent"),
    )


def route_status(stops: DataFrame) -> DataFrame:
    return stops.groupBy("route_id", "order_status").agg(F.count_if(F.col("status") == "pending").alias("pending")).select(
        "route_id", "pending", F.when(F.col("pending") == 0, "completed").when(F.col("order_status") == "P", "in_progress").otherwise(F.col("order_status")).alias("route_status")
    )


def double_bookings(stops: DataFrame) -> DataFrame:
    """Patients on another open route of the organization on the same day."""
    open_ = stops.where("order_status <> 'F'").select("organization_id", F.to_date("service_date").alias("day"), "patient_id", "route_id").distinct()
    other = open_.withColumnRenamed("route_id", "other_route")
    return open_.join(other, ["organization_id", "day", "patient_id"]).where("route_id <> other_route")


def _serve(t: Column, start: Column, end: Column, service: Column) -> tuple[Column, Column]:
    """(time after service, in window)."""
    begin = F.greatest(t, start)
    return begin + service, begin <= end


def stop_diagnostics(stops: DataFrame, depot: DataFrame | None = None) -> DataFrame:
    """ISOLATED_STOP if the window closes before arrival from the depot, INSUFFICIENT_SHIFT if the tour of it alone is too long.

    Without ``depot``, the stops themselves hold out_s and back_s, and nothing is joined.
    """
    rows = stops if depot is None else stops.join(depot, ["route_id", "node"])
    after, in_time = _serve(F.col("out_s"), F.col("start_s"), F.col("end_s"), F.col("service_s"))
    fits = (after <= F.col("shift_s")) & (after + F.col("back_s") <= F.col("shift_s"))
    code = F.when(~in_time, "ISOLATED_STOP").when(~F.coalesce(fits, F.lit(True)), "INSUFFICIENT_SHIFT")
    return rows.withColumn("code", code)


def pair_diagnostics(checked: DataFrame, matrix: DataFrame) -> DataFrame:
    """Pairs of stops, each feasible alone, that neither order can serve, with what to do."""
    good = checked.where("code is null").drop("code")
    cols = ["start_s", "end_s", "service_s", "out_s", "back_s"]
    a = good.select("route_id", "shift_s", F.col("node").alias("i"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = good.select("route_id", F.col("node").alias("j"), *[F.col(c).alias(f"b_{c}") for c in cols])
    m = matrix.select("route_id", "i", "j", F.col("duration_s").alias("ij"))
    back = matrix.select("route_id", F.col("i").alias("j"), F.col("j").alias("i"), F.col("duration_s").alias("ji"))
    rows = a.join(b, "route_id").where("i < j").join(m, ["route_id", "i", "j"]).join(back, ["route_id", "i", "j"])

    def chain(x: str, y: str, arc: str) -> tuple[Column, Column]:
        t1, ok1 = _serve(F.col(f"{x}_out_s"), F.col(f"{x}_start_s"), F.col(f"{x}_end_s"), F.col(f"{x}_service_s"))
        t2, ok2 = _serve(t1 + F.col(arc), F.col(f"{y}_start_s"), F.col(f"{y}_end_s"), F.col(f"{y}_service_s"))
        return ok1 & ok2, F.coalesce(t2 + F.col(f"{y}_back_s") <= F.col("shift_s"), F.lit(True))

    w1, s1 = chain("a", "b", "ij")
    w2, s2 = chain("b", "a", "ji")
    code = F.when((w1 & s1) | (w2 & s2), F.lit(None)).when(w1 | w2, "INSUFFICIENT_SHIFT").otherwise("INCOMPATIBLE_WINDOWS")
    actions = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit("; ".join(v)))])
    return rows.select("route_id", "i", "j", code.alias("code")).where("code is not null").withColumn("actions", actions[F.col("code")])


def proven_infeasible(checked: DataFrame, pairs: DataFrame, vehicles: int = 1) -> DataFrame:
    """Routes that the diagnostics prove to have no solution: a stop that fails alone, or with a single vehicle two that no order serves."""
    alone = checked.where(F.col("code").isin("ISOLATED_STOP", "INSUFFICIENT_SHIFT")).select("route_id")
    return alone.union(pairs.select("route_id")).distinct() if vehicles == 1 else alone.distinct()


#: Exchanges of four arcs that a tour tries after it has settled; stops up to which a timed route without tour is searched completely.
KICKS, EXACT = 1, 10


@functools.cache
def _orders(n: int) -> np.ndarray:
    """All orders of n nodes from node 0."""
    return np.array([(0, *rest) for rest in itertools.permutations(range(1, n))])


def _turn(cost: np.ndarray, order: np.ndarray) -> np.ndarray:
    """2-opt: a stretch is turned round wherever that helps, first come, until none does. Running sums of arcs both ways give each change in one step."""
    n = len(order)
    better = True
    while better:
        better = False
        for i in range(1, n - 1):
            j = i + 1
            while j < n:
                after = np.append(order[1:], order[0])
                ahead = np.cumsum(cost[order, after] - cost[after, order])  # ahead[k]: arcs up to k there, less those back
                ends = order[j:]
                change = cost[order[i - 1], ends] - cost[order[i - 1], order[i]] + cost[order[i], after[j:]] - cost[ends, after[j:]] - (ahead[j - 1 : n - 1] - ahead[i - 1])
                helps = np.flatnonzero(change < -1e-9)
                if not len(helps):
                    break
                j += int(helps[0])
                order = np.concatenate([order[:i], order[i : j + 1][::-1], order[j + 1 :]])
                better = True
                j += 1
    return order


def _shift(cost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, bool]:
    """Stretches of up to three nodes move to the best place, turned or not, while that helps."""
    n, moved = len(order), False
    for size in (1, 2, 3):
        i = 1
        while i + size <= n:
            part, rest = order[i : i + size], np.concatenate([order[:i], order[i + size :]])
            to = np.append(rest[1:], rest[0])
            gain = cost[order[i - 1], part[0]] + cost[part[-1], order[(i + size) % n]] - cost[order[i - 1], order[(i + size) % n]]
            inner = cost[part[:-1], part[1:]].sum() - cost[part[1:], part[:-1]].sum()
            straight = cost[rest, part[0]] + cost[part[-1], to] - cost[rest, to]
            turned = cost[rest, part[-1]] + cost[part[0], to] - cost[rest, to] - inner
            k = int(np.minimum(straight, turned).argmin())
            if min(straight[k], turned[k]) - gain < -1e-9:
                order = np.concatenate([rest[: k + 1], part if straight[k] <= turned[k] else part[::-1], rest[k + 1 :]])
                moved = True
            else:
                i += 1
    return order, moved


def _settle(cost: np.ndarray, order: np.ndarray) -> np.ndarray:
    moved = True
    while moved:
        order, moved = _shift(cost, _turn(cost, order))
    return order


def tour(cost: np.ndarray) -> list[int]:
    """Order of all nodes from 0 and back, of low cost: the best of all orders up to 7 nodes; beyond, nearest arcs, then stretches turned and
    moved until nothing helps, then a few exchanges of four arcs, each settled in the same way and kept if it is better.
    """
    n = len(cost)
    if n <= 2:
        return list(range(n))
    if n <= 7:
        every = _orders(n)
        return every[cost[every, np.roll(every, -1, axis=1)].sum(axis=1).argmin()].tolist()
    order, left = [0], np.ones(n, bool)
    left[0] = False
    while len(order) < n:
        order.append(int(np.where(left, cost[order[-1]], np.inf).argmin()))
        left[order[-1]] = False
    total = lambda o: cost[o, np.append(o[1:], o[0])].sum()
    best = _settle(cost, np.array(order))
    rng = np.random.default_rng(n)
    for _ in range(KICKS):
        a, b, c = np.sort(rng.choice(np.arange(1, n), 3, replace=False))
        new = _settle(cost, np.concatenate([best[:a], best[b:c], best[a:b], best[c:]]))
        if total(new) < total(best) - 1e-9:
            best = new
    return best.tolist()


#: Rows that a task gathers before it solves the routes in them, and the largest routes that are solved many at once.
GATHER, TOGETHER = 1 << 18, 20


def _places(route: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (route, node) rows: each row's place among the distinct nodes of its route, and the distinct nodes by route with their routes."""
    by = np.lexsort((node, route))
    r, k = route[by], node[by]
    new = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])]
    number = np.cumsum(new) - 1
    first = np.searchsorted(r[new], np.arange(route.max() + 1))
    place = np.empty(len(by), int)
    place[by] = number - first[r]
    return place, r[new], k[new]


def sequence_routes(matrix: DataFrame) -> DataFrame:
    """Visiting order per route from its long matrix; node of least number is the depot.

    Routes are dealt by id and sorted; a task streams through many of them and holds some batches and one open route. Routes of one size are solved together.
    """

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        ids, i, j, s = (part[c].to_numpy() for c in ("route_id", "i", "j", "duration_s"))
        route = np.r_[0, np.cumsum(ids[1:] != ids[:-1])]
        heads = ids[np.r_[True, route[1:] != route[:-1]]]
        place, owner, node = _places(np.r_[route, route], np.r_[i, j])
        sizes = np.bincount(owner)
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        position = np.arange(len(owner)) - first[owner]
        found = np.empty(len(owner), node.dtype)
        for n in np.unique(sizes):
            which = np.flatnonzero(sizes == n)
            rows = np.flatnonzero(sizes[route] == n)
            seat = np.searchsorted(which, route[rows])
            for at in range(0, len(which), max(1, tours.ROOM // int(n * n))):
                own = which[at : at + max(1, tours.ROOM // int(n * n))]
                lo, hi = np.searchsorted(seat, [at, at + len(own)])
                cost = np.zeros((len(own), n, n))
                cost[seat[lo:hi] - at, place[rows[lo:hi]], place[len(route) + rows[lo:hi]]] = s[rows[lo:hi]]
                order = tours.tours(cost, _orders, KICKS) if n <= TOGETHER else np.array([tour(c) for c in cost])
                to = first[own][:, None] + np.arange(n)
                found[to] = node[first[own][:, None] + order]
        return pd.DataFrame({"route_id": heads[owner], "position": position, "node": found})

    return _route_by_route(_by_route(matrix.select("route_id", "i", "j", "duration_s")), solve, "position int, node int")


def _by_route(rows: DataFrame) -> DataFrame:
    """Rows dealt and sorted by route. A window asks for that, so rows that are dealt by route already are not shuffled again; its number goes with them."""
    return rows.withColumn("__row", F.row_number().over(Window.partitionBy("route_id").orderBy("i", "j")))


def _route_by_route(rows: DataFrame, solve, columns: str) -> DataFrame:
    """``solve`` on whole routes of rows that are dealt and sorted by route_id: a task holds ``GATHER`` rows, a batch and one open route."""

    def run(batches):
        held, n, enough = [], 0, GATHER
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < enough:
                continue
            part = pd.concat(held, ignore_index=True)
            last = part["route_id"] == part["route_id"].iloc[-1]  # it may go on in the next batch
            if not last.all():
                yield solve(part[~last])
                part = part[last]
            held, n = [part], len(part)
            enough = max(GATHER, 2 * n)
        if n:
            yield solve(pd.concat(held, ignore_index=True))

    kind = rows.schema["route_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"route_id {kind}, {columns}")


def earliest_order(seconds: list, start: list, end: list, service: list, shift: float) -> list[int] | None:
    """An order of nodes 1.. that keeps all windows and the shift, if there is one: the earliest time after each (set served, last node)."""
    n = len(seconds)
    reach = {(0, 0): (0.0, None)}
    layer = [(0, 0)]
    for _ in range(n - 1):
        ahead: dict = {}
        for state in layer:
            served, at = state
            for k in range(1, n):
                if not served >> k & 1:
                    t = max(reach[state][0] + seconds[at][k], start[k])
                    key = (served | 1 << k, k)
                    if t <= end[k] and t + service[k] < ahead.get(key, (math.inf,))[0]:
                        ahead[key] = (t + service[k], state)
        reach |= ahead
        layer = list(ahead)
    last = [s for s in layer if reach[s][0] + seconds[s[1]][0] <= shift]
    if not last:
        return None
    state, out = min(last, key=lambda s: reach[s][0] + seconds[s[1]][0]), []
    while state[0]:
        out.append(state[1])
        state = reach[state][1]
    return out[::-1]


def timed_tour(seconds: list, cost: list, start: list, end: list, service: list, shift: float, exact: int = EXACT) -> list[int] | None:
    """Order of nodes 1.. from depot 0 and back within windows and shift, of low cost; None if none is found.

    Stops enter one by one at their cheapest place that keeps every window, by closing time, opening time and slack in
    turn; then stops and reversed stretches move while that lowers the cost. If no entry order works, up to ``exact``
    stops are searched completely, so that None proves that no tour exists; beyond, None means none was found.
    """
    n = len(seconds)

    def kept(order: list[int]) -> bool:
        t, at = 0.0, 0
        for k in order:
            t = max(t + seconds[at][k], start[k])
            if t > end[k]:
                return False
            t, at = t + service[k], k
        return t + seconds[at][0] <= shift

    def total(order: list[int]) -> float:
        return sum(cost[a][b] for a, b in zip([0, *order], [*order, 0]))

    found = []
    for urgency in (lambda k: end[k], lambda k: start[k], lambda k: end[k] - start[k]):
        order: list[int] = []
        for k in sorted(range(1, n), key=lambda k: (urgency(k), k)):
            ways = [new for p in range(len(order) + 1) if kept(new := [*order[:p], k, *order[p:]])]
            if not ways:
                break
            order = min(ways, key=total)
        if len(order) == n - 1:
            found.append(order)
    if not found and n - 1 <= exact and (order := earliest_order(seconds, start, end, service, shift)) is not None:
        found.append(order)
    if not found:
        return None
    order = min(found, key=total)
    best, better = total(order), True
    while better:
        better = False
        for i in range(n - 1):
            for j in range(n - 1):
                rest = order[:i] + order[i + 1 :]
                moved = rest[:j] + [order[i]] + rest[j:]
                turned = order[:i] + order[i : j + 1][::-1] + order[j + 1 :] if i < j else order
                for new in (moved, turned):
                    if (t := total(new)) < best - 1e-9 and kept(new):
                        order, best, better = new, t, True
    return order


def sequence_timed_routes(matrix: DataFrame, stops: DataFrame, objective: str = "time", per_km: float = 0.3, per_hour: float = 12.0, depot: int = 0) -> DataFrame:
    """Visiting order per route that keeps each stop's window and the shift, or status ``infeasible`` with null positions; never a tour that breaks one.

    ``stops``: route_id, node, start_s, end_s, service_s, shift_s (null: no limit). ``matrix``: all arcs, those of node ``depot`` too; one that is missing cannot be used.
    ``objective``: time (seconds) or cost (kilometres and hours at their rates). Stops and arcs of a route meet by one shuffle, without a join.
    """
    if objective not in ("time", "cost"):
        raise ValueError("objective is time or cost")
    limits = [F.lit(None).cast("double").alias(c) for c in ("start_s", "end_s", "service_s", "shift_s")]
    weight = F.col("duration_s") if objective == "time" else arc_cost(F.col("distance_m"), F.col("duration_s"), F.lit(per_km), F.lit(per_hour))
    arcs = matrix.select("route_id", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("duration_s").cast("double").alias("duration_s"), weight.cast("double").alias("weight"), *limits)
    marks = stops.select("route_id", F.col("node").cast("long").alias("i"), F.col("node").cast("long").alias("j"), F.lit(0.0).alias("duration_s"), F.lit(0.0).alias("weight"), *[F.col(c).cast("double").alias(c) for c in ("start_s", "end_s", "service_s", "shift_s")])
    rows = _by_route(marks.union(arcs.where("i <> j")))  # the marks first: the planner asks the first of a union how it is dealt, and cannot tell of a join

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        ids, i, j = (part[c].to_numpy() for c in ("route_id", "i", "j"))
        route = np.r_[0, np.cumsum(ids[1:] != ids[:-1])]
        heads = ids[np.r_[True, route[1:] != route[:-1]]]
        is_stop = (i == j) & (i != depot)
        stops = part[is_stop]
        owner, node = route[is_stop], i[is_stop]  # by route and node
        if not len(owner):
            return pd.DataFrame({"route_id": ids[:0], "position": pd.array([], "Int32"), "node": i[:0], "status": np.array([], object)})
        sizes = np.bincount(owner, minlength=len(heads))
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        # places of both ends of each arc: 0 for the depot, else 1 and more; -1 if the route has no such stop
        codes = np.unique(np.r_[node, i, j], return_inverse=True)[1].ravel()
        width = int(codes.max()) + 1
        keys = owner * width + codes[: len(node)]
        arc = np.flatnonzero(i != j)

        def place(side: int, values: np.ndarray) -> np.ndarray:
            key = route[arc] * width + codes[len(node) + side * len(i) :][arc]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(values[arc] == depot, 0, np.where(keys[at] == key, at - first[route[arc]] + 1, -1))

        y, x = place(0, i), place(1, j)
        arc, y, x = (a[(y >= 0) & (x >= 0)] for a in (arc, y, x))
        own_seconds, own_weights = (part[c].to_numpy()[arc] for c in ("duration_s", "weight"))
        values = {c: stops[c].fillna(empty).to_numpy() for c, empty in (("start_s", 0.0), ("end_s", math.inf), ("service_s", 0.0))}
        shifts = np.full(len(heads), math.inf)
        np.minimum.at(shifts, owner, stops["shift_s"].fillna(math.inf).to_numpy())
        position, found, solved = np.arange(len(owner)) - first[owner] + 1, node.copy(), np.zeros(len(heads), bool)
        for m in np.unique(sizes[sizes > 0]):
            n, each = int(m) + 1, max(1, tours.ROOM // int((m + 1) * (m + 1)))
            which = np.flatnonzero(sizes == m)
            rows = np.flatnonzero(sizes[route[arc]] == m)
            seat = np.searchsorted(which, route[arc[rows]])
            for at in range(0, len(which), each):
                own = which[at : at + each]
                lo, hi = np.searchsorted(seat, [at, at + len(own)])
                seconds, weights = np.full((2, len(own), n, n), np.inf)
                spot = seat[lo:hi] - at, y[rows[lo:hi]], x[rows[lo:hi]]
                seconds[spot], weights[spot] = own_seconds[rows[lo:hi]], own_weights[rows[lo:hi]]
                seconds, weights = np.nan_to_num(seconds, nan=np.inf, posinf=np.inf), np.nan_to_num(weights, nan=np.inf, posinf=np.inf)
                to = first[own][:, None] + np.arange(m)
                start, end, service = (np.concatenate([np.full((len(own), 1), empty), values[c][to]], axis=1) for c, empty in (("start_s", 0.0), ("end_s", math.inf), ("service_s", 0.0)))
                if n <= TOGETHER:
                    order, has = tours.timed_tours(seconds, weights, start, end, service, shifts[own], EXACT, earliest_order)
                else:
                    each_order = [timed_tour(*(a[r].tolist() for a in (seconds, weights, start, end, service)), float(shifts[own[r]]), EXACT) for r in range(len(own))]
                    has = np.array([o is not None for o in each_order])
                    order = np.array([range(1, n) if o is None else o for o in each_order])
                found[to[has]] = node[first[own[has]][:, None] + order[has] - 1]
                solved[own] = has
        ok = solved[owner]
        return pd.DataFrame({"route_id": heads[owner], "position": pd.Series(position, dtype="Int32").mask(~ok), "node": found, "status": np.where(ok, "feasible", "infeasible")})

    return _route_by_route(rows, solve, "position int, node long, status string")


def navigation_link(points: Column, origin: Column | None = None, destination: Column | None = None, base: str = "https://maps.example/dir") -> Column:
    """Origin, points and destination with coordinates as lat,lon at five decimals after the base; a destination that is the last point is not repeated."""
    place = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))
    known = lambda a: F.filter(a, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    way = F.transform(known(points), place)
    if origin is not None:
        way = F.concat(known(F.array(place(origin))), way)
    if destination is not None:
        last = F.try_element_at(way, F.lit(-1))
        end = F.filter(known(F.array(place(destination))), lambda p: ~p.eqNullSafe(last))
        way = F.concat(way, end)
    return F.concat(F.lit(base + "/"), F.array_join(F.transform(way, lambda p: F.format_string("%.5f,%.5f", p["lat"], p["lon"])), "/"))


def snapshots(stops: DataFrame, patients: DataFrame) -> DataFrame:
    """Published document per revision: stops in order with the patient's reference, as JSON."""
    rows = stops.join(patients.select("patient_id", "external_ref"), "patient_id", "left")
    item = F.struct("sequence", "patient_id", "external_ref", "service_minutes")
    return rows.groupBy("organization_id", "revision_id").agg(F.array_sort(F.collect_list(item)).alias("order"), F.max("service_date").alias("published_at"))


def explode_snapshots(published: DataFrame) -> DataFrame:
    """Stops of published documents in order, bad patient ids left out; never joined to live patients."""
    kind = "order array<struct<sequence:int,patient_id:bigint,external_ref:string,service_minutes:int>>"
    return published.select("revision_id", F.explode(F.from_json("document", kind)["order"]).alias("s")).where("s.patient_id is not null").select("revision_id", "s.*")


def holding_reference(published: DataFrame, reference: str) -> DataFrame:
    return published.where(F.exists("order", lambda s: s["external_ref"] == reference)).select("revision_id")


def metrics_gate(metrics: DataFrame) -> DataFrame:
    """Per revision the reason why its variants cannot be compared: one of original and optimized is missing, or stale; else null."""
    there = lambda name: F.coalesce(F.bool_or(F.col("variant") == name), F.lit(False))
    stale = F.bool_or(F.col("variant").isin("original", "optimized") & F.coalesce("stale", F.lit(False)))
    reason = F.when(~(there("original") & there("optimized")), "METRICS_UNAVAILABLE").when(stale, "METRICS_STALE")
    return metrics.groupBy("revision_id").agg(reason.alias("reason"))


def publish_gate(requests: DataFrame, metrics: DataFrame, stops: DataFrame) -> DataFrame:
    """Each request to publish a route with the first reason against it, null where it may be published.

    ``requests`` join route and revision: null route_status means no such route, null revision_status no such revision.
    ``stops`` counts with their own coordinates only. A request without revision_id asks for the current one.
    """
    gate = metrics_gate(metrics).select(F.col("revision_id").alias("target"), F.col("reason").alias("__metrics"), F.lit(True).alias("__measured"))
    located = stops.groupBy(F.col("revision_id").alias("target")).agg(F.count("*").alias("__stops"), F.count_if(F.col("longitude").isNull() | F.col("latitude").isNull()).alias("__lost"))
    rows = requests.withColumn("target", F.coalesce("revision_id", "current_revision")).join(gate, "target", "left").join(located, "target", "left")
    status = F.col("route_status")
    reason = (
        F.when(status.isNull(), "ROUTE_NOT_FOUND")
        .when(~F.col("version").eqNullSafe(F.col("expected_version")), "ROUTE_VERSION_CONFLICT")
        .when(status == "published", "ROUTE_PUBLISHED")
        .when(~status.isin("draft", "optimizing", "ready"), "ROUTE_NOT_PUBLISHABLE")
        .when(F.col("target").isNull(), "REVISION_NOT_FOUND")
        .when(F.col("target") != F.col("current_revision"), "REVISION_NOT_CURRENT")
        .when(F.col("revision_status").isNull(), "REVISION_NOT_FOUND")
        .when(F.col("revision_status") == "published", "REVISION_PUBLISHED")
        .when(F.col("revision_status") != "draft", "REVISION_NOT_DRAFT")
        .when(~F.col("solver_status").eqNullSafe("feasible"), "ROUTE_NOT_FEASIBLE")
        .when(F.col("origin").isNull() | F.col("destination").isNull(), "ROUTE_ORIGIN_MISSING")
        .when(F.col("__measured").isNull(), "METRICS_UNAVAILABLE")
        .when(F.col("__metrics").isNotNull(), F.col("__metrics"))
        .when(F.col("__stops").isNull(), "NO_STOPS_TO_PUBLISH")
        .when(F.col("__lost") > 0, "STOP_LOCATION_MISSING")
    )
    return rows.withColumn("reason", reason).drop("target", "__metrics", "__measured", "__stops", "__lost")


def history_page(revisions: DataFrame, limit: int, before: tuple | None = None, since=None, until=None, reference: str | None = None, **equal) -> DataFrame:
    """Newest first after a cursor (published_at, id); one row more than the clamped limit tells whether more follow.

    ``since`` and ``until`` bound published_at, both included; ``reference`` asks for documents that hold it; other arguments ask columns to be equal.
    """
    n = min(max(limit, 1), 100)
    if since is not None:
        revisions = revisions.where(F.col("published_at") >= since)
    if until is not None:
        revisions = revisions.where(F.col("published_at") <= until)
    if reference is not None:
        revisions = revisions.where(F.exists("order", lambda s: s["external_ref"] == reference))
    for name, value in equal.items():
        revisions = revisions.where(F.col(name) == value)
    if before:
        revisions = revisions.where((F.col("published_at") < before[0]) | ((F.col("published_at") == before[0]) & (F.col("revision_id") < before[1])))
    return revisions.orderBy(F.desc("published_at"), F.desc("revision_id")).limit(n + 1)


def active_shares(shares: DataFrame, as_of: Column) -> DataFrame:
    reason = F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at") <= as_of, "expired")
    return shares.withColumn("reason", reason).withColumn("active", F.col("reason").isNull())


#: Routes that an editor sees at a time; pairs of editors and routes in one part of an organization and in one task; routes in one task.
ROUTES_A_RUN, PAIRS_A_PART, PAIRS_A_TASK, ROUTES_A_TASK = 1 << 7, 1 << 21, 1 << 25, 1 << 18


def visible_routes(members: DataFrame, routes: DataFrame, shares: DataFrame) -> DataFrame:
    """(user, route) of editors, assignees in the field, and active shares, once each.

    Editors' pairs, by far the most, differ by themselves and are not shuffled; pairs of assignees and shares that an editor has already are left out
    by the route's organization. Only routes of several organizations, if any, are made distinct afterwards. Editors meet routes in as many tasks as
    their pairs ask for, since the planner goes by the bytes of the routes. One editor after the other sees the same run of routes, so that pairs take
    little room in a file.
    """
    r = routes.select("organization_id", "route_id", "assignee")
    homes = written(r.select("organization_id", "route_id").distinct().withColumn("__homes", F.count("*").over(Window.partitionBy("route_id"))), "homes")
    editors = members.where("role = 'editor'").select("organization_id", "user_id").distinct()
    sizes = written(homes.groupBy("organization_id").agg(F.count("*").alias("__routes")).join(editors.groupBy("organization_id").agg(F.count("*").alias("__editors")), "organization_id"), "meetings")
    most = sizes.agg(F.sum(F.col("__routes") * F.col("__editors") / PAIRS_A_TASK), F.sum(F.col("__routes") / ROUTES_A_TASK)).first()
    tasks = math.ceil(max(1, *(x or 0 for x in most)))
    parts = sizes.select("organization_id", F.ceil(F.col("__routes") / ROUTES_A_RUN).alias("__runs"), F.ceil(F.col("__routes") * F.col("__editors") / PAIRS_A_PART).alias("__parts"))
    key = ["organization_id", "__part"]

    def edited(homes: DataFrame) -> DataFrame:
        run = F.pmod(F.xxhash64("route_id"), F.col("__runs"))
        dealt = homes.join(parts, "organization_id").select("organization_id", "route_id", run.alias("__run"), F.pmod(run, F.col("__parts")).alias("__part"))
        runs = dealt.repartition(tasks, *key).groupBy(*key, "__run").agg(F.collect_list(F.struct("route_id")).alias("__seen"))
        met = editors.join(parts, "organization_id").select("organization_id", "user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("__part"))
        return runs.join(met.hint("shuffle_hash"), key).select("user_id", F.explode("__seen").alias("__route")).select("user_id", "__route.route_id")

    field = members.where("role = 'field'").join(r, "organization_id").where("assignee = user_id").select("user_id", "route_id")
    others = field.union(shares.where("active").select("user_id", "route_id")).distinct()
    single = "__homes = 1 AND route_id IS NOT NULL"
    own = homes.where(single).select("route_id", "organization_id")
    several = homes.where(f"NOT ({single})").select("route_id", "organization_id")
    e = editors.select(F.col("organization_id").alias("__organization"), F.col("user_id").alias("__user"))
    rest = others.join(own, "route_id", "left").join(e, (F.col("organization_id") == F.col("__organization")) & F.col("user_id").eqNullSafe(F.col("__user")), "left_anti")
    return edited(own).union(rest.select("user_id", "route_id").union(edited(several)).distinct())


def may_see(asked: DataFrame, members: DataFrame, routes: DataFrame, shares: DataFrame) -> DataFrame:
    """Asked (user_id, route_id) pairs with the reason why the user sees the route: editor, assignee or share; null if not.

    The rule is looked up for what is asked: no table of all users and routes is made. A user who is no member of the route's
    organization sees nothing; an unknown route is seen by nobody.
    """
    role = lambda name: F.bool_or(F.col("role") == name).alias(f"__{name}")
    m = members.groupBy("organization_id", "user_id").agg(role("editor"), role("field"))
    shared = shares.where("active").select("user_id", "route_id", F.lit(True).alias("__share")).distinct()
    rows = asked.join(routes.select("route_id", "organization_id", "assignee"), "route_id", "left").join(m, ["organization_id", "user_id"], "left").join(shared, ["user_id", "route_id"], "left")
    reason = F.when(F.col("__editor"), "editor").when(F.col("__field") & (F.col("assignee") == F.col("user_id")), "assignee").when(F.col("__field").isNotNull() & F.col("__share"), "share")
    return rows.select(*asked.columns, reason.alias("reason"))


def next_revisions(revisions: DataFrame) -> DataFrame:
    w = Window.partitionBy("route_id")
    return revisions.withColumn("is_current", F.row_number().over(w.orderBy(F.desc("revision_no"))) == 1).withColumn("next_no", F.max("revision_no").over(w) + 1)


def reorder(stops: DataFrame, requested: DataFrame) -> DataFrame:
    """Sequence 1..n in requested order and a version more where the request is a permutation of the route's patients, else unchanged with a reason; other columns stay."""
    asked = requested.select("route_id", F.posexplode("patients").alias("__pos", "patient_id"))
    have = stops.groupBy("route_id").agg(F.array_sort(F.collect_list("patient_id")).alias("have"))
    fits = requested.join(have, "route_id").select("route_id", ((F.array_sort("patients") == F.col("have")) & (F.size(F.array_distinct("patients")) == F.size("patients"))).alias("__fits"))
    asked = asked.join(fits.where("__fits"), "route_id", "left_semi")
    rows = stops.join(fits, "route_id", "left").join(asked, ["route_id", "patient_id"], "left")
    new = {"sequence": F.when(F.col("__fits"), F.col("__pos") + 1).otherwise(F.col("sequence")), "version": F.col("version") + F.coalesce(F.col("__fits").cast("int"), F.lit(0)), "reason": F.when(~F.col("__fits"), "STOP_ORDER_NOT_PERMUTATION")}
    return rows.withColumns(new).select(*stops.columns, "reason")


def replace_stops(stops: DataFrame, requested: DataFrame, minutes: int = 45) -> DataFrame:
    """Routes with a request (route_id, patients) get its patients as stops, 1..n, a version more; service minutes carry over from before, ``minutes`` for new ones.

    Columns route_id, patient_id, sequence, service_minutes, version, reason. A request that names a patient twice, or nobody, changes nothing and
    has its reason on the old stops; other routes stay.
    """
    keys = ["route_id", "patient_id"]
    bad = F.when(F.size("patients") == 0, "NO_STOPS").when(F.size(F.array_distinct("patients")) < F.size("patients"), "DUPLICATE_PATIENT")
    judged = requested.withColumn("reason", bad)
    before = stops.groupBy(*keys).agg(F.max_by("service_minutes", "sequence").alias("__minutes"))
    versions = stops.groupBy("route_id").agg(F.max("version").alias("__version"))
    new = judged.where("reason IS NULL").select("route_id", F.posexplode("patients").alias("__at", "patient_id")).join(before, keys, "left").join(versions, "route_id", "left")
    made = new.select(*keys, (F.col("__at") + 1).alias("sequence"), F.coalesce("__minutes", F.lit(minutes)).alias("service_minutes"), (F.coalesce("__version", F.lit(0)) + 1).alias("version"), F.lit(None).cast("string").alias("reason"))
    old = stops.join(judged.where("reason IS NULL").select("route_id"), "route_id", "left_anti").join(judged.where("reason IS NOT NULL").select("route_id", "reason"), "route_id", "left")
    return old.select(*keys, "sequence", "service_minutes", "version", "reason").unionByName(made)


def mark_stale(metrics: DataFrame, reordered: DataFrame) -> DataFrame:
    """Metrics (revision_id) whose route was reordered are stale until they are computed again."""
    return metrics.join(reordered.select("revision_id", F.lit(True).alias("__new")).distinct(), "revision_id", "left").withColumn("stale", F.coalesce("stale", F.lit(False)) | F.coalesce("__new", F.lit(False))).drop("__new")


def published_documents(order: DataFrame, metrics: DataFrame, revisions: DataFrame) -> DataFrame:
    """The whole published document a revision as JSON: order, origin, destination, objective, dataset version, and the original and optimized metrics.

    ``order`` from :func:`snapshots`; ``metrics``: revision_id, variant, travel_seconds, distance_m, cost; ``revisions``: revision_id, origin, destination, objective, dataset_version.
    """
    value = F.struct("travel_seconds", "distance_m", "cost")
    of = lambda name: F.max(F.when(F.col("variant") == name, value)).alias(name)
    measured = metrics.groupBy("revision_id").agg(of("original"), of("optimized")).select("revision_id", F.struct("original", "optimized").alias("metrics"))
    rows = order.join(revisions, "revision_id").join(measured, "revision_id", "left")
    return rows.select("organization_id", "revision_id", "published_at", F.to_json(F.struct("dataset_version", "origin", "destination", "objective", "order", "metrics")).alias("document"))


def shared_view(shares: DataFrame, stops: DataFrame) -> DataFrame:
    """What an active share shows of its route: its day, how many stops it has, and their sequences; no person, place, service or status.

    ``permission`` and ``expires_at`` of the share stay where it has them. A route without stops has 0 and an empty list.
    """
    per = stops.groupBy("route_id").agg(F.max("service_date").alias("service_date"), F.count("*").alias("stop_count"), F.sort_array(F.collect_list("sequence")).alias("sequences"))
    kept = [c for c in ("permission", "expires_at") if c in shares.columns]
    rows = shares.where("active").select("share_id", "route_id", *kept).join(per, "route_id", "left")
    return rows.withColumns({"stop_count": F.coalesce("stop_count", F.lit(0)), "sequences": F.coalesce("sequences", F.array().cast("array<int>"))})


def foreign_patients(requested: DataFrame, patients: DataFrame) -> DataFrame:
    """Requested (organization, patient) pairs that the organization does not have, once each."""
    keys = ["organization_id", "patient_id"]
    return requested.select(*keys).distinct().join(patients.select(*keys), keys, "left_anti")


def ledger(requests: DataFrame) -> DataFrame:
    """First payload of a key creates, the same one replays, another conflicts."""
    w = Window.partitionBy("organization_id", "type", "idempotency_key").orderBy("created_at", "id")
    first = F.first("request_hash").over(w)
    return requests.withColumn("outcome", F.when(F.row_number().over(w) == 1, "create").when(F.col("request_hash") == first, "replay").otherwise("conflict"))


def first_per_stratum(rows: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def latency_percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    return rows.groupBy(by).agg(p.alias("p"), F.max(value).alias("max")).select(by, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "max")


def notifications(events: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row per (event, recipient) of known event types; recipients are distinct."""
    kind = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    rows = events.withColumn("type", kind[F.col("event_type")]).where("type is not null")
    return rows.select("event_id", "type", F.explode(F.array_distinct("recipients")).alias("recipient_id")).dropDuplicates(["event_id", "recipient_id"])


def patient_map(patients: DataFrame, addresses: DataFrame, history: DataFrame, zones: DataFrame) -> DataFrame:
    a = addresses.where("is_active").select("patient_id", "address_id", "postal_code", "municipality", "geocode_status", "version")
    h = history.where("valid_to is null").select("patient_id", "organization_id", "zone_id", "source")
    return patients.join(a, "patient_id").join(h, ["patient_id", "organization_id"], "left").join(zones.select("organization_id", "zone_id", "kind"), ["organization_id", "zone_id"], "left")
