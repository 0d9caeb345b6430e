"""Operators on crowded inputs: the same results as plain versions, with work that does not grow with pairs."""

import hashlib
import itertools
import json
import math
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from homeround.functions import text
from homeround.operators import intake, planning, ranges, routing, tours, zoning
from homeround.plans import catalog
from homeround.sources import domain
from homeround.streaming import routes


def plain_counts(x, y, w, own, r):
    return np.array([w[(x - x[i]) ** 2 + (y - y[i]) ** 2 <= r * r].sum() for i in own])


@pytest.mark.parametrize("spread, n", [(10_000, 400), (900, 900), (60, 700), (0, 5)])
def test_near_counts_of_any_density(spread, n):
    rng = np.random.default_rng(n)
    x, y = 500_000 + spread * rng.random((2, n)).round(3)
    x[: n // 4], y[: n // 4] = 500_000 + 500 * (rng.integers(0, 3, (2, n // 4)))  # exactly at the radius
    w = rng.integers(1, 5, n)
    own = np.flatnonzero(rng.random(n) < 0.7)
    assert zoning.near_counts(x, y, w, own, 500.0).tolist() == plain_counts(x, y, w, own, 500.0).tolist()


def test_density_across_tiles(spark):
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(0, 900, (400, 2)), rng.integers(-4, 5, (200, 2)) * 500.0, np.zeros((3, 2))]).round(2)
    rows = [(i % 2, i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    points = spark.createDataFrame(rows, "organization_id int, point_id long, x double, y double")
    got = {r.point_id: r.density for r in zoning.density(points).collect()}
    for o in (0, 1):
        mine = [i for i in range(len(xy)) if i % 2 == o]
        x, y = xy[mine].T
        assert [got[i] for i in mine] == plain_counts(x, y, np.ones(len(mine), int), range(len(mine)), 500.0).tolist()
    assert zoning.density(points.where("1 = 0")).count() == 0


def test_areas_are_shared_among_tasks(spark):
    """Areas are few bytes and much work; so the planner would give all of them to one task."""
    n = 20_000
    points = spark.range(n).select(F.lit(1).alias("organization_id"), F.lit("urban").alias("kind"), F.col("id").alias("point_id"), (F.col("id") % 150 * 40.0).alias("x"), (F.col("id") % 143 * 40.0).alias("y"))
    cut = zoning.cluster_points(points, 12)
    assert cut.rdd.getNumPartitions() == math.ceil(n / 8192)
    zones = zoning._zones(cut)
    surplus = spark.createDataFrame([(1, 100)], "organization_id int, surplus long")
    merged = zoning.merge_plan(zoning.written(zones, "sizes"), surplus, 12)
    used = merged.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert merged.rdd.getNumPartitions() == math.ceil(zones.count() / 2048)
    assert sum(r["count"] for r in used) == zones.count()


def test_commits_read_import_rows_once_written(spark):
    for name in ("version_addresses", "commit_addresses", "upsert_patients", "commit_counts", "accept_rows"):
        assert not [f for f in catalog.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "orders.parquet" in f]


def plain_groups(xy, eps):
    group = list(range(len(xy)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(xy)):
        for j in np.flatnonzero(((xy[:i] - xy[i]) ** 2).sum(axis=1) <= eps * eps):
            a, b = sorted((find(i), find(int(j))))
            group[b] = a
    out = [find(i) for i in range(len(xy))]
    return [g if out.count(g) > 1 else None for g in out]


@pytest.mark.parametrize("depth", [2, 6])
def test_rural_groups_by_squares(spark, monkeypatch, depth):
    monkeypatch.setattr(zoning, "SQUARE_DEPTH", depth)
    rng = np.random.default_rng(depth)
    blob = lambda x, y, n, s: np.array([x, y]) + rng.uniform(-s, s, (n, 2))
    xy = np.concatenate([
        rng.uniform(-40_000, 40_000, (150, 2)), blob(0, 0, 60, 30), blob(2_530, 0, 60, 30), blob(60_000, 0, 50, 40), blob(62_575, 0, 50, 40), blob(90_000, 5, 3, 0),
        [[100_000.0, 0.0], [102_500.0, 0.0], [105_000.5, 0.0], [105_000.5, 0.0]],
    ])
    points = spark.createDataFrame([(7, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "organization_id int, point_id long, x double, y double")
    got = {r.point_id: r.group for r in zoning.rural_groups(points).collect()}
    assert [got[i] for i in range(len(xy))] == plain_groups(xy, 2_500.0)


def test_a_dense_town_has_as_many_links_as_squares(spark):
    """100,000 points in a town of 9 by 9 kilometres: some 40 squares, at most 12 links a square."""
    town = spark.range(100_000).select(F.lit(1).alias("organization_id"), F.col("id").alias("point_id"), (F.rand(1) * 9_000).alias("x"), (F.rand(2) * 9_000).alias("y"))
    town = spark.createDataFrame(town.collect(), town.schema)
    links = zoning.linked_squares(town.select("organization_id", "x", "y"), zoning.RURAL_EPS_M)
    squares = town.select(F.floor(F.col("x") / (zoning.RURAL_EPS_M / 1.4143)), F.floor(F.col("y") / (zoning.RURAL_EPS_M / 1.4143))).distinct().count()
    assert links.count() <= 12 * squares < 500
    assert zoning.rural_groups(town).select("group").distinct().count() == 1


def old_tour(cost):
    """Nearest arcs, then any stretch turned round while the whole tour gets shorter."""
    n = len(cost)
    order, left = [0], set(range(1, n))
    while left:
        order.append(min(left, key=lambda j: (cost[order[-1], j], j)))
        left.remove(order[-1])
    total = lambda o: cost[o, [*o[1:], o[0]]].sum()
    best, better = total(order), True
    while better:
        better = False
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                new = order[:i] + order[i : j + 1][::-1] + order[j + 1 :]
                if (t := total(new)) < best - 1e-9:
                    order, best, better = new, t, True
    return order


@pytest.mark.parametrize("kind", ["plane", "one way", "whole numbers"])
def test_tours_are_never_worse_than_turning_alone(kind):
    rng = np.random.default_rng(3)
    better = 0
    for n in (1, 2, 3, 5, 7, 8, 9, 12, 25, 25, 40):
        xy = rng.random((n, 2))
        cost = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)) if kind == "plane" else rng.random((n, n)) if kind == "one way" else rng.integers(1, 9, (n, n)).astype(float)
        new, old = routing.tour(cost), old_tour(cost)
        assert new[0] == 0 and sorted(new) == list(range(n)) and routing.tour(cost) == new
        total = lambda o: cost[o, [*o[1:], o[0]]].sum()  # noqa: B023, E731
        assert total(new) <= total(old) + 1e-9
        better += total(new) < total(old) - 1e-9
    assert better >= 2


def test_short_tours_are_the_best():
    rng = np.random.default_rng(5)
    for n in (2, 3, 4, 5, 6, 7):
        cost = rng.integers(1, 50, (n, n)).astype(float)
        total = lambda o: cost[list(o), [*o[1:], o[0]]].sum()  # noqa: B023, E731
        assert total(routing.tour(cost)) == min(total((0, *p)) for p in itertools.permutations(range(1, n)))


def test_long_tours_are_quick():
    xy = np.random.default_rng(6).random((120, 2))
    cost = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    start = time.process_time()
    routing.tour(cost)
    assert time.process_time() - start < 1.5  # some 0.1 s on a free core


def test_one_large_plan_is_placed_as_a_stream(spark):
    """The same days as one pass in memory gives, with batches of 100 rows, for a plan whose visits come as many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        visits = spark.range(6_000).select(
            F.when(F.col("id") < 5_000, 1).otherwise(F.col("id") % 3).cast("int").alias("plan_id"), F.col("id").alias("patient_id"), F.concat(F.lit("Z"), F.col("id") % 7).alias("zone_id"),
            F.when(F.col("id") % 4 == 0, "rural").otherwise("urban").alias("kind"), (F.col("id") % 19 != 0).alias("geocode_confirmed"), F.when(F.col("id") % 5 != 0, 20 + F.col("id") % 40).cast("int").alias("service_minutes"),
            F.when(F.col("id") % 6 == 0, 480 + 60 * (F.col("id") % 5)).cast("int").alias("window_start"), F.when(F.col("id") % 6 == 0, 600 + 60 * (F.col("id") % 7)).cast("int").alias("window_end"),
        )
        days = spark.range(40).select(F.when(F.col("id") < 20, 1).otherwise(2).cast("int").alias("plan_id"), F.date_add(F.lit("2026-09-01").cast("date"), (F.col("id") % 20).cast("int")).alias("date"), F.lit(150).alias("capacity_visits"), F.lit(6_000).alias("capacity_minutes"), F.lit(None).cast("int").alias("window_start"), F.lit(None).cast("int").alias("window_end"))
        got = sorted((tuple(r) for r in planning.place_visits(visits, days).collect()), key=str)
        ranked, per_day = planning.visit_priority(visits).toPandas(), days.toPandas()
        none = {c: None for c in ("date",)}
        expected = []
        for plan, part in ranked.groupby("plan_id"):
            placed = planning.place_plan(part[part.conflict.isna()], per_day[per_day.plan_id == plan])
            expected += [tuple(r) for r in placed.itertuples(index=False)]
            expected += [(plan, v.patient_id, v.zone_id, none["date"], v.conflict) for v in part[part.conflict.notna()].itertuples()]
        plain = lambda r: (int(r[0]), int(r[1]), r[2], r[3] if r[3] is not None and r[3] == r[3] else None, r[4])
        assert got == sorted((plain(r) for r in expected), key=str)
        assert {r[4] for r in got} >= {None, "UNSCHEDULABLE", "ADDRESS_NOT_CONFIRMED"} and len(got) == 6_000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_case_folding(spark):
    texts = ["Straße", "ΟΔΟΣ ΣΑΣ", "ﬁx ŉ ǰ", "İstanbul ISPARTA ı", "ẞ ᾳ ᾼ", "ꭰᎠᏸ", "Plain ABC", "ÑÜ Å"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.casefold(F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [t.casefold() for t in texts]
    every = "".join(chr(i) for i in range(0x20, 0x1F000) if chr(i).isalpha() and not 0xD800 <= i < 0xE000 and len(chr(i).casefold()) and chr(i) != "Σ")
    chars = spark.createDataFrame([(c,) for c in every], "t string").select("t", text.casefold(F.col("t")).alias("got")).where("t <> got OR t = got").collect()
    assert [r.t for r in chars if r.got != r.t.casefold()] == []


def test_payload_hashes(spark):
    same = ['{"b":[1,{"d":"é","c":null}],"a":"x\\ty"}', '{ "a" : "x\\ty",\n "b" : [1, {"c":null, "d":"\\u00e9"}] }']
    other = ['{"b":[1,{"d":"e","c":null}],"a":"x\\ty"}', '{"b":[{"d":"é","c":null},1],"a":"x\\ty"}', "{", None]
    got = [r.h for r in spark.createDataFrame([(t,) for t in same + other], "t string").select(text.payload_hash(F.col("t")).alias("h")).collect()]
    canonical = json.dumps(json.loads(same[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[0] == got[1] == hashlib.sha256(canonical.encode()).hexdigest() and len({*got[1:4]}) == 3 and got[4:] == [None, None]


def test_plan_counts(spark):
    rows = [(1, None), (1, "A"), (1, "A"), (1, "B"), (2, None)]
    placed = spark.createDataFrame(rows, "plan_id int, code string")
    assert sorted(map(tuple, planning.plan_metrics(placed).collect())) == [(1, 1, 3), (2, 1, 0)]
    assert sorted(map(tuple, planning.conflict_counts(placed).collect())) == [(1, "A", 2), (1, "B", 1)]


def corners(points):
    """Those that see all others within less than half a turn."""
    out = set()
    for p in points:
        turns = sorted(math.atan2(q[1] - p[1], q[0] - p[0]) for q in points if q != p)
        gaps = [b - a for a, b in zip(turns, turns[1:])] + [turns[0] + 2 * math.pi - turns[-1]]
        if max(gaps) > math.pi + 1e-9:
            out.add(p)
    return out


def test_hulls_are_the_corners_in_turn():
    rng = np.random.default_rng(8)
    for n in (3, 4, 9, 40):
        points = {(float(x), float(y)) for x, y in rng.integers(0, 8, (n, 2))} | {(0.0, 0.0), (7.0, 1.0), (2.0, 9.0)}
        text = zoning.hull_wkt(*np.array(sorted(points)).T)
        ring = [tuple(map(float, p.split())) for p in text.removeprefix("POLYGON ((").removesuffix("))").split(", ")]
        assert ring[0] == ring[-1] and set(ring) == corners(points) and len(ring) == len(set(ring)) + 1
        area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:]))
        assert area > 0  # one turn to the left all the way
    assert zoning.hull_wkt(np.array([0.0, 1.0, 2.0]), np.array([0.0, 1.0, 2.0])) is None


def test_a_reference_that_most_rows_share(spark):
    rows = spark.range(3_000).select(
        F.lit(1).alias("organization_id"), F.lit("2026-01").alias("period"), F.concat(F.lit("b"), F.col("id") % 7).alias("batch_id"), F.floor(F.col("id") / 7).cast("int").alias("row_number"), (F.col("id") % 7 == 6).alias("cancelled"),
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("own"), F.col("id"))).when(F.col("id") % 11 != 0, "shared").alias("reference_hash"), F.array().cast("array<struct<field:string,code:string>>").alias("errors"),
    )
    got = {(r.batch_id, r.row_number): [e.code for e in r.errors] for r in intake.mark_duplicates(rows).collect()}
    first = {}
    for i in range(3_000):
        if i % 5 and i % 11:
            first.setdefault(i % 7, i // 7)
    for i in range(3_000):
        shared = i % 5 != 0 and i % 11 != 0
        assert got[f"b{i % 7}", i // 7] == (["DUPLICATE_IN_BATCH" if i // 7 > first[i % 7] else "DUPLICATE_IN_PERIOD"] if shared else [])


def test_numbers_by_ranges(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id") % 10 < 9).alias("g"), (F.col("id") * 7919 % 5_003).alias("k"), "id")
    got = ranges.numbered(rows, ["g"], ["k"], "n").collect()
    plain = {}
    for g, k, i in sorted(((r.g, r.k, r.id) for r in rows.collect()), key=lambda r: (str(r[0]), r[1])):
        plain[i] = plain.get(("last", g), 0) + 1
        plain["last", g] = plain[i]
    assert len(got) == 5_000 and all(r.n == plain[r.id] for r in got)


@pytest.mark.parametrize("n", range(1, 13))
def test_routes_of_one_size_are_solved_together(n):
    """Many routes at once get the tours that each gets alone, with and without windows."""
    rng = np.random.default_rng(n)
    cost = np.round(rng.random((40, n, n)) * 90) / 10
    assert tours.tours(cost, routing._orders, routing.KICKS).tolist() == [routing.tour(c) for c in cost]
    if n == 1:
        return
    for wide, shift in ((90, 14_400.0), (900, np.inf)):
        seconds = rng.integers(60, 960, (40, n, n)).astype(float)
        seconds[rng.random(seconds.shape) < 0.05] = np.inf
        start = rng.integers(0, 60 * n, (40, n)) * 60.0
        end, service, shifts = start + rng.integers(5, wide, (40, n)) * 60.0, rng.integers(1, 20, (40, n)) * 60.0, np.full(40, shift)
        order, has = tours.timed_tours(seconds, cost, start, end, service, shifts, routing.EXACT, routing.earliest_order)
        alone = [routing.timed_tour(*(a[r].tolist() for a in (seconds, cost, start, end, service)), shift) for r in range(40)]
        assert [o.tolist() if ok else None for o, ok in zip(order, has)] == alone


def test_sequenced_routes_keep_their_order_over_batches(spark, monkeypatch):
    """Routes of all sizes, cut by batches and gathered in any number, are the tours of their own matrices."""
    rows = [(r, i, j, float(60 + (r * 37 + i * 13 + j * 29) % 900)) for r in range(40) for i in range(1, 2 + r % 9) for j in range(1, 2 + r % 9) if i != j]
    matrix = spark.createDataFrame(rows, "route_id long, i int, j int, duration_s double")
    monkeypatch.setattr(routing, "GATHER", 64)
    got = {}
    for r in routing.sequence_routes(matrix).collect():
        got.setdefault(r.route_id, {})[r.position] = r.node
    for r in range(40):
        n = 1 + r % 9
        cost = np.array([[0.0 if i == j else float(60 + (r * 37 + i * 13 + j * 29) % 900) for j in range(1, n + 1)] for i in range(1, n + 1)])
        assert n == 1 or [got[r][p] for p in range(n)] == [k + 1 for k in routing.tour(cost)]


def test_visible_routes_without_a_shuffle_of_pairs(spark):
    """Once each, also where an editor has a share, a route is in two organizations, or something is null; only pairs of assignees and shares are made distinct."""
    members = spark.createDataFrame([(o, u, "editor" if u % 3 == 0 else "field") for o in range(3) for u in range(o, 9 + o)] + [(0, None, "editor"), (1, 3, "editor")], "organization_id int, user_id int, role string")
    routes = spark.createDataFrame([(r % 3, r, r % 10) for r in range(40)] + [(1, 0, 4), (2, 6, 3), (0, None, 3), (1, None, 5)], "organization_id int, route_id int, assignee int")
    shares = spark.createDataFrame([(u, r, (u + r) % 4 != 0) for u in range(8) for r in (0, 5, 6, 39, 77)] + [(None, 3, True), (3, None, True), (3, 3, True)], "user_id int, route_id int, active boolean")
    got = routing.visible_routes(members, routes, shares)
    r = routes.select("organization_id", "route_id", "assignee")
    plain = members.where("role = 'editor'").join(r, "organization_id").select("user_id", "route_id").union(
        members.where("role = 'field'").join(r, "organization_id").where("assignee = user_id").select("user_id", "route_id")).union(shares.where("active").select("user_id", "route_id")).distinct()
    key = lambda t: tuple((v is None, v or 0) for v in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    assert got._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "Union"


def test_rural_groups_count_neighbours_once(spark):
    """What stands behind the points is worked out once, not at every step."""
    rows = [(1, i, 500_000.0 + 700 * i, 4_790_000.0) for i in range(20)]
    points = zoning.density(spark.createDataFrame(rows, "organization_id int, point_id long, x double, y double"))
    got = zoning.rural_groups(points)
    assert "MapInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.group for r in got.collect()} == {0}


def test_rows_of_routes_look_for_nulls_by_column(monkeypatch):
    """Values and nulls as they are; nothing is asked cell by cell."""
    asked = []
    monkeypatch.setattr(pd, "isna", lambda v, f=pd.isna: asked.append(1) or f(v))
    n = 500
    frame = pd.DataFrame({c: [None if (i + k) % 3 == 0 else i + k for i in range(n)] for k, c in enumerate(routes.Row._fields)}).assign(rank=np.arange(n) % 3)
    asked.clear()
    got = routes._rows(frame)
    assert len(asked) <= len(frame.columns)
    want = [[i % 3 if c == "rank" else None if (i + k) % 3 == 0 else i + k for k, c in enumerate(routes.Row._fields)] for i in range(n)]
    assert [list(r) for r in got] == want


def test_stops_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(domain, "ROWS_A_TASK", 1000)
    stops = domain.view(spark, "/root/testdata/sf0.001", "stops")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert stops.rdd.getNumPartitions() == math.ceil(rows / 1000) > spark.sparkContext.defaultParallelism
    per = stops.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.collect_set("route_id").alias("routes")).collect()
    assert max(r.n for r in per) < 2000 and sum(len(r.routes) for r in per) == len({x for r in per for x in r.routes})


@pytest.mark.parametrize("name", ["matrix_hash", "navigation_links", "stop_fingerprint", "route_status", "navigation_tours", "shared_minimal_view"])
def test_light_tasks_are_filled_before_writers_hold_rows(spark, monkeypatch, name):
    """sf0.001 has some 6,000 stops; up to 200 parts, Spark's default, the writers of a shuffle hold no rows."""
    monkeypatch.setattr(domain, "ROWS_A_TASK", 20)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 200
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    monkeypatch.setattr(domain, "ROWS_A_LIGHT_TASK", 25)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == math.ceil(rows / 25) > 200
    monkeypatch.setattr(domain, "ROWS_A_TASK", 1000)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == math.ceil(rows / 1000)


def test_totals_meet_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(domain, "ROWS_A_TASK", 1000)
    v = lambda name: domain.view(spark, "/root/testdata/sf0.001", name)
    order = v("stops").select("route_id", F.col("sequence").alias("node"), F.col("sequence").alias("position"))
    for frame in (routing.route_totals(order, v("arcs"), v("stops")), routing.tour_cost(order, v("arcs"))):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        moved = [line for line in plan.splitlines() if " Exchange hashpartitioning(" in line and ("route_id" in line or "i#" in line)]
        assert not moved


def test_totals_of_several_orders_repeated_cells_and_missing_arcs(spark):
    order = [("r", w, n, p) for w, nodes in (("there", [1, 2, 3]), ("back", [3, 2, 1])) for p, n in enumerate(nodes)] + [("lone", "there", 1, 0), ("gap", "there", 1, 0), ("gap", "there", 2, 1)]
    order = spark.createDataFrame(order, "route_id string, variant string, node int, position int")
    cells = [("r", 1, 2, 60.0, 1000.0), ("r", 2, 3, 30.0, None), ("r", 2, 3, 31.0, 500.0), ("r", 2, 1, 90.0, 10.0), ("r", None, 2, 7.0, 7.0), ("gap", 2, 1, 1.0, 1.0)]
    cells = spark.createDataFrame(cells, "route_id string, i int, j int, duration_s double, distance_m double")
    stops = spark.createDataFrame([("r", 5), ("r", 6), ("gap", 1), ("lone", 1)], "route_id string, service_minutes int")
    got = {(r.route_id, r.variant): tuple(r)[2:] for r in routing.route_totals(order, cells, stops).collect()}
    assert got == {("r", "there"): (121, 1500, 0.7533, 660), ("r", "back"): (90, 10, 0.303, 660)}
    one = order.where("variant = 'there'").drop("variant")
    assert [tuple(r) for r in routing.route_totals(one, cells, stops).collect()] == [("r", 121, 1500, 0.7533, 660)]
    assert {r.route_id: r.cost for r in routing.tour_cost(one, cells).collect()} == {"r": 0.7533, "lone": 0.0, "gap": 0.0036}


@pytest.mark.parametrize("name", ["sequence_timed_routes", "sequence_routes"])
@pytest.mark.parametrize("limit", ["-1", "10MB"])
def test_arcs_are_not_shuffled_to_be_sequenced(spark, name, limit):
    """Arcs are made where the stops of their route are: only given tables are dealt anew, also where customers and orders cannot be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) <= {"l_orderkey", "o_orderkey", "o_custkey", "c_custkey"}


@pytest.mark.parametrize("limit", [40, 2_000])
def test_merge_plan_is_the_plain_rule_whatever_a_task_holds(spark, monkeypatch, limit):
    """Organizations over the limit are cut into squares, with the unions of the whole: nearest first, ties by name, as many as asked or as fit."""
    monkeypatch.setattr(zoning, "AREA_ZONES", limit)
    monkeypatch.setattr(zoning, "SQUARE_M", 8.0)
    rng = np.random.default_rng(11)
    groups = {1: rng.random((150, 2)) * 900, 2: rng.integers(0, 12, (130, 2)) * 40.0, 3: np.tile(rng.random((1, 2)) * 50, (40, 1)), 4: rng.random((5, 2)), 5: rng.random((90, 2)) * 1e5}
    asked = {1: 60, 2: 1000, 3: 7, 4: 0, 5: 1}
    rows = [(o, f"z{k:03d}", int(rng.integers(1, 7)), *map(float, p)) for o, xy in groups.items() for k, p in enumerate(xy)]
    zones = zoning.written(spark.createDataFrame(rows, "organization_id int, cluster string, n long, x double, y double"), "sizes")
    surplus = spark.createDataFrame(list(asked.items()), "organization_id int, surplus long")
    got = {(r.organization_id, r.cluster): r.merged for r in zoning.merge_plan(zones, surplus, 12).collect()}
    for o, m in asked.items():
        own = [r for r in rows if r[0] == o]
        into = zoning.merge_nearest(np.array([r[2] for r in own]), np.array([r[3:] for r in own]), 12, m)
        assert [got[r[:2]] for r in own] == [own[k][1] for k in into]


def test_editors_meet_routes_in_as_many_tasks_as_pairs(spark, monkeypatch, tmp_path):
    """Routes are few bytes, so the planner would put all of an organization's pairs into one task; runs of routes make the pairs' file small."""
    monkeypatch.setattr(routing, "PAIRS_A_PART", 1 << 11, raising=False)
    monkeypatch.setattr(routing, "PAIRS_A_TASK", 1 << 14, raising=False)
    members = spark.range(60).select((F.col("id") % 2).alias("organization_id"), F.col("id").alias("user_id"), F.lit("editor").alias("role"))
    routes = spark.range(5000).select((F.col("id") % 2).alias("organization_id"), (F.col("id") * 7).alias("route_id"), F.lit(0).cast("long").alias("assignee"))
    shares = spark.createDataFrame([], "user_id long, route_id long, active boolean")
    got = routing.visible_routes(members, routes, shares)
    got.write.parquet(str(tmp_path / "pairs"))
    back = spark.read.parquet(str(tmp_path / "pairs"))
    assert back.count() == back.distinct().count() == 150_000 == back.where("user_id < 60 and route_id % 7 = 0 and route_id < 35000 and (user_id + route_id) % 2 = 0").count()
    files = [f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet") if f.stat().st_size > 2000]
    assert len(files) > 5 and sum(files) < 150_000


def test_merge_plan_with_nothing_to_join(spark):
    zones = zoning.written(spark.createDataFrame([(1, "a", 9, 0.0, 0.0), (1, "b", 8, 1.0, 1.0)], "organization_id int, cluster string, n long, x double, y double"), "sizes")
    for surplus in ([(1, 1)], [(1, 0)], [(2, 1)], []):
        got = zoning.merge_plan(zones, spark.createDataFrame(surplus, "organization_id int, surplus long"), 12).collect()
        assert sorted((r.cluster, r.merged) for r in got) == ([("a", "a"), ("b", "b")] if surplus[:1] and surplus[0][0] == 1 else [])
