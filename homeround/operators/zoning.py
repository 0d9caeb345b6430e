"""Zoning: point features, clusters, proposals and their acceptance."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeround.functions.geo import DEPOT, haversine_m, project_utm30n
from homeround.operators import joining
from homeround.operators.graphs import components
from homeround.operators.ranges import numbered
from homeround.storage import forget, written

DENSITY_M, URBAN_DENSITY = 500.0, 4
RURAL_EPS_M, WIDE_M = 2500.0, 12_000.0
SPEED_KMH = {"urban": 20.0, "rural": 35.0}
#: Side of the smallest square, and how many times four squares a side make the next larger one.
SQUARE_M, SQUARE_LEVELS = 75.0, 6
#: How often squares are quartered in each direction while many of their places may be near.
SQUARE_DEPTH = 6
AREA_POINTS, AREA_ZONES, AREA_BORDER = 2_000, 2_000, 300
#: Rows that a task gets when areas are dealt to tasks: a few areas.
ROWS_A_TASK = {"points": 1 << 13, "zones": 1 << 11}


def confirmed_points(addresses: DataFrame) -> DataFrame:
    """Located active addresses of organizations that have two or more of them."""
    kept = addresses.where(
        F.col("is_active") & F.col("geocode_status").isin("matched", "manual") & F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    )
    enough = kept.groupBy("organization_id").agg(F.count("*").alias("n")).where("n >= 2")
    return kept.join(enough.select("organization_id"), "organization_id", "left_semi")


def projected(points: DataFrame) -> DataFrame:
    x, y = project_utm30n(F.col("longitude"), F.col("latitude"))
    return points.withColumns({"x": x, "y": y})


def _boxes(places: DataFrame, side: float, name: str) -> DataFrame:
    """Squares of a grid that hold places: their key, the box around their places, and how many there are."""
    low, high = lambda c: F.min(c).alias(f"{name}_{c}0"), lambda c: F.max(c).alias(f"{name}_{c}1")
    return places.groupBy("organization_id", F.floor(F.col("x") / side).alias(f"{name}x"), F.floor(F.col("y") / side).alias(f"{name}y")).agg(
        low("x"), high("x"), low("y"), high("y"), F.count("*").alias(f"{name}_n")
    )


def _apart() -> tuple[Column, Column]:
    """Squares of the least and the greatest distance that places of boxes a and b can have: rounding keeps the order of differences, squares and sums."""
    least, most = [], []
    for c in ("x", "y"):
        left, right = F.col(f"b_{c}0") - F.col(f"a_{c}1"), F.col(f"a_{c}0") - F.col(f"b_{c}1")
        least.append(F.pow(F.greatest(left, right, F.lit(0.0)), 2))
        most.append(F.pow(F.greatest(F.col(f"b_{c}1") - F.col(f"a_{c}0"), F.col(f"a_{c}1") - F.col(f"b_{c}0")), 2))
    return least[0] + least[1], most[0] + most[1]


def linked_squares(places: DataFrame, radius: float) -> DataFrame:
    """(organization, ax, ay, bx, by): squares of side ``radius`` / 1.4143, of which two places, one in each, are within ``radius``.

    Places of one square are all within it. Two squares are compared by the boxes around their places, first whole, then by smaller squares, and
    place by place only where boxes that hold few of them straddle the radius; a pair found near at any size is asked about no more. So rows
    grow with the squares that hold places, not with pairs of places.
    """
    side, limit = radius / 1.4143, radius * radius
    whole = ["organization_id", "ax", "ay", "bx", "by"]
    a, b = _boxes(places, side, "a"), _boxes(places, side, "b")
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    around = F.explode(F.array(*[F.struct((F.col("ax") + i).alias("bx"), (F.col("ay") + j).alias("by")) for i, j in steps]))
    open_ = a.withColumn("to", around).select("*", "to.bx", "to.by").drop("to").join(b, ["organization_id", "bx", "by"])
    open_ = open_.withColumns({f"{n}{c}_now": F.col(f"{n}{c}") for n in "ab" for c in "xy"})
    found, kept = None, []
    for level in range(SQUARE_DEPTH):
        least, most = _apart()
        asked = written(open_.where(least <= limit).withColumn("sure", most <= limit), f"squares-{level}")
        kept.append(asked)
        sure = asked.where("sure").select(*whole).distinct()
        rest = asked.where("NOT sure").join(sure, whole, "left_anti")
        now = [f"{n}{c}_now" for n in "ab" for c in "xy"]
        finest = level == SQUARE_DEPTH - 1
        few = rest if finest else rest.where(F.col("a_n") * F.col("b_n") <= 64)
        at = lambda c: F.floor(F.col(c) / (side / 4**level))  # noqa: B023, E731
        ends = [places.select("organization_id", at("x").alias(f"{n}x_now"), at("y").alias(f"{n}y_now"), F.col("x").alias(f"{n}_px"), F.col("y").alias(f"{n}_py")) for n in "ab"]
        seen = few.select(*whole, *now).join(ends[0], ["organization_id", "ax_now", "ay_now"]).join(ends[1], ["organization_id", "bx_now", "by_now"])
        near = seen.where(F.pow(F.col("a_px") - F.col("b_px"), 2) + F.pow(F.col("a_py") - F.col("b_py"), 2) <= limit).select(*whole).distinct()
        links = written(sure.union(near), f"links-{level}")
        found = links if found is None else found.union(links)
        if finest:
            break
        many = rest.where(F.col("a_n") * F.col("b_n") > 64).join(links, whole, "left_anti").select(*whole, *now)
        for n in "ab":
            parts = _boxes(places, side / 4 ** (level + 1), n).withColumns({f"{n}x_now": F.floor(F.col(f"{n}x") / 4), f"{n}y_now": F.floor(F.col(f"{n}y") / 4)})
            parts = parts.withColumnsRenamed({f"{n}x": f"{n}x_part", f"{n}y": f"{n}y_part"})
            many = many.join(parts, ["organization_id", f"{n}x_now", f"{n}y_now"])
        open_ = many.drop(*now).withColumnsRenamed({f"{n}{c}_part": f"{n}{c}_now" for n in "ab" for c in "xy"})
        if many.isEmpty():
            break
    forget(*kept)
    return found


def near_counts(x: np.ndarray, y: np.ndarray, weight: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
    """Weight of the places within ``radius`` of each place of ``own``. Places are cut into strips sorted by x: of a strip the stretch that is surely inside is a
    difference of running sums, and only the two rims are compared. Strips are as high as makes both cost about the same: root of the density work a place.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    area = max(np.ptp(x), radius / 8) * max(np.ptp(y), radius / 8)
    height = float(np.clip(np.sqrt(50 * area / len(x)), radius / 512, radius))
    strip = np.floor((y - y.min()) / height)
    pace = np.ptp(x) + 8 * radius  # strips stand apart in one sorted key
    x0, y0 = x.min(), y.min()
    key = strip * pace + (x - x0)
    order = np.argsort(key)
    key, sx, sy = key[order], x[order], y[order]
    total = np.append(0, np.cumsum(weight[order]))
    out, limit = np.zeros(len(own), np.int64), radius * radius
    px, py, ps = x[own], y[own], strip[own]
    slack = 1e-6 * radius
    reach = int(radius / height) + 2
    for step in range(-reach, reach + 1):
        s = ps + step
        low = y0 + s * height - py
        high = low + height
        least = np.maximum(0, np.maximum(low, -high)) - slack
        most = np.maximum(np.abs(low), np.abs(high)) + slack
        here = np.flatnonzero((least < radius) & (s >= 0) & (s <= strip.max()))
        if not len(here):
            continue
        outer = np.sqrt(limit - np.maximum(least[here], 0) ** 2) + slack
        inner = np.sqrt(np.maximum(limit - most[here] ** 2, 0)) - slack
        at = s[here] * pace + (px[here] - x0)
        first, last = np.searchsorted(key, at - outer), np.searchsorted(key, at + outer, "right")
        none = inner <= 0
        start, stop = np.searchsorted(key, at - inner), np.searchsorted(key, at + inner, "right")
        start, stop = np.where(none, last, start), np.where(none, last, stop)
        out[here] += total[stop] - total[start]
        for a, b in ((first, start), (stop, last)):
            size = b - a
            cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), 4_000_000)[1:])
            for part in np.split(np.arange(len(here)), cuts):
                n = size[part]
                rim = np.repeat(a[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
                who = np.repeat(here[part], n)
                near = (px[who] - sx[rim]) ** 2 + (py[who] - sy[rim]) ** 2 <= limit
                out += np.bincount(who[near], weights=(total[rim + 1] - total[rim])[near], minlength=len(out)).astype(np.int64)
    return out


def density(points: DataFrame, radius: float = DENSITY_M) -> DataFrame:
    """Number of points within ``radius``, itself included.

    Points at one place are counted once, with weight. Places are dealt to tiles of twice the radius, and to the neighbours whose rim they stand in: one shuffle,
    a tile of places a task.
    """
    side = 2 * radius
    places = points.groupBy("organization_id", "x", "y").agg(F.count("*").alias("w"))
    tile = lambda c, d=0.0: F.floor((F.col(c) + d) / side)
    halo = radius * (1 + 1e-6)
    around = F.explode(F.array_distinct(F.array(*[F.struct(tile("x", i).alias("tx"), tile("y", j).alias("ty")) for i in (0.0, -halo, halo) for j in (0.0, -halo, halo)])))
    dealt = places.withColumn("t", around).select("*", "t.tx", "t.ty", ((F.col("t.tx") == tile("x")) & (F.col("t.ty") == tile("y"))).alias("own")).drop("t")
    kind = places.schema["organization_id"].dataType.simpleString()

    def count(part: pd.DataFrame) -> pd.DataFrame:
        """Whole tiles, one after the other."""
        x, y, w, mine = (part[c].to_numpy() for c in ("x", "y", "w", "own"))
        out = np.zeros(len(part), np.int64)
        cut = np.flatnonzero(np.any([part[c].to_numpy()[1:] != part[c].to_numpy()[:-1] for c in ("organization_id", "tx", "ty")], axis=0)) + 1
        for a, b in zip([0, *cut], [*cut, len(part)]):
            own = np.flatnonzero(mine[a:b])
            if len(own) and b - a <= 64:
                near = (x[a:b][own, None] - x[None, a:b]) ** 2 + (y[a:b][own, None] - y[None, a:b]) ** 2 <= radius * radius
                out[a + own] = near @ w[a:b]
            elif len(own):
                out[a + own] = near_counts(x[a:b], y[a:b], w[a:b], own, radius)
        return part.assign(density=out)[mine][["organization_id", "x", "y", "density"]]

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held):
                last = np.all([held[c] == held[c].iloc[-1] for c in ("organization_id", "tx", "ty")], axis=0)  # it may go on
                if not last.all():
                    yield count(held[~last])
                    held = held[last]
        if held is not None and len(held):
            yield count(held)

    tiles = dealt.repartition("organization_id", "tx", "ty").sortWithinPartitions("organization_id", "tx", "ty")
    by_place = tiles.mapInPandas(run, f"organization_id {kind}, x double, y double, density long")
    return points.join(by_place, ["organization_id", "x", "y"])


def kind_of(density: Column, hint: Column) -> Column:
    return F.when(hint.isin("urban", "rural"), hint).when(density >= URBAN_DENSITY, "urban").otherwise("rural")


def catalogue_hint(points: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The row's own hint, else the municipality catalogue: exact name first, then without case."""
    exact = catalogue.groupBy("municipality").agg(F.min("kind").alias("__a"))
    loose = catalogue.groupBy(F.lower("municipality").alias("__m")).agg(F.min("kind").alias("__b"))
    found = points.join(exact, "municipality", "left").join(loose, F.lower(points["municipality"]) == F.col("__m"), "left")
    return found.withColumn("municipality_kind", F.coalesce("municipality_kind", "__a", "__b")).drop("__a", "__b", "__m")


def features(points: DataFrame) -> DataFrame:
    """Projection, density, kind, distance and minutes to the depot."""
    rows = density(written(projected(points), "projected")).withColumn("kind", kind_of(F.col("density"), F.col("municipality_kind")))
    far = haversine_m(F.col("longitude"), F.col("latitude"), F.lit(DEPOT[0]), F.lit(DEPOT[1]))
    speed = F.when(F.col("kind") == "urban", SPEED_KMH["urban"]).otherwise(SPEED_KMH["rural"])
    return rows.withColumns({"depot_distance_m": far, "depot_time_minutes": far / 1000 / speed * 60})


def rural_groups(points: DataFrame, eps: float = RURAL_EPS_M) -> DataFrame:
    """(organization, point, group): connected components of points within ``eps``, named by their smallest point; a lone point has a null group.

    The points of a small square are one group by construction, so components are found over squares.
    """
    points = written(points.select("organization_id", "point_id", "x", "y"), "rural")  # read at every step; the density behind it is not cheap
    side = eps / 1.4143
    square = ["organization_id", "ax", "ay"]
    at = points.select("organization_id", "point_id", F.floor(F.col("x") / side).alias("ax"), F.floor(F.col("y") / side).alias("ay"))
    squares = written(at.groupBy(*square).agg(F.min("point_id").alias("point_id"), F.count("*").alias("n")), "squares")
    links = linked_squares(written(points.select("organization_id", "x", "y").distinct(), "places"), eps)
    node = F.struct("organization_id", "point_id")
    ends = links.join(squares.select(*square, node.alias("a")), square).join(squares.select("organization_id", F.col("ax").alias("bx"), F.col("ay").alias("by"), node.alias("b")), ["organization_id", "bx", "by"])
    found = components(ends.select("a", "b"))
    named = squares.withColumn("node", node).join(found, "node", "left")
    group = F.coalesce("component.point_id", F.when(F.col("n") > 1, F.col("point_id")))
    return at.join(named.select(*square, group.alias("group")), square).select("organization_id", "point_id", "group")


def admin_seeds(points: DataFrame, max_visits: int) -> DataFrame:
    """(organization, point, seed): municipality, else postal code, if it fits and is under 12 km wide; leftovers have a null seed.

    The size is tested first, so pairs are only formed in groups of at most ``max_visits``.
    """

    def fitting(rows: DataFrame, keys: list[str]) -> DataFrame:
        sized = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        small = rows.join(sized.where(F.col("n") <= max_visits), keys)
        other = small.select(*keys, F.col("x").alias("bx"), F.col("y").alias("by"))
        apart = F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2))
        wide = small.join(other, keys).groupBy(*keys).agg(F.max(apart).alias("diameter"))
        return sized.join(wide, keys, "left").select(*keys, "n", (F.coalesce(F.col("diameter"), F.lit(0.0)) <= WIDE_M).alias("tight"))

    towns = ["organization_id", "municipality"]
    by_town = points.join(fitting(points, towns), towns, "left").withColumnRenamed("n", "town_n").withColumnRenamed("tight", "town_ok")
    large = by_town.where(F.col("town_n") > max_visits)
    codes = [*towns, "postal_code"]
    by_code = by_town.join(fitting(large, codes), codes, "left")
    seed = (
        F.when((F.col("town_n") <= max_visits) & F.col("town_ok"), F.col("municipality"))
        .when((F.col("town_n") > max_visits) & (F.col("n") <= max_visits) & F.col("tight"), F.concat_ws("/", "municipality", "postal_code"))
    )
    return by_code.select("organization_id", "point_id", seed.alias("seed"))


def capacity_clusters(points: np.ndarray, k: int, cap: int, rounds: int = 20) -> np.ndarray:
    """Labels of Lloyd's clusters with at most ``cap`` members: points nearest to a centre choose first. Same input, same labels."""
    n = len(points)
    k = max(k, -(-n // cap), 1)
    order = np.lexsort((points[:, 1], points[:, 0]))
    centres = points[order[np.linspace(0, n - 1, k).astype(int)]].astype(float)
    for _ in range(rounds):
        nearest = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.stack([points[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    apart = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    labels, room = np.full(n, -1), np.full(k, cap)
    for i in np.lexsort((np.arange(n), apart.min(axis=1))):
        j = int(np.where(room > 0, apart[i], np.inf).argmin())
        labels[i], room[j] = j, room[j] - 1
    return labels


def areas(rows: DataFrame, keys: list[str], limit: int, id_col: str, weight: Column | int = 1) -> DataFrame:
    """``rows`` with ``area``, of which none weighs much over ``limit`` however large a group of ``keys`` is.

    The area is the whole group if that is light enough, else the largest square of the grid that is. Rows of a smallest
    square that is still too heavy are dealt by the hash of ``id_col``. Rows without coordinates are left out.
    """
    x, y = F.floor(F.col("x") / SQUARE_M).alias("__x"), F.floor(F.col("y") / SQUARE_M).alias("__y")
    placed = rows.where("x is not null and y is not null").select("*", x, y)
    squares = placed.groupBy(*keys, "__x", "__y").agg(F.sum(F.lit(weight) if isinstance(weight, int) else weight).alias("__n"))
    larger = [F.struct(F.lit(k).alias("level"), F.floor(F.col("__x") / 4**k).alias("gx"), F.floor(F.col("__y") / 4**k).alias("gy")) for k in range(SQUARE_LEVELS)]
    whole = F.struct(F.lit(SQUARE_LEVELS).alias("level"), F.lit(0).cast("long").alias("gx"), F.lit(0).cast("long").alias("gy"))
    nested = squares.select("*", F.explode(F.array(*larger, whole)).alias("__s"))
    sums = nested.groupBy(*keys, "__s").agg(F.sum("__n").alias("__total"))
    fits = F.max(F.when(F.col("__total") <= limit, F.col("__s"))).alias("__s")
    chosen = nested.join(sums, [*keys, "__s"]).groupBy(*keys, "__x", "__y").agg(fits, F.max("__n").alias("__n"))
    dealt = F.pmod(F.xxhash64(id_col), F.ceil(F.col("__n") * 2 / limit))
    heavy = F.concat_ws(":", F.lit("-"), "__x", "__y", dealt)
    name = F.when(F.col("__s").isNull(), heavy).otherwise(F.concat_ws(":", "__s.level", "__s.gx", "__s.gy"))
    return placed.join(chosen, [*keys, "__x", "__y"]).withColumn("area", name).drop("__x", "__y", "__s", "__n")


def _tasks(table: DataFrame, kind: str) -> int:
    """How many tasks the areas of a written table ask for. The planner goes by bytes, of which an area has few, and would put hundreds into one task."""
    return max(1, math.ceil(table.count() / ROWS_A_TASK[kind]))


def _split(rows: DataFrame, keys: list[str], max_visits: int, tasks: int, least: str | None = None) -> DataFrame:
    """``rows`` with ``cluster``: each group of ``keys``, which is small, in clusters of at most ``max_visits``; ``least`` names how many at least."""
    kept = ["organization_id", "kind", "point_id", "x", "y"]
    fields = [rows.schema[c] for c in kept]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", cluster string"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("point_id").reset_index(drop=True)
        name = ":".join(str(part[k].iloc[0]) for k in keys[1:])
        labels = capacity_clusters(part[["x", "y"]].to_numpy(), int(part[least].iloc[0]) if least else 1, max_visits)
        part["cluster"] = [f"{name}:{j}" for j in labels]
        return part[[*kept, "cluster"]]

    return rows.select(*dict.fromkeys([*kept, *keys, *([least] if least else [])])).repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, schema)


def cluster_points(features: DataFrame, max_visits: int) -> DataFrame:
    """Capacity-limited clusters per (organization, kind): (organization, kind, point, x, y, cluster). More than 2,000 points are cut into areas first."""
    keys = ["organization_id", "kind"]
    points = written(features.select(*keys, "point_id", "x", "y"), "points")  # read twice; the density behind it is not cheap
    return _split(areas(points, keys, AREA_POINTS, "point_id"), [*keys, "area"], max_visits, _tasks(points, "points"))


def _zones(members: DataFrame) -> DataFrame:
    return members.groupBy("organization_id", "cluster").agg(F.count("*").alias("n"), F.bround(F.avg("x"), 3).alias("x"), F.bround(F.avg("y"), 3).alias("y"))


def split_plan(zones: DataFrame, missing: DataFrame) -> DataFrame:
    """(organization, cluster, pieces): into how many pieces each zone goes so that ``missing`` zones are made by halving the largest piece again and again.

    A zone of n members has n - 1 halvings, the i-th of a piece of n / 2^floor(log2 i). The largest of an organization are
    found from a histogram of piece sizes; only those of the last size taken are ranked.
    """
    halvings = zones.where("n > 1").join(missing, "organization_id").select("organization_id", "cluster", "missing", F.explode(F.expr("transform(sequence(1, int(n) - 1), i -> n / pow(2, floor(log2(i))))")).alias("piece"))
    per = halvings.groupBy("organization_id", "cluster", "missing", "piece").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("organization_id").orderBy(F.desc("piece")))
    rest = per.groupBy("organization_id", "missing", "piece").agg(F.sum("c").alias("c")).withColumn("rest", F.col("missing") - upto + F.col("c")).where("rest > 0")
    per = per.join(rest.select("organization_id", "piece", F.col("c").alias("all"), "rest"), ["organization_id", "piece"])
    whole = per.where("all <= rest").select("organization_id", "cluster", "c")
    before = F.sum("c").over(Window.partitionBy("organization_id", "piece").orderBy("cluster")) - F.col("c")
    part = per.where("all > rest").select("organization_id", "cluster", F.least("c", F.col("rest") - before).alias("c")).where("c > 0")
    return whole.union(part).groupBy("organization_id", "cluster").agg((F.sum("c") + 1).alias("pieces"))


def merge_nearest(n: np.ndarray, xy: np.ndarray, cap: int, merges: int) -> np.ndarray:
    """For each zone the zone it ends in, after at most ``merges`` unions of the nearest two that fit together."""
    n, xy, into = n.astype(float), xy.astype(float).copy(), np.arange(len(n))
    apart = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    apart[np.tril_indices(len(n))] = np.inf
    for _ in range(merges):
        open_ = np.where(n[:, None] + n[None] <= cap, apart, np.inf)
        i, j = np.unravel_index(open_.argmin(), open_.shape) if open_.size else (0, 0)
        if not open_.size or not np.isfinite(open_[i, j]):
            break
        xy[i] = (n[i] * xy[i] + n[j] * xy[j]) / (n[i] + n[j])
        n[i] += n[j]
        into[into == j] = i
        apart[j], apart[:, j] = np.inf, np.inf
        far = ((xy - xy[i]) ** 2).sum(axis=1)
        gone = into != np.arange(len(n))
        far[gone] = np.inf
        apart[i, i + 1 :], apart[:i, i] = far[i + 1 :], far[:i]
    return into


def _squared(rows: DataFrame, limit: int, turn: int) -> DataFrame:
    """``rows`` with ``area``, a square of few zones, and ``edge``, the way to its end; squares lie elsewhere at every turn. Inside no square (too many zones in the smallest) it is 0."""
    off = [SQUARE_M * 4 ** (SQUARE_LEVELS - 1) * (turn * f % 1) for f in (0.6180339887, 0.7548776662)]
    moved = rows.withColumns({"__px": F.col("x"), "__py": F.col("y"), "x": F.col("x") + off[0], "y": F.col("y") + off[1]})
    name = F.split("area", ":")
    side = SQUARE_M * F.pow(F.lit(4.0), F.try_element_at(name, F.lit(1)).try_cast("int"))
    ways = [w for c, k in (("x", 2), ("y", 3)) for low in [F.try_element_at(name, F.lit(k)).try_cast("long") * side] for w in (F.col(c) - low, low + side - F.col(c))]
    inside = F.greatest(F.least(*ways) - 1e-6, F.lit(0.0))
    edge = F.when(name[0] == str(SQUARE_LEVELS), F.lit(math.inf)).when(name[0] == "-", F.lit(0.0)).otherwise(inside)
    return areas(moved, ["organization_id"], limit, "num").withColumn("edge", edge).withColumns({"x": F.col("__px"), "y": F.col("__py")}).drop("__px", "__py")


def merge_plan(zones: DataFrame, surplus: DataFrame, max_visits: int) -> DataFrame:
    """(organization, cluster, merged): ``surplus`` unions of an organization's nearest zones that fit, as :func:`merge_nearest` makes them, however many zones there are.

    Squares make the unions that are sure whatever happens elsewhere (:mod:`joining`), at every turn other squares, until no two zones fit; the first
    ``surplus`` of all are the plan. So where squares lie and what a task holds (``AREA_ZONES``) has no part in the result. ``zones`` is counted, so it is best a written table.
    """
    org = "organization_id"
    kind = zones.schema[org].dataType.simpleString()
    asked = written(numbered(zones.join(surplus, org), [org], ["cluster"], "num"), "asked")
    schema = f"{org} {kind}, num long, n double, x double, y double, born double, code long, nth long, history array<long>"
    none = {"born": F.lit(0.0), "code": F.lit(-1).cast("long"), "nth": F.lit(0).cast("long"), "history": F.array().cast("array<long>")}
    state = asked.where("surplus > 0 and x is not null and y is not null").select(org, F.col("num").cast("long"), F.col("n").cast("double"), "x", "y", *[c.alias(k) for k, c in none.items()])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("num").reset_index(drop=True)
        num, n, born, code, nth, edge = (part[c].to_numpy(copy=True) for c in ("num", "n", "born", "code", "nth", "edge"))
        xy, history, stays = part[["x", "y"]].to_numpy(copy=True), [list(h) for h in part["history"]], np.ones(len(part), bool)
        for i, j, event in joining.unions(num, n, xy, born, code, nth, edge, max_visits):
            history[i] += history[j] + event
            stays[j] = False
        out = pd.DataFrame({org: part[org], "num": num, "n": n, "x": xy[:, 0], "y": xy[:, 1], "born": born, "code": code, "nth": nth, "history": history})
        return out[stays]

    finished, limit, turn = [], AREA_ZONES, 0
    while True:
        sizes = state.groupBy(org, "n").agg(F.count("*").alias("c")).groupBy(org).agg(F.array_sort(F.collect_list(F.struct("n", "c"))).alias("__sizes"))
        least = F.col("__sizes")[0]
        other = F.when((F.col("n") == least["n"]) & (least["c"] == 1), F.try_element_at("__sizes", F.lit(2))["n"]).otherwise(least["n"])
        marked = state.join(sizes, org).withColumn("__open", F.coalesce(F.col("n") + other <= max_visits, F.lit(False))).drop("__sizes")
        finished.append(marked.where("not __open and size(history) > 0").drop("__open"))
        open_ = written(marked.where("__open").drop("__open"), "open")
        left = open_.count()
        if not left:
            break
        dealt = _squared(open_, limit, turn).repartition(max(1, math.ceil(left / ROWS_A_TASK["zones"])), org, "area")
        state = written(dealt.groupBy(org, "area").applyInPandas(run, schema), "unions")
        forget(open_)
        if state.count() > 0.9 * left:  # these squares decide little
            limit *= 2
        turn += 1

    ends = functools.reduce(DataFrame.union, finished)
    each = ends.select(org, "history", F.explode(F.filter(F.sequence(F.lit(0), F.size("history"), F.lit(joining.EVENT)), lambda k: k < F.size("history"))).alias("k"))
    when = ["__at", "__pair", "__nth"]
    events = numbered(each.select(org, *[F.col("history")[F.col("k") + i].alias(c) for i, c in enumerate(when)]), [org], when, "__rank")
    last = events.join(surplus.select(org, "surplus"), org).where("__rank = surplus").select(org, *when)

    def land(parts):
        for part in parts:
            found = [(o, *pair) for o, root, history, *until in part[[org, "num", "history", *when]].itertuples(index=False) for pair in zip(*joining.landed(root, history, tuple(until)))]
            yield pd.DataFrame(found, columns=[org, "num", "into"])

    known = ends.join(last, org, "left").select(org, "num", "history", *[F.coalesce(c, F.lit((1 << 63) - 1)).alias(c) for c in when])
    moved = known.mapInPandas(land, f"{org} {kind}, num int, into int").where("num <> into")
    names = asked.select(org, F.col("num").alias("into"), F.col("cluster").alias("merged"))
    plan = asked.join(moved.join(names, [org, "into"]), [org, "num"], "left")
    return plan.select(org, "cluster", F.coalesce("merged", "cluster").alias("merged")).repartition(_tasks(zones, "zones"), org, "cluster")


def fit_target(members: DataFrame, targets: DataFrame, max_visits: int) -> DataFrame:
    """Zones of one kind brought to the ``k`` zones an organization asks for: the largest split, or the nearest that fit joined. Capacity wins."""
    zones = written(_zones(members), "sizes")
    gap = zones.groupBy("organization_id").agg(F.count("*").alias("c")).join(targets, "organization_id").withColumn("gap", F.col("k") - F.col("c"))
    pieces = split_plan(zones, gap.where("gap > 0").select("organization_id", F.col("gap").alias("missing")))
    merged = merge_plan(zones, gap.where("gap < 0").select("organization_id", (-F.col("gap")).alias("surplus")), max_visits)
    rows = members.join(pieces, ["organization_id", "cluster"], "left").join(merged, ["organization_id", "cluster"], "left")
    cut = _split(rows.where("pieces > 1"), ["organization_id", "kind", "cluster"], max_visits, _tasks(members, "points"), "pieces")
    return rows.where("pieces is null").select(*cut.columns[:-1], F.coalesce("merged", "cluster").alias("cluster")).unionByName(cut)


def propose_zones(features: DataFrame, max_visits: int, target: int | None = None) -> DataFrame:
    """(organization, kind, point, x, y, cluster) of all located points; lone rural points are outliers with a null cluster.

    Rural points group by neighbourhood, urban ones by municipality or postal code where these fit, the others by distance;
    the kinds never mix. ``target`` zones an organization are aimed at by its urban zones.
    """
    kept = ["organization_id", "kind", "point_id", "x", "y"]
    located = written(features.where("x is not null and y is not null"), "features")
    rural = located.where("kind <> 'urban'")
    groups = written(rural.select(*kept).join(rural_groups(rural), ["organization_id", "point_id"]), "groups")
    sized = groups.groupBy("organization_id", "group").agg(F.count("*").alias("n"))
    grouped = groups.where("group is not null").join(sized, ["organization_id", "group"])
    small = grouped.where(F.col("n") <= max_visits).select(*kept, F.concat(F.lit("r:"), "group").alias("cluster"))
    large = areas(grouped.where(F.col("n") > max_visits), ["organization_id", "kind", "group"], AREA_POINTS, "point_id")
    urban = located.where("kind = 'urban'")
    seeded = written(urban.select(*kept).join(admin_seeds(urban, max_visits), ["organization_id", "point_id"]), "seeded")
    zones = seeded.where("seed is not null").select(*kept, F.concat(F.lit("s:"), "seed").alias("cluster")).unionByName(cluster_points(seeded.where("seed is null"), max_visits))
    country = written(small.unionByName(_split(large, ["organization_id", "kind", "group", "area"], max_visits, _tasks(groups, "points"))), "country")
    if target is not None:
        zones = written(zones, "zones")
        there = country.groupBy("organization_id").agg(F.count_distinct("cluster").alias("there"))
        floor = zones.groupBy("organization_id").agg(F.ceil(F.count("*") / max_visits).alias("floor"))
        k = F.greatest("floor", F.lit(target) - F.coalesce("there", F.lit(0)))
        zones = written(fit_target(zones, floor.join(there, "organization_id", "left").select("organization_id", k.alias("k")), max_visits), "fitted")
    lone = groups.where("group is null").select(*kept, F.lit(None).cast("string").alias("cluster"))
    return zones.unionByName(country).unionByName(lone)


def label_clusters(members: DataFrame) -> DataFrame:
    """Members, centroid and a label numbered per kind: ordered by kind, centroid, smallest member."""
    per = members.groupBy("organization_id", "kind", "cluster").agg(
        F.count("*").alias("n"), F.bround(F.avg("x"), 3).alias("cx"), F.bround(F.avg("y"), 3).alias("cy"), F.min("point_id").alias("first_member")
    )
    placed = numbered(per, ["organization_id", "kind"], ["cx", "cy", "first_member"], "__number")
    return placed.withColumn("label", F.concat_ws("-", "kind", F.col("__number") - 1)).drop("__number")


def cluster_summary(members: DataFrame) -> DataFrame:
    """Per cluster: members, centroid in degrees and metres, and kind, mixed where both occur. Rows without cluster are outliers and take no part."""
    mean = lambda c, n: F.bround(F.avg(c), n)
    return members.where("cluster is not null").groupBy("organization_id", "cluster").agg(
        F.count("*").alias("n"), mean("longitude", 6).alias("longitude"), mean("latitude", 6).alias("latitude"), mean("x", 3).alias("x"), mean("y", 3).alias("y"),
        F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed").alias("kind"),
    )


def proposal_summary(members: DataFrame) -> DataFrame:
    """Per organization: points, clusters, outliers and the size of the largest cluster (0 if all are outliers)."""
    sizes = members.groupBy("organization_id", "cluster").agg(F.count("*").alias("n"))
    inside = F.col("cluster").isNotNull()
    return sizes.groupBy("organization_id").agg(
        F.sum("n").alias("n_points"), F.count_if(inside).alias("n_clusters"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"), F.coalesce(F.max(F.when(inside, F.col("n"))), F.lit(0)).alias("max_size"),
    )


def hull_wkt(xs: np.ndarray, ys: np.ndarray) -> str | None:
    """Convex hull by monotone chain as POLYGON text; null unless it has three corners."""
    pts = sorted(set(zip(xs.tolist(), ys.tolist())))

    def half(points):
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1]) if len(pts) > 2 else []
    return "POLYGON ((" + ", ".join(f"{a!r} {b!r}" for a, b in [*ring, ring[0]]) + "))" if len(ring) > 2 else None


def zone_hulls(members: DataFrame) -> DataFrame:
    org = members.schema["organization_id"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        row = part.iloc[0]
        return pd.DataFrame({"organization_id": [row.organization_id], "cluster": [row.cluster], "boundary": [hull_wkt(part.x.to_numpy(), part.y.to_numpy())]})

    return members.groupBy("organization_id", "cluster").applyInPandas(run, f"organization_id {org}, cluster string, boundary string")


def occupancy(zones: DataFrame, assignments: DataFrame) -> DataFrame:
    """Zones with their current members, 0 where none, and whether that is over capacity."""
    counts = assignments.where("valid_to is null").groupBy("organization_id", "zone_id").agg(F.count("*").alias("occupied"))
    return zones.join(counts, ["organization_id", "zone_id"], "left").withColumn("occupied", F.coalesce("occupied", F.lit(0))).withColumn("over_capacity", F.col("occupied") > F.col("max_visits"))


def accept_proposal(current: DataFrame, proposed: DataFrame, reset_manual: bool = False) -> DataFrame:
    """What happens to each (organization, patient): keep, preserve_manual, open, move or close."""
    keys = ["organization_id", "patient_id"]
    now = current.select(*keys, F.col("zone_id").alias("old_zone"), "source")
    both = now.join(proposed.select(*keys, F.col("zone_id").alias("new_zone")), keys, "full_outer")
    manual = (F.col("source") == "manual") & F.lit(not reset_manual)
    action = (
        F.when(F.col("old_zone").isNull(), "open")
        .when(manual, "preserve_manual")
        .when(F.col("new_zone").isNull(), "close")
        .when((F.col("old_zone") == F.col("new_zone")) & (F.col("source") == "cluster"), "keep")
        .otherwise("move")
    )
    return both.withColumn("action", action)


def apply_proposal(history: DataFrame, proposed: DataFrame, at: Column, reset_manual: bool = False) -> DataFrame:
    """The assignment history after a proposal is accepted at ``at``: rows of moved and left patients closed, new ones opened."""
    keys = ["organization_id", "patient_id"]
    actions = accept_proposal(history.where("valid_to is null"), proposed, reset_manual)
    ends = actions.where(F.col("action").isin("move", "close")).select(*keys, F.lit(True).alias("__end"))
    kind = history.schema["valid_to"].dataType
    rows = history.join(ends, keys, "left").withColumn("valid_to", F.coalesce("valid_to", F.when(F.col("__end"), at.cast(kind)))).drop("__end")
    opened = actions.where(F.col("action").isin("move", "open")).select(
        *keys, F.col("new_zone").alias("zone_id"), at.cast(history.schema["valid_from"].dataType).alias("valid_from"), F.lit(None).cast(kind).alias("valid_to"), F.lit("cluster").alias("source")
    )
    return rows.unionByName(opened, allowMissingColumns=True)


def upsert_zones(current: DataFrame, clusters: DataFrame) -> DataFrame:
    """Zones by (organization, name) with the clusters' kind (mixed if it is none of the three), capacity and centroid; the version rises where there is a cluster."""
    keys, taken = ["organization_id", "name"], ["kind", "max_visits", "longitude", "latitude"]
    new = clusters.select(*keys, F.lit(True).alias("__new"), F.when(F.col("kind").isin("urban", "rural", "mixed"), F.col("kind")).otherwise("mixed").alias("__kind"), *[F.col(c).alias(f"__{c}") for c in taken[1:]])
    both = current.select(*keys, "version", *taken).join(new, keys, "full_outer")
    kept = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in taken]
    return both.select(*keys, *kept, (F.coalesce("version", F.lit(0)) + F.coalesce("__new", F.lit(False)).cast("int")).alias("version"))


def override_batch(requests: DataFrame, current: DataFrame, zones: DataFrame) -> DataFrame:
    """Manual moves: first failing reason, or null where the move is made. Capacity fills in request order."""
    cur = current.select("organization_id", "patient_id", F.col("zone_id").alias("from_zone"), F.col("row_version"))
    rows = requests.join(cur, ["organization_id", "patient_id"], "left").join(zones.select("organization_id", "zone_id", "max_visits", "occupied"), ["organization_id", "zone_id"], "left")
    bad = F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", "REASON_REQUIRED").when(~F.col("expected_version").eqNullSafe(F.col("row_version")), "STALE_VERSION").when(F.col("max_visits").isNull(), "ZONE_UNKNOWN")
    rows = rows.withColumn("rejected", bad)
    entering = (F.col("rejected").isNull() & (F.col("zone_id") != F.coalesce("from_zone", F.lit("")))).cast("int")
    before = F.sum(entering).over(Window.partitionBy("organization_id", "zone_id").orderBy("request_no"))
    return rows.withColumn("rejected", F.coalesce("rejected", F.when((entering == 1) & (F.col("occupied") + before > F.col("max_visits")), "CAPACITY_EXCEEDED")))


def spread_split(longitude: np.ndarray, latitude: np.ndarray, cap: int) -> np.ndarray:
    """Labels of compact parts of at most ``cap`` points: seeds far from each other, then the points nearest to any seed choose first, each the nearest with room."""
    n = len(longitude)
    k = -(-n // cap)
    lam, phi = np.radians(longitude), np.radians(latitude)

    def to(i: int) -> np.ndarray:
        h = np.sin((phi - phi[i]) / 2) ** 2 + np.cos(phi) * np.cos(phi[i]) * np.sin((lam - lam[i]) / 2) ** 2
        return np.arcsin(np.minimum(1, np.sqrt(h)))

    seeds, apart = [0], np.empty((n, k))
    apart[:, 0] = to(0)
    for j in range(1, k):
        nearest = apart[:, :j].min(axis=1)
        nearest[seeds] = -1
        seeds.append(int(nearest.argmax()))
        apart[:, j] = to(seeds[-1])
    labels, room = np.full(n, -1), np.full(k, cap - 1)
    labels[seeds] = np.arange(k)
    for i in np.lexsort((np.arange(n), apart.min(axis=1))):
        if labels[i] < 0:
            j = int(np.where(room > 0, apart[i], np.inf).argmin())
            labels[i], room[j] = j, room[j] - 1
    return labels


def geodesic_split(points: DataFrame, max_visits: int) -> DataFrame:
    """Administrative fallback: (organization, point, zone) of the points with coordinates; neither municipality nor postal code: outlier (null).

    A municipality that fits is a zone, else its postal codes are; points without municipality go by postal code. What is still
    too large is split by far seeds, over 2,000 points in areas first, so that no task holds a whole large place.
    """
    known = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rows = points.where("longitude is not null and latitude is not null").select("organization_id", "point_id", "longitude", "latitude", known("municipality").alias("town"), known("postal_code").alias("code"))
    towns = rows.where("town <> ''").groupBy("organization_id", "town").agg(F.count("*").alias("tn"))
    rows = rows.join(towns, ["organization_id", "town"], "left")
    place = (
        F.when((F.col("town") == "") & (F.col("code") == ""), F.lit(None)).when(F.col("tn") <= max_visits, F.col("town")).otherwise(F.concat("town", F.lit("/"), "code"))
    )
    rows = written(rows.withColumn("place", place), "places")
    sizes = rows.where("place is not null").groupBy("organization_id", "place").agg(F.count("*").alias("n"))
    sized = rows.join(sizes, ["organization_id", "place"], "left")
    whole = sized.where(F.col("n").isNull() | (F.col("n") <= max_visits)).select("organization_id", "point_id", F.col("place").alias("zone"))
    keys = ["organization_id", "place"]
    large = areas(projected(sized.where(F.col("n") > max_visits)), keys, AREA_POINTS, "point_id")
    types = {c: points.schema[c].dataType.simpleString() for c in ("organization_id", "point_id")}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["latitude", "longitude", "point_id"])
        labels = spread_split(part["longitude"].to_numpy(float), part["latitude"].to_numpy(float), max_visits)
        name = f"{part['place'].iloc[0]}/{part['area'].iloc[0]}:"
        return pd.DataFrame({"organization_id": part["organization_id"], "point_id": part["point_id"], "zone": [f"{name}{k}" for k in labels]})

    cut = large.select(*keys, "area", "point_id", "longitude", "latitude").groupBy(*keys, "area").applyInPandas(run, f"organization_id {types['organization_id']}, point_id {types['point_id']}, zone string")
    return whole.unionByName(cut)


def mean_pair_minutes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Mean minutes between members of a cluster over both directions; 0 without pairs."""
    a = members.select("route_id", F.col("node").alias("i"), "cluster")
    b = members.select("route_id", F.col("node").alias("j"), F.col("cluster").alias("other"))
    inside = pairs.join(a, ["route_id", "i"]).join(b, ["route_id", "j"]).where("cluster = other")
    means = inside.groupBy("route_id").agg((F.sum("duration_s") / F.count("*") / 60).alias("m"))
    return members.select("route_id").distinct().join(means, "route_id", "left").select("route_id", F.bround(F.coalesce("m", F.lit(0.0)), 6).alias("minutes"))


def improve_cohesion(labels: list[int], seconds: np.ndarray, kinds: list[str], cap: int) -> list[int]:
    """Greedy single moves to a zone of the same kind with room that lower the mean pair duration most, until none does."""
    labels, both = list(labels), (seconds + seconds.T) / 2
    zones = sorted(set(labels))
    own = np.array([zones.index(x) for x in labels], int)
    kind_of_zone = np.array([kinds[labels.index(z)] for z in zones])
    same = np.array(kinds)[:, None] == kind_of_zone[None]
    at = np.arange(len(labels))
    near = both @ np.eye(len(zones))[own]
    while True:
        size = np.bincount(own, minlength=len(zones))
        pairs = (size * (size - 1)).sum() / 2
        total = near[at, own].sum() / 2
        mean = total / pairs if pairs else 0.0
        left = pairs - (size[own] - 1)[:, None] + size[None]
        moved = total - near[at, own][:, None] + near
        gain = mean - np.divide(moved, left, out=np.zeros_like(moved), where=left > 0)
        closed = ~same | (size >= cap)[None] | (size[own] < 2)[:, None]
        closed[at, own] = True
        gain[closed] = -np.inf
        if not gain.size or gain.max() <= 1e-9:
            return [zones[k] for k in own]
        i, z = np.unravel_index(int((gain > gain.max() - 1e-12).argmax()), gain.shape)
        near[:, own[i]] -= both[:, i]
        near[:, z] += both[:, i]
        own[i] = z


def border_areas(members: DataFrame) -> DataFrame:
    """``members`` with the ``area`` inside which they may change zone: whole zones together, about 300 points at most."""
    members = written(members, "members")
    zones = areas(_zones(members), ["organization_id"], AREA_BORDER, "cluster", F.col("n"))
    return members.join(zones.select("organization_id", "cluster", "area"), ["organization_id", "cluster"])


def apply_cohesion(members: DataFrame, pairs: DataFrame, max_visits: int) -> DataFrame:
    """Members of each (organization, area) after border moves: ``cluster`` before, ``adjusted`` after, and mean minutes of both.

    ``pairs`` holds durations of all ordered pairs (i, j) of an area. Where one is missing, negative or not finite nothing moves and ``reason`` says so.
    """
    types = {c: members.schema[c].dataType.simpleString() for c in ("organization_id", "point_id")}
    schema = f"organization_id {types['organization_id']}, area string, point_id {types['point_id']}, kind string, cluster string, adjusted string, before_minutes double, after_minutes double, reason string"

    def minutes(labels: list, seconds: np.ndarray) -> float:
        of = np.array(labels)
        together = (of[:, None] == of[None]) & ~np.eye(len(of), dtype=bool)
        return round(float(seconds[together].mean() / 60), 6) if together.any() else 0.0

    def run(part: pd.DataFrame, times: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("point_id").reset_index(drop=True)
        if not len(part):
            return pd.DataFrame(columns=[f.split()[0] for f in schema.split(", ")])
        at = pd.Index(part["point_id"])
        seconds = np.full((len(part), len(part)), np.nan)
        i, j = at.get_indexer(times["i"]), at.get_indexer(times["j"])
        known = (i >= 0) & (j >= 0)
        seconds[i[known], j[known]] = times["duration_s"].to_numpy(float)[known]
        np.fill_diagonal(seconds, 0.0)
        sound = bool((np.isfinite(seconds) & (seconds >= 0)).all())
        before = part["cluster"].tolist()
        after = improve_cohesion(before, seconds, part["kind"].tolist(), max_visits) if sound else before
        return part[["organization_id", "area", "point_id", "kind", "cluster"]].assign(
            adjusted=after, before_minutes=minutes(before, seconds) if sound else None,
            after_minutes=minutes(after, seconds) if sound else None, reason=None if sound else "ROUTER_TABLE_FAILED",
        )

    keys = ["organization_id", "area"]
    rows = members.select(*keys, "point_id", "kind", "cluster")
    return rows.groupBy(*keys).cogroup(pairs.select(*keys, "i", "j", "duration_s").groupBy(*keys)).applyInPandas(run, schema)
