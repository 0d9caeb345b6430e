"""Geocoding on candidate tables: gazetteer, cache, scores, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homeround.functions.geo import haversine_m
from homeround.functions.text import fold, house_number_key, municipality_key, street_key

MATCH, AMBIGUOUS, MARGIN, SAME_M = 0.55, 0.3, 0.15, 50.0

#: Place classes that are precise without a number, and those that score as a place.
PRECISE = ("village", "hamlet", "isolated_dwelling", "locality", "neighbourhood", "suburb")
PLACES = ("building", "house", "place", *PRECISE)


def flatten_candidates(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row per element of a geocoder's JSON array."""
    kind = (
        "array<struct<lat:string,lon:string,display_name:string,importance:double,type:string,category:string,class:string,"
        "address:struct<postcode:string,house_number:string,city:string,town:string,village:string,municipality:string>>>"
    )
    rows = replies.select("address_id", F.posexplode(F.from_json(reply, kind)).alias("pos", "c"))
    return rows.select(
        "address_id",
        (F.col("pos") + 1).alias("ordinal"),
        F.col("c.lat").cast("double").alias("latitude"),
        F.col("c.lon").cast("double").alias("longitude"),
        F.col("c.display_name").alias("display_label"),
        F.coalesce("c.importance", F.lit(0.0)).alias("importance"),
        F.when(F.col("c.type").isin(*PLACES), F.col("c.type")).otherwise(F.coalesce("c.category", "c.class")).alias("place_class"),
        F.col("c.address.postcode").alias("postal_code"),
        F.coalesce("c.address.city", "c.address.town", "c.address.village", "c.address.municipality").alias("municipality"),
        F.col("c.address.house_number").alias("house_number"),
    )


def gazetteer_keys(points: DataFrame) -> DataFrame:
    """First point of each key, of streets and their aliases: with the postal code, and without (postal_code null)."""
    names = F.concat(F.array("street"), F.filter(F.split("aliases", r"\|"), lambda a: a != ""))
    rows = points.select("*", F.posexplode(names).alias("nth", "name"))
    rows = rows.select(
        street_key(F.col("name")).alias("street_key"), house_number_key(F.col("house_number")).alias("number_key"),
        municipality_key(F.col("municipality")).alias("municipality_key"), F.explode(F.array("postal_code", F.lit(None).cast("string"))).alias("postal_code"),
        "point_no", "nth", "latitude", "longitude",
    ).where("street_key <> ''")
    keys = ["street_key", "number_key", "municipality_key", "postal_code"]
    return rows.groupBy(*keys).agg(F.min(F.struct("point_no", "nth", "latitude", "longitude")).alias("p")).select(*keys, "p.*")


def gazetteer_lookup(addresses: DataFrame, points: DataFrame) -> DataFrame:
    """Point of (street, number, municipality, postal code), else of (street, number, municipality)."""
    keys = gazetteer_keys(points)
    on = ["street_key", "number_key", "municipality_key"]
    asked = addresses.withColumns(
        {"street_key": street_key(F.col("street")), "number_key": house_number_key(F.col("house_number")), "municipality_key": municipality_key(F.col("municipality"))}
    )
    exact = keys.where("postal_code is not null").select(*on, "postal_code", F.col("point_no").alias("__a"))
    loose = keys.where("postal_code is null").select(*on, F.col("point_no").alias("__b"))
    found = asked.join(exact, [*on, "postal_code"], "left").join(loose, on, "left")
    return found.select(*addresses.columns, F.coalesce("__a", "__b").alias("point_no"), F.col("__a").isNotNull().alias("with_postal_code"))


def score(postal_code: Column, municipality: Column) -> Column:
    """0.4 postal code + 0.3 municipality (equal, or in the label) + 0.15 precise + 0.1 class + 0.05 importance, 4 places half-even."""
    label = F.lower(F.trim("display_label"))
    town = F.lower(F.trim(municipality))
    same_town = F.coalesce(F.lower(F.trim("candidate_municipality")) == town, F.lit(False)) | label.contains(town)
    points = [
        F.when(F.col("candidate_postal_code") == postal_code, 0.4).otherwise(0.0),
        F.when(same_town, 0.3).otherwise(0.0),
        F.when(F.col("house_number").isNotNull() | F.col("place_class").isin(*PRECISE), 0.15).otherwise(0.0),
        F.when(F.col("place_class").isin(*PLACES), 0.1).otherwise(0.0),
        F.least(F.greatest("importance", F.lit(0.0)), F.lit(1.0)) * 0.05,
    ]
    return F.bround(sum(points[1:], points[0]), 4)


def rank_candidates(candidates: DataFrame, addresses: DataFrame) -> DataFrame:
    """Candidates with ``score`` and ``rank`` per address; ties keep input order."""
    asked = addresses.select("address_id", F.col("postal_code").alias("__cp"), F.col("municipality").alias("__town"))
    scored = candidates.join(asked, "address_id").withColumn("score", score(F.col("__cp"), F.col("__town"))).drop("__cp", "__town")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("address_id").orderBy(F.desc("score"), "ordinal")))


def classify(ranked: DataFrame, addresses: DataFrame) -> DataFrame:
    """Outcome per address from its best candidate and the first one at another place."""
    best = Window.partitionBy("address_id").orderBy("rank")
    first = lambda c: F.first(c).over(best)
    same = ((F.col("house_number") == first("house_number")) & F.col("candidate_postal_code").eqNullSafe(first("candidate_postal_code"))) | (
        haversine_m(F.col("longitude"), F.col("latitude"), first("longitude"), first("latitude")) <= SAME_M
    )
    tagged = ranked.withColumn("__other", (F.col("rank") > 1) & ~F.coalesce(same, F.lit(False)))
    per = tagged.groupBy("address_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"), F.max(F.when(F.col("__other"), F.col("score"))).alias("runner_up")
    )
    outcome = (
        F.when(F.col("top_score").isNull() | (F.col("top_score") < AMBIGUOUS), "not_found")
        .when(F.col("top_score") < MATCH, "ambiguous")
        .when(F.bround(F.col("top_score") - F.col("runner_up"), 9) < MARGIN, "ambiguous")
        .otherwise("matched")
    )
    return addresses.select("address_id").join(per, "address_id", "left").withColumn("outcome", outcome)


def first_candidates(candidates: DataFrame, n: int = 5) -> DataFrame:
    """The first n candidates of each address in input order, as one array."""
    kept = candidates.where(F.col("ordinal") <= n)
    return kept.groupBy("address_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "latitude", "longitude", F.col("importance").alias("score"), F.col("place_class").alias("class")))).alias("candidates")
    )


def augment_candidates(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Where a gazetteer point exists and no candidate is that house: the point comes first, candidates without a number go.

    ``found``: address_id, street, aliases (parted by bars), house_number, and the point's latitude and longitude. A candidate is that
    house if it has the number and its label, folded, holds the street or an alias, folded or as a key.
    """
    names = F.concat(F.array("street"), F.split(F.coalesce("aliases", F.lit("")), r"\|"))
    spelled = found.select("address_id", F.explode(names).alias("name")).where("trim(name) <> ''")
    spelled = spelled.select("address_id", F.array(fold(F.col("name")), street_key(F.col("name"))).alias("n"))
    spelled = spelled.groupBy("address_id").agg(F.flatten(F.collect_list("n")).alias("__names"))
    point = found.select("address_id", F.col("street").alias("__street"), F.col("house_number").alias("__no"), F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"))
    joined = candidates.join(point.join(spelled, "address_id", "left"), "address_id", "left").withColumn("__label", fold(F.col("display_label")))
    named = F.exists("__names", lambda n: (n != "") & F.col("__label").contains(n))
    is_it = (house_number_key(F.col("house_number")) == house_number_key(F.col("__no"))) & named
    joined = joined.withColumn("__there", F.max(F.coalesce(is_it, F.lit(False))).over(Window.partitionBy("address_id")))
    plain = joined.where(F.col("__street").isNull() | F.col("__there") | F.col("house_number").isNotNull())
    there = joined.where("__there").select("address_id").distinct()
    new = point.join(there, "address_id", "left_anti").select("address_id", F.lit(0).alias("ordinal"), F.col("__lat").alias("latitude"), F.col("__lon").alias("longitude"), F.lit(1.0).alias("importance"), F.lit("house").alias("place_class"), F.col("__no").alias("house_number"))
    rows = plain.select("address_id", "ordinal", "latitude", "longitude", "importance", "place_class", "house_number").unionByName(new)
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("address_id").orderBy("ordinal")))


def cached_lookup(requests: DataFrame, cache: DataFrame, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(requests with a fresh cached reply, distinct hashes that need a lookup)."""
    fresh = cache.where(F.col("stored_at") > F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")).select("query_hash", "provider_version", "reply_no")
    keys = ["query_hash", "provider_version"]
    return requests.join(fresh, keys), requests.select(*keys).distinct().join(fresh, keys, "left_anti")


def municipality_retry(addresses: DataFrame, candidates: DataFrame, municipal: DataFrame) -> DataFrame:
    """Candidates, and for addresses without any the candidates of their municipality, marked ``retried``.

    ``municipal`` holds few rows a municipality, with ordinal; only addresses without a hit are joined to it.
    """
    missing = addresses.select("address_id", "municipality").join(candidates.select("address_id"), "address_id", "left_anti")
    again = missing.join(municipal, "municipality").drop("municipality").withColumn("retried", F.lit(True))
    return candidates.withColumn("retried", F.lit(False)).unionByName(again, allowMissingColumns=True)


def latest_attempts(attempts: DataFrame) -> DataFrame:
    newest = Window.partitionBy("address_id").orderBy(F.desc("requested_at"), F.desc("id"))
    return attempts.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("batch").agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("matched", "ambiguous", "not_found")])


def match_rate(outcomes: DataFrame, labelled: DataFrame, fictional: DataFrame) -> DataFrame:
    """Share matched of a labelled sample without the known fictional ids, and the failures."""
    sample = outcomes.join(labelled, "address_id", "left_semi").join(fictional, "address_id", "left_anti")
    return sample.groupBy("organization_id").agg(
        F.bround(F.avg((F.col("outcome") == "matched").cast("double")), 6).alias("rate"), F.count_if(F.col("outcome") != "matched").alias("failures")
    )
