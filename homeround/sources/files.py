"""File sources and sinks: import sheets, screening, gazetteers, registry refresh, table sinks."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES, MAX_ROWS = 10 << 20, 500
#: Fixed value: the storage that holds the macros of a binary workbook; its name stands in the file in one or two bytes a character.
VBA_NAME = "_VBA_PROJECT"


def _sheet(content: bytes) -> tuple[list[str], Iterator[list[str]]]:
    """(header, rows) of a CSV file; the delimiter is ``;`` if the first line has as many as commas. Empty lines are no rows."""
    text = content.decode("utf-8-sig", errors="replace")
    first = next(iter(text[: text.find("\n") + 1 or None].splitlines()), "")
    rows = (row for row in csv.reader(io.StringIO(text, newline=""), delimiter=";" if first.count(";") >= first.count(",") else ",") if row)
    return next(rows, []), rows


def parse_sheets(files: DataFrame, names: list[str], carry: list[str], limit: int | None = None) -> DataFrame:
    """Rows of CSV files (``path``, ``content``, and the columns to ``carry``): carried columns, ``row_number`` from 1, ``names``, ``error``.

    A task reads each file's header and streams its rows; a name that a header lacks is null, of a repeated one the last counts, and one
    plan serves any number of headers. A file of more than ``limit`` rows, or one that cannot be parsed, gives one row: no number and an error.
    """
    head = [f for f in files.select(*carry).schema]
    schema = T.StructType([*head, T.StructField("row_number", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in names), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(file, rows: list[tuple], error: str | None) -> pd.DataFrame:
            out = {c: [getattr(file, c)] * len(rows) for c in carry}
            columns = list(zip(*rows))
            out["row_number"] = pd.array([r[0] for r in rows], "Int32")
            return pd.DataFrame(out | {n: columns[k] for k, n in enumerate(names, 1)} | {"error": error}, columns=schema.names)

        csv.field_size_limit(MAX_BYTES)
        for batch in batches:
            for file in batch.itertuples(index=False):
                refused, held = None, []
                try:
                    header, rows = _sheet(file.content)
                    at = {h.strip(): k for k, h in enumerate(header)}
                    where = [at.get(n) for n in names]
                    for number, row in enumerate(rows, 1):
                        held.append((number, *(row[k] if k is not None and k < len(row) else None for k in where)))
                        if limit is not None and number > limit:
                            refused = "TOO_MANY_ROWS"
                            break
                        if limit is None and len(held) == 10_000:
                            yield made(file, held, None)
                            held = []
                except csv.Error:
                    refused = "NOT_PARSED"
                if refused:
                    held = [(None, *[None] * len(names))]
                if held:
                    yield made(file, held, refused)

    return files.select(*dict.fromkeys([*carry, "path", "content"])).mapInPandas(run, schema)


def read_import_csv(spark: SparkSession, paths: list[str], names: list[str] | None = None) -> DataFrame:
    """CSV files with a header of their own each, as strings: the asked columns, ``row_number``, ``file``, and ``error`` of a file that cannot be parsed.

    One plan whatever the headers. Without ``names`` they are gathered from the headers first: what reaches the driver is each distinct
    name once, as many as the result has columns. Files over the size limit are not read: :func:`screen_files` names them.
    """
    files = spark.read.format("binaryFile").load(paths).where(F.col("length") <= MAX_BYTES).select("path", "content", F.col("path").alias("file"))
    if names is None:

        def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"name": [h.strip() for content in batch["content"] for h in _sheet(content)[0]]})

        names = [r["name"] for r in files.select("content").mapInPandas(heads, "name string").where("name <> ''").distinct().orderBy("name").collect()]
    return parse_sheets(files, names, ["file"])


def map_columns(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Source headers to canonical names; only mapped columns that exist stay."""
    return rows.select(*[F.col(f"`{source}`").alias(name) for source, name in mapping.items() if source in rows.columns])


@F.pandas_udf(T.BooleanType())
def _has_macros(content: pd.Series) -> pd.Series:
    def look(data: bytes) -> bool:
        try:
            return any("vbaproject" in n.lower() for n in zipfile.ZipFile(io.BytesIO(data)).namelist())
        except zipfile.BadZipFile:
            return False

    return content.map(look)


def file_error() -> Column:
    """What speaks against a file (``path``, ``length``, ``content``), or null."""
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    starts = lambda magic: F.startswith("content", F.to_binary(F.lit(magic), F.lit("hex")))
    holds = lambda text: F.contains("content", F.lit(text))
    return (
        F.when(F.col("length") > MAX_BYTES, "FILE_TOO_LARGE")
        .when(~kind.isin("csv", "xlsx", "xls"), "UNSUPPORTED_EXTENSION")
        .when((kind == "xlsx") & ~starts("504B0304"), "BAD_SIGNATURE")
        .when((kind == "xls") & ~starts("D0CF11E0"), "BAD_SIGNATURE")
        .when((kind == "xlsx") & _has_macros("content"), "MACROS_REJECTED")
        .when((kind == "xls") & (holds(VBA_NAME.encode()) | holds(VBA_NAME.encode("utf-16-le"))), "MACROS_REJECTED")
        .when((kind == "csv") & ~F.is_valid_utf8("content"), "NOT_UTF8")
    )


def screen_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content_hash, error): a null error if the file may be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("content_hash"), file_error().alias("error"))


def enforce_row_cap(rows: DataFrame, limit: int = MAX_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of files within the limit, rejected files with their count); a file over it goes whole."""
    sizes = rows.groupBy("file").agg(F.count("*").alias("n"))
    over = sizes.where(F.col("n") > limit)
    return rows.join(over, "file", "left_anti"), over


def dedupe_files(batches: DataFrame, loaded: DataFrame) -> DataFrame:
    """Adds ``duplicate``: the content is already loaded for the (organization, period) and not cancelled, or came earlier in this run."""
    keys = ["organization_id", "period", "content_hash"]
    known = loaded.where("not cancelled").select(*keys, F.lit(True).alias("__known")).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("batch_id"))
    return batches.join(known, keys, "left").withColumn("duplicate", F.coalesce("__known", F.lit(False)) | (nth > 1)).drop("__known")


def read_gazetteer_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "street string, house_number string, municipality string, postal_code string, latitude double, longitude double, source string, source_ref string, aliases string"
    return spark.read.csv(path, header=True, schema=schema).withColumn("aliases", F.filter(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda a: F.trim(a) != ""))


def read_gazetteer_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Points of a feature collection; features with fewer than two coordinates are skipped. Aliases: a text cut at bars, or an array."""
    props = "struct<street:string,house_number:string,municipality:string,postal_code:string,source:string,source_ref:string,aliases:string>"
    schema = f"features array<struct<geometry:struct<coordinates:array<double>>,properties:{props}>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).where("size(f.geometry.coordinates) >= 2")
    a = F.coalesce("f.properties.aliases", F.lit(""))
    aliases = F.when(a.startswith("["), F.from_json(a, "array<string>")).otherwise(F.split(a, r"\|"))
    return f.select(
        *[F.col(f"f.properties.{c}").alias(c) for c in ("street", "house_number", "municipality", "postal_code")],
        F.col("f.geometry.coordinates")[1].alias("latitude"), F.col("f.geometry.coordinates")[0].alias("longitude"),
        F.col("f.properties.source").alias("source"), F.col("f.properties.source_ref").alias("source_ref"), F.filter(aliases, lambda x: F.trim(x) != "").alias("aliases"),
    )


def refresh_gazetteer(registry: DataFrame, municipalities: list[str]) -> DataFrame:
    """Registry rows of the listed municipalities with a number (not empty, not 0) and coordinates."""
    lat, lon = (F.replace(F.col(f"`{c}`"), F.lit(","), F.lit(".")).try_cast("double") for c in ("LAT_ETRS89", "LON_ETRS89"))
    rows = registry.select(
        F.trim(F.col("`Izena/Nombre`")).alias("street"), F.trim(F.col("`Zenbakia/Número`")).alias("house_number"), F.trim(F.col("`Udalerria/Municipio`")).alias("municipality"),
        F.col("`Posta-kodea/Código Postal`").alias("postal_code"), lat.alias("latitude"), lon.alias("longitude"), F.col("`Posta-helbidea/Dirección postal`").alias("source_ref"),
    )
    return rows.where(F.col("municipality").isin(municipalities) & ~F.coalesce("house_number", F.lit("")).isin("", "0") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def write_geojson_lines(points: DataFrame, path: str) -> None:
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct("street", "house_number", "municipality", "postal_code").alias("properties"),
    )
    points.select(F.to_json(feature).alias("value")).write.text(path)


def save_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet by organization (and more), replacing only the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(by or ["organization_id"])).parquet(path)
