"""Arriving import files, end to end: screened, known contents left out, parsed, capped, checked, repeated references found.

Everything that is remembered is keyed state: the contents that came before by (organization, period, hash), and who holds a reference
by (organization, period, reference). A batch costs what it brings, however much has been loaded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from homeround.operators import intake
from homeround.sources import files
from homeround.streaming.routes import use_keyed_state

BINARY = "path string, modificationTime timestamp, length long, content binary"
FILE = ["organization_id", "period", "batch_id", "path", "arrived"]
OWN = ["organization_id", "period", "reference_hash"]


def arriving_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Stream of files under ``folder``/organization/period/."""
    source = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    return source.load(folder)


def _screened(found: DataFrame) -> DataFrame:
    """One row a content of an organization and period: its id is made of them, so a file sent twice is one, under whatever name."""
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    rows = found.withColumns({"organization_id": part(3).try_cast("long"), "period": part(2), "content_hash": F.sha2("content", 256), "error": files.file_error()})
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    rows = rows.withColumn("error", F.when(F.col("organization_id").isNull(), "UNKNOWN_FOLDER").otherwise(F.coalesce("error", F.when(kind != "csv", "SHEET_NOT_READ"))))
    rows = rows.withColumn("batch_id", F.sha2(F.concat_ws("/", "organization_id", "period", "content_hash"), 256)).withColumnRenamed("modificationTime", "arrived")
    return rows.dropDuplicates(["organization_id", "period", "content_hash", "error"])


def _checked(found: DataFrame, mapping: dict[str, str], limit: int) -> DataFrame:
    """Rows with their own errors; a refused file is one row without number."""
    sheets = files.parse_sheets(found.where("error IS NULL"), list(mapping), FILE, limit)
    named = sheets.select(*FILE, "row_number", *[F.col(f"`{h}`").alias(n) for h, n in mapping.items()], "error")
    refused = found.where("error IS NOT NULL").select(*FILE, F.lit(None).cast("int").alias("row_number"), *[F.lit(None).cast("string").alias(n) for n in mapping.values()], "error")
    rows = named.unionByName(refused)
    rows = rows.withColumns({n: F.lit(None).cast("string") for n in intake.FIELDS if n not in mapping.values()})
    checked = intake.validate_rows(rows)
    return checked.withColumn("errors", F.when(F.col("error").isNull(), F.col("errors")).otherwise(F.slice("errors", 1, 0)))


def _mark(rows: pd.DataFrame, holders: list[str]) -> tuple[pd.DataFrame, list[str]]:
    """Rows of one reference in order of arrival with the code of a repeated one, and up to two batches that hold it in a valid row."""
    rows = rows.sort_values(["arrived", "batch_id", "row_number"], ignore_index=True)
    codes, seen = [], set()
    for batch, errors in zip(rows["batch_id"], rows["errors"]):
        code = "DUPLICATE_IN_BATCH" if batch in seen else "DUPLICATE_IN_PERIOD" if any(h != batch for h in holders) else None
        seen.add(batch)
        codes.append(code)
        if code is None and len(errors) == 0 and batch not in holders and len(holders) < 2:
            holders = [*holders, batch]
    return rows.assign(repeated=codes), holders


class References(StatefulProcessor):
    """Who holds a reference in a period."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holders = handle.getValueState("holders", "first string, second string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = [h for h in self.holders.get() if h is not None] if self.holders.exists() else []
        marked, holders = _mark(pd.concat(list(rows), ignore_index=True), known)
        if holders != known:
            self.holders.update((*holders, *[None] * (2 - len(holders))))
        yield marked

    def close(self) -> None:
        pass


def _kind(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("repeated", T.StringType())])


def _finished(rows: DataFrame) -> DataFrame:
    extra = F.when(F.col("repeated").isNotNull(), F.array(F.struct(F.lit("external_ref").alias("field"), F.col("repeated").alias("code")))).otherwise(F.slice("errors", 1, 0))
    status = F.when(F.col("error").isNotNull(), "refused").when(F.size("errors") == 0, "valid").otherwise("invalid")
    return rows.withColumn("errors", F.concat("errors", extra)).withColumn("validation_status", status).drop("repeated")


def import_stream(found: DataFrame, mapping: dict[str, str], limit: int = files.MAX_ROWS) -> DataFrame:
    """Checked rows of arriving files, each file once.

    ``found``: :func:`arriving_files`. ``mapping``: header -> canonical name. Rows carry organization_id, period, batch_id, path, row_number,
    the fields, ``errors`` and validation_status. A file that is refused (its size, extension, signature, macros, encoding, folder or
    number of rows) is one row with ``error``, without number. A reference that comes again in its file, or that an earlier file of the
    organization and period holds in a valid row, is marked. Files of one batch count in order of arrival.
    """
    use_keyed_state(found.sparkSession)
    rows = _checked(_screened(found), mapping, limit)
    keyed = rows.where("reference_hash IS NOT NULL")
    marked = keyed.groupBy(*OWN).transformWithStateInPandas(References(), _kind(rows), "append", "none")
    return _finished(marked.unionByName(rows.where("reference_hash IS NULL").withColumn("repeated", F.lit(None).cast("string"))))


def replay_imports(found: DataFrame, mapping: dict[str, str], limit: int = files.MAX_ROWS) -> DataFrame:
    """The same in batch over all files (path, modificationTime, length, content)."""
    rows = _checked(_screened(found), mapping, limit)
    keyed = rows.where("reference_hash IS NOT NULL")
    marked = keyed.groupBy(*OWN).applyInPandas(lambda frame: _mark(frame, [])[0], _kind(rows))
    return _finished(marked.unionByName(rows.where("reference_hash IS NULL").withColumn("repeated", F.lit(None).cast("string"))))
