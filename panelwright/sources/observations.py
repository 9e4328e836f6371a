"""Observation payloads and second-source rows to long panels, and back to snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import steps
from panelwright.functions.ids import code_after_slash, country_place_id
from panelwright.schema import (
    AGGREGATE_REGION,
    COUNTRY_ROW,
    GEOMETRY_COLLECTION,
    INDICATOR,
    PANEL_COLUMNS,
    PAYLOAD,
    SECOND_SOURCE_ROW,
)
from panelwright.staging import settle

# Places per payload row of a snapshot, so that one variable never is one record.
PLACES_PER_ROW = 10_000

# Fixed values of the facet given to second-source observations.
SECOND_SOURCE_FACET = {
    "observationPeriod": "P1Y",
    "provenanceId": "worldBank/WDI",
    "provenanceUrl": "https://data.worldbank.org/indicator/",
}


def period_of(date: Column) -> Column:
    """The step a date stands for, on the axis of the unit it is written in (``functions.steps``).
    Null for anything else, so that no two dates fall into one step unseen.
    """
    return steps.step_of(date)


# ---- readers ----


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payloads as JSON, one per line; a variable may be spread over any number of lines."""
    return spark.read.schema(PAYLOAD).json(path)


def read_payload_documents(spark: SparkSession, path: str) -> DataFrame:
    """Payloads as pretty-printed JSON, one document per file."""
    return spark.read.schema(PAYLOAD).json(path, multiLine=True)


def read_second_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SECOND_SOURCE_ROW).json(path)


def unwrap_envelope(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows out of ``[meta, rows]`` texts; a text of any other shape fails the job."""
    body = F.from_json(
        F.get_json_object(column, "$[1]"), F.lit(f"array<{SECOND_SOURCE_ROW.simpleString()}>")
    )
    is_envelope = F.coalesce(F.json_array_length(column) >= 2, F.lit(False))
    guard = F.assert_true(is_envelope, F.lit("not a [meta, rows] response"))
    return texts.where(guard.isNull()).select(F.inline(body))


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COUNTRY_ROW).json(path)


def read_geometry(spark: SparkSession, path: str) -> DataFrame:
    return geometry_places(spark.read.schema(GEOMETRY_COLLECTION).json(path, multiLine=True))


def geometry_places(collections: DataFrame) -> DataFrame:
    """One row per feature: its id and the untouched shape."""
    return collections.select(F.explode("features").alias("_f")).select(
        F.col("_f.id").alias("place_id"),
        F.col("_f.properties").alias("properties"),
        F.col("_f.geometry").alias("geometry"),
    )


# ---- payloads to long rows ----


def _observations(payloads: DataFrame, indicators: DataFrame) -> DataFrame:
    rows = payloads.select("facets", F.explode("data").alias("variable_id", "_places"))
    rows = rows.select("variable_id", "facets", F.explode("_places").alias("place_id", "_obs"))
    facet = F.try_element_at(F.col("facets"), F.col("_obs.facet"))
    rows = rows.select("variable_id", "place_id", "_obs", facet.alias("_facet"))
    meta = indicators.select(
        INDICATOR, "variable_id", "source_agency", "dimensions"
    )
    return rows.join(meta, "variable_id")


def _long(rows: DataFrame, date: Column, value: Column) -> DataFrame:
    return rows.select(
        INDICATOR,
        "place_id",
        period_of(date).alias("period"),
        date.alias("date"),
        F.nanvl(value, F.lit(None).cast("double")).alias("value"),
        "variable_id",
        F.col("_facet.unit").alias("unit"),
        F.col("_facet.unitDisplayName").alias("unit_display"),
        "source_agency",
        F.col("_facet.provenanceId").alias("provenance_id"),
        F.col("_facet.provenanceUrl").alias("provenance_url"),
        F.col("_obs.facet").alias("facet_id"),
        "dimensions",
        F.col("_facet.observationPeriod").alias("observation_period"),
    )


def decode_points(payloads: DataFrame, indicators: DataFrame) -> DataFrame:
    """Latest-only payloads to long rows; a facet the payload does not describe gives nulls."""
    rows = _observations(payloads, indicators)
    return _long(rows, F.col("_obs.date"), F.col("_obs.value"))


def decode_series(payloads: DataFrame, indicators: DataFrame) -> DataFrame:
    """Series payloads to long rows, one per element."""
    rows = _observations(payloads, indicators).withColumn("_point", F.explode("_obs.series"))
    return _long(rows, F.col("_point.date"), F.col("_point.value")).select(*PANEL_COLUMNS)


def snapshot_points(payloads: DataFrame, indicators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(long rows, EMPTY_RESPONSE findings of requested variables that are not there)."""
    rows = decode_points(payloads, indicators)
    return rows, empty_responses(rows, indicators)


def empty_responses(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested variables without a single row: an error, never "no data"."""
    return (
        requested.select(INDICATOR, "variable_id")
        .join(rows.select("variable_id").distinct(), "variable_id", "left_anti")
        .select(
            INDICATOR,
            F.lit("error").alias("level"),
            F.lit("EMPTY_RESPONSE").alias("code"),
            F.concat(F.lit("no data for "), "variable_id").alias("message"),
            F.to_json(F.struct("variable_id")).alias("evidence"),
        )
    )


def require_responses(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """Counts requested variables; running it fails when one has no rows."""
    empty = empty_responses(rows, requested).agg(F.count("*").alias("n_empty"))
    guard = F.assert_true(F.col("n_empty") == 0, F.lit("a requested variable has no data"))
    return empty.where(guard.isNull())


# ---- second source ----


def real_countries(countries: DataFrame) -> DataFrame:
    """Allow-list of places: aggregates out, a row without a region stays, odd codes out."""
    return (
        countries.where(~F.col("region.id").eqNullSafe(F.lit(AGGREGATE_REGION)))
        .select(country_place_id(F.col("id")).alias("place_id"), F.col("name").alias("place_name"))
        .where(F.col("place_id").isNotNull())
    )


def usable_rows(rows: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Rows with a value and a well-formed country code, of allowed places only.

    Adds place_id; all other columns stay.
    """
    out = (
        rows.where(F.col("value").isNotNull())
        .withColumn("place_id", country_place_id(F.col("countryiso3code")))
        .where(F.col("place_id").isNotNull())
    )
    if allowed is not None:
        out = out.join(allowed.select("place_id"), "place_id", "left_semi")
    return out


def with_second_source_facet(rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """Long rows from usable rows carrying variable_id: unit from the catalog, one facet each."""
    code = code_after_slash(F.col("variable_id"))
    meta = indicators.select(
        INDICATOR, "variable_id", "unit", "unit_display", "source_agency", "dimensions"
    )
    return rows.drop("unit", "indicator").join(meta, "variable_id").select(
        INDICATOR,
        "place_id",
        period_of(F.col("date")).alias("period"),
        "date",
        F.col("value").cast("double").alias("value"),
        "variable_id",
        "unit",
        "unit_display",
        "source_agency",
        F.lit(SECOND_SOURCE_FACET["provenanceId"]).alias("provenance_id"),
        F.concat(F.lit(SECOND_SOURCE_FACET["provenanceUrl"]), code).alias("provenance_url"),
        F.concat(F.lit("worldbank/"), code).alias("facet_id"),
        "dimensions",
        F.lit(SECOND_SOURCE_FACET["observationPeriod"]).alias("observation_period"),
    )


def latest_points(panel: DataFrame) -> DataFrame:
    """The last known value per series. Of equal dates the smallest value stands.

    One map-side combined aggregation.
    """
    kept = [c for c in panel.columns if c not in (INDICATOR, "place_id")]
    known = panel.where(F.col("value").isNotNull() & ~F.isnan("value"))
    newest = F.max_by(F.struct(*kept), F.struct(F.col("date"), -F.col("value")))
    return (
        known.groupBy(INDICATOR, "place_id").agg(newest.alias("_r")).select(
            INDICATOR, "place_id", "_r.*"
        )
    )


def combine_sources(*panels: DataFrame) -> DataFrame:
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# ---- snapshots ----


def _chunks(panel: DataFrame, per_row: int) -> DataFrame:
    """Adds a chunk number so that each (variable, chunk) holds about ``per_row`` places."""
    places = settle(panel.groupBy("variable_id").agg(F.count("*").alias("_rows")))
    chunks = F.ceil(F.col("_rows") / per_row)
    return panel.join(places, "variable_id").withColumn(
        "_chunk", F.pmod(F.xxhash64("place_id"), chunks)
    )


def _facet_map() -> Column:
    described = F.struct(
        F.col("unit"),
        F.col("unit_display").alias("unitDisplayName"),
        F.col("provenance_id").alias("provenanceId"),
        F.col("provenance_url").alias("provenanceUrl"),
        F.col("observation_period").alias("observationPeriod"),
    )
    pairs = F.collect_set(F.struct("facet_id", described.alias("facet")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["facet_id"].isNotNull()))


def encode_points(latest: DataFrame, per_row: int = PLACES_PER_ROW) -> DataFrame:
    """Latest-only payloads of a bounded number of places each.

    ``latest`` has one row per (indicator, place) and describes each facet in one way.
    """
    observation = F.struct(F.col("facet_id").alias("facet"), "date", "value")
    places = F.map_from_entries(F.collect_list(F.struct(F.col("place_id"), observation)))
    return (
        _chunks(latest, per_row)
        .groupBy(INDICATOR, "variable_id", "_chunk")
        .agg(places.alias("_places"), _facet_map().alias("facets"))
        .select(INDICATOR, F.create_map("variable_id", "_places").alias("data"), "facets")
    )


def encode_series(panel: DataFrame, per_row: int = PLACES_PER_ROW) -> DataFrame:
    """Series payloads: per place and facet the points by rising date, known values only.

    A payload has one series of a place, so a second facet of a place stands in a row of its own.
    """
    known = panel.where(F.col("value").isNotNull() & ~F.isnan("value"))
    described = ["unit", "unit_display", "provenance_id", "provenance_url", "observation_period"]
    period = [] if "observation_period" in panel.columns else [F.lit(None).cast("string").alias("observation_period")]
    by = [INDICATOR, "variable_id", "place_id", "facet_id"]
    per_place = known.select("*", *period).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("date", "value"))).alias("series"),
        *[F.min(c).alias(c) for c in described],
    )
    observation = F.struct(F.col("facet_id").alias("facet"), "series")
    places = F.map_from_entries(F.collect_list(F.struct(F.col("place_id"), observation)))
    nth = F.row_number().over(Window.partitionBy(INDICATOR, "variable_id", "place_id").orderBy("facet_id"))
    return (
        _chunks(per_place.withColumn("_nth", nth), per_row)
        .groupBy(INDICATOR, "variable_id", "_chunk", "_nth")
        .agg(places.alias("_places"), _facet_map().alias("facets"))
        .select(INDICATOR, F.create_map("variable_id", "_places").alias("data"), "facets")
    )


MANIFEST = "indicator_key string, folder string, n_places long, written_at timestamp"


def write_snapshot(
    latest: DataFrame, requested: DataFrame, names: DataFrame, path: str
) -> DataFrame:
    """Writes payloads by indicator and the place names; returns what was skipped as empty.

    Every write goes to a folder of its own and counts once its manifest is there, which is
    written last: a row per indicator with the folder that holds it. A write that was lost, or of
    which only parts are there, is never seen; of several the last one of an indicator counts.
    """
    spark = latest.sparkSession
    folder = f"write={uuid.uuid4().hex}"
    encode_points(latest).write.partitionBy(INDICATOR).json(f"{path}/points/{folder}")
    used = names.join(latest.select("place_id").distinct(), "place_id", "left_semi")
    used.where(F.col("place_name") != "").write.mode("overwrite").json(f"{path}/place_names")
    written = latest.groupBy(INDICATOR).agg(F.count("*").alias("n_places"))
    manifest = written.select(
        INDICATOR, F.lit(folder).alias("folder"), "n_places", F.current_timestamp().alias("written_at")
    )
    manifest.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return empty_responses(latest, requested)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The write that counts of each indicator: its last."""
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    last = F.max_by(F.struct("folder", "n_places", "written_at"), F.struct("written_at", "folder"))
    return rows.groupBy(INDICATOR).agg(last.alias("_m")).select(INDICATOR, "_m.*")


def read_snapshot(spark: SparkSession, path: str, indicators: DataFrame):
    """(long rows, findings) of a written snapshot, variables found by content.

    The manifest joins on the folder names, so files that it does not name are pruned, not read.
    """
    folder = F.regexp_replace("folder", "^write=", "").alias("_write")
    named = settle(read_manifest(spark, path).select(folder, F.col(INDICATOR).alias("_named")))
    schema = T.StructType([*PAYLOAD.fields, T.StructField("write", T.StringType()), T.StructField(INDICATOR, T.StringType())])
    payloads = spark.read.schema(schema).json(f"{path}/points")
    same = (F.col("write") == F.col("_write")) & (F.col(INDICATOR) == F.col("_named"))
    found = payloads.join(named, same, "left_semi")
    return snapshot_points(found.select("data", "facets"), indicators)
