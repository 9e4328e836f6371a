"""Indicator metadata as tables: merging, checking, selecting, profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.ids import (
    CATALOGUED_PREFIX,
    REPUBLISHED_PREFIX,
    id_agency,
    id_code,
    id_dimensions,
)
from panelwright.schema import DEFAULT_SOURCE, DENOMINATOR_TOPIC, INDICATOR, POLARITIES
from panelwright.staging import release, settle

_ONLY_DISCOVERED = [
    "source_agency",
    "code",
    "dimensions",
    "provenance_id",
    "provenance_url",
    "temporal_start",
    "temporal_end",
    "value_min",
    "value_max",
    "place_coverage",
    "facet_count",
    "upstream_source",
]


def merge_catalog(curated: DataFrame, discovered: DataFrame) -> DataFrame:
    """Curated metadata enriched with discovered metadata; curated fields win.

    Rows only discovery knows are left out. A null in a curated field counts as not given.
    """
    empty = F.create_map().cast("map<string,string>")
    found = discovered.select(
        "key",
        F.col("unit").alias("_unit"),
        F.col("unit_display").alias("_unit_display"),
        F.col("variable_id").alias("_variable_id"),
        F.col("label").alias("_label"),
        *[F.col(c) for c in _ONLY_DISCOVERED],
        F.lit(True).alias("_found"),
    )
    merged = curated.join(found, "key", "left")
    return merged.select(
        "key",
        F.col("key").alias(INDICATOR),
        F.coalesce("variable_id", "_variable_id").alias("variable_id"),
        F.coalesce("label", "_label").alias("label"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        F.coalesce("polarity", F.lit("neutral")).alias("polarity"),
        "sdg_target",
        "saturation_ceiling",
        "denominator",
        "role",
        F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source"),
        "target_value",
        "target_year",
        F.coalesce("unit", "_unit").alias("unit"),
        F.coalesce("unit_display", "_unit_display").alias("unit_display"),
        *[
            F.coalesce(c, empty).alias(c) if c == "dimensions" else F.col(c)
            for c in _ONLY_DISCOVERED
        ],
        F.coalesce("_found", F.lit(False)).alias("enriched"),
    )


def catalog_findings(curated: DataFrame, topics: DataFrame, sources: DataFrame) -> DataFrame:
    """Hard problems of curated rows, one row each: (key, code, detail)."""
    known_sources = sources.select("source").distinct().withColumn("_known", F.lit(True))
    rows = curated.withColumn("source", F.coalesce("source", F.lit(DEFAULT_SOURCE))).join(
        known_sources, "source", "left"
    )
    polarity = F.coalesce("polarity", F.lit("neutral"))

    def problem(fires: Column, code: str, detail: Column) -> Column:
        return F.when(fires, F.struct(F.lit(code).alias("code"), detail.alias("detail")))

    nothing = F.lit(None).cast("string")
    found = F.array_compact(
        F.array(
            problem(F.col("variable_id").isNull(), "MISSING_ID", nothing),
            problem(F.col("label").isNull(), "MISSING_LABEL", nothing),
            problem(~polarity.isin(POLARITIES), "INVALID_POLARITY", polarity),
            problem(F.col("_known").isNull(), "UNKNOWN_SOURCE", F.col("source")),
        )
    )
    own = rows.select("key", F.inline(found))
    unknown = (
        curated.select("key", F.explode("topics").alias("topic"))
        .where(F.col("topic") != DENOMINATOR_TOPIC)
        .join(topics.select("topic"), "topic", "left_anti")
        .select("key", F.lit("UNKNOWN_TOPIC").alias("code"), F.col("topic").alias("detail"))
    )
    return own.unionByName(unknown)


def require_valid(curated: DataFrame, topics: DataFrame, sources: DataFrame) -> DataFrame:
    """Number of problems; running it fails unless there are none."""
    n = catalog_findings(curated, topics, sources).agg(F.count("*").alias("n_problems"))
    guard = F.assert_true(F.col("n_problems") == 0, F.lit("the catalog has problems"))
    return n.where(guard.isNull())


def selectable_indicators(
    catalog: DataFrame, topics: DataFrame, topic_filter: list[str] | None = None
) -> DataFrame:
    """Indicators a person can choose, with ``topic_order`` to sort by (then by lower label).

    Denominators are out. No filter means everything. The topic that counts is the first one of
    the indicator's list that is known; without any the indicator sorts last.
    """
    chosen = catalog.where(~F.col("role").eqNullSafe(F.lit("denominator")))
    if topic_filter:
        wanted = F.array(*[F.lit(t) for t in topic_filter])
        chosen = chosen.where(F.arrays_overlap("topics", wanted))
    listed = chosen.select("key", F.posexplode("topics").alias("_pos", "topic"))
    first = (
        listed.join(topics.select("topic", "ordinal"), "topic")
        .groupBy("key")
        .agg(F.min_by("ordinal", "_pos").alias("_ordinal"))
    )
    last = topics.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).scalar()
    return (
        chosen.join(first, "key", "left")
        .withColumn("topic_order", F.coalesce("_ordinal", last))
        .drop("_ordinal")
    )


def in_selection_order(selectable: DataFrame) -> DataFrame:
    return selectable.orderBy("topic_order", F.lower("label"), "key")


def topics_of_indicators(catalog: DataFrame, topics: DataFrame) -> DataFrame:
    """(key, position, topic, ordinal) in the indicator's own order, known topics only."""
    return catalog.select("key", F.posexplode("topics").alias("position", "topic")).join(
        topics.select("topic", "ordinal"), "topic"
    )


def indicators_of_topic(catalog: DataFrame, topic: str) -> DataFrame:
    return catalog.where(F.array_contains("topics", topic))


def profile_observations(panel: DataFrame) -> DataFrame:
    """Metadata measured from the data: coverage, ranges (unrounded), facets.

    A unit or provenance is taken only when a single facet serves the indicator. The panel is
    written once. Distinct places, dates and facets are then found by hashing, one after the other
    and with numbers only beside the keys: texts in an aggregation, or several distinct counts in
    one, would sort all rows of a task, some of them several times.
    """
    served = ["unit", "unit_display", "provenance_id", "provenance_url"]
    known = panel.where(F.col("value").isNotNull() & ~F.isnan("value")).select(
        INDICATOR, "place_id", "value", "date", "facet_id", *served
    )
    known = settle(known)
    per_place = known.groupBy(INDICATOR, "place_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    places = per_place.groupBy(INDICATOR).agg(
        F.count("place_id").alias("place_coverage"), F.min("lo").alias("value_min"), F.max("hi").alias("value_max")
    )
    dates = known.select(INDICATOR, "date").distinct().groupBy(INDICATOR).agg(
        F.min("date").alias("temporal_start"), F.max("date").alias("temporal_end")
    )
    per_facet = known.where(F.col("facet_id").isNotNull()).select(INDICATOR, "facet_id", *served).distinct()
    most = [F.max(c).alias(c) for c in served]
    facets = per_facet.groupBy(INDICATOR, "facet_id").agg(*most).groupBy(INDICATOR).agg(
        F.count("facet_id").alias("facet_count"), *most
    )
    # a row each of an indicator, null ones too, which a join would lose
    rows = places.unionByName(dates, allowMissingColumns=True).unionByName(facets, allowMissingColumns=True)
    none = F.lit(0)
    profile = rows.groupBy(INDICATOR).agg(
        F.coalesce(F.max("place_coverage"), none).alias("place_coverage"),
        *[F.max(c).alias(c) for c in ("value_min", "value_max", "temporal_start", "temporal_end")],
        F.coalesce(F.max("facet_count"), none).alias("facet_count"),
        *most,
    )
    single = F.col("facet_count") == 1
    return profile.withColumns({c: F.when(single, F.col(c)) for c in served})


def discovered_rows(curated: DataFrame, profile: DataFrame) -> DataFrame:
    """Discovered metadata of curated indicators: what the id says plus what was measured."""
    v = F.col("variable_id")
    return curated.select(
        "key",
        "variable_id",
        "label",
        id_agency(v).alias("source_agency"),
        id_code(v).alias("code"),
        id_dimensions(v).alias("dimensions"),
    ).join(profile.withColumnRenamed(INDICATOR, "key"), "key", "left").fillna(
        0, subset=["place_coverage"]
    )


def upstream_producer(organisation: Column, fallback: Column) -> Column:
    """Text before the first comma, trimmed, or the fallback when that is empty."""
    return F.coalesce(
        F.nullif(F.trim(F.substring_index(organisation, ",", 1)), F.lit("")), fallback
    )


def upsert_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select("key"), "key", "left_anti").unionByName(
        new, allowMissingColumns=True
    )


#: Folders of a table in hash buckets: the number of buckets, and the bucket.
BUCKETS, BUCKET = "_buckets", "_bucket"


def _placed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    return rows.withColumns({BUCKETS: F.lit(buckets), BUCKET: place})


def _write(placed: DataFrame, path: str, mode: str) -> None:
    writer = placed.hint("rebalance", BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BUCKETS, BUCKET).parquet(path)


def write_buckets(rows: DataFrame, path: str, key: str = "key", buckets: int = 64) -> None:
    """Writes a new table in ``buckets`` folders by the hash of the key, for ``upsert_buckets``."""
    _write(_placed(rows, key, buckets), path, "error")


def read_buckets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a table in hash buckets; columns that a file lacks are null, an empty table has none."""
    return _read(spark, path, schema).drop(BUCKETS, BUCKET)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    places = [T.StructField(BUCKETS, T.IntegerType()), T.StructField(BUCKET, T.IntegerType())]
    return spark.read.schema(T.StructType([*schema.fields, *places])).parquet(path)


def upsert_buckets(new: DataFrame, path: str, schema: T.StructType, key: str = "key", buckets: int = 64) -> list[int]:
    """New rows replace those of the same key in a table of ``write_buckets``; returns the buckets rewritten.

    Only buckets that a new key falls into are read and overwritten; the others keep their files. A
    null key is a key like others, rows of ``new`` with one key all stay. Columns ``new`` lacks are
    null in its rows, columns that ``schema`` lacks are an error. A table keeps its number of buckets.
    The new content is staged before anything is replaced, so a failed call can be repeated.
    """
    if extra := set(new.columns) - set(schema.names):
        raise ValueError(f"columns the table does not have: {sorted(extra)}")
    spark = new.sparkSession
    table = _read(spark, path, schema)
    other = table.where(F.col(BUCKETS) != buckets).select(BUCKETS).first()
    if other is not None:
        raise ValueError(f"the table has {other[0]} buckets, not {buckets}")
    placed = settle(_placed(new, key, buckets))
    # at most as many numbers as there are buckets
    touched = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())
    if touched:
        mine = placed.select(BUCKET, F.col(key).alias("_key")).distinct()
        same = (table[BUCKET] == mine[BUCKET]) & table[key].eqNullSafe(mine["_key"])
        stay = table.where(F.col(BUCKET).isin(touched)).join(mine, same, "left_anti")
        content = settle(stay.unionByName(placed, allowMissingColumns=True))
        _write(content, path, "overwrite")
        release(content)
    release(placed)
    return touched


def candidate_variables(hits: DataFrame) -> DataFrame:
    """Search hits (variable_id, name) of the catalogued families as candidate metadata rows."""
    v = F.col("variable_id")
    second = F.get(F.split(v, "/"), 1)
    return hits.where(v.startswith(CATALOGUED_PREFIX) | v.startswith(REPUBLISHED_PREFIX)).select(
        F.concat(F.lit("candidate_"), F.lower(id_code(v)), F.lit("_"), second).alias("key"),
        "variable_id",
        F.coalesce("name", v).alias("label"),
        id_agency(v).alias("source_agency"),
        id_code(v).alias("code"),
        id_dimensions(v).alias("dimensions"),
        F.lit("candidate").alias("status"),
    )
