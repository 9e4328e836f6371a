"""Names, regions and selections of places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.quality import Dropped, drop_missing


def attach_place_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Adds place_name, null when there is none or it is blank."""
    named = names.where(F.col("place_name") != "").select("place_id", "place_name")
    return df.join(named, "place_id", "left")


def with_display_name(df: DataFrame) -> DataFrame:
    return df.withColumn("display_name", F.coalesce("place_name", "place_id"))


def place_parents(edges: DataFrame) -> DataFrame:
    """One parent per place; of several, the one listed last.

    ``edges`` has (parent, place_id, ordinal).
    """
    return edges.groupBy("place_id").agg(
        F.max_by("parent", F.struct("ordinal", "parent")).alias("parent")
    )


def parent_counts(parents: DataFrame, edges: DataFrame) -> DataFrame:
    """Children per parent; a parent without any counts 0."""
    return (
        parents.select("parent")
        .join(edges.select("parent", "place_id"), "parent", "left")
        .groupBy("parent")
        .agg(F.count("place_id").alias("n_places"))
    )


def filter_region(df: DataFrame, parents: DataFrame, region: str | None) -> DataFrame:
    """Adds the region of each place and keeps one region; ``None`` keeps all."""
    out = df.join(parents.select("place_id", F.col("parent").alias("region")), "place_id", "left")
    return out if region is None else out.where(F.col("region") == region)


def select_places(df: DataFrame, places: list[str] | DataFrame) -> DataFrame:
    if isinstance(places, DataFrame):
        return df.join(places.select("place_id"), "place_id", "left_semi")
    return df.where(F.col("place_id").isin(list(places)))


def attach_population(df: DataFrame, population: DataFrame) -> Dropped:
    """Sizes points by population; those it does not cover are dropped with a report."""
    sized = df.join(population.select("place_id", "population"), "place_id", "left")
    return drop_missing(sized, ["population"], "no population figure available to size the point")
