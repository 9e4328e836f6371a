"""One huge JSON document read by many tasks.

Spark's text reader cuts the file at ``}`` and deals it by byte ranges. Whether a fragment begins
inside a string, how deep it lies and which record it belongs to are prefix sums: of quotes, of
brackets outside strings, and of records that end before it. Each sum is taken within a byte range
and shifted by the totals of the ranges before it, of which there is one row each; so no task sees
more than a range, and a record may lie across ranges. Records are put together again from their
fragments and parsed with ``from_json`` inside the brackets they stood in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.schema import GEOMETRY_COLLECTION, PAYLOAD
from panelwright.staging import settle

_RANGE = ["_file", "_block"]
#: Records a window spans when a name is carried on to the records below it.
_CARRIED = 100_000


def _count(text: Column, kinds: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kinds}]", ""))


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments in their order, with what they add to each sum if they begin outside or inside a string."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.concat("value", F.lit("}")).alias("_text"),
    )
    plain = F.regexp_replace("_text", r"(?s)\\.", "")

    def shown(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '"[^"]*$', "")

    rows = rows.select("*", plain.alias("_plain"))
    rows = rows.select(
        *_RANGE, "_at", "_text",
        _count(F.col("_plain"), '"').alias("_quotes"),
        F.array(shown(F.col("_plain")), shown(F.regexp_replace("_plain", '^[^"]*("|$)', ""))).alias("_shown"),
    )
    return settle(
        rows.select(
            *_RANGE, "_at", "_text", "_quotes",
            F.transform("_shown", lambda x: _count(x, r"\[{") - _count(x, r"\]}")).alias("_deltas"),
            F.transform("_shown", lambda x: x.endswith("}")).alias("_closings"),
        )
    )


def _sum_before(rows: DataFrame, what: str, out: str) -> DataFrame:
    """Adds the sum of ``what`` over all fragments of the file before each."""
    blocks = rows.groupBy(*_RANGE).agg(F.sum(what).alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*_RANGE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(*_RANGE).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(what).over(inside), F.lit(0)))
    return rows.join(blocks, _RANGE).withColumn(out, F.col("_carry") + F.col("_own")).drop("_carry", "_own")


def split_records(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """``_file``, ``_record`` (its number), ``body``, ``opened``, ``left``.

    A record ends with a ``}`` after which ``depth`` brackets are open. ``body`` is its text with
    what opened since the record before; ``opened`` brackets are open before it and ``left`` after
    it. What follows the last record of a document is a body too.
    """
    rows = _sum_before(_fragments(spark, path), "_quotes", "_quoted")
    state = (F.col("_quoted") % 2).cast("int")
    rows = rows.select(
        *_RANGE, "_at", "_text", F.get("_deltas", state).alias("_delta"), F.get("_closings", state).alias("_closes")
    )
    rows = _sum_before(rows, "_delta", "_depth")
    ends = F.col("_closes") & (F.col("_depth") + F.col("_delta")).isin(depth, 0)
    rows = _sum_before(rows.withColumn("_ends", ends.cast("int")), "_ends", "_record")
    place = F.struct("_block", "_at")
    pieces = F.array_sort(F.collect_list(F.struct("_block", "_at", "_text")))
    records = rows.groupBy("_file", "_record").agg(
        F.array_join(F.transform(pieces, lambda p: p["_text"]), "").alias("_text"),
        F.min_by("_depth", place).alias("_depth"),
        F.max_by(F.col("_depth") + F.col("_delta"), place).alias("left"),
    )
    closed = F.regexp_extract("_text", r"^[\s,}\]]*", 0)
    body = F.substring("_text", F.length(closed) + 1, F.length("_text"))
    # the reader's last fragment is what follows the last bracket: its own bracket was not there
    body = F.when(F.col("left") < 0, F.regexp_replace(body, r"\}$", "")).otherwise(body)
    return records.select(
        "_file", "_record", body.alias("body"), (F.col("_depth") - _count(closed, r"\]}")).alias("opened"),
        F.greatest("left", F.lit(0)).alias("left"),
    ).where(F.trim("body") != "")


def _wrapped(openers: list[str], closers: list[str]) -> Column:
    """The body between the brackets that are open before it and those that are after it."""
    before, after = F.lit(""), F.lit("")
    for i in range(1, len(openers) + 1):
        before = F.when(F.col("opened") == i, "".join(openers[:i])).otherwise(before)
        after = F.when(F.col("left") == i, "".join(reversed(closers[:i]))).otherwise(after)
    return F.concat(before, "body", after)


def read_geometry_parts(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections in the shape of ``GEOMETRY_COLLECTION``, a feature each."""
    records = split_records(spark, path, 2)
    text = _wrapped(["{", '"features":['], ["}", "]"])
    parsed = records.select(F.from_json(text, GEOMETRY_COLLECTION).alias("_c")).select("_c.*")
    return parsed.where(F.size("features") > 0)


def read_payload_parts(spark: SparkSession, path: str) -> DataFrame:
    """Payload documents in the shape of ``PAYLOAD``: a row for each place of a variable, with its facet.

    A file may hold several documents, one after the other, that describe a facet alike.
    """
    records = split_records(spark, path, 3)
    text = _wrapped(["{", '"data":{', '"":{'], ["}", "}", "}"])
    parsed = settle(records.select("_file", "_record", F.from_json(text, PAYLOAD).alias("_p")).select("_file", "_record", "_p.*"))
    rows = parsed.select("_file", "_record", F.explode("data").alias("_variable", "_places"))
    rows = rows.select("_file", "_record", F.nullif("_variable", F.lit("")).alias("_variable"), F.explode("_places").alias("_place", "_obs"))

    # A record below another of the same variable does not say its name: the last one said holds.
    rows = rows.withColumn("_group", F.floor(F.col("_record") / _CARRIED))
    said = F.max_by("_variable", F.when(F.col("_variable").isNotNull(), F.col("_record")))
    groups = rows.groupBy("_file", "_group").agg(said.alias("_said"))
    earlier = Window.partitionBy("_file").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_file", "_group", F.last("_said", ignorenulls=True).over(earlier).alias("_said"))
    upto = Window.partitionBy("_file", "_group").orderBy("_record").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_variable", F.last("_variable", ignorenulls=True).over(upto)).join(groups, ["_file", "_group"])
    rows = rows.withColumn("_variable", F.coalesce("_variable", "_said"))

    facets = parsed.select("_file", F.explode("facets").alias("_id", "_facet"))
    facets = facets.groupBy("_file", "_id").agg(F.min("_facet").alias("_facet"))
    found = rows.join(facets, (rows["_file"] == facets["_file"]) & (F.col("_obs.facet") == F.col("_id")), "left")
    described = F.map_from_entries(
        F.array_compact(F.array(F.when(F.col("_id").isNotNull(), F.struct("_id", "_facet"))))
    )
    data = F.create_map("_variable", F.create_map("_place", "_obs"))
    return found.select(data.alias("data"), described.alias("facets"))
