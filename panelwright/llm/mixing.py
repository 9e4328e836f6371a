"""Mixing sources to target weights by Pareto order sampling.

Sources get targets in proportion to their weights, at most ``MOST_COPIES`` times their size; what
is above goes to the others by weight. A source with target ``t`` and size ``z`` takes each of its
documents ``floor(t / z)`` times for certain. For the rest, documents are ranked by Pareto's
``(u / (1 - u)) / (p / (1 - p))``: random odds, from a hash of the id, divided by inclusion odds.
Within a source the inclusion odds are a common factor, which no rank depends on, times a
preference between 1/2 and 2: the document's size relative to the source's mean. Documents are
taken in rank order while they fit into what is left to take, and one last document, the one
whose size is nearest to what is still missing, closes the gap if that brings it nearer.

Everything is exact and depends on ids, sizes and sources alone, so reruns agree. Ranks are found
by a histogram of ranks per source and a running total inside single cells of it: no source, however
large, is ranked by one task.

A null text has size 0; a null source is a source of its own, last in order; a null id is one id.
Rows equal in id, size and source are taken or left together. Sources of size 0 take nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwright.llm.common import documents, fresh, query, settle, word_count

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Cells of the histogram of ranks.
CELLS = 4096


def source_key(source: Column) -> Column:
    """A text that is never null and orders like the source, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def odds(doc_id: Column) -> Column:
    """Random odds ``u / (1 - u)`` of an id; ``u`` has 52 bits of a digest."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return u / (1 - u)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Target of each source, from one row for each with ``skey``, ``docs`` and ``source_size``.

    The level to which weights are multiplied is found by ordering the sources by the level at
    which they reach their limit. There is one row per source here, whatever their size.
    """
    by_name = Window.orderBy("skey")
    by_level = Window.orderBy("_level", "skey").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    nth = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (nth + 1).cast("int"))
    weighed = sizes.withColumn("_weight", weight).withColumn("_limit", F.lit(float(MOST_COPIES)) * F.col("source_size"))
    ranked = weighed.withColumn("_level", F.col("_limit") / F.col("_weight")).select(
        "*",
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(by_level), F.lit(0.0))).alias("_left"),
        (F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(by_level), F.lit(0.0))).alias("_weights"),
    )
    free = F.col("_level") > F.col("_left") / F.col("_weights")
    level = F.min(F.when(free, F.struct("_level", "skey", (F.col("_left") / F.col("_weights")).alias("level")))).over(whole)
    return ranked.select(
        "skey",
        "source_size",
        "docs",
        F.when(free, F.col("_weight") * level["level"]).otherwise(F.col("_limit")).alias("target"),
    )


def sample_plan(narrow: DataFrame) -> DataFrame:
    """For each source: whole copies, and which ranks and which last document are taken.

    ``narrow`` has ``skey``, ``_id``, ``_odds`` and ``size``.
    """
    sizes = narrow.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = settle(
        source_targets(sizes)
        .withColumn("whole", F.floor(share))
        .withColumn("_rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    # rows that can't be told apart are one unit
    units = settle(
        narrow.filter("size > 0")
        .groupBy("skey", "_id", "_odds", "size")
        .agg(F.count("*").alias("_same"))
        .join(targets, "skey")
        .select(
            "skey",
            "_id",
            "size",
            (F.col("size") * F.col("_same")).alias("_all"),
            "_rest",
            rank(F.col("_odds"), F.col("size"), F.col("source_size"), F.col("docs")).alias("_rank"),
        )
        .withColumn("_cell", F.floor(CELLS * (F.col("_rank") / (1 + F.col("_rank")))))
    )
    cells = units.groupBy("skey", "_cell", "_rest").agg(F.sum("_all").alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("skey").orderBy("_cell"))
    cells = cells.select("skey", "_cell", "_rest", (upto - F.col("_words")).alias("_start"), upto.alias("_end"))
    last = cells.filter("_start <= _rest and _end > _rest").select("skey", "_cell", "_start")
    order = ["_rank", "_id", "size"]
    inside = Window.partitionBy("skey", "_cell").orderBy(*order)
    fits = (
        units.join(last, ["skey", "_cell"])
        .withColumn("_upto", F.col("_start") + F.sum("_all").over(inside))
        .filter("_upto <= _rest")
        .groupBy("skey")
        .agg(F.max(F.struct(*order)).alias("_cut"), F.max("_upto").alias("_got"))
    )
    # where nothing of the last cell fits, all cells before it were taken
    cuts = settle(
        targets.join(last.withColumnRenamed("_cell", "_last"), "skey", "left")
        .join(fits, "skey", "left")
        .withColumn("_got", F.coalesce("_got", "_start", F.least("source_size", "_rest")))
        .withColumn("_gap", F.when(F.col("_last").isNotNull(), F.col("_rest") - F.col("_got")).otherwise(0.0))
    )
    closing = (
        units.join(cuts.select("skey", "_last", "_cut", "_gap"), "skey")
        .filter((F.col("_gap") > 0) & ~taken(*order))
        .filter(F.abs(F.col("_all") - F.col("_gap")) < F.col("_gap"))
        .groupBy("skey")
        .agg(F.min(F.struct(F.abs(F.col("_all") - F.col("_gap")).alias("_off"), *order)).alias("_close"))
    )
    return cuts.join(closing, "skey", "left").select(
        "skey", "source_size", "docs", "target", "whole", "_last", "_cut", "_close"
    )


def rank(own_odds: Column, size: Column, source_size: Column, docs: Column) -> Column:
    """Random odds over the part of the inclusion odds that differs within a source."""
    return own_odds / F.greatest(F.lit(0.5), F.least(F.lit(2.0), size * docs / source_size))


def taken(rank_: str, id_: str, size: str) -> Column:
    """Whether a document ranks up to where its source's sample ends."""
    cell = F.floor(CELLS * (F.col(rank_) / (1 + F.col(rank_))))
    inside = F.struct(F.col(rank_).alias("_rank"), F.col(id_).alias("_id"), F.col(size).alias("size")) <= F.col("_cut")
    return F.coalesce((cell < F.col("_last")) | ((cell == F.col("_last")) & F.coalesce(inside, F.lit(False))), F.lit(False))


def mixed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``copies`` and what it was derived from, and the names of these columns."""
    names = {x: fresh(docs, f"mix_{x}") for x in ("skey", "_id", "_odds", "size")}
    sized = docs.withColumns(
        {
            names["skey"]: source_key(F.col("source")),
            names["_id"]: F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            names["_odds"]: odds(F.col("doc_id")),
            names["size"]: F.coalesce(word_count(F.col("text")), F.lit(0).cast("long")),
        }
    )
    narrow = settle(sized.select(*[F.col(v).alias(k) for k, v in names.items()]))
    plan = settle(sample_plan(narrow))
    more = {x: fresh(docs, f"plan_{x}") for x in ("rank", "copies")}
    plan = plan.withColumnRenamed("skey", names["skey"])
    joined = sized.join(plan, names["skey"]).withColumn(
        more["rank"],
        rank(F.col(names["_odds"]), F.col(names["size"]), F.col("source_size"), F.col("docs")),
    )
    me = F.struct(F.col(more["rank"]).alias("_rank"), F.col(names["_id"]).alias("_id"), F.col(names["size"]).alias("size"))
    closes = F.coalesce(me == F.struct("_close._rank", "_close._id", "_close.size"), F.lit(False))
    extra = (taken(more["rank"], names["_id"], names["size"]) | closes) & (F.col(names["size"]) > 0)
    copies = F.col("whole") + F.when(extra, 1).otherwise(0)
    return joined.withColumn(more["copies"], copies), {**names, **more}


def mix(docs: DataFrame) -> DataFrame:
    """The mixture: each document as often as the mix takes it, with the columns it came with."""
    clash = {c: fresh(docs, f"own_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    inner, at = mixed(docs.withColumnsRenamed(clash))
    back = [F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns]
    times = F.array_repeat(F.lit(0), F.col(at["copies"]).cast("int"))
    return inner.withColumn("_time", F.explode(times)).select(*back)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS z, count(*) AS n,
         [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
lev AS (SELECT *, 3.0::DOUBLE * z AS lim, (3.0::DOUBLE * z) / w AS lvl FROM s),
run AS (
  SELECT *, (sum(z) OVER ())::DOUBLE - coalesce(sum(lim) OVER before, 0) AS rest_w,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest_k
  FROM lev WINDOW before AS (ORDER BY lvl, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lam AS (SELECT rest_w / rest_k AS v FROM run WHERE lvl > rest_w / rest_k ORDER BY lvl, source NULLS LAST LIMIT 1),
t AS (
  SELECT *, CASE WHEN lvl > rest_w / rest_k THEN w * (SELECT v FROM lam) ELSE lim END AS target FROM run),
p AS (
  SELECT *, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END::BIGINT AS whole FROM t),
q AS (
  SELECT d.*, p.z, p.target, p.whole, p.target - p.whole * p.z AS rest,
         (u / (1 - u)) / greatest(0.5, least(2.0, (size * n)::DOUBLE / z)) AS rnk
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (
  SELECT *, sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rnk, coalesce(doc_id::VARCHAR, ''), size) AS upto
  FROM q),
f AS (SELECT *, size > 0 AND upto <= rest AS fits FROM c),
g AS (SELECT *, rest - coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source), 0) AS gap FROM f),
h AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 AND NOT fits AND gap > 0 AND abs(size - gap) < gap
         THEN abs(size - gap) END NULLS LAST, rnk, coalesce(doc_id::VARCHAR, ''), size) = 1
         AND size > 0 AND NOT fits AND gap > 0 AND abs(size - gap) < gap AS closes
  FROM g)
SELECT doc_id, size, z AS source_size, target,
       (size * (whole + CASE WHEN fits OR closes THEN 1 ELSE 0 END))::BIGINT AS taken
FROM h
"""


@query("op10_pareto_mix", ORACLE)
def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = mixed(documents(spark, sf_dir).select("doc_id", "source", "text"))
    size = F.col(at["size"])
    return docs.select(
        "doc_id", size.alias("size"), "source_size", "target", (size * F.col(at["copies"])).alias("taken")
    )
