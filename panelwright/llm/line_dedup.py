"""Line dedup by overlapping windows of three lines.

Every three consecutive lines are hashed as one window; a text of one or two lines is one window
of all its lines. A window that occurs again, later in the order of (doc_id, position), covers its
lines there; windows of blank lines only are no windows. Covered lines are removed, the rest is
joined again. Every removed line equals a line at an earlier place, so the first of them stays.

A null text stays null and has no lines; an empty text is one blank line. Null ids come first.
Rows equal in id and text are one occurrence and get the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import documents, query

LINES = 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, not again for each element of a lambda inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(text: Column) -> Column:
    """(position, hash, lines) of each window of a text."""

    def of_lines(lines: Column) -> Column:
        def window(at: Column) -> Column:
            part = F.slice(lines, at + 1, LINES)
            return F.struct(
                at.alias("at"),
                F.xxhash64(F.transform(part, lambda x: F.xxhash64(x))).alias("window"),
                F.forall(part, lambda x: F.length(F.btrim(x, F.lit(" \t\r\x0b\x0c"))) == 0).alias("blank"),
            )

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - LINES, F.lit(0))), window)

    return _let(F.split(text, "\n", -1), of_lines)


def repeats(docs: DataFrame) -> DataFrame:
    """``_id``, ``_text``, ``at``: the later occurrences of every window that occurs again.

    The first occurrence of each window comes from an aggregate that combines on the map side;
    it is joined back on the window's hash, which Spark can split where one window is very common.
    """
    windows = (
        docs.filter(F.col("text").isNotNull())
        .select(
            F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), F.explode(_windows(F.col("text"))).alias("w")
        )
        .select("_id", "_text", "w.at", "w.window", "w.blank")
        .filter(~F.col("blank"))
        .drop("blank")
    )
    place = F.struct("_id", "_text", "at")
    firsts = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    return windows.join(firsts.drop("last"), "window").filter(place != F.col("first")).select("_id", "_text", "at")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed`` and the remaining ``text`` of every document."""
    covered = repeats(docs).groupBy("_id", "_text").agg(F.collect_set("at").alias("_starts"))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("_own"))
    both = own.join(covered, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("_own") == F.col("_text")), "left")

    def rest(lines: Column) -> Column:
        """How many lines there are, how many stay, and these, joined."""
        end = F.size(lines) - 1
        starts = F.coalesce("_starts", F.array().cast("array<int>"))
        inside = _let(end, lambda n: F.flatten(F.transform(starts, lambda at: F.sequence(at, F.least(at + LINES - 1, n)))))
        stay = F.array_except(F.sequence(F.lit(0), end), inside)
        return _let(
            stay,
            lambda kept: F.struct(
                F.size(lines).alias("all"),
                F.size(kept).alias("kept"),
                F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
            ),
        )

    found = both.select("doc_id", F.col("text").isNull().alias("_none"), _let(F.split("text", "\n", -1), rest).alias("_rest"))
    return found.select(
        "doc_id",
        F.when(F.col("_none"), 0).otherwise(F.col("_rest.all")).cast("long").alias("n_lines"),
        F.when(F.col("_none"), 0).otherwise(F.col("_rest.all") - F.col("_rest.kept")).cast("long").alias("n_removed"),
        F.when(~F.col("_none"), F.col("_rest.text")).alias("text"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS x FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
w AS (
  SELECT doc_id, text, x, i0::INT AS p0, array_to_string(x[i0 + 1 : i0 + 3], chr(10)) AS win
  FROM l, unnest(range(0, greatest(len(x) - 3, 0) + 1)) AS t(i0)),
v AS (
  SELECT *, row_number() OVER (PARTITION BY win, least(len(x), 3) ORDER BY doc_id NULLS FIRST, md5(text), p0) AS nth
  FROM w WHERE regexp_matches(win, '[^ \t\r\x0b\x0c\n]')),
c AS (
  SELECT doc_id, text, count(DISTINCT p) AS n, list(DISTINCT p) AS ps
  FROM v, unnest(range(p0, least(p0 + 3, len(x)))) AS t(p) WHERE nth > 1 GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL WHEN c.n IS NULL THEN d.text ELSE
    coalesce(array_to_string(list_transform(list_filter(range(0, len(string_split(d.text, chr(10)))), lambda i: NOT list_contains(c.ps, i)),
      lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)), '') END AS text
FROM documents d LEFT JOIN c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text = c.text
"""


@query("op4_line_windows", ORACLE)
def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))
