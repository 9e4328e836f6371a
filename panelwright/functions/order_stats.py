"""Exact quantiles, ranks and running totals that do not depend on a group fitting in one task.

Values are ordered by a whole number each (``with_order_key``). Rows are summed by the 22 leading
bits of that number first; a quantile then needs only the rows of the few buckets it lies in, and
they are found by a join, not shuffled as a whole. Within these buckets rows are summed by 43 bits
and by all 64 at once. The sum before a number is that of the buckets before its own on each level.
A window spans at most the buckets of one digit, 2 to 4 million rows, whatever the size of the key;
nothing is sampled, written or switched by size. Null keys are a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.staging import settle

# Bits below the two leading digits of an order key.
_TOP, _MIDDLE = 42, 21
_MANTISSA, _BIAS = 52, 1023
_LEAST_NORMAL, _LEAST = 2.0**-1022, 2.0**-1074
#: Weights are taken to so many decimals, so that their sums are exact in any order.
WEIGHT = "decimal(38,12)"


def with_order_key(df: DataFrame, value: str, out: str = "_key") -> DataFrame:
    """Adds a whole number that orders as the double does, infinities included; both zeros are 0.

    It is the number its sign, exponent and mantissa make up. Null for null and NaN. Each step has
    a name that the next refers to, so that none is worked out twice.
    """
    size = F.abs("_double")
    normal = (size >= _LEAST_NORMAL) & (size < float("inf"))
    unit = 1 << _MANTISSA

    def power(exponent: str) -> Column:
        return F.pow(F.lit(2.0), F.col(exponent))

    # the logarithm may be off by one next to a power of two
    off = F.when(F.col("_part") >= 2, 1.0).when(F.col("_part") < 1, -1.0).otherwise(0.0)
    part = (F.col("_plain") / power("_octave") - 1) * float(unit)
    bits = (
        F.when(normal, (F.col("_octave") + _BIAS).cast("bigint") * unit + part.cast("bigint"))
        .when(size == float("inf"), F.lit((2 * _BIAS + 1) * unit))
        .when(size < _LEAST_NORMAL, (size / F.lit(_LEAST)).cast("bigint"))
    )
    steps = {
        "_double": F.col(value).cast("double"),
        "_plain": F.when(normal, size).otherwise(1.0),
        "_near": F.floor(F.log2("_plain")).cast("double"),
        "_part": F.col("_plain") / power("_near"),
        "_octave": F.col("_near") + off,
        out: bits * F.when(F.col("_double") < 0, -1).otherwise(1),
    }
    return df.select("*", *[c.alias(name) for name, c in steps.items()]).drop(*[n for n in steps if n != out])


def same(keys: Sequence[str], prefix: str = "_k_") -> Column:
    """Equal keys on both sides of a join whose right side has them under ``prefix``; null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def renamed(df: DataFrame, keys: Sequence[str], prefix: str = "_k_") -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}" if c in keys else c) for c in df.columns])


def join_keys(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on ``keys``, where null equals null; the keys stay once."""
    joined = df.join(renamed(other, keys), same(keys), how)
    return joined.select(*df.columns, *[c for c in other.columns if c not in keys])


def value_cells(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """A row for each known value of a key: ``_key``, ``_v`` and the rows (or the weight) ``_n``."""
    return _summed(_weighed(df, keys, value, weight), [*keys, "_key"])


def _weighed(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None) -> DataFrame:
    weight = F.lit(1).cast("bigint") if weight is None else weight
    rows = df.select(*keys, (F.col(value).cast("double") + 0.0).alias("_v"), weight.alias("_n"))
    return with_order_key(rows, "_v").where(F.col("_key").isNotNull())


def _summed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.max("_v").alias("_v"), F.sum("_n").alias("_n"))


def sums_before(
    rows: DataFrame, keys: Sequence[str], wanted: Callable[[Column, Column, Column], Column] | None = None
) -> DataFrame:
    """A row for each number ``_key`` of a key: ``_v``, ``_n``, ``_before`` (the sum of ``_n`` at the
    smaller numbers) and ``_all``. ``rows`` has ``_key``, ``_v`` and ``_n``.

    ``wanted`` says of a range of sums (what is before it, its own, the key's) whether its numbers
    are of interest; others are left out.
    """
    keys = list(keys)

    def earlier(window):
        return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    rows = rows.withColumn("_p1", F.shiftright("_key", _TOP))
    of_key = Window.partitionBy(*keys)
    top = rows.groupBy(*keys, "_p1").agg(F.sum("_n").alias("_n")).select(
        *keys, "_p1", "_n", earlier(of_key.orderBy("_p1")).alias("_b1"), F.sum("_n").over(of_key).alias("_all")
    )
    if wanted is not None:
        top = top.where(wanted(F.col("_b1"), F.col("_n"), F.col("_all")))
    inside = join_keys(rows, top.drop("_n"), [*keys, "_p1"])

    # Both lower levels in one table: buckets of 43 bits among those of 22, and numbers among these.
    second = F.shiftright("_key", _MIDDLE)
    levels = F.array(
        F.struct(F.lit(False).alias("low"), F.col("_p1").alias("above"), second.alias("at")),
        F.struct(F.lit(True).alias("low"), second.alias("above"), F.col("_key").alias("at")),
    )
    cells = inside.select(*keys, "_v", "_n", "_b1", "_all", F.inline(levels).alias("_low", "_above", "_at"))
    cells = cells.groupBy(*keys, "_low", "_above", "_at").agg(
        F.max("_v").alias("_v"), F.sum("_n").alias("_n"), F.max("_b1").alias("_b1"), F.max("_all").alias("_all")
    )
    siblings = Window.partitionBy(*keys, "_low", "_above").orderBy("_at")
    cells = cells.withColumn("_b", earlier(siblings))
    family = Window.partitionBy(*keys, F.when(F.col("_low"), F.col("_above")).otherwise(F.col("_at")))
    cells = cells.withColumn("_b2", F.max(F.when(~F.col("_low"), F.col("_b"))).over(family))
    before = (F.col("_b1") + F.col("_b2") + F.col("_b")).alias("_before")
    return cells.where("_low").select(*keys, F.col("_at").alias("_key"), "_v", "_n", before, "_all")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    weight: str | None = None,
    count: str | None = None,
) -> DataFrame:
    """One row per key with a column per named quantile, linearly interpolated.

    ``count`` names a column for the number of known values. ``weight`` is a whole number of times that a row counts. Keys without a known value have no row.
    """
    keys = list(keys)
    cells = _weighed(df, keys, value, F.col(weight).cast("bigint") if weight else None)

    def places(p: float, total: Column) -> tuple[Column, Column, Column]:
        at = F.lit(float(p)) * (total - 1)
        return at, F.floor(at), F.ceil(at)

    def inside(rank: Column, before: Column, n: Column) -> Column:
        return (rank >= before) & (rank < before + n)

    def any_of(before: Column, n: Column, total: Column) -> Column:
        out = F.lit(False)
        for p in probs.values():
            _, low, high = places(p, total)
            out = out | inside(low, before, n) | inside(high, before, n)
        return out

    found = sums_before(cells, keys, any_of)
    picked, out = [F.max("_all").alias("_all")], []
    for i, (name, p) in enumerate(probs.items()):
        at, low, high = places(p, F.col("_all"))
        for side, rank in (("low", low), ("high", high)):
            picked.append(F.max(F.when(inside(rank, F.col("_before"), F.col("_n")), F.col("_v"))).alias(f"_{side}{i}"))
        a, b = F.col(f"_low{i}"), F.col(f"_high{i}")
        out.append(F.when((a == b) | (at == low), a).otherwise(a + (b - a) * (at - low)).alias(name))
    number = [F.col("_all").alias(count)] if count else []
    return found.groupBy(*keys).agg(*picked).select(*keys, *out, *number)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], measure: str, out: str, total: str | None = None
) -> DataFrame:
    """Adds the running sum of ``measure`` per key in ``order``, and the key's total.

    For orders that no number stands for, such as those by text. ``order`` has to be a total order
    within the key. Rows are range partitioned on (keys, order), which also splits a single large
    key, written once so the partitions stay as they are, summed within each partition, and
    shifted by the totals of the partitions before it.
    """
    keys = list(keys)
    ranged = settle(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    parts = ranged.groupBy(*keys, "_part").agg(F.sum(measure).alias("_part_sum"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_part_sum").over(before), F.lit(0)).alias("_shift"),
        F.sum("_part_sum").over(whole).alias("_key_total"),
    )
    run = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = join_keys(ranged.withColumn("_part_run", F.sum(measure).over(run)), parts, [*keys, "_part"])
    summed = summed.withColumn(out, F.col("_shift") + F.col("_part_run"))
    if total:
        summed = summed.withColumn(total, F.col("_key_total"))
    return summed.drop("_part", "_part_run", "_shift", "_key_total")


def percentile_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str, higher_is_worse: bool = True
) -> DataFrame:
    """Average-tie rank over the non-null count, in (0, 1]; null values keep a null rank.

    ``higher_is_worse=False`` turns it round, so 1 always means most in need of attention.
    """
    return percentile_ranks(df, keys, {out: (value, higher_is_worse)})


def percentile_ranks(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, bool]]) -> DataFrame:
    """``percentile_rank`` for several columns: the new column's name to (value, higher is worse)."""
    keys = list(keys)
    out = df
    share = (F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_all")
    for value in dict.fromkeys(v for v, _ in wanted.values()):
        ranks = [(share if up else 1 - share).alias(name) for name, (v, up) in wanted.items() if v == value]
        cells = sums_before(value_cells(df, keys, value), keys)
        cells = renamed(cells.select(*keys, "_key", *ranks), [*keys, "_key"])
        joined = with_order_key(out, value).join(cells, same(keys) & (F.col("_key") == F.col("_k__key")), "left")
        out = joined.drop("_key", "_k__key", *[f"_k_{k}" for k in keys])
    return out.select(*df.columns, *wanted)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows per key. Spark limits each key to ``n`` rows before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_position", position).where(F.col("_position") <= n)
    if rank:
        return out.withColumn(rank, F.col("_position").cast("bigint")).drop("_position")
    return out.drop("_position")
