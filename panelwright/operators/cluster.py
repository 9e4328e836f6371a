"""Groups of places that look alike on a few standardised indicators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.bins import to_wide
from panelwright.sources.catalog import selectable_indicators
from panelwright.staging import settle


def feature_keys(
    catalog: DataFrame, topics: DataFrame, target: str, siblings: int = 2
) -> list[str]:
    """The target and the first enriched selectable indicators sharing a topic with it."""
    own = catalog.where(F.col("key") == target).select("topics").first()
    if own is None:
        return []
    near = (
        selectable_indicators(catalog, topics, list(own["topics"] or []))
        .where(F.col("enriched") & (F.col("key") != target))
        .orderBy("topic_order", F.lower("label"), "key")
        .limit(siblings)
    )
    return [target] + [r["key"] for r in near.select("key").collect()]


def feature_matrix(latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Places that have every listed indicator, one column each: a single shuffle on the place."""
    return to_wide(latest, ["place_id"], keys).na.drop(subset=list(keys))


class Archetypes(NamedTuple):
    labels: DataFrame
    centers: DataFrame
    silhouettes: dict[int, float]
    k_used: int


# Bits of a column's largest value, and units of a standard deviation, in whole numbers.
VALUE_BITS, UNIT = 40, 1 << 16
MAX_ROUNDS = 25

Centre = tuple[int, ...]


def compute_archetypes(
    features: DataFrame,
    columns: Sequence[str],
    k: int | None = None,
    k_range: Sequence[int] = range(2, 7),
    n_init: int = 10,
    seed: int = 0,
) -> Archetypes | None:
    """K-means on standardised columns; k is the one with the best silhouette unless given.

    Values, centres and distances are whole numbers, so sums are exact and the groups depend on
    the rows alone, not on their order or partitions. All sizes and starts advance together, one
    aggregate a round; the driver holds centres only. A start's first centre is the place with the
    least hash of its id, each further one the place farthest from those before it; each k keeps
    the cheapest of ``n_init`` starts. The silhouette is that of squared Euclidean distance,
    because the plain one needs all pairs of places. Groups are numbered in the order of their
    centres. Returns None for fewer rows than the smallest k, or when no k gives two groups.
    """
    columns = list(columns)
    clean = features.select("place_id", *columns).na.drop()
    largest = clean.agg(F.count("*"), *[F.max(F.abs(F.col(f"`{c}`"))) for c in columns]).first()
    n, largest = largest[0], largest[1:]
    sizes = [x for x in ([k] if k is not None else k_range) if x < n]
    if n < min(k_range) or not sizes:
        return None
    units = [2.0 ** (math.frexp(x)[1] - VALUE_BITS) if x else 1.0 for x in largest]
    whole = [F.round(F.col(f"`{c}`") / u).cast("bigint") for c, u in zip(columns, units)]
    exact = [F.sum(v.cast("decimal(20,0)") * x) for v in whole for x in (F.lit(1), v.cast("decimal(18,0)"))]
    sums = [int(x) for x in clean.agg(*exact).first()]
    middles = [s / n for s in sums[::2]]
    spreads = [math.sqrt(n * q - s * s) / n for s, q in zip(sums[::2], sums[1::2])]
    scaled = [
        F.floor((v - F.lit(m)) * F.lit(UNIT / sd if sd else 0.0) + 0.5).cast("bigint") for v, m, sd in zip(whole, middles, spreads)
    ]
    points = settle(clean.select("place_id", *[F.col(f"`{c}`") for c in columns], F.array(*scaled).alias("_z")))

    starts = _farthest_first(points, max(sizes), n_init, seed)
    keys = [(size, start) for size in sizes for start in range(n_init)]
    groups = [starts[start][:size] for size, start in keys]
    found = _rounds(points, groups)
    silhouettes, kept = {}, {}
    for size in sizes:
        own = [i for i, key in enumerate(keys) if key[0] == size]
        best = min(own, key=lambda i: (found[i].cost, i))
        kept[size] = found[best]
    judged = {size: g for size, g in kept.items() if sum(c > 0 for c in g.counts) > 1}
    if not judged:
        return None
    silhouettes = dict(zip(judged, _silhouettes(points, list(judged.values()), n)))
    used = max(silhouettes, key=lambda size: (silhouettes[size], -size))
    centres = sorted(c for c, m in zip(kept[used].centres, kept[used].counts) if m)
    nearest = F.expr(f"{_nearest(_literal([centres]))}[0].j")
    labels = settle(points.select("place_id", *[F.col(f"`{c}`") for c in columns], nearest.cast("int").alias("cluster")))
    centers = labels.groupBy("cluster").agg(*[F.avg(f"`{c}`").alias(c) for c in columns])
    return Archetypes(labels.select("place_id", "cluster"), centers, silhouettes, used)


class _Grouping(NamedTuple):
    centres: list[Centre]
    counts: list[int]
    sums: list[list[int]]
    squares: list[int]
    cost: int


def _literal(groups: Sequence[Sequence[Sequence[int]]]) -> str:
    """Centres of several groupings as a SQL literal."""
    one = lambda c: f"array({', '.join(f'{x}L' for x in c)})"
    return f"array({', '.join('array(' + ', '.join(one(c) for c in g) + ')' for g in groups)})"


def _nearest(groups: str) -> str:
    """For each grouping the squared distance and number of the centre next to a point."""
    square = "aggregate(zip_with(_z, c, (a, b) -> (a - b) * (a - b)), 0L, (s, x) -> s + x)"
    return f"transform({groups}, g -> array_min(transform(g, (c, j) -> struct({square} AS d, j AS j))))"


def _farthest_first(points: DataFrame, k: int, n_init: int, seed: int) -> list[list[Centre]]:
    """``k`` centres for each start. Ties go to the lower place id."""
    numbers = F.explode(F.array(*[F.lit(seed + i) for i in range(n_init)])).alias("_start")
    rank = F.struct(F.md5(F.concat("place_id", F.lit("#"), F.col("_start").cast("string"))), "place_id")
    rows = points.select("place_id", "_z", numbers).groupBy("_start").agg(F.min_by("_z", rank).alias("_z")).collect()
    starts = [[tuple(r["_z"])] for r in sorted(rows, key=lambda r: r["_start"])]
    for _ in range(k - 1):
        near = points.select("place_id", "_z", F.posexplode(F.expr(_nearest(_literal(starts)))).alias("_start", "_near"))
        order = F.struct(-F.col("_near.d"), "place_id")
        rows = near.groupBy("_start").agg(F.min_by("_z", order).alias("_z")).collect()
        for r in rows:
            starts[r["_start"]].append(tuple(r["_z"]))
    return starts


def _rounds(points: DataFrame, groups: list[list[Centre]]) -> list[_Grouping]:
    """Moves all centres to the middle of their places until they rest, at most ``MAX_ROUNDS`` times.

    A grouping whose centres rest takes no part in further rounds, as it would stay as it is.
    """
    groups = list(groups)
    width = len(groups[0][0])
    sums = [F.sum(F.get("_z", F.lit(i))).alias(f"_s{i}") for i in range(width)]
    square = F.aggregate("_z", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    out: list[_Grouping | None] = [None] * len(groups)
    moving = list(range(len(groups)))
    for left in range(MAX_ROUNDS, -1, -1):
        near = points.select("_z", F.posexplode(F.expr(_nearest(_literal([groups[g] for g in moving])))).alias("_g", "_near"))
        told = near.groupBy("_g", F.col("_near.j").alias("_j")).agg(
            F.count("*").alias("_n"), F.sum("_near.d").alias("_d"), F.sum(square).alias("_q"), *sums
        )
        rows = {(moving[r["_g"]], r["_j"]): r for r in told.collect()}
        still = []
        for g in moving:
            centres = groups[g]
            own = [rows.get((g, j)) for j in range(len(centres))]
            total = [[r[f"_s{i}"] if r else 0 for i in range(width)] for r in own]
            counts = [r["_n"] if r else 0 for r in own]
            middle = [
                tuple((2 * s + c) // (2 * c) for s in t) if c else old for t, c, old in zip(total, counts, centres)
            ]
            out[g] = _Grouping(centres, counts, total, [r["_q"] if r else 0 for r in own], sum(r["_d"] for r in own if r))
            if left and middle != centres:
                still.append(g)
                groups[g] = middle
        moving = still
        if not moving:
            break
    return out


def _silhouettes(points: DataFrame, found: list[_Grouping], n: int) -> list[float]:
    """Mean over all places, each to nine decimals, for several groupings."""
    q = "aggregate(_z, 0L, (s, x) -> s + x * x)"
    out = []
    for i, g in enumerate(found):
        clusters = [f"struct({m}D AS n, {q_}D AS q, {_literal([[t]])}[0][0] AS y)" for m, q_, t in zip(g.counts, g.squares, g.sums)]
        dot = "aggregate(zip_with(_z, c.y, (a, b) -> a * b), 0L, (s, x) -> s + x)"
        total = f"c.n * cast({q} as double) + c.q - 2 * cast({dot} as double)"
        away = f"transform(array({', '.join(clusters)}), (c, j) -> struct(c.n AS n, j AS j, {total} AS t))"
        own = f"{_nearest(_literal([g.centres]))}[0].j"
        out.append(F.struct(F.expr(away).alias("t"), F.expr(own).alias("j")).alias(f"_g{i}"))
    rows = points.select(*out)
    scores = []
    for i in range(len(found)):
        mine = F.col(f"_g{i}.j")
        own = F.get(F.col(f"_g{i}.t"), mine)
        others = F.filter(F.col(f"_g{i}.t"), lambda c: (c["j"] != mine) & (c["n"] > 0))
        inner = own["t"] / F.greatest(own["n"] - 1, F.lit(1.0))
        outer = F.array_min(F.transform(others, lambda c: c["t"] / c["n"]))
        top = F.greatest(inner, outer)
        score = F.when((own["n"] > 1) & (top > 0), (outer - inner) / top).otherwise(0.0)
        scores.append(F.sum(F.floor(score * 1e9 + 0.5).cast("bigint")).alias(f"_s{i}"))
    return [x / n / 1e9 for x in rows.agg(*scores).first()]


def rank_groups(centers: DataFrame, column: str, polarity: str) -> DataFrame | None:
    """Worst and best cluster on one column, the lowest cluster id on a tie."""
    if polarity not in ("higher_is_better", "lower_is_better") or column not in centers.columns:
        return None
    low = F.min_by(F.struct("cluster", column), F.struct(F.col(column), F.col("cluster")))
    high = F.min_by(F.struct("cluster", column), F.struct(-F.col(column), F.col("cluster")))
    worst, best = (low, high) if polarity == "higher_is_better" else (high, low)
    return centers.agg(worst.alias("_w"), best.alias("_b")).select(
        F.lit(column).alias("indicator_key"),
        F.col("_w.cluster").alias("worst_cluster"),
        F.col(f"_w.`{column}`").alias("worst_value"),
        F.col("_b.cluster").alias("best_cluster"),
        F.col(f"_b.`{column}`").alias("best_value"),
    )


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("n_places"))


def cluster_members(labels: DataFrame, ranking: DataFrame) -> DataFrame:
    """Places of the worst group."""
    worst = ranking.select(F.col("worst_cluster").alias("cluster"))
    return labels.join(worst, "cluster", "left_semi")
