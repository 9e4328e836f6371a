import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions.order_stats import (
    exact_quantiles,
    percentile_rank,
    running_totals,
    sums_before,
    top_per_key,
    value_cells,
    with_order_key,
)
from panelwright.functions.student_t import TABLE_UP_TO, t_975, t_975_column

PROBS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p975": 0.975, "p100": 1.0}


@pytest.fixture(scope="module")
def groups():
    """Groups of very different shape: ties, clusters with outliers, huge spans, signs."""
    rng = np.random.default_rng(7)
    out = {
        "one": np.array([3.5]),
        "two": np.array([-1.0, 4.0]),
        "constant": np.full(40, 7.25),
        "normal": rng.normal(size=500),
        "ties": rng.integers(0, 4, size=300).astype(float),
        "zero_heavy": np.where(rng.random(300) < 0.6, 0.0, rng.normal(size=300)),
        "ceiling": np.minimum(100.0, 99 + rng.random(400) * 1.5),
        "cluster": np.concatenate([1000 + rng.random(300) * 1e-6, [1e300, -1e300, 0.0]]),
        "span": np.concatenate([10.0 ** rng.uniform(-300, 300, 200), -(10.0 ** rng.uniform(-9, 9, 99))]),
        "powers": np.array([2.0**k for k in range(-30, 31)] + [-(2.0**k) for k in range(-5, 6)]),
    }
    for i in range(30):
        out[f"random{i}"] = np.round(rng.normal(size=rng.integers(3, 60)) * 10, 2)
    return out


@pytest.fixture(scope="module")
def frame(spark, groups):
    rows = [(k, i, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)]
    rows += [("normal", 9000, None), ("ties", 9001, float("nan"))]
    return spark.createDataFrame(rows, "k string, i int, v double").repartition(5)


def test_quantiles_equal_numpy(frame, groups):
    got = exact_quantiles(frame, ["k"], "v", PROBS).toPandas().set_index("k")
    assert set(got.index) == set(groups)
    for key, values in groups.items():
        for name, p in PROBS.items():
            ordered = np.sort(values)
            at = p * (len(ordered) - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            want = low + (high - low) * (at - np.floor(at))
            assert got.loc[key, name] == pytest.approx(want, rel=1e-12, abs=1e-300), (key, name)


def test_quantiles_of_a_group_without_values(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    for bound in (1_000_000, 0):
        assert exact_quantiles(df, ["k"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("higher_is_worse", [True, False])
def test_percentile_rank_equals_pandas(frame, groups, higher_is_worse):
    got = percentile_rank(frame, ["k"], "v", "r", higher_is_worse).toPandas()
    want = got.groupby("k")["v"].rank(pct=True)
    want = want if higher_is_worse else 1 - want
    pd.testing.assert_series_equal(got["r"], want, check_names=False, rtol=1e-12)
    assert len(got) == sum(len(v) for v in groups.values()) + 2


def test_running_totals_follow_the_order(frame):
    order = [F.col("v").desc_nulls_last(), F.col("i").asc()]
    df = frame.withColumn("one", F.lit(1))
    got = running_totals(df, ["k"], order, "one", "n", "all").toPandas()
    assert {"k", "i", "v", "one", "n", "all"} == set(got.columns)
    for _, g in got.groupby("k"):
        g = g.sort_values("n")
        assert list(g["n"]) == list(range(1, len(g) + 1))
        assert set(g["all"]) == {len(g)}
        # Spark puts NaN above every number.
        keyed = [(-np.inf if np.isnan(v) else -v, i) for v, i in zip(g["v"], g["i"])]
        keyed = [(np.inf, i) if v == -np.inf and i == 9000 else (v, i) for v, i in keyed]
        assert keyed == sorted(keyed)


def test_order_keys_are_the_bits_of_the_number(spark):
    rng = random.Random(1)
    values = [2.0**e for e in range(-1074, 1024)]
    values += [math.nextafter(v, to) for v in values for to in (0, math.inf)]
    values += [struct.unpack(">d", struct.pack(">q", rng.randrange(0, 0x7FF << 52)))[0] for _ in range(5000)]
    values += [math.inf, 0.0, 99.9]
    rows = [(v, struct.unpack(">q", struct.pack(">d", v))[0]) for v in values]
    rows += [(-v, -b) for v, b in rows]
    df = spark.createDataFrame(rows, "v double, bits long")
    df = with_order_key(df, "v", "key")
    assert df.where("key is null or key <> bits").count() == 0
    odd = spark.createDataFrame([(None,), (math.nan,)], "v double")
    assert with_order_key(odd, "v").where("_key is not null").count() == 0


@pytest.mark.parametrize("parts", [2, 16])
def test_one_key_with_most_rows_a_null_key_and_infinities(spark, parts):
    inf = math.inf
    rows = [("hot", float(i % 997)) for i in range(6000)] + [("cold", float(i)) for i in range(300)]
    rows += [(None, v) for v in (-inf, 1.0, 2.0, inf, inf, None)] + [("end", -inf), ("end", -inf), ("end", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    got = {r.k: (r.low, r.m, r.q, r.high) for r in exact_quantiles(df, ["k"], "v", {"low": 0.0, "m": 0.5, "q": 0.9, "high": 1.0}).collect()}
    hot = sorted(i % 997 for i in range(6000))
    assert got["hot"][1:3] == pytest.approx(((hot[2999] + hot[3000]) / 2, hot[5399] + 0.1 * (hot[5400] - hot[5399])))
    assert got[None] == (-inf, 2.0, inf, inf) and got["end"][:2] == (-inf, -inf) and got["end"][3] == 4.0
    ranks = percentile_rank(df, ["k"], "v", "r").where("k is null").toPandas().sort_values("v")
    assert ranks["r"].tolist()[:5] == pytest.approx([0.2, 0.4, 0.6, 0.9, 0.9]) and math.isnan(ranks["r"].tolist()[5])
    total = running_totals(df.where("v is not null").withColumn("one", F.lit(1)), ["k"], [F.col("v")], "one", "n", "all")
    assert sorted(r.n for r in total.where("k is null").collect()) == [1, 2, 3, 4, 5]
    cells = sums_before(value_cells(df, ["k"], "v"), ["k"]).where("k is null")
    assert sorted((r._v, r._n, r._before, r._all) for r in cells.collect()) == [(-inf, 1, 0, 5), (1.0, 1, 1, 5), (2.0, 1, 2, 5), (inf, 2, 3, 5)]


def test_rows_are_never_ordered_within_a_whole_key(spark):
    """Only the sums of buckets are; rows and numbers are ordered in a bucket."""
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    text = percentile_rank(df, ["k"], "v", "r")._jdf.queryExecution().executedPlan().toString()
    spans = [x.split("specifiedwindowframe")[0].split(",") for x in text.split("windowspecdefinition(")[1:]]
    whole = [x for x in spans if not any(c.strip().startswith(("_above", "_w")) for c in x)]
    assert len(spans) > len(whole) and all("_at" not in c and "_key" not in c for x in whole for c in x)


def test_top(frame):
    top = top_per_key(frame, ["k"], [F.desc("v"), F.asc("i")], 2, "rank")
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 2


def test_t_quantiles_match_textbook_values(spark):
    for df, want in {1: 12.7062, 2: 4.30265, 3: 3.18245, 4: 2.77645, 10: 2.22814, 30: 2.04227, 60: 2.00030}.items():
        assert t_975(df) == pytest.approx(want, abs=6e-6)
    rows = spark.range(0, 400).select("id", t_975_column(F.col("id")).alias("t")).toPandas()
    t = rows.set_index("id")["t"]
    assert np.isnan(t[0])
    assert t[120] == pytest.approx(1.97993, abs=6e-6)
    assert t[TABLE_UP_TO + 1] == pytest.approx(t_975(TABLE_UP_TO + 1), abs=1e-8)
    assert t[300] == pytest.approx(t_975(300), abs=1e-9)
