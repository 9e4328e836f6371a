"""Panels and metadata tables over the driver's tables, each with the same thing in SQL.

Every panel is one map-side combined aggregation of a fact table, so however many raw rows a
user, customer or supplier has, a series keeps one row per calendar step. Sums of
decimals are rounded here, where they are made, so that later comparisons do not hang on the
order of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.schema import literal_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(ts: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average event value per user and day: one indicator over all events, one per type."""
    return (
        table(spark, sf_dir, "events")
        .select(
            F.explode(F.array(F.lit("all"), F.col("event_type"))).alias("_type"),
            "user_id",
            _day("ts").alias("period"),
            "value",
        )
        .groupBy("_type", "user_id", "period")
        .agg(F.round(F.avg("value"), 6).alias("value"))
        .select(
            F.concat(F.lit("events/"), "_type").alias("indicator_key"),
            F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("place_id"),
            "period",
            F.date_from_unix_date("period").cast("string").alias("date"),
            "value",
        )
    )


def cust_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentage of a customer's orders of a year that are finished."""
    share = F.avg((F.col("o_orderstatus") == "F").cast("double")) * 100
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("period"))
        .agg(share.alias("value"))
        .select(
            F.lit("orders/finished").alias("indicator_key"),
            F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")).alias("place_id"),
            "period",
            F.col("period").cast("string").alias("date"),
            "value",
        )
    )


def supp_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four indicators per supplier and year, measured together and then put under each other."""
    flag = F.col("l_returnflag")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    measured = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("period"))
        .agg(
            (F.avg((flag == "R").cast("double")) * 100).alias("share_r"),
            (F.avg((flag == "A").cast("double")) * 100).alias("share_a"),
            F.round(revenue / 1000, 4).alias("revenue"),
            F.sum("l_quantity").alias("quantity"),
        )
    )
    return measured.unpivot(
        ["l_suppkey", "period"], ["share_r", "share_a", "revenue", "quantity"], "_m", "value"
    ).select(
        F.concat(F.lit("ship/"), "_m").alias("indicator_key"),
        F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string")).alias("place_id"),
        "period",
        F.col("period").cast("string").alias("date"),
        "value",
    )


def nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value (millions) per customer nation and month, combined per customer first."""
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_custkey").alias("c_custkey"),
            (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("period"),
        )
        .agg(F.sum("o_totalprice").alias("_v"))
    )
    return (
        per_customer.join(
            table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey"
        )
        .groupBy(
            F.lit("nation/orders").alias("indicator_key"),
            F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("place_id"),
            "period",
        )
        .agg((F.round(F.sum("_v"), 2) / 1_000_000).alias("value"))
        .withColumn("date", F.col("period").cast("string"))
    )


def latest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event per user and last order per customer, with facet and unit."""
    events = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(
            F.max_by(
                F.struct("event_type", "value", "ts"), F.struct("ts", "event_id")
            ).alias("r")
        )
        .select(
            F.lit("events/latest").alias("indicator_key"),
            F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("place_id"),
            F.to_date("r.ts").cast("string").alias("date"),
            F.col("r.value").alias("value"),
            F.col("r.event_type").alias("facet_id"),
            F.when(F.col("r.event_type") == "error", "Index").otherwise("Percent").alias("unit"),
        )
    )
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.max_by(
                F.struct("o_orderpriority", "o_totalprice", "o_orderdate"),
                F.struct("o_orderdate", "o_orderkey"),
            ).alias("r")
        )
        .select(
            F.lit("orders/latest").alias("indicator_key"),
            F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")).alias("place_id"),
            F.year("r.o_orderdate").cast("string").alias("date"),
            F.col("r.o_totalprice").alias("value"),
            F.col("r.o_orderpriority").alias("facet_id"),
            F.lit("USD").alias("unit"),
        )
    )
    return events.unionByName(orders)


def nation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances by nation of suppliers, and of customers in debt and in credit."""
    s = table(spark, sf_dir, "supplier").select(
        F.lit("supplier/balance").alias("indicator_key"), F.col("s_nationkey").alias("n"),
        F.col("s_acctbal").alias("b"),
    )
    c = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_acctbal") < 0, "customer/debt").otherwise("customer/credit").alias("indicator_key"), F.col("c_nationkey").alias("n"),
        F.col("c_acctbal").alias("b"),
    )
    return (
        s.unionByName(c)
        .groupBy(
            "indicator_key", F.concat(F.lit("nation/"), F.col("n").cast("string")).alias("place_id")
        )
        .agg(F.round(F.sum("b"), 2).alias("value"))
    )


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations outside region 4 that can be drawn, and one shape nothing has data for."""
    nations = table(spark, sf_dir, "nation").where(F.col("n_regionkey") != 4).select(
        F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("place_id")
    )
    regions = table(spark, sf_dir, "region").where(F.col("r_regionkey") == 0).select(
        F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("place_id")
    )
    return nations.unionByName(regions)


def user_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of users; every seventh one is blank."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("place_id"),
        F.when(F.col("user_id") % 7 == 0, "")
        .otherwise(F.concat(F.lit("User "), F.col("user_id").cast("string")))
        .alias("place_name"),
    )


# Metadata of the panels above. Each row: key, label, polarity, ceiling, target value, target
# period, denominator, first period, last period, unit, dimensions.
_SETTINGS = [
    ("events/all", "All events", "neutral", None, None, None, None, 19723, 19752, "Percent", None),
    ("events/click", "Clicks", "higher_is_better", None, 200.0, 19800, None, 19723, 19752, "Percent", None),
    ("events/error", "Errors", "lower_is_better", None, 5.0, 19750, None, 19723, 19752, "Index", None),
    ("events/purchase", "Purchases", "higher_is_better", 150.0, 100.0, 19760, None, 19723, 19752, "Percent", None),
    ("events/signup", "Signups", "higher_is_better", None, None, None, None, 19723, 19752, "Percent", None),
    ("events/view", "Views", "lower_is_better", None, 1.0, None, None, 19723, 19752, "Percent", None),
    ("orders/finished", "Finished orders", "higher_is_better", 100.0, 60.0, 2005, None, 1995, 2001, "Percent", None),
    ("ship/share_r", "Returned share", "lower_is_better", 50.0, 20.0, 2004, "ship/quantity", 1995, 2001, "Percent", {"URBANIZATION": "R", "SEX": "F"}),
    ("ship/share_a", "Accepted share", "higher_is_better", 100.0, 40.0, 2010, "ship/quantity", 1996, 2003, "pct", {"URBANIZATION": "DOU_R", "SEX": "M"}),
    ("ship/revenue", "Revenue", "higher_is_better", None, None, None, None, 1999, 2001, "kUSD", {"URBANIZATION": "X9"}),
    ("ship/quantity", "Quantity", "neutral", None, None, None, None, 2010, 2012, None, {"COOK_FUEL": "CLEAN"}),
    ("supp/rich", "Rich suppliers", "neutral", None, None, None, None, 2000, 2003, "zorkmid", {"URBANIZATION": "U"}),
    ("nation/orders", "Order value", "higher_is_better", None, 5.0, 24100, None, 23940, 24019, "mUSD", None),
]
_SETTINGS_SCHEMA = (
    "indicator_key string, label string, polarity string, saturation_ceiling double, "
    "target_value double, target_year int, denominator string, temporal_start int, "
    "temporal_end int, unit string, dimensions map<string,string>"
)
UNIT_FAMILIES = [
    ("Percent", "percent"), ("pct", "percent"), ("kUSD", "money"), ("mUSD", "money"),
    ("Index", "index"),
]
DIMENSION_ALIASES = [
    ("URBANIZATION", "R", "rural", "Rural"),
    ("URBANIZATION", "DOU_R", "rural", "Rural"),
    ("URBANIZATION", "U", "urban", None),
    ("SEX", "F", "female", "Female"),
    ("SEX", "M", "male", None),
    ("COOK_FUEL", "CLEAN", "clean_fuel", None),
]


def settings(spark: SparkSession) -> DataFrame:
    rows = literal_table(spark, _SETTINGS, _SETTINGS_SCHEMA)
    return rows.withColumns(
        {
            "temporal_start": F.col("temporal_start").cast("string"),
            "temporal_end": F.col("temporal_end").cast("string"),
            "unit_display": F.col("unit"),
        }
    )


def unit_families(spark: SparkSession) -> DataFrame:
    return literal_table(spark, UNIT_FAMILIES, "member string, family string")


def dimension_aliases(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, DIMENSION_ALIASES, "dim string, alias string, canonical string, label string"
    )


# Expectations for the latest points: unit, value range, recorded places, source.
_PULLS = [
    ("events/latest", "Latest event", "api_a", "Agency One", "Percent", 1.0, 200.0, 200),
    ("orders/latest", "Latest order", "api_b", None, "USD", 0.0, 1e9, 100),
    ("parts/latest", "Latest part", "api_b", None, "USD", None, None, None),
]


def pulls(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        _PULLS,
        "indicator_key string, label string, source string, upstream_source string, unit string, "
        "value_min double, value_max double, place_coverage bigint",
    )


def pull_sources(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, [("api_a", "Source A"), ("api_b", "Source B"), ("api_c", "Source C")],
        "source string, source_label string",
    )


# ---- metadata derived from the part table: as many indicators as there are parts ----


def part_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable ids of every shape the grammar knows, built from part columns."""
    brand = F.upper(F.replace("p_brand", F.lit("#"), F.lit("_")))
    size = F.col("p_size").cast("string")
    full = F.concat(
        F.lit("undata/"), F.lower("p_type"), F.lit("/"), brand, F.lit(".URBANIZATION--R__SIZE--"),
        size, F.lit("__AVERAGING--_Z__BROKEN"),
    )
    shapes = (
        F.when(F.col("p_size") % 6 == 0, F.concat(F.lit("worldbank/"), brand, F.lit("."), size))
        .when(F.col("p_size") % 6 == 1, F.concat(F.lit("undata/"), brand))
        .when(F.col("p_size") % 6 == 2, F.concat(F.lit("worldBank/"), brand))
        .when(F.col("p_size") % 6 == 3, F.concat(F.lit("undata/"), F.lower("p_type"), F.lit("/"), brand))
        .otherwise(full)
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("name"), shapes.alias("variable_id"),
        "p_type", "p_size", "p_brand", "p_retailprice",
    )


def curated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    topics = F.when(size % 5 == 0, F.array(F.lit("_denominators"))).otherwise(
        F.array(F.lower("p_type"), F.when(size % 2 == 0, F.lit("small")).otherwise(F.lit("large")))
    )
    return part_ids(spark, sf_dir).select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("key"),
        F.when(size != 50, F.col("variable_id")).alias("variable_id"),
        F.when(size != 49, F.col("name")).alias("label"),
        topics.alias("topics"),
        F.when(size % 4 == 0, "lower_is_better").when(size % 4 == 1, "higher_is_better")
        .when(size == 7, "sideways").alias("polarity"),
        F.lit(None).cast("string").alias("sdg_target"),
        F.when(size % 10 == 0, 100.0).alias("saturation_ceiling"),
        F.when(size % 7 == 0, "part/0").alias("denominator"),
        F.when(size % 5 == 0, "denominator").alias("role"),
        F.when(size % 3 == 0, "api_b").when(size == 11, "api_x").otherwise("api_a").alias("source"),
        F.lit(None).cast("double").alias("target_value"),
        F.lit(None).cast("int").alias("target_year"),
        F.when(size % 3 == 0, "pieces").alias("unit"),
        F.lit(None).cast("string").alias("unit_display"),
    )


def part_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics are the part types except PROMO, plus two size topics in reverse order."""
    t = table(spark, sf_dir, "part").where(F.col("p_type") != "PROMO")
    types = t.select(F.lower("p_type").alias("topic")).distinct()
    return types.select("topic", (F.ascii("topic") * 10 + F.length("topic")).alias("ordinal"))


def part_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity per part, supplier and year: one indicator per part."""
    cells = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", "l_suppkey", F.year("l_shipdate").alias("period"))
        # The flag as a number: numbers are combined by hashing, texts only after a sort.
        .agg(
            F.sum("l_quantity").alias("value"),
            F.char(F.max(F.ascii("l_returnflag"))).alias("facet_id"),
        )
    )
    return cells.select(
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("indicator_key"),
        F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string")).alias("place_id"),
        "period",
        F.col("period").cast("string").alias("date"),
        "value",
        "facet_id",
        F.concat(F.lit("unit_"), "facet_id").alias("unit"),
        F.lit("pieces").alias("unit_display"),
        F.concat(F.lit("prov/"), "facet_id").alias("provenance_id"),
        F.concat(F.lit("https://example.org/"), "facet_id").alias("provenance_url"),
    )


# ---- the same in SQL ----


def _values(rows, *columns) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, dict):
            keys = ", ".join(f"'{k}'" for k in v)
            vals = ", ".join(f"'{x}'" for x in v.values())
            return f"MAP([{keys}], [{vals}])"
        return f"'{v}'" if isinstance(v, str) else repr(v)

    body = ",\n".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(columns)})"


_NO_DIMS = [r[:10] for r in _SETTINGS]
SQL = {
    "user_day": """SELECT k AS indicator_key, 'user/' || user_id AS place_id,
        CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS period,
        CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(avg(value), 6) AS value
        FROM (SELECT ts, user_id, value, 'events/all' AS k FROM events UNION ALL
              SELECT ts, user_id, value, 'events/' || event_type AS k FROM events) GROUP BY ALL""",
    "cust_year": """SELECT 'orders/finished' AS indicator_key, 'cust/' || o_custkey AS place_id,
        CAST(year(o_orderdate) AS INTEGER) AS period, CAST(year(o_orderdate) AS VARCHAR) AS date,
        avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS value
        FROM orders GROUP BY ALL""",
    "supp_wide": """SELECT 'supp/' || l_suppkey AS place_id, CAST(year(l_shipdate) AS INTEGER) AS period,
        avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS share_r,
        avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS share_a,
        round(sum(l_extendedprice * (1 - l_discount)) / 1000, 4) AS revenue, sum(l_quantity) AS quantity
        FROM lineitem GROUP BY ALL""",
    "supp_year": """SELECT 'ship/' || m AS indicator_key, place_id, period, CAST(period AS VARCHAR) AS date, value
        FROM (SELECT place_id, period, 'share_r' AS m, share_r AS value FROM supp_wide UNION ALL
              SELECT place_id, period, 'share_a', share_a FROM supp_wide UNION ALL
              SELECT place_id, period, 'revenue', revenue FROM supp_wide UNION ALL
              SELECT place_id, period, 'quantity', quantity FROM supp_wide)""",
    "nation_month": """SELECT 'nation/orders' AS indicator_key, 'nation/' || c_nationkey AS place_id,
        CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS period,
        CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS VARCHAR) AS date,
        round(sum(o_totalprice), 2) / 1000000 AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "latest_point": """SELECT 'events/latest' AS indicator_key, 'user/' || user_id AS place_id,
        CAST(CAST(ts AS DATE) AS VARCHAR) AS date, value, event_type AS facet_id,
        CASE WHEN event_type = 'error' THEN 'Index' ELSE 'Percent' END AS unit
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
              FROM events) WHERE rn = 1
        UNION ALL SELECT 'orders/latest', 'cust/' || o_custkey, CAST(year(o_orderdate) AS VARCHAR),
        o_totalprice, o_orderpriority, 'USD'
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
              AS rn FROM orders) WHERE rn = 1""",
    "nation_points": """SELECT k AS indicator_key, 'nation/' || n AS place_id, round(sum(b), 2) AS value
        FROM (SELECT 'supplier/balance' AS k, s_nationkey AS n, s_acctbal AS b FROM supplier UNION ALL
              SELECT CASE WHEN c_acctbal < 0 THEN 'customer/debt' ELSE 'customer/credit' END, c_nationkey, c_acctbal FROM customer) GROUP BY ALL""",
    "geometry": """SELECT 'nation/' || n_nationkey AS place_id FROM nation WHERE n_regionkey <> 4
        UNION ALL SELECT 'region/' || r_regionkey FROM region WHERE r_regionkey = 0""",
    "user_names": """SELECT DISTINCT 'user/' || user_id AS place_id,
        CASE WHEN user_id % 7 = 0 THEN '' ELSE 'User ' || user_id END AS place_name FROM events""",
    "settings": "SELECT * FROM " + _values(
        _NO_DIMS, "indicator_key", "label", "polarity", "saturation_ceiling", "target_value",
        "target_year", "denominator", "temporal_start", "temporal_end", "unit",
    ),
    "dims": "SELECT * FROM " + _values(
        [(r[0], d, v) for r in _SETTINGS if r[10] for d, v in r[10].items()],
        "indicator_key", "dim", "raw",
    ),
    "families": "SELECT * FROM " + _values(UNIT_FAMILIES, "member", "family"),
    "aliases": "SELECT * FROM " + _values(DIMENSION_ALIASES, "dim", "alias", "canonical", "label"),
    "pulls": "SELECT * FROM " + _values(
        _PULLS, "indicator_key", "label", "source", "upstream_source", "unit", "value_min",
        "value_max", "place_coverage",
    ),
    "pull_sources": """SELECT * FROM (VALUES ('api_a', 'Source A'), ('api_b', 'Source B'),
        ('api_c', 'Source C')) AS v(source, source_label)""",
    "part_ids": """SELECT p_partkey, p_name AS name, p_type, p_size, p_brand, p_retailprice,
        CASE WHEN p_size % 6 = 0 THEN 'worldbank/' || b || '.' || p_size
             WHEN p_size % 6 = 1 THEN 'undata/' || b
             WHEN p_size % 6 = 2 THEN 'worldBank/' || b
             WHEN p_size % 6 = 3 THEN 'undata/' || lower(p_type) || '/' || b
             ELSE 'undata/' || lower(p_type) || '/' || b || '.URBANIZATION--R__SIZE--' || p_size
                  || '__AVERAGING--_Z__BROKEN' END AS variable_id
        FROM (SELECT *, upper(replace(p_brand, '#', '_')) AS b FROM part)""",
    "parsed_ids": """SELECT *, split_part(variable_id, '/', 1) AS s1, split_part(variable_id, '/', 2) AS s2,
        split_part(variable_id, '/', 3) AS s3 FROM part_ids""",
    "curated": """SELECT 'part/' || p_partkey AS key, CASE WHEN p_size <> 50 THEN variable_id END AS variable_id,
        CASE WHEN p_size <> 49 THEN name END AS label,
        CASE WHEN p_size % 5 = 0 THEN ['_denominators']
             ELSE [lower(p_type), CASE WHEN p_size % 2 = 0 THEN 'small' ELSE 'large' END] END AS topics,
        CASE WHEN p_size % 4 = 0 THEN 'lower_is_better' WHEN p_size % 4 = 1 THEN 'higher_is_better'
             WHEN p_size = 7 THEN 'sideways' END AS polarity,
        CASE WHEN p_size % 10 = 0 THEN 100.0::DOUBLE END AS saturation_ceiling,
        CASE WHEN p_size % 7 = 0 THEN 'part/0' END AS denominator,
        CASE WHEN p_size % 5 = 0 THEN 'denominator' END AS role,
        CASE WHEN p_size % 3 = 0 THEN 'api_b' WHEN p_size = 11 THEN 'api_x' ELSE 'api_a' END AS source,
        CASE WHEN p_size % 3 = 0 THEN 'pieces' END AS unit FROM part_ids""",
    "topics": """SELECT DISTINCT lower(p_type) AS topic, ascii(lower(p_type)) * 10 + length(p_type) AS ordinal
        FROM part WHERE p_type <> 'PROMO'""",
    "part_panel": """SELECT 'part/' || l_partkey AS indicator_key, 'supp/' || l_suppkey AS place_id,
        CAST(year(l_shipdate) AS INTEGER) AS period, CAST(year(l_shipdate) AS VARCHAR) AS date,
        sum(l_quantity) AS value, max(l_returnflag) AS facet_id, 'unit_' || max(l_returnflag) AS unit,
        'prov/' || max(l_returnflag) AS provenance_id FROM lineitem GROUP BY ALL""",
}
