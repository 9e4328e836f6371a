"""Queries on identifiers, payloads, second-source rows, metadata tables and places."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelwright.functions import ids
from panelwright.operators import coverage, lineage, places
from panelwright.plans import panels
from panelwright.plans.registry import query, rounded, whole, with_tables
from panelwright.schema import INDICATOR, PAYLOAD, literal_table
from panelwright.sources import catalog, json_documents, observations
from panelwright.staging import settle, staging_folder

# ---- identifiers ----

_PARSED = """SELECT p_partkey, name, variable_id,
    CASE WHEN p_size % 6 = 0 THEN 'worldbank' WHEN p_size % 6 IN (1, 2) THEN NULL ELSE lower(p_type) END AS agency,
    CASE WHEN p_size % 6 = 0 THEN b || '.' || p_size WHEN p_size % 6 = 1 THEN b
         WHEN p_size % 6 = 2 THEN 'worldBank/' || b ELSE b END AS code,
    CASE WHEN p_size % 6 >= 4 THEN 'SIZE=' || p_size || ',URBANIZATION=R' ELSE '' END AS dims,
    p_size % 6 >= 3 AS is_catalogued
    FROM (SELECT *, upper(replace(p_brand, '#', '_')) AS b FROM part_ids)"""


def _dims_text(dims):
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(dims)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
        ),
        ",",
    )


@query(
    "parse_variable_ids",
    with_tables(
        "part_ids parsed",
        """SELECT p_partkey, coalesce(agency, '') AS agency, code, dims, is_catalogued FROM parsed""",
        {"parsed": _PARSED},
    ),
)
def parse_variable_ids(spark, sf):
    parsed = ids.parse_variable_id(F.col("variable_id"))
    df = panels.part_ids(spark, sf).select("p_partkey", parsed.alias("p"))
    return df.select(
        "p_partkey",
        F.coalesce("p.agency", F.lit("")).alias("agency"),
        "p.code",
        _dims_text(F.col("p.dimensions")).alias("dims"),
        "p.is_catalogued",
    )


@query(
    "format_variable_ids",
    with_tables(
        "part_ids",
        """SELECT p_partkey, 'undata/' || lower(p_type) || '/' || upper(replace(p_brand, '#', '_')) ||
        CASE WHEN p_size % 6 >= 4 THEN '.SIZE--' || p_size || '__URBANIZATION--R' ELSE '' END AS canonical_id
        FROM part_ids WHERE p_size % 6 >= 3""",
    ),
)
def format_variable_ids(spark, sf):
    parsed = ids.parse_variable_id(F.col("variable_id"))
    df = panels.part_ids(spark, sf).select("p_partkey", parsed.alias("p"))
    return df.where("p.is_catalogued").select(
        "p_partkey",
        ids.format_variable_id(
            F.col("p.agency"), F.col("p.code"), F.col("p.dimensions")
        ).alias("canonical_id"),
    )


@query(
    "candidate_variables",
    with_tables(
        "part_ids parsed",
        """SELECT 'candidate_' || lower(code) || '_' || split_part(variable_id, '/', 2) AS key, variable_id,
        name AS label, coalesce(agency, '') AS source_agency, code, dims, 'candidate' AS status
        FROM parsed WHERE starts_with(variable_id, 'undata/') OR starts_with(variable_id, 'worldBank/')""",
        {"parsed": _PARSED},
    ),
)
def candidate_variables(spark, sf):
    df = catalog.candidate_variables(panels.part_ids(spark, sf))
    return df.withColumn("dims", _dims_text(F.col("dimensions"))).drop("dimensions").withColumn(
        "source_agency", F.coalesce("source_agency", F.lit(""))
    )


@query(
    "lineage_selection",
    with_tables(
        "part_ids parsed",
        """SELECT p_partkey, r.p AS parameter, r.v AS value FROM (SELECT p_partkey, unnest([
        {'p': 'variable', 'v': variable_id}, {'p': 'agency', 'v': coalesce(agency, '—')}, {'p': 'code', 'v': code},
        {'p': 'parentEntity', 'v': 'Earth'}, {'p': 'childType', 'v': 'Country'}]) AS r FROM parsed)
        UNION ALL SELECT p_partkey, 'dimension: SIZE', CAST(p_size AS VARCHAR) FROM part_ids WHERE p_size % 6 >= 4
        UNION ALL SELECT p_partkey, 'dimension: URBANIZATION', 'R' FROM part_ids WHERE p_size % 6 >= 4""",
        {"parsed": _PARSED},
    ),
)
def lineage_selection(spark, sf):
    rows = panels.part_ids(spark, sf).withColumn(INDICATOR, F.col("p_partkey").cast("string"))
    return lineage.selection_rows(rows).select(
        F.col(INDICATOR).cast("bigint").alias("p_partkey"), "parameter", "value"
    )


@query(
    "lineage_steps",
    with_tables(
        "part_ids curated",
        """SELECT key AS indicator_key, array_to_string(list_filter(['transform.fetch', 'transform.latest',
        'transform.long', 'transform.names', 'transform.join',
        CASE WHEN saturation_ceiling IS NOT NULL THEN 'transform.saturation' END,
        CASE WHEN denominator IS NOT NULL THEN 'transform.denominator' END,
        CASE WHEN source = 'api_b' THEN 'transform.merge' END], lambda x: x IS NOT NULL), ',') AS steps FROM curated""",
    ),
)
def lineage_steps(spark, sf):
    rows = panels.curated_parts(spark, sf).withColumn(INDICATOR, F.col("key"))
    steps = lineage.transformation_steps(rows, rows.where(F.col("source") == "api_b"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "step")))["step"]
    return steps.groupBy(INDICATOR).agg(F.array_join(ordered, ",").alias("steps"))


# ---- second source ----

_ROWS = {
    "country_rows": """SELECT n_nationkey, chr(65 + n_nationkey) || 'q' || chr(65 + n_regionkey) AS code,
        CASE WHEN n_regionkey = 0 THEN 'NA' WHEN n_regionkey = 1 THEN NULL ELSE 'R' || n_regionkey END AS region,
        n_name FROM nation""",
    "source_rows": """SELECT CASE WHEN n_nationkey % 9 = 8 THEN code || 'X' ELSE code END AS iso, n_nationkey,
        CAST(year(o_orderdate) AS VARCHAR) AS date, 'OR.' || o_orderstatus || '.X' AS code_x, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN country_rows ON c_nationkey = n_nationkey""",
    "usable": """SELECT 'country/' || upper(iso) AS place_id, date, value, code_x FROM source_rows JOIN country_rows USING (n_nationkey)
        WHERE value IS NOT NULL AND length(iso) = 3 AND region IS DISTINCT FROM 'NA'""",
}


def _country_rows(spark, sf):
    region = F.when(F.col("n_regionkey") == 0, "NA").when(
        F.col("n_regionkey") > 1, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    )
    return panels.table(spark, sf, "nation").select(
        "n_nationkey",
        F.concat(
            F.char(65 + F.col("n_nationkey")), F.lit("q"), F.char(65 + F.col("n_regionkey"))
        ).alias("id"),
        F.col("n_name").alias("name"),
        F.struct(region.alias("id")).alias("region"),
    )


def _second_source(spark, sf):
    code = F.when(F.col("n_nationkey") % 9 == 8, F.concat("id", F.lit("X"))).otherwise(F.col("id"))
    countries = _country_rows(spark, sf).select("n_nationkey", code.alias("countryiso3code"))
    customers = panels.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = panels.table(spark, sf, "orders")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(countries, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "countryiso3code",
            F.year("o_orderdate").cast("string").alias("date"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"),
            F.concat(F.lit("worldbank/OR."), "o_orderstatus", F.lit(".X")).alias("variable_id"),
        )
    )


def _usable(spark, sf):
    allowed = observations.real_countries(_country_rows(spark, sf))
    return observations.usable_rows(_second_source(spark, sf), allowed)


@query(
    "real_countries",
    with_tables(
        "country_rows",
        """SELECT 'country/' || upper(code) AS place_id, n_name AS place_name FROM country_rows
        WHERE region IS DISTINCT FROM 'NA'""",
        _ROWS,
    ),
)
def real_countries(spark, sf):
    return observations.real_countries(_country_rows(spark, sf))


@query(
    "usable_rows",
    with_tables(
        "country_rows source_rows usable",
        """SELECT place_id, date, count(*) AS n_rows, round(sum(value), 2) AS total FROM usable GROUP BY ALL""",
        _ROWS,
    ),
)
def usable_rows(spark, sf):
    return (
        _usable(spark, sf)
        .groupBy("place_id", "date")
        .agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))
    )


def _second_source_meta(spark):
    return literal_table(
        spark,
        [
            ("orders/OR.F.X", "worldbank/OR.F.X", "USD", "US dollars", "worldbank", None),
            ("orders/OR.O.X", "worldbank/OR.O.X", "USD", "US dollars", "worldbank", None),
            ("orders/OR.P.X", "worldbank/OR.P.X", "USD", "US dollars", "worldbank", None),
        ],
        "indicator_key string, variable_id string, unit string, unit_display string, "
        "source_agency string, dimensions map<string,string>",
    )


def _second_source_long(spark, sf):
    meta = _second_source_meta(spark)
    return observations.with_second_source_facet(_usable(spark, sf), meta)


_LONG_COLUMNS = """'orders/' || code_x AS indicator_key, place_id, CAST(date AS BIGINT) AS period, date, value,
    'USD' AS unit, 'worldBank/WDI' AS provenance_id, 'https://data.worldbank.org/indicator/' || code_x AS provenance_url,
    'worldbank/' || code_x AS facet_id"""


def _long_columns(df):
    return df.select(
        INDICATOR, "place_id", whole("period"), "date", "value", "unit", "provenance_id",
        "provenance_url", "facet_id",
    )


@query(
    "second_source_latest",
    with_tables(
        "country_rows source_rows usable",
        f"""SELECT {_LONG_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY place_id, code_x ORDER BY date DESC, value)
        AS rn FROM usable) WHERE rn = 1""",
        _ROWS,
    ),
)
def second_source_latest(spark, sf):
    return _long_columns(observations.latest_points(_second_source_long(spark, sf)))


@query(
    "combined_sources",
    with_tables(
        "country_rows source_rows usable user_day",
        """SELECT indicator_key, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM (
        SELECT 'orders/' || code_x AS indicator_key, date FROM usable UNION ALL
        SELECT indicator_key, date FROM user_day) GROUP BY ALL""",
        _ROWS,
    ),
)
def combined_sources(spark, sf):
    both = observations.combine_sources(_second_source_long(spark, sf), panels.user_day(spark, sf))
    return both.groupBy(INDICATOR).agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


# ---- payloads ----


def _payload_meta(spark, keys):
    return literal_table(
        spark, [(k, f"var/{k}", "maker", None) for k in keys],
        "indicator_key string, variable_id string, source_agency string, "
        "dimensions map<string,string>",
    )


def _described(df):
    return df.withColumns(
        {
            "variable_id": F.concat(F.lit("var/"), INDICATOR),
            "unit": F.concat(F.lit("unit of "), "facet_id"),
            "unit_display": F.lit("shown"),
            "provenance_id": F.concat(F.lit("prov/"), "facet_id"),
            "provenance_url": F.lit("https://example.org"),
            "observation_period": F.lit("P1D"),
        }
    )


def _through_json(payloads):
    """Payloads as text and back: what a snapshot goes through."""
    text = payloads.select(F.to_json(F.struct("data", "facets")).alias("t"))
    return text.select(F.from_json("t", PAYLOAD).alias("p")).select("p.*")


@query(
    "payload_points",
    with_tables(
        "latest_point",
        """SELECT indicator_key, place_id, CASE WHEN length(date) = 10
          THEN date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) ELSE CAST(date AS BIGINT) END AS period, date, value,
        'var/' || indicator_key AS variable_id, 'unit of ' || facet_id AS unit, 'shown' AS unit_display,
        'maker' AS source_agency, 'prov/' || facet_id AS provenance_id, facet_id FROM latest_point""",
    ),
)
def payload_points(spark, sf):
    payloads = observations.encode_points(_described(panels.latest_point(spark, sf)), per_row=50)
    meta = _payload_meta(spark, ["events/latest", "orders/latest"])
    df = observations.decode_points(_through_json(payloads), meta)
    return df.select(
        INDICATOR, "place_id", whole("period"), "date", "value", "variable_id", "unit",
        "unit_display", "source_agency", "provenance_id", "facet_id",
    )


@query(
    "payload_document_parts",
    with_tables(
        "latest_point",
        """SELECT indicator_key, place_id, date, value, 'unit of ' || facet_id AS unit, facet_id FROM latest_point""",
    ),
)
def payload_document_parts(spark, sf):
    """Payload files read as documents by byte ranges, not by lines."""
    payloads = observations.encode_points(_described(panels.latest_point(spark, sf)), per_row=500)
    path = f"{staging_folder(spark).rstrip('/')}/panelwright/documents-{uuid.uuid4().hex}"
    payloads.select(F.to_json(F.struct("data", "facets"))).write.text(path)
    meta = _payload_meta(spark, ["events/latest", "orders/latest"])
    df = observations.decode_points(json_documents.read_payload_parts(spark, path), meta)
    return df.select(INDICATOR, "place_id", "date", "value", "unit", "facet_id")


@query(
    "snapshot_round_trip",
    with_tables(
        "latest_point",
        """SELECT indicator_key, place_id, date, value, facet_id FROM latest_point UNION ALL
        SELECT 'parts/latest', NULL, NULL, NULL, 'EMPTY_RESPONSE' WHERE 'parts/latest' NOT IN (SELECT indicator_key FROM latest_point)""",
    ),
)
def snapshot_round_trip(spark, sf):
    """Written twice, the first time with other values; only what the manifest names comes back."""
    path = f"{staging_folder(spark).rstrip('/')}/panelwright/snapshot-{uuid.uuid4().hex}"
    latest = settle(_described(panels.latest_point(spark, sf)))
    meta = _payload_meta(spark, ["events/latest", "orders/latest", "parts/latest"])
    names = panels.user_names(spark, sf)
    observations.write_snapshot(latest.withColumn("value", -F.col("value")), meta, names, path)
    skipped = observations.write_snapshot(latest, meta, names, path)
    rows, _ = observations.read_snapshot(spark, path, meta)
    none = F.lit(None)
    told = skipped.select(
        INDICATOR, none.cast("string").alias("place_id"), none.cast("string").alias("date"),
        none.cast("double").alias("value"), F.col("code").alias("facet_id"),
    )
    return rows.select(INDICATOR, "place_id", "date", "value", "facet_id").unionByName(told)


@query(
    "gap_file_round_trip",
    with_tables(
        "cust_year settings gaps",
        "SELECT indicator_key, place_id, CAST(period AS BIGINT) AS period FROM gaps",
        {
            "gaps": """SELECT indicator_key, place_id, p AS period FROM (
            SELECT DISTINCT indicator_key, place_id, unnest(generate_series(temporal_start, temporal_end)) AS p
            FROM cust_year JOIN settings USING (indicator_key)) g
            ANTI JOIN cust_year c ON c.indicator_key = g.indicator_key AND c.place_id = g.place_id AND c.period = g.p"""
        },
    ),
)
def gap_file_round_trip(spark, sf):
    """The holes of the grid, written as CSV and read again."""
    path = f"{staging_folder(spark).rstrip('/')}/panelwright/gaps-{uuid.uuid4().hex}"
    holes = coverage.missing_cells(panels.cust_year(spark, sf), panels.settings(spark))
    coverage.write_missing_cells(holes, path)
    back = spark.read.schema("indicator_key string, place_id string, period bigint").option("header", True).csv(path)
    return back.select(INDICATOR, "place_id", "period")


@query(
    "payload_series",
    with_tables(
        "user_day",
        """SELECT indicator_key, place_id, date_diff('day', DATE '1970-01-01', CAST(date AS DATE)) AS period, date, value,
        'unit of one' AS unit, 'one' AS facet_id FROM user_day""",
    ),
)
def payload_series(spark, sf):
    panel = _described(panels.user_day(spark, sf).withColumn("facet_id", F.lit("one")))
    payloads = observations.encode_series(panel, per_row=100)
    meta = _payload_meta(spark, [f"events/{x}" for x in ("all", "click", "error", "purchase", "signup", "view")])
    df = observations.decode_series(_through_json(payloads), meta)
    return df.select(INDICATOR, "place_id", whole("period"), "date", "value", "unit", "facet_id")


@query(
    "empty_responses",
    with_tables(
        "latest_point",
        """SELECT 'parts/latest' AS indicator_key, 'error' AS level, 'EMPTY_RESPONSE' AS code,
        'no data for var/parts/latest' AS message WHERE (SELECT count(*) FROM latest_point) > 0""",
    ),
)
def empty_responses(spark, sf):
    payloads = observations.encode_points(_described(panels.latest_point(spark, sf)))
    meta = _payload_meta(spark, ["events/latest", "orders/latest", "parts/latest"])
    _, findings = observations.snapshot_points(_through_json(payloads), meta)
    return findings.drop("evidence")


@query(
    "geometry_places",
    """SELECT 'nation/' || n_nationkey AS place_id, n_name AS name FROM nation""",
)
def geometry_places(spark, sf):
    feature = F.struct(
        F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("id"),
        F.create_map(F.lit("name"), F.col("n_name")).alias("properties"),
        F.lit("POLYGON EMPTY").alias("geometry"),
    )
    collections = panels.table(spark, sf, "nation").select(F.array(feature).alias("features"))
    df = observations.geometry_places(collections)
    return df.select("place_id", F.col("properties")["name"].alias("name"))


# ---- metadata ----

_META = {
    "profile": """SELECT indicator_key, count(DISTINCT place_id) AS place_coverage, min(value) AS value_min,
        max(value) AS value_max, min(date) AS temporal_start, max(date) AS temporal_end,
        count(DISTINCT facet_id) AS facet_count,
        CASE WHEN count(DISTINCT facet_id) = 1 THEN max(unit) END AS unit,
        CASE WHEN count(DISTINCT facet_id) = 1 THEN max(provenance_id) END AS provenance_id
        FROM part_panel GROUP BY ALL""",
    "parsed": _PARSED,
    "merged": """SELECT c.key, c.variable_id, c.label, array_to_string(c.topics, ',') AS topics, c.topics AS tlist,
        coalesce(c.polarity, 'neutral') AS polarity, c.role, c.source, coalesce(c.unit, p.unit) AS unit,
        d.agency, d.code, d.dims, p.provenance_id, p.temporal_start, p.temporal_end, p.value_min, p.value_max,
        coalesce(p.place_coverage, 0) AS place_coverage, p.facet_count
        FROM curated c JOIN parsed d ON c.key = 'part/' || d.p_partkey
        LEFT JOIN profile p ON c.key = p.indicator_key""",
}
_META_TABLES = "part_ids curated part_panel profile parsed merged"


def _discovered(spark, sf):
    """What is known of each part: its id taken apart, and its measured profile."""
    profile = catalog.profile_observations(panels.part_panel(spark, sf))
    named = panels.part_ids(spark, sf).select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("key"),
        "variable_id",
        F.col("name").alias("label"),
    )
    return catalog.discovered_rows(named, profile).withColumn(
        "upstream_source", F.lit(None).cast("string")
    )


@query(
    "profile_observations",
    with_tables(
        "part_panel profile",
        "SELECT * REPLACE (coalesce(unit, '') AS unit, coalesce(provenance_id, '') AS provenance_id) FROM profile",
        _META,
    ),
)
def profile_observations(spark, sf):
    df = catalog.profile_observations(panels.part_panel(spark, sf))
    blank = F.lit("")
    return df.drop("unit_display", "provenance_url").withColumns(
        {"unit": F.coalesce("unit", blank), "provenance_id": F.coalesce("provenance_id", blank)}
    )


@query(
    "merge_catalog",
    with_tables(
        _META_TABLES,
        """SELECT m.key, d.variable_id AS variable_id, d.name AS label, topics, polarity, source,
        coalesce(unit, '') AS unit, coalesce(d.agency, '') AS source_agency, d.code AS code, d.dims AS dims,
        coalesce(provenance_id, '') AS provenance_id, coalesce(temporal_start, '') AS temporal_start,
        coalesce(temporal_end, '') AS temporal_end, value_min, value_max, place_coverage, true AS enriched
        FROM merged m JOIN parsed d ON m.key = 'part/' || d.p_partkey""",
        _META,
    ),
)
def merge_catalog(spark, sf):
    df = catalog.merge_catalog(panels.curated_parts(spark, sf), _discovered(spark, sf))
    blank = F.lit("")
    texts = ["unit", "source_agency", "provenance_id", "temporal_start", "temporal_end"]
    return df.select(
        "key", "variable_id", "label", F.array_join("topics", ",").alias("topics"), "polarity",
        "source", *[F.coalesce(c, blank).alias(c) for c in texts], "code",
        _dims_text(F.col("dimensions")).alias("dims"), "value_min", "value_max",
        "place_coverage", "enriched",
    )


def _known_sources(spark):
    return panels.pull_sources(spark).where(F.col("source") != "api_c")


@query(
    "catalog_findings",
    with_tables(
        "part_ids curated topics",
        """SELECT key, 'MISSING_ID' AS code, '' AS detail FROM curated WHERE variable_id IS NULL
        UNION ALL SELECT key, 'MISSING_LABEL', '' FROM curated WHERE label IS NULL
        UNION ALL SELECT key, 'INVALID_POLARITY', polarity FROM curated
            WHERE polarity NOT IN ('higher_is_better', 'lower_is_better', 'neutral')
        UNION ALL SELECT key, 'UNKNOWN_SOURCE', source FROM curated WHERE source NOT IN ('api_a', 'api_b')
        UNION ALL SELECT key, 'UNKNOWN_TOPIC', t FROM (SELECT key, unnest(topics) AS t FROM curated)
            WHERE t <> '_denominators' AND t NOT IN (SELECT topic FROM topics)""",
    ),
)
def catalog_findings(spark, sf):
    df = catalog.catalog_findings(
        panels.curated_parts(spark, sf), panels.part_topics(spark, sf), _known_sources(spark)
    )
    return df.withColumn("detail", F.coalesce("detail", F.lit("")))


def _selectable_sql(where: str) -> str:
    return f"""SELECT key, CAST(coalesce(min_by(ordinal, pos) FILTER (ordinal IS NOT NULL),
        (SELECT max(ordinal) + 1 FROM topics)) AS BIGINT) AS topic_order FROM (
        SELECT key, topic AS t, pos, ordinal FROM (SELECT key, unnest(topics) AS topic,
        generate_subscripts(topics, 1) AS pos FROM curated WHERE role IS DISTINCT FROM 'denominator' {where})
        LEFT JOIN topics USING (topic)) GROUP BY ALL"""


@query(
    "selectable_indicators",
    with_tables("part_ids curated topics", _selectable_sql("")),
)
def selectable_indicators(spark, sf):
    df = catalog.selectable_indicators(
        panels.curated_parts(spark, sf), panels.part_topics(spark, sf)
    )
    return df.select("key", whole("topic_order"))


@query(
    "selectable_indicators_filtered",
    with_tables(
        "part_ids curated topics",
        _selectable_sql("AND list_has_any(topics, ['economy', 'promo'])"),
    ),
)
def selectable_indicators_filtered(spark, sf):
    df = catalog.selectable_indicators(
        panels.curated_parts(spark, sf), panels.part_topics(spark, sf), ["economy", "promo"]
    )
    return catalog.in_selection_order(df).select("key", whole("topic_order"))


@query(
    "topic_lookups",
    with_tables(
        "part_ids curated topics",
        """SELECT key, CAST(pos - 1 AS BIGINT) AS position, topic, CAST(ordinal AS BIGINT) AS ordinal,
        list_contains(topics_of, 'medium') AS in_medium FROM (SELECT key, topics AS topics_of, unnest(topics) AS topic,
        generate_subscripts(topics, 1) AS pos FROM curated) JOIN topics USING (topic)""",
    ),
)
def topic_lookups(spark, sf):
    curated, topics = panels.curated_parts(spark, sf), panels.part_topics(spark, sf)
    medium = catalog.indicators_of_topic(curated, "medium").select(
        "key", F.lit(True).alias("_in")
    )
    return (
        catalog.topics_of_indicators(curated, topics)
        .join(medium, "key", "left")
        .select(
            "key", whole("position"), "topic", whole("ordinal"),
            F.coalesce("_in", F.lit(False)).alias("in_medium"),
        )
    )


@query(
    "upstream_producers",
    """SELECT p_partkey, coalesce(nullif(trim(split_part(org, ',', 1)), ''), p_brand) AS producer FROM (
    SELECT *, CASE WHEN p_size % 3 = 0 THEN ' ' || p_name || ' , ' || p_type WHEN p_size % 3 = 1 THEN ', ' || p_type END
    AS org FROM part)""",
)
def upstream_producers(spark, sf):
    organisation = F.when(
        F.col("p_size") % 3 == 0,
        F.concat(F.lit(" "), "p_name", F.lit(" , "), "p_type"),
    ).when(F.col("p_size") % 3 == 1, F.concat(F.lit(", "), "p_type"))
    return panels.table(spark, sf, "part").select(
        "p_partkey",
        catalog.upstream_producer(organisation, F.col("p_brand")).alias("producer"),
    )


@query(
    "upsert_metadata",
    """SELECT 'part/' || p_partkey AS key, p_name AS label, 'old' AS status FROM part
    WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.0)
    UNION ALL SELECT DISTINCT CASE WHEN l_discount = 0.0 THEN 'part/' ELSE 'offer/' END || l_partkey, 'measured', 'new' FROM lineitem""",
)
def upsert_metadata(spark, sf):
    old = panels.table(spark, sf, "part").select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_name").alias("label"),
        F.lit("old").alias("status"),
    )
    new = (
        panels.table(spark, sf, "lineitem")
        .select(F.when(F.col("l_discount") == 0.0, "part/").otherwise("offer/").alias("kind"), "l_partkey")
        .distinct()
        .select(
            F.concat("kind", F.col("l_partkey").cast("string")).alias("key"),
            F.lit("measured").alias("label"),
            F.lit("new").alias("status"),
        )
    )
    return catalog.upsert_metadata(old, new)


@query(
    "upserted_buckets",
    """SELECT 'part/' || p_partkey AS key, p_name AS label, p_retailprice AS price, 'old' AS status FROM part
    WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0.0) AND p_size <> 1
    UNION ALL SELECT DISTINCT CASE WHEN l_discount = 0.0 THEN 'part/' ELSE 'offer/' END || l_partkey, 'measured', NULL, 'new' FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1) OR l_discount <> 0.0
    UNION ALL SELECT 'part/' || p_partkey, NULL, p_retailprice * 2, 'last' FROM part WHERE p_size = 1""",
)
def upserted_buckets(spark, sf):
    """A table in hash buckets after two upserts; the second one lacks the labels."""
    path = f"{staging_folder(spark).rstrip('/')}/panelwright/upsert-{uuid.uuid4().hex}"
    parts = panels.table(spark, sf, "part").withColumn("key", F.concat(F.lit("part/"), F.col("p_partkey").cast("string")))
    price = F.col("p_retailprice").alias("price")
    old = parts.select("key", F.col("p_name").alias("label"), price, F.lit("old").alias("status"))
    kind = F.when(F.col("l_discount") == 0.0, "part/").otherwise("offer/")
    sold = panels.table(spark, sf, "lineitem").select(F.concat(kind, F.col("l_partkey").cast("string")).alias("key"))
    new = sold.distinct().select("key", F.lit("measured").alias("label"), F.lit("new").alias("status"))
    last = parts.where("p_size = 1").select("key", (F.col("p_retailprice") * 2).alias("price"), F.lit("last").alias("status"))
    catalog.write_buckets(old, path)
    for rows in (new, last):
        catalog.upsert_buckets(rows, path, old.schema)
    return catalog.read_buckets(spark, path, old.schema)


# ---- places ----


@query(
    "place_names",
    with_tables(
        "user_day user_names",
        """SELECT indicator_key, d.place_id, count(*) AS n_rows, coalesce(nullif(place_name, ''), d.place_id) AS display_name
        FROM user_day d LEFT JOIN user_names n ON d.place_id = n.place_id GROUP BY ALL""",
    ),
)
def place_names(spark, sf):
    named = places.attach_place_names(panels.user_day(spark, sf), panels.user_names(spark, sf))
    named = places.with_display_name(named)
    return named.groupBy(INDICATOR, "place_id", "display_name").agg(F.count("*").alias("n_rows"))


def _edges(spark, sf):
    """Nation to region, and a second region for nations that have a supplier in debt."""
    nations = panels.table(spark, sf, "nation")
    first = nations.select("n_nationkey", F.col("n_regionkey").alias("r"))
    debt = panels.table(spark, sf, "supplier").where(F.col("s_acctbal") < 0).select("s_nationkey")
    second = nations.join(
        debt, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi"
    ).select("n_nationkey", ((F.col("n_regionkey") + 1) % 5).alias("r"))
    return first.unionByName(second).select(
        F.concat(F.lit("region/"), F.col("r").cast("string")).alias("parent"),
        F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("place_id"),
        F.col("r").alias("ordinal"),
    )


_EDGES = {
    "edges": """SELECT 'region/' || r AS parent, 'nation/' || n_nationkey AS place_id, r AS ordinal FROM (
        SELECT n_nationkey, n_regionkey AS r FROM nation UNION ALL
        SELECT n_nationkey, (n_regionkey + 1) % 5 FROM nation
        WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0))""",
    "parents": "SELECT place_id, max_by(parent, ordinal) AS parent FROM edges GROUP BY ALL",
}


@query("place_parents", with_tables("edges parents", "SELECT * FROM parents", _EDGES))
def place_parents(spark, sf):
    return places.place_parents(_edges(spark, sf))


@query(
    "parent_counts",
    with_tables(
        "edges",
        """SELECT p.parent, count(e.place_id) AS n_places FROM (
        SELECT 'region/' || r_regionkey AS parent FROM region UNION ALL SELECT 'region/none') p
        LEFT JOIN edges e ON p.parent = e.parent GROUP BY ALL""",
        _EDGES,
    ),
)
def parent_counts(spark, sf):
    regions = panels.table(spark, sf, "region").select(
        F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("parent")
    )
    none = literal_table(spark, [("region/none",)], "parent string")
    return places.parent_counts(regions.unionByName(none), _edges(spark, sf))


@query(
    "region_filter",
    with_tables(
        "nation_month edges parents",
        """SELECT place_id, CAST(period AS BIGINT) AS period, round(value, 6) AS value, parent AS region
        FROM nation_month JOIN parents USING (place_id) WHERE parent = 'region/3'""",
        _EDGES,
    ),
)
def region_filter(spark, sf):
    df = places.filter_region(
        panels.nation_month(spark, sf), places.place_parents(_edges(spark, sf)), "region/3"
    )
    return df.select("place_id", whole("period"), rounded("value"), "region")


@query(
    "select_places",
    with_tables(
        "user_day user_names",
        """SELECT indicator_key, place_id, CAST(period AS BIGINT) AS period, value FROM user_day
        WHERE place_id IN (SELECT place_id FROM user_names WHERE place_name <> '')""",
    ),
)
def select_places(spark, sf):
    chosen = panels.user_names(spark, sf).where(F.col("place_name") != "")
    df = places.select_places(panels.user_day(spark, sf), chosen)
    return df.select(INDICATOR, "place_id", whole("period"), "value")


@query(
    "attach_population",
    with_tables(
        "nation_points sizes",
        """SELECT indicator_key, place_id, value, population FROM nation_points JOIN sizes USING (place_id)""",
        {
            "sizes": """SELECT CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 9000 THEN 'nation/' ELSE 'elsewhere/' END
            || c_nationkey AS place_id, count(*) AS population FROM customer GROUP BY ALL"""
        },
    ),
)
def attach_population(spark, sf):
    chosen = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000)
    where = F.when(chosen, "nation/").otherwise("elsewhere/")
    sizes = (
        panels.table(spark, sf, "customer")
        .groupBy(F.concat(where, F.col("c_nationkey").cast("string")).alias("place_id"))
        .agg(F.count("*").alias("population"))
    )
    kept = places.attach_population(panels.nation_points(spark, sf), sizes).kept
    return kept.select(INDICATOR, "place_id", "value", "population")
