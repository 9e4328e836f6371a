"""Column contracts and fixed values shared by the operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

INDICATOR, PLACE, PERIOD = "indicator_key", "place_id", "period"
SERIES = [INDICATOR, PLACE]
CELL = [INDICATOR, PLACE, PERIOD]



def literal_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A few constant rows as a table whose size Spark knows, so joins with it broadcast."""
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]
    text = json.dumps([dict(zip(names, row)) for row in rows]).replace("\\", "\\\\")
    text = text.replace("'", "\\'")
    return spark.sql(f"SELECT inline(from_json('{text}', 'array<struct<{columns}>>'))")


PANEL_COLUMNS = [
    "indicator_key",
    "place_id",
    "period",
    "date",
    "value",
    "variable_id",
    "unit",
    "unit_display",
    "source_agency",
    "provenance_id",
    "provenance_url",
    "facet_id",
    "dimensions",
]

# A decoded observation payload: data is variable -> place -> observation. A latest-only
# payload fills date/value, a series payload fills series.
OBSERVATION = T.StructType(
    [
        T.StructField("facet", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField(
            "series",
            T.ArrayType(
                T.StructType(
                    [T.StructField("date", T.StringType()), T.StructField("value", T.DoubleType())]
                )
            ),
        ),
    ]
)
FACET = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("unit", "unitDisplayName", "provenanceId", "provenanceUrl", "observationPeriod")
    ]
)
PAYLOAD = T.StructType(
    [
        T.StructField("data", T.MapType(T.StringType(), T.MapType(T.StringType(), OBSERVATION))),
        T.StructField("facets", T.MapType(T.StringType(), FACET)),
    ]
)

# Rows of the second source: one observation per row, padded with null values.
_ID_VALUE = T.StructType([T.StructField("id", T.StringType()), T.StructField("value", T.StringType())])
SECOND_SOURCE_ROW = T.StructType(
    [
        T.StructField("indicator", _ID_VALUE),
        T.StructField("country", _ID_VALUE),
        T.StructField("countryiso3code", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("obs_status", T.StringType()),
        T.StructField("decimal", T.IntegerType()),
    ]
)
COUNTRY_ROW = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("region", T.StructType([T.StructField("id", T.StringType())])),
    ]
)
GEOMETRY_COLLECTION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
                        T.StructField("geometry", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

CURATED = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("variable_id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("polarity", T.StringType()),
        T.StructField("sdg_target", T.StringType()),
        T.StructField("saturation_ceiling", T.DoubleType()),
        T.StructField("denominator", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("target_value", T.DoubleType()),
        T.StructField("target_year", T.IntegerType()),
        T.StructField("unit", T.StringType()),
        T.StructField("unit_display", T.StringType()),
    ]
)
DISCOVERED = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("variable_id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("source_agency", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("dimensions", T.MapType(T.StringType(), T.StringType())),
        T.StructField("provenance_id", T.StringType()),
        T.StructField("provenance_url", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("unit_display", T.StringType()),
        T.StructField("temporal_start", T.StringType()),
        T.StructField("temporal_end", T.StringType()),
        T.StructField("value_min", T.DoubleType()),
        T.StructField("value_max", T.DoubleType()),
        T.StructField("place_coverage", T.LongType()),
        T.StructField("facet_count", T.LongType()),
        T.StructField("upstream_source", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

# ---- Fixed values: these have to be the same everywhere for results to agree. ----
POLARITIES = ["higher_is_better", "lower_is_better", "neutral"]
FINDING_LEVELS = ["error", "warn", "info"]
PLACE_ID_PATTERN = "^country/[A-Z]{3}$"
AGGREGATE_REGION = "NA"
DEFAULT_SOURCE = "un_datacommons"
DENOMINATOR_TOPIC = "_denominators"
MAD_TO_SIGMA = 1.4826
SATURATION_TOLERANCE = 0.5
RANGE_TOLERANCE = 1e-6
DISAGREEMENT_POINTS = 10.0
NORMAL_975 = 1.959963984540054
# Sentences that end up in result rows (format_string templates).
SPIKE_DETAIL = (
    "%s by %s between %s and %s, much more than this country's usual year-to-year change."
)
PEER_DETAIL = "%s %s in %s, far more than other countries typically moved that same year."
REVERSAL_DETAIL = (
    "Moving %s over its full reporting history (%s per year), not just noise in a single year."
)
INTERPOLATED_DETAIL = (
    "%s by almost exactly %s every year from %s to %s. A series that moves in identical steps "
    "is usually filled in between two real measurements rather than measured each year."
)
# Labels of anomaly kinds in the summary table; a kind without one is shown as it is.
KIND_LABELS = {
    "spike": "Sudden jump/drop",
    "peer_outlier": "Breaking from the pack",
    "reversal": "Moving the wrong direction",
}
# Names of the processing steps in a lineage trail, in order.
LINEAGE_STEPS = [
    "transform.fetch",
    "transform.latest",
    "transform.long",
    "transform.names",
    "transform.join",
]
