"""Variable and place identifiers, as column expressions.

A variable id reads ``undata/<agency>/<CODE>[.<DIM>--<VALUE>[__<DIM>--<VALUE>]...]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the id grammar.
CATALOGUED_PREFIX = "undata/"
DIRECT_PREFIX = "worldbank/"
REPUBLISHED_PREFIX = "worldBank/"
NOT_APPLICABLE = "_Z"


def _rest(variable_id: Column) -> Column:
    return F.substr(variable_id, F.lit(len(CATALOGUED_PREFIX) + 1))


def _follows_grammar(variable_id: Column) -> Column:
    return variable_id.startswith(CATALOGUED_PREFIX) & (F.instr(_rest(variable_id), "/") > 0)


def id_agency(variable_id: Column) -> Column:
    first = F.substring_index(_rest(variable_id), "/", 1)
    return F.when(variable_id.startswith(DIRECT_PREFIX), F.lit("worldbank")).when(
        _follows_grammar(variable_id), first
    )


def _after_agency(variable_id: Column) -> Column:
    rest = _rest(variable_id)
    return F.substr(rest, F.instr(rest, "/") + 1)


def id_code(variable_id: Column) -> Column:
    return (
        F.when(
            variable_id.startswith(DIRECT_PREFIX),
            F.substr(variable_id, F.lit(len(DIRECT_PREFIX) + 1)),
        )
        .when(_follows_grammar(variable_id), F.substring_index(_after_agency(variable_id), ".", 1))
        .when(variable_id.startswith(CATALOGUED_PREFIX), _rest(variable_id))
        .otherwise(variable_id)
    )


def id_dimensions(variable_id: Column) -> Column:
    """Map of dimension to value; chunks without ``--`` and not-applicable values are left out."""
    tail = _after_agency(variable_id)
    suffix = F.when(F.instr(tail, ".") > 0, F.substr(tail, F.instr(tail, ".") + 1)).otherwise("")
    pairs = F.transform(
        F.filter(F.split(suffix, "__"), lambda c: F.instr(c, "--") > 0),
        lambda c: F.struct(
            F.substring_index(c, "--", 1).alias("key"),
            F.substr(c, F.instr(c, "--") + 2).alias("value"),
        ),
    )
    pairs = F.filter(pairs, lambda p: p["value"] != NOT_APPLICABLE)
    # A dimension given twice keeps its last value.
    last_only = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q["key"] == p["key"]
        ),
    )
    empty = F.create_map().cast("map<string,string>")
    return F.when(_follows_grammar(variable_id), F.map_from_entries(last_only)).otherwise(empty)


def id_is_catalogued(variable_id: Column) -> Column:
    return _follows_grammar(variable_id)


def parse_variable_id(variable_id: Column) -> Column:
    return F.struct(
        variable_id.alias("raw"),
        id_agency(variable_id).alias("agency"),
        id_code(variable_id).alias("code"),
        id_dimensions(variable_id).alias("dimensions"),
        id_is_catalogued(variable_id).alias("is_catalogued"),
    )


def format_variable_id(agency: Column, code: Column, dimensions: Column) -> Column:
    """The canonical id, with dimensions in name order."""
    base = F.concat(F.lit(CATALOGUED_PREFIX), agency, F.lit("/"), code)
    chunks = F.transform(
        F.array_sort(F.map_entries(dimensions)),
        lambda e: F.concat(e["key"], F.lit("--"), e["value"]),
    )
    has_any = F.coalesce(F.size(dimensions), F.lit(0)) > 0
    return F.when(has_any, F.concat(base, F.lit("."), F.array_join(chunks, "__"))).otherwise(base)


def country_place_id(iso3: Column) -> Column:
    """``country/XXX`` for exactly three letters in any case, otherwise null: never guessed."""
    return F.when(iso3.rlike("^[A-Za-z]{3}$"), F.concat(F.lit("country/"), F.upper(iso3)))


def code_after_slash(variable_id: Column) -> Column:
    slash = F.instr(variable_id, "/")
    return F.when(slash > 0, F.substr(variable_id, slash + 1)).otherwise(variable_id)
