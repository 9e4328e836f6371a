"""Small helpers the operators share."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.staging import forget, release, settle, shuffles_removed, staging_folder

__all__ = [
    "QUERIES", "ORACLES", "append", "documents", "forget", "fresh", "own_folder", "query", "release", "settle", "shuffles_removed", "word_count"
]

WORD = "[^\\x20\\x09-\\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can say the same, its SQL."""

    def register(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    That is enough for local sessions and for clusters with the package at the same path; else
    submit it with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of words; null for null texts."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def own_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the one all executors share."""
    return f"{staging_folder(spark).rstrip('/')}/panelwright/{what}-{uuid.uuid4().hex}"


def append(docs: DataFrame, text_column: str, added: str, work: Callable[[pa.Array], list]) -> DataFrame:
    """``docs`` with further columns that ``work`` derives from an Arrow array of texts.

    ``added`` is the DDL of the new columns, which must not be among those of ``docs``. ``work``
    gets the texts of a batch and returns one Arrow array for each new column.
    """
    more = T._parse_datatype_string(added)
    schema = T.StructType(docs.schema.fields + more.fields)
    kinds = [_arrow(f.dataType) for f in more.fields]
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            new = [pa.array(x, k) if not isinstance(x, pa.Array) else x.cast(k) for x, k in zip(work(batch.column(at)), kinds)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *new], names=[*batch.schema.names, *more.names]
            )

    return docs.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {
        "bigint": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "string": pa.string(),
        "binary": pa.binary(),
        "array<bigint>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
        "array<double>": pa.list_(pa.float64()),
        "array<string>": pa.list_(pa.string()),
    }
    return simple[kind.simpleString()]
