"""Registration of queries with their SQL and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rounded(name: str, digits: int) -> Column:
    """A double rounded as the SQL's engine does it, by whole numbers of 10^-digits.

    Spark's own rounding goes by the decimal text, which differs where a large product has no digit left for the half.
    """
    scaled = F.col(name) * 10.0 ** digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / 10.0 ** digits).otherwise(F.col(name))


def query(name: str, sql: str | None = None, **rounding: str):
    """Register a query.  ``r6="a b"`` rounds columns a and b to 6 digits on both sides.

    Adding 0.0 after rounding makes a negative zero a zero.
    """
    digits = {c: int(k[1:]) for k, cols in rounding.items() for c in cols.split()}

    def wrap(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            def read(table: str) -> DataFrame:
                return spark.read.parquet(f"{sf}/{table}.parquet")
            read.spark, read.folder = spark, sf
            df = fn(read)
            # dates leave as timestamps, the one time type both engines hand over alike
            df = df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields
                                 if f.dataType.typeName() == "date"})
            doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
            return df.withColumns({c: (_rounded(c, d) if c in doubles else F.round(c, d)) + F.lit(0.0) for c, d in digits.items()})
        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in digits.items())
            ORACLES[name] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if rounded else sql
        return fn
    return wrap
