"""Registered queries and their checking SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ByteType, DecimalType, FloatType, IntegerType, ShortType

from checks import sql, views
from lettings.plans.build import Lazy
from lettings.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MONEY = {"price", "adr", "annual_revenue", "estimated_revenue_l365d"}


def scratch(w: Lazy) -> str:
    """A new folder for one run of a query that writes."""
    return f"{shared_folder(w.spark)}/runs/{uuid.uuid4().hex}"


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and other numbers as DOUBLE, as in the SQL."""
    def plain(field):
        if isinstance(field.dataType, ByteType | ShortType | IntegerType):
            return F.col(field.name).cast("bigint").alias(field.name)
        if isinstance(field.dataType, DecimalType | FloatType):
            return F.col(field.name).cast("double").alias(field.name)
        return F.col(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(name: str, oracle: str | None = None):
    """Registers a function of the derived tables under ``name``."""
    def wrap(fn: Callable[[Lazy], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(views.world(spark, sf_dir)))
        if oracle is not None:
            ORACLES[name] = sql.build(oracle)
        return fn

    return wrap


def table(name: str, source: str, cols: Sequence[str], oracle_table: str, digits: Mapping[str, int] | None = None,
          rename: Mapping[str, str] | None = None, fn: Callable[[Lazy], DataFrame] | None = None) -> None:
    """Registers named columns of a derived table; ``digits`` rounds on both sides."""
    digits, rename = digits or {}, rename or {}

    def build(w: Lazy) -> DataFrame:
        df = fn(w) if fn else w[source]
        return df.select(*[
            F.round(c, digits[c]).alias(c) if c in digits
            else F.col(c).cast("double").alias(c) if c in MONEY else F.col(c)
            for c in cols
        ])

    def text(c: str) -> str:
        inner = rename.get(c, c)
        if c in digits:
            return f"{sql.rd(inner, digits[c])} as {c}"
        if c in MONEY:
            return f"cast({inner} as double) as {c}"
        return f"{inner} as {c}" if inner != c else c

    query(name, f"select {', '.join(text(c) for c in cols)} from {oracle_table}")(build)
