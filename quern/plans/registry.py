"""The registry of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def settled(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded (and without a negative zero), whole numbers as long: what both engines agree on."""
    kinds = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "float": lambda c: F.round(c.cast("double"), digits) + F.lit(0.0), "int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long"), "tinyint": lambda c: c.cast("long")}
    return df.select(*(kinds[t](F.col(f"`{n}`")).alias(n) if t in kinds else F.col(f"`{n}`") for n, t in df.dtypes))


def query(sql: str | None = None, doubles: str = "", longs: str = "", digits: int = 6, name: str | None = None, **views: str) -> Callable[[Query], Query]:
    """Register a query under its function's name. sql: the oracle, in which {x} stands for the view x; doubles and longs name its
    columns that are rounded and cast."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"another query has the name {key}")
        QUERIES[key] = lambda spark, sf_dir: settled(f(spark, sf_dir), digits)
        if sql:
            text = sql
            for view, body in views.items():
                text = text.replace("{" + view + "}", f"({body})")
            changes = [f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"' for c in doubles.split()] + [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in longs.split()]
            ORACLE_SQL[key] = f"SELECT * REPLACE ({', '.join(changes)}) FROM ({text})" if changes else text
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["group_report"](spark, sf_dir)


from quern.plans import corpus, extras, flows, records, shapes, training  # noqa: E402, F401  the modules register their queries
