"""Where queries register, with their SQL, and what their definitions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def long(c, name: str):
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long").alias(name)


def rounded(c, name: str, digits: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits).alias(name)


def pick(key: str, *values: str):
    """One of some texts by a key, and the same in SQL."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def sql_pick(key: str, *values: str) -> str:
    return f"[{', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}][{key} % {len(values)} + 1]"
