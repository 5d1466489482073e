"""Registry of the catalogued queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PANEL = f"panel AS ({fx.PANEL_SQL})"
EPANEL = f"epanel AS ({fx.EVENTS_SQL})"
OOF = fx.EXPERTS_CTE.replace("AS STRING", "AS VARCHAR")


def query(name: str, sql: str | None = None, *, ctes: tuple[str, ...] = (), digits: int = 6, **column_digits: int):
    """Register a query; doubles are rounded alike on both sides (``digits``, or per column)."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            out = []
            for field in df.schema:
                c = F.col(f"`{field.name}`")
                if field.dataType.simpleString() in ("double", "float"):
                    c = F.round(c.cast("double"), column_digits.get(field.name, digits)) + F.lit(0.0)
                out.append(c.alias(field.name))
            return df.select(*out)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = _rounded(sql, ctes, digits, column_digits)
        return fn

    return wrap


def _rounded(sql: str, ctes: tuple[str, ...], digits: int, column_digits: dict[str, int]) -> str:
    """Wrap the oracle so that columns listed as {{d:a b c}} in the SQL tail are rounded."""

    body, _, doubles = sql.partition("--d:")
    names = doubles.split()
    head = "WITH " + ", ".join(ctes) + " " if ctes else ""
    if not names:
        return head + body
    replaced = ", ".join(f"round(CAST({n} AS DOUBLE), {column_digits.get(n, digits)}) + 0e0 AS {n}" for n in names)
    if ctes and body.lstrip().upper().startswith("WITH "):
        body = body.lstrip()[5:]
        raise ValueError("put CTEs into ctes=, not into the body: " + body[:40])
    return f"{head}SELECT * REPLACE ({replaced}) FROM ({body}) AS outcome"


panel, epanel, oof, table = fx.panel, fx.event_panel, fx.oof, fx.table
