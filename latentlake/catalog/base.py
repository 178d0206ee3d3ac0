"""Query registration: a Spark builder and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentlake.catalog.fixtures import VIEWS
from latentlake.runtime import ship

Builder = Callable[[SparkSession, str], DataFrame]
_MODULES = ("scans", "scalars", "sampling", "stats", "mining", "analytics", "protos", "registry", "probe", "flows")


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


_QUERIES: dict[str, Query] = {}


def with_views(body: str, needs: str) -> str:
    """Prefix ``body`` with the named fixture views and whatever they build on."""
    done: list[str] = []

    def add(name: str) -> None:
        deps, _ = VIEWS[name]
        for dep in deps.split():
            add(dep)
        if name not in done:
            done.append(name)

    for name in needs.split():
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in done)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}" if ctes else body
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}" if ctes else body
    return f"WITH {ctes}\n{body}" if ctes else body


def query(name: str, sql: str | None = None, needs: str = "", d: str = "", digits: int = 6):
    """Register a query; ``d`` names the double columns, rounded alike on both sides."""
    doubles = d.split()

    def wrap(build: Builder) -> Builder:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            df = build(spark, sf)
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in doubles})

        text = None
        if sql is not None:
            text = with_views(sql, needs)
            if doubles:
                rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in doubles)
                text = f"SELECT * REPLACE ({rounded}) FROM (\n{text}\n)"
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = Query(name, run, text)
        return build

    return wrap


def _load() -> None:
    for module in _MODULES:
        import_module(f"latentlake.catalog.{module}")


def all_queries() -> dict[str, Builder]:
    _load()
    return {n: q.build for n, q in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return {n: q.sql for n, q in _QUERIES.items() if q.sql is not None}
