"""Every registered query against its SQL in DuckDB, on whole tables of the smallest scale."""

import math

import duckdb
import pytest
from conftest import SF

from latentlake.catalog import all_oracles, all_queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)
QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "is_finite"):
        return "nan" if math.isnan(v) else repr(float(v))
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert len(df.columns) == len(set(df.columns))
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert table(df.columns, rows) == table(columns, result.fetchall())


def test_only_fits_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"m2_probe_l1", "m4_predictions", "m6_latent_map", "h17_probe_top_latents", "p6_probe_metrics"}
