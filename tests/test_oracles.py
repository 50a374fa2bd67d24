"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from voxspan import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that run many small jobs are compared at sf0.01 by the driver.
SLOW = {"quota_sample", "flood_fill", "graph_edges", "edge_cost", "stair_component_stats", "shortest_paths", "path_markers"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _rows(df):
    df = df[sorted(df.columns)]

    def text(v):
        if pd.isna(v):
            return "-"
        return str(v) if isinstance(v, (bool, str)) or type(v).__name__ == "bool_" else f"{float(v) + 0.0:.4f}"

    return sorted(tuple(text(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in plans.oracle_sql() if n not in SLOW])
def test_same_as_sql(spark, duck, sf, name):
    got, want = plans.queries()[name](spark, sf).toPandas(), duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
