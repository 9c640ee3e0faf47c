"""Every query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


def values(df):
    df = df[sorted(df.columns)].astype(str)
    return sorted(map(tuple, df.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, name):
    base = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        base.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = entry.queries()[name](spark, DATA)
    # whole numbers stay whole where some are null
    wanted, got = base.execute(entry.oracle_sql()[name]).df(), found.toPandas().astype({c: "Int64" for c, kind in found.dtypes if kind in ("int", "bigint")})
    assert sorted(got.columns) == sorted(wanted.columns)
    assert values(got) == values(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_prices_that_round_up_to_a_thousand(spark, tmp_path):
    prices = "SELECT 1 AS l_orderkey, CAST(range AS INT) AS l_linenumber, [999.4, 999.49, 999.5, 999.74, -999.74, 999.99, 1000.0, -1000.0, 0.0, 1004.99][range + 1]::DOUBLE AS l_extendedprice, 0.04 AS l_discount, 0.0 AS l_tax, 3.0 AS l_quantity FROM range(10)"
    duckdb.sql(f"COPY (SELECT * REPLACE (l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax, l_quantity::DOUBLE AS l_quantity) FROM ({prices})) TO '{tmp_path}/lineitem.parquet'")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert values(entry.queries()["formatted_numbers"](spark, str(tmp_path)).toPandas()) == values(base.execute(entry.oracle_sql()["formatted_numbers"]).df())
