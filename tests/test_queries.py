"""Every query against its SQL in DuckDB."""

from __future__ import annotations

import os


import duckdb
import pytest
from lemmaflow.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    return sorted(tuple("\0" if x is None else str(x).lower() if isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    order = sorted(got.columns)
    assert normal([r[c] for c in order] for r in rows) == normal(expected.project(", ".join(f'"{c}"' for c in order)).fetchall())
