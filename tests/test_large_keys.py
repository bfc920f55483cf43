"""Queries against their SQL on keys that the small tables don't have."""

from __future__ import annotations

import duckdb
from lemmaflow.registry import ORACLES, QUERIES


def test_web_candidates_of_large_keys(spark, tmp_path):
    """the SQL took the number of a part modulo 1,000,000, the query as it stands in the title."""
    part = f"{tmp_path}/part.parquet"
    duckdb.execute(f"COPY (SELECT p_partkey + i * 999990 AS p_partkey, * EXCLUDE (p_partkey, i) FROM '/root/testdata/sf0.001/part.parquet', range(3) t(i)) TO '{part}' (FORMAT parquet)")
    expected = duckdb.sql(ORACLES["ext_web_candidates"].replace("FROM part", f"FROM '{part}'"))
    rows = QUERIES["ext_web_candidates"](spark, str(tmp_path)).select(*expected.columns).collect()
    assert max(r.part for r in rows) > 1_999_980
    assert sorted(map(tuple, rows)) == sorted(expected.fetchall())
