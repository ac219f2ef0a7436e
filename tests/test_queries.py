"""Every query with a DuckDB twin, over whole tables, against it."""

from __future__ import annotations

from pathlib import Path

import pytest

from lexispark.plans import source_queries  # noqa: F401  adds its queries
from lexispark.plans.queries import ORACLES, QUERIES


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple("~" if r[k] is None else f"{r[k]:.6g}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    out = QUERIES[name](spark, data)
    ran = con.execute(ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(out.columns) == sorted(names)
    assert rows(out.columns, out.collect()) == rows(names, ran.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
