"""Every registered query against DuckDB running its SQL on the same tables."""

import decimal

import duckdb
import pytest

from turnlake.plans import incremental_queries, raw_queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    rows = registry.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in rows.collect())
    if name not in registry.ORACLE_SQL:
        assert ours
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall()) == ours
