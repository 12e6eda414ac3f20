"""Every query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestar.plans import catalog

SF = "/root/testdata/sf0.001"
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalog.ORACLE_SQL[name]).df()[list(got.columns)]
    by = list(got.columns)
    got, want = got.sort_values(by).values.tolist(), want.sort_values(by).values.tolist()
    assert len(got) == len(want)
    for x, y in zip(got, want):
        assert all(p == q or isinstance(p, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-6) for p, q in zip(x, y)), (x, y)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_refit_reads_its_view_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    view = catalog.view_e(spark, SF)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(catalog, "view_e", lambda spark, d: view.mapInArrow(counted, view.schema))
    assert catalog.QUERIES["refit_bootstrap_dm"](spark, SF).count() == 1
    assert read.value == view.count()


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
