"""Every registered query of the library proper against its SQL."""

import pytest

from fanplume.plans import cube_queries, place_queries, source_queries, store_queries, stream_queries

QUERIES = {**cube_queries.QUERIES, **place_queries.QUERIES, **store_queries.QUERIES, **stream_queries.QUERIES, **source_queries.QUERIES}
ORACLE_SQL = {**cube_queries.ORACLE_SQL, **place_queries.ORACLE_SQL, **store_queries.ORACLE_SQL, **stream_queries.ORACLE_SQL, **source_queries.ORACLE_SQL}


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_sql(key, same):
    same(QUERIES[key], ORACLE_SQL[key])


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_registration_needs_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "True", out.stderr


def shifted_suppliers(spark, tmp_path, key):
    """A query's rows, and its SQL's, on suppliers whose latitudes go far beyond 90, sorted and unrounded."""
    import duckdb

    folder = str(tmp_path / "supplier.parquet")
    spark.sql("SELECT k AS s_suppkey, CAST(k % 25 AS INT) AS s_nationkey, ((k * 7919) % 1100000) / 100D AS s_acctbal FROM (SELECT explode(concat(sequence(0L, 122L), sequence(1990L, 2099L), sequence(399950L, 400022L), sequence(5000000000L, 5000000052L))) AS k)").write.parquet(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{folder}/*.parquet'")
    want = con.sql(ORACLE_SQL[key])
    names = sorted(want.columns)
    rows = lambda found: sorted(([None if v is None else v if isinstance(v, str) else float(v) for v in r] for r in found), key=repr)
    return rows(QUERIES[key](spark, str(tmp_path)).select(names).collect()), rows(want.select(*names).fetchall())


def test_round_trip_of_routes_off_the_globe(spark, tmp_path):
    got, want = shifted_suppliers(spark, tmp_path, "sc15_round_trip")
    assert got == want and len(got) == 359


def test_points_off_the_globe_are_refused_unless_asked_for():
    from fanplume.sources.tracks import polyline_points

    with pytest.raises(ValueError):
        polyline_points("_bnmP_evi@")
    assert polyline_points("_bnmP_evi@", on_globe=False) == [(91.5, 7.0)]
    with pytest.raises(ValueError):
        polyline_points("_" * 1_000_000, on_globe=False)


def test_tracks_off_the_globe_come_back_from_gpx(spark, tmp_path):
    got, want = shifted_suppliers(spark, tmp_path, "sc14_gpx_scan")
    assert got == want and len(got) == 359
