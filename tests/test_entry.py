"""The driver contract, and a few queries against DuckDB on the smallest data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's test data")
@pytest.mark.parametrize("name", ["bench_repo_counts", "repository_growth", "hourly_activity_dense", "language_weighted_daily", "participation_edges", "p1_found", "p2_found", "p4_found", "p6_found", "p7_found", "stream_dispositions", "silver_daily_stats", "silver_normalize", "corpus_dedup"])
def test_queries_equal_their_sql(spark, name):
    compare(spark, name)


def compare(spark, name):
    """Fails unless a query and its SQL give the same rows on the smallest data."""
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    rel = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)

    def rows(data, names):
        at = [list(names).index(c) for c in columns]
        show = lambda v: f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
        return sorted(tuple(show(r[i]) for i in at) for r in data)

    assert rows(df.collect(), df.columns) == rows(rel.fetchall(), rel.columns)
