"""Every named grid query against its SQL twin."""

import duckdb
import pytest

from halocline.plans import observed, roster  # noqa: F401

SF = "/root/testdata/sf0.001"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: The largest decompositions are left to the driver's comparison.
NAMES = [n for n in roster.ORACLES if not n.endswith(("_v", "_serial")) and n != "obs_event_parts"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = roster.QUERIES[name](spark, SF)
    got = duck.execute(roster.ORACLES[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(cols, got.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
