"""Every registered query of the dataflow side against its SQL."""

from pathlib import Path

import duckdb
import pytest

from weirflow.queries import ORACLES, QUERIES

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="the driver's tables are not here")


def rows(df, columns):
    clean = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else int(v) if hasattr(v, "__index__") else v
    return sorted(repr([clean(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, str(DIR)).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for p in DIR.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.skipif(not DIR.exists(), reason="the driver's tables are not here")
def test_lineage_of_slices_needs_no_items(spark):
    plan = QUERIES["span_join_lineage"](spark, str(DIR))._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "items" not in plan
