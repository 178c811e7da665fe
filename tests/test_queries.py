import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import build, catalog, more, pages, service  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rows = con.execute(catalog.SQL[name])
    names = [x[0] for x in rows.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rows.fetchall())
    assert sorted(names) == cols and got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_rectangles_conserve_area(spark):
    """Parts of a cover never overlap a region and never exceed the cover."""
    from quire.plans import views

    parts = catalog.QUERIES["q45_rect_difference"](spark, SF)
    regions = views.boxes(spark, SF).where("kind = 0")
    assert parts.alias("a").join(regions.alias("b"), "page").where("a.left < b.right AND a.right > b.left AND a.top < b.bottom AND a.bottom > b.top").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
