"""Each query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from strandline.sources import shared

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


def rows(df):
    names = sorted(df.columns)
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    frame = df[names].astype(object).where(df[names].notna(), None)
    return names, sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=str)


@pytest.fixture(autouse=True)
def tables_removed(spark):
    yield
    shared.remove_written(spark)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sf_dir, con, name):
    assert rows(entry.queries()[name](spark, sf_dir).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", [n for n in sorted(entry.queries()) if n.startswith("q_") and n not in entry.oracle_sql()])
def test_query_without_sql(spark, sf_dir, name):
    """What their operators compute is tested against brute force; here their rows are distinct and agree in a second run."""
    first = rows(entry.queries()[name](spark, sf_dir).toPandas())
    assert len(set(first[1])) == len(first[1]) and first == rows(entry.queries()[name](spark, sf_dir).toPandas())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_estimator_check_to_the_digits_of_its_sql(spark, sf_dir, con):
    """mean_s has six digits, as in the SQL."""
    own = entry.queries()["q_estimator_check"](spark, sf_dir).toPandas()
    want = con.execute(entry.oracle_sql()["q_estimator_check"]).df()
    of = lambda df: {(r.site, r.size_): r.mean_s for r in df.rename(columns={"size": "size_"}).itertuples()}
    assert of(own) == pytest.approx(of(want), abs=1e-9)
