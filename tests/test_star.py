"""Every star query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from plinth.plans import city, star  # noqa: F401  city adds its queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    text = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(star.queries()))
def test_same_as_sql(spark, db, name):
    got, want = star.queries()[name](spark, FOLDER), db.sql(star.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r) for r in got.collect()]
    assert rows and plain(rows, got.columns) == plain(want.fetchall(), want.columns)


def test_known_counts(spark):
    counts = {r.relation: r.n for r in star.queries()["spatial_relation_counts"](spark, FOLDER).collect()}
    assert counts == {"INTERSECTS": 162, "TOUCHES": 176, "ADJACENT_TO": 648, "none": 9582}
