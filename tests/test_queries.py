"""Every registered query against its SQL at the smallest scale."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry
from check_queries import canonical
from driver_queries import spark_queries
from driver_queries.oracle import ORACLE
from driver_queries.spark_queries import QUERIES
from limnokit.session import COMPILED_BYTES, METHOD_LIMIT, settle

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() == 6


# Groups are too small at this scale for every curve to have an inner optimum
CURVES = {"incubation_curves", "saturating_share"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - CURVES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = pd.DataFrame.from_records([tuple(r) for r in df.collect()], columns=df.columns).astype(object)
    res = duck.execute(ORACLE[name])
    want = pd.DataFrame.from_records(res.fetchall(), columns=[d[0] for d in res.description]).astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_lines_of_incubations_are_compiled(spark, monkeypatch):
    """The step from the readings to the lines splits methods above HotSpot's limit, in any session."""
    seen = {}

    def spy(df, label):
        seen[label] = spark.conf.get(METHOD_LIMIT)
        return settle(df, label)

    monkeypatch.setattr(spark_queries, "settle", spy)
    own = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, "65535")
    try:
        assert spark_queries.incubation_lines(spark, SF).count() > 0
        assert seen == {"lines": str(COMPILED_BYTES)} and spark.conf.get(METHOD_LIMIT) == "65535"
    finally:
        spark.conf.set(METHOD_LIMIT, own)
