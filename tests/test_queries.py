"""Registered queries against their SQL on the smallest tables, where these are at hand."""

import datetime
import math
import os

import pandas as pd
import pytest

from eocube.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f").replace(" 00:00:00.000000", "")
    if isinstance(v, datetime.date):
        return v.isoformat()
    return bool(v) if str(type(v)).find("bool") >= 0 else float(v) if not isinstance(v, str) else v


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-9)
    return a == b


def table(df):
    cols = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False)]
    return cols, sorted(rows, key=lambda r: tuple((v is None, repr(round(v, 3) + 0.0 if isinstance(v, float) else v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    (cols, got), (names, want) = table(QUERIES[name](spark, SF).toPandas()), table(duck.sql(ORACLE[name]).df())
    assert cols == names and len(got) == len(want)
    assert not [(g, w) for g, w in zip(got, want) if not all(map(same, g, w))][:3]


@pytest.mark.parametrize("name", ["t10_preferred_curve", "m11_group_refits", "t13_index_fitness", "n13_repair_depressions"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
