"""Ranks, order statistics and sign scores without a task that holds a group, against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from eocube.operators import stats as S
from eocube.operators.ranks import medians, ranks, select_positions, sign_score, tile_of


def rows(values, seed=1, groups=("a", "b", None)):
    rnd = random.Random(seed)
    return [(rnd.choice(groups), i, rnd.randrange(values) / 8 if rnd.random() < 0.95 else None) for i in range(400)]


def by_group(data):
    out = {}
    for g, _, v in data:
        if v is not None:
            out.setdefault(g, []).append(v)
    return {g: sorted(v) for g, v in out.items()}


@pytest.mark.parametrize("values", [3, 5000])
def test_ranks_and_tiles(spark, values):
    data = [r for r in rows(values) if r[2] is not None]
    df = spark.createDataFrame(data, "g string, k int, v double")
    got = ranks(df, ["g"], ["v", "k"]).withColumn("t", tile_of(F.col("_rank"), F.col("_count"), 7)).collect()
    assert len(got) == len(data)
    for g in ("a", "b", None):
        own = sorted((v, k) for h, k, v in data if h == g)
        assert [(r.v, r.k) for r in sorted((r for r in got if r.g == g), key=lambda r: r._rank)] == own and {r._count for r in got if r.g == g} == {len(own)}
        size, more = divmod(len(own), 7)
        assert [sum(r.t == t for r in got if r.g == g) for t in range(1, 8)] == [size + (t <= more) for t in range(1, 8)]
    equal = spark.createDataFrame([("a", 1.0)] * 9, "g string, v double")  # equal rows: each rank once
    assert sorted(r._rank for r in ranks(equal, ["g"], ["v"]).collect()) == list(range(9))
    assert ranks(df.limit(0), ["g"], ["v"]).collect() == []


@pytest.mark.parametrize("values", [2, 50, 10**6])
@pytest.mark.parametrize("bins", [2, 4096])
def test_positions_by_narrowing(spark, values, bins):
    data = rows(values, values)
    df = spark.createDataFrame(data, "g string, k int, v double")
    n = F.col("_count")
    got = {r.g: r for r in select_positions(df, ["g"], "v", {"lo": F.lit(0), "mid": F.floor(n / 2), "hi": n - 1, "none": n}, bins, most=0 if bins == 2 else 10_000).collect()}
    want = by_group(data)
    assert got.keys() == want.keys()
    for g, v in want.items():
        assert (got[g].lo, got[g].mid, got[g].hi, got[g].none, got[g]._count) == (v[0], v[len(v) // 2], v[-1], None, len(v))
    all_values = sorted(x for v in want.values() for x in v)
    assert select_positions(df, [], "v", {"q": F.floor(n * 0.9)}).first().q == all_values[int(len(all_values) * 0.9)]
    assert {r.g: r.m for r in medians(df, ["g"], "v", "m").collect()} == {g: (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for g, v in want.items()}
    assert select_positions(df.limit(0), ["g"], "v", {"q": F.lit(0)}).collect() == []


@pytest.mark.parametrize("values", [1, 2, 5, 90, 10**6])
def test_sign_score(spark, values):
    rnd = random.Random(values)
    data = [(g, rnd.randrange(values) * 1.0, rnd.randrange(5 if values < 100 else values) * 1.0) for g in (1, 2) for _ in range(250)]
    sign = lambda v: (v > 0) - (v < 0)
    for r in sign_score(spark.createDataFrame(data, "g int, x double, y double"), "x", "y", ["g"]).collect():
        own = [(x, y) for g, x, y in data if g == r.g]
        assert (r.score, r.n) == (sum(sign(a - c) * sign(b - d) for i, (a, b) in enumerate(own) for c, d in own[:i]), 250)


def test_hundredth_farthest_out_goes(spark):
    data = [(i % 2, i, (i % 7) * 1.0) for i in range(300)] + [(0, 900, 1e6), (1, 901, -1e6), (1, 902, 99.0)]
    left = {r.k for r in S.robust_outliers(spark.createDataFrame(data, "g int, k int, v double"), ["g"], "v").collect()}
    assert {k for _, k, _ in data} - left == {900, 901, 902}


def test_trimmed_groups(spark):
    data = rows(300, 6)
    got = {r.g: r for r in S.trimmed(spark.createDataFrame(data, "g string, k int, v double"), ["g"], "v").collect()}
    for g, v in by_group(data).items():
        kept = v[int(len(v) * 0.05) : -(-len(v) * 19 // 20)]
        assert got[g].n == len(kept) and got[g].mean_value == pytest.approx(sum(kept) / len(kept))
