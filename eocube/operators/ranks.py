"""Exact ranks and order statistics within groups of any size: no task sorts or holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def _same(a: str, b: str, by: list[str]) -> list[Column]:
    return [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in by]


def ranks(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_rank`` (from 0, by ``order``) and ``_count`` within each group ``by``.

    Rows are dealt by ranges of (by, order) and numbered in their range; what is summed is a row for each group and
    range. Rows equal in ``by`` and ``order`` take neighbouring ranks, any of them first. Nulls come first.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = stage(df, "to-rank").withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(f"`{k}`") for k in [*by, *order]] + [F.col("_tie")]
    dealt = held.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie")
    at = stage(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_at", 33)), "ordered")
    runs = at.groupBy("_p", *[F.col(f"`{k}`") for k in by]).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_k"))
    group = Window.partitionBy(*[F.col(f"`{k}`") for k in by] or [F.lit(1)])  # a row for each range of the group
    runs = runs.withColumn("_count", F.sum("_k").over(group)).withColumn("_before", F.sum("_k").over(group.orderBy("_p")) - F.col("_k"))
    j = at.alias("a").join(runs.alias("b"), [F.col("a._p") == F.col("b._p"), *_same("a", "b", by)])
    return j.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("b._before") + F.col("a._at") - F.col("b._first")).alias("_rank"), F.col("b._count").alias("_count"))


def tile_of(rank: Column, count: Column, k: int) -> Column:
    """The tile from 1 to ``k`` of a rank, as SQL's ntile deals: the first ones take one row more."""
    size, more = F.floor(count / k), count % k
    wide = more * (size + 1)
    return F.when(rank < wide, F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - wide) / F.nullif(size, F.lit(0)))).cast("int") + 1


def select_positions(df: DataFrame, by: list[str], value: str, positions: dict[str, Column], bins: int = 4096, most: int = 10_000) -> DataFrame:
    """``(by, names.., _count)``: the values at sorted positions of each group, by narrowing histograms.

    ``positions`` are from 0, as columns over ``_count``, the group's rows with a value; a position outside gives null.
    Each round counts the values between a position's bounds in ``bins`` bins and keeps the bin that holds it, until its
    bounds are equal. Rows aren't moved: only counts by bin are. For few groups: bounds of up to ``most`` go to all
    tasks, more are joined by shuffle.
    """
    base = df.filter(F.col(f"`{value}`").isNotNull()).select(*[F.col(f"`{k}`") for k in by], F.col(f"`{value}`").cast("double").alias("_v"))
    g = base.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_count")).filter("_count > 0")
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), p.cast("long").alias("_k")) for n, p in positions.items()]))
    left = stage(g.withColumn("_w", wanted).select(*by, "_count", "_lo", "_hi", "_w.*").withColumn("_lo", F.when((F.col("_k") >= 0) & (F.col("_k") < F.col("_count")), F.col("_lo"))), "positions")
    found = left.filter("_lo is null or _lo = _hi")
    left = left.filter("_lo < _hi")
    while n := left.count():
        j = base.alias("a").join((F.broadcast(left) if n <= most else left).alias("b"), _same("a", "b", by) or F.lit(True)).filter("a._v between b._lo and b._hi")
        at = F.least(F.floor((F.col("a._v") - F.col("b._lo")) / (F.col("b._hi") - F.col("b._lo")) * bins), F.lit(bins - 1)).alias("_bin")
        h = j.groupBy(*[F.col(f"b.`{k}`") for k in by], "b._name", "b._k", "b._count", at).agg(F.count(F.lit(1)).alias("_c"), F.min("a._v").alias("_lo"), F.max("a._v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*by, "_name").orderBy("_bin"))  # bins rows
        now = h.withColumn("_u", upto).filter("_k < _u and _k >= _u - _c").select(*by, "_count", "_lo", "_hi", "_name", (F.col("_k") - F.col("_u") + F.col("_c")).alias("_k"))
        now = stage(now, "positions")
        found, left = found.unionByName(now.filter("_lo = _hi")), now.filter("_lo < _hi")
    kind = df.schema[value].dataType
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_lo"))).cast(kind).alias(n) for n in positions], F.max("_count").alias("_count"))


def medians(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Median by group: the mean of the two middle values."""
    n = F.col("_count")
    got = select_positions(df, by, value, {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2)})
    return got.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(name))


def sign_score(df: DataFrame, x: str, y: str, by: list[str], digits: int = 8) -> DataFrame:
    """``(by, score, n)``: sum of sign(dx) sign(dy) over all pairs of a group, and its rows, without making pairs.

    Equal points are counted first. Distinct values get ranks, and ranks are cut into digits. A pair that differs in x
    and in y has a highest digit in which its x differ and one in which its y differ: there both points share the higher
    digits, so they are in one cell of ``digits`` x ``digits`` counts, and the signs follow from the counts. Cells are
    plain groups, whatever values are equal; counts are added before they are shuffled.
    """
    g = F.to_json(F.struct(*[F.col(f"`{k}`") for k in by])) if by else F.lit("")
    rows = df.select(g.alias("_g"), *[F.col(f"`{k}`") for k in by], F.col(f"`{x}`").cast("double").alias("_x"), F.col(f"`{y}`").cast("double").alias("_y")).na.drop(subset=["_x", "_y"])
    points = stage(rows.groupBy("_g", *by, "_x", "_y").agg(F.count(F.lit(1)).alias("_c")), "points")
    names = points.groupBy("_g").agg(*[F.first(k).alias(k) for k in by], F.sum("_c").alias("n"))
    top = {}
    for v in ("_x", "_y"):
        r = stage(ranks(points.select("_g", v).distinct(), ["_g"], [v]).select("_g", v, F.col("_rank").alias(f"_r{v}")), "value-ranks")
        top[v] = r.agg(F.max(f"_r{v}")).first()[0] or 0
        points = points.join(r, ["_g", v])

    def levels(v):
        k = 1
        while digits**k <= top[v]:
            k += 1
        rank = F.col(f"_r{v}")
        return F.array(*[F.struct(F.lit(i).alias("l"), F.floor(rank / digits ** (i + 1)).alias("p"), (F.floor(rank / digits**i) % digits).alias("d")) for i in range(k)])

    at = points.withColumn("_a", F.explode(levels("_x"))).withColumn("_b", F.explode(levels("_y")))
    cells = at.groupBy("_g", F.col("_a.l").alias("lx"), F.col("_a.p").alias("px"), F.col("_b.l").alias("ly"), F.col("_b.p").alias("py"), F.col("_a.d").alias("i"), F.col("_b.d").alias("j")).agg(F.sum("_c").alias("c"))
    held = cells.groupBy("_g", "lx", "px", "ly", "py").agg(F.collect_list(F.struct("i", "j", "c")).alias("e"))  # up to digits x digits
    one = lambda e: lambda s, f: s + F.when(f["i"] < e["i"], F.signum(e["j"] - f["j"]).cast("long") * e["c"] * f["c"]).otherwise(F.lit(0).cast("long"))
    score = F.aggregate("e", F.lit(0).cast("long"), lambda s, e: s + F.aggregate("e", F.lit(0).cast("long"), one(e)))
    total = held.groupBy("_g").agg(F.sum(score).alias("score"))
    return names.join(total, "_g").select(*by, "score", "n")
