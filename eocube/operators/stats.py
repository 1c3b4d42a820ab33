"""Summary statistics, accuracy measures and rank statistics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .ranks import medians, ranks, select_positions, sign_score, tile_of


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent non-null value by key; of equals the smallest."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), value)).alias(value), F.max("_n").alias("n"))


def confusion(df: DataFrame, real: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(real).alias("real"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(matrix: DataFrame) -> DataFrame:
    """``(cls, omission, commission, overall)`` from ``(real, predicted, n)``; the matrix has a cell for each pair of classes."""
    hit = F.when(F.col("real") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = matrix.groupBy(F.col("real").alias("cls")).agg((1 - F.sum(hit) / F.sum("n")).alias("omission"))
    cols = matrix.groupBy(F.col("predicted").alias("cls")).agg((1 - F.sum(hit) / F.sum("n")).alias("commission"))
    overall = matrix.agg((F.sum(hit) / F.sum("n")).alias("overall"))
    j = rows.join(cols, "cls", "full").crossJoin(F.broadcast(overall))  # one row
    return j.select("cls", F.round("omission", 9).alias("omission"), F.round("commission", 9).alias("commission"), F.round("overall", 9).alias("overall"))


def errors(df: DataFrame, real: str, predicted: str, by: list[str]) -> DataFrame:
    """How many rows are classed, and how many wrongly, by pixel or by date."""
    known = df.filter(F.col(real).isNotNull() & F.col(predicted).isNotNull())
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(real) != F.col(predicted)).alias("n_errors"))


def goodness_of_fit(df: DataFrame, real: str, fitted: str, by: list[str] | None = None) -> DataFrame:
    """R2, RMSE, MAE, MSE and mean error, in one pass over sums."""
    e = F.col(fitted) - F.col(real)
    g = df.filter(F.col(real).isNotNull() & F.col(fitted).isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_s"), F.sum(F.abs(e)).alias("_a"), F.sum(e).alias("_e"), F.var_pop(real).alias("_v"),
    )
    n = F.col("n")
    return g.select(
        *(by or []), "n", F.round(1 - F.col("_s") / F.nullif(n * F.col("_v"), F.lit(0.0)), 5).alias("r2"), F.round(F.sqrt(F.col("_s") / n), 9).alias("rmse"),
        F.round(F.col("_a") / n, 9).alias("mae"), F.round(F.col("_s") / n, 9).alias("mse"), F.round(F.col("_e") / n, 9).alias("mean_error"),
    )


def linear_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.round(F.regr_slope(y, x), 9).alias("slope"), F.round(F.regr_intercept(y, x), 9).alias("intercept"), F.round(F.regr_r2(y, x), 9).alias("r2"), F.round(F.corr(x, y), 9).alias("r"), F.regr_count(y, x).alias("n"))


def correlation_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson r of every pair of columns, in one pass."""
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in combinations(names, 2)])
    return row.unpivot([], row.columns, "pair", "r").select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), F.round("r", 9).alias("r"))


def mid_ranks(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks within groups, equal values sharing their mean rank."""
    w = Window.partitionBy(*by).orderBy(value)
    same = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation by group; groups are to be of a size that one task sorts."""
    r = mid_ranks(mid_ranks(df, x, by, "_rx"), y, by, "_ry")
    return r.groupBy(*by).agg(F.round(F.corr("_rx", "_ry"), 9).alias("rho"), F.count(F.lit(1)).alias("n"))


def kendall(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Kendall tau-a by group: concordant less discordant pairs over all pairs, without making pairs."""
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    return sign_score(df, x, y, by).filter("n > 1").select(*by, F.round(F.col("score") / pairs, 9).alias("tau"), pairs.alias("pairs"))


def two_sample_distances(df: DataFrame, cls: str, value: str, reference) -> DataFrame:
    """Kolmogorov-Smirnov, Wasserstein-1 and Cramer-von Mises distance of each class to the reference class, from counts by distinct value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(cls).alias("cls"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ref = counted.filter(F.col("cls") == reference)
    others = counted.filter(F.col("cls") != reference)
    # Each other class with the reference's values beside its own.
    both = others.select("cls", "v", "n", F.lit(0).alias("m")).unionByName(ref.select("v", F.col("n").alias("m")).join(others.select("cls").distinct(), how="cross").select("cls", "v", F.lit(0).alias("n"), "m"))
    both = both.groupBy("cls", "v").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    w, up = Window.partitionBy("cls").orderBy("v"), Window.partitionBy("cls")
    all_n, all_m = F.sum("n").over(up), F.sum("m").over(up)
    both = both.select("cls", (F.sum("n").over(w) / all_n - F.sum("m").over(w) / all_m).alias("gap"), (F.lead("v").over(w) - F.col("v")).alias("step"), (F.col("n") + F.col("m")).alias("k"), (all_n * all_m / F.pow(all_n + all_m, 2)).alias("f"))
    # Cramer-von Mises: squared gaps over the pooled values.
    return both.groupBy("cls").agg(F.round(F.max(F.abs("gap")), 9).alias("ks"), F.round(F.sum(F.abs("gap") * F.col("step")), 5).alias("wasserstein"), F.round(F.sum(F.col("gap") * F.col("gap") * F.col("k") * F.col("f")), 6).alias("cvm"))


def positional_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """The value at position floor(n * q) of the sorted group, for each q."""
    w, up = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by)
    r = df.filter(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(up).alias("_n"))
    return r.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == F.floor(F.col("_n") * q), F.col(value))).alias(f"q{round(q * 100)}") for q in shares])


def bin_means(df: DataFrame, by_value: str, value: str, width: float) -> DataFrame:
    """Mean by bins of fixed width, with positional 30 % and 70 % bounds."""
    b = df.filter(F.col(by_value).isNotNull() & F.col(value).isNotNull()).withColumn("bin", F.floor(F.col(by_value) / width).cast("int"))
    bounds = select_positions(b, ["bin"], value, {f"q{round(100 * q)}": F.floor(F.col("_count") * q) for q in (0.3, 0.7)}).drop("_count")
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 9).alias("mean_value")).join(bounds, "bin")


def trimmed(df: DataFrame, by: list[str], value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Count and mean between two positional shares of each group, of any size."""
    r = ranks(df.filter(F.col(value).isNotNull()).select(*by, value), by, [value])
    kept = r.filter((F.col("_rank") >= F.floor(F.col("_count") * low)) & (F.col("_rank") < F.ceil(F.col("_count") * high)))
    return kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 9).alias("mean_value"))


def factor_contribution(df: DataFrame) -> DataFrame:
    """Shares of two drivers from four scenarios (both changed, only a, only b, none): mean over both orders of change."""
    a = ((F.col("both") - F.col("only_b")) + (F.col("only_a") - F.col("none"))) / 2
    b = ((F.col("both") - F.col("only_a")) + (F.col("only_b") - F.col("none"))) / 2
    return df.select("y", "x", F.round(a, 9).alias("part_a"), F.round(b, 9).alias("part_b"))


def rank_aggregate(lists: DataFrame, items: str = "items") -> DataFrame:
    """Elements of many ordered lists by their mean position."""
    return lists.select(F.posexplode(items).alias("pos", "item")).groupBy("item").agg(F.round(F.avg("pos"), 9).alias("mean_pos"), F.count(F.lit(1)).alias("n"))


def exclude_groups(df: DataFrame, by: list[str], outlier, share: float = 0.25) -> DataFrame:
    """Rows of the groups in which at most ``share`` of the rows are outliers."""
    good = df.groupBy(*by).agg((F.count_if(outlier) / F.count(F.lit(1))).alias("_s")).filter(F.col("_s") <= share).select(*by)
    return df.join(good, by, "left_semi")


def otsu(df: DataFrame, value: str, low: float, high: float, bins: int = 64) -> DataFrame:
    """Threshold of the largest between-class variance, over a histogram of fixed bins."""
    width = (high - low) / bins
    h = df.filter(F.col(value).between(low, high)).groupBy(F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bin")  # bins rows
    up = Window.partitionBy(F.lit(1))
    mid = low + (F.col("bin") + 0.5) * width
    h = h.select("bin", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * mid).over(w).alias("s0"), F.sum("n").over(up).alias("w"), F.sum(F.col("n") * mid).over(up).alias("s"))
    w1 = F.col("w") - F.col("w0")
    var = F.when(w1 > 0, F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.nullif(w1, F.lit(0)), 2))
    return h.select("bin", F.round(var, 4).alias("v")).agg(F.max_by("bin", F.struct("v", -F.col("bin"))).alias("bin")).select(F.round(low + (F.col("bin") + 1) * width, 9).alias("threshold"))


def subtotals(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Mean by (a, b), with an "all" row by a: the mean over b."""
    cell = df.groupBy(a, F.col(b).cast("string").alias(b)).agg(F.avg(value).alias("v"))
    top = cell.groupBy(a).agg(F.avg("v").alias("v")).select(a, F.lit("all").alias(b), "v")
    return cell.unionByName(top).select(a, b, F.round("v", 9).alias("mean_value"))


def grouping_means(df: DataFrame, names: list[str], value: str) -> DataFrame:
    """Mean of ``value`` for each value of each single column: grouping sets ((a), (b), ...)."""
    sets = [[F.col(n)] for n in names]
    g = df.groupingSets(sets, *names).agg(F.round(F.avg(value), 9).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return g.select(F.concat_ws("", *[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names]).alias("parameter"), F.coalesce(*[F.col(n).cast("string") for n in names]).alias("setting"), "mean_value", "n")


def folds_contiguous(df: DataFrame, key: str, k: int) -> DataFrame:
    """k folds of neighbouring rows in the order of a unique key, by the key's rank from counts in two levels."""
    return ranked(df, key).withColumn("fold", F.least(F.floor((F.col("rank") - 1) / F.greatest(F.floor(F.col("total") / k), F.lit(1))), F.lit(k - 1)).cast("int")).select(key, "fold")


def ranked(df: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """``rank`` (from 1) and ``total`` of a whole-number key: blocks are counted and summed first, then ranked inside."""
    b = df.withColumn("_b", F.floor(F.col(key) / block))
    blocks = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.select("_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("total"))
    inner = Window.partitionBy("_b").orderBy(key)
    return b.join(blocks, "_b").withColumn("rank", F.col("_first") + F.row_number().over(inner)).drop("_b", "_first")


def stratified_folds(df: DataFrame, value: str, key: str, strata: int, k: int, by: list[str]) -> DataFrame:
    """Fold of each row: quantile strata of the value, then seeded shuffled folds in each (within groups ``by``)."""
    s = ranks(df, by, [value, key]).withColumn("stratum", tile_of(F.col("_rank"), F.col("_count"), strata)).drop("_rank", "_count")
    s = ranks(s.withColumn("_deal", F.md5(F.concat(F.col(key).cast("string"), F.lit(":7")))), [*by, "stratum"], ["_deal"])
    return s.withColumn("fold", tile_of(F.col("_rank"), F.col("_count"), k)).drop("_deal", "_rank", "_count")


def robust_outliers(df: DataFrame, by: list[str], value: str, share: float = 0.01) -> DataFrame:
    """Rows less the ``share`` of them that lie farthest out: by robust z-score (median and median absolute deviation of
    their group). Rows tied with the last that stays stay as well. Groups are few and may be of any size."""
    d = df.join(medians(df, by, value, "_m"), by).withColumn("_a", F.abs(F.col(value) - F.col("_m")))
    z = F.round(F.coalesce(0.6745 * F.col("_a") / F.nullif(F.col("_mad"), F.lit(0.0)), F.lit(0.0)), 9)
    d = stage(d.join(medians(d, by, "_a", "_mad"), by).withColumn("_z", z).drop("_m", "_a", "_mad"), "scores")
    last = select_positions(d, [], "_z", {"_last": F.ceil(F.col("_count") * (1 - share)) - 1}).select("_last")
    return d.crossJoin(F.broadcast(last)).filter("_z <= _last").drop("_z", "_last")  # one row


def weighted_mae(df: DataFrame, real: str, fitted: str, centre: float = 3.0) -> DataFrame:
    """Mean absolute error weighted by a sigmoid of the real value around ``centre``."""
    w = 1 / (1 + F.exp(-(F.col(real) - centre)))
    return df.agg(F.round(F.sum(w * F.abs(F.col(real) - F.col(fitted))) / F.sum(w), 9).alias("weighted_mae"))
