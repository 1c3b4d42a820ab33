"""Quality rules with risk-controlled thresholds.

Each rule compares a statistic of a document with a cutoff and rejects what is beyond it. Cutoffs are learnt from
labelled documents: for every stratum (language) and rule, the strictest cutoff is taken that loses at most ``k`` of the
``n`` good documents, where ``k`` is the largest number with P(Binomial(n, alpha) <= k) <= delta / tests. As ``k`` depends
on ``n`` alone, this is the exact binomial (order statistic) bound: with that confidence the rule rejects at most the
share ``alpha`` of all good documents, whichever value the data put there. Tests are all strata and the pool, times all
rules (Bonferroni), so with probability 1 - ``delta`` all stated limits hold at once. ``ALPHA`` spends the risk by rule;
its sum bounds what all rules lose together. A stratum with too few labels for a rule takes the pool's cutoff (``level``
says which: the bound is then one for good documents of all strata together); without enough labels in the pool there is
none. Cutoffs never go under ``FLOOR``, so that a single sign rejects no document; a milder cutoff keeps the bound.

Only counts by stratum, rule and step are gathered: their number doesn't grow with the documents.

Edge cases: null and empty texts have no words (all counts 0; base_failed, as n_words < 20); a null stratum is a
stratum of its own; repeated labels of a document count each; documents without labels don't count; without labels
only the base rule rejects; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import batches, read

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_bangs", "n_bars", "n_caps", "n_same_words"]
#: Rules: the share that is tested; beyond the cutoff a document is rejected.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "bangs": "n_bangs / greatest(word_chars, 1)",
    "caps": "n_caps / greatest(word_chars, 1)",
    "same_words": "n_same_words / greatest(n_words, 1)",
    "dup_lines": "least(1, n_dup_lines / greatest(n_words, 1))",
}
#: Share of good documents that a rule may lose, and the least cutoff.
ALPHA = {"symbols": 0.02, "repeats": 0.01, "bangs": 0.01, "caps": 0.005, "same_words": 0.005, "dup_lines": 0.005}
FLOOR = {"symbols": 0.005, "repeats": 0.02, "bangs": 0.005, "caps": 0.05, "same_words": 0.02, "dup_lines": 0.01}
#: Shares are counted by steps of this fineness.
STEPS = 2_000
_SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\v\f\r"


def repeated_words(ids: np.ndarray, n: int = 8) -> int:
    """Words inside windows of ``n`` (a power of two) that stand twice or more; exact: windows are renumbered, not hashed."""
    if len(ids) < n + 1:
        return 0
    code, width = ids, 1
    while width < n:
        a, b = code[:-width], code[width:]
        _, code, count = np.unique(a * (int(code.max()) + 1) + b, return_inverse=True, return_counts=True)
        if count.max() < 2:
            return 0
        width *= 2
    start = np.flatnonzero(count[code] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[start] += 1
    cover[start + n] -= 1
    return int((np.cumsum(cover) > 0).sum())


def count(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of one text."""
    if not text:
        return (0,) * (len(COUNTS) + len(MORE))
    words = text.encode().split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_BLANK):
            seen.add(line)
    chars = len(text) - sum(map(text.count, _BLANK))
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    return (
        len(words), chars, sum(map(text.count, _SYMBOLS)), dup, repeated_words(ids),
        int(raw[33]), int(raw[124]), int(raw[65:91].sum()), int((ids[1:] == ids[:-1]).sum()),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``(doc_id, stratum, counts..)``: a row for each input row."""

    def run(rows):
        for b in batches(rows, text=2):
            got = list(zip(*map(count, b.column(2).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in got)], ["doc_id", "stratum", *COUNTS, *MORE])

    kind = docs.schema[id_col].dataType.simpleString()
    cols = "".join(f", {c} bigint" for c in [*COUNTS, *MORE])
    return docs.select(F.col(id_col), F.col(stratum_col).cast("string"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, stratum string{cols}")


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed term by term; terms far under the mean, which add nothing, are left out."""
    if k >= n:
        return 1.0
    x = np.arange(max(0, k - int(60 * math.sqrt(n * p)) - 60), k + 1)
    lead = math.lgamma(n + 1) - math.lgamma(x[0] + 1) - math.lgamma(n - x[0] + 1) + x[0] * math.log(p) + (n - x[0]) * math.log1p(-p)
    steps = np.log(n - x[:-1]) - np.log(x[1:]) + math.log(p) - math.log1p(-p)
    terms = lead + np.concatenate([[0.0], np.cumsum(steps)])
    return min(1.0, float(np.exp(terms).sum()))


def most_lost(n: int, alpha: float, level: float) -> int:
    """The largest k with P(Binomial(n, alpha) <= k) <= level; -1 if there is none."""
    low, high = -1, int(n * alpha)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if binomial_cdf(mid, n, alpha) <= level else (low, mid - 1)
    return low


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: dict[str, float] | None = None, delta: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(level, stratum, rule, cutoff, alpha, n_good, n_lost, p_value)``: a row for each stratum and rule that has a certified
    cutoff, and for the pool (level "all", stratum null). ``n_lost`` counts the good documents beyond the cutoff, and
    ``p_value`` is of that count; where the cutoff is the rule's floor, both are of the floor."""
    alpha = alpha or ALPHA
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("_id"))
    known = stats.filter(~base_failed()).join(good, F.col("doc_id") == F.col("_id"))
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(F.expr(e) * STEPS).cast("int").alias("step")) for r, e in RULES.items()]))
    cells = stage(known.select("stratum", steps.alias("s")).groupBy("stratum", "s.rule", "s.step").agg(F.count(F.lit(1)).alias("n")), "rule-counts")
    pool = cells.groupBy(F.lit("all").alias("level"), F.lit(None).cast("string").alias("stratum"), "rule", "step").agg(F.sum("n").alias("n"))
    both = cells.select(F.lit("stratum").alias("level"), "stratum", "rule", "step", "n").unionByName(pool)
    tests = F.broadcast(cells.select("stratum").distinct().agg((F.count(F.lit(1)) + 1).alias("m")))  # one row
    by_rule = lambda d: F.element_at(F.create_map(*[F.lit(x) for r, v in d.items() for x in (r, float(v))]), F.col("rule"))
    group = Window.partitionBy("level", "stratum", "rule")  # STEPS + 1 rows at most
    beyond = group.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    counted = both.withColumns({"n_lost": F.coalesce(F.sum("n").over(beyond), F.lit(0)), "n_good": F.sum("n").over(group), "over_floor": F.coalesce(F.sum(F.when(F.col("step") > by_rule(FLOOR) * STEPS, F.col("n"))).over(group), F.lit(0))})

    @F.pandas_udf("long")
    def bound(n, a, m):
        import pandas as pd

        return pd.Series([most_lost(int(x), float(y), delta / (int(z) * len(RULES))) for x, y, z in zip(n, a, m)])

    @F.pandas_udf("double")
    def p_value(k, n, a):
        import pandas as pd

        return pd.Series([binomial_cdf(int(x), int(y), float(z)) for x, y, z in zip(k, n, a)])

    sizes = counted.select("level", "stratum", "rule", "n_good").distinct().crossJoin(tests).withColumn("alpha", by_rule(alpha))
    sizes = sizes.withColumn("k", bound("n_good", "alpha", "m")).filter("k >= 0").select(*[F.col(c).alias(f"_{c}") for c in ("level", "stratum", "rule", "alpha", "k")])
    same = (F.col("level") == F.col("_level")) & F.col("stratum").eqNullSafe(F.col("_stratum")) & (F.col("rule") == F.col("_rule"))
    sound = counted.join(sizes, same).filter("n_lost <= _k")
    best = sound.groupBy("level", "stratum", "rule", F.col("_alpha").alias("alpha"), "n_good").agg(F.min(F.struct("step", F.least("n_lost", "over_floor").alias("n_lost"))).alias("s"))
    out = best.select("level", "stratum", "rule", F.greatest(F.col("s.step") / STEPS, by_rule(FLOOR)).alias("cutoff"), "alpha", "n_good", F.col("s.n_lost").alias("n_lost"))
    return out.withColumn("p_value", p_value("n_lost", "n_good", "alpha"))


def apply_rules(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """``stats`` with base_failed, kept and bounds: each document by its stratum's cutoff, or the pool's where that has none.

    ``bounds`` says whose bound holds for the document, rule by rule: "stratum", or "all" (then the risk is limited for all
    strata together, not for this one); a rule without any cutoff isn't named and rejects nothing.
    """
    wide = lambda df, *by: df.groupBy(*by).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES])
    left, right = stats.alias("l"), wide(chosen.filter("level = 'stratum'"), "stratum").alias("r")
    pool = wide(chosen.filter("level = 'all'")).select(*[F.col(f"_{r}").alias(f"_all_{r}") for r in RULES])  # one row
    joined = left.join(right, F.col("l.stratum").eqNullSafe(F.col("r.stratum")), "left").crossJoin(F.broadcast(pool))
    cut = {r: F.coalesce(F.col(f"r._{r}"), F.col(f"_all_{r}")) for r in RULES}
    beyond = reduce(lambda a, b: a | b, [F.coalesce(F.ceil(F.expr(e) * STEPS) / STEPS > cut[r], F.lit(False)) for r, e in RULES.items()])
    whose = [F.when(F.col(f"r._{r}").isNotNull(), F.lit(f"{r}:stratum")).when(F.col(f"_all_{r}").isNotNull(), F.lit(f"{r}:all")) for r in RULES]
    return joined.select("l.*", base_failed().alias("base_failed"), (~base_failed() & ~beyond).alias("kept"), F.concat_ws(" ", *whose).alias("bounds"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    stats = stage(statistics(read(spark, sf_dir, "documents")), "rule-statistics")
    kept = apply_rules(stats, stage(cutoffs(stats, read(spark, sf_dir, "labels")), "cutoffs"))
    return kept.select("doc_id", *COUNTS, "base_failed", "kept", "bounds")
