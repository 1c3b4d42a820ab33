"""Token counts from an exact length histogram.

Documents are counted by encoded length; the histogram (one row for each length that occurs) then answers, for every
context limit, how many documents and tokens there are, what truncation at the limit keeps, and which quantile the
limit is. Suffix sums run in two levels (blocks of lengths, then within a block), so no task sees all lengths.

Edge cases: a null or empty text has length 0 and is counted; an empty table gives no rows; repeated documents count
each time; null groups form a group of their own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import load_ranks
from .common import batches, read

_ENC: dict = {}


def _encoding(ranks_path: str, pattern: str):
    import tiktoken

    if (key := (ranks_path, pattern)) not in _ENC:
        _ENC[key] = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
    return _ENC[key]


def lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", by: list[str] | None = None) -> DataFrame:
    """``(*by, n_tokens long)``, a row for each document; no special tokens."""
    by = by or []

    def run(rows):
        enc = _encoding(ranks_path, pattern)
        for b in batches(rows, text=len(by)):
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(by)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(by)], pa.array(n, pa.int64())], [*by, "n_tokens"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in by)
    return docs.select(*map(F.col, by), F.col(text_col)).mapInArrow(run, f"{kinds}n_tokens bigint")


def length_table(lengths: DataFrame, by: list[str] | None = None, block: int = 1024) -> DataFrame:
    """For each context limit that is some document's length:

    n_docs (documents of just this length), docs_over / tokens_over (those longer), docs_total / tokens_total,
    kept_tokens (the tokens left if every document is cut at the limit), lost_tokens, and quantile (share of documents
    of this length or shorter).
    """
    by = by or []
    hist = lengths.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("_b", F.floor(F.col("n_tokens") / block).cast("long"))
    blocks = hist.groupBy(*by, "_b").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_t"))
    later = Window.partitionBy(*by).orderBy(F.desc("_b"))
    after = later.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    blocks = blocks.select(
        *by, "_b",
        F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_da"), F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_ta"),
        F.sum("_d").over(whole).alias("docs_total"), F.sum("_t").over(whole).alias("tokens_total"),
    )
    left, right = hist.alias("l"), blocks.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_b"]]
    joined = left.join(right, on).select("l.*", "r._da", "r._ta", "r.docs_total", "r.tokens_total")
    inner = Window.partitionBy(*by, "_b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.select(
        *by, "n_tokens", "n_docs",
        (F.col("_da") + F.coalesce(F.sum("n_docs").over(inner), F.lit(0))).alias("docs_over"),
        (F.col("_ta") + F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inner), F.lit(0))).alias("tokens_over"),
        "docs_total", "tokens_total",
    )
    lost = F.col("tokens_over") - F.col("n_tokens") * F.col("docs_over")
    return out.withColumns({
        "kept_tokens": F.col("tokens_total") - lost,
        "lost_tokens": lost,
        "quantile": F.round((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total"), 9),
    })


def answer(table: DataFrame, limits: list[int], by: list[str] | None = None) -> DataFrame:
    """Totals for any stated limits: ``(*by, context_limit, docs_over, kept_tokens, lost_tokens)``.

    Taken from the suffix sums at the smallest length that is at least the limit; limits over the longest lose nothing.
    """
    by = by or []
    spark = table.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit bigint")
    at = table.join(F.broadcast(asked), F.col("n_tokens") >= F.col("context_limit"))
    at = at.groupBy(*by, "context_limit").agg(F.min_by(F.struct("n_docs", "docs_over", "tokens_over", "n_tokens"), "n_tokens").alias("s"))
    over = F.when(F.col("s.n_tokens") > F.col("context_limit"), F.col("s.n_docs") + F.col("s.docs_over")).otherwise(F.col("s.docs_over"))
    tokens = F.when(F.col("s.n_tokens") > F.col("context_limit"), F.col("s.tokens_over") + F.col("s.n_docs") * F.col("s.n_tokens")).otherwise(F.col("s.tokens_over"))
    totals = table.select(*by, "docs_total", "tokens_total").distinct()
    left, right = totals.crossJoin(F.broadcast(asked)).alias("l"), at.withColumns({"_o": over, "_t": tokens}).drop("s").alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "context_limit"]]
    o, t = F.coalesce(F.col("r._o"), F.lit(0)), F.coalesce(F.col("r._t"), F.lit(0))
    lost = t - o * F.col("l.context_limit")
    return left.join(right, on, "left").select(*[F.col(f"l.{c}").alias(c) for c in by], F.col("l.context_limit"), o.alias("docs_over"), (F.col("l.tokens_total") - lost).alias("kept_tokens"), lost.alias("lost_tokens"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    n = lengths(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, by=["lang"])
    return length_table(n, by=["lang"])
