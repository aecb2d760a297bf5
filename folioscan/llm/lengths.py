"""Exact histogram of encoded lengths, and what follows from it for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TOKENIZER, token_counts


def length_histogram(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per distinct encoded length of ``docs`` (doc_id, text): the length, its documents, and suffix sums.

    Columns: n_tokens, docs, tokens; docs_at_least and tokens_at_least (of this length or longer); truncated_tokens
    (what is left if texts are cut at this limit) and cut_tokens (what is lost); share_at_most (the part of all
    documents that fit the limit, hence every quantile).  Null and empty texts have length 0; repeated rows count as
    often as they occur; an empty table has no lengths.  Documents are summed per length in each task, so the
    shuffle carries a row per task and length, and the last window sees distinct lengths only.
    """
    counts = token_counts(docs, path).groupBy("n_tokens").agg(F.count("*").alias("docs"))
    down = Window.orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    rows = rows.withColumn("docs_at_least", F.sum("docs").over(down)).withColumn("tokens_at_least", F.sum("tokens").over(down))
    whole = Window.partitionBy()
    rows = rows.withColumn("all_docs", F.max("docs_at_least").over(whole)).withColumn("all_tokens", F.max("tokens_at_least").over(whole))
    kept = F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return rows.select(
        "n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least", kept.alias("truncated_tokens"), (F.col("all_tokens") - kept).alias("cut_tokens"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("share_at_most"),
    )


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each ``context_limit`` (long) of ``limits``: documents and tokens in all, documents that are cut, tokens kept.

    Between two lengths of the histogram nothing changes but the length at which longer texts are cut, so the sums of
    the next length answer any limit.
    """
    h = histogram.groupBy().agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias("suffix"))
    longer = F.filter("suffix", lambda s: s["n_tokens"] > F.col("context_limit"))
    x = limits.select("context_limit").join(h).withColumn("next", F.when(F.size(longer) > 0, F.element_at(longer, 1)))
    return x.select(
        "context_limit", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("next.docs_at_least", F.lit(0)).alias("docs_cut"),
        F.coalesce(F.col("tokens") - F.coalesce("next.tokens_at_least", F.lit(0)) + F.col("context_limit") * F.coalesce("next.docs_at_least", F.lit(0)), F.lit(0)).alias("tokens_kept"),
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row, n_tokens: the least length that at least the part ``q`` of all documents do not exceed (null if none)."""
    return histogram.where(F.col("share_at_most") >= q).agg(F.min("n_tokens").alias("n_tokens"))
