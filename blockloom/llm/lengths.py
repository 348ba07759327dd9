"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import by_id
from blockloom.llm.tokens import encoder, rows
from blockloom.storage import few, written

_BUCKET = 64


def histogram(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_tokens, n_docs``: how many rows of ``docs`` encode to each length.

    Each task counts its rows before the shuffle, so what is shuffled is a few
    thousand pairs however many copies or hot sources there are.  A null text
    has length 0, as an empty one; a text of any length is encoded whole; rows
    that repeat, and documents of one length, count as often as they stand;
    an empty table has no rows.  Only the text is read, so extra columns may have any name.
    """

    def count(batches):
        enc, size, seen = encoder(tokenizer), encoder(tokenizer).dtype.itemsize, Counter()
        for (text,) in rows(batches, "text"):
            seen[len(enc.encode(text)) // size] += 1
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(seen.keys(), pa.int64()), "n": pa.array(seen.values(), pa.int64())})

    found = by_id(docs, id_col, text_col).select("text").mapInArrow(count, "n_tokens long, n long")
    return found.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length: documents and tokens of that length or more, and the corpus cut there.

    ``truncated_total`` is the sum of min(length, n_tokens) over all documents;
    between two rows it is linear with slope ``docs_at_least`` of the upper one.
    ``quantile`` is the share of documents no longer than the row.  The histogram is
    read twice, so it is written first (a row a length; texts are encoded once).  Sums run in
    buckets of 64 lengths first, so no task orders the whole histogram.
    """
    inner = written(hist, "lengths", few(0)).withColumn("bucket", F.floor(F.col("n_tokens") / _BUCKET))
    tokens = F.col("n_docs") * F.col("n_tokens")
    per = inner.groupBy("bucket").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("toks"))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = per.select("bucket", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_above") for c in ("docs", "toks")), *(F.sum(c).over(every).alias(f"all_{c}") for c in ("docs", "toks")))
    here = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs_ge = F.sum("n_docs").over(here) + F.col("docs_above")
    toks_ge = F.sum(tokens).over(here) + F.col("toks_above")
    return (
        inner.join(above, "bucket")
        .select("n_tokens", "n_docs", docs_ge.alias("docs_at_least"), toks_ge.alias("tokens_at_least"), "all_docs", "all_toks")
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("all_toks") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
            ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
        )
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for a context limit: tokens that fit, tokens cut off, documents cut.

    An empty corpus gives zeros.
    """
    def longer(c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("n_tokens") > limit, F.col(c))), F.lit(0))

    total = F.coalesce(F.max("tokens_at_least"), F.lit(0))
    kept = total - longer("tokens_at_least") + longer("docs_at_least") * limit
    return sums.agg(kept.cast("long").alias("kept_tokens"), (total - kept).cast("long").alias("cut_tokens"), longer("docs_at_least").alias("cut_docs"))


def quantile_length(sums: DataFrame, q: float) -> DataFrame:
    """The least length that a share ``q`` of the documents does not exceed; null for an empty corpus."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
