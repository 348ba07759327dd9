"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import fresh, hash_pair
from blockloom.storage import drop, few, written

#: A line on more than this share of its host's pages is boilerplate.
RATIO = 0.1
#: An option: lines on fewer pages than this stay whatever their share.  By default the share decides alone.
MIN_PAGES = 1
#: Lines of boilerplate, of all hosts, up to which their 16-byte keys are broadcast; more are joined with a shuffle.
BROADCAST_LINES = 200_000
#: Hosts up to which their page totals are broadcast.
BROADCAST_HOSTS = 200_000
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, lines``: for each host the keys of its boilerplate lines.

    A page holds a line once however often it repeats there.  At most (mean lines
    a page) / ratio lines of a host can pass, so the array of a host is bounded.
    Counting is a partial aggregate on (host, line key): a hot host is spread by
    its lines, a hot line is summed before the shuffle.  Totals come to the counts, so only
    what passes is dealt by host.
    """
    p = pages.select(F.col(f"`{host_col}`").alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where(F.col("host").isNotNull())
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), lambda x: hash_pair(F.trim(x))))
    counts = p.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    totals = written(p.groupBy("host").agg(F.count(F.lit(1)).alias("total")), "totals", few(0))
    if totals.count() <= BROADCAST_HOSTS:
        joined = counts.join(F.broadcast(totals), "host")
    else:  # a hot host's lines are met in SALTS places
        salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = counts.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])
    return joined.where(F.col("n") > F.lit(float(ratio)) * F.col("total")).groupBy("host").agg(F.collect_list("key").alias("lines"))


def line_dedup(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with the boilerplate lines cut out of ``text_col``, all rows and columns kept.

    Lines are what stands between line feeds, compared without blanks at either
    end; blank lines stay.  A line on just ``ratio`` of the pages stays, on more goes; with
    the share alone, a host of fewer than 1 / ratio pages loses every line, and
    ``min_pages`` of 2 keeps what is on one page only.  A null text stays null, an empty one empty.  Rows
    with a null host are never judged.  A page that loses every line keeps its
    row with an empty text, and texts of any length are read whole.  An empty table gives no rows.  Repeated rows count as pages of their own.
    ``counts`` names two more columns: lines before, and lines cut out.  Extra
    columns may have any name; ours give way.  Lines are compared by a 128-bit key.
    """
    spark = docs.sparkSession
    bad = written(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    listed_in_all = bad.agg(F.sum(F.size("lines"))).first()[0] or 0
    host, lines, salt = fresh(docs.columns, "bl_host", "bl_lines", "bl_salt")
    listed = bad.select(F.col("host").alias(host), F.col("lines").alias(lines))
    if listed_in_all == 0:
        joined = docs.withColumn(lines, F.lit(None).cast(bad.schema["lines"].dataType))
        drop(bad)
    elif listed_in_all <= broadcast_lines:
        joined = docs.join(F.broadcast(listed), F.col(f"`{host_col}`") == F.col(host), "left").drop(host)
    else:
        salted = listed.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn(salt + "_", F.pmod(F.xxhash64(f"`{text_col}`"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, (F.col(f"`{host_col}`") == F.col(host)) & (F.col(salt + "_") == F.col(salt)), "left").drop(host, salt, salt + "_")
    all_lines, listed_lines = _lines(F.col(f"`{text_col}`")), F.col(lines)
    kept = F.filter(all_lines, lambda x: ~F.array_contains(listed_lines, hash_pair(F.trim(x))))
    text = F.when(listed_lines.isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, "\n"))
    out = {text_col: text}
    if counts:
        out[counts[0]] = F.coalesce(F.size(all_lines), F.lit(0)).cast("long")
        out[counts[1]] = F.coalesce(F.when(listed_lines.isNull(), 0).otherwise(F.size(all_lines) - F.size(kept)), F.lit(0)).cast("long")
    return joined.withColumns(out).drop(lines)
