"""From raw documents to packed training windows, in five written stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import decontaminate, line_dedup, minhash, packing, quality
from blockloom.llm.common import fresh
from blockloom.storage import new_path, remove

#: Pieces of text that a worker remembers while it packs.
CACHE = 150_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more (a tie stays).

    It learns from the table's labels, at most ``quality.SAMPLE`` rows of each
    class outside the held-out fold.  A null or empty text has the score of no evidence, a
    long one is scored whole, equal texts have equal scores; a null id is no matter.  An
    empty table gives no rows.  Extra columns stay, whatever their names.
    """
    return quality.quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines on more than a tenth of their source's; ``n_chars`` follows the text.

    A line on one document alone repeats nothing and stays, else sources of fewer
    than ten documents would lose all they have; a share of just a tenth stays too.  Null texts
    stay null, with a null ``n_chars``; documents without a source are not judged; repeated rows
    count each.  Texts of any length are read whole.  An empty table gives no rows.  Extra columns
    stay, whatever their names.
    """
    cut = line_dedup.line_dedup(docs, host_col="source", min_pages=2)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates (five-word shingles, similarity 0.8).

    Null and empty texts, and rows without id, are near nothing and stay.  Rows that share an
    id are one document: they stay or go together.  Long texts are compared whole.
    An empty table gives no rows.  Extra columns stay, whatever their names.
    """
    gone = minhash.near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return without(docs, gone)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    Null and empty texts leak nothing and stay, as do rows without id.  Rows that share an id
    go together; repeated rows go or stay alike.  Long texts are searched whole.  No items, or an
    empty table, take nothing away.  Extra columns stay, whatever their names.
    """
    leaked = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return without(docs, leaked)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the rows of some ids, under a name that no column has."""
    (name,) = fresh(docs.columns, "bl_gone")
    gone = gone.select(F.col("doc_id").alias(name))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4,096 ids, with the ids.

    A null or empty text is the end id alone, a text of any length is cut as need be; null
    ids stay null; repeated rows are packed as often as they stand, and equal rows may
    stand in any order.  An empty table gives no rows.  Other columns are not read.
    Workers still hold memory of the stages before, so they remember fewer pieces.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, cache=CACHE)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier, near dedup, decontamination and tokens are beyond SQL; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is written to the shared folder and read again as the next one's input.

    A stage's table goes as soon as the next one's is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(before)
        docs, before = spark.read.parquet(path), path
    return docs
