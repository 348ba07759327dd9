"""Tables read as pixel planes, blocks and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAY_WIDTH, COLOR_WIDTH = 100, 45


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: str, width: int) -> dict[str, Column]:
    """Row and column of a key that counts pixels in raster order."""
    return {"r": F.floor(F.col(key) / width).cast("int"), "c": (F.col(key) % width).cast("int")}


def gray_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noisy gray plane, 100 wide, one pixel an order."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    size = o.agg((F.floor(F.max("o_orderkey") / GRAY_WIDTH) + 1).cast("int").alias("h"))
    at = place("o_orderkey", GRAY_WIDTH)
    v = (F.floor("o_totalprice").cast("long") % 256).cast("float")
    return o.crossJoin(F.broadcast(size)).select(F.lit("orders").alias("image_id"), F.lit("gray").alias("channel"), at["r"].alias("r"), at["c"].alias("c"), v.alias("v"), "h", F.lit(GRAY_WIDTH).alias("w"))


def rgb_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A colour plane, 45 wide, one pixel a part; the last part fills up an unfinished last row."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    size = p.agg(F.max("p_partkey").alias("last")).withColumn("h", (F.floor(F.col("last") / COLOR_WIDTH) + 1).cast("int"))
    at = place("p_partkey", COLOR_WIDTH)
    colors = {"red": (F.floor("p_retailprice").cast("int") - 900) * 2, "green": F.col("p_size").cast("int") * 5, "blue": (F.col("p_partkey") % 256).cast("int")}
    fills = F.sequence(at["c"], F.when(F.col("p_partkey") == F.col("last"), COLOR_WIDTH - 1).otherwise(at["c"]))
    one = p.crossJoin(F.broadcast(size)).withColumn("c", F.explode(fills))
    return one.select(F.lit("part").alias("image_id"), at["r"].alias("r"), "c", *(v.alias(k) for k, v in colors.items()), "h", F.lit(COLOR_WIDTH).alias("w"))


def embedding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-vector as a block of whole numbers from 0 to 255; its id is the block row."""
    e = _read(spark, sf_dir, "embeddings")
    px = F.transform("embedding", lambda x: F.least(F.greatest(F.rint(F.lit(128.0) + 255.0 * x.cast("double")), F.lit(0.0)), F.lit(255.0)).cast("float"))
    return e.select(F.lit("embeddings").alias("image_id"), F.lit("gray").alias("channel"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("vec_id").cast("int").alias("br"), F.lit(0).alias("bc"), px.alias("px"))


def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segment, n, value``: events in runs of eight."""
    e = _read(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 8).alias("segment"), (F.col("event_id") % 8).cast("int").alias("n"), F.col("value").cast("double").alias("value"))
