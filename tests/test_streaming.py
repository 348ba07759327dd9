import numpy as np
from pyspark.sql import functions as F

from blockloom.functions.params import LUMA
from blockloom.operators import coding
from blockloom.operators.preprocess import level_shift
from blockloom.operators.quantize import literal_table, quantize
from blockloom.operators.transform import dct2
from blockloom.streaming.blocks import encode_stream

SCHEMA = "image_id string, channel string, h int, w int, br int, bc int, px array<float>"


def test_stream_equals_table(spark, tmp_path):
    x = np.random.default_rng(0).integers(0, 256, (12, 64)).astype(float)
    rows = [("i", "gray", 8, 96, 0, i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, SCHEMA)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = encode_stream(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), LUMA)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = dct2(level_shift(table)).withColumn("qf", quantize(F.col("f"), literal_table(LUMA)))
    want = {r.bc: (r.qf, r.ac_symbols) for r in coding.encode_blocks(batch).collect()}
    got = {r.bc: (r.qf, r.ac_symbols) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
