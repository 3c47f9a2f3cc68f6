from tensorloom.sources.tensor import TensorRel
from tensorloom.streaming.contraction import contract_stream


def test_stream_against_batch(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 2), (0, 1, 3), (1, 0, 5), (0, 1, 1)], "d0 bigint, d1 bigint, v bigint")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    b = TensorRel.from_data(spark, [1, 2, 3, 4], [2, 2], "i64")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = contract_stream(stream, "ij,jk->ik", [b], {"i": 2, "j": 2})
    q = out.writeStream.outputMode("complete").format("memory").queryName("contracted").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.d0, r.d1): r.v for r in spark.table("contracted").collect()}
    assert got == {(0, 0): 2 * 1 + 4 * 2, (0, 1): 2 * 3 + 4 * 4, (1, 0): 5, (1, 1): 15}
