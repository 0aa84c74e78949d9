"""The sharded probe deals the questions to one shard over copies of it."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm import probe


def test_one_shard_is_answered_by_several_tasks(spark):
    docs = spark.range(50).select("id", F.repeat(F.lit("word "), 230_000).alias("text")).repartition(4)
    index = spark.createDataFrame([(7, bytearray(b"part"))], "shard long, data binary")

    def answer(opened, question):
        from pyspark import TaskContext

        return opened + question + b":%d" % TaskContext.get().partitionId()

    def close(batch, texts, said):
        return pa.RecordBatch.from_pydict({"id": batch.column(0), "said": [b"".join(said).decode()] * batch.num_rows})

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("said", T.StringType())])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tasks = {}
        for deal in (1 << 20, 20):
            got = probe.probe(docs, 1, index, lambda texts: [(7, b"?%d" % len(texts))], bytes, answer, close, schema, deal_bytes=deal).collect()
            assert sorted(r.id for r in got) == list(range(50)) and all(r.said.startswith("part?1:") for r in got)
            tasks[deal] = len({r.said for r in got})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tasks[1 << 20] == 1 and tasks[20] > 2
