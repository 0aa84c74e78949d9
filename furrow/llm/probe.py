"""Documents ask a sharded index that is too large to broadcast.

Nothing is joined row by row. A slice of documents is kept whole as one row of a written
table, beside one question a shard: the distinct things of the slice that belong to the
shard. Questions meet their shard's part of the index by a shuffle on the shard, which
comes first in its group and answers them as they stream by; answers meet their slice
by a shuffle on the slice and are there before it. What is frequent in the documents is asked
once a slice, so shards are asked alike; each part of the index is copied once for every
DEAL_BYTES of questions to the most asked one, and questions are dealt over the copies, so
tasks grow with the documents. No task holds more than one part of the index or one slice
with its answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from furrow.llm.text import slices, texts, tidy
from furrow.session import materialise

SLICE_BYTES = 1 << 20
#: Bytes of questions that one copy of a part of the index answers: parts are a tenth of it or so, and so is what the copies add.
DEAL_BYTES = 128 << 20
_ROW = "unit string, shard long, part int, data binary"
_NAMES = ["unit", "shard", "part", "data"]
_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _stored(batch: pa.RecordBatch) -> bytes:
    sink = BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def probe(
    docs: DataFrame,
    text_at: int,
    index: DataFrame,
    ask: Callable[[list[bytes | None]], Iterable[tuple[int, bytes]]],
    load: Callable[[bytes], object],
    answer: Callable[[object, bytes], bytes | None],
    close: Callable[[pa.RecordBatch, list[bytes | None], list[bytes]], pa.RecordBatch],
    schema: T.StructType,
    deal_bytes: int = DEAL_BYTES,
) -> DataFrame:
    """Rows that close() makes of each slice of docs and the answers to its questions.

    index has one row a shard (shard long, data binary), which load() opens. ask() gives
    (shard, question) pairs for a slice's texts, one a shard at most.
    """
    arrow = to_arrow_schema(schema)

    def split(batches):
        for batch in batches:
            plain = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])
            for part in slices(plain, f"c{text_at}", SLICE_BYTES):
                unit = uuid.uuid4().hex
                yield _rows([(unit, -1, 1, _stored(part)), *((unit, shard, 1, question) for shard, question in ask(texts(part.column(text_at))))])

    def respond(batches):
        shard = opened = None
        for batch in batches:
            out = []
            for unit, at, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    shard, opened = at, load(data)
                elif at == shard and (said := answer(opened, data)) is not None:
                    out.append((unit, at, 0, said))
            yield _rows(out)

    def finish(batches):
        unit, said = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                at, part, data = (batch.column(c)[row].as_py() for c in ("unit", "part", "data"))
                if at != unit:
                    unit, said = at, []
                if part == 0:
                    said.append(data)
                else:
                    with pa.ipc.open_stream(data) as reader:
                        for held in reader:
                            yield close(held, texts(held.column(text_at)), said).cast(arrow)

    # units have names of their own per attempt, so they are written before they are read twice
    asked = materialise(docs.mapInArrow(tidy(split), _ROW), "questions")
    questions = asked.filter("shard >= 0")
    most = questions.groupBy("shard").agg(F.sum(F.length("data")).alias("n")).agg(F.max("n")).first()[0] or 0
    copies = max(1, -(-most // deal_bytes))
    parts = index.select(F.lit(None).cast("string").alias("unit"), F.col("shard").cast("long").alias("shard"), F.lit(0).alias("part"), "data", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    dealt = questions.withColumn("copy", F.pmod(F.xxhash64("unit"), F.lit(copies)).cast("int")).unionByName(parts)
    dealt = dealt.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "part").select(_NAMES)
    answers = dealt.mapInArrow(tidy(respond), _ROW)
    met = answers.unionByName(asked.filter("shard < 0")).repartition("unit").sortWithinPartitions("unit", "part")
    return met.mapInArrow(tidy(finish), schema)
