"""Word rules, digests and the Arrow-batch driver shared by the text operators.

Two word rules occur. ``alnum`` words: ASCII upper case folded, then runs of
digits, a-z and everything from U+0080 up. ``space`` words: runs of anything
but ASCII white space. On UTF-8 bytes both need only C-level bytes methods,
because every separator is a single ASCII byte.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
ALNUM = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEEP or 0x41 <= b <= 0x5A else 0x20 for b in range(256))

#: Bytes of text handled in one go inside a task; bounds the memory of a worker.
SLICE_BYTES = 4 << 20


def tidy(run: Callable) -> Callable:
    """A batch function that gives freed memory back to the system when a task ends.

    Workers live on and serve later stages; what the allocators would keep for them
    counts against the executor.
    """

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # only glibc has it
                pass

    return tidied


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]) -> object:
    """make()'s result, kept by the worker process for its next tasks.

    One at a time: what another operator left there is let go first, so that a worker
    that serves a chain of operators never holds the tables of more than one.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def alnum_words(data: bytes) -> list[bytes]:
    return data.translate(ALNUM).split()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes; null stays None."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about `limit` bytes of text, one row at least."""
    column, start, held = batch.column(text_col), 0, 0
    sizes = column.cast(pa.binary())
    lengths = pa.compute.binary_length(sizes).fill_null(0).to_pylist()
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if batch.num_rows - start:
        yield batch.slice(start)


def annotate(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[bytes | None]], Iterable[tuple]]],
) -> DataFrame:
    """(id, *fields) per row: `make()` runs once per task, its result once per slice of texts.

    Only the id and text columns are read, so further columns of docs, whatever
    their names, cannot clash with the new ones.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for part in slices(batch, "text"):
                columns = list(zip(*score(texts(part.column("text"))), strict=True)) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(arrow.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow
                )

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), schema)


def rewrite(
    docs: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[list[bytes | None]], list]],
    keep_rows: bool,
) -> DataFrame:
    """docs with all its columns: rows filtered by a list of booleans (keep_rows), or text replaced.

    `make()` gives a function from texts to booleans, or to new texts (None: null).
    """
    where = docs.columns.index(text_col)
    schema = docs.schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = make()
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            plain = pa.RecordBatch.from_arrays(batch.columns, names=names)
            for part in slices(plain, names[where]):
                out = decide(texts(part.column(where)))
                columns = part.columns
                if keep_rows:
                    columns = [c.filter(pa.array(out, pa.bool_())) for c in columns]
                else:
                    columns[where] = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(tidy(run), schema)
