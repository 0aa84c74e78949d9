"""Line dedup through sharded minimal perfect hashes.

Every document gives its distinct line keys as 128-bit hashes; Spark counts the
documents of each. Hashes found in two documents or more are dealt to shards, and each
shard becomes a minimal perfect hash (levels of bitmaps: a key takes the first level
where no other key meets its bit) over an array of 64-bit fingerprints and one of
counts. A line that is asked for and not there is in one document. Documents probe the
arrays: a line's slot comes from its first 64 bits, the fingerprint is its other 64
bits, so a probe is decided by 128 bits and lines are never joined. The count at the
slot is compared with `min_docs` on probing: one index serves any threshold.

The arrays are broadcast if they are within MAX_INDEX_BYTES, which is checked on
their number of lines first and which their real size follows. Beyond it the same
arrays stay where they are and the lines' hashes come to their shards in packs, one a
slice of documents (see probe). Both ways give the same rows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from furrow.llm.probe import probe
from furrow.llm.text import sha256_hex, slices, texts, tidy
from furrow.session import materialise

MIN_DOCS = 10
MAX_INDEX_BYTES = 64 << 20
KEYS_PER_SHARD = 1 << 17
#: A fingerprint, a count, and the bits of the perfect hash.
BYTES_PER_LINE = 14
#: Counts are held as 32-bit numbers; more documents than this count as this many.
MOST = 2**31 - 1


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z in lower case."""
    return line.strip().lower()


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, different for each seed."""
    h = h ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bitmaps and the rank before each level's words."""

    levels: list[tuple[np.ndarray, np.ndarray]]  # packed bits as uint64, cumulative ones before each word

    @staticmethod
    def build(keys: np.ndarray, gamma: float = 2.0) -> "PerfectHash":
        levels, left, seen, seed = [], keys, 0, 0
        while len(left):
            if seed == 200:
                raise ValueError("two different lines share the first half of a 128-bit hash")
            words = max(1, int(np.ceil(gamma * len(left) / 64)))
            spot = (mix(left, seed) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(spot, minlength=words * 64) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(bits).astype(np.int64)
            levels.append((bits, seen + np.concatenate(([0], np.cumsum(ones)[:-1]))))
            seen += int(ones.sum())
            left, seed = left[~alone[spot]], seed + 1
        return PerfectHash(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """0 .. n-1 for the n keys it was built on, each once; any slot or -1 for others."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for seed, (bits, ranks) in enumerate(self.levels):
            if not len(left):
                break
            spot = mix(keys[left], seed) % np.uint64(len(bits) * 64)
            word, bit = (spot >> np.uint64(6)).astype(np.int64), spot & np.uint64(63)
            here = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = (ranks[word] + np.bitwise_count(below))[here]
            left = left[~here]
        return out


@dataclass
class Shard:
    """Perfect hash, fingerprints and counts; apart (high, low, n) the lines whose first half another line has."""

    perfect: PerfectHash
    prints: np.ndarray
    numbers: np.ndarray
    twins: list[tuple[int, int, int]]

    @staticmethod
    def build(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> "Shard":
        _, first = np.unique(high, return_index=True)
        rest = np.setdiff1d(np.arange(len(high)), first)
        perfect = PerfectHash.build(high[first])
        slot = perfect.slots(high[first])
        prints, numbers = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int32)
        prints[slot], numbers[slot] = low[first], np.minimum(n[first], MOST)
        return Shard(perfect, prints, numbers, [(int(high[i]), int(low[i]), min(int(n[i]), MOST)) for i in rest])

    def counts(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Documents of each line hash; 1 if it isn't indexed."""
        out = np.ones(len(high), np.int64)
        slot = self.perfect.slots(high)
        good = np.flatnonzero(slot >= 0)
        good = good[self.prints[slot[good]] == low[good]]
        out[good] = self.numbers[slot[good]]
        for a, b, n in self.twins:
            out[(high == np.uint64(a)) & (low == np.uint64(b))] = n
        return out

    def dumps(self) -> bytes:
        return pickle.dumps(([b.tobytes() for b, _ in self.perfect.levels], self.prints.tobytes(), self.numbers.tobytes(), self.twins))

    @staticmethod
    def loads(data: bytes) -> "Shard":
        levels, prints, numbers, twins = pickle.loads(data)
        out, seen = [], 0
        for raw in levels:
            bits = np.frombuffer(raw, np.uint64)
            ones = np.bitwise_count(bits).astype(np.int64)
            out.append((bits, seen + np.concatenate(([0], np.cumsum(ones)[:-1]))))
            seen += int(ones.sum())
        return Shard(PerfectHash(out), np.frombuffer(prints, np.uint64), np.frombuffer(numbers, np.int32), twins)


@dataclass
class LineIndex:
    """All shards; a key's shard comes from its fingerprint half."""

    shards: list[Shard | None]

    def counts(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Documents of each line hash; 1 if it isn't indexed."""
        out = np.ones(len(high), np.int64)
        shard = (low % np.uint64(len(self.shards))).astype(np.int64)
        for k in np.unique(shard).tolist():
            if self.shards[k] is not None:
                at = np.flatnonzero(shard == k)
                out[at] = self.shards[k].counts(high[at], low[at])
        return out


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """(high, low, n): 128-bit hashes of line keys and the number of documents with each, where there are two or more."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found: dict[bytes, int] = {}
                for t in texts(part.column("text")):
                    for key in {line_key(x) for x in (t or b"").split(b"\n")}:
                        found[key] = found.get(key, 0) + 1
                found.pop(b"", None)
                both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), ">u8").reshape(-1, 2).astype(np.uint64)
                yield pa.RecordBatch.from_pydict({"high": both[:, 0].view(np.int64), "low": both[:, 1].view(np.int64), "n": np.fromiter(found.values(), np.int64, len(found))})

    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), "high long, low long, n long")
    return rows.groupBy("high", "low").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)


def _pack(table: pa.Table) -> pa.Table:
    high, low = (table.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
    data = Shard.build(high, low, table.column("n").to_numpy()).dumps()
    return pa.table({"shard": table.column("shard")[:1], "data": pa.array([data], pa.binary())})


def _shards(counted: DataFrame) -> tuple[DataFrame, int, int]:
    """One row (shard, data) a shard of a materialised (high, low, n) table; the number of shards, and of lines."""
    total = counted.count()
    n = max(1, -(-total // KEYS_PER_SHARD))
    # the unsigned value of low, modulo n, as the probe has it
    half = F.shiftrightunsigned("low", 1)
    shard = F.pmod(F.pmod(half, F.lit(n)) * 2 + F.col("low").bitwiseAND(F.lit(1)), F.lit(n)).cast("long")
    packed = counted.select(shard.alias("shard"), "high", "low", "n").groupBy("shard").applyInArrow(_pack, "shard long, data binary")
    return materialise(packed, "shards"), n, total


def _rewritten(docs: DataFrame, min_docs: int, limit: int, text_col: str, close, schema: T.StructType) -> DataFrame:
    """Rows that close(batch, text lines with what goes) makes of docs, by either way."""
    arrow, where = to_arrow_schema(schema), docs.columns.index(text_col)
    index, n, total = _shards(materialise(_counted(docs, text_col), "lines"))
    if BYTES_PER_LINE * total > limit:
        return probe(docs, where, index, lambda batch: _questions(batch, n), Shard.loads, lambda shard, question: _answer(shard, question, min_docs), lambda part, batch, said: close(part, _told(batch, said, min_docs)), schema)
    shards: list = [None] * n
    for r in index.collect():
        shards[r["shard"]] = Shard.loads(bytes(r["data"]))
    shared = docs.sparkSession.sparkContext.broadcast(LineIndex(shards))

    def run(batches):
        found = shared.value
        for batch in batches:
            plain = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])
            for part in slices(plain, f"c{where}"):
                yield close(part, _drops(texts(part.column(where)), found, min_docs)).cast(arrow)

    return docs.mapInArrow(tidy(run), schema)


def _hashes(batch: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Each text's lines; the 128-bit hashes of all their keys, and which keys are not empty."""
    split = [(t or b"").split(b"\n") for t in batch]
    keys = [line_key(x) for lines in split for x in lines]
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)
    return split, both, np.fromiter(map(bool, keys), bool, len(keys))


def _per_text(split: list[list[bytes]], gone: np.ndarray) -> list[tuple[list[bytes], np.ndarray]]:
    ends = np.cumsum([len(x) for x in split])
    return [(lines, gone[end - len(lines) : end]) for lines, end in zip(split, ends, strict=True)]


def _questions(batch: list[bytes | None], n: int) -> list[tuple[int, bytes]]:
    """Per shard the distinct line hashes of a slice."""
    _, both, filled = _hashes(batch)
    both = np.unique(both[filled], axis=0)
    shard = (both[:, 1] % np.uint64(n)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return [(int(shard[part[0]]), both[part].tobytes()) for part in np.split(order, cuts[1:]) if len(part)]


def _answer(shard: Shard, question: bytes, min_docs: int) -> bytes | None:
    """Those of the asked hashes that are in min_docs documents."""
    both = np.frombuffer(question, np.uint64).reshape(-1, 2)
    frequent = shard.counts(both[:, 0], both[:, 1]) >= min_docs
    return both[frequent].tobytes() if frequent.any() else None


def _told(batch: list[bytes | None], said: list[bytes], min_docs: int) -> list[tuple[list[bytes], np.ndarray]]:
    """Each text's lines and which of them go, by the answers; a line that no shard was asked for is in one document."""
    split, both, filled = _hashes(batch)
    frequent = {x[i : i + 16] for x in said for i in range(0, len(x), 16)}
    data = both.tobytes()
    gone = np.fromiter((data[i : i + 16] in frequent for i in range(0, len(data), 16)), bool, len(both)) & filled
    return _per_text(split, gone if min_docs > 1 else filled)


def _drops(batch: list[bytes | None], index: LineIndex, min_docs: int) -> list[tuple[list[bytes], np.ndarray]]:
    """Each text's lines and which of them go, by the count at their slot."""
    split, both, filled = _hashes(batch)
    return _per_text(split, (index.counts(both[:, 0], both[:, 1]) >= min_docs) & filled)


def _row(lines: list[bytes], gone: np.ndarray) -> tuple[int, int, bytes]:
    n = int(gone.sum())
    return len(lines), n, b"\n".join(x for x, g in zip(lines, gone.tolist()) if not g) if n else b"\n".join(lines)


_FIELDS = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def line_digests(docs: DataFrame, min_docs: int = MIN_DOCS, max_index_bytes: int = MAX_INDEX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_sha256) of every whole text.

    A line whose key is not empty and occurs in at least min_docs documents (rows)
    goes, in every document; with min_docs of 1 or less all such lines do. Null and empty texts are one empty line, which stays. A
    repeated row counts as one more document. Very long texts and lines are handled
    whole. Only the id and the text are read, so no other column's name can clash.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *_FIELDS])

    def close(part: pa.RecordBatch, judged: list) -> pa.RecordBatch:
        rows = [_row(lines, gone) for lines, gone in judged]
        columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([sha256_hex(r[2]) for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return _rewritten(chosen, min_docs, max_index_bytes, "text", close, schema)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_index_bytes: int = MAX_INDEX_BYTES, text_col: str = "text") -> DataFrame:
    """docs with all columns, whatever their names, frequent lines removed from the text; a null text stays null."""
    names, where = docs.columns, docs.columns.index(text_col)

    def close(part: pa.RecordBatch, judged: list) -> pa.RecordBatch:
        columns = part.columns
        kept = [None if null else _row(lines, gone)[2] for null, (lines, gone) in zip(columns[where].is_null().to_pylist(), judged, strict=True)]
        columns[where] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    return _rewritten(docs, min_docs, max_index_bytes, text_col, close, docs.schema)
