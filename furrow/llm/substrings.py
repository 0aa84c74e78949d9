"""Substring dedup: repeated windows of 20 words, by compressed FM-indexes of content shards.

A window's minimiser is the least hash of the word runs inside it. Consecutive windows
with one minimiser form a segment, and a segment goes to the shard of its minimiser:
equal windows have equal minimisers, so all occurrences of a window meet in one shard,
and a shard's work grows with its own text only, not with the corpus times the shards.
Tasks collapse segments that repeat inside the task before the shuffle, report what repeats
among their places by an index of those segments, and ship each once in compressed packs.

A first pass over the documents marks minimisers in a bitmap of 2 ** FILTER_BITS cells
(32 MB whatever the corpus) that at least two segments share; a segment alone in its
cell repeats nowhere and isn't shipped. The bitmap only saves shuffle: on a corpus that
fills it, more segments travel, and the result is the same.

In a shard, segments whose minimiser is unique are done. The others' different word
sequences are indexed (BWT in a wavelet matrix) and streamed through backward search, each
once whatever its number of places. Matching statistics that reach the window length give an
interval for every window, and equal intervals are equal windows: of the places of an
interval the earliest stays, all others are repeats. No repeat is reported in another way.

A minimiser with a great share of all segments (a passage in a third of the documents)
would fill one shard: such minimisers are found on a sample, at most HOT_PER_SHARD per
shard by their share, and their windows go one by one to shards of their own hashes.
The sample steers placement only; results don't depend on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.fmindex import FMIndex
from furrow.llm.hashing import Words
from furrow.llm.text import sha256_hex, slices, texts, tidy
from furrow.session import materialise

WINDOW = 20
RUN = 5
SLICE = 1 << 20
PACK_BYTES = 12 << 20
#: Repeated windows after which a task reports them.
REPEATS = 1_000_000
#: Bytes of documents for each shard: a shard's segments are at most a few times as much.
SHARD_BYTES = 4 << 20
HOT_PER_SHARD = 8
SAMPLE = 32
FILTER_BITS = 28
_NULL_ID = -(2**63)


def window_minima(runs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least of each `width` consecutive hashes, and whether it occurs more than once there."""
    low, many, have = runs, np.zeros(len(runs), bool), 1
    while have < width:
        step = min(have, width - have)
        if step != have:  # overlapping halves: count ties apart
            a, b = low[: len(low) - step], low[step:]
            low, many, have = np.minimum(a, b), np.ones(len(a), bool), have + step
            continue
        a, b, ma, mb = low[: max(0, len(low) - step)], low[step:], many[: max(0, len(low) - step)], many[step:]
        low, many, have = np.minimum(a, b), np.where(a < b, ma, np.where(b < a, mb, True)), have + step
    return low, many


class Segments:
    """The segments of some texts: minimiser, text number, first word in its text, windows, content."""

    def __init__(self, batch: list[bytes], window: int, run: int):
        words = Words(batch, spelled=True, n_lanes=1)
        self.words, self.window = words, window
        n = words.lanes.shape[1]
        low, many = window_minima(words.windows(run), window - run + 1) if n >= window else (np.zeros(0, np.uint64), np.zeros(0, bool))
        valid = np.zeros(len(low) + 1, bool)
        text_of = np.repeat(np.arange(len(batch)), np.diff(words.bounds))
        if len(low):
            valid[:-1] = text_of[: len(low)] == text_of[window - 1 :]
        new = valid[:-1] & np.concatenate(([True], ~valid[:-2] | (low[1:] != low[:-1]))) if len(low) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        self.count = np.bincount(group[valid[:-1]], minlength=len(self.first)).astype(np.int64) if len(self.first) else np.zeros(0, np.int64)
        self.minimiser = low[self.first]
        self.text = text_of[self.first]
        self.start = self.first - words.bounds[self.text]
        #: a window of it may occur in it twice
        ties = np.bincount(group[valid[:-1] & many], minlength=len(self.first)) > 0 if len(self.first) else np.zeros(0, bool)
        self.loops = ties | (self.count > window - run + 1)

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("first", "count", "minimiser", "text", "start", "loops"):
            setattr(self, name, getattr(self, name)[chosen])

    def contents(self) -> list[bytes]:
        data, a, b = self.words.data, self.words.starts, self.words.ends
        return [data[x:y] for x, y in zip(a[self.first].tolist(), b[self.first + self.count + self.window - 2].tolist(), strict=True)]


def _pack(rows: list[tuple]) -> bytes:
    """Segments (id, tie, start, windows, minimiser, loops, content) as one compressed block."""
    ids, ties, starts, counts, lows, loops, contents = zip(*rows, strict=True)
    arrays = [
        np.diff(np.array(ids, np.int64), prepend=np.int64(0)),
        np.array(ties, np.int64),
        np.array(starts, np.int32),
        np.array(counts, np.int32),
        np.array(lows, np.uint64).astype(np.uint32),
        np.array(loops, np.uint8),
    ]
    body = np.int64(len(rows)).tobytes() + b"".join(x.tobytes() for x in arrays) + b"\n".join(contents)
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpack(block: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    body = zstandard.ZstdDecompressor().decompress(block)
    n, at, arrays = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for kind in (np.int64, np.int64, np.int32, np.int32, np.uint32, np.uint8):
        arrays.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    arrays[0] = np.cumsum(arrays[0])
    return arrays, body[at:].split(b"\n")


def _windows_of(content: bytes, window: int) -> list[bytes]:
    words = content.split(b" ")
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def _shared_cells(rows: DataFrame, window: int, run: int) -> bytes:
    """Bitmap of cells (the top FILTER_BITS of a minimiser) with two segments or more."""
    block = 1 << 16

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                low = Segments(texts(part.column("text")), window, run).minimiser
                cell, n = np.unique((low >> np.uint64(64 - FILTER_BITS)).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.minimum(n, 2).astype(np.int32))], names=["cell", "n"])

    def fold(table: pa.Table) -> pa.Table:
        bits = np.zeros(block, bool)
        bits[table.column("cell").to_numpy() % block] = True
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    counted = rows.select("text").mapInArrow(tidy(work), "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
    blocks = counted.select(F.shiftright("cell", 16).alias("block"), "cell").groupBy("block").applyInArrow(fold, "block int, bits binary")
    out = np.zeros((1 << FILTER_BITS) // block * (block // 8), np.uint8).reshape(-1, block // 8)
    for r in blocks.collect():  # at most 2 ** (FILTER_BITS - 16) rows of 8 KB
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _emit(rows: DataFrame, window: int, run: int, shards: int, hot, cells) -> DataFrame:
    """(shard, kind, pack): packs of segments for shards (kind 0), and repeats that a task finds itself (kind 1)."""

    def work(batches):
        hot_set = np.sort(np.array(hot.value, np.uint64))
        shared = np.frombuffer(cells.value, np.uint8)
        held: dict[bytes, tuple] = {}
        others: dict[bytes, list[tuple]] = {}  # later places of a sequence that is held
        size = again = 0

        def add(key: tuple, count: int, low: int, loops: int, content: bytes) -> tuple[int, int]:
            """Bytes and repeated windows that a segment adds."""
            other = held.get(content)
            if other is None:
                held[content] = (key, count, low, loops)
                return len(content), 0
            if key == other[0]:
                return 0, 0
            if key < other[0]:
                held[content] = (key, count, low, loops)
                key = other[0]
            others.setdefault(content, []).append(key)
            return 0, count

        def flush():
            by: dict[int, list] = {}
            for content, (key, count, low, loops) in held.items():
                by.setdefault(low % shards, []).append((*key, count, low // shards, loops, content))
            out = [(s, 0, _pack(part)) for s, part in by.items()]
            if others:
                places = [(i, *key) for i, content in enumerate(others) for key in (held[content][0], *others[content])]
                of, ids, ties, starts = (np.array(c, np.int64) for c in zip(*places, strict=True))
                found = indexed_repeats(list(others), of, ids, ties, starts, window)
                out.append((int(ids[0]) % shards, 1, zstandard.ZstdCompressor(level=3).compress(np.int64(len(found[0])).tobytes() + b"".join(c.tobytes() for c in found))))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=["shard", "kind", "pack"])
            held.clear()
            others.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = Segments(texts(part.column("text")), window, run)
                ids, ties = part.column("id").to_pylist(), part.column("tie").to_pylist()
                cell = (found.minimiser >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                found.keep(((shared[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1) | found.loops)
                at = np.minimum(np.searchsorted(hot_set, found.minimiser), max(0, len(hot_set) - 1))
                is_hot = hot_set[at] == found.minimiser if len(hot_set) else np.zeros(len(at), bool)
                for t, start, count, low, loops, hot_one, content in zip(
                    found.text.tolist(), found.start.tolist(), found.count.tolist(), found.minimiser.tolist(), found.loops.tolist(), is_hot.tolist(), found.contents(), strict=True
                ):
                    if hot_one:
                        added = [add((ids[t], ties[t], start + k), 1, hash_of(one), 0, one) for k, one in enumerate(_windows_of(content, window))]
                    else:
                        added = [add((ids[t], ties[t], start), count, low, loops, content)]
                    size, again = (x + sum(y) for x, y in zip((size, again), zip(*added)))
                if size > PACK_BYTES or again > REPEATS:
                    yield from flush()
                    size = again = 0
        yield from flush()

    return rows.mapInArrow(tidy(work), "shard int, kind int, pack binary")


def hash_of(content: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(content)


def indexed_repeats(contents: list[bytes], of: np.ndarray, ids: np.ndarray, ties: np.ndarray, starts: np.ndarray, window: int) -> list[np.ndarray]:
    """Arrays id, tie, start, n: runs of n windows from a word on that also start earlier.

    contents are different word sequences, `of` says which of them stands at each place (id, tie,
    start). All are indexed, and each is searched once; a place repeats the windows
    whose interval has an earlier place.
    """
    vocabulary: dict[bytes, int] = {}
    code = lambda w: vocabulary.setdefault(w, len(vocabulary) + 1)
    coded = [np.fromiter(map(code, c.split(b" ")), np.int64) for c in contents]
    lengths = np.array([len(c) + 1 for c in coded])
    text = np.concatenate([x for c in coded for x in (c, np.zeros(1, np.int64))])
    begins = np.cumsum(lengths) - lengths
    # the windows of every sequence, and the intervals that they are found in
    n = lengths - window
    base = np.cumsum(n) - n
    ends = np.arange(int(n.sum())) + np.repeat(begins - base, n) + window - 1
    # a sequence with one place repeats only what the index holds twice
    least = np.where(np.bincount(of, minlength=len(contents)) > 1, 1, 2)
    _, interval = FMIndex(text, window).repeats(text, ends, window, np.repeat(least, n))
    # each place has the windows of its sequence
    held = n[of]
    place = np.repeat(np.arange(len(of)), held)
    offset = np.arange(len(place)) - np.repeat(np.cumsum(held) - held, held)
    found = interval[base[of][place] + offset]
    place, offset, found = (x[found >= 0] for x in (place, offset, found))
    if not len(found):
        return [np.empty(0, kind) for kind in (np.int64, np.int64, np.int32, np.int32)]
    # a window's place as one number: its document by (id, tie), then its word
    order = np.lexsort((ties, ids))
    other = np.concatenate(([0], (np.diff(ids[order]) != 0) | (np.diff(ties[order]) != 0)))
    document = np.empty(len(of), np.int64)
    document[order] = np.cumsum(other)
    key = document[place] << 32 | starts[place] + offset
    earliest = np.full(len(text), np.iinfo(np.int64).max)
    np.minimum.at(earliest, found, key)
    later = key != earliest[found]
    # neighbouring windows of one place become one run
    hit = np.flatnonzero(later)
    new = np.concatenate(([True], (np.diff(offset[hit]) != 1) | (np.diff(place[hit]) != 0)))[: len(hit)]
    head = hit[new]
    sizes = np.diff(np.append(np.flatnonzero(new), len(hit)))
    at = place[head]
    return [c.astype(kind) for c, kind in zip((ids[at], ties[at], starts[at] + offset[head], sizes), (np.int64, np.int64, np.int32, np.int32), strict=True)]


def shard_repeats(packs: list[bytes], window: int) -> list[np.ndarray]:
    """Arrays id, tie, start, n: runs of n windows from a word on that also start earlier, in one shard."""
    parts = [_unpack(p) for p in packs]
    ids, ties, starts, _, lows, loops = (np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True))
    contents = [c for p in parts for c in p[1]]
    _, inverse, times = np.unique(lows, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero((times[inverse] > 1) | (loops > 0))
    if not len(chosen):
        return [np.empty(0, kind) for kind in (np.int64, np.int64, np.int32, np.int32)]
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(contents[k], len(number)) for k in chosen.tolist()), np.int64, len(chosen))
    return indexed_repeats(list(number), of, ids[chosen], ties[chosen], starts[chosen].astype(np.int64), window)


def _hot_minimisers(rows: DataFrame, window: int, run: int, shards: int) -> list[int]:
    """Minimisers of more than 1 / (HOT_PER_SHARD * shards) of a sample's segments: fewer than HOT_PER_SHARD * shards by their share."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                low, n = np.unique(Segments(texts(part.column("text")), window, run).minimiser, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(n)], names=["low", "n"])

    sampled = rows.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    counted = sampled.mapInArrow(tidy(work), "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).filter("n >= 8")
    counted = materialise(counted, "hot")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.filter(F.col("n") > total / (HOT_PER_SHARD * shards)).filter("n >= 64").select("low").collect()
    return [r["low"] & 0xFFFFFFFFFFFFFFFF for r in found]


def repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, runs): rows are (id, tie, own, text); runs are (id, tie, start, n), n windows from word `start` on that also start earlier.

    id is own with nulls in first place; tie tells rows apart that share an id (a text
    digest; 0 while ids are unique). There are as many shards as the documents' bytes
    ask for, so that a shard's size does not grow with the corpus.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of a whole number type, as its order is that of the documents")
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
        shards = max(4, -(-size // SHARD_BYTES))
    ident = F.coalesce(docs[id_col].cast("long"), F.lit(_NULL_ID))
    shared_ids = docs.select(ident.alias("id")).groupBy("id").count().filter("count > 1").limit(1).count()
    # the null id's number is a real id too; then both share an id, and the digest orders them
    tie = F.xxhash64(docs[text_col].cast("string")) if shared_ids else F.lit(0).cast("long")
    rows = docs.select(ident.alias("id"), tie.alias("tie"), docs[id_col].alias("own"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    hot = spark.sparkContext.broadcast(_hot_minimisers(rows, window, run, shards))
    cells = spark.sparkContext.broadcast(_shared_cells(rows, window, run))

    def work(table: pa.Table) -> pa.Table:
        kinds, blocks = table.column("kind").to_pylist(), table.column("pack").to_pylist()
        out = [_local_repeats(p) for k, p in zip(kinds, blocks) if k == 1]
        packs = [p for k, p in zip(kinds, blocks) if k == 0]
        if packs:
            out.append(shard_repeats(packs, window))
        return pa.table({name: np.concatenate(c) for name, c in zip(("id", "tie", "start", "n"), zip(*out, strict=True))})

    emitted = _emit(rows, window, run, shards, hot, cells)
    return rows, emitted.groupBy("shard").applyInArrow(work, "id long, tie long, start int, n int")


def _local_repeats(block: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for kind in (np.int64, np.int64, np.int32, np.int32):
        out.append(np.frombuffer(body, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _cut(docs: DataFrame, window: int, run: int, shards: int | None, id_col: str, text_col: str) -> DataFrame:
    """(own, text, runs) of every row; runs null where nothing repeats."""
    rows, found = repeats(docs, window, run, shards, id_col, text_col)
    grouped = found.groupBy("id", "tie").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    return rows.join(grouped, ["id", "tie"], "left").select("own", "text", "runs")


def kept_words(data: bytes, runs: list[tuple[int, int]], window: int) -> tuple[int, int, list[bytes]]:
    """Words, how many of them repeated windows cover, and the others."""
    words = data.split()
    if not runs:
        return len(words), 0, words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, n in runs:
        edges[start] += 1
        edges[start + n + window - 1] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return len(words), int(gone.sum()), [w for w, g in zip(words, gone.tolist()) if not g]


def substring_digests(docs: DataFrame, window: int = WINDOW, run: int = RUN, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every whole text.

    A word goes if a window over it, `window` words of one document, also starts
    earlier: in a row of smaller id, or earlier in the same row. Null ids come before
    all others; rows that share an id are ordered by a digest of their text, and rows
    that agree in both are one document read twice, with one result. Ids are whole
    numbers (TypeError for others). Null and empty texts have no words; very long texts
    are whole documents like others.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for data, runs in zip(texts(part.column("text")), part.column("runs").to_pylist(), strict=True):
                    n, gone, kept = kept_words(data, [(r["start"], r["n"]) for r in runs or ()], window)
                    out.append((n, gone, sha256_hex(b" ".join(kept))))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("own"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2])], names=schema.names)

    return _cut(docs, window, run, shards, id_col, text_col).mapInArrow(tidy(work), schema)


def deduplicated_texts(docs: DataFrame, window: int = WINDOW, run: int = RUN, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every row's kept words joined by one space."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(text_col, T.StringType())])

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = [b" ".join(kept_words(d, [(r["start"], r["n"]) for r in runs or ()], window)[2]) for d, runs in zip(texts(part.column("text")), part.column("runs").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("own"), pa.array(out, pa.binary()).cast(pa.string())], names=schema.names)

    return _cut(docs, window, run, shards, id_col, text_col).mapInArrow(tidy(work), schema)
