"""Benchmark decontamination by word n-grams.

A window is 13 consecutive words of a benchmark item (a shorter item is one window).
The distinct windows are a broadcast hash set if there are at most MAX_WINDOWS of
them in MAX_BYTES, which is checked; documents are then scanned in one pass without a
shuffle. The windows of a larger benchmark stay in shards, each slice of documents asks
the shards for those of its own windows that they have (see probe), and the set of
these few is scanned for in the same way. Both ways give the same rows.

The scan codes each word by the set's vocabulary, drops places with a foreign word,
compares rolling hashes with a hash table, and verifies every hit on the words.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from furrow.llm.probe import probe
from furrow.llm.text import ALNUM, alnum_words, sha256_hex, slices, texts, tidy
from furrow.session import materialise

WINDOW = 13
#: What is broadcast at most: windows, and bytes of windows and item ids.
MAX_WINDOWS, MAX_BYTES = 500_000, 64 << 20
#: Windows' bytes of a shard beyond that.
SHARD_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^ ]+")


def item_windows(words: list[bytes], n: int = WINDOW) -> list[bytes]:
    """An item's windows, words joined by a space; one for an item of fewer words."""
    if not words:
        return []
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """(item string, gram binary, size int), distinct; an item with a null text has none, a null id stays null."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out: dict[str, list] = {"item": [], "gram": [], "size": []}
                for item, t in zip(part.column("item").to_pylist(), texts(part.column("text")), strict=True):
                    words = alnum_words(t or b"")
                    grams = item_windows(words, n)
                    out["item"] += [item] * len(grams)
                    out["gram"] += grams
                    out["size"] += [min(n, len(words))] * len(grams)
                yield pa.RecordBatch.from_pydict({"item": pa.array(out["item"], pa.string()), "gram": pa.array(out["gram"], pa.binary()), "size": pa.array(out["size"], pa.int32())})

    chosen = items.select(items[id_col].cast("string").alias("item"), items[text_col].cast("string").alias("text"))
    return chosen.mapInArrow(tidy(run), "item string, gram binary, size int").distinct()


@dataclass
class NgramSet:
    """Windows and the items that each belongs to."""

    grams: dict[bytes, tuple]

    def __post_init__(self):
        self.by_size: dict[int, tuple[np.ndarray, int]] = {}
        vocabulary = sorted({w for g in self.grams for w in g.split(b" ")})
        self.codes = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") | 1 for w in vocabulary}
        sizes: dict[int, list[bytes]] = {}
        for g in self.grams:
            sizes.setdefault(g.count(b" ") + 1, []).append(g)
        for size, grams in sorted(sizes.items()):
            codes = np.array([[self.codes[w] for w in g.split(b" ")] for g in grams], np.uint64)
            bits = max(10, (16 * len(grams)).bit_length())
            table = np.zeros(1 << bits, bool)
            table[self.rolling(codes.ravel(), size)[::size] >> np.uint64(64 - bits)] = True
            self.by_size[size] = (table, 64 - bits)

    @staticmethod
    def rolling(codes: np.ndarray, size: int) -> np.ndarray:
        m = len(codes) - size + 1
        total = np.zeros(m, np.uint64)
        for k in range(size):
            total = total * np.uint64(_BASE) + codes[k : k + m]
        total ^= total >> np.uint64(31)
        return total * np.uint64(_BASE)

    def hits(self, words: list[bytes]) -> list[tuple[int, int, tuple]]:
        """(start, size, items) of every verified occurrence of a window."""
        n, out = len(words), []
        get = self.codes.get
        codes = np.fromiter((get(w, 0) for w in words), np.uint64, n)
        foreign = np.concatenate(([0], np.cumsum(codes == 0)))
        for size, (table, shift) in self.by_size.items():
            if n < size:
                break
            starts = np.flatnonzero(foreign[size:] == foreign[:-size])
            if len(starts) and size > 1:
                starts = starts[table[self.rolling(codes, size)[starts] >> np.uint64(shift)]]
            for i in starts.tolist():
                items = self.grams.get(b" ".join(words[i : i + size]))
                if items is not None:
                    out.append((i, size, items))
        return out


def covered(hits: list[tuple], n: int) -> np.ndarray:
    """Boolean per word: inside any hit."""
    edges = np.zeros(n + 1, np.int64)
    for start, size, *_ in hits:
        edges[start] += 1
        edges[start + size] -= 1
    return np.cumsum(edges[:n]) > 0


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def without(t: bytes, hits: list[tuple], n: int) -> bytes:
    """A text of n words less its hit words, from the first to the last byte of consecutive ones."""
    spans = [m.span() for m in _WORD.finditer(t.translate(ALNUM))]
    gone = np.flatnonzero(covered(hits, n)).tolist()
    kept, at = [], 0
    for k, i in enumerate(gone):
        if not k or gone[k - 1] != i - 1:
            kept.append(t[at : spans[i][0]])
        at = spans[i][1]
    return b"".join([*kept, t[at:]])


def _set_of(rows: list[tuple[bytes, str | None]]) -> NgramSet:
    by: dict[bytes, set] = {}
    for gram, item in rows:
        by.setdefault(gram, set()).add(item)
    return NgramSet({g: tuple(sorted(i for i in items if i is not None)) for g, items in by.items()})


def _digests(grams: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64, len(grams))


def _shards(grams: DataFrame, n: int) -> DataFrame:
    """(shard, data): the windows with their items, by the windows' hashes."""

    def run(batches):
        for batch in batches:
            hashes = _digests(batch.column("gram").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array((hashes % np.uint64(n)).astype(np.int64)), pa.array(hashes.view(np.int64)), batch.column("gram"), batch.column("item")], names=["shard", "hash", "gram", "item"])

    def pack(table: pa.Table) -> pa.Table:
        data = pickle.dumps(tuple(table.column(c).to_pylist() for c in ("hash", "gram", "item")))
        return pa.table({"shard": table.column("shard")[:1], "data": pa.array([data], pa.binary())})

    hashed = grams.select("gram", "item").mapInArrow(tidy(run), "shard long, hash long, gram binary, item string")
    return hashed.groupBy("shard").applyInArrow(pack, "shard long, data binary")


def _load(data: bytes) -> dict[int, list]:
    by: dict[int, list] = {}
    for h, gram, item in zip(*pickle.loads(data), strict=True):
        by.setdefault(h, []).append((gram, item))
    return by


def _answer(windows_: dict[int, list], question: bytes) -> bytes | None:
    found = [x for h in np.frombuffer(question, np.int64).tolist() for x in windows_.get(h, ())]
    return pickle.dumps(found) if found else None


def _scanned(docs: DataFrame, items: DataFrame, n: int, max_windows: int, max_bytes: int, text_at: int, item_id_col: str, item_text_col: str, close, schema: T.StructType) -> DataFrame:
    """Rows that close(batch, texts, set) makes of slices of docs, where the set has all windows that occur in the slice, at least."""
    arrow = to_arrow_schema(schema)
    grams = materialise(windows(items, item_id_col, item_text_col, n), "windows")
    size = grams.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("gram") + F.coalesce(F.length("item"), F.lit(0))), F.lit(0)).alias("bytes")).first()
    if size["n"] > max_windows or size["bytes"] > max_bytes:
        sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most n values
        shards = 1 + size["bytes"] // SHARD_BYTES

        def ask(batch):
            found: list[np.ndarray] = []
            for t in batch:
                words = alnum_words(t or b"")
                for k in sizes:
                    found.append(_digests([b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]))
            hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            shard = (hashes % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
            return [(int(shard[part[0]]), hashes[part].tobytes()) for part in np.split(order, cuts[1:]) if len(part)]

        def told(part, batch, said):
            return close(part, batch, _set_of([x for data in said for x in pickle.loads(data)]))

        return probe(docs, text_at, _shards(grams, shards), ask, _load, _answer, told, schema)
    shared = docs.sparkSession.sparkContext.broadcast(_set_of([(bytes(r["gram"]), r["item"]) for r in grams.select("gram", "item").collect()]))

    def run(batches):
        index = shared.value
        for batch in batches:
            plain = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])
            for part in slices(plain, f"c{text_at}", SLICE_BYTES):
                yield close(part, texts(part.column(text_at)), index).cast(arrow)

    return docs.mapInArrow(tidy(run), schema)


_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]


def flag(docs: DataFrame, items: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every whole text.

    Words in any occurrence of a window are hit; n_items and items_sha256 (ids sorted
    as strings, comma-joined) tell which items' windows occur. A document is
    contaminated if at least one word in twenty is hit. Null texts have no words; a
    benchmark without words hits nothing; an item with a null id hits but isn't
    listed; repeated document rows give repeated rows, repeated items count once. Very
    long texts are scanned whole. Only the id and the text are read.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *_FIELDS])
    kinds = [f.type for f in list(to_arrow_schema(schema))[1:]]

    def close(part, batch, index):
        rows = []
        for t in batch:
            words = alnum_words(t or b"")
            hits = index.hits(words)
            n_hit = int(covered(hits, len(words)).sum()) if hits else 0
            found = sorted({x for h in hits for x in h[2]})
            rows.append((len(words), n_hit, len(found), sha256_hex(",".join(found).encode()), is_contaminated(n_hit, len(words))))
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True))], names=schema.names)

    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return _scanned(chosen, items, n, max_windows, max_bytes, 1, item_id_col, item_text_col, close, schema)


def clean(docs: DataFrame, items: DataFrame, action: str = "drop", n: int = WINDOW, max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with all columns: contaminated documents dropped ("drop"), or hit spans cut from every text ("cut").

    Rows are judged one by one, by their own texts, also where ids are null or shared. A
    cut runs from the first to the last byte of consecutive hit words. Other documents
    are unchanged; a null text stays null; no other column's name can clash.
    """
    names, where = docs.columns, docs.columns.index(text_col)

    def close(part, batch, index):
        columns, out = part.columns, []
        for t in batch:
            words = alnum_words(t or b"")
            hits = index.hits(words)
            if action == "cut":
                out.append(without(t, hits, len(words)) if hits else t)
            else:
                out.append(not (hits and is_contaminated(int(covered(hits, len(words)).sum()), len(words))))
        if action == "cut":
            columns[where] = pa.array(out, pa.binary()).cast(pa.string())
        else:
            columns = [c.filter(pa.array(out, pa.bool_())) for c in columns]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return _scanned(docs, items, n, max_windows, max_bytes, where, item_id_col, item_text_col, close, docs.schema)
