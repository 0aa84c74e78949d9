"""Near-duplicate documents: HyperMinHash sketches, banded, estimated, then verified.

A document's set is its distinct shingles. Documents with equal sets (128-bit digests
of them) are one class, and one class counts once from then on. Each class has REGISTERS
registers: the least of a random permutation of its shingle hashes, kept as its number
of leading zeros and its next MANTISSA bits (16 bits in all). BANDS groups of ROWS
registers are bucket keys: at similarity 0.8 a pair shares no bucket with a chance of
about 5e-8.

No bucket is expanded into pairs. A bucket names a pivot and its other classes are
compared with it. Buckets that then still hold classes of several components are cut by
set size (sets that differ by more than the threshold can't be linked) and their
registers are compared in tiles; only classes that this makes likely are compared
further, again in tiles, and what is already connected isn't compared at all.

Registers only drop pairs: the share of equal ones, corrected for chance collisions,
must not be far below the threshold. Every link is confirmed on the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.hashing import Words, finish
from furrow.llm.text import slices, texts, tidy
from furrow.operators.graph import hanging_nodes
from furrow.session import materialise

SHINGLE = 5
SHARE = 80
ROWS, BANDS = 4, 32
REGISTERS = ROWS * BANDS
MANTISSA = 10
SLICE = 1 << 20
#: Rows and bytes of a tile's side, by registers and by texts; small tiles are bundled to as many bytes.
SIDE, SIDE_BYTES = 1024, 512 << 10
TEXTS_SIDE, TEXTS_BYTES = 256, 2 << 20

_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(0, 2**64, REGISTERS, np.uint64)
_ODD = _rng.integers(0, 2**64, REGISTERS, np.uint64) | np.uint64(1)


def shingle_sets(batch: list[bytes | None], n: int) -> list[tuple[np.ndarray, bytes | None]]:
    """Of each text: the sorted 64-bit hashes of its distinct shingles, and a 128-bit digest of the set (None if empty).

    The digest is over 128 bits of every shingle, which come from 128-bit hashes of the words.
    """
    words = Words([(t or b"").lower() for t in batch])
    high, low = words.windows(n), words.windows(n, 1)
    out: list[tuple[np.ndarray, bytes | None]] = []
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if b == a:
            out.append((np.zeros(0, np.uint64), None))
            continue
        if b - a >= n:
            h, x = high[a : b - n + 1], low[a : b - n + 1]
        else:  # the whole sequence is one shingle, apart from those of n words by its length
            h, x = (reduce(lambda p, q: finish(p + q * np.uint64(3)), lane[a:b, None], np.full(1, b - a, np.uint64)) for lane in words.lanes)
        order = np.argsort(h)
        h, x = h[order], x[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
        h, x = h[new], x[new]
        out.append((h, hashlib.blake2b(h.tobytes() + x.tobytes(), digest_size=16).digest()))
    return out


def exact_sets(batch: list[bytes], n: int) -> list[np.ndarray]:
    """Of each text: its distinct shingles as sorted numbers; equal numbers in a batch mean equal words, no hash is involved."""
    vocabulary: dict[bytes, int] = {}
    coded = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t.lower().split()), np.int64) for t in batch]
    bounds = np.cumsum([0, *map(len, coded)])
    flat = np.concatenate(coded) if coded else np.zeros(0, np.int64)
    runs = flat
    for k in range(1, n):
        m = max(0, len(flat) - k)
        runs = np.unique(runs[:m] * max(1, len(vocabulary)) + flat[k : k + m], return_inverse=True)[1]
    out = []
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        # a shorter text shares no shingle with a text of another class
        out.append(np.unique(runs[a : b - n + 1]) if b - a >= n else np.array([-1 - i]))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a set that isn't empty."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, ((shingles[at : at + 256, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    high = least >> np.uint64(11)
    length = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 11, np.frexp((least & np.uint64(2047)).astype(np.float64))[1])
    zeros = (64 - length).astype(np.uint64)
    # bits after the leading one; a shift by 64 or more is taken as none left
    rest = np.where(zeros < 63, (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA), np.uint64(0))
    return ((np.minimum(zeros, np.uint64(63)) << np.uint64(MANTISSA)) | rest).astype("<u2")


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less the share that chance makes equal."""
    ratio = np.maximum(n_a, n_b) / np.minimum(n_a, n_b)
    chance = 0.1699 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / (1 - chance)


def plausible(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, share: int) -> np.ndarray:
    """Pairs at most six standard errors below the threshold, and of sizes that allow it."""
    j = share / 100
    least = j - 6 * (j * (1 - j) / REGISTERS) ** 0.5
    return (estimate(equal, n_a, n_b) >= least) & (100 * np.minimum(n_a, n_b) >= share * np.maximum(n_a, n_b))


def text_key(docs: DataFrame, text_col: str) -> Column:
    """128-bit digest of a row's text, null for a null text."""
    return F.unhex(F.md5(docs[text_col].cast("string")))


def sketches(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n_shingles, node, regs) per row: node is a 128-bit digest of the set, null for an empty one; key one of the text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(texts(part.column("text")), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("key"),
                        pa.array([len(s) for s, _ in sets], pa.int64()),
                        pa.array([node for _, node in sets], pa.binary()),
                        pa.array([registers(s).tobytes() if len(s) else None for s, _ in sets], pa.binary()),
                    ],
                    names=["id", "key", "n_shingles", "node", "regs"],
                )

    chosen = docs.select(docs[id_col].alias("id"), text_key(docs, text_col).alias("key"), docs[text_col].cast("string").alias("text"))
    kinds = {"id": docs.schema[id_col].dataType, "key": T.BinaryType(), "n_shingles": T.LongType(), "node": T.BinaryType(), "regs": T.BinaryType()}
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    return chosen.mapInArrow(tidy(run), schema)


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, num) of every band of every class."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = np.frombuffer(b"".join(part.column("regs").to_pylist()), np.uint64).reshape(-1, BANDS)
                keys = finish(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part.column("num").to_numpy(), BANDS))], names=["bucket", "num"])

    return classes.select("num", "regs").mapInArrow(tidy(run), "bucket long, num long")


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Pairs whose registers and sizes allow a link."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                equal = (_regs(part.column("regs_a")) == _regs(part.column("regs_b"))).mean(axis=1)
                good = plausible(equal, part.column("n_a").to_numpy(), part.column("n_b").to_numpy(), share)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    side = lambda x: classes.select(F.col("num").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(run), "a long, b long")


def _texts(nums: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(num, body) of the given classes: the text of one document of each."""
    needed = nums.join(classes.select("num", F.col("of.id").alias("of_id"), F.col("of.key").alias("of_key")), "num").withColumn("place", F.xxhash64("of_id", "of_key"))
    rows = docs.select(docs[id_col].alias("id"), text_key(docs, text_col).alias("key"), docs[text_col].cast("string").alias("body"))
    held = rows.withColumn("place", F.xxhash64("id", "key")).join(needed, "place").filter(F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")))
    # rows that repeat id and text answer once; grouped as they were joined, without another shuffle
    return materialise(held.groupBy("place", "num").agg(F.any_value("body").alias("body")).drop("place"), "texts")


def _bounded(batch: pa.RecordBatch, columns: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of about `limit` bytes in the columns together, one row at least."""
    sizes = sum(pa.compute.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in columns)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def _verified(pairs: DataFrame, bodies: DataFrame, n: int, share: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets really reach the threshold."""

    def count(batches):
        for batch in batches:
            for part in _bounded(batch, ["ta", "tb"], SLICE):
                left, right = (texts(part.column(c)) for c in ("ta", "tb"))
                # a text that many pairs name is read once
                place = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}
                sets = exact_sets(list(place), n)
                good = []
                for x, y in zip(left, right, strict=True):
                    x, y = sets[place[x]], sets[place[y]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= share * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    side = lambda x: bodies.select(F.col("num").alias(x), F.col("body").alias(f"t{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(count), "a long, b long")


def block_links(left: list[np.ndarray], right: list[np.ndarray], share: int) -> np.ndarray:
    """Boolean matrix of pairs that reach the threshold, by products of 0/1 matrices over shared shingles."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), size) for side, size in zip((left, right), sizes)]
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate(side) for side in (left, right)]
    where = [np.searchsorted(shared, f) for f in flat]
    real = [(w < len(shared)) & (shared[np.minimum(w, len(shared) - 1)] == f) if len(shared) else np.zeros(len(f), bool) for w, f in zip(where, flat)]
    for at in range(0, len(shared), 4096):
        x = []
        for side in range(2):
            m = np.zeros((len(sizes[side]), min(4096, len(shared) - at)), np.float32)
            pick = real[side] & (where[side] >= at) & (where[side] < at + 4096)
            m[rows[side][pick], where[side][pick] - at] = 1
            x.append(m)
        both += x[0] @ x[1].T
    return 100 * both >= share * (sizes[0][:, None] + sizes[1][None, :] - both)


def register_links(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, share: int) -> np.ndarray:
    """Boolean matrix of pairs whose registers and sizes allow a link."""
    out = np.zeros((len(left), len(right)), bool)
    for i in range(0, len(left), 32):
        for j in range(0, len(right), 256):
            equal = (left[i : i + 32, None] == right[None, j : j + 256]).mean(axis=2)
            out[i : i + 32, j : j + 256] = plausible(equal, n_left[i : i + 32, None], n_right[None, j : j + 256], share)
    return out


def _tiles(rows: DataFrame, side: int, side_bytes: int, linked) -> DataFrame:
    """Pairs (a, b) of different components of each group that links connect, from rows (grp, num, comp, size, data, n).

    A group's rows outside its largest component are compared with all its rows, in
    tiles of bounded numbers and bytes, by linked(data and n of one side, and of the
    other). A tile gives a spanning forest of its links: at most one row a component. Small
    groups share tasks, of which there are as many as their bytes ask for.
    """
    rows = materialise(rows, "rows")
    per = rows.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("bytes"))
    most = F.max(F.struct("k", "comp", "bytes"))
    per = per.groupBy("grp").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("k"), F.sum("bytes").alias("bytes"), most.alias("core")).filter("comps > 1")
    tiles = lambda k, size: F.greatest(F.ceil(k / side), F.ceil(size / side_bytes), F.lit(1)).cast("int")
    plan = per.select("grp", "core.comp", "bytes", tiles(F.col("k") - F.col("core.k"), F.col("bytes") - F.col("core.bytes")).alias("n_in"), tiles(F.col("k"), F.col("bytes")).alias("n_all"))
    plan = materialise(plan.withColumnRenamed("comp", "core"), "plan")
    small = (F.col("n_in") == 1) & (F.col("n_all") == 1)
    room = plan.filter(small).agg(F.sum("bytes")).first()[0] or 0
    bundles = 1 + 2 * room // side_bytes
    h = F.xxhash64("num")
    i, j = F.pmod(h, F.col("n_in")).cast("int"), F.pmod(h, F.col("n_all")).cast("int")
    inner = F.col("comp") != F.col("core")
    copies = F.concat(
        F.when(inner, F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(0).alias("side")))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>")),
        F.transform(F.sequence(F.lit(0), F.col("n_in") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(1).alias("side"))),
    )
    spread = rows.join(plan.drop("bytes"), "grp").select("grp", "num", "comp", "data", "n", small.alias("small"), F.inline(copies))
    task = F.when(F.col("small"), F.pmod(F.xxhash64("grp"), F.lit(bundles))).otherwise(F.xxhash64("grp", "i", "j"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("i", "ascending"), ("j", "ascending"), ("side", "ascending")]).combine_chunks()
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("grp", "i", "j")])
        cuts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0), [True])))
        found: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            tile = table.slice(a, b - a)
            middle = int((tile.column("side").to_numpy() == 0).sum())
            if middle:
                found += _forest([tile.slice(0, middle), tile.slice(middle)], linked)
        columns = list(zip(*found, strict=True)) or [(), ()]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return spread.withColumn("task", task).groupBy("task").applyInArrow(compare, "a long, b long")


def _forest(sides: list[pa.Table], linked) -> list[tuple[int, int]]:
    """Pairs of components that links of one tile connect and that weren't connected in it before."""
    comps = [s.column("comp").to_numpy() for s in sides]
    matrix = linked(*((s.column("data"), s.column("n").to_numpy()) for s in sides))
    matrix &= comps[0][:, None] != comps[1][None, :]
    root: dict[int, int] = {}
    out = []

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for p, q in zip(*(x.tolist() for x in np.nonzero(matrix)), strict=True):
        a, b = int(comps[0][p]), int(comps[1][q])
        if (x := find(a)) != (y := find(b)):
            root[x] = y
            out.append((a, b))
    return out


def _open(members: DataFrame, found: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Rows (grp, num, comp, size, data, n) of buckets, cut by set size, that hold classes of several components."""
    # dealt by bucket once, for the sums and for the join with them
    named = members.join(found.withColumnRenamed("node", "num"), "num", "left").select("bucket", "num", F.coalesce("component", "num").alias("comp")).repartition("bucket")
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    # sizes in steps of the threshold's ratio: linked sets are in one step or in neighbouring ones
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(log(100 / share) + 1e-9)).cast("long")
    rows = named.join(mixed, "bucket").join(classes.select("num", "n_shingles", "regs"), "num").withColumn("step", F.explode(F.array(step, step - 1)))
    return rows.select(F.xxhash64("bucket", "step").alias("grp"), "num", "comp", F.lit(2 * REGISTERS).alias("size"), F.col("regs").alias("data"), F.col("n_shingles").alias("n"))


def _linked(docs: DataFrame, n: int, share: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (node, id, comp) of every class: its least id, and what links reach alike."""
    rows = materialise(sketches(docs, n, id_col, text_col), "sketches")
    filled = rows.filter("node IS NOT NULL")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key"))
    classes = filled.groupBy("node").agg(first.alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    # a class's number stands for its digest from here on; it is written, so it stays
    classes = materialise(classes.withColumn("num", F.monotonically_increasing_id()), "classes")

    bands = _buckets(classes).repartition("bucket")
    pivots = bands.groupBy("bucket").agg(F.min("num").alias("pivot"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    members = materialise(bands.join(pivots, "bucket"), "members")
    star = members.filter(F.col("num") != F.col("pivot")).select(F.col("num").alias("a"), F.col("pivot").alias("b"))
    # a pair's repeats are in different buckets, so they are dropped where the next join has them
    star = star.repartition("a").distinct()
    likely = materialise(_likely(star, classes, share), "likely")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct()
    links = materialise(_verified(likely, _texts(ends(likely), classes, docs, id_col, text_col), n, share), "links")
    found = materialise(hanging_nodes(links), "components")

    # buckets whose classes aren't all connected yet: first by registers, then what is likely by words
    open_ = _open(members.drop("pivot"), found, classes, share)
    near = materialise(_tiles(open_, SIDE, SIDE_BYTES, lambda x, y: register_links(_regs(x[0]), _regs(y[0]), x[1], y[1], share)), "near")
    named = classes.select("node", F.col("of.id").alias("id"), "num").join(found.withColumnRenamed("node", "num"), "num", "left").select("node", "id", F.coalesce("component", "num").alias("comp"))
    if not near.take(1):
        return rows, named
    hung = hanging_nodes(near)
    groups = materialise(hung.select(F.col("node").alias("comp"), F.col("component").alias("grp")).union(hung.select("component", "component").distinct()), "groups")
    # found leaves out the class that names a component
    nodes = found.select(F.col("node").alias("num"), F.col("component").alias("comp")).join(groups, "comp").select("num", "comp", "grp").union(groups.select("comp", "comp", "grp"))
    nodes = materialise(nodes, "nodes")
    held = nodes.join(_texts(nodes.select("num"), classes, docs, id_col, text_col), "num")
    held = held.select("grp", "num", "comp", F.octet_length("body").alias("size"), F.col("body").alias("data"), F.lit(0).alias("n"))

    def by_words(x, y):
        left, right = (texts(s[0]) for s in (x, y))
        sets = exact_sets([*left, *right], n)
        return block_links(sets[: len(left)], sets[len(left) :], share)

    more = materialise(_tiles(held, TEXTS_SIDE, TEXTS_BYTES, by_words), "links")
    if not more.take(1):
        return rows, named
    joint = materialise(hanging_nodes(more), "components").select(F.col("node").alias("comp"), F.col("component").alias("joint"))
    return rows, named.join(joint, "comp", "left").select("node", "id", F.coalesce("joint", "comp").alias("comp"))


def components(docs: DataFrame, n: int = SHINGLE, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row.

    Rows with equal shingle sets belong together; two sets are linked if
    100 * intersection >= share * union. component_id is the least id that links reach, kept
    tells whether it is the row's own. A text of fewer than n words is one shingle; null
    texts and texts without words have no shingles, are linked with nothing, and keep
    their own id. Very long texts are whole sets like all others. Rows that repeat an id
    are judged by their own texts. Ids are of any type with an order (strings: as
    strings). Null ids never become a component_id unless all ids of a component are null.
    """
    rows, ids = _linked(docs, n, share, id_col, text_col)
    least = ids.groupBy("comp").agg(F.min("id").alias("component_id"))
    labels = materialise(ids.join(least, "comp").select("node", "component_id"), "labels")
    joined = rows.select("id", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, n: int = SHINGLE, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all columns, exactly one row of each group of near-duplicates.

    Rows are judged one by one, also those that share an id or have none: the row with
    the least id stays (null ids last), among these the one with the least text digest.
    Of rows that repeat id and text one stays, the least by its columns as JSON. Texts
    without shingles are in no group and all stay.
    """
    rows, ids = _linked(docs, n, share, id_col, text_col)
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    firsts = materialise(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(place).alias("first")).join(ids.select("node", "comp"), "node"), "firsts")
    least = firsts.groupBy("comp").agg(F.min("first").alias("first"))
    chosen = materialise(firsts.select("node", "comp").join(least, "comp").select("node", "first"), "chosen")
    judged = rows.select("id", "key", "node").join(chosen, "node").groupBy("id", "key").agg(F.first(place.eqNullSafe(F.col("first"))).alias("stays"), F.count(F.lit(1)).alias("n"))
    # rows to take out: those that go, and those of which one is put back
    out = materialise(judged.filter("NOT stays OR n > 1").select(F.col("id").alias("out_id"), F.col("key").alias("out_key"), "stays"), "out")
    same = docs[id_col].eqNullSafe(out["out_id"]) & (text_key(docs, text_col) == out["out_key"])
    kept = docs.join(out, same, "left_anti")
    again = out.filter("stays")
    if not again.take(1):
        return kept
    row = F.struct("*")
    repeated = docs.join(again, same, "left_semi")
    one = repeated.groupBy(repeated[id_col], text_key(repeated, text_col)).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.union(one.select("row.*"))
