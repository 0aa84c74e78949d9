"""Label rasters: components, adjacency, overlap counts, zonal statistics and distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from furrow.operators.focal import EIGHT, FOUR, column_nearest, row_nearest, spread
from furrow.operators.graph import connected_components
from furrow.session import BY_SORT, materialise

#: Cells of a block that one task labels in memory.
BLOCK = 512
#: Rows of a field that one group measures.
ROWS = 16
_WIDTH = 1 << 32


def cell_key(r, c):
    """One integer a cell, in row order."""
    return r * F.lit(_WIDTH) + c


def _label_block(frame: pd.DataFrame, steps: list[tuple[int, int]]) -> np.ndarray:
    """Least cell key of each cell's component in one block, by min propagation with pointer jumping."""
    r, c, v = (frame[k].to_numpy(np.int64) for k in ("r", "c", "v"))
    key = r * _WIDTH + c
    order = np.argsort(key)
    key, v, r, c = key[order], v[order], r[order], c[order]
    a, b = [], []
    for i, j in steps:
        want = (r + i) * _WIDTH + c + j
        at = np.searchsorted(key, want)
        hit = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == want)
        hit[hit] = v[hit] == v[at[hit]]
        a.append(np.flatnonzero(hit))
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(key))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    out = np.empty(len(key), np.int64)
    out[order] = key[root]
    return out


def label_components(df: DataFrame, value: str, connectivity: int = 4, block: int = BLOCK) -> DataFrame:
    """(r, c, value, component): connected cells of one value share the least cell key of their component.

    Cells whose value is NULL or 0 are background and drop. Blocks are labelled in
    parallel; only label pairs along block edges meet in the graph step, so its size
    grows with edges, not cells.
    """
    steps = [s for s in (FOUR if connectivity == 4 else EIGHT) if s > (0, 0)]
    cells = df.filter(F.coalesce(F.col(value), F.lit(0)) != 0).select(F.col("r").cast("long"), F.col("c").cast("long"), F.col(value).cast("long").alias("v"))
    dealt = cells.withColumns({"br": F.floor(F.col("r") / block).cast("long"), "bc": F.floor(F.col("c") / block).cast("long")})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(local=_label_block(frame, steps))

    # written once: both the edges and the result read it
    local = materialise(dealt.groupBy("br", "bc").applyInPandas(run, "r long, c long, v long, br long, bc long, local long"), "blocks")
    edge = (F.col("r") % block).isin(0, block - 1) | (F.col("c") % block).isin(0, block - 1)
    rim = local.filter(edge)
    beside = spread(rim, steps, {"w": "v", "from_": "local", "fr": "br", "fc": "bc"})
    pairs = beside.join(rim, ["r", "c"]).filter("v = w AND (br <> fr OR bc <> fc)").select(F.col("from_").alias("a"), F.col("local").alias("b")).distinct()
    merged = connected_components(pairs)
    # blocks that touch no other keep their labels
    out = local.join(merged, F.col("local") == F.col("node"), "left")
    return out.select("r", "c", F.col("v").alias(value), F.coalesce("component", "local").alias("component"))


def edge_pairs(df: DataFrame, label: str, tile: int) -> DataFrame:
    """Distinct (a, b), a < b, of labels that touch across tile edges, corners included."""
    cells = df.filter(F.col(label) != 0).select("r", "c", F.col(label).alias("l"))
    rim = cells.filter((F.col("r") % tile).isin(0, tile - 1) | (F.col("c") % tile).isin(0, tile - 1))
    at = rim.withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    beside = spread(at, EIGHT, {"m": "l", "fr": "tr", "fc": "tc"})
    return beside.join(at, ["r", "c"]).filter("m < l AND (fr <> tr OR fc <> tc)").select(F.col("m").alias("a"), F.col("l").alias("b")).distinct()


def merge_tiles(df: DataFrame, label: str, tile: int) -> DataFrame:
    """Labels that touch across tile edges become the least label of their group."""
    groups = connected_components(edge_pairs(df, label, tile))
    out = df.join(groups, F.col(label) == F.col("node"), "left")
    return out.withColumn("merged", F.coalesce("component", label)).drop("node", "component")


def segment_fields(df: DataFrame, t_ext: float, t_bound: float, extent: str = "extent", boundary: str = "boundary", connectivity: int = 4) -> DataFrame:
    """(r, c, field): components of cells with enough extent and little boundary; other cells -1."""
    inside = (F.col(extent) >= t_ext) & (F.col(boundary) < t_bound)
    marked = df.select("r", "c", F.when(inside, 1).otherwise(0).alias("inside"))
    found = label_components(marked, "inside", connectivity).select("r", "c", "component")
    return marked.select("r", "c").join(found, ["r", "c"], "left").select("r", "c", F.coalesce("component", F.lit(-1)).alias("field"))


def keep_labels(df: DataFrame, label: str, ids: DataFrame) -> DataFrame:
    return df.join(ids, label, "left_semi")


def drop_border_labels(df: DataFrame, label: str, step: int, limit: int = 5) -> DataFrame:
    """Remove every label with a cell within `limit` of a slice edge (slices of step x step cells)."""
    near = lambda k: (F.col(k) % step < limit) | (F.col(k) % step >= step - limit)
    touching = df.filter((F.col(label) != 0) & (near("r") | near("c"))).select(label).distinct()
    return df.filter(F.col(label) != 0).join(touching, label, "left_anti")


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def best_iou(pairs: DataFrame, a: str = "ref", b: str = "pred", mode: str = "faithful", least: int = 5) -> DataFrame:
    """Per reference label the prediction that overlaps it most (smallest id on ties), union, IoU and relative overlaps.

    mode faithful picks before background 0 is dropped, so a label that mostly overlaps
    background vanishes; mode dedup drops background first. Labels of at most `least`
    cells drop. Sizes come from small aggregates joined back.
    """
    size_a = pairs.groupBy(a).agg(F.sum("n").alias("size_a"))
    size_b = pairs.groupBy(b).agg(F.sum("n").alias("size_b"))
    competing = pairs if mode == "faithful" else pairs.filter((F.col(a) != 0) & (F.col(b) != 0))
    best = competing.groupBy(a).agg(F.max(F.struct(F.col("n"), (-F.col(b)).alias("m"))).alias("s")).select(a, (-F.col("s.m")).alias(b), F.col("s.n").alias("n"))
    out = best.filter((F.col(a) != 0) & (F.col(b) != 0)).join(size_a, a).join(size_b, b).filter((F.col("size_a") > least) & (F.col("size_b") > least))
    union = F.col("size_a") + F.col("size_b") - F.col("n")
    return out.select(a, b, "n", "size_a", "size_b", (F.col("n") / union).alias("iou"), (F.col("n") / F.col("size_a")).alias("overlap_a"), (F.col("n") / F.col("size_b")).alias("overlap_b"))


def zonal(df: DataFrame, label: str) -> DataFrame:
    """Cell count and truncated mean row and column of every label but 0."""
    return df.filter(F.col(label) != 0).groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg("r")).cast("long").alias("centre_r"), F.floor(F.avg("c")).cast("long").alias("centre_c"))


def field_iou(df: DataFrame, ref: str = "ref", pred: str = "pred", keys: list[str] = []) -> DataFrame:
    """Per reference field: best IoU over intersecting predictions with its id and overlaps, and the IoU of the prediction at its centroid."""
    pairs = df.groupBy(*keys, ref, pred).agg(F.count(F.lit(1)).alias("n"))
    at = field_centres(df, ref, keys).join(df.select(*keys, "r", "c", F.col(pred).alias("centre_pred")), [*keys, "r", "c"], "left")
    return pair_iou(pairs, at, ref, pred, keys)


def field_centres(df: DataFrame, ref: str, keys: list[str] = []) -> DataFrame:
    """(keys, ref, r, c): the cell of each field's mean row and column, which may lie outside the field."""
    return df.filter(F.col(ref) != 0).groupBy(*keys, ref).agg(F.floor(F.avg("r")).cast("long").alias("r"), F.floor(F.avg("c")).cast("long").alias("c"))


def pair_iou(pairs: DataFrame, at: DataFrame, ref: str, pred: str, keys: list[str]) -> DataFrame:
    """field_iou from cell counts of (ref, pred) pairs, background 0 included, and the prediction at each field's centre."""
    size_a = pairs.groupBy(*keys, ref).agg(F.sum("n").alias("size_a"))
    size_b = pairs.groupBy(*keys, pred).agg(F.sum("n").alias("size_b"))
    scored = pairs.filter((F.col(ref) != 0) & (F.col(pred) != 0)).join(size_a, [*keys, ref]).join(size_b, [*keys, pred])
    scored = scored.withColumn("iou", F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n")))
    best = scored.groupBy(*keys, ref).agg(F.max(F.struct("iou", (-F.col(pred)).alias("m"), "n", "size_b")).alias("b"))
    centre_iou = scored.select(*keys, ref, F.col(pred).alias("centre_pred"), F.col("iou").alias("centre_iou"))
    out = size_a.filter(F.col(ref) != 0).join(best, [*keys, ref], "left").join(at, [*keys, ref], "left").join(centre_iou, [*keys, ref, "centre_pred"], "left")
    return out.select(
        *keys,
        ref,
        F.col("size_a").alias("field_size"),
        F.coalesce("b.iou", F.lit(0.0)).alias("max_iou"),
        (-F.col("b.m")).alias("best_pred"),
        F.coalesce("centre_iou", F.lit(0.0)).alias("centre_iou"),
        F.col("r").alias("centre_r"),
        F.col("c").alias("centre_c"),
        "centre_pred",
        (F.col("b.n") / F.col("b.size_b")).alias("ratio_pred"),
        (F.col("b.n") / F.col("size_a")).alias("ratio_true"),
    )


def _steps_of(key: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours, as positions, among sorted cell keys."""
    a, b = [], []
    for i, j in steps:
        want = key + i * _WIDTH + j
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[at] == want
        a.append(np.flatnonzero(hit))
        b.append(at[hit])
    return np.concatenate(a), np.concatenate(b)


def level_labels(key: np.ndarray, extent: np.ndarray, boundary: np.ndarray, t_ext: list[float], t_bound: list[float], steps: list[tuple[int, int]]) -> np.ndarray:
    """(len(t_bound) * len(t_ext), cells): one more than the least key of each cell's component at each pair of thresholds, 0 outside.

    A component tree a boundary threshold: extents are let in from the highest threshold
    down, components only grow and merge, and each level starts from the one before.
    Keys are sorted, t_ext ascends.
    """
    a, b = _steps_of(key, steps)
    out = np.zeros((len(t_bound) * len(t_ext), len(key)), np.int64)
    with np.errstate(invalid="ignore"):
        for j, bound in enumerate(t_bound):
            root = np.arange(len(key))
            for i in range(len(t_ext) - 1, -1, -1):
                inside = (extent >= t_ext[i]) & (boundary < bound)
                live = inside[a] & inside[b]
                x, y = root[a[live]], root[b[live]]
                while len(differ := np.flatnonzero(x != y)):  # only what meets for the first time at this level
                    x, y = x[differ], y[differ]
                    low = np.minimum(x, y)
                    np.minimum.at(root, x, low)
                    np.minimum.at(root, y, low)
                    while not np.array_equal(root, up := root[root]):
                        root = up
                    x, y = root[x], root[y]
                out[j * len(t_ext) + i] = np.where(inside, key[root] + 1, 0)
    return out


_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("tr", "tc", "br", "bc", "r", "c", "ref", "label", "n")] + [T.StructField("kind", T.IntegerType()), T.StructField("point", T.IntegerType()), T.StructField("labels", T.ArrayType(T.LongType()))])


def grid_search_iou(df: DataFrame, t_ext: list[float], t_bound: list[float], tile: int, ref: str = "ref", extent: str = "extent", boundary: str = "boundary", connectivity: int = 4, block: int = BLOCK) -> DataFrame:
    """field_iou of the segmentation at every pair of thresholds, tile by tile: 13 columns a reference field.

    Fields are components (W8) inside tiles of tile x tile cells; their ids are one more than the
    least cell key. Each block of cells is read once: its component trees give the labels of all
    pairs of thresholds, of which only pair counts, the block's rim and the fields' centres
    leave the task. Labels that touch along blocks of a tile are merged in one graph for all
    thresholds. NULL references count as background, NULL values as outside.
    """
    low, bounds = sorted({float(t) for t in t_ext}), sorted({float(t) for t in t_bound})
    block = max(k for k in range(1, min(tile, block) + 1) if tile % k == 0)
    steps = [s for s in (FOUR if connectivity == 4 else EIGHT) if s > (0, 0)]
    cells = df.select(F.col("r").cast("long"), F.col("c").cast("long"), F.coalesce(F.col(ref).cast("long"), F.lit(0)).alias("ref"), F.col(extent).cast("double").alias("extent"), F.col(boundary).cast("double").alias("boundary"))
    places = {n: F.floor(F.col(k) / size).cast("long") for n, k, size in (("tr", "r", tile), ("tc", "c", tile), ("br", "r", block), ("bc", "c", block))}
    cells = cells.withColumns(places)
    centres = materialise(field_centres(cells, "ref", ["tr", "tc"]), "centres")
    asked = centres.select("r", "c").distinct().withColumns(places).select("br", "bc", "r", "c")

    schema = to_arrow_schema(_FOUND)

    def run(frame: pa.Table, wanted: pa.Table) -> pa.Table:
        def rows(size: int, **columns) -> pa.Table:
            return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        def there(table: pa.Table) -> np.ndarray:
            return table.column("r").to_numpy() * _WIDTH + table.column("c").to_numpy()

        if not frame.num_rows:
            return rows(0)
        order = np.argsort(there(frame))
        frame = frame.take(order)
        key = there(frame)
        r, c, refs = (frame.column(k).to_numpy() for k in ("r", "c", "ref"))
        extent_, boundary_ = (np.asarray(frame.column(k).to_numpy(), float) for k in ("extent", "boundary"))
        labels = level_labels(key, extent_, boundary_, low, bounds, steps)
        places = {k: frame.column(k)[0].as_py() for k in ("tr", "tc", "br", "bc")}
        out = []
        for point, row in enumerate(labels):
            both, n = np.unique(np.stack([refs, row]), axis=1, return_counts=True)
            kept = both.any(axis=0)
            m = int(kept.sum())
            out.append(rows(m, kind=[0] * m, point=[point] * m, ref=both[0, kept], label=both[1, kept], n=n[kept], **{k: [v] * m for k, v in places.items()}))
        edge = np.flatnonzero(np.isin(r % block, (0, block - 1)) | np.isin(c % block, (0, block - 1))) if block < tile else np.zeros(0, int)
        middle = np.flatnonzero(np.isin(key, there(wanted)))
        for kind, at in ((1, edge), (2, middle)):
            m = len(at)
            out.append(rows(m, kind=[kind] * m, r=r[at], c=c[at], labels=list(labels[:, at].T), **{k: [v] * m for k, v in places.items()}))
        return pa.concat_tables(out)

    found = materialise(cells.groupBy("br", "bc").cogroup(asked.groupBy("br", "bc")).applyInArrow(run, _FOUND), "levels")
    node = lambda label: F.struct(F.col("point"), F.col(label).alias("label"))
    counts = found.filter("kind = 0").select("tr", "tc", "point", "ref", "label", "n")
    centre = found.filter("kind = 2").select("tr", "tc", "r", "c", F.posexplode("labels").alias("point", "label"))
    if block < tile:
        rim = found.filter("kind = 1").select("tr", "tc", "br", "bc", "r", "c", "labels")
        beside = spread(rim, steps, {"others": "labels", "fr": "br", "fc": "bc", "gr": "tr", "gc": "tc"})
        touching = beside.join(rim, ["r", "c"]).filter("tr = gr AND tc = gc AND (br <> fr OR bc <> fc)").select(F.posexplode(F.arrays_zip("labels", "others")).alias("point", "x"))
        pairs = touching.select("point", "x.labels", "x.others").filter("labels <> 0 AND others <> 0").select(node("labels").alias("a"), node("others").alias("b"))
        merged = materialise(connected_components(pairs.distinct()).select("node.point", "node.label", F.col("component.label").alias("least")), "merged")
        counts, centre = (d.join(merged, ["point", "label"], "left").withColumn("label", F.coalesce("least", "label")).drop("least") for d in (counts, centre))
    keys = ["tr", "tc", "point"]
    pairs = counts.groupBy(*keys, "ref", F.col("label").alias("pred")).agg(F.sum("n").alias("n"))
    points = F.explode(F.sequence(F.lit(0), F.lit(len(low) * len(bounds) - 1)))
    at = centres.withColumn("point", points).join(centre.withColumnRenamed("label", "centre_pred"), [*keys, "r", "c"], "left")
    scored = pair_iou(pairs, at, "ref", "pred", keys)
    value = lambda some, i: F.get(F.array(*(F.lit(t) for t in some)), i)
    return scored.select(
        F.concat_ws("_", F.col("tr") * tile, F.col("tc") * tile).alias("row_col_start"),
        value(low, F.col("point") % len(low)).alias("t_ext"),
        value(bounds, F.floor(F.col("point") / len(low)).cast("int")).alias("t_bound"),
        *(c for c in scored.columns if c not in keys),
    )


def border_distance(df: DataFrame, label: str) -> DataFrame:
    """(r, c, label, dist): distance of each field cell to the nearest cell of another label over the field's largest; a one-cell field has 1.

    Label 0 is background and drops.
    """
    return field_distance(df.filter(F.col(label) != 0), label)


def field_distance(df: DataFrame, label: str) -> DataFrame:
    """border_distance of fields with any labels; repeated cells count once, NULL labels drop.

    A distance transform in two passes, columns and then rows, over each field with its
    outer ring: between a cell and its nearest foreign one lies nothing else. Tasks
    measure as many pieces of ROWS rows at once as a batch holds.
    """
    own = df.filter(F.col(label).isNotNull()).select(F.col("r").cast("long"), F.col("c").cast("long"), F.col(label).alias("l"))
    # what only neighbours reach is foreign
    reached = spread(own, [(0, 0, 1), *((i, j, 0) for i, j in FOUR)], {"l": "l"}).groupBy("l", "r", "c").agg(F.max("w0").alias("own"))
    near = column_nearest(reached.withColumn("foreign", F.col("own") == 0), ["l"], "foreign").withColumn("rows", F.floor(F.col("r") / ROWS))
    kind = df.schema[label].dataType.simpleString()

    def measured(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        r, c, gap, from_r = (table.column(x).to_numpy() for x in ("r", "c", "gap", "from_r"))
        wanted = gap > 0
        piece = np.zeros(len(r), np.int64)
        piece[starts] = 1
        d2, _ = row_nearest(np.cumsum(piece) * ROWS + r % ROWS, c, gap.astype(float), from_r.astype(float), wanted)
        inside = pa.array(wanted)
        columns = [table.column(x).filter(inside).combine_chunks() for x in ("r", "c", "l")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.sqrt(d2[wanted]))], names=["r", "c", "l", "d"])

    def measure(batches):
        held, starts, size, last = [], [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table(batch)
            code = table.column("l").combine_chunks().dictionary_encode().indices.to_numpy()
            rows = table.column("rows").to_numpy()
            new = np.flatnonzero((np.diff(code) != 0) | (np.diff(rows) != 0)) + 1
            if last != (first := (table.column("l")[0].as_py(), rows[0])):
                new = np.concatenate([[0], new])
            if len(new):  # all pieces but the last one are whole
                held.append(table[: new[-1]])
                starts.append(size + new[:-1])
                if size + new[-1]:
                    yield measured(pa.concat_tables(held), np.concatenate(starts))
                held, starts, size = [table[new[-1] :]], [np.zeros(1, np.int64)], table.num_rows - new[-1]
            else:
                held.append(table)
                size += table.num_rows
            last = (table.column("l")[-1].as_py(), rows[-1])
        if held:
            yield measured(pa.concat_tables(held), np.concatenate(starts))

    dealt = near.repartition("l", "rows").sortWithinPartitions("l", "rows")
    # written once: both the largest distances and the result read it
    dist = materialise(dealt.mapInArrow(measure, f"r long, c long, l {kind}, d double"), "distances")
    top = dist.groupBy("l").agg(F.max("d").alias("most")).hint(BY_SORT)
    return dist.join(top, "l").select("r", "c", F.col("l").alias(label), (F.col("d") / F.col("most")).alias("dist"))


def proximity(df: DataFrame, value: str, cell: float, reach: int) -> DataFrame:
    """(r, c, dist): distance in map units to the nearest cell equal to 1; NULL beyond `reach` cells.

    In two passes: a 1 reaches along its column first, then what has come to a row
    reaches along it, so a cell is copied about four times the reach, not its square.
    """
    ones = df.filter(F.col(value) == 1).select("r", "c", F.lit(0).cast("long").alias("d2"))
    for along in ("r", "c"):
        step = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
        spaced = ones.withColumn("k", step).withColumns({along: F.col(along) + F.col("k"), "d2": F.col("d2") + F.col("k") * F.col("k")})
        ones = spaced.filter(F.col("d2") <= reach * reach).groupBy("r", "c").agg(F.min("d2").alias("d2"))
    return df.select("r", "c").join(ones, ["r", "c"], "left").select("r", "c", (F.sqrt("d2") * cell).alias("dist"))
