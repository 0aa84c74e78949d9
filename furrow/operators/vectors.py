"""Parcels as rings of points: edges, rasterising, polygonising, overlay."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from furrow.operators.focal import FOUR, spread
from furrow.operators.graph import connected_components
from furrow.operators.labels import field_distance
from furrow.operators.sampling import ranked
from furrow.session import BY_SORT, materialise


def box_ring(x0: str, y0: str, x1: str, y1: str):
    """The closed ring of a box as an array of points."""
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners))


def polygon_edges(df: DataFrame, ident: str, ring: str = "ring") -> DataFrame:
    """One row per ring segment (id, seg, x0, y0, x1, y1); NULL or one-point rings give none."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))).alias("b"))
    rows = df.filter(F.size(ring) > 1).select(ident, F.posexplode(pairs).alias("seg", "e"))
    return rows.select(ident, "seg", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))


def rasterise_lines(edges: DataFrame, ident: str, cell: float, all_touched: bool = True) -> DataFrame:
    """Distinct (id, r, c) of cells that segments cross (all_touched), or whose cell a segment's sampled centre line enters."""
    return _crossed(edges, ident, cell, all_touched).distinct()


def _crossed(edges: DataFrame, ident: str, cell: float, all_touched: bool = True) -> DataFrame:
    """rasterise_lines with a row for each piece of a segment.

    A segment is cut at every grid line it crosses; each piece lies in one cell, that of
    its middle. Without all_touched, pieces shorter than half a cell drop.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")

    def cuts(a, b):
        low, high = F.ceil(F.least(a, b) / cell).cast("int"), F.floor(F.greatest(a, b) / cell).cast("int")
        lines = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.when(a == b, F.array().cast("array<double>")).otherwise(F.transform(lines, lambda k: (k * F.lit(float(cell)) - a) / (b - a)))

    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts(F.col("x0"), F.col("x1")), cuts(F.col("y0"), F.col("y1")))))
    pieces = edges.withColumn("t", at).withColumn("p", F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("a"), F.slice("t", 2, F.size("t") - 1).alias("b"))))
    # 0.0 and -0.0 are different cuts, but nothing lies between them
    pieces = pieces.filter(F.col("p.b") > F.col("p.a"))
    mid = (F.col("p.a") + F.col("p.b")) / 2
    size = (F.col("p.b") - F.col("p.a")) * F.sqrt(dx * dx + dy * dy)
    kept = pieces if all_touched else pieces.filter(size >= cell / 2)
    return kept.select(ident, F.floor((F.col("y0") + mid * dy) / cell).cast("long").alias("r"), F.floor((F.col("x0") + mid * dx) / cell).cast("long").alias("c"))


def rasterise_polygons(df: DataFrame, ident: str, cell: float, ring: str = "ring", order: str | None = None) -> DataFrame:
    """(r, c, id): cells whose centre is inside a polygon by the even-odd rule; the highest order (id) overwrites.

    Each polygon's box is exploded into rows only; per row its edge crossings are sorted
    and the cell runs between odd and even ones are exploded.
    """
    order = order or ident
    cells = _every_cell(df, ident, cell, ring)
    if order != ident:
        cells = cells.join(df.select(ident, order), ident)
    return cells.groupBy("r", "c").agg(F.max_by(ident, F.struct(order, ident)).alias(ident))


def subtract_lines(mask: DataFrame, lines: DataFrame) -> DataFrame:
    return mask.join(lines.select("r", "c").distinct(), ["r", "c"], "left_anti")


def label_stack(df: DataFrame, ident: str, cell: float, ring: str = "ring") -> DataFrame:
    """(r, c, extent, edge, dist) of parcels: area less dilated borders, borders dilated by 2x2, normalised distance inside.

    Areas and borders meet by one aggregation over the cells. Cells of a parcel with a NULL id have distance 0.
    """
    area = _every_cell(df, ident, cell, ring).select("r", "c", ident, F.lit(1).alias("area"), F.lit(1).alias("own"))
    grown = spread(_crossed(polygon_edges(df, ident, ring), ident, cell).select("r", "c"), [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 0)], {})
    marks = area.unionByName(grown.select("r", "c", F.lit(1).alias("edge"), F.col("w0").cast("int").alias("own")), allowMissingColumns=True)
    cells = marks.groupBy("r", "c").agg(F.max(ident).alias(ident), *(F.coalesce(F.max(k), F.lit(0)).alias(k) for k in ("area", "edge")), F.max("own").alias("own"))
    # written once: both the distances and the result read it; borders grow inside the cells that parcels have
    cells = materialise(cells.filter("own = 1").select("r", "c", ident, F.when(F.col("edge") == 0, F.col("area")).otherwise(0).alias("extent"), "edge"), "stack")
    measured = (F.col("extent") == 1) & F.col(ident).isNotNull()
    dist = field_distance(cells.filter(measured), ident).select("r", "c", F.lit(1).alias("extent"), F.lit(0).alias("edge"), "dist")
    return cells.filter(~measured).select("r", "c", "extent", "edge", F.lit(0.0).alias("dist")).unionByName(dist)


def polygonise(df: DataFrame, label: str, cell: float) -> DataFrame:
    """Per label but 0: cells, area in hectares, box in map units, perimeter, boundary faces."""
    own = df.filter(F.col(label) != 0).select("r", "c", F.col(label).alias("l"))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in FOUR))
    # a face is named by the doubled coordinates of its middle: two cells of one label share it
    faces = own.select("l", F.explode(steps).alias("o"), "r", "c").select("l", (2 * F.col("r") + F.col("o.i")).alias("fr"), (2 * F.col("c") + F.col("o.j")).alias("fc"))
    once = faces.groupBy("l", "fr", "fc").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").groupBy("l").agg(F.count(F.lit(1)).alias("faces"))
    shape = own.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return shape.join(once, "l").select(
        F.col("l").alias(label),
        F.col("n").alias("n_cells"),
        (F.col("n") * (cell * cell / 10000)).alias("area_ha"),
        (F.col("c0") * cell).alias("x0"),
        (F.col("r0") * cell).alias("y0"),
        ((F.col("c1") + 1) * cell).alias("x1"),
        ((F.col("r1") + 1) * cell).alias("y1"),
        (F.col("faces") * cell).alias("perimeter"),
        F.col("faces").alias("n_faces"),
    )


#: Side of a block whose faces one task strings together, in cells.
RING_BLOCK = 512
_SHIFT = 1 << 32
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_PIECE = "l long, head long, to long, closed boolean, low long, xs array<long>, ys array<long>"


def _next_faces(own: DataFrame) -> DataFrame:
    """(l, face, to, x0, y0): directed unit faces of each label's outline, and the face that follows each.

    The cell lies to the left. Where two parts of a label touch at a corner, the face that
    turns left most follows. A face is named by its start and its direction, which one label only has.
    """
    faces = F.array(*(F.struct(*((F.col("c" if i % 2 == 0 else "r") + d).alias(n) for i, (n, d) in enumerate(zip(("x0", "y0", "x1", "y1"), ends)))) for ends in ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))))
    every = own.select("l", F.inline(faces))
    # both cells of an inner face name it by its doubled middle
    key = [(F.col("x0") + F.col("x1")).alias("mx"), (F.col("y0") + F.col("y1")).alias("my")]
    once = every.groupBy("l", *key).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("x0", "y0", "x1", "y1")).alias("f")).filter("n = 1").select("l", "f.*")
    heading = F.when(F.col("x1") > F.col("x0"), 0).when(F.col("y1") > F.col("y0"), 1).when(F.col("x1") < F.col("x0"), 2).otherwise(3)
    name = (F.col("y0") * _SHIFT + F.col("x0")) * 4 + heading
    named = materialise(once.withColumn("face", name), "faces")
    after = named.select("l", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("face").alias("to"))
    turn = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y1")) - (F.col("y1") - F.col("y0")) * (F.col("x2") - F.col("x1"))
    return named.join(after, ["l", "x1", "y1"]).groupBy("l", "face", "x0", "y0").agg(F.max_by("to", turn).alias("to"))


def _strung(table: pa.Table) -> pa.Table:
    """Pieces of outline inside one block: chains of faces, and whole rings; of their points only those where the heading changes."""
    face, to, xs, ys = (table.column(k).to_pylist() for k in ("face", "to", "x0", "y0"))
    at = {f: i for i, f in enumerate(face)}
    after = [at.get(t, -1) for t in to]
    led = set(after)
    heads = [i for i in range(len(face)) if i not in led]
    seen = bytearray(len(face))
    out = []
    for i in [*heads, *sorted(range(len(face)), key=lambda i: (xs[i], ys[i]))]:
        if seen[i]:
            continue
        chain = []
        while i >= 0 and not seen[i]:
            seen[i] = 1
            chain.append(i)
            i = after[i]
        bends = [k for n, k in enumerate(chain) if n == 0 or face[k] % 4 != face[chain[n - 1]] % 4]
        low = min(xs[k] * _SHIFT + ys[k] for k in bends)
        out.append((table.column("l")[0].as_py(), face[chain[0]], to[chain[-1]], i >= 0, low, [xs[k] for k in bends], [ys[k] for k in bends]))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES, strict=True)], schema=_PIECES)


_PIECES = pa.schema([("l", pa.int64()), ("head", pa.int64()), ("to", pa.int64()), ("closed", pa.bool_()), ("low", pa.int64()), ("xs", pa.list_(pa.int64())), ("ys", pa.list_(pa.int64()))])


def _places(links: DataFrame) -> DataFrame:
    """(head, left): pieces from each one to the end of its list, itself included, by pointer doubling over (head, to).

    Each round writes a row a piece, and pointers jump twice as far as in the one before;
    only one boolean a round comes to the driver.
    """
    now = materialise(links.withColumn("left", F.lit(1).cast("long")), "list")
    while not now.filter("to IS NOT NULL").isEmpty():
        jump = now.select(F.col("head").alias("to"), F.col("to").alias("further"), F.col("left").alias("more"))
        now = materialise(now.join(jump, "to", "left").select("head", F.col("further").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "list")
    return now.select("head", "left")


def label_rings(df: DataFrame, label: str, cell: float, block: int = RING_BLOCK) -> DataFrame:
    """(label, ring no, ring): closed outlines of every label but 0, from its least point (x, then y) on; rings count in the order of these.

    Faces between two cells of a label drop, blocks string their faces together, and
    pieces of blocks are put in order by list ranking: no task holds more than a
    block's faces of a label, but for the row of a finished ring with its corners.
    """
    own = df.filter(F.col(label) != 0).select(F.col(label).cast("long").alias("l"), F.col("r").cast("long"), F.col("c").cast("long"))
    dealt = _next_faces(own).groupBy("l", F.floor(F.col("y0") / block), F.floor(F.col("x0") / block))
    pieces = materialise(dealt.applyInArrow(_strung, _PIECE), "pieces")
    open_ = pieces.filter("NOT closed").select("head", "to")
    rings = connected_components(open_, "head", "to").select(F.col("node").alias("head"), F.col("component").alias("ring"))
    pieces = pieces.join(rings, "head", "left").withColumn("ring", F.coalesce("ring", "head"))
    first = materialise(pieces.groupBy("l", "ring").agg(F.min(F.struct("low", "head")).alias("m")).select("l", "ring", F.col("m.low").alias("least"), F.col("m.head").alias("start")), "rings")
    cut = pieces.filter("NOT closed").join(first.select("ring", "start"), "ring").select("head", F.when(F.col("to") != F.col("start"), F.col("to")).alias("to"))
    placed = pieces.join(_places(cut), "head", "left").withColumn("place", -F.coalesce("left", F.lit(1)))
    whole = placed.groupBy("l", "ring").agg(F.array_sort(F.collect_list(F.struct("place", "xs", "ys"))).alias("p"))
    numbered = ranked(first, ["l"], [F.col("least")], "no").select("ring", "least", (F.col("no") - 1).cast("int").alias("ring_no"))
    schema = T.StructType([T.StructField(label, T.LongType()), T.StructField("ring_no", T.IntegerType()), T.StructField("ring", T.ArrayType(_POINT))])

    def close(batches):
        for batch in batches:
            rows = []
            for l, no, least, xs, ys in zip(*(batch.column(k).to_pylist() for k in ("l", "ring_no", "least", "xs", "ys")), strict=True):
                points = [*zip(xs, ys, strict=True)]
                start = points.index(divmod(least, _SHIFT))
                points = points[start:] + points[:start]
                kept = [p for o, p, q in zip([points[-1], *points], points, [*points[1:], points[0]]) if (p[0] - o[0]) * (q[1] - p[1]) != (p[1] - o[1]) * (q[0] - p[0])]
                rows.append({label: l, "ring_no": no, "ring": [{"x": float(x * cell), "y": float(y * cell)} for x, y in [*kept, kept[0]]]})
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

    flat = whole.join(numbered, "ring").select("l", "ring_no", "least", F.flatten(F.transform("p", lambda x: x["xs"])).alias("xs"), F.flatten(F.transform("p", lambda x: x["ys"])).alias("ys"))
    return flat.mapInArrow(close, schema)


def overlay_pairs(a: DataFrame, b: DataFrame, id_a: str, id_b: str, cell: float, ring: str = "ring") -> DataFrame:
    """Intersections of two polygon tables by common cells: areas, and overlaps relative to either side, 1 at most.

    The error of an area is of the order of its outline times the cell size. Polygons
    of one table that overlap each other all count.
    """
    runs_a, runs_b = _cell_runs(a, id_a, cell, ring), _cell_runs(b, id_b, cell, ring)
    length = F.sum(F.col("_high") - F.col("_low") + 1)
    size_a = runs_a.groupBy(id_a).agg(length.alias("n_a")).hint(BY_SORT)
    size_b = runs_b.groupBy(id_b).agg(length.alias("n_b")).hint(BY_SORT)
    both = _cells_of_runs(runs_a).join(_cells_of_runs(runs_b).hint(BY_SORT), ["r", "c"]).groupBy(id_a, id_b).agg(F.count(F.lit(1)).alias("n"))
    unit = cell * cell
    out = both.join(size_a, id_a).join(size_b, id_b)
    return out.select(
        id_a,
        id_b,
        (F.col("n") * unit).alias("area"),
        F.least(F.col("n") / F.col("n_a"), F.lit(1.0)).alias("overlap_a"),
        F.least(F.col("n") / F.col("n_b"), F.lit(1.0)).alias("overlap_b"),
        (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("iou"),
    )


def _boxes(df: DataFrame, ident: str, ring: str) -> DataFrame:
    """(id, ring, x0, y0, x1, y1, level): boxes with an inside; 2 ** level is the least power of two that the longer side does not exceed."""
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    box = df.filter(F.size(ring) > 3).select(F.col(ident).alias("id"), F.col(ring).alias("ring"), F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))
    return box.filter("x1 > x0 AND y1 > y0").withColumn("level", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).cast("int"))


def _placed(boxes: DataFrame, levels: Column, low: int, copies: bool) -> DataFrame:
    """Boxes at grid cells of each of the levels; salted where large boxes are few and small ones meet them in crowds."""
    at = boxes.drop("ring").withColumn("at", F.explode(levels))
    size = F.pow(F.lit(2.0), F.col("at"))
    for k in ("x", "y"):
        at = at.withColumn(f"b{k}", F.explode(F.sequence(F.floor(F.col(f"{k}0") / size).cast("long"), F.floor(F.col(f"{k}1") / size).cast("long"))))
    salts = F.pow(F.lit(4), F.least(F.col("at") - low, F.lit(3))).cast("int")
    return at.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)) if copies else F.pmod(F.xxhash64("id"), salts).cast("int"))


def box_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): ids of boxes (of _boxes) that overlap, each pair once.

    Boxes lie in the grid of their own size, at most nine cells each, and the smaller of two
    looks the larger up in its coarser grid: rows grow with the boxes and the number of
    sizes, not with areas. A pair counts in the cell of the least corner of its overlap.
    """
    ends = a.select("level").union(b.select("level")).agg(F.min("level"), F.max("level")).first()
    if ends[0] is None:
        return a.select(F.col("id").alias("a")).limit(0).join(b.select(F.col("id").alias("b")).limit(0))
    low, high = ends
    own = F.array("level")
    above = F.when(F.col("level") < high, F.sequence(F.col("level") + 1, F.lit(high))).otherwise(F.array().cast("array<int>"))
    upward = F.sequence(F.col("level"), F.lit(high))

    def met(large: DataFrame, small: DataFrame, levels: Column, names: tuple[str, str]) -> DataFrame:
        x = _placed(large, own, low, True)
        y = _placed(small, levels, low, False)
        y = y.select("at", "bx", "by", "salt", *(F.col(c).alias(f"o_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
        both = x.join(y.hint(BY_SORT), ["at", "bx", "by", "salt"]).filter("x0 < o_x1 AND o_x0 < x1 AND y0 < o_y1 AND o_y0 < y1")
        size = F.pow(F.lit(2.0), F.col("at"))
        corner = (F.floor(F.greatest("x0", "o_x0") / size) == F.col("bx")) & (F.floor(F.greatest("y0", "o_y0") / size) == F.col("by"))
        return both.filter(corner).select(F.col("id").alias(names[0]), F.col("o_id").alias(names[1]))

    return met(a, b, upward, ("a", "b")).unionByName(met(b, a, above, ("b", "a")))


def _sides(ring: str) -> Column:
    """Edges of a ring that are not vertical, from left to right; s tells those that were turned."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(ring, i).alias("p"), F.element_at(ring, i + 1).alias("q")))
    turned = F.transform(
        F.filter(edges, lambda e: e["p"]["x"] != e["q"]["x"]),
        lambda e: F.when(e["p"]["x"] < e["q"]["x"], F.struct(e["p"]["x"].alias("x0"), e["p"]["y"].alias("y0"), e["q"]["x"].alias("x1"), e["q"]["y"].alias("y1"), F.lit(1.0).alias("s"))).otherwise(
            F.struct(e["q"]["x"].alias("x0"), e["q"]["y"].alias("y0"), e["p"]["x"].alias("x1"), e["p"]["y"].alias("y1"), F.lit(-1.0).alias("s"))
        ),
    )
    return turned


def _below_both(e: Column, f: Column, base: Column) -> Column:
    """Signed area over the common x of two edges, above base and below both of them."""
    u, v = F.greatest(e["x0"], f["x0"]), F.least(e["x1"], f["x1"])
    height = lambda g, x: g["y0"] + (g["y1"] - g["y0"]) * ((x - g["x0"]) / (g["x1"] - g["x0"]))
    f_u, f_v = height(f, u), height(f, v)
    d_u, d_v = height(e, u) - f_u, height(e, v) - f_v
    n_u, n_v = F.least(d_u, F.lit(0.0)), F.least(d_v, F.lit(0.0))
    crossing = ((d_u < 0) & (d_v > 0)) | ((d_u > 0) & (d_v < 0))
    under = F.when(crossing, -(n_u + n_v) * (n_u + n_v) / (2 * F.abs(d_u - d_v))).otherwise((n_u + n_v) / 2)
    return e["s"] * f["s"] * (v - u) * ((f_u + f_v) / 2 - base + under)


def overlay_exact(a: DataFrame, b: DataFrame, id_a: str, id_b: str, ring: str = "ring") -> DataFrame:
    """Intersections of two tables of simple polygons by their exact areas, and overlaps relative to either side.

    What lies below one edge of either polygon adds up with the edges' signs to the common
    area, so each pair of overlapping boxes is measured by itself, in native array
    functions over its edges; the work of a pair is the product of its edges that share an
    x. Pairs that only touch are left out. NULL rings, and rings without an inside, meet nothing.
    """
    boxes = [_boxes(d, i, ring) for d, i in ((a, id_a), (b, id_b))]
    first, second = (x.select(F.col("id").alias(n), _sides("ring").alias(f"e_{n}"), F.col("x0").alias(f"x_{n}"), F.col("y0").alias(f"y_{n}"), _ring_area("ring").alias(f"size_{n}")) for x, n in zip(boxes, ("a", "b")))
    both = box_pairs(*boxes).join(first.hint(BY_SORT), "a").join(second.hint(BY_SORT), "b")

    def moved(edges: str) -> Column:
        """Edges seen from the corner of the first box, which loses no digits."""
        shift = lambda e: [(e[k] - F.col(f"{k[0]}_a")).alias(k) for k in ("x0", "y0", "x1", "y1")]
        return F.transform(edges, lambda e: F.struct(*shift(e), e["s"].alias("s")))

    both = both.withColumns({"e_a": moved("e_a"), "e_b": moved("e_b")})
    base = F.least(F.lit(0.0), F.col("y_b") - F.col("y_a"))
    near = lambda e: F.filter("e_b", lambda f: (f["x0"] < e["x1"]) & (f["x1"] > e["x0"]))
    area = F.abs(F.aggregate("e_a", F.lit(0.0), lambda t, e: t + F.aggregate(near(e), F.lit(0.0), lambda u, f: u + _below_both(e, f, base))))
    out = both.select("a", "b", "size_a", "size_b", area.alias("area")).filter(F.col("area") > 1e-9 * F.least("size_a", "size_b"))
    return out.select(
        F.col("a").alias(id_a),
        F.col("b").alias(id_b),
        "area",
        F.least(F.col("area") / F.col("size_a"), F.lit(1.0)).alias("overlap_a"),
        F.least(F.col("area") / F.col("size_b"), F.lit(1.0)).alias("overlap_b"),
        (F.col("area") / (F.col("size_a") + F.col("size_b") - F.col("area"))).alias("iou"),
    )


def _ring_area(ring: str) -> Column:
    """Area of a closed ring, from its first point on so that far-off coordinates lose no digits."""
    o = F.element_at(ring, 1)
    turn = lambda i: (F.element_at(ring, i)["x"] - o["x"]) * (F.element_at(ring, i + 1)["y"] - o["y"]) - (F.element_at(ring, i + 1)["x"] - o["x"]) * (F.element_at(ring, i)["y"] - o["y"])
    return F.abs(F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda t, i: t + turn(i))) / 2


def _every_cell(df: DataFrame, ident: str, cell: float, ring: str) -> DataFrame:
    """(id, r, c) of every polygon by itself."""
    return _cells_of_runs(_cell_runs(df, ident, cell, ring))


def _cells_of_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumn("c", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def _cell_runs(df: DataFrame, ident: str, cell: float, ring: str) -> DataFrame:
    """(id, r, _low, _high): runs of cells along rows of every polygon by itself."""
    edges = polygon_edges(df, ident, ring)
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(low / cell - 0.5).cast("int"), (F.ceil(high / cell - 0.5) - 1).cast("int")
    rows = edges.filter(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    y = (F.col("r") + 0.5) * cell
    x = F.col("x0") + (y - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    crossed = rows.groupBy(ident, "r").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    odd = F.filter(F.transform("xs", lambda v, i: F.struct(v.alias("v"), F.element_at("xs", F.least(i + 2, F.size("xs"))).alias("w"), i.alias("i"))), lambda s: s["i"] % 2 == 0)
    runs = crossed.select(ident, "r", F.explode(odd).alias("s"))
    a, b = F.ceil(F.col("s.v") / cell - 0.5).cast("int"), (F.ceil(F.col("s.w") / cell - 0.5) - 1).cast("int")
    return runs.filter(a <= b).select(ident, F.col("r").cast("long").alias("r"), a.cast("long").alias("_low"), b.cast("long").alias("_high"))
