"""Quantile-stratified and proportional sampling, splits, and chip selection.

Draws are ranks by an order column: a hash of the id and a seed by default, or the id
itself where a result must be reproducible in any engine.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.session import materialise


def draw_order(ident: str, seed: int | None) -> Column:
    return F.col(ident) if seed is None else F.xxhash64(F.col(ident), F.lit(seed))


class Counted:
    """The distinct values of a column with their counts, in ranges and written once, for exact quantiles of any size.

    Sums per range place each wanted rank, and at most two values a share come to the
    driver. The built-in percentile would hold all distinct values in one task.
    """

    def __init__(self, df: DataFrame, value: str):
        counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.dealt = materialise(counted.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "quantiles")

    def quantiles(self, shares: list[float], above: float | None = None) -> list[float | None]:
        """Quantiles, interpolated linearly, of the values above a limit; None if there are none."""
        dealt = self.dealt if above is None else self.dealt.filter(F.col("v") > above)
        sums = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()}
        total = sum(sums.values())
        if not total:
            return [None] * len(shares)
        at = [q * (total - 1) for q in shares]
        ranks = sorted({r for x in at for r in (int(x), min(int(x) + 1, total - 1))})
        before, wanted = 0, []
        for part in sorted(sums):  # parts are in the order of values
            wanted += [(part, r - before, r) for r in ranks if before <= r < before + sums[part]]
            before += sums[part]
        inside = dealt.filter(F.col("part").isin(*{w[0] for w in wanted})).withColumn("upto", F.sum("n").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
        ask = dealt.sparkSession.createDataFrame(wanted, "part int, place long, rank long")
        hits = inside.join(F.broadcast(ask), "part").filter((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
        found = {r["rank"]: r["v"] for r in hits.select("rank", "v").collect()}
        low = [found[int(x)] for x in at]
        high = [found[min(int(x) + 1, total - 1)] for x in at]
        return [a + (b - a) * (x - int(x)) for a, b, x in zip(low, high, at)]


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated linearly, of a column of any size; NULLs don't count, no values give None."""
    return Counted(df, value).quantiles(shares)


def _edges(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def quantile_edges(df: DataFrame, size: str, bins: int) -> list[float]:
    """Interpolated quantiles of size at 0, 1/bins ... 1; a bounded row to the driver."""
    return quantiles(df, size, _edges(bins))


def distinct_edges(df: DataFrame, size: str, bins: int, start: float) -> list[float]:
    """Edges after raising the least size by ones until all are distinct.

    The table is counted once. A raise that excludes no further value changes nothing,
    so the minimum goes at once to the next whole step that does.
    """
    counted, least = Counted(df, size), start
    while True:
        edges = counted.quantiles(_edges(bins), least)
        if edges[0] is None:
            raise ValueError("no minimum size gives distinct quantile edges")
        if len(set(edges)) == len(edges):
            return edges
        least += max(1, ceil(edges[0] - least))


def bucket(size: str, edges: list[float], closed: str = "right") -> Column:
    """Bin number 0 .. len(edges) - 2, NULL outside; left-open bins (closed right) or right-open ones."""
    out = F.when(F.lit(False), F.lit(0))
    for i in range(len(edges) - 1):
        low, high = edges[i], edges[i + 1]
        inside = (F.col(size) > low) & (F.col(size) <= high) if closed == "right" else (F.col(size) >= low) & (F.col(size) < high)
        out = out.when(inside, F.lit(i))
    return out


def _first_per(df: DataFrame, keys: list[str], order: list[Column], k: Column | int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def _drawn(binned: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each bin: a bin is a tenth of all rows, so ranks are dealt by ranges."""
    return ranked(binned, ["bin"], order, "_place").filter(F.col("_place") <= k).drop("_place")


def sample_by_decile(df: DataFrame, ident: str, size: str, n: int, bins: int = 10, start: float = 0, seed: int | None = None) -> DataFrame:
    """n / bins rows of every size decile (fewer if a decile is smaller), with their bin."""
    edges = distinct_edges(df, size, bins, start)
    binned = df.withColumn("bin", bucket(size, edges)).filter("bin IS NOT NULL")
    return _drawn(binned, [draw_order(ident, seed), F.col(ident)], n // bins)


def sample_per_decile(df: DataFrame, ident: str, size: str, n: int, bins: int = 10, seed: int | None = None) -> DataFrame:
    """n rows of each equal-frequency bin; the least size belongs to the first."""
    edges = quantile_edges(df, size, bins)
    binned = df.withColumn("bin", F.coalesce(bucket(size, edges), F.when(F.col(size) == edges[0], 0)))
    return _drawn(binned, [draw_order(ident, seed), F.col(ident)], n)


def allocate(df: DataFrame, region: str, total: int) -> DataFrame:
    """Per region its rows and ceil(share * total)."""
    counts = df.groupBy(region).agg(F.count(F.lit(1)).alias("n"))
    all_rows = counts.agg(F.sum("n").alias("all_n"))
    return counts.crossJoin(F.broadcast(all_rows)).select(region, "n", F.ceil(F.col("n") * total / F.col("all_n")).cast("long").alias("quota"))


def group_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, e): quantiles of value at the shares, interpolated linearly, of each group, whatever its size. NULL keys are a group."""
    kept = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    places = sizes.select(*keys, F.posexplode(F.transform(F.array(*(F.lit(float(q)) for q in shares)), lambda q: q * (F.col("_n") - 1))).alias("_i", "_at"))
    asked = places.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_i", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    at = ranked(kept, keys, [F.col("_v")], "_place").withColumn("_place", F.col("_place") - 1)
    same = F.col("_rank") == F.col("_place")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ends = at.join(asked, same).groupBy(*keys, "_i", "_at").agg(F.min_by("_v", "_rank").alias("_low"), F.max_by("_v", "_rank").alias("_high"))
    edge = F.struct("_i", (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias("e"))
    return ends.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(edge)), lambda x: x["e"]).alias("e"))


def group_edges(df: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """(group, e): interpolated quantiles of value at 0, 1/bins ... 1 of each group, whatever its size."""
    return group_quantiles(df, [group], value, [i / bins for i in range(bins + 1)])


def sample_chips(df: DataFrame, region: str, ident: list[str], classes: list[str], total: int, bins: int = 5, close_last: bool = False) -> DataFrame:
    """Chips per region in proportion to its size, spread over quintiles of each class in turn.

    Each class takes quota / bins / len(classes) chips per quintile [lo, hi); what one
    class has drawn is no longer in the pool of the next. The last quintile leaves the
    maximum out unless close_last. Quantiles and draws are ranks dealt by ranges, so a
    region may hold any share of the chips.
    """
    pool, drawn = df.join(allocate(df, region, total).select(region, "quota"), region), None
    for cls in classes:
        with_edges = pool.join(group_edges(pool, region, cls, bins), region)
        inside = F.filter(
            F.sequence(F.lit(0), F.lit(bins - 1)),
            lambda i: (F.col(cls) >= F.get("e", i)) & ((F.col(cls) < F.get("e", i + 1)) | (F.lit(close_last) & (i == bins - 1) & (F.col(cls) == F.get("e", i + 1)))),  # noqa: B023
        )
        binned = with_edges.withColumn("bin", F.get(inside, F.lit(0))).filter("bin IS NOT NULL").drop("e")
        share = F.floor(F.col("quota") / bins / len(classes))
        placed = ranked(binned, [region, "bin"], [F.col(i) for i in ident], "_place")
        took = materialise(placed.filter(F.col("_place") <= share).drop("_place").withColumn("drawn_for", F.lit(cls)), "drawn")
        drawn = took if drawn is None else drawn.unionByName(took)
        pool = pool.join(took.select(region, *ident), [region, *ident], "left_anti")
    return drawn.drop("quota")


def chip_stats(df: DataFrame, size: int, layers: list[str]) -> DataFrame:
    """Non-zero cells per chip and layer; chips with a negative or NULL input are rejected."""
    bad = F.lit(False)
    for v in layers:
        bad = bad | F.col(v).isNull() | (F.col(v) < 0)
    chip = [F.floor(F.col(k) / size).cast("long").alias(f"chip_{k}") for k in ("r", "c")]
    return df.groupBy(*chip).agg(*(F.count_if(F.col(v) != 0).alias(f"n_{v}") for v in layers), F.bool_or(bad).alias("bad")).filter("NOT bad").drop("bad")


def sample_empty(df: DataFrame, keys: list[str], count: str, share: float) -> DataFrame:
    """A share (rounded down, at least one if there are any) of the chips whose every layer is empty."""
    chips = df.groupBy(*keys).agg(F.max(count).alias("most"))
    total = chips.agg(F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(1)).alias("k"))
    empty = chips.filter("most = 0").drop("most")
    # a global rank without one task for all rows: per-partition counts of a range sort would do; k is small, so a sort with a limit is a top-k
    k = total.first()["k"]
    return empty.orderBy(*keys).limit(int(k))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Column `name`: the row's number within its group, from 1, for groups of any size.

    Rows are dealt by ranges of group and order and numbered within each range and group; the
    ranges' counts, a small table, place them. No group is in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = [F.col(k) for k in keys]
    dealt = materialise(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    inner = W.partitionBy("_part", *keys)
    counts = dealt.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("_part").alias("_p"), "_before", *(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    out = dealt.withColumn("_rank", F.row_number().over(inner.orderBy(*order))).join(before, same)
    return out.withColumn(name, F.col("_rank") + F.col("_before")).select(*df.columns, name)


def split(df: DataFrame, ratio: float, strata: list[str], order: list[Column]) -> DataFrame:
    """Column part: train for the first int(n * ratio) rows of each stratum, hold for the others."""
    placed = ranked(df, strata, order, "_place")
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size")).select("_size", *(F.col(k).alias(f"_s{i}") for i, k in enumerate(strata)))
    same = F.lit(True)
    for i, k in enumerate(strata):
        same = same & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    joined = placed.join(sizes, same)
    return joined.withColumn("part", F.when(F.col("_place") <= F.floor(F.col("_size") * ratio), "train").otherwise("hold")).select(*df.columns, "part")


def drop_outer_chips(df: DataFrame, has_border: str, row: str = "chip_r", col: str = "chip_c") -> DataFrame:
    """Drop, from each of the four sides of every chip row and column, the chips up to and with the first border chip."""
    flags = []
    for across, along, up in ((row, col, True), (row, col, False), (col, row, True), (col, row, False)):
        order = F.col(along).asc() if up else F.col(along).desc()
        w = W.partitionBy(across).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        flags.append(F.coalesce(F.max(F.col(has_border).cast("int")).over(w), F.lit(0)) == 0)
    out = df.withColumns({f"_f{i}": f for i, f in enumerate(flags)})
    return out.filter("NOT (_f0 OR _f1 OR _f2 OR _f3)").drop("_f0", "_f1", "_f2", "_f3")


def top1(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _first_per(df, keys, order, 1)


def best_with_ties(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that reach their group's maximum."""
    best = df.groupBy(*keys).agg(F.max(value).alias("_best"))
    return df.join(best, keys).filter(F.col(value) == F.col("_best")).drop("_best")


def drop_worst_duplicate(df: DataFrame, ident: str, value: str, mode: str = "faithful") -> DataFrame:
    """faithful: of all rows whose id repeats, the single one with the least value goes. dedup: each id keeps its best row."""
    if mode == "dedup":
        return top1(df, [ident], [F.col(value).desc(), *(F.col(c) for c in df.columns if c not in (ident, value))])
    repeated = df.groupBy(ident).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(ident)
    worst = df.join(repeated, ident, "left_semi").orderBy(value, *(c for c in df.columns if c != value)).limit(1)
    return df.exceptAll(worst.select(*df.columns))


def order_by_suffix(df: DataFrame, name: str) -> DataFrame:
    """Rows in the order of the number at the end of a name."""
    return df.orderBy(F.regexp_extract(name, r"(\d+)$", 1).try_cast("long"), name)


def shuffle_pairs(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that a seed fixes: by digests of seed and key."""
    return df.orderBy(*shuffle_order(key, seed))


def shuffle_order(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]
