"""Regression trees with linear leaves, one a scene, grown in Spark from histograms.

Each level reads the training cells once: weighted sums a bin, predictor and node give the
best split of every node of every scene at the same time. Only sums are shuffled, and no
rows, splits or models come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.operators.sampling import group_quantiles
from furrow.session import materialise


def leaf_of(splits: str, x: Column, depth: int) -> Column:
    """Number of the leaf that predictors x fall into: 1 is the root, and 2n and 2n + 1 lie below n."""
    node = F.lit(1)
    for _ in range(depth):
        at = F.try_element_at(F.col(splits), node)
        goes = F.get(x, at["feature"]) > at["threshold"]
        node = F.when(at.isNull(), node).otherwise(2 * node + goes.cast("int"))
    return node


def leaf_value(leaves: str, leaf: Column, x: Column) -> Column:
    """Prediction of a leaf's linear model, clipped to the range of its training cells."""
    model = F.try_element_at(F.col(leaves), leaf)
    value = F.aggregate(F.zip_with(F.concat(F.array(F.lit(1.0)), x), model["beta"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.least(value, model["hi"]), model["lo"])


def fit_tree(rows: DataFrame, predictors: list[str], keys: list[str], attach: Callable[[DataFrame, DataFrame], DataFrame], fit: Callable[..., DataFrame], depth: int = 4, bins: int = 32, least: int = 10) -> DataFrame:
    """(keys, splits, leaves) of each scene: splits node -> (feature, threshold), leaves node -> (lo, hi, beta).

    rows have mean_<predictor>, y and w. Splits lessen the weighted squared error of the
    leaves' means most, at quantiles of the scene's values (`bins` of them a predictor), with
    `least` cells on either side; of equal ones the first predictor's least threshold wins.
    x > threshold goes to the right. Leaves get weighted ridge models. attach(rows, table)
    joins a table of one row a scene to the rows; fit(rows, predictors, by, least) gives models.
    """
    means = [f"mean_{p}" for p in predictors]
    edges = None
    for i, mean in enumerate(means):
        one = group_quantiles(rows, keys, mean, [k / bins for k in range(1, bins)]).select(*keys, F.col("e").alias(f"_e{i}"))
        edges = one if edges is None else edges.join(one, keys)
    edges = materialise(edges.select(*keys, F.array(*(F.col(f"_e{i}") for i in range(len(means)))).alias("edges")), "edges")
    x = F.array(*means)
    placed = F.array(*(F.size(F.filter(F.get("edges", F.lit(i)), lambda e: e < F.col(mean))) for i, mean in enumerate(means)))  # noqa: B023
    cells = materialise(attach(rows, edges).withColumn("bins", placed).select(*rows.columns, "bins"), "binned")
    kind = "map<int,struct<feature:int,threshold:double>>"
    tree = edges.select(*keys, F.create_map().cast(kind).alias("splits"))
    for level in range(depth):
        at = attach(cells, tree).withColumn("node", leaf_of("splits", x, level)).filter(F.col("node") >= 1 << level)
        split = [*keys, "node", "feature"]
        sums = at.select(*keys, "node", "y", "w", F.posexplode("bins").alias("feature", "bin")).groupBy(*split, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
        whole, upto = W.partitionBy(*split), W.partitionBy(*split).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
        for c in ("n", "w", "s"):
            sums = sums.withColumns({f"{c}_l": F.sum(c).over(upto), f"{c}_all": F.sum(c).over(whole)}).withColumn(f"{c}_r", F.col(f"{c}_all") - F.col(f"{c}_l"))
        part = lambda side: F.col(f"s_{side}") * F.col(f"s_{side}") / F.nullif(F.col(f"w_{side}"), F.lit(0.0))
        gain = part("l") + part("r") - part("all")
        open_ = sums.filter((F.col("n_l") >= least) & (F.col("n_r") >= least)).withColumn("gain", gain).filter(F.col("gain") > 1e-9 * F.abs(part("all")))
        best = open_.groupBy(*keys, "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("m"))
        found = best.join(edges, keys).select(*keys, "node", F.struct((-F.col("m.f")).alias("feature"), F.get(F.get("edges", -F.col("m.f")), -F.col("m.b")).alias("threshold")).alias("at"))
        new = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("node", "at"))).cast(kind).alias("new"))
        tree = materialise(tree.join(new, keys, "left").select(*keys, F.when(F.col("new").isNull(), F.col("splits")).otherwise(F.map_concat("splits", "new")).alias("splits")), "tree")
    leaves = fit(attach(cells, tree).withColumn("leaf", leaf_of("splits", x, depth)), predictors, [*keys, "leaf"], 1)
    models = leaves.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("leaf", F.struct("lo", "hi", "beta")))).alias("leaves"))
    return tree.join(models, keys)
