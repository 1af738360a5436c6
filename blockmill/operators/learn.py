"""Judging block models, clusterings of all rows, and means per label."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockmill.functions.ranking import split_row_number
from blockmill.functions.vectors import vector_to_array
from blockmill.operators import lloyd
from blockmill.runtime import store


def trim_models(
    scores: DataFrame, key: str, score: str = "accuracy", cut: float = 0.1, stripes: int = 1000
) -> DataFrame:
    """Drop the worst and the best ``cut`` of the rows by a score in [0, 1].

    Counted from 0 in ascending order, ties by key (a number), the rows from ``cut * n`` to
    ``(1 - cut) * n - 1`` stay. How many rows have a smaller score is worked out
    over the distinct scores, cut into stripes; only rows of a score on which a
    limit falls are numbered, and one score that many rows share in stripes of
    its keys' range, so no task sorts them all.
    """
    counts = scores.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    stripe = F.floor(F.col("_s") * stripes)
    before = Window.partitionBy("_stripe").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy(stripe.alias("_stripe")).agg(F.sum("_c").alias("_n")).select(
        "_stripe",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias("_n"),
    )
    placed = store(
        counts.withColumn("_stripe", stripe)
        .withColumn("_within", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .join(F.broadcast(starts), "_stripe")
        .select("_s", "_c", "_n", (F.col("_start") + F.col("_within")).alias("_from")),
        "scores",
    )
    low, high = F.ceil(F.lit(cut) * F.col("_n")), F.floor(F.lit(1 - cut) * F.col("_n") - 1)
    last = F.col("_from") + F.col("_c") - 1
    inside = placed.where((F.col("_from") >= low) & (last <= high))
    # At most two scores are cut through, the one at either limit.
    split = placed.where(
        ((F.col("_from") < low) | (last > high)) & (last >= low) & (F.col("_from") <= high)
    )
    kept = scores.join(inside.select("_s"), scores[score].eqNullSafe(F.col("_s")), "left_semi")
    tied = scores.join(F.broadcast(split), scores[score].eqNullSafe(F.col("_s")))
    limits = tied.groupBy("_s").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    part = F.floor(F.try_divide(F.col(key) - F.col("_lo"), F.col("_hi") - F.col("_lo") + 1) * stripes)
    numbered = split_row_number(
        tied.join(F.broadcast(limits), "_s"), ["_s"], F.coalesce(part, F.lit(0)), [F.col(key)], "_row"
    )
    index = F.col("_from") + F.col("_row") - 1
    return kept.unionByName(numbered.where((index >= low) & (index <= high)).select(*scores.columns))


def cluster_global(df: DataFrame, k: int, kind: str = "mixture", seed: int = 9) -> DataFrame:
    """(label, prediction) from one clustering of all rows.

    ``kind`` is mixture, kmeans or bisecting; kmeans reads ``id`` and ``vec``,
    the others ``features``.
    """
    if kind == "kmeans":
        rows = df.withColumn("_all", F.lit(0))
        centres = lloyd.kmeans(rows, k, group="_all", seed=seed)
        return lloyd.with_own_label(rows, centres, "_all").select("label", "prediction")
    kinds = {"mixture": GaussianMixture, "bisecting": BisectingKMeans}
    if kind not in kinds:
        raise ValueError(f"kind must be one of kmeans, {', '.join(kinds)}, not {kind!r}")
    rows = df.select("label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = kinds[kind](k=k, seed=seed).fit(rows)
    finally:
        rows.unpersist()
    return model.transform(df).select("label", "prediction")


def group_mean_vector(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """(label, mean): mean vector per label, added up on the map side."""
    return df.groupBy(label).agg(
        vector_to_array(Summarizer.mean(F.col(features))).alias("mean")
    )
