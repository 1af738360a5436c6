"""Agreement of a clustering with known labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def purity(df: DataFrame) -> DataFrame:
    """Share of rows that carry the commonest label of their cluster."""
    clusters = _cells(df).groupBy("prediction").agg(
        F.max("n").alias("top"), F.sum("n").alias("n")
    )
    return clusters.agg((F.sum("top") / F.sum("n")).alias("purity"))


def nmi(df: DataFrame) -> DataFrame:
    """Mutual information over the root of both entropies; 0 if either is 0.

    With ``S = sum(n ln n)`` over cells, labels and clusters, the entropies are
    ``ln N - S / N`` and the mutual information is
    ``(S_cells - S_labels - S_clusters) / N + ln N``: one pass over the
    contingency table, no joins.
    """
    table = _cells(df)
    sides = table.groupingSets(
        [["label", "prediction"], ["label"], ["prediction"]], "label", "prediction"
    ).agg(F.grouping_id().alias("side"), F.sum("n").alias("n"))
    # grouping_id: 0 = cells, 1 = labels (prediction folded), 2 = clusters
    weight = F.col("n") * F.log("n")
    sums = sides.agg(
        *(F.sum(F.when(F.col("side") == i, weight)).alias(f"s{i}") for i in range(3)),
        *(F.count_if(F.col("side") == i).alias(f"c{i}") for i in (1, 2)),
        F.sum(F.when(F.col("side") == 1, F.col("n"))).alias("total"),
    )
    log_total = F.log("total")
    h_label = log_total - F.col("s1") / F.col("total")
    h_cluster = log_total - F.col("s2") / F.col("total")
    mutual = (F.col("s0") - F.col("s1") - F.col("s2")) / F.col("total") + log_total
    flat = (F.col("c1") < 2) | (F.col("c2") < 2)
    return sums.select(
        F.when(flat, 0.0).otherwise(mutual / F.sqrt(h_label * h_cluster)).alias("nmi")
    )
