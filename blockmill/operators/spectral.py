"""Spectral clustering of centres and of sample blocks, and anchor labelling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.functions.vectors import array_to_vector
from blockmill.operators import lloyd
from blockmill.operators.blocks import BLOCK
from blockmill.operators.neighbours import knn_label, nearest_within
from blockmill.operators.subspace import leading_vectors
from blockmill.runtime import store, store_counted

#: Most centres that are clustered; they are model parameters, and each is compared with all.
MAX_CENTRES = 2_000

#: Similarities below this are taken for 0.
_LEAST = 1e-12


def gaussian_laplacian(centres: DataFrame) -> DataFrame:
    """(g, i, j, w) of ``I - 2 L / c``: L is the plain Laplacian of the similarities
    ``exp(-d^2 / 2)`` and c an upper bound of its eigenvalues, so that the smallest
    ones of L are the largest here and all lie in [-1, 1].

    ``centres`` is (id, vec), ``MAX_CENTRES`` rows at most, which are shipped to
    the tasks that compare their share of them with all.
    """
    rows = centres.collect()
    shared = centres.sparkSession.sparkContext.broadcast(
        (np.array([r["id"] for r in rows]), np.array([r["vec"] for r in rows], dtype=np.float64))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        for batch in batches:
            for i, vec in zip(batch["id"], batch["vec"]):
                s = np.exp(-((vectors - np.array(vec)) ** 2).sum(axis=1) / 2)
                kept = (s > _LEAST) & (ids != i)
                yield pd.DataFrame({"i": i, "j": ids[kept], "s": s[kept]})

    similar = store(centres.mapInPandas(compare, "i bigint, j bigint, s double"), "similar")
    degree = similar.groupBy("i").agg(F.sum("s").alias("d"))
    bound = 2 * (degree.agg(F.max("d")).first()[0] or 1.0)
    g = F.lit(0).cast("bigint").alias("g")
    # Sums of degrees differ in the last digits from run to run; nine are kept.
    off = similar.select(g, "i", "j", F.round(2 * F.col("s") / bound, 12).alias("w"))
    alone = centres.select(F.col("id").alias("i")).join(degree, "i", "left")
    on = alone.select(g, "i", F.col("i").alias("j"), F.round(1 - 2 * F.coalesce("d", F.lit(0.0)) / bound, 12).alias("w"))
    return off.unionByName(on)


def _clustered(entries: DataFrame, nodes: DataFrame, k: int, seed: int) -> DataFrame:
    """(g, id, prediction): k-means on the rows of the leading vectors."""
    vectors, _ = leading_vectors(entries, nodes, k)
    rows = store(vectors.select("g", F.col("i").alias("id"), "vec"), "embedded")
    centres = lloyd.kmeans(rows, k, group="g", seed=seed, start="spread")
    labelled = store(lloyd.with_own_label(rows, centres, "g").select("g", "id", "prediction"), "clustered")
    return lloyd.by_smallest_member(labelled, "prediction", "g")


def spectral_gaussian(centres: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(id, prediction) for a set of centres (id, vec).

    Similarity ``exp(-d^2 / 2)``, plain Laplacian, ``k`` smallest eigenvectors,
    k-means. Centres are model parameters: their number is a setting, at most
    ``MAX_CENTRES``, and does not grow with the data. Clusters are numbered by
    their smallest member; equal calls give equal numbers.
    """
    given = centres.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    stored, n = store_counted(given, "centres")
    if n > MAX_CENTRES:
        raise ValueError(f"{n} centres; at most {MAX_CENTRES} are compared with each other")
    nodes = stored.select(F.lit(0).cast("bigint").alias("g"), F.col("id").alias("i"))
    return _clustered(gaussian_laplacian(stored), nodes, k, seed).select("id", "prediction")


#: Digits of a weight that are kept; sums of parts differ in the last ones.
_DIGITS = 9


def adaptive_similarity(df: DataFrame, k_max: int = 30, group: str = "block_id") -> DataFrame:
    """(g, i, j, w): weights to the ``k_max`` nearest rows of the same block.

    ``w = max((S - (k_max - 1) d) / S, 0)`` with d the squared distance and S
    the sum of the ``k_max`` smallest ones. Sparse: ``k_max`` entries per row.
    """
    found = nearest_within(df, group, k_max)
    total = F.aggregate("hits", F.lit(0.0), lambda acc, x: acc + x["sq_dist"])
    return found.select(
        "g", F.col("q").alias("i"), total.alias("s"), F.explode("hits").alias("hit")
    ).select(
        "g",
        "i",
        F.col("hit.id").alias("j"),
        F.greatest(
            F.coalesce(
                F.try_divide(F.col("s") - (k_max - 1) * F.col("hit.sq_dist"), F.col("s")), F.lit(0.0)
            ),
            F.lit(0.0),
        ).alias("w"),
    )


def normalised_similarity(weights: DataFrame) -> DataFrame:
    """Symmetric mean of the weights, then ``D^-1/2 S D^-1/2``."""
    both = weights.select("g", "i", "j", "w").unionByName(
        weights.select("g", F.col("j").alias("i"), F.col("i").alias("j"), "w")
    )
    sym = both.groupBy("g", "i", "j").agg((F.sum("w") / 2.0).alias("w")).where("w > 0")
    degree = sym.groupBy("g", "i").agg(F.sum("w").alias("d"))
    return (
        sym.join(degree.withColumnRenamed("d", "di"), ["g", "i"])
        .join(degree.select("g", F.col("i").alias("j"), F.col("d").alias("dj")), ["g", "j"])
        .select("g", "i", "j", (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))
    )


def spectral_adaptive(df: DataFrame, k: int, k_max: int = 30, group: str = BLOCK, seed: int = 1) -> DataFrame:
    """(block, id, prediction) for the rows (block, id, vec), every block by itself
    and all at once.

    The similarity is a sparse table of at most ``2 k_max`` entries per row. The
    rows of its ``k`` leading eigenvectors are clustered. Clusters are numbered by
    their smallest member; equal calls give equal numbers.
    """
    rows = store(
        df.select(
            F.col(group).cast("bigint").alias(BLOCK), F.col("id").cast("bigint").alias("id"),
            F.col("vec").cast("array<double>").alias("vec"),
        ).where(f"{BLOCK} IS NOT NULL AND vec IS NOT NULL"),
        "rows",
    )
    near = store(adaptive_similarity(rows, k_max), "near")
    weights = normalised_similarity(near).withColumn("w", F.round("w", _DIGITS))
    nodes = rows.select(F.col(BLOCK).alias("g"), F.col("id").alias("i"))
    found = _clustered(weights, nodes, k, seed)
    return found.select(F.col("g").cast(df.schema[group].dataType).alias(group), "id", "prediction")


def anchor_labels(
    df: DataFrame, labelled: DataFrame, k: int, per_cluster: int = 10, steps: int = 100, seed: int = 42
) -> DataFrame:
    """(id, label) for every row of ``df`` through ``per_cluster * k`` anchors.

    ``df`` has id, vec; ``labelled`` also has label. The anchors are k-means
    centres of the labelled rows, named after their nearest labelled row; rows
    then take the name of their nearest anchor.
    """
    together = labelled.select(F.lit(0).alias("g"), "id", "vec")
    centres = lloyd.kmeans(together, k * per_cluster, steps=steps, tol=0.0, group="g", seed=seed)
    anchors = store(centres.select(F.col("cluster").cast("bigint").alias("id"), F.col("centre").alias("vec")), "anchors")
    named = knn_label(anchors, labelled.select("id", "vec", "label"))
    names = dict(named.collect())
    ordered = F.array(*(F.lit(names.get(i)) for i in range(k * per_cluster)))
    nearest = lloyd.with_own_label(df.select("id", "vec", F.lit(0).alias("g")), centres, "g")
    return nearest.select("id", F.get(ordered, F.col("prediction")).alias("label"))


def as_vectors(df: DataFrame, column: str = "vec", into: str = "features") -> DataFrame:
    """Add the pyspark.ml form of an array column."""
    return df.withColumn(into, array_to_vector(F.col(column).cast("array<double>")))
