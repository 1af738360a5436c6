"""Several clusterings of the same rows, held as ``id`` and ``labels`` (an array
with one cluster number per clustering).

Rows with the same ``labels`` are alike for everything here, so they are first
folded into *signatures* with a count; what follows grows with the number of
signatures and not with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.functions.vectors import majority
from blockmill.operators import lloyd
from blockmill.operators.blocks import BLOCK, blocks_at
from blockmill.operators.subspace import leading_vectors
from blockmill.runtime import store


#: Most centres of all clusterings together that are grouped; a setting, not data.
MAX_CENTRES = 2_000


def signatures(clusterings: DataFrame) -> DataFrame:
    """(labels, n)"""
    return clusterings.groupBy("labels").agg(F.count(F.lit(1)).alias("n"))


def one_hot_clusters(clusterings: DataFrame, k: int) -> DataFrame:
    """The points x (H k) 0/1 matrix as (id, col) for its ones; col = h k + c."""
    return clusterings.select("id", F.posexplode("labels").alias("h", "c")).select(
        "id", (F.col("h") * k + F.col("c")).alias("col")
    )


def _cells(clusterings: DataFrame) -> DataFrame:
    """(g, h, cg, ch, n): rows in cluster cg of clustering g and ch of h.

    Each signature makes H^2 cells, which are added up before the shuffle.
    """
    return (
        signatures(clusterings)
        .select("labels", "n", F.posexplode("labels").alias("g", "cg"))
        .select("g", "cg", "n", F.posexplode("labels").alias("h", "ch"))
        .groupBy("g", "h", "cg", "ch")
        .agg(F.sum("n").alias("n"))
    )


def coassociation(clusterings: DataFrame) -> DataFrame:
    """(labels_i, labels_j, n_i, n_j, share): how often points share a cluster.

    The points x points matrix is constant on pairs of signatures, so it is
    given per pair of signatures, with the number of points of each. Pairs that
    never share a cluster have share 0 and are left out.
    """
    long = signatures(clusterings).select(
        "labels", "n", F.size("labels").alias("total"), F.posexplode("labels").alias("h", "c")
    )
    i = long.select(
        "h", "c", "total", F.col("labels").alias("labels_i"), F.col("n").alias("n_i")
    )
    j = long.select("h", "c", F.col("labels").alias("labels_j"), F.col("n").alias("n_j"))
    return (
        i.join(j, ["h", "c"])
        .groupBy("labels_i", "labels_j", "n_i", "n_j", "total")
        .agg(F.count(F.lit(1)).alias("shared"))
        .select(
            "labels_i", "labels_j", "n_i", "n_j", (F.col("shared") / F.col("total")).alias("share")
        )
    )


def coassociation_of(pairs: DataFrame, clusterings: DataFrame) -> DataFrame:
    """Share for the pairs (i, j) asked for, without building the matrix."""
    left = clusterings.select(F.col("id").alias("i"), F.col("labels").alias("_li"))
    right = clusterings.select(F.col("id").alias("j"), F.col("labels").alias("_lj"))
    same = F.zip_with("_li", "_lj", lambda a, b: F.when(a == b, 1.0).otherwise(0.0))
    share = F.aggregate(same, F.lit(0.0), lambda total, x: total + x) / F.size("_li")
    return (
        pairs.join(left, "i").join(right, "j").withColumn("share", share).drop("_li", "_lj")
    )


def ensemble_distances(clusterings: DataFrame) -> DataFrame:
    """(h, distance): L1 distance of each clustering from the co-association mean.

    With M_h the 0/1 co-membership matrix of clustering h and B the mean of all,
    ``sum |M_h - B| = |M_h| - 2 <M_h, B> + |B|`` as B lies in [0, 1], and
    ``<M_g, M_h>`` is the sum of the squared cells of the contingency table of g
    and h. No pair of points is ever formed.
    """
    overlap = _cells(clusterings).groupBy("g", "h").agg(
        F.sum(F.col("n").cast("double") * F.col("n")).alias("s")
    )
    per = overlap.groupBy("h").agg(
        F.sum("s").alias("crossed"), F.max(F.when(F.col("g") == F.col("h"), F.col("s"))).alias("own")
    )
    # One entry per clustering.
    listed = per.agg(F.collect_list(F.struct("h", "own", "crossed")).alias("all"))
    mean = F.aggregate("all", F.lit(0.0), lambda total, x: total + x["own"]) / F.size("all")
    return listed.select(
        F.explode("all").alias("x"), mean.alias("mean"), F.size("all").alias("k")
    ).select(
        "x.h", (F.col("x.own") - 2 * F.col("x.crossed") / F.col("k") + F.col("mean")).alias("distance")
    )


def ensemble_pick(clusterings: DataFrame) -> DataFrame:
    """The clustering closest to the co-association mean, the first on a tie."""
    return ensemble_distances(clusterings).orderBy("distance", "h").limit(1)


def ncut_matrix(clusterings: DataFrame, n_clusterings: int, k: int) -> DataFrame:
    """(col_i, col_j, value) of ``A^T A``: the one-hot matrix B over ``sqrt(H)``
    with columns over ``sqrt(column sum + 1e-6)``; (H k)^2 entries at most."""
    cells = _cells(clusterings).select(
        (F.col("g") * k + F.col("cg")).alias("col_i"),
        (F.col("h") * k + F.col("ch")).alias("col_j"),
        "n",
    )
    sums = cells.where("col_i = col_j").select(F.col("col_i").alias("col"), F.col("n").alias("sum"))
    sums_i = sums.select(F.col("col").alias("col_i"), F.col("sum").alias("s_i"))
    sums_j = sums.select(F.col("col").alias("col_j"), F.col("sum").alias("s_j"))
    scale = F.sqrt((F.col("s_i") + 1e-6) * (F.col("s_j") + 1e-6))
    return (
        cells.join(sums_i, "col_i")
        .join(sums_j, "col_j")
        .select("col_i", "col_j", (F.col("n") / (n_clusterings * scale)).alias("value"))
    )


def ncut_centre_labels(
    clusterings: DataFrame, n_clusterings: int, k: int, k_final: int, keep_first: bool = True, seed: int = 42
) -> DataFrame:
    """(col, label): the final cluster of every column h k + c, by the leading vectors
    of the cut matrix, whose size is fixed by the parameters."""
    if n_clusterings * k > MAX_CENTRES:
        raise ValueError(f"{n_clusterings * k} centres; at most {MAX_CENTRES} are grouped")
    cells = ncut_matrix(clusterings, n_clusterings, k)
    g = F.lit(0).cast("bigint").alias("g")
    # Sums of roots differ in the last digits from run to run.
    entries = cells.select(g, F.col("col_i").alias("i"), F.col("col_j").alias("j"), F.round("value", 12).alias("w"))
    nodes = clusterings.sparkSession.range(n_clusterings * k).select(g, F.col("id").alias("i"))
    wanted = min(n_clusterings * k, k_final if keep_first else k_final + 1)
    vectors, _ = leading_vectors(entries, nodes, wanted)
    used = F.col("vec") if keep_first else F.slice("vec", 2, wanted)
    rows = store(vectors.select("g", F.col("i").alias("id"), used.alias("vec")), "cut")
    centres = lloyd.kmeans(rows, k_final, group="g", seed=seed, start="spread")
    labelled = store(lloyd.with_own_label(rows, centres, "g").select("g", "id", "prediction"), "cut-labels")
    return lloyd.by_smallest_member(labelled, "prediction", "g").select(
        F.col("id").alias("col"), F.col("prediction").alias("label")
    )


def ensemble_ncut(
    df: DataFrame,
    train_ids: list[int],
    test_ids: list[int],
    k: int,
    k_final: int,
    keep_first: bool = True,
    seed: int = 42,
) -> DataFrame:
    """(id, label): block k-means models combined by a bipartite normalised cut.

    ``df`` has block_id, id and vec. The models of ``train_ids`` cluster the rows
    of ``test_ids``; the cut groups their centres; every row of ``df`` then takes
    the majority of its nearest centres' groups, one per model. Equal calls give
    equal labels.
    """
    models = store(lloyd.kmeans(blocks_at(df, train_ids), k, seed=seed, start="spread"), "models")
    n_models = models.select(BLOCK).distinct().count()
    test = lloyd.with_labels(blocks_at(df, test_ids), models).select("id", "labels")
    groups = ncut_centre_labels(test, n_models, k, k_final, keep_first, seed)
    names = dict(groups.collect())
    ordered = F.array(*(F.lit(names.get(col)) for col in range(n_models * k)))
    rows = lloyd.with_labels(df.select("id", "vec"), models)
    votes = F.transform("labels", lambda c, h: F.get(ordered, h * k + c))
    return rows.select("id", majority(votes).alias("label"))
