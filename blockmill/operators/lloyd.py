"""K-means of all blocks at once: every step is one pass over the rows of all blocks.

A step ships the centres of the blocks, whose size is checked, to all tasks; a
task adds up the rows nearest to each centre and hands on one sum per centre and
dimension. Values are added as whole numbers, scaled so that no sum can leave 64
bits: the order of additions then changes nothing, and equal calls give equal
centres to the last bit whatever the cluster does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockmill.functions.hashing import bucket_hash
from blockmill.operators.blocks import BLOCK

#: Bytes of centres that are shipped to every task; the blocks of a wave have no more.
WAVE_BYTES = 64 << 20

_SUMS = "g bigint, cluster int, n bigint, sums array<bigint>"
_CENTRES = "cluster int, n bigint, centre array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length, none of them null, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance) per row, the first centre on a tie.

    One centre after the other: a sum along a row does not depend on the other
    rows, so a row has the same distances in any batch.
    """
    best = np.full(len(rows), np.inf)
    number = np.zeros(len(rows), np.int32)
    for c, centre in enumerate(centres):
        distance = ((rows - centre) ** 2).sum(axis=1)
        closer = distance < best
        best[closer], number[closer] = distance[closer], c
    return number, best


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, places in the batch, vectors) for the blocks of a batch."""
    groups = batch.column("g").to_numpy(zero_copy_only=False)
    vectors = _matrix(batch.column("vec"))
    for g in np.unique(groups):
        places = np.nonzero(groups == g)[0]
        yield int(g), places, vectors[places]


def _step(rows: DataFrame, centres: dict[int, np.ndarray], scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{block: (scaled sums, counts)} of the rows nearest to each centre."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, _, vectors in _parts(batch):
                if g not in shared.value:
                    continue
                mine = shared.value[g]
                number, _ = _nearest(vectors, mine)
                whole = np.rint(vectors * scale).astype(np.int64)
                total = sums.setdefault(g, np.zeros(mine.shape, np.int64))
                for c in np.unique(number):
                    total[c] += whole[number == c].sum(axis=0)
                counts[g] = counts.get(g, 0) + np.bincount(number, minlength=len(mine))
        out = [(g, c, int(counts[g][c]), sums[g][c].tolist()) for g in sums for c in np.nonzero(counts[g])[0].tolist()]
        columns = list(zip(*out)) or [[], [], [], []]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["g", "cluster", "n", "sums"]
        )

    partial = rows.mapInArrow(add, _SUMS)
    totals = (
        partial.select("g", "cluster", "n", F.posexplode("sums").alias("pos", "value"))
        .groupBy("g", "cluster", "pos")
        .agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
        .collect()
    )
    shared.unpersist()
    found = {g: (np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)) for g, c in centres.items()}
    for g, cluster, pos, value, n in totals:
        found[g][0][cluster, pos] = value
        found[g][1][cluster] = n
    return found


def _hashed_start(rows: DataFrame, k: int, seed: int) -> dict[int, np.ndarray]:
    """The k rows of each block that come first by the hash of their id."""
    order = Window.partitionBy("g").orderBy(bucket_hash(seed, F.col("id")), "id")
    # Only the first k rows of each block leave a task (a limit per group).
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    centres: dict[int, list] = {}
    for r in sorted(first.collect(), key=lambda r: (r["g"], r["_n"])):
        centres.setdefault(r["g"], []).append(r["vec"])
    return {g: np.array(c) for g, c in centres.items()}


def _spread_start(rows: DataFrame, k: int, seed: int) -> dict[int, np.ndarray]:
    """The first row of each block by the hash of its id, then again and again the
    row farthest from those chosen, the smallest id on a tie."""
    centres = _hashed_start(rows, 1, seed)
    for _ in range(1, k):
        shared = rows.sparkSession.sparkContext.broadcast(centres)

        def farthest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, int, list]] = {}
            for batch in batches:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                for g, places, vectors in _parts(batch):
                    _, distance = _nearest(vectors, shared.value[g])
                    # Ties to ten digits go by id: copies may differ in the last bits.
                    # Only the farthest can be chosen (all, if one is not a number).
                    far = np.nonzero(~(distance < distance.max() * (1 - 1e-8)))[0]
                    rounded = np.array([float(f"{x:.10g}") for x in distance[far]])
                    first = np.lexsort((ids[places[far]], -rounded))[0]
                    top = far[first]
                    mine = (-rounded[first], int(ids[places[top]]), vectors[top].tolist())
                    best[g] = min(best.get(g, mine), mine)
            columns = list(zip(*((g, *b) for g, b in best.items()))) or [[], [], [], []]
            types = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["g", "d", "id", "vec"]
            )

        each = rows.mapInArrow(farthest, "g bigint, d double, id bigint, vec array<double>")
        chosen = each.groupBy("g").agg(F.min_by("vec", F.struct("d", "id")).alias("vec"), F.min("d").alias("d")).collect()
        shared.unpersist()
        # A block with fewer different rows than k gets fewer centres.
        centres |= {r["g"]: np.vstack([centres[r["g"]], r["vec"]]) for r in chosen if r["d"] < 0}
    return centres


def kmeans(
    df: DataFrame,
    k: int,
    steps: int = 100,
    tol: float = 1e-4,
    group: str = BLOCK,
    id: str = "id",
    vec: str = "vec",
    seed: int = 42,
    start: str = "hash",
) -> DataFrame:
    """(group, cluster, n, centre): one k-means per block, for all blocks at once.

    ``id`` is a unique whole number, ``vec`` an array of doubles, all of one
    length. Starts from the rows that come first by hash, or with ``start`` =
    "spread" from rows far apart. Ends after ``steps`` steps, or when no centre
    has moved by more than ``tol``. A row equally near to several centres
    belongs to the first. A centre with no row stays where it is, with n = 0;
    a block with fewer rows than ``k`` has as many centres as rows. Rows whose
    vector or block is null take no part. Blocks are worked on in waves whose
    centres fit into ``WAVE_BYTES``.
    """
    rows = df.select(
        F.col(group).cast("bigint").alias("g"), F.col(id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec")
    ).where("g IS NOT NULL AND vec IS NOT NULL")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    key = df.schema[group].dataType.simpleString()
    try:
        magnitude = F.array_max(F.transform("vec", F.abs))
        known = rows.agg(
            F.count(F.lit(1)).alias("n"), F.max(magnitude).alias("top"), F.max(F.size("vec")).alias("d"),
            F.approx_count_distinct("g").alias("groups"),
        ).first()
        if not known["n"]:
            return spark.createDataFrame([], f"{group} {key}, {_CENTRES}")
        # The largest sum of all rows stays below 2 ** 62.
        top = known["top"] or 1.0
        scale = 2.0 ** math.floor(62 - math.log2(known["n"]) - math.log2(top))
        waves = -(-known["groups"] * k * known["d"] * 8 // WAVE_BYTES)
        parts = []
        for wave in range(waves):
            mine = rows if waves == 1 else rows.where(F.pmod(F.xxhash64("g"), F.lit(waves)) == wave)
            parts += _run(mine, k, steps, tol, seed, start, scale)
    finally:
        rows.unpersist()
    made = spark.createDataFrame(parts, f"{group} bigint, {_CENTRES}")
    return made.withColumn(group, F.col(group).cast(key))


def _run(rows: DataFrame, k: int, steps: int, tol: float, seed: int, start: str, scale: float) -> list[tuple]:
    if start not in ("hash", "spread"):
        raise ValueError(f"start must be hash or spread, not {start!r}")
    centres = (_hashed_start if start == "hash" else _spread_start)(rows, k, seed)
    counts = {g: np.zeros(len(c), np.int64) for g, c in centres.items()}
    for _ in range(steps):
        moved = 0.0
        for g, (sums, n) in _step(rows, centres, scale).items():
            new = centres[g].copy()
            new[n > 0] = sums[n > 0] / scale / n[n > 0, None]
            moved = max(moved, float(((new - centres[g]) ** 2).sum(axis=1).max(initial=0.0)))
            centres[g], counts[g] = new, n
        if moved <= tol * tol:
            break
    return [
        (g, c, int(counts[g][c]), centre.tolist()) for g in sorted(centres) for c, centre in enumerate(centres[g])
    ]


def _models(centres: DataFrame, group: str) -> dict[int, np.ndarray]:
    """{block: centres by number}, after a look at their size."""
    size = centres.agg(F.coalesce(F.sum(F.size("centre") * 8), F.lit(0))).first()[0]
    if size > WAVE_BYTES:
        raise ValueError(f"{size} bytes of centres; at most {WAVE_BYTES} are shipped to the tasks")
    models: dict[int, list] = {}
    for r in sorted(centres.select(F.col(group).cast("bigint"), "cluster", "centre").collect()):
        models.setdefault(r[0], []).append(r["centre"])
    return {g: np.array(c) for g, c in models.items()}


def with_labels(df: DataFrame, centres: DataFrame, group: str = BLOCK, vec: str = "vec", into: str = "labels") -> DataFrame:
    """Add ``into``: the nearest centre of every block's model, in the order of the blocks.

    One pass over the rows whatever the number of models. Null vectors get null.
    """
    models = list(dict(sorted(_models(centres, group).items())).values())
    shared = df.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            known = vectors.notna()
            out = pd.Series([None] * len(vectors), dtype=object)
            if known.any():
                matrix = np.array(vectors[known].tolist(), dtype=np.float64)
                labels = np.stack([_nearest(matrix, m)[0] for m in shared.value], axis=1)
                out[known.to_numpy()] = pd.Series(labels.tolist(), dtype=object).to_numpy()
            yield out

    return df.withColumn(into, nearest(F.col(vec).cast("array<double>")))


def with_own_label(
    df: DataFrame, centres: DataFrame, group: str = BLOCK, vec: str = "vec", into: str = "prediction"
) -> DataFrame:
    """Add ``into``: the nearest centre of the row's own block; null where the block
    has no centres or the vector is null."""
    shared = df.sparkSession.sparkContext.broadcast(_models(centres, group))

    @F.pandas_udf("int")
    def nearest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for groups, vectors in batches:
            out = np.full(len(groups), np.nan)
            for g in groups[groups.notna()].unique():
                if g in shared.value:
                    mine = ((groups == g) & vectors.notna()).to_numpy()
                    matrix = np.array(vectors[mine].tolist(), dtype=np.float64)
                    if len(matrix):
                        out[mine] = _nearest(matrix, shared.value[g])[0]
            yield pd.Series(out).astype("Int32")

    return df.withColumn(into, nearest(F.col(group).cast("bigint"), F.col(vec).cast("array<double>")))


def by_smallest_member(df: DataFrame, cluster: str, group: str, id: str = "id") -> DataFrame:
    """Number the clusters of every group anew, from 0 on by their smallest member."""
    first = df.groupBy(F.col(group).alias("_g"), F.col(cluster).alias("_c")).agg(F.min(id).alias("_first"))
    # One row per cluster of a group.
    number = F.row_number().over(Window.partitionBy("_g").orderBy("_first")) - 1
    numbered = first.select("_g", "_c", number.alias("_number"))
    return (
        df.join(F.broadcast(numbered), (df[group] == F.col("_g")) & (df[cluster] == F.col("_c")))
        .withColumn(cluster, F.col("_number"))
        .drop("_g", "_c", "_number")
    )
