"""Exact search for the largest inner products through distances to pivots.

One more coordinate gives every vector the same length, after which the largest
inner product with a query is the smallest distance to it. Vectors are keyed by
their nearest pivot and the distance to it; distances are cut into rings. By the
triangle inequality a ring [a, b] around pivot p holds nothing nearer to a query q
than max(a - d(q, p), d(q, p) - b), and as each vector lies at its nearest pivot
nothing nearer than (d(q, p) - min d(q, .)) / 2. A query first searches the rings
of the smallest bounds until they hold enough vectors; the k-th score found then
bounds the distance, and only the rings within that bound are searched after it.
Within a ring the vectors are sorted by distance and only those between d(q, p) - r
and d(q, p) + r are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockmill.llm.tables import store

#: Pivots, at most; fewer for small tables.
PIVOTS = 256
#: Vectors the pivots and ring borders are chosen from, at most.
SAMPLE = 20_000
RINGS = 8
#: Vectors of a ring searched in one place; larger rings are cut by a hash.
RING_ROWS = 32_768
#: Queries searched together in one place.
QUERY_ROWS = 2_048
#: Share of the largest length allowed for rounding in the bounds.
SLACK = 1e-9


@dataclass
class Pivots:
    """Pivots in the lengthened space, and ring borders for each of them."""

    points: np.ndarray
    top: float
    borders: np.ndarray

    def distances(self, vectors: np.ndarray, lengthen: bool) -> np.ndarray:
        """Distances to all pivots; candidates are lengthened to one norm."""
        norms = np.einsum("ij,ij->i", vectors, vectors)
        extra = np.sqrt(np.maximum(self.top - norms, 0)) if lengthen else np.zeros(len(vectors))
        whole = np.c_[vectors, extra]
        squares = np.einsum("ij,ij->i", whole, whole)
        near = squares[:, None] + np.einsum("ij,ij->i", self.points, self.points) - 2 * whole @ self.points.T
        return np.sqrt(np.maximum(near, 0))

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, ring and distance of candidates."""
        away = self.distances(vectors, True)
        nearest = away.argmin(axis=1)
        distance = away[np.arange(len(vectors)), nearest]
        return nearest, (distance[:, None] >= self.borders[nearest]).sum(axis=1), distance


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, top: float, rows: int) -> Pivots:
    """Pivots far from one another, out of a bounded sample."""
    count = int(min(PIVOTS, max(1, np.sqrt(rows) / 8), len(sample)))
    lengthened = np.c_[sample, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", sample, sample), 0))]
    picked = [0]
    away = np.full(len(sample), np.inf)
    for _ in range(count - 1):
        away = np.minimum(away, ((lengthened - lengthened[picked[-1]]) ** 2).sum(axis=1))
        picked.append(int(away.argmax()))
    pivots = Pivots(lengthened[picked], top, np.zeros((count, RINGS - 1)))
    nearest, _, distance = pivots.keys(sample)
    for p in range(count):
        mine = distance[nearest == p]
        if len(mine):
            pivots.borders[p] = np.quantile(mine, np.arange(1, RINGS) / RINGS)
    return pivots


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "vector"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` the ``k``
    other rows with the largest inner products, ties to the smaller id.

    ``vector`` holds whole numbers; rows that are null or hold nulls, and rows
    without an id, take no part, and shorter vectors count as filled up with
    zeros. Rows with the query's id are never its results. Repeated rows are
    candidates each; a repeated query is answered once, for its smallest vector.
    Fewer than ``k`` candidates are all returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id).alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    own = own.filter("vec_id IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    own = store(own, "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows, width, top = own.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(square)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not rows:
        return spark.createDataFrame([], schema)
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()
    pivots = spark.sparkContext.broadcast(choose_pivots(_matrix(sample["vector"], width), top, rows))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                pivot, ring, away = pivots.value.keys(_matrix(batch["vector"], width))
                yield batch.assign(pivot=pivot.astype("int32"), ring=ring.astype("int32"), away=away)

    placed = own.select("vec_id", "vector").mapInPandas(
        place, f"vec_id long, vector {own.schema['vector'].dataType.simpleString()}, pivot int, ring int, away double"
    )
    index = store(placed, "pivot-index")
    # At most PIVOTS * RINGS rows, whatever the table.
    rings = index.groupBy("pivot", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")
    ).toPandas()
    rings["parts"] = -(-rings["n"] // RING_ROWS)
    asked = own.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = store(asked.withColumnRenamed("vec_id", "query_id"), "queries")
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    slack = SLACK * max(top, 1.0)

    def plan(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        """The ring parts a query has to visit; floor: the score to reach."""
        low, high, sizes = (rings[c].to_numpy() for c in ("low", "high", "n"))
        at, parts = rings["pivot"].to_numpy(), rings["parts"].to_numpy()
        order_no = np.arange(len(rings))
        for batch in batches:
            if not len(batch):
                continue
            queries = _matrix(batch["vector"], width)
            away = pivots.value.distances(queries, False)
            near = away[:, at]
            bound = np.maximum(np.maximum(low - near, near - high), (near - away.min(axis=1)[:, None]) / 2)
            # Nothing is nearer to a query than the difference of the two lengths.
            norms = np.einsum("ij,ij->i", queries, queries)
            bound = np.maximum(bound, 0)
            for i in range(len(batch)):
                order = np.lexsort((order_no, bound[i]))
                # Enough rings to hold k vectors besides the query's own.
                opening = int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1
                if first:
                    visit, floor = order[:opening], np.nan
                else:
                    floor = batch["floor"].iloc[i]
                    rest = order[opening:]
                    reach = np.inf if np.isnan(floor) else norms[i] + top - 2 * floor
                    visit = rest[bound[i][rest] ** 2 <= reach + slack]
                if len(visit):
                    times = parts[visit]
                    yield pd.DataFrame(
                        {
                            "query_id": batch["query_id"].iloc[i],
                            "vector": [batch["vector"].iloc[i]] * int(times.sum()),
                            "floor": floor,
                            "pivot": np.repeat(at[visit], times).astype("int32"),
                            "ring": np.repeat(rings["ring"].to_numpy()[visit], times).astype("int32"),
                            "part": np.concatenate([np.arange(t) for t in times]).astype("int32"),
                        }
                    )

    def search(cell: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Best k of one ring part for each of its queries."""
        found = []
        if len(cell) and len(queries):
            cell = cell.sort_values(["away", "vec_id"])
            away, ids = cell["away"].to_numpy(), cell["vec_id"].to_numpy()
            matrix, asks = _matrix(cell["vector"], width), _matrix(queries["vector"], width)
            floors = queries["floor"].to_numpy(dtype=float)
            reach = np.einsum("ij,ij->i", asks, asks) + top - 2 * np.where(np.isnan(floors), -np.inf, floors)
            radius = np.sqrt(np.maximum(reach, 0)) + np.sqrt(slack)
            center = pivots.value.distances(asks, False)[:, int(cell["pivot"].iloc[0])]
            starts = np.searchsorted(away, center - radius, "left")
            ends = np.searchsorted(away, center + radius, "right")
            for low in range(0, len(asks), 256):
                scores = asks[low : low + 256] @ matrix.T
                for i, row in enumerate(scores, start=low):
                    s, e, query = starts[i], ends[i], queries["query_id"].iloc[i]
                    near, mine = row[s:e], ids[s:e]
                    keep = mine != query
                    if not np.isnan(floors[i]):
                        keep &= near >= floors[i]
                    near, mine = near[keep], mine[keep]
                    if len(near) > k:
                        # All that tie with the k-th are sorted, so ids decide.
                        keep = near >= np.partition(near, -k)[-k]
                        near, mine = near[keep], mine[keep]
                    best = np.lexsort((mine, -near))[:k]
                    found.append(pd.DataFrame({"query_id": query, "vec_id": mine[best], "score": near[best].astype("int64")}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    sizes = spark.createDataFrame(rings[["pivot", "ring", "parts"]].astype("int32"))
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    cut = (
        index.join(F.broadcast(sizes), ["pivot", "ring"])
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        .withColumn("group", group).drop("parts")
    )

    def visited(queries: DataFrame, first: bool) -> DataFrame:
        kind = own.schema["vector"].dataType.simpleString()
        plans = queries.mapInPandas(
            lambda b: plan(b, first), f"query_id long, vector {kind}, floor double, pivot int, ring int, part int"
        ).withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
        keys = ["pivot", "ring", "part", "group"]
        return cut.groupBy(*keys).cogroup(plans.groupBy(*keys)).applyInPandas(
            search, "query_id long, vec_id long, score long"
        )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    opening = store(visited(asked, True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "opening")
    floors = opening.filter(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    rest = visited(asked.join(floors, "query_id", "left"), False)
    every = opening.select("query_id", "vec_id", "score").union(rest)
    ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component, x as double; null for vectors that
    are null or hold null or non-finite components."""
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double")))
