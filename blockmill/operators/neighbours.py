"""Nearest neighbours without a cross join.

Distances are worked out in numpy over batches, and only the k best leave a
task. Which side is shipped to the tasks depends on the row counts; when neither
is small, the queries are cut into tiles and all candidates stream past each tile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.functions.hashing import bucket_hash
from blockmill.functions.vectors import majority

#: Most vectors, and most numbers in them, that are shipped to every task.
SHIP_ROWS = 50_000
SHIP_NUMBERS = 8_000_000

#: Queries per tile when both sides are large, and candidates looked at together.
TILE_ROWS = 4_000
STEP_ROWS = 500

_PAIR = "q bigint, sq_dist double, id bigint, label int"
_HITS = "array<struct<sq_dist:double,id:bigint,label:int>>"


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _best(q_ids, q_vecs, ids, vecs, labels, k: int, skip_self: bool) -> pd.DataFrame:
    """The k nearest of ``ids`` for each of ``q_ids``, ties by id.

    Works through the queries in slices so that no more than a few million
    distances are held at once.
    """
    order = np.argsort(ids, kind="stable")
    ids, vecs, labels = ids[order], vecs[order], labels[order]
    step = max(1, 4_000_000 // max(1, vecs.size))
    parts = []
    for start in range(0, len(q_ids), step):
        block = q_vecs[start : start + step]
        dist = ((block[:, None, :] - vecs[None, :, :]) ** 2).sum(axis=2)
        if skip_self:
            dist[q_ids[start : start + step, None] == ids[None, :]] = np.inf
        # Candidates are in id order, so a stable sort breaks ties by id.
        picked = np.argsort(dist, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(dist, picked, axis=1)
        keep = np.isfinite(found)
        rows = np.repeat(q_ids[start : start + step], keep.sum(axis=1))
        chosen = picked[keep]
        parts.append(
            pd.DataFrame(
                {"q": rows, "sq_dist": found[keep], "id": ids[chosen], "label": labels[chosen]}
            )
        )
    if not parts:
        return pd.DataFrame({"q": [], "sq_dist": [], "id": [], "label": []})
    return pd.concat(parts, ignore_index=True)


def _shrink(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    return pairs.sort_values(["q", "sq_dist", "id"]).groupby("q", sort=False).head(k)


def _gather(pairs: DataFrame, k: int) -> DataFrame:
    """(q, hits): the k best of the partial results, nearest first."""
    hits = F.sort_array(F.collect_list(F.struct("sq_dist", "id", "label")))
    return pairs.groupBy("q").agg(F.slice(hits, 1, k).cast(_HITS).alias("hits"))


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 1,
    skip_self: bool = False,
    ship_rows: int = SHIP_ROWS,
) -> DataFrame:
    """(q, hits): the ``k`` nearest candidates of every query, nearest first.

    ``queries`` has ``id, vec``; ``candidates`` has ``id, vec, label``; vectors
    are arrays. Exact for any size of either side.
    """
    queries, candidates = _query_side(queries), _candidate_side(candidates)
    if _at_most(candidates, ship_rows):
        return _ship_candidates(queries, candidates, k, skip_self)
    return _nearest_to_many(queries, candidates, k, skip_self, ship_rows)


def _query_side(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("bigint").alias("id"), "vec")


def _candidate_side(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").cast("bigint").alias("id"), "vec", F.col("label").cast("int").alias("label")
    )


def _nearest_to_many(
    queries: DataFrame, candidates: DataFrame, k: int, skip_self: bool, ship_rows: int
) -> DataFrame:
    if _at_most(queries, ship_rows):
        return _ship_queries(queries, candidates, k, skip_self)
    whole = F.lit(0).cast("bigint").alias("g")
    left = queries.select(whole, "id", "vec", F.lit(0).alias("label"))
    right = candidates.select(whole, "id", "vec", "label")
    return _tiles(left, right, k, skip_self).select("q", "hits")


def _at_most(df: DataFrame, rows: int) -> bool:
    """Whether a side may be shipped; looks at no more rows than it has to."""
    seen = df.limit(rows + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("numbers")
    ).first()
    return seen["rows"] <= rows and seen["numbers"] <= SHIP_NUMBERS


def _ship_candidates(queries: DataFrame, candidates: DataFrame, k: int, skip_self: bool) -> DataFrame:
    shipped = _broadcast_side(candidates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vecs, labels = shipped.value
        for batch in batches:
            q_ids = batch["id"].to_numpy(dtype=np.int64)
            if not len(q_ids) or not len(ids):
                continue
            found = _best(q_ids, _matrix(batch["vec"]), ids, vecs, labels, k, skip_self)
            # The hits of a query follow each other, nearest first.
            triples = [
                {"sq_dist": d, "id": i, "label": l}
                for d, i, l in zip(found["sq_dist"], found["id"], found["label"])
            ]
            starts = np.flatnonzero(np.r_[True, np.diff(found["q"].to_numpy()) != 0])
            ends = np.r_[starts[1:], len(triples)]
            yield pd.DataFrame(
                {
                    "q": found["q"].to_numpy()[starts],
                    "hits": [triples[s:e] for s, e in zip(starts, ends)],
                }
            )

    return queries.mapInPandas(run, f"q bigint, hits {_HITS}")


def _ship_labels(queries: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """(id, label) with the vote counted in the same pass, column-wise."""
    shipped = _broadcast_side(labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vecs, labels = shipped.value
        names, codes = np.unique(labels, return_inverse=True)
        for batch in batches:
            q_ids = batch["id"].to_numpy(dtype=np.int64)
            if not len(q_ids) or not len(ids):
                continue
            found = _best(np.arange(len(q_ids)), _matrix(batch["vec"]), ids, vecs, codes, k, False)
            votes = np.zeros((len(q_ids), len(names)), dtype=np.int64)
            np.add.at(votes, (found["q"].to_numpy(), found["label"].to_numpy()), 1)
            # argmax takes the first maximum, so the lowest label on a tie.
            yield pd.DataFrame({"id": q_ids, "label": names[votes.argmax(axis=1)]})

    return queries.mapInPandas(run, "id bigint, label int")


def _broadcast_side(side: DataFrame):
    """ids, vectors and labels of a side that was found small enough."""
    rows = side.toPandas()
    return side.sparkSession.sparkContext.broadcast(
        (
            rows["id"].to_numpy(dtype=np.int64),
            _matrix(rows["vec"]),
            rows["label"].to_numpy(dtype=np.int64),
        )
    )


def _ship_queries(queries: DataFrame, candidates: DataFrame, k: int, skip_self: bool) -> DataFrame:
    side = queries.toPandas()
    q_ids = side["id"].to_numpy(dtype=np.int64)
    shipped = queries.sparkSession.sparkContext.broadcast((q_ids, _matrix(side["vec"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_vecs = shipped.value
        best = None
        for batch in batches:
            ids = batch["id"].to_numpy(dtype=np.int64)
            if not len(ids) or not len(q_ids):
                continue
            labels = batch["label"].to_numpy(dtype=np.int64)
            found = _best(q_ids, q_vecs, ids, _matrix(batch["vec"]), labels, k, skip_self)
            best = found if best is None else _shrink(pd.concat([best, found]), k)
        if best is not None:
            yield best

    return _gather(candidates.mapInPandas(run, _PAIR), k)


class _Tile:
    """The queries of a tile and their ``k`` nearest of the candidates seen so far.

    Candidates are sifted by one product of matrices, whose distances are off in the
    last digits; only those that may be among the nearest have theirs worked out.
    """

    def __init__(self, g: int, k: int, skip_self: bool):
        self.g, self.k, self.skip_self = g, k, skip_self
        self.given: list[tuple[np.ndarray, np.ndarray]] = []
        self.vecs: np.ndarray | None = None

    def add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        self.given.append((ids, vecs))

    def _begin(self) -> None:
        self.ids = np.concatenate([i for i, _ in self.given])
        self.vecs = np.concatenate([v for _, v in self.given])
        self.sizes = (self.vecs**2).sum(axis=1)
        self.wide = np.c_[self.vecs, np.ones(len(self.vecs))]
        self.bound = np.full(len(self.ids), np.inf)
        none = np.zeros(0, dtype=np.int64)
        self.best = (none, np.zeros(0), none, none)  # place of the query, distance, id, label
        self.pending: list[tuple[np.ndarray, ...]] = []

    def see(self, ids: np.ndarray, vecs: np.ndarray, labels: np.ndarray) -> None:
        if self.vecs is None:
            self._begin()
        for start in range(0, len(ids), STEP_ROWS):
            part = slice(start, start + STEP_ROWS)
            self._sift(ids[part], vecs[part], labels[part])

    def _sift(self, ids: np.ndarray, vecs: np.ndarray, labels: np.ndarray) -> None:
        sizes = (vecs**2).sum(axis=1)
        with np.errstate(all="ignore"):
            # Squared distances less the query's own square.
            near = self.wide @ np.c_[-2 * vecs, sizes].T
            # What a distance may be off by.
            slack = (self.vecs.shape[1] + 8) * 1e-15 * (self.sizes + sizes.max())
            cut = self.bound - self.sizes + slack
            if len(ids) > self.k and not np.isfinite(self.bound).all():
                others = np.where(self.ids[:, None] == ids, np.inf, near) if self.skip_self else near
                # Twice over, as this bound is off as well.
                cut = np.fmin(cut, np.partition(others, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
            # Not a number is not greater either, and looked at below.
            far = near > cut[:, None]
            q, c = np.divmod(np.flatnonzero(np.logical_not(far, out=far)), len(ids))
        for start in range(0, len(q), 1 << 18):
            mine, theirs = q[start : start + (1 << 18)], c[start : start + (1 << 18)]
            dist = ((self.vecs[mine] - vecs[theirs]) ** 2).sum(axis=1)
            keep = np.isfinite(dist)
            if self.skip_self:
                keep &= self.ids[mine] != ids[theirs]
            mine, theirs = mine[keep], theirs[keep]
            self.pending.append((mine, dist[keep], ids[theirs], labels[theirs]))
        if sum(len(p[0]) for p in self.pending) >= len(self.ids) * self.k // 2:
            self._shrink()

    def _shrink(self) -> None:
        """The ``k`` nearest of what is held, ties by id."""
        q, dist, ids, labels = (np.concatenate(x) for x in zip(self.best, *self.pending))
        self.pending = []
        still = dist <= self.bound[q]
        q, dist, ids, labels = q[still], dist[still], ids[still], labels[still]
        order = np.lexsort((ids, dist, q))
        starts = np.searchsorted(q[order], np.arange(len(self.ids)))
        order = order[np.arange(len(order)) - starts[q[order]] < self.k]
        self.best = tuple(x[order] for x in (q, dist, ids, labels))
        last = np.searchsorted(self.best[0], np.arange(len(self.ids)) + 1) - 1
        full = np.bincount(self.best[0], minlength=len(self.ids)) == self.k
        self.bound[full] = self.best[1][last[full]]

    def hits(self) -> Iterator[pa.RecordBatch]:
        if self.vecs is None:
            return
        self._shrink()
        q, dist, ids, labels = self.best
        held, counts = np.unique(q, return_counts=True)
        values = pa.StructArray.from_arrays(
            [pa.array(dist), pa.array(ids), pa.array(labels.astype(np.int32))], ["sq_dist", "id", "label"]
        )
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(held), self.g)), pa.array(self.ids[held]), pa.ListArray.from_arrays(offsets, values)],
            ["g", "q", "hits"],
        )


def _rows_of(column: pa.Array) -> np.ndarray:
    """Arrays of one length, none of them null, as rows."""
    if column.null_count:
        raise ValueError("null vectors have no distance")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tiles(left: DataFrame, right: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """(g, q, hits) within every group ``g``; both sides are ``g, id, vec, label``.

    All rows of a group are compared, which takes time with the square of its size,
    but a task holds one tile of queries and passes its candidates on batch by batch.
    """
    sizes = left.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_ROWS)).cast("int").alias("n"))
    columns = ["id", F.col("vec").cast("array<double>").alias("vec"), F.col("label").cast("int").alias("label")]
    tile = (bucket_hash(7, F.col("id")) % F.col("n")).cast("int")
    queries = left.join(sizes, "g").select("g", tile.alias("tile"), F.lit(0).alias("side"), *columns)
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    seen = right.join(sizes, "g").select("g", every.alias("tile"), F.lit(1).alias("side"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            kinds = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "tile", "side")]
            changes = np.any([np.diff(x) != 0 for x in kinds], axis=0)
            edges = np.r_[0, np.nonzero(changes)[0] + 1, batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                g, number, side = (int(x[low]) for x in kinds)
                if (g, number) != key:
                    if held is not None:
                        yield from held.hits()
                    key, held = (g, number), _Tile(g, k, skip_self)
                part = batch.slice(low, high - low)
                ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                vecs = _rows_of(part.column("vec"))
                if side == 0:
                    held.add(ids, vecs)
                elif held.given:
                    held.see(ids, vecs, part.column("label").to_numpy(zero_copy_only=False).astype(np.int64))
        if held is not None:
            yield from held.hits()

    # As many parts as are set: few bytes are much work here.
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        queries.unionByName(seen)
        .repartition(parts, "g", "tile")
        .sortWithinPartitions("g", "tile", "side")
        .mapInArrow(run, f"g bigint, q bigint, hits {_HITS}")
    )
    # Rows with the same id are one query.
    hits = F.sort_array(F.flatten(F.collect_list("hits")))
    return found.groupBy("g", "q").agg(F.slice(hits, 1, k).cast(_HITS).alias("hits"))


def nearest_within(df: DataFrame, group: str, k: int) -> DataFrame:
    """(g, q, hits): the ``k`` nearest other rows of the same group.

    ``df`` has ``group``, ``id`` and ``vec``.
    """
    rows = df.select(
        F.col(group).cast("bigint").alias("g"),
        F.col("id").cast("bigint").alias("id"),
        "vec",
        F.lit(0).alias("label"),
    )
    return _tiles(rows, rows, k, skip_self=True)


def knn_label(
    queries: DataFrame, labelled: DataFrame, k: int = 1, ship_rows: int = SHIP_ROWS
) -> DataFrame:
    """(id, label): majority label of the ``k`` nearest labelled vectors, the
    lowest one on a tie."""
    queries, labelled = _query_side(queries), _candidate_side(labelled)
    if _at_most(labelled, ship_rows):
        return _ship_labels(queries, labelled, k)
    found = _nearest_to_many(queries, labelled, k, False, ship_rows)
    return found.select(F.col("q").alias("id"), majority(F.col("hits.label")).alias("label"))


def vote_columns(df: DataFrame, columns: Sequence[str], into: str = "label") -> DataFrame:
    """Majority of several label columns of a row, the lowest on a tie."""
    return df.withColumn(into, majority(F.array(*columns)))
