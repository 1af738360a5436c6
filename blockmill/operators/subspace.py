"""Leading eigenvectors of symmetric matrices given as tables of their entries.

A block of vectors is filtered by a Chebyshev polynomial of the matrix, which
damps the unwanted part of the spectrum, and made orthonormal again; the small
matrices of its inner products are solved on the driver. A multiplication is one
join and one aggregate over the entries, so nothing has rows x rows numbers but
the entries themselves. Several matrices (one per block) are worked on at once.

The vectors of a small matrix are broadcast to its entries. Those of a large one
never are: its rows are cut into stripes, the entries of two stripes stay packed
where they are, and the vectors of a stripe travel to them through a shuffle.

Products are added as whole numbers of a fixed unit. Such sums don't depend on
the order in which they are made, and the first vectors come from a hash, so equal
calls give equal vectors to the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockmill.functions.hashing import HASH_RANGE, bucket_hash
from blockmill.runtime import join_checked, store, store_counted

#: Multiplications between two orthonormalisations.
DEGREE = 8
#: Orthonormalisations at most.
MAX_ROUNDS = 40
#: A vector counts as found when ``|A x - value x|`` is below this.
RESIDUAL = 1e-5
#: Vectors carried beyond those asked for; they make the others converge faster.
EXTRA = 6
#: Beyond so many rows all vectors of a row travel in one row to the stripes' entries;
#: below, one row per vector is broadcast, which takes less time to plan and compile.
WIDE_ROWS = 10_000
#: Rows of a stripe, about; a task holds the vectors of two stripes and their entries.
STRIPE_ROWS = 1 << 16
#: Entries that are packed into one row and multiplied together (16 bytes each).
PIECE_ENTRIES = 1 << 14
#: Units of sums of products with vectors, whose numbers stay below about 1 ...
_UNIT = 2.0**44
#: ... and of inner products, whose sums stay below about 1.
_INNER = 2.0**56


def _fixed(value: Column, unit: float) -> Column:
    return F.rint(value * unit).cast("bigint")


def _multiply(entries: DataFrame, state: DataFrame, rows: int, factors: tuple[Column, ...] | None = None) -> DataFrame:
    """``state`` with, per row and vector, the sum of the products of the row's entries
    as ``t`` and the number that was there before as ``u``.

    ``factors`` are alpha, beta, gamma: of the product, of the number itself and of the
    one before. Each row has an own entry, so a recurrence stays within one aggregate.
    """
    joined = join_checked(entries, state, ["g", "j"], rows, F.col("i"))
    value = F.col("w") * F.col("t")
    if factors is not None:
        alpha, beta, gamma = factors
        own = F.when(F.col("own"), beta * F.col("t") + gamma * F.col("u")).otherwise(F.lit(0.0))
        value = alpha * F.col("w") * F.col("t") + own
    return joined.groupBy("g", F.col("i").alias("j"), "c").agg(
        (F.sum(_fixed(value, _UNIT)) / _UNIT).alias("t"), F.max(F.when(F.col("own"), F.col("t"))).alias("u")
    )


class _Joined:
    """Matrices whose vectors are broadcast, one row per vector.

    ``block`` is (g, i, t): the vectors by row, as arrays.
    """

    def __init__(self, entries: DataFrame, nodes: DataFrame, start: Column, p: int):
        own = nodes.select("g", "i", F.col("i").alias("j"), F.lit(0.0).alias("w"), F.lit(True).alias("own"))
        given = entries.select("g", "i", "j", F.col("w").cast("double").alias("w"), F.lit(False).alias("own"))
        self.cells = store(given.unionByName(own), "matrix")
        self.block, rows = store_counted(nodes.select("g", "i", start.alias("t")), "vectors")
        self.rows = rows * p

    def _filtered(self, state: DataFrame, factors: dict[int, tuple]) -> DataFrame:
        """The scaled Chebyshev polynomial of the matrix times the vectors ``t``."""
        table = state.sparkSession.createDataFrame(
            [(g, *f) for g, f in factors.items()],
            "g bigint, alpha array<double>, beta array<double>, gamma array<double>",
        )
        entries = self.cells.join(F.broadcast(table), "g")
        for m in range(DEGREE):
            state = _multiply(entries, state, self.rows, tuple(F.get(name, F.lit(m)) for name in ("alpha", "beta", "gamma")))
        return state

    def product(self, block: DataFrame, factors: dict[int, tuple] | None) -> DataFrame:
        """``block`` times the polynomial of ``factors`` as ``t``, and the product with the matrix as ``y``."""
        state = block.select("g", F.col("i").alias("j"), F.posexplode("t").alias("c", "t")).withColumn("u", F.lit(0.0))
        if factors is not None:
            state = self._filtered(state, factors)
        both = _multiply(self.cells, state, self.rows).withColumnRenamed("j", "i")
        listed = both.groupBy("g", "i").agg(
            F.sort_array(F.collect_list(F.struct("c", F.col("u").alias("t"), F.col("t").alias("y")))).alias("all")
        )
        return listed.select("g", "i", F.col("all.t").alias("t"), F.col("all.y").alias("y"))

    def free(self) -> None:
        pass


_PACKED = "g bigint, a int, b int, rows binary, cols binary, w binary"


def _pack(entries: pa.Table, places: pa.Table) -> pa.Table:
    """The entries of stripes a and b in pieces of ``PIECE_ENTRIES``, by their places in
    the stripes; ``places`` has the ids of a (side 0) and b (side 1) in their order."""
    ids, side = (places.column(c).to_numpy() for c in ("i", "side"))
    known = [np.sort(ids[side == s]) for s in (0, 1)]
    i, j, w = (entries.column(c).to_numpy() for c in ("i", "j", "w"))
    if not (len(i) and len(known[0]) and len(known[1])):
        return pa.Table.from_pylist([], _packed_schema())
    rows, cols = (np.searchsorted(k, x).clip(max=len(k) - 1) for k, x in zip(known, (i, j)))
    # What is named by no node has no row.
    there = (known[0][rows] == i) & (known[1][cols] == j)
    rows, cols, w = rows[there], cols[there], w[there]
    order = np.lexsort((cols, rows))
    columns = [x[order].astype(kind) for x, kind in ((rows, "<i4"), (cols, "<i4"), (w, "<f8"))]
    g, a, b = (entries.column(c)[0].as_py() for c in ("g", "a", "b"))
    pieces = [
        (g, a, b, *(x[low : low + PIECE_ENTRIES].tobytes() for x in columns))
        for low in range(0, len(order), PIECE_ENTRIES)
    ]
    return pa.Table.from_pylist([dict(zip(_packed_schema().names, x)) for x in pieces], _packed_schema())


def _packed_schema() -> pa.Schema:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.schema(list(zip(("g", "a", "b", "rows", "cols", "w"), kinds)))


class _Striped:
    """Matrices of any size, all vectors of a row in one row.

    ``block`` is (g, i, n, a, place, t): the row i is the one numbered ``place`` in the
    stripe ``a`` of the ``n`` stripes of its matrix. The packed entries are kept by the
    executors, on their disks where memory is short, in the partitions they are
    multiplied in; only the vectors and sums of products of pairs of stripes move.
    """

    def __init__(self, entries: DataFrame, nodes: DataFrame, start: Column, p: int, sizes: dict[int, int]):
        self.p = p
        spark = entries.sparkSession
        counts = spark.createDataFrame(
            [(g, -(-n // STRIPE_ROWS)) for g, n in sizes.items()], "g bigint, n int"
        )

        def stripe(of: str) -> Column:
            return (bucket_hash(11, F.col(of)) % F.col("n")).cast("int")

        known = nodes.where("i IS NOT NULL").distinct().join(F.broadcast(counts), "g")
        place = F.row_number().over(Window.partitionBy("g", "a").orderBy("i")) - 1
        numbered = known.withColumn("a", stripe("i")).withColumn("place", place)
        self.block = store(numbered.select("g", "i", "n", "a", "place", start.alias("t")), "vectors")
        ids = self.block.select("g", "i", "n", "a")
        other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        sides = ids.select("g", "a", other.alias("b"), "i", F.lit(0).alias("side")).unionByName(
            ids.select("g", other.alias("a"), F.col("a").alias("b"), "i", F.lit(1).alias("side"))
        )
        given = store(entries.select("g", "i", "j", F.col("w").cast("double").alias("w")).where("w IS NOT NULL"), "matrix")
        cells = given.join(F.broadcast(counts), "g").select("g", stripe("i").alias("a"), stripe("j").alias("b"), "i", "j", "w")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Rows this long are not read back from files, whose readers hold thousands of rows at once.
        self.cells = (
            cells.groupBy("g", "a", "b")
            .cogroup(sides.groupBy("g", "a", "b"))
            .applyInArrow(_pack, _PACKED)
            .repartition(parts, "g", "a", "b")
            .sortWithinPartitions("g", "a", "b")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )

    def _multiply(self, state: DataFrame, factors: dict[int, tuple[float, float, float]] | None) -> DataFrame:
        """The sum of the products of the row's entries as t0, t1, .. and what was there
        before as u0, u1, ..; ``factors`` as for the other kind of matrices, by g."""
        p = self.p
        t, u = ([f"{name}{c}" for c in range(p)] for name in "tu")
        here = F.col("a") == F.col("b")
        # The vectors of b go to all stripes a; what is a row's own only to its own stripe.
        sent = state.withColumnRenamed("a", "b").withColumn("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        sent = sent.select("g", "n", "a", "b", "place", F.when(here, F.col("i")).alias("i"), *t, *(F.when(here, F.col(x)).alias(x) for x in u))
        schema = f"g bigint, n int, a int, place int, i bigint, {', '.join(f't{c} bigint, u{c} double' for c in range(p))}"
        unit = _UNIT

        def fixed(value: np.ndarray) -> np.ndarray:
            return np.rint(value * unit).astype(np.int64)

        def multiply(key: tuple, cells: pa.Table, vectors: pa.Table) -> pa.Table:
            g, a, b = (x.as_py() for x in key)
            place = vectors.column("place").to_numpy()
            size = int(place.max(initial=-1)) + 1
            given = np.zeros((size, p))
            given[place] = np.column_stack([vectors.column(x).to_numpy() for x in t])
            alpha, beta, gamma = (1.0, 0.0, 0.0) if factors is None else factors[g]
            pieces = [
                tuple(np.frombuffer(row[c], kind) for c, kind in (("rows", "<i4"), ("cols", "<i4"), ("w", "<f8")))
                for row in cells.select(["rows", "cols", "w"]).to_pylist()
            ] if size else []
            n_rows = max([size if a == b else 0, *(int(rows[-1]) + 1 for rows, _, _ in pieces)])
            total = np.zeros((n_rows, p), dtype=np.int64)
            touched = np.full(n_rows, a == b)
            for rows, cols, w in pieces:
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                total[rows[starts]] += np.add.reduceat(fixed((alpha * w)[:, None] * given[cols]), starts, axis=0)
                touched[rows] = True
            ids, before = np.zeros(n_rows, dtype=np.int64), None
            if a == b and size:
                ids[place] = vectors.column("i").to_numpy()
                before = np.zeros((size, p))
                before[place] = np.column_stack([vectors.column(x).to_numpy() for x in u])
                total += fixed(beta * given + gamma * before)
            at = np.flatnonzero(touched)
            own = a == b
            n = vectors.column("n")[0].as_py() if size else 0
            columns = [
                pa.array(np.full(len(at), g)), pa.array(np.full(len(at), n, dtype=np.int32)),
                pa.array(np.full(len(at), a, dtype=np.int32)), pa.array(at.astype(np.int32)),
                pa.array(ids[at]) if own else pa.nulls(len(at), pa.int64()),
            ]
            for c in range(p):
                columns += [pa.array(total[at, c]), pa.array(given[at, c]) if own else pa.nulls(len(at), pa.float64())]
            return pa.Table.from_arrays(columns, ["g", "n", "a", "place", "i", *(x for two in zip(t, u) for x in two)])

        parts = self.cells.groupBy("g", "a", "b").cogroup(sent.groupBy("g", "a", "b")).applyInArrow(multiply, schema)
        return parts.groupBy("g", "n", "a", "place").agg(
            F.max("i").alias("i"), *((F.sum(x) / unit).alias(x) for x in t), *(F.max(x).alias(x) for x in u)
        )

    def product(self, block: DataFrame, factors: dict[int, tuple] | None) -> DataFrame:
        """As for the other kind of matrices."""
        p = self.p
        state = block.select(
            "g", "n", "a", "place", "i", *(F.get("t", F.lit(c)).alias(f"t{c}") for c in range(p)),
            *(F.lit(0.0).alias(f"u{c}") for c in range(p)),
        )
        for m in range(DEGREE if factors is not None else 0):
            state = self._multiply(state, {g: tuple(f[m] for f in three) for g, three in factors.items()})
        t, y = (F.array(*(f"{name}{c}" for c in range(p))) for name in "ut")
        return self._multiply(state, None).select("g", "i", "n", "a", "place", t.alias("t"), y.alias("y"))

    def free(self) -> None:
        self.cells.unpersist()


def _inner_products(both: DataFrame, p: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """{g: (T'T, T'AT, (AT)'AT)} of rows (g, t, y) with y = A t."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = batch.column("g").to_numpy(zero_copy_only=False)
            t, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) for c in "ty")
            for g in np.unique(groups):
                mine, total = groups == g, sums.setdefault(int(g), np.zeros((3, p, p), dtype=np.int64))
                for n, (left, right) in enumerate(((t, t), (t, y), (y, y))):
                    total[n] += np.rint(left[mine][:, :, None] * right[mine][:, None, :] * _INNER).astype(np.int64).sum(axis=0)
        columns = [pa.array([g for g in sums for _ in range(3 * p * p)], pa.int64())]
        columns.append(pa.array(list(range(3 * p * p)) * len(sums), pa.int32()))
        columns.append(pa.array(np.concatenate([x.ravel() for x in sums.values()] or [np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays(columns, ["g", "cell", "value"])

    sums = (
        both.select("g", "t", "y").mapInArrow(add, "g bigint, cell int, value bigint")
        .groupBy("g", "cell")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    found = {g: np.zeros(3 * p * p) for g in {r["g"] for r in sums}}
    for g, cell, value in sums:
        found[g][cell] = value / _INNER
    return {g: tuple((m + m.T) / 2 for m in cells.reshape(3, p, p)) for g, cells in found.items()}


def _ritz(inner: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, residuals, rotation) of the best vectors in the block, largest value first."""
    gram, projected, squared = inner
    size, basis = np.linalg.eigh(gram)
    kept = size > size[-1] * 1e-12
    white = basis[:, kept] / np.sqrt(size[kept])
    values, turned = np.linalg.eigh(white.T @ projected @ white)
    rotation = (white @ turned)[:, ::-1]
    values = values[::-1]
    again = np.einsum("ij,ik,kj->j", rotation, squared, rotation)
    return values, np.sqrt(np.maximum(again - values**2, 0)), rotation


def _factors(cut: float) -> tuple[list[float], list[float], list[float]]:
    """alpha, beta, gamma of the polynomial that damps [-1, cut] and is 1 at 1."""
    centre, half = (cut - 1) / 2, (cut + 1) / 2
    first = sigma = half / (1 - centre)
    alpha, beta, gamma = [sigma / half], [-centre * sigma / half], [0.0]
    for _ in range(1, DEGREE):
        new = 1 / (2 / first - sigma)
        alpha.append(2 * new / half)
        beta.append(-2 * new * centre / half)
        gamma.append(-sigma * new)
        sigma = new
    return alpha, beta, gamma


def leading_vectors(entries: DataFrame, nodes: DataFrame, k: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The ``k`` largest eigenvalues of each matrix and their vectors:
    (g, i, vec) and (g, rank, value, residual).

    ``entries`` (g, i, j, w) holds both halves of symmetric matrices with
    eigenvalues in [-1, 1]; cells that are missing are 0. ``nodes`` (g, i) names
    all rows once, also those without entries. A matrix with fewer rows than
    ``k`` has as many vectors as rows, the rest of ``vec`` is 0. The entry of each
    vector with the largest absolute value is positive, that of the smallest i
    among equals.
    """
    spark = entries.sparkSession
    p = k + EXTRA
    start = F.array(*(
        (bucket_hash(seed + c, F.col("i")) + 0.5) / F.lit(float(HASH_RANGE)) - 0.5 for c in range(p)
    ))
    sizes = {r["g"]: r["n"] for r in nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    wide = sum(sizes.values()) > WIDE_ROWS
    matrix = _Striped(entries, nodes, start, p, sizes) if wide else _Joined(entries, nodes, start, p)
    # Sums over all rows fit their unit if vectors have about the length 1.
    block = _turned(matrix.block, {g: np.eye(p) / math.sqrt(n) for g, n in sizes.items()}, p)
    factors = None
    last: dict[int, tuple] = {}
    for _ in range(MAX_ROUNDS):
        both = store(matrix.product(block, factors), "vectors")
        last = {g: _ritz(inner) for g, inner in _inner_products(both, p).items()}
        turn = {}
        for g, (_, _, rotation) in last.items():
            turn[g] = np.zeros((p, p))
            turn[g][:, : rotation.shape[1]] = rotation
        block = _turned(both, turn, p)
        if all((residuals[:k] < RESIDUAL).all() for _, residuals, _ in last.values()):
            break
        # What lies beyond the block's smallest value is damped, the more the farther away.
        cuts = {
            g: min(max(float(values[-1]), -0.99), 0.999) if len(values) == p else -0.5
            for g, (values, _, _) in last.items()
        }
        factors = {g: _factors(cut) for g, cut in cuts.items()}
    matrix.free()
    return _signed(block, k), spark.createDataFrame(
        [
            (g, r, float(values[r]), float(residuals[r]))
            for g, (values, residuals, _) in last.items()
            for r in range(min(k, len(values)))
        ],
        "g bigint, rank int, value double, residual double",
    )


def _turned(block: DataFrame, turn: dict[int, np.ndarray], p: int) -> DataFrame:
    """The rows ``t`` times the small matrix of their g."""
    matrices = block.sparkSession.createDataFrame(
        [(g, m.T.tolist()) for g, m in turn.items()], "g bigint, m array<array<double>>"
    )
    product = F.transform(
        "m",
        lambda column: F.aggregate(
            F.zip_with("t", column, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
        ),
    )
    kept = [c for c in block.columns if c not in ("t", "y")]
    return block.join(F.broadcast(matrices), "g").select(*kept, product.alias("t"))


def _signed(block: DataFrame, k: int) -> DataFrame:
    """(g, i, vec) with signs fixed by the entry of the largest absolute value."""
    tops = [
        F.max_by(F.signum(F.get("t", F.lit(c))), F.struct(F.round(F.abs(F.get("t", F.lit(c))), 9), -F.col("i")))
        for c in range(k)
    ]
    signs = block.groupBy("g").agg(F.array(*tops).alias("signs"))
    return block.join(F.broadcast(signs), "g").select(
        "g", "i", F.zip_with(F.slice("t", 1, k), "signs", lambda x, s: x * s).alias("vec")
    )
