"""Clustering by passing messages over a table of similarities (i, k, s).

A row ``i`` of the table may be far longer than the others, so rows longer than
``ROW_PIECE`` are cut into pieces once, before the first round. In each round a
piece reports its two best availabilities and its sum, the reports of a row are
put together, and the result goes back to its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockmill.runtime import join_checked, scratch_path, store, store_counted

#: Share of a row's largest value within which another one counts as tied with it.
TIED = 1e-9

#: Rounds between two looks at the centres.
LOOK = 10

#: Longest run of entries of one row that is handled by one task.
ROW_PIECE = 100_000


def start_messages(similarities: DataFrame, row_piece: int = ROW_PIECE) -> DataFrame:
    """(i, k, piece, pieces, r, a) with r = 0 and a = s."""
    lengths, rows = store_counted(
        similarities.groupBy("i").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(row_piece)).cast("int").alias("pieces")
        ),
        "lengths",
    )
    # A long row is not joined in one task either.
    return join_checked(similarities, lengths, ["i"], rows, F.col("k")).select(
        "i",
        "k",
        F.pmod(F.hash("k"), "pieces").alias("piece"),
        "pieces",
        F.lit(0.0).alias("r"),
        F.col("s").cast("double").alias("a"),
    )


def _back_to_pieces(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Join one report per row ``i`` to the pieces of that row."""
    spread = reports.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return rows.join(spread.drop("pieces"), ["i", "piece"])


def responsibilities(state: DataFrame, damping: float = 0.5) -> DataFrame:
    """``r' = d r + (1 - d)(a + best other a - best a)`` within a row, the other
    being 0 where there is none."""
    ordered = Window.partitionBy("i", "piece").orderBy(F.desc("a"), "k")
    best_two = F.slice(F.sort_array(F.collect_list(F.struct("a", "k")), asc=False), 1, 2)
    tops = (
        state.withColumn("_n", F.row_number().over(ordered))
        .where("_n <= 2")
        .groupBy("i", "pieces")
        .agg(best_two.alias("top"))
        .select(
            "i",
            "pieces",
            F.col("top")[0]["a"].alias("best"),
            F.col("top")[0]["k"].alias("best_k"),
            F.get("top", F.lit(1))["a"].alias("second"),
        )
    )
    other = F.when(F.col("k") == F.col("best_k"), F.coalesce("second", F.lit(0.0))).otherwise(
        F.col("best")
    )
    updated = F.lit(damping) * F.col("r") + F.lit(1 - damping) * (F.col("a") + other - F.col("best"))
    return _back_to_pieces(state, tops).select("i", "k", "piece", "pieces", updated.alias("r"))


def availabilities(state: DataFrame, damping: float = 0.5) -> DataFrame:
    """``a' = d P + (1 - d)(P if i = k else min(0, P + r'))`` with P the sum of
    the other positive r' of the row."""
    positive = F.greatest("r", F.lit(0.0))
    sums = state.groupBy("i", "pieces").agg(F.sum(positive).alias("all"))
    p = F.col("all") - positive
    freed = F.when(F.col("i") == F.col("k"), p).otherwise(F.least(F.lit(0.0), p + F.col("r")))
    updated = F.lit(damping) * p + F.lit(1 - damping) * freed
    return _back_to_pieces(state, sums).select(
        "i", "k", "piece", "pieces", "r", updated.alias("a")
    )


def _rounds(
    similarities: DataFrame, rounds: int, damping: float, row_piece: int
) -> Iterator[DataFrame]:
    """The state after each round, at the latest until the next but one is asked for.

    The state is stored after each round: the plan never grows, and a lost
    executor costs at most the round at hand. Two places are written in turn,
    so there are never more than two states on disk.
    """
    places = [scratch_path(similarities.sparkSession, "messages") for _ in range(2)]
    given = store(similarities.select("i", "k", "s"), "similarities")
    state = store(start_messages(given, row_piece), "messages", places[0])
    for done in range(1, rounds + 1):
        half = responsibilities(state, damping).persist(StorageLevel.MEMORY_AND_DISK)
        state = store(availabilities(half, damping), "messages", places[done % 2])
        half.unpersist()
        yield state


def run_rounds(
    similarities: DataFrame, rounds: int, damping: float = 0.5, row_piece: int = ROW_PIECE
) -> DataFrame:
    """(i, k, r, a) after ``rounds`` rounds."""
    for state in _rounds(similarities, rounds, damping, row_piece):
        pass
    return state.select("i", "k", "r", "a")


def centres(state: DataFrame) -> DataFrame:
    """(i, centre): the k with the largest a + r of a row, the lowest k on a tie.

    Values within ``TIED`` of the largest count as tied with it: the order in which
    sums are added up changes their last digits from run to run.
    """
    valued = state.select("i", "k", "piece", "pieces", (F.col("a") + F.col("r")).alias("v"))
    most = valued.groupBy("i", "pieces").agg(F.max("v").alias("most"))
    near = F.col("v") >= F.col("most") - F.lit(TIED) * F.abs("most")
    return _back_to_pieces(valued, most).where(near).groupBy("i").agg(F.min("k").alias("centre"))


def message_passing(
    similarities: DataFrame,
    rounds: int = 100,
    damping: float = 0.5,
    row_piece: int = ROW_PIECE,
    patience: int | None = 20,
) -> DataFrame:
    """(i, centre) after ``rounds`` rounds, or earlier where nothing changes any more.

    Every ``LOOK`` rounds the centres are looked at; when they have stayed the same
    for ``patience`` rounds, they are taken. Without ``patience`` all rounds are run.
    """
    last, same, state = None, 0, None
    for done, state in enumerate(_rounds(similarities, rounds, damping, row_piece), start=1):
        if patience is None or done % LOOK or done == rounds:
            continue
        found = store(centres(state), "centres")
        changed = last is None or not found.join(last, ["i", "centre"], "left_anti").isEmpty()
        last, same = found, 0 if changed else same + LOOK
        if same >= patience:
            return found
    return store(centres(state), "centres")
