"""Joins on time: the latest row before, and intervals that overlap.

Both cut time into pieces so that a key with a large share of the rows is worked
on by many tasks, and both are equi-joins or windows over those pieces: no pair
of rows is formed that is not in the result or next to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockmill.runtime import store

#: Rows of a piece of one key's time, about.
PIECE_ROWS = 50_000

#: Right rows of a bin beyond which it is cut into parts.
BIN_ROWS = 10_000


def _present(df: DataFrame, key: Sequence[str], *times: str) -> Column:
    """Rows that can match: no null in the key nor in the times."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), 1) for c in (*key, *times)))) == F.array()


def _number(df: DataFrame, name: str) -> Column:
    """A time as a number, in seconds for dates and timestamps."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp")) / F.lit(1e6)
    return F.col(name).cast("double")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    tie: str,
    tolerance: float | None = None,
) -> DataFrame:
    """Every row of ``left`` with ``values`` of the latest row of ``right`` that has
    its key and lies at or before its time.

    Of right rows of one time the one with the largest ``tie`` counts. With
    ``tolerance`` a match must not lie further back than that (seconds for
    timestamps). A left row whose key or time is null, or that has no match, gets
    nulls; right rows with a null key or time match nothing. The columns in
    ``values`` must not be columns of ``left``.

    Both sides are put in one order per key and cut along it into pieces; within
    a piece the last right row is carried on by a window. What a piece begins
    with is the last right row of the pieces before it, found from one row per
    piece. So a key with a third of all rows is shared out, and each row is
    shuffled once.
    """
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    match = F.struct(_number(right, right_time).alias("_at"), F.col(tie).alias("_tie"), *(F.col(v).alias(v) for v in values))
    none = F.lit(None)
    known = right.where(_present(right, key, right_time))
    match_type = known.select(match.alias("m")).schema["m"].dataType
    rows = left.select(
        F.struct(*key).alias("_key"), _number(left, left_time).alias("_t"), F.lit(True).alias("_left"),
        F.struct(*left.columns).alias("_row"), none.cast(match_type).alias("_match"),
    )
    row_type = rows.schema["_row"].dataType
    rows = rows.unionByName(
        known.select(
            F.struct(*key).alias("_key"), _number(right, right_time).alias("_t"), F.lit(False).alias("_left"),
            none.cast(row_type).alias("_row"), match.alias("_match"),
        )
    )
    rows = store(rows, "asof")
    # Borders of equal parts of each key's time; all rows of one time share a piece.
    spans = rows.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / F.lit(PIECE_ROWS)).alias("_n"))
    parts = min(10_000, spans.agg(F.max("_n")).first()[0] or 1)
    cuts = rows.where("_t IS NOT NULL").join(spans.where("_n > 1"), "_key", "left_semi").groupBy("_key").agg(
        F.percentile_approx("_t", F.lit([i / parts for i in range(1, max(parts, 2))]), 10_000).alias("_cuts")
    )
    # One row per long key; the keys of a table may be many, so Spark sizes the join itself.
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_t"))), F.lit(0))
    cut = rows.join(cuts, "_key", "left").withColumn(
        "_piece", F.when(F.col("_cuts").isNull() | F.col("_t").isNull(), 0).otherwise(piece)
    ).drop("_cuts")
    last = cut.where("NOT _left").groupBy("_key", "_piece").agg(
        F.max_by("_match", F.struct("_match._at", "_match._tie")).alias("_end")
    )
    before = Window.partitionBy("_key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut.select("_key", "_piece").distinct().join(last, ["_key", "_piece"], "left")
    carried = pieces.select("_key", "_piece", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    # At one time the right rows come first, the smallest tie first of all.
    within = Window.partitionBy("_key", "_piece").orderBy("_t", "_left", "_match._tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = (
        cut.withColumn("_own", F.last("_match", ignorenulls=True).over(within))
        .where("_left")
        .join(carried, ["_key", "_piece"], "left")
        .withColumn("_found", F.coalesce("_own", "_begin"))
    )
    near = F.col("_t").isNotNull()
    if tolerance is not None:
        near &= F.col("_t") - F.col("_found._at") <= tolerance
    return found.select("_row.*", *(F.when(near, F.col(f"_found.{v}")).alias(v) for v in values))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    widths: Sequence[float],
) -> DataFrame:
    """Pairs of rows with one key whose closed intervals [start, end] share a moment.

    ``widths`` are lengths of bins (seconds for timestamps), ascending. An interval
    belongs to the layer of the shortest width it does not exceed, or to the last.
    A pair of layers meets in bins of the longer one's width, so an interval
    touches two bins at most, but for those longer than all widths. A pair of
    rows is kept in the bin in which the later of the two starts lies, so none is
    met twice. Rows with a null in the key, in a start or an end, or with an end
    before the start, match nothing. Columns of the two sides must have different
    names, but for the key.

    A bin that holds more than ``BIN_ROWS`` right rows is cut into parts by a
    hash, and left rows go to all of its parts, so a hot bin is shared out.
    """
    clash = (set(left.columns) & set(right.columns)) - set(key)
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(sorted(clash))}")
    steps = F.array(*(F.lit(float(w)) for w in widths))

    def layered(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        known = df.where(_present(df, key, *span)).withColumns(
            {f"_s{side}": _number(df, span[0]), f"_e{side}": _number(df, span[1])}
        ).where(f"_e{side} >= _s{side}")
        length = F.col(f"_e{side}") - F.col(f"_s{side}")
        return store(
            known.withColumn(
                f"_layer{side}", F.least(F.size(F.filter(steps, lambda w: w < length)), F.lit(len(widths) - 1))
            ),
            "intervals",
        )

    a, b = layered(left, left_span, "a"), layered(right, right_span, "b")

    def binned(df: DataFrame, side: str, other: str, met: DataFrame) -> DataFrame:
        layers = sorted(r[0] for r in met.select(f"_layer{other}").distinct().collect())
        each = F.array(*map(F.lit, layers)) if layers else F.array().cast("array<int>")
        wide = F.get(steps, F.greatest("_layera", "_layerb"))
        ends = (F.floor(F.col(f"_{e}{side}") / F.col("_w")).cast("bigint") for e in "se")
        return (
            df.withColumn(f"_layer{other}", F.explode(each)).withColumn("_w", wide).withColumn("_bin", F.explode(F.sequence(*ends)))
        )

    place = [*key, "_layera", "_layerb", "_bin"]
    right_bins = binned(b, "b", "a", a)
    sizes = right_bins.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / F.lit(BIN_ROWS)).cast("int").alias("_parts"))
    hot = store(sizes.where("_parts > 1"), "hot-bins")
    parts = F.coalesce("_parts", F.lit(1))
    a = binned(a, "a", "b", b).drop("_w").join(hot, place, "left")
    a = a.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    names = [F.col(c) for c in right.columns]
    b = right_bins.join(hot, place, "left").withColumn("_part", F.pmod(F.xxhash64(*names), parts).cast("int")).drop("_parts")
    met = a.join(b, [*place, "_part"]).where("_sa <= _eb AND _sb <= _ea")
    once = F.floor(F.greatest("_sa", "_sb") / F.col("_w")) == F.col("_bin")
    return met.where(once).select(*left.columns, *(c for c in right.columns if c not in key))
