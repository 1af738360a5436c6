"""Streams over arriving files against plain code, with late rows, repeats and runs called again."""

import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from blockmill.operators import mining
from blockmill.operators.blocks import assign_blocks
from blockmill.streaming import votes, windows
from blockmill.streaming.folder import arrive
from tests.helpers import random_baskets

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = "id long, at timestamp, kind string, v long, extra string"


def arrivals(rng, n_files=4, n=60):
    """Rows that lag by up to three hours, repeats of earlier rows, nulls in every column, one hot kind"""
    files = []
    for f in range(n_files):
        rows = []
        for i in range(n):
            at = START + timedelta(minutes=60 * f + rng.randrange(60) - 60 * rng.choice([0, 0, 1, 2, 3]))
            kind = rng.choice(["hot"] * 6 + ["a", None])
            rows.append((rng.choice([f * n + i, None]) if i % 9 == 0 else f * n + i, at, kind, rng.choice([1, 5, None]), "x"))
        rows += rows[:5] + [x for old in files for x in old[:3]] + [(1, None, "a", 7, None)]
        files.append(rows)
    return files


def brute(files, delay, width):
    """{(window, kind): (n, sum)} of closed windows; [(rows, late)] per file"""
    mark, seen, totals, told = None, set(), defaultdict(lambda: [0, None]), []
    for rows in files:
        late = 0
        for ident, at, kind, v, _ in rows:
            if at is None:
                continue
            if mark is not None and at <= mark:
                late += 1
            elif (ident, at) not in seen:
                seen.add((ident, at))
                # Rows with equal key and time are the same event: any of them counts.
                cell = totals[START + (at - START) // width * width, kind]
                cell[0] += 1
                cell[1] = cell[1] if v is None else (cell[1] or 0) + v
        told.append((len(rows), late))
        times = [r[1] for r in rows if r[1] is not None]
        mark = max([max(times) - delay] + [m for m in [mark] if m]) if times else mark
    closed = {k: tuple(x) for k, x in totals.items() if mark is not None and k[0] + width <= mark}
    return closed, told


def windows_of(spark, root):
    totals = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")]
    empty = spark.createDataFrame([], SCHEMA)
    return windows.ClosingWindows(
        spark, empty.schema, f"{root}/in", f"{root}/w", "at", "70 minutes", "30 minutes", ["kind"], ["id"], totals
    )


def unique(files):
    """Values that depend on the event only, so that equal events are equal rows"""
    return [[(i, at, "hot" if i is None else k, None if i is None else v, x) for i, at, k, v, x in rows] for rows in files]


def test_windows_equal_brute_force(spark, tmp_path):
    files = unique(arrivals(random.Random(4)))
    found = windows_of(spark, tmp_path)
    for run, rows in enumerate(files):
        arrive(spark.createDataFrame(rows, SCHEMA), found.source)
        found.advance(run)
        if run == 0:
            assert found.closed().columns == ["window_start", "kind", "n", "total"]
    closed, told = brute(files, timedelta(minutes=70), timedelta(minutes=30))
    got = {(r.s, r.kind): (r.n, r.total) for r in found.closed().withColumn("s", F.unix_timestamp("window_start")).collect()}
    assert got == {(int(w.timestamp()), k): x for (w, k), x in closed.items()} and len(got) > 5
    assert [(r.n_rows, r.n_late) for r in found.runs().orderBy("run").collect()] == told
    assert sum(late for _, late in told) > 10
    # Nothing new has arrived: nothing changes.
    before = sorted(map(str, found.closed().collect()))
    found.advance(len(files))
    assert sorted(map(str, found.closed().collect())) == before


def test_windows_as_a_batch_hold_all_rows_in_time(spark):
    rows = unique(arrivals(random.Random(5), n_files=1))[0]
    df = spark.createDataFrame(rows, SCHEMA)
    got = windows.window_totals(df, "at", "1 minute", "30 minutes", ["kind"], ["id"], [F.count(F.lit(1)).alias("n")])
    assert got.agg(F.sum("n")).first()[0] == len({(r[0], r[1]) for r in rows if r[1]})
    none = windows.window_totals(df.limit(0), "at", "1 minute", "1 hour", ["kind"], ["id"], [F.count(F.lit(1)).alias("n")])
    assert none.count() == 0


def test_windows_of_an_empty_file(spark, tmp_path):
    found = windows_of(spark, tmp_path)
    arrive(spark.createDataFrame([], SCHEMA), found.source)
    found.advance(0)
    assert found.closed().count() == 0 and found.runs().agg(F.sum("n_late")).first()[0] in (0, None)


def test_votes_after_every_block(spark, tmp_path):
    data = [(i, basket) for i, basket in enumerate(random_baskets(random.Random(6), 300))]
    df = assign_blocks(spark.createDataFrame(data, "txn_id long, items array<int>"), 4, "txn_id")
    local = mining.mine_blocks(df, min_support=0.1)
    rows = votes.block_rows(local).cache()
    source, root = f"{tmp_path}/in", f"{tmp_path}/votes"
    # The first block comes three times, once with other counts; the last is out of turn.
    for blocks in ([0], [0], [3, 0], [1], [2]):
        sent = rows.where(F.col("block_id").isin(blocks))
        arrive(sent.withColumn("freq", F.col("freq") + 1) if blocks == [3, 0] else sent, source)
        votes.advance(spark, rows.schema, source, root)
        if blocks == [3, 0]:  # sent once more as it was: the first count stays
            arrive(rows.where(F.col("block_id") == 3), source)
    steps = votes.merged_steps(spark, root)
    assert {r.blocks_seen for r in steps.select("blocks_seen").distinct().collect()} == {1, 2, 3, 4}
    plain = defaultdict(dict)
    for r in local.itemsets.collect():
        if len(r["items"]) > 1:
            plain[tuple(r["items"])][r.block_id] = r.freq + (r.block_id == 3)
    want = {k: sum(x.values()) // len(x) for k, x in plain.items() if len(x) >= 2}
    last = steps.where("blocks_seen = 4").select("items", "freq")
    assert {tuple(r["items"]): r.freq for r in last.collect()} == want and len(want) > 10
    first = {tuple(r["items"]): r.freq for r in steps.where("blocks_seen = 1").collect()}
    assert first == {k: x[0] for k, x in plain.items() if 0 in x}


def test_votes_of_blocks_without_itemsets(spark, tmp_path):
    rows = spark.createDataFrame([(0, [], 3), (1, ["a", "b"], 2), (1, [], 2)], "block_id int, items array<string>, freq long")
    arrive(rows, f"{tmp_path}/in")
    votes.advance(spark, rows.schema, f"{tmp_path}/in", f"{tmp_path}/votes")
    got = votes.merged_steps(spark, f"{tmp_path}/votes").collect()
    assert [(r.blocks_seen, r["items"], r.freq) for r in got] == [(2, ["a", "b"], 2)]
    assert votes.merged_steps(spark, f"{tmp_path}/votes", share=0.6).count() == 0
