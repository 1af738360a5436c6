"""Mergeable quantiles and running sums against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from blockmill.operators import quantiles, running


@pytest.mark.parametrize("points, stripes", [(10, 1000), (40, 3)])
def test_quantiles_stay_within_their_rank_error(spark, points, stripes, monkeypatch):
    monkeypatch.setattr(quantiles, "STRIPES", stripes)
    rng = random.Random(3)
    rows = [(b, rng.choice([7.0, 7.0, rng.gauss(0, 50), rng.random()])) for b in (0, 1, 2) for _ in range(rng.randint(3, 900))]
    rows += [(5, 1e9)] * 4 + [(0, None), (0, float("nan")), (None, 3.0)]
    df = spark.createDataFrame(rows, "block_id bigint, x double")
    made = quantiles.block_summaries(df, "x", points)
    summaries = made.collect()
    known = [(b, x) for b, x in rows if b is not None and x is not None and x == x]
    for block in (0, 1, 2, 5):
        mine = [r for r in summaries if r.block_id == block]
        assert sum(r.steps for r in mine) == points and len(mine) <= points
        assert {r.n for r in mine} == {sum(b == block for b, _ in known)}
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]

    def check(values, found):
        for share, value in found:
            below, upto = sum(v < value for v in values), sum(v <= value for v in values)
            slack = len(values) / points + 1
            assert below - slack <= share * len(values) <= upto + slack

    check([x for _, x in known], [tuple(r) for r in quantiles.merged_quantiles(made, shares).collect()])
    per_block = quantiles.block_quantiles(made, shares).collect()
    for block in (0, 1, 2, 5):
        check([x for b, x in known if b == block], [(r.share, r.value) for r in per_block if r.block_id == block])
    assert quantiles.block_summaries(df.limit(0), "x").count() == 0
    assert [r.value for r in quantiles.merged_quantiles(made.limit(0), [0.5]).collect()] == [None]


@pytest.mark.parametrize("stripe_rows", [100_000, 15])
def test_running_sums_equal_brute_force(spark, stripe_rows, monkeypatch):
    monkeypatch.setattr(running, "STRIPE_ROWS", stripe_rows)
    rng = random.Random(4)
    rows = [(i, rng.choice([5, 5, 5, rng.randrange(300), None]), rng.choice([None, rng.randrange(-9, 99)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, at long, x long").withColumn("_row", F.lit("kept")).drop("_row")
    got = {r.id: r for r in running.running_totals(df, "at", "id", "x", peers="peers", last=[1, 7, 1000]).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    amounts = [r[2] or 0 for r in ordered]
    for n, (i, at, _) in enumerate(ordered):
        r = got[i]
        assert r.running == sum(amounts[: n + 1])
        assert r.peers == sum(a for a, o in zip(amounts, ordered) if (o[1] is not None, o[1] or 0) <= (at is not None, at or 0))
        for size in (1, 7, 1000):
            assert r[f"last_{size}"] == sum(amounts[max(0, n + 1 - size) : n + 1])
    assert running.running_totals(df.limit(0), "at", "id", "x", last=[3]).count() == 0


def test_stripes_are_told_once_per_row(spark, monkeypatch):
    """Ranges of the order that Spark cuts: no row is compared with all limits."""
    monkeypatch.setattr(running, "STRIPE_ROWS", 20)
    df = spark.range(2000).select("id", F.when(F.col("id") > 50, F.col("id") % 700).alias("at"))
    striped = running._striped(df, "at")
    assert "lambda" not in striped._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted((-1 if r.at is None else r.at, r._stripe) for r in striped.collect())
    assert len(rows) == 2000 and [s for _, s in rows] == sorted(s for _, s in rows)
    assert len({s for _, s in rows}) > 50 and len(set(rows)) == len({at for at, _ in rows})
