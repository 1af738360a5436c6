"""Joins on time against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blockmill.operators import timejoin


def times(rng, n, hot):
    """(key, time, id): a hot key, nulls, many equal times"""
    return [
        (rng.choice(["hot"] * hot + ["a", "b", None]), rng.choice([rng.randrange(40), rng.randrange(1000), None]), i)
        for i in range(n)
    ]


@pytest.mark.parametrize("piece_rows", [50_000, 20])
@pytest.mark.parametrize("tolerance", [None, 5])
def test_asof_equals_brute_force(spark, piece_rows, tolerance, monkeypatch):
    monkeypatch.setattr(timejoin, "PIECE_ROWS", piece_rows)
    rng = random.Random(5)
    left, right = times(rng, 300, 6) + [("only", 3, 900)] * 2, times(rng, 200, 6) + [("right", 1, 901)]
    ldf = spark.createDataFrame(left, "k string, t long, id long").withColumn("_match", F.lit("kept"))
    rdf = spark.createDataFrame([(k, t, i, f"v{i}") for k, t, i in right], "k string, at long, rid long, v string")
    got = timejoin.asof_join(ldf, rdf, ["k"], "t", "at", ["rid", "v"], tie="rid", tolerance=tolerance)
    assert got.columns == ["k", "t", "id", "_match", "rid", "v"]
    want = []
    for k, t, i in left:
        fits = [(at, r) for kk, at, r in right if None not in (k, t, at) and kk == k and at <= t]
        best = max(fits, default=(None, None))
        if best[0] is not None and tolerance is not None and t - best[0] > tolerance:
            best = (None, None)
        want.append((k, t, i, "kept", best[1], None if best[1] is None else f"v{best[1]}"))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_asof_odd_tables(spark):
    df = spark.createDataFrame([("a", 1, 2)], "k string, t long, id long")
    other = df.select("k", F.col("t").alias("at"), F.col("id").alias("rid"))
    assert timejoin.asof_join(df.limit(0), other, ["k"], "t", "at", ["rid"], tie="rid").count() == 0
    assert timejoin.asof_join(df, other.limit(0), ["k"], "t", "at", ["rid"], tie="rid").first().rid is None
    with pytest.raises(ValueError, match="both sides"):
        timejoin.asof_join(df, df, ["k"], "t", "t", ["id"], tie="id")


def spans(rng, n):
    """(key, start, end): short, long and wrong ones, nulls, one hot key at one place"""
    out = []
    for _ in range(n):
        start = rng.choice([5, 5, rng.randrange(300), None])
        length = rng.choice([0, 1, 3, 12, 40, 400, -1])
        out.append((rng.choice(["hot"] * 5 + ["a", None]), start, None if start is None else start + length))
    return [(k, s, e, i) for i, (k, s, e) in enumerate(out)]


@pytest.mark.parametrize("bin_rows", [10_000, 7])
@pytest.mark.parametrize("widths", [(2, 10, 100), (10,)])
def test_intervals_equal_brute_force(spark, bin_rows, widths, monkeypatch):
    monkeypatch.setattr(timejoin, "BIN_ROWS", bin_rows)
    rng = random.Random(9)
    left, right = spans(rng, 120), spans(rng, 110)
    right += right[:5]
    ldf = spark.createDataFrame([(k, None if s is None else float(s), None if e is None else float(e), i) for k, s, e, i in left], "k string, s double, e double, i long")
    rdf = spark.createDataFrame([(k, None if s is None else float(s), None if e is None else float(e), i) for k, s, e, i in right], "k string, rs double, re double, j long")
    got = timejoin.interval_join(ldf, rdf, ["k"], ("s", "e"), ("rs", "re"), widths)
    assert got.columns == ["k", "s", "e", "i", "rs", "re", "j"]
    want = Counter(
        (i, j)
        for k, s, e, i in left
        for kk, rs, re, j in right
        if None not in (k, s, rs) and k == kk and s <= e and rs <= re and s <= re and rs <= e
    )
    assert Counter((r.i, r.j) for r in got.collect()) == want
    assert timejoin.interval_join(ldf.limit(0), rdf, ["k"], ("s", "e"), ("rs", "re"), widths).count() == 0
    assert timejoin.interval_join(ldf, rdf.limit(0), ["k"], ("s", "e"), ("rs", "re"), widths).count() == 0
