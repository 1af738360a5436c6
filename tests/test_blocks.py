import pytest
from pyspark.sql import functions as F

from blockmill.functions.hashing import HASH_RANGE, bucket_hash
from blockmill.functions.ranking import split_row_number
from blockmill.operators import blocks as B


@pytest.fixture(scope="module")
def rows(spark):
    return B.assign_blocks(spark.range(2000).withColumnRenamed("id", "key"), 8, "key").cache()


def ids(df):
    return {r[0] for r in df.select(B.BLOCK).distinct().collect()}


def test_blocks_partition_the_rows(rows):
    assert rows.count() == 2000
    assert ids(rows) == set(range(8))
    sizes = [r["count"] for r in rows.groupBy(B.BLOCK).count().collect()]
    assert min(sizes) > 180 and max(sizes) < 320


def test_blocks_do_not_change_between_runs(spark):
    make = lambda: {
        tuple(r) for r in B.assign_blocks(spark.range(100), 7, "id", 5).collect()
    }
    assert make() == make()


def test_hash_is_spread_evenly(spark):
    tenth = F.floor(bucket_hash(1, F.col("id")) * 10 / HASH_RANGE)
    counts = [r["count"] for r in spark.range(20000).groupBy(tenth.alias("t")).count().collect()]
    assert len(counts) == 10 and min(counts) > 1800 and max(counts) < 2200


def test_first_blocks(rows):
    assert ids(B.first_blocks(rows, 3)) == {0, 1, 2}
    assert B.first_blocks(rows, 9).count() == 0


def test_random_blocks_without_replacement(rows):
    picked = B.random_blocks(rows, 5, seed=3)
    assert len(ids(picked)) == 5
    assert picked.count() == rows.where(F.col(B.BLOCK).isin(list(ids(picked)))).count()
    assert B.random_blocks(rows, 9).count() == 0
    assert ids(B.random_blocks(rows, 4, seed=1)) != ids(B.random_blocks(rows, 4, seed=2))


def test_two_random_blocks_are_disjoint(rows):
    both = B.two_random_blocks(rows, 3, 5)
    one, two = ids(both.where("side = 1")), ids(both.where("side = 2"))
    assert len(one) == 3 and len(two) == 5 and not one & two
    assert B.two_random_blocks(rows, 4, 5).count() == 0


def test_train_and_predict(rows):
    train, predict = B.train_predict_blocks(rows, [5, 1, 2, 7], 2, 3)
    assert ids(train) == {5, 1} and ids(predict) == {2}
    assert B.train_predict_blocks(rows, [5, 1], 2, 2)[1] is None


def test_drawn_ids_are_distinct(spark):
    assert B.draw_block_ids(spark, 50, 20, 50).count() == 20


def test_split_weights(rows):
    parts = B.random_split(rows, "key", [500, 300, 200])
    share = {r["split"]: r["count"] / 2000 for r in parts.groupBy("split").count().collect()}
    assert abs(share[0] - 0.5) < 0.05 and abs(share[1] - 0.3) < 0.05 and abs(share[2] - 0.2) < 0.05


def test_reblocking_is_independent_of_the_first_blocks(spark):
    rows = spark.range(4000).withColumnRenamed("id", "key")
    again = B.reblock_chain(rows, "key", 8, 4, 8)
    assert ids(again) == set(range(8))


def test_deal_is_even_within_every_source(spark):
    # one source holds nearly all rows, and is cut into many stripes
    source = F.when(F.col("key") < 1800, 0).when(F.col("key") < 1950, F.col("key") % 3 + 1)
    source = source.cast("bigint")  # null for the last rows
    rows = spark.range(2000).withColumnRenamed("id", "key").withColumn("src", source)
    dealt = B.deal_blocks(rows, 7, "key", "src", rows_per_stripe=50)
    assert dealt.count() == 2000
    for r in dealt.groupBy("src").pivot(B.BLOCK).count().collect():
        sizes = [v or 0 for k, v in r.asDict().items() if k != "src"]
        assert max(sizes) - min(sizes) <= 1


def test_split_row_number_equals_row_number(spark):
    rows = spark.range(500).select(
        (F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("v"), "id"
    )
    got = split_row_number(rows, ["g"], F.floor(F.col("v") / 10), [F.col("v"), F.col("id")], "rn", "n")
    data = [(r.g, r.v, r.id) for r in rows.collect()]
    want = {}
    for g in range(3):
        group = sorted((v, i) for gg, v, i in data if gg == g)
        want.update({(g, i): (rank, len(group)) for rank, (_, i) in enumerate(group, 1)})
    assert {(r.g, r.id): (r.rn, r.n) for r in got.collect()} == want
