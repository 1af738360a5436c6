"""Plans stay what they were meant to be."""

import pytest
from pyspark.sql import functions as F

from blockmill import runtime
from blockmill.operators import blocks as B
from blockmill.operators import quality
from blockmill.operators.mining import tally
from tests.helpers import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def orders(spark):
    return spark.read.parquet(f"{DATA}/orders.parquet")


def test_assigning_blocks_moves_nothing(orders):
    text = plan(B.assign_blocks(orders, 8, "o_orderkey").select("block_id"))
    assert "Exchange" not in text and "ReadSchema: struct<o_orderkey:bigint>" in text


def test_named_blocks_are_a_plain_filter(orders):
    text = plan(B.blocks_at(B.assign_blocks(orders, 8, "o_orderkey"), [1, 2]))
    assert "Exchange" not in text and "Join" not in text


def test_drawing_blocks_broadcasts_only_the_drawn_ids(orders):
    blocked = B.assign_blocks(orders.select("o_orderkey", "o_totalprice"), 8, "o_orderkey")
    text = plan(B.random_blocks(blocked, 3))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text
    # the ids come from the key column alone
    assert "ReadSchema: struct<o_orderkey:bigint>" in text


def test_filters_on_data_columns_reach_the_scan(orders):
    rows = B.assign_blocks(orders, 8, "o_orderkey").where("o_totalprice > 1000")
    assert "GreaterThan(o_totalprice,1000.0)" in plan(rows)


def test_merging_adds_up_before_the_shuffle(spark):
    table = spark.createDataFrame([(0, [1, 2], 3)], "block_id bigint, items array<int>, freq bigint")
    text = plan(tally(table))
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_nmi_needs_no_join(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "label string, prediction int")
    assert "Join" not in plan(quality.nmi(rows))


def test_join_changes_its_way_with_the_size(spark, monkeypatch):
    large = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    small = spark.range(2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 2)
    near = runtime.join_checked(large, small, ["k"], 2, F.col("id"))
    far = runtime.join_checked(large, small, ["k"], 3, F.col("id"))
    assert "_part" not in plan(near) and "_part" in plan(far)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))


def test_stored_tables_lie_in_the_shared_folder(spark):
    stored = runtime.store(spark.range(3), "t")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder in stored.inputFiles()[0]
    again, n = runtime.store_counted(spark.range(7), "t")
    assert n == 7 == again.count()


def test_stored_in_turn_at_two_places(spark):
    places = [runtime.scratch_path(spark, "turn") for _ in range(2)]
    state = runtime.store(spark.range(4), "turn", places[0])
    for done in range(1, 4):
        state = runtime.store(state.select(F.col("id") + 1), "turn", places[done % 2]).toDF("id")
    assert sorted(r.id for r in state.collect()) == [3, 4, 5, 6]
