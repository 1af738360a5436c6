import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from blockmill import runtime
from blockmill.functions.hashing import bucket_hash
from blockmill.functions.itemsets import canonical, itemset_key, parse_key
from blockmill.operators import mining as M
from blockmill.operators import rules
from blockmill.operators.blocks import assign_blocks
from blockmill.plans import sweeps
from blockmill.plans.itemsets import full_itemsets, sampled_local_itemsets
from tests.helpers import brute_blocks, brute_itemsets, random_baskets


def frame(spark, rows):
    return spark.createDataFrame(rows, "block_id bigint, items array<int>")


def found(local):
    return {(r.block_id, tuple(r["items"])): r.freq for r in local.itemsets.collect()}


@pytest.fixture(scope="module")
def skewed():
    """One block holds most rows, and one basket is repeated in it many times."""
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 0, 1, 2]), b) for b in random_baskets(rng, 300)]
    return rows + [(0, [1, 2, 3, 4])] * 150


@pytest.mark.parametrize("max_len", [1, 2, None])
def test_local_miner_is_exact(spark, skewed, max_len):
    local = M.mine_blocks(frame(spark, skewed), min_support=0.05, max_len=max_len)
    assert found(local) == brute_blocks(skewed, 0.05, max_len)


def test_local_miner_without_broadcasts(spark, skewed, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    local = M.mine_blocks(frame(spark, skewed), min_support=0.05)
    assert found(local) == brute_blocks(skewed, 0.05)


def test_rounding_of_the_threshold(spark):
    rows = [(0, [1, 2])] * 2 + [(0, [3])] * 5  # 0.3 * 7 = 2.1
    assert (0, (1, 2)) in found(M.mine_blocks(frame(spark, rows), min_support=0.3))
    assert (0, (1, 2)) not in found(
        M.mine_blocks(frame(spark, rows), min_support=0.3, rounding="ceil")
    )
    assert brute_blocks(rows, 0.3, rounding=math.ceil) == found(
        M.mine_blocks(frame(spark, rows), min_support=0.3, rounding="ceil")
    )


def test_block_with_nothing_frequent_still_counts(spark):
    rows = [(0, [1, 2])] * 10 + [(1, [i]) for i in range(10)]
    local = M.mine_blocks(frame(spark, rows), min_support=0.5)
    assert local.n_blocks == 2
    assert {tuple(r["items"]) for r in M.merge_half(local).collect()} == {(1, 2)}
    assert M.merge_by_vote(local.itemsets, 2).count() == 0


def test_nothing_frequent_at_all(spark):
    local = M.mine_blocks(frame(spark, [(0, [i]) for i in range(9)]), min_count=2)
    assert local.itemsets.count() == 0 and local.itemsets.columns == ["block_id", "items", "freq"]


def test_unsorted_baskets_with_repeats(spark):
    local = M.mine_blocks(frame(spark, [(0, [3, 1, 3]), (0, [1, 3])]), min_count=2)
    assert found(local) == {(0, (1,)): 2, (0, (3,)): 2, (0, (1, 3)): 2}


def test_supports_never_grow_with_length(spark, skewed):
    freq = found(M.mine_blocks(frame(spark, skewed), min_support=0.05))
    for (block, items), n in freq.items():
        for i in range(len(items)):
            if len(items) > 1:
                assert freq[block, items[:i] + items[i + 1 :]] >= n


def test_arguments_are_checked(spark):
    rows = frame(spark, [(0, [1])])
    with pytest.raises(ValueError):
        M.mine_blocks(rows)
    with pytest.raises(ValueError):
        M.mine_blocks(rows, min_support=0.1, min_count=3)
    with pytest.raises(ValueError):
        M.mine_blocks(rows, min_support=0.1, rounding="up")


def test_exact_equals_brute_force_and_one_block(spark):
    baskets = random_baskets(random.Random(8), 200)
    rows = frame(spark, [(0, b) for b in baskets])
    model = M.fit_exact(rows, 0.04)
    want = brute_itemsets(baskets, math.ceil(200 * 0.04))
    exact = {tuple(r["items"]): r.freq for r in M.exact_itemsets(model, 1).collect()}
    assert exact == want
    one_block = {tuple(r["items"]): r.freq for r in full_itemsets(rows, 0.04).collect()}
    assert one_block == {k: v for k, v in want.items() if len(k) > 1}


def test_rules_agree_with_the_built_in_ones(spark):
    baskets = random_baskets(random.Random(9), 150, items=8)
    rows = frame(spark, [(0, b) for b in baskets])
    model = M.fit_exact(rows, 0.05, 0.4)
    key = lambda r: (tuple(sorted(r.antecedent)), r.consequent)
    built_in = {(k[0], k[1][0]): r.confidence for r in M.exact_rules(model).collect() for k in [key(r)]}
    ours = {
        key(r): r.confidence
        for r in M.rules_from_itemsets(M.exact_itemsets(model, 1), 0.4).collect()
    }
    assert ours == pytest.approx(built_in) and ours


def test_toy_rules(spark):
    """Three baskets of four items, support 0, confidence 0.99."""
    rows = frame(spark, [(0, [1, 2, 3, 4]), (0, [1, 2, 5, 6]), (0, [1, 3, 5, 7])])
    model = M.fit_exact(rows, 1e-9, 0.99)
    rules = {(tuple(r.antecedent), r.consequent[0]) for r in M.exact_rules(model).collect()}
    assert ((2,), 1) in rules and ((1,), 2) not in rules


def test_confidence_without_rules_is_null(spark):
    local = M.mine_blocks(frame(spark, [(0, [1]), (0, [2])]), min_count=1)
    rules = M.rules_from_itemsets(local.itemsets, 0.5, ["block_id"])
    row = M.confidence_stats(rules, local.blocks).first()
    assert row.avg_confidence is None and row.n_rules == 0


def test_toy_votes(spark):
    """With one model the merge returns its rows unchanged."""
    rows = [(0, [1, 2], 5), (0, [1, 3], 4), (0, [2, 3], 7)]
    table = spark.createDataFrame(rows, "block_id bigint, items array<int>, freq bigint")
    merged = {tuple(r["items"]): r.freq for r in M.merge_by_vote(table, 0.5).collect()}
    assert merged == {(1, 2): 5, (1, 3): 4, (2, 3): 7}


def test_merges(spark):
    rows = [(0, [1, 2], 5), (1, [1, 2], 8), (0, [3, 4], 2), (2, [1, 2], 9), (3, [1], 9)]
    table = spark.createDataFrame(rows, "block_id bigint, items array<int>, freq bigint")
    vote = {tuple(r["items"]): r.freq for r in M.merge_by_vote(table, 2.0).collect()}
    assert vote == {(1, 2): 7}  # 22 div 3, over the blocks that voted
    assert {tuple(r["items"]): (r.total, r.votes) for r in M.merge_sum(table).collect()} == {
        (1, 2): (22, 3),
        (3, 4): (2, 1),
    }
    assert {tuple(r["items"]): r.freq for r in M.merge_max(table).collect()} == {
        (1, 2): 9,
        (3, 4): 2,
    }


def test_sampled_blocks_are_reblocked(spark):
    rows = [(i, b) for i, b in enumerate(random_baskets(random.Random(2), 400))]
    table = assign_blocks(spark.createDataFrame(rows, "txn_id bigint, items array<int>"), 8, "txn_id")
    local = sampled_local_itemsets(table, 4, 0.1, m=3)
    assert local.n_blocks == 12
    assert sampled_local_itemsets(table, 4, 0.1).n_blocks == 4


def test_keys_sort_numbers_as_numbers(spark):
    row = spark.createDataFrame([([10, 9, 2, 9],)], "items array<int>").select(
        itemset_key(canonical(F.col("items"))).alias("key")
    )
    assert row.first().key == "{2,9,10}"
    back = row.select(parse_key(F.col("key"), "int").alias("items")).first()["items"]
    assert back == [2, 9, 10]


def brute_rules(counts, min_confidence):
    """{(left, right): freq} over {itemset: count}"""
    return {
        (left, tuple(sorted(set(whole) - set(left)))): n
        for whole, n in counts.items()
        for size in range(1, len(whole))
        for left in combinations(whole, size)
        if n / counts[left] >= min_confidence
    }


@pytest.mark.parametrize("min_confidence", [0.0, 0.3, 0.7])
def test_rules_of_any_length_equal_brute_force(spark, min_confidence, monkeypatch):
    monkeypatch.setattr("blockmill.runtime.BROADCAST_ROWS", 3)
    rng = random.Random(12)
    groups = {None: random_baskets(rng, 40, 6, 5), 1: random_baskets(rng, 60, 5, 4), 2: [[3]]}
    rows = [(g, list(items), n) for g, b in groups.items() for items, n in brute_itemsets(b, 2 if g else 1).items()]
    df = spark.createDataFrame(rows, "block_id bigint, items array<int>, freq bigint")
    got = rules.rules(df, min_confidence, ["block_id"]).collect()
    want = {
        (g, *key): n
        for g, b in groups.items()
        for key, n in brute_rules(brute_itemsets(b, 2 if g else 1), min_confidence).items()
    }
    assert {(r.block_id, tuple(r.antecedent), tuple(r.consequent)): r.freq for r in got} == want
    assert len(got) == len(want)


def test_rules_of_the_three_by_four_matrix(spark):
    """Every basket has items of its own, so every rule within a basket is certain."""
    baskets = [[i * 4 + j for j in range(4)] for i in range(3)]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<int>").withColumn("block_id", F.lit(0).cast("bigint"))
    mined = M.mine_blocks(df, min_count=1).itemsets
    got = rules.rules(mined, 0.99).collect()
    assert len(got) == 3 * (3**4 - 2 * 2**4 + 1) and {r.confidence for r in got} == {1.0}
    short = rules.rules(mined, 0.99, max_right=1).collect()
    assert len(short) == 3 * (4 * 3 + 4 * 3 + 4) and all(len(r.consequent) == 1 for r in short)
    assert rules.rules(mined.limit(0), 0.5).count() == 0


def test_levels_find_what_fp_growth_finds(spark):
    rng = random.Random(21)
    rows = random_baskets(rng, 150) * 3 + [[]] * 4
    df = spark.createDataFrame([(r,) for r in rows], "items array<int>").cache()
    for size in (1, 2):
        want = M.exact_itemsets(M.fit_exact(df, 0.05), size)
        got = M.exact_by_levels(df, 0.05, size)
        assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blockings_are_mined_without_a_copy_of_the_baskets_for_each(spark, monkeypatch):
    rng = random.Random(14)
    baskets = [(n, b) for n, b in enumerate(random_baskets(rng, 100, items=9))] + [(None, [1, 2]), (7, [3, 1, 3])]
    df = runtime.store(spark.createDataFrame(baskets, "txn_id long, items array<int>").coalesce(1), "baskets")
    kept, persist = [], type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda rows, *at: kept.append(persist(rows, *at).count()) or rows)
    itemsets, _ = sweeps.mine_blockings(df, [1, 3, 5], 0.1, max_len=3)
    found = itemsets.collect()
    hashes = {r.txn_id: r.h for r in df.select("txn_id", bucket_hash(42, F.col("txn_id")).alias("h")).collect()}
    for n in (1, 3, 5):
        want = brute_blocks([(hashes[t] % n, set(b)) for t, b in baskets], 0.1, 3)
        assert {(r.block_id.block, tuple(r["items"])): r.freq for r in found if r.n == n} == want
    assert kept[0] <= sum(len(set(b)) - 1 for _, b in baskets)
