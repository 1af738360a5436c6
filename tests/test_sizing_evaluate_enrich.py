import math
import random

import pytest
from pyspark.sql import functions as F

from blockmill.operators import enrich, evaluate, sizing
from blockmill.operators.mining import mine_blocks
from blockmill.plans import sweeps
from tests.helpers import brute_blocks, brute_itemsets, random_baskets


@pytest.fixture(scope="module")
def blocked():
    rng = random.Random(1)
    return [(rng.randrange(4), b) for b in random_baskets(rng, 240, items=8)]


@pytest.fixture(scope="module")
def local(spark, blocked):
    return mine_blocks(
        spark.createDataFrame(blocked, "block_id bigint, items array<int>"), min_support=0.1
    )


def test_stats_and_sample_size(local, blocked):
    sizes = {b: sum(1 for x, _ in blocked if x == b) for b in range(4)}
    found = brute_blocks(blocked, 0.1)
    support = {}
    for (block, items), n in found.items():
        support[items] = max(support.get(items, 0), n / sizes[block])
    row = sizing.itemset_stats(local).first()
    multi = {k: v for k, v in support.items() if len(k) > 1}
    assert row.r_max == pytest.approx(max(support.values()))
    assert row.r_max_multi == pytest.approx(max(multi.values()))
    assert (row.n_itemsets, row.n_itemsets_multi) == (len(support), len(multi))
    size = sizing.sample_size(F.col("r_max"), F.col("n_itemsets"), 0.05, 0.01)
    want = row.r_max**2 / (2 * 0.05**2) * math.log(2 * row.n_itemsets / 0.01)
    assert sizing.itemset_stats(local).select(size).first()[0] == pytest.approx(want)


def test_quantile_is_the_lower_index(spark):
    rows = [(b, [1]) for b in range(10) for _ in range(b + 1)]
    rows += [(b, [2]) for b in range(10) for _ in range(20 - b)]
    local = mine_blocks(
        spark.createDataFrame(rows, "block_id bigint, items array<int>"), min_count=1
    )
    per_block = sorted(max(b + 1, 20 - b) / 21 for b in range(10))
    assert sizing.r_max_quantile(local).first()[0] == pytest.approx(per_block[8])


def test_scores(spark):
    approx = spark.createDataFrame([([2, 1], 3), ([3, 4], 1)], "items array<int>, freq bigint")
    exact = spark.createDataFrame(
        [([1, 2], 10), ([5, 6], 9), ([7, 8], 9)], "items array<int>, freq bigint"
    )
    row = evaluate.evaluate_itemsets(approx, exact).first()
    assert (row.tp, row.fp, row.fn) == (1, 1, 2)
    assert row.precision == 0.5 and row.recall == pytest.approx(1 / 3)
    error = evaluate.support_error(approx, exact, 4, 100).first()
    assert (error.error, error.ase) == (2.0, 0.02)


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], "items array<int>, freq bigint")
    row = evaluate.evaluate_itemsets(none, none).first()
    assert row.tp == 0 and row.precision is None and row.recall is None


def test_one_block_agrees_with_itself(spark):
    baskets = random_baskets(random.Random(3), 120, items=8)
    rows = spark.createDataFrame(list(enumerate(baskets)), "txn_id bigint, items array<int>")
    for row in sweeps.sweep_supports(rows, [0.1, 0.2], 1, 120).collect():
        assert (row.precision, row.recall, row.error) == (1.0, 1.0, 0.0)
    scores = sweeps.sweep_block_counts(rows, [1, 2, 4], 0.1, 120).collect()
    truth = {k for k in brute_itemsets(baskets, 12) if len(k) > 1}
    assert [r.precision for r in scores if r.n == 1] == [1.0]
    assert {r.n for r in scores} == {1, 2, 4} and {r.n_exact for r in scores} == {len(truth)}


def test_enrichment_counts_unknown_goods_as_a_category(spark):
    sets = spark.createDataFrame(
        [(["a", "b"], 4), (["a", "x"], 3), (["x", "y"], 2)], "items array<string>, freq bigint"
    )
    goods = spark.createDataFrame(
        [("a", 1.005, "t"), ("b", 2.25, "t")], "name string, price double, type string"
    )
    got = {r.fim: r for r in enrich.enrich_itemsets(sets, goods).collect()}
    assert got["{a,b}"].total_price == 3.26 and got["{a,b}"].one_category
    assert not got["{a,x}"].one_category
    assert got["{a,x}"].categories == sorted(["t", enrich.UNKNOWN_TYPE])
    assert got["{x,y}"].one_category and got["{x,y}"].total_price == 0.0
    report = enrich.itemset_report(sets, goods, 10)
    assert [r.fim for r in enrich.top_by(report, "support", 2).collect()] == ["{a,b}", "{a,x}"]
    assert [r.fim for r in enrich.single_category(report).collect()] == ["{a,b}", "{x,y}"]
    enrich.register_report(report, "sets")
    top = spark.sql("SELECT fim FROM sets WHERE one_category ORDER BY total_price DESC LIMIT 1")
    assert top.first().fim == "{a,b}"
