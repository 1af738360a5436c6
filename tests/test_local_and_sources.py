import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockmill.operators import local as L
from blockmill.operators.blocks import assign_blocks
from blockmill.operators.blocks import random_blocks
from blockmill.sources import readers as R
from blockmill.sources import writers as W
from tests.helpers import DATA
from workload import block_queries


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(600).select(
        F.col("id").alias("key"), (F.col("id") * 7 % 113).cast("double").alias("v")
    )
    return assign_blocks(made, 6, "key").cache()


def test_summary_rejects_what_it_does_not_know(rows):
    for bad in ("median", "101%", "-1%", "x%"):
        with pytest.raises(ValueError):
            L.block_summary(rows, [bad])
    names = [r.summary for r in L.block_summary(rows.select("v")).collect()]
    assert names == list(L.DEFAULT_STATISTICS)
    assert [r.summary for r in L.block_summary(rows.select("v"), ["95%", "max"]).collect()] == [
        "95%",
        "max",
    ]


def test_local_extremes_come_from_the_first_block(rows):
    first = rows.where("block_id = 0").agg(F.min("v"), F.max("v")).first()
    assert L.block_min(rows, "v").first()[0] == first[0]
    assert L.block_max(rows, "v").first()[0] == first[1]


def test_map_and_fold_do_not_depend_on_pieces(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        doubled = L.block_map(
            rows, 2, lambda b, p: pd.DataFrame({"block_id": b, "v": p["v"] * 2}), "block_id bigint, v double"
        )
        want = rows.where("block_id < 2").agg(F.sum("v") * 2).first()[0]
        assert doubled.agg(F.sum("v")).first()[0] == want
        sums = L.block_fold(
            rows,
            lambda b, p: pd.DataFrame({"block_id": [b], "n": [len(p)], "s": [p["v"].sum()]}),
            "block_id bigint, n bigint, s double",
            F.sum("n").alias("n"),
            F.sum("s").alias("s"),
        )
        got = {r.block_id: (r.n, r.s) for r in sums.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = rows.groupBy("block_id").agg(F.count("v").alias("n"), F.sum("v").alias("s")).collect()
    assert got == {r.block_id: (r.n, r.s) for r in plain}


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv", "text"])
def test_files_are_blocks_longest_first(spark, tmp_path, fmt):
    path = str(tmp_path / f"some {fmt}+files")
    size = F.pow(F.lit(2), F.col("id") % 5).cast("int")
    rows = spark.range(50).select(F.explode(F.array_repeat("id", size)).alias("id"), F.col("id").alias("g"))
    lines = rows.select("g", F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"))
    for g in range(5):
        one = lines.where(F.col("g") % 5 == g).drop("g").coalesce(1)
        one.write.mode("append").format(fmt).save(path)
    blocks = R.read_text_blocks(spark, path) if fmt == "text" else R.read_blocks(spark, path, fmt)
    sizes = [r["count"] for r in blocks.groupBy("block_id").count().orderBy("block_id").collect()]
    assert sum(sizes) == rows.count() and len(sizes) == 5
    if fmt in ("json", "csv", "text"):
        assert sizes == sorted(sizes, reverse=True)


def test_files_in_nested_folders(spark, tmp_path):
    path = str(tmp_path / "top")
    for n in range(5):
        spark.range(n * 40, n * 40 + 40).coalesce(1).write.parquet(f"{path}/a{n}/b{n}")
    rows = R.read_blocks(spark, path, recursiveFileLookup="true")
    assert rows.count() == 200 and rows.select("block_id").distinct().count() == 5
    some = R.read_blocks(spark, path, recursiveFileLookup="true", pathGlobFilter="*.parquet")
    assert some.count() == 200


def test_drawing_stored_blocks_reads_only_those(spark, tmp_path, rows):
    path = str(tmp_path / "stored")
    W.reblock(rows.drop("block_id"), 6, "key", path)
    assert sorted(r.block_id for r in R.stored_block_ids(spark, path).collect()) == list(range(6))
    drawn = R.random_stored_blocks(spark, path, 2, 7)
    same = random_blocks(R.read_stored_blocks(spark, path), 2, 7)
    assert sorted(r.key for r in drawn.collect()) == sorted(r.key for r in same.collect())
    plan = drawn._jdf.queryExecution()
    assert "PartitionFilters: [block_id" in plan.toString()
    assert plan.executedPlan().toString().count("FileScan") == 1
    assert R.random_stored_blocks(spark, path, 7, 7).count() == 0


def test_many_paths_and_delimiters(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2;3;4 5 6 7")
    (tmp_path / "b.txt").write_text("8;9")
    paths = [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]
    rows = R.read_text_blocks(spark, paths, ";").select(
        "block_id", R.basket_of(F.col("value")).alias("items")
    )
    got = sorted((r.block_id, r["items"]) for r in rows.collect())
    assert got == [(0, [1, 2]), (0, [3]), (0, [4, 5, 6, 7]), (1, [8]), (1, [9])]


def test_stored_blocks_prune_directories(spark, tmp_path, rows):
    path = str(tmp_path / "blocks")
    W.reblock(rows.drop("block_id"), 5, "key", path)
    W.reblock(rows.drop("block_id"), 4, "key", path)  # replaces
    back = R.read_stored_blocks(spark, path)
    assert back.count() == 600 and back.select("block_id").distinct().count() == 4
    plan = back.where(F.col("block_id").isin([1, 3]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [block_id" in plan


def test_csv_in_one_file_or_many(spark, tmp_path):
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    rows = spark.range(100).repartition(4)
    W.write_csv(rows, many)
    W.write_csv(rows, one, single_file=True)
    assert len(list((tmp_path / "many").glob("*.csv"))) == 4
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1


def test_itemset_csv_round_trip(spark, tmp_path):
    sets = spark.createDataFrame([([1, 2], 5), ([3, 10], 7)], "items array<int>, freq bigint")
    W.write_itemset_csv(sets, str(tmp_path / "s"))
    assert {tuple(r) for r in R.read_itemset_csv(spark, str(tmp_path / "s")).collect()} == {
        ("{1,2}", 5),
        ("{3,10}", 7),
    }


def test_random_files_gives_all_when_there_are_fewer(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(40).repartition(4).write.parquet(path)
    assert R.random_files(spark, path, 3).count() == 3
    assert R.random_files(spark, path, 9).count() == 4
    assert 0 < R.read_files(spark, R.random_files(spark, path, 3)).count() < 40


def test_goods_and_vectors_from_text(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"name": "1", "price": 2.5, "Type": "a"}\n')
    assert tuple(R.read_goods(spark, str(tmp_path / "g.json")).first()) == ("1", 2.5, "a")
    row = R.labelled_vectors(spark.createDataFrame([("0.5, 1,2.0,7.0",)], "value string")).first()
    assert row.label == 7 and list(row.features) == [0.5, 1.0, 2.0]


def test_written_tables_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    W.write_parquet(spark.range(5), path)
    W.write_parquet(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_random_files_query_gives_every_row(spark):
    """A hundred files are all there are: the rows of the whole table, not their number."""
    got = block_queries.random_files(spark, DATA)
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    rows = got.where("wanted = 100")
    assert sorted(tuple(r) for r in rows.select("o_orderkey", "o_totalprice").collect()) == sorted(
        tuple(r) for r in orders.select("o_orderkey", "o_totalprice").collect()
    )
    assert [r.n for r in got.where("wanted = 5").collect()] == [5]
