"""Sources, sinks, block sampling and per-block statistics over the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.functions.itemsets import itemset_key
from blockmill.functions.vectors import features_of, label_of
from blockmill.operators import blocks as B
from blockmill.operators import local as L
from blockmill.runtime import scratch_path
from blockmill.sources import readers as R
from blockmill.sources import writers as W
from workload.fixtures import (
    N_BLOCKS,
    SEED,
    baskets,
    goods,
    sql_draw,
    sql_goods,
    sql_hash,
    sql_key,
    sql_pairs,
    table,
)
from workload.registry import query

_H = sql_hash(SEED, "o_orderkey")
_BLOCKED = f"ob AS (SELECT o_orderkey, o_totalprice, {_H} % {N_BLOCKS} AS block_id FROM orders)"
_RANKED = (
    "rb AS (SELECT block_id, row_number() OVER (ORDER BY "
    f"{sql_draw(SEED)}) AS rn, count(*) OVER () AS n_blocks "
    "FROM (SELECT DISTINCT block_id FROM ob))"
)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


def blocked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.assign_blocks(orders(spark, sf_dir), N_BLOCKS, "o_orderkey", SEED)


# --- sources ---------------------------------------------------------------


@query(
    "src_blocks",
    f"""WITH b AS (SELECT o_orderkey, {_H} % 5 AS k FROM orders)
    SELECT f.fmt, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key,
      CAST(sum(o_orderkey) AS BIGINT) AS key_sum
    FROM b, (SELECT unnest(['orc', 'parquet', 'json', 'csv', 'text']) AS fmt) f GROUP BY f.fmt, k""",
)
def src_blocks(spark, sf_dir):
    """Five files in nested folders, one per block, in each of five formats; what
    lies in each block tells the blocks apart."""
    keys = orders(spark, sf_dir).select("o_orderkey")
    by_file = B.assign_blocks(keys, 5, "o_orderkey", SEED).withColumn(
        "value", F.col("o_orderkey").cast("string")
    )
    parts = []
    for fmt in ("orc", "parquet", "json", "csv", "text"):
        path = scratch_path(spark, f"orders-{fmt}")
        written = by_file.select("value", B.BLOCK) if fmt == "text" else by_file.select("o_orderkey", B.BLOCK)
        written.repartition(B.BLOCK).write.partitionBy(B.BLOCK).format(fmt).save(path)
        options = {"inferSchema": "true"} if fmt == "csv" else {}
        rows = R.read_blocks(spark, path, fmt, recursiveFileLookup="true", **options)
        key = F.col(rows.columns[0]).cast("bigint")
        parts.append(
            rows.groupBy("block_id").agg(
                F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key"),
                F.max(key).alias("last_key"), F.sum(key).alias("key_sum"),
            ).select(F.lit(fmt).alias("fmt"), "n_rows", "first_key", "last_key", "key_sum")
        )
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


@query(
    "src_inline_csv",
    "SELECT p_partkey AS partkey, p_brand AS brand, p_size AS size, "
    "round(p_retailprice, 6) AS price FROM part",
)
def src_inline_csv(spark, sf_dir):
    text = table(spark, sf_dir, "part").select(
        F.concat_ws(",", "p_partkey", "p_brand", "p_size", "p_retailprice").alias("line")
    )
    parsed = R.csv_column("line", "partkey bigint, brand string, size int, price double")
    return text.select(parsed.alias("row")).select(
        "row.partkey", "row.brand", "row.size", F.round("row.price", 6).alias("price")
    )


@query(
    "src_inline_json",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
def src_inline_json(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return events.select("event_id", R.json_column("props", "k int")["k"].alias("k"))


@query(
    "src_text_blocks",
    f"""WITH {sql_pairs('p_size')}, g AS (SELECT txn_id, {sql_hash(SEED, 'txn_id')} % 5 AS k,
      array_to_string(list(item ORDER BY item), ' ') AS value FROM base GROUP BY txn_id)
    SELECT count(*) AS n_rows, CAST(sum(length(value)) AS BIGINT) AS n_chars, min(value) AS first_value
    FROM g GROUP BY k""",
)
def src_text_blocks(spark, sf_dir):
    path = scratch_path(spark, "lines")
    lines = B.assign_blocks(baskets(spark, sf_dir, "p_size"), 5, "txn_id", SEED).select(
        F.array_join(F.col("items").cast("array<string>"), " ").alias("value"), B.BLOCK
    )
    lines.repartition(B.BLOCK).write.partitionBy(B.BLOCK).option("lineSep", ";").text(path)
    blocks = R.read_text_blocks(spark, path, delimiter=";", recursiveFileLookup="true")
    return blocks.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("value")).alias("n_chars"), F.min("value").alias("first_value")
    ).drop("block_id")


@query(
    "src_txn_text",
    f"WITH {sql_pairs('p_size')} SELECT txn_id, {sql_key('list(item ORDER BY item)')} AS items "
    "FROM base GROUP BY txn_id",
)
def src_txn_text(spark, sf_dir):
    lines = baskets(spark, sf_dir, "p_size").select(
        "txn_id", F.array_join(F.col("items").cast("array<string>"), " ").alias("value")
    )
    return lines.select("txn_id", itemset_key(R.basket_of(F.col("value"))).alias("items"))


@query(
    "src_vec_text",
    """SELECT vec_id, label, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first_value,
     round(embedding[-1]::DOUBLE, 6) AS last_value,
     round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""",
)
def src_vec_text(spark, sf_dir):
    text = F.concat_ws(
        ",", F.col("embedding").cast("array<double>").cast("array<string>"), F.col("label").cast("string")
    )
    lines = table(spark, sf_dir, "embeddings").select("vec_id", text.alias("value"))
    vec = features_of(F.col("value"))
    return lines.select("vec_id", label_of(F.col("value")).alias("label"), vec.alias("vec")).select(
        "vec_id",
        "label",
        F.size("vec").cast("bigint").alias("n"),
        F.round(F.get("vec", F.lit(0)), 6).alias("first_value"),
        F.round(F.element_at("vec", -1), 6).alias("last_value"),
        F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query("src_goods_json", f"WITH {sql_goods()} SELECT name, price, type FROM goods")
def src_goods_json(spark, sf_dir):
    path = scratch_path(spark, "goods")
    goods(spark, sf_dir).withColumnRenamed("type", "Type").write.json(path)
    return R.read_goods(spark, path)


@query("snk_parquet", f"WITH {sql_pairs()} SELECT txn_id, {sql_key('list(item ORDER BY item)')} AS items FROM base GROUP BY txn_id")
def snk_parquet(spark, sf_dir):
    path = scratch_path(spark, "out")
    W.write_parquet(baskets(spark, sf_dir), path)
    return spark.read.parquet(path).select("txn_id", itemset_key(F.col("items")).alias("items"))


def _item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        baskets(spark, sf_dir, "p_size")
        .select(F.explode("items").alias("item"))
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("freq"))
        .select(F.array("item").alias("items"), "freq")
    )


_ITEM_SQL = (
    f"WITH {sql_pairs('p_size')} SELECT '{{' || item || '}}' AS fim, count(*) AS freq "
    "FROM base GROUP BY item"
)


@query("src_fim_csv", _ITEM_SQL)
def src_fim_csv(spark, sf_dir):
    path = scratch_path(spark, "itemsets")
    W.write_itemset_csv(_item_counts(spark, sf_dir), path)
    return R.read_itemset_csv(spark, path).select("fim", F.col("freq").cast("bigint").alias("freq"))


@query("snk_csv", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
def snk_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    W.write_csv(orders(spark, sf_dir), path)
    back = spark.read.schema("o_orderkey bigint, o_totalprice double").csv(path)
    return back.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


_REBLOCK = range(1, 22, 2)


@query(
    "snk_reblock",
    " UNION ALL ".join(
        f"SELECT {n} AS n, {_H} % {n} AS block_id, count(*) AS n_rows, "
        f"min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2"
        for n in _REBLOCK
    ),
)
def snk_reblock(spark, sf_dir):
    parts = []
    for n in _REBLOCK:
        path = scratch_path(spark, f"blocks{n}")
        W.reblock(orders(spark, sf_dir), n, "o_orderkey", path, SEED)
        parts.append(R.read_stored_blocks(spark, path).withColumn("n", F.lit(n)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("n", F.col("block_id").cast("bigint").alias("block_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key")
    )


# --- block sampling --------------------------------------------------------


@query("to_blocks", f"WITH {_BLOCKED} SELECT o_orderkey, block_id FROM ob")
def to_blocks(spark, sf_dir):
    return blocked_orders(spark, sf_dir).select("o_orderkey", "block_id")


@query(
    "deal_blocks",
    f"""WITH h AS (SELECT o_orderkey, year(o_orderdate)::BIGINT AS src, {_H} AS h FROM orders)
    SELECT o_orderkey, (row_number() OVER (PARTITION BY src ORDER BY h, o_orderkey)
      + {sql_hash(SEED, 'src')}) % {N_BLOCKS} AS block_id FROM h""",
)
def deal_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").cast("bigint").alias("src")
    )
    return B.deal_blocks(rows, N_BLOCKS, "o_orderkey", "src", SEED, rows_per_stripe=500).select(
        "o_orderkey", "block_id"
    )


@query(
    "sub_blocks_first",
    f"WITH {_BLOCKED}, r AS (SELECT *, dense_rank() OVER (ORDER BY block_id) AS rn FROM ob) "
    "SELECT o_orderkey, block_id FROM r WHERE rn <= 4",
)
def sub_blocks_first(spark, sf_dir):
    return B.first_blocks(blocked_orders(spark, sf_dir), 4, N_BLOCKS).select("o_orderkey", "block_id")


@query("sub_blocks_at", f"WITH {_BLOCKED} SELECT o_orderkey, block_id FROM ob WHERE block_id IN (1, 5, 9)")
def sub_blocks_at(spark, sf_dir):
    return B.blocks_at(blocked_orders(spark, sf_dir), [1, 5, 9]).select("o_orderkey", "block_id")


@query(
    "random_blocks",
    f"WITH {_BLOCKED}, {_RANKED} SELECT o_orderkey, block_id FROM ob "
    "WHERE block_id IN (SELECT block_id FROM rb WHERE rn <= 8 AND n_blocks >= 8)",
)
def random_blocks(spark, sf_dir):
    return B.random_blocks(blocked_orders(spark, sf_dir), 8, SEED, N_BLOCKS).select("o_orderkey", "block_id")


@query(
    "two_random_blocks",
    f"WITH {_BLOCKED}, {_RANKED} SELECT o_orderkey, block_id, "
    "CASE WHEN rn <= 3 THEN 1 ELSE 2 END AS side FROM ob JOIN rb USING (block_id) "
    "WHERE rn <= 7 AND n_blocks >= 7",
)
def two_random_blocks(spark, sf_dir):
    return B.two_random_blocks(blocked_orders(spark, sf_dir), 3, 4, SEED, N_BLOCKS).select(
        "o_orderkey", "block_id", "side"
    )


@query(
    "train_predict_blocks",
    f"WITH {_BLOCKED} SELECT o_orderkey, block_id, CASE WHEN block_id IN (7, 2, 11) "
    "THEN 'train' ELSE 'predict' END AS side FROM ob WHERE block_id IN (7, 2, 11, 0, 15)",
)
def train_predict_blocks(spark, sf_dir):
    rows = blocked_orders(spark, sf_dir).select("o_orderkey", "block_id")
    train, predict = B.train_predict_blocks(rows, [7, 2, 11, 0, 15, 4], 3, 5)
    return train.withColumn("side", F.lit("train")).unionByName(
        predict.withColumn("side", F.lit("predict"))
    )


@query(
    "draw_block_ids",
    f"""WITH {_BLOCKED}, d AS (SELECT DISTINCT id % {N_BLOCKS} AS block_id FROM
      (SELECT range AS id FROM range(10000) ORDER BY {sql_hash(SEED, 'range')}, range LIMIT 6))
    SELECT o_orderkey, block_id FROM ob JOIN d USING (block_id)""",
)
def draw_block_ids(spark, sf_dir):
    drawn = B.draw_block_ids(spark, 10_000, 6, N_BLOCKS, SEED)
    return blocked_orders(spark, sf_dir).join(F.broadcast(drawn), "block_id", "left_semi").select(
        "o_orderkey", "block_id"
    )


@query(
    "random_files",
    f"WITH {_BLOCKED} SELECT 100 AS wanted, o_orderkey, o_totalprice, block_id, NULL::BIGINT AS n FROM ob "
    "UNION ALL SELECT 5, NULL, NULL, NULL, 5",
)
def random_files(spark, sf_dir):
    """A hundred files are more than the table has: all its rows. Of five random files,
    which are named by chance, only their number ``n`` is known."""
    path = scratch_path(spark, "files")
    W.write_blocks(blocked_orders(spark, sf_dir), path)

    def read(n: int) -> DataFrame:
        rows = R.read_files(spark, R.random_files(spark, path, n, SEED))
        return B.assign_blocks(rows, N_BLOCKS, "o_orderkey", SEED).withColumn("wanted", F.lit(n))

    every = read(100).select("wanted", "o_orderkey", "o_totalprice", "block_id")
    few = read(5).select("wanted", "_metadata.file_path").groupBy("wanted").agg(
        F.count_distinct("file_path").alias("n")
    )
    return every.unionByName(few, allowMissingColumns=True)


@query(
    "random_stored_blocks",
    f"WITH {_BLOCKED}, {_RANKED} SELECT o_orderkey, o_totalprice, block_id FROM ob "
    "WHERE block_id IN (SELECT block_id FROM rb WHERE rn <= 5)",
)
def random_stored_blocks(spark, sf_dir):
    """Rows of five random blocks of a stored table."""
    path = scratch_path(spark, "files")
    W.write_blocks(blocked_orders(spark, sf_dir), path)
    return R.random_stored_blocks(spark, path, 5, SEED).select(
        "o_orderkey", "o_totalprice", F.col("block_id").cast("bigint").alias("block_id")
    )


@query(
    "random_split",
    f"SELECT o_orderkey, CASE WHEN {_H} % 1000 < 900 THEN 0 ELSE 1 END AS split FROM orders",
)
def random_split(spark, sf_dir):
    return B.random_split(orders(spark, sf_dir), "o_orderkey", [900, 100], SEED).select(
        "o_orderkey", "split"
    )


@query(
    "reblock_chain",
    f"WITH a AS (SELECT o_orderkey, {_H} % 50 AS b1 FROM orders), "
    "r AS (SELECT *, dense_rank() OVER (ORDER BY b1) AS rn FROM a) "
    f"SELECT o_orderkey, {sql_hash(SEED + 1, 'o_orderkey')} % 20 AS block_id FROM r WHERE rn <= 15",
)
def reblock_chain(spark, sf_dir):
    return B.reblock_chain(orders(spark, sf_dir), "o_orderkey", 50, 15, 20, SEED).select(
        "o_orderkey", "block_id"
    )


# --- per-block functions ---------------------------------------------------


@query("block_collect", f"WITH {_BLOCKED} SELECT o_orderkey, block_id FROM ob WHERE block_id < 1")
def block_collect(spark, sf_dir):
    return L.block_collect(blocked_orders(spark, sf_dir), n_blocks=N_BLOCKS).select("o_orderkey", "block_id")


@query("block_min", f"WITH {_BLOCKED} SELECT min(o_totalprice) AS local_min FROM ob WHERE block_id < 1")
def block_min(spark, sf_dir):
    return L.block_min(blocked_orders(spark, sf_dir), "o_totalprice", N_BLOCKS)


@query("block_max", f"WITH {_BLOCKED} SELECT max(o_totalprice) AS local_max FROM ob WHERE block_id < 1")
def block_max(spark, sf_dir):
    return L.block_max(blocked_orders(spark, sf_dir), "o_totalprice", N_BLOCKS)


@query(
    "block_describe",
    f"""WITH {_BLOCKED}, q AS (SELECT l_quantity FROM lineitem JOIN ob ON l_orderkey = o_orderkey
      WHERE block_id < 2)
    SELECT s AS summary, round(v, 6) AS l_quantity FROM (
      SELECT unnest(['count', 'mean', 'stddev', 'min', 'max']) AS s,
        unnest([count(l_quantity), avg(l_quantity), stddev_samp(l_quantity), min(l_quantity),
          max(l_quantity)]) AS v FROM q)""",
)
def block_describe(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    blocks = B.assign_blocks(lines, N_BLOCKS, "l_orderkey", SEED)
    return L.block_describe(blocks, ["l_quantity"], 2, N_BLOCKS).select(
        "summary", F.round(F.col("l_quantity").cast("double"), 6).alias("l_quantity")
    )


@query(
    "block_summary",
    """SELECT unnest(['count', 'mean', 'stddev', 'min', 'max']) AS summary,
      unnest([count(l_quantity), round(avg(l_quantity), 6), round(stddev_samp(l_quantity), 6),
        min(l_quantity), max(l_quantity)]) AS l_quantity,
      unnest([count(l_flag)::VARCHAR, NULL, NULL, min(l_flag), max(l_flag)]) AS l_flag
    FROM (SELECT l_quantity, l_returnflag AS l_flag FROM lineitem)""",
)
def block_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_returnflag").alias("l_flag"))
    return L.block_summary(rows, ["count", "mean", "stddev", "min", "max"]).select(
        "summary", F.round(F.col("l_quantity").cast("double"), 6).alias("l_quantity"), "l_flag"
    )


def _price_band(block: int, piece: pd.DataFrame) -> pd.DataFrame:
    bands = pd.cut(piece["o_totalprice"], [-1, 100_000, 300_000, 1e12], labels=["low", "mid", "high"])
    named = bands.astype(object).where(bands.notna(), None)  # no price, no band
    return pd.DataFrame({"block_id": block, "o_orderkey": piece["o_orderkey"], "band": named})


@query(
    "block_map",
    f"WITH {_BLOCKED} SELECT block_id, o_orderkey, CASE WHEN o_totalprice <= 100000 THEN 'low' "
    "WHEN o_totalprice <= 300000 THEN 'mid' WHEN o_totalprice > 300000 THEN 'high' END AS band FROM ob WHERE block_id < 3",
)
def block_map(spark, sf_dir):
    return L.block_map(
        blocked_orders(spark, sf_dir), 3, _price_band, "block_id bigint, o_orderkey bigint, band string", N_BLOCKS
    )


@query(
    "block_reduce",
    f"WITH {_BLOCKED} SELECT block_id, count(*) AS n_rows, max(o_totalprice) - min(o_totalprice) "
    "AS spread FROM ob WHERE block_id < 3 GROUP BY block_id",
)
def block_reduce(spark, sf_dir):
    return L.block_reduce(
        blocked_orders(spark, sf_dir),
        3,
        F.count(F.lit(1)).alias("n_rows"),
        (F.max("o_totalprice") - F.min("o_totalprice")).alias("spread"),
        n_blocks=N_BLOCKS,
    )


def _moments(block: int, piece: pd.DataFrame) -> pd.DataFrame:
    x, y = piece["l_quantity"], piece["l_extendedprice"]
    return pd.DataFrame(
        {
            "block_id": [block],
            "n": [len(piece)],
            "sx": [x.sum()],
            "sy": [y.sum()],
            "sxx": [(x * x).sum()],
            "sxy": [(x * y).sum()],
        }
    )


_SLOPE_SQL = (
    f"lb AS (SELECT {sql_hash(SEED, 'l_orderkey')} % {N_BLOCKS} AS block_id, "
    "l_quantity, l_extendedprice FROM lineitem)"
)


def block_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One local model per block: the slope of price over quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    blocks = B.assign_blocks(lines, N_BLOCKS, "l_orderkey", SEED)
    sums = ["n", "sx", "sy", "sxx", "sxy"]
    n, sx, sy, sxx, sxy = map(F.col, sums)
    return L.block_lo(
        blocks,
        _moments,
        "block_id bigint, n bigint, sx double, sy double, sxx double, sxy double",
        [F.sum(name).alias(name) for name in sums],
        ((n * sxy - sx * sy) / (n * sxx - sx * sx)).alias("slope"),
    )


@query(
    "block_lo",
    f"WITH {_SLOPE_SQL} SELECT block_id, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope "
    "FROM lb GROUP BY block_id",
)
def block_lo(spark, sf_dir):
    return block_slopes(spark, sf_dir).select("block_id", F.round("slope", 4).alias("slope"))


@query(
    "block_go",
    f"WITH {_SLOPE_SQL} SELECT count(*) AS n_models, round(avg(slope), 4) AS slope FROM (SELECT "
    "block_id, regr_slope(l_extendedprice, l_quantity) AS slope FROM lb GROUP BY block_id)",
)
def block_go(spark, sf_dir):
    return L.block_go(
        block_slopes(spark, sf_dir),
        lambda models: models.agg(
            F.count(F.lit(1)).alias("n_models"), F.round(F.avg("slope"), 4).alias("slope")
        ),
    )
