"""The given tables in the shapes the operators expect, with the same shapes in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.functions.hashing import DRAW_SEED
from blockmill.operators.baskets import form_baskets
from blockmill.operators.blocks import assign_blocks
from blockmill.runtime import store

SEED = 42
N_BLOCKS = 16
N_PICKED = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txn_id, l_partkey), one row per order line"""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("txn_id"), "l_partkey")


def blocked_lines(spark: SparkSession, sf_dir: str, n: int = N_BLOCKS) -> DataFrame:
    """Order lines, all lines of an order in the same block."""
    return assign_blocks(order_lines(spark, sf_dir), n, "txn_id", SEED)


def lines_to_baskets(
    spark: SparkSession, sf_dir: str, item: str = "p_brand"
) -> Callable[[DataFrame], DataFrame]:
    """Look up a part column and gather it per order."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(item).alias("item"))

    def prepare(lines: DataFrame) -> DataFrame:
        by = [name for name in lines.columns if name != "l_partkey"]
        return form_baskets(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), by)

    return prepare


def baskets(spark: SparkSession, sf_dir: str, item: str = "p_brand") -> DataFrame:
    """(txn_id, items): the distinct values of a part column per order"""
    return lines_to_baskets(spark, sf_dir, item)(order_lines(spark, sf_dir))


def blocked_baskets(
    spark: SparkSession, sf_dir: str, item: str = "p_brand", n: int = N_BLOCKS
) -> DataFrame:
    return assign_blocks(baskets(spark, sf_dir, item), n, "txn_id", SEED)


def stored_baskets(
    spark: SparkSession, sf_dir: str, item: str = "p_brand", n: int = N_BLOCKS
) -> DataFrame:
    """Blocked baskets written once, as mining reads them several times."""
    return store(blocked_baskets(spark, sf_dir, item, n), "baskets")


#: Brands the goods table leaves out, to meet unknown items.
UNPRICED = ("Brand#1", "Brand#2", "Brand#3")


def goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, price, type) per brand, without the unpriced ones"""
    return (
        table(spark, sf_dir, "part")
        .where(~F.col("p_brand").isin(*UNPRICED))
        .groupBy(F.col("p_brand").alias("name"))
        .agg(F.min("p_retailprice").alias("price"), F.min("p_type").alias("type"))
    )


def sql_goods() -> str:
    names = ", ".join(f"'{name}'" for name in UNPRICED)
    return (
        "goods AS (SELECT p_brand AS name, min(p_retailprice) AS price, min(p_type) AS type "
        f"FROM part WHERE p_brand NOT IN ({names}) GROUP BY p_brand)"
    )


_MASK = 2**32 - 1


def _hash_int(value: int, seed: int) -> int:
    """Murmur3 of one 32-bit word, to start from a literal seed column."""
    rotl = lambda x, r: ((x << r) & _MASK) | (x >> (32 - r))
    word = rotl((value & _MASK) * 0xCC9E2D51 & _MASK, 15) * 0x1B873593 & _MASK
    h = (rotl(seed ^ word, 13) * 5 + 0xE6546B64) & _MASK
    h ^= 4
    h = (h ^ (h >> 16)) * 0x85EBCA6B & _MASK
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & _MASK
    return h ^ (h >> 16)


def sql_hash(seed: int, key: str) -> str:
    """Murmur3 of (seed, bigint key), the SQL side of ``bucket_hash``."""

    def let(value: str, body: str) -> str:
        return f"list_transform([{value}], lambda x: {body})[1]"

    def mul(value: str, factor: int) -> str:
        return f"((({value}) * {factor}::UBIGINT) & {_MASK}::UBIGINT)"

    def rotl(value: str, r: int) -> str:
        return let(value, f"(((x << {r}) & {_MASK}::UBIGINT) | (x >> {32 - r}))")

    def shift(value: str, r: int) -> str:
        return let(value, f"xor(x, x >> {r})")

    h = f"{_hash_int(seed, 42)}::UBIGINT"
    for word in (f"(({key})::BIGINT & {_MASK})", f"((({key})::BIGINT >> 32) & {_MASK})"):
        k = mul(rotl(mul(f"{word}::UBIGINT", 0xCC9E2D51), 15), 0x1B873593)
        h = f"((({rotl(f'xor({h}, {k})', 13)}) * 5 + {0xE6546B64}) & {_MASK}::UBIGINT)"
    h = mul(shift(f"xor({h}, 8::UBIGINT)", 16), 0x85EBCA6B)
    h = mul(shift(h, 13), 0xC2B2AE35)
    return f"({shift(h, 16)})::BIGINT"


def sql_draw(seed: int, block: str = "block_id") -> str:
    return f"{sql_hash(seed + DRAW_SEED, block)}, {block}"


def sql_pairs(item: str = "p_brand") -> str:
    """base(txn_id, item)"""
    return (
        f"base AS (SELECT DISTINCT l_orderkey AS txn_id, {item} AS item "
        "FROM lineitem JOIN part ON p_partkey = l_partkey)"
    )


def sql_blocked(item: str = "p_brand", n: int = N_BLOCKS) -> str:
    """base, and b(block_id, txn_id, item) over all blocks"""
    return (
        f"{sql_pairs(item)}, "
        f"b AS (SELECT {sql_hash(SEED, 'txn_id')} % {n} AS block_id, txn_id, item FROM base)"
    )


def sql_picked(item: str = "p_brand", n: int = N_BLOCKS, picked: int = N_PICKED) -> str:
    """as sql_blocked, but b only holds the drawn blocks, named in pick(block_id)"""
    return f"""{sql_pairs(item)},
 blk AS (SELECT DISTINCT txn_id, {sql_hash(SEED, 'txn_id')} % {n} AS block_id FROM base),
 pick AS (SELECT block_id FROM (SELECT block_id, row_number() OVER (
     ORDER BY {sql_draw(SEED)}) AS rn
   FROM (SELECT DISTINCT block_id FROM blk)) WHERE rn <= {picked}),
 b AS (SELECT blk.block_id, base.txn_id, base.item
   FROM base JOIN blk USING (txn_id) JOIN pick USING (block_id))"""


def sql_subsets(source: str, by: str = "") -> str:
    """({by}items, freq): in how many baskets of ``source`` each set of items lies,
    whatever its length; equal baskets are folded together first"""
    return (
        f"SELECT {by}items, CAST(sum(w) AS BIGINT) AS freq FROM (SELECT {by}w, "
        "list_filter(s, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items FROM ("
        f"SELECT {by}s, w, unnest(range(1, 1::BIGINT << len(s))) AS m FROM ("
        f"SELECT {by}s, count(*) AS w FROM (SELECT {by}list(DISTINCT item ORDER BY item) AS s "
        f"FROM {source} GROUP BY {by}txn_id) GROUP BY ALL))) GROUP BY ALL"
    )


def sql_local(
    threshold: str = "greatest(1, CAST(floor(n_rows * 0.02::DOUBLE) AS BIGINT))",
) -> str:
    """On b: n(block_id, n_rows, mc) and loc(block_id, items list, freq, n_rows), all lengths"""
    return (
        f"n AS (SELECT block_id, n_rows, {threshold} AS mc FROM "
        "(SELECT block_id, count(DISTINCT txn_id) AS n_rows FROM b GROUP BY block_id)),\n "
        f"loc AS (SELECT block_id, items, freq, n_rows FROM ({sql_subsets('b', 'block_id, ')}) "
        "JOIN n USING (block_id) WHERE freq >= mc)"
    )


def sql_key(items: str = "items") -> str:
    return f"'{{' || array_to_string({items}, ',') || '}}'"


SQL_VOTE = (
    "merged AS (SELECT items, CAST(sum(freq) AS BIGINT) // count(*) AS freq FROM loc "
    "WHERE len(items) > 1 GROUP BY items "
    "HAVING count(*) >= 0.5 * (SELECT count(*) FROM n))"
)
