"""Parameter sweeps: mined once, judged for every setting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.functions.hashing import bucket_hash
from blockmill.operators.blocks import BLOCK
from blockmill.operators.evaluate import evaluate_itemsets, support_error
from blockmill.operators.mining import (
    LocalItemsets,
    mine_groupings,
    rules_from_itemsets,
    tally,
)
from blockmill.operators.sizing import itemset_stats, sample_size
from blockmill.runtime import store


def _each(counts: Sequence[int]) -> Column:
    """One row per count."""
    return F.explode(F.array(*(F.lit(n).cast("bigint") for n in counts)))


def mine_blockings(
    baskets: DataFrame,
    counts: Sequence[int],
    min_support: float,
    key: str = "txn_id",
    seed: int = 42,
    max_len: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mine the same baskets cut into each of ``counts`` blocks, in one pass and
    without a copy of the baskets for each.

    Returns the local itemsets and the blocks, both with ``n``, the blocking.
    """
    counts = sorted(set(counts))
    h = bucket_hash(seed, F.col(key))
    rows = baskets.select(h.alias("hash"), F.array_distinct("items").alias("items"))
    # Blocking and block name a block together, so no id can run into another's.
    place = F.struct("n", (F.col("hash") % F.col("n")).alias("block"))
    sizes = rows.select("hash", _each(counts).alias("n")).select(place.alias(BLOCK))
    local = mine_groupings(rows, "hash", sizes, place, min_support, max_len)
    n = F.col(f"{BLOCK}.n")
    return local.with_support().withColumn("n", n), local.blocks.withColumn("n", n)


def _merge_each(itemsets: DataFrame, blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Half-vote merge within every blocking ``n``; ``by`` are further settings.

    There is one row per blocking in ``quorum``, so it is always broadcast.
    """
    quorum = blocks.groupBy("n").agg((F.count(F.lit(1)) * 0.5).alias("needed"))
    return (
        tally(itemsets, [*by, "n"])
        .join(F.broadcast(quorum), "n")
        .where("votes >= needed")
        .select(*by, "n", "items", F.expr("total div votes").alias("freq"))
    )


def sweep_block_counts(
    baskets: DataFrame,
    counts: Sequence[int],
    min_support: float,
    total_rows: int,
    max_len: int | None = None,
) -> DataFrame:
    """Judge the merged result of every block count against the one-block result."""
    itemsets, blocks = mine_blockings(baskets, [1, *counts], min_support, max_len=max_len)
    # Written once: it is used as the truth and as what is judged, twice each.
    merged = store(_merge_each(itemsets, blocks, []), "merged")
    settings = _each(counts).alias("n")
    truth = merged.where("n = 1").select(settings, "items", "freq")
    approx = merged.where(F.col("n").isin(list(counts)))
    scores = evaluate_itemsets(approx, truth, ["n"])
    errors = support_error(approx, truth, F.col("n"), total_rows, ["n"])
    return scores.join(errors, "n", "left")


def sweep_supports(
    baskets: DataFrame,
    supports: Sequence[float],
    n_blocks: int,
    total_rows: int,
    max_len: int | None = None,
) -> DataFrame:
    """Judge ``n_blocks`` blocks against one block for every support.

    Mined once at the lowest support; an itemset frequent at a higher support
    is frequent at the lowest one, so the others only filter.
    """
    itemsets, blocks = mine_blockings(baskets, [1, n_blocks], min(supports), max_len=max_len)
    level = F.explode(F.array(*map(F.lit, supports))).alias("min_support")
    needed = F.greatest(
        F.lit(1).cast("bigint"),
        F.floor(F.col("n_rows").cast("double") * F.col("min_support")).cast("bigint"),
    )
    kept = itemsets.withColumn("min_support", level).where(F.col("freq") >= needed)
    merged = store(_merge_each(kept, blocks, ["min_support"]), "merged")
    truth = merged.where("n = 1")
    approx = merged.where(F.col("n") == n_blocks)
    scores = evaluate_itemsets(approx, truth, ["min_support"])
    errors = support_error(approx, truth, n_blocks, total_rows, ["min_support"])
    return scores.join(errors, "min_support", "left")


def sweep_eps_delta(
    local: LocalItemsets,
    exact: DataFrame,
    settings: Sequence[tuple[float, float]],
    min_confidence: float = 0.6,
) -> DataFrame:
    """(eps, delta, n_rules, sample_size, precision, recall) per setting.

    ``exact`` are the true itemsets, singles included; found is what any block
    found. Four one-row tables are laid side by side, then fanned out.
    """
    found = local.itemsets.groupBy("items").agg(F.max("freq").alias("freq"))
    scores = evaluate_itemsets(found, exact).select("precision", "recall")
    rules = rules_from_itemsets(local.itemsets, min_confidence, [BLOCK]).agg(
        F.count(F.lit(1)).alias("n_rules")
    )
    stats = itemset_stats(local).select("r_max", "n_itemsets")
    one_row = (
        stats.unionByName(rules, allowMissingColumns=True)
        .unionByName(scores, allowMissingColumns=True)
        .agg(*(F.max(c).alias(c) for c in ("r_max", "n_itemsets", "n_rules", "precision", "recall")))
    )
    pairs = F.explode(
        F.array(*(F.struct(F.lit(e).alias("eps"), F.lit(d).alias("delta")) for e, d in settings))
    )
    size = sample_size(F.col("r_max"), F.col("n_itemsets"), F.col("s.eps"), F.col("s.delta"))
    return one_row.withColumn("s", pairs).select(
        "s.eps",
        "s.delta",
        "n_rules",
        F.round(size, 2).alias("sample_size"),
        F.round("precision", 4).alias("precision"),
        F.round("recall", 4).alias("recall"),
    )
