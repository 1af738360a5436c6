"""Association rules with consequents of any length, from mined itemsets.

Moving an item from the left to the right can only lower the confidence, so the
right sides that reach the limit within an itemset are grown level by level: two
of them that differ in their last item make the next longer one. A level is one
join with the itemsets' counts, and all blocks are worked on at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.runtime import join_checked, store_counted


def rules(itemsets: DataFrame, min_confidence: float, by: Sequence[str] = (), max_right: int | None = None) -> DataFrame:
    """(by, antecedent, consequent, freq, confidence): all rules between two parts
    of an itemset, none of them empty, per group ``by``.

    ``itemsets`` has ``items`` in canonical order and ``freq``, and with an itemset
    all its subsets, as mining gives them. ``max_right`` limits the length of
    consequents. Groups may be null. No itemsets, or single items only, give no rules.
    """
    known, n_known = store_counted(
        itemsets.select(F.struct(F.lit(0).alias("_"), *by).alias("_g"), "items", "freq"), "itemsets"
    )
    left = known.select("_g", F.col("items").alias("antecedent"), F.col("freq").alias("_left"))
    # Per itemset the right sides of one length, grouped by all items but the last.
    level = known.where(F.size("items") > 1).select(
        "_g", "items", "freq", F.slice("items", 1, 0).alias("_stem"), F.explode("items").alias("_last")
    )
    found = []
    length = 1
    while max_right is None or length <= max_right:
        right = F.concat("_stem", F.array("_last"))
        candidates = level.withColumn("consequent", right).withColumn(
            "antecedent", F.array_except("items", "consequent")
        )
        # One short left side can have very many rules: it is joined in parts.
        scored = join_checked(candidates, left, ["_g", "antecedent"], n_known, F.xxhash64("items", "consequent"))
        kept, n_kept = store_counted(
            scored.withColumn("confidence", F.col("freq") / F.col("_left"))
            .where(F.col("confidence") >= F.lit(min_confidence))
            .drop("_left"),
            "rules",
        )
        found.append(kept)
        if not n_kept:
            break
        # No more right sides share a stem than the itemset has items.
        stems = kept.where(F.size("items") > length + 1).groupBy("_g", "items", "freq", "_stem").agg(
            F.sort_array(F.collect_list("_last")).alias("_ends")
        )
        pairs = F.flatten(
            F.transform(
                "_ends",
                lambda a, i: F.transform(
                    F.slice("_ends", i + 2, F.size("_ends")), lambda b: F.struct(a.alias("a"), b.alias("b"))
                ),
            )
        )
        level = stems.select("_g", "items", "freq", "_stem", F.explode(pairs).alias("_p")).select(
            "_g", "items", "freq", F.concat("_stem", F.array("_p.a")).alias("_stem"), F.col("_p.b").alias("_last")
        )
        length += 1
    every = reduce(DataFrame.unionByName, found)
    return every.select(*(F.col(f"_g.{c}").alias(c) for c in by), "antecedent", "consequent", "freq", "confidence")

