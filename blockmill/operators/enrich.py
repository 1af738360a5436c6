"""Itemsets looked up in a goods table (name, price, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.functions.itemsets import itemset_key
from blockmill.runtime import store

#: Stands for the category of an item the goods table does not know. Such items
#: share one category of their own.
UNKNOWN_TYPE = "(unknown)"


def enrich_itemsets(itemsets: DataFrame, goods: DataFrame) -> DataFrame:
    """(items, fim, freq, total_price, one_category, categories) per itemset.

    Unknown items cost nothing. The goods side is left to the planner: it is
    broadcast only if it turns out small at run time.
    """
    known = goods.groupBy("name").agg(F.min(F.struct("price", "type")).alias("good"))
    single = itemsets.select("items", "freq", F.explode("items").alias("item")).withColumn(
        "name", F.col("item").cast("string")
    )
    category = F.coalesce("good.type", F.lit(UNKNOWN_TYPE))
    return (
        single.join(known, "name", "left")
        .groupBy("items", "freq")
        .agg(
            F.round(F.sum(F.coalesce("good.price", F.lit(0.0))), 2).alias("total_price"),
            F.sort_array(F.collect_set(category)).alias("categories"),
        )
        .select(
            "items",
            itemset_key(F.col("items")).alias("fim"),
            "freq",
            "total_price",
            (F.size("categories") == 1).alias("one_category"),
            "categories",
        )
    )


def itemset_report(itemsets: DataFrame, goods: DataFrame, rows: int | Column) -> DataFrame:
    """(fim, support, total_price, one_category, categories)"""
    rows = rows if isinstance(rows, Column) else F.lit(rows)
    return enrich_itemsets(itemsets, goods).select(
        "fim",
        (F.col("freq") / rows).alias("support"),
        "total_price",
        "one_category",
        F.array_join("categories", ",").alias("categories"),
    )


def register_report(report: DataFrame, view: str) -> DataFrame:
    """Make the report a view for SQL; it is mined and joined once, then read."""
    stored = store(report, "report")
    stored.createOrReplaceTempView(view)
    return stored


def top_by(report: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` rows with the highest ``column``, ties in key order."""
    return report.orderBy(F.desc(column), "fim").limit(n)


def single_category(report: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` itemsets, in key order, whose items share one category."""
    return report.where("one_category").orderBy("fim").limit(n)
