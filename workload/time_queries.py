"""Joins on time, running sums and mergeable quantiles over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockmill.operators import quantiles, running, timejoin
from blockmill.operators.blocks import assign_blocks
from workload.fixtures import N_BLOCKS, SEED, sql_hash, table
from workload.registry import query

#: Days that an order counts as recent, and the widths of bins in days.
_RECENT, _WIDTHS = 30, (30, 365, 3000)


@query(
    "asof_join",
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    v AS (SELECT event_id AS view_id, user_id, ts, value AS view_value FROM events WHERE event_type = 'view'),
    m AS (SELECT p.event_id, arg_max({'i': view_id, 'v': view_value}, {'t': v.ts, 'i': view_id}) AS best
      FROM p JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts GROUP BY 1)
    SELECT event_id, user_id, best.i AS view_id, best.v AS view_value FROM p LEFT JOIN m USING (event_id)""",
)
def asof_join(spark, sf_dir):
    """Each purchase with its user's latest view before it."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select(
        F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value")
    )
    found = timejoin.asof_join(bought, seen, ["user_id"], "ts", "view_ts", ["view_id", "view_value"], tie="view_id")
    return found.select("event_id", "user_id", "view_id", "view_value")


@query(
    "interval_join",
    f"""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate AS s, o_orderdate + INTERVAL {_RECENT} DAY AS e FROM orders),
    h AS (SELECT o_custkey, l_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT o_custkey, o_orderkey, l_orderkey FROM o JOIN h USING (o_custkey) WHERE o.s <= h.e AND h.s <= o.e""",
)
def interval_join(spark, sf_dir):
    """Orders with the shipping spans of their customer's orders that meet their first month."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    recent = orders.withColumn("until", F.col("o_orderdate") + F.expr(f"INTERVAL {_RECENT} DAYS"))
    shipped = (
        lines.groupBy("l_orderkey")
        .agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
        .join(orders.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    )
    found = timejoin.interval_join(
        recent, shipped, ["o_custkey"], ("o_orderdate", "until"), ("first", "last"), [w * 86_400 for w in _WIDTHS]
    )
    return found.select("o_custkey", "o_orderkey", "l_orderkey")


@query(
    "running_total",
    """WITH c AS (SELECT o_orderkey, o_orderdate, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
    SELECT o_orderkey, (sum(cents) OVER (ORDER BY o_orderdate NULLS FIRST, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT AS running,
      (sum(cents) OVER (ORDER BY o_orderdate NULLS FIRST RANGE UNBOUNDED PRECEDING))::BIGINT AS of_day,
      (sum(cents) OVER (ORDER BY o_orderdate NULLS FIRST, o_orderkey ROWS 99 PRECEDING))::BIGINT AS last_100 FROM c""",
)
def running_total(spark, sf_dir):
    """Order prices in cents, added up along the order dates."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    )
    found = running.running_totals(orders, "o_orderdate", "o_orderkey", "cents", peers="of_day", last=[100])
    return found.select("o_orderkey", "running", "of_day", "last_100")


_POINTS, _SHARES = 100, (0.05, 0.25, 0.5, 0.75, 0.95)


@query(
    "merged_quantiles",
    f"""WITH b AS (SELECT {sql_hash(SEED, 'o_orderkey')} % {N_BLOCKS} AS g, o_totalprice AS v FROM orders),
    c AS (SELECT g, v, count(*) AS c FROM b GROUP BY 1, 2),
    r AS (SELECT g, v, c, sum(c) OVER (PARTITION BY g ORDER BY v) AS upto, sum(c) OVER (PARTITION BY g) AS n FROM c),
    s AS (SELECT v, (upto * {_POINTS}) // n - ((upto - c) * {_POINTS}) // n AS steps, n FROM r),
    m AS (SELECT v, sum(steps * n) AS w FROM s GROUP BY 1),
    q AS (SELECT v, sum(w) OVER (ORDER BY v) AS upto, sum(w) OVER () AS total FROM m WHERE w > 0)
    SELECT share, min(v) AS value FROM q, (SELECT unnest([{", ".join(f"{s}::DOUBLE" for s in _SHARES)}]) AS share)
    WHERE upto >= share * total GROUP BY 1""",
)
def merged_quantiles(spark, sf_dir):
    """Quantiles of all order prices from the summaries of the blocks."""
    orders = assign_blocks(table(spark, sf_dir, "orders"), N_BLOCKS, "o_orderkey", SEED)
    return quantiles.merged_quantiles(quantiles.block_summaries(orders, "o_totalprice", _POINTS), _SHARES)
