"""Itemset mining, sample sizes, accuracy and enrichment over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.functions.itemsets import itemset_key
from blockmill.operators import enrich, evaluate, mining, rules, sizing
from blockmill.operators.mining import LocalItemsets, mine_blocks
from blockmill.plans import sweeps
from blockmill.plans.itemsets import (
    full_itemsets,
    sampled_itemsets,
    sampled_local_itemsets,
    stored_itemsets,
)
from blockmill.runtime import scratch_path, store
from blockmill.sources.writers import write_blocks
from workload.fixtures import (
    N_BLOCKS,
    N_PICKED,
    SEED,
    SQL_VOTE,
    baskets,
    blocked_baskets,
    blocked_lines,
    goods,
    lines_to_baskets,
    sql_blocked,
    sql_goods,
    sql_hash,
    sql_key,
    sql_local,
    sql_pairs,
    sql_picked,
    sql_subsets,
    stored_baskets,
)
from workload.registry import query

SUPPORT = 0.02
MIN_CONFIDENCE = 0.15
_CEIL = "greatest(1, CAST(ceil(n_rows * 0.02::DOUBLE) AS BIGINT))"


def keyed(itemsets: DataFrame) -> DataFrame:
    """The same table with ``items`` as a ``{a,b}`` string."""
    return itemsets.withColumn("items", itemset_key(F.col("items")))


def sampled(
    spark: SparkSession, sf_dir: str, n: int = N_BLOCKS, picked: int = N_PICKED, m: int | None = None
) -> DataFrame:
    """Brands bought together, estimated from ``picked`` of ``n`` blocks of orders."""
    return sampled_itemsets(
        blocked_lines(spark, sf_dir, n),
        picked,
        SUPPORT,
        prepare=lines_to_baskets(spark, sf_dir),
        m=m,
        of_blocks=n,
    )


def all_baskets(spark: SparkSession, sf_dir: str, item: str = "p_brand") -> DataFrame:
    """Every order's basket, written once as mining reads it several times."""
    return store(baskets(spark, sf_dir, item), "baskets")


def every_local(spark: SparkSession, sf_dir: str, rounding: str = "floor") -> LocalItemsets:
    """Local itemsets of all blocks."""
    return mine_blocks(stored_baskets(spark, sf_dir), min_support=SUPPORT, rounding=rounding)


_ALL_SETS = f"all_sets AS ({sql_subsets('base')})"

_EXACT = (
    f"{sql_pairs()}, {_ALL_SETS}, exact AS (SELECT items, freq FROM all_sets WHERE freq >= "
    "ceil((SELECT count(DISTINCT txn_id) FROM base) * 0.02::DOUBLE))"
)
_RULES = (
    "rules AS (SELECT {by}list_filter(b.items, lambda x: x != i.item) AS antecedent, i.item AS consequent, "
    "b.freq::DOUBLE / a.freq AS confidence FROM {table} b, unnest(b.items) AS i(item) "
    "JOIN {table} a ON {on}a.items = list_filter(b.items, lambda x: x != i.item) "
    "WHERE len(b.items) > 1 AND b.freq::DOUBLE / a.freq >= 0.15)"
)

# --- mining ----------------------------------------------------------------


@query("fim_exact", f"WITH {_EXACT} SELECT {sql_key()} AS items, freq FROM exact WHERE len(items) > 1")
def fim_exact(spark, sf_dir):
    return keyed(mining.exact_itemsets(mining.fit_exact(all_baskets(spark, sf_dir), SUPPORT)))


_LOCAL_OUT = f"SELECT block_id, {sql_key()} AS items, freq FROM loc"


@query("fim_local", f"WITH {sql_blocked()}, {sql_local()} {_LOCAL_OUT}")
def fim_local(spark, sf_dir):
    local = mine_blocks(stored_baskets(spark, sf_dir), min_support=SUPPORT)
    return keyed(local.itemsets)


@query("fim_local_long", f"WITH {sql_blocked('p_type')}, {sql_local()} {_LOCAL_OUT}")
def fim_local_long(spark, sf_dir):
    """Few items and long patterns."""
    return keyed(mine_blocks(stored_baskets(spark, sf_dir, "p_type"), min_support=SUPPORT).itemsets)


@query(
    "fim_local_global_count",
    f"WITH {sql_blocked('p_type')}, "
    + sql_local("CAST(floor((SELECT count(DISTINCT txn_id) FROM b) * 0.01::DOUBLE) AS BIGINT)")
    + f" {_LOCAL_OUT}",
)
def fim_local_global_count(spark, sf_dir):
    rows = stored_baskets(spark, sf_dir, "p_type")
    return keyed(mine_blocks(rows, min_count=int(rows.count() * 0.01)).itemsets)


@query("fim_local_fixed_count", f"WITH {sql_blocked()}, {sql_local('20')} {_LOCAL_OUT}")
def fim_local_fixed_count(spark, sf_dir):
    return keyed(mine_blocks(stored_baskets(spark, sf_dir), min_count=20).itemsets)


@query(
    "itemset_key",
    f"WITH {sql_pairs('p_size')}, g AS (SELECT list(item ORDER BY item) AS items FROM base GROUP BY txn_id) "
    f"SELECT {sql_key()} AS key, count(*) AS n FROM g WHERE len(items) > 1 GROUP BY 1",
)
def itemset_key_query(spark, sf_dir):
    several = baskets(spark, sf_dir, "p_size").where(F.size("items") > 1)
    return several.select(itemset_key(F.col("items")).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n")
    )


_PICKED_LOCAL = f"WITH {sql_picked()}, {sql_local()}"
_ALL_LOCAL = f"WITH {sql_blocked()}, {sql_local()}"
_ALL_CEIL = f"WITH {sql_blocked()}, {sql_local(_CEIL)}"


@query("go_vote_merge", f"{_ALL_LOCAL}, {SQL_VOTE} SELECT {sql_key()} AS items, freq FROM merged")
def go_vote_merge(spark, sf_dir):
    return keyed(mining.merge_half(every_local(spark, sf_dir)))


@query(
    "go_any_merge",
    f"{_ALL_LOCAL} SELECT {sql_key()} AS items, CAST(sum(freq) AS BIGINT) // count(*) AS freq "
    "FROM loc WHERE len(items) > 1 GROUP BY items",
)
def go_any_merge(spark, sf_dir):
    return keyed(mining.merge_by_vote(every_local(spark, sf_dir).itemsets, 1))


@query(
    "go_sum_merge",
    f"{_ALL_LOCAL} SELECT {sql_key()} AS items, CAST(sum(freq) AS BIGINT) AS total, "
    "count(*) AS votes FROM loc WHERE len(items) > 1 GROUP BY items",
)
def go_sum_merge(spark, sf_dir):
    return keyed(mining.merge_sum(every_local(spark, sf_dir).itemsets))


@query(
    "go_max_merge",
    f"{_ALL_LOCAL} SELECT {sql_key()} AS items, max(freq) AS freq FROM loc "
    "WHERE len(items) > 1 GROUP BY items",
)
def go_max_merge(spark, sf_dir):
    return keyed(mining.merge_max(every_local(spark, sf_dir).itemsets))


@query("sampled_fim", f"{_PICKED_LOCAL}, {SQL_VOTE} SELECT {sql_key()} AS items, freq FROM merged")
def sampled_fim(spark, sf_dir):
    return keyed(sampled(spark, sf_dir))


@query("stored_fim", f"{_PICKED_LOCAL}, {SQL_VOTE} SELECT {sql_key()} AS items, freq FROM merged")
def stored_fim(spark, sf_dir):
    """The same from baskets stored by block, as a data lake would hold them."""
    path = scratch_path(spark, "blocks")
    write_blocks(blocked_baskets(spark, sf_dir), path)
    return keyed(stored_itemsets(spark, path, N_PICKED, SUPPORT, SEED))


def _sql_reblocked(m: int, picked: int = N_PICKED) -> str:
    return f"""{sql_picked(picked=picked).replace(' b AS (', ' kept AS (')},
 b AS (SELECT {sql_hash(SEED + 1, 'txn_id')} % {picked * m} AS block_id, txn_id, item FROM kept)"""


@query(
    "sampled_fim_reblocked",
    f"WITH {_sql_reblocked(4)}, {sql_local()}, {SQL_VOTE} SELECT {sql_key()} AS items, freq FROM merged",
)
def sampled_fim_reblocked(spark, sf_dir):
    return keyed(sampled(spark, sf_dir, m=4))


@query(
    "scalable_fim",
    f"WITH {sql_blocked()}, {sql_local()}, {SQL_VOTE} SELECT {sql_key()} AS items, freq FROM merged",
)
def scalable_fim(spark, sf_dir):
    return keyed(full_itemsets(stored_baskets(spark, sf_dir), SUPPORT))


@query(
    "itemset_support",
    f"{_ALL_LOCAL} SELECT block_id, {sql_key()} AS items, round(freq / n_rows, 6) AS support FROM loc",
)
def itemset_support(spark, sf_dir):
    return keyed(every_local(spark, sf_dir).with_support()).select(
        "block_id", "items", F.round("support", 6).alias("support")
    )


@query(
    "assoc_rules",
    f"WITH {_EXACT}, {_RULES.format(by='', on='', table='exact')} SELECT "
    f"{sql_key('antecedent')} AS antecedent, consequent, round(confidence, 6) AS confidence FROM rules",
)
def assoc_rules(spark, sf_dir):
    model = mining.fit_exact(all_baskets(spark, sf_dir), SUPPORT, MIN_CONFIDENCE)
    return mining.exact_rules(model).select(
        itemset_key(F.col("antecedent")).alias("antecedent"),
        F.get("consequent", F.lit(0)).alias("consequent"),
        F.round("confidence", 6).alias("confidence"),
    )


@query(
    "assoc_rules_long",
    f"""WITH {sql_blocked("p_type")}, {sql_local()} SELECT z.block_id, {sql_key('a.items')} AS antecedent,
      {sql_key('list_filter(z.items, lambda x: NOT list_contains(a.items, x))')} AS consequent, z.freq,
      round(z.freq::DOUBLE / a.freq, 6) AS confidence
    FROM loc z JOIN loc a ON a.block_id = z.block_id AND len(a.items) < len(z.items) AND list_has_all(z.items, a.items)
    WHERE z.freq::DOUBLE / a.freq >= {MIN_CONFIDENCE}::DOUBLE""",
)
def assoc_rules_long(spark, sf_dir):
    """All rules of every block, with any number of part types on either side."""
    local = mine_blocks(stored_baskets(spark, sf_dir, "p_type"), min_support=SUPPORT)
    found = rules.rules(local.itemsets, MIN_CONFIDENCE, ["block_id"])
    return found.select(
        "block_id",
        itemset_key(F.col("antecedent")).alias("antecedent"),
        itemset_key(F.col("consequent")).alias("consequent"),
        "freq",
        F.round("confidence", 6).alias("confidence"),
    )


_BLOCK_RULES = _RULES.format(by="b.block_id, ", on="a.block_id = b.block_id AND ", table="loc")


@query(
    "rule_confidence_stats",
    f"{_ALL_CEIL}, {_BLOCK_RULES} SELECT n.block_id, round(avg(confidence), 6) AS avg_confidence, "
    "count(confidence) AS n_rules FROM n LEFT JOIN rules USING (block_id) GROUP BY n.block_id",
)
def rule_confidence_stats(spark, sf_dir):
    local = every_local(spark, sf_dir, "ceil")
    rules = mining.rules_from_itemsets(local.itemsets, MIN_CONFIDENCE, ["block_id"])
    return mining.confidence_stats(rules, local.blocks).withColumn(
        "avg_confidence", F.round("avg_confidence", 6)
    )


@query("distinct_items", f"WITH {sql_pairs()} SELECT DISTINCT item FROM base")
def distinct_items(spark, sf_dir):
    return mining.distinct_items(baskets(spark, sf_dir))


# --- sample sizes ----------------------------------------------------------

_STATS = (
    "s AS (SELECT items, max(freq / n_rows) AS support FROM loc GROUP BY items), "
    "st AS (SELECT max(support) AS r_max, max(support) FILTER (WHERE len(items) > 1) AS r_max_multi, "
    "count(*) AS n_itemsets, count(*) FILTER (WHERE len(items) > 1) AS n_itemsets_multi FROM s)"
)


@query("r_max", f"{_ALL_CEIL}, {_STATS} SELECT round(r_max, 6) AS r_max, round(r_max_multi, 6) AS r_max_multi FROM st")
def r_max(spark, sf_dir):
    stats = sizing.itemset_stats(every_local(spark, sf_dir, "ceil"))
    return stats.select(F.round("r_max", 6).alias("r_max"), F.round("r_max_multi", 6).alias("r_max_multi"))


@query("itemset_universe", f"{_ALL_CEIL}, {_STATS} SELECT n_itemsets, n_itemsets_multi FROM st")
def itemset_universe(spark, sf_dir):
    return sizing.itemset_stats(every_local(spark, sf_dir, "ceil")).select(
        "n_itemsets", "n_itemsets_multi"
    )


def _size_sql(r: str, n: str, eps: str, delta: str) -> str:
    return f"{r} * {r} / (2 * {eps} * {eps}) * ln(2 * {n} / {delta})"


@query(
    "sample_size",
    f"{_ALL_CEIL}, {_STATS} SELECT "
    f"round({_size_sql('r_max', 'n_itemsets', '0.05::DOUBLE', '0.01::DOUBLE')}, 6) AS size_all, "
    f"round({_size_sql('r_max_multi', 'n_itemsets_multi', '0.05::DOUBLE', '0.01::DOUBLE')}, 6) AS size_multi FROM st",
)
def sample_size(spark, sf_dir):
    stats = sizing.itemset_stats(every_local(spark, sf_dir, "ceil"))
    every = sizing.sample_size(F.col("r_max"), F.col("n_itemsets"), 0.05, 0.01)
    multi = sizing.sample_size(F.col("r_max_multi"), F.col("n_itemsets_multi"), 0.05, 0.01)
    return stats.select(F.round(every, 6).alias("size_all"), F.round(multi, 6).alias("size_multi"))


_MERGED_SIZE = _size_sql("r_max", "n_itemsets", "eps", "0.05::DOUBLE")


@query(
    "sample_size_merged",
    f"""WITH {_sql_reblocked(5, 4)}, {sql_local()},
    m AS (SELECT items, max(freq) AS freq FROM loc WHERE len(items) > 1 GROUP BY items),
    st AS (SELECT max(freq) / 20000::DOUBLE AS r_max, count(*) AS n_itemsets,
      unnest([0.05::DOUBLE, 0.005::DOUBLE]) AS eps FROM m)
    SELECT eps, round(r_max, 6) AS r_max, n_itemsets, round({_MERGED_SIZE}, 6) AS sample_size,
      CAST(floor({_MERGED_SIZE}) AS BIGINT) AS sample_rows FROM st""",
)
def sample_size_merged(spark, sf_dir):
    local = sampled_local_itemsets(
        blocked_lines(spark, sf_dir),
        4,
        SUPPORT,
        prepare=lines_to_baskets(spark, sf_dir),
        m=5,
        of_blocks=N_BLOCKS,
    )
    sizes = sizing.merged_sample_size(local, 20_000, (0.05, 0.005), 0.05)
    return sizes.withColumn("r_max", F.round("r_max", 6)).withColumn(
        "sample_size", F.round("sample_size", 6)
    )


@query(
    "r_max_quantile",
    f"""{_ALL_CEIL}, p AS (SELECT n.block_id, coalesce(max(freq / loc.n_rows), 0) AS r
      FROM n LEFT JOIN loc USING (block_id) GROUP BY n.block_id),
    o AS (SELECT r, row_number() OVER (ORDER BY r) AS rn, count(*) OVER () AS c FROM p)
    SELECT round(r, 6) AS r_max FROM o WHERE rn = floor(0.95::DOUBLE * (c - 1)) + 1""",
)
def r_max_quantile(spark, sf_dir):
    return sizing.r_max_quantile(every_local(spark, sf_dir, "ceil")).select(
        F.round("r_max", 6).alias("r_max")
    )


@query(
    "merged_itemsets_desc",
    f"{_ALL_CEIL} SELECT {sql_key()} AS items, round(max(freq / n_rows), 6) AS support "
    "FROM loc GROUP BY items ORDER BY max(freq / n_rows) DESC, 1",
)
def merged_itemsets_desc(spark, sf_dir):
    merged = keyed(sizing.merged_by_support(every_local(spark, sf_dir, "ceil")))
    return merged.orderBy(F.desc("support"), "items").select(
        "items", F.round("support", 6).alias("support")
    )


# The settings of the sweeps.
_SETTINGS = [(0.01, 0.05), (0.02, 0.05), (0.05, 0.05), (0.10, 0.05), (0.15, 0.05)]
_SETTINGS_SQL = ", ".join(f"({e}::DOUBLE, {d}::DOUBLE)" for e, d in _SETTINGS)


@query(
    "eps_delta_sweep",
    f"""WITH {sql_blocked()}, {sql_local(_CEIL)}, {_STATS}, {_BLOCK_RULES},
    {_ALL_SETS}, exact AS (SELECT items FROM all_sets WHERE freq >=
      ceil((SELECT count(DISTINCT txn_id) FROM base) * 0.02::DOUBLE)),
    tp AS (SELECT count(*) AS c FROM s JOIN exact USING (items)),
    p AS (SELECT * FROM (VALUES {_SETTINGS_SQL}) AS v(eps, delta))
    SELECT eps, delta, (SELECT count(*) FROM rules) AS n_rules,
      round({_size_sql('r_max', 'n_itemsets', 'eps', 'delta')}, 2) AS sample_size,
      round((SELECT c FROM tp) / n_itemsets, 4) AS precision,
      round((SELECT c FROM tp) / (SELECT count(*) FROM exact), 4) AS recall FROM st, p""",
)
def eps_delta_sweep(spark, sf_dir):
    exact = mining.exact_by_levels(all_baskets(spark, sf_dir), SUPPORT, min_size=1)
    return sweeps.sweep_eps_delta(
        every_local(spark, sf_dir, "ceil"), exact, _SETTINGS, MIN_CONFIDENCE
    )


# --- accuracy --------------------------------------------------------------

_SCORES = (
    "count(est) AS n_approx, count(real) AS n_exact, count(est + real) AS tp, "
    "count(est) - count(est + real) AS fp, count(real) - count(est + real) AS fn, "
    "round(count(est + real) / count(est), 6) AS precision, "
    "round(count(est + real) / count(real), 6) AS recall"
)


def rounded_scores(scores: DataFrame) -> DataFrame:
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(
    "fim_eval",
    f"""WITH {sql_picked()}, {sql_local()}, {SQL_VOTE}, {_ALL_SETS},
    exact AS (SELECT items, freq FROM all_sets WHERE len(items) > 1 AND freq >=
      ceil((SELECT count(DISTINCT txn_id) FROM base) * 0.02::DOUBLE))
    SELECT {_SCORES} FROM (SELECT m.freq AS est, e.freq AS real
      FROM merged m FULL JOIN exact e ON m.items = e.items)""",
)
def fim_eval(spark, sf_dir):
    exact = mining.exact_itemsets(mining.fit_exact(all_baskets(spark, sf_dir), SUPPORT))
    return rounded_scores(evaluate.evaluate_itemsets(sampled(spark, sf_dir), exact))


@query(
    "fim_ase",
    f"""WITH {sql_picked()}, {sql_local()}, {SQL_VOTE}, {_ALL_SETS},
    t AS (SELECT count(DISTINCT txn_id) AS total FROM base),
    exact AS (SELECT items, freq FROM all_sets WHERE len(items) > 1 AND freq >=
      ceil((SELECT total FROM t) * 0.02::DOUBLE))
    SELECT round(avg(abs(e.freq - m.freq * {N_BLOCKS})), 6) AS error,
      round(avg(abs(e.freq - m.freq * {N_BLOCKS}) / (SELECT total FROM t)), 6) AS ase
    FROM merged m JOIN exact e ON m.items = e.items""",
)
def fim_ase(spark, sf_dir):
    rows = all_baskets(spark, sf_dir)
    exact = mining.exact_by_levels(rows, SUPPORT)
    errors = evaluate.support_error(sampled(spark, sf_dir), exact, N_BLOCKS, rows.count())
    return errors.select(F.round("error", 6).alias("error"), F.round("ase", 6).alias("ase"))


# Block counts and supports of the sweeps.
_COUNTS = list(range(3, 22, 2))
_SUPPORTS = [round(0.004 + 0.0002 * i, 4) for i in range(10)]


def _sql_blockings(counts: list[int], threshold: str) -> str:
    """base, b(block_id, ...) with block_id = n * 2^20 + block, loc"""
    every = " UNION ALL ".join(
        f"SELECT {n} * 1048576 + h % {n} AS block_id, txn_id, item FROM hashed" for n in counts
    )
    return (
        f"{sql_pairs('p_size')}, hashed AS (SELECT txn_id, item, "
        f"{sql_hash(SEED, 'txn_id')} AS h FROM base), b AS ({every}), {sql_local(threshold)}"
    )


_SWEEP_SCORES = (
    f"{_SCORES}, round(avg(abs(real - est * scale)), 6) AS error, "
    "round(avg(abs(real - est * scale) / total), 6) AS ase"
)


@query(
    "eval_sweep_blocks",
    f"""WITH {_sql_blockings([1, *_COUNTS], 'greatest(1, CAST(floor(n_rows * 0.005::DOUBLE) AS BIGINT))')},
    q AS (SELECT block_id // 1048576 AS n, count(*) AS c FROM n GROUP BY 1),
    v AS (SELECT block_id // 1048576 AS n, items, CAST(sum(freq) AS BIGINT) // count(*) AS freq,
      count(*) AS votes FROM loc WHERE len(items) > 1 GROUP BY 1, 2),
    m AS (SELECT v.n, items, freq FROM v JOIN q USING (n) WHERE votes >= 0.5 * c),
    tr AS (SELECT q.n, items, freq FROM q, (SELECT items, freq FROM m WHERE n = 1) WHERE q.n > 1),
    x AS (SELECT coalesce(a.n, tr.n) AS n, a.freq AS est, tr.freq AS real, a.n AS scale,
      (SELECT count(DISTINCT txn_id) FROM base) AS total
      FROM (SELECT * FROM m WHERE n > 1) a FULL JOIN tr ON a.n = tr.n AND a.items = tr.items)
    SELECT n, {_SWEEP_SCORES} FROM x GROUP BY n""",
)
def eval_sweep_blocks(spark, sf_dir):
    rows = all_baskets(spark, sf_dir, "p_size")
    result = sweeps.sweep_block_counts(rows, _COUNTS, 0.005, rows.count())
    return rounded_scores(result).withColumns({c: F.round(c, 6) for c in ("error", "ase")})


@query(
    "eval_sweep_support",
    f"""WITH {_sql_blockings([1, 5], 'greatest(1, CAST(floor(n_rows * 0.004::DOUBLE) AS BIGINT))')},
    q AS (SELECT block_id // 1048576 AS n, count(*) AS c FROM n GROUP BY 1),
    s AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _SUPPORTS)}]) AS min_support),
    k AS (SELECT min_support, block_id // 1048576 AS n, items, freq FROM loc, s
      WHERE freq >= greatest(1, CAST(floor(n_rows * min_support) AS BIGINT)) AND len(items) > 1),
    v AS (SELECT min_support, n, items, CAST(sum(freq) AS BIGINT) // count(*) AS freq,
      count(*) AS votes FROM k GROUP BY 1, 2, 3),
    m AS (SELECT min_support, v.n, items, freq FROM v JOIN q USING (n) WHERE votes >= 0.5 * c),
    x AS (SELECT coalesce(a.min_support, t.min_support) AS min_support, a.freq AS est,
      t.freq AS real, 5 AS scale, (SELECT count(DISTINCT txn_id) FROM base) AS total
      FROM (SELECT * FROM m WHERE n > 1) a FULL JOIN (SELECT * FROM m WHERE n = 1) t
        ON a.min_support = t.min_support AND a.items = t.items)
    SELECT min_support, {_SWEEP_SCORES} FROM x GROUP BY min_support""",
)
def eval_sweep_support(spark, sf_dir):
    rows = all_baskets(spark, sf_dir, "p_size")
    result = sweeps.sweep_supports(rows, _SUPPORTS, 5, rows.count())
    return rounded_scores(result).withColumns({c: F.round(c, 6) for c in ("error", "ase")})


# --- enrichment ------------------------------------------------------------

_ENRICH = f"""{_ALL_LOCAL}, {SQL_VOTE}, {sql_goods()},
 e AS (SELECT {sql_key('merged.items')} AS fim, merged.freq,
   CAST(round(sum(coalesce(price, 0)) * 100) AS BIGINT) AS total_cents,
   list_sort(list(DISTINCT coalesce(type, '{enrich.UNKNOWN_TYPE}'))) AS kinds
   FROM merged, unnest(merged.items) AS i(item) LEFT JOIN goods ON goods.name = i.item
   GROUP BY merged.items, merged.freq),
 report AS (SELECT fim, round(freq / 10000, 6) AS support, freq, total_cents,
   len(kinds) = 1 AS one_category, array_to_string(kinds, ',') AS categories FROM e)"""
_REPORT_COLUMNS = "fim, support, total_cents, one_category, categories"


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_itemsets(stored_baskets(spark, sf_dir), SUPPORT)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_itemsets(merged(spark, sf_dir), goods(spark, sf_dir))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.itemset_report(merged(spark, sf_dir), goods(spark, sf_dir), 10_000)


def in_cents(rows: DataFrame) -> DataFrame:
    """Prices as whole cents, which compare exactly."""
    cents = F.round(F.col("total_price") * 100).cast("bigint")
    out = rows.withColumn("total_cents", cents).drop("total_price")
    return out.withColumn("support", F.round("support", 6)) if "support" in out.columns else out


@query("itemset_total_price", f"{_ENRICH} SELECT fim, total_cents FROM report")
def itemset_total_price(spark, sf_dir):
    return in_cents(enriched(spark, sf_dir).select("fim", "total_price"))


@query("itemset_same_category", f"{_ENRICH} SELECT fim, one_category FROM report")
def itemset_same_category(spark, sf_dir):
    return enriched(spark, sf_dir).select("fim", "one_category")


@query("itemset_categories", f"{_ENRICH} SELECT fim, categories FROM report")
def itemset_categories(spark, sf_dir):
    return enriched(spark, sf_dir).select("fim", F.array_join("categories", ",").alias("categories"))


@query("itemset_report", f"{_ENRICH} SELECT {_REPORT_COLUMNS} FROM report")
def itemset_report(spark, sf_dir):
    return in_cents(report(spark, sf_dir))


@query(
    "itemset_top_support",
    f"{_ENRICH} SELECT {_REPORT_COLUMNS} FROM report ORDER BY freq DESC, fim LIMIT 20",
)
def itemset_top_support(spark, sf_dir):
    return in_cents(enrich.top_by(report(spark, sf_dir), "support"))


@query(
    "itemset_top_price",
    f"{_ENRICH} SELECT {_REPORT_COLUMNS} FROM report ORDER BY total_cents DESC, fim LIMIT 20",
)
def itemset_top_price(spark, sf_dir):
    return in_cents(enrich.top_by(report(spark, sf_dir), "total_price"))


@query(
    "itemset_one_category",
    f"{_ENRICH} SELECT {_REPORT_COLUMNS} FROM report WHERE one_category ORDER BY fim LIMIT 20",
)
def itemset_one_category(spark, sf_dir):
    return in_cents(enrich.single_category(report(spark, sf_dir)))
