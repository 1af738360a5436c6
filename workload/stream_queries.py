"""Streams over files that the given tables arrive in."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockmill.functions.hashing import bucket_hash
from blockmill.operators.mining import mine_blocks
from blockmill.runtime import scratch_path, store
from blockmill.streaming import votes, windows
from blockmill.streaming.folder import arrive
from workload.fixtures import N_BLOCKS, SEED, sql_blocked, sql_hash, sql_key, sql_local, stored_baskets, table
from workload.mining_queries import SUPPORT, keyed
from workload.registry import query

#: Events come in six files, by days; a tenth of them one file later, a tenth two, and
#: a tenth twice. What is over a week behind is late.
_FILES, _DAYS, _DELAY_DAYS = 6, 6, 7


def arriving_events(spark, sf_dir):
    """(event_id, ts, event_type, cents, file)"""
    put_off = bucket_hash(SEED, F.col("event_id")) % 10
    first = F.least(((F.dayofmonth("ts") - 1) / _DAYS).cast("int") + F.when(put_off < 2, put_off + 1).otherwise(0), F.lit(_FILES - 1))
    again = F.when(put_off == 2, F.array(first, F.least(first + 1, F.lit(_FILES - 1)))).otherwise(F.array(first))
    # The wall time read as UTC: watermarks are on points of time, and days begin at midnight UTC.
    point = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts")
    return table(spark, sf_dir, "events").where("ts IS NOT NULL").select(
        "event_id", point, "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.explode(again).alias("file")
    )


def closing_windows(spark, sf_dir):
    root = scratch_path(spark, "windows")
    events = store(arriving_events(spark, sf_dir), "arriving")
    source = f"{root}/arrived"
    totals = [F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")]
    found = windows.ClosingWindows(
        spark, events.drop("file").schema, source, root, "ts", f"{_DELAY_DAYS} days", "1 day", ["event_type"], ["event_id"], totals
    )
    for file in range(_FILES):
        arrive(events.where(F.col("file") == file).drop("file"), source)
        found.advance(file)
    return found


_SENT = f"""WITH h AS (SELECT event_id, ts, event_type, round(value * 100)::BIGINT AS cents,
      {sql_hash(SEED, 'event_id')} % 10 AS off FROM events WHERE ts IS NOT NULL),
    f AS (SELECT *, least((day(ts) - 1) // {_DAYS} + CASE WHEN off < 2 THEN off + 1 ELSE 0 END, {_FILES - 1}) AS first FROM h),
    sent AS (SELECT event_id, ts, event_type, cents, first AS file FROM f UNION ALL
      SELECT event_id, ts, event_type, cents, least(first + 1, {_FILES - 1}) FROM f WHERE off = 2),
    tops AS (SELECT file, max(ts) AS top FROM sent GROUP BY 1),
    files AS (SELECT unnest(range({_FILES + 1})) AS file),
    marks AS (SELECT f.file, date_trunc('milliseconds', max(t.top)) - INTERVAL {_DELAY_DAYS} DAY AS mark
      FROM files f LEFT JOIN tops t ON t.file < f.file GROUP BY 1),
    judged AS (SELECT s.*, coalesce(s.ts <= m.mark, false) AS late FROM sent s JOIN marks m USING (file))"""


@query(
    "stream_windows",
    f"""{_SENT}, once AS (SELECT DISTINCT event_id, ts, event_type, cents FROM judged WHERE NOT late)
    SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, sum(cents)::BIGINT AS cents FROM once
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT mark FROM marks WHERE file = {_FILES}) GROUP BY 1, 2""",
)
def stream_windows(spark, sf_dir):
    """Events and cents per day and type, of the days that are closed after the last file."""
    start = F.to_utc_timestamp("window_start", F.current_timezone()).cast("timestamp_ntz")
    return closing_windows(spark, sf_dir).closed().withColumn("window_start", start)


@query(
    "stream_late_rows",
    f"{_SENT} SELECT file AS run, count(*) AS n_rows, count(*) FILTER (late) AS n_late FROM judged GROUP BY 1",
)
def stream_late_rows(spark, sf_dir):
    """How many events each file brought, and how many of them too late."""
    return closing_windows(spark, sf_dir).runs()


#: How many blocks come at a time.
_AT_ONCE = 2


@query(
    "stream_vote_merge",
    f"WITH {sql_blocked()}, {sql_local()}, steps AS (SELECT s.b AS upto, count(*) AS blocks_seen "
    f"FROM (SELECT unnest(range({_AT_ONCE}, {N_BLOCKS + 1}, {_AT_ONCE})) AS b) s JOIN n ON n.block_id < s.b GROUP BY 1) "
    f"SELECT DISTINCT blocks_seen, {sql_key()} AS items, freq FROM (SELECT upto, blocks_seen, items, "
    "CAST(sum(freq) AS BIGINT) // count(*) AS freq FROM steps JOIN loc ON block_id < upto WHERE len(items) > 1 "
    "GROUP BY ALL HAVING count(*) >= 0.5 * blocks_seen)",
)
def stream_vote_merge(spark, sf_dir):
    """The vote merge after each two blocks; every second time the two before are sent again."""
    root = scratch_path(spark, "votes")
    rows = store(votes.block_rows(mine_blocks(stored_baskets(spark, sf_dir), min_support=SUPPORT)), "sent")
    source = f"{root}/arrived"
    for k, start in enumerate(range(0, N_BLOCKS, _AT_ONCE)):
        since = start - _AT_ONCE * (k % 2)
        arrive(rows.where(F.col("block_id").between(since, start + _AT_ONCE - 1)), source)
        votes.advance(spark, rows.schema, source, root)
    return keyed(votes.merged_steps(spark, root))
