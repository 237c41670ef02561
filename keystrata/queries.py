"""The registered queries on logs made of the test tables, each with the same question in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions.records import record_size, status
from keystrata.operators import bloom, feed, resolve, rewrite, scan, stats, verify
from keystrata.plans import maintenance
from keystrata.plans.positions import LogPosition, StorePosition
from keystrata.runtime import scratch_path
from keystrata.sources import segments
from keystrata.sources.store import LogStore
from keystrata.streaming import live

NOW = 1706659200000000000
SOON = 86_400_000_000_000
TIER_BASE = 9000
KEYS = ["user:000001", "user:000002", "user:000003", "user:000007", "user:000011", "user:999999"]


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change log: errors delete the user's key, sign-ups expire after twelve hours."""
    return as_log(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_log(events: DataFrame) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.col("event_id").alias("pos"),
        F.expr("event_id div 500 + 1").alias("segment_id"),
        F.expr("event_id div 8").alias("batch_id"),
        (micros * 1000).alias("ts_ns"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("rtype"),
        F.when(F.col("event_type") == "signup", micros * 1000 + 43_200_000_000_000).otherwise(F.lit(0)).alias("expires_ns"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("props")).alias("value"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.col("o_orderkey").alias("pos"), F.lit(1).cast("bigint").alias("segment_id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("rtype"), F.lit(0).cast("bigint").alias("expires_ns"), F.col("o_orderpriority").alias("value"),
    )


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("key"), (F.col("turn") + 1).alias("seq"), F.col("turn").alias("pos"), F.lit(1).cast("bigint").alias("segment_id"),
        F.lit(0).alias("rtype"), F.lit(0).cast("bigint").alias("expires_ns"), F.col("text").alias("value"),
    )


LOG = """log AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id + 1 AS seq, event_id AS pos, event_id // 500 + 1 AS segment_id, event_id // 8 AS batch_id,
 epoch_us(ts) * 1000 AS ts_ns, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rtype, CASE WHEN event_type = 'signup' THEN epoch_us(ts) * 1000 + 43200000000000 ELSE 0 END AS expires_ns,
 CASE WHEN event_type = 'error' THEN '' ELSE props END AS value FROM events)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY segment_id DESC, pos DESC) AS rn FROM log)"
LATEST = f"WITH {LOG}, {RANKED}, latest AS (SELECT * FROM ranked WHERE rn = 1)"
IS_LIVE = f"rtype = 0 AND NOT (expires_ns <> 0 AND expires_ns <= {NOW})"
STATUS = f"CASE WHEN rtype IS NULL THEN 'NOT_FOUND' WHEN rtype <> 0 THEN 'DELETED' WHEN expires_ns <> 0 AND expires_ns <= {NOW} THEN 'EXPIRED' ELSE 'LIVE' END"
SIZE = "CAST(CASE WHEN expires_ns <> 0 THEN 38 ELSE 30 END + strlen(key) + strlen(value) AS BIGINT)"

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {LOG} SELECT segment_id, pos, key, value, rtype = 1 AS deleted FROM log")
def walk_records(spark, sf_dir):
    return scan.walk(event_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT segment_id, pos, 'Key: ' || key || ', Value: ' || value || ', Deleted: ' || CASE WHEN rtype = 1 THEN 'true' ELSE 'false' END AS line FROM log")
def record_lines(spark, sf_dir):
    return scan.lines(event_log(spark, sf_dir))


@query(f"{LATEST} SELECT key, segment_id, pos FROM latest")
def index_latest(spark, sf_dir):
    return resolve.latest(event_log(spark, sf_dir).select("key", "segment_id", "pos"))


@query(f"{LATEST} SELECT key, segment_id, pos, seq, value FROM latest")
def index_latest_wide(spark, sf_dir):
    return resolve.latest_narrow(event_log(spark, sf_dir)).select("key", "segment_id", "pos", "seq", "value")


@query(f"{LATEST} SELECT key, {STATUS} AS status FROM latest")
def key_status(spark, sf_dir):
    return resolve.key_status(event_log(spark, sf_dir).drop("value"), NOW)


@query(f"{LATEST} SELECT k.key, {STATUS} AS status, CASE WHEN {STATUS} = 'LIVE' THEN value END AS value FROM (SELECT unnest({KEYS!r}) AS key) k LEFT JOIN latest USING (key)")
def point_get_many(spark, sf_dir):
    return scan.get(event_log(spark, sf_dir), KEYS, NOW)


@query(f"{LATEST} SELECT key, {STATUS} AS status, ts_ns FROM latest")
def modified_time(spark, sf_dir):
    return scan.modified(event_log(spark, sf_dir), NOW)


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE}")
def foreach_live(spark, sf_dir):
    return scan.for_each(event_log(spark, sf_dir), NOW)


@query(f"{LATEST} SELECT {STATUS} AS status, count(*) AS n FROM latest GROUP BY 1")
def count_by_status(spark, sf_dir):
    return scan.count_by_status(event_log(spark, sf_dir), NOW)


@query(f"WITH {LOG} SELECT count(DISTINCT key) AS n FROM log")
def len_keys(spark, sf_dir):
    return scan.count_keys(event_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT count(DISTINCT segment_id) AS n FROM log")
def segment_count(spark, sf_dir):
    return event_log(spark, sf_dir).agg(F.countDistinct("segment_id").alias("n"))


@query(f"WITH {LOG} SELECT segment_id, count(*) AS n_records, count(DISTINCT key) AS n_keys, count(*) FILTER (rtype = 1) AS n_tombstones, CAST(sum({SIZE}) AS BIGINT) AS bytes, max(seq) AS max_seq, min(key) AS min_key, max(key) AS max_key FROM log GROUP BY 1")
def segment_stats(spark, sf_dir):
    return stats.segment_stats(event_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT CAST(sum({SIZE}) AS BIGINT) AS bytes, max(seq) AS highest_seq, count(DISTINCT segment_id) AS segments FROM log")
def store_size(spark, sf_dir):
    return stats.store_size(event_log(spark, sf_dir))


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE} AND key >= 'user:000003' AND key < 'user:000010'")
def range_scan(spark, sf_dir):
    return scan.scan_range(event_log(spark, sf_dir), "user:000003", "user:000010", NOW)


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE} AND key < 'user:000010'")
def range_open_start(spark, sf_dir):
    return scan.scan_range(event_log(spark, sf_dir), None, "user:000010", NOW)


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE} AND key >= 'user:000010'")
def range_open_end(spark, sf_dir):
    return scan.scan_range(event_log(spark, sf_dir), "user:000010", "", NOW)


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE} AND key >= 'user:000010' AND key < 'user:000003'")
def range_empty(spark, sf_dir):
    return scan.scan_range(event_log(spark, sf_dir), "user:000010", "user:000003", NOW)


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE} AND starts_with(key, 'user:00001')")
def prefix_scan(spark, sf_dir):
    return scan.scan_prefix(event_log(spark, sf_dir), "user:00001", NOW)


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE}")
def prefix_all(spark, sf_dir):
    return scan.scan_prefix(event_log(spark, sf_dir), "", NOW)


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE} AND key >= 'user:000002' ORDER BY key LIMIT 10")
def range_first_n(spark, sf_dir):
    return scan.scan_range(event_log(spark, sf_dir), "user:000002", None, NOW, limit=10)


@query(f"{LATEST} SELECT key, segment_id, pos, size, CAST(sum(size) OVER (ORDER BY segment_id, pos) - size AS BIGINT) AS new_pos FROM (SELECT *, {SIZE} AS size FROM latest WHERE {IS_LIVE})")
def compact_live(spark, sf_dir):
    return rewrite.compact(event_log(spark, sf_dir), NOW).select("key", "segment_id", "pos", "size", "new_pos")


@query(f"WITH {LOG}, {RANKED} SELECT segment_id, pos, key FROM ranked WHERE rn > 1")
def superseded_records(spark, sf_dir):
    return resolve.superseded(event_log(spark, sf_dir)).select("segment_id", "pos", "key")


@query(f"WITH {LOG}, s AS (SELECT key, segment_id, max(pos) AS pos FROM log GROUP BY 1, 2), t AS (SELECT key, max(segment_id) AS by_segment FROM log GROUP BY 1) SELECT key, segment_id, pos, by_segment FROM s JOIN t USING (key) WHERE segment_id < by_segment")
def shadowed_values(spark, sf_dir):
    return resolve.shadowed(event_log(spark, sf_dir)).select("key", "segment_id", "pos", "by_segment")


def _merge_sql(where: str, live: str) -> str:
    return f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY segment_id DESC, pos DESC) AS rn FROM log WHERE {where}) SELECT key, value, rtype, segment_id AS from_segment, pos AS from_pos, CAST(0 AS BIGINT) + (SELECT min(segment_id) FROM log WHERE {where}) AS segment_id FROM r WHERE rn = 1{live}"


@query(_merge_sql("segment_id IN (2, 3, 4)", "").replace("(SELECT min(segment_id) FROM log WHERE segment_id IN (2, 3, 4))", "2"))
def merge_partial_keep(spark, sf_dir):
    return rewrite.merge(event_log(spark, sf_dir), [2, 3, 4], False, NOW).select("key", "value", "rtype", "from_segment", "from_pos", "segment_id")


@query(_merge_sql("segment_id < (SELECT max(segment_id) FROM log)", f" AND {IS_LIVE}"))
def merge_full_drop(spark, sf_dir):
    log = event_log(spark, sf_dir)
    ends = log.agg(F.min("segment_id"), F.max("segment_id")).first()
    return rewrite.merge(log, range(ends[0], ends[1]), True, NOW).select("key", "value", "rtype", "from_segment", "from_pos", "segment_id")


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE}")
def merge_then_read(spark, sf_dir):
    """Merging changes no answer: the live keys of the store after a partial merge."""
    log = event_log(spark, sf_dir).select("key", "value", "rtype", "expires_ns", "seq", "segment_id", "pos")
    return scan.for_each(rewrite.merged_store(log, [2, 3, 4], False, NOW), NOW)


TIERS = f"catalog AS (SELECT segment_id, CAST(sum({SIZE}) AS BIGINT) AS bytes FROM log GROUP BY 1), tiers AS (SELECT *, CAST((bytes >= {TIER_BASE * 4})::INT + (bytes >= {TIER_BASE * 16})::INT + (bytes >= {TIER_BASE * 64})::INT AS BIGINT) AS tier FROM catalog)"


@query(f"WITH {LOG}, {TIERS} SELECT segment_id, bytes, tier FROM tiers")
def size_tiers(spark, sf_dir):
    return stats.tiers(event_log(spark, sf_dir), TIER_BASE)


def _run_sql(held: str) -> str:
    return f"""WITH {LOG}, {TIERS}, marks AS (SELECT *, CASE WHEN lag(tier) OVER (ORDER BY segment_id DESC) = tier THEN 0 ELSE 1 END AS fresh FROM tiers WHERE {held}),
 runs AS (SELECT *, sum(fresh) OVER (ORDER BY segment_id DESC) AS run FROM marks),
 best AS (SELECT run, min(tier) AS tier, min(segment_id) AS oldest FROM runs GROUP BY run HAVING count(*) >= 2 ORDER BY tier, run LIMIT 1)
 SELECT r.segment_id, b.tier, b.oldest = (SELECT min(segment_id) FROM catalog) AS drop FROM runs r JOIN best b USING (run)"""


@query(_run_sql("true"))
def pick_merge_run(spark, sf_dir):
    catalog = event_log(spark, sf_dir).groupBy("segment_id").agg(F.sum(record_size()).alias("bytes"))
    return maintenance.merge_run(catalog, TIER_BASE)


@query(_run_sql("segment_id < 12"))
def pick_merge_held(spark, sf_dir):
    catalog = event_log(spark, sf_dir).groupBy("segment_id").agg(F.sum(record_size()).alias("bytes"))
    return maintenance.merge_run(catalog, TIER_BASE, held=12)


@query(f"WITH {LOG} SELECT key, seq, lag(seq) OVER (PARTITION BY key ORDER BY segment_id, pos) AS previous_seq, lead(ts_ns) OVER (PARTITION BY key ORDER BY segment_id, pos) AS replaced_ns FROM log")
def version_history(spark, sf_dir):
    w = Window.partitionBy("key").orderBy("segment_id", "pos")
    return event_log(spark, sf_dir).select("key", "seq", F.lag("seq").over(w).alias("previous_seq"), F.lead("ts_ns").over(w).alias("replaced_ns"))


@query(f"{LATEST} SELECT l.segment_id, count(*) AS n_records, CAST(sum(l.size) AS BIGINT) AS bytes, count(*) FILTER (k.pos IS NOT NULL) AS n_live, CAST(coalesce(sum(l.size) FILTER (k.pos IS NOT NULL), 0) AS BIGINT) AS live_bytes FROM (SELECT *, {SIZE} AS size FROM log) l LEFT JOIN (SELECT segment_id, pos FROM latest WHERE {IS_LIVE}) k USING (segment_id, pos) GROUP BY 1")
def dead_ratio(spark, sf_dir):
    return stats.dead_records(event_log(spark, sf_dir), NOW)


@query(f"{LATEST} SELECT key, expires_ns FROM latest WHERE {STATUS} = 'EXPIRED'")
def expired_keys(spark, sf_dir):
    return resolve.latest(event_log(spark, sf_dir).drop("value")).where(status(NOW) == "EXPIRED").select("key", "expires_ns")


@query(f"{LATEST} SELECT key, expires_ns FROM latest WHERE {IS_LIVE} AND expires_ns <> 0 AND expires_ns <= {NOW + SOON}")
def expiring_soon(spark, sf_dir):
    alive = resolve.live(event_log(spark, sf_dir).drop("value"), NOW)
    return alive.where((F.col("expires_ns") != 0) & (F.col("expires_ns") <= NOW + SOON)).select("key", "expires_ns")


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, key ORDER BY pos DESC) AS rn FROM log) SELECT batch_id, key, pos, rtype FROM r WHERE rn = 1")
def batch_last_wins(spark, sf_dir):
    return event_log(spark, sf_dir).groupBy("batch_id", "key").agg(F.max("pos").alias("pos"), F.max_by("rtype", "pos").alias("rtype"))


@query(f"WITH {LOG} SELECT batch_id, count(*) AS n FROM log WHERE pos % 101 <> 7 GROUP BY 1 HAVING count(*) = 8")
def batch_whole_only(spark, sf_dir):
    """Batches of eight of which no record is lost, where every 101st record is."""
    return verify.whole_batches(event_log(spark, sf_dir).where("pos % 101 <> 7"), "batch_id", F.lit(8))


@query(f"WITH {LOG}, bad AS (SELECT segment_id, min(batch_id * 8) AS cut FROM log WHERE pos % 1009 = 300 GROUP BY 1) SELECT segment_id, count(*) AS n, max(pos) AS last_pos FROM log LEFT JOIN bad USING (segment_id) WHERE cut IS NULL OR batch_id * 8 < cut GROUP BY 1")
def recover_prefix(spark, sf_dir):
    """What is left of each segment if every 1009th record is damaged: all batches before the first damaged one."""
    log = event_log(spark, sf_dir).withColumn("batch_pos", F.col("batch_id") * 8)
    return verify.recover(log, F.col("pos") % 1009 != 300).groupBy("segment_id").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query(f"WITH {LOG} SELECT segment_id, min(pos) AS pos FROM log WHERE pos % 1009 = 300 GROUP BY 1")
def verify_first_damage(spark, sf_dir):
    """The first record of each segment whose stored checksum is not the one of its bytes."""
    raw = F.concat(F.lit(bytes(4)), F.encode(F.concat_ws("|", "key", "value", "seq"), "utf-8"))
    log = event_log(spark, sf_dir).withColumn("raw", raw)
    log = log.withColumn("crc", F.when(F.col("pos") % 1009 == 300, verify.checksum() + 1).otherwise(verify.checksum()))
    return verify.verify(log, verify.checksum())


@query(f"{LATEST} SELECT key, value, seq, ts_ns, expires_ns FROM latest WHERE {IS_LIVE}")
def snapshot_live(spark, sf_dir):
    return feed.snapshot(event_log(spark, sf_dir), NOW).select("key", "value", "seq", "ts_ns", "expires_ns")


@query(f"WITH {LOG} SELECT seq, key, rtype, value FROM log WHERE seq > (SELECT max(seq) FROM log) - 100")
def since_seq(spark, sf_dir):
    log = event_log(spark, sf_dir)
    last = log.agg(F.max("seq")).first()[0]
    return feed.since_seq(log, last - 99).select("seq", "key", "rtype", "value")


@query(f"WITH {LOG}, t AS (SELECT *, sum({SIZE}) OVER (ORDER BY pos) AS total FROM log WHERE segment_id = 1 AND pos > 100) SELECT seq, key FROM t WHERE total <= 4096 OR pos = 101")
def since_batch(spark, sf_dir):
    return feed.next_batch(event_log(spark, sf_dir), 1, 100, 4096).select("seq", "key")


@query(f"WITH {LOG} SELECT max(segment_id) AS segment, max(pos) AS last, max(seq) + 1 AS seq FROM log")
def end_position(spark, sf_dir):
    return feed.position(event_log(spark, sf_dir))


@query(f"{LATEST} SELECT count(*) AS live, CAST(0 AS BIGINT) AS different FROM latest WHERE {IS_LIVE}")
def replica_equals_leader(spark, sf_dir):
    """A snapshot at segment 1, then the feed from there: the follower's live keys against the leader's."""
    log = event_log(spark, sf_dir).select("key", "value", "rtype", "expires_ns", "segment_id", "pos")
    start = log.where("segment_id = 1")
    follower = feed.apply_batch(feed.snapshot(start, 0), feed.after(log, 1, 499))
    different = feed.diff(follower, log, NOW).agg(F.count("*").alias("different"))
    return resolve.live(follower, NOW).agg(F.count("*").alias("live")).join(F.broadcast(different))  # one row each


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE}")
def apply_twice_idempotent(spark, sf_dir):
    log = event_log(spark, sf_dir).select("key", "value", "rtype", "expires_ns", "segment_id", "pos")
    once = feed.apply_batch(log.where("segment_id = 1"), feed.after(log, 1, 499))
    return scan.for_each(feed.apply_batch(once, feed.after(log, 1, 499)), NOW)


@query(f"WITH {LOG}, p AS (SELECT segment_id AS segment, max(seq) + 1 AS seq FROM log GROUP BY 1) SELECT segment, CASE WHEN seq <= 700 THEN 'REACHED' ELSE 'STALE' END AS state FROM p")
def reached_status(spark, sf_dir):
    """Which ends of segments a follower that has applied up to number 700 has reached."""
    ends = event_log(spark, sf_dir).groupBy(F.col("segment_id").alias("segment")).agg((F.max("seq") + 1).alias("seq"), (F.max("pos") + 1).alias("offset"))
    applied = StorePosition(1, 2, LogPosition(700, 699, 0, 700))
    state = feed.reached_state(F.lit(1), F.col("segment"), F.col("offset"), F.col("seq"), 1, StorePosition(1, 1), applied)
    return ends.select("segment", state.alias("state"))


@query(f"WITH {LOG}, c AS (SELECT segment_id, max(seq) AS max_seq, segment_id = 2 AS dropped FROM log GROUP BY 1) SELECT segment_id, NOT EXISTS (SELECT 1 FROM c d WHERE d.segment_id >= c.segment_id AND d.dropped) AS allowed FROM c")
def resume_allowed(spark, sf_dir):
    """From which segments a follower can go on by number, if segment 2 was rewritten with records dropped."""
    catalog = event_log(spark, sf_dir).groupBy("segment_id").agg(F.max("seq").alias("max_seq")).withColumn("dropped", F.col("segment_id") == 2)
    return feed.resumable(catalog)


@query(f"{LATEST} SELECT key, segment_id, pos, 'KEY_MISMATCH' AS problem FROM (SELECT CASE WHEN pos % 7 = 0 THEN 'x' || key ELSE key END AS key, segment_id, pos, pos % 7 = 0 AS broken FROM latest) WHERE broken")
def index_validate(spark, sf_dir):
    """An index some of whose keys are wrong, held against the log."""
    log = event_log(spark, sf_dir)
    index = resolve.latest(log.select("key", "segment_id", "pos")).withColumn("key", F.when(F.col("pos") % 7 == 0, F.concat(F.lit("x"), F.col("key"))).otherwise(F.col("key")))
    return verify.validate_index(index, log)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) SELECT 'cust:' || CAST(o_custkey AS VARCHAR) AS key, o_orderpriority AS value FROM r WHERE rn = 1 AND o_orderstatus <> 'F'")
def orders_live(spark, sf_dir):
    return scan.for_each(order_log(spark, sf_dir), NOW)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT 'conv:' || CAST(conv_id AS VARCHAR) AS key, turn AS pos FROM r WHERE rn = 1")
def conversations_latest(spark, sf_dir):
    return resolve.latest(conversation_log(spark, sf_dir).select("key", "segment_id", "pos")).select("key", "pos")


@query(f"WITH {LOG} SELECT segment_id, key, value, rtype, seq, expires_ns FROM log")
def decode_segment(spark, sf_dir):
    """Every record encoded into binary segments and decoded again."""
    decoded = segments.decode(segments.encode(event_log(spark, sf_dir)), "strict")
    return decoded.select("segment_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "rtype", "seq", "expires_ns")


@query(f"{LATEST} SELECT key, segment_id, pos FROM latest")
def stream_latest(spark, sf_dir):
    """The same as index_latest, by a stream over the events."""
    name = f"stream_latest_{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = live.latest_stream(as_log(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")).select("key", "segment_id", "pos"))
    run = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query(f"WITH {LOG} SELECT count(DISTINCT key) AS probed, CAST(0 AS BIGINT) AS missed FROM log")
def bloom_no_false_negative(spark, sf_dir):
    """Every key of a segment must be found in the segment's filter."""
    log = event_log(spark, sf_dir).select("segment_id", "key")
    filters = bloom.build(log)
    hits = bloom.probe(log.distinct(), filters)
    return hits.agg(F.countDistinct("key").alias("probed"), F.count_if(~F.col("maybe")).alias("missed"))


QUARTER = "n AS (SELECT (max(event_id) + 4) // 4 AS q FROM events)"


def _leader(spark, sf_dir):
    """A store and the event log in four frames, to be appended one after another."""
    log = event_log(spark, sf_dir).withColumn("ord", F.col("pos"))
    quarter = (log.agg(F.max("pos")).first()[0] + 4) // 4
    frames = [log.where(F.col("pos").between(k * quarter, (k + 1) * quarter - 1)).select("ord", "key", "value", "rtype", "expires_ns") for k in range(4)]
    return LogStore(spark, scratch_path(spark, "leader"), segment_bytes=8_000), frames


def _text(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), *more)


@query(f"{LATEST} SELECT key, value FROM latest WHERE {IS_LIVE}")
def store_replica_live(spark, sf_dir):
    """A follower that takes a snapshot of half a store's life, and then follows it by batches through merges."""
    leader, frames = _leader(spark, sf_dir)
    follower = LogStore(spark, scratch_path(spark, "follower"), segment_bytes=40_000)
    for frame in frames[:2]:
        leader.append(frame, 1)
    rows, pos, release = leader.snapshot(0)
    follower.apply_snapshot(rows, pos)
    for frame in frames[2:]:
        leader.append(frame, 2)
        leader.maintain(0)
    for rows, start, end in leader.follow(pos):
        follower.apply(rows, start, end)
    release()
    return _text(scan.for_each(follower.read(), NOW))


@query(f"WITH {LOG}, {QUARTER} SELECT key, value, seq FROM log, n WHERE pos >= 2 * q AND pos < 3 * q")
def store_since_unit(spark, sf_dir):
    """One call for the feed with a small limit gives one whole frame."""
    leader, frames = _leader(spark, sf_dir)
    for frame in frames[:2]:
        leader.append(frame, 1)
    pos = leader.position()
    for frame in frames[2:]:
        leader.append(frame, 2)
    return _text(leader.since(pos, 1)[0], "seq")


@query(f"{LATEST} SELECT key, value, seq FROM latest WHERE {IS_LIVE}")
def store_merged_live(spark, sf_dir):
    """The live records of a store after all its merges."""
    leader, frames = _leader(spark, sf_dir)
    for frame in frames:
        leader.append(frame, 1)
        leader.maintain(NOW)
    leader.rotate()
    leader.merge_all(NOW)
    return _text(leader.read(), "seq")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["event_log", "oracle_sql", "queries"]
