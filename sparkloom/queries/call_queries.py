"""Call logs, caches, traces: events are calls of their user's session, purchases write, errors fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import calls as C
from sparkloom.queries import query, read


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq"), F.col("event_type").alias("tool"), "event_id", "user_id", "props", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query("""WITH m AS (SELECT user_id, epoch_us(ts) AS seq, event_type AS tool, row_number() OVER w - 1 AS idx, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY seq) AS run FROM m)
SELECT user_id AS session, tool, min(idx) AS start_index, count(*) AS occurrences, min(seq) AS first_seq, max(seq) AS last_seq FROM r GROUP BY user_id, run, tool HAVING count(*) >= 3""")
def mine_runs(spark: SparkSession, d: str) -> DataFrame:
    return C.mine_runs(_calls(spark, d), 3)


@query("""WITH e AS (SELECT *, event_type = 'purchase' AS w, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts) AS epoch FROM events)
SELECT event_id, epoch::BIGINT AS epoch, NOT w AND row_number() OVER (PARTITION BY user_id, w, epoch, event_type, props ORDER BY ts) > 1 AS hit FROM e""")
def cache_hits_epoch(spark: SparkSession, d: str) -> DataFrame:
    c = _calls(spark, d).withColumn("resource", F.col("user_id")).withColumn("is_write", F.col("tool") == "purchase")
    return C.cache_hits(c, ["tool", "props"]).select("event_id", "epoch", "hit")


@query("""SELECT o_orderkey AS entry FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND s_acctbal < 0)""")
def invalidate_reads(spark: SparkSession, d: str) -> DataFrame:
    """Orders are cache entries that read their suppliers; suppliers in debt are written."""
    reads = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("reads"))
    entries = read(spark, d, "orders").join(reads, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("entry"), "reads")
    return C.invalidate(entries, read(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("resource"))).select("entry")


@query("""SELECT e.event_id, c.c_name AS cached, c.c_custkey IS NOT NULL AS hit FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_mktsegment = 'BUILDING'""")
def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    cache = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("key"), F.col("c_name").alias("cached"))
    return read(spark, d, "events").withColumn("key", F.sha2(F.col("user_id").cast("string"), 256)).join(cache, "key", "left").select("event_id", "cached", F.col("cached").isNotNull().alias("hit"))


@query("""WITH c AS (SELECT event_id, event_type AS key, epoch_ms(ts) AS s, epoch_ms(ts) + (CAST(value AS BIGINT) % 500) * 1000 AS e FROM events),
n AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY key ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM c),
f AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s, event_id) AS flight FROM n)
SELECT event_id, first_value(event_id) OVER (PARTITION BY key, flight ORDER BY s, event_id) AS leader FROM f""")
def single_flight(spark: SparkSession, d: str) -> DataFrame:
    """A call takes its value's seconds; SQL's cast rounds halves to the even number."""
    c = _calls(spark, d).select(F.col("event_id").alias("id"), F.col("tool").alias("key"), F.col("ms").alias("start_ms"), (F.col("ms") + (F.rint("value").cast("bigint") % 500) * 1000).alias("end_ms"))
    return C.single_flight(c).select(F.col("id").alias("event_id"), "leader")


_METRICS = """SELECT user_id AS plan_id, count(DISTINCT CAST(props->>'$.k' AS INTEGER)) AS nodes_total, count(*) FILTER (event_type = 'purchase') AS nodes_succeeded, count(*) FILTER (event_type = 'error') AS nodes_failed,
count(*) FILTER (event_type = 'signup') AS nodes_skipped, count(*) FILTER (event_type = 'view') AS cache_hits, count(*) FILTER (event_type = 'click') AS retries,
CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' ELSE 'success' END AS run_status FROM events GROUP BY user_id"""


def _trace(spark: SparkSession, d: str) -> DataFrame:
    names = {"purchase": "finished", "error": "failed", "signup": "skipped", "view": "cache_hit", "click": "retried"}
    status = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    return read(spark, d, "events").select(F.col("user_id").alias("plan_id"), F.get_json_object("props", "$.k").alias("node"), status.alias("status"))


@query(_METRICS)
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    return C.run_metrics(_trace(spark, d))


@query("""SELECT user_id AS plan_id, CASE WHEN bool_or(event_type = 'signup') THEN 'cancelled' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'success' END AS run_status, bool_and(event_type <> 'error') AS conforms FROM events GROUP BY user_id""")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    t = _trace(spark, d).groupBy("plan_id").agg(F.bool_or(F.col("status") == "skipped").alias("c"), F.count_if(F.col("status") == "failed").alias("f"))
    return t.select("plan_id", C.run_status(F.col("c"), F.col("f")).alias("run_status"), (F.col("f") == 0).alias("conforms"))


@query("""SELECT event_type AS case_id, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS deviation,
round(avg(value) FILTER (user_id % 2 = 0) / avg(value) FILTER (user_id % 2 = 1), 6) AS speedup FROM events GROUP BY 1""")
def bench_stats(spark: SparkSession, d: str) -> DataFrame:
    side = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    return read(spark, d, "events").groupBy(F.col("event_type").alias("case_id")).agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.round(side(0) / side(1), 6).alias("speedup"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts)::INT AS attempt FROM events")
def attempt_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("event_id", F.row_number().over(Window.partitionBy("session", "tool").orderBy("seq")).alias("attempt"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, role)::INT AS position FROM conversations")
def serial_position(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.floor(F.col("turn") / 2), "role")
    return read(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("position"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 40")
def stderr_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 40 lines of each session."""
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    return _calls(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 40").select("user_id", "event_id")


@query("SELECT e.event_id, CASE WHEN c.c_custkey IS NULL THEN 'batch_missing_output' END AS code, c.c_mktsegment AS output FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_acctbal > 0")
def batch_output_join(spark: SparkSession, d: str) -> DataFrame:
    out = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("output"))
    return read(spark, d, "events").join(out, "user_id", "left").select("event_id", F.when(F.col("output").isNull(), "batch_missing_output").alias("code"), "output")


@query("SELECT event_id, CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'unresolved_output' END AS code, CASE WHEN event_type <> 'error' THEN props END AS output FROM events")
def declared_outputs(spark: SparkSession, d: str) -> DataFrame:
    """A missing output is an error unless its node is already dead (odd sessions)."""
    e = read(spark, d, "events").withColumn("output", F.when(F.col("event_type") != "error", F.col("props")))
    return e.select("event_id", F.when(F.col("output").isNull() & (F.col("user_id") % 2 == 0), "unresolved_output").alias("code"), "output")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0")
def unsettled(spark: SparkSession, d: str) -> DataFrame:
    done = read(spark, d, "orders").where("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select((F.col("user_id") % 8).alias("cache"), F.col("seq").alias("ts"), F.concat("tool", F.lit(":"), "user_id").alias("key"), F.col("user_id").alias("resource"), (F.col("tool") == "purchase").alias("is_write"))


@query()
def lru_replay(spark: SparkSession, d: str) -> DataFrame:
    return C.replay_lru(_log(spark, d), 16)


TTL = 3_600_000_000


@query(f"""
WITH RECURSIVE calls AS (SELECT user_id % 8 AS cache, epoch_us(ts) AS ts, event_type || ':' || user_id AS key, user_id AS resource, event_type = 'purchase' AS is_write FROM events
), placed AS (SELECT *, sum(is_write::INT) OVER (PARTITION BY resource ORDER BY ts, key ROWS UNBOUNDED PRECEDING) AS epoch FROM calls
), reads AS (SELECT *, row_number() OVER (PARTITION BY key, epoch ORDER BY ts) AS nth FROM placed WHERE NOT is_write
), held AS (
  SELECT *, ts AS since, false AS hit FROM reads WHERE nth = 1
  UNION ALL
  SELECT r.*, CASE WHEN r.ts - h.since > {TTL} THEN r.ts ELSE h.since END, r.ts - h.since <= {TTL} FROM held h JOIN reads r ON r.key = h.key AND r.epoch = h.epoch AND r.nth = h.nth + 1
)
SELECT cache, ts, key, resource, is_write, hit FROM held UNION ALL SELECT cache, ts, key, resource, is_write, false FROM placed WHERE is_write
""")
def ttl_replay(spark: SparkSession, d: str) -> DataFrame:
    """An entry lives for an hour from its insert; a write drops its user's entries."""
    return C.replay_lru(_log(spark, d), 1 << 30, TTL)
