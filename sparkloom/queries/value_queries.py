"""Scalar operators over events, orders, parts, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import values as V
from sparkloom.queries import query, read


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, list_contains(json_keys(props), 'k') AS has_k, list_contains(json_keys(props), 'z') AS has_z FROM events")
def pick_path(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", V.pick(F.col("props"), "k", "int").alias("k"), V.has_path(F.col("props"), "k").alias("has_k"), V.has_path(F.col("props"), "z").alias("has_z"))


@query("SELECT event_id, event_type AS kind, CASE WHEN event_type = 'error' THEN 'override' ELSE props->>'$.k' END AS k, 'error' = event_type AS replaced FROM events")
def merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    base = F.from_json("props", "map<string,string>")
    more = F.when(F.col("event_type") == "error", F.create_map(F.lit("k"), F.lit("override"))).otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))
    m = V.merge_maps(base, F.create_map(F.lit("kind"), F.col("event_type")), more)
    return e.select("event_id", m["kind"].alias("kind"), m["k"].alias("k"), (m["k"] == "override").alias("replaced"))


@query("SELECT c_custkey, 'customer:' || c_custkey || '/' || c_mktsegment AS label FROM customer")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    text, _ = V.template("customer:{c_custkey}/{c_mktsegment}", {c: F.col(c) for c in ("c_custkey", "c_mktsegment")})
    return read(spark, d, "customer").select("c_custkey", text.alias("label"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'user:{user_id}/{reason}' ELSE 'user:' || user_id || '/' || event_type END AS resource, event_type <> 'error' AS resolved FROM events")
def template_unresolved(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("event_type") != "error", F.col("event_type"))
    text, known = V.template("user:{user_id}/{reason}", {"user_id": F.col("user_id"), "reason": reason})
    return read(spark, d, "events").select("event_id", text.alias("resource"), known.alias("resolved"))


@query("""SELECT event_id, '{"a":{"y":' || (props->>'$.k') || ',"z":"' || event_type || '"},"u":' || user_id || '}' AS key FROM events""")
def canonical_key(spark: SparkSession, d: str) -> DataFrame:
    loose = F.concat(F.lit('{ "u": '), F.col("user_id"), F.lit(', "a": {"z": "'), F.col("event_type"), F.lit('", "y" : '), F.get_json_object("props", "$.k"), F.lit("} }"))
    return read(spark, d, "events").select("event_id", V.canonical_json(loose).alias("key"))


_GATE = "CASE WHEN event_type = 'error' THEN 'null' WHEN event_type = 'click' THEN 'false' WHEN event_type = 'view' THEN '0' ELSE props END"


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error', 'click')")
def when_truthy(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where(V.truthy(F.expr(_GATE))).select("event_id")


@query("SELECT event_id FROM events WHERE CAST(props->>'$.k' AS INTEGER) = 3")
def when_equals(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where(V.equals(F.col("props"), '{ "k" : 3 }')).select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('error', 'click')")
def when_not(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where(~V.truthy(F.expr(_GATE))).select("event_id")


@query("SELECT p_partkey, (SELECT string_agg(upper(w) || ':' || (i - 1), '|' ORDER BY i) FROM (SELECT unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i)) AS mapped FROM part")
def fan_out_ordered(spark: SparkSession, d: str) -> DataFrame:
    mapped = F.transform(F.split("p_name", " "), lambda x, i: F.concat(F.upper(x), F.lit(":"), i.cast("string")))
    return read(spark, d, "part").select("p_partkey", F.array_join(mapped, "|").alias("mapped"))


@query("SELECT event_id, replace(replace(event_type || '.' || '~' || user_id, '~', '~0'), '.', '~1') AS escaped, event_type || '.' || '~' || user_id AS back FROM events")
def segment_escape(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("event_type", F.lit(".~"), "user_id")
    return read(spark, d, "events").select("event_id", V.escape_segment(raw).alias("escaped"), V.unescape_segment(V.escape_segment(raw)).alias("back"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS ok FROM customer")
def node_id_check(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '.x') WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END")
    return read(spark, d, "customer").select("c_custkey", V.valid_node_id(name).alias("ok"))


@query("""SELECT event_id, '{"api_key":"[redacted]","k":' || (props->>'$.k') || ',"Max_Tokens":"[redacted]"}' AS flat,
'{"user":{"name":"' || event_type || '","PassWord":"[redacted]"},"list":[{"authorization_x":"[redacted]","n":' || user_id || '}]}' AS deep FROM events""")
def redact_keys(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    flat = F.create_map(F.lit("api_key"), F.lit("s3cr3t"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("Max_Tokens"), F.lit("17"))
    flat = V.redact_map(flat)
    text = F.concat(F.lit('{"api_key":"'), flat["api_key"], F.lit('","k":'), flat["k"], F.lit(',"Max_Tokens":"'), flat["Max_Tokens"], F.lit('"}'))
    deep = F.concat(F.lit('{"user": {"name": "'), "event_type", F.lit('", "PassWord": [1, {"x": 2}]}, "list": [{"authorization_x": "Basic", "n": '), "user_id", F.lit("}]}"))
    return e.select("event_id", text.alias("flat"), V.redact_json(deep).alias("deep"))


_CUT = """SELECT conv_id, turn, CASE WHEN octet_length(encode(j)) > 100 THEN '{"$truncated":true,"bytes":' || octet_length(encode(j)) || ',"preview":' || to_json(left(j, 100)) || '}' ELSE j END AS shaped
FROM (SELECT conv_id, turn, to_json({'role': role, 'text': text}) AS j FROM conversations)"""


@query(_CUT)
def truncate_output(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", V.truncated(F.to_json(F.struct("role", "text")), 100).alias("shaped"))


@query("SELECT attempt, least(CAST(100 * pow(2, least(attempt - 1, 16)) AS BIGINT), 5000) AS wait_ms FROM (SELECT unnest(range(1, 25)) AS attempt)")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 25).select(F.col("id").alias("attempt"), V.backoff_ms(F.col("id")).alias("wait_ms"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN greatest(k, 1) ELSE 1 END AS attempts, CASE WHEN k % 2 = 0 THEN k * 100 ELSE 30000 END AS timeout_ms
FROM (SELECT event_id, event_type, CAST(props->>'$.k' AS INTEGER) AS k FROM events)""")
def retry_attempts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("k", V.pick(F.col("props"), "k", "int"))
    t = F.col("event_type")
    timeout = F.coalesce(F.when(F.col("k") % 2 == 0, F.col("k") * 100), F.lit(30000))
    return e.select("event_id", V.retry_attempts(t == "view", t == "click", F.when(t != "purchase", F.col("k"))).alias("attempts"), timeout.alias("timeout_ms"))


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN false WHEN event_type = 'view' THEN true ELSE event_type = 'error' OR contains('slow ' || event_type || ' call', 'purchase c') END AS again FROM events""")
def retryable(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    verdict = F.when(t == "signup", F.lit(False)).when(t == "view", F.lit(True))
    errors = F.array(F.lit("error"), F.lit("purchase c"))
    return read(spark, d, "events").select("event_id", V.is_retryable(verdict, t, F.concat(F.lit("slow "), t, F.lit(" call")), errors).alias("again"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing_node_output' WHEN event_type = 'view' THEN 'missing_path' END AS code FROM events")
def resolution_codes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", V.resolution_code(F.col("event_type") != "error", V.has_path(F.when(F.col("event_type") != "view", F.col("props")).otherwise(F.lit("{}")), "k")).alias("code"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'https://h.example/' || user_id ELSE 'https://api.example/v1/' || event_type || '/' || user_id END AS url,
event_type IN ('view', 'signup') AS version_ok FROM events""")
def url_join(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    url = F.when(t == "click", F.concat(F.lit("https://h.example/"), "user_id")).otherwise(F.concat(F.lit("//"), "event_type", F.lit("/"), "user_id"))
    version = F.when(t.isin("view", "signup"), F.lit("2025-06-18")).when(t == "error", F.lit("20250618-1")).otherwise(F.lit("2025-6-18"))
    return read(spark, d, "events").select("event_id", V.join_url(F.lit("https://api.example/v1/"), url).alias("url"), V.protocol_version_ok(version).alias("version_ok"))


@query("SELECT o_orderkey, 5 * ((o_orderkey % 4)::BIGINT) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 10 END AS ms FROM orders")
def dispatch_cost(spark: SparkSession, d: str) -> DataFrame:
    fixed = F.when(F.col("o_orderkey") % 3 != 0, 10)
    return read(spark, d, "orders").select("o_orderkey", V.dispatch_ms(fixed, F.lit(5), F.col("o_orderkey") % 4).cast("bigint").alias("ms"))


@query("SELECT conv_id, turn, left(text, list_max(list_filter(range(0, 21), lambda k: octet_length(encode(left(text, k))) <= 20))) AS head FROM conversations")
def capped_decode(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", V.capped_text(F.col("text").cast("binary"), 20).alias("head"))


@query("SELECT page_id, regexp_matches(split_part(url, '://', 2), '^[^/]*/en/[^/]*\\.html$') AS hit FROM pages")
def glob_predicate(spark: SparkSession, d: str) -> DataFrame:
    path = F.split_part("url", F.lit("://"), F.lit(2))
    return read(spark, d, "pages").select("page_id", path.rlike(V.glob_like("*/en/*.html")).alias("hit"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN to_json(text) WHEN turn % 3 = 0 THEN NULL ELSE '{"n":' || turn || '}' END AS result, role <> 'user' AND turn % 3 = 0 AS failed FROM conversations""")
def mcp_normalize(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.sources.mcp import normalized

    bad = (F.col("role") != "user") & (F.col("turn") % 3 == 0)
    raw = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("structuredContent"), F.lit(False).alias("isError")))).when(bad, F.lit('{"isError":true,"content":[{"type":"text","text":"no"}]}')).otherwise(F.concat(F.lit('{"n":'), "turn", F.lit("}")))
    value, error = normalized(raw)
    return read(spark, d, "conversations").select("conv_id", "turn", value.alias("result"), error.isNotNull().alias("failed"))


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS message FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def text_join(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").where("role = 'user'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy("conv_id").agg(F.array_join(parts, "\n").alias("message"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'mcp:shop' END AS reads, CASE WHEN event_type <> 'view' THEN 'mcp:shop' END AS writes,
event_type IN ('view', 'signup') AS idempotent, event_type = 'view' AND user_id % 2 = 0 AS cacheable, event_type <> 'error' AS declared FROM events""")
def tool_usage_effects(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.sources.mcp import effects_of

    t, even = F.col("event_type"), F.col("user_id") % 2 == 0
    e = effects_of("shop", read_only=t == "view", idempotent=t.isin("view", "signup"), cacheable=(t == "view") & even)
    return read(spark, d, "events").select("event_id", *[e[k].alias(k) for k in ("reads", "writes", "idempotent", "cacheable")], (t != "error").alias("declared"))


@query("""SELECT event_id, 'status=' || CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END || ' nodes=' || user_id || ' wall_ms=' || (props->>'$.k') AS line FROM events""")
def run_summary_text(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return read(spark, d, "events").select("event_id", F.format_string("status=%s nodes=%d wall_ms=%s", status, "user_id", F.get_json_object("props", "$.k")).alias("line"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{"id":' || turn || ',"ok":true}' END AS answer FROM conversations""")
def sse_pick(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.sources.mcp import sse_answer

    c = read(spark, d, "conversations")
    other = F.concat(F.lit('event: message\ndata: {"id":-1}\n\n'))
    mine = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('event: message\ndata: {"id":'), "turn", F.lit(',"ok":true}\n\n'))).otherwise(F.lit(": ping\n\n"))
    return c.select("conv_id", "turn", sse_answer(F.concat(other, mine), F.col("turn")).alias("answer"))


@query("SELECT event_id, user_id % 7 = 0 AS blocked, CAST(props->>'$.k' AS INTEGER) < 50 AS valid FROM events WHERE event_type = 'click'")
def input_gates(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("event_type = 'click'")
    blocked = F.pmod("user_id", F.lit(7)) == 0
    return e.select("event_id", blocked.alias("blocked"), F.coalesce(V.pick(F.col("props"), "k", "int") < 50, F.lit(False)).alias("valid"))
