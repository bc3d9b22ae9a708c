"""Plans run end to end over tables, map-reduce, pipelines, files and the trace stream."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.settling import shared_dir
from sparkloom.plans.frontends import PlanBuilder, compile_recipe, ref, splice
from sparkloom.plans.ir import Node, Plan, parse_plan
from sparkloom.plans.runtime import Runtime
from sparkloom.queries import query, read
from sparkloom.sources.tables import Tables, table_tools


def flagship_plan() -> Plan:
    """Totals by customer with a label. Orders are scanned twice (and once after sharing); `unused` is eliminated."""
    b = PlanBuilder("customer totals")
    b.plan = Plan(tools=table_tools(), name=b.plan.name)
    b.node("orders", "scan", {"path": "orders.parquet"}).node("orders_again", "scan", {"path": "orders.parquet"})
    b.node("customers", "scan", {"path": "customer.parquet", "columns": ["c_custkey", "c_mktsegment"]})
    b.node("totals", "reduce", {"frame": ref("orders"), "by": ["o_custkey"], "aggregates": {"n_orders": ["count", "*"]}})
    b.node("largest", "reduce", {"frame": ref("orders_again"), "by": ["o_custkey"], "aggregates": {"largest": ["max", "o_totalprice"]}})
    b.node("unused", "filter", {"frame": ref("orders"), "where": "o_totalprice < 0"})
    b.node("renamed", "project", {"frame": ref("largest"), "columns": {"k": "o_custkey", "largest": "largest"}})
    b.node("both", "join", {"left": ref("totals"), "right": ref("renamed"), "on": {"o_custkey": "k"}})
    b.node("named", "join", {"left": ref("both"), "right": ref("customers"), "on": {"o_custkey": "c_custkey"}})
    b.node("labelled", "label", {"frame": ref("named"), "template": "customer:{c_custkey}/{c_mktsegment}", "as": "label"})
    b.node("out", "project", {"frame": ref("labelled"), "columns": {c: c for c in ("c_custkey", "label", "n_orders", "largest")}})
    return b.output("out", "out.output").build()


def outputs(spark: SparkSession, d: str, plan: Plan) -> dict:
    result = Runtime({"tables": Tables(spark, d)}).run(plan)
    if result.status != "success":
        raise RuntimeError(f"the plan ended as {result.status}: {result.errors}")
    return result.outputs


@query("""SELECT c_custkey, 'customer:' || c_custkey || '/' || c_mktsegment AS label, count(*) AS n_orders, max(o_totalprice) AS largest FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    return outputs(spark, d, flagship_plan())["out"]


@query("SELECT l_suppkey, count(*) AS n_lines, min(l_quantity) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1")
def map_reduce_by_key(spark: SparkSession, d: str) -> DataFrame:
    recipe = {
        "version": "0", "tools": {},
        "recipe": {"kind": "map_reduce", "tool": "scan", "items": ["lineitem.parquet"], "input_key": "path", "node_prefix": "m_", "reduce_tool": "union", "reduce_input_key": "frames"},
        "outputs": {"all": "m_reduce.output"},
    }
    plan = splice(compile_recipe(recipe), (), table_tools())
    by = {"frame": ref("m_reduce"), "by": ["l_suppkey"], "aggregates": {"n_lines": ["count", "*"], "least": ["min", "l_quantity"], "most": ["max", "l_extendedprice"]}}
    plan = Plan(plan.tools, (*plan.nodes, Node("by_key", "reduce", by)), parse_plan({"version": "0", "outputs": {"out": "by_key.output"}}).outputs)
    return outputs(spark, d, plan)["out"]


@query("SELECT o_custkey, o_orderkey * 2 AS twice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1")
def pipeline_prev(spark: SparkSession, d: str) -> DataFrame:
    steps = [
        {"tool": "scan", "input": {"path": "orders.parquet"}},
        {"tool": "filter", "input": {"frame": {"$prev": ""}, "where": {"$param": "status"}}},
        {"tool": "filter", "input": {"frame": {"$prev": ""}, "where": "o_orderkey % 2 = 1"}},
        {"tool": "project", "input": {"frame": {"$prev": ""}, "columns": {"o_custkey": "o_custkey", "twice": "o_orderkey * 2"}}},
    ]
    recipe = {"version": "0", "params": {"status": None}, "recipe": {"kind": "pipeline", "steps": steps}, "outputs": {"out": "step_4.output"}}
    plan = splice(compile_recipe(recipe, {"status": "o_orderstatus = 'F'"}), (), table_tools())
    return outputs(spark, d, plan)["out"]


@query("SELECT o_custkey, list_sum(list_transform(list(o_orderkey ORDER BY o_orderkey), lambda x, i: x * i))::BIGINT AS weighed FROM orders GROUP BY 1")
def for_each_gather(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders in order, mapped with their place and gathered."""
    own = F.array_sort(F.collect_list("o_orderkey"))
    mapped = F.transform("own", lambda x, i: x * (i + 1))
    g = read(spark, d, "orders").groupBy("o_custkey").agg(own.alias("own"))
    return g.select("o_custkey", F.aggregate(mapped, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("weighed"))


@query("SELECT 'read_' || (i + 1) AS node_id, v AS item FROM (SELECT unnest(['a.md', 'b.md', 'c.md']) AS v, unnest(range(3)) AS i)")
def fan_out_static(spark: SparkSession, d: str) -> DataFrame:
    recipe = {"version": "0", "recipe": {"kind": "fan_out", "tool": "read", "items": ["a.md", "b.md", "c.md"], "node_prefix": "read_", "input_key": "path"}}
    return spark.createDataFrame([(n.id, n.input["path"]) for n in compile_recipe(recipe).nodes], "node_id string, item string")


TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query(f"SELECT unnest({TABLES}) || '.parquet' AS name, true AS filled")
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """The tables' files, found by a glob without reading them."""
    from sparkloom.sources.files import list_files

    return list_files(spark, d, "*.parquet").select("name", (F.col("bytes") > 0).alias("filled")).orderBy("name")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def write_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written by a plan's effectful node, then scanned by one that waits for it."""
    path = f"{shared_dir(spark)}/nations-{spark.sparkContext.applicationId}"
    b = PlanBuilder()
    b.plan = Plan(tools=table_tools())
    b.node("n", "scan", {"path": "nation.parquet"}).node("r", "scan", {"path": "region.parquet"})
    b.node("j", "join", {"left": ref("n"), "right": ref("r"), "on": {"n_regionkey": "r_regionkey"}})
    b.node("w", "write", {"frame": ref("j"), "path": path}).node("again", "scan", {"path": path, "columns": ["n_nationkey", "n_name", "r_name"]}, after=["w"])
    return outputs(spark, d, b.output("out", "again.output").build())["out"]


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type AS tool, count(*) FILTER (user_id % 2 = 0) AS finished, count(*) FILTER (user_id % 2 = 1) AS failed FROM events GROUP BY ALL")
def trace_windows(spark: SparkSession, d: str) -> DataFrame:
    """The stream's windowed metrics, over a finished trace."""
    from sparkloom.streaming.trace import windowed_metrics

    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), F.when(F.col("user_id") % 2 == 0, "finished").otherwise("failed").alias("status"), F.lit(1).alias("duration_ms"))
    return windowed_metrics(e, "1 hour").select(F.col("window.start").alias("hour"), "tool", "finished", "failed")
