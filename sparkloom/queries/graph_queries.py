"""Graph operators: conversations are plans (turns are nodes), orders are plans of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import graphs as G
from sparkloom.operators.settling import settle
from sparkloom.queries import query, read


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns as nodes: plan_id, node_id, pos, tool."""
    return read(spark, d, "conversations").select(F.col("conv_id").alias("plan_id"), F.col("turn").alias("node_id"), F.col("turn").alias("pos"), F.col("role").alias("tool"), "text")


def _chain(spark: SparkSession, d: str) -> DataFrame:
    """Each turn depends on the one before."""
    t = _turns(spark, d)
    return t.where("node_id > 0").select("plan_id", (F.col("node_id") - 1).alias("src"), F.col("node_id").alias("dst"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as nodes of their order's plan; the tool is the return flag, the input the part's and supplier's last digit."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = read(spark, d, "lineitem").withColumn("node_id", F.row_number().over(w))
    return li.select(F.col("l_orderkey").alias("plan_id"), "node_id", F.col("node_id").alias("pos"), F.col("l_returnflag").alias("tool"), (F.col("l_partkey") % 3).alias("input"), "l_quantity", "l_suppkey")


_LINES = "lines AS (SELECT l_orderkey AS plan_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INT AS node_id, l_returnflag AS tool, l_partkey % 3 AS input, l_quantity, l_suppkey FROM lineitem)"


@query("SELECT DISTINCT conv_id AS plan_id, turn - 1 AS src, turn AS dst FROM conversations WHERE turn > 0 UNION SELECT conv_id, turn - 2, turn FROM conversations WHERE turn > 1 AND role = 'user'")
def edge_union(spark: SparkSession, d: str) -> DataFrame:
    asks = _turns(spark, d).where("tool = 'user' and node_id > 1").select("plan_id", (F.col("node_id") - 2).alias("src"), F.col("node_id").alias("dst"))
    return G.union_edges(_chain(spark, d), asks, asks)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')")
def unknown_tool(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left_anti")


@query("SELECT conv_id AS plan_id, turn - 3 AS src, turn AS dst FROM conversations WHERE turn < 3")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    return G.dangling(t.select("plan_id", (F.col("node_id") - 3).alias("src"), F.col("node_id").alias("dst")), t)


@query("SELECT l_orderkey AS plan_id, l_returnflag AS node_id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_returnflag").alias("node_id"))
    return G.duplicate_ids(li)


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0")
def effect_coherence(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("writes", F.when(F.col("event_type") == "purchase", F.array(F.concat(F.lit("user:"), "user_id"))).otherwise(F.array()))
    return e.where((F.col("user_id") % 2 == 0) & (F.size("writes") > 0)).select("event_id", "event_type")


@query(f"WITH {_LINES} SELECT plan_id, node_id, CASE WHEN tool <> 'N' THEN first_value(node_id) OVER (PARTITION BY plan_id, tool, input ORDER BY node_id) ELSE node_id END AS canonical FROM lines")
def dedup_survivor(spark: SparkSession, d: str) -> DataFrame:
    return G.survivors(_lines(spark, d), ["tool", "input"], "tool <> 'N'")


_ALIAS = f"{_LINES}, alias AS (SELECT plan_id, node_id, CASE WHEN tool <> 'N' THEN first_value(node_id) OVER (PARTITION BY plan_id, tool, input ORDER BY node_id) ELSE node_id END AS canonical FROM lines)"


@query(f"""WITH {_ALIAS}, edges AS (SELECT plan_id, node_id - 1 AS src, node_id AS dst FROM lines WHERE node_id > 1)
SELECT DISTINCT e.plan_id, coalesce(s.canonical, e.src) AS src, e.dst FROM edges e JOIN alias t ON t.plan_id = e.plan_id AND t.node_id = e.dst AND t.canonical = t.node_id LEFT JOIN alias s ON s.plan_id = e.plan_id AND s.node_id = e.src""")
def alias_rewrite(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    edges = lines.where("node_id > 1").select("plan_id", (F.col("node_id") - 1).alias("src"), F.col("node_id").alias("dst"))
    return G.rewrite_edges(edges, G.survivors(lines, ["tool", "input"], "tool <> 'N'"))


_BACK = """WITH RECURSIVE edges AS (SELECT conv_id AS plan_id, turn - 1 AS src, turn AS dst FROM conversations WHERE turn > 0 AND turn % 4 <> 0),
roots AS (SELECT conv_id AS plan_id, turn AS node FROM conversations WHERE role = 'user' AND turn % 3 = 0),
live AS (SELECT plan_id, node FROM roots UNION SELECT e.plan_id, e.src FROM live l JOIN edges e ON e.plan_id = l.plan_id AND e.dst = l.node)"""


@query(f"{_BACK} SELECT conv_id AS plan_id, turn AS node FROM conversations c WHERE conv_id IN (SELECT plan_id FROM roots) AND NOT EXISTS (SELECT 1 FROM live WHERE plan_id = conv_id AND node = turn)")
def dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    edges = _chain(spark, d).where("dst % 4 <> 0")
    outputs = t.where("tool = 'user' and node_id % 3 = 0").select("plan_id", F.col("node_id").alias("node"))
    live = G.live_nodes(t.select("plan_id", "node_id", F.lit(True).alias("pure")), edges, outputs, settle)
    every = t.select("plan_id", F.col("node_id").alias("node"))
    return every.join(live, ["plan_id", "node"], "left_anti")


@query(f"{_BACK} SELECT DISTINCT e.plan_id, e.src, e.dst FROM edges e JOIN live a ON a.plan_id = e.plan_id AND a.node = e.src JOIN live b ON b.plan_id = e.plan_id AND b.node = e.dst")
def retained_subgraph(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    edges = _chain(spark, d).where("dst % 4 <> 0")
    seeds = t.where("tool = 'user' and node_id % 3 = 0").select("plan_id", F.col("node_id").alias("node"))
    kept = G.reach(seeds, edges.select("plan_id", F.col("dst").alias("a"), F.col("src").alias("b")), settle)
    return edges.join(kept.withColumnRenamed("node", "src"), ["plan_id", "src"], "left_semi").join(kept.withColumnRenamed("node", "dst"), ["plan_id", "dst"], "left_semi").select("plan_id", "src", "dst")


@query(f"""WITH {_LINES}, grouped AS (SELECT plan_id, tool, node_id, CASE WHEN tool = 'A' THEN 2 END AS batch_size, row_number() OVER (PARTITION BY plan_id, tool ORDER BY node_id) - 1 AS idx, count(*) OVER (PARTITION BY plan_id, tool) AS n FROM lines),
chunked AS (SELECT plan_id, tool, node_id, (idx // coalesce(batch_size, n))::BIGINT AS chunk FROM grouped)
SELECT *, count(*) OVER (PARTITION BY plan_id, tool, chunk) AS size FROM chunked QUALIFY size > 1""")
def batch_groups(spark: SparkSession, d: str) -> DataFrame:
    n = _lines(spark, d).withColumn("layer", F.lit(0)).withColumn("batch_size", F.when(F.col("tool") == "A", 2))
    return G.batch_groups(n.select("plan_id", "layer", "tool", "node_id", "batch_size")).select("plan_id", "tool", "node_id", "chunk", "size")


@query("SELECT conv_id AS plan_id, turn AS node_id, turn::INT AS layer FROM conversations")
def chain_layers(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    n = _turns(spark, d).select("plan_id", "node_id", "tool", F.lit(True).alias("pure"), F.lit(False).alias("commutative"), none.alias("reads"), none.alias("writes"))
    return G.layers(n, _chain(spark, d))


@query(f"WITH {_LINES} SELECT plan_id, node_id, (CASE WHEN tool = 'R' THEN row_number() OVER (PARTITION BY plan_id, tool, l_suppkey % 2 ORDER BY node_id) - 1 ELSE 0 END)::INT AS layer FROM lines")
def write_layers(spark: SparkSession, d: str) -> DataFrame:
    """Independent nodes; those of tool R write one of two resources, the others are pure."""
    writes = F.when(F.col("tool") == "R", F.array(F.concat(F.lit("r"), (F.col("l_suppkey") % 2).cast("string")))).otherwise(F.array().cast("array<string>"))
    n = _lines(spark, d).select("plan_id", "node_id", "tool", (F.col("tool") != "R").alias("pure"), F.lit(False).alias("commutative"), F.array().cast("array<string>").alias("reads"), writes.alias("writes"))
    return G.layers(n, n.select("plan_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst")).where("false"))


@query(f"""WITH {_LINES}, t AS (SELECT plan_id, node_id AS node, 's' || (l_suppkey % 5) AS resource, tool = 'R' AS w, node_id AS layer FROM lines)
SELECT DISTINCT plan_id, resource, node FROM (
  SELECT a.plan_id, a.resource, unnest([a.node, b.node]) AS node FROM t a JOIN t b ON a.plan_id = b.plan_id AND a.resource = b.resource AND a.node <> b.node AND a.w WHERE abs(a.node - b.node) <> 1)""")
def conflict_resources(spark: SparkSession, d: str) -> DataFrame:
    """Each node is its own layer; neighbours are ordered, others aren't."""
    n = _lines(spark, d)
    touches = n.select("plan_id", F.col("node_id").alias("node"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("resource"), (F.col("tool") == "R").alias("is_write"))
    layer = n.select("plan_id", F.col("node_id").alias("node"), F.col("node_id").alias("layer"))
    near = n.select("plan_id", F.col("node_id").alias("a"), F.explode(F.array(F.col("node_id") - 1, F.col("node_id") + 1)).alias("b"))
    return G.conflicts(touches, layer, near)


@query("SELECT conv_id AS plan_id, turn AS node_id, turn AS ancestors, max(turn) OVER (PARTITION BY conv_id) - turn AS descendants FROM conversations")
def ancestor_counts(spark: SparkSession, d: str) -> DataFrame:
    paths = G.closure(_chain(spark, d), settle)
    up = paths.groupBy("plan_id", F.col("dst").alias("node_id")).agg(F.count("*").alias("ancestors"))
    down = paths.groupBy("plan_id", F.col("src").alias("node_id")).agg(F.count("*").alias("descendants"))
    t = _turns(spark, d).select("plan_id", "node_id").join(up, ["plan_id", "node_id"], "left").join(down, ["plan_id", "node_id"], "left")
    return t.fillna(0, ["ancestors", "descendants"])


@query("""WITH t AS (SELECT s_suppkey, s_nationkey % 3 AS adapter, s_nationkey AS tool, CASE WHEN s_suppkey % 2 = 0 THEN 7 END AS fixed_ms, NULL::INT AS batch_size FROM supplier)
SELECT s_suppkey, coalesce(t.fixed_ms, CASE WHEN t.tool % 2 = 0 AND t.adapter = 0 THEN NULL WHEN n.n_nationkey IS NOT NULL THEN n.n_regionkey * 10 END)::INT AS fixed_ms,
CASE WHEN t.tool % 2 = 0 AND t.adapter = 0 THEN 100 + t.tool WHEN n.n_nationkey IS NOT NULL THEN 5 END::INT AS batch_size
FROM t LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n.n_nationkey = t.tool""")
def hydrate_capabilities(spark: SparkSession, d: str) -> DataFrame:
    """Scoped rows hide global ones whole, their null columns too."""
    tools = read(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("adapter"), F.col("s_nationkey").alias("tool"), F.when(F.col("s_suppkey") % 2 == 0, 7).cast("int").alias("fixed_ms"), F.lit(None).cast("int").alias("batch_size"))
    nation = read(spark, d, "nation")
    scoped = nation.where("n_nationkey % 2 = 0").select(F.lit(0).alias("adapter"), F.col("n_nationkey").alias("tool"), F.lit(None).cast("int").alias("fixed_ms"), (F.col("n_nationkey") + 100).cast("int").alias("batch_size"))
    everywhere = nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("tool"), (F.col("n_regionkey") * 10).cast("int").alias("fixed_ms"), F.lit(5).alias("batch_size"))
    return G.hydrate(tools, scoped, everywhere, ["fixed_ms", "batch_size"]).select("s_suppkey", "fixed_ms", "batch_size")


@query("""SELECT l_orderkey AS plan_id, sum(10 + 5)::BIGINT AS serial_ms, (SELECT 0) + sum(m)::BIGINT AS compiled_ms, sum(t)::BIGINT AS tokens FROM (
  SELECT l_orderkey, l_returnflag, 15 * count(*) AS s, max(10 + 5 * n) AS m, sum(l_linenumber) AS t, count(*) AS c FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n FROM lineitem) GROUP BY ALL) GROUP BY 1""".replace("sum(10 + 5)::BIGINT", "sum(s)::BIGINT").replace("(SELECT 0) + ", ""))
def cost_summary(spark: SparkSession, d: str) -> DataFrame:
    """A layer is a return flag, batched whole."""
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_returnflag").alias("layer"), F.lit(10).alias("fixed_ms"), F.lit(5).alias("per_call_ms"), F.col("l_linenumber").alias("tokens"))
    return G.cost_summary(li.withColumn("batch", F.count("*").over(Window.partitionBy("plan_id", "layer"))))


@query("""WITH RECURSIVE edges AS (SELECT conv_id AS plan_id, turn - 1 AS src, turn AS dst FROM conversations WHERE turn > 0 AND turn % 4 <> 0),
dead AS (SELECT conv_id AS plan_id, turn AS node FROM conversations WHERE turn % 5 = 1),
out AS (SELECT plan_id, node FROM dead UNION SELECT e.plan_id, e.dst FROM out o JOIN edges e ON e.plan_id = o.plan_id AND e.src = o.node)
SELECT plan_id, node, 'failed_dependency' AS reason FROM out EXCEPT SELECT plan_id, node, 'failed_dependency' FROM dead""")
def transitive_skip(spark: SparkSession, d: str) -> DataFrame:
    dead = _turns(spark, d).where("node_id % 5 = 1").select("plan_id", F.col("node_id").alias("node"))
    return G.transitive_skip(dead, _chain(spark, d).where("dst % 4 <> 0"), settle).withColumn("reason", F.lit("failed_dependency"))


@query("""SELECT a.conv_id AS plan_id, a.turn AS a, b.turn AS b, list_has_any(list_distinct(string_split(a.text, ' ')), list_distinct(string_split(b.text, ' '))) AS overlap
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def resource_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d).select("plan_id", "node_id", F.split("text", " ").alias("r"))
    nxt = t.select("plan_id", (F.col("node_id") - 1).alias("node_id"), F.col("r").alias("s"))
    return t.join(nxt, ["plan_id", "node_id"]).select("plan_id", F.col("node_id").alias("a"), (F.col("node_id") + 1).alias("b"), F.arrays_overlap("r", "s").alias("overlap"))


@query(f"""WITH {_LINES} SELECT plan_id, node_id, row_number() OVER (PARTITION BY plan_id ORDER BY l_quantity DESC, node_id)::INT AS turn FROM lines""")
def ready_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("plan_id").orderBy(F.desc("l_quantity"), "node_id")
    return _lines(spark, d).select("plan_id", "node_id", F.row_number().over(w).alias("turn"))


@query(f"""WITH {_LINES} SELECT plan_id, l_suppkey % 3 AS resource, string_agg(DISTINCT node_id::VARCHAR, ',' ORDER BY node_id::VARCHAR) FILTER (tool = 'R') AS writers, string_agg(DISTINCT node_id::VARCHAR, ',' ORDER BY node_id::VARCHAR) FILTER (tool <> 'R') AS readers, count(DISTINCT tool) > 1 AS exclusive FROM lines GROUP BY ALL""")
def group_touchers(spark: SparkSession, d: str) -> DataFrame:
    node = F.col("node_id").cast("string")
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ","))
    n = _lines(spark, d).groupBy("plan_id", (F.col("l_suppkey") % 3).alias("resource"))
    g = n.agg(F.collect_set(F.when(F.col("tool") == "R", node)).alias("w"), F.collect_set(F.when(F.col("tool") != "R", node)).alias("r"), (F.count_distinct("tool") > 1).alias("exclusive"))
    return g.select("plan_id", "resource", joined(F.col("w")).alias("writers"), joined(F.col("r")).alias("readers"), "exclusive")
