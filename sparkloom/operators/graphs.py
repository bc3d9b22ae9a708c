"""Analyses of many plans at once: edges, validity, layers, sharing, elimination, batches, conflicts, costs.

Tables: nodes(plan_id, pos, node_id, tool, ...), edges(plan_id, src, dst, kind) with dst depending on src.
Plans are partitioned by plan_id; what needs a plan whole (layers, closures) groups by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.plans.compiler import NodeEffects, layered
from sparkloom.plans.ir import Effects, PlanError

DATA_KINDS = ("ref", "for_each", "when")


def union_edges(*parts: DataFrame) -> DataFrame:
    """Distinct (plan_id, src, dst) of edge tables."""
    whole = parts[0].select("plan_id", "src", "dst")
    for p in parts[1:]:
        whole = whole.unionByName(p.select("plan_id", "src", "dst"))
    return whole.distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from nodes that their plan doesn't have."""
    return edges.join(nodes.select("plan_id", F.col("node_id").alias("src")), ["plan_id", "src"], "left_anti")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("plan_id", "node_id").agg(F.count("*").alias("n")).where("n > 1")


def hydrate(tools: DataFrame, scoped: DataFrame, everywhere: DataFrame, names: list[str]) -> DataFrame:
    """tools with null columns of `names` filled from the row of (adapter, tool), or if there is none of tool."""
    a = scoped.select("adapter", "tool", F.lit(True).alias("_hit"), *[F.col(n).alias(f"_s_{n}") for n in names])
    b = everywhere.select("tool", *[F.col(n).alias(f"_e_{n}") for n in names])
    filled = [F.coalesce(n, F.when(F.col("_hit"), F.col(f"_s_{n}")).otherwise(F.col(f"_e_{n}"))).alias(n) for n in names]
    rest = [c for c in tools.columns if c not in names]
    return tools.join(a, ["adapter", "tool"], "left").join(b, "tool", "left").select(*rest, *filled)


def survivors(nodes: DataFrame, key: list[str], eligible: str = "true") -> DataFrame:
    """(plan_id, node_id, canonical): a node stands for itself, or for it the first node of equal key in list order."""
    w = Window.partitionBy("plan_id", *key).orderBy("pos")
    return nodes.select("plan_id", "node_id", F.when(F.expr(eligible), F.first("node_id").over(w)).otherwise(F.col("node_id")).alias("canonical"))


def rewrite_edges(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """Edges with removed ends replaced by what stands for them; edges of removed nodes go."""
    kept = alias.where("node_id = canonical").select("plan_id", F.col("node_id").alias("dst"))
    to = alias.select("plan_id", F.col("node_id").alias("src"), "canonical")
    out = edges.join(kept, ["plan_id", "dst"], "left_semi").join(to, ["plan_id", "src"], "left")
    return out.select("plan_id", F.coalesce("canonical", "src").alias("src"), "dst").distinct()


#: Tables that a growing result may consist of before they are written as one.
PARTS = 16


def reach(seeds: DataFrame, edges: DataFrame, settle: Callable[[DataFrame], DataFrame], rounds: int = 10_000) -> DataFrame:
    """(plan_id, node): seeds and all that edges (plan_id, a, b) lead to from them. Each round joins the newest nodes
    alone and writes what it adds; settle() cuts lineage."""
    found = fresh = settle(seeds.select("plan_id", "node").distinct())
    edges = settle(edges.select("plan_id", F.col("a").alias("node"), "b").distinct())
    for k in range(1, rounds + 1):
        step = fresh.join(edges, ["plan_id", "node"]).select("plan_id", F.col("b").alias("node")).distinct()
        fresh = settle(step.join(found, ["plan_id", "node"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = found.union(fresh) if k % PARTS else settle(found.union(fresh))
    raise RuntimeError("reachability didn't settle")


def live_nodes(nodes: DataFrame, edges: DataFrame, outputs: DataFrame, settle: Callable) -> DataFrame:
    """Nodes that outputs or effects need: backwards from output nodes and nodes that aren't pure; all nodes of plans
    without outputs. nodes: plan_id, node_id, pure."""
    with_outputs = outputs.select("plan_id").distinct()
    roots = outputs.select("plan_id", "node").union(nodes.where("not pure").select("plan_id", "node_id"))
    free = nodes.join(with_outputs, "plan_id", "left_anti").select("plan_id", "node_id")
    return reach(roots.union(free), edges.select("plan_id", F.col("dst").alias("a"), F.col("src").alias("b")), settle)


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, node_id, layer) by the greedy rule of one plan; layer -1 in plans with a cycle.

    nodes: plan_id, node_id, tool, pure, commutative, reads, writes. Plans are packed into rows by the JVM, so Python sees
    whole plans, many to a batch."""
    packed = edges.groupBy("plan_id", "dst").agg(F.collect_set("src").alias("deps")).withColumnRenamed("dst", "node_id")
    fields = ["node_id", "tool", "pure", "commutative", "reads", "writes", "deps"]
    plans = nodes.join(packed, ["plan_id", "node_id"], "left").groupBy("plan_id").agg(F.collect_list(F.struct(*fields)).alias("nodes"))
    kinds = {c: nodes.schema[c].dataType for c in ("plan_id", "node_id")}
    arrow = {c: to_arrow_type(k) for c, k in kinds.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for plan, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(plan, n, k) for n, k in _placed(own)]
            plan, node, layer = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(plan, arrow["plan_id"]), pa.array(node, arrow["node_id"]), pa.array(layer, pa.int32())], names=["plan_id", "node_id", "layer"])

    return plans.mapInArrow(run, f"plan_id {kinds['plan_id'].simpleString()}, node_id {kinds['node_id'].simpleString()}, layer int")


def _placed(own: list[dict]) -> Iterator[tuple]:
    deps = {n["node_id"]: set(n["deps"] or ()) for n in own}
    effects = {}
    for n in own:
        e = Effects(pure=n["pure"], reads=tuple(n["reads"]), writes=tuple(n["writes"]), commutative=n["commutative"])
        effects[n["node_id"]] = NodeEffects(n["tool"], e.declared, e)
    try:
        yield from ((n, k) for k, layer in enumerate(layered(deps, effects)) for n in layer)
    except PlanError:
        yield from ((n, -1) for n in deps)


def batch_groups(nodes: DataFrame) -> DataFrame:
    """nodes (plan_id, layer, tool, node_id, batch_size null: unlimited) with chunk and size; chunks of one are left out."""
    w = Window.partitionBy("plan_id", "layer", "tool")
    at = F.row_number().over(w.orderBy("node_id")) - 1
    chunk = F.floor(at / F.coalesce("batch_size", F.count("*").over(w))).cast("bigint")
    out = nodes.withColumn("chunk", chunk)
    size = F.count("*").over(Window.partitionBy("plan_id", "layer", "tool", "chunk"))
    return out.withColumn("size", size).where("size > 1")


def conflicts(touches: DataFrame, layer_of: DataFrame, ordered: DataFrame) -> DataFrame:
    """(plan_id, resource, node): nodes that a resource keeps from running side by side.

    touches: plan_id, node, resource, is_write. ordered: plan_id, a, b for nodes with a path between them, either way.
    A writer is kept from the touchers of its resource, a reader from its writers, that are in other layers without a path
    between them. They are counted, not paired: all in other layers, less those that a path orders."""
    t = touches.groupBy("plan_id", "resource", "node").agg(F.max("is_write").alias("is_write")).join(layer_of, ["plan_id", "node"])
    by_layer = t.groupBy("plan_id", "resource", "layer").agg(F.count("*").alias("here"), F.count_if("is_write").alias("writers_here"))
    totals = by_layer.groupBy("plan_id", "resource").agg(F.sum("here").alias("touchers"), F.sum("writers_here").alias("writers")).where("writers > 0 and touchers > 1")
    ends = ordered.select("plan_id", F.col("a").alias("node"), "b").distinct()
    other = t.select("plan_id", "resource", F.col("node").alias("b"), F.col("is_write").alias("b_writes"))
    known = t.select("plan_id", "resource", "node").join(ends, ["plan_id", "node"]).join(other, ["plan_id", "resource", "b"])
    known = known.groupBy("plan_id", "resource", "node").agg(F.count("*").alias("placed"), F.count_if("b_writes").alias("placed_writers"))
    all_of = t.join(totals, ["plan_id", "resource"]).join(by_layer, ["plan_id", "resource", "layer"]).join(known, ["plan_id", "resource", "node"], "left").na.fill(0, ["placed", "placed_writers"])
    free = F.when(F.col("is_write"), F.expr("touchers - here - placed")).otherwise(F.expr("writers - writers_here - placed_writers"))
    return all_of.where(free > 0).select("plan_id", "resource", "node")


def closure(edges: DataFrame, settle: Callable, rounds: int = 40) -> DataFrame:
    """(plan_id, src, dst) for every path, by joining the newest paths with all, before and behind: rounds grow as the
    logarithm of the longest path, and each writes what it adds."""
    paths = fresh = settle(edges.select("plan_id", "src", "dst").distinct())
    for _ in range(rounds):
        behind = fresh.select("plan_id", "src", F.col("dst").alias("mid")).join(paths.select("plan_id", F.col("src").alias("mid"), "dst"), ["plan_id", "mid"])
        before = paths.select("plan_id", "src", F.col("dst").alias("mid")).join(fresh.select("plan_id", F.col("src").alias("mid"), "dst"), ["plan_id", "mid"])
        more = behind.union(before).select("plan_id", "src", "dst").distinct()
        fresh = settle(more.join(paths, ["plan_id", "src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return paths
        paths = paths.union(fresh)
    raise RuntimeError("the closure didn't settle")


def cost_summary(nodes: DataFrame) -> DataFrame:
    """(plan_id, serial_ms, compiled_ms, tokens). nodes: plan_id, layer, fixed_ms, per_call_ms, tokens, batch (calls in
    its batch, 1 outside)."""
    cost = lambda n: F.coalesce("fixed_ms", F.lit(0)) + F.coalesce("per_call_ms", F.lit(0)) * n
    by_layer = nodes.groupBy("plan_id", "layer").agg(F.sum(cost(F.lit(1))).alias("s"), F.max(cost(F.col("batch"))).alias("c"), F.sum(F.coalesce("tokens", F.lit(0))).alias("t"))
    return by_layer.groupBy("plan_id").agg(F.sum("s").alias("serial_ms"), F.sum("c").alias("compiled_ms"), F.sum("t").alias("tokens"))


def transitive_skip(dead: DataFrame, data_edges: DataFrame, settle: Callable) -> DataFrame:
    """(plan_id, node): what depends by data on dead nodes, these left out."""
    out = reach(dead, data_edges.select("plan_id", F.col("src").alias("a"), F.col("dst").alias("b")), settle)
    return out.join(dead, ["plan_id", "node"], "left_anti")
