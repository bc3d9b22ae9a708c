from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import values as V
from sparkloom.operators import calls as C
from sparkloom.operators import graphs as G
from sparkloom.operators.settling import settle
from sparkloom.plans.frontends import PlanBuilder, ref
from sparkloom.plans.ir import Plan
from sparkloom.plans.result import TraceEvent
from sparkloom.plans.runtime import RunConfig, Runtime
from sparkloom.queries.flow_queries import flagship_plan
from sparkloom.sources.tables import Tables, table_tools
from sparkloom.streaming.trace import TraceFolder, trace_stream, windowed_metrics


def test_the_flagship_plan_is_shared_and_pruned(spark, sf):
    r = Runtime({"tables": Tables(spark, sf)}).run(flagship_plan())
    assert r.status == "success" and r.optimization["eliminated"] == ["unused"]
    assert r.optimization["deduplicated"] == [{"removed": "orders_again", "canonical": "orders"}]


def test_table_references_and_errors(spark, sf):
    b = PlanBuilder()
    b.plan = Plan(tools=table_tools())
    b.node("n", "scan", {"path": "nation.parquet"}).node("x", "filter", {"frame": 1, "where": "true"}).output("k", "n.output.n_name").output("x", "x.output")
    r = Runtime({"tables": Tables(spark, sf)}).run(b.build(), RunConfig(on_error="continue", max_output_bytes=10))
    assert r.outputs["k"].columns == ["n_name"] and r.errors["x"]["code"] == "invalid_input"
    bad = PlanBuilder()
    bad.plan = Plan(tools=table_tools())
    bad.node("n", "scan", {"path": "nation.parquet"}).node("r", "reduce", {"frame": ref("n"), "by": [], "aggregates": {"x": ["median?", "n_name"]}})
    assert Runtime({"tables": Tables(spark, sf)}).run(bad.build()).errors["r"]["code"] == "invalid_input"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_paths_tell_null_from_missing(spark):
    df = spark.createDataFrame([('{"a":{"b":null}}',), ('{"a":{}}',), ("no json",), (None,)], "j string")
    assert [tuple(r) for r in df.select(V.pick(F.col("j"), "a.b"), V.has_path(F.col("j"), "a.b")).collect()] == [(None, True), (None, False), (None, False), (None, False)]
    got = df.select(V.redact_json(F.col("j"))).collect()
    assert [r[0] for r in got] == ['{"a":{"b":null}}', '{"a":{}}', None, None]


def test_capped_text(spark):
    df = spark.createDataFrame([("aé€".encode(),), (b"\xff",), (None,)], "b binary")
    assert [r[0] for r in df.select(V.capped_text(F.col("b"), 4)).collect()] == ["aé", "�", None]


def test_layers_and_cycles(spark):
    n = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a"), ("q", "b")], "plan_id string, node_id string")
    n = n.selectExpr("*", "'t' AS tool", "true AS pure", "false AS commutative", "cast(array() AS array<string>) AS reads", "cast(array() AS array<string>) AS writes")
    e = spark.createDataFrame([("p", "a", "b"), ("q", "a", "b"), ("q", "b", "a")], "plan_id string, src string, dst string")
    assert rows(G.layers(n, e)) == [("p", "a", 0), ("p", "b", 1), ("q", "a", -1), ("q", "b", -1)]


def test_reach_and_closure(spark):
    e = spark.createDataFrame([(1, k, k + 1) for k in range(30)], "plan_id int, src int, dst int")
    assert G.closure(e, settle).count() == 30 * 31 // 2
    seeds = spark.createDataFrame([(1, 25)], "plan_id int, node int")
    assert rows(G.transitive_skip(seeds, e, settle)) == [(1, k) for k in range(26, 31)]
    assert G.reach(seeds.where("false"), e.selectExpr("plan_id", "src AS a", "dst AS b"), settle).count() == 0


def test_lru_replay(spark):
    log = [(1, k, key, key, w) for k, (key, w) in enumerate([("a", False), ("b", False), ("a", False), ("c", False), ("b", False), ("b", True), ("b", False)])]
    df = spark.createDataFrame(log, "cache int, ts bigint, key string, resource string, is_write boolean")
    assert [r.hit for r in C.replay_lru(df, 2).orderBy("ts").collect()] == [False, False, True, False, False, False, False]
    assert [r.hit for r in C.replay_lru(df, 9, 1).orderBy("ts").collect()] == [False, False, False, False, False, False, False]


def test_mining_keeps_to_sessions(spark):
    calls = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 3, "a"), (1, 4, "b"), (1, 5, "a")], "session int, seq int, tool string")
    assert rows(C.mine_runs(calls)) == [(1, "a", 0, 2, 1, 2)]


def test_trace_streams(spark, tmp_path):
    sink = TraceFolder(str(tmp_path / "trace"), "p1")
    for k in range(4):
        sink(TraceEvent("a", "t", "finished" if k % 2 else "started", at_ms=1_700_000_000_000 + k, duration_ms=k))
    sink.flush()
    q = windowed_metrics(trace_stream(spark, str(tmp_path / "trace"))).writeStream.format("memory").queryName("trace").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = spark.sql("SELECT tool, started, finished, longest_ms FROM trace").collect()
    finally:
        q.stop()
    assert [tuple(r) for r in got] == [("t", 2, 2, 3)]


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.md", "a.md", True), ("*.md", "d/a.md", False), ("**/*.md", "d/e/a.md", True), ("**/*.md", "a.md", True), ("a?.txt", "ab.txt", True)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(V.glob_like(glob), path)) is hit


def test_replay_follows_a_plain_cache(spark):
    """Against a list of entries that is searched from end to end."""
    rng = random.Random(9)
    log = [(c, ts, f"k{(k := rng.randrange(9))}", k % 3, rng.random() < 0.1) for c in range(2) for ts in range(300)]
    got = {(r.cache, r.ts): r.hit for r in C.replay_lru(spark.createDataFrame(log, "cache int, ts long, key string, resource int, is_write boolean"), 4, 25).collect()}
    for c in range(2):
        held = []  # (key, since, resource), the least recent first
        for _, ts, key, resource, write in sorted(x for x in log if x[0] == c):
            found = next((e for e in held if e[0] == key), None)
            hit = not write and found is not None and ts - found[1] <= 25
            if write:
                held = [e for e in held if e[2] != resource]
            else:
                held = [e for e in held if e[0] != key] + [found if hit else (key, ts, resource)]
                held = held[-4:]
            assert got[c, ts] is hit


def test_conflicts_are_those_of_pairs(spark):
    rng = random.Random(4)
    layer = {n: rng.randrange(4) for n in range(12)}
    touches = [(1, n, r, rng.random() < 0.4) for n in layer for r in "ab" if rng.random() < 0.8] * 2
    ordered = {(a, b) for a in layer for b in layer if layer[a] != layer[b] and rng.random() < 0.4}
    ordered |= {(b, a) for a, b in ordered}
    writes = {}
    for _, n, r, w in touches:
        writes[n, r] = writes.get((n, r), False) or w
    want = {(r, n) for (n, r), w in writes.items() for (m, q), v in writes.items() if q == r and m != n and (w or v) and layer[n] != layer[m] and (n, m) not in ordered}
    got = G.conflicts(
        spark.createDataFrame(touches, "plan_id int, node int, resource string, is_write boolean"),
        spark.createDataFrame([(1, n, k) for n, k in layer.items()], "plan_id int, node int, layer int"),
        spark.createDataFrame([(1, a, b) for a, b in sorted(ordered)], "plan_id int, a int, b int"),
    )
    assert sorted((r.resource, r.node) for r in got.collect()) == sorted(want)
