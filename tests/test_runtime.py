from __future__ import annotations

import io
import json
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from sparkloom.cli import bench, execute
from sparkloom.config import bound
from sparkloom.plans.compiler import Capability
from sparkloom.plans.frontends import PlanBuilder, ref
from sparkloom.plans.ir import Effects, Limits, PlanError, Retry, Tool
from sparkloom.plans.policy import CallPolicy, LockTable, MemoryCache
from sparkloom.plans.result import KeyRedactor
from sparkloom.plans.runtime import RunConfig, Runtime
from sparkloom.plans.schema import check_schema
from sparkloom.server import answer, serve
from sparkloom.sources.base import Local, ToolError, conformance
from sparkloom.sources.files import Files, text_within
from sparkloom.sources.http import Http
from sparkloom.sources.mcp import McpHttp, McpStdio, capability, normalize
from sparkloom.sources.shell import Shell


class Counting:
    """Counts calls and the most that ran at once."""

    def __init__(self, sleep=0.0, fails=0, error=None, batches=False):
        self.calls, self.now, self.most, self.lock = [], 0, 0, threading.Lock()
        self.sleep, self.fails, self.error, self.sizes = sleep, fails, error or ToolError("flaky", "again"), []
        if batches:
            self.call_batch = self._batch

    def call(self, tool, x):
        with self.lock:
            self.calls.append((tool, x))
            self.now += 1
            self.most = max(self.most, self.now)
            failing = len(self.calls) <= self.fails
        time.sleep(self.sleep)
        with self.lock:
            self.now -= 1
        if failing or tool == "bad":
            raise self.error
        if tool == "panic":
            raise RuntimeError("boom")
        return {"tool": tool, "in": x}

    def _batch(self, tool, inputs):
        self.sizes.append(len(inputs))
        return [(k, {"in": x}) for k, x in inputs if x != "lost"]


def builder(**tools):
    b = PlanBuilder()
    for name, effects in tools.items():
        b.tool(name, "x", **effects)
    return b


PURE = {"pure": True, "cacheable": True}


def run(b, executor, **config):
    return Runtime({"x": executor}).run(b.build(), RunConfig(**config))


def test_partial_results_and_modes():
    b = builder(ok=PURE, bad={"reads": ["r"]}, then=PURE)
    b.node("a", "ok", 1).node("b", "bad").node("c", "then", ref("b")).node("d", "ok", 2, after=["b"]).output("a", "a.output").output("c", "c.output")
    r = run(b, Counting())
    assert r.status == "failed" and r.errors["b"]["code"] == "again" and r.skipped["c"] == "failed_dependency" and r.skipped["d"] == "not_run" if "d" in r.skipped else True
    b.output("d", "d.output")
    r = run(b, Counting(), on_error="continue")
    assert r.outputs["d"]["in"] == 2 and r.skipped == {"c": "failed_dependency"} and r.metrics.nodes_succeeded == 2
    compact = run(b, Counting(), mode="compact")
    assert compact.node_outputs == {} and compact.trace == [] and compact.optimization is None


def test_gates():
    b = builder(ok=PURE)
    b.node("a", "ok", {"v": False}).node("g", "ok", 1, when="a.output.in.v").node("n", "ok", 2, when="a.output.in.v", negate=True)
    b.node("e", "ok", 3, when="a.output.in", equals={"v": False}).node("c", "ok", ref("g")).node("o", "ok", 4, after=["g"])
    for k in "agneco":
        b.output(k, f"{k}.output")
    r = run(b, Counting())
    assert r.status == "success" and r.skipped == {"g": "condition", "c": "failed_dependency"} and set(r.outputs) == {"a", "n", "e", "o"}


def test_missing_paths_and_outputs():
    b = builder(ok=PURE).node("a", "ok", 1).node("b", "ok", ref("a", "nope")).output("x", "a.output.zip").output("b", "b.output")
    r = run(b, Counting(), on_error="continue")
    assert r.errors["b"]["code"] == "missing_path" and r.errors["outputs.x"]["code"] == "unresolved_output" and "outputs.b" not in r.errors


def test_fan_out_batches_and_errors():
    b = builder(ok=PURE, each={"pure": True, "batchable": True})
    b.plan.tools["each"] = Tool("x", Effects(pure=True, batchable=True), Limits(batch_size=2))
    b.node("l", "ok", {"items": [{"p": 1}, {"p": 2}, {"p": 1}, {"p": 3}]}).node("f", "each", {"v": {"$item": "p"}}, for_each="l.output.in.items").output("f", "f.output")
    e = Counting(batches=True)
    r = run(b, e)
    assert [x["in"]["v"] for x in r.outputs["f"]] == [1, 2, 1, 3] and e.sizes == [2, 1]
    b = builder(ok=PURE, bad=PURE).node("l", "ok", 42).node("f", "ok", {"$item": ""}, for_each="l.output.in").output("f", "f.output")
    assert run(b, Counting()).errors["f"]["code"] == "invalid_for_each"
    b = builder(ok=PURE, bad=PURE).node("l", "ok", [1]).node("f", "bad", {"$item": ""}, for_each="l.output.in").output("f", "f.output")
    assert run(b, Counting()).errors["f"] == {"message": "item 0: flaky", "code": "again", "retryable": None}
    b = builder(ok=PURE).node("l", "ok", [{}]).node("f", "ok", {"$item": "q"}, for_each="l.output.in").output("f", "f.output")
    assert run(b, Counting()).errors["f"]["code"] == "invalid_item"
    b = builder(ok=PURE).node("l", "ok", []).node("f", "ok", {"$item": ""}, for_each="l.output.in").output("f", "f.output")
    assert run(b, Counting()).outputs["f"] == []


def test_batches_lose_no_member():
    b = builder(t={"pure": True, "batchable": True}).node("a", "t", 1).node("b", "t", "lost").output("a", "a.output").output("b", "b.output")
    r = run(b, Counting(batches=True), on_error="continue")
    assert r.outputs["a"] == {"in": 1} and r.errors["b"]["code"] == "batch_missing_output" and r.metrics.batch_dispatches == 1


def test_limits_and_locks():
    b = builder(t={"reads": ["r"]}, w={"writes": ["r"]})
    b.plan.tools["t"] = Tool("x", Effects(reads=("r",)), Limits(max_concurrency=2))
    for k in range(6):
        b.node(f"n{k}", "t", k)
    e = Counting(0.03)
    run(b, e)
    assert e.most == 2
    e = Counting(0.02)
    run(builder(w={"writes": ["r"]}).node("a", "w", 1).node("b", "w", 2).node("c", "w", 3), e)
    assert e.most == 1
    e = Counting(0.02)
    run(builder(w={"writes": ["r"], "reads": ["r"]}).node("a", "w", 1).node("b", "w", 2), e)
    assert e.most == 1
    e = Counting(0.03)
    run(builder(w={"writes": ["r"], "commutative": True}).node("a", "w", 1).node("b", "w", 2), e)
    assert e.most == 2
    e = Counting(0.02)
    run(builder(u={}).node("a", "u", 1).node("b", "u", 2), e, concurrency=8)
    assert e.most == 1
    e = Counting(0.02)
    run(builder(t=PURE).node("a", "t", 1).node("b", "t", 2).node("c", "t", 3), e, concurrency=1)
    assert e.most == 1


def test_cache_follows_writes():
    b = builder(r={"reads": ["x"], "cacheable": True}, w={"writes": ["x"]}).node("a", "r").node("w", "w", 1, after=["a"]).node("b", "r", after=["w"]).node("c", "r", after=["b"])
    e = Counting()
    r = run(b, e)
    assert [t for t, _ in e.calls] == ["r", "w", "r"] and r.metrics.cache_hits == 1
    assert [t.status for t in r.trace if t.node == "c"] == ["cache_hit"]
    e, runtime = Counting(), None
    runtime = Runtime({"x": e})
    failing = builder(r={"reads": ["x"], "cacheable": True}, bad={"writes": ["x"]}).node("a", "r").node("w", "bad", 1, after=["a"])
    runtime.run(failing.build())
    runtime.run(builder(r={"reads": ["x"], "cacheable": True}).node("a", "r").build())
    assert [t for t, _ in e.calls] == ["r", "bad", "r"]


def test_single_flight_across_runs():
    e = Counting(0.05)
    runtime = Runtime({"x": e})
    p = builder(t=PURE).node("a", "t", 1).build()
    threads = [threading.Thread(target=runtime.run, args=(p,)) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(e.calls) == 1


def test_retry_only_where_safe():
    retry = {"retry": {"max_attempts": 3, "backoff_ms": 1}}
    e = Counting(fails=2)
    r = run(builder(t={"reads": ["r"], "idempotent": True, **retry}).node("a", "t"), e)
    assert r.status == "success" and r.metrics.retries == 2 and [t.attempt for t in r.trace if t.status == "retried"] == [1, 2]
    e = Counting(fails=2)
    assert run(builder(t={"writes": ["r"], **retry}).node("a", "t"), e).status == "failed" and len(e.calls) == 1
    e = Counting(fails=2, error=ToolError("x", "no", False))
    assert run(builder(t={"pure": True, **retry}).node("a", "t"), e).status == "failed" and len(e.calls) == 1
    p = CallPolicy.of(Effects(pure=True, retry=Retry(5, ("slow",), 100)), None)
    assert p.again(ToolError("too slow")) and p.again(ToolError("x", "slow")) and not p.again(ToolError("x"))
    assert p.wait_ms(1, lambda: 0) == 100 and p.wait_ms(4, lambda: 0) == 800 and p.wait_ms(40, lambda: 1) == 5000


def test_timeouts_panics_blocks_and_schemas():
    r = run(builder(t={"pure": True, "timeout_ms": 20}).node("a", "t"), Counting(0.2))
    assert r.errors["a"]["code"] == "timeout"
    assert run(builder(t={"pure": True}).node("a", "t"), Counting(0.2), timeout_ms=20).errors["a"]["code"] == "timeout"
    r = run(builder(panic=PURE).node("a", "panic"), Counting())
    assert r.errors["a"]["code"] == "panic" and r.errors["a"]["retryable"] is False
    runtime = Runtime({"x": Counting()})
    runtime.block("t")
    assert runtime.run(builder(t=PURE).node("a", "t").build()).errors["a"]["code"] == "blocked_tool"
    runtime = Runtime({"x": Counting()})
    runtime.describe("t", Capability(input_schema={"type": "object", "required": ["p"], "properties": {"p": {"type": "string"}}}), "x")
    assert runtime.run(builder(t=PURE).node("a", "t", {"p": 1}).build()).errors["a"]["code"] == "invalid_input"
    assert runtime.run(builder(t=PURE).node("a", "t", {"p": "s"}).build()).status == "success"
    with pytest.raises(PlanError):
        Runtime().run(builder(t=PURE).node("a", "t").build())


def test_cancel():
    cancel = threading.Event()
    cancel.set()
    e = Counting()
    r = run(builder(t=PURE).node("a", "t"), e, cancel=cancel)
    assert r.status == "cancelled" and r.skipped == {"a": "cancelled"} and not e.calls


def test_shaping():
    b = builder(t=PURE).node("a", "t", {"Api_Key_2": "s", "list": [{"max_tokens": 3}], "text": "x" * 4096}).output("a", "a.output.in")
    r = run(b, Counting(), redactor=KeyRedactor(), max_output_bytes=256)
    assert r.outputs["a"]["$truncated"] and r.outputs["a"]["bytes"] > 4096 and len(r.outputs["a"]["preview"]) == 256 and '"[redacted]"' in r.outputs["a"]["preview"]
    assert KeyRedactor()({"Api_Key_2": "s", "list": [{"max_tokens": 3, "n": 1}]}) == {"Api_Key_2": "[redacted]", "list": [{"max_tokens": "[redacted]", "n": 1}]}


def test_wide_plans_run():
    b = builder(t={"pure": True})
    for k in range(1000):
        b.node(f"n{k}", "t", k).output(f"n{k}", f"n{k}.output")
    assert run(b, Counting()).metrics.nodes_succeeded == 1000


def test_builtin_tools():
    b = PlanBuilder()
    for t in ("pick", "merge", "template", "collect"):
        b.tool(t, "builtin", pure=True)
    b.node("m", "merge", {"objects": [{"a": 1, "b": {"c": [5]}}, {"a": 2}]}).node("p", "pick", {"value": ref("m"), "path": "b..c.0"}).node("t", "template", {"template": "v{p}", "values": {"p": ref("p")}}).node("c", "collect", [ref("t"), ref("p")])
    r = Runtime().run(b.output("c", "c.output").output("m", "m.output").build())
    assert r.outputs == {"c": ["v5", 5], "m": {"a": 2, "b": {"c": [5]}}}
    bad = Runtime().run(PlanBuilder().tool("template", "builtin", pure=True).node("t", "template", {"template": "{x}", "values": {}}).build())
    assert bad.errors["t"]["code"] == "invalid_input"


def test_locks_and_cache():
    t = LockTable()
    t.take(1, "r", Effects(reads=("x",)))
    assert t.fits("r", Effects(reads=("x",))) and not t.fits("w", Effects(writes=("x",))) and not t.fits("u", Effects())
    now = [0.0]
    c = MemoryCache(2, 1000, lambda: now[0])
    c.put("a", 1, ["x"])
    c.put("b", 2, ["y"])
    assert c.get("a") == (True, 1)
    c.put("c", 3, [])
    assert c.get("b") == (False, None)
    now[0] = 0.9
    assert c.get("a")[0]
    now[0] = 1.1
    assert not c.get("a")[0]
    c.put("d", 4, ["z"])
    c.drop_reads(["z"])
    assert not c.get("d")[0]


def test_schema_check():
    s = json.dumps({"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}, "l": {"type": "array", "items": {"enum": [1, 2]}, "maxItems": 2}}, "additionalProperties": False})
    assert check_schema(s, {"n": 1, "l": [1, 2]}) is None and check_schema(s, {"n": 1.0}) is None
    for bad in ({"n": 0}, {"n": True}, {"n": 1.5}, {"l": [3]}, {"l": [1, 1, 1]}, {"z": 1}, []):
        assert check_schema(s, bad)


# --- executors --------------------------------------------------------------------------------------------------


def test_files(tmp_path):
    f = Files(tmp_path, read_cap=4)
    f.call("write_file", {"path": "d/a.txt", "content": "aéb€"})
    assert f.call("read_file", {"path": "d/a.txt"}) == {"content": "aéb", "truncated": True, "bytes": 7}
    assert f.call("read_file", {"path": "d/a.txt", "max_bytes": 99}) == {"content": "aéb€"}
    assert text_within("é".encode(), 1) == ""
    f.call("write_files", {"files": [{"path": "b.md", "content": "1"}, {"path": "c.txt", "content": "2"}]})
    assert [e["name"] for e in f.call("list_dir", {"recursive": True})["entries"]] == ["b.md", "c.txt", "d", "d/a.txt"]
    assert f.call("list_dir", {"recursive": True, "glob": "**/*.txt"})["entries"] == [{"name": "c.txt", "kind": "file"}, {"name": "d/a.txt", "kind": "file"}]
    assert Files(tmp_path, entry_cap=1).call("list_dir", {}) == {"entries": [{"name": "b.md", "kind": "file"}], "truncated": True}
    with pytest.raises(ToolError) as e:
        f.call("write_files", {"files": [{"path": "b.md", "content": "new"}, {"path": "b.md/x", "content": "2"}]})
    assert e.value.code == "write_rollback" and (tmp_path / "b.md").read_text() == "1"
    (tmp_path / "out").symlink_to("/etc")
    for raw in ("/etc/passwd", "../x", "out/passwd"):
        with pytest.raises(ToolError) as e:
            f.call("read_file", {"path": raw})
        assert e.value.code == "escapes_root"
    assert dict(f.call_batch("read_file", [(1, {"path": "b.md"}), (2, {"path": "c.txt"})])) == {1: {"content": "1"}, 2: {"content": "2"}}


def test_http():
    class Client:
        def request(self, method, url, headers, body):
            self.got = (method, url, dict(headers), body)
            return 201, {"Content-Type": "application/json"}, b'{"ok":1}'

    c = Client()
    h = Http(c, "https://h/v1/", {"X-A": "1"})
    assert h.call("request", {"method": "post", "url": "/p", "headers": {"x-a": "2"}, "body": {"k": 1}}) == {"status": 201, "ok": True, "headers": {"content-type": "application/json"}, "body": {"ok": 1}}
    assert c.got == ("POST", "https://h/v1/p", {"x-a": "2", "content-type": "application/json"}, b'{"k": 1}')
    with pytest.raises(ToolError):
        h.call("request", {"url": "/p", "headers": {"a": 1}})


def test_shell(tmp_path):
    s = Shell(tmp_path, cap=5)
    got = s.call("run", {"program": sys.executable, "args": ["-c", "import sys; print('x' * 9); print(sys.stdin.read(), file=sys.stderr)"], "stdin": "in"})
    assert got == {"status": 0, "success": True, "stdout": "xxxxx", "stdout_truncated": True, "stderr": "in\n"}
    with pytest.raises(ToolError) as e:
        s.call("run", {"program": sys.executable, "args": ["-c", "import time; time.sleep(5)"], "timeout_ms": 50})
    assert e.value.code == "timeout"
    with pytest.raises(ToolError):
        s.call("run", {"program": "no-such-program-here"})


SERVER = """
import json, sys
for line in sys.stdin:
    m = json.loads(line)
    if "id" not in m:
        continue
    r = {"jsonrpc": "2.0", "id": m["id"]}
    p = m.get("params") or {}
    if m["method"] == "initialize":
        r["result"] = {"protocolVersion": "2025-06-18"}
    elif m["method"] == "tools/list":
        r["result"] = {"tools": [{"name": "b" if p.get("cursor") else "a", "annotations": {"readOnlyHint": True, "idempotentHint": True}}]} | ({} if p.get("cursor") else {"nextCursor": "2"})
    elif p["name"] == "die":
        sys.exit(1)
    elif p["name"] == "bad":
        r["result"] = {"isError": True, "content": [{"type": "text", "text": "no"}, {"type": "text", "text": "way"}]}
    else:
        r["result"] = {"structuredContent": p["arguments"]}
    print(json.dumps(r), flush=True)
"""


def test_mcp(tmp_path):
    path = tmp_path / "server.py"
    path.write_text(SERVER)
    m = McpStdio("shop", [sys.executable, str(path)], timeout_s=20)
    assert m.call_batch("echo", [("x", {"a": 1}), ("y", {"b": 2})]) == [("x", {"a": 1}), ("y", {"b": 2})]
    assert set(m.tools()) == {"a", "b"} and m.tools()["a"].effects == Effects(reads=("mcp:shop",), idempotent=True, cacheable=True)
    with pytest.raises(ToolError) as e:
        m.call("bad", {})
    assert e.value.message == "no\nway" and e.value.code == "mcp_tool_error"
    with pytest.raises(ToolError) as e:
        m.call("die", {})
    assert e.value.code == "mcp_transport"
    assert m.call("echo", {"again": 1}) == {"again": 1}
    m.close()
    assert capability("s", {}).effects.writes == ("mcp:s",) and normalize({"x": 1}) == {"x": 1}
    with pytest.raises(ToolError):
        McpStdio("none", ["/no/such/program"]).call("x", {})


SLOW = """
import json, os, sys, time
ready = False
for line in sys.stdin:
    m = json.loads(line)
    if m["method"] == "initialize":
        time.sleep(0.3)
        if "--refuse" in sys.argv:
            print(json.dumps({"id": m["id"], "result": {}}), flush=True)
            continue
        ready = True
        print(json.dumps({"id": m["id"], "result": {"protocolVersion": "2025-06-18"}}), flush=True)
    elif "id" in m:
        print(json.dumps({"id": m["id"], "result": {"structuredContent": {"ready": ready, "pid": os.getpid(), "depth": os.environ["SPARKLOOM_DEPTH"]}}}), flush=True)
"""


def test_mcp_calls_wait_for_the_greeting(tmp_path, monkeypatch):
    path = tmp_path / "slow.py"
    path.write_text(SLOW)
    monkeypatch.setenv("SPARKLOOM_DEPTH", "1")
    m = McpStdio("slow", [sys.executable, str(path)], timeout_s=20)
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: m.call("x", {}), range(8)))
    assert all(g["ready"] and g["depth"] == "2" for g in got) and len({g["pid"] for g in got}) == 1
    m.close()
    m = McpStdio("rude", [sys.executable, str(path), "--refuse"], timeout_s=20)
    for _ in range(2):  # a failed greeting isn't skipped by the next call
        with pytest.raises(ToolError, match="protocol version"):
            m.call("x", {})
    assert m.session is None


def test_mcp_over_http():
    class Client:
        def request(self, method, url, headers, body):
            m = json.loads(body)
            if m["method"] == "initialize":
                return 200, {"Content-Type": "application/json", "Mcp-Session-Id": "s1"}, json.dumps({"id": m["id"], "result": {"protocolVersion": "2025-06-18"}}).encode()
            assert headers["mcp-session-id"] == "s1"
            if "id" not in m:
                return 202, {}, b""
            events = [{"id": -1}, {"id": m["id"], "result": {"structuredContent": m["params"]["arguments"]}}]
            return 200, {"Content-Type": "text/event-stream"}, "".join(f"event: message\ndata: {json.dumps(e)}\n\n" for e in events).encode()

    assert McpHttp("s", "http://h/mcp", Client()).call("echo", {"a": 1}) == {"a": 1}


def test_conformance_and_config(tmp_path):
    assert all(c.passed for c in conformance(Local(), "echo", {"a": 1}, {"a": 1}, "fail"))
    assert not all(c.passed for c in conformance(Local(), "const", {"a": 1}, {"a": 1}))
    r = bound({"fs": [{"adapter": "fs", "root": str(tmp_path)}], "shell": [{"adapter": "sh", "env": {"A": "1"}, "inherit": ["PATH"], "default_timeout_ms": 9}], "http": [{"adapter": "h", "base_url": "https://x"}], "capabilities": [{"tool": "t", "adapter": "fs", "effects": {"pure": True}}]})
    assert set(r.executors) == {"builtin", "local", "fs", "sh", "h"} and r.capability("fs", "t").effects.pure
    assert r.executors["sh"].env["A"] == "1" and set(r.executors["sh"].env) <= {"A", "PATH"}
    with pytest.raises(PlanError):
        bound({"ftp": []})


# --- command line and server ------------------------------------------------------------------------------------

PLAN = {
    "version": "0", "tools": {"const": {"adapter": "local", "effects": {"pure": True, "cacheable": True, "batchable": True}}, "echo": {"adapter": "local", "effects": {"pure": True}}},
    "nodes": [{"id": "a", "tool": "const", "input": {"value": {"id": 7}, "sleep_ms": 20}}, {"id": "b", "tool": "const", "input": {"value": 1, "sleep_ms": 20}}, {"id": "c", "tool": "echo", "input": {"u": {"$ref": "a.output.id"}}}],
    "outputs": {"a": "a.output", "b": "b.output", "c": "c.output"},
}


def test_commands(tmp_path, capsys):
    path = tmp_path / "plan.json"
    path.write_text(json.dumps(PLAN))
    told = lambda *argv: (execute(list(argv)), json.loads(capsys.readouterr().out))
    assert told("validate", str(path))[1] == {"valid": True, "nodes": 3, "layers": 2}
    assert told("layers", str(path))[1] == [["a", "b"], ["c"]]
    assert told("optimize", str(path))[1]["report"]["batch_groups"] == [{"layer": 0, "tool": "const", "nodes": ["a", "b"]}]
    assert told("explain", str(path))[1]["diagnostics"] == []
    code, got = told("run", str(path), "--result-mode", "compact")
    assert code == 0 and got["outputs"] == {"a": {"id": 7}, "b": 1, "c": {"u": 7}}
    (tmp_path / "calls.json").write_text(json.dumps([{"tool": "x", "input": 1}] * 3))
    assert told("suggest", str(tmp_path / "calls.json"))[1]["suggestions"][0]["occurrences"] == 3
    (tmp_path / "r.json").write_text(json.dumps({"version": "0", "params": {"v": None}, "tools": {"echo": {"adapter": "local"}}, "recipe": {"kind": "fan_out", "tool": "echo", "items": [{"$param": "v"}]}, "outputs": {"o": "item_1.output"}}))
    assert told("run-recipe", str(tmp_path / "r.json"), "--param", 'v={"k":1}')[1]["outputs"] == {"o": {"k": 1}}
    assert told("compile-recipe", str(tmp_path / "r.json"), "--param", "v=5")[1]["nodes"] == [{"id": "item_1", "tool": "echo", "input": 5}]
    assert told("conformance", "local", "--failing-tool", "fail")[1]["passed"]
    b = told("bench", str(path), "-i", "1", "--warmup", "0")[1]
    assert b["serial"]["mean_ms"] > b["compiled"]["mean_ms"]
    (tmp_path / "suite.json").write_text(json.dumps({"iterations": 1, "warmup": 0, "cases": [{"id": "p", "plan": json.loads(path.read_text())}]}))
    assert told("bench-suite", str(tmp_path / "suite.json"))[1]["cases"][0]["speedup"] > 0
    assert told("schema", "plan")[1]["required"] == ["version"]


def test_bench_refuses_failing_plans():
    with pytest.raises(PlanError):
        bench(Runtime({"local": Local()}), PlanBuilder().tool("fail", "local", pure=True).node("a", "fail").output("a", "a.output").build(), 1, 0)


def test_server(monkeypatch):
    runtime = Runtime({"local": Local()})
    call = lambda name, **a: answer(runtime, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    assert answer(runtime, {"id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}})["result"]["protocolVersion"] == "2024-11-05"
    assert len(answer(runtime, {"id": 1, "method": "tools/list"})["result"]["tools"]) == 4
    assert call("run_compiled_tool_graph", plan=PLAN)["structuredContent"]["outputs"]["c"] == {"u": 7}
    assert call("explain_tool_plan", plan=PLAN)["structuredContent"]["layers"] == [["a", "b"], ["c"]]
    assert call("run_compiled_tool_graph", plan={})["isError"] and call("nope")["isError"]
    assert answer(runtime, {"id": 1, "method": "x"})["error"]["code"] == -32601 and answer(runtime, {"method": "x"}) is None
    out = io.StringIO()
    serve(runtime, io.StringIO('{"id": 5, "method": "ping"}\nnot json\n\n'), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert got[5]["result"] == {} and got[None]["error"]["code"] == -32700
    monkeypatch.setenv("SPARKLOOM_DEPTH", "2")
    assert call("explain_tool_plan", plan=PLAN)["isError"]
