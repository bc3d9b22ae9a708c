"""python -m sparkloom COMMAND: plans, intents and recipes from JSON files (- for standard input)."""

from __future__ import annotations

import argparse
import json
import statistics
import sys
import time
from dataclasses import asdict, replace
from pathlib import Path
from typing import Any

from sparkloom.config import configured
from sparkloom.plans.compiler import explain, optimize, validate
from sparkloom.plans.frontends import compile_intent, compile_recipe, parse_params
from sparkloom.plans.ir import Plan, PlanError, ValueRef, dump, members, parse_plan
from sparkloom.plans.mining import suggest
from sparkloom.plans.result import KeyRedactor
from sparkloom.plans.runtime import RunConfig, Runtime
from sparkloom.plans.schema import DOCUMENTS
from sparkloom.sources.base import conformance


def read_json(path: str) -> Any:
    return json.loads(sys.stdin.read() if path == "-" else Path(path).read_text())


def show(value: Any) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False, default=str))


def bench(runtime: Runtime, plan: Plan, iterations: int = 3, warmup: int = 1) -> dict:
    """Serial without a cache against compiled, in turns, with the cache cleared before each run."""
    prepared = runtime.prepare(plan)
    sides = {"serial": lambda: runtime.run_serial(plan), "compiled": lambda: runtime.run(prepared)}
    took: dict[str, list[float]] = {k: [] for k in sides}
    for k in range(warmup + iterations):
        for name, run in sides.items():
            runtime.cache.clear()
            began = time.perf_counter()
            if (result := run()).status != "success":
                raise PlanError("bench_failed", f"the {name} run ended as {result.status}: {result.errors}")
            if k >= warmup:
                took[name].append((time.perf_counter() - began) * 1000)
    stats = {k: {"mean_ms": statistics.fmean(v), "min_ms": min(v), "max_ms": max(v), "stddev_ms": statistics.pstdev(v)} for k, v in took.items()}
    a, b = stats["serial"]["mean_ms"], stats["compiled"]["mean_ms"]
    return stats | {"speedup": a / b if b else None, "saved_ms": a - b}


def bench_suite(runtime: Runtime, suite: Any) -> list[dict]:
    """bench() of each case of a suite: iterations, warmup, and cases of id and plan, intent, or recipe with params. A plan's
    nodes all count as outputs, so that elimination doesn't pass for speed; recipes and intents likewise."""
    d = members(suite, "suite", ("cases",), ("iterations", "warmup"))
    found = []
    for raw in d["cases"]:
        c = members(raw, "case", ("id",), ("plan", "intent", "recipe", "params"))
        plan = parse_plan(c["plan"]) if "plan" in c else compile_intent(c["intent"]) if "intent" in c else compile_recipe(c.get("recipe"), c.get("params"))
        plan = replace(plan, outputs={n.id: ValueRef(n.id) for n in plan.nodes})
        found.append({"id": c["id"]} | bench(runtime, plan, d.get("iterations", 3), d.get("warmup", 1)))
    return found


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *files: str, run: bool = False, params: bool = False, config: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for f in files:
            p.add_argument(f)
        if params:
            p.add_argument("--param", action="append", default=[])
        if run or config:
            p.add_argument("--runtime-config", "--mcp-config", dest="config")
        if run:
            p.add_argument("--result-mode", choices=("full", "compact"), default="full")
            p.add_argument("--on-error", choices=("fail_fast", "continue"), default="fail_fast")
            p.add_argument("--timeout-ms", type=int)
            p.add_argument("--max-output-bytes", type=int)
            p.add_argument("--max-concurrency", type=int, default=16)
            p.add_argument("--no-cache", action="store_true")
            p.add_argument("--redact", action="store_true")
        return p

    for name in ("validate", "layers", "optimize", "explain"):
        add(name, "plan")
    add("compile-intent", "intent")
    add("compile-recipe", "recipe", params=True)
    add("run", "plan", run=True)
    add("run-intent", "intent", run=True)
    add("run-recipe", "recipe", run=True, params=True)
    b = add("bench", "plan", config=True)
    b.add_argument("-i", "--iterations", type=int, default=3)
    b.add_argument("--warmup", type=int, default=1)
    add("bench-suite", "suite", config=True)
    k = add("schema")
    k.add_argument("kind", choices=sorted(DOCUMENTS))
    c = add("conformance", "adapter", config=True)
    c.add_argument("--echo-tool", default="echo")
    c.add_argument("--failing-tool")
    s = add("suggest", "calls")
    s.add_argument("--min-occurrences", type=int, default=2)
    add("serve-mcp", config=True)
    return top


def run_config(a: argparse.Namespace) -> RunConfig:
    return RunConfig(timeout_ms=a.timeout_ms, max_output_bytes=a.max_output_bytes, concurrency=a.max_concurrency, cache=not a.no_cache, redactor=KeyRedactor() if a.redact else None, on_error=a.on_error, mode=a.result_mode)


def execute(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    match a.command:
        case "validate":
            graph = validate(parse_plan(read_json(a.plan)))
            show({"valid": True, "nodes": len(graph.dependencies), "layers": len(graph.layers)})
        case "layers":
            show(validate(parse_plan(read_json(a.plan))).layers)
        case "optimize":
            done = optimize(parse_plan(read_json(a.plan)))
            show({"plan": dump(done.plan), "report": done.report()})
        case "explain":
            show(explain(parse_plan(read_json(a.plan))))
        case "compile-intent":
            show(dump(compile_intent(read_json(a.intent))))
        case "compile-recipe":
            show(dump(compile_recipe(read_json(a.recipe), parse_params(a.param))))
        case "run" | "run-intent" | "run-recipe":
            if a.command == "run":
                plan = parse_plan(read_json(a.plan))
            else:
                plan = compile_intent(read_json(a.intent)) if a.command == "run-intent" else compile_recipe(read_json(a.recipe), parse_params(a.param))
            result = configured(a.config).run(plan, run_config(a))
            show(result.to_json())
            return int(result.status != "success")
        case "bench":
            show(bench(configured(a.config), parse_plan(read_json(a.plan)), a.iterations, a.warmup))
        case "bench-suite":
            show({"cases": bench_suite(configured(a.config), read_json(a.suite))})
        case "schema":
            show(DOCUMENTS[a.kind])
        case "conformance":
            runtime = configured(a.config)
            if a.adapter not in runtime.executors:
                raise PlanError("unknown_adapter", f"no executor for adapter {a.adapter!r}")
            checks = conformance(runtime.executors[a.adapter], a.echo_tool, {"ping": 1}, {"ping": 1}, a.failing_tool)
            show({"passed": all(c.passed for c in checks), "checks": [asdict(c) for c in checks]})
            return int(not all(c.passed for c in checks))
        case "suggest":
            show({"suggestions": suggest(read_json(a.calls), a.min_occurrences)})
        case "serve-mcp":
            from sparkloom.server import serve

            serve(configured(a.config))
    return 0


def main() -> int:
    try:
        return execute(sys.argv[1:])
    except (PlanError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
