"""The compiler as a server of the Model Context Protocol: newline-separated JSON-RPC, requests answered side by side."""

from __future__ import annotations

import json
import sys
import threading
from concurrent.futures import ThreadPoolExecutor
from typing import Any, TextIO

from sparkloom.plans.compiler import explain
from sparkloom.plans.frontends import compile_intent, compile_recipe
from sparkloom.plans.ir import PlanError, members, parse_plan
from sparkloom.plans.runtime import RunConfig, Runtime
from sparkloom.sources.mcp import PROTOCOL, depth, version_ok

#: The offered tools' names and what they take, and how deep servers may nest.
TOOLS = {"run_compiled_tool_graph": "plan", "run_compiled_tool_intent": "intent", "run_compiled_tool_recipe": "recipe", "explain_tool_plan": "plan"}
DEEPEST = 2
_OPTIONS = {"result_mode": {"enum": ["full", "compact"]}, "on_error": {"enum": ["fail_fast", "continue"]}}


def tool_list() -> list[dict]:
    out = []
    for name, what in TOOLS.items():
        properties: dict[str, Any] = {what: {"type": "object"}}
        if name.startswith("run_"):
            properties |= _OPTIONS
        if what == "recipe":
            properties["params"] = {"type": "object"}
        out.append({"name": name, "description": f"{'Explains' if name.startswith('explain') else 'Runs'} a {what}.", "inputSchema": {"type": "object", "required": [what], "properties": properties}})
    return out


def call_tool(runtime: Runtime, name: str, arguments: Any) -> dict:
    if depth() >= DEEPEST:
        raise PlanError("too_deep", "servers are nested too deep")
    if name not in TOOLS:
        raise PlanError("unknown_tool", f"unknown tool {name!r}")
    what = TOOLS[name]
    a = members(arguments, "arguments", (what,), ("params", "result_mode", "on_error"))
    plan = parse_plan(a["plan"]) if what == "plan" else compile_intent(a["intent"]) if what == "intent" else compile_recipe(a["recipe"], a.get("params"))
    if name == "explain_tool_plan":
        told = explain(plan)
        return {"content": [{"type": "text", "text": f"{len(told['layers'])} layers"}], "structuredContent": told, "isError": False}
    result = runtime.run(plan, RunConfig(mode=a.get("result_mode", "full"), on_error=a.get("on_error", "fail_fast")))
    return {"content": [{"type": "text", "text": result.summary()}], "structuredContent": result.to_json(), "isError": result.status == "failed"}


def answer(runtime: Runtime, message: Any) -> dict | None:
    """The response to a message, None for a notification."""
    if not isinstance(message, dict) or "id" not in message:
        return None
    made: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    params = message.get("params") or {}
    match message.get("method"):
        case "initialize":
            asked = params.get("protocolVersion")
            return made | {"result": {"protocolVersion": asked if version_ok(asked) else PROTOCOL, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "sparkloom", "version": "0"}}}
        case "ping":
            return made | {"result": {}}
        case "tools/list":
            return made | {"result": {"tools": tool_list()}}
        case "tools/call":
            try:
                return made | {"result": call_tool(runtime, params.get("name"), params.get("arguments") or {})}
            except (PlanError, TypeError, ValueError) as e:
                return made | {"result": {"content": [{"type": "text", "text": str(e)}], "isError": True}}
        case other:
            return made | {"error": {"code": -32601, "message": f"unknown method {other!r}"}}


def serve(runtime: Runtime, lines: TextIO | None = None, out: TextIO | None = None) -> None:
    lines, out, lock = lines or sys.stdin, out or sys.stdout, threading.Lock()

    def handle(line: str) -> None:
        try:
            response = answer(runtime, json.loads(line))
        except ValueError as e:
            response = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if response is not None:
            with lock:
                out.write(json.dumps(response, default=str) + "\n")
                out.flush()

    with ThreadPoolExecutor(16) as pool:
        for line in lines:
            if line.strip():
                pool.submit(handle, line)
