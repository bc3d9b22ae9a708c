"""Runtime configuration files: bindings of adapters, and capabilities."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from sparkloom.plans.compiler import Capability
from sparkloom.plans.ir import PlanError, members, parse_cost, parse_effects, parse_limits, strings, typed
from sparkloom.plans.runtime import Runtime
from sparkloom.sources.base import Local
from sparkloom.sources.files import ENTRY_CAP, READ_CAP, Files
from sparkloom.sources.http import TIMEOUT_S, Http, UrllibClient
from sparkloom.sources.mcp import REQUEST_TIMEOUT_S, McpHttp, McpStdio
from sparkloom.sources.shell import OUTPUT_CAP, Shell, environment


def parse_capability(d: dict) -> Capability:
    part = lambda key, parse: None if d.get(key) is None else parse(d[key])
    return Capability(part("effects", parse_effects), part("limits", parse_limits), part("cost", parse_cost), d.get("version"), d.get("input_schema"), d.get("output_schema"))


def _environment(b: dict, what: str) -> dict[str, str] | None:
    if not {"env", "env_clear", "inherit"} & set(b):
        return None
    return environment(typed(b, "env", dict, what, {}), typed(b, "env_clear", bool, what, "inherit" in b), strings(b, "inherit", what))


def configured(path: str | None = None) -> Runtime:
    """A runtime with the local tools and what the file at `path` binds."""
    return bound(json.loads(Path(path).read_text()) if path else {})


def bound(doc: Any) -> Runtime:
    d = members(doc, "config", (), ("mcp", "fs", "shell", "http", "capabilities"))
    runtime = Runtime({"local": Local()})
    for raw in typed(d, "fs", list, "config", []):
        b = members(raw, "fs", ("adapter", "root"), ("max_read_bytes", "max_entries"))
        runtime.executors[b["adapter"]] = Files(b["root"], b.get("max_read_bytes", READ_CAP), b.get("max_entries", ENTRY_CAP))
    for raw in typed(d, "shell", list, "config", []):
        b = members(raw, "shell", ("adapter",), ("cwd", "programs", "env", "env_clear", "inherit", "default_timeout_ms", "max_output_bytes"))
        runtime.executors[b["adapter"]] = Shell(b.get("cwd", "."), b.get("programs"), _environment(b, "shell"), b.get("default_timeout_ms"), b.get("max_output_bytes", OUTPUT_CAP))
    for raw in typed(d, "http", list, "config", []):
        b = members(raw, "http", ("adapter",), ("base_url", "default_headers", "timeout_ms"))
        runtime.executors[b["adapter"]] = Http(UrllibClient(b.get("timeout_ms", TIMEOUT_S * 1000) / 1000), b.get("base_url"), b.get("default_headers"))
    for raw in typed(d, "mcp", list, "config", []):
        b = members(raw, "mcp", ("adapter", "name"), ("command", "url", "headers", "args", "env", "env_clear", "inherit", "request_timeout_ms", "hydrate"))
        timeout = b.get("request_timeout_ms", REQUEST_TIMEOUT_S * 1000) / 1000
        if ("command" in b) == ("url" in b):
            raise PlanError("invalid_field", "mcp needs a command or a url")
        client = McpHttp(b["name"], b["url"], UrllibClient(timeout), b.get("headers")) if "url" in b else McpStdio(b["name"], [b["command"], *b.get("args", [])], timeout, _environment(b, "mcp"))
        runtime.executors[b["adapter"]] = client
        if b.get("hydrate"):
            for tool, c in client.tools().items():
                runtime.describe(tool, c, b["adapter"])
    for raw in typed(d, "capabilities", list, "config", []):
        b = members(raw, "capability", ("tool",), ("adapter", "effects", "limits", "cost", "version", "input_schema", "output_schema"))
        runtime.describe(b["tool"], parse_capability(b), b.get("adapter"))
    return runtime
