"""Servers of the Model Context Protocol as tools, over standard input and output or HTTP, and the protocol's values as columns."""

from __future__ import annotations

import collections
import contextlib
import itertools
import json
import os
import queue
import subprocess
import threading
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.plans.compiler import Capability
from sparkloom.plans.ir import Effects
from sparkloom.sources.base import ToolError
from sparkloom.sources.http import Client, UrllibClient

#: Fixed values of the protocol.
PROTOCOL = "2025-06-18"
REQUEST_TIMEOUT_S, STDERR_LINES = 60.0, 40
#: Names the environment variable that says how deep a server is nested.
DEPTH_VARIABLE = "SPARKLOOM_DEPTH"


def depth() -> int:
    """How many servers of this kind this process runs under."""
    told = os.environ.get(DEPTH_VARIABLE, "0")
    return int(told) if told.isdigit() else 0


def version_ok(v: Any) -> bool:
    return isinstance(v, str) and len(v) == 10 and v.count("-") == 2


def normalize(result: Any) -> Any:
    """A tool's result: its structured content if there is one; a result marked as an error is raised."""
    if isinstance(result, dict) and result.get("isError"):
        lines = [c["text"] for c in result.get("content", []) if isinstance(c, dict) and c.get("type") == "text"]
        raise ToolError("\n".join(lines) or "the tool failed", "mcp_tool_error")
    if isinstance(result, dict) and result.get("structuredContent") is not None:
        return result["structuredContent"]
    return result


def normalized(result: Column) -> tuple[Column, Column]:
    """(value, error message) of results as JSON text, as normalize() has them."""
    v = F.try_parse_json(result)
    bad = F.coalesce(F.try_variant_get(v, "$.isError", "boolean"), F.lit(False))
    lines = F.transform(F.filter(F.from_json(F.get_json_object(result, "$.content"), "array<struct<type:string,text:string>>"), lambda c: c["type"] == "text"), lambda c: c["text"])
    own = F.try_variant_get(v, "$.structuredContent", "variant")
    value = F.when(~bad, F.to_json(F.when(own.isNotNull() & ~F.coalesce(F.is_variant_null(own), F.lit(False)), own).otherwise(v)))
    return value, F.when(bad, F.array_join(lines, "\n"))


def effects_of(server: str, read_only: Column, idempotent: Column, cacheable: Column) -> dict[str, Column]:
    """Effects from a tool's annotations, as columns."""
    world = F.lit(f"mcp:{server}")
    return {"reads": F.when(read_only, world), "writes": F.when(~read_only, world), "idempotent": idempotent, "cacheable": read_only & idempotent & cacheable}


def capability(server: str, annotations: Mapping[str, Any], schema: dict | None = None) -> Capability:
    world = (f"mcp:{server}",)
    read, again = bool(annotations.get("readOnlyHint")), bool(annotations.get("idempotentHint"))
    effects = Effects(reads=world if read else (), writes=() if read else world, idempotent=again or read, cacheable=read and again)
    return Capability(effects, input_schema=schema)


def sse_answer(body: Column, id: Column) -> Column:
    """The data of the server-sent event whose JSON has this id."""
    data = F.transform(F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    return F.get(F.filter(data, lambda x: F.get_json_object(x, "$.id") == id.cast("string")), 0)


def _listed(server: str, ask: Callable[[dict], dict]) -> dict[str, Capability]:
    """What a server lists, page after page."""
    found, cursor = {}, None
    while True:
        page = ask({"cursor": cursor} if cursor else {})
        found |= {t["name"]: capability(server, t.get("annotations") or {}, t.get("inputSchema")) for t in page.get("tools", [])}
        cursor = page.get("nextCursor")
        if not cursor:
            return found


def event_with_id(body: str, key: int) -> dict | None:
    """The message with this id among server-sent events."""
    for line in body.splitlines():
        if line.startswith("data:"):
            with contextlib.suppress(ValueError):
                got = json.loads(line[5:])
                if isinstance(got, dict) and got.get("id") == key:
                    return got
    return None


class McpHttp:
    """A server behind one URL: requests are posted, answers are JSON or server-sent events; the session's name that the
    server gives is sent back."""

    def __init__(self, name: str, url: str, client: Client | None = None, headers: Mapping[str, str] | None = None):
        self.name, self.url, self.client = name, url, client or UrllibClient(REQUEST_TIMEOUT_S)
        self.headers = {"content-type": "application/json", "accept": "application/json, text/event-stream", **(headers or {})}
        self.ids, self.lock, self.ready = itertools.count(1), threading.Lock(), False

    def _post(self, message: dict) -> tuple[dict[str, str], str]:
        status, headers, data = self.client.request("POST", self.url, self.headers, json.dumps(message).encode())
        if not 200 <= status < 300:
            raise ToolError(f"{self.name} answered {status}", "mcp_transport", status >= 500 or status == 429)
        return {k.lower(): v for k, v in headers.items()}, data.decode("utf-8", "replace")

    def _ask(self, method: str, params: dict) -> dict:
        key = next(self.ids)
        headers, body = self._post({"jsonrpc": "2.0", "id": key, "method": method, "params": params})
        if "mcp-session-id" in headers:
            self.headers["mcp-session-id"] = headers["mcp-session-id"]
        try:
            got = event_with_id(body, key) if "event-stream" in headers.get("content-type", "") else json.loads(body)
        except ValueError as e:
            raise ToolError(f"{self.name} answered no JSON", "mcp_protocol", False) from e
        if not isinstance(got, dict):
            raise ToolError(f"{self.name} gave no answer", "mcp_protocol", False)
        if "error" in got:
            raise ToolError(str(got["error"].get("message")), "mcp_server")
        return got.get("result") or {}

    def _start(self) -> None:
        with self.lock:
            if self.ready:
                return
            hello = self._ask("initialize", {"protocolVersion": PROTOCOL, "capabilities": {}, "clientInfo": {"name": "sparkloom", "version": "0"}})
            if not version_ok(hello.get("protocolVersion")):
                raise ToolError("the server names no protocol version", "mcp_protocol", False)
            self._post({"jsonrpc": "2.0", "method": "notifications/initialized"})
            self.ready = True

    def call(self, tool: str, input: Any) -> Any:
        self._start()
        return normalize(self._ask("tools/call", {"name": tool, "arguments": input}))

    def tools(self) -> dict[str, Capability]:
        self._start()
        return _listed(self.name, lambda p: self._ask("tools/list", p))


class _Session:
    """One life of a server process and what is waited for from it."""

    def __init__(self, name: str, process: subprocess.Popen, timeout_s: float):
        self.name, self.process, self.timeout_s = name, process, timeout_s
        self.ids, self.writing = itertools.count(1), threading.Lock()
        self.waiting: dict[int, queue.Queue] = {}
        self.stderr: collections.deque[str] = collections.deque(maxlen=STDERR_LINES)
        self.ended = False
        threading.Thread(target=self._read, daemon=True).start()
        threading.Thread(target=lambda: self.stderr.extend(process.stderr), daemon=True).start()

    @property
    def alive(self) -> bool:
        return not self.ended and self.process.poll() is None

    def _read(self) -> None:
        for line in self.process.stdout:
            with contextlib.suppress(ValueError, AttributeError):
                got = json.loads(line)
                if box := self.waiting.pop(got.get("id"), None):
                    box.put(got)
        self.ended = True
        for key in list(self.waiting):
            if box := self.waiting.pop(key, None):
                box.put(None)

    def _told(self) -> str:
        return "".join(self.stderr)[-500:]

    def write(self, message: dict) -> None:
        try:
            with self.writing:
                self.process.stdin.write(json.dumps(message) + "\n")
                self.process.stdin.flush()
        except OSError as e:
            raise ToolError(f"{self.name} is gone: {self._told()}", "mcp_transport") from e

    def send(self, method: str, params: dict) -> tuple[int, queue.Queue]:
        key, box = next(self.ids), queue.Queue()
        self.waiting[key] = box
        self.write({"jsonrpc": "2.0", "id": key, "method": method, "params": params})
        if not self.alive and self.waiting.pop(key, None):  # its reader may have left before the box stood there
            box.put(None)
        return key, box

    def ask(self, sent: tuple[int, queue.Queue]) -> dict:
        key, box = sent
        try:
            got = box.get(timeout=self.timeout_s)
        except queue.Empty as e:
            self.waiting.pop(key, None)
            raise ToolError(f"{self.name} didn't answer in time", "timeout", True) from e
        if got is None:
            raise ToolError(f"{self.name} ended: {self._told()}", "mcp_transport")
        if "error" in got:
            raise ToolError(str(got["error"].get("message")), "mcp_server")
        return got.get("result") or {}

    def greet(self) -> None:
        hello = self.ask(self.send("initialize", {"protocolVersion": PROTOCOL, "capabilities": {}, "clientInfo": {"name": "sparkloom", "version": "0"}}))
        if not version_ok(hello.get("protocolVersion")):
            raise ToolError("the server names no protocol version", "mcp_protocol", False)
        self.write({"jsonrpc": "2.0", "method": "notifications/initialized"})

    def end(self) -> None:
        if self.process.poll() is None:
            with contextlib.suppress(OSError):
                self.process.stdin.close()
            try:
                self.process.wait(2)
            except subprocess.TimeoutExpired:
                self.process.kill()


class McpStdio:
    """One server process, started when first needed and again when it has died. Nobody gets a process whose greeting isn't
    answered; one that fails it is ended. A batch writes all its requests before it waits for any answer. A process is told
    how deep it is nested, one deeper than this one."""

    def __init__(self, name: str, command: Sequence[str], timeout_s: float = REQUEST_TIMEOUT_S, env: Mapping[str, str] | None = None):
        self.name, self.command, self.timeout_s, self.env = name, list(command), timeout_s, env
        self.starting, self.session = threading.Lock(), None

    def _started(self) -> _Session:
        with self.starting:
            if self.session and self.session.alive:
                return self.session
            env = {**(os.environ if self.env is None else self.env), DEPTH_VARIABLE: str(depth() + 1)}
            try:
                process = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, bufsize=1, env=env)
            except OSError as e:
                raise ToolError(str(e), "mcp_transport") from e
            session = _Session(self.name, process, self.timeout_s)
            try:
                session.greet()
            except ToolError:
                process.kill()
                raise
            self.session = session
            return session

    def call(self, tool: str, input: Any) -> Any:
        return self.call_batch(tool, [(0, input)])[0][1]

    def call_batch(self, tool: str, inputs: Sequence[tuple[Any, Any]]) -> list[tuple[Any, Any]]:
        s = self._started()
        sent = [(k, s.send("tools/call", {"name": tool, "arguments": x})) for k, x in inputs]
        return [(k, normalize(s.ask(x))) for k, x in sent]

    def tools(self) -> dict[str, Capability]:
        s = self._started()
        return _listed(self.name, lambda p: s.ask(s.send("tools/list", p)))

    def close(self) -> None:
        if self.session:
            self.session.end()
