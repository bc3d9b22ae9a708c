"""The executor contract, its errors, and the tools that need no outside world."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from sparkloom.plans.ir import MISSING, Effects, Tool, fill_template, walk


class ToolError(Exception):
    """A failed call: message, code, and whether a retry may help (None: not said)."""

    def __init__(self, message: str, code: str | None = None, retryable: bool | None = None):
        super().__init__(message)
        self.message, self.code, self.retryable = message, code, retryable

    def to_json(self) -> dict:
        return {"message": self.message, "code": self.code, "retryable": self.retryable}


class Executor(Protocol):
    """call must be safe from several threads at once."""

    def call(self, tool: str, input: Any) -> Any: ...


def call_batch(executor: Executor, tool: str, inputs: Sequence[tuple[Any, Any]]) -> list[tuple[Any, Any]]:
    """(key, output) of (key, input) pairs: by the executor's own call_batch, else one by one; any error fails all."""
    own = getattr(executor, "call_batch", None)
    return own(tool, inputs) if own else [(k, executor.call(tool, x)) for k, x in inputs]


def field_of(input: Any, name: str, kind: type, default: Any = MISSING) -> Any:
    value = input.get(name, default) if isinstance(input, dict) else MISSING
    if value is MISSING or (value is not default and not isinstance(value, kind)):
        raise ToolError(f"{name} must be {kind.__name__}", "invalid_input", False)
    return value


class Builtin:
    """collect (its input), pick (a path), merge (objects, the rightmost wins), template (text with holes)."""

    def call(self, tool: str, input: Any) -> Any:
        if tool == "collect":
            return input
        if tool == "pick":
            found = walk(field_of(input, "value", object), tuple(p for p in field_of(input, "path", str).split(".") if p))
            if found is MISSING:
                raise ToolError(f"no value at {input['path']!r}", "missing_path", False)
            return found
        if tool == "merge":
            parts = input.get("objects") if isinstance(input, dict) else input
            if not isinstance(parts, list) or not all(isinstance(p, dict) for p in parts):
                raise ToolError("merge needs a list of objects", "invalid_input", False)
            return {k: v for p in parts for k, v in p.items()}
        if tool == "template":
            text, filled = fill_template(field_of(input, "template", str), input.get("values", {}))
            if not filled:
                raise ToolError(f"template {text!r} can't be filled", "invalid_input", False)
            return text
        raise ToolError(f"unknown tool {tool!r}", "unknown_tool", False)


BUILTIN_TOOLS = {name: Tool("builtin", Effects(pure=True, idempotent=True, cacheable=True, commutative=True)) for name in ("collect", "pick", "merge", "template")}


class Local:
    """Tools for trials: const, echo, write (identity), fail. All sleep for sleep_ms; a batch sleeps for its longest."""

    def call(self, tool: str, input: Any) -> Any:
        self._sleep([input])
        return self._answer(tool, input)

    def call_batch(self, tool: str, inputs: Sequence[tuple[Any, Any]]) -> list[tuple[Any, Any]]:
        self._sleep([x for _, x in inputs])
        return [(k, self._answer(tool, x)) for k, x in inputs]

    @staticmethod
    def _sleep(inputs: list) -> None:
        time.sleep(max((x.get("sleep_ms", 0) for x in inputs if isinstance(x, dict)), default=0) / 1000)

    @staticmethod
    def _answer(tool: str, input: Any) -> Any:
        if tool == "const":
            return field_of(input, "value", object)
        if tool in ("echo", "write"):
            return input
        if tool == "fail":
            raise ToolError(input.get("message", "failed") if isinstance(input, dict) else "failed", "failed", False)
        raise ToolError(f"unknown tool {tool!r}", "unknown_tool", False)


class Functions:
    """Python functions of one input as tools."""

    def __init__(self, functions: Mapping[str, Any]):
        self.functions = dict(functions)

    def call(self, tool: str, input: Any) -> Any:
        if tool not in self.functions:
            raise ToolError(f"unknown tool {tool!r}", "unknown_tool", False)
        return self.functions[tool](input)


def as_column_function(function: Callable, kind: Any, effects: Effects | None) -> Any:
    """A Python function as a function of columns that Catalyst treats as its effects allow: unless it is pure it may be
    neither merged with an equal call, nor moved, nor called again for a row that it has been called for."""
    from pyspark.sql import functions as F

    made = F.udf(function, kind)
    return made if effects is not None and effects.pure else made.asNondeterministic()


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    detail: str = ""


def conformance(executor: Executor, tool: str, input: Any, expected: Any, failing: str | None = None) -> list[Check]:
    """Does an executor answer a call, map a batch's keys, and report errors?"""
    checks = []

    def check(name: str, run: Any) -> None:
        try:
            passed, detail = run()
        except Exception as e:  # noqa: BLE001  a check reports whatever goes wrong
            passed, detail = False, str(e)
        checks.append(Check(name, passed, detail))

    check("call", lambda: ((got := executor.call(tool, input)) == expected, repr(got)))
    check("batch", lambda: (dict(got := call_batch(executor, tool, [("a", input), ("b", input)])) == {"a": expected, "b": expected}, repr(got)))
    if failing:

        def fails() -> tuple[bool, str]:
            try:
                return False, repr(executor.call(failing, input))
            except ToolError as e:
                return True, e.message

        check("error", fails)
    return checks
