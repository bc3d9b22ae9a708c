"""Front-ends that lower to plans: intents, recipes with parameters, and a builder."""

from __future__ import annotations

import json
import subprocess
import sys
from collections.abc import Iterable, Mapping
from dataclasses import replace
from typing import Any

from sparkloom.plans.compiler import Capability
from sparkloom.plans.ir import (
    ITEM, MISSING, PARAM, PREV, REF, VERSION, Effects, Limits, Cost, Node, Plan, PlanError, Tool, ValueRef, When,
    check_node_id, check_version, collect_refs, dump, members, parse_effects, parse_outputs, parse_tool, parse_tools, rewrite, strings, typed, unescape_segment,
)

_HEAD = ("name", "description", "tools", "outputs")


def compile_intent(doc: Any) -> Plan:
    """Steps in order; a step depends on what it lists under `after` and on the steps that its input refers to."""
    d = members(doc, "intent", ("version",), (*_HEAD, "steps"))
    check_version(d)
    tools, nodes, seen = parse_tools(d), [], set()
    for raw in typed(d, "steps", list, "intent", []):
        s = members(raw, "step", ("id", "tool"), ("input", "after"))
        name = check_node_id(s["id"])
        if name in seen:
            raise PlanError("duplicate_id", f"step {name!r} occurs twice")
        seen.add(name)
        if s["tool"] not in tools:
            raise PlanError("unknown_tool", f"step {name!r} names the unknown tool {s['tool']!r}")
        own = s.get("input", {})
        deps = set(strings(s, "after", "step")) | {r.node for r in collect_refs(own)}
        nodes.append(Node(name, s["tool"], own, tuple(sorted(deps))))
    return Plan(tools, tuple(nodes), parse_outputs(d), d.get("name"), d.get("description"))


def compile_recipe(doc: Any, params: Mapping[str, Any] | None = None) -> Plan:
    """fan_out, map_reduce or pipeline, with $param filled from params over the declared defaults (null: required)."""
    d = members(doc, "recipe", ("version", "recipe"), (*_HEAD, "params"))
    check_version(d)
    declared = typed(d, "params", dict, "recipe", {})
    if unknown := set(params or {}) - set(declared):
        raise PlanError("unknown_param", f"unknown parameters {sorted(unknown)}")
    values = declared | dict(params or {})
    if absent := sorted(k for k, v in values.items() if v is None):
        raise PlanError("missing_param", f"parameters without a value: {absent}")

    def value_of(name: Any) -> Any:
        if name not in values:
            raise PlanError("unknown_param", f"$param {name!r} isn't declared")
        return values[name]

    body = rewrite(d["recipe"], {PARAM: value_of})
    lower = {"fan_out": _fan_out, "map_reduce": _map_reduce, "pipeline": _pipeline}.get(body.get("kind") if isinstance(body, dict) else None)
    if lower is None:
        raise PlanError("invalid_recipe", "kind must be fan_out, map_reduce or pipeline")
    return Plan(parse_tools(d), tuple(lower(body)), parse_outputs(d), d.get("name"), d.get("description"))


def _wrapped(item: Any, key: str | None) -> Any:
    return item if key is None else {key: item}


_FAN = ("tool", "items", "items_ref", "node_prefix", "input_key")


def _spread(r: dict) -> list[Node]:
    prefix, key, items = r.get("node_prefix", "item_"), r.get("input_key"), typed(r, "items", list, "recipe", [])
    if r.get("items_ref") is not None:
        return [Node(f"{prefix}each", r["tool"], _wrapped({ITEM: ""}, key), for_each=ValueRef.parse(r["items_ref"]))]
    if not items:
        raise PlanError("empty_recipe", "a recipe needs items or items_ref")
    return [Node(f"{prefix}{k}", r["tool"], _wrapped(x, key)) for k, x in enumerate(items, 1)]


def _fan_out(r: dict) -> list[Node]:
    return _spread(members(r, "fan_out", ("kind", "tool"), _FAN))


def _map_reduce(r: dict) -> list[Node]:
    members(r, "map_reduce", ("kind", "tool", "reduce_tool"), (*_FAN, "reduce_input_key"))
    mapped = _spread(r)
    refs = [{REF: f"{n.id}.output"} for n in mapped]
    gathered = refs[0] if mapped[0].for_each else refs
    return [*mapped, Node(f"{r.get('node_prefix', 'item_')}reduce", r["reduce_tool"], _wrapped(gathered, r.get("reduce_input_key")))]


def _pipeline(r: dict) -> list[Node]:
    members(r, "pipeline", ("kind", "steps"), ("node_prefix",))
    prefix, nodes = r.get("node_prefix", "step_"), []

    def before(path: Any) -> Any:
        if not nodes or not isinstance(path, str):
            raise PlanError("invalid_prev", "$prev needs a step before it, and a path")
        ref = ValueRef(nodes[-1].id, tuple(map(unescape_segment, path.split("."))) if path else ())
        return {REF: str(ref)}

    for k, raw in enumerate(typed(r, "steps", list, "pipeline", []), 1):
        s = members(raw, "step", ("tool",), ("input",))
        nodes.append(Node(f"{prefix}{k}", s["tool"], rewrite(s.get("input", {}), {PREV: before})))
    if not nodes:
        raise PlanError("empty_recipe", "a pipeline needs steps")
    return nodes


def splice(plan: Plan, nodes: Iterable[Node], tools: Mapping[str, Tool] | None = None) -> Plan:
    """plan with nodes put before its own, as the sources that a recipe with items_ref needs."""
    return replace(plan, nodes=(*nodes, *plan.nodes), tools={**(tools or {}), **plan.tools})


def parse_params(pairs: Iterable[str]) -> dict[str, Any]:
    """k=v arguments: v as JSON if it is JSON, else as text."""
    out = {}
    for pair in pairs:
        name, found, text = pair.partition("=")
        if not found or not name:
            raise PlanError("invalid_param", f"{pair!r} isn't name=value")
        try:
            out[name] = json.loads(text)
        except ValueError:
            out[name] = text
    return out


class PlanBuilder:
    """Plans in code: PlanBuilder().tool(...).node(...).output(...).build()."""

    def __init__(self, name: str | None = None):
        self.plan = Plan(name=name)

    def tool(self, name: str, adapter: str = "builtin", *, limits: Limits | None = None, cost: Cost | None = None, version: str | None = None, **effects: Any) -> PlanBuilder:
        own = parse_effects(effects) if effects else None
        self.plan = replace(self.plan, tools=self.plan.tools | {name: Tool(adapter, own, limits, cost, version)})
        return self

    def node(self, id: str, tool: str, input: Any = None, *, after: Iterable[str] = (), for_each: str | None = None, when: str | None = None, equals: Any = MISSING, negate: bool = False) -> PlanBuilder:
        gate = When(ValueRef.parse(when), equals, negate) if when else None
        made = Node(id, tool, {} if input is None else input, tuple(after), ValueRef.parse(for_each) if for_each else None, gate)
        self.plan = replace(self.plan, nodes=(*self.plan.nodes, made))
        return self

    def output(self, name: str, ref: str) -> PlanBuilder:
        self.plan = replace(self.plan, outputs=self.plan.outputs | {name: ValueRef.parse(ref)})
        return self

    def build(self) -> Plan:
        return self.plan


class IntentBuilder:
    """Intents in code: IntentBuilder().tool(...).step(...).output(...); build() gives the document, compile() the plan."""

    def __init__(self, name: str | None = None):
        self.doc: dict[str, Any] = {"version": VERSION, "tools": {}, "steps": [], "outputs": {}} | ({"name": name} if name else {})

    def tool(self, name: str, adapter: str = "builtin", **parts: Any) -> IntentBuilder:
        self.doc["tools"][name] = _described(adapter, parts)
        return self

    def step(self, id: str, tool: str, input: Any = None, *, after: Iterable[str] = ()) -> IntentBuilder:
        self.doc["steps"].append({"id": id, "tool": tool} | ({} if input is None else {"input": input}) | ({"after": list(after)} if after else {}))
        return self

    def output(self, name: str, ref: str) -> IntentBuilder:
        self.doc["outputs"][name] = ref
        return self

    def build(self) -> dict[str, Any]:
        return self.doc

    def compile(self) -> Plan:
        return compile_intent(self.doc)


class RecipeBuilder:
    """Recipes in code. One of fan_out, map_reduce and pipeline says what is done; param() declares a parameter (None:
    required), which param_ref() stands for."""

    def __init__(self, name: str | None = None):
        self.doc: dict[str, Any] = {"version": VERSION, "tools": {}, "params": {}, "outputs": {}} | ({"name": name} if name else {})

    def tool(self, name: str, adapter: str = "builtin", **parts: Any) -> RecipeBuilder:
        self.doc["tools"][name] = _described(adapter, parts)
        return self

    def param(self, name: str, default: Any = None) -> RecipeBuilder:
        self.doc["params"][name] = default
        return self

    def _set(self, kind: str, **parts: Any) -> RecipeBuilder:
        self.doc["recipe"] = {"kind": kind} | {k: v for k, v in parts.items() if v is not None}
        return self

    def fan_out(self, tool: str, items: Any = None, *, items_ref: str | None = None, prefix: str | None = None, key: str | None = None) -> RecipeBuilder:
        return self._set("fan_out", tool=tool, items=items, items_ref=items_ref, node_prefix=prefix, input_key=key)

    def map_reduce(self, tool: str, reduce_tool: str, items: Any = None, *, items_ref: str | None = None, prefix: str | None = None, key: str | None = None, reduce_key: str | None = None) -> RecipeBuilder:
        return self._set("map_reduce", tool=tool, reduce_tool=reduce_tool, items=items, items_ref=items_ref, node_prefix=prefix, input_key=key, reduce_input_key=reduce_key)

    def pipeline(self, *steps: tuple[str, Any], prefix: str | None = None) -> RecipeBuilder:
        return self._set("pipeline", steps=[{"tool": t, "input": x} for t, x in steps], node_prefix=prefix)

    def output(self, name: str, ref: str) -> RecipeBuilder:
        self.doc["outputs"][name] = ref
        return self

    def build(self) -> dict[str, Any]:
        return self.doc

    def compile(self, **params: Any) -> Plan:
        return compile_recipe(self.doc, params)


def _described(adapter: str, parts: Mapping[str, Any]) -> dict[str, Any]:
    """A tool as a document: limits, cost and version by name, the rest are effects. Checked at once."""
    head = {k: dump(v) for k, v in parts.items() if k in ("limits", "cost", "version") and v is not None}
    effects = {k: list(v) if isinstance(v, tuple | set) else v for k, v in parts.items() if k not in ("limits", "cost", "version")}
    doc = {"adapter": adapter} | head | ({"effects": effects} if effects else {})
    parse_tool(doc)
    return doc


def fan_out(tool: str, inputs: Iterable[Any], prefix: str = "item_") -> list[Node]:
    """A node for each input, as a recipe makes them."""
    return [Node(f"{prefix}{k}", tool, x) for k, x in enumerate(inputs, 1)]


def capabilities(**tools: Mapping[str, Any]) -> dict[str, Capability]:
    """What an adapter says of its tools: capabilities(read={"reads": ["x"], "cost": Cost(5)}, ...)."""
    out = {}
    for name, parts in tools.items():
        t = parse_tool(_described("", {k: v for k, v in parts.items() if not k.endswith("_schema")}))
        out[name] = Capability(t.effects, t.limits, t.cost, t.version, parts.get("input_schema"), parts.get("output_schema"))
    return out


def run_by_cli(doc: Plan | Mapping[str, Any], *options: str, command: str = "run", timeout_s: float = 600) -> dict[str, Any]:
    """The result document of `python -m sparkloom run`, in a process of its own; PlanError with its complaint if it has none."""
    text = json.dumps(dump(doc) if isinstance(doc, Plan) else doc)
    done = subprocess.run([sys.executable, "-m", "sparkloom", command, "-", *options], input=text, capture_output=True, text=True, timeout=timeout_s, check=False)
    try:
        return json.loads(done.stdout)
    except ValueError:
        raise PlanError("cli", done.stderr.strip() or f"ended with {done.returncode}") from None


def ref(node: str, *path: str) -> dict:
    return {REF: str(ValueRef(node, tuple(path)))}


__all__ = ["Effects", "IntentBuilder", "PlanBuilder", "RecipeBuilder", "capabilities", "compile_intent", "compile_recipe", "fan_out", "parse_params", "ref", "run_by_cli", "splice"]
