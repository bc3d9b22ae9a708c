"""The plan model: strict parsing, references, markers, effects and canonical text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

VERSION = "0"
#: Keys with which an object of one key is a marker.
REF, LITERAL, ITEM, PREV, PARAM = "$ref", "$literal", "$item", "$prev", "$param"


class PlanError(ValueError):
    """A plan, intent or recipe that isn't valid. kind names the rule."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class _Missing:
    """Stands for an absent value where null is a value."""

    def __repr__(self) -> str:
        return "MISSING"


MISSING = _Missing()


# --- references -------------------------------------------------------------------------------------------------


def escape_segment(s: str) -> str:
    return s.replace("~", "~0").replace(".", "~1")


def unescape_segment(s: str) -> str:
    return s.replace("~1", ".").replace("~0", "~")


def check_node_id(name: str) -> str:
    if not isinstance(name, str) or not name or "." in name:
        raise PlanError("invalid_node_id", f"node id {name!r} is empty or has a dot")
    return name


@dataclass(frozen=True, order=True)
class ValueRef:
    """`node.output` and a path of segments into it."""

    node: str
    path: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> ValueRef:
        parts = text.split(".") if isinstance(text, str) else []
        if len(parts) < 2 or parts[1] != "output" or not all(parts):
            raise PlanError("invalid_ref", f"{text!r} is no reference of the form node.output[.segment]")
        return cls(parts[0], tuple(map(unescape_segment, parts[2:])))

    def __str__(self) -> str:
        return ".".join([self.node, "output", *map(escape_segment, self.path)])


class ResolutionError(KeyError):
    """code is missing_node_output or missing_path."""

    def __init__(self, code: str, ref: object):
        super().__init__(f"{code}: {ref}")
        self.code = code


def step(value: Any, segment: str) -> Any:
    if isinstance(value, dict):
        return value.get(segment, MISSING)
    if isinstance(value, list) and segment.isascii() and segment.isdigit():
        return value[int(segment)] if int(segment) < len(value) else MISSING
    if hasattr(value, "columns") and hasattr(value, "select"):  # a table
        return value.select(segment) if segment in value.columns else MISSING
    return MISSING


def walk(value: Any, path: tuple[str, ...]) -> Any:
    for segment in path:
        value = step(value, segment)
        if value is MISSING:
            break
    return value


def resolve_ref(ref: ValueRef, outputs: Mapping[str, Any]) -> Any:
    if ref.node not in outputs:
        raise ResolutionError("missing_node_output", ref)
    found = walk(outputs[ref.node], ref.path)
    if found is MISSING:
        raise ResolutionError("missing_path", ref)
    return found


# --- markers ----------------------------------------------------------------------------------------------------


def marker(value: Any, key: str) -> Any:
    """What stands under key if value is an object of that key alone, else MISSING."""
    return value[key] if isinstance(value, dict) and len(value) == 1 and key in value else MISSING


def rewrite(value: Any, rules: Mapping[str, Callable[[Any], Any]], keep_literal: bool = True) -> Any:
    """value with each marker of rules replaced; what $literal shields stays (with its shield, if keep_literal)."""
    if (shielded := marker(value, LITERAL)) is not MISSING:
        return value if keep_literal else shielded
    for key, rule in rules.items():
        if isinstance(value, dict) and key in value:
            if len(value) > 1:
                raise PlanError("invalid_marker", f"{key} must be the only key")
            return rule(value[key])
    if isinstance(value, dict):
        return {k: rewrite(v, rules, keep_literal) for k, v in value.items()}
    if isinstance(value, list):
        return [rewrite(v, rules, keep_literal) for v in value]
    return value


def collect_refs(value: Any) -> list[ValueRef]:
    """References within a value, in order, each once."""
    if isinstance(value, dict) and REF not in value:
        for x in value.values():
            if isinstance(x, (dict, list)):
                break
        else:
            return []
    found: dict[str, None] = {}
    stack = [value]
    while stack:
        at = stack.pop()
        if isinstance(at, dict):
            if REF in at:
                if len(at) > 1:
                    raise PlanError("invalid_marker", f"{REF} must be the only key")
                found.setdefault(at[REF] if isinstance(at[REF], str) else canonical(at[REF]))
            elif len(at) > 1 or LITERAL not in at:
                stack += reversed(at.values())
        elif isinstance(at, list):
            stack += reversed(at)
    return list(map(ValueRef.parse, found))


def resolve_input(template: Any, outputs: Mapping[str, Any], item: Any = MISSING) -> Any:
    """The template with references and, inside a fan-out, items filled in. What is filled in is never looked into."""
    rules: dict[str, Callable] = {REF: lambda text: resolve_ref(ValueRef.parse(text), outputs)}
    if item is not MISSING:
        rules[ITEM] = lambda path: _item(item, path)
    return rewrite(template, rules, keep_literal=False)


def _item(item: Any, path: Any) -> Any:
    found = walk(item, tuple(map(unescape_segment, path.split("."))) if path else ()) if isinstance(path, str) else MISSING
    if found is MISSING:
        raise ResolutionError("invalid_item", path)
    return found


# --- canonical text and templates -------------------------------------------------------------------------------


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys; numbers keep their own form (1 and 1.0 differ)."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def scalar_text(value: Any) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    return json.dumps(value) if isinstance(value, int | float) else None


_HOLE = re.compile(r"\{([^{}]*)\}")


def fill_template(template: str, values: Any) -> tuple[str, bool]:
    """(text, whether every hole was filled). Holes {a.b} take scalars from objects; if one can't be filled, the whole
    template stays as it is. An unclosed brace is text."""
    missing = False

    def filled(m: re.Match) -> str:
        nonlocal missing
        at = values
        for key in m[1].split("."):
            at = at.get(key, MISSING) if isinstance(at, dict) else MISSING
        text = None if at is MISSING else scalar_text(at)
        missing |= text is None
        return text or ""

    out = _HOLE.sub(filled, template)
    return (template, False) if missing else (out, True)


# --- the model --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Retry:
    max_attempts: int = 1
    retryable_errors: tuple[str, ...] = ()
    backoff_ms: int | None = None


@dataclass(frozen=True)
class Effects:
    pure: bool = False
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = ()
    idempotent: bool = False
    cacheable: bool = False
    batchable: bool = False
    commutative: bool = False
    timeout_ms: int | None = None
    retry: Retry | None = None

    @property
    def declared(self) -> bool:
        return self.pure or bool(self.reads) or bool(self.writes)

    @property
    def contradictory(self) -> bool:
        return self.pure and bool(self.writes)

    @property
    def reusable(self) -> bool:
        return self.pure or self.cacheable


@dataclass(frozen=True)
class Limits:
    max_concurrency: int | None = None
    batch_size: int | None = None


@dataclass(frozen=True)
class Cost:
    fixed_ms: int = 0
    per_call_ms: int = 0
    tokens: int = 0


@dataclass(frozen=True)
class Tool:
    adapter: str
    effects: Effects | None = None
    limits: Limits | None = None
    cost: Cost | None = None
    version: str | None = None


@dataclass(frozen=True)
class When:
    ref: ValueRef
    equals: Any = MISSING
    negate: bool = False

    def holds(self, outputs: Mapping[str, Any]) -> bool:
        """Null and false are the only false values; equality compares canonical text."""
        found = resolve_ref(self.ref, outputs)
        verdict = (found is not None and found is not False) if self.equals is MISSING else canonical(found) == canonical(self.equals)
        return verdict != self.negate


@dataclass(frozen=True)
class Node:
    id: str
    tool: str
    input: Any = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()
    for_each: ValueRef | None = None
    when: When | None = None

    def data_refs(self) -> list[ValueRef]:
        if self.for_each is None and self.when is None:
            return collect_refs(self.input)
        gates = [self.for_each] if self.for_each else []
        return collect_refs(self.input) + gates + ([self.when.ref] if self.when else [])

    def data_dependencies(self) -> set[str]:
        return {r.node for r in self.data_refs()}

    def dependencies(self) -> set[str]:
        refs = self.data_refs()
        return {r.node for r in refs}.union(self.depends_on) if refs else set(self.depends_on)


@dataclass(frozen=True)
class Plan:
    tools: dict[str, Tool] = field(default_factory=dict)
    nodes: tuple[Node, ...] = ()
    outputs: dict[str, ValueRef] = field(default_factory=dict)
    name: str | None = None
    description: str | None = None
    version: str = VERSION


# --- strict parsing ---------------------------------------------------------------------------------------------


def members(doc: Any, what: str, required: tuple[str, ...], optional: tuple[str, ...]) -> dict:
    """doc, if it is an object with no other keys and all required ones."""
    if not isinstance(doc, dict):
        raise PlanError("invalid_document", f"{what} must be an object")
    if unknown := set(doc) - set(required) - set(optional):
        raise PlanError("unknown_field", f"{what} has unknown fields {sorted(unknown)}")
    if absent := [k for k in required if k not in doc]:
        raise PlanError("missing_field", f"{what} lacks {absent}")
    return doc


def typed(doc: dict, key: str, kind: type, what: str, default: Any = None, least: int | None = None) -> Any:
    value = doc.get(key)
    if value is None:
        return default
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)) or (least is not None and value < least):
        raise PlanError("invalid_field", f"{what}.{key} must be {kind.__name__}" + (f" of {least} or more" if least is not None else ""))
    return value


def strings(doc: dict, key: str, what: str) -> tuple[str, ...]:
    found = typed(doc, key, list, what, [])
    if not all(isinstance(x, str) for x in found):
        raise PlanError("invalid_field", f"{what}.{key} must hold strings")
    return tuple(found)


def check_version(doc: dict) -> None:
    if doc["version"] != VERSION:
        raise PlanError("unsupported_version", f"version {doc['version']!r} isn't {VERSION!r}")


def parse_effects(doc: Any) -> Effects:
    flags = ("pure", "idempotent", "cacheable", "batchable", "commutative")
    d = members(doc, "effects", (), (*flags, "reads", "writes", "timeout_ms", "retry"))
    retry = None
    if d.get("retry") is not None:
        r = members(d["retry"], "retry", ("max_attempts",), ("retryable_errors", "backoff_ms"))
        retry = Retry(typed(r, "max_attempts", int, "retry", least=0), strings(r, "retryable_errors", "retry"), typed(r, "backoff_ms", int, "retry", least=1))
    known = {f: typed(d, f, bool, "effects", False) for f in flags}
    return Effects(**known, reads=tuple(sorted(set(strings(d, "reads", "effects")))), writes=tuple(sorted(set(strings(d, "writes", "effects")))), timeout_ms=typed(d, "timeout_ms", int, "effects", least=1), retry=retry)


def parse_limits(doc: Any) -> Limits:
    d = members(doc, "limits", (), ("max_concurrency", "batch_size"))
    return Limits(typed(d, "max_concurrency", int, "limits", least=1), typed(d, "batch_size", int, "limits", least=1))


def parse_cost(doc: Any) -> Cost:
    names = tuple(f.name for f in fields(Cost))
    d = members(doc, "cost", (), names)
    return Cost(*[typed(d, n, int, "cost", 0, 0) for n in names])


def parse_tool(doc: Any) -> Tool:
    d = members(doc, "tool", ("adapter",), ("effects", "limits", "cost", "version"))
    part = lambda key, parse: None if d.get(key) is None else parse(d[key])
    return Tool(typed(d, "adapter", str, "tool"), part("effects", parse_effects), part("limits", parse_limits), part("cost", parse_cost), typed(d, "version", str, "tool"))


def parse_tools(doc: dict) -> dict[str, Tool]:
    return {k: parse_tool(v) for k, v in typed(doc, "tools", dict, "plan", {}).items()}


def parse_outputs(doc: dict) -> dict[str, ValueRef]:
    return {k: ValueRef.parse(v) for k, v in typed(doc, "outputs", dict, "plan", {}).items()}


def parse_node(doc: Any) -> Node:
    d = members(doc, "node", ("id", "tool"), ("input", "depends_on", "for_each", "when"))
    when = None
    if d.get("when") is not None:
        w = members(d["when"], "when", ("ref",), ("equals", "not"))
        when = When(ValueRef.parse(w["ref"]), w.get("equals", MISSING), typed(w, "not", bool, "when", False))
    each = ValueRef.parse(d["for_each"]) if d.get("for_each") is not None else None
    return Node(typed(d, "id", str, "node"), typed(d, "tool", str, "node"), d.get("input", {}), strings(d, "depends_on", "node"), each, when)


def parse_plan(doc: Any) -> Plan:
    d = members(doc, "plan", ("version",), ("name", "description", "tools", "nodes", "outputs"))
    check_version(d)
    return Plan(parse_tools(d), tuple(map(parse_node, typed(d, "nodes", list, "plan", []))), parse_outputs(d), typed(d, "name", str, "plan"), typed(d, "description", str, "plan"))


def dump(value: Any) -> Any:
    """A model object as JSON data, with absent parts left out."""
    if isinstance(value, ValueRef):
        return str(value)
    if isinstance(value, When):
        return {"ref": str(value.ref)} | ({} if value.equals is MISSING else {"equals": value.equals}) | ({"not": True} if value.negate else {})
    if isinstance(value, Node):
        out = {"id": value.id, "tool": value.tool, "input": value.input}
        out |= {"depends_on": list(value.depends_on)} if value.depends_on else {}
        return out | ({"for_each": str(value.for_each)} if value.for_each else {}) | ({"when": dump(value.when)} if value.when else {})
    if isinstance(value, Plan):
        out = {"version": value.version, "name": value.name, "description": value.description, "tools": dump(value.tools), "nodes": dump(value.nodes), "outputs": dump(value.outputs)}
        return {k: v for k, v in out.items() if v is not None}
    if hasattr(value, "__dataclass_fields__"):
        return {f.name: dump(v) for f in fields(value) if (v := getattr(value, f.name)) is not None}
    if isinstance(value, dict):
        return {k: dump(v) for k, v in value.items()}
    return [dump(v) for v in value] if isinstance(value, list | tuple | set | frozenset) else value


def with_aliases(node: Node, alias: Mapping[str, str]) -> Node:
    """node with every reference and ordering edge to a removed node pointed at the one that stands for it."""
    to = lambda r: replace(r, node=alias.get(r.node, r.node))
    return replace(
        node,
        input=rewrite(node.input, {REF: lambda t: {REF: str(to(ValueRef.parse(t)))}}),
        depends_on=tuple(sorted({alias.get(d, d) for d in node.depends_on})),
        for_each=to(node.for_each) if node.for_each else None,
        when=replace(node.when, ref=to(node.when.ref)) if node.when else None,
    )


def iter_nodes(plan: Plan) -> Iterator[tuple[Node, Tool]]:
    for n in plan.nodes:
        yield n, plan.tools[n.tool]
