"""A small JSON Schema check for tool inputs."""

from __future__ import annotations

import json
from functools import lru_cache
from typing import Any

_TYPES = {"null": type(None), "boolean": bool, "integer": int, "number": (int, float), "string": str, "array": list, "object": dict}


@lru_cache(maxsize=512)
def _compiled(text: str) -> Any:
    return json.loads(text)


def check_schema(text: str, value: Any) -> str | None:
    """What is wrong with value, or None. Knows type, enum, const, required, properties, additionalProperties, items,
    minimum, maximum, minLength, maxLength, minItems and maxItems; other keywords are ignored."""
    return _check(_compiled(text), value, "input")


def _is(value: Any, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES.get(kind, object)) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def _check(s: Any, v: Any, at: str) -> str | None:
    if s is True or s == {}:
        return None
    if s is False:
        return f"{at} isn't allowed"
    kinds = s.get("type")
    if kinds and not any(_is(v, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at} must be {kinds}"
    if "enum" in s and v not in s["enum"]:
        return f"{at} must be one of {s['enum']}"
    if "const" in s and v != s["const"]:
        return f"{at} must be {s['const']!r}"
    size = v if isinstance(v, int | float) and not isinstance(v, bool) else None
    for low, high, n in (("minimum", "maximum", size), ("minLength", "maxLength", len(v) if isinstance(v, str) else None), ("minItems", "maxItems", len(v) if isinstance(v, list) else None)):
        if n is not None and (n < s.get(low, n) or n > s.get(high, n)):
            return f"{at} must be within {low} and {high}"
    if isinstance(v, list) and "items" in s:
        return next((e for k, x in enumerate(v) if (e := _check(s["items"], x, f"{at}[{k}]"))), None)
    if isinstance(v, dict):
        if absent := [k for k in s.get("required", []) if k not in v]:
            return f"{at} lacks {absent}"
        known, other = s.get("properties", {}), s.get("additionalProperties", True)
        return next((e for k, x in v.items() if (e := _check(known.get(k, other), x, f"{at}.{k}"))), None)
    return None


def _object(required: dict[str, Any], **optional: Any) -> dict[str, Any]:
    return {"type": "object", "required": list(required), "properties": required | optional, "additionalProperties": False}


_TEXT, _FLAG, _TEXTS = {"type": "string"}, {"type": "boolean"}, {"type": "array", "items": {"type": "string"}}
_COUNT, _AMOUNT = {"type": "integer", "minimum": 1}, {"type": "integer", "minimum": 0}
_RETRY = _object({"max_attempts": _AMOUNT}, retryable_errors=_TEXTS, backoff_ms=_COUNT)
_EFFECTS = _object({}, **dict.fromkeys(("pure", "idempotent", "cacheable", "batchable", "commutative"), _FLAG), reads=_TEXTS, writes=_TEXTS, timeout_ms=_COUNT, retry=_RETRY)
_TOOL = _object({"adapter": _TEXT}, effects=_EFFECTS, limits=_object({}, max_concurrency=_COUNT, batch_size=_COUNT), cost=_object({}, fixed_ms=_AMOUNT, per_call_ms=_AMOUNT, tokens=_AMOUNT), version=_TEXT)
_HEAD = {"name": _TEXT, "description": _TEXT, "tools": {"type": "object", "additionalProperties": _TOOL}, "outputs": {"type": "object", "additionalProperties": _TEXT}}
_WHEN = _object({"ref": _TEXT}, equals=True, **{"not": _FLAG})
_LIST = {"type": "array"}
#: JSON schemas of the documents that the front-ends take.
DOCUMENTS = {
    "plan": _object({"version": _TEXT}, **_HEAD, nodes=_LIST | {"items": _object({"id": _TEXT, "tool": _TEXT}, input=True, depends_on=_TEXTS, for_each=_TEXT, when=_WHEN)}),
    "intent": _object({"version": _TEXT}, **_HEAD, steps=_LIST | {"items": _object({"id": _TEXT, "tool": _TEXT}, input=True, after=_TEXTS)}),
    "recipe": _object({"version": _TEXT, "recipe": {"type": "object", "required": ["kind"], "properties": {"kind": {"enum": ["fan_out", "map_reduce", "pipeline"]}}}}, **_HEAD, params={"type": "object"}),
}


def check_document(kind: str, doc: Any) -> str | None:
    """What is wrong with a plan, intent or recipe by its schema, or None."""
    return _check(DOCUMENTS[kind], doc, kind)
