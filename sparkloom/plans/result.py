"""Results of a run, and their shaping: redaction and truncation."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

#: Fixed values, as in sparkloom.functions.values.
_NEEDLES = ("token", "password", "secret", "authorization", "api_key", "apikey", "access_key")
_MASK = "[redacted]"
_PREVIEW = 512


def compact(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


class KeyRedactor:
    """Masks values whose key contains a needle, in any case and at any depth (so `token` masks `max_tokens` too)."""

    def __init__(self, needles: Iterable[str] = _NEEDLES, mask: str = _MASK):
        self.needles, self.mask = tuple(n.lower() for n in needles), mask

    def __call__(self, value: Any) -> Any:
        if isinstance(value, list):
            return [self(v) for v in value]
        if not isinstance(value, dict):
            return value
        return {k: self.mask if any(n in k.lower() for n in self.needles) else self(v) for k, v in value.items()}


def truncate(value: Any, most: int) -> Any:
    text = compact(value)
    size = len(text.encode())
    return value if size <= most else {"$truncated": True, "bytes": size, "preview": text[: min(most, _PREVIEW)]}


def shape(value: Any, redactor: KeyRedactor | None, most: int | None) -> Any:
    if hasattr(value, "schema"):  # a table stays as it is
        return value
    value = redactor(value) if redactor else value
    return value if most is None else truncate(value, most)


def shape_json(text: str, redactor: KeyRedactor | None, most: int | None) -> str | None:
    """Shaped JSON text; null for text that isn't JSON."""
    try:
        return compact(shape(json.loads(text), redactor, most))
    except ValueError:
        return None


def now_ms() -> int:
    return time.time_ns() // 1_000_000


@dataclass
class TraceEvent:
    """status: started, finished, cache_hit, failed, retried or skipped."""

    node: str
    tool: str
    status: str
    at_ms: int = field(default_factory=now_ms)
    duration_ms: int | None = None
    error: str | None = None
    batch_id: int | None = None
    attempt: int | None = None


@dataclass
class Metrics:
    wall_ms: int = 0
    nodes_total: int = 0
    nodes_succeeded: int = 0
    nodes_failed: int = 0
    nodes_skipped: int = 0
    cache_hits: int = 0
    batch_dispatches: int = 0
    retries: int = 0


@dataclass
class RunResult:
    """status: success, failed or cancelled. Compact results leave node_outputs, trace and optimization empty."""

    status: str
    outputs: dict[str, Any]
    errors: dict[str, dict]
    skipped: dict[str, str]
    metrics: Metrics
    node_outputs: dict[str, Any] = field(default_factory=dict)
    trace: list[TraceEvent] = field(default_factory=list)
    optimization: dict | None = None

    def to_json(self) -> dict:
        return asdict(self)

    def summary(self) -> str:
        m = self.metrics
        return f"status={self.status} nodes={m.nodes_total} succeeded={m.nodes_succeeded} failed={m.nodes_failed} skipped={m.nodes_skipped} wall_ms={m.wall_ms}"
