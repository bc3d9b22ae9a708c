"""Suggestions from an observed list of calls: runs of one tool that a fan-out could replace."""

from __future__ import annotations

from itertools import groupby
from typing import Any

from sparkloom.plans.ir import PlanError, members


def suggest(calls: list[Any], least: int = 2) -> list[dict]:
    """For each run of `least` (2 at least) or more calls of one tool in a row: where, how many, and their inputs."""
    rows = [members(c, "call", ("tool",), ("input",)) for c in calls]
    if not all(isinstance(r["tool"], str) for r in rows):
        raise PlanError("invalid_field", "call.tool must be str")
    out, at = [], 0
    for tool, own in groupby(rows, key=lambda r: r["tool"]):
        items = [r.get("input", {}) for r in own]
        if len(items) >= max(2, least):
            out.append({"kind": "fan_out", "tool": tool, "start_index": at, "occurrences": len(items), "items": items})
        at += len(items)
    return out
