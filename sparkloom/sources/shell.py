"""Processes as a tool: an argument list, never a shell's line; off unless bound."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from sparkloom.plans.ir import Effects, Tool
from sparkloom.sources.base import ToolError, field_of
from sparkloom.sources.files import Files, text_within

OUTPUT_CAP = 1 << 20


def environment(env: Mapping[str, str] | None = None, clear: bool = False, inherit: Sequence[str] = ()) -> dict[str, str]:
    """This process's environment, or of it only the names in `inherit`, and env over it."""
    own = {k: os.environ[k] for k in inherit if k in os.environ} if clear else dict(os.environ)
    return own | dict(env or {})


class Shell:
    """run {program, args?, stdin?, cwd?, timeout_ms?} -> {status, success, stdout, stderr}; outputs over the cap are cut
    and marked. The environment is `env`, by default a few names of this process's own."""

    def __init__(self, base: str | Path, programs: Sequence[str] | None = None, env: Mapping[str, str] | None = None, timeout_ms: int | None = None, cap: int = OUTPUT_CAP):
        self.files, self.programs, self.timeout_ms, self.cap = Files(base), programs, timeout_ms, cap
        self.env = environment(inherit=("PATH", "HOME", "LANG"), clear=True) if env is None else dict(env)

    def call(self, tool: str, input: Any) -> Any:
        if tool != "run":
            raise ToolError(f"unknown tool {tool!r}", "unknown_tool", False)
        program, args = field_of(input, "program", str), field_of(input, "args", list, [])
        if self.programs is not None and program not in self.programs:
            raise ToolError(f"{program!r} may not run", "blocked_program", False)
        if not all(isinstance(a, str) for a in args):
            raise ToolError("args must hold strings", "invalid_input", False)
        timeout = field_of(input, "timeout_ms", int, self.timeout_ms)
        try:
            done = subprocess.run([program, *args], input=field_of(input, "stdin", str, "").encode(), cwd=self.files.inside(field_of(input, "cwd", str, ".")), timeout=timeout and timeout / 1000, capture_output=True, env=self.env, check=False)
        except subprocess.TimeoutExpired as e:
            raise ToolError(f"{program!r} took longer than {timeout} ms", "timeout", True) from e
        except OSError as e:
            raise ToolError(str(e), "io", False) from e
        out: dict[str, Any] = {"status": done.returncode, "success": done.returncode == 0}
        for name, data in (("stdout", done.stdout), ("stderr", done.stderr)):
            out[name] = text_within(data, self.cap)
            if len(data) > self.cap:
                out[f"{name}_truncated"] = True
        return out


def run_tool() -> Tool:
    """All shell calls write one resource, so they run one after another."""
    return Tool("shell", Effects(writes=("shell:world",)))
