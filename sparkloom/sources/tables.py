"""Tables as tools: node outputs are lazy DataFrames, references are lineage, and Catalyst plans the whole.

A reference into a DataFrame (`orders.output.o_custkey`) selects that column.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.values import template
from sparkloom.plans.ir import Effects, Tool
from sparkloom.sources.base import ToolError, field_of

_AGGREGATES = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg, "count_distinct": F.count_distinct}


def _frame(input: Any, name: str = "frame") -> DataFrame:
    found = input.get(name) if isinstance(input, dict) else None
    if not isinstance(found, DataFrame):
        raise ToolError(f"{name} must be a table", "invalid_input", False)
    return found


class Tables:
    """scan {path, columns?}, filter {frame, where}, project {frame, columns: {name: expression}}, join {left, right, on,
    how?}, reduce {frame, by, aggregates: {name: [function, column]}}, label {frame, template, as}, union {frames},
    write {frame, path}."""

    def __init__(self, spark: SparkSession, root: str = ""):
        self.spark, self.root = spark, root

    def call(self, tool: str, input: Any) -> Any:
        run = getattr(self, f"_{tool}", None)
        if run is None:
            raise ToolError(f"unknown tool {tool!r}", "unknown_tool", False)
        return run(input)

    def _path(self, input: Any) -> str:
        path = field_of(input, "path", str)
        return f"{self.root}/{path}" if self.root and "://" not in path and not path.startswith("/") else path

    def _scan(self, input: Any) -> DataFrame:
        out = self.spark.read.format(input.get("format", "parquet")).load(self._path(input))
        return out.select(*input["columns"]) if input.get("columns") else out

    def _filter(self, input: Any) -> DataFrame:
        return _frame(input).where(field_of(input, "where", str))

    def _project(self, input: Any) -> DataFrame:
        return _frame(input).select(*[F.expr(e).alias(n) for n, e in field_of(input, "columns", dict).items()])

    def _join(self, input: Any) -> DataFrame:
        left, right, on = _frame(input, "left"), _frame(input, "right"), field_of(input, "on", dict)
        cond = [left[a] == right[b] for a, b in on.items()]
        return left.join(right, cond, input.get("how", "inner"))

    def _reduce(self, input: Any) -> DataFrame:
        columns = []
        for name, (fn, column) in field_of(input, "aggregates", dict).items():
            if fn not in _AGGREGATES:
                raise ToolError(f"unknown aggregate {fn!r}", "invalid_input", False)
            columns.append(_AGGREGATES[fn](F.col(column) if column != "*" else F.lit(1)).alias(name))
        return _frame(input).groupBy(*field_of(input, "by", list)).agg(*columns)

    def _label(self, input: Any) -> DataFrame:
        frame = _frame(input)
        text, _ = template(field_of(input, "template", str), {c: F.col(c) for c in frame.columns})
        return frame.withColumn(field_of(input, "as", str), text)

    def _union(self, input: Any) -> DataFrame:
        first, *rest = field_of(input, "frames", list)
        for f in rest:
            first = first.unionByName(f)
        return first

    def _write(self, input: Any) -> dict:
        _frame(input).write.mode("overwrite").format(input.get("format", "parquet")).save(self._path(input))
        return {"path": input["path"], "written": True}


def table_tools() -> dict[str, Tool]:
    pure = Tool("tables", Effects(pure=True, idempotent=True, cacheable=True, commutative=True))
    read = Tool("tables", Effects(reads=("table:{path}",), idempotent=True, cacheable=True))
    write = Tool("tables", Effects(writes=("table:{path}",), idempotent=True))
    return {"scan": read, "write": write} | {k: pure for k in ("filter", "project", "join", "reduce", "label", "union")}
