"""Trace events appended to a folder as JSON lines, and read as a stream with running metrics per window."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.result import TraceEvent

SCHEMA = "plan_id string, node string, tool string, status string, at_ms bigint, duration_ms bigint, error string, batch_id bigint, attempt int"


class TraceFolder:
    """An on_event callback: collects a run's events and drops them as one file, by rename, when flushed."""

    def __init__(self, folder: str, plan_id: str):
        self.folder, self.plan_id, self.events, self.lock = Path(folder), plan_id, [], threading.Lock()
        self.folder.mkdir(parents=True, exist_ok=True)

    def __call__(self, event: TraceEvent) -> None:
        with self.lock:
            self.events.append({"plan_id": self.plan_id} | asdict(event))

    def flush(self) -> None:
        with self.lock:
            own, self.events = self.events, []
        if own:
            part = self.folder / f".{uuid.uuid4().hex}"
            part.write_text("".join(json.dumps(e) + "\n" for e in own))
            part.rename(self.folder / f"trace-{part.name[1:]}.json")


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder).withColumn("ts", F.timestamp_millis("at_ms"))


def windowed_metrics(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts by status per window and tool; rows later than `late` are dropped, and the window's state with them."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window), "tool")
    return counts.agg(*map(n, ("started", "finished", "failed", "retried", "skipped", "cache_hit")), F.max("duration_ms").alias("longest_ms"))
