"""Analyses of call logs, cache logs and trace events."""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mine_runs(calls: DataFrame, least: int = 2) -> DataFrame:
    """(session, tool, start_index, occurrences, first_seq, last_seq): maximal runs of one tool; least is 2 or more.

    calls: session, seq, tool; start_index counts a session's calls from 0."""
    w = Window.partitionBy("session").orderBy("seq")
    changed = F.lag("tool").over(w).eqNullSafe(F.col("tool"))
    marked = calls.select("session", "seq", "tool", (F.row_number().over(w) - 1).alias("at"), F.when(changed, 0).otherwise(1).alias("new"))
    runs = marked.withColumn("run", F.sum("new").over(w))
    found = runs.groupBy("session", "run", "tool").agg(F.min("at").cast("bigint").alias("start_index"), F.count("*").alias("occurrences"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return found.where(F.col("occurrences") >= max(least, 2)).drop("run")


def cache_hits(calls: DataFrame, key: Sequence[str]) -> DataFrame:
    """calls (resource, seq, is_write, ...) with epoch and hit: a read hits if the same was read since the last write."""
    own = Window.partitionBy("resource").orderBy("seq")
    epoch = calls.withColumn("epoch", F.sum(F.col("is_write").cast("int")).over(own))
    nth = F.row_number().over(Window.partitionBy("resource", "is_write", "epoch", *key).orderBy("seq"))
    return epoch.withColumn("hit", ~F.col("is_write") & (nth > 1))


def invalidate(entries: DataFrame, written: DataFrame) -> DataFrame:
    """Cache entries (entry, reads) none of whose resources stands in written (resource)."""
    gone = entries.select("entry", F.explode("reads").alias("resource")).join(written, "resource", "left_semi")
    return entries.join(gone.select("entry").distinct(), "entry", "left_anti")


def single_flight(calls: DataFrame) -> DataFrame:
    """calls (key, start_ms, end_ms, id) with leader: the first call of the group whose times overlap in a chain."""
    w = Window.partitionBy("key").orderBy("start_ms", "id")
    upto = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = calls.withColumn("new", F.when(F.col("start_ms") < upto, 0).otherwise(1))
    flight = new.withColumn("flight", F.sum("new").over(w))
    return flight.withColumn("leader", F.first("id").over(Window.partitionBy("key", "flight").orderBy("start_ms", "id"))).drop("new")


def run_metrics(trace: DataFrame, by: str = "plan_id") -> DataFrame:
    """The counters of a run by trace status, and its status."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = trace.groupBy(by).agg(F.count_distinct("node").alias("nodes_total"), n("finished").alias("nodes_succeeded"), n("failed").alias("nodes_failed"), n("skipped").alias("nodes_skipped"), n("cache_hit").alias("cache_hits"), n("retried").alias("retries"))
    return out.withColumn("run_status", run_status(F.lit(False), F.col("nodes_failed")))


def run_status(cancelled: Column, errors: Column) -> Column:
    return F.when(cancelled, "cancelled").when(errors > 0, "failed").otherwise("success")


def replay_lru(log: DataFrame, capacity: int, ttl_ms: int | None = None) -> DataFrame:
    """log (cache, ts, key, resource, is_write) with hit, by the cache's own rules: an entry past ttl_ms from its insert
    misses, a hit renews recency alone, an insert evicts the least recent, a write drops its resource's entries.

    Inherently one after another, so a group is one cache's log."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["ts", "key"], kind="stable")
        held: OrderedDict[str, tuple[int, str]] = OrderedDict()
        of: defaultdict[str, set[str]] = defaultdict(set)  # a resource's entries
        hits = []

        def drop(key: str) -> None:
            of[held.pop(key)[1]].discard(key)

        for ts, key, resource, write in zip(own.ts, own.key, own.resource, own.is_write, strict=True):
            hit = False
            if write:
                for k in of.pop(resource, ()):
                    del held[k]
            else:
                if key in held and ttl_ms is not None and ts - held[key][0] > ttl_ms:
                    drop(key)
                hit = key in held
                if not hit:
                    held[key] = (ts, resource)
                    of[resource].add(key)
                    if len(held) > capacity:
                        drop(next(iter(held)))
                held.move_to_end(key)
            hits.append(hit)
        return own.assign(hit=hits)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    return log.groupBy("cache").applyInPandas(run, f"{schema}, hit boolean")
