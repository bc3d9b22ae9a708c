"""What the operators of this package share: inputs, the shared folder, words, connected components."""

from __future__ import annotations

import ctypes
import gc
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.settling import shared_dir

#: White space between words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch while a table is settled, so that two Python workers an executor stay small.
ARROW_BATCH = "4m"


@contextmanager
def small_batches(spark: SparkSession, size: str) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame, name: str, batch: str = ARROW_BATCH) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession, batch):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Functions whose last value a worker keeps from task to task.
_KEPT: list = []


def kept(make: Callable) -> Callable:
    """make, whose last value a worker keeps for the tasks of stages that name it to tidy(); other stages let it go."""
    _KEPT.append(lru_cache(maxsize=1)(make))
    return _KEPT[-1]


def trim() -> None:
    """Freed memory goes back to the system."""
    with suppress(OSError, AttributeError):  # the C library may have no such call
        ctypes.CDLL(None).malloc_trim(0)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


def let_go(uses: Sequence[Callable]) -> None:
    """Drops what this worker keeps for other stages."""
    others = [c for c in _KEPT if c not in uses and c.cache_info().currsize]
    for c in others:
        c.cache_clear()
    if others:
        give_back()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *uses: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker gives freed memory back: workers live on between stages, and what they
    hold counts against their executor. uses: the functions of kept() whose values the worker needs in its next task too."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(uses)
        yield from run(batches)
        give_back()

    return tidied


#: Ids that a join broadcasts; beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """ids (settled rows of a number or two), marked for broadcast if there are at most MOST_BROADCAST."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def without_ids(docs: DataFrame, ids: DataFrame, id: str) -> DataFrame:
    """docs without the rows whose id stands in ids (one column); columns as they are, null ids stay."""
    name = max([*docs.columns, "_gone"], key=len) + "_"  # a name that docs doesn't have
    gone = settle(ids.select(F.col(ids.columns[0]).alias(name)), "ids")
    return docs.join(few(gone), F.col(f"`{id}`") == F.col(f"`{name}`"), "left_anti")


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def listed(spark: SparkSession, rows: list[tuple], columns: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Rows that the driver has, as a relation of one literal."""
    kind = ", ".join(f"`{c}`: {k}" for c, k in zip(columns, kinds, strict=True))
    packed = json.dumps([dict(zip(columns, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(packed), f"array<struct<{kind}>>")))


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): component is the least node that edges (a, b) join to node; only nodes of edges occur.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a groupBy and a join, so that a hub's
    neighbours are never gathered; each round is settled in the shared folder. Rounds grow as the logarithm of the
    component's diameter.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = settle(pairs, "components")
    for _ in range(rounds):
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.union(low.where("low < u").select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = small.union(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        settled = settle(small, "components")
        same = settled.count() == pairs.count() and settled.exceptAll(pairs).isEmpty()
        pairs = settled
        if same:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    least = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return least.select(F.col("u").alias("node"), "component").union(
        least.select(F.col("component").alias("node"), "component").distinct()
    )
