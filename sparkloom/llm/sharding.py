"""Sharding by a permutation-filled lookup table (after the published Maglev load balancer).

The shards take turns; at its turn a shard claims the first slot of its own preference order that is still free. The
table has a prime number of slots, so that (offset + i * skip) mod size runs through all of them. A key is hashed to a
slot, and the broadcast table gives the slot's shard in constant time. Removing a shard moves few other keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import MOST_BROADCAST, listed, table

#: Slots in a row of the lookup table as it is sent to Spark.
SLOTS_A_ROW = 4096
SHARDS = 32
SLOTS = 4099


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(shards: Sequence[str], size: int) -> list[int]:
    """The shard number of each slot. ValueError unless size is a prime of at least len(shards), and no shard twice."""
    if not shards or size < max(3, len(shards)) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table needs a prime number of slots, no fewer than shards")
    if len(set(shards)) < len(shards):
        raise ValueError("a shard is named twice")
    slots = [-1] * size
    at = [_number(f"{s}:offset") % size for s in shards]
    skip = [_number(f"{s}:skip") % (size - 1) + 1 for s in shards]
    for turn in range(size):
        k = turn % len(shards)
        while slots[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % size
        slots[at[k]] = k
    return slots


def slot_of(keys: Sequence[Column], size: int) -> Column:
    """A key's slot, from the md5 of its columns as text; null counts as the empty string."""
    text = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(size).cast("bigint"))


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], size: int, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with the columns slot (long) and shard (name). Null keys count as empty text; equal keys always share a shard.

    An empty table gives an empty result. Columns of df with the new ones' names are replaced. Names may hold any
    character. A table of more than MOST_BROADCAST slots is joined without a broadcast.
    """
    spark = df.sparkSession
    names = listed(spark, list(enumerate(shards)), ["n", shard], ["int", "string"])
    filled = fill(shards, size)
    parts = [(lo, filled[lo : lo + SLOTS_A_ROW]) for lo in range(0, size, SLOTS_A_ROW)]
    rows = listed(spark, parts, ["first", "part"], ["bigint", "array<int>"]).select("first", F.posexplode("part").alias("k", "n"))
    lookup = rows.join(F.broadcast(names), "n").select((F.col("first") + F.col("k")).alias(slot), shard)
    lookup = F.broadcast(lookup) if size <= MOST_BROADCAST else lookup
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (slot, shard)]
    out = df.select(*rest, slot_of([F.col(f"`{k}`") for k in keys], size).alias(slot))
    return out.join(lookup, slot, "left").select(*rest, slot, shard)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, ["doc_id"], shard_names(SHARDS), SLOTS)


def _oracle() -> str:
    hexed = lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
    return f"""
WITH RECURSIVE shards AS (
  SELECT k, 'shard-' || lpad(k::VARCHAR, 4, '0') AS name FROM range({SHARDS}) t(k)
), prefs AS (
  SELECT list({hexed("name || ':offset'")} % {SLOTS} ORDER BY k) AS start,
         list({hexed("name || ':skip'")} % {SLOTS - 1} + 1 ORDER BY k) AS skip FROM shards
), turns AS (
  SELECT 0 AS turn, repeat('0', {SLOTS})::BIT AS taken, (SELECT list(0 ORDER BY k) FROM shards) AS next, NULL::BIGINT AS slot, NULL::BIGINT AS shard
  UNION ALL
  SELECT turn + 1, set_bit(taken, ((o + i * s) % {SLOTS})::INT, 1),
         list_concat(next[:k], [i + 1], next[k + 2:]), (o + i * s) % {SLOTS}, k
  FROM (
    SELECT turn, taken, next, k, o, s,
           list_filter(range(next[k + 1]::BIGINT, {SLOTS}::BIGINT), lambda x: get_bit(taken, ((o + x * s) % {SLOTS})::INT) = 0)[1] AS i
    FROM (SELECT t.turn, t.taken, t.next, t.turn % {SHARDS} AS k, p.start[t.turn % {SHARDS} + 1] AS o, p.skip[t.turn % {SHARDS} + 1] AS s
          FROM turns t, prefs p WHERE t.turn < {SLOTS})
  )
)
SELECT d.doc_id, {hexed("d.doc_id::VARCHAR")} % {SLOTS} AS slot, 'shard-' || lpad(t.shard::VARCHAR, 4, '0') AS shard
FROM documents d JOIN turns t ON t.slot = {hexed("d.doc_id::VARCHAR")} % {SLOTS}
"""


QUERIES = {"op8_sharding": op8_sharding}
ORACLES = {"op8_sharding": _oracle()}
