"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens (words) to the power alpha, normalised; alpha between 0 (all equal) and
1 (as they come) is bisected until the weights' entropy or the most repetitions of a source meet the target. A source
whose budget is e times its tokens and a rest goes through e whole epochs and the start of one more: its documents, in
the order of a seeded hash, up to the rest. An epoch runs over blocks of documents in an order drawn anew per epoch, and
through each block in an order drawn anew.

The order within a source is cut at one key, found by sums over blocks and then within one block, so no task holds a
source. Weights depend on sources' token counts alone, so the driver sees how many sources have each count (no more
different counts than the root of twice all tokens); sources themselves stay a table of any size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import few, settle, table, words

#: Documents in a block, about.
BLOCK = 2048
STEPS = 60
REPEATS = 2.0
SEED = 17


@dataclass(frozen=True)
class Share:
    source: str
    tokens: int
    weight: float
    budget: int


@dataclass(frozen=True)
class Temperature:
    """weight(tokens) of a source, and the tokens to draw altogether."""

    alpha: float
    total: int
    whole: float
    size: float

    def weight(self, tokens: int) -> float:
        return (tokens / self.total) ** self.alpha / self.whole if tokens else 0.0


def temperature(counts: Mapping[int, int], *, entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> Temperature:
    """counts: how many sources have so many tokens. Exactly one of entropy (bits) and repeats is given.

    budget None: the least budget in which each document occurs once or more. A target that no alpha in 0..1 meets gives the
    nearest end. Sources without tokens have weight 0."""
    if (entropy is None) == (repeats is None):
        raise ValueError("give entropy or repeats")
    have = sorted((t, n) for t, n in counts.items() if t)
    total = sum(t * n for t, n in have)
    if not total:
        return Temperature(1.0, 1, 1.0, 0.0)

    def at(alpha: float) -> Temperature:
        whole = math.fsum(n * (t / total) ** alpha for t, n in have)
        raw = Temperature(alpha, total, whole, 0.0)
        size = float(budget) if budget is not None else max(t / raw.weight(t) for t, _ in have)
        return Temperature(alpha, total, whole, size)

    def over(x: Temperature) -> bool:  # as alpha rises, entropy and repetitions fall
        if entropy is not None:
            return -math.fsum(n * x.weight(t) * math.log2(x.weight(t)) for t, n in have) > entropy
        return max(x.weight(t) * x.size / t for t, _ in have) > repeats

    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if over(at(mid)) else (low, mid)
    return at(round(high, 9))


def plan(sources: Mapping[str, int], **target) -> tuple[float, list[Share]]:
    """(alpha, shares by source name), with temperature()'s arguments."""
    t = temperature(Counter(sources.values()), **target)
    return t.alpha, [Share(k, n, t.weight(n), round(t.weight(n) * t.size)) for k, n in sorted(sources.items())]


def order_key(doc_id: Column, seed: int) -> Column:
    """A number below 2 ** 60."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("bigint")


def _block(key: Column, blocks: Column) -> Column:
    return F.shiftright(F.shiftright(key, 30) * blocks, 30)


def copies(df: DataFrame, **target) -> DataFrame:
    """df with _tokens (words of the text), _key (order in its source), _block and _copies (0 or more); columns of df with
    these names are replaced. Arguments as for packed_copies."""
    new = ("_tokens", "_key", "_block", "_copies")
    out = packed_copies(df, **target)
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in df.columns if c not in new], *new)


def _named(source: Column) -> Column:
    return F.coalesce(source.cast("string"), F.lit(""))


def packed_copies(df: DataFrame, source: str = "source", id: str = "doc_id", text: str = "text", *, seed: int = SEED, **target) -> DataFrame:
    """(_doc: df's row as a struct, _tokens, _key, _block, _copies). target: entropy, repeats and budget of temperature().

    Null sources count as '', null texts as without words. Ids are of any type; rows with the same id stand or fall
    together. A source without tokens is used once. An empty table gives an empty result.
    """
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"), _named(F.col(f"`{source}`")).alias("_source"), F.size(words(F.col(f"`{text}`"))).cast("bigint").alias("_tokens"), order_key(F.col(f"`{id}`"), seed).alias("_key"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("_id"))
    light = settle(keyed.select("_source", "_tokens", "_key", "_id"), "mix-tokens")
    totals = settle(light.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    t = temperature({r["tokens"]: r["n"] for r in totals.groupBy("tokens").agg(F.count("*").alias("n")).collect()}, **target)
    budget = F.round(F.pow(F.col("tokens") / F.lit(float(t.total)), F.lit(t.alpha)) / F.lit(t.whole) * F.lit(t.size)).cast("bigint")
    budgets = totals.withColumn("budget", F.when(F.col("tokens") > 0, budget))
    whole = lambda e, otherwise: F.coalesce(F.expr(e), F.lit(otherwise).cast("bigint"))
    targets = settle(budgets.select("_source", whole("budget div nullif(tokens, 0)", 1).alias("epochs"), whole("budget % nullif(tokens, 0)", 0).alias("rest"), F.ceil(F.col("docs") / BLOCK).alias("blocks")), "mix-targets")
    placed = light.join(few(targets), "_source").withColumn("b", _block(F.col("_key"), F.col("blocks")))
    sums = placed.groupBy("_source", "b", "rest").agg(F.sum("_tokens").alias("t"))
    sums = sums.withColumn("upto", F.sum("t").over(Window.partitionBy("_source").orderBy("b")))  # a row for each block
    split = sums.where("rest > 0 and upto > rest and upto - t <= rest").select("_source", "b", (F.col("rest") - (F.col("upto") - F.col("t"))).alias("left"))
    inside = placed.join(few(settle(split, "mix-blocks")), ["_source", "b"]).withColumn("upto", F.sum("_tokens").over(Window.partitionBy("_source", "b").orderBy("_key", "_id")))
    # the last key that the rest covers, in the block where it ends
    cut = inside.groupBy("_source").agg(F.max(F.when(F.col("upto") <= F.col("left"), F.struct("_key", "_id"))).alias("last"), F.min("b").alias("cut_block"))
    limits = settle(targets.join(cut, "_source", "left").select("_source", "epochs", "blocks", "cut_block", F.col("last._key").alias("cut_key"), F.col("last._id").alias("cut_id")), "mix-limits")
    block = _block(F.col("_key"), F.col("blocks"))
    upto = (F.col("_key") < F.col("cut_key")) | ((F.col("_key") == F.col("cut_key")) & (F.col("_id") <= F.col("cut_id")))
    more = F.coalesce((block < F.col("cut_block")) | ((block == F.col("cut_block")) & F.coalesce(upto, F.lit(False))), F.lit(False))
    return keyed.join(few(limits), "_source").select("_doc", "_tokens", "_key", block.alias("_block"), (F.col("epochs") + more.cast("bigint")).alias("_copies"))


def mix(df: DataFrame, **target) -> DataFrame:
    """df's rows, each as often as its source's weight asks; columns as in df. training_order() gives their order."""
    epochs = F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))
    out = packed_copies(df, **target).where("_copies > 0").select("_doc", F.explode(epochs).alias("_epoch"))
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in df.columns])


def drawn(source: Column, id: Column, epoch: Column, block: Column, seed: int) -> tuple[Column, Column]:
    """(block_order, doc_order): a block's place among its source's in an epoch, and a document's in its block."""
    number = lambda x, n: F.conv(F.substring(F.md5(x), 1, n), 16, 10).cast("bigint")
    blocks = F.concat_ws("/", F.lit(str(seed)), _named(source), epoch.cast("string"), block.cast("string"))
    return number(blocks, 8), number(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id.cast("string"), F.lit(""))), 15)


def training_order(df: DataFrame, source: str = "source", id: str = "doc_id", text: str = "text", seed: int = SEED) -> tuple[DataFrame, list[Column]]:
    """(df with further columns, columns to sort it by) for rows that mix() gave: the n-th row of an id and text is its n-th
    epoch. Epochs follow one another; in one, blocks of all sources are interleaved in the order drawn, and each block is
    run through in the order drawn for it. Rows without an id are all in the first epoch."""
    name = lambda x: max([*df.columns, x], key=len) + "_"
    epoch, block, first, second, nth, blocks = (name(x) + str(k) for k, x in enumerate(("epoch", "block", "first", "second", "nth", "blocks")))
    known = F.col(f"`{id}`").isNotNull()
    alone = F.when(known, F.lit(0).cast("bigint")).otherwise(F.monotonically_increasing_id())
    w = Window.partitionBy(F.col(f"`{id}`"), F.xxhash64(F.col(f"`{text}`")), F.col(nth)).orderBy(F.lit(0))
    out = df.withColumn(nth, alone).withColumn(epoch, F.when(known, F.row_number().over(w) - 1).otherwise(0).cast("bigint"))
    ids = df.select(_named(F.col(f"`{source}`")).alias(blocks + "of"), F.col(f"`{id}`").alias("i")).distinct()
    sizes = settle(ids.groupBy(blocks + "of").agg(F.ceil(F.count("*") / BLOCK).alias(blocks)), "mix-sizes")
    out = out.join(few(sizes), _named(F.col(f"`{source}`")) == F.col(blocks + "of"), "left")
    out = out.withColumn(block, _block(order_key(F.col(f"`{id}`"), seed), F.greatest(F.col(blocks), F.lit(1))))
    a, b = drawn(F.col(f"`{source}`"), F.col(f"`{id}`"), F.col(epoch), F.col(block), seed)
    out = out.withColumn(first, a).withColumn(second, b).drop(nth, blocks, blocks + "of", block)
    return out, [F.col(epoch), F.col(first), F.col(second)]


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each copy of each document: doc_id, source, n_tokens, epoch, block, block_order, doc_order.

    Training order is (epoch, block_order, doc_order)."""
    docs = copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), repeats=REPEATS).where("_copies > 0")
    docs = docs.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias("epoch"), F.col("_block").alias("block"))
    block_order, doc_order = drawn(F.col("source"), F.col("doc_id"), F.col("epoch"), F.col("block"), SEED)
    return docs.withColumns({"block_order": block_order, "doc_order": doc_order})


def oracle(source: str = "documents", columns: str = "doc_id, source, n_tokens, epoch, block, doc_order, block_order") -> str:
    """DuckDB's SQL for the rows of op5, or other columns, over the view `source`."""
    hexed = lambda x, n: f"('0x' || substr(md5({x}), 1, {n}))::BIGINT"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT d.*, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens,
    {hexed(f"'{SEED}/' || coalesce(doc_id::VARCHAR, '')", 15)} AS place, coalesce(d.source, '') AS s FROM {source} d
), totals AS (SELECT s, sum(n_tokens)::BIGINT AS t, count(*) AS docs, sum(sum(n_tokens)) OVER () AS whole FROM keyed GROUP BY s
), steps AS (
  SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT k + 1, CASE WHEN more THEN (low + high) / 2 ELSE low END, CASE WHEN more THEN high ELSE (low + high) / 2 END
  FROM (SELECT k, low, high, (SELECT max(pow(t / whole, (low + high) / 2) / t) / min(pow(t / whole, (low + high) / 2) / t) FROM totals WHERE t > 0) > {REPEATS} AS more FROM steps WHERE k < {STEPS})
), alpha AS (SELECT round(high, 9) AS a FROM steps WHERE k = {STEPS}
), weighed AS (SELECT s, t, docs, CASE WHEN t > 0 THEN pow(t / whole, a) / sum(CASE WHEN t > 0 THEN pow(t / whole, a) END) OVER () ELSE 0 END AS w FROM totals, alpha
), budgets AS (SELECT *, round(w * max(CASE WHEN t > 0 THEN t / w END) OVER ())::BIGINT AS budget FROM weighed
), targets AS (SELECT s, CASE WHEN t > 0 THEN budget // t ELSE 1 END AS epochs, CASE WHEN t > 0 THEN budget % t ELSE 0 END AS rest, CAST(ceil(docs / {BLOCK}.0) AS BIGINT) AS blocks FROM budgets
), placed AS (
  SELECT k.*, g.epochs, g.rest, ((k.place >> 30) * g.blocks) >> 30 AS block,
    sum(k.n_tokens) OVER (PARTITION BY k.s ORDER BY k.place, k.doc_id::VARCHAR RANGE UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN targets g USING (s)
), copied AS (SELECT *, unnest(range(0, epochs + (CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)))::BIGINT AS epoch FROM placed
), mixed AS (SELECT *, {hexed(f"'{SEED}/' || s || '/' || epoch::VARCHAR || '/' || block::VARCHAR", 8)} AS block_order, {hexed(f"'{SEED}/' || epoch::VARCHAR || '/' || coalesce(doc_id::VARCHAR, '')", 15)} AS doc_order FROM copied)
SELECT {columns} FROM mixed
"""


QUERIES = {"op5_mixing": op5_mixing}
ORACLES = {"op5_mixing": oracle()}
