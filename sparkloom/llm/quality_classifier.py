"""Quality by compression: two zstandard dictionaries, from good and from bad labelled texts.

A text is cut into blocks, each compressed against either dictionary; the difference of the summed sizes, normalised,
alone becomes a score, through a logistic curve fitted on training rows that no dictionary was trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import table, tidy
from sparkloom.llm.labelled import class_weights, fold, logistic, sigmoid, training_rows

PER_CLASS = 2500
DICTIONARY = 48 * 1024
BLOCK = 1024
LEVEL = 1
THRESHOLD = 0.7


def _dictionary(texts: list[bytes]) -> bytes | None:
    """A dictionary trained on blocks of the texts, smaller where they are few; None where they are too few for any."""
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, blocks)) // 8), blocks, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


@dataclass
class Compressors:
    """Compressed sizes of texts against the two dictionaries."""

    good: bytes
    bad: bytes
    tools: list = field(default_factory=list)

    def sizes(self, text: bytes) -> tuple[int, int]:
        if not self.tools:
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        good, bad = self.tools
        view = memoryview(text)
        blocks = [view[i : i + BLOCK] for i in range(0, len(view), BLOCK)]
        return sum(len(good(b)) for b in blocks), sum(len(bad(b)) for b in blocks)

    def difference(self, text: bytes) -> float:
        """How much smaller the good dictionary makes a text than the bad one does, normalised; 0 for an empty text."""
        if not text:
            return 0.0
        g, b = self.sizes(text)
        return 10 * (b - g) / (b + g)


@dataclass
class Model:
    """The two dictionaries, or none, and the curve: a factor for the difference, and what stands without one."""

    good: bytes | None
    bad: bytes | None
    factor: float
    base: float

    def scorer(self):
        if self.good is None or self.bad is None:
            return lambda texts: np.full(len(texts), sigmoid(np.array(self.base)))
        c = Compressors(self.good, self.bad)
        return lambda texts: sigmoid(self.factor * np.array([c.difference(t) for t in texts], dtype=float) + self.base)


def train(texts: list[bytes], labels: list[int], rate: float) -> Model:
    """Dictionaries from one half of the rows, the curve from the other half, on which no dictionary was fitted. Where a
    class has too few texts for a dictionary or for the curve, the model says the share `rate` for every text."""
    y = np.array(labels, dtype=float)
    half = np.arange(len(texts)) % 2 == 0
    good, bad = (_dictionary([t for t, k, h in zip(texts, labels, half, strict=True) if k == label and h]) for label in (1, 0))
    if good is None or bad is None or len(set(y[~half])) < 2:
        p = min(max(rate, 0.01), 0.99)
        return Model(None, None, 0.0, float(np.log(p / (1 - p))))
    c = Compressors(good, bad)
    x = np.array([[c.difference(t)] for t, h in zip(texts, half, strict=True) if not h])
    factor, base = logistic(x, y[~half], class_weights(y[~half], rate))
    return Model(good, bad, float(factor), float(base))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """(doc_id, name) of every row, repeated ones too; null and empty texts get the score of no difference. Other columns of
    docs, whatever their names, are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in batches:
            texts = [t.as_buffer() if t.is_valid else b"" for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(texts), pa.float64())], names=["doc_id", name])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(f"`{text}`").cast("binary")).mapInArrow(tidy(run), f"doc_id {kind}, {name} double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    out = fold(F.col("doc_id"), 4) == 2
    rows = training_rows(docs, labels, "quality", out, PER_CLASS, [F.col("text").cast("binary").alias("t")])
    rate = labels.where(~out & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    model = train(rows["t"].to_pylist(), rows["_y"].to_pylist(), 0.5 if rate is None else float(rate))
    s = score(docs, model)
    return s.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLES: dict[str, str] = {}
