"""Benchmark decontamination: every training passage queries an inverted index of test items, and hits are verified.

Items are indexed in segments of at most SEGMENT words; a document is cut into passages of two segments' length, each
sharing half with the next, so a segment that a document holds lies whole within one passage. A passage's BM25 score
for a segment is divided by the segment's score for itself, so one threshold serves all.

The search is a batched form of block-max WAND: its bounds are tested for many passages at once, without pivots. Terms whose greatest impacts together stay
below the threshold cannot make a hit and are set aside; the postings of the other terms name blocks of segments; a
block's greatest impacts over all the passage's terms bound its segments, and only in blocks whose bound reaches the
threshold are segments scored. Nothing above the threshold is lost. Verification compares word sequences around the
passage with the item's question (all but its last sentence) and answer (its last sentence).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sparkloom.llm.common import few, settle, table, tidy, without_ids

SEGMENT = 64
BLOCK = 8
K1, B = 1.2, 0.75
THRESHOLD = 0.6
#: Words in a row that count as shared, and the shares of a question's and an answer's runs that must be found.
RUN = 5
QUESTION, ANSWER = 0.6, 0.6
#: Bytes of items' texts in one index, which is sent to every task; more items are searched in parts, one after another.
INDEX_TEXT = 48 << 20
#: Cells of an impact table; beyond, postings are searched.
MOST_CELLS = 1 << 23
#: Words looked up at once, and passages searched at once, however long their text.
PIECE, AT_ONCE = 1 << 16, 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed_words(text: Column) -> Column:
    """xxhash64 of the text's words: runs of letters and digits, in lower case."""
    split = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(split, lambda w: F.xxhash64(w))


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n words in a row."""
    if n < 1 or len(words) < n:
        return np.empty(0, dtype=np.uint64)
    w = words.astype(np.int64).view(np.uint64)
    out = np.zeros(len(w) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ (w[k : k + len(out)] + _STEP * np.uint64(k + 1))) * _STEP
            out ^= out >> np.uint64(29)
    return out


def found_share(part: np.ndarray, words: np.ndarray) -> float:
    """The share of part's distinct runs that words have; 1 for an empty part."""
    n = min(RUN, len(part))
    own = np.unique(runs(part, n))
    return float(np.isin(own, runs(words, n)).mean()) if len(own) else 1.0


class Impacts:
    """Impacts by term and place (0 where there is no posting): a table if it is small, else a search in the postings."""

    def __init__(self, terms: int, places: int, term: np.ndarray, place: np.ndarray, impact: np.ndarray):
        self.places, self.table = max(places, 1), None
        self.keys, self.impact = term * self.places + place, impact
        if terms * self.places <= MOST_CELLS:
            self.table = np.zeros(terms * self.places)
            self.table[self.keys] = impact

    def at(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        ask = term * self.places + place
        if self.table is not None:
            return self.table[ask]
        at = np.minimum(np.searchsorted(self.keys, ask), len(self.keys) - 1)
        return np.where(self.keys[at] == ask, self.impact[at], 0.0)


def cut(words: np.ndarray) -> list[np.ndarray]:
    """Segments of at most SEGMENT words, of about one length."""
    return np.array_split(words, -(-len(words) // SEGMENT)) if len(words) else []


@dataclass
class Statistics:
    """How many segments all items have, their mean length, and in how many each of some terms occurs."""

    segments: int
    mean: float
    terms: np.ndarray  # sorted
    counts: np.ndarray

    def holders(self, terms: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.terms, terms)]


@dataclass
class Index:
    """Segments of items, their terms' impacts, and by block of segments the terms' greatest impacts."""

    ids: list
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    item: np.ndarray  # of each segment
    vocabulary: np.ndarray
    bitmap: np.ndarray
    block_start: np.ndarray  # postings by term: blocks
    block: np.ndarray
    most: np.ndarray  # a term's greatest impact
    by_seg: Impacts
    by_block: Impacts

    @classmethod
    def build(cls, ids: Sequence, questions: list[np.ndarray], answers: list[np.ndarray], whole: Statistics | None = None) -> Index:
        """whole: statistics of all items, where these are a part of them."""
        segments, item = [], []
        for k, (q, a) in enumerate(zip(questions, answers, strict=True)):
            own = cut(np.concatenate([q, a]))
            segments += own
            item += [k] * len(own)
        vocabulary = np.unique(np.concatenate(segments)) if segments else np.empty(0, dtype=np.int64)
        n, lengths = len(segments), np.array([len(s) for s in segments], dtype=float)
        of = np.repeat(np.arange(n), [len(s) for s in segments])
        term = np.searchsorted(vocabulary, np.concatenate(segments)) if segments else np.empty(0, dtype=np.int64)
        pair, tf = np.unique(term * max(n, 1) + of, return_counts=True)
        term, seg = np.divmod(pair, max(n, 1))
        df = np.bincount(term, minlength=len(vocabulary)) if whole is None else whole.holders(vocabulary)
        total, mean = (n, lengths.mean() if n else 1.0) if whole is None else (whole.segments, whole.mean)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[seg] / mean)) if n else np.empty(0)
        impact = impact / np.bincount(seg, impact, minlength=n)[seg] if n else impact
        starts = lambda t: np.searchsorted(t, np.arange(len(vocabulary) + 1))
        blocks = -(-n // BLOCK) or 1
        key = term * blocks + seg // BLOCK
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        greatest = np.maximum.reduceat(impact, heads) if len(key) else impact
        most = np.zeros(len(vocabulary))
        np.maximum.at(most, term, impact)
        bitmap = np.zeros(1 << 22, dtype=bool)
        bitmap[vocabulary & ((1 << 22) - 1)] = True
        return cls(list(ids), questions, answers, np.array(item, dtype=np.int64), vocabulary, bitmap, starts(term[heads]), seg[heads] // BLOCK, most, Impacts(len(vocabulary), n, term, seg, impact), Impacts(len(vocabulary), blocks, term[heads], seg[heads] // BLOCK, greatest))

    def terms(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of the words that the index knows."""
        at = np.flatnonzero(self.bitmap[words & ((1 << 22) - 1)])
        term = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[term] == words[at]
        return at[same], term[same]

    def search(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, segment, score) of all that reach THRESHOLD, from the passages' terms, repeated ones included."""
        floor = THRESHOLD - 1e-9
        n_terms = len(self.vocabulary)
        # passages whose bound, counting repeats, can't reach the threshold
        bound = np.bincount(passage, self.most[term])
        keep = bound[passage] >= floor
        key = np.unique(passage[keep] * n_terms + term[keep])
        passage, term = np.divmod(key, n_terms)
        order = np.lexsort((self.most[term], passage))
        passage, term = passage[order], term[order]
        upto = np.cumsum(self.most[term])
        first = np.r_[True, passage[1:] != passage[:-1]] if len(passage) else np.empty(0, dtype=bool)
        upto -= np.repeat((upto - self.most[term])[first], np.diff(np.r_[np.flatnonzero(first), len(passage)])) if len(passage) else 0
        heavy = upto >= floor  # the others together stay below the threshold
        blocks = int(self.block.max()) + 1 if len(self.block) else 1
        which, hit = _expand(self.block_start, term[heavy])
        pairs = np.unique(passage[heavy][which] * blocks + self.block[hit])
        p, b = np.divmod(pairs, blocks)
        if not len(p):
            return p, p, np.empty(0)
        start = np.searchsorted(passage, np.arange(int(passage[-1]) + 2))
        which, at = _expand(start, p)
        impact = self.by_block.at(term[at], b[which])
        good = np.bincount(which, impact, minlength=len(p)) >= floor
        p, b = p[good], b[good]
        last = np.minimum((b + 1) * BLOCK, len(self.item))
        sizes = last - b * BLOCK
        p, s = np.repeat(p, sizes), np.repeat(b * BLOCK - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        which, at = _expand(start, p)
        score = np.bincount(which, self.by_seg.at(term[at], s[which]), minlength=len(p))
        good = score >= floor
        return p[good], s[good], score[good]

    def leaks(self, words: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """(document, item, best score, question's share, answer's share) of verified items, for documents whose words
        lie one after another."""
        if not len(self.vocabulary):
            return
        doc_end = np.cumsum(lengths)
        doc_start = doc_end - lengths
        per_doc = np.maximum(1, -(-(lengths - SEGMENT) // SEGMENT))  # passages
        first = np.cumsum(per_doc) - per_doc
        at, term = self.terms(words)
        doc = np.searchsorted(doc_end, at, side="right")
        half = (at - doc_start[doc]) // SEGMENT
        one, two = first[doc] + half, first[doc] + half - 1
        in_one, in_two = half < per_doc[doc], half > 0
        passage = np.concatenate([one[in_one], two[in_two]])
        order = np.argsort(passage, kind="stable")
        passage, term = passage[order], np.concatenate([term[in_one], term[in_two]])[order]
        cuts = np.searchsorted(passage, np.arange(0, int(per_doc.sum()) + AT_ONCE, AT_ONCE))
        hits = [(self.search(passage[a:z] - k * AT_ONCE, term[a:z]), k * AT_ONCE) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
        p, s, score = (np.concatenate(x) for x in zip(*[(p + k, s, v) for (p, s, v), k in hits], strict=True)) if hits else (np.empty(0, dtype=np.int64),) * 3
        best: dict[tuple[int, int], list] = {}
        for x, k, v in zip(p.tolist(), self.item[s].tolist(), score.tolist(), strict=True):
            d = int(np.searchsorted(first, x, side="right")) - 1
            best.setdefault((d, k), []).append((v, x - int(first[d])))
        for (d, k), hits in sorted(best.items()):
            whole = len(self.questions[k]) + len(self.answers[k])
            shares = (0.0, 0.0)
            for _, h in hits:
                lo = max(int(doc_start[d]), int(doc_start[d]) + h * SEGMENT - whole)
                near = words[lo : min(int(doc_end[d]), int(doc_start[d]) + (h + 2) * SEGMENT + whole)]
                shares = max(shares, (found_share(self.questions[k], near), found_share(self.answers[k], near)), key=min)
            if shares[0] >= QUESTION and shares[1] >= ANSWER:
                yield d, k, max(v for v, _ in hits), *shares


def _expand(start: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `of` its range start[x]..start[x + 1]: (position in of, place)."""
    sizes = start[of + 1] - start[of]
    which = np.repeat(np.arange(len(of)), sizes)
    return which, np.repeat(start[of] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence or line, empty if there is but one."""
    parts = [p for p in re.split(r"(?<=[.!?…])\s+|\n+", text) if re.search(r"\w", p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _texts(items: DataFrame, id: str, text: str) -> DataFrame:
    """Distinct (i, t, part) of items with words, settled; parts hold INDEX_TEXT bytes, about."""
    rows = items.select(F.col(f"`{id}`").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).distinct()
    rows = settle(rows, "items")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, -(-size // INDEX_TEXT)))).cast("int"))


def _holders(rows: DataFrame) -> DataFrame:
    """(term, n, words): in how many segments of all items a term occurs; the row without a term counts segments and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = cut(b.column(0)[k].values.to_numpy(zero_copy_only=False)) if b.column(0)[k].is_valid else []
                if own:
                    terms, n = np.unique(np.concatenate([np.unique(s) for s in own]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([None, *terms.tolist()], pa.int64()), pa.array([len(own), *n.tolist()], pa.int64()), pa.array([sum(map(len, own)), *[0] * len(terms)], pa.int64())], names=["term", "n", "words"])

    counted = rows.select(hashed_words(F.col("t"))).mapInArrow(tidy(run), "term bigint, n bigint, words bigint")
    return settle(counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "item-terms")


def _index(rows: DataFrame, holders: DataFrame | None) -> Index:
    """The index of a part's rows (i, t). Items without words are left out."""
    spark = rows.sparkSession
    found = sorted(rows.select("i", "t").collect(), key=lambda r: (r["i"] is not None, r["i"], r["t"]))
    if not found:
        return Index.build([], [], [])
    q, a = zip(*[split_item(r["t"]) for r in found], strict=True)
    # by Arrow: rows given as a list would start further Python workers, which live on beside the operators' own
    halves = spark.createDataFrame(pa.table({"k": pa.array(range(len(found)), pa.int32()), "q": pa.array(q, pa.string()), "a": pa.array(a, pa.string())}))
    hashed = {r["k"]: (r["q"], r["a"]) for r in halves.select("k", hashed_words(F.col("q")).alias("q"), hashed_words(F.col("a")).alias("a")).collect()}
    some = [k for k in range(len(found)) if hashed[k][0] or hashed[k][1]]
    array = lambda k, side: np.array(hashed[k][side], dtype=np.int64)
    whole = None
    if holders is not None:
        total = holders.where("term is null").first()
        own = rows.select(F.explode(hashed_words(F.col("t"))).alias("term")).distinct()
        terms = sorted((r["term"], r["n"]) for r in holders.join(few(settle(own, "part-terms")), "term", "left_semi").collect())
        whole = Statistics(total["n"] if total else 0, total["words"] / total["n"] if total else 1.0, np.array([t for t, _ in terms], dtype=np.int64), np.array([n for _, n in terms], dtype=np.int64))
    return Index.build([found[k]["i"] for k in some], [array(k, 0) for k in some], [array(k, 1) for k in some], whole)


def find_leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), a row for each document and item that it holds.

    Null and empty texts hold nothing; repeated documents are judged each, repeats of an item's id and text count once; a null
    item id stays null. One pass over the documents, without a shuffle, for each INDEX_TEXT bytes of items: terms weigh as they
    do in all items, so the parts give what one index would."""
    rows = _texts(items, item_id, item_text)
    parts = sorted(r["part"] for r in rows.select("part").distinct().collect())
    holders = _holders(rows) if len(parts) > 1 else None
    kinds = docs.schema[id].dataType, items.schema[item_id].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, score double, question_overlap double, answer_overlap double"
    asked = docs.select(F.col(f"`{id}`").alias("doc_id"), hashed_words(F.col(f"`{text}`")).alias("w"))
    out = docs.sparkSession.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    for k in parts:
        sent = docs.sparkSession.sparkContext.broadcast(_index(rows.where(F.col("part") == k), holders))
        out = out.union(settle(asked.mapInArrow(tidy(_searching(sent, to_arrow_type(kinds[1]))), schema), "leaks"))
        sent.destroy()
    return out


def _searching(sent: Broadcast, item_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            column = b.column(1)
            offsets = column.offsets.to_numpy().astype(np.int64)
            flat, lo = column.values.to_numpy(zero_copy_only=False), 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1)
                found = list(index.leaks(flat[offsets[lo] : offsets[hi]], np.diff(offsets[lo : hi + 1])))
                if found:
                    d, k, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x + lo for x in d])), pa.array([index.ids[x] for x in k], item_kind), *[pa.array(x, pa.float64()) for x in rest]], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
                lo = hi

    return run


def without_leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id") -> DataFrame:
    """The documents that hold no item; columns as they are. A null id is never removed."""
    return without_ids(docs, find_leaks(docs, items, id).select("doc_id").distinct(), id)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's verified benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES: dict[str, str] = {}
