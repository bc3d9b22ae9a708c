"""N-gram Jaccard join with Bayesian pruning (after the published BayesLSH).

Documents with one set of word shingles are copies, for which one representative stands. Representatives
meet in bands of their MinHash values (24 bands of 4: a pair of similarity 0.8 is missed with a chance of 3e-6). A
bucket's members are worked on together: values are compared a few at a time, and a pair is dropped once the posterior
chance that its similarity reaches the threshold is below TOLERANCE; the rest is decided exactly on the shingle sets.

Buckets with the same members are worked on once, and a pair counts in the first band that joins it. Large buckets are
dealt into chunks and worked on by pairs of chunks, so no task holds an unbounded group; what leaves a task is a
document's number of links and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import connected_components, few, settle, table, tidy, without_ids, words
from sparkloom.llm.decontaminate import runs

SHINGLE = 5
#: The similarity as a fraction.
OVER, UNDER = 4, 5
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
#: A chunk's shingles and members, about.
CHUNK_SHINGLES, CHUNK_MEMBERS = 1 << 18, 512
#: Pairs compared at once, and shingles and pairs whose bit sets are intersected at once.
STRIP, COLUMNS, PAIRS = 1 << 17, 1 << 12, 1 << 15


def _hashers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


_A, _B = _hashers()


def least_matches() -> list[int]:
    """For n = STEP, 2 * STEP, ...: the fewest equal values of n with which a pair stays.

    Under a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1), whose chance to exceed t is the
    chance of at most m successes in n + 1 trials of chance t."""
    t = OVER / UNDER
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        chance, m = 0.0, -1
        while chance < TOLERANCE:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def shingles(hashed: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of SHINGLE words in a row; a shorter text is one shingle, a text without words none."""
    return np.unique(runs(hashed, min(SHINGLE, len(hashed))))


def minhash(own: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    h = (own >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), 1 << 14):
        np.minimum(low, (h[None, k : k + (1 << 14)] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return ((low ^ (low >> np.uint32(15))) & np.uint32(0xFFFF)).astype(np.uint16)


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield flat[a:b]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sizes, bands = [], [], []
        for hashed in _texts(b.column(1)):
            own = shingles(hashed)
            keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            sizes.append(len(own))
            bands.append(minhash(own).view(np.int64) if len(own) else [])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), b.column(2)], names=["doc_id", "set_key", "size", "bands", "text_hash"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, set_key, words) of which the words' shingles have the key: rows of one id may have several texts."""
    for b in batches:
        own = [shingles(h) for h in _texts(b.column(2))]
        meant = [k for k, (s, key) in enumerate(zip(own, b.column(1).to_pylist(), strict=True)) if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == key]
        for lo in range(0, len(meant), 512):
            part = meant[lo : lo + 512]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(part)), pa.array([minhash(own[k]).tobytes() for k in part], pa.binary()), pa.array([own[k].tobytes() for k in part], pa.binary())], names=["rep", "values", "shingles"])


def _candidates(values: np.ndarray, left: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that stay after comparing all values, and whose first common band is `band`. left: 0 for all pairs, else
    the members of the first chunk, which are paired with the others alone."""
    least = least_matches()
    n, found = len(values), []
    rows = left or n - 1
    lo = 0
    while lo < rows:
        hi = min(rows, lo + max(1, STRIP // (n * STEP)))
        first = left or lo + 1
        same = (values[lo:hi, None, :STEP] == values[None, first:, :STEP]).sum(axis=2)
        i, j = np.nonzero(same >= least[0])
        i, j, m = i + lo, j + first, same[i, j]
        if not left:
            later = j > i
            i, j, m = i[later], j[later], m[later]
        for k, need in enumerate(least[1:], 1):
            m = m + (values[i, k * STEP : (k + 1) * STEP] == values[j, k * STEP : (k + 1) * STEP]).sum(axis=1)
            stays = m >= need
            i, j, m = i[stays], j[stays], m[stays]
        common = (values[i] == values[j]).reshape(-1, BANDS, ROWS).all(axis=2)
        here = common.any(axis=1) & (common.argmax(axis=1) == band)
        found.append((i[here], j[here]))
        lo = hi
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs reach the similarity, exactly: by bit sets over the shingles that two members or more have, COLUMNS of
    them at a time, so that memory depends on neither the shingles' number nor the pairs'."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    sizes = np.array([len(sets[k]) for k in used])
    _, inverse, counts = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(used)), sizes)[counts[inverse] > 1]
    place = (np.cumsum(counts > 1) - 1)[inverse[counts[inverse] > 1]]
    by = np.argsort(place, kind="stable")
    owner, place = owner[by], place[by]
    both = np.zeros(len(i), dtype=np.int64)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        lo, hi = np.searchsorted(place, [first, first + COLUMNS])
        bits = np.zeros((len(used), COLUMNS), dtype=bool)
        bits[owner[lo:hi], place[lo:hi] - first] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        some = packed.any(axis=1)
        here = np.flatnonzero(some[i] & some[j])
        for x in range(0, len(here), PAIRS):
            k = here[x : x + PAIRS]
            both[k] += np.bitwise_count(packed[i[k]] & packed[j[k]]).sum(axis=1, dtype=np.int64)
    return (OVER + UNDER) * both >= OVER * (sizes[i] + sizes[j])


def _unit(band: int, left: int, reps: np.ndarray, copies: np.ndarray, values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reps, the documents newly linked to each, the least rep that each is joined to)."""
    links, label = np.zeros(len(reps), dtype=np.int64), np.arange(len(reps))
    i, j = _candidates(values, left, band) if len(reps) > 1 else (label[:0], label[:0])
    if len(i):
        good = _similar(sets, i, j)
        i, j = i[good], j[good]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        while True:
            low = label.copy()
            np.minimum.at(low, i, label[j])
            np.minimum.at(low, j, label[i])
            low = low[low]
            if (low == label).all():
                break
            label = low
    return reps, links, reps[label]


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit and side; one unit is held at a time."""
    held: list[tuple] = []
    out: list[tuple] = []

    def done() -> None:
        left = sum(1 for r in held if r[2] == 0) if held[-1][2] == 1 else 0
        values = np.frombuffer(b"".join(r[5] for r in held), dtype=np.uint16).reshape(-1, VALUES)
        reps, links, label = _unit(held[0][1], left, np.array([r[3] for r in held]), np.array([r[4] for r in held]), values, [np.frombuffer(r[6], dtype=np.uint64) for r in held])
        some = links > 0
        if some.any():
            out.append((reps[some], label[some], links[some]))
        held.clear()

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["rep", "joined", "links"])
        out.clear()
        return made

    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and held[0][0] != row[0]:
                done()
            held.append(row)
        if len(out) > 1000:
            yield batch()
    if held:
        done()
    if out:
        yield batch()


def _units(reps: DataFrame) -> DataFrame:
    """(unit, band, side, rep): what is compared together; side 1 only in units of two chunks."""
    member = reps.select("rep", "size", F.posexplode("bands").alias("band", "key"))
    bucket = member.groupBy("band", "key").agg(F.count("*").alias("m"), F.sum("size").alias("load"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("m > 1")
    bucket = settle(bucket, "buckets")
    two = bucket.where("m = 2").select("band", F.array("lo", "hi").alias("members"), F.lit(None).cast("array<bigint>").alias("others"))
    chunks = F.greatest(F.ceil(F.col("load") / CHUNK_SHINGLES), F.ceil(F.col("m") / CHUNK_MEMBERS))
    many = bucket.where("m > 2").select("band", "key", chunks.cast("bigint").alias("chunks"))
    dealt = member.join(many, ["band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")))
    lists = dealt.groupBy("band", "key", "chunks", "chunk").agg(F.sort_array(F.collect_list("rep")).alias("members"))  # bounded by the chunk
    lists = settle(lists, "chunks")
    single = lists.select("band", "members", F.lit(None).cast("array<bigint>").alias("others"))
    split = lists.where("chunks > 1")
    cross = split.alias("a").join(split.alias("b"), ["band", "key"]).where("a.chunk < b.chunk").select("band", F.col("a.members").alias("members"), F.col("b.members").alias("others"))
    units = two.union(single).union(cross).where("size(members) > 1 or others is not null")
    units = units.groupBy("members", "others").agg(F.min("band").alias("band")).withColumn("unit", F.monotonically_increasing_id())
    units = settle(units, "units")
    side = lambda name, k: units.where(f"{name} is not null").select("unit", "band", F.lit(k).alias("side"), F.explode(name).alias("rep"))
    return side("members", 0).union(side("others", 1))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, copy_of, class_id, n_links) of every row.

    copy_of: the least id with the same shingles. class_id: the least id that links join to this one. n_links: the other
    rows of similarity OVER / UNDER or more, copies included. A text without words (null or empty) and a row without an
    id link to nothing. Ids are whole numbers. Each row counts for itself: rows of one id with one text are copies of each
    other, rows of one id with different texts are linked as their texts are.
    """
    return _classes(docs, id, text).select("doc_id", "copy_of", "class_id", "n_links")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _classes(docs: DataFrame, id: str, text: str) -> DataFrame:
    """The columns of near_duplicates, with text_hash and class_key (the same in a class, null for rows without links)."""
    hashed = F.transform(words(F.col("t")), lambda w: F.xxhash64(w))
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    sketch = source.select("doc_id", hashed.alias("h"), _text_hash(F.col("t")).alias("text_hash")).mapInArrow(tidy(_sketch), "doc_id bigint, set_key binary, size bigint, bands array<bigint>, text_hash bigint")
    sketch = settle(sketch, "sketches")
    # a set of shingles has a number, as rows of one id may have several sets
    reps = sketch.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = settle(reps.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    units = _units(reps)
    need = reps.join(few(settle(units.select("rep").distinct(), "needed")), "rep", "left_semi").select(F.col("least").alias("doc_id"), "set_key", "rep")
    need = few(settle(need, "needed-texts"))
    sets = source.join(need, "doc_id").select("rep", "set_key", hashed.alias("h")).mapInArrow(tidy(_sets), "rep bigint, values binary, shingles binary").dropDuplicates(["rep"])
    rows = units.join(reps.select("rep", "copies"), "rep").join(sets, "rep")
    rows = rows.repartition("unit").sortWithinPartitions("unit", "side", "rep").select("unit", "band", "side", "rep", "copies", "values", "shingles")
    links = settle(rows.mapInArrow(tidy(_work), "rep bigint, joined bigint, links bigint"), "links")
    joined = connected_components(links.select(F.col("rep").alias("a"), F.col("joined").alias("b"))).withColumnRenamed("node", "rep")
    joined = settle(joined.join(reps.select("rep", "least"), "rep"), "joined")
    joined = joined.join(joined.groupBy("component").agg(F.min("least").alias("class_id")), "component").select("rep", "component", "class_id")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("set_key", "rep", "least", "copies").join(joined, "rep", "left").join(counts, "rep", "left").where("copies > 1 or links is not null")
    known = known.select("set_key", F.col("least").alias("copy_of"), F.coalesce("class_id", "least").alias("class_id"), F.coalesce("component", "rep").alias("class_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"))
    # rows that link to nothing, among them those without words or id, are kept out of the join
    known = few(settle(known, "linked"))
    rows = sketch.select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(known, "set_key", "left")
    return rows.select("doc_id", "text_hash", "class_key", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, that of the least id; columns as they are. Rows without an id, and texts without
    words, stay; equal rows of one id and text stay once."""
    found = settle(_classes(docs, id, text), "classes")
    again = settle(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    gone = found.where("class_id <> doc_id").select("doc_id").distinct()
    if again.isEmpty():
        return without_ids(docs, gone, id)
    # rows of ids that occur more than once are told apart by their texts
    own = F.coalesce(F.concat(F.lit("c"), F.col("class_key")), F.concat_ws("/", F.lit("d"), "doc_id", "text_hash"))
    first = found.where("doc_id is not null").groupBy(own.alias("own")).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    stays = settle(first.select("first.*").join(few(again), "doc_id", "left_semi"), "first-texts")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("_doc"), F.col(f"`{id}`").cast("bigint").alias("doc_id"), _text_hash(F.col(f"`{text}`")).alias("text_hash"))
    odd = packed.join(few(stays), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("_doc.*")
    return without_ids(docs, gone.union(again).distinct(), id).union(odd)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, copy_of, class_id, n_links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_near_duplicates": op1_near_duplicates}
#: The same by comparing every two documents that share a shingle.
ORACLES = {"op1_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, least({SHINGLE}, len(w)) AS k, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)
), sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS key FROM sh GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT p.a, p.b FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b WHERE {OVER + UNDER} * p.c >= {OVER} * (x.n + y.n)
), reach AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT r.n, l.b FROM reach r JOIN links l ON l.a = r.m
), classes AS (SELECT n AS doc_id, min(m) AS class_id FROM reach GROUP BY n)
SELECT d.doc_id, CASE WHEN s.key IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY s.key) END AS copy_of, c.class_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d JOIN classes c USING (doc_id) LEFT JOIN sets s USING (doc_id)
"""}
