"""Each operator against a brute-force version on small tables, with nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import compare
import numpy as np
import pyarrow as pa
import pytest
import tokenizers
import zstandard
from pyspark.sql import functions as F

from sparkloom.llm import (
    common, decontaminate, labelled, mixing, near_duplicates, quality_classifier, quality_rules, registry, sharding, suffix_dedup,
    token_output, toxicity, urls,
)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPLIT = re.compile(r"[\x20\x09-\x0d]+")
#: Columns that have the names of the operators' own.
EXTRA = ["score", "t", "h", "rep", "kept", "class_id", "_w", "block", "bands", "shard_x", "path_", "words"]


def table(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    return df.withColumns({c: F.lit(1) for c in EXTRA}) if extra else df


def words(t):
    return [w for w in SPLIT.split(t or "") if w]


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", ["op1_near_duplicates", "op3_suffix_dedup", "op4_quality_rules", "op5_mixing", "op8_sharding", "op10_url_filters"])
def test_oracle(name, spark, sf):
    compare.same(registry.queries()[name](spark, sf).toPandas(), compare.views(sf).sql(registry.oracle_sql()[name]).df())


def test_ten_operators():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))


ODD = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "x " * 30_000, "b"), (4, "x " * 30_000, "b"), (5, "same words here again and again.", "b"), (6, "same words here again and again.", "c"), (None, "lost id of a text.", "c"), (7, "\n\t \x0b", "c"), (8, "日本語 текст é" * 20, "c")]


# --- 1 ----------------------------------------------------------------------------------------------------------


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    ids = sorted(sets)
    links = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in sorted(links):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    n = collections.Counter(x for pair in links for x in pair)
    return {i: (find(i), n[i]) for i in ids}


def varied(rng, n=90):
    bases = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.choice([3, 6, 60, 200]))] for _ in range(5)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("members", [2048, 3])
def test_near_duplicates(spark, monkeypatch, members):
    monkeypatch.setattr(near_duplicates, "CHUNK_MEMBERS", members)  # small chunks: the way of large groups
    rows = varied(random.Random(7))
    got = near_duplicates.near_duplicates(table(spark, [(i, t, "s") for i, t in rows], extra=True)).toPandas()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got.itertuples()} == brute_links(rows)


def test_near_duplicates_of_odd_rows(spark):
    got = near_duplicates.near_duplicates(table(spark, ODD, extra=True)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[6].class_id == 5 and by[6].n_links == 1 and by[1].class_id == 1 and by[2].n_links == 0 and by[None].class_id is None and by[7].n_links == 0
    assert near_duplicates.near_duplicates(table(spark, [])).count() == 0
    kept = near_duplicates.one_of_each(table(spark, ODD, extra=True))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, None])) and kept.columns[:2] == ["doc_id", "text"]


def test_near_duplicates_of_repeated_ids(spark):
    """As if each row had an id of its own."""
    rng = random.Random(5)
    v, w = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(60)) for _ in range(2))
    rows = [(1, w), (1, v), (2, w + " z"), (3, v + " z"), (3, v + " z"), (1, "alone it stands here now"), (0, v + " y"), (5, None), (5, None), (None, w)]
    got = near_duplicates.near_duplicates(table(spark, [(i, t, "s") for i, t in rows])).collect()
    sets = [near_duplicates.shingles(np.array([hash(x) for x in words(t)], dtype=np.int64)) if t else [] for _, t in rows]
    links = {(a, b) for a in range(9) for b in range(9) if a != b and len(sets[a]) and len(sets[b]) and 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))}
    component = {k: {k} for k in range(10)}
    for _ in range(10):
        for a, b in links:
            component[a] = component[b] = component[a] | component[b]
    want = [(i, min((rows[x][0] for x in component[k] if rows[x][0] is not None), default=None), sum(a == k for a, _ in links)) for k, (i, _) in enumerate(rows)]
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == sorted(want, key=str)
    kept = near_duplicates.one_of_each(table(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, w), (0, v + " y"), (1, "alone it stands here now"), (5, None), (None, w)], key=str)


def test_a_unit_is_worked_on_in_bounded_memory(monkeypatch):
    """Two whole chunks whose shingles are shared in pairs."""
    import tracemalloc

    n = 2 * near_duplicates.CHUNK_MEMBERS
    size = 2 * near_duplicates.CHUNK_SHINGLES // n
    sets = [np.sort(np.arange(size, dtype=np.uint64) + np.uint64(size * (k // 2)) + np.uint64((k % 2) * size // 20)) for k in range(n)]
    i, j = np.triu_indices(n, 1)
    some = (j - i < 40)
    i, j = i[some], j[some]
    tracemalloc.start()
    got = near_duplicates._similar(sets, i, j)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    want = [9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * 2 * size for a, b in zip(i[:500], j[:500], strict=True)]
    assert got[:500].tolist() == want and got.sum() == ((j == i + 1) & (i % 2 == 0)).sum()


def test_pruning_keeps_pairs_at_the_threshold():
    least = near_duplicates.least_matches()
    assert len(least) == near_duplicates.VALUES // near_duplicates.STEP
    rng = np.random.default_rng(1)
    lost = 0
    for _ in range(2000):
        same = rng.random(near_duplicates.VALUES) < 0.8
        lost += any(same[: (k + 1) * near_duplicates.STEP].sum() < m for k, m in enumerate(least))
    assert lost <= 1


def test_bands_meet_pairs_at_the_threshold():
    """Of 3,000 pairs of similarity 0.8 all meet in a band."""
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(3000):
        own = rng.integers(0, 1 << 63, 90, dtype=np.int64).view(np.uint64)
        a, b = (near_duplicates.minhash(np.sort(x)).reshape(near_duplicates.BANDS, -1) for x in (own[:81], np.r_[own[:72], own[81:]]))  # 72 of 90 in common
        lost += not (a == b).all(axis=1).any()
    assert lost <= 1


# --- 2 ----------------------------------------------------------------------------------------------------------


def plain(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def test_decontamination_finds_all_planted_items(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(900)] + ["the", "of", "and"] * 60
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, f"{text(rng.choice([10, 30, 90, 200]))}. {text(rng.choice([3, 8, 20]))}.") for k in range(40)]
    rows, planted = [], set()
    for i in range(120):
        t = text(rng.choice([5, 100, 700]))
        if i % 3 == 0:
            k = rng.randrange(len(items))
            planted.add((i, k))
            t = f"{t}\n{items[k][1].upper() if i % 2 else items[k][1]} {text(40)}"
        if i % 10 == 1:  # a question without its answer is no leak
            t += " " + items[0][1].split(".")[0]
        rows.append((i, t, "s"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_leaks(table(spark, rows, extra=True), bench).toPandas()
    assert set(zip(got.doc_id, got.item_id, strict=True)) == planted
    left = decontaminate.without_leaks(table(spark, rows, extra=True), bench)
    assert {r.doc_id for r in left.collect()} == set(range(120)) - {d for d, _ in planted}


@pytest.mark.parametrize("cells", [1 << 23, 0])
def test_search_loses_nothing_above_the_threshold(monkeypatch, cells):
    """Block-max WAND against scores of every passage and segment."""
    monkeypatch.setattr(decontaminate, "MOST_CELLS", cells)
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 60, rng.integers(3, 150)).astype(np.int64) for _ in range(37)]
    index = decontaminate.Index.build(range(37), items, [np.empty(0, dtype=np.int64)] * 37)
    docs = [np.concatenate([rng.integers(0, 90, 120), items[k % 37]]).astype(np.int64) for k in range(30)]
    passage, term, n = [], [], 0
    want = set()
    dense = np.zeros((len(index.vocabulary), len(index.item)))
    for t in range(len(index.vocabulary)):
        dense[t] = index.by_seg.at(np.full(len(index.item), t), np.arange(len(index.item)))
    for d in docs:
        for lo in range(0, max(1, len(d) - decontaminate.SEGMENT), decontaminate.SEGMENT):
            _, own = index.terms(d[lo : lo + 2 * decontaminate.SEGMENT])
            passage += [n] * len(own)
            term += own.tolist()
            score = dense[np.unique(own)].sum(axis=0)
            want |= {(n, int(s)) for s in np.flatnonzero(score >= decontaminate.THRESHOLD)}
            n += 1
    p, s, _ = index.search(np.array(passage), np.array(term))
    assert set(zip(p.tolist(), s.tolist(), strict=True)) == want and want


def test_items_in_parts_are_found_as_in_one_index(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([12, 30, 900]))) + ". So it is " + " ".join(rng.choices(vocabulary, k=6)) + ".") for k in range(30)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=50)) + " " + (rng.choice(items)[1] if k % 3 else "") + " tail") for k in range(60)]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items * 2, "item_id bigint, text string")
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in decontaminate.find_leaks(*frames).collect())
    want = found()
    assert len(want) >= 40
    monkeypatch.setattr(decontaminate, "INDEX_TEXT", 8000)
    assert found() == want


def test_impacts_are_bm25s():
    rng = np.random.default_rng(4)
    items = [rng.integers(0, 40, n) for n in (5, 64, 20, 33)]
    index = decontaminate.Index.build(range(4), items, [np.empty(0, dtype=np.int64)] * 4)
    mean = np.mean([len(x) for x in items])
    for k, own in enumerate(items):
        raw = {}
        for w in set(own.tolist()):
            df, tf = sum(w in x for x in items), (own == w).sum()
            raw[w] = np.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
        for w, v in raw.items():
            at = np.searchsorted(index.vocabulary, [w])
            assert abs(index.by_seg.at(at, np.array([k]))[0] - v / sum(raw.values())) < 1e-12


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "same words here again and again."), (2, None), (3, ""), (None, "x x x"), (1, "same words here again and again.")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table(spark, ODD, extra=True), bench).collect()}
    assert {(5, 1), (6, 1)} <= got and (4, None) in got and not {d for d, _ in got} & {1, 2, 3, 7}
    assert decontaminate.find_leaks(table(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(table(spark, ODD), bench.where("false")).count() == 0
    assert decontaminate.without_leaks(table(spark, ODD), bench.where("false")).count() == len(ODD)


# --- 3 ----------------------------------------------------------------------------------------------------------


def brute_cut(rows, n=50):
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - n + 1):
            first.setdefault(t[i : i + n], d)
    out = {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "piece", "partitions"), [(50_000, 1 << 21, 8192), (3, 1 << 21, 2), (50_000, 90, 8192)])
def test_suffix_dedup(spark, monkeypatch, hot, piece, partitions):
    for name, value in {"HOT": hot, "PIECE": piece, "MOST_PARTITIONS": partitions, "TEXT_PER_BUCKET": 2000, "WINDOWS_PER_BUCKET": 20_000}.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(hot + piece)
    base = ["".join(rng.choice("ab é") for _ in range(250)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [b[(a := rng.randrange(150)) : a + rng.randrange(10, 140)] for b in rng.choices(base, k=rng.randrange(5))]
        rows.append((i, "ab" * rng.randrange(10, 80) if i % 11 == 0 else "".join(parts)))
    got = suffix_dedup.remove_repeats(table(spark, [(i, t, "s") for i, t in rows], extra=True).repartition(3), with_text=True).toPandas()
    want = brute_cut([(i, t.encode()) for i, t in rows])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()} == want
    assert len(got) == 80 and all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.itertuples())


@pytest.mark.parametrize(("piece", "hot"), [(1 << 21, False), (120, False), (1 << 21, True), (120, True)])
def test_suffix_dedup_decides_by_sorting(monkeypatch, piece, hot):
    """The steps in this process: with the sort all repeats are found, without its groups none."""
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(400)).encode()
    texts = [shared[i * 10 : 300 + i * 10] + f" tail {i}".encode() for i in range(10)]

    def found():
        spans = {}
        sent = []
        for lo in (0, 5):
            own = texts[lo : lo + 5]
            hashes = [np.unique(np.concatenate([suffix_dedup._hash_of(suffix_dedup._windows(f, s)[0]) for f, _, s, _ in suffix_dedup._pieces(pa.array([t]))])) for t in own]
            batch = pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 5)), pa.array([0] * 5), pa.array(own), pa.array([h.tolist() for h in hashes]), pa.array([h.tolist() if hot else [] for h in hashes], pa.list_(pa.int64()))], names=list("abcde"))
            sent += list(suffix_dedup._contexts(3)(iter([batch])))
        for _ in range(2 if hot else 1):
            rows = pa.Table.from_batches(sent).sort_by("bucket").to_batches() if sent else []
            sent = []
            for b in suffix_dedup._repeats(3)(iter(rows)):
                for r in b.to_pylist():
                    if r["block"] is None:
                        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
                    else:
                        sent.append(pa.RecordBatch.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([r["kind"]], pa.int32()), pa.array([r["block"]], pa.binary())], names=["bucket", "kind", "block"]))
        return {d: len(set().union(*(range(*x) for x in own))) for d, own in spans.items()}

    assert found() == {d: n for d, (_, n, *_) in brute_cut(list(enumerate(texts))).items() if n}
    monkeypatch.setattr(suffix_dedup, "sort_suffixes", lambda data, starts: (np.arange(len(starts)), np.arange(len(starts))))
    assert found() == {}


def test_suffix_dedup_of_odd_rows(spark):
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(table(spark, ODD, extra=True)).collect()}
    assert {(1, 0, 0), (2, 0, 0), (4, 60_000, 0), (5, 32, 0), (6, 32, 0)} <= got
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0
    twice = [(1, "z" * 49, "s"), (2, "z" * 49, "s"), (3, "y" * 50, "s"), (4, "y" * 50, "s"), (None, "y" * 60, "s")]
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(table(spark, twice)).collect()} == {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 50, 1), (None, 0, 0)}


def test_suffix_dedup_of_repeated_ids(spark):
    a, b = "".join(map(str, range(60))), "".join(chr(97 + k * k % 26) for k in range(80))
    rows = [(1, a, "s"), (1, b, "s"), (1, b, "s"), (2, "x" + a, "s"), (2, b + "y" + a[:50], "s"), (2, "x" + a, "s"), (2, "z" * 70, "s")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept) for r in suffix_dedup.remove_repeats(table(spark, rows), with_text=True).collect())
    want = [(1, len(a), 0, a), (1, len(b), 0, b), (1, len(b), 0, b), (2, len(a) + 1, len(a), "x"), (2, len(a) + 1, len(a), "x"), (2, len(b) + 51, len(b) + 50, "y"), (2, 70, 0, "z" * 70)]
    assert got == sorted((i, n, k, t.encode()) for i, n, k, t in want)


def test_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 99, 3000), np.tile(rng.integers(97, 123, 70), 9)]).astype(np.uint8)
    starts = rng.permutation(len(data) - suffix_dedup.LENGTH)
    order, group = suffix_dedup.sort_suffixes(data, starts)
    raw = data.tobytes()
    found = [raw[starts[k] : starts[k] + suffix_dedup.LENGTH] for k in order]
    assert found == sorted(found)
    assert [a == b for a, b in zip(found, found[1:], strict=False)] == (group[1:] == group[:-1]).tolist()


def test_blind_tries_order_strings():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(10)) for _ in range(300)]
    trie = suffix_dedup.BlindTrie(strings[0], 0)
    for k, s in enumerate(strings[1:], 1):
        trie.insert(s, k)
    leaves = [[strings[k] for k in leaf] for leaf in trie.leaves()]
    assert [x[0] for x in leaves] == sorted(set(strings)) and all(len(set(x)) == 1 for x in leaves) and sum(map(len, leaves)) == 300


# --- 4 ----------------------------------------------------------------------------------------------------------


def test_quality_rules_of_odd_rows(spark):
    compare_rows = [(i, t, s) for i, t, s in ODD] + [(20, "a b c d e f g h i. " * 3, "s"), (21, "\n".join(["A good line of words that ends well."] * 2 + ["x | y | z | q", "all rights reserved."]), "s")]
    df = table(spark, compare_rows, extra=False)
    got = quality_rules.measure(df).select("doc_id", *quality_rules.COLUMNS).toPandas()
    c = compare.views("/root/testdata/sf0.001")
    c.register("odd", df.toPandas())
    compare.same(got, c.sql(quality_rules.oracle("odd")).df())
    clash = quality_rules.measure(table(spark, ODD, extra=True)).select("doc_id", *quality_rules.COLUMNS, "score")
    assert clash.schema["kept"].dataType.simpleString() == "boolean" and clash.count() == len(ODD)
    assert quality_rules.measure(table(spark, [])).count() == 0


def test_words_of_boilerplate_in_prose_are_no_fault(spark):
    prose = ["She baked one cookie for each of the three children.", "They argued whether the copyright act applies to a song.", "He would subscribe to no theory of his own age.", "The dialog in the play and its design in blue are fine."]
    stock = ["Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Home » News » Sport » More.", "See www.a.org and http://b.org now.", "Read more.", "This work is licensed under the GNU General Public License, version 3."]
    rows = [(k, x, "s") for k, x in enumerate(prose + stock)]
    got = {r.doc_id: len(r.good_lines) for r in quality_rules.measure(table(spark, rows, extra=True)).collect()}
    assert got == {k: int(k < len(prose)) for k in range(len(rows))}


def test_cleaning_keeps_good_lines(spark):
    good = "\n".join(" ".join(f"word{k}x{j}" for j in range(9)) + "." for k in range(5))
    bad = good + "\nHome | About | Help | Login\nAll rights reserved."
    rows = [(1, good, "s"), (2, bad, "s"), (3, "BUY NOW!! " * 40, "s"), (4, None, "s")]
    clean = quality_rules.clean_documents(table(spark, rows, extra=True))
    assert clean.columns[5:] == EXTRA and all(r.kept == 1 and r._w == 1 for r in clean.collect())
    got = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert got == {1: (good, len(good)), 2: (good, len(good))}


# --- 5 ----------------------------------------------------------------------------------------------------------


def test_temperature_meets_targets():
    sources = {"a": 1000, "b": 100, "c": 10, "empty": 0}
    alpha, shares = mixing.plan(sources, repeats=3.0)
    by = {s.source: s for s in shares}
    assert by["a"].budget == 1000 and by["c"].budget == 30 and 0 < alpha < 1 and by["empty"].budget == 0
    alpha, shares = mixing.plan(sources, entropy=1.2)
    assert abs(-sum(s.weight * np.log2(s.weight) for s in shares if s.weight) - 1.2) < 1e-6
    assert mixing.plan(sources, entropy=9.0)[0] == 0 and mixing.plan(sources, entropy=0.0)[0] == 1
    assert mixing.plan(sources, repeats=2.0, budget=111)[1][0].budget <= 111
    with pytest.raises(ValueError, match="give"):
        mixing.plan(sources)


@pytest.mark.parametrize("budget", [None, 700, 9000])
def test_mixing_realises_budgets(spark, monkeypatch, budget):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice("aaaaab")) for i in range(150)]
    got = mixing.copies(table(spark, rows, extra=False), repeats=2.0, budget=budget).toPandas()
    _, shares = mixing.plan({s: sum(len(words(t)) for _, t, x in rows if x == s) for s in "ab"}, repeats=2.0, budget=budget)
    for s in shares:
        own = got[got.source == s.source].sort_values("_key")
        full, rest = divmod(s.budget, s.tokens)
        upto = own._tokens.cumsum()
        assert own._copies.tolist() == [full + int(0 < rest and u <= rest) for u in upto]
        assert s.budget - own._tokens.max() < (own._copies * own._tokens).sum() <= s.budget


def test_mixing_of_odd_rows(spark):
    got = mixing.mix(table(spark, ODD, extra=True).withColumn("_copies", F.lit("own")), repeats=2.0)
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")] + [*EXTRA, "_copies"] and {r._copies for r in got.collect()} == {"own"} and got.select("doc_id").distinct().count() == 9
    assert mixing.mix(table(spark, []), repeats=2.0).count() == 0
    assert mixing.mix(table(spark, [(1, "", "a"), (2, None, None)]), repeats=2.0).count() == 2
    named = spark.createDataFrame([(f"id{k}", "w " * (k + 1), "ab"[k % 4 == 0]) for k in range(40)], "doc_id string, text string, source string")
    assert mixing.mix(named, repeats=2.0, budget=600).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_training_order_is_the_mixed_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    docs = table(spark, [(k, "w " * (k % 7 + 1), "ab"[k % 5 == 0]) for k in range(60)])
    made = mixing.copies(docs, repeats=3.0).where("_copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
    a, b = mixing.drawn(F.col("source"), F.col("doc_id"), F.col("epoch"), F.col("_block"), mixing.SEED)
    want = [r.doc_id for r in made.sort("epoch", a, b).collect()]
    rows, order = mixing.training_order(mixing.mix(docs, repeats=3.0))
    got = [r.doc_id for r in rows.sort(*order).collect()]
    assert got == want and len(got) > 60 and all(x != y for x, y in zip(got, got[1:], strict=False))
    first, second = got[:60], [x for x in got[60:]]
    assert sorted(first) == list(range(60)) and [x for x in first if x in set(second)] != second  # drawn anew
    odd, by = mixing.training_order(table(spark, ODD, extra=True))
    assert odd.sort(*by).count() == len(ODD)


# --- 6, 7 -------------------------------------------------------------------------------------------------------


def labelled_table(spark, kind, n=700):
    rng = random.Random(9)
    clean = [f"{a}{b}" for a in "bcdfgklm" for b in ("an", "er", "ito", "us", "ela")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(clean) for _ in range(rng.randrange(10, 120))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3 if kind == "toxic" else len(w)):
                w[rng.randrange(len(w))] = rng.choice(["vilewordish", "vilewordful"]) if kind == "toxic" else rng.choice(["###", "$$$&&&", "BUY!!", "%%%"])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, int(not bad), int(bad)))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


class Folder:
    def __init__(self, spark, tmp_path, docs, labels):
        self.path = f"{tmp_path}/t"
        docs.write.parquet(f"{self.path}/documents.parquet")
        labels.write.parquet(f"{self.path}/labels.parquet")


@pytest.mark.parametrize(("kind", "query", "n", "out", "least"), [("toxic", toxicity.op6_toxicity, 5, 0, 0.95), ("quality", quality_classifier.op7_quality_classifier, 4, 2, 0.95)])
def test_classifiers_on_held_out_rows(spark, tmp_path, kind, query, n, out, least):
    docs, labels = labelled_table(spark, kind)
    odd = table(spark, [(1000 + k, t, s) for k, (_, t, s) in enumerate(ODD)])
    f = Folder(spark, tmp_path, docs.union(odd), labels)
    got = query(spark, f.path).toPandas()
    assert len(got) == 700 + len(ODD) and got.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == out) for r in got.itertuples())
    limit = 0.5 if kind == "toxic" else 0.7
    assert (got.predicted == (got.score >= limit).astype(int)).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert len(held) > 80 and (held.predicted == held[kind]).mean() >= least
    assert got[got.doc_id.isin([1000, 1001])].score.nunique() == 1


def test_a_capped_class_keeps_its_rate(spark, tmp_path, monkeypatch):
    """Labels without a word that tells: the scores are the rate of all labelled rows, however few of a class are trained on."""
    rng = random.Random(3)
    docs = table(spark, [(i, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(12)), "s") for i in range(600)])
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(600)], "doc_id bigint, quality int, toxic int")
    f = Folder(spark, tmp_path, docs, labels)
    monkeypatch.setattr(toxicity, "PER_CLASS", 40)
    got = toxicity.op6_toxicity(spark, f.path).toPandas()
    assert got.score.mean() < 0.25 and got.predicted.mean() < 0.1


def test_compression_scores_are_a_curve_of_the_difference(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    vocabulary = [[word("abcde") for _ in range(60)], [word("vwxyz") for _ in range(60)]]
    texts = [" ".join(rng.choice(vocabulary[k % 2]) for _ in range(300)).encode() for k in range(120)]
    y = [k % 2 for k in (x // 2 for x in range(120))]
    texts = [t for _, t in sorted(zip(range(120), texts), key=lambda p: (p[0] // 4, p[0] % 2))]
    labels = [int(t[:1] in b"vwxyz") for t in texts]
    model = quality_classifier.train(texts, labels, 0.5)
    tools = [zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    rows = [(k, t.decode(), "s") for k, t in enumerate(texts)] + [(500, None, "s"), (501, "", "s"), (501, "", "s")]
    docs = table(spark, rows, extra=True).withColumn("name", F.lit(1))
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    for k, t in enumerate(texts):
        good, bad = (sum(len(c.compress(t[i : i + quality_classifier.BLOCK])) for i in range(0, len(t), quality_classifier.BLOCK)) for c in tools)
        want = 1 / (1 + np.exp(-(model.factor * 10 * (bad - good) / (bad + good) + model.base)))
        assert abs(got[k] - want) < 1e-9 and (got[k] > 0.5) == bool(labels[k])
    assert got[500] == got[501] and len(y) == 120
    assert quality_classifier.train([b"too", b"few"], [0, 1], 0.3).scorer()([b"x"]).tolist() == pytest.approx([0.3])


def test_ids_labelled_both_ways_are_not_trained_on(spark, monkeypatch):
    docs = table(spark, [(k, "some words here", "s") for k in range(20)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20)] + [(3, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = labelled.training_rows(docs, labels, "toxic", F.lit(False), 100, ["text"]).to_pylist()
    assert sorted(r["doc_id"] for r in rows) == [k for k in range(20) if k != 3]
    monkeypatch.setattr(labelled, "BYTES_PER_CLASS", 60)
    rows = labelled.training_rows(docs, labels, "toxic", F.lit(False), 100, ["text"]).to_pylist()
    assert collections.Counter(r["_y"] for r in rows) == {0: 4, 1: 4}


def test_toxicity_keeps_callers_columns(spark):
    model = toxicity.train([np.ones((3, toxicity.PARTS), dtype=np.int32)] * 20, [k % 2 for k in range(20)], ["en"] * 20, 0.5)
    got = toxicity.score(table(spark, ODD, extra=True).withColumns({"_words": F.lit(7), "words_": F.lit(8)}), model)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", *[c for c in EXTRA if c != "score"], "_words", "words_", "score"]
    assert {(r._words, r.words_) for r in got.collect()} == {(7, 8)}


def test_threshold_of_weighted_rows():
    """Where a clean row stands for ten, the best threshold leaves it out."""
    y, s = np.array([1, 1, 1, 1, 0, 0, 0, 0.0]), np.array([0.8, 0.8, 0.4, 0.4, 0.5, 0.2, 0.2, 0.2])
    assert toxicity.calibrate(s, y, [""] * 8, labelled.class_weights(y, 0.5))[""] == 0.4
    assert toxicity.calibrate(s, y, [""] * 8, labelled.class_weights(y, 4 / 44))[""] == 0.8


def test_classifiers_without_labels(spark, tmp_path):
    f = Folder(spark, tmp_path, table(spark, ODD), spark.createDataFrame([(1, None, None)], "doc_id bigint, quality int, toxic int"))
    for query in (toxicity.op6_toxicity, quality_classifier.op7_quality_classifier):
        assert query(spark, f.path).count() == len(ODD)


def test_pooling_over_pieces(monkeypatch):
    """Long texts scored in pieces get the score of the whole."""
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, toxicity.BUCKETS, (n, toxicity.PARTS)).astype(np.int32) for n in (0, 1, 2, 3, 50, 400, 7)]
    m = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)), 0.1, {})
    tokens, lengths = np.concatenate(docs), np.array([len(d) for d in docs])
    whole = m.scores(tokens, lengths, m.table())
    monkeypatch.setattr(toxicity, "PIECE", 16)
    assert np.allclose(whole, m.scores(tokens, lengths, m.table()), atol=1e-5)
    v = m.embedding[docs[4]].sum(axis=1)
    best = np.concatenate([sum(v[j : len(v) - w + 1 + j] @ f[j] for j in range(w)).max(axis=0) for w, f in zip(toxicity.WIDTHS, m.filters, strict=True)])
    assert np.isclose(whole[4], labelled.sigmoid(np.tanh(best) @ m.out + m.bias), atol=1e-4)


def test_training_is_bounded_and_avoids_held_out_rows(spark):
    docs, labels = labelled_table(spark, "toxic")
    got = labelled.training_rows(docs, labels, "toxic", labelled.fold(F.col("doc_id"), 5) == 0, 40, [F.col("text")])
    assert collections.Counter(got["_y"].to_pylist()) == {0: 40, 1: 40}
    assert all(zlib.crc32(str(d).encode()) % 5 for d in got["doc_id"].to_pylist())


# --- 8 ----------------------------------------------------------------------------------------------------------


def test_sharding_is_even_and_stable(spark):
    full, fewer = sharding.fill(sharding.shard_names(16), 4099), sharding.fill(sharding.shard_names(15), 4099)
    counts = collections.Counter(full)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(full, fewer, strict=True) if a != 15)
    assert moved < 0.1 * 4099
    for bad in ((["a"], 4), ([], 7), (list("abcdefghi"), 7)):
        with pytest.raises(ValueError, match="slots"):
            sharding.fill(*bad)


def test_sharding_of_odd_rows(spark):
    got = sharding.assign_shards(table(spark, ODD, extra=True), ["doc_id", "source"], ["a", "b"], 11).collect()
    assert len(got) == len(ODD) and {r.shard for r in got} <= {"a", "b"} and len({r.slot for r in got if r.doc_id == 4}) == 1
    assert sharding.assign_shards(table(spark, []), ["doc_id"], ["a"], 3).count() == 0
    names = ["eu,west", "us", "a\"b\\c", "é"]
    assert {r.shard for r in sharding.assign_shards(spark.range(200), ["id"], names, 101).collect()} == set(names)
    with pytest.raises(ValueError, match="twice"):
        sharding.fill(["a", "a"], 11)
    clash = sharding.assign_shards(table(spark, ODD).withColumn("slot", F.lit(77)).withColumn("shard", F.lit(1)), ["doc_id", "slot"], ["a"], 3)
    assert {(r.shard, r.slot < 3) for r in clash.collect()} == {("a", True)}


# --- 9 ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return token_output.Encoder(token_output.default_tokenizer())


def test_encoding_is_the_librarys(encoder, corpus):
    odd = ["", " ", "  ", "a  b", "a   b", "a \nb", "a\n b", "x  ", "x \n", "x\n\n", "\n\n\ny", " x", "it's o'sull  <|endoftext|> 12.5!! ...", "\x00 a", "a\x1fb c", "\u00a0a b\u00a0c", "日本語 текст", "é.È, x!y", "a\t b\r\nc", "WORD!! wörd&&& |"]
    for texts in (odd, corpus.text.tolist()):
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in encoder.encode(texts)] == want
        assert [encoder.encode([t])[0].tolist() for t in texts] == want


def test_white_space_after_line_ends_and_nul(encoder):
    """Runs of white space that begin with a line's end, of any characters, and a NUL where a piece begins."""
    spaces = ["\t", "\u00a0", "\u2003", "\u3000", "\r", "\x0b", "\x85"]
    texts = [f"a{s}b" for s in ("\n\u00a0\u00a0", "\n\x00", "\x00", "\n\x00\x00", " \x00")]
    texts += ["\x00b", "\x00", "\x00\x00b", "\x00\nb", "\n\x00"]
    texts += [f"{a}{line}{x}{y}{b}" for a in ("", "a") for line in ("", "\n", "\n\n") for x in spaces for y in ("", " ", *spaces) for b in ("", "b", " b", ".")]
    got = [x.tolist() for x in encoder.encode(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [encoder.encode([t])[0].tolist() for t in texts] == got


def test_added_tokens_are_found_as_by_a_fresh_tokenizer(encoder, corpus):
    fresh = tokenizers.Tokenizer.from_file(token_output.default_tokenizer())
    texts = ["<|endoftext|>", "x <|endoftext|> y", "a\n<|endoftext|>\nb", "word<|endoftext|><|endoftext|>.", "<|endoftext", *corpus.text.head(50)]
    got = [x.tolist() for x in encoder.encode(texts)]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [50256]


def test_forgetting_changes_nothing(monkeypatch, corpus, encoder):
    monkeypatch.setattr(token_output, "MOST_KNOWN", 50)
    e = token_output.Encoder(token_output.default_tokenizer())
    for t in corpus.text[:60]:
        assert e.encode([t])[0].tolist() == encoder.encode([t])[0].tolist()


def test_token_files(spark, sf, corpus, encoder, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "FRAME_BYTES", 4096)
    rows = [(r.doc_id, r.text, "s") for r in corpus.itertuples()] + [(10_000, None, "s"), (10_001, "", "s"), (10_001, "twice", "s"), (-5, "first of all", "s"), (None, "no id", "s")]
    docs = table(spark, rows, extra=True).repartition(5)
    manifest = token_output.write_tokens(docs, f"file://{tmp_path}/tokens")
    got = token_output.read_tokens(manifest).toPandas().sort_values("start")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert [None if i != i else i for i in got.doc_id] == [i for i, _, _ in order]
    at = 0
    for r in got.itertuples():
        assert r.start == at
        at += r.n_tokens
    want = collections.Counter((i, len(ids := encoder.encode([t or ""])[0].tolist() + [2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, _ in rows)
    assert collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_tokens, r.ids_crc32) for r in got.itertuples()) == want
    assert token_output.token_digest(spark, table(spark, [])).count() == 0


def test_readers_decompress_one_frame_and_check_it(tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "FRAME_BYTES", 100)
    path = tmp_path / "f.zst"
    with path.open("wb") as f:
        w = token_output.Writer(f, wide=False)
        for k in range(100):
            w.add(k, np.arange(k, dtype=np.uint32))
        w.close()
    r = token_output.open_reader(str(path))
    assert len(r.frames) > 20
    read, whole = [], r.source.read_at
    r.source.read_at = lambda n, at: read.append(n) or whole(n, at)
    assert [x.tolist() for x in r.find(70)] == [list(range(70))] and len(read) == 1 and r.find(1000) == []
    import zstandard

    data = path.read_bytes()
    assert len(zstandard.ZstdDecompressor().decompressobj().decompress(data)) == r.frames[0].content  # plain zstd reads it too
    bad = bytearray(data)
    bad[r.frames[3].at + 12] ^= 0xFF
    path.write_bytes(bad)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_output.open_reader(str(path)).documents(r.frames[3]))


# --- 10 ---------------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.COM/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "http://b.com/en/": ("b.com", "/en/", "com/en/", "block"),
        "https://example.net/de/81#f": ("example.net", "/de/81", "example.net/de/8", "block"), "https://x.net/de/1": ("x.net", "/de/1", "net/de/", "allow"),
        "http://notcom/en/": ("notcom", "/en/", None, "allow"), "no scheme": ("", "", None, "allow"), "x://h?://q/en/": ("h", "", None, "allow"), "a://": ("", "", None, "allow"),
        "http://É.ORG/es/": ("É.org", "/es/", "org/es/", "block"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(cases)], "page_id bigint, url string, html string").withColumn("kind", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, mass=10).collect()}
    assert list(cases.values()) == [got[k] for k in range(len(cases))]
    assert urls.filter_urls(df.where("false"), mass=10).count() == 0


def test_distrust_flows_against_links(spark):
    page = lambda h, *to: (f"http://{h}/x", "".join(f'<a HREF="https://{t}/y">' for t in to))
    rows = [page("spam.example.org", "good.net"), page("friend.org", "spam.example.org", "//x"), page("good.net", "fine.org"), page("fine.org"), page("alone.org"), page("www.friend.org")]
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)] + [(99, "http://good.net/de/1", None)], "page_id bigint, url string, html string")
    got = {r.host: r.verdict for r in urls.filter_urls(df, blocked=["spam.example.org"], mass=10**3).where("page_id < 99").collect()}
    assert got == {"spam.example.org": "block", "friend.org": "block", "www.friend.org": "block", "good.net": "allow", "fine.org": "allow", "alone.org": "allow"}


def test_domains_without_pages_are_in_the_graph(spark):
    """A link to a blocked domain that is no page's host, and seeds for any top-level domain."""
    rows = [("http://m.bad.example.org/x", None), ("http://friend.org/x", '<a href="http://bad.example.org/">'), ("http://fine.net/x", None), ("http://10.0.0.1/x", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id bigint, url string, html string")
    edges = {tuple(r) for r in urls.host_edges(df.select(urls.host_and_path(F.col("url"))[0].alias("host"), "html")).collect()}
    both = {("m.bad.example.org", "bad.example.org"), ("bad.example.org", "example.org")}
    assert edges == both | {e[::-1] for e in both} | {("friend.org", "bad.example.org")}
    for seed in ("bad.example.org", "bad.example.*"):
        got = {r.host: r.verdict for r in urls.filter_urls(df, blocked=[seed], mass=10**4).collect()}
        assert got == {"m.bad.example.org": "block", "friend.org": "block", "fine.net": "allow", "10.0.0.1": "allow"}


def test_names_in_pages_are_references(spark):
    rows = [("a.org", "write to me@b.net or see B.NET/x and style.css"), ("b.net", "x" * 200_000 + " src=//c.net:80/y //d"), ("e.f.org", "F.ORG 1.5")]
    df = spark.createDataFrame(rows, "host string, html string")
    ups = {("e.f.org", "f.org"), ("f.org", "e.f.org")}
    assert {tuple(r) for r in urls.host_edges(df).collect()} == {("a.org", "b.net"), ("b.net", "c.net:80")} | ups


def test_a_long_chain_is_followed_to_its_end(spark):
    rows = [(k, f"http://h{k}.org/x", f'<a href="http://h{k + 1}.org/">') for k in range(14)] + [(14, "http://h14.org/es/1", None), (None, "http://h14.org/es/1", None), (None, "http://h14.org/x", None), (15, "http://other.org/x", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("own") for c in ("host", "path", "rule", "verdict", "said", "_salt")})
    got = [(r.page_id, r.rule, r.verdict) for r in urls.filter_urls(df, mass=10**5).collect()]
    want = [(k, None, "block") for k in range(14)] + [(14, "org/es/", "block"), (None, "org/es/", "block"), (None, None, "block"), (15, None, "allow")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_many_rules_and_many_hosts(spark, monkeypatch):
    rng = random.Random(3)
    names = ["com", "b.com", "a.b.com", "net", "x.net"]
    rules = [(rng.choice(["allow", "block"]), rng.choice(names), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4)))) for _ in range(60)]
    rows = [(k, f"http://{rng.choice([*names, 'q.a.b.com', 'notcom'])}/" + "".join(rng.choice("ab/") for _ in range(5)), None) for k in range(300)] + [(None, None, None)] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    ties = sorted({(n, p): (s, n, p) for s, n, p in rules}.values())
    want = sorted(map(str, urls.filter_urls(df, ties, mass=100).collect()))
    monkeypatch.setattr(urls, "MOST_INLINE", 3)
    monkeypatch.setattr(urls, "few", lambda df: df)
    assert sorted(map(str, urls.filter_urls(df, ties, mass=100).collect())) == want


def test_rank_matches_a_loop(spark):
    rng = random.Random(6)
    edges = {(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}") for _ in range(20)}
    edges = {(a, b) for a, b in edges if a != b}
    seeds = [("trust", "h1"), ("trust", "h2"), ("distrust", "h3")]
    got = {(r.kind, r.host): r["rank"] for r in urls.propagate(spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame(seeds, "kind string, host string"), 10_000).collect()}
    for kind in ("trust", "distrust"):
        own = {e if kind == "trust" else e[::-1] for e in edges}
        fresh = collections.Counter({h: 10_000 // sum(k == kind for k, _ in seeds) for k, h in seeds if k == kind})
        out, rank = collections.Counter(a for a, _ in own), collections.Counter()
        while fresh:
            rank.update(fresh)
            parts = collections.Counter()
            for a, b in own:
                parts[b] += urls.DAMPING * (fresh[a] // out[a])
            fresh = collections.Counter({h: r // 100 for h, r in parts.items() if r // 100})
        assert {h: r for (k, h), r in got.items() if k == kind} == rank


# --- shared -----------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(300 + k, 301 + k) for k in range(40)] + [(500, 500 + k) for k in range(1, 30)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert common.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_small_batches_are_undone(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    assert common.settle(spark.range(3), "x").count() == 3 and spark.conf.get(key) == before
    assert pa.__version__
