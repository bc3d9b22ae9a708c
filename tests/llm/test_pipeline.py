"""run() against a plain reimplementation of its stages."""

from __future__ import annotations

import collections
import zlib

import compare
import corpus_pipeline
import numpy as np
import pytest
from test_operators import brute_links, plain

from sparkloom.llm import mixing, quality_rules, token_output


@pytest.fixture(scope="module")
def staged(spark, sf):
    """What each stage returns, from what the stage before returned."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, sf), "test-stage")
        out.append(docs.toPandas())
    return out


def test_stages(staged, spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "token output"]
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(list(s.columns) == columns for s in staged[:4])


def test_quality_stage(staged, sf):
    select = "doc_id, array_to_string(good, chr(10)) AS text, lang, source, length(array_to_string(good, chr(10)))::BIGINT AS n_chars"
    want = compare.views(sf).sql(quality_rules.oracle(select=select) + " WHERE kept").df()
    compare.same(staged[0], want)


def test_near_duplicate_stage(staged):
    links = brute_links(list(zip(staged[0].doc_id, staged[0].text, strict=True)))
    assert sorted(staged[1].doc_id) == sorted(i for i, (c, _) in links.items() if c == i)


def test_decontamination_stage(staged, spark, sf):
    items = [" ".join(plain(t)) for t in spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text]
    leaks = {i for i, t in zip(staged[1].doc_id, staged[1].text, strict=True) if any(x in " ".join(plain(t)) for x in items)}
    assert set(staged[2].doc_id) == set(staged[1].doc_id) - leaks


def test_mixing_stage(staged):
    before, after = staged[2], collections.Counter(staged[3].doc_id)
    assert set(after) == set(before.doc_id)
    tokens = {s: sum(len(t.split()) for t in g.text) for s, g in before.groupby("source")}
    _, shares = mixing.plan(tokens, repeats=mixing.REPEATS)
    text = dict(zip(before.doc_id, before.text, strict=True))
    source = dict(zip(before.doc_id, before.source, strict=True))
    for s in shares:
        own = sum(n * len(text[i].split()) for i, n in after.items() if source[i] == s.source)
        assert s.budget - max(len(text[i].split()) for i in text if source[i] == s.source) <= own <= s.budget


def test_token_stage(staged):
    e = token_output.Encoder(token_output.default_tokenizer())
    want = collections.Counter()
    for i, t in zip(staged[3].doc_id, staged[3].text, strict=True):
        ids = [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter(zip(staged[4].doc_id, staged[4].n_tokens, staged[4].ids_crc32, strict=True)) == want


def test_copies_lie_apart(staged, spark):
    """The files hold the documents in training order."""
    docs = spark.createDataFrame(staged[3])
    rows, order = mixing.training_order(docs)
    want = [r.doc_id for r in rows.sort(*order, "doc_id").collect()]
    got = staged[4].sort_values("start").doc_id.tolist()
    assert got == want and all(a != b for a, b in zip(got, got[1:], strict=False)) and len(set(got)) < len(got)


def test_run_is_the_stages_in_turn(staged, spark, sf):
    compare.same(corpus_pipeline.run(spark, sf).toPandas(), staged[4])
