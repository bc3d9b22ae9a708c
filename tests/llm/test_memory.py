"""What Python workers hold between the stages of the pipeline."""

from __future__ import annotations

import pytest

from sparkloom.llm import decontaminate, token_output
from sparkloom.llm.common import tidy


def test_stages_let_go_of_the_encoder():
    path = token_output.default_tokenizer()
    first = token_output.encoder(path)
    list(tidy(iter, token_output.encoder)([]))
    assert token_output.encoder(path) is first
    list(tidy(iter)([]))
    assert token_output.encoder.cache_info().currsize == 0


@pytest.mark.parametrize("words", [0, 30])
def test_leaks_need_no_rows_from_python(spark, monkeypatch, words):
    """createDataFrame of a list would start a second pool of workers."""
    text = " ".join(f"w{k}" for k in range(words))
    docs = spark.range(2).selectExpr("id AS doc_id", f"IF(id = 0, '{text}', 'other') AS text")
    items = spark.range(7, 8).selectExpr("id AS item_id", f"'{text}' AS text")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_: pytest.fail("rows sent from Python"))
    got = decontaminate.find_leaks(docs, items).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(0, 7)] * (words > 0)
    assert not decontaminate.find_leaks(docs, items.where("item_id < 0")).collect()
