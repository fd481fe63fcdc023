"""Whole rows go to Python in small batches."""

from __future__ import annotations

from ledgerloom.llm import toxicity


def test_rejected_rows_are_written_in_small_batches(spark, monkeypatch):
    sizes = []
    own = toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, label, rows=None: sizes.append(rows) or own(df, label, rows))
    out = toxicity.reject(spark.range(300).selectExpr("id doc_id", "if(id % 3 = 0, null, 'some text') text"), toxicity.Model())
    assert out.count() == 300 and sizes == [128]
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
