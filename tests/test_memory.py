"""What a task holds: joins that are made once, and small batches of whole texts."""

from __future__ import annotations

from ledgerloom.operators import agenda


def test_analyses_are_judged_once(spark):
    proposals = spark.createDataFrame([(1, 7, "order 5", [5, 6], "w"), (2, 7, "order 9", [5, 6], "w"), (3, 8, "x", [5], "w"), (4, 7, "x", [5, 5], "w")], "proposal_id long, question_id long, statement string, premise_ids array<long>, warrant string")
    premises = spark.createDataFrame([(7, 5, "order 5", "fact"), (7, 6, "order 6", "fact")], "question_id long, id long, statement string, kind string")
    verdicts = spark.createDataFrame([(1, "accepted")], "proposal_id long, verdict string")
    props, links, rejected = agenda.analyses(proposals, premises, verdicts)
    assert [(r.proposal_id, r.status) for r in props.collect()] == [(1, "reportable")]
    assert links.count() == 3
    assert {(r.proposal_id, r.reason) for r in rejected.collect()} == {(2, "unsupported number"), (3, "unknown question"), (4, "fewer than two premises")}
    for out in (props, links, rejected):  # the joins aren't repeated for each output
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
