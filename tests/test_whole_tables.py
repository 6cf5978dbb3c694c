"""Queries without SQL read whole tables and build every kind of row."""

from conftest import DATA

from muniment.operators import extraction
from muniment.plans import registry


def test_evidence_has_hypotheses(spark):
    got = {r["type"]: r for r in registry.queries()["evidence_objects"](spark, DATA).collect()}
    assert got["ResolutionHypothesis"]["n"] == got["ResolutionHypothesis"]["with_ref"] > 0


def test_scores_read_all_languages(spark):
    people = extraction.mentions(spark.read.parquet(f"{DATA}/documents.parquet"))
    got = {r["doc_id"] for r in registry.queries()["prf_greedy"](spark, DATA).select("doc_id").collect()}
    assert got == {r["doc_id"] for r in people.select("doc_id").distinct().collect()}


def test_dataset_is_computed_once(spark):
    frame = registry.queries()["dataset_violations"](spark, DATA)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "MapIn" not in plan and "Exchange" not in plan  # its checks are stored: no text is searched and nothing dealt again
    assert frame.collect() == []
