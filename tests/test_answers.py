"""Answers of a model, chunks, and Turtle files."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from muniment.operators import answers as A
from muniment.operators import evidence as E
from muniment.operators import extraction as X
from muniment.operators import review as R
from muniment.sources import sinks


def test_parsed():
    assert A.parsed('```json\n{"persons": []}\n```') == {"persons": []}
    assert A.parsed('{"persons": [{"name": "Guy"}, {"name": "Ba')["persons"] == [{"name": "Guy"}]
    with pytest.raises(ValueError):
        A.parsed("sorry")
    with pytest.raises(ValueError):
        A.parsed("")


def test_person():
    assert A.person({"name": " Pope \n Urban ", "source_offset": 0, "confidence": "x"}) | {"name": "Pope Urban"} == A.person({"name": "Pope Urban", "source_offset": 0})
    assert A.person({"raw_mention": "Guy"})["name"] == "Guy" and A.person({"name": " "}) is None and A.person("Guy") is None
    assert A.person({"name": "Guy", "source_offset": 0})["source_offset"] == 0


def test_packed():
    text = "One two.\n\nThree four. Five.\n\n\n" + "Long sentence here. " * 5 + "End\n\nLast."
    spans = X.packed(text, 40)
    assert all(text[s:e] and e - s <= 40 for s, e in spans) and spans == sorted(spans)
    assert "".join(text[s:e] for s, e in spans).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert X.packed("", 10) == [(0, 0)] and X.packed("x" * 30, 10) == [(0, 30)] and X.packed("\n" * 30, 10) == [(0, 30)]


def test_answers_fall_back(spark):
    docs = spark.createDataFrame([(1, "Count Bohemond of Taranto came."), (1, "bad: King Baldwin of Jerusalem fell."), (2, None), (3, ""), (None, "bad")], "doc_id long, text string")

    def model(prompt):
        if "bad" in prompt.split("Text:\n")[1]:
            raise TimeoutError
        return json.dumps({"persons": [{"name": "Bohemond", "source_offset": 6}], "metadata": {"year": 1099}})

    asked = A.answers(docs, model)
    got = {(r["doc_id"], r["name"], r["source_offset"]) for r in A.people(asked).collect()}
    assert (1, "Bohemond", 6) in got and any(d == 1 and "Baldwin" in n and o >= 5 for d, n, o in got)
    told = {(r["doc_id"], r["engine"], tuple(r["reasons"])) for r in A.summary(asked).collect()}
    assert told == {(1, "model", ()), (1, "heuristic", ("TimeoutError",)), (3, "model", ()), (None, "heuristic", ("TimeoutError",))}
    assert {r["reason"] for r in A.answers(docs, None).collect()} == {"not_configured"}


def test_turtle_file(spark, tmp_path):
    rows = [("http://x/1", "rdf:type", "crm:E21_Person", "iri"), ("http://x/1", "label", 'a "b"', "literal"), ("http://x/1", "http://y/p", "1099", "year")]
    graph = spark.createDataFrame(rows, "s string, p string, o string, o_kind string")
    sinks.turtle(graph, str(tmp_path / "t"))
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/t/part-*")))
    assert "@prefix crm: <http://www.cidoc-crm.org/cidoc-crm/> ." in text and "rdf:type crm:E21_Person" in text
    assert ':label "a \\"b\\""' in text and '<http://y/p> "1099"^^xsd:gYear' in text and E.turtle_header() in text


def test_filters(spark):
    links = spark.createDataFrame([(1, 0, "Guy", "high", ["A", "B"]), (1, 1, "Eve", "no_match", []), (2, 0, "Ann", "low", None)], "doc_id long, pos int, person string, status string, ids array<string>")
    said = spark.createDataFrame([(1, "GUY", "A", "accept")], "doc_id long, person string, id string, decision string")
    shown = lambda mode: {r["person"] for r in R.filtered_links(links, said, said, mode).collect()}
    assert shown("accepted") == shown("conflict") == {"Guy"} and shown("unreviewed") == {"Eve", "Ann"} and shown("no_match") == {"Eve"} and len(shown("all")) == 3
    with pytest.raises(ValueError):
        R.filtered_links(links, said, mode="odd")
    assert [r[0] for r in spark.range(1).select(R.compared(F.lit("King, of Acre"), F.lit("acre"))).collect()] == ["partial"]
