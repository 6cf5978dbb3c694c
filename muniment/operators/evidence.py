"""The evidence model: objects, their constraints as queries that return violations, triples and graph patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Vocabularies of the evidence schema.
TYPES = ("Work", "SourceSnapshot", "Passage", "Mention", "Identity", "IdentityGroup", "Assertion", "ResolutionHypothesis", "ResolutionDecision", "Activity", "Place")
DECISION_STATUS = ("accepted", "rejected", "unresolved", "superseded")


def build(docs: DataFrame, people: DataFrame, candidates: DataFrame) -> DataFrame:
    """Evidence objects (id, type, doc_id, ref, label, score) of documents: a work, a snapshot with its
    checksum, and for each mention (doc_id, pos, name, group, confidence, source_offset) its passage, mention,
    identity and assertion; for each candidate (doc_id, pos, authority_id, score) a hypothesis. One row an id."""
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    doc = F.col("doc_id").cast("string")
    work, snapshot = T.stable_id("work", doc), T.stable_id("snapshot", doc, F.sha2("text", 256))
    row = lambda df, key, kind, ref, label, score: df.select(key.alias("id"), F.lit(kind).alias("type"), "doc_id", ref.cast("string").alias("ref"), label.cast("string").alias("label"), score.cast("double").alias("score"))
    at = F.coalesce("source_offset", F.lit(0)).cast("string")
    passage, mention = T.stable_id("passage", doc, at), T.stable_id("mention", doc, at, F.col("name"))
    person, claim = T.stable_id("identity", doc, T.normalise(F.col("name"))), T.stable_id("assertion", doc, at, F.col("name"))
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    kind = F.when(F.col("group"), "IdentityGroup").otherwise("Identity")
    parts = [
        row(docs, work, "Work", text, doc, none), row(docs, snapshot, "SourceSnapshot", work, F.sha2("text", 256), none), row(people, passage, "Passage", work, F.col("context"), none),
        row(people, mention, "Mention", passage, F.col("name"), clamp(F.col("confidence"))), row(people, person, "Identity", text, F.col("name"), none).withColumn("type", F.lit("Identity")),
        row(people, claim, "Assertion", passage, F.lit("mentions"), clamp(F.col("confidence"))),
    ]
    parts[4] = people.select(person.alias("id"), kind.alias("type"), "doc_id", text.alias("ref"), F.col("name").alias("label"), none.alias("score"))
    named = candidates.join(people.select("doc_id", "pos", "name", "source_offset"), ["doc_id", "pos"])
    parts.append(row(named, T.stable_id("hypothesis", doc, at, F.col("name"), F.col("authority_id")), "ResolutionHypothesis", mention, F.col("authority_id"), clamp(F.col("score"))))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("id", "type").agg(*(F.min(c).alias(c) for c in ("doc_id", "ref", "label", "score")))


def dangling(objects: DataFrame) -> DataFrame:
    """Objects whose ref is no object's id."""
    return objects.where("ref IS NOT NULL").join(objects.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select("id", F.lit("dangling_ref").alias("violation"))


def missing_keys(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose column is no key of parent: the referential check between two tables."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def contract_violations(objects: DataFrame) -> DataFrame:
    """(id, violation): unknown types, repeated ids, scores out of range, missing ids, dangling references."""
    twice = objects.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("violation"))
    row = lambda cond, name: objects.where(cond).select("id", F.lit(name).alias("violation"))
    return reduce(DataFrame.unionAll, [twice, row(~F.col("type").isin(*TYPES), "unknown_type"), row("id IS NULL OR id = ''", "missing_id"), row("score < 0 OR score > 1", "score_range"), dangling(objects)])


def shape_violations(assertions: DataFrame, passages: DataFrame, decisions: DataFrame, activities: DataFrame) -> DataFrame:
    """(id, shape) that a shape is broken at: an assertion without a passage, one whose interval is reversed, a
    decision outside the vocabulary, an accepted decision without an activity with a responsible agent."""
    has = assertions.select("id", F.explode("passage_ids").alias("passage")).join(passages.select(F.col("id").alias("passage")), "passage", "left_semi").select("id").distinct()
    bare = assertions.join(has, "id", "left_anti").select("id", F.lit("evidence").alias("shape"))
    reversed_ = assertions.where("not_before > not_after").select("id", F.lit("interval").alias("shape"))
    status = decisions.where(F.col("status").isNull() | ~F.col("status").isin(*DECISION_STATUS)).select("id", F.lit("status").alias("shape"))
    agents = activities.where("agent IS NOT NULL").select(F.col("id").alias("activity"))
    alone = decisions.where("status = 'accepted'").join(agents, "activity", "left_anti").select("id", F.lit("agent").alias("shape"))
    return reduce(DataFrame.unionAll, [bare, reversed_, status, alone])


def schema_violations(objects: DataFrame, rules: dict[str, list[tuple[str, Column]]]) -> DataFrame:
    """(id, rule) by type: rules maps a type to (name, condition that must hold)."""
    parts = [objects.where((F.col("type") == t) & ~F.coalesce(ok, F.lit(False))).select("id", F.lit(name).alias("rule")) for t, checks in rules.items() for name, ok in checks]
    return reduce(DataFrame.unionAll, parts)


def imported(store: DataFrame, snapshot: DataFrame) -> DataFrame:
    """snapshot rows (id, checksum) with what importing them does: skip the same, refuse a reused id, insert the rest."""
    old = store.select("id", F.col("checksum").alias("old_"))
    what = F.when(F.col("old_").isNull(), "insert").when(F.col("old_") == F.col("checksum"), "skip").otherwise("conflict")
    return snapshot.join(old, "id", "left").select("id", "checksum", what.alias("outcome"))


def triples(rows: DataFrame, subject: Column, pairs: list[tuple[str, Column, str]]) -> DataFrame:
    """(s, p, o, o_kind) of rows: (predicate, object, kind) pairs; null objects give none."""
    items = F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(k).alias("o_kind")) for p, o, k in pairs])
    return rows.select(subject.alias("s"), F.explode(items).alias("t")).where("t.o IS NOT NULL").select("s", "t.p", "t.o", "t.o_kind")


def records(graph: DataFrame, predicates: list[str]) -> DataFrame:
    """The inverse: one row a subject, a column a predicate (the smallest object)."""
    return graph.groupBy("s").pivot("p", predicates).agg(F.min("o"))


def publication(objects: DataFrame) -> DataFrame:
    """Lossless triples: each object's canonical JSON as a literal, and its type."""
    doc = F.to_json(F.struct(*sorted(objects.columns)))
    return triples(objects, F.col("id"), [("rdf:type", F.col("type"), "iri"), ("canonicalJson", doc, "literal")])


def republished(graph: DataFrame, schema: str) -> DataFrame:
    return graph.where("p = 'canonicalJson'").select(F.from_json("o", schema).alias("x")).select("x.*")


def conflicting(assertions: DataFrame) -> DataFrame:
    """Ordered pairs (a, b, predicate) of assertions (id, predicate, object) that differ in object. A large
    predicate has few distinct objects: pairs are made between objects' groups first."""
    a, b = (assertions.select(F.col("id").alias(x), "predicate", F.col("object").alias(f"o{x}")) for x in "ab")
    return a.join(b, "predicate").where("a <> b AND oa <> ob").select("a", "b", "predicate")


def overlapping(rows: DataFrame, start: str, end: str, low: int, high: int) -> DataFrame:
    """Rows whose interval meets [low, high]; open ends pass."""
    return rows.where((F.col(start).isNull() | (F.col(start) <= high)) & (F.col(end).isNull() | (F.col(end) >= low)))


def evidence_for(assertions: DataFrame, objects: DataFrame) -> DataFrame:
    """(assertion, passage) of assertions whose object is an object of the dataset."""
    return assertions.select("id", "object", F.explode("passage_ids").alias("passage")).join(objects.select(F.col("id").alias("object")).distinct(), "object", "left_semi").select(F.col("id").alias("assertion"), "passage")


def uncertain(assertions: DataFrame, predicate: str = "participatedIn") -> DataFrame:
    return assertions.where((F.col("predicate") == predicate) & (F.col("certainty") != "explicit"))


# Namespaces of what is published.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#", "prov": "http://www.w3.org/ns/prov#", "geo": "http://www.opengis.net/ont/geosparql#", "crm": "http://www.cidoc-crm.org/cidoc-crm/",
    "wd": "http://www.wikidata.org/entity/",
}
BASE = "https://example.org/entity/"


def turtle_header(base: str = BASE) -> str:
    """The prefixes of a Turtle file; names without a prefix are of the base, as relative addresses are."""
    return "".join(f"@prefix {k}: <{v}> .\n" for k, v in PREFIXES.items()) + f"@prefix : <{base}> .\n@base <{base}> .\n"


def serialised(graph: DataFrame) -> DataFrame:
    """(s, block): a Turtle block a subject, predicates in order. Names with a known prefix stay short, predicates
    without one are of the base; the rest are addresses."""
    short = rf"^(?:{'|'.join(PREFIXES)}):\w[\w-]*$"
    name = lambda c: F.when(c.rlike(short), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    typed = lambda kind: F.concat(F.lit('"'), F.col("o"), F.lit(f'"^^xsd:{kind}'))
    term = F.when(F.col("o_kind") == "iri", name(F.col("o"))).when(F.col("o_kind") == "year", typed("gYear"))
    for kind in ("decimal", "integer", "dateTime"):
        term = term.when(F.col("o_kind") == kind, typed(kind))
    term = term.otherwise(F.concat(F.lit('"'), T.turtle(F.col("o")), F.lit('"')))
    p = F.when(F.col("p").rlike(short), F.col("p")).when(F.col("p").contains(":"), name(F.col("p"))).otherwise(F.concat(F.lit(":"), F.col("p")))
    lines = graph.select("s", F.concat(p, F.lit(" "), term).alias("l")).groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("l")), " ;\n    ").alias("b"))
    return lines.select("s", F.concat(name(F.col("s")), F.lit("\n    "), F.col("b"), F.lit(" .")).alias("block"))


def tei_standoff(mentions: DataFrame, accepted: DataFrame) -> DataFrame:
    """(doc_id, xml): a document's mentions as stand-off annotations, with the identity that was accepted for each."""
    rows = mentions.join(accepted.select("doc_id", "pos", "authority_id"), ["doc_id", "pos"], "left")
    ref = F.coalesce(F.concat(F.lit(' ref="'), T.xml(F.col("authority_id")), F.lit('"')), F.lit(""))
    item = F.concat(F.lit('<persName start="'), F.col("source_offset").cast("string"), F.lit('"'), ref, F.lit(">"), T.xml(F.col("name")), F.lit("</persName>"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))).alias("a")).select("doc_id", F.concat(F.lit("<standOff>"), F.array_join(F.transform("a", lambda s: s["x"]), ""), F.lit("</standOff>")).alias("xml"))


def discovery(objects: DataFrame) -> DataFrame:
    """The lossy schema.org projection of works and identities."""
    kind = F.when(F.col("type") == "Work", "CreativeWork").when(F.col("type") == "Identity", "Person").when(F.col("type") == "Place", "Place")
    return objects.withColumn("@type", kind).where(F.col("@type").isNotNull()).select("id", F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.col("id").alias("@id"), "@type", F.col("label").alias("name"))).alias("json"))
