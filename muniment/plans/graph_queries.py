"""Queries over evidence, triples, graph patterns, the person graph, pages and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import extraction as X
from ..operators import governance as G
from ..operators import graph as K
from ..sources import sinks
from .registry import register
from .text_queries import linked_people, table

_AUTH = "a AS (SELECT 'AUTH:' || p_partkey AS id, p_name || ' ' || (p_partkey % 400) AS label, lower(p_name || ' ' || (p_partkey % 400)) AS norm FROM part), x AS (SELECT 'Q' || p_partkey AS qid, upper(p_name) || '  ' || (p_partkey % 900) AS label, lower(p_name || ' ' || (p_partkey % 900)) AS norm FROM part WHERE p_size > 25), e AS (SELECT p_brand || '!' AS name, lower(replace(p_brand, '#', ' ')) AS norm FROM part UNION ALL SELECT p_name || ' ' || (p_partkey % 400), lower(p_name || ' ' || (p_partkey % 400)) FROM part),\n"
_MERGE = """s AS (SELECT norm, min(id) AS id FROM a GROUP BY 1 HAVING count(DISTINCT id) = 1), h AS (SELECT x.qid, s.id FROM x JOIN s USING (norm)),
b AS (SELECT id, max(qid) AS qid, count(DISTINCT qid) AS n FROM h GROUP BY 1), k AS (SELECT norm FROM a UNION SELECT norm FROM x),
g AS (SELECT a.id, a.label, b.qid, 1 + coalesce(b.n, 0) AS n_sources FROM a LEFT JOIN b USING (id)
  UNION ALL SELECT 'WIKIDATA:' || qid, min(label), qid, 1 FROM x WHERE qid NOT IN (SELECT qid FROM h) GROUP BY qid
  UNION ALL SELECT 'EXTRACTED:' || regexp_replace(norm, '[^a-z0-9]+', '-', 'g'), min(name), NULL, 1 FROM e WHERE norm NOT IN (SELECT norm FROM k) GROUP BY norm)
"""


def _merged(spark, sf_dir, **kw):
    p = table(spark, sf_dir, "part")
    auth = p.select(F.concat(F.lit("AUTH:"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws(" ", "p_name", (F.col("p_partkey") % 400).cast("string")).alias("label"))
    ext = p.where("p_size > 25").select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("qid"), F.concat_ws("  ", F.upper("p_name"), (F.col("p_partkey") % 900).cast("string")).alias("label"))
    names = p.select(F.concat("p_brand", F.lit("!")).alias("name")).unionAll(p.select(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 400).cast("string"))))
    return K.merged(auth, ext, names, **kw)


@register("exact_kg_match", "WITH " + _AUTH + _MERGE + "SELECT id, label, qid, n_sources FROM g")
def exact_kg_match(spark, sf_dir):
    return _merged(spark, sf_dir).select("id", "label", "qid", F.size("sources").cast("long").alias("n_sources"))


@register("kg_breakdown", "WITH " + _AUTH + _MERGE + "SELECT count(*) AS persons, count(qid) AS with_qid, count(*) FILTER (id LIKE 'AUTH:%') AS with_authority, count(*) FILTER (id LIKE 'EXTRACTED:%') AS needs_review FROM g")
def kg_breakdown(spark, sf_dir):
    return K.breakdown(_merged(spark, sf_dir))


@register("kg_breakdown_as_published", "WITH " + _AUTH + _MERGE + "SELECT count(*) + (SELECT count(DISTINCT qid) FROM h) AS persons FROM g")
def kg_breakdown_as_published(spark, sf_dir):
    return K.breakdown(_merged(spark, sf_dir, keep_matched=True)).select("persons")


@register("couples", "SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey <> l_partkey")
def couples(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", "spouse").otherwise("child")
    return K.couples(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), kind.alias("kind"), F.col("l_partkey").alias("other")))


@register("person_triples", """WITH p AS (SELECT 'http://www.wikidata.org/entity/Q' || c_custkey AS s, c_name, c_mktsegment, c_custkey % 300 + 1000 AS y FROM customer)
SELECT s, 'rdf:type' AS p, 'crm:E21_Person' AS o, 'iri' AS o_kind FROM p UNION ALL SELECT s, 'rdfs:label', c_name, 'literal' FROM p UNION ALL SELECT s, 'birthYear', y::VARCHAR, 'year' FROM p UNION ALL SELECT s, 'altLabel', lower(c_name), 'literal' FROM p UNION ALL SELECT s, 'hasRole', c_mktsegment, 'literal' FROM p""")
def person_triples(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    people = c.select(F.concat(F.lit("WIKIDATA:Q"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"), F.array(F.lower("c_name")).alias("variants"), F.array("c_mktsegment").alias("roles"), F.array().cast("array<string>").alias("places"), F.concat((F.col("c_custkey") % 300 + 1000).cast("string"), F.lit("-01-02")).alias("birth"), F.lit(None).cast("string").alias("death"))
    return K.person_triples(people)


def _assertions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("predicate"), F.col("o_orderstatus").alias("object"), "o_orderpriority", "o_orderdate")


@register("conflicting_assertions", "SELECT x.o_orderkey AS a, y.o_orderkey AS b, x.o_custkey AS predicate FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey <> y.o_orderkey AND x.o_orderstatus <> y.o_orderstatus")
def conflicting_assertions(spark, sf_dir):
    return E.conflicting(_assertions(spark, sf_dir))


@register("interval_overlap", """WITH i AS (SELECT o_custkey, min(year(o_orderdate))::INT AS first_, CASE WHEN o_custkey % 5 > 0 THEN max(year(o_orderdate))::INT END AS last_ FROM orders GROUP BY 1)
SELECT o_custkey, first_, coalesce(last_, 0)::INT AS last_ FROM i WHERE (first_ IS NULL OR first_ <= 1996) AND (last_ IS NULL OR last_ >= 1999)""")
def interval_overlap(spark, sf_dir):
    i = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("first_"), F.max(F.year("o_orderdate")).alias("last_")).withColumn("last_", F.when(F.col("o_custkey") % 5 > 0, F.col("last_")))
    return E.overlapping(i, "first_", "last_", 1999, 1996).withColumn("last_", F.coalesce("last_", F.lit(0)))


@register("uncertain_participation", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT'")
def uncertain_participation(spark, sf_dir):
    a = _assertions(spark, sf_dir).select("id", F.col("object").alias("predicate"), F.when(F.col("o_orderpriority") == "1-URGENT", "explicit").otherwise("possible").alias("certainty"))
    return E.uncertain(a, "O").select("id")


@register("evidence_for_person", "SELECT o_orderkey AS assertion, l_linenumber AS passage FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def evidence_for_person(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_linenumber").alias("passage_ids"))
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("object")).join(lines, "id")
    return E.evidence_for(a, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@register("fk_violations", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def fk_violations(spark, sf_dir):
    kept = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return E.missing_keys(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", kept, "o_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@register("shape_violations", """WITH p AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25)
SELECT o_orderkey AS id, 'evidence' AS shape FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM p) UNION ALL SELECT o_orderkey, 'interval' FROM orders WHERE o_totalprice > 450000
UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT o_orderkey, 'agent' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def shape_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_orderkey")).alias("passage_ids"), F.col("o_totalprice").alias("not_before"), F.lit(450000.0).alias("not_after"))
    passages = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("id")).distinct()
    status = F.when(F.col("o_orderpriority") == "5-LOW", "odd").when(F.col("o_orderpriority") == "1-URGENT", "accepted").otherwise("rejected")
    d = o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_custkey").alias("activity"))
    agents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).alias("agent"))
    return E.shape_violations(a, passages, d, agents)


@register("schema_violations", "SELECT p_partkey::VARCHAR AS id, 'size' AS rule FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey::VARCHAR, 'pattern' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#1')")
def schema_violations(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.lit("Work").alias("type"), "p_size", "p_brand")
    return E.schema_violations(p, {"Work": [("size", F.col("p_size") <= 40), ("pattern", F.col("p_brand").rlike("^Brand#1"))]})


@register("snapshot_import", """WITH s AS (SELECT p_partkey AS id, md5(p_name) AS checksum FROM part WHERE p_size < 30), n AS (SELECT p_partkey AS id, md5(CASE WHEN p_size < 10 THEN p_brand ELSE p_name END) AS checksum FROM part)
SELECT n.id, n.checksum, CASE WHEN s.id IS NULL THEN 'insert' WHEN s.checksum = n.checksum THEN 'skip' ELSE 'conflict' END AS outcome FROM n LEFT JOIN s USING (id)""")
def snapshot_import(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.where("p_size < 30").select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("checksum"))
    return E.imported(old, p.select(F.col("p_partkey").alias("id"), F.md5(F.when(F.col("p_size") < 10, F.col("p_brand")).otherwise(F.col("p_name"))).alias("checksum")))


@register("triples_round_trip", "SELECT o_orderkey::VARCHAR AS s, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def triples_round_trip(spark, sf_dir):
    """Rows to triples and back."""
    o = table(spark, sf_dir, "orders")
    t = E.triples(o, F.col("o_orderkey").cast("string"), [("status", F.col("o_orderstatus"), "literal"), ("priority", F.col("o_orderpriority"), "literal"), ("none", F.lit(None).cast("string"), "literal")])
    return E.records(t, ["status", "priority"])


@register("turtle_blocks", r"""SELECT n_name AS s, '<' || n_name || '>' || chr(10) || '    :inRegion <' || r_name || '> ;' || chr(10) || '    :label "' || lower(n_name) || '" .' AS block FROM nation JOIN region ON n_regionkey = r_regionkey""")
def turtle_blocks(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return E.serialised(E.triples(n, F.col("n_name"), [("label", F.lower("n_name"), "literal"), ("inRegion", F.col("r_name"), "iri")]))


def link_candidates(spark, sf_dir):
    """(doc_id, pos, authority_id, score): every candidate of the linked mentions."""
    return linked_people(spark, sf_dir).select("doc_id", "pos", F.explode("candidates").alias("c")).select("doc_id", "pos", "c.authority_id", "c.score")


@register("evidence_objects")
def evidence_objects(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    people = X.mentions(d)
    objects = E.build(d, people, link_candidates(spark, sf_dir))
    return objects.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("ref").alias("with_ref"))


@register("evidence_contract")
def evidence_contract(spark, sf_dir):
    """No row: what is built keeps its own contract."""
    d = table(spark, sf_dir, "documents")
    people = X.mentions(d)
    return E.contract_violations(E.build(d, people, link_candidates(spark, sf_dir)))


@register("publication_round_trip", "SELECT s_suppkey::VARCHAR AS id, 'Work' AS type, s_name AS label FROM supplier")
def publication_round_trip(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.lit("Work").alias("type"), F.col("s_name").alias("label"))
    return E.republished(E.publication(s), "id string, type string, label string")


@register("discovery_projection", """SELECT s_suppkey::VARCHAR AS id, '{"@context":"https://schema.org","@id":"' || s_suppkey || '","@type":"Person","name":"' || s_name || '"}' AS json FROM supplier WHERE s_suppkey % 2 = 0""")
def discovery_projection(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "Identity").otherwise("Passage").alias("type"), F.col("s_name").alias("label"))
    return E.discovery(s)


@register("tei_standoff", """SELECT l_orderkey AS doc_id, '<standOff>' || string_agg('<persName start="' || l_partkey || '"' || CASE WHEN l_returnflag = 'A' THEN ' ref="AUTH:' || l_suppkey || '"' ELSE '' END || '>' || l_linestatus || '</persName>', '' ORDER BY l_linenumber, l_partkey, l_suppkey) || '</standOff>' AS xml FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) GROUP BY 1""")
def tei_standoff(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")).alias("x"))
    m = first.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("x.l_partkey").alias("source_offset"), F.col("x.l_linestatus").alias("name"), "x.l_returnflag", "x.l_suppkey")
    accepted = m.where("l_returnflag = 'A'").select("doc_id", "pos", F.concat(F.lit("AUTH:"), F.col("l_suppkey").cast("string")).alias("authority_id"))
    return E.tei_standoff(m, accepted)


@register("document_index", "SELECT count(DISTINCT doc_id) AS count, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS documents FROM documents")
def document_index(spark, sf_dir):
    return sinks.index(table(spark, sf_dir, "documents")).select("count", F.md5(F.array_join("documents", ",")).alias("documents"))


@register("same_as", """WITH c AS (SELECT 'Person ' || (l_partkey % 500) AS person, 'Q' || l_suppkey AS qid, l_discount * 10 AS score FROM lineitem), b AS (SELECT person, arg_max(qid, (score, qid)) AS qid, max(score) AS score FROM c GROUP BY 1)
SELECT person, CASE WHEN score >= 0.9 THEN '{"@type":"Person","name":"' || person || '","sameAs":"http://www.wikidata.org/entity/' || qid || '"}' ELSE '{"@type":"Person","name":"' || person || '"}' END AS json FROM b""")
def same_as(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Person "), (F.col("l_partkey") % 500).cast("string")).alias("person"), F.concat(F.lit("Q"), F.col("l_suppkey").cast("string")).alias("qid"), (F.col("l_discount") * 10).alias("score"))
    return sinks.same_as(c, 0.9)


# -- pages --------------------------------------------------------------------------------------------

_PLAIN = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')


@register("page_paragraphs", rf"""WITH x AS (SELECT page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) AS p FROM pages), e AS (SELECT page_id, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS t FROM x)
SELECT page_id, pos::BIGINT AS pos, md5({_PLAIN.format("t")}) AS paragraph FROM e""")
def page_paragraphs(spark, sf_dir):
    return K.paragraphs(table(spark, sf_dir, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), F.md5("paragraph").alias("paragraph"))


@register("html_fields", rf"""WITH x AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<li\b[^>]*>(.*?)</li>', 1), lambda t: {_PLAIN.format("t")}) AS c FROM pages), e AS (SELECT page_id, unnest(range(0, (len(c) // 2)::BIGINT)) AS i, c FROM x)
SELECT page_id, lower(regexp_replace(c[2 * i + 1], ':\s*$', '')) AS label, c[2 * i + 2] AS value FROM e""")
def html_fields(spark, sf_dir):
    return K.fields(table(spark, sf_dir, "pages"), "li")


@register("genealogy", r"""WITH e AS (SELECT doc_id AS page_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
n AS (SELECT *, nullif(regexp_extract(t, '^([A-Z][a-z]+) ', 1), '') AS name FROM e), s AS (SELECT *, sum((name IS NOT NULL)::INT) OVER (PARTITION BY page_id ORDER BY pos) AS person FROM n)
SELECT page_id, person::BIGINT AS person, arg_min(name, pos) AS name, count(*) AS paragraphs FROM s WHERE person > 0 GROUP BY 1, 2""")
def genealogy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("pos", "paragraph"))
    return K.genealogy(rows, F.regexp_extract("paragraph", "^([A-Z][a-z]+) ", 1)).drop("relations")


@register("stated_relations", r"""WITH t AS (SELECT c_custkey, 'He was son of ' || c_mktsegment || ', and brother of Walter (' || (1000 + c_custkey % 300) || '-' || (1040 + c_custkey % 300) || ')' AS s FROM customer)
SELECT c_custkey, 'child_of' AS type, c_mktsegment AS name, (1000 + c_custkey % 300)::INT AS born FROM customer UNION ALL SELECT c_custkey, 'sibling_of', 'Walter', (1000 + c_custkey % 300)::INT FROM customer""")
def stated_relations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    year = F.col("c_custkey") % 300
    t = c.select("c_custkey", F.concat(F.lit("He was son of "), "c_mktsegment", F.lit(", and brother of Walter ("), (1000 + year).cast("string"), F.lit("-"), (1040 + year).cast("string"), F.lit(")")).alias("s"))
    return t.select("c_custkey", F.explode(K.relations_of(F.col("s"))).alias("r"), K.lifetime(F.col("s"))["start"].alias("born")).select("c_custkey", "r.type", "r.name", "born")


@register("label_features", """WITH p AS (SELECT p_partkey, [p_name, p_type] AS q, [upper(p_type), p_brand] AS c FROM part)
SELECT p_partkey, len(list_intersect(list_transform(q, lambda x: lower(x)), list_transform(c, lambda x: lower(x))))::BIGINT AS n_shared FROM p""")
def label_features(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.array("p_name", "p_type").alias("query_labels"), F.array(F.upper("p_type"), "p_brand").alias("candidate_labels"))
    return K.candidate_features(p).select("p_partkey", F.col("n_shared").cast("long").alias("n_shared"))


@register("relevant_records", "SELECT p_partkey FROM part WHERE p_size * 30 <= 1400 AND p_size * 40 >= 1000 AND contains(lower(p_name), 'red') OR (p_size * 30 <= 1400 AND p_size * 40 >= 1000 AND contains(lower(p_brand), 'red'))")
def relevant_records(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.array(F.col("p_size") * 30, F.col("p_size") * 40).alias("years"))
    return K.relevant(p, 1000, 1400, ("red",)).select("p_partkey")


@register("wikibase_statements", "SELECT 'Q' || event_id AS id, 'P' || user_id AS property, props->>'$.k' AS value FROM events")
def wikibase_statements(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"claims":{"P'), F.col("user_id").cast("string"), F.lit('":[{"rank":"normal","mainsnak":{"datavalue":{"type":"wikibase-entityid","value":{"id":"'), k, F.lit('"}}}}]}}'))
    return K.wikibase_statements(e.select(F.concat(F.lit("Q"), F.col("event_id").cast("string")).alias("id"), doc.alias("json"))).select("id", "property", "value")


# -- governance ---------------------------------------------------------------------------------------

@register("coverage_rollup", """SELECT r_name AS tradition, count(*) FILTER (c_acctbal > 0) AS present, count(*) FILTER (c_acctbal <= 0) AS missing, count(*) AS total
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), ())""")
def coverage_rollup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    b = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_name").alias("name"), F.col("r_name").alias("tradition"))
    return G.coverage(b, c.where("c_acctbal > 0").select(F.col("c_name").alias("name")))


@register("operation_gate", """SELECT o_orderkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN o_orderstatus = 'O' ELSE false END AND (s_suppkey % 4 = 0 OR o_totalprice > 200000), false) AS allowed FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""")
def operation_gate(spark, sf_dir):
    reg = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "open").otherwise("restricted").alias("rights"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("O"))).alias("permitted_operations"))
    req = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("operation"), (F.col("o_totalprice") > 200000).alias("written_permission"))
    return G.allowed(req, reg).select("o_orderkey", "allowed")


@register("registry_errors", "SELECT s_suppkey::VARCHAR AS id, 'missing title' AS error FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey::VARCHAR, 'rights' FROM supplier WHERE s_nationkey = 3")
def registry_errors(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return G.registry_errors(s.select(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("title"), F.when(F.col("s_nationkey") == 3, "odd").otherwise("open").alias("rights"), F.array(F.lit("read")).alias("permitted_operations"), F.lit("2024-01-01").alias("checked_at")))


@register("review_age", "SELECT o_orderkey AS id, date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::INT AS age_days, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') > 1000 AS stale FROM orders")
def review_age(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("checked_at"), F.lit(1000).alias("stale_after_days"))
    return G.review_age(o, F.to_date(F.lit("2002-01-01")))


@register("quarantined", "SELECT DISTINCT 'path/' || c_nationkey AS path FROM customer WHERE NOT (c_acctbal > 9000 AND c_mktsegment = 'BUILDING')")
def quarantined(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_acctbal") > 9000).alias("canonical"), (F.col("c_mktsegment") == "BUILDING").alias("public"), F.array(F.concat(F.lit("path/"), F.col("c_nationkey").cast("string"))).alias("paths"))
    return G.quarantined(c)


@register("name_provenance", "SELECT p_partkey, 2::BIGINT AS names, 0::BIGINT AS unsourced FROM part")
def name_provenance(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.array("p_name", F.concat("p_name", F.lit("*"))).alias("names"), F.array("p_brand").alias("sources"))
    return G.name_provenance(p).select("p_partkey", F.size(F.map_keys("name_sources")).cast("long").alias("names"), F.size("unsourced").cast("long").alias("unsourced"))


@register("snapshot_checksum")
def snapshot_checksum(spark, sf_dir):
    return K.snapshot(table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_uri"), "n_nationkey"))
