"""Queries over chunks, a model's answers, and evaluation of links against adjudicated pairs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import extraction as X
from ..operators import linking as L
from ..operators import metrics as M
from .registry import register
from .text_queries import authority_from_benchmark, table

_PIECES = r"""d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS text FROM documents WHERE text IS NOT NULL),
p0 AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(\n\n+)', '\1' || chr(30), 'g'), chr(30)) AS ps FROM d WHERE length(text) > {size}),
p AS (SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM p0),
q AS (SELECT doc_id, i, raw, regexp_replace(raw, '\n\n+$', '') AS body FROM p),
s0 AS (SELECT doc_id, i, raw, body, length(body) > {size} AS long, CASE WHEN length(body) > {size} THEN regexp_split_to_array(regexp_replace(body, '([.!?][ \t\n\r\f\v]+)', '\1' || chr(30), 'g'), chr(30)) ELSE [body] END AS ss FROM q),
s AS (SELECT doc_id, i, long, generate_subscripts(ss, 1) AS j, len(ss) AS m, unnest(ss) AS bit, length(raw) - length(body) AS tail FROM s0),
t AS (SELECT doc_id, i, j, long, CASE WHEN long AND j < m THEN length(regexp_replace(bit, '([.!?])[ \t\n\r\f\v]+$', '\1')) ELSE length(bit) END AS n, length(bit) + CASE WHEN j = m THEN tail ELSE 0 END AS width FROM s),
u AS (SELECT *, sum(width) OVER (PARTITION BY doc_id ORDER BY i, j) - width AS start FROM t),
k AS (SELECT doc_id, start, n, CASE WHEN long THEN 1 ELSE 2 END AS joint, long AND j = 1 AS opens, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS r FROM u WHERE n > 0),
f(doc_id, r, start, n, chunk, used) AS (SELECT doc_id, r, start, n, 0, n + joint FROM k WHERE r = 1
  UNION ALL SELECT k.doc_id, k.r, k.start, k.n, f.chunk + CASE WHEN k.opens OR f.used + k.n + k.joint > {size} THEN 1 ELSE 0 END, CASE WHEN k.opens OR f.used + k.n + k.joint > {size} THEN k.n + k.joint ELSE f.used + k.n + k.joint END FROM f JOIN k ON k.doc_id = f.doc_id AND k.r = f.r + 1),
c AS (SELECT doc_id, chunk, min(start) AS start, max(start + n) AS last FROM f GROUP BY 1, 2 UNION ALL SELECT doc_id, 0, 0, length(text) FROM d WHERE length(text) <= {size}),
x AS (SELECT c.doc_id, c.chunk::INT AS chunk, c.start::INT AS start, substr(d.text, (c.start + 1)::BIGINT, (c.last - c.start)::BIGINT) AS text FROM c JOIN d USING (doc_id))
"""
_CHUNKS = "WITH RECURSIVE " + _PIECES + "SELECT doc_id, chunk, start, md5(text) AS text FROM x"


def spaced(spark, sf_dir):
    """The documents, lines of every other one as paragraphs."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n\n"))).otherwise(F.col("text")).alias("text"))


@register("chunks", _CHUNKS.replace("{size}", "5500"))
def chunks(spark, sf_dir):
    return X.chunks(spaced(spark, sf_dir)).select("doc_id", "chunk", "start", F.md5("text").alias("text"))


@register("chunks_small", _CHUNKS.replace("{size}", "300"))
def chunks_small(spark, sf_dir):
    return X.chunks(spaced(spark, sf_dir), 300).select("doc_id", "chunk", "start", F.md5("text").alias("text"))


def stand_in(prompt: str) -> str:
    """In place of a model: names the first word of a text in fenced JSON; every fifth length cuts the answer off, every seventh fails."""
    text = prompt.split("Text:\n", 1)[1]
    word = text.split(" ", 1)[0] or "none"
    if len(text) % 7 == 0:
        raise TimeoutError
    body = json.dumps({"persons": [{"name": word, "source_offset": 0}, {"name": " "}], "metadata": {"title": word}})
    return body[: body.index('{"name": " "')] if len(text) % 5 == 0 else f"```json\n{body}\n```"


_ASKED = "WITH RECURSIVE " + _PIECES.replace("{size}", "600") + r""", y AS (SELECT doc_id, chunk, start, regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS text FROM x),
z AS (SELECT doc_id, chunk, start, length(text) % 7 = 0 AS failed, length(text) % 5 = 0 AS cut, coalesce(nullif(string_split(text, ' ')[1], ''), 'none') AS word FROM y)
"""


@register("model_summary", _ASKED + """SELECT doc_id, count(*) AS chunks, count(*) FILTER (failed) AS fallback_chunks, CASE WHEN count(*) FILTER (failed) = 0 THEN 'model' WHEN count(*) FILTER (failed) = count(*) THEN 'heuristic' ELSE 'mixed' END AS engine,
  md5(arg_min(word, chunk) FILTER (NOT failed AND NOT cut)) AS title FROM z GROUP BY 1""")
def model_summary(spark, sf_dir):
    asked = A.answers(spaced(spark, sf_dir), stand_in, size=600)
    return A.summary(asked).select("doc_id", "chunks", "fallback_chunks", "engine", F.md5("metadata.title").alias("title"))


@register("model_people", _ASKED + r"SELECT doc_id, chunk, md5(trim(regexp_replace(word, '\s+', ' ', 'g'))) AS name, start AS source_offset FROM z WHERE NOT failed AND trim(regexp_replace(word, '\s+', ' ', 'g')) <> ''")
def model_people(spark, sf_dir):
    """The persons of readable answers."""
    asked = A.answers(spaced(spark, sf_dir), stand_in, size=600)
    return A.people(asked.where("reason IS NULL")).select("doc_id", "chunk", F.md5("name").alias("name"), "source_offset")


@register("model_fallback")
def model_fallback(spark, sf_dir):
    """What the patterns find where no model is at hand."""
    return A.people(A.answers(table(spark, sf_dir, "documents"), None)).drop("row_", "context")


# -- evaluation of links ------------------------------------------------------------------------------

_PAIRS = """pairs AS (SELECT l_orderkey % 97 AS doc_id, md5((l_partkey % 50)::VARCHAR) AS person, CASE WHEN l_linenumber % 3 = 0 THEN 'wikidata:Q' || (l_suppkey % 3) ELSE 'AUTH:' || (l_suppkey % 3) END AS id, CASE WHEN l_returnflag = 'A' THEN 'accepted' ELSE 'rejected' END AS verdict FROM lineitem),
"""
_COUNTS = """SELECT doc_id, count(*) FILTER (verdict = 'accepted' AND hit) AS accept_hit, count(*) FILTER (verdict = 'accepted' AND NOT hit) AS accept_miss, count(*) FILTER (verdict = 'rejected' AND hit) AS reject_hit, count(*) FILTER (verdict = 'rejected' AND NOT hit) AS reject_avoided,
  round(count(*) FILTER ((verdict = 'accepted') = hit)::DOUBLE / count(*), 4) AS agreement FROM h GROUP BY 1"""


def _pairs(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "wikidata:Q").otherwise("AUTH:")
    return i.select((F.col("l_orderkey") % 97).alias("doc_id"), F.md5((F.col("l_partkey") % 50).cast("string")).alias("person"), F.concat(kind, (F.col("l_suppkey") % 3).cast("string")).alias("id"), F.when(F.col("l_returnflag") == "A", "accepted").otherwise("rejected").alias("verdict"))


def _proposed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 97).alias("doc_id"), F.concat(F.upper(F.md5((F.col("o_custkey") % 50).cast("string"))), F.lit("! ")).alias("person"), F.concat(F.lit("AUTH:"), (F.col("o_custkey") % 3).cast("string")).alias("top_id"), (0.6 + F.col("o_custkey") % 40 / 100).alias("confidence"))


_LINKS = "links AS (SELECT DISTINCT o_orderkey % 97 AS doc_id, md5((o_custkey % 50)::VARCHAR) AS person, 'AUTH:' || (o_custkey % 3) AS id FROM orders),\n"


@register("link_agreement", "WITH " + _PAIRS + _LINKS + "a AS (SELECT * FROM pairs WHERE NOT starts_with(id, 'wikidata:')), h AS (SELECT a.*, l.id IS NOT NULL AS hit FROM a LEFT JOIN links l ON l.doc_id = a.doc_id AND l.person = a.person AND l.id = a.id)\n" + _COUNTS)
def link_agreement(spark, sf_dir):
    return M.linking_agreement(_proposed(spark, sf_dir), _pairs(spark, sf_dir).where(M.system_of(F.col("id")) == "authority"))


@register("external_agreement", "WITH " + _PAIRS + """e AS (SELECT o_orderkey % 97 AS doc_id, md5((o_custkey % 50)::VARCHAR) AS key, arg_max('Q' || (o_orderkey % 3), (o_custkey % 7, -o_orderkey)) AS qid FROM orders GROUP BY 1, 2),
a AS (SELECT * FROM pairs WHERE starts_with(id, 'wikidata:')), h AS (SELECT a.*, coalesce('wikidata:' || e.qid = a.id, false) AS hit FROM a LEFT JOIN e ON e.doc_id = a.doc_id AND e.key = a.person)
""" + _COUNTS)
def external_agreement(spark, sf_dir):
    """Keys of every other order have a letter too many: only the fuzzy join finds them."""
    o = table(spark, sf_dir, "orders")
    key = F.md5((F.col("o_custkey") % 50).cast("string"))
    key = F.when(F.col("o_custkey") % 2 == 0, key).otherwise(F.concat(key, F.lit("x")))
    found = o.select((F.col("o_orderkey") % 97).alias("doc_id"), key.alias("key"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("Q"), (F.col("o_orderkey") % 3).cast("string")).alias("qid"), (F.col("o_custkey") % 7).cast("double").alias("score"))
    return M.external_agreement(found, _pairs(spark, sf_dir).where(M.system_of(F.col("id")) == "external"))


@register("link_sweep", "WITH " + _PAIRS + """a AS (SELECT * FROM pairs WHERE NOT starts_with(id, 'wikidata:')), s AS (SELECT o_orderkey % 97 AS doc_id, md5((o_custkey % 50)::VARCHAR) AS person, 'AUTH:' || (o_custkey % 3) AS id, max(0.6 + o_custkey % 40 / 100.0) AS score FROM orders GROUP BY 1, 2, 3),
f AS (SELECT unnest([0.6, 0.7, 0.8, 0.9])::DOUBLE AS doc_id), h AS (SELECT f.doc_id, a.verdict, coalesce(s.score >= f.doc_id - 1e-9, false) AS hit FROM a LEFT JOIN s ON s.doc_id = a.doc_id AND s.person = a.person AND s.id = a.id, f)
""" + _COUNTS.replace("SELECT doc_id,", "SELECT doc_id AS floor,", 1))
def link_sweep(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).where(M.system_of(F.col("id")) == "authority")
    return M.link_sweep(_proposed(spark, sf_dir), pairs, [0.6, 0.7, 0.8, 0.9])


@register("miss_causes", "WITH " + _PAIRS + """a AS (SELECT DISTINCT doc_id, person, id FROM pairs WHERE verdict = 'accepted' AND NOT starts_with(id, 'wikidata:')),
p AS (SELECT DISTINCT o_orderkey % 97 AS doc_id, md5((o_custkey % 50)::VARCHAR) AS person FROM orders), l AS (SELECT o_orderkey % 97 AS doc_id, md5((o_custkey % 50)::VARCHAR) AS person, 'AUTH:' || (o_custkey % 3) AS top, 'AUTH:' || (o_custkey % 2) AS other FROM orders WHERE o_orderstatus = 'O')
SELECT doc_id, person, id, CASE WHEN bool_or(l.top = a.id) THEN 'HIT' WHEN bool_and(p.person IS NULL) THEN 'not_extracted' WHEN bool_and(l.top IS NULL) THEN 'no_candidates' WHEN bool_or(l.other = a.id) THEN 'ranked_below_top' ELSE 'candidate_missing' END AS cause
FROM a LEFT JOIN p USING (doc_id, person) LEFT JOIN l USING (doc_id, person) GROUP BY 1, 2, 3""")
def miss_causes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 97).alias("doc_id"), F.md5((F.col("o_custkey") % 50).cast("string")).alias("person"), *(F.concat(F.lit("AUTH:"), (F.col("o_custkey") % n).cast("string")).alias(f"a{n}") for n in (3, 2)), "o_orderstatus")
    links = o.where("o_orderstatus = 'O'").select("doc_id", "person", F.col("a3").alias("top_id"), F.array(F.struct(F.col("a2").alias("authority_id"))).alias("candidates"))
    accepted = _pairs(spark, sf_dir).where((M.system_of(F.col("id")) == "authority") & (F.col("verdict") == "accepted"))
    return M.diagnosed(accepted, o.select("doc_id", F.col("person").alias("name")), links).select("doc_id", "person", "id", "cause")


@register("relinked")
def relinked(spark, sf_dir):
    """Stored mentions linked again at the lowest floor once, then read at several."""
    people = X.mentions(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    linked = L.links(people, authority_from_benchmark(spark, sf_dir), floor=0.6)
    gold = people.where("pos = 0").select("doc_id", F.col("name").alias("person"), F.format_string("AUTH:%05d", F.col("doc_id")).alias("id"), F.lit("accepted").alias("verdict"))
    return M.link_sweep(linked, gold, [0.6, 0.75, 0.9])
