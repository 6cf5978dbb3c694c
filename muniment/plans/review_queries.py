"""Queries over what reviewers see."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as R
from .registry import register
from .text_queries import table

_LINKS = """links AS (SELECT o_orderkey AS doc_id, 0 AS pos, 'P ' || (o_custkey % 10) AS person, CASE WHEN o_custkey % 4 = 0 THEN 'no_match' WHEN o_custkey % 4 = 1 THEN 'low' WHEN o_custkey % 4 = 2 THEN 'medium' ELSE 'high' END AS status FROM orders),
ids AS (SELECT DISTINCT l_orderkey AS doc_id, 'AUTH:' || (l_suppkey % 5) AS id FROM lineitem),
dec AS (SELECT l_orderkey AS doc_id, 'AUTH:' || (l_suppkey % 5) AS id, max(CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'R' THEN 'reject' ELSE 'flag' END) AS decision FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 2),
r AS (SELECT links.doc_id, links.person, links.status, ids.id, dec.decision FROM links LEFT JOIN ids USING (doc_id) LEFT JOIN dec ON dec.doc_id = links.doc_id AND dec.id = ids.id),
t AS (SELECT doc_id, any_value(person) AS person, any_value(status) AS status, count(*) FILTER (decision = 'accept') AS a, count(*) FILTER (starts_with(decision, 'reject')) AS j, count(*) FILTER (decision = 'flag') AS f, count(*) FILTER (decision IS NULL) AS o FROM r GROUP BY 1)
"""


def _links(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey") % 4
    links = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.lit("P "), (F.col("o_custkey") % 10).cast("string")).alias("person"), F.when(k == 0, "no_match").when(k == 1, "low").when(k == 2, "medium").otherwise("high").alias("status"))
    ids = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set(F.concat(F.lit("AUTH:"), (F.col("l_suppkey") % 5).cast("string"))).alias("ids"))
    return links.join(ids, "doc_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def _decisions(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").where("l_linenumber < 3")
    said = F.when(F.col("l_returnflag") == "A", "accept").when(F.col("l_returnflag") == "R", "reject").otherwise("flag")
    d = i.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("AUTH:"), (F.col("l_suppkey") % 5).cast("string")).alias("id"), said.alias("decision"))
    return d.join(_links(spark, sf_dir).select("doc_id", "person"), "doc_id")


@register("link_filters", "WITH " + _LINKS + "SELECT 'accepted' AS mode, doc_id FROM t WHERE a > 0 UNION ALL SELECT 'rejected', doc_id FROM t WHERE j > 0 UNION ALL SELECT 'flagged', doc_id FROM t WHERE f > 0 UNION ALL SELECT 'unreviewed', doc_id FROM t WHERE a = 0 AND o > 0 UNION ALL SELECT 'no_match', doc_id FROM t WHERE status = 'no_match'")
def link_filters(spark, sf_dir):
    links, said, out = _links(spark, sf_dir), _decisions(spark, sf_dir), None
    for mode in ("accepted", "rejected", "flagged", "unreviewed", "no_match"):
        part = R.filtered_links(links, said, mode=mode).select(F.lit(mode).alias("mode"), "doc_id")
        out = part if out is None else out.unionAll(part)
    return out


@register("review_progress", "WITH " + _LINKS + "SELECT doc_id, count(*) AS total, count(decision) AS reviewed FROM r WHERE id IS NOT NULL GROUP BY 1")
def review_progress(spark, sf_dir):
    return R.progress(_links(spark, sf_dir), _decisions(spark, sf_dir))


@register("link_dashboard", "WITH " + _LINKS + "SELECT coalesce(doc_id, -1) AS doc_id, count(*) AS links, count(*) FILTER (status = 'high') AS high, count(*) FILTER (status = 'medium') AS medium, count(*) FILTER (status = 'low') AS low, count(*) FILTER (status = 'no_match') AS no_match FROM links GROUP BY ROLLUP (doc_id)")
def link_dashboard(spark, sf_dir):
    return R.dashboard(_links(spark, sf_dir)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


@register("decision_map", "WITH " + _LINKS + """SELECT dec.doc_id, '{' || string_agg('"' || dec.doc_id || '::' || lower(person) || '::' || lower(id) || '":"' || decision || '"', ',' ORDER BY lower(id)) || '}' AS json FROM dec JOIN links USING (doc_id) GROUP BY 1""")
def decision_map(spark, sf_dir):
    return R.decision_map(_decisions(spark, sf_dir))


@register("context_comparison", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'match' WHEN p_size % 3 = 1 THEN 'partial' ELSE 'mismatch' END AS place_match, CASE WHEN p_size % 2 = 0 THEN 'match' END AS role_match, 'mismatch' AS date_match FROM part""")
def context_comparison(spark, sf_dir):
    k = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("1099").alias("date"), F.lit("1100").alias("c_date"), F.upper("p_name").alias("place"), F.when(k % 3 == 0, F.concat("p_name", F.lit("!"))).when(k % 3 == 1, F.concat(F.lit("of "), "p_name")).otherwise("zzz").alias("c_place"), F.when(k % 2 == 0, F.col("p_brand")).alias("role"), F.col("p_brand").alias("c_role"))
    return R.context_comparison(p).select("p_partkey", "place_match", "role_match", "date_match")


_VOTES = """v AS (SELECT (l_orderkey % 50)::VARCHAR AS doc_id, 'Per  son ' || (l_partkey % 20) AS person, CASE WHEN l_linenumber % 4 = 0 THEN 'wikidata:Q' ELSE 'AUTH:' END || (l_suppkey % 4) AS id, CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'R' THEN 'reject' ELSE 'flag' END AS decision FROM lineitem),
acc AS (SELECT doc_id, replace(person, '  ', ' ') AS person, id FROM v WHERE starts_with(id, 'AUTH:') GROUP BY 1, 2, 3 HAVING sum(CASE decision WHEN 'accept' THEN 1 WHEN 'reject' THEN -1 ELSE 0 END) > 0),
adj AS (SELECT DISTINCT doc_id, lower(replace(person, '  ', ' ')) AS norm, id FROM v)
"""


def _votes(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    said = F.when(F.col("l_returnflag") == "A", "accept").when(F.col("l_returnflag") == "R", "reject").otherwise("flag")
    return i.select((F.col("l_orderkey") % 50).cast("string").alias("doc_id"), F.concat(F.lit("Per  son "), (F.col("l_partkey") % 20).cast("string")).alias("person"), F.concat(F.when(F.col("l_linenumber") % 4 == 0, "wikidata:Q").otherwise("AUTH:"), (F.col("l_suppkey") % 4).cast("string")).alias("id"), said.alias("decision"))


def _seen(spark, sf_dir):
    """People and links of the worksheet: a third of the names are no longer extracted."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 3 > 0")
    name = F.concat(F.lit("PER son "), (F.col("o_custkey") % 20).cast("string"))
    auth = lambda n: F.concat(F.lit("AUTH:"), (F.col("o_orderkey") % n).cast("string"))
    o = o.select((F.col("o_orderkey") % 50).cast("string").alias("doc_id"), F.col("o_orderkey").alias("pos"), name.alias("name"), name.alias("person"), F.concat(F.lit("seen  in "), F.col("o_orderkey").cast("string")).alias("context"), auth(6).alias("top_id"), (F.col("o_custkey") % 100 / 100).alias("confidence"), F.array(F.struct(auth(6).alias("authority_id")), F.struct(auth(7).alias("authority_id"))).alias("candidates"))
    return o


_SEEN = "seen AS (SELECT (o_orderkey % 50)::VARCHAR AS doc_id, 'per son ' || (o_custkey % 20) AS norm, o_orderkey AS pos, 'seen in ' || o_orderkey AS context, 'AUTH:' || (o_orderkey % 6) AS a, 'AUTH:' || (o_orderkey % 7) AS b, (o_custkey % 100) / 100.0 AS confidence FROM orders WHERE o_custkey % 3 > 0), one AS (SELECT doc_id, norm, arg_min(context, pos) AS context, arg_min(a, pos) AS a, arg_min(b, pos) AS b FROM seen GROUP BY 1, 2)\n"


@register("worksheet_accepts", "WITH " + _VOTES + "SELECT * FROM acc")
def worksheet_accepts(spark, sf_dir):
    return R.accepts(_votes(spark, sf_dir))


@register("worksheet_repair", "WITH " + _VOTES + ", " + _SEEN + """SELECT acc.doc_id, acc.person, acc.id, CASE WHEN acc.id = 'AUTH:1' THEN 'per SON 1' END AS preferred_label, acc.id = 'AUTH:1' AND lower(acc.person) = 'per son 1' AS names_agree, coalesce(one.context, '') AS context, one.norm IS NOT NULL AS extracted,
  concat_ws(',', CASE WHEN one.a <> acc.id THEN one.a END, CASE WHEN one.b <> acc.id THEN one.b END) AS others FROM acc LEFT JOIN one ON one.doc_id = acc.doc_id AND one.norm = lower(acc.person)""")
def worksheet_repair(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    authority = spark.createDataFrame([("AUTH:1", "per SON 1", ["x"])], "authority_id string, preferred_label string, variants array<string>")
    return R.repair_rows(R.accepts(_votes(spark, sf_dir)), seen, seen, authority).drop("variants").withColumn("others", F.array_join("others", ","))


@register("worksheet_growth", "WITH " + _VOTES + ", " + _SEEN + """, g AS (SELECT seen.* FROM seen WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.doc_id = seen.doc_id AND adj.norm = seen.norm AND adj.id = seen.a) ORDER BY confidence DESC, doc_id, pos LIMIT 30)
SELECT row_number() OVER (ORDER BY g.confidence DESC, g.doc_id, g.pos)::INT AS n, g.doc_id, g.a AS top_id, one.context FROM g JOIN one USING (doc_id, norm)""")
def worksheet_growth(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    return R.growth_rows(seen, seen, R.adjudicated(_votes(spark, sf_dir))).select("n", "doc_id", "top_id", "context")


@register("worksheet_blocks", "WITH " + _VOTES + "SELECT person, count(*) AS n FROM acc GROUP BY 1")
def worksheet_blocks(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    authority = spark.createDataFrame([], "authority_id string, preferred_label string, variants array<string>")
    return R.repair_lines(R.repair_rows(R.accepts(_votes(spark, sf_dir)), seen, seen, authority)).where("block LIKE '### %(**names differ**)%'").groupBy("person").agg(F.count(F.lit(1)).alias("n"))


@register("accepted_identity", "SELECT l_orderkey % 500 AS mention_id, arg_max(l_suppkey, (l_orderkey * 10 + l_linenumber)) AS candidate_id FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_suppkey, l_returnflag) WHERE l_returnflag = 'A' GROUP BY 1")
def accepted_identity(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_suppkey", "l_returnflag")).alias("x"))
    d = i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_orderkey").alias("hypothesis_id"), F.col("x.l_suppkey").alias("candidate_id"), F.when(F.col("x.l_returnflag") == "A", "accepted").otherwise("rejected").alias("status"))
    return R.accepted_identity(d, i.select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") % 500).alias("mention_id")).distinct())


@register("evidence_view", """SELECT o_orderkey AS id, coalesce((SELECT min(c_custkey) FROM customer WHERE c_custkey = o_custkey AND o_orderstatus = 'O'), -1) AS mention_id, 'text ' || o_custkey AS passages, o_orderpriority AS agent, (SELECT count(*) FROM customer WHERE c_custkey = o_custkey AND o_orderstatus = 'O') AS candidates FROM orders""")
def evidence_view(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    a = o.select(F.col("o_orderkey").alias("id"), "o_custkey", F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("n"), F.col("o_custkey").cast("string"))).otherwise("none").alias("object"), F.array("o_custkey").alias("passage_ids"), F.col("o_orderpriority").alias("activity_id"))
    keys = o.select(F.col("o_custkey").alias("k")).distinct()
    m = c.select(F.col("c_custkey").alias("id"), F.lit(0).alias("pos"), F.col("c_custkey").alias("passage_id"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("verbatim"))
    p = keys.select(F.col("k").alias("id"), F.concat(F.lit("text "), F.col("k").cast("string")).alias("text"))
    act = o.select(F.col("o_orderpriority").alias("id"), F.col("o_orderpriority").alias("agent")).distinct()
    h = c.select(F.col("c_custkey").alias("mention_id"), F.array(F.lit("x")).alias("candidates"))
    return R.evidence_view(a, m, p, act, h).select("id", F.coalesce("mention_id", F.lit(-1)).alias("mention_id"), F.array_join("passages", ",").alias("passages"), "agent", F.coalesce(F.size("candidates"), F.lit(0)).cast("long").alias("candidates"))
