"""Queries over human decisions. The events table stands in for them: a user is a reviewer, k a person."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decisions as D
from ..operators import metrics as M
from ..streaming import incremental
from .registry import register

_SQL = """WITH d AS (
  SELECT event_id AS pos, ts, 'doc' || (user_id % 7) AS doc_id, 'Person ' || (props->>'$.k') AS person, 'AUTH:' || ((props->>'$.k')::BIGINT % 50) AS id, 'c' || user_id AS client_id,
         CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'not_a_person' WHEN 'view' THEN 'is_group' ELSE 'accept' END AS decision, value
  FROM events)
"""
_REJ = "decision IN ('reject', 'not_a_person', 'wrong_era', 'is_group')"


def decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "signup", "not_a_person").when(F.col("event_type") == "view", "is_group").otherwise("accept")
    return e.select(
        F.col("event_id").alias("pos"), "ts", F.concat(F.lit("doc"), (F.col("user_id") % 7).cast("string")).alias("doc_id"), F.concat(F.lit("Person "), k).alias("person"),
        F.concat(F.lit("AUTH:"), (k.cast("long") % 50).cast("string")).alias("id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client_id"), kind.alias("decision"), "value",
    )


@register("vote_majority", _SQL + f"""
SELECT doc_id, person, id, sum(CASE WHEN decision = 'accept' THEN 1 WHEN {_REJ} THEN -1 ELSE 0 END)::BIGINT AS votes,
       CASE WHEN sum(CASE WHEN decision = 'accept' THEN 1 WHEN {_REJ} THEN -1 ELSE 0 END) > 0 THEN 'accepted' ELSE 'rejected' END AS verdict
FROM d GROUP BY ALL HAVING votes <> 0""".replace("GROUP BY ALL", "GROUP BY doc_id, person, id"))
def vote_majority(spark, sf_dir):
    return D.majority(decision_rows(spark, sf_dir))


@register("conflicts", _SQL + f""", l AS (
  SELECT doc_id, person, id, client_id, arg_max(decision, pos) AS decision FROM d GROUP BY 1, 2, 3, 4),
n AS (SELECT lower(doc_id) AS doc_id, lower(person) AS person, lower(id) AS id, count(*) FILTER (decision = 'accept') AS accepts, count(*) FILTER ({_REJ}) AS rejects FROM l GROUP BY 1, 2, 3)
SELECT *, CASE WHEN rejects >= 2 AND rejects > accepts THEN 'reject' WHEN accepts >= 1 AND accepts >= rejects THEN 'accept' ELSE 'unresolved' END AS resolution
FROM n WHERE accepts > 0 AND rejects > 0""")
def conflicts(spark, sf_dir):
    return D.conflicts(decision_rows(spark, sf_dir))


_VOTES = """, v AS (
  SELECT lower(person) AS norm, arg_max(person, pos) AS name, count(*) FILTER (decision = 'accept') AS accepts, count(*) FILTER (decision IN ('reject', 'not_a_person', 'wrong_era')) AS rejects
  FROM d GROUP BY 1),
l AS (SELECT *, CASE WHEN accepts >= 1 AND accepts >= rejects THEN 'allow' WHEN rejects >= 2 AND rejects > accepts THEN 'block' END AS list FROM v)
"""


@register("feedback_votes", _SQL + _VOTES + "SELECT * FROM l WHERE list IS NOT NULL")
def feedback_votes(spark, sf_dir):
    return D.feedback_votes(decision_rows(spark, sf_dir))


def _flags(spark, sf_dir):
    d = decision_rows(spark, sf_dir)
    return d.select(T.normalise(F.col("person"), punctuation=None).alias("norm"), F.col("doc_id").alias("source"), F.col("decision").alias("reason"), "pos")


@register("flag_tally", _SQL + """, f AS (SELECT lower(person) AS norm, doc_id AS source, decision AS reason, pos FROM d),
a AS (SELECT norm, source, reason, count(*) AS n FROM f WHERE pos % 2 = 0 GROUP BY 1, 2, 3),
b AS (SELECT norm, source, reason, count(*) AS n FROM f WHERE pos % 2 = 1 AND source <> 'doc3' GROUP BY 1, 2, 3)
SELECT * FROM a WHERE source NOT IN (SELECT source FROM b) UNION ALL SELECT * FROM b""")
def flag_tally(spark, sf_dir):
    f = _flags(spark, sf_dir)
    old = f.where("pos % 2 = 0").groupBy("norm", "source", "reason").agg(F.count(F.lit(1)).alias("n"))
    return D.tallied(old, f.where("pos % 2 = 1 AND source <> 'doc3'").select("norm", "source", "reason"))


@register("feedback_terms", _SQL + _VOTES + """, t AS (SELECT lower(person) AS norm, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 2),
b AS (SELECT norm, 0 AS priority, rejects AS n FROM l WHERE list = 'block'),
u AS (SELECT * FROM b UNION ALL SELECT norm, 1, n FROM t WHERE norm NOT IN (SELECT norm FROM b))
SELECT * FROM u WHERE norm NOT IN (SELECT norm FROM l WHERE list = 'allow') ORDER BY priority, n DESC, norm LIMIT 120""")
def feedback_terms(spark, sf_dir):
    tally = _flags(spark, sf_dir).groupBy("norm", "source", "reason").agg(F.count(F.lit(1)).alias("n"))
    return D.prompt_terms(D.feedback_votes(decision_rows(spark, sf_dir)), tally)


@register("community_index", _SQL + "SELECT doc_id, person, id, decision, count(*) AS n, string_agg(DISTINCT client_id, ',' ORDER BY client_id) AS reviewers FROM d GROUP BY 1, 2, 3, 4")
def community_index(spark, sf_dir):
    return D.community(decision_rows(spark, sf_dir).withColumn("scholar_name", F.col("client_id")))


@register("upsert_votes", _SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, person, id, client_id ORDER BY pos DESC) AS rn FROM d)
SELECT doc_id, person, id, client_id, decision, pos FROM r WHERE rn = 1 AND value >= 5""")
def upsert_votes(spark, sf_dir):
    d = decision_rows(spark, sf_dir).withColumn("decision", F.when(F.col("value") >= 5, F.col("decision")))
    return D.latest(d, ("doc_id", "person", "id", "client_id"), "pos").select("doc_id", "person", "id", "client_id", "decision", "pos")


@register("decision_errors", _SQL + """, x AS (SELECT pos, CASE WHEN value < 1 THEN 'maybe' ELSE decision END AS decision, CASE WHEN value > 100 THEN 'soon' ELSE '2024-01-02T03:04:05Z' END AS t, CASE WHEN value BETWEEN 2 AND 3 THEN ' ' ELSE person END AS person FROM d)
SELECT pos, 'decision' AS field, 'unknown' AS message FROM x WHERE decision = 'maybe'
UNION ALL SELECT pos, 'submitted_at', 'not ISO 8601' FROM x WHERE t = 'soon' UNION ALL SELECT pos, 'person', 'missing' FROM x WHERE trim(person) = ''""")
def decision_errors(spark, sf_dir):
    d = decision_rows(spark, sf_dir).withColumn("decision", F.when(F.col("value") < 1, "maybe").otherwise(F.col("decision")))
    d = d.withColumn("submitted_at", F.when(F.col("value") > 100, "soon").otherwise("2024-01-02T03:04:05Z")).withColumn("person", F.when(F.col("value").between(2, 3), " ").otherwise(F.col("person")))
    return D.validated(d).select("pos", F.explode("errors").alias("e")).select("pos", "e.field", "e.message")


def _reviews(spark, sf_dir):
    d = decision_rows(spark, sf_dir)
    action = F.when(F.col("decision") == "accept", "accept").when(F.col("decision") == "reject", "reject").otherwise("unresolved")
    return d.select(F.col("person").alias("target_id"), F.col("pos").cast("string").alias("review_id"), action.alias("action"), F.when(F.col("value") > 10, (F.col("pos") - 1).cast("string")).alias("supersedes"))


@register("review_state", _SQL + """, r AS (SELECT person AS target_id, pos::VARCHAR AS review_id, CASE decision WHEN 'accept' THEN 'accept' WHEN 'reject' THEN 'reject' ELSE 'unresolved' END AS action, CASE WHEN value > 10 THEN (pos - 1)::VARCHAR END AS supersedes FROM d),
a AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM r s WHERE s.target_id = r.target_id AND s.supersedes = r.review_id) AS live FROM r)
SELECT target_id, count(*) AS n_reviews, count(*) FILTER (live) AS n_active, bool_or(live AND action = 'accept') AND bool_or(live AND action = 'reject') AS conflict FROM a GROUP BY 1""")
def review_state(spark, sf_dir):
    return D.review_state(_reviews(spark, sf_dir))


@register("link_resolved", _SQL + f""", s AS (SELECT doc_id, person, id, bool_or(decision = 'accept') AS a, bool_or({_REJ}) AS r FROM d GROUP BY 1, 2, 3)
SELECT doc_id, person, bool_or(a) OR bool_and(r) AS resolved FROM s GROUP BY 1, 2""")
def link_resolved(spark, sf_dir):
    d = decision_rows(spark, sf_dir)
    return D.link_resolved(d.select("doc_id", "person", "id").distinct(), d)


@register("review_events", _SQL + """SELECT pos, 'reviewer-' || substr(sha256(client_id), 1, 12) AS reviewer,
  'id:review:' || substr(sha256(person || chr(31) || decision || chr(31) || 'reviewer-' || substr(sha256(client_id), 1, 12) || chr(31) || pos::VARCHAR), 1, 24) AS review_id, CASE WHEN decision NOT IN ('accept', 'reject') THEN 1 ELSE 0 END::BIGINT AS n_errors FROM d""")
def review_events(spark, sf_dir):
    d = decision_rows(spark, sf_dir)
    rows = d.select("pos", F.col("person").alias("target_id"), F.lit("Mention").alias("target_type"), F.col("decision").alias("action"), F.col("client_id").alias("reviewer"), F.lit("").alias("comment"), F.lit(None).cast("string").alias("supersedes"), F.col("pos").cast("string").alias("timestamp"))
    return D.make_review(rows).select("pos", "reviewer", "review_id", F.size("errors").cast("long").alias("n_errors"))


@register("decision_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def decision_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type")
    return incremental.decision_counts(e, "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("noise_jump", """WITH h AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(count(*) FILTER (value > 50)::DOUBLE / count(*), 4) AS noise_share FROM events GROUP BY 1, 2)
SELECT *, round(noise_share - lag(noise_share) OVER w, 4) AS change, coalesce(noise_share - lag(noise_share) OVER w > 0.05, false) AS jump FROM h WINDOW w AS (PARTITION BY event_type ORDER BY day)""")
def noise_jump(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    h = e.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.count_if(F.col("value") > 50) / F.count(F.lit(1)), 4).alias("noise_share"))
    return M.noise_jumps(h, "day", "noise_share", 0.05, ["event_type"])


@register("selection_metrics", """SELECT event_type, count(*) AS events, round(count(*) FILTER (user_id % 3 > 0)::DOUBLE / count(*), 4) AS coverage,
  round(count(*) FILTER (user_id % 3 = 1)::DOUBLE / count(*) FILTER (user_id % 3 > 0), 4) AS agreement, round(avg(value) FILTER (user_id % 3 > 0), 4) AS mean_regret FROM events GROUP BY 1""")
def selection_metrics(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    human = F.when(F.col("user_id") % 3 == 1, "a").when(F.col("user_id") % 3 == 2, "b")
    return M.selection_metrics(e.select("event_type", F.lit("a").alias("automatic"), human.alias("human"), F.col("value").alias("regret")), ["event_type"])


@register("run_totals", """SELECT count(*) AS docs_total, count(*) FILTER (value < 100) AS docs_ok, count(*) FILTER (value >= 100) AS docs_failed, sum(user_id)::BIGINT AS total_persons,
  (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) AS engine, sum(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS fallback_chunks,
  round(sum(event_id % 5)::DOUBLE / (sum(event_id % 5) + sum(user_id)), 4) AS noise_share FROM events""")
def run_totals(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return M.run_totals(e.select((F.col("value") < 100).alias("ok"), F.col("user_id").alias("persons"), F.col("event_type").alias("engine"), F.when(F.col("user_id") % 2 == 0, F.lit(1).cast("long")).alias("fallback_chunks"), (F.col("event_id") % 5).alias("filtered")))


@register("dashboard", """WITH e AS (SELECT 'doc' || (user_id % 7) AS doc_id, CASE WHEN value >= 90 THEN 'high' WHEN value >= 75 THEN 'medium' WHEN value >= 60 THEN 'low' ELSE 'no_match' END AS status FROM events)
SELECT doc_id, count(*) AS links, count(*) FILTER (status = 'high') AS high, count(*) FILTER (status = 'medium') AS medium, count(*) FILTER (status = 'low') AS low, count(*) FILTER (status = 'no_match') AS no_match FROM e GROUP BY ROLLUP (doc_id)""")
def dashboard(spark, sf_dir):
    from ..operators.linking import status

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("doc"), (F.col("user_id") % 7).cast("string")).alias("doc_id"), status(F.col("value") / 100).alias("status"))
    return e.rollup("doc_id").agg(F.count(F.lit(1)).alias("links"), *(F.count_if(F.col("status") == s).alias(s) for s in ("high", "medium", "low", "no_match")))


@register("engine_provenance", """SELECT user_id, CASE WHEN sum((event_type = 'view')::INT) > 0 AND sum((event_type = 'error')::INT) > 0 THEN 'mixed' WHEN sum((event_type = 'view')::INT) > 0 THEN 'model' ELSE 'heuristic' END AS engine FROM events GROUP BY 1""")
def engine_provenance(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("m"), F.count_if(F.col("event_type") == "error").alias("f"))
    return e.select("user_id", M.engine_of(F.col("m"), F.col("f")).alias("engine"))


@register("wide_long_merge", """WITH s AS (SELECT event_id AS pos, 'Q' || user_id AS qid, event_type AS label, CASE event_type WHEN 'signup' THEN 'P569' WHEN 'error' THEN 'P570' WHEN 'click' THEN 'P21' WHEN 'view' THEN 'P39' ELSE 'P26' END AS prop,
  CASE event_type WHEN 'click' THEN CASE WHEN (props->>'$.k')::INT % 2 = 0 THEN 'male' ELSE 'female' END ELSE 'v' || (props->>'$.k') END AS v FROM events)
SELECT qid, arg_min(label, pos) AS label, arg_min(v, pos) FILTER (prop = 'P569') AS birth, arg_min(v, pos) FILTER (prop = 'P570') AS death,
  CASE arg_min(v, pos) FILTER (prop = 'P21') WHEN 'male' THEN 'm' WHEN 'female' THEN 'f' ELSE 'unknown' END AS gender,
  count(DISTINCT v) FILTER (prop = 'P39') AS n_roles, count(DISTINCT v) FILTER (prop = 'P26') AS n_spouses FROM s GROUP BY 1""")
def wide_long_merge(spark, sf_dir):
    from ..operators import graph

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    prop = F.when(F.col("event_type") == "signup", "P569").when(F.col("event_type") == "error", "P570").when(F.col("event_type") == "click", "P21").when(F.col("event_type") == "view", "P39").otherwise("P26")
    v = F.when(F.col("event_type") == "click", F.when(k.cast("int") % 2 == 0, "male").otherwise("female")).otherwise(F.concat(F.lit("v"), k))
    s = e.select(F.col("event_id").alias("pos"), F.concat(F.lit("Q"), F.col("user_id").cast("string")).alias("qid"), F.col("event_type").alias("label"), prop.alias("prop"), v.alias("value_label"))
    return graph.people_of(s).select("qid", "label", "birth", "death", "gender", F.size("roles").cast("long").alias("n_roles"), F.size("relations").cast("long").alias("n_spouses"))


@register("incremental_reviews")
def incremental_reviews(spark, sf_dir):
    """The reviews as a batch of a stream's input: the state that the streaming operator keeps, from the batch one."""
    return D.review_state(_reviews(spark, sf_dir))
