"""Human decisions: reading, validation, votes, conflicts, feedback terms and append-only reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What a decision may say.
DECISIONS = ("accept", "reject", "not_a_person", "wrong_era", "is_group")
REVIEWS = ("accept", "reject", "unresolved", "supersede")
MIN_REJECTS, MIN_ACCEPTS = 2, 1


def from_map(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON map document::person::id -> decision object; the key's third part is kept."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<decision:string,ts:string,client_id:string>>").alias("m"))
    rows = raw.select(F.explode("m").alias("key", "d")).withColumn("k", F.split("key", "::"))
    return rows.select(F.col("k")[0].alias("doc_id"), F.col("k")[1].alias("person"), F.get("k", F.lit(2)).alias("id"), F.col("d.decision").alias("decision"), F.col("d.ts").alias("submitted_at"), F.col("d.client_id").alias("client_id"))


def validated(rows: DataFrame) -> DataFrame:
    """rows (doc_id, person, id, decision, client_id, submitted_at) with `errors`: an array of (field, message)."""
    missing = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.struct(F.lit(c).alias("field"), F.lit("missing").alias("message")))
    checks = [missing(c) for c in ("doc_id", "person", "id", "decision", "client_id")]
    checks.append(F.when(~T.decision_of(F.col("decision")).isin(*DECISIONS), F.struct(F.lit("decision").alias("field"), F.lit("unknown").alias("message"))))
    checks.append(F.when(F.col("submitted_at").isNotNull() & ~T.is_iso_time(F.col("submitted_at")), F.struct(F.lit("submitted_at").alias("field"), F.lit("not ISO 8601").alias("message"))))
    return rows.withColumn("errors", F.array_compact(F.array(*checks)))


def latest(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key: upserts and, with a null decision, deletions."""
    by = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("n_", F.row_number().over(by)).where("n_ = 1 AND decision IS NOT NULL").drop("n_")


def majority(rows: DataFrame) -> DataFrame:
    """(doc_id, person, id, votes, verdict): the sign of accepts less rejections; ties are dropped."""
    vote = F.when(F.col("decision") == "accept", 1).when(F.col("decision").isin(*T.REJECTING), -1).otherwise(0)
    out = rows.groupBy("doc_id", "person", "id").agg(F.sum(vote).alias("votes")).where("votes <> 0")
    return out.withColumn("verdict", F.when(F.col("votes") > 0, "accepted").otherwise("rejected"))


def conflicts(rows: DataFrame, min_rejects: int = MIN_REJECTS, min_accepts: int = MIN_ACCEPTS) -> DataFrame:
    """Keys whose reviewers' last decisions both accept and reject, and how the thresholds resolve them. Needs `pos`."""
    keys = [F.lower(F.trim(c)).alias(c) for c in ("doc_id", "person", "id")]
    last = latest(rows.select(*keys, "client_id", "decision", "pos"), ("doc_id", "person", "id", "client_id"), "pos")
    n = last.groupBy("doc_id", "person", "id").agg(F.count_if(F.col("decision") == "accept").alias("accepts"), F.count_if(F.col("decision").isin(*T.REJECTING)).alias("rejects"))
    verdict = F.when((F.col("rejects") >= min_rejects) & (F.col("rejects") > F.col("accepts")), "reject").when((F.col("accepts") >= min_accepts) & (F.col("accepts") >= F.col("rejects")), "accept").otherwise("unresolved")
    return n.where("accepts > 0 AND rejects > 0").withColumn("resolution", verdict)


def feedback_votes(rows: DataFrame, min_rejects: int = MIN_REJECTS, min_accepts: int = MIN_ACCEPTS, distinct_clients: bool = False) -> DataFrame:
    """(norm, name, accepts, rejects, list): names to block or to allow; allowing undoes blocking. Needs `pos`."""
    plain = rows.select(T.normalise(F.col("person"), punctuation=None).alias("norm"), T.collapse(F.col("person")).alias("name"), T.decision_of(F.col("decision")).alias("d"), "client_id", "pos").where("norm <> ''")
    count = (lambda d: F.countDistinct(F.when(F.col("d") == d, F.col("client_id")))) if distinct_clients else (lambda d: F.count_if(F.col("d") == d))
    n = plain.groupBy("norm").agg(F.max_by("name", "pos").alias("name"), count("accept").alias("accepts"), count("reject").alias("rejects"))
    allow = (F.col("accepts") >= min_accepts) & (F.col("accepts") >= F.col("rejects"))
    block = (F.col("rejects") >= min_rejects) & (F.col("rejects") > F.col("accepts"))
    return n.withColumn("list", F.when(allow, "allow").when(block, "block")).where("list IS NOT NULL")


def tallied(tally: DataFrame, batch: DataFrame) -> DataFrame:
    """The flag tally (norm, source, reason, n) after a batch of flagged (norm, source, reason): a source's
    earlier rows are replaced, so a repeated run counts once."""
    now = batch.groupBy("norm", "source", "reason").agg(F.count(F.lit(1)).alias("n"))
    return tally.join(now.select("source").distinct(), "source", "left_anti").select(now.columns).unionByName(now)


def prompt_terms(votes: DataFrame, tally: DataFrame, least: int = 2, most: int = 120) -> DataFrame:
    """(norm, priority, n): blocked terms first, then often flagged ones that aren't allowed."""
    allowed = votes.where("list = 'allow'").select("norm")
    blocked = votes.where("list = 'block'").select("norm", F.lit(0).alias("priority"), F.col("rejects").alias("n"))
    auto = tally.groupBy("norm").agg(F.sum("n").alias("n")).where(F.col("n") >= least).join(blocked, "norm", "left_anti").select("norm", F.lit(1).alias("priority"), "n")
    return blocked.unionByName(auto).join(allowed, "norm", "left_anti").orderBy("priority", F.col("n").desc(), "norm").limit(most)


def community(rows: DataFrame) -> DataFrame:
    """(doc_id, person, id, decision, n, reviewers): votes by decision and the distinct names behind them."""
    who = F.coalesce(F.nullif(F.trim("scholar_name"), F.lit("")), F.lit("Anon"))
    return rows.groupBy("doc_id", "person", "id", "decision").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(who)), ",").alias("reviewers"))


def make_review(rows: DataFrame) -> DataFrame:
    """Review events from (target_id, target_type, action, reviewer, comment, supersedes, timestamp), with errors."""
    error = lambda cond, field, text: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(text).alias("message")))
    errors = F.array_compact(F.array(error(~F.col("action").isin(*REVIEWS), "action", "unknown"), error((F.col("action") == "supersede") & F.col("supersedes").isNull(), "supersedes", "missing")))
    reviewer = T.pseudonym(F.col("reviewer"))
    return rows.withColumn("reviewer", reviewer).withColumn("review_id", T.stable_id("review", "target_id", "action", "reviewer", "timestamp")).withColumn("errors", errors)


def review_state(reviews: DataFrame) -> DataFrame:
    """(target_id, n_reviews, n_active, conflict): a review that another of the same target supersedes is not active."""
    gone = reviews.where("supersedes IS NOT NULL").select("target_id", F.col("supersedes").alias("review_id")).distinct()
    active = reviews.join(gone.withColumn("gone", F.lit(True)), ["target_id", "review_id"], "left").withColumn("on", F.col("gone").isNull())
    return active.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if("on").alias("n_active"),
        (F.bool_or(F.col("on") & (F.col("action") == "accept")) & F.bool_or(F.col("on") & (F.col("action") == "reject"))).alias("conflict"),
    )


def link_resolved(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, person, resolved): any candidate accepted, or all of them rejected. links: (doc_id, person, id) candidates."""
    seen = links.join(rows.select("doc_id", "person", "id", "decision"), ["doc_id", "person", "id"], "left").groupBy("doc_id", "person", "id").agg(F.bool_or(F.col("decision") == "accept").alias("a"), F.bool_or(F.col("decision").isin(*T.REJECTING)).alias("r"))
    return seen.groupBy("doc_id", "person").agg((F.coalesce(F.bool_or("a"), F.lit(False)) | F.bool_and(F.coalesce("r", F.lit(False)))).alias("resolved"))


def validation_report(rows: DataFrame, most: int = 20) -> DataFrame:
    """The first errors by field and message of validated() rows with `pos`."""
    flat = rows.select("pos", F.explode("errors").alias("e")).groupBy("e.field", "e.message").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    return flat.orderBy("first", "field").limit(most)
