"""What reviewers see: filters over links and their decisions, contexts compared, worksheets, and the evidence behind
a decision. Decisions join on keys; nothing is looked up row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MODES = ("all", "unreviewed", "no_match", "conflict", "accepted", "rejected", "flagged")


def sheet_norm(c: Column) -> Column:
    """The worksheet's form of a name: case and white space only."""
    return T.normalise(c, marks=False, punctuation=None, casefold=True)


def filtered_links(links: DataFrame, decisions: DataFrame, conflicts: DataFrame | None = None, mode: str = "all") -> DataFrame:
    """Rows of links (doc_id, pos, person, status, ids) that a filter shows. ids: all candidate ids, those of external
    candidates for persons without others. decisions: (doc_id, person, id, decision), one row a key; conflicts:
    (doc_id, person, id). unreviewed: unresolved (nothing accepted) and a candidate, or all of none, undecided."""
    if mode not in MODES:
        raise ValueError(f"no such filter: {mode}")
    if mode == "all":
        return links
    if mode == "no_match":
        return links.where("status = 'no_match'")
    key = lambda df: df.withColumn("key_", T.decision_key(F.col("doc_id").cast("string"), F.col("person"), F.col("id")))
    rows = key(links.select("doc_id", "pos", "person", F.explode_outer("ids").alias("id")))
    said = conflicts.withColumn("decision", F.lit("conflict")) if mode == "conflict" else decisions
    said = key(said).groupBy("key_").agg(F.max("decision").alias("decision"))
    told = rows.join(said, "key_", "left").groupBy("doc_id", "pos").agg(
        F.count_if(F.col("decision") == "accept").alias("accept"), F.count_if(F.col("decision").startswith("reject")).alias("reject"), F.count_if(F.col("decision") == "flag").alias("flag"),
        F.count_if(F.col("decision") == "conflict").alias("conflict"), F.count_if(F.col("decision").isNull()).alias("open"),
    )
    wanted = {"accepted": "accept > 0", "rejected": "reject > 0", "flagged": "flag > 0", "conflict": "conflict > 0", "unreviewed": "accept = 0 AND open > 0"}[mode]
    return links.join(told.where(wanted).select("doc_id", "pos"), ["doc_id", "pos"], "left_semi")


def compared(extracted: Column, candidate: Column) -> Column:
    """match, partial (one form holds the other), mismatch, or null where either is missing."""
    form = lambda c: F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[^\w\s]", "")), F.lit(""))
    a, b = form(extracted), form(candidate)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a == b, "match").when(a.contains(b) | b.contains(a), "partial").otherwise("mismatch")


def context_comparison(rows: DataFrame) -> DataFrame:
    """rows with what date, place and role of a mention and of its candidate (c_date, c_place, c_role) have in common."""
    return rows.select("*", *[compared(F.col(k).cast("string"), F.col(f"c_{k}").cast("string")).alias(f"{k}_match") for k in ("date", "place", "role")])


# -- worksheets ---------------------------------------------------------------------------------------

def adjudicated(decisions: DataFrame) -> DataFrame:
    """(doc_id, person_norm, id): keys that have a decision."""
    return decisions.where("decision <> ''").select(F.trim("doc_id").alias("doc_id"), sheet_norm(F.col("person")).alias("person_norm"), F.trim("id").alias("id")).distinct()


def accepts(decisions: DataFrame) -> DataFrame:
    """(doc_id, person, id) of authority pairs with more accepting than rejecting votes; ties are disputes."""
    said = T.decision_of(F.col("decision"))
    vote = F.when(said == "accept", 1).when(said == "reject", -1).otherwise(0)
    rows = decisions.where(F.trim("id").startswith("AUTH:")).select(F.trim("doc_id").alias("doc_id"), T.collapse(F.col("person")).alias("person"), F.trim("id").alias("id"), vote.alias("v"))
    return rows.groupBy("doc_id", "person", "id").agg(F.sum("v").alias("v")).where("v > 0").drop("v")


def contexts(people: DataFrame) -> DataFrame:
    """(doc_id, person_norm, context): of the first mention of a name, on one line, 200 characters."""
    rows = people.select("doc_id", "pos", sheet_norm(F.col("name")).alias("person_norm"), F.substring(T.collapse(F.col("context")), 1, 200).alias("context"))
    return rows.groupBy("doc_id", "person_norm").agg(F.min_by("context", "pos").alias("context"))


def repair_rows(accepted: DataFrame, people: DataFrame, links: DataFrame, authority: DataFrame, others: int = 3) -> DataFrame:
    """Accepted pairs with the record they name (authority: authority_id, preferred_label, variants), whether names agree,
    the context, whether the mention is still extracted, and the other candidates of the first link of the name."""
    pairs = accepted.withColumn("person_norm", sheet_norm(F.col("person")))
    offered = links.select("doc_id", "pos", sheet_norm(F.col("person")).alias("person_norm"), "candidates").groupBy("doc_id", "person_norm").agg(F.min_by("candidates", "pos").alias("candidates"))
    known = authority.where("authority_id <> ''").dropDuplicates(["authority_id"]).select(F.col("authority_id").alias("id"), "preferred_label", "variants")
    rows = pairs.join(known, "id", "left").join(contexts(people).withColumn("extracted", F.lit(True)), ["doc_id", "person_norm"], "left").join(offered, ["doc_id", "person_norm"], "left")
    rest = F.slice(F.filter("candidates", lambda c: c["authority_id"] != F.col("id")), 1, others)
    return rows.select(
        "doc_id", "person", "id", "preferred_label", F.slice("variants", 1, 6).alias("variants"), sheet_norm(F.coalesce("preferred_label", F.lit(""))).eqNullSafe(F.col("person_norm")).alias("names_agree"),
        F.coalesce("context", F.lit("")).alias("context"), F.coalesce("extracted", F.lit(False)).alias("extracted"), F.coalesce(F.transform(rest, lambda c: c["authority_id"]), F.array().cast("array<string>")).alias("others"),
    )


def growth_rows(links: DataFrame, people: DataFrame, reviewed: DataFrame, size: int = 30) -> DataFrame:
    """The `size` best top candidates without a decision, numbered; ties by document and place."""
    asked = links.where(F.col("top_id").startswith("AUTH:")).select("doc_id", "pos", "person", "top_id", "confidence", sheet_norm(F.col("person")).alias("person_norm"))
    keys = reviewed.select("doc_id", "person_norm", F.col("id").alias("top_id"))
    best = asked.join(keys, ["doc_id", "person_norm", "top_id"], "left_anti").orderBy(F.col("confidence").desc(), "doc_id", "pos").limit(size)
    number = F.row_number().over(Window.orderBy(F.col("confidence").desc(), "doc_id", "pos"))  # over `size` rows
    return best.join(contexts(people), ["doc_id", "person_norm"], "left").select(number.alias("n"), "doc_id", "person", "top_id", "confidence", F.coalesce("context", F.lit("")).alias("context"))


def repair_lines(rows: DataFrame) -> DataFrame:
    """(person, block): a Markdown block a pair, to be read in the order of lower-cased persons."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    block = F.concat_ws(
        "\n", line("### ", F.col("person"), " → `", F.col("id"), "`"), line("- Authority record: ", F.coalesce("preferred_label", F.lit("(none)")), F.when(F.col("names_agree"), " (names agree)").otherwise(" (**names differ**)")),
        line("- Document: `", F.col("doc_id").cast("string"), "`"), F.when(F.col("context") != "", line("- Context: ", F.col("context"))), F.when(~F.col("extracted"), F.lit("- No longer extracted from the document")),
        F.when(F.size("variants") > 0, line("- Variants: ", F.array_join("variants", ", "))), F.when(F.size("others") > 0, line("- Other candidates: ", F.array_join("others", ", "))),
        F.lit("| verdict | relink to | note |\n|---|---|---|\n| confirm / reject / relink | | |"),
    )
    return rows.select(F.lower("person").alias("order"), "person", block.alias("block")).orderBy("order", "block")


def progress(links: DataFrame, decided: DataFrame) -> DataFrame:
    """(doc_id, total, reviewed): candidates of links (doc_id, person, ids) and those with a decision."""
    key = lambda df: df.withColumn("key_", T.decision_key(F.col("doc_id").cast("string"), F.col("person"), F.col("id")))
    rows = key(links.select("doc_id", "person", F.explode("ids").alias("id"))).join(key(decided).select("key_", F.lit(1).alias("d_")).distinct(), "key_", "left")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count("d_").alias("reviewed"))


def dashboard(links: DataFrame) -> DataFrame:
    """(doc_id, links, high, medium, low, no_match) of each document, and of all under a null doc_id."""
    return links.rollup("doc_id").agg(F.count(F.lit(1)).alias("links"), *[F.count_if(F.col("status") == s).alias(s) for s in ("high", "medium", "low", "no_match")])


def decision_map(decisions: DataFrame) -> DataFrame:
    """(doc_id, json): a document's decisions as one object by key."""
    entry = F.struct(T.decision_key(F.col("doc_id").cast("string"), F.col("person"), F.col("id")).alias("k"), F.col("decision").alias("v"))
    one = decisions.select("doc_id", entry.alias("e")).groupBy("doc_id", "e.k").agg(F.max("e.v").alias("v"))
    return one.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("json"))


def accepted_identity(decisions: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(mention_id, candidate_id): what the last accepted decision (pos, hypothesis_id, candidate_id, status) of a mention chose."""
    rows = decisions.where("status = 'accepted'").join(hypotheses.select(F.col("id").alias("hypothesis_id"), "mention_id"), "hypothesis_id")
    return rows.groupBy("mention_id").agg(F.max_by("candidate_id", "pos").alias("candidate_id"))


def evidence_view(assertions: DataFrame, mentions: DataFrame, passages: DataFrame, activities: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """(id, mention_id, passages, agent, candidates) of assertions (id, object, passage_ids, activity_id): the first mention
    (id, pos, passage_id, verbatim) in one of its passages that reads like its object, and the mention's candidates."""
    spans = assertions.select("id", "object", F.explode_outer("passage_ids").alias("passage_id"))
    said = spans.join(mentions.select("passage_id", F.col("verbatim").alias("object"), F.col("id").alias("mention_id"), "pos"), ["passage_id", "object"]).groupBy("id").agg(F.min_by("mention_id", "pos").alias("mention_id"))
    texts = spans.join(passages.select(F.col("id").alias("passage_id"), "text"), "passage_id").groupBy("id").agg(F.array_sort(F.collect_list("text")).alias("passages"))
    agents = activities.select(F.col("id").alias("activity_id"), "agent")
    out = assertions.select("id", "activity_id").join(said, "id", "left").join(texts, "id", "left").join(agents, "activity_id", "left")
    return out.join(hypotheses.select("mention_id", "candidates"), "mention_id", "left").select("id", "mention_id", "passages", "agent", "candidates")
