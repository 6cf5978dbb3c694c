"""Evaluation: extraction and linking against adjudicated gold, error rates, sweeps and gates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T


def share(a: Column, b: Column) -> Column:
    return F.round(a / F.nullif(b.cast("double"), F.lit(0.0)), 4)


def extraction_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, tp, fp, fn, precision, recall, f1) of (doc_id, pos, name) rows: each prediction, in order, takes
    the first gold name left that equals it. Matching depends on order, so a document is one group."""
    tag = lambda df, kind: df.select("doc_id", F.lit(kind).alias("kind"), "pos", T.normalise(F.col("name"), casefold=True).alias("norm"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        left, tp = frame.loc[frame["kind"] == "g", "norm"].tolist(), 0
        said = frame.loc[frame["kind"] == "p", "norm"].tolist()
        total = len(left)
        for p in said:
            hit = next((i for i, g in enumerate(left) if p == g or fuzzy.sort_ratio(p, g) >= 0.9 or fuzzy.sort_ratio(fuzzy.folded(p), fuzzy.folded(g)) >= 0.9), None)
            if hit is not None:
                del left[hit]
                tp += 1
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]], "tp": [tp], "fp": [len(said) - tp], "fn": [total - tp]})

    both = tag(predicted, "p").unionByName(tag(gold, "g"))
    kind = predicted.schema["doc_id"].dataType.simpleString()
    out = both.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, tp long, fp long, fn long")
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return out.select("*", zero(p).alias("precision"), zero(r).alias("recall"), zero(2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def linking_agreement(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, accept_hit, accept_miss, reject_hit, reject_avoided, agreement): pairs (doc_id, person, id,
    verdict) against any top candidate of links (doc_id, person, top_id) of an equal person."""
    named = links.where("top_id IS NOT NULL").select("doc_id", T.normalise(F.col("person"), casefold=True).alias("p_norm"), F.col("top_id").alias("id")).distinct()
    asked = pairs.withColumn("norm", T.normalise(F.col("person"), casefold=True))
    near = asked.select("doc_id", "id", "norm").distinct().join(named, ["doc_id", "id"]).where(fuzzy.equal_udf("norm", "p_norm")).select("doc_id", "id", "norm").distinct().withColumn("hit", F.lit(True))
    return counted(asked.join(near, ["doc_id", "id", "norm"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))), ["doc_id"])


def null_reference(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts summed over `by`, with what a linker that links nothing would score, and the lift over it."""
    n = {c: F.sum(c) for c in ("accept_hit", "accept_miss", "reject_hit", "reject_avoided")}
    out = counts.groupBy(*by).agg(*(v.alias(k) for k, v in n.items()))
    yes, no = F.col("accept_hit") + F.col("accept_miss"), F.col("reject_hit") + F.col("reject_avoided")
    agree, null = (F.col("accept_hit") + F.col("reject_avoided")) / F.nullif((yes + no).cast("double"), F.lit(0.0)), no / F.nullif((yes + no).cast("double"), F.lit(0.0))
    return out.select(*by, *n, F.round(agree, 4).alias("agreement"), F.round(null, 4).alias("null_agreement"), F.round(agree - null, 4).alias("lift"), share(F.col("accept_hit"), yes).alias("accept_rate"), share(no, yes + no).alias("negative_share"))


def system_of(key: Column) -> Column:
    return F.when(F.lower(key).startswith("wikidata:"), "external").otherwise("authority")


def floor_sweep(scored: DataFrame, floors: list[float]) -> DataFrame:
    """Agreement at several candidate floors from scores computed once: scored (id, score, verdict) holds each
    adjudicated pair's best score, null if it isn't the top candidate."""
    rows = scored.select("score", "verdict", F.explode(F.array(*map(F.lit, floors))).alias("floor"))
    hit, yes = F.coalesce(F.col("score") >= F.col("floor"), F.lit(False)), F.col("verdict") == "accepted"
    out = rows.groupBy("floor").agg(F.count_if(yes & hit).alias("accept_hit"), F.count_if(yes & ~hit).alias("accept_miss"), F.count_if(~yes & hit).alias("reject_hit"), F.count_if(~yes & ~hit).alias("reject_avoided"))
    return out.withColumn("agreement", share(F.col("accept_hit") + F.col("reject_avoided"), F.col("accept_hit") + F.col("accept_miss") + F.col("reject_hit") + F.col("reject_avoided")))


def miss_reason(extracted: Column, candidates: Column, contains: Column, is_top: Column) -> Column:
    return F.when(is_top, "HIT").when(~extracted, "not_extracted").when(candidates == 0, "no_candidates").when(contains, "ranked_below_top").otherwise("candidate_missing")


def cer(reference: Column, hypothesis: Column) -> Column:
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / n)


def _as_letters(words: Column, known: Column) -> Column:
    """Words as single letters by their place in `known`, so that levenshtein() counts whole words."""
    return F.array_join(F.transform(words, lambda w: F.char(F.array_position(known, w) + 0x100)), "")


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate. Edit distance on words by rows folded with aggregate()."""
    a, b = (F.filter(F.split(c, r"\s+"), lambda w: w != "") for c in (hypothesis, reference))

    def row(acc: Column, w: Column) -> Column:
        head = F.element_at(acc, 1) + 1
        best = F.transform(F.sequence(F.lit(1), F.size(b)), lambda j: F.least(F.element_at(acc, j + 1) + 1, F.element_at(acc, j) + (F.element_at(b, j) != w).cast("int")))
        return F.aggregate(best, F.array(head), lambda s, v: F.concat(s, F.array(F.least(v, F.element_at(s, -1) + 1))))

    edits = F.element_at(F.aggregate(a, F.sequence(F.lit(0), F.size(b)), row), -1)
    return F.when(F.size(b) == 0, F.when(F.size(a) == 0, 0.0).otherwise(1.0)).otherwise(edits / F.size(b))


def candidate_distance(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, pairs, mean_distance, max_distance) over the pairs of an item's (key, pos, text) candidates."""
    a, b = rows.select(key, F.col("pos").alias("i"), F.col("text").alias("a")), rows.select(key, F.col("pos").alias("j"), F.col("text").alias("b"))
    longest = F.greatest(F.length("a"), F.length("b"))
    d = a.join(b, key).where("i < j").withColumn("d", F.coalesce(F.levenshtein("a", "b") / F.nullif(longest, F.lit(0)), F.lit(0.0)))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("d"), 4).alias("mean_distance"), F.round(F.max("d"), 4).alias("max_distance"))


def selection_metrics(events: DataFrame, by: list[str]) -> DataFrame:
    """Of events (automatic, human, regret): how many were decided, agreed with, and the mean regret."""
    decided = F.col("human").isNotNull()
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), share(F.count_if(decided), F.count(F.lit(1))).alias("coverage"), share(F.count_if(F.col("human") == F.col("automatic")), F.count_if(decided)).alias("agreement"), F.round(F.avg(F.when(decided, F.col("regret"))), 4).alias("mean_regret"))


# Keys that would pass off a selection as the truth.
TRUTH_CLAIMS = ("ground_truth", "gold")


def selection_errors(candidates: Column, automatic: Column, human: Column, event: Column) -> Column:
    """Why a selection event is not valid: choices outside the candidates, a key of TRUTH_CLAIMS at any depth of its JSON."""
    bad = lambda c: c.isNotNull() & ~F.array_contains(candidates, c)
    claimed = event.rlike(rf'(?i)(?<!\\)"(?:{"|".join(TRUTH_CLAIMS)})"\s*:')
    return F.array_compact(F.array(F.when(bad(automatic), "automatic"), F.when(bad(human), "human"), F.when(claimed, "forbidden_key")))


def stacked(counts: dict[str, DataFrame]) -> DataFrame:
    """Frames of equal columns under one another, tagged by type."""
    return reduce(DataFrame.unionByName, [df.withColumn("type", F.lit(k)) for k, df in counts.items()])


def noise_jumps(history: DataFrame, by: str, value: str, most: float = 0.10, part: list[str] | None = None) -> DataFrame:
    """history with the change of `value` from the entry before and whether it exceeds `most`."""
    before = F.lag(value).over(Window.partitionBy(*(part or [F.lit(1)])).orderBy(by))
    return history.withColumn("change", F.round(F.col(value) - before, 4)).withColumn("jump", F.coalesce(F.col(value) - before > most, F.lit(False)))


def gate(samples: DataFrame, min_agreement: float, min_lift: float) -> DataFrame:
    """Per segment over several samples: the least agreement and lift, and whether both pass."""
    out = samples.groupBy("segment").agg(F.min("agreement").alias("least_agreement"), F.round(F.avg("agreement"), 4).alias("mean_agreement"), F.max("agreement").alias("most_agreement"), F.min("lift").alias("least_lift"))
    return out.withColumn("passes", (F.col("least_agreement") >= min_agreement) & (F.col("least_lift") >= min_lift))


def run_totals(runs: DataFrame) -> DataFrame:
    """One row of a run's documents: done, failed, persons, the commonest engine, degraded chunks, noise share."""
    return runs.agg(
        F.count(F.lit(1)).alias("docs_total"), F.count_if("ok").alias("docs_ok"), F.count_if(~F.col("ok")).alias("docs_failed"), F.sum("persons").alias("total_persons"),
        F.mode("engine", True).alias("engine"), F.sum(F.coalesce("fallback_chunks", F.lit(0))).alias("fallback_chunks"), share(F.sum("filtered"), F.sum("filtered") + F.sum("persons")).alias("noise_share"),
    )


def engine_of(llm_chunks: Column, fallback_chunks: Column) -> Column:
    return F.when((llm_chunks > 0) & (fallback_chunks > 0), "mixed").when(llm_chunks > 0, "model").otherwise("heuristic")


# -- links against adjudicated pairs ------------------------------------------------------------------

def counted(judged: DataFrame, by: list[str]) -> DataFrame:
    """The four counts and the agreement of rows (verdict, hit)."""
    yes, hit = F.col("verdict") == "accepted", F.col("hit")
    out = judged.groupBy(*by).agg(F.count_if(yes & hit).alias("accept_hit"), F.count_if(yes & ~hit).alias("accept_miss"), F.count_if(~yes & hit).alias("reject_hit"), F.count_if(~yes & ~hit).alias("reject_avoided"))
    return out.withColumn("agreement", share(F.col("accept_hit") + F.col("reject_avoided"), F.col("accept_hit") + F.col("accept_miss") + F.col("reject_hit") + F.col("reject_avoided")))


def fuzzy_keys(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, norm, key): the key of a document that equals each asked (doc_id, norm), else the first by (pos, key)
    that is close to it. Equal ones are joined first; only what is left meets its document's keys."""
    exact = asked.join(keys.select("doc_id", F.col("key").alias("norm")), ["doc_id", "norm"], "left_semi").withColumn("key", F.col("norm"))
    rest = asked.join(keys.select("doc_id", F.col("key").alias("norm")), ["doc_id", "norm"], "left_anti").join(keys, "doc_id").where(fuzzy.equal_udf("norm", "key"))
    return exact.unionByName(rest.groupBy("doc_id", "norm").agg(F.min(F.struct("pos", "key"))["key"].alias("key")))


def external_agreement(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Agreement of external reconciliation (doc_id, key, pos, qid, score) with adjudicated pairs (doc_id, person, id,
    verdict): the proposal of a mention is the best scored candidate of its key, the first of equals."""
    score = F.coalesce("score", F.lit(0.0))
    best = found.groupBy("doc_id", "key").agg(F.min_by("qid", F.struct(-score, "pos")).alias("qid"), F.min("pos").alias("pos"))
    asked = pairs.withColumn("norm", T.normalise(F.col("person"), casefold=True))
    keys = fuzzy_keys(asked.select("doc_id", "norm").distinct(), best.select("doc_id", "key", "pos"))
    top = keys.join(best.select("doc_id", "key", "qid"), ["doc_id", "key"]).select("doc_id", "norm", "qid")
    hit = F.coalesce(F.col("qid") == F.regexp_replace("id", "^wikidata:", ""), F.lit(False))
    return counted(asked.join(top, ["doc_id", "norm"], "left").withColumn("hit", hit), ["doc_id"])


def link_sweep(linked: DataFrame, pairs: DataFrame, floors: list[float]) -> DataFrame:
    """(floor, counts, agreement): links made once at the lowest floor, read at each. A top candidate at a floor
    is the same at a lower one, so nothing is linked again."""
    named = linked.where("top_id IS NOT NULL").select("doc_id", T.normalise(F.col("person"), casefold=True).alias("p_norm"), F.col("top_id").alias("id"), "confidence")
    named = named.groupBy("doc_id", "p_norm", "id").agg(F.max("confidence").alias("score"))
    asked = pairs.withColumn("norm", T.normalise(F.col("person"), casefold=True))
    near = asked.select("doc_id", "id", "norm").distinct().join(named, ["doc_id", "id"]).where(fuzzy.equal_udf("norm", "p_norm")).groupBy("doc_id", "id", "norm").agg(F.max("score").alias("score"))
    rows = asked.join(near, ["doc_id", "id", "norm"], "left").select("verdict", "score", F.explode(F.array(*map(F.lit, floors))).alias("floor"))
    return counted(rows.withColumn("hit", F.coalesce(F.col("score") >= F.col("floor") - 1e-9, F.lit(False))), ["floor"])


def diagnosed(accepted: DataFrame, people: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, person, id, cause): why each accepted pair is or isn't proposed, from mentions (doc_id, name) and links
    (doc_id, person, top_id, candidates)."""
    asked = accepted.select("doc_id", "person", "id", T.normalise(F.col("person"), casefold=True).alias("norm")).distinct()
    norms = asked.select("doc_id", "norm").distinct()
    names = people.select("doc_id", T.normalise(F.col("name"), casefold=True).alias("key"), F.lit(0).alias("pos")).distinct()
    seen = fuzzy_keys(norms, names).select("doc_id", "norm").distinct().withColumn("seen", F.lit(True))
    ids = F.array_union(F.array_compact(F.array("top_id")), F.coalesce(F.transform("candidates", lambda c: c["authority_id"]), F.array().cast("array<string>")))
    links = linked.select("doc_id", T.normalise(F.col("person"), casefold=True).alias("p_norm"), "top_id", ids.alias("ids"))
    near = norms.join(links.select("doc_id", "p_norm").distinct(), "doc_id").where(fuzzy.equal_udf("norm", "p_norm"))
    near = near.join(links, ["doc_id", "p_norm"]).groupBy("doc_id", "norm").agg(F.collect_set("top_id").alias("tops"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    out = asked.join(seen, ["doc_id", "norm"], "left").join(near, ["doc_id", "norm"], "left")
    has = lambda c: F.coalesce(F.array_contains(c, F.col("id")), F.lit(False))
    cause = miss_reason(F.coalesce("seen", F.lit(False)), F.coalesce(F.size("ids"), F.lit(0)), has("ids"), has("tops"))
    return out.select("doc_id", "person", "id", "ids", cause.alias("cause"))
