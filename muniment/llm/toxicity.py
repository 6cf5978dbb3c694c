"""Toxicity by multiple-instance learning: sentences scored, combined by noisy-or, trained on documents.

A sentence's score is a logistic function of its words' weights; a document is toxic unless every
sentence is not: P = 1 - prod(1 - p_s). Only document labels are known, so the likelihood of the noisy-or
is what training climbs (Adam, all of the sample at once), and the sentence scores come out of it, which
locate the sentences to blame.

The sample is drawn by a hash of the id and bounded by `max_docs`. Features of fewer than `least_docs` sampled
documents get no weight. Scoring covers whole texts.

Defined results: null, empty or wordless text scores as no sentence at all, 0. Without labels of both
kinds all scores are 0. Repeated rows repeat; an id labelled twice takes the larger label; an empty table
gives no rows. Labels, lang, source and doc_id are never inputs of a score; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_WORD, _END = re.compile(r"[^\W_]+"), re.compile(r"[.!?\n]")
PREFIXES = (4, 5, 6, 7, 8)
#: Labels (an id and a bit) are broadcast up to so many, joined by a shuffle beyond.
LABELS = 200_000


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings, for words that inflect or compound."""
    return [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) > k - 1)]


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << 22) - 1)


class Model(dict):
    """Weights by feature, and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        super().__init__(weights)
        self.bias = bias

    def scorer(self):
        """The function from a text to its score and its sentences' scores."""
        by, cache, bias = dict(self), {}, self.bias
        starts = {f.removeprefix("^")[: PREFIXES[0]] for f in by}  # a word that begins otherwise has weight 0

        def weight(token: str) -> float:
            if len(cache) > 400_000:
                cache.clear()
            known = token[: PREFIXES[0]] in starts
            w = cache[token] = sum(by.get(f, 0.0) for f in features(token)) if known else 0.0
            return w

        def score(text: str | None) -> tuple[float, np.ndarray]:
            if not text or not by:
                return 0.0, np.zeros(0)
            sums = []
            for part in _END.split(text.lower()):
                words = _WORD.findall(part)
                if words:
                    total = 0.0
                    for w in set(words):  # a word counts once in a sentence
                        x = cache.get(w)
                        total += weight(w) if x is None else x
                    sums.append(total)
            hazard = np.logaddexp(0, bias + np.array(sums))
            return float(-np.expm1(-hazard.sum())), -np.expm1(-hazard)

        return score


def fit(texts: list[str], label: np.ndarray, least_docs: int = 8, rounds: int = 150, rate: float = 0.1, decay: float = 2e-4) -> Model:
    """Noisy-or weights from texts and 0/1 labels."""
    label = np.asarray(label, float)
    if not len(label) or label.min() == label.max():
        return Model({}, 0.0)
    # In how many documents each feature is, counted by hash: what shares a hash with a frequent one is let
    # through here, but is a feature of its own below.
    seen = np.zeros(1 << 22, np.uint32)
    for text in texts:
        found = {_slot(f) for w in set(_WORD.findall((text or "").lower())) for f in features(w)}
        seen[np.fromiter(found, np.int64, len(found))] += 1
    words: dict[str, int] = {}  # words with a frequent feature, by number; others: -1
    names: dict[str, int] = {}
    of, feature, sentence, word, owner = (array("i") for _ in range(5))
    for d, text in enumerate(texts):
        for part in _END.split((text or "").lower()):
            now = set(_WORD.findall(part))
            if not now:
                continue
            for w in sorted(now):
                if (i := words.get(w)) is None:
                    known = [f for f in features(w) if seen[_slot(f)] >= least_docs]
                    i = words[w] = len(of) if known else -1
                    for f in known:
                        feature.append(names.setdefault(f, len(names)))
                        of.append(i)
                if i >= 0:
                    sentence.append(len(owner))
                    word.append(i)
            owner.append(d)
    del words, seen
    if not len(word):
        return Model({}, 0.0)
    of, feature, sentence, word, owner = (np.frombuffer(q, np.int32) for q in (of, feature, sentence, word, owner))
    size, kept = len(of), np.arange(len(names))  # a word's number is where its features start
    x, b, n = np.zeros(len(kept)), -6.0, len(label)
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, rounds + 1):
        by_word = np.bincount(of, weights=x[feature], minlength=size)
        a = b + np.bincount(sentence, weights=by_word[word], minlength=len(owner))
        hazard = np.bincount(owner, weights=np.logaddexp(0, a), minlength=n)
        pull = (1 - label) - label / np.maximum(np.expm1(np.minimum(hazard, 50)), 1e-6)
        da = pull[owner] / (1 + np.exp(-a))
        dw = np.bincount(word, weights=da[sentence], minlength=size)
        g = np.append(np.bincount(feature, weights=dw[of], minlength=len(kept)) / n + decay * np.sign(x), da.sum() / n)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        x, b = x - move[:-1], b - move[-1]
    name = list(names)
    return Model({name[k]: float(c) for k, c in zip(kept, x, strict=True) if abs(c) > 0.1}, float(b))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic); about max_docs labelled rows are used at most, repeated ones once."""
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = common.if_small(common.durable(labels), LABELS)
    n = docs.select("doc_id").join(labels, "doc_id").count()
    picked = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(labels, "doc_id")
    if n > max_docs:
        picked = picked.where(common.unit_hash("doc_id", "text") < max_docs / n)
    picked = picked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").distinct()
    rows = sorted((r["doc_id"], r["text"] or "", r["toxic"]) for r in picked.toLocalIterator())
    return fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))


_SENTENCE = re.compile(r"[^.!?\n]+")


def scored(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """(doc_id, score, offending) of every whole text; offending: the (start, end, score) in code points of a text
    of at least `least` whose sentences score that much, or if none does alone, of its highest sentence."""
    weights, bias = dict(model), model.bias

    def blame(score, text: str) -> list[dict]:
        found = [{"start": m.start(), "end": m.end(), "score": score(m.group())[0]} for m in _SENTENCE.finditer(text)]
        bad = [x for x in found if x["score"] >= least]
        return bad or [max(found, key=lambda x: x["score"])]

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        score = Model(weights, bias).scorer()
        for batch in common.slices(batches):
            texts = batch.column(1).to_pylist()
            total = [score(t)[0] for t in texts]
            marked = [blame(score, t) if s >= least else [] for t, s in zip(texts, total, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.float64()), pa.array(marked, kind)], ["doc_id", "score", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")


def locate(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """(doc_id, start, end, sentence, score): the offending sentences, one row each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).distinct()
    told = scored(rows.select("doc_id", "text"), model, least).where(F.size("offending") > 0).select("doc_id", F.explode("offending").alias("o")).distinct()
    return told.join(rows, "doc_id").select("doc_id", "o.start", "o.end", F.substring("text", F.col("o.start") + 1, F.col("o.end") - F.col("o.start")).alias("sentence"), "o.score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = F.coalesce(common.fold_of("doc_id", 4) == 2, F.lit(False))
    model = train(docs, labels.where(~held))
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), spans.alias("offending"))
