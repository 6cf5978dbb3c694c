"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

A document's statistics (below) are transformed so that well-formed text is roughly normal, and judged by
their Mahalanobis distance from a minimum-covariance-determinant (MCD) estimate of its group, a language
and source. Each group has several deterministic starts: medians and quartile ranges, the plain moments, and
SUBSETS of about SUBSET rows drawn by hash. A start takes concentration steps: distances of all the group's
rows under the present estimate, the half with the smallest distances, its mean and covariance. After STEPS of
them the start of the least determinant goes on, until that falls no more (MORE steps at most, README has how
far they get). A last step reweights all rows within the 97.5 % radius.

At scale a group may hold a third of the corpus, so no group is gathered. A step aggregates moments
(count, sums, products) by group, start and distance bin with map-side combination: at most BINS rows of a
start leave the aggregate, and the per-group arithmetic runs on those. The half is cut at a bin's edge.
Quartiles come from counts by group and bin of width GRID. Groups under `least` rows are judged with the rest
of their language, and if that is still under it, with the rest of all.

Defined results: null, empty or wordless text has no words and fails the base rules; null lang or source
is a value of its own; repeated rows are judged alike; an empty table gives no rows; a group too small to
estimate (under LEAST_ANY rows in the last pool) is kept by the method; texts under judge_words words aren't judged by it. Ties in distance fall into one bin
and so are taken or left together. Only doc_id, text, lang and source are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Transformed statistics: log words, log mean word length, roots of the shares of symbols, repeated
#: lines, repeated windows, capitals and ASCII punctuation.
STATS = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeat", "x_upper", "x_punct")
#: Smallest standard deviation of each that counts: below it, differences don't make a text bad. Each statistic can
#: reject by itself: half of the lines repeated, or 29 % of the words in repeated windows, lie beyond the limit.
FLOOR = (0.6, 0.08, 0.06, 0.115, 0.09, 0.08, 0.05)
TAIL = 1e-5  # share of a normal group that the limit would reject
P, STEPS, MORE, BINS, GROUPS, LEAST_ANY = len(STATS), 2, 4, 160, 200_000, 30
SUBSETS, SUBSET, GRID = 4, 12, 0.02
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def text_statistics(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the STATS)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, *[0.0] * P)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    code = np.frombuffer(raw, np.uint8)
    upper, punct = int(_UPPER[code].sum()), int(_PUNCT[code].sum())
    return (
        n, chars, symbols, dup, repeat,
        math.log(n), math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(dup / len(lines)), math.sqrt(repeat / n),
        math.sqrt(upper / chars), math.sqrt(punct / chars),
    )


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words which occurs at least twice."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    word = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    mixed = (word + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    window = np.zeros(n - width + 1, np.uint64)
    for k in range(width):  # a polynomial in an odd 64-bit base; equal windows have equal values
        window *= np.uint64(0x9E3779B97F4A7C15)
        window += mixed[k : n - width + 1 + k]
    order = np.argsort(window, kind="stable")
    i, j = order[:-1], order[1:]
    same = window[i] == window[j]
    if not same.any():
        return 0
    i, j = i[same], j[same]
    at = np.union1d(i, j)
    for k in range(width):
        if (word[i + k] != word[j + k]).any():  # two windows share a value: the words themselves decide
            times: dict[tuple, int] = {}
            rows = [tuple(word[a : a + width].tolist()) for a in at.tolist()]
            for r in rows:
                times[r] = times.get(r, 0) + 1
            at = at[[times[r] > 1 for r in rows]]
            break
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover)[:n] > 0).sum())


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, source, the five base counts, the STATS, also) of every whole text; also: long columns of docs."""
    names = ["doc_id", "lang", "source", *_COUNTS, *STATS, *also]
    schema = "doc_id long, lang string, source string, " + ", ".join([*(f"{c} long" for c in _COUNTS), *(f"{c} double" for c in STATS), *(f"{c} long" for c in also)])

    def run(batches):
        for batch in common.slices(batches):
            found = [text_statistics(t) for t in batch.column(3).to_pylist()]
            columns = list(zip(*found, strict=True)) or [[]] * (5 + P)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.float64()) for c in columns[5:]), *batch.columns[4:]], names
            )

    cols = [F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string")]
    return docs.select(*(c.alias(n) for c, n in zip(cols, ("doc_id", "lang", "source", "text"), strict=True)), *also).mapInArrow(run, schema)


# -- chi-square ---------------------------------------------------------------------------------------

def chi2_cdf(x: float, k: float) -> float:
    """Regularised lower incomplete gamma function P(k/2, x/2) by its series or continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_quantile(p: float, k: float) -> float:
    lo, hi = 0.0, 10.0 * k + 400
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return (lo + hi) / 2


# -- minimum covariance determinant -------------------------------------------------------------------

_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_STATE = "grp string, start int, mu array<double>, w array<double>, log_det double, n_used long"


def estimate(count: float, sums: np.ndarray, products: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, whitening matrix (lower, row by row) and log-determinant of the moments of the nearest
    `share` of a group; the covariance is scaled to be consistent at the normal distribution."""
    mu = sums / count
    cov = np.zeros((P, P))
    for (i, j), s in zip(_PAIRS, products, strict=True):
        cov[i, j] = cov[j, i] = s / count - mu[i] * mu[j]
    if share < 0.999:
        q = chi2_quantile(share, P)
        cov *= share / max(chi2_cdf(q, P + 2), 1e-9)
    cov += np.diag(np.maximum(np.square(FLOOR) - np.diag(cov), 0) + 1e-9)
    # A floor for every direction too: two statistics in lockstep don't make a thin ellipsoid.
    scale = np.sqrt(np.diag(cov))
    value, vector = np.linalg.eigh(cov / np.outer(scale, scale))
    cov = (vector * np.maximum(value, 0.1)) @ vector.T * np.outer(scale, scale)
    low = np.linalg.cholesky(cov)
    white = np.linalg.inv(low)
    return mu, np.array([white[i, j] for i, j in _PAIRS]), float(2 * np.log(np.diag(low)).sum())


def distance2(prefix: str = "") -> Column:
    """Squared Mahalanobis distance from the joined state's mu and w, as one codegen expression."""
    total = None
    for i in range(P):
        row = None
        for n, (a, j) in enumerate(_PAIRS):
            if a == i:
                term = F.col("w")[n] * (F.col(STATS[j]) - F.col("mu")[j])
                row = term if row is None else row + term
        total = row * row if total is None else total + row * row
    return total


def grouped(stats: DataFrame, least: int) -> DataFrame:
    """With column grp: the language and source, the rest of a language, or the rest of all."""
    key = lambda *c: F.to_json(F.struct(*c))
    named = stats.withColumn("g1", key("lang", "source")).withColumn("g2", key("lang"))
    by = common.durable(named.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")))
    own = F.when(F.col("n") >= least, F.col("g1"))
    rest = by.where(F.col("n") < least).groupBy("g2").agg(F.sum("n").alias("n2"))
    by = by.join(rest, "g2", "left").select("g1", F.coalesce(own, F.when(F.col("n2") >= least, F.col("g2")), F.lit("*")).alias("grp"))
    return named.join(common.if_small(by, GROUPS), "g1").drop("g1", "g2")


def _concentrate(last: bool):
    """The step from the moments of a group's start by bin to its next estimate."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        n = frame["n"].to_numpy()
        take = 1 if last else int(np.searchsorted(np.cumsum(n), (n.sum() + P + 1) / 2)) + 1
        part = frame.iloc[: max(1, take)]
        count = part["n"].sum()
        share = 0.975 if last else min(1.0, count / n.sum())
        return _state_row(frame, part, count, share)

    return run


def _state_row(frame: pd.DataFrame, part: pd.DataFrame, count: float, share: float) -> pd.DataFrame:
    sums, products = (part[[f"{k}{i}" for i in range(m)]].sum().to_numpy() for k, m in (("s", P), ("p", len(_PAIRS))))
    mu, white, log_det = estimate(count, sums, products, share)
    return pd.DataFrame({"grp": [frame["grp"].iloc[0]], "start": [int(frame["start"].iloc[0])], "mu": [mu], "w": [white], "log_det": [log_det], "n_used": [int(count)]})


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Count, sums and products of the STATS by keys, combined before they are shuffled."""
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(STATS)] + [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{n}") for n, (i, j) in enumerate(_PAIRS)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)


def quartiles(stats: DataFrame) -> DataFrame:
    """(grp, stat, n, q1, q2, q3) from counts by bin, interpolated within the bin that holds a quartile."""
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.floor(F.col(c) / GRID).cast("long").alias("bin")) for i, c in enumerate(STATS)]))
    bins = stats.select("grp", listed.alias("x")).groupBy("grp", "x.stat", "x.bin").agg(F.count(F.lit(1)).alias("n"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin")
        n, at = frame["n"].to_numpy(float), frame["bin"].to_numpy(float) * GRID
        upto = np.cumsum(n)
        out = {"grp": [frame["grp"].iloc[0]], "stat": [int(frame["stat"].iloc[0])], "n": [int(upto[-1])]}
        for q in (1, 2, 3):
            k = int(np.searchsorted(upto, upto[-1] * q / 4))
            out[f"q{q}"] = [at[k] + GRID * (upto[-1] * q / 4 - (upto[k] - n[k])) / n[k]]
        return pd.DataFrame(out)

    return bins.groupBy("grp", "stat").applyInPandas(run, "grp string, stat int, n long, q1 double, q2 double, q3 double")


def starts(stats: DataFrame) -> DataFrame:
    """(grp, start, mu, w, log_det, n_used): 0 medians and quartile ranges, 1 plain moments, from 2 on subsets."""

    def middle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("stat")
        sd = np.maximum((frame["q3"] - frame["q1"]).to_numpy() / 1.349, FLOOR)
        w = np.array([1 / sd[i] if i == j else 0.0 for i, j in _PAIRS])
        return pd.DataFrame({"grp": [frame["grp"].iloc[0]], "start": [0], "mu": [frame["q2"].to_numpy()], "w": [w], "log_det": [float(2 * np.log(sd).sum())], "n_used": [int(frame["n"].iloc[0])]})

    plain = lambda frame: _state_row(frame, frame, frame["n"].sum(), 1.0)
    first = quartiles(stats).groupBy("grp").applyInPandas(middle, _STATE)
    sizes = common.if_small(common.durable(stats.groupBy("grp").agg(F.greatest(F.lit(SUBSETS), F.ceil(F.count(F.lit(1)) / SUBSET)).alias("parts"))), GROUPS)
    drawn = stats.join(sizes, "grp").withColumn("start", (F.pmod(F.xxhash64(F.lit(9), "doc_id", *STATS), F.col("parts")) + 2).cast("int")).where(F.col("start") < 2 + SUBSETS)
    every = _moments(stats.withColumn("start", F.lit(1)), "grp", "start").unionAll(_moments(drawn, "grp", "start"))
    return first.unionAll(every.groupBy("grp", "start").applyInPandas(plain, _STATE))


def robust_state(stats: DataFrame, steps: int = STEPS, more: int = MORE) -> DataFrame:
    """(grp, start, mu, w, log_det, n_used): the reweighted MCD estimate of each grp of a grouped() table."""
    state = common.durable(starts(stats))
    radius = chi2_quantile(0.975, P)
    near = F.least(F.greatest(F.floor(F.log2(F.col("d2") + 1e-9) * 6) + 60, F.lit(0)), F.lit(BINS)).cast("int")

    def step(state: DataFrame, edge: Column, last: bool = False) -> DataFrame:
        far = stats.join(common.if_small(state.select("grp", "start", "mu", "w"), GROUPS), "grp").withColumn("d2", distance2())
        moments = _moments(far.withColumn("bin", edge), "grp", "start", "bin")
        return common.durable(moments.groupBy("grp", "start").applyInPandas(_concentrate(last), _STATE))

    for n in range(steps + more):
        new = step(state, near)
        if n + 1 == steps:  # of each group's starts the one of the least determinant
            least = new.groupBy("grp").agg(F.min(F.struct("log_det", "start", "mu", "w", "n_used")).alias("x"))
            best = common.durable(least.select("grp", "x.start", "x.mu", "x.w", "x.log_det", "x.n_used"))
            common.drop(new)
            new = best
        done = n >= steps and new.join(state.select("grp", F.col("log_det").alias("old_")), "grp").where(F.col("old_") - F.col("log_det") > 0.02).isEmpty()
        common.drop(state)
        state = new
        if done:
            break
    new = step(state, F.when(F.col("d2") <= radius, 0).otherwise(1), True)
    common.drop(state)
    return new


def judged(docs: DataFrame, tail: float = TAIL, least: int = 100, min_words: int = 20, repeat_percent: int = 30, judge_words: int = 20, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, distance, also): distance is null where no estimate exists. Texts
    under judge_words words say too little for a distance: they neither enter an estimate nor are judged by it."""
    stats = common.durable(grouped(common.durable(statistics(docs, also)), least))
    long = F.col("n_words") >= judge_words
    state = robust_state(stats.where(long))
    enough = common.if_small(state.where(F.col("n_used") * 2 >= LEAST_ANY).select("grp", "mu", "w"), GROUPS)
    bad = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    out = stats.join(enough, "grp", "left").withColumn("distance", F.sqrt(distance2())).withColumn("base_failed", bad)
    limit = math.sqrt(chi2_quantile(1 - tail, P))
    kept = ~F.col("base_failed") & (~long | (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit))
    return out.select("doc_id", *_COUNTS, "base_failed", kept.alias("kept"), F.when(F.col("n_words") > 0, F.col("distance")).alias("distance"), *also)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"))
