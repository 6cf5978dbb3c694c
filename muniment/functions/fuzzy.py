"""Similarity of names: ratios from the longest common subsequence, on words in order or as sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import PARTICLES


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the letters of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        u = row & at.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both, only_a, only_b = (sorted(s) for s in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 1.0
    i, ia, ib = " ".join(both), " ".join(both + only_a), " ".join(both + only_b)
    return max([ratio(ia, ib), *([ratio(i, ia), ratio(i, ib)] if both else [])])


def folded(norm: str) -> str:
    kept = [t for t in norm.split() if t not in PARTICLES]
    return " ".join(kept) if len(kept) >= 2 else norm


def ensemble(a: str, b: str) -> float:
    """The best of: words in order; the same without particles; 0.9 of word sets without particles, from two words on."""
    fa, fb = folded(a), folded(b)
    best = sort_ratio(a, b)
    if (fa, fb) != (a, b):
        best = max(best, sort_ratio(fa, fb))
    if len(fa.split()) >= 2 and len(fb.split()) >= 2:
        best = max(best, 0.9 * set_ratio(fa, fb))
    return best


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger word set: the plain form where no edit ratio is wanted."""
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")) for c in (a, b))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.greatest(F.size(x), F.size(y)), F.lit(0)), F.lit(0.0))


def lcs_column(a: Column, b: Column) -> Column:
    """lcs() as a Catalyst expression: the table's rows folded with aggregate()."""
    letters, others = (F.filter(F.split(c, ""), lambda x: x != "") for c in (a, b))

    def row(acc: Column, c: Column) -> Column:
        up = F.transform(F.sequence(F.lit(1), F.size(others)), lambda j: F.greatest(F.element_at(acc, j + 1), F.element_at(acc, j) + (F.element_at(others, j) == c).cast("int")))
        start = F.array(F.lit(0))
        return F.aggregate(up, start, lambda s, v: F.concat(s, F.array(F.greatest(F.element_at(s, -1), v))))

    zero = F.array_repeat(F.lit(0), F.size(others) + 1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(F.aggregate(letters, zero, row), -1))


def ratio_column(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * lcs_column(a, b) / total)


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda t: t != "")), " ")


def sort_ratio_column(a: Column, b: Column) -> Column:
    return ratio_column(sorted_words(a), sorted_words(b))


@F.pandas_udf(T.DoubleType())
def ensemble_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """ensemble() in Arrow batches, for long lists of pairs."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if (s := known.get(pair)) is None:
            s = known[pair] = None if pair[0] is None or pair[1] is None else ensemble(*pair)
        out.append(s)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.BooleanType())
def equal_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Evaluation's equality at 90: the same, or words in order alike, plain or without particles."""
    known: dict[tuple[str, str], bool] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if (same := known.get((x, y))) is None:
            same = known[x, y] = x is not None and y is not None and (x == y or sort_ratio(x, y) >= 0.9 or ((folded(x), folded(y)) != (x, y) and sort_ratio(folded(x), folded(y)) >= 0.9))
        out.append(same)
    return pd.Series(out, dtype="bool")
