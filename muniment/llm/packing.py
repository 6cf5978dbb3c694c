"""Packing token sequences as a cutting-stock problem, by column generation.

A document of n tokens is cut into n // size whole sequences and a remainder, so the cuts depend on the
document alone and tokens are counted, checked and written in one pass over the texts. Remainders meet in
sequences by patterns, multisets of lengths: a linear program over the length histogram (at most `size`
rows however large the corpus) is solved by the revised simplex method, whose columns a knapsack dynamic
program prices. A pattern costs what its sequence takes in the end: `size`, or its fill where that is a
power of two. Pattern counts are rounded down; what demand is left, less than one sequence for each
pattern in the basis, is packed best fit first. Pieces are then ranked within their length, and a rank's
sequence and offset follow from the patterns by arithmetic.

At scale only the histogram and the patterns pass through the driver. Ranks come from counts by length and
salt, a length with more pieces having more salts, so no task holds a length's pieces.

Defined results: null text is read as empty and is its end token alone; repeated rows are packed each for
itself; ties in rank fall by id and start; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SIZE, GAP, ROUNDS = 1024, 1e-3, 600
_WIDE = re.compile(r"[^\x00-ɏ‐-›]")


# -- tokens -------------------------------------------------------------------------------------------

def tokenizer(path: str | None = None, ranks_path: str | None = None, pattern: str | None = None):
    """texts -> lists of ids as by the tokenizer file's plain call, its added tokens included. Where the same
    vocabulary lies beside it as ranks, texts of Latin letters without an added token go through those,
    which gives the same ids several times as fast."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole, quick, added = [], None, None
    if path is None or ranks_path:
        with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            names = [t["content"] for t in json.load(f)["added_tokens"]]
        added = re.compile("|".join([_WIDE.pattern, *map(re.escape, names)]))
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if quick is not None and not added.search(text):
            return quick(text)
        if not whole:  # loaded when the first text needs it
            whole.append(Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json")))
        return whole[0].encode(text, add_special_tokens=False).ids

    return encode


def cut(docs: DataFrame, size: int = SIZE, end_id: int = 0, with_ids: bool = False, **files) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's pieces, the last the remainder."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches):
        encode = tokenizer(**files)
        for part in common.slices(batches):
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                ids = np.append(np.array(encode(text or ""), "<u4"), np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), size):
                    raw = ids[s : s + size].tobytes()
                    for c, x in zip(cols, (doc, s, len(raw) // 4, zlib.crc32(raw), len(ids), raw), strict=False):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


# -- the linear program -------------------------------------------------------------------------------

def sequence_cost(fill: np.ndarray | int, size: int = SIZE):
    """Tokens that a sequence takes: its fill where that is a power of two, else the full size."""
    fill = np.asarray(fill)
    return np.where((fill > 0) & (fill & (fill - 1) == 0), fill, size)


def price(lengths: np.ndarray, value: np.ndarray, size: int = SIZE) -> list[tuple[float, np.ndarray]]:
    """Patterns of negative reduced cost, the best by fill: a knapsack by dynamic programming over exact
    fills, each length as often as it fits."""
    best, last = np.full(size + 1, -np.inf), np.full(size + 1, -1)
    best[0] = 0.0
    for c in range(int(lengths[0]), size + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        way = best[c - lengths[:n]] + value[:n]
        k = int(way.argmax())
        best[c], last[c] = way[k], k
    gain = best[1:] - sequence_cost(np.arange(1, size + 1), size)
    out = []
    for c in np.argsort(-gain)[:8] + 1:
        if gain[c - 1] <= 1e-7 * size:
            break
        counts = np.zeros(len(lengths))
        left = int(c)
        while left:
            counts[last[left]] += 1
            left -= int(lengths[last[left]])
        out.append((float(gain[c - 1]), counts))
    return out


def first_basis(lengths: np.ndarray, demand: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(basis, use): patterns made longest piece first, each used until a length is spent. A length that a
    pattern spends is in no later one, so the basis is triangular up to order, and feasible."""
    m, left = len(lengths), demand.astype(float)
    basis, use = np.zeros((m, m)), np.zeros(m)
    spent = np.zeros(m, bool)
    for j in range(m):
        k = int(np.flatnonzero(~spent)[-1])
        column = np.zeros(m)
        column[k] = 1
        open_ = np.where(spent, 0, np.ceil(left)).astype(np.int64)
        open_[k] = max(0, open_[k] - 1)
        for n in fill_best(lengths, open_, size - int(lengths[k])):
            column[np.searchsorted(lengths, n)] += 1
        on = np.flatnonzero(column)
        ratio = left[on] / column[on]
        r = on[int(ratio.argmin())]
        use[j] = max(0.0, left[r] / column[r])
        left = np.maximum(left - use[j] * column, 0)
        left[r], spent[r] = 0, True
        basis[:, j] = column
    return basis, use


def solve(lengths: np.ndarray, demand: np.ndarray, size: int = SIZE, gap: float = GAP, rounds: int = ROUNDS) -> list[tuple[float, np.ndarray]]:
    """(use, pattern) of a basic solution of: least total cost, each length's demand met exactly.

    Columns come from price(), several a round, each entered while it still improves. Demands are spread by under
    a hundredth of a piece, so that few pivots are degenerate; the basis meets the true demands in the end. Rounds
    end when no column prices out, when the cost is within `gap` of the demand's tokens or of the best of Farley's
    bounds, or after `rounds` of them: the plan is whole then too, with somewhat more padding (README's figures).
    """
    demand = demand.astype(float)
    spread = demand + np.random.default_rng(1).uniform(0.002, 0.01, len(demand))
    basis, use = first_basis(lengths, spread, size)
    costs = sequence_cost((lengths @ basis).astype(np.int64), size).astype(float)
    tokens = float(lengths @ spread)
    bound = tokens
    inverse = np.linalg.inv(basis)  # triangular up to order, so it has one
    for turn in range(1, rounds + 1):
        total = float(costs @ use)
        if total - bound <= gap * total:
            break
        if turn % 40 == 0:  # again from the basis, for numerical hygiene
            inverse = np.linalg.inv(basis)
            use = np.maximum(inverse @ spread, 0)
        dual = costs @ inverse
        found = price(lengths, dual, size)
        if not found:
            break
        bound = max(bound, float(dual @ spread) / (1 + found[0][0] / size))
        for _, column in found:
            cost = float(sequence_cost(int(column @ lengths), size))
            if (costs @ inverse) @ column - cost <= 1e-7 * size:
                continue
            step = inverse @ column
            ok = step > 1e-7
            if not ok.any():
                continue
            ratio = np.where(ok, use / np.where(ok, step, 1), np.inf)
            theta = ratio.min()
            r = int(np.where(ratio <= theta + 1e-9, step, 0).argmax())  # of ties the firmest pivot
            use = np.maximum(use - theta * step, 0)
            use[r] = theta
            basis[:, r], costs[r] = column, cost
            row = inverse[r] / step[r]
            inverse -= np.outer(step, row)
            inverse[r] = row
    use = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(float(u), basis[:, j]) for j, u in enumerate(use) if u > 1e-9]


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """(times, lengths of a sequence) that use up the histogram exactly. Whole sequences come first."""
    out = [(histogram[size], [size])] if histogram.get(size) else []
    lengths = np.array(sorted(n for n, c in histogram.items() if n < size and c))
    if not len(lengths):
        return out
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    for use, pattern in sorted(solve(lengths, left.astype(float), size), key=lambda x: -x[0]):
        counts = pattern.astype(np.int64)
        on = counts > 0
        times = min(int(use + 1e-6), int((left[on] // counts[on]).min()))
        if times:
            left -= times * counts
            out.append((times, [int(n) for n, c in zip(lengths[::-1], counts[::-1], strict=True) for _ in range(c)]))
    # Best fit: the longest piece opens a sequence, then the subset that fills it best is taken.
    while left.any():
        k = int(np.flatnonzero(left)[-1])
        left[k] -= 1
        items = [int(lengths[k]), *fill_best(lengths, left, size - int(lengths[k]))]
        for n in items[1:]:
            left[np.searchsorted(lengths, n)] -= 1
        out.append((1, items))
    return out


def fill_best(lengths: np.ndarray, left: np.ndarray, room: int) -> list[int]:
    """The multiset of what is left that fills the room best, by bounded knapsack over reachable fills."""
    by = np.full(room + 1, -1)  # the length that reached a fill first
    by[0] = 0
    for n, c in zip(lengths[::-1].tolist(), left[::-1].tolist(), strict=True):
        if not c or n > room:
            continue
        for _ in range(min(c, room // n)):
            fresh = (by[n:] < 0) & (by[: room + 1 - n] >= 0)
            # A fill reached in this very pass must not serve again in it: work from a copy.
            if not fresh.any():
                break
            by[n:][fresh] = n
        if by[room] >= 0:
            break
    fill, out = int(np.flatnonzero(by >= 0)[-1]), []
    while fill:
        out.append(int(by[fill]))
        fill -= out[-1]
    return out


# -- assignment ---------------------------------------------------------------------------------------

def ranked(pieces: DataFrame, histogram: dict[int, int], size: int = SIZE) -> DataFrame:
    """pieces with `rank`, from 0 within each length. A length has a salt for about each thousandth of all
    pieces; ranks are within a length and salt, plus what the length's lower salts hold."""
    share = max(1000, sum(histogram.values()) // 1000)
    salts = F.array(*[F.lit(max(1, -(-histogram.get(n, 0) // share))) for n in range(1, size + 1)])
    salted = pieces.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "start"), F.element_at(salts, F.col("length").cast("int"))).cast("int"))
    counts = salted.groupBy("length", "salt_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("length").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "salt_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    inner = Window.partitionBy("length", "salt_").orderBy("doc_id", "start")
    return salted.withColumn("rank", F.row_number().over(inner) - 1).join(counts, ["length", "salt_"]).withColumn("rank", F.col("rank") + F.col("before_")).drop("salt_", "before_")


def place_table(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """(length, first rank, first sequence, offset) rows, sorted: a piece of a length and rank lies, from its
    row on, at sequence + rank - first rank."""
    rows, upto, sequence = [], {}, 0
    for times, items in patterns:
        offset = 0
        for n in items:
            rows.append((n, upto.get(n, 0), sequence, offset))
            upto[n] = upto.get(n, 0) + times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, size: int = SIZE, end_id: int = 0, with_ids: bool = False, **files) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): each piece and its place."""
    pieces = common.durable(cut(docs, size, end_id, with_ids, **files))
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = place_table(plan(histogram, size))
    key = places[:, 0] << 40 | places[:, 1]
    out = [f for f in pieces.schema.fieldNames()] + ["sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = places[np.searchsorted(key, length << 40 | rank, "right") - 1]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in out[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], out)

    schema = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in out)
    return ranked(pieces, histogram, size).withColumn("rank", F.col("rank").cast("long")).mapInArrow(run, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
