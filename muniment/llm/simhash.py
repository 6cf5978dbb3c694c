"""SimHash near-duplicates, compared bit-sliced.

Fingerprints: one 64-bit majority vote per whole text over the XXH64 of its word shingles.

Search: two fingerprints that differ in at most r of 64 bits agree exactly on at least two of r + 2 blocks,
so all pairs within reach meet in a bucket family of two fixed blocks: for r = 3 one of ten of 25 or 26 bits.
Only distinct fingerprints go in (copies meet in one by a map-side combined aggregate). In a bucket the
fingerprints stand as 64 bit planes, 64 fingerprints to a machine word: one fingerprint against a block
is an XOR of a plane with 0 or ~0, carry-save adders count the differing planes of all 64 at once in
three bits that saturate, and a block is abandoned once every counter in it has passed the radius.
All buckets of a batch are compared in the same few array operations. A bucket gives a spanning forest
of its links, never its pairs: fewer rows than it has members.

Large buckets: one with more than TILE members is cut into chunks by hash, and each pair of chunks is a
task of its own, so no task holds more than two chunks whatever the bucket holds.

Components: of fingerprints, by large-star and small-star steps as joins and aggregates, each written to the
shared folder; documents then take the smallest id of their fingerprint's component. Nothing about documents
reaches the driver but counts.

Defined results: null, empty or wordless text has fingerprint 0 and is linked like any other; a repeated
row gives a repeated row; an id with several texts has a row for each; rows without an id link others but
name no component (null where no row of it has an id); ties can't arise (a bit needs more than half); an
empty table gives no rows.
Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RADIUS, TILE = 3, 4096


def bucket_masks(radius: int) -> list[int]:
    """The bits that each bucket family fixes: two of radius + 2 blocks."""
    if not 0 <= radius <= 6:
        raise ValueError(f"radius {radius}: bucket families hold for 0 to 6 bits")
    edges = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    block = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(radius + 2)]
    return [a | b for a, b in combinations(block, 2)]


# -- fingerprints -------------------------------------------------------------------------------------

def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words of the text, A-Z in lower case; shorter texts: of all words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    flat, at = b" ".join(words), np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    digest = xxhash.xxh64_intdigest
    starts, ends = at[:-width].tolist(), (at[width:] - 1).tolist()
    return np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, width: int) -> int:
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for texts of any length
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in common.slices(batches):
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# -- bit-sliced comparison ----------------------------------------------------------------------------

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _lanes(words: np.ndarray) -> np.ndarray:
    """(n, 64) booleans of n machine words."""
    return np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)


def planes_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the blocks values[start:end], each block in machine words of its own.
    Returns planes (64, words), the first word of each block, and the position of each word's lanes (-1: none)."""
    words = (ends - starts + 63) // 64
    first = np.concatenate([[0], np.cumsum(words)])
    lanes = np.full(int(first[-1]) * 64, -1, np.int64)
    sizes = ends - starts
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lanes[np.repeat(first[:-1] * 64, sizes) + inside] = np.repeat(starts, sizes) + inside
    bits = np.unpackbits(values[lanes].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8"), first, lanes.reshape(-1, 64)


def compare(values: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, order: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's value against the 64 lanes of its word. Returns the numbers of the (query, word)
    pairs with a lane within the radius, and for each a machine word with those lanes set."""

    def differ(p: int, alive: np.ndarray) -> np.ndarray:
        return planes[p][word[alive]] ^ (np.uint64(0) - (values[query[alive]] >> np.uint64(p) & np.uint64(1)))

    return count_planes(differ, len(query), order, radius)


def count_planes(differ, n: int, order: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """differ(plane, alive) gives machine words whose lanes say where a plane differs. Counts the planes of all
    lanes at once and abandons words in which every lane is past the radius. Returns the numbers of the words
    with a lane within the radius, and for each a machine word with those lanes set."""
    alive, zero = np.arange(n), np.zeros(n, np.uint64)
    counter, over = [zero] * max(3, radius.bit_length()), zero
    for at in range(0, len(order), 4):
        d = [differ(p, alive) for p in order[at : at + 4]]
        d += [np.zeros_like(over)] * (4 - len(d))
        # Two carry-save adders take the four planes into the counters; past the last they stay marked as over.
        ones, twos, *rest = counter
        a = ones ^ d[0]
        c1 = (ones & d[0]) | (a & d[1])
        ones = a ^ d[1]
        a = ones ^ d[2]
        c2 = (ones & d[2]) | (a & d[3])
        ones = a ^ d[3]
        a = twos ^ c1
        carry = (twos & c1) | (a & c2)
        twos = a ^ c2
        for k, bit in enumerate(rest):
            rest[k], carry = bit ^ carry, bit & carry
        over = over | carry
        counter = [ones, twos, *rest]
        keep = np.flatnonzero(over | _above(counter, radius) != FULL)
        if len(keep) < len(alive):  # words in which every lane is past the radius are abandoned
            alive, over, counter = alive[keep], over[keep], [x[keep] for x in counter]
            if not len(alive):
                break
    return alive, ~(over | _above(counter, radius))


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, lowest bit first, exceeds the radius: decided at the highest bit that differs."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], FULL)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which a[i], b[i] differ in at most `radius` bits, one machine word a value or several (rows, words): 64 pairs to
    a machine word, the planes of both stood vertically."""
    if not len(a):
        return np.zeros(0, bool)
    a, b = a.reshape(len(a), -1), b.reshape(len(b), -1)
    whole = np.array([0]), np.array([len(a)])
    pa, pb = (np.concatenate([planes_of(np.ascontiguousarray(x[:, k]), *whole)[0] for k in range(x.shape[1])]) for x in (a, b))
    n = pa.shape[1]
    word, mask = count_planes(lambda p, alive: pa[p][alive] ^ pb[p][alive], n, np.arange(len(pa)), radius)
    out = np.zeros((n, 64), bool)
    out[word] = _lanes(mask)
    return out.ravel()[: len(a)]


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (each the smallest position of its component) after links i - j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def block_links(values: np.ndarray, q_from, q_to, b_from, b_to, order: np.ndarray, radius: int = RADIUS, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (position, root position) of the links between values[q_from:q_to] and
    values[b_from:b_to], for each of several pairs of blocks; order: the bit planes that may differ."""
    q_from, q_to, b_from, b_to = (np.asarray(x, np.int64) for x in (q_from, q_to, b_from, b_to))
    label = np.arange(len(values))
    planes, first, lanes = planes_of(values, b_from, b_to)
    per = np.diff(first)  # words of each block
    combos = (q_to - q_from) * per
    upto = np.concatenate([[0], np.cumsum(combos)])
    for at in range(0, int(upto[-1]), step):
        n = np.arange(at, min(at + step, int(upto[-1])))
        block = np.searchsorted(upto, n, "right") - 1
        inner = n - upto[block]
        query, word = q_from[block] + inner // per[block], first[block] + inner % per[block]
        if (whole := lanes[word, -1] >= 0).any():  # a block against itself: only lanes past the query
            drop = whole & (lanes[word, -1] <= query) & (b_from[block] == q_from[block])
            query, word = query[~drop], word[~drop]
        hit, mask = compare(values, planes, query, word, order, radius)
        if len(hit):
            k, lane = np.nonzero(_lanes(mask))
            i, j = query[hit[k]], lanes[word[hit[k]], lane]
            true = (j >= 0) & (i != j)
            label = merge(label, i[true], j[true])
    member = np.flatnonzero(label != np.arange(len(values)))
    return member, label[member]


# -- links over all fingerprints ----------------------------------------------------------------------

def links(fps: DataFrame, tile: int = TILE, radius: int = RADIUS) -> DataFrame:
    """(a, b) of a table of distinct fp: enough links of at most `radius` bits to give its components."""
    fixed = bucket_masks(radius)
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in fixed])
    keyed = fps.select("fp", F.posexplode(masks).alias("family", "mask")).select("fp", "family", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("family", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = common.durable(sizes)
    met = keyed.join(sizes, ["family", "key"])  # drops the rows that stand alone in their bucket
    chunks = F.ceil(F.col("n") / tile).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # A chunk goes to the tile of itself and to one tile with each other chunk.
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("lo"), F.greatest(c, F.col("chunk")).alias("hi")))
    met = met.select("fp", "family", "key", "chunk", F.explode(tiles).alias("t")).select("fp", "family", "key", "chunk", F.col("t.lo").alias("lo"), F.col("t.hi").alias("hi"))
    # Many buckets to a task: rows are dealt by bucket and tile, sorted, and cut at each change.
    width = met.repartition("family", "key", "lo", "hi").sortWithinPartitions("family", "key", "lo", "hi", "chunk", "fp")

    def run(frames):
        carry = None
        for frame in frames:
            frame = frame if carry is None else pd.concat([carry, frame], ignore_index=True)
            ids = frame[["family", "key", "lo", "hi"]].to_numpy()
            cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            carry = frame.iloc[last:]
            yield from out(frame.iloc[:last], np.concatenate([[0], cuts]))
        if carry is not None and len(carry):
            yield from out(carry, np.array([0, len(carry)]))

    def out(frame, cuts):
        if not len(frame):
            return
        fp, chunk = frame["fp"].to_numpy().astype(np.int64).view(np.uint64), frame["chunk"].to_numpy()
        family, lo, hi = (frame[c].to_numpy() for c in ("family", "lo", "hi"))
        start, end = cuts[:-1], cuts[1:]
        # Rows of a tile are sorted by chunk: the first `left` are chunk lo where lo < hi.
        left = np.add.reduceat(chunk == lo, start)
        two = lo[start] < hi[start]
        use = (end - start > 1) & ~(two & ((left == 0) | (left == end - start)))
        for f in np.unique(family[start[use]]):
            k = use & (family[start] == f)
            s, e, t, m = start[k], end[k], two[k], left[k]
            order = np.array([p for p in range(64) if not fixed[f] >> p & 1])  # the other planes agree in a bucket
            i, r = block_links(fp, s, np.where(t, s + m, e), np.where(t, s + m, s), e, order, radius)
            if len(i):
                yield pd.DataFrame({"a": fp[i].view(np.int64), "b": fp[r].view(np.int64)})

    return width.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that each reaches.

    Large-star then small-star until the edges stop changing. Each step takes the minimum per node by a
    map-side combined aggregate and joins it back, so a node with very many edges can be split.
    """
    now = common.durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.durable(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = common.durable(small)
        common.drop(now)
        common.drop(large)
        now = small
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    found = common.durable(fingerprints(docs, width))
    first = common.durable(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = components(links(first.select("fp"), tile, radius)).withColumnRenamed("node", "fp")
    named = common.durable(first.join(parts, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "first"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return found.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
