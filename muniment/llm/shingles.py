"""Near-duplicates at a similarity of word shingles: the SimHash comparison of simhash.py behind buckets that reach
that far, and whole sets to decide.

Texts of similarity 0.8 differ in some 20 of 128 fingerprint bits, more than blocks of equal bits can find, so the
buckets come from minima of the shingles' hashes and the bit-sliced comparison, at a radius that a similar pair
passes with near certainty, leaves few unlike pairs to the check of whole sets.

1. Sets: the XXH64 of each run of `width` words of the whole text, A-Z in lower case, each counted once. Texts
   of equal sets form a class; its smallest id stands for it.
2. Bands: BANDS keys, each of ROWS minima under permutations of their own. Two texts of similarity s share
   a key with probability 1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8, more above; at 0.4, 0.03.
3. Groups: texts that share keys, directly or through others. All pairs of a group are compared but those that links
   join already, so a text that is near to any other of its group is met by it, whichever has the smallest id. A
   group of more than ALL_PAIRS texts is cut into chunks by hash, and each pair of chunks is a task's tile. A tile gives
   a spanning forest of its links, never its pairs: fewer rows than it has texts, however large the group.
4. Comparison: candidate pairs stand 64 to a machine word in the bit planes of both fingerprints; carry-save
   counters count the differing planes, and words with no pair within RADIUS bits are abandoned.
5. Check: each pair that is left, the shared part of both whole sets, exactly.

A group of n texts costs n * n / 2 comparisons inside its tiles, and each of its sets goes to CHUNKS tiles (one with each
chunk of the group), to more only beyond CHUNKS * TILE texts.

Defined results: null, empty and wordless texts have the empty set and form one class; a text of up to `width`
words has one shingle; a repeated row gives a repeated row; rows without an id are left out; an empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 54, 8
ALL_PAIRS, LEADERS = 32, 16  # a group of up to so many texts is one tile; so many texts at a time meet the rest of a tile
CHUNKS, TILE = 40, 4096  # a group is cut into up to so many chunks, or into chunks of so many texts
#: Bits of 128 in which fingerprints may differ: at 0.8 a bit differs with probability 0.15, and 34 are passed by 0.999
#: of such pairs or more; at 0.4 by a fifth, at 0.3 by a thirtieth, of unlike pairs by next to none.
RADIUS = 34
#: Ids whose texts are read again are broadcast up to so many, joined by a shuffle beyond.
IDS = 200_000
_RNG = np.random.default_rng(5)
_MASK = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The text's distinct shingle hashes in order."""
    return np.unique(simhash.shingle_hashes(text, width))


def band_keys(found: np.ndarray) -> list[int]:
    """A key for each band of a shingle set; none of the empty set."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(found), 1024):  # bounded memory for texts of any length
        h = (found[None, at : at + 1024] ^ _MASK) * _ODD
        np.minimum(low, (h ^ h >> np.uint64(32)).min(axis=1), out=low)
    raw, step = low.astype("<u8").tobytes(), 8 * ROWS
    keys = np.array([xxhash.xxh64_intdigest(raw[b * step : (b + 1) * step], b) for b in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """Two machine words of majority bits, over the hashes and over another mixing of them."""
    other = found * np.uint64(0xD6E8FEB86659FD93)
    return simhash.majority(found), simhash.majority((other ^ other >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15))


def tile_links(sets: list[np.ndarray], fps: np.ndarray, left: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (position, root position) of the similar pairs of a tile's sets (none empty), those before `left`
    with those after it, or all with all where left is 0. fps: their fingerprints (rows, 2)."""
    n = len(sets)
    label, size = np.arange(n), np.fromiter(map(len, sets), np.int64, n)
    end = np.cumsum(size)
    start = end - size
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(code.max()) + 1, np.int64)
    for at in range(0, left or n, LEADERS):
        query, other = np.arange(at, min(at + LEADERS, left or n)), np.arange(left or at + 1, n)
        i, j = (x.ravel() for x in np.broadcast_arrays(query[:, None], other))
        # Sets of other sizes can't be similar; pairs that links join already are not compared.
        use = (i < j) & (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= np.maximum(size[i], size[j]) * similarity - 1e-9)
        i, j = i[use], j[use]
        near = simhash.close_pairs(fps[i], fps[j], RADIUS)
        i, j = i[near], j[near]
        for q in np.unique(i):
            to = j[i == q]
            to = to[label[to] != label[q]]
            if not len(to):
                continue
            mark[code[start[q] : end[q]]] = 1
            if len(to) * 4 > n:
                both = np.add.reduceat(mark[code], start)[to]
            else:
                both = np.array([mark[code[start[k] : end[k]]].sum() for k in to])
            mark[code[start[q] : end[q]]] = 0
            to = to[both >= similarity * (size[q] + size[to] - both) - 1e-9]
            label = simhash.merge(label, np.full(len(to), q), to)
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _links(texts: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): of rows (key, doc_id) each doc_id b that links of similar pairs of a group join to smaller ones, and a, the
    smallest that they reach."""
    least = rows.groupBy("key").agg(F.min("doc_id").alias("a"))
    groups = simhash.components(rows.select("key", F.col("doc_id").alias("b")).join(least, "key").select("a", "b"))
    groups = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    nodes = common.durable(groups.unionAll(groups.select(F.col("group").alias("doc_id"), "group").distinct()))
    sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("many"))

    def read(batches):
        for batch in common.slices(batches):
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            f, g = zip(*map(fingerprint, sets), strict=True) if sets else ([], [])
            digest = pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) for x in sets], pa.string())
            both = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (f, g)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digest, *both, pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "group", "digest", "f", "g", "found"])

    met = texts.join(common.if_small(nodes, IDS), "doc_id").select("doc_id", "group", "text")
    stored = met = common.durable(met.mapInArrow(read, "doc_id long, group long, digest string, f long, g long, found binary").where(F.length("found") > 0))
    common.free_heaps(texts.sparkSession)
    if not met.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():  # repeated rows
        met = met.dropDuplicates(["doc_id", "digest"])
    chunks = F.greatest(F.least(F.ceil(F.col("many") / ALL_PAIRS), F.lit(CHUNKS)), F.ceil(F.col("many") / TILE)).cast("int")
    dealt = met.join(common.if_small(common.durable(sizes.select("group", chunks.alias("chunks"))), IDS), "group")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    # A chunk goes to the tile of itself and to one tile with each other chunk.
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("lo"), F.greatest(c, F.col("chunk")).alias("hi")))
    dealt = dealt.select("group", "chunk", "doc_id", "f", "g", "found", F.explode(tiles).alias("t")).select("group", "t.lo", "t.hi", "chunk", "doc_id", "f", "g", "found")
    dealt = dealt.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi", "chunk", "doc_id")

    def compared(frames):
        for frame, cuts in common.grouped(frames, ["group", "lo", "hi"]):
            ids, chunk, lo, hi = (frame[c].to_numpy() for c in ("doc_id", "chunk", "lo", "hi"))
            fps, found, out = frame[["f", "g"]].to_numpy().view(np.uint64), frame["found"], []
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                left = int((chunk[s:e] == lo[s]).sum()) if lo[s] < hi[s] else 0
                if e - s < 2 or lo[s] < hi[s] and left in (0, e - s):
                    continue
                member, root = tile_links([np.frombuffer(x, np.uint64) for x in found.iloc[s:e]], np.ascontiguousarray(fps[s:e]), left, similarity)
                out.append(pd.DataFrame({"a": ids[s:e][root], "b": ids[s:e][member]}))
            if out:
                yield pd.concat(out)
        common.spare()

    new = simhash.components(dealt.mapInPandas(compared, "a long, b long"))
    common.drop(stored)
    return new.select(F.col("component").alias("a"), F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id that links of at least the similarity reach."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in common.slices(batches):
            digest, keys = [], []
            for t in batch.column(1).to_pylist():
                found = shingle_set(t, width)
                digest.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                keys.append(band_keys(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "keys"])

    told = common.durable(texts.mapInArrow(run, "doc_id long, digest string, keys array<long>"))
    common.free_heaps(docs.sparkSession)
    first = common.durable(told.groupBy("digest").agg(F.min("doc_id").alias("first")))
    alone = told.join(first.select("digest", F.col("first").alias("doc_id")), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    rows = alone.select("doc_id", F.explode("keys").alias("key"))
    # The keys of one text alone go before the rows do.
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("key")
    links = _links(texts, common.durable(rows.join(shared, "key").select("key", "doc_id")), width, similarity)
    named = first.join(links.select(F.col("b").alias("first"), F.col("a").alias("component")), "first", "left")
    return told.select("doc_id", "digest").join(named.select("digest", F.coalesce("component", "first").alias("component_id")), "digest").select("doc_id", "component_id")
