import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from muniment.llm import simhash as S


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    label = list(ids)
    while True:
        new = [min(label[j] for j in range(len(ids)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(ids))]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize(("n", "flips"), [(5, 2), (300, 2), (700, 5)])
def test_block_links(n, flips):
    rng = np.random.default_rng(n)
    v = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)[rng.integers(0, max(1, n // 20), n)]
    for _ in range(flips):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    v = np.unique(v)
    d = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    member, root = S.block_links(v, [0], [len(v)], [0], [len(v)], np.arange(64), step=1000)
    got = np.arange(len(v))
    got[member] = root
    assert (got == S.merge(np.arange(len(v)), *np.nonzero(np.triu(d, 1)))).all()
    half = len(v) // 2
    member, root = S.block_links(v, [0], [half], [half], [len(v)], np.arange(64))
    got = np.arange(len(v))
    got[member] = root
    i, j = np.nonzero(d[:half, half:])
    assert (got == S.merge(np.arange(len(v)), i, j + half)).all()


def test_other_radii():
    v = np.array([0, 1, 3, 7, 15, 31], np.uint64)
    for radius in (1, 2, 5):
        member, _ = S.block_links(v, [0], [6], [0], [6], np.arange(64), radius)
        assert len(member) == 5
    member, _ = S.block_links(v[[0, 3]], [0], [2], [0], [2], np.arange(64), 2)
    assert not len(member)


def test_close_pairs():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 40), replace=False)) for _ in a], np.uint64)
    for radius in (0, 3, 7, 12, 20, 33):
        assert (S.close_pairs(a, a ^ flips, radius) == (np.bitwise_count(flips) <= radius)).all()
    assert not len(S.close_pairs(a[:0], a[:0], 3))


def test_ids_with_several_texts(spark):
    """Links run between fingerprints: a text without an id bridges, and an id's two texts stay apart."""
    base = 0x0123456789ABCDEF
    fps = [(5, base), (None, base ^ 0b111), (3, base ^ 0b111111), (7, ~base & (1 << 62) - 1), (7, base)]
    df = spark.createDataFrame([(i, v) for i, v in fps], "doc_id long, fp long")
    parts = S.components(S.links(df.select("fp").distinct())).collect()
    assert {r["node"] for r in parts} | {r["component"] for r in parts} == {base, base ^ 0b111, base ^ 0b111111}
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(4, text), (9, "other words stand here"), (9, text), (2, text), (None, "alone and unnamed text")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in S.near_duplicates(docs).collect())
    assert got == [(0, None), (2, 2), (4, 2), (9, 2), (9, 9)]


def test_radius_six(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**62, 200)
    b = [int(x) ^ sum(1 << int(k) for k in rng.choice(62, 6, replace=False)) for x in a]
    df = spark.createDataFrame([(int(x),) for x in [*a, *b]], "fp long")
    parts = {r["node"]: r["component"] for r in S.components(S.links(df, radius=6)).collect()}
    assert all(parts.get(int(x), int(x)) == parts.get(y, y) for x, y in zip(a, b))


def test_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(300)]
        rows.append((5 * i, " ".join(text)))
        for k in range(rng.randrange(3)):
            text[rng.randrange(300)] = "edit"
            rows.append((5 * i + 1 + k, " ".join(text)))
    for tile in (4096, 2):  # 2: every bucket is cut into chunks
        got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
        fps = [brute_fingerprint(t) for _, t in rows]
        want = brute_components([i for i, _ in rows], fps)
        assert [got[i][0] & (1 << 64) - 1 for i, _ in rows] == fps
        assert [got[i][1] for i, _ in rows] == want
        assert len(set(want)) < len(rows)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["component"] for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {501: 500}


def test_odd(odd, none):
    got = S.near_duplicates(odd).select("doc_id", S.hex_of("fp").alias("f"), "component_id").collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["f"] == by[2]["f"] == by[3]["f"] == "0" * 16 and by[3]["component_id"] == 1
    assert by[8]["component_id"] == 6 and by[4]["component_id"] == by[5]["component_id"] == 4
    assert S.near_duplicates(none).count() == 0
    assert S.near_duplicates(odd.where(F.col("doc_id") == 9)).count() == 1
