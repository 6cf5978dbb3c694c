import random

import numpy as np

from muniment.llm import shingles as S
from muniment.llm import simhash


def brute_similarity(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def near_copies(rng, groups=40, copies=4, n=200, edits=(1, 2, 3, 4, 5, 8, 12)):
    rows = []
    for g in range(groups):
        text = [f"w{rng.randrange(4000)}" for _ in range(n)]
        rows.append((10 * g, " ".join(text)))
        for k in range(copies):
            mine = list(text)
            for e in rng.sample(range(n), rng.choice(edits)):
                mine[e] = f"x{rng.randrange(4000)}"
            rows.append((10 * g + 1 + k, " ".join(mine)))
    return rows


def kept_by_stage(spark, rows):
    import corpus_pipeline as P

    stage = dict(P.STAGES)["SimHash near-dedup"]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in stage(spark, docs, "").collect()}


def test_stage_keeps_no_near_copy(spark):
    rows = near_copies(random.Random(3))
    ids = kept_by_stage(spark, rows)
    kept = [(i, t) for i, t in rows if i in ids]
    assert not [(i, j) for i, a in kept for j, b in kept if i < j and i // 10 == j // 10 and brute_similarity(a, b) >= 0.8]
    for i, t in rows:  # what goes has a near copy of its group
        assert i in dict(kept) or any(brute_similarity(t, b) >= 0.8 for j, b in rows if j != i and j // 10 == i // 10)
    assert {i for i, _ in kept} >= {10 * g for g in range(40)}


def test_unlike_texts_of_one_bucket(spark, monkeypatch):
    """Every text has the same key: near copies are found behind many unlike leaders, in rounds and pair by pair."""
    monkeypatch.setattr(S, "ALL_PAIRS", 6)
    monkeypatch.setattr(S, "LEADERS", 3)
    rows = near_copies(random.Random(4), groups=14, copies=2, edits=(1, 2))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    keys = spark.createDataFrame([(0, 1, i, len(S.shingle_set(t)), 0, 0) for i, t in rows], "band int, key long, doc_id long, n long, f long, g long")
    gone = {r["b"] for r in S._links(texts, keys, 5, 0.8).collect()}
    assert gone == {i for i, _ in rows if i % 10}


def test_components_reach_through_a_copy(spark):
    """A is near B and B near C, A and C are not near: one component, whichever of them has the smallest id."""
    base = [f"w{i}" for i in range(200)]
    b = ["x" if i in (20, 40, 60) else w for i, w in enumerate(base)]
    c = ["y" if i in (90, 110, 130, 150) else w for i, w in enumerate(b)]
    a, b, c = (" ".join(x) for x in (base, b, c))
    assert brute_similarity(a, b) >= 0.8 and brute_similarity(b, c) >= 0.8 and brute_similarity(a, c) < 0.8
    for ids in ((1, 2, 3), (2, 1, 3), (1, 3, 2), (2, 3, 1)):
        docs = spark.createDataFrame(list(zip(ids, (a, b, c), strict=True)), "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1}
    assert kept_by_stage(spark, list(zip((1, 2, 3), (a, b, c), strict=True))) == {1}


def test_odd(odd, none):
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(odd).collect()}
    assert got[3] == got[2] == 1 and got[8] == 6 and got[5] == 4 and got[9] == 9 and None not in got
    assert S.near_duplicates(odd).count() == odd.where("doc_id IS NOT NULL").count()
    assert S.near_duplicates(none).count() == 0


def test_radius_lets_similar_pairs_pass():
    """Sets of 0.8 similarity, of any size: their fingerprints lie within the radius."""
    rng, a, b = np.random.default_rng(9), [], []
    for n in [9, 18, 27, 90, 900] * 400:
        common = rng.integers(0, 1 << 64, 8 * n // 9, np.uint64)
        for out in (a, b):
            out.append(S.fingerprint(np.concatenate([common, rng.integers(0, 1 << 64, n // 9, np.uint64)])))
    a, b = np.array(a, np.uint64), np.array(b, np.uint64)
    assert simhash.close_pairs(a, b, S.RADIUS).mean() >= 0.998
    assert simhash.close_pairs(a, np.roll(b, 5, axis=0), S.RADIUS).mean() <= 0.01


def test_rows_of_one_id(spark):
    """Repeated ids: only the row that is a near copy goes, of repeated rows one stays, rows without an id are compared too."""
    import corpus_pipeline as P

    text = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, text[0], "en", "s", 1), (1, text[1], "en", "s", 1), (2, text[0], "en", "s", 1), (3, text[2], "en", "s", 1), (3, text[2], "en", "s", 1), (None, text[2] + " end", None, None, None), (None, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_ long")
    got = dict(P.STAGES)["SimHash near-dedup"](spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(r["text"][:2] for r in got.collect())
    assert kept == ["", "a0", "b0", "c0"]
    judged = dict(P.STAGES)["quality rules"](spark, docs, "").collect()
    assert len(judged) == 6 and "" not in {r["text"] for r in judged}


def test_large_group_gives_few_rows(spark):
    """A group of 300 texts that are alike but not near, with chains of near ones: right components, compared in tiles that give
    fewer links than texts."""
    rng, rows = random.Random(6), []
    base = [f"w{i}" for i in range(120)]
    for i in range(300):
        mine = list(base)
        for e in rng.sample(range(120), 1 + i % 12):
            mine[e] = f"x{rng.randrange(4000)}"
        rows.append((i, " ".join(mine)))
    sets = [S.shingle_set(t) for _, t in rows]
    label = np.arange(300)
    pairs = [(i, j) for i in range(300) for j in range(i + 1, 300) if 1.0 * len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]
    label = simhash.merge(label, *(np.array(x) for x in zip(*pairs, strict=True)))
    assert len(pairs) > 400 and len(set(label.tolist())) > 100
    fps = np.array([S.fingerprint(x) for x in sets], np.uint64)
    member, root = S.tile_links(sets, fps, 0, 0.8)
    assert len(member) < 300 and {m: r for m, r in zip(member, root, strict=True)} == {m: label[m] for m in range(300) if label[m] != m}
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label.tolist()))
