"""Packing, mixing, passages, neighbours and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from muniment.llm import ann, common, mixing, packing, passages


def test_best_fill():
    rng = np.random.default_rng(0)
    for _ in range(500):
        k = rng.integers(1, 6)
        lengths, left, room = np.sort(rng.choice(np.arange(1, 15), k, replace=False)), rng.integers(0, 4, k), int(rng.integers(0, 40))
        got, reach = packing.fill_best(lengths, left, room), {0}
        for n, c in zip(lengths.tolist(), left.tolist(), strict=True):
            assert got.count(n) <= c
            for _ in range(c):
                reach |= {b + n for b in reach if b + n <= room}
        assert sum(got) == max(reach)


@pytest.mark.parametrize("histogram", [{1: 1}, {600: 50, 500: 10, 3: 70}, {512: 3, 513: 4}, {1024: 5, 7: 1000}, {n: 3 + n % 5 for n in range(1, 1024)}])
def test_plan_uses_each_piece_once(histogram):
    used, cost = {}, 0
    for times, items in packing.plan(histogram):
        assert sum(items) <= 1024
        cost += times * int(packing.sequence_cost(sum(items)))
        for n in items:
            used[n] = used.get(n, 0) + times
    assert used == histogram
    if len(histogram) > 100:
        assert 1 - sum(n * c for n, c in histogram.items()) / cost < 0.01


def test_columns_beat_the_first_basis():
    lengths, demand = np.array([300, 341, 400, 682]), np.array([100.0, 300.0, 100.0, 10.0])
    _, use = packing.first_basis(lengths, demand)
    basis, _ = packing.first_basis(lengths, demand)
    before = float(packing.sequence_cost((lengths @ basis).astype(int)) @ use)
    after = sum(u * float(packing.sequence_cost(int(p @ lengths))) for u, p in packing.solve(lengths, demand))
    assert after <= before + 1e-6


def check_pack(docs, got):
    encode, by = packing.tokenizer(), {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    want = sorted((i, s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes()), len(ids)) for i, t in docs for ids in [[*encode(t or ""), 0]] for s in range(0, len(ids), 1024))
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want


def test_packing(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id IS NOT NULL").collect()]
    check_pack(rows, packing.pack(odd.where("doc_id IS NOT NULL")).collect())
    one = packing.pack(odd.where("doc_id = 9"), with_ids=True).collect()
    assert np.frombuffer(one[0]["ids"], "<u4").tolist() == [*packing.tokenizer()("one"), 0]
    assert packing.pack(none).count() == 0


def test_tokenizers_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ours, rng = packing.tokenizer(), random.Random(8)
    assert ours("a <|endoftext|> b") == t.encode("a <|endoftext|> b", add_special_tokens=False).ids
    for _ in range(500):
        text = "".join(rng.choice([*"ab Zé1ß\n\t  '’s.,!<|endoftext|>中я　\x85", "<|endoftext|>"]) for _ in range(rng.randrange(50)))
        assert ours(text) == t.encode(text, add_special_tokens=False).ids


def test_mixing(spark, odd, none):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)) or None, rng.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).withColumn("taken", F.col("size") * F.col("times")).collect()
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == sorted(c.sql(mixing.OP5_SQL).fetchall())
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 60 and mine[0]["target"] <= 3 * mine[0]["source_size"] + 1e-9
    assert sum({(r["source"], r["target"]) for r in got}.__iter__().__next__()[1:]) >= 0
    assert sum(t for _, t in {(r["source"], r["target"]) for r in got}) == pytest.approx(sum(r["size"] for r in got))
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and out.count() == mixing.mix(odd).agg(F.sum("times")).first()[0]


def test_chain_prefers_order():
    got = passages.chains([0, 5, 10, 12, 20], [100, 105, 3, 112, 120])
    assert got[0] == [0, 1, 3, 4]


def test_seeds_are_chosen_by_value():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 1000, 200).astype(np.uint32), rng.integers(0, 1000, 300).astype(np.uint32)
        b[50:100] = a[20:70]
        (x, h), (y, g) = passages.seeds(a), passages.seeds(b)
        mine = {(p - 20, v) for p, v in zip(x.tolist(), h.tolist()) if 20 <= p <= 58}
        assert mine <= {(p - 50, v) for p, v in zip(y.tolist(), g.tolist())}
    assert len(passages.seeds(np.zeros(3, np.uint32))[0]) == 0


def test_all_pairs_of_a_passage(spark):
    """Each pair that shares a passage is found: behind other texts that have single seeds of it, and where its words
    occur earlier in the text."""
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    passage = text(70)
    rows = [(i, " ".join(text(30) + passage + text(30))) for i in (1, 50, 51, 99)]
    rows += [(2 + i, " ".join(text(40) + passage[i : i + 14] + text(40))) for i in range(40)]  # too little of it for a link
    rows += [(70, " ".join(passage[:30] + text(60) + passage[40:] + text(50) + passage + text(20)))]
    got = {(r["doc_id"], r["partner_id"]) for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = [1, 50, 51, 70, 99]
    assert got == {(i, j) for i in whole for j in whole if i > j}


def edited(rng, words, share, new):
    """About `share` of the words substituted, dropped or preceded by another."""
    out = []
    for w in words:
        r = rng.random()
        if r >= share:
            out.append(w)
        elif r < share * 0.8:
            out.append(new())
        elif r < share * 0.9:
            out += [new(), w]
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_frequent_line_stays_in_its_tile(spark, monkeypatch):
    """A line of 60 texts gives no matches to store, but those of the two texts whose words around it agree too."""
    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))
    line = next(x for x in iter(lambda: say(10), None) if len(passages.seeds(passages.word_codes(x))[0]) >= 2)
    around = say(30), say(30)
    rows = [(i, f"{say(60)} {around[0]} {line} {around[1]} {say(20)}" if i in (17, 44) else f"{say(60)} {line} {say(60)}") for i in range(60)]
    stored, durable = [], common.durable
    monkeypatch.setattr(common, "durable", lambda df: stored.append(durable(df)) or stored[-1])
    got = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in got} == {(44, 17)} and got[0]["agreeing"] >= 66
    made = [x for x in stored if x.columns == ["doc_id", "rdoc", "x", "y"]]  # its files are read no more
    assert len(made) == 1 and {(r["doc_id"], r["rdoc"]) for r in made[0].collect()} == {(44, 17)}


def test_shared_words_bound_alignments():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 60):
        a, b = rng.integers(0, 9, n).astype(np.uint32), rng.integers(3, 12, 40).astype(np.uint32)
        assert passages.shared_words(a, b) == sum(min((a == w).sum(), (b == w).sum()) for w in range(12)) >= passages.small_alignment(a, b)


def test_seeds_of_one_text_alone_are_not_stored(spark, monkeypatch):
    """Texts that share no seed leave a row or less each in every stored table, whatever their length."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(300))) for i in range(20)]
    stored, durable = [], common.durable
    monkeypatch.setattr(common, "durable", lambda df: stored.append(durable(df)) or stored[-1])
    monkeypatch.setattr(common, "drop", lambda df: None)
    assert passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert len(stored) > 3 and all(x.count() <= 20 for x in stored)


def test_many_alignments_are_those_of_single_chains():
    rng = np.random.default_rng(6)
    a, b, xs, ys = [], [], [], []
    for _ in range(60):
        one = rng.integers(0, 40, rng.integers(20, 250)).astype(np.uint32)
        two = np.where(rng.random(len(one)) < rng.choice([0.0, 0.1, 0.3]), rng.integers(0, 40, len(one)), one).astype(np.uint32)
        for at in rng.integers(0, len(two), rng.integers(0, 5)):
            two = np.insert(two[: max(1, at - 2)], max(1, at - 2), [*rng.integers(0, 40, rng.choice([0, 1, 3, 70])), *two[at:]]).astype(np.uint32)
        x, y = np.nonzero(passages.run_hashes(one, 4)[:, None] == passages.run_hashes(two, 4))
        for c in passages.chains(x.tolist(), y.tolist())[:3]:
            a.append(one)
            b.append(two)
            xs.append(x[c])
            ys.append(y[c])
    cuts = [np.cumsum([0, *map(len, v)]) for v in (a, b)]
    a0, b0 = rng.integers(0, 90, len(a)), rng.integers(0, 90, len(a))
    xs, ys = [x + s for x, s in zip(xs, a0, strict=True)], [y + s for y, s in zip(ys, b0, strict=True)]
    of = np.repeat(np.arange(len(a)), [len(x) for x in xs])
    got = passages.align_many(np.concatenate(a), np.concatenate(b), of, *cuts, a0, b0, np.concatenate(xs), np.concatenate(ys))
    assert len(a) > 50 and list(map(tuple, got)) == [passages.align(p, q, s, u, x.tolist(), y.tolist()) for p, q, s, u, x, y in zip(a, b, a0, b0, xs, ys, strict=True)]


@pytest.mark.parametrize("left", [0, 90])
def test_supported_pairs_are_all(left, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK", 32)
    rng = np.random.default_rng(4)
    around = passages.ranked(np.concatenate([passages.surroundings(rng.integers(0, 30, 80).astype(np.uint32), rng.integers(0, 77, 1)) for _ in range(150)]))
    doc = rng.integers(0, 100, 150)
    for least in (25, 40):
        i, j = passages.supported(around, doc, left, least)
        held = [set(r.tolist()) - {0} for r in around]
        # Numbers that fall together can only add a pair.
        want = {(p, q) for p in range(left or 150) for q in range(left or p + 1, 150) if doc[p] != doc[q] and len(held[p] & held[q]) >= least}
        assert want and want <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) <= len(want) * 1.05


def test_rounds_change_no_passage(spark, monkeypatch):
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    common_, rows = say(90), []
    for i in range(12):
        rows.append((i, f"{say(20 + i)} {common_ if i % 3 else 'de ' * (70 + 9 * i)} {say(15)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, passages.shared_passages(docs).collect()))
    monkeypatch.setattr(passages, "MATCHES", 1)
    monkeypatch.setattr(passages, "CHAINS", 1)
    assert len({r[:4:3] for r in whole}) >= 28 + 6 and sorted(map(tuple, passages.shared_passages(docs).collect())) == whole


def test_seeds_of_one_repeated_word():
    for w in range(1, 200):
        at, h = passages.seeds(np.full(100, w, np.uint32))
        assert all((h == v).sum() <= 14 for v in set(h.tolist()))
        assert not len(at) or {0, *at.tolist()} >= {0, 8, 16} and at.max() in (96, 88)


def test_recall_of_edited_passages(spark):
    """Pairs that brute-force alignment finds alike, edited at several rates, some of lines that occur earlier apart."""
    rng = random.Random(12)
    new = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    text = lambda n: [new() for _ in range(n)]
    lines, rows, want = [text(18) for _ in range(60)], [], set()
    rows += [(i, " ".join(text(40) + line + text(40))) for i, line in enumerate(lines)]  # each line alone, in an earlier text
    for g in range(120):
        rate = (0.0, 0.05, 0.1, 0.15, 0.18, 0.0)[g % 6]
        one = sum(rng.sample(lines, 4), []) if g % 6 == 5 else text(rng.randrange(60, 120))
        two = edited(rng, one, rate, new)
        i = 1000 + 2 * g
        rows += [(i, " ".join(text(50) + one + text(50))), (i + 1, " ".join(text(70) + two + text(30)))]
        if lcs(one, two) >= 0.8 * max(len(one), len(two)):
            want.add((i + 1, i))
    found = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["partner_id"]) for r in found}
    assert len(want) > 100 and len(want & got) >= 0.95 * len(want), len(want & got) / len(want)
    assert all(r["similarity"] >= 0.8 for r in found)


def test_ranges_and_ids(spark):
    """A passage in every text over many ranges; an id with two texts; repeated rows."""
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    passage = text(80)
    rows = [(i, f"{text(20)} {passage} {text(20)}") for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    got = {}
    for r in passages.shared_passages(spark.createDataFrame(rows + rows[:50], "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r["partner_id"])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(got) == set(range(1, 200)) and all(i - 1 in p for i, p in got.items())
    two = spark.createDataFrame([*rows[:3], (1, text(90)), (None, rows[0][1])], "doc_id long, text string")
    out = [sorted(map(tuple, passages.shared_passages(x).collect())) for x in (two, two.orderBy(F.col("doc_id").desc()).repartition(3))]
    assert out[0] == out[1]


def test_passages(spark, odd, none):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    rows, want = [], {}
    for g in range(12):
        passage = text(70)
        for k in range(3):
            mine = list(passage)
            for e in rng.sample(range(5, 65), 3 if k else 0):
                mine[e] = word()
            if k == 2:
                mine.insert(30, word())
            before = text(rng.randrange(10, 90))
            i = 10 * g + k
            rows.append((i, " ".join(before + mine + text(rng.randrange(10, 90)))))
            if k:
                want[i] = (10 * g, len(before), len(before) + len(mine))
    rows += [(500 + i, " ".join(text(120))) for i in range(20)] + [(900, rows[0][1]), (901, rows[0][1])]
    got = {r["doc_id"]: r for r in passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in got if i < 900} == set(want)
    for i, (p, s, e) in want.items():
        assert p <= got[i]["partner_id"] < i and abs(got[i]["start_word"] - s) <= 16 and abs(got[i]["end_word"] - e) <= 16  # edits near an edge hide its seeds
    assert got[900]["is_copy"] and got[901]["partner_id"] == 0
    by = {r["doc_id"]: r for r in passages.shared_passages(odd).where("is_copy").collect()}
    assert by[7]["partner_id"] == 6 and by[8]["partner_id"] == 6
    assert passages.shared_passages(none).count() == 0


def test_stages_begin_with_small_heaps(spark, odd):
    """In local mode the driver's heap is the executor's: what earlier steps made it grow by goes back to the system."""
    import corpus_pipeline

    heap = spark._jvm.java.lang.Runtime.getRuntime()
    held = [spark._jvm.java.nio.ByteBuffer.allocate(1 << 28) for _ in range(5)]
    grown = heap.totalMemory()
    for x in held:
        spark.sparkContext._gateway.detach(x)
    del held, x
    corpus_pipeline.mask_pii(spark, odd, "")
    assert grown > 5 << 28 and heap.totalMemory() < grown - (3 << 28)


def brute(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in ok if i != q and len(x) == len(v))[:k]
    return out


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=16) + (i % 7))]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [(3000, None), (3100, [0.0] * 16), (3200, [None] * 16), (3300, [float("nan")] * 16), (3400, [1.0, 2.0]), (rows[5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    for shard, block in ((8192, 7), (200, 1 << 17), (200, 2)):
        got = {}
        monkeypatch.setattr(ann, "BLOCK", block)
        for r in ann.nearest(df, F.col("vec_id") % 100 == 0, shard=shard).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        want = brute({i: v for i, v in rows}.items())
        hit = sum(len({i for _, i, _ in got.get(q, [])} & {i for _, i in w}) for q, w in want.items())
        assert hit / sum(map(len, want.values())) >= 0.9
        assert [(i, s) for _, i, s in sorted(got[0])] == [(i, s) for s, i in want[0]]
        assert 3400 not in got and 3000 not in got
    assert ann.nearest(df.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.nearest(df.where("vec_id < 3"), F.col("vec_id") % 100 == 0).count() == 2


def test_cells_and_pruning():
    """Clustered rows: a query verifies little, and every row has a cell."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 64)) * 10, 100, axis=0) + rng.normal(size=(4000, 64))
    p = x @ ann.directions(64)
    cells = ann.Cells(p[::4], 16).of(p)
    assert 8 <= len(np.unique(cells)) <= 16 and np.bincount(cells).max() < 1500
    one = ann.Shard(np.arange(4000), x, 10)
    hit = sum(len({i for _, i in one.search(q, x[q])} & set(np.argsort(((x - x[q]) ** 2).sum(1))[1:11].tolist())) for q in range(0, 4000, 100))
    assert hit >= 360 and one.verified < 0.2 * 40 * 4000
    assert (ann.Cells(np.zeros((10, ann.M)), 4).of(np.zeros((5, ann.M))) == 0).all()


def test_neighbours_odd(spark):
    """Nulls in every column, ties, repeated rows, a hot vector, clashing names."""
    rows = [(i, [1.0, 2.0], 0, "b") for i in range(0, 600, 5)] + [(None, [1.0, 2.0], 1, "x"), (100, [1.0, 2.0], 0, "b"), (700, [5.0, None], None, None), (701, [3.0, 4.0], 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int, query_id string")
    got = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % 100 == 0, shard=50).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {0, 100, 200, 300, 400, 500}
    assert got[0] == [5, 10, 15, 20, 25, 30, 35, 40, 45, 50] and got[100] == [0, 5, 10, 15, 20, 25, 30, 35, 40, 45]


def test_pipeline(spark, odd, none, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(11)
    rows = [(100 + i, " ".join(f"word{rng.randrange(500)}" for _ in range(60)), "en", "abc"[i % 3], 1) for i in range(40)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = more.unionByName(odd.select(more.columns))
    kept = docs
    for name, stage in P.STAGES:
        kept = common.durable(stage(spark, kept, str(tmp_path)))
        if name != "packing":
            assert kept.columns == docs.columns
        if name == "quality rules":
            assert {100 + i for i in range(40)} <= {r["doc_id"] for r in kept.collect()}
        if name == "SimHash near-dedup":
            ids = [r["doc_id"] for r in kept.collect()]
            assert len(ids) == len(set(ids)) and len({6, 7, 8} & set(ids)) == 1
    assert kept.count() > 0
    empty = none.select(more.columns)
    for _, stage in P.STAGES:
        empty = common.durable(stage(spark, empty, str(tmp_path)))
    assert empty.count() == 0
