"""PII, quality, licences, toxicity and language, against plain forms and on odd tables."""

import hashlib
import os
import random
import re
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from muniment.llm import langid, licenses, pii, quality, toxicity

RX = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def ok(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
            return 16 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [(k, *m.span()) for k, rx in RX.items() for m in rx.finditer(text) if ok(k, m.group())]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice("ab1@.@-_ +()5 .") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]
    assert pii.base_spans("1" * 5000 + ".2.3.4") == plain_spans("x")


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_field_finds_more(field):
    finder = pii.Finder(field)
    said = "call (212) 555-0134 now\nthe key: 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b\ncard 1234567890123456 er\nfrom 1999 to 2004, 12.5 and version 1.2.33"
    got = {(k, said[s:e]) for k, s, e in finder.spans([said])[0]}
    assert {("phone", "(212) 555-0134"), ("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"), ("card", "1234567890123456")} <= got
    assert len(got) == 3
    assert finder.spans(["plain words only. and more words"]) == [[]]


def test_runs_are_split(field):
    finder = pii.Finder(field)

    def found(said):
        return {(k, said[s:e]) for k, s, e in finder.spans([said])[0]}

    assert {("phone", "555-123-4567"), ("phone", "555-987-6543")} <= found("call 555-123-4567, 555-987-6543 now")
    assert {("phone", "(212) 555-0134"), ("phone", "(213) 555-9876")} <= found("tel (212) 555-0134 (213) 555-9876")
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    assert ("secret", key) in found(f"key: {key}") and list(pii._pieces(f'token:"{key}"', "secret", 0, 48)) == [(7, 47)]
    assert list(pii._pieces(f"api_key={key}", "secret", 0, 48)) == [(8, 48)]
    mixed = "mail a.b@host.org 555-123-4567"
    assert {("email", "a.b@host.org"), ("phone", "555-123-4567")} <= found(mixed)
    assert list(pii._free(([5, 12], [9, 14]), 2, 20)) == [(2, 5), (9, 12), (14, 20)] and list(pii._free(([5], [9]), 6, 8)) == []


def test_held_out_by_kind(field):
    """Lines drawn by another seed: the field's spans against the labelled ones."""
    finder, hit, said, true = pii.Finder(field), {}, {}, {}
    for text, spans in pii.examples(600, seed=77):
        got = finder.spans([text])[0]
        for k, s, e in spans:
            true[k] = true.get(k, 0) + 1
            hit[k] = hit.get(k, 0) + any(g[0] == k and g[1] < e and g[2] > s for g in got)
        for k, s, e in got:
            said[k] = said.get(k, 0) + 1
    assert all(hit[k] / true[k] >= 0.9 for k in true), (hit, true)


def test_long_digits():
    import time

    start = time.time()
    assert pii.base_spans("1" * 1_000_000) == []
    assert len(pii.base_spans("1.2.3.4 " * 20_000)) == 20_000
    assert time.time() - start < 20


def test_viterbi_is_best(field):
    rng = np.random.default_rng(0)
    lines = [rng.normal(size=(n, len(pii.LABELS))) for n in (1, 2, 4, 3)]
    for e, path in zip(lines, field.decode(lines), strict=True):
        def total(p, e=e):
            return field.first[p[0]] + field.last[p[-1]] + sum(e[t, l] for t, l in enumerate(p)) + sum(field.t[a, b] for a, b in zip(p, p[1:]))
        best = max(np.ndindex(*[len(pii.LABELS)] * len(e)), key=total)
        assert total(tuple(path)) == pytest.approx(total(best))


def test_pii_table(spark, odd, none, field):
    got = {r["doc_id"]: r for r in pii.found(odd, field).collect()}
    assert len(got) == odd.select("doc_id").distinct().count()
    assert got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["spans"] == []
    assert list(got[12]["n_base"]) == [1, 1, 0, 1]
    assert all(r.value == "" or r.kind in pii.KINDS for x in got.values() for r in x["spans"])
    masked = {r["doc_id"]: r["text"] for r in pii.masked(odd, field).collect()}
    assert masked[12] == "mail [EMAIL], [PHONE], [IP]" and masked[1] is None
    assert pii.masked(odd, field).columns == odd.columns
    assert pii.found(none, field).count() == 0


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    win = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(win) if win.count(w) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(inside)


def test_base_counts():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é ", " ", "\n", "\t", "#", "a b c d e f g h i ", "\x0b", " x"]) for _ in range(rng.randrange(60)))
        assert quality.text_statistics(text)[:5] == plain_quality(text), repr(text)


def test_chi_square():
    assert quality.chi2_quantile(0.95, 3) == pytest.approx(7.8147, abs=1e-3)
    assert quality.chi2_quantile(0.5, 7) == pytest.approx(6.3458, abs=1e-3)


def test_outliers_go_and_clean_stays(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    rows = [(i, prose(rng.randrange(30, 900)), "en", f"s{i % 2}") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(100).split()), "en", "s0") for i in range(40)]
    rows += [(2000 + i, prose(100).upper() + "!!", "en", "s1") for i in range(40)]
    # Bad in one statistic only: half of the lines are one line repeated, between lines of their own.
    rows += [(3000 + i, "\n".join(x for _ in range(20) for x in (prose(12), "Top of page")), "en", "s0") for i in range(20)]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i]["kept"] for i in range(400)) >= 398
    assert not any(got[i]["kept"] for i in got if i >= 1000)
    assert not any(got[i]["base_failed"] for i in got)


def plain_mcd(x, seeds):
    """The least determinant over many starts of concentration steps on the whole matrix, exact halves."""
    h, best = (len(x) + x.shape[1] + 1) // 2, None
    for seed in range(seeds):
        at = np.random.default_rng(seed).choice(len(x), 20, replace=False)
        for _ in range(30):
            mu, cov = x[at].mean(axis=0), np.cov(x[at].T, bias=True)
            cov += np.diag(np.maximum(np.square(quality.FLOOR) - np.diag(cov), 0) + 1e-9)
            d = np.einsum("ij,ij->i", (x - mu) @ np.linalg.inv(cov), x - mu)
            at = np.argsort(d, kind="stable")[:h]
        if best is None or np.linalg.slogdet(cov)[1] < best[0]:
            best = np.linalg.slogdet(cov)[1], mu, cov
    return best


def test_estimate_against_plain(spark):
    """A fifth of the rows is a far cluster: the estimate lands on the larger part, as the plain search does."""
    rng = np.random.default_rng(8)
    mix = np.eye(7) + 0.4 * rng.normal(size=(7, 7)) / 7
    x = np.concatenate([rng.normal(size=(600, 7)) @ mix.T, rng.normal(size=(150, 7)) * 0.8 + 6])
    rows = [(i, "g", *map(float, v)) for i, v in enumerate(x)]
    stats = spark.createDataFrame(rows, "doc_id long, grp string, " + ", ".join(f"{c} double" for c in quality.STATS))
    got = quality.robust_state(stats).collect()[0]
    _, mu, cov = plain_mcd(x, 10)
    assert np.abs(np.array(got["mu"]) - mu).max() < 0.25
    far = lambda m, c: np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)
    white = np.zeros((7, 7))
    for (i, j), v in zip(quality._PAIRS, got["w"]):
        white[i, j] = v
    ours = (((x - np.array(got["mu"])) @ white.T) ** 2).sum(axis=1)
    assert np.corrcoef(np.log(ours), np.log(far(mu, cov)))[0, 1] > 0.97
    assert ours[600:].min() > quality.chi2_quantile(1 - quality.TAIL, 7) > np.quantile(ours[:600], 0.99)


def test_same_hash_windows_differ():
    words = [b"w%d" % (i % 11) for i in range(60)]
    assert quality.repeated_words(words) == 60
    assert quality.repeated_words([b"w%d" % i for i in range(60)]) == 0


def test_quality_odd(odd, none):
    got = quality.judged(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[6]["kept"] and by[7]["kept"]
    assert quality.judged(none).count() == 0


def wrapped(text, width, prefix=""):
    return "\n".join(prefix + x for part in text.split("\n") for x in textwrap.wrap(part, width))


def test_licenses(spark, odd, none):
    text = dict(licenses.TEXTS)
    rows = [("MIT", "", "Copyright (c) 2020 A. Body\n\n" + text["MIT"].replace(",", " ,").upper()), (None, "MIT", "words\nReleased  under the MIT LICENCE!\nmore"), (None, "", text["MIT"] + " extra"), (None, "", None), (None, "reserved", "All rights reserved."), (None, "", "")]
    heads = {"MIT": "MIT License\n\nCopyright (c) 2019-2024 Some Body <a@b.org>\n\n", "ISC": "ISC License\n\nCopyright (c) 4-digit year, Company\n\n", "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright 2001, Somebody\nAll rights reserved.\n\n", "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License\n\nCopyright © 2001 Somebody\n\n', "Zlib": "zlib License\n\n(C) 2010 Somebody\n\n"}
    for name, body in licenses.TEXTS:
        for width, prefix in ((60, ""), (72, "  "), (79, " * "), (41, "# ")):
            note = "reserved" if name == "BSD-2-Clause" else ""
            rows.append((name, note, heads.get(name, "") + wrapped(body, width, prefix)))
    wrap = 'provided that the above\ncopyright notice and this permission notice appear in all copies.'  # the usual wrapping of ISC
    rows += [("ISC", "", text["ISC"].replace("provided that the above copyright notice and this permission notice appear in all copies.", wrap)), ("BSD-3-Clause", "", text["BSD-3-Clause"].replace("1.", "*").replace("2.", "*").replace("3.", "*"))]
    rows += [(None, "", text["MIT"] + "\n(c) You owe me money."), (None, "", text["MIT"] + "\ncopyright holders may ask for more")]
    df = spark.createDataFrame([(i, t) for i, (*_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [(a, b) for a, b, _ in rows]
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    assert {r[0]: r[2:] for r in c.sql(licenses.OP4_SQL).fetchall()} == got
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def test_license_words(spark):
    """Equivalent words side by side, and the long licences' digests where their files lie on this machine."""
    said = [("LICENCE LICENCE", "license license"), ("a sub-licence", "a SUB licence"), ("V2 v3", "version 2 version 3"), ("http://x.y http://x.y", "https x y https x y")]
    df = spark.createDataFrame([(str(i), t) for i, pair in enumerate(said) for t in pair], "name string, text string")
    by = {}
    for r in licenses.digest_of(df).collect():
        by.setdefault(r["name"], set()).add(r["digest"])
    assert all(len(v) == 1 for v in by.values())
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    here = [(n, open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read()) for n, f in files.items() if os.path.exists(f"/usr/share/common-licenses/{f}")]
    for r in licenses.digest_of(spark.createDataFrame(here, "name string, text string")).collect() if here else []:
        assert (r["name"], r["digest"]) in licenses.DIGESTS


def test_toxicity(spark, odd, none):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(10)]
        if bad:
            sentences[rng.randrange(10)] += f" {rng.choice(['nastyone', 'nastytwo', 'vileword'])}"
        docs.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model).collect()}
    assert all((score[i] >= 0.3) == bool(t) for i, t in labels)
    found = toxicity.locate(df, model).collect()
    assert all(re.search("nasty|vile", r["sentence"]) for r in found) and {r["doc_id"] for r in found} == {i for i, t in labels if t}
    again = toxicity.train(df.unionAll(df), lab.unionAll(lab.withColumn("toxic", F.lit(0))))
    assert dict(again) == dict(model) and again.bias == model.bias  # repeated rows count once, of two labels the larger
    assert toxicity.scored(odd, model).count() == odd.count() and toxicity.scored(none, model).count() == 0
    assert {r["score"] for r in toxicity.scored(odd, toxicity.train(none, lab)).collect()} == {0.0}


def test_language_gradients():
    net = langid.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    codes, label, mask = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1]), np.ones((6, 4))
    _, grad = net.gradients(codes, label, mask)
    for k in net.p:
        at = (0, int(codes[2, 1])) if k[0] == "x" else (0, 0)
        net.p[k][at] += 1e-4
        up = net.gradients(codes, label, mask)[0]
        net.p[k][at] -= 2e-4
        down = net.gradients(codes, label, mask)[0]
        net.p[k][at] += 1e-4
        assert grad[k][at] == pytest.approx((up - down) / 2e-4, abs=1e-6)


def test_language_held_out(spark, odd, none):
    rng = random.Random(7)
    speech = {"en": "the and of with from which".split(), "de": "der und nicht für über schön".split(), "fr": "le et où être déjà garçon".split()}
    rows = [(i, " ".join(rng.choice(speech[l]) for _ in range(60)), l) for i in range(300) for l in [("en", "de", "fr")[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df.where("doc_id < 200"), rounds=12)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df.where("doc_id >= 200"), net).collect()}
    assert np.mean([got[i] == l for i, _, l in rows if i >= 200]) >= 0.97
    by = {r["doc_id"]: r for r in langid.identify(odd, net).collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[11]["lang_pred"] == "und" and by[1]["score"] == 0
    assert langid.identify(none, net).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}
    long = "the and of " * 20_000
    assert langid.predict(net, [long])[0] == ["en"]
