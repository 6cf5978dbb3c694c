import pytest
from pyspark.sql import functions as F

from muniment.functions import fuzzy
from muniment.functions import text as T
from muniment.operators import extraction as X
from muniment.operators import linking as L
from muniment.sources import readers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "score"), [("godefroy de bouillon", "godefroy of bouillon", 1.0), ("ralph of caen", "ralph ii of fougeres", 0.606), ("count robert of flanders", "thierry of flanders", 0.651)])
def test_ensemble(a, b, score):
    assert fuzzy.ensemble(a, b) == pytest.approx(score, abs=1e-3)


def test_lcs_forms_agree(spark):
    pairs = [("abcde", "ace"), ("", "x"), ("ring", "string"), ("aaaa", "aa"), ("godefroy", "gaufrei")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(fuzzy.lcs_column(F.col("a"), F.col("b"))).collect()] == [fuzzy.lcs(a, b) for a, b in pairs]


def test_normalise(spark):
    assert one(spark, T.normalise(F.col("s")), s="  Adhémar  of-le Puy! ") == "adhemar of le puy"
    assert one(spark, T.normalise(F.col("s"), punctuation=None), s="Adhémar of-le Puy") == "adhemar of-le puy"
    assert one(spark, T.normalise(F.col("s"), casefold=True), s="Groß") == "gross"
    assert one(spark, T.fold_particles(F.col("s")), s="ralph of caen") == "ralph caen"
    assert one(spark, T.fold_particles(F.col("s")), s="of caen") == "of caen"


def test_text_helpers(spark):
    assert one(spark, T.repaired_json(F.col("s")), s='```json\n{"a": 1} tail') == '{"a": 1}'
    assert one(spark, T.decision_of(F.col("s")), s="reject:wrong_match") == "reject"
    assert one(spark, T.year_signed(F.col("s")), s="c. -500 BC") == "-500"
    assert one(spark, T.doi(F.col("s")), s="https://doi.org/10.1/AB") == "10.1/ab"
    assert one(spark, T.entity_uri(F.col("s")), s="WIKIDATA:Q1") == "http://www.wikidata.org/entity/Q1"
    assert one(spark, T.is_iso_time(F.col("s")), s="2024-01-02T03:04:05Z") is True
    assert one(spark, T.is_iso_time(F.col("s")), s="soon") is False


def test_mentions(spark):
    text = "In the Second Crusade Eugene III met Count Raymond of Tripoli, and Godfrey of Bouillon. The pilgrims saw Jerusalem. Riley-Smith argues."
    got = [(r["name"], r["title"], r["group"], r["source_offset"]) for r in X.mentions(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()]
    assert ("Eugene III", None, False, text.index("Second")) in got or ("Eugene III", None, False, text.index("In the")) in got
    assert any(g[:3] == ("Count Raymond of Tripoli", "Count", False) for g in got)
    assert any(g[:3] == ("pilgrims", None, True) for g in got)
    assert not any(g[0] == "Jerusalem" for g in got)


def test_reasons(spark):
    rows = [("Volume", "", False, None, "bibliographic_noise"), ("Steven Runciman", "", False, None, "modern_scholar"), ("Robert of France", "", False, None, None), ("Ab", "", False, None, "token_too_short"), ("Louis 9", "", False, None, "contains_digits"), ("", "", False, None, "empty_name"), ("Dr. Who", "the university in 1985", False, None, "post_medieval")]
    df = spark.createDataFrame(rows, "name string, context string, group boolean, title string, want string")
    for r in df.withColumn("got", X.problem_reason(F.col("name"), F.col("context"), F.col("group"), F.col("title"))).collect():
        assert r["got"] == r["want"], r


def test_links(spark):
    auth = spark.createDataFrame([("AUTH:1", "Godefroy de Bouillon", "person", ["Godfrey of Bouillon"], []), ("AUTH:2", "Thierry of Flanders", "person", [], []), (None, "Nobody", None, [], [])], "authority_id string, preferred_label string, type string, variants array<string>, more_variants array<string>")
    people = spark.createDataFrame([(1, 0, "Godfrey of Bouillon", False), (1, 1, "Godefroy of Bouillon", False), (1, 2, "Someone Else", False)], "doc_id long, pos int, name string, `group` boolean")
    got = {r["person"]: (r["top_id"], r["status"], r["confidence"]) for r in L.links(people, L.authority_lookup(auth)).collect()}
    assert got["Godfrey of Bouillon"] == ("AUTH:1", "high", 1.0)
    assert got["Godefroy of Bouillon"][0] == "AUTH:1"
    assert got["Someone Else"][:2] == (None, "no_match")


def test_chunks_cover_the_text(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(200))
    got = X.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 300).orderBy("chunk").collect()
    assert " ".join(r["text"] for r in got) == text
    assert all(len(r["text"]) <= 301 and text[r["start"] :].startswith(r["text"][:20]) for r in got)


def test_recovered_json():
    assert readers.recovered('[{"a": "}"}, {"b": 1}, {"c"') == [{"a": "}"}, {"b": 1}]


def test_files(spark, tmp_path):
    (tmp_path / "a b.txt").write_bytes("Größe \xff".encode("utf-8") + b"\xff")
    (tmp_path / "x.pdf").write_bytes(b"%PDF\nstream\nBT (Walter) Tj ET\nendstream")
    got = {r["engine"]: r for r in readers.inputs(spark, str(tmp_path), {"stub": lambda b: "recognised"}).collect()}
    assert got["text"]["text"].startswith("Größe") and got["text"]["doc_id"].startswith("a-b-")
    assert got["stub"]["text"] == "recognised"


def test_pages_source(spark, tmp_path):
    from muniment.sources.remote import PagedSource

    for n in range(3):
        (tmp_path / f"page-{n:05d}.json").write_text('[{"item": "Q%d"}, {"item": "Q9"}]' % n)
    spark.dataSource.register(PagedSource)
    df = spark.read.format("muniment_pages").option("path", str(tmp_path)).option("pages", 3).load()
    assert sorted(r["item"] for r in df.collect()) == ["Q0", "Q1", "Q2", "Q9", "Q9", "Q9"]


def test_streams(spark, tmp_path):
    from muniment.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"id": "a"}\n')
    for _ in range(2):  # the second run finds nothing new
        incremental.staged(spark, str(tmp_path / "in"), "id string", str(tmp_path / "out"), str(tmp_path / "ck"), lambda d: d).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
