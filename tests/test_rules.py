"""The noise rules against their SQL on names and lines that two pattern engines read differently."""

import duckdb
import pytest

from muniment.plans import registry

LINES = [
    "Noñueci.", "Noñ voló.", "Cióno ño. x", "Sourceó a", "el éno. b", "ſource of it", "booK one two", "x\u000bvol y", "abc ", "abc\u0085 def", "EDİTOR a", "a b cfé cf. é", "DİOCESE x", "Smith", "Smİth Kedar",
    "KEDAR", "a de Riley", "a \u000bRiley", "Kingñ a vol. é", "Ñking pp. a", "St a pp.é 3", "a a a ſt. vol. x", "see Ñ1850ñ", "éed. smith",
]


@pytest.fixture(scope="module")
def odd_lines(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rules"))
    spark.createDataFrame([(n, t) for n, t in enumerate(["\n".join(LINES), *LINES])], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return path


def against_sql(spark, path, name):
    want = duckdb.sql(registry.oracle_sql()[name].replace("FROM documents", f"FROM '{path}/documents.parquet/*.parquet'")).df()
    got = registry.queries()[name](spark, path).toPandas()
    plain = lambda frame: sorted(map(str, frame[sorted(want.columns)].astype(object).where(frame[sorted(want.columns)].notna(), None).values.tolist()))
    assert len(want) > 0
    assert plain(got) == plain(want)


def test_problem_reasons_of_letters_beyond_ascii(spark, odd_lines):
    against_sql(spark, odd_lines, "problem_reasons")


def test_penalties_of_letters_beyond_ascii(spark, odd_lines):
    against_sql(spark, odd_lines, "penalised_confidence")


def test_noise_statistics_of_letters_beyond_ascii(spark, odd_lines):
    against_sql(spark, odd_lines, "noise_statistics")


def test_noise_share_of_many_lines(spark, tmp_path):
    """Shares that lie between two of four decimals, whose product with 10,000 does not."""
    parts = [(7, 800), (57, 800), (137, 800), (1, 800), (3, 160), (1, 32)]
    spark.createDataFrame([(n, "\n".join(["source"] * k + ["Baldwin Rodes"] * (m - k))) for n, (k, m) in enumerate(parts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    against_sql(spark, str(tmp_path), "noise_statistics")
