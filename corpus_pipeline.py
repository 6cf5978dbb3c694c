"""From raw documents to packed training sequences: five stages over the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, extra ones included. A filtering stage decides on rows: of an id with several rows only those that it
rejects go, and rows without an id are judged like others. Null, empty and wordless texts fail the quality
rules; whole texts are read, whatever their length; of repeated or tied near copies the row of the smallest id
stays, or where ids are missing or repeated, of the smallest hash; an empty table passes all stages empty.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muniment.llm import common, mixing, packing, pii, quality, shingles

#: Rows to remove are broadcast up to so many (some MB), joined by a shuffle beyond.
IDS = 200_000


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that begins with small heaps, whatever the executors have run before."""

    @functools.wraps(run)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.free_heaps(spark)
        return run(spark, docs, sf_dir)

    return begun


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """docs with a column that names its rows, the column's name, and whether the names are ids: a hash of id, text,
    language and source where ids are missing or repeated, by which only repeated rows share a name."""
    name = "row_"
    while name in docs.columns:
        name += "_"
    unique = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty()
    key = F.col("doc_id").cast("long") if unique else F.xxhash64("doc_id", "text", "lang", "source")
    return docs.withColumn(name, key), name, unique


def _without(keyed: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    return keyed.join(common.if_small(common.durable(rows.select(name).distinct()), IDS), name, "left_anti")


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject: no words, too many repeated ones, outliers. A short text
    says too little to be an outlier, and shortness alone rejects none here."""
    keyed, name, _ = _keyed(docs)
    return _without(keyed, quality.judged(keyed, min_words=1, also=(name,)).where(~F.col("kept")), name).select(docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest name by _keyed(); of repeated rows one. Documents are
    near-duplicates from a similarity of 0.8 of their sets of five-word shingles; op1_simhash's settings are its own."""
    keyed, name, unique = _keyed(docs)
    found = shingles.near_duplicates(keyed.select(F.col(name).alias("doc_id"), "text")).where("doc_id <> component_id")
    kept = _without(keyed, found.select(F.col("doc_id").alias(name)), name)
    return (kept if unique else kept.dropDuplicates([name])).select(docs.columns)


@_stage
def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them."""
    return mixing.mixed(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; a document taken twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("PII", mask_pii),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: The stages that train a field, estimate covariances and tokenize can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = common.durable(docs)
            common.free_plans(spark)
    return docs
