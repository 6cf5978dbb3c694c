"""Outputs: documents, indexes, Turtle, JSON-LD, TEI, BibTeX, worksheets, histories."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence


#: Spark's setting that deletes an execution's shuffle files at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written once and read again, so that what reads it several times computes it once; the shuffle files that it took
    are deleted then. It is kept in spark.checkpoint.dir, which driver and executors share, or in local mode in a temporary folder."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='muniment-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/s-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(people: DataFrame, links: DataFrame, path: str) -> None:
    """One JSON line a document with its persons and links."""
    p = people.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in people.columns if c not in ("doc_id", "pos")]))).alias("persons"))
    k = links.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in links.columns if c not in ("doc_id", "pos", "candidates")]))).alias("links"))
    p.join(k, "doc_id", "left").write.mode("overwrite").json(path)


def index(docs: DataFrame) -> DataFrame:
    return docs.agg(F.countDistinct("doc_id").alias("count"), F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("documents"))


def canonical_json(*columns: str) -> Column:
    """JSON of the columns with its keys sorted."""
    return F.to_json(F.struct(*sorted(columns)))


def checked(objects: DataFrame, path: str) -> None:
    """Objects as canonical JSON lines, written only if no contract is violated; Spark's commit makes it atomic."""
    bad = [r["violation"] for r in evidence.contract_violations(objects).limit(10).collect()]
    if bad:
        raise ValueError("; ".join(bad))
    objects.select(canonical_json(*objects.columns).alias("value")).write.mode("overwrite").text(path)


def turtle(graph: DataFrame, path: str, base: str = evidence.BASE) -> None:
    """Turtle blocks as text files, each of which begins with the prefixes."""
    header = evidence.turtle_header(base)

    def run(batches):
        yield pa.RecordBatch.from_pydict({"value": [header]})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    evidence.serialised(graph).select("block").mapInArrow(run, "value string").write.mode("overwrite").text(path)


def publish(objects: DataFrame, mentions: DataFrame, accepted: DataFrame, path: str) -> None:
    """The publication profiles side by side: json, ttl, jsonld and tei."""
    checked(objects, f"{path}/json")
    turtle(evidence.publication(objects), f"{path}/ttl")
    evidence.discovery(objects).select("json").write.mode("overwrite").text(f"{path}/jsonld")
    evidence.tei_standoff(mentions, accepted).select("xml").write.mode("overwrite").text(f"{path}/tei")


def bibliography(docs: DataFrame, path: str) -> None:
    key = T.cite_key(F.coalesce("title", F.lit("untitled")), F.col("year"))
    docs.select(T.bibtex(key, F.col("title"), F.col("author"), F.col("year")).alias("value")).write.mode("overwrite").text(path)


def appended(rows: DataFrame, path: str) -> None:
    """Append-only JSON lines: reviews and evaluation history."""
    rows.write.mode("append").json(path)


def accepted_names(rows: DataFrame, votes: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, person) accepted here, or by at least `least` of the community."""
    mine = rows.where("decision = 'accept'").select("doc_id", "person")
    theirs = votes.where(F.col("decision") == "accept").where(F.col("n") >= least).select("doc_id", "person")
    return mine.union(theirs).distinct()


def same_as(candidates: DataFrame, least: float = 0.4) -> DataFrame:
    """(person, json): JSON-LD of a person, with sameAs only where the best external score suffices."""
    best = candidates.groupBy("person").agg(F.max_by("qid", F.struct("score", "qid")).alias("qid"), F.max("score").alias("score"))
    link = F.when(F.col("score") >= least, F.concat(F.lit("http://www.wikidata.org/entity/"), "qid"))
    return best.select("person", F.to_json(F.struct(F.lit("Person").alias("@type"), F.col("person").alias("name"), link.alias("sameAs"))).alias("json"))


def worksheet(repair: DataFrame, growth: DataFrame) -> DataFrame:
    """Markdown lines of a review worksheet: accepted links to check, then the queue of proposals."""
    line = lambda df, section: df.select(F.lit(section).alias("section"), F.concat(F.lit("- "), F.col("person"), F.lit(" → "), F.coalesce("top_id", F.lit("?")), F.lit(" ("), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))), F.lit(")")).alias("line"))
    return line(repair, "1 repair").unionByName(line(growth, "2 growth"))
