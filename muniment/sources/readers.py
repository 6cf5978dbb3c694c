"""Inputs: texts, PDFs, JSON in several shapes, CSV statements, TEI, genealogical pages, and staged files."""

from __future__ import annotations

import io
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

SHORT = 200  # a PDF's text layer below this many characters goes to recognition


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, recursively; bytes that aren't UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return raw.select("path", _lossy("content").alias("text"))


@F.pandas_udf(T.StringType())
def _lossy(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "replace"))


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:\\.|[^\]])*)\]\s*TJ")
_PIECE = re.compile(rb"\(((?:\\.|[^\\()])*)\)")


def pdf_layer(content: bytes) -> str:
    """The text that a simple PDF's content streams show, plain or deflated."""
    out = []
    for body in _STREAM.findall(content):
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        for one, many in _SHOWN.findall(body):
            out.append(b"".join(_PIECE.findall(many)) if many else one)
    return b"\n".join(out).replace(b"\\(", b"(").replace(b"\\)", b")").decode("latin-1")


def pdfs(spark: SparkSession, path: str, engines: dict | None = None) -> DataFrame:
    """(path, text, engine) of PDFs: the text layer, or if it is short what the first recognition engine, a
    function of bytes, returns that isn't empty. Without engines the layer stays."""
    names = list(engines or {})

    @F.pandas_udf("text string, engine string")
    def read(content: pd.Series) -> pd.DataFrame:
        rows = []
        for b in content:
            layer, who = pdf_layer(bytes(b)), "layer"
            if len(layer.strip()) < SHORT:
                for n in names:
                    if said := engines[n](bytes(b)):
                        layer, who = said, n
                        break
            rows.append((layer, who))
        return pd.DataFrame(rows, columns=["text", "engine"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(path)
    return raw.select("path", read("content").alias("r")).select("path", "r.text", "r.engine")


def inputs(spark: SparkSession, path: str, engines: dict | None = None) -> DataFrame:
    """(doc_id, path, text, engine) of all texts and PDFs below a path."""
    both = texts(spark, path).withColumn("engine", F.lit("text")).unionByName(pdfs(spark, path, engines))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return both.select(X.doc_key(stem, F.col("text")).alias("doc_id"), "path", "text", "engine")


AUTHORITY = "authority_id string, preferred_label string, name string, type string, variants array<string>, normalized struct<preferred:string,variants:array<string>>"


def authority(spark: SparkSession, path: str) -> DataFrame:
    """(authority_id, preferred_label, type, variants, more_variants) of an authority file, whose records lie
    under `persons` or `entities`."""
    schema = f"persons array<struct<{_fields(AUTHORITY)}>>, entities array<struct<{_fields(AUTHORITY)}>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode(F.coalesce("persons", "entities")).alias("r")).select("r.*")
    more = F.concat(F.array_compact(F.array("normalized.preferred")), F.coalesce("normalized.variants", F.array()))
    return rows.select("authority_id", F.coalesce("preferred_label", "name").alias("preferred_label"), "type", "variants", more.alias("more_variants"))


def _fields(ddl: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files with what could not be read in `_corrupt_record`; a missing path gives no rows."""
    try:
        return spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{schema}, _corrupt_record string")


PERSON = "name string, raw_mention string, title string, role string, gender string, `group` boolean, context string, confidence double, source_offset int"


def stored_people(spark: SparkSession, path: str, without: str = r"(index|unified_kg)\.json$") -> DataFrame:
    """Persons of per-document JSON files, tagged by file; file names that match `without` are passed over."""
    rows = spark.read.schema(f"doc_id string, persons array<struct<{PERSON.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True).withColumn("source_doc", F.input_file_name())
    return rows.where(~F.col("source_doc").rlike(without)).select("doc_id", "source_doc", F.posexplode("persons").alias("pos", "p")).select("doc_id", "source_doc", "pos", "p.*")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """Long statements (pos, qid, label, prop, value_label) from CSV pages."""
    rows = spark.read.schema("item string, itemLabel string, prop string, value string, valueLabel string").csv(path, header=True)
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    return rows.select(F.monotonically_increasing_id().alias("pos"), last("item").alias("qid"), F.col("itemLabel").alias("label"), last("prop").alias("prop"), F.coalesce("valueLabel", "value").alias("value_label"))


def qids(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.element_at(F.split(column, "/"), -1).alias("qid")).where(F.col("qid").rlike(r"^Q\d+$")).distinct()


TEI = "`_xml:id` string, persName array<struct<_VALUE:string,`_xml:lang`:string>>, birth struct<_when:string>, death struct<_when:string>, floruit struct<_from:string,_to:string>"


def tei_people(spark: SparkSession, path: str, tag: str = "person") -> DataFrame:
    """(id, names, birth, death, years) of TEI person elements."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(TEI).load(path)
    year = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"-?(\d{3,4})", 1), F.lit("")).cast("int")
    years = F.array_compact(F.array(year(F.col("birth._when")), year(F.col("death._when")), year(F.col("floruit._from")), year(F.col("floruit._to"))))
    return rows.select(F.col("`_xml:id`").alias("id"), F.transform("persName", lambda p: X.collapse(p["_VALUE"])).alias("names"), year(F.col("birth._when")).alias("birth"), year(F.col("death._when")).alias("death"), years.alias("years"))


def crossref(rows: DataFrame, column: str = "json") -> DataFrame:
    """(title, author, year) of bibliographic JSON: print, then online, then deposited year."""
    schema = "message struct<title:array<string>,author:array<struct<family:string,given:string>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,deposited:struct<`date-parts`:array<array<int>>>>"
    m = rows.select(F.from_json(column, schema)["message"].alias("m"))
    year = lambda k: F.get(F.get(F.col(f"m.`{k}`.`date-parts`"), F.lit(0)), F.lit(0))
    people = F.array_join(F.transform("m.author", lambda a: F.concat_ws(", ", a["family"], a["given"])), "; ")
    return m.select(F.get("m.title", F.lit(0)).alias("title"), people.alias("author"), F.coalesce(year("published-print"), year("published-online"), year("deposited")).alias("year"))


def recovered(raw: str | None) -> list[dict]:
    """The complete objects of a JSON array that was cut off."""
    import json

    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(raw or ""):
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    out.append(json.loads(raw[start : i + 1]))
                except ValueError:
                    pass
    return out


def open_bytes(content: bytes):
    return io.BytesIO(content)
