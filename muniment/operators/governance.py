"""Sources: what may be done with them, what is quarantined or stale, and what the authority covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The registry's vocabulary.
RIGHTS = ("open", "restricted", "unknown", "closed")
REQUIRED = ("id", "title", "rights", "permitted_operations", "checked_at")


def registry_errors(registry: DataFrame) -> DataFrame:
    """(id, error): repeated ids, missing required fields, rights outside the vocabulary."""
    twice = registry.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("error"))
    missing = registry.select("id", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED if c != "id"]))).alias("error"))
    rights = registry.where(~F.col("rights").isin(*RIGHTS)).select("id", F.lit("rights").alias("error"))
    return twice.unionAll(missing).unionAll(rights)


def allowed(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests (source_id, operation, written_permission) with `allowed`; an unknown source allows nothing."""
    known = registry.select(F.col("id").alias("source_id"), "rights", "permitted_operations")
    listed = F.array_contains(F.coalesce("permitted_operations", F.array()), F.col("operation"))
    ok = listed & ((F.col("rights") == "open") | F.coalesce("written_permission", F.lit(False)))
    return requests.join(known, "source_id", "left").withColumn("allowed", F.coalesce(ok, F.lit(False))).drop("rights", "permitted_operations")


def quarantined(registry: DataFrame) -> DataFrame:
    return registry.where(~F.coalesce("canonical", F.lit(False)) | ~F.coalesce("public", F.lit(False))).select(F.explode("paths").alias("path")).distinct()


def review_age(registry: DataFrame, today: Column) -> DataFrame:
    age = F.datediff(today, F.to_date("checked_at"))
    return registry.select("id", age.alias("age_days"), (age > F.col("stale_after_days")).alias("stale"))


def coverage(benchmark: DataFrame, authority: DataFrame, group: str = "tradition") -> DataFrame:
    """(group, present, missing, total) of benchmark (name, group) against authority (name), and the grand total."""
    seen = benchmark.join(authority.select("name").distinct().withColumn("here", F.lit(1)), "name", "left")
    return seen.rollup(group).agg(F.count("here").alias("present"), F.count_if(F.col("here").isNull()).alias("missing"), F.count(F.lit(1)).alias("total"))


def name_provenance(records: DataFrame) -> DataFrame:
    """records (id, names, sources) with each name's sources; names without a map entry and entries without a name."""
    filled = F.map_from_arrays("names", F.array_repeat("sources", F.size("names")))
    out = records.withColumn("name_sources", F.coalesce(F.col("name_sources"), filled) if "name_sources" in records.columns else filled)
    return out.withColumn("unsourced", F.array_except("names", F.map_keys("name_sources"))).withColumn("unnamed", F.array_except(F.map_keys("name_sources"), "names"))


def inventory(files: DataFrame) -> DataFrame:
    """(path, records, sha256) of files (path, content): how many records a JSON file holds, by its known keys."""
    text = F.decode("content", "UTF-8")
    n = F.coalesce(F.json_array_length(F.get_json_object(text, "$.persons")), F.json_array_length(F.get_json_object(text, "$.objects")), F.json_array_length(F.get_json_object(text, "$.entities")), F.json_array_length(text), F.lit(1))
    return files.select("path", n.cast("long").alias("records"), F.sha2("content", 256).alias("sha256"))
