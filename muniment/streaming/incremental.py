"""What arrives over time: staged documents, votes, reviews and per-source tallies, as streaming queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def staged(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame]):
    """Processes each new staged JSON file once: the checkpoint remembers what is done. Returns the query."""
    rows = spark.readStream.schema(schema).json(path)

    def batch(df: DataFrame, epoch: int) -> None:
        process(df).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decision_counts(events: DataFrame, time: str, kind: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts a window and kind, late rows up to the watermark included. events may be a stream or a table."""
    seen = events.withWatermark(time, late) if events.isStreaming else events
    return seen.groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def replace_source(table: str, batch: DataFrame) -> DataFrame:
    """A batch's tally merged into a saved table: rows of the batch's sources are replaced, so runs repeat safely."""
    from ..operators.decisions import tallied

    spark = batch.sparkSession
    return tallied(spark.read.parquet(table), batch)


STATE = "n int, active string"
ACTIVE = "target_id string, n_reviews int, n_active int, conflict boolean"


def _follow(key, frames, state):
    """Reviews by id and action, and what is superseded, kept per target."""
    import json

    n, kept = (state.get[0], json.loads(state.get[1])) if state.exists else (0, {"on": {}, "gone": []})
    for frame in frames:
        for r in frame.itertuples():
            n += 1
            if r.supersedes:
                kept["gone"].append(r.supersedes)
            kept["on"][r.review_id] = r.action
    gone = set(kept["gone"])
    active = [a for i, a in kept["on"].items() if i not in gone]
    state.update((n, json.dumps(kept)))
    yield pd.DataFrame({"target_id": [key[0]], "n_reviews": [n], "n_active": [len(active)], "conflict": ["accept" in active and "reject" in active]})


def review_states(reviews: DataFrame) -> DataFrame:
    """A stream of (target_id, review_id, action, supersedes) to each target's state after every batch."""
    return reviews.groupBy("target_id").applyInPandasWithState(_follow, ACTIVE, STATE, "update", "NoTimeout")


def unseen(rows: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't cached yet, one a key."""
    return rows.dropDuplicates(keys).join(cache.select(keys).distinct(), keys, "left_anti")
