"""Streaming views of failure and progress logs; each has the batch query that gives the same final rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.operators.integrity import failure_summary
from gridloom.sources.shared import shared_path


def log_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as they come, or a single file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if one.exists(where) and one.getFileStatus(where).isFile():
        parent, name = where.getParent().toString(), where.getName()
        return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).load(parent)
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def failure_counts(log: DataFrame, kind: str = "error_type") -> DataFrame:
    """Failures by type, running totals."""
    return failure_summary(log, kind)


def request_windows(log: DataFrame, ts: str = "ts", late: str = "10 minutes", length: str = "75 seconds", step: str = "15 seconds") -> DataFrame:
    """Requests in sliding windows; the mean rate a minute of each. Events later than the watermark are dropped."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    n = rows.groupBy(F.window(ts, length, step)).agg(F.count("*").alias("n"))
    seconds = (F.unix_timestamp("window.end") - F.unix_timestamp("window.start")).cast("double")
    return n.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", (F.col("n") * 60.0 / seconds).alias("per_minute"))


def activity_sessions(log: DataFrame, key: str, ts: str = "ts", gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of activity without a pause of the gap; a stall lies between two of them."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    s = rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def stalls(log: DataFrame, key: str, key_type: str, ts: str = "ts", after: float = 120.0, escalate: int = 2) -> DataFrame:
    """Pauses longer than ``after`` seconds in each key's events, as they end; escalated from the given number of consecutive ones on.

    State per key: last event and consecutive stalls. An event that follows in time resets the count. Batches of a key are sorted by time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, count = state.get if state.exists else (None, 0)
        out = []
        for t in pd.concat([b[ts] for b in batches]).sort_values().astype("datetime64[us]").astype("int64"):
            if last is not None and t - last > after * 1e6:
                count += 1
                out.append((k[0], pd.Timestamp(last, unit="us"), (t - last) / 1e6, count, count >= escalate))
            elif last is not None:
                count = 0
            last = t if last is None else max(last, t)
        state.update((last, count))
        yield pd.DataFrame(out, columns=[key, "since", "seconds", "consecutive", "escalated"])

    rows = log.select(key, ts)
    schema = f"{key} {key_type}, since timestamp, seconds double, consecutive int, escalated boolean"
    return rows.groupBy(key).applyInPandasWithState(step, schema, "last long, count int", "append", GroupStateTimeout.NoTimeout)


def running_ranges(log: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Smallest, largest, sum and count so far of each band."""
    return log.groupBy(by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count(value).alias("count"))


def without_repeats(log: DataFrame, key: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def drained(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what there is and reads the rows it gave from Parquet in the shared folder; totals replace those of the batch before."""
    spark, folder = df.sparkSession, shared_path(df.sparkSession, name)
    rows = f"{folder}/rows"
    spark.createDataFrame([], df.schema).write.parquet(rows)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", rows)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(rows))
    writer.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(rows)


def flushed(df: DataFrame, path: str, checkpoint: str, every: str = "45 seconds", mode: str = "append") -> StreamingQuery:
    """Writes progress at fixed times; a restart goes on where the checkpoint ends, so every row is written once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(processingTime=every).start()
