"""The event log as a stream: replay into a store, and counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemolake.operators.events import audit_states, created_rows
from mnemolake.schema import EVENT, ddl


def read_events(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return spark.readStream.schema(schema or ddl(EVENT)).parquet(path)


def replay(events: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Gives each micro-batch's memory rows to sink(rows, batch_id), which must ignore what it has already: a batch may come twice."""
    run = lambda batch, number: sink(created_rows(batch), number)
    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, stamp: str = "occurred_at", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each type in windows of event time; state of windows older than the watermark is dropped."""
    rows = events.withColumn("ts", F.col(stamp).cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")


def follow(store, sink, cursor: str, most_rows: int = 10_000) -> int:
    """Gives the events that a store has beyond a durable cursor to sink(events, cursor), in order and in slices of bounded size; returns the last cursor.

    The cursor is a file that is replaced after each slice, so a run that fails is taken up where it stopped: the slice
    that it was in comes again, no other.
    """
    spark = store.spark
    at = spark._jvm.org.apache.hadoop.fs.Path(cursor)
    fs, last = at.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    if fs.exists(at):
        stream = fs.open(at)
        last = int(bytes(stream.readAllBytes()).decode())
        stream.close()
    for last, rows in store.slices(last, most_rows):
        sink(rows, last)
        out = fs.create(at, True)
        out.write(bytearray(str(last).encode()))
        out.close()
    return last


def replay_history(history: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Follows another store's audit history: each micro-batch gives the memories that it changed, with their state now, to sink(rows, batch_id).

    The state of a memory, its last text and its last deletion, lives in Spark's state store; rows with `gone` are deletions.
    """
    run = lambda batch, number: sink(batch, number)
    return audit_states(history).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
