"""The change feed of a graph and windowed counts, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.graph import first_per_key


def changes(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """ADD, DELETE and UPDATE events between two versions of a table: (kgraph_id, kind, oper, entity_id).

    Rows are told apart by a hash of their JSON form, in which maps have their entries in the order of the keys and a null is no value: maps in another order are equal, and a
    value that moves from one column to another is an update. Null ids meet nothing: such rows are added and deleted.
    """
    part = lambda c, t: (F.array_sort(F.map_entries(c)) if t.startswith("map") else F.col(c)).alias(c)
    old, new = (df.select("kgraph_id", "id", F.xxhash64(F.to_json(F.struct(*[part(c, df.schema[c].dataType.simpleString()) for c in sorted(df.columns)]))).alias(h)) for df, h in ((before, "_old"), (after, "_new")))
    both = old.join(new, ["kgraph_id", "id"], "full").filter("_old is null or _new is null or _old != _new")
    oper = F.when(F.col("_old").isNull(), "ADD").when(F.col("_new").isNull(), "DELETE").otherwise("UPDATE")
    return both.select("kgraph_id", F.lit(kind).alias("kind"), oper.alias("oper"), F.col("id").alias("entity_id"))


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; on a stream, events later than ``late`` behind the newest are dropped and windows end then."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    return own.groupBy(F.window(time, window, slide) if slide else F.window(time, window), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    own = events.withWatermark(time, late) if events.isStreaming else events
    return own.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def deduplicated(events: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """First event of each key; on a stream within the watermark, so state stays bounded."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return first_per_key(events, keys, time)


def publish(events: DataFrame, path: str, checkpoint: str, kind: str | None = None) -> StreamingQuery:
    """Appends a feed (of one kind) to a folder, exactly once, until it has caught up."""
    own = events if kind is None else events.filter(F.col("kind") == kind)
    return own.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(events: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], kind: str | None = None) -> StreamingQuery:
    """Calls handle(batch, number) with each micro-batch of a feed until it has caught up."""
    own = events if kind is None else events.filter(F.col("kind") == kind)
    return own.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
