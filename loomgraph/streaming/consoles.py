"""Messages of a change feed to the console of each graph: in one pass over a table, or over a stream with state for each graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a feed has: console rows (kind ``console``) open a console for their graph, the others tell what has happened to a node or an edge (src and dst, else null).
FEED = "kgraph_id long, at timestamp, seq long, kind string, oper string, entity_id long, src long, dst long, console long"
MESSAGES = "kgraph_id long, at timestamp, seq long, console long, number long, message string"
KINDS = ("knode", "kedge")


def _shown() -> Column:
    """Only additions of nodes and edges are shown, and no loops."""
    loop = F.col("src").isNotNull() & F.col("src").eqNullSafe(F.col("dst"))
    return F.col("kind").isin(*KINDS) & (F.col("oper") == "ADD") & ~loop


def _message() -> Column:
    return F.to_json(F.struct("oper", "kind", F.col("kgraph_id").alias("kgraph"), F.col("entity_id").alias("id"), "src", "dst")).alias("message")


def console_messages(feed: DataFrame, idle_seconds: int) -> DataFrame:
    """Messages of a whole feed: (kgraph_id, at, seq, console, number, message), one for each addition of a node or edge that is no loop, to the console that its graph has then.

    The last console that was opened wins; without one nothing is sent. Rows count in the order of time, then ``seq``. A graph without rows for more than ``idle_seconds`` loses its console,
    and its numbers start anew at 1. Rows without a graph or time are left out.
    """
    rows = feed.filter("kgraph_id is not null and at is not null")
    order = Window.partitionBy("kgraph_id").orderBy("at", "seq")
    gap = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(order) > idle_seconds * 1_000_000
    rows = rows.withColumn("_session", F.sum(F.when(gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    session = Window.partitionBy("kgraph_id", "_session").orderBy("at", "seq")
    held = F.last(F.when(F.col("kind") == "console", F.col("console")), ignorenulls=True).over(session.rowsBetween(Window.unboundedPreceding, 0))
    sent = rows.withColumn("console", held).filter(_shown() & F.col("console").isNotNull())
    return sent.select("kgraph_id", "at", "seq", "console", F.row_number().over(session).cast("long").alias("number"), _message())


class _Consoles(StatefulProcessor):
    """State of one graph: its console, the last number sent, the time of its last row, and a timer that clears them."""

    def __init__(self, idle_seconds: int):
        self.idle = idle_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("graph", "console long, number long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        console, number, last = self.state.get() if self.state.exists() else (None, 0, None)
        batch = pd.concat(list(rows)).sort_values(["micros", "seq"], kind="stable")  # a graph's rows of one micro-batch
        out = []
        for r in batch.itertuples(index=False):
            if last is not None and r.micros - last > self.idle:
                console, number = None, 0  # what the timer does, where rows come sooner than the timer
            last = int(r.micros)
            if r.kind == "console" and not pd.isna(r.console):
                console = int(r.console)
            if r.shown and console is not None:
                number += 1
                out.append((r.kgraph_id, r.at, r.seq, console, number, r.message))
        self.state.update((console, number, last))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.idle) // 1000 + 1)
        yield pd.DataFrame(out, columns=["kgraph_id", "at", "seq", "console", "number", "message"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def console_stream(feed: DataFrame, idle_seconds: int, late: str = "0 seconds") -> DataFrame:
    """The same messages from a stream whose rows come in the order of time from one micro-batch to the next, up to ``late``; rows that come later are dropped.

    Each graph's state is a console, a number and a time; a timer clears it once the stream has gone on for ``idle_seconds``, so state doesn't grow with graphs that are over. A micro-batch's rows of one graph are
    sorted in one task. The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = feed.filter("kgraph_id is not null and at is not null").withWatermark("at", late)
    rows = rows.select("kgraph_id", "at", "seq", "kind", "console", F.unix_micros("at").alias("micros"), F.coalesce(_shown(), F.lit(False)).alias("shown"), _message())
    return rows.groupBy("kgraph_id").transformWithStateInPandas(_Consoles(idle_seconds), MESSAGES, "Append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(feed: DataFrame, folder: str, idle_seconds: int, batches: int = 3) -> DataFrame:
    """Messages of a stored feed, sent through the stream in micro-batches of consecutive times: writes the feed to ``folder`` in as many parts, streams them, and reads what came out."""
    spark = feed.sparkSession
    edges = feed.filter("at is not null").agg(F.percentile_approx(F.unix_micros("at"), [i / batches for i in range(1, batches)])).first()[0] or []
    part = sum((F.when(F.unix_micros("at") > e, 1).otherwise(0) for e in edges), F.lit(0))
    for i in range(batches):  # one file a part, the older first; the source takes one at a time
        feed.filter(F.coalesce(part, F.lit(0)) == i).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")
        run = console_stream(stream, idle_seconds).writeStream.format("parquet").option("path", f"{folder}/messages").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    return spark.read.schema(MESSAGES).parquet(f"{folder}/messages")
