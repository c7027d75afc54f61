"""The running states as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import text as T
from ..operators.accepted import AcceptedIndex, dedup_against
from ..operators.buckets import MICROS, levels
from ..operators.quality import FilterConfig, quality_filter


def stream_usage(log: DataFrame, window: str = "60 seconds", slide: str | None = None, late: str = "5 minutes") -> DataFrame:
    """Requests and tokens by key and event-time window; rows later than the watermark are dropped. Also right for a batch."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp"))
    if log.isStreaming:
        rows = rows.withWatermark("ts", late)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(span, "key").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "key", "requests", "tokens")


class Buckets(StatefulProcessor):
    """The levels and the time of the last request of each key, for as long as a bucket is not full again."""

    def __init__(self, sizes: tuple[float, float], rates: tuple[float, float]):
        self.sizes, self.rates = sizes, rates

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "last long, requests double, tokens double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # The columns walked are numbers; a key's micro-batch is held as these, never as whole rows.
        us, events, costs = (np.concatenate(x) for x in zip(*[[batch[c].to_numpy() for c in ("us", "event_id", "tokens")] for batch in rows]))
        order = np.lexsort((events, us))
        us, events, costs = us[order], events[order], costs[order]
        last, *now = self.bucket.get() if self.bucket.exists() else (-1, *self.sizes)
        times = np.maximum.accumulate(np.append(last, us))  # a row older than the last one refills nothing
        pause = np.where(times[:-1] < 0, 0, np.diff(times)) / MICROS
        (a, requests), (b, tokens) = (levels(c, pause * r, x, n) for c, r, x, n in zip(self.sizes, self.rates, (np.ones(len(us)), costs), now))
        now = (float(requests[-1]), float(tokens[-1]))
        self.bucket.update((int(times[-1]), *now))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if all(r > 0 or n >= c for r, n, c in zip(self.rates, now, self.sizes)):
            wait = max((c - n) / r if r > 0 else 0.0 for r, n, c in zip(self.rates, now, self.sizes))
            self.handle.registerTimer(max(int(times[-1] / 1000 + wait * 1000) + 2, timerValues.getCurrentWatermarkInMs() + 1))
        for at in range(0, len(us), 10_000):
            cut = slice(at, at + 10_000)
            yield pd.DataFrame({"key": key[0], "event_id": events[cut], "admitted": (a & b)[cut], "request_level": requests[cut], "token_level": tokens[cut]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()  # full: as if it had never been there
        return iter([])

    def close(self) -> None:
        pass


def stream_token_bucket(log: DataFrame, request_capacity: float, request_refill: float, token_capacity: float, token_refill: float, late: str = "5 minutes") -> DataFrame:
    """(key, event_id, admitted, request_level, token_level): each key has a bucket of requests and one of tokens, as in ``operators.buckets.token_bucket``.

    Rows of one micro-batch are walked in the order of (ts, event_id); a row older than the last one, or without a time, refills nothing, and null or NaN tokens cost nothing.
    The levels are state in RocksDB. A timer drops those of a key once the watermark has passed the time when both its buckets
    are full again: rows that come then find full buckets either way, and rows that are older are too late. Buckets that never fill up keep their state.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log.select("key", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.nanvl(F.col("tokens").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("tokens"))
    rows = rows.withWatermark("ts", late).withColumn("us", F.coalesce(F.unix_micros("ts"), F.lit(-1)))
    made = "key string, event_id long, admitted boolean, request_level double, token_level double"
    processor = Buckets((float(request_capacity), float(token_capacity)), (float(request_refill), float(token_refill)))
    return rows.groupBy("key").transformWithStateInPandas(processor, made, "append", "EventTime")


def stream_quality_filter(source: DataFrame, accepted: str, checkpoint: str, config: FilterConfig = FilterConfig(), buckets: int = 16):
    """A started query that filters each micro-batch and against all texts accepted before, and adds what passes under ``accepted``.

    What equals or is near to an accepted text goes first, so that it can't count as kept within its batch: batches in the order of
    seq accept what one batch of all would. Accepted texts are kept in an index under ``accepted``-index (see ``operators.accepted``), of which a batch
    reads the partitions of its own words. Each batch writes the folder batch_id=n and its segment of the index anew and reads
    only segments of smaller n, so a batch that runs again gives the same table.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        index = AcceptedIndex(spark, f"{accepted}-index", config.similarity_threshold, buckets)
        rows = batch.select("*", T.text_hash(F.col("text")).alias("_hash"), T.hashed_set(F.col("text")).alias("_set"))
        if number > 0:
            rows = dedup_against(rows, index, number=number).where("reason is null").drop("reason")
        passed = quality_filter(rows, config).where("status = 'passed'").select(*batch.columns, "_hash", "_set")
        passed.write.mode("overwrite").parquet(f"{accepted}/batch_id={number}")
        index.append(spark.read.schema(passed.schema).parquet(f"{accepted}/batch_id={number}"), number)

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
