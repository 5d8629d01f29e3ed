"""The rate limit as a streaming operator, and findings that arrive as documents do."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_rate_limited(requests: DataFrame, key: str, ts: str, request_id: str, limit: int, window_seconds: float = 60) -> DataFrame:
    """key, request_id, ts, rejected for a stream of requests.

    The state of a client is the times that still count, ``limit`` at most. Requests of one
    batch are taken in order of time; one that comes later than younger ones is judged
    when it comes. Clients silent for a window are forgotten.
    """
    window_us = int(window_seconds * 1e6)

    def judge(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        rejected = []
        for now in rows["at"]:
            while times and now - times[0] >= window_us:
                times.popleft()
            rejected.append(len(times) >= limit)
            if not rejected[-1]:
                times.append(int(now))
        state.update((list(times),))
        state.setTimeoutDuration(max(1, int(window_seconds * 1000)))
        yield pd.DataFrame({"client": name[0], "request_id": rows["id"].to_numpy(), "at": rows["at"].to_numpy(), "rejected": rejected})

    keyed = requests.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("client"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(request_id).cast("string").alias("id"))
    judged = keyed.groupBy("client").applyInPandasWithState(
        judge, "client string, request_id string, at bigint, rejected boolean", "times array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    return judged.select(F.col("client").alias(key), "request_id", F.timestamp_micros("at").alias("ts"), "rejected")


def stream_findings(documents: DataFrame, find, path: str, checkpoint: str):
    """Writes the findings of each batch of new documents: ``find`` maps documents to findings."""

    def write(batch: DataFrame, number: int) -> None:
        find(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
