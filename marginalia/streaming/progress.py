"""Lookups under way: answers as they come, and what becomes of requests without one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIMEOUT_SECONDS, LATENESS = 30, "10 seconds"
NO_ANSWER = "lookup_incomplete"


def progress(requests: DataFrame, answers: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """ref_id, asked, status, completed_at: one row for each request (ref_id, asked) and what came of it.

    The first answer (ref_id, answered, status) within the time counts; further ones and
    those that come too late or before their request are dropped. A request without one is
    ``lookup_incomplete`` when its time is over. Rows without an id or a time are left out,
    and so is an id's second request.

    Works on tables and on streams. In a stream an answer is passed on with the batch in
    which it comes, and a timeout once the watermark, ``lateness`` behind the latest times
    on both sides, has passed it; requests and answers that come later than that are
    dropped. What is kept for a request goes with its timeout.
    """
    asked = requests.select("ref_id", F.col("asked").cast("timestamp").alias("asked")).where("ref_id is not null and asked is not null")
    came = answers.select(F.col("ref_id").alias("_ref"), F.col("answered").cast("timestamp").alias("answered"), "status").where("_ref is not null and answered is not null")
    streaming = asked.isStreaming
    if streaming:
        asked, came = asked.withWatermark("asked", lateness).dropDuplicatesWithinWatermark(["ref_id"]), came.withWatermark("answered", lateness)
    else:
        first = F.row_number().over(Window.partitionBy("ref_id").orderBy("asked"))
        asked = asked.withColumn("_n", first).where("_n = 1").drop("_n")
    over = F.col("asked") + F.expr(f"INTERVAL {timeout_seconds} SECONDS")
    joined = asked.join(came, (F.col("ref_id") == F.col("_ref")) & (F.col("answered") >= F.col("asked")) & (F.col("answered") < over), "left")
    if streaming:
        # one column of event time goes on: that of the request
        joined = joined.withColumn("answered", F.timestamp_micros(F.unix_micros("answered"))).dropDuplicatesWithinWatermark(["ref_id"])
    else:
        best = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.col("answered").asc_nulls_last(), "status"))
        joined = joined.withColumn("_n", best).where("_n = 1").drop("_n")
    return joined.select("ref_id", "asked", F.when(F.col("answered").isNull(), NO_ANSWER).otherwise(F.col("status")).alias("status"), F.coalesce("answered", over).alias("completed_at"))


def stream_progress(requests: DataFrame, answers: DataFrame, path: str, checkpoint: str, timeout_seconds: int = TIMEOUT_SECONDS, lateness: str = LATENESS):
    """Appends what ``progress`` gives for two streams to a table at ``path``, each batch in order of completion."""

    def write(batch: DataFrame, number: int) -> None:
        batch.sortWithinPartitions("completed_at", "ref_id").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/number={number}")

    found = progress(requests, answers, timeout_seconds, lateness)
    return found.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
