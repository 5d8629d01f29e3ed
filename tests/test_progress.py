from datetime import UTC, datetime, timedelta

from marginalia.streaming import progress

START = datetime(2024, 1, 1, tzinfo=UTC)
ASKED, CAME = "ref_id string, asked timestamp", "ref_id string, answered timestamp, status string"


def at(seconds):
    return START + timedelta(seconds=seconds)


REQUESTS = [("quick", at(0)), ("lost", at(1)), ("doubled", at(2)), ("late", at(3)), ("edge", at(4)), (None, at(5)), ("untimed", None)]
ANSWERS = [("quick", at(2), "verified"), ("doubled", at(9), "mismatch"), ("doubled", at(12), "verified"), ("late", at(40), "verified"), ("edge", at(34), "verified"), ("unknown", at(6), "verified"), (None, at(6), "x")]
WANTED = {"quick": ("verified", at(2)), "lost": ("lookup_incomplete", at(31)), "doubled": ("mismatch", at(9)), "late": ("lookup_incomplete", at(33)), "edge": ("lookup_incomplete", at(34))}


def told(rows):
    return {r.ref_id: (r.status, r.completed_at.replace(tzinfo=UTC)) for r in rows}


def test_progress_of_tables(spark):
    requests = spark.createDataFrame([*REQUESTS, ("quick", at(20))], ASKED)
    found = progress.progress(requests, spark.createDataFrame(ANSWERS, CAME)).collect()
    assert len(found) == 5 and told(found) == WANTED
    assert progress.progress(requests.where("false"), spark.createDataFrame(ANSWERS, CAME)).collect() == []
    assert {s for s, _ in told(progress.progress(requests, spark.createDataFrame([], CAME)).collect()).values()} == {"lookup_incomplete"}


def test_progress_of_streams(spark, tmp_path):
    """Answers come with their batches, timeouts once the watermark has passed them, each request once."""
    steps = [(REQUESTS[:3], []), (REQUESTS[3:], ANSWERS[:1]), ([("next", at(25))], ANSWERS[1:3]), ([("last", at(60))], [*ANSWERS[3:], ("next", at(60), "verified")]), ([("end", at(200))], [("end", at(200), "verified")]), ([("z", at(400))], [("z", at(401), "verified")])]
    for asked, came in steps:
        spark.createDataFrame(asked, ASKED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked")
        spark.createDataFrame(came, CAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/came")
        streams = [spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}") for name, schema in (("asked", ASKED), ("came", CAME))]
        query = progress.stream_progress(*streams, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination(120)
        assert query.exception() is None
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    got = told(rows)
    assert len(rows) == len(got)
    assert {k: got[k] for k in WANTED} == WANTED and got["next"] == ("lookup_incomplete", at(55)) and got["last"] == ("lookup_incomplete", at(90))
    batch = {r.ref_id: r.batch for r in rows}
    assert batch["quick"] < batch["doubled"] < batch["lost"]
