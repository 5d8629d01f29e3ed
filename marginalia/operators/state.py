"""Rate limits and a cache with a time to live: folds over rows in order of time.

Whether a row passes depends on which rows before it passed, so no window frame tells. The
rows of a key stream through a task in order of time; a task holds the times that still
count, never the rows of a key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.chained import CappedCache, ClientLimit, WindowLimit, chained
from marginalia.storage import kept


def _limited(limit: int, window_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, times = object(), deque()
        for batch in batches:
            rejected = []
            for key, now in zip(batch.column("_key").to_pylist(), batch.column("_now").to_pylist()):
                if key != last:
                    last, times = key, deque()
                while times and now - times[0] >= window_us:
                    times.popleft()
                rejected.append(len(times) >= limit)
                if not rejected[-1]:
                    times.append(now)
            names = [n for n in batch.schema.names if n not in ("_key", "_now")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rejected)], [*names, "rejected"])

    return run


def _in_order(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    keyed = df.withColumns({"_key": F.coalesce(F.col(key).cast("string"), F.lit("unknown")), "_now": F.unix_micros(F.col(ts).cast("timestamp"))})
    return keyed.repartition("_key").sortWithinPartitions("_key", "_now", order)


def rate_limited(requests: DataFrame, key: str, ts: str, order: str, limit: int, window_seconds: float = 60) -> DataFrame:
    """Adds ``rejected``. A rejected request doesn't count against later ones; a null key is a client of its own."""
    kept = _in_order(requests, key, ts, order)
    schema = requests.withColumn("rejected", F.lit(False)).schema
    return kept.mapInArrow(_limited(limit, int(window_seconds * 1e6)), schema)


def _cached(ttl_us: int, keeps_failed: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, created = object(), None
        for batch in batches:
            hits = []
            failed = batch.column(keeps_failed).to_pylist() if keeps_failed else [False] * batch.num_rows
            for key, now, bad in zip(batch.column("_key").to_pylist(), batch.column("_now").to_pylist(), failed):
                if key != last:
                    last, created = key, None
                hits.append(created is not None and now - created < ttl_us)
                if not hits[-1]:
                    created = None if bad else now
            names = [n for n in batch.schema.names if n not in ("_key", "_now")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(hits)], [*names, "hit"])

    return run


def cache_hits(lookups: DataFrame, key: str, ts: str, order: str, ttl_seconds: float = 600, failed: str | None = None) -> DataFrame:
    """Adds ``hit``: whether a value made less than the time to live ago is there. Age counts from creation; failed lookups leave none."""
    kept = _in_order(lookups, key, ts, order)
    schema = lookups.withColumn("hit", F.lit(False)).schema
    return kept.mapInArrow(_cached(int(ttl_seconds * 1e6), failed), schema)


def origin_of(url: Column) -> Column:
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    return F.concat(scheme, F.lit("://"), host)


def admitted(requests: DataFrame, allowed: DataFrame, origin: str = "origin", referer: str = "referer") -> DataFrame:
    """Requests whose origin, or referer where there is none, is in ``allowed`` (origin)."""
    stated = F.when(F.coalesce(origin, F.lit("")) != "", F.col(origin)).otherwise(F.col(referer))
    names = allowed.select(origin_of(F.col("origin")).alias("_allowed")).distinct()
    return requests.join(names, origin_of(stated) == F.col("_allowed"), "left_semi")


def client_of(forwarded: str, address: str) -> Column:
    return F.coalesce(F.nullif(F.trim(forwarded), F.lit("")), F.nullif(F.trim(address), F.lit("")), F.lit("unknown"))


def globally_limited(requests: DataFrame, ts: str, order: str, limit: int, window_seconds: float = 60) -> DataFrame:
    """Adds ``rejected`` by one limit for all requests together; see ``chained`` for how that is done in parallel."""
    return chained(requests, WindowLimit(limit, int(window_seconds * 1e6)), ts, order, "rejected")


def capped_cache_hits(lookups: DataFrame, key: str, ts: str, order: str, cap: int = 500, ttl_seconds: float = 600, failed: str | None = None) -> DataFrame:
    """As ``cache_hits``, for one cache of ``cap`` entries: beyond that the entry first inserted goes. A key set again keeps its place."""
    return chained(lookups, CappedCache(int(ttl_seconds * 1e6), cap), ts, order, "hit", key, failed)


def rate_limited_with_reset(requests: DataFrame, key: str, ts: str, order: str, limit: int, window_seconds: float = 60, cap: int = 10_000) -> DataFrame:
    """As ``rate_limited``, but all clients are forgotten as soon as more than ``cap`` are known."""
    return chained(requests, ClientLimit(limit, int(window_seconds * 1e6), cap), ts, order, "rejected", key)


def guarded(requests: DataFrame, client: str, ts: str, order: str, client_limit: int, global_limit: int, window_seconds: float = 60) -> DataFrame:
    """Adds ``outcome``: client_limited, globally_limited or passed.

    The global limit takes only what its clients' limits let pass, which has used up their
    slots all the same.
    """
    by_client = kept(rate_limited(requests, client, ts, order, client_limit, window_seconds), "by-client")
    globally = globally_limited(by_client.where("not rejected").drop("rejected"), ts, order, global_limit, window_seconds)
    out = globally.withColumn("outcome", F.when(F.col("rejected"), "globally_limited").otherwise("passed")).drop("rejected")
    return out.unionByName(by_client.where("rejected").drop("rejected").withColumn("outcome", F.lit("client_limited")))


def guard_chain(
    requests: DataFrame, allowed: DataFrame, client: str, ts: str, order: str, client_limit: int, global_limit: int, window_seconds: float = 60, method: str = "method", origin: str = "origin", referer: str = "referer"
) -> DataFrame:
    """Adds ``outcome``: method_not_allowed, forbidden, client_limited, globally_limited or passed, in this order of tests.

    Only POST is allowed. A request that fails one test takes no slot of a later one.
    """
    names = allowed.select(origin_of(F.col("origin")).alias("_allowed")).where("_allowed is not null").distinct()
    stated = F.when(F.coalesce(origin, F.lit("")) != "", F.col(origin)).otherwise(F.col(referer))
    tested = requests.join(names, origin_of(stated) == F.col("_allowed"), "left")
    stopped = F.when(~F.coalesce(F.col(method) == "POST", F.lit(False)), "method_not_allowed").when(F.col("_allowed").isNull(), "forbidden")
    tested = kept(tested.withColumn("outcome", stopped).drop("_allowed"), "tested")
    good = guarded(tested.where("outcome is null").drop("outcome"), client, ts, order, client_limit, global_limit, window_seconds)
    return good.unionByName(tested.where("outcome is not null"))
