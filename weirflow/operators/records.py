"""Recorded channels: a log table of ``channel, seq, ts_ns, payload, lineage``, plus its append order ``arrival``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import lineage as L

from .dataflow import HISTORY, top_by
from .numbering import number


def record(channels: dict[str, DataFrame], payload_col: str = "payload", start: int | None = None, stop: int | None = None) -> DataFrame:
    """All messages of the channels as one log; those that arrive from ``start`` on and before ``stop``, where these are given."""
    parts = [
        df.select(F.lit(name).alias("channel"), "seq", "ts_ns", "arrival", F.col(payload_col).cast("binary").alias("payload"), "lineage")
        for name, df in channels.items()
    ]
    log = reduce(lambda a, b: a.unionByName(b), parts)
    log = log if start is None else log.filter(F.col("arrival") >= start)
    return log if stop is None else log.filter(F.col("arrival") < stop)


def write(log: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write a log, one folder a channel, so that a scan of a channel reads nothing else."""
    log.write.partitionBy("channel").option("compression", compression).parquet(path)


def append(log: DataFrame, path: str, compression: str = "zstd") -> None:
    """Add messages to a written log; their numbers and arrivals go on from its own, whatever they were."""
    there = read(log.sparkSession, path)
    last = there.groupBy("channel").agg(F.max("seq").alias("_last"))
    came = there.agg(F.max("arrival")).first()[0]
    own = number(number(log, ["arrival"], "_place"), ["_place"], "_own", by=["channel"]).join(last, "channel", "left")
    shifted = own.withColumns({"seq": F.col("_own") + F.coalesce(F.col("_last") + 1, F.lit(0)), "arrival": F.col("_place") + (0 if came is None else came + 1)})
    shifted.select(*log.columns).write.mode("append").partitionBy("channel").option("compression", compression).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_range(log: DataFrame, channel: str | None, lo: int, hi: int) -> DataFrame:
    """Messages from ``lo`` to ``hi``, both included; both filters reach the scan."""
    out = log.filter(F.col("ts_ns").between(lo, hi))
    return out if channel is None else out.filter(F.col("channel") == channel)


def split_by_time(log: DataFrame, lo: int, hi: int) -> DataFrame:
    return read_range(log, None, lo, hi)


def merge(*logs: DataFrame) -> DataFrame:
    """All messages of all logs, none dropped; order them by ``ts_ns`` and ``arrival``."""
    return reduce(lambda a, b: a.unionByName(b), logs)


def seek(log: DataFrame, ts_ns: int) -> DataFrame:
    """The first message at or after a time."""
    return log.filter(F.col("ts_ns") >= ts_ns).orderBy("ts_ns", "arrival").limit(1)


def first_n(log: DataFrame, n: int) -> DataFrame:
    return top_by(log, ["channel"], ["arrival"], n)


def dump(log: DataFrame, n: int = HISTORY) -> DataFrame:
    """The bounded history of every channel."""
    return top_by(log, ["channel"], [F.desc("arrival")], n)


def channel_stats(log: DataFrame) -> DataFrame:
    """Count, bytes, first and last number and time of each channel, and its average rate."""
    span = (F.col("last_ts_ns") - F.col("first_ts_ns")) / F.lit(1e9)
    return (
        log.groupBy("channel")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.octet_length("payload").cast("bigint")).alias("n_bytes"),
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.min("ts_ns").alias("first_ts_ns"),
            F.max("ts_ns").alias("last_ts_ns"),
        )
        .withColumn("rate_hz", F.when(span > 0, F.col("n") / span).otherwise(F.lit(0.0)))
    )


def totals(log: DataFrame) -> DataFrame:
    """Messages, bytes and duration from the first to the last appended message, never below 0."""
    return log.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length("payload").cast("bigint")), F.lit(0)).alias("n_bytes"),
        F.greatest(F.max_by("ts_ns", "arrival") - F.min_by("ts_ns", "arrival"), F.lit(0)).alias("duration_ns"),
    )


def replay(log: DataFrame, channels: list[str]) -> dict[str, DataFrame]:
    """Recorded source channels as new sources, with fresh lineage; derived ones must be computed again."""
    return {
        c: log.filter(F.col("channel") == c).select("seq", "arrival", "ts_ns", "payload", L.rooted(c, "seq").alias("lineage")) for c in channels
    }
