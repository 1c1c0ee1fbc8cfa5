"""Latency calibration, service-level statistics and channel monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import lineage as L

#: Lower bounds of the latency buckets in µs; the first bucket starts at 0.
EDGES_US = (100, 1_000, 10_000, 100_000, 1_000_000, 10_000_000, 100_000_000)
#: Safety factor of a suggested cost, factor of drift, arrivals that a monitor keeps, degradation window.
SAFETY, DRIFT, ARRIVALS, WINDOW_MS = 1.3, 3, 128, 20


def stage_latencies(log: DataFrame) -> DataFrame:
    """``stage, latency_ns``: from the recorded input of each derived message, by its first lineage branch.

    Inputs that were not recorded, or recorded later than the output, give no latency.
    """
    out = log.select(
        F.col("channel").alias("stage"), F.col("ts_ns").alias("out_ns"), F.col("arrival").alias("out_at"), L.input_hop("lineage").alias("i"), F.size(L.hops("lineage")).alias("hops")
    ).filter("hops > 0")
    ins = log.select(F.col("channel").alias("in_channel"), F.col("seq").alias("in_seq"), F.col("ts_ns").alias("in_ns"), F.col("arrival").alias("in_at"))
    joined = out.join(ins, (F.col("i.channel") == F.col("in_channel")) & (F.col("i.seq") == F.col("in_seq")))
    return joined.filter("in_at < out_at and out_ns >= in_ns").select("stage", (F.col("out_ns") - F.col("in_ns")).alias("latency_ns"))


def exact_percentiles(rows: DataFrame, by: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """``sorted[min(n - 1, floor(f n))]`` of each group; equal values are counted before they are ordered."""
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(by))
    c = counts.select(by, value, "_n", upto.alias("_upto"), total.alias("_total"))

    def at(f: float) -> Column:
        place = F.least(F.col("_total") - 1, F.floor(F.lit(f) * F.col("_total")))
        return F.min(F.when(F.col("_upto") > place, F.col(value)))

    return c.groupBy(by).agg(F.max("_total").alias("n"), *[at(f).alias(k) for k, f in fractions.items()])


def calibrate(log: DataFrame) -> DataFrame:
    """Per stage: messages, p50, p99, p99.9 in µs and the suggested cost."""
    p = exact_percentiles(stage_latencies(log), "stage", "latency_ns", {"p50": 0.5, "p99": 0.99, "p999": 0.999})
    us = lambda c: F.col(c) / 1000.0
    return p.select("stage", "n", us("p50").alias("p50_us"), us("p99").alias("p99_us"), us("p999").alias("p999_us"), (us("p999") * SAFETY).alias("suggest_us"))


def drift(calibrated: DataFrame, declared: DataFrame) -> DataFrame:
    """``declared`` (stage, declared_us) against the suggestion: HIGH, LOW, OK, or UNKNOWN for a stage never seen."""
    j = declared.join(calibrated, "stage", "left")
    verdict = (
        F.when(F.col("suggest_us").isNull(), "UNKNOWN")
        .when(F.col("declared_us") > DRIFT * F.col("suggest_us"), "HIGH")
        .when(DRIFT * F.col("declared_us") < F.col("suggest_us"), "LOW")
        .otherwise("OK")
    )
    return j.select("stage", "declared_us", "suggest_us", verdict.alias("verdict"))


def bucket_floor(us: Column) -> Column:
    """The lower bound of a latency's bucket."""
    return F.coalesce(*[F.when(us >= e, F.lit(e)) for e in reversed(EDGES_US)], F.lit(0)).cast("bigint")


def histogram(rows: DataFrame, by: str, us: str) -> DataFrame:
    return rows.groupBy(by, bucket_floor(F.col(us)).alias("floor_us")).agg(F.count(F.lit(1)).alias("n"))


def misses(rows: DataFrame, by: str, us: str, deadline: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(us) > F.col(deadline)).alias("misses"))


def bucket_percentiles(hist: DataFrame, by: str, fractions: dict[str, float]) -> DataFrame:
    """The floor of the first bucket whose cumulative count reaches round(total * f), never an empty one."""
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("floor_us").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(by))
    h = hist.select(by, "floor_us", upto.alias("_upto"), total.alias("_total"))
    return h.groupBy(by).agg(*[F.min(F.when(F.col("_upto") >= F.round(F.col("_total") * f), F.col("floor_us"))).alias(k) for k, f in fractions.items()])


def degradations(rows: DataFrame, by: str, ts_ns: str, missed: Column, window_ms: int = WINDOW_MS) -> DataFrame:
    """Windows in which an endpoint missed at least once, with the number of misses."""
    w = (F.floor(F.col(ts_ns) / (window_ms * 1_000_000)) * (window_ms * 1_000_000)).cast("bigint").alias("window_ns")
    return rows.groupBy(by, w).agg(F.count_if(missed).alias("misses")).filter("misses >= 1")


def rate_hz(df: DataFrame, by: str, cell_ns: int = 1_000_000_000) -> DataFrame:
    """Add ``hz``, the arrivals of the trailing second, and ``shown_hz``, which a monitor's slots cap."""
    w = Window.partitionBy(by, "_cell").orderBy("ts_ns").rangeBetween(-cell_ns, 0)
    # each message also stands in the next cell, so that a cell holds the whole second behind its rows
    cell = F.floor(F.col("ts_ns") / cell_ns).cast("bigint")
    twice = df.withColumn("_own", cell).withColumn("_cell", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    counted = twice.withColumn("hz", F.count(F.lit(1)).over(w)).filter("_own = _cell").drop("_own", "_cell")
    return counted.withColumn("shown_hz", F.least(F.col("hz"), F.lit(ARRIVALS).cast("bigint")))


def monitor(log: DataFrame) -> DataFrame:
    """Newest number and size, and message count, of each channel."""
    newest = F.max_by(F.struct("seq", F.octet_length("payload").alias("size")), "arrival")
    return log.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), newest.alias("_l")).select(
        "channel", "n", F.col("_l.seq").alias("last_seq"), F.col("_l.size").cast("bigint").alias("last_size")
    )


def cursor(kept: DataFrame, moves: DataFrame) -> DataFrame:
    """Where cursor moves land among retained frames (``channel, seq``), clamped to them.

    ``moves`` are ``channel, at, by``: a frame and how many frames to step, negative to go back.
    """
    w = Window.partitionBy("channel")
    k = kept.select("channel", "seq", (F.row_number().over(w.orderBy("seq")) - 1).alias("place"), F.count(F.lit(1)).over(w).alias("size"))
    at = moves.join(k.withColumnRenamed("seq", "at"), ["channel", "at"])
    to = at.select("channel", "at", "by", F.greatest(F.lit(0), F.least(F.col("place") + F.col("by"), F.col("size") - 1)).alias("place"))
    return to.join(k.select("channel", "place", F.col("seq").alias("lands_on")), ["channel", "place"]).select("channel", "at", "by", "lands_on")
