"""Structured Streaming forms of the stateful operators.

Streams are files read as they appear; within a micro-batch rows are put in arrival
order before they touch state, and state is trimmed by our own bounds, never by event
time. Results go to a Parquet sink in the shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weirflow.operators.dataflow import HISTORY
from weirflow.operators.timing import WINDOW_MS
from weirflow.shared import fresh_path
from weirflow.shipping import ship


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; the table is a folder of Parquet files, or one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(path.rpartition("/")[0])


def ticks(spark: SparkSession, per_second: int) -> DataFrame:
    """An unbounded periodic source: ``seq, at``."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(F.col("value").alias("seq"), F.col("timestamp").alias("at"))


def drain(stream: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, exactly once into Parquet, and return the rows written.

    A stream that is drained again into the same folder ``at`` goes on where it stopped, with the state it
    had: its checkpoint is kept beside the rows.
    """
    spark = stream.sparkSession
    at = at or fresh_path(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", at + "-checkpoint").trigger(availableNow=True).start(at)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)


def run_for(stream: DataFrame, seconds: float, name: str) -> DataFrame:
    """Run a stream for a time, stop it after the batch that is under way, and return the rows written."""
    spark = stream.sparkSession
    at = fresh_path(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", at + "-checkpoint").start(at)
    try:
        query.awaitTermination(seconds)
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(at)


def zip_stream(stream: DataFrame, keys: Sequence[str], side: str, order: Sequence[str], depth: int | None = None) -> DataFrame:
    """The zip join of each flow instance: ``keys, pair, a, b`` as in the batch form; ``depth`` None never drops."""
    ship(stream.sparkSession)
    keys, order = list(keys), list(order)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        queues, counts, pair = json.loads(state.get[0]) if state.exists else ([[], []], [0, 0], 0)
        rows = []
        for s in pd.concat(list(batches)).sort_values(order)[side]:
            queues[s].append(counts[s])
            counts[s] += 1
            if depth is not None and len(queues[s]) > depth:
                queues[s].pop(0)
            if queues[0] and queues[1]:
                rows.append((*key, pair, queues[0].pop(0), queues[1].pop(0)))
                pair += 1
        state.update((json.dumps((queues, counts, pair)),))
        if rows:
            yield pd.DataFrame(rows, columns=[*keys, "pair", "a", "b"])

    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    return (
        stream.select(*dict.fromkeys([*keys, side, *order]))
        .groupBy(*keys)
        .applyInPandasWithState(step, f"{kinds}, pair long, a long, b long", "queues string", "append", GroupStateTimeout.NoTimeout)
    )


def fold_stream(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], zero: Callable[[], object], step: Callable, schema: str
) -> DataFrame:
    """``fold_by_key`` over a stream; the state is kept as JSON."""
    ship(stream.sparkSession)
    keys, order = list(keys), list(order)
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else zero()
        out = []
        for row in pd.concat(list(batches)).sort_values(order).itertuples(index=False):
            held, made = step(held, row)
            out += [key + m for m in made]
        state.update((json.dumps(held),))
        if out:
            yield pd.DataFrame(out, columns=names)

    return stream.groupBy(*keys).applyInPandasWithState(fold, schema, "held string", "append", GroupStateTimeout.NoTimeout)


def span_stream(trigger: DataFrame, data: DataFrame, before_s: int, lateness: str | None = None) -> DataFrame:
    """``trigger_id, data_id``: data messages up to ``before_s`` seconds before each trigger, as a stream-stream join.

    Both have ``id`` and ``at`` (timestamp). Without ``lateness`` no row is ever dropped, the state keeps all,
    and triggers without data give no row. With ``lateness`` watermarks bound the state, rows later than that
    are lost, and a trigger whose span has stayed empty gives a row with null ``data_id`` once the watermark
    has passed it. ``span_history`` emits every trigger at once.
    """
    cell = lambda c: F.floor(F.unix_seconds(c) / before_s)
    t = trigger.select(F.col("id").alias("trigger_id"), F.col("at").alias("t_at")).withColumn("t_cell", cell("t_at"))
    # a span touches two cells of its own length; a data row is in both that it can serve, so a trigger is one row and can stay alone
    d = data.select(F.col("id").alias("data_id"), F.col("at").alias("d_at")).withColumn("d_cell", F.explode(F.array(cell("d_at"), cell("d_at") + 1)))
    if lateness:
        t, d = t.withWatermark("t_at", lateness), d.withWatermark("d_at", lateness)
    near = F.expr(f"t_cell = d_cell and d_at between t_at - interval {before_s} seconds and t_at")
    return t.join(d, near, "left_outer" if lateness else "inner").select("trigger_id", "data_id")


def span_history(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], trigger: str, time: str, lo: int, hi: int, schema: str, depth: int = HISTORY
) -> DataFrame:
    """Each trigger with the slice of the last ``depth`` data messages before it whose ``time`` lies from ``lo`` to ``hi`` around its own.

    ``trigger`` is a boolean column. ``schema`` names the keys, then ``id, n, data_lo, data_hi``: the trigger's
    ``id``, the size of its slice, which may be empty, and the ids of its ends.
    """

    def step(state: list, row) -> tuple[list, list]:
        at = int(getattr(row, time))
        if not getattr(row, trigger):
            return [*state, [int(row.id), at]][-depth:], []
        found = [i for i, t in state if at + lo <= t <= at + hi]
        return state, [(int(row.id), len(found), found[0] if found else None, found[-1] if found else None)]

    return fold_stream(stream, keys, order, list, step, schema)


def degradation_stream(stream: DataFrame, by: str, at: str, missed, lateness: str, window_ms: int = WINDOW_MS) -> DataFrame:
    """Windows with a miss; a window is written once the watermark has passed it, and rows later than ``lateness`` are not counted."""
    w = F.window(at, f"{window_ms} milliseconds")
    return stream.withWatermark(at, lateness).groupBy(w.alias("w"), by).agg(F.count_if(missed).alias("misses")).filter("misses >= 1").select(
        by, (F.unix_micros("w.start") * 1000).alias("window_ns"), "misses"
    )


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], name: str) -> None:
    """A sink that calls ``fn`` with every micro-batch."""
    stream.writeStream.foreachBatch(fn).option("checkpointLocation", fresh_path(stream.sparkSession, name)).trigger(availableNow=True).start().awaitTermination()
