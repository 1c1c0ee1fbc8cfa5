"""The positional zip of two sides whose queues hold a number of messages and then drop the oldest.

How far one side is ahead of the other is a walk by +1 and -1 that is clipped at the depth,
and all pairs follow from it: an arrival that finds the other side waiting is paired with the
oldest that waits. Steps x -> min(max(x + a, lo), hi) are closed under composition, so a range
of arrivals is one such step, whatever its length. Ranges are therefore walked apart, each
from the state in which the ranges before it leave its first instance; only one row a range is
put in order as a whole, and an instance of any length is spread over all its ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.shared import written
from weirflow.shipping import ship

from .numbering import ranged


def composed(step: np.ndarray, instance: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a, lo, hi`` of all steps of a row's instance up to the row, by doubling; an instance's rows are adjacent."""
    a, lo, hi = step.astype(np.int64), np.full(len(step), -depth, np.int64), np.full(len(step), depth, np.int64)
    k = 1
    while k < len(step):
        same = np.flatnonzero(instance[k:] == instance[:-k]) + k
        if not len(same):
            break
        before, own = same - k, (a[same], lo[same], hi[same])
        shifted = a[before] + own[0]
        low, high = (np.clip(x[before] + own[0], own[1], own[2]) for x in (lo, hi))
        a[same], lo[same], hi[same] = shifted, low, high
        k *= 2
    return a, lo, hi


def _columns(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows of a range in order, the number of each row's instance, and its step."""
    t = t.sort_by("_at")
    codes = pc.dictionary_encode(t.column("_key").combine_chunks()).indices.to_numpy(zero_copy_only=False)
    instance = np.cumsum(np.r_[False, codes[1:] != codes[:-1]])
    return t, instance, 1 - 2 * t.column("_side").to_numpy().astype(np.int64)


def _carried(summary: DataFrame, values: int, advance) -> DataFrame:
    """``_of`` and ``values`` numbers: what the ranges before a range leave for its first instance.

    ``summary`` has a row a range: ``_bucket, head, tail`` (keys of its first and last instance) and more;
    ``advance(row, given)`` is what the last instance leaves after the range.
    """
    names = [f"_c{k}" for k in range(values)]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        key, state, out = None, (0,) * values, []
        for row in pdf.sort_values("_bucket").itertuples(index=False):
            given = state if row.head == key else (0,) * values
            out.append((row[0], *given))
            key, state = row.tail, advance(row, given if row.head == row.tail else (0,) * values)
        return pd.DataFrame(out, columns=["_of", *names])

    # a row a range, and ranges are no more than shuffle partitions
    return summary.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(scan, "_of long, " + ", ".join(f"{n} long" for n in names))


def zip_with_queues(rows: DataFrame, keys: Sequence[str], side: str, order: Sequence[str], depth: int, ranges: int | None = None) -> DataFrame:
    """Pairs of each instance (``keys``; none for one instance) when queues hold ``depth`` and drop their oldest message.

    ``side`` is 0 or 1. Returns ``keys, pair, a, b``: the numbers of the paired messages within their side.
    """
    ship(rows.sparkSession)
    keys = list(keys)
    d = rows.select(*dict.fromkeys([*keys, *order]), F.col(side).cast("int").alias("_side"), F.to_json(F.struct(*[F.col(k) for k in keys], F.lit(0).alias("_"))).alias("_key"))
    t = ranged(d, list(order), keys, ranges).select(*keys, "_side", "_key", "_bucket", "_at")

    def summarise(t: pa.Table) -> pa.Table:
        bucket = t.column("_bucket")[0].as_py()
        t, instance, step = _columns(t)
        last = np.flatnonzero(instance == instance[-1])
        a, lo, hi = (x[-1] for x in composed(step[last], instance[last], depth))
        ups = int((step[last] > 0).sum())
        values = [bucket, t.column("_key")[0].as_py(), t.column("_key")[-1].as_py(), int(a), int(lo), int(hi), ups, len(last) - ups]
        return pa.Table.from_pylist([dict(zip(("_bucket", "head", "tail", "a", "lo", "hi", "n0", "n1"), values, strict=True))])

    def after(row, given: tuple) -> tuple:
        return min(max(given[0] + row.a, row.lo), row.hi), given[1] + row.n0, given[2] + row.n1

    summary = t.groupBy("_bucket").applyInArrow(summarise, "_bucket long, head string, tail string, a long, lo long, hi long, n0 long, n1 long")
    starts = _carried(summary, 3, after)
    given = t.join(F.broadcast(starts), F.col("_bucket") == F.col("_of")).drop("_of")

    def walk(t: pa.Table) -> pa.Table:
        t, instance, step = _columns(t)
        first = np.r_[True, instance[1:] != instance[:-1]]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(step)), 0))
        head = instance == 0
        state, n0, n1 = (np.where(head, t.column(f"_c{k}")[0].as_py(), 0) for k in range(3))
        a, lo, hi = composed(step, instance, depth)
        then = np.clip(state + a, lo, hi)
        ahead = np.where(first, state, np.r_[0, then[:-1]])  # of side 0, before the row
        ups, downs = np.cumsum(step > 0), np.cumsum(step < 0)
        own0 = n0 + ups - (step > 0) - (ups - (step > 0))[begin]  # messages of a side before the row
        own1 = n1 + downs - (step < 0) - (downs - (step < 0))[begin]
        hit = np.flatnonzero(((step > 0) & (ahead < 0)) | ((step < 0) & (ahead > 0)))
        left = np.where(step > 0, own0, own0 - ahead)[hit]
        right = np.where(step > 0, own1 + ahead, own1)[hit]
        new = np.r_[True, instance[hit][1:] != instance[hit][:-1]][: len(hit)]
        place = np.arange(len(hit)) - np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
        out = t.select([*keys, "_key", "_bucket"]).take(pa.array(hit))
        for name, column in (("_pair", place), ("a", left), ("b", right)):
            out = out.append_column(name, pa.array(column.astype(np.int64)))
        return out

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    found = written(given.groupBy("_bucket").applyInArrow(walk, f"{kinds}_key string, _bucket long, _pair long, a long, b long"), "pairs")
    ends = found.groupBy("_bucket", "_key").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("at"))
    ends = summary.select("_bucket", "head", "tail").join(ends.withColumnRenamed("_bucket", "_b"), (F.col("_b") == F.col("_bucket")) & (F.col("_key") == F.col("tail")), "left")
    offsets = _carried(ends.select("_bucket", "head", "tail", F.coalesce("n", F.lit(0)).alias("n")), 1, lambda row, given: (given[0] + row.n,))
    offsets = offsets.join(summary.select("_bucket", "head"), F.col("_of") == F.col("_bucket")).drop("_bucket")
    shifted = found.join(F.broadcast(offsets), (F.col("_bucket") == F.col("_of")) & (F.col("_key") == F.col("head")), "left")
    return shifted.select(*keys, (F.col("_pair") + F.coalesce("_c0", F.lit(0))).alias("pair"), "a", "b")
