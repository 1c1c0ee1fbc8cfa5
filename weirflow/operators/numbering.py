"""Sequence numbers and running folds over a total order, without a single-task sort.

Rows are dealt to ranges of the whole order key, whose bounds Spark takes from a sample of
the rows, so neither a far value nor many equal times fill one range. They are written
once, sorted and numbered inside their range; what follows reads that table instead of
computing the rows again. Each range is then shifted by the rows (and folds) of the ranges
before it. Only the small table of range totals is ordered as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.shared import written


def ranged(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``df`` as a written table, sorted by ``by`` and ``order`` inside ranges of these, with ``_bucket`` (of the range) and ``_at`` (in it).

    Without ``ranges`` there are as many as Spark's shuffle settings ask for.
    """
    at = F.monotonically_increasing_id()
    t = df.repartitionByRange(*[ranges] * (ranges is not None), *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", at)
    return written(t.select(*df.columns, F.shiftright("_at", 33).alias("_bucket"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ordered")


def number(df: DataFrame, order: Sequence[str], out: str = "seq", by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Add ``out``, the 0-based place in ``order`` among the rows with equal ``by``; nulls come first."""
    if by:
        return running(df, order, {}, out, by, ranges)
    t = ranged(df, order, ranges=ranges)
    totals = t.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # a row a range: no more than there are shuffle partitions
    return t.join(F.broadcast(shifts), F.col("_bucket") == F.col("_of")).select(*df.columns, (F.col("_at") + F.col("_before")).alias(out))


def running(
    df: DataFrame,
    order: Sequence[str],
    folds: dict[str, tuple[str, str]],
    seq: str = "seq",
    by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Add ``seq`` and running ``folds`` (output: function sum, min or max, and column), each row included."""
    t = ranged(df, order, by, ranges)
    w = Window.partitionBy(*by, "_bucket").orderBy("_at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = t.withColumns({seq: (F.row_number().over(w) - 1).cast("bigint")} | {k: getattr(F, f)(c).over(upto) for k, (f, c) in folds.items()})
    totals = t.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"), *[getattr(F, f)(c).alias(f"_total_{k}") for k, (f, c) in folds.items()])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_by_{k}") for k in by],
        F.col("_bucket").alias("_of"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        *[getattr(F, f)(f"_total_{k}").over(before).alias(f"_carried_{k}") for k, (f, _) in folds.items()],
    )
    same = F.col("_bucket") == F.col("_of")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    joined = local.join(carried, same)
    add = {"sum": lambda x, y: F.coalesce(x + y, x, y), "min": F.least, "max": F.greatest}

    def fold(k: str, f: str) -> Column:
        return add[f](F.col(k), F.col(f"_carried_{k}"))

    return joined.withColumns({seq: F.col(seq) + F.col("_before")} | {k: fold(k, f) for k, (f, _) in folds.items()}).select(
        *df.columns, seq, *folds
    )
