"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.shared import fresh_path, shared_dir, written

__all__ = ["fresh_path", "let", "shared_dir", "slices", "table", "unused", "written"]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once a row and hand it to ``body`` as a bound variable.

    Inside lambdas Catalyst may inline a column's expression and evaluate it again
    for each element; binding it keeps array expressions linear.
    """
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 4 << 20, at: int = 1) -> Iterator[pa.RecordBatch]:
    """Smaller batches, without a copy: at most ``rows`` rows and, unless a text alone is longer, ``size`` bytes of text in column ``at``.

    What a worker holds as Python objects is so bounded by bytes, whatever the lengths of the texts.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < b.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            stop = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(begin, stop - begin)
            begin = stop


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column is called that."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
