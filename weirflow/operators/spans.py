"""Slices of sorted data, cut or reduced for the triggers of a time bucket.

Rows arrive sorted by bucket, data before triggers, then time. The data of a bucket is held
once; slices are ranges of it, which are found for all triggers of a batch together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Items of the slices that go into one batch; a longer slice is a batch of its own.
BATCH_ITEMS = 1 << 16


def least_and_most(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each range (none is empty), by two overlapping stretches of a power of two."""
    size = hi - lo
    level = np.frexp(size.astype(np.float64))[1] - 1
    least, most = np.empty(len(lo), values.dtype), np.empty(len(lo), values.dtype)
    low = high = values
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            step = 1 << (k - 1)
            low, high = np.minimum(low[:-step], low[step:]), np.maximum(high[:-step], high[step:])
        at = np.flatnonzero(level == k)
        a, b = lo[at], hi[at] - (1 << k)
        least[at], most[at] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
    return least, most


class Bucket:
    """The data rows of a bucket, by time."""

    def __init__(self, rows: pa.Table):
        self.time = rows["_lo"].to_numpy()
        self.seq = rows["_seq"].to_numpy()
        self.items = pa.concat_arrays(rows["_item"].chunks) if len(rows) else pa.array([], rows["_item"].type)
        self.ordered = bool((self.seq[1:] > self.seq[:-1]).all())
        self.sums: dict[str, tuple] = {}

    def ranges(self, asked: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Where each trigger's slice begins and ends; equal where it is empty."""
        low, high = asked.column("_lo"), asked.column("_hi")
        known = pc.and_(low.is_valid(), high.is_valid()).to_numpy(zero_copy_only=False)
        a = np.searchsorted(self.time, low.fill_null(0).to_numpy(), "left")
        b = np.searchsorted(self.time, high.fill_null(0).to_numpy(), "right")
        return a, np.where(known, np.maximum(a, b), a)

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Least and greatest number in each slice, null where it is empty."""
        some = np.flatnonzero(b > a)
        lo, hi = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        lo[some], hi[some] = (self.seq[a[some]], self.seq[b[some] - 1]) if self.ordered else least_and_most(self.seq, a[some], b[some])
        return pa.array(lo, mask=b == a), pa.array(hi, mask=b == a)

    def fold(self, how: str, column: str, kind: pa.DataType, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """Sum, minimum or maximum of the values that are not null, null where there are none."""
        if column not in self.sums:
            values = pc.struct_field(self.items, column)
            place = np.concatenate([[0], np.cumsum(values.is_valid().to_numpy(zero_copy_only=False))])
            self.sums[column] = (values.drop_null(), place)
        values, place = self.sums[column]
        a, b = place[a], place[b]
        some = np.flatnonzero(b > a)
        if how == "sum" and pa.types.is_integer(values.type):
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values.to_numpy().astype(np.int64))])
            return pa.array(total[b] - total[a], kind, mask=a == b)
        if how != "sum" and pa.types.is_integer(values.type):
            out = np.zeros(len(a), values.to_numpy().dtype)
            out[some] = least_and_most(values.to_numpy(), a[some], b[some])[how == "max"]
            return pa.array(out, kind, mask=a == b)
        # differences of sums would not be exact
        reduce = getattr(pc, how)
        return pa.array([reduce(values.slice(i, j - i)).as_py() if j > i else None for i, j in zip(a.tolist(), b.tolist(), strict=True)], kind)

    def cut(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The slices as lists, by number."""
        size = b - a
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(offsets[-1]) + np.repeat(a - offsets[:-1], size)
        if not self.ordered:
            at = at[np.lexsort((self.seq[at], np.repeat(np.arange(len(a)), size)))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.items.take(pa.array(at)))


def cutter(schema: pa.Schema, folds: dict[str, tuple[str, str]] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does: one row a trigger, with its slice or with the slice's size and ``folds``, and the ends of the slice."""

    def answer(bucket: Bucket, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = bucket.ranges(asked)
        begin, upto = 0, np.cumsum(b - a)
        while begin < len(a):
            stop = len(a)
            if folds is None:
                done = upto[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(upto, done + BATCH_ITEMS, "right")))
            x, y = a[begin:stop], b[begin:stop]
            if folds is None:
                made = [bucket.cut(x, y)]
            else:
                made = [pa.array(y - x), *[bucket.fold(f, c, schema.field(k).type, x, y) for k, (f, c) in folds.items()]]
            own = asked.column("_own").slice(begin, stop - begin)
            yield pa.RecordBatch.from_arrays([own, *made, *bucket.ends(x, y)], schema.names)
            begin = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held, bucket = None, [], None
        for batch in batches:
            homes, asks = batch.column("_home").to_numpy(), batch.column("_asks").to_numpy(zero_copy_only=False)
            breaks = np.flatnonzero((homes[1:] != homes[:-1]) | (asks[1:] != asks[:-1])) + 1
            for i, j in zip([0, *breaks.tolist()], [*breaks.tolist(), len(homes)], strict=True):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if homes[i] != home:
                    home, held, bucket = homes[i], [], None
                if not asks[i]:
                    held.append(part.select(["_lo", "_seq", "_item"]))
                    continue
                if bucket is None:
                    bucket = Bucket(pa.Table.from_batches(held, part.select(["_lo", "_seq", "_item"]).schema))
                    held = []
                yield from answer(bucket, part)

    return run
