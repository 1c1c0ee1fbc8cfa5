"""Best-fit packing by the sum-of-squares rule.

Each document becomes pieces of at most ``capacity`` tokens (its first piece takes what
is over a multiple of it), so at most one piece a document is short. Full pieces are
sequences of their own. Short ones are packed in groups of about ``GROUP`` pieces,
dealt by a hash so that no key can grow a group: among the open sequences and a new
one, a piece goes where the sum of the squared numbers of open sequences with equal
gaps becomes smallest, ties to the tightest fit. State is one counter and one stack
a gap. Only piece lengths move in the shuffle, never texts or ids.

``pack_in_order`` packs groups that are ranges of the rows' order instead, and names each
sequence by its earliest piece, so sequences in order of their ids follow the rows' order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.shipping import ship

from .common import slices, unused, written
from .encode import loaded

#: Short pieces of a group, about.
GROUP = 40_000


def pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str, text_col: str, place_col: str | None = None
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids with ``end_id`` behind, and its ``place`` if given."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = loaded(tokenizer_path)
        for b in slices(batches):
            row, no, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(enc.encode([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()])):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    row.append(i)
                    no.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at += size
                    k += 1
            at_row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at_row), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                + [c.take(at_row) for c in b.columns[2:]],
                ["doc_id", "piece", "start", "length", "ids_crc32", *b.schema.names[2:]],
            )

    ship(docs.sparkSession)
    d = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text", *([f"`{place_col}` as place"] if place_col else []))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", place long" if place_col else ""))


def piece_bits(capacity: int) -> int:
    """Bits for the number of a piece in its document: no text has 2**31 bytes, and a token has one at least."""
    return (2**31 // capacity + 1).bit_length()


class SumOfSquares:
    """Open sequences by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.sequences = 0

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset of a piece of ``size`` tokens, from 1 to the capacity."""
        c, n = self.capacity, self.open
        g, least = c, 1 << 60
        if size < c:
            # change of the sum when a sequence of gap g = size..c-1 gets gap g - size
            change = 2 * (n[: c - size] - n[size:c]) + 2
            change[0] = 1 - 2 * n[size]  # a full sequence is no longer open
            change = np.where(n[size:c] > 0, change, 1 << 60)
            k = int(np.argmin(change))
            g, least = size + k, int(change[k])
        if size >= c or least > 2 * n[c - size] + 1:  # a new sequence adds this
            seq, gap = self.sequences, c
            self.sequences += 1
        else:
            seq, gap = self.stacks[g].pop(), g
            n[g] -= 1
        left = gap - size
        if left:
            n[left] += 1
            self.stacks[left].append(seq)
        return seq, c - gap


def pack_short(short: DataFrame, capacity: int, groups: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, part = SumOfSquares(capacity), TaskContext.get().partitionId()
        for b in batches:
            placed = [state.place(s) for s in b.column(b.schema.get_field_index("length")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part << 40 | s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                [*b.schema.names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in short.schema.fields)
    dealt = short.repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32"))
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32").mapInArrow(
        run, f"{fields}, sequence_id long, offset long"
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece that holds the end id alone. Repeated rows are
    documents of their own, whose pieces are packed apart. A text of any length is cut into
    as many pieces as it needs. Other columns are ignored; an empty table gives an empty result.
    """
    p = written(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    short = p.filter(F.col("length") < capacity)
    groups = max(1, round(short.count() / GROUP))
    full = p.filter(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return pack_short(short, capacity, groups).unionByName(full)


def in_file_order(docs: DataFrame, out: str, columns: list[str]) -> DataFrame:
    """``columns``, and as ``out`` the 0-based number of each row in the order of the files and of the rows inside them.

    Files are in order of the number that their writer gave them. What is not a plain
    scan of Parquet files is written first, which keeps the order of its partitions.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs, "ordered")
    at = docs.metadataColumn("_metadata")
    d = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], at["file_name"].alias("_file"), at["row_index"].alias("_row"))
    number = F.expr(r"try_cast(regexp_extract(_file, '^part-([0-9]+)', 1) as bigint)")
    before = Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)
    files = d.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))  # a row a file
    files = files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    return d.join(F.broadcast(files), "_file").select(*own, (F.col("_before") + F.col("_row")).alias(out))


def pack_ranges(short: DataFrame, capacity: int, groups: int) -> DataFrame:
    """``sequence_id, offset`` of short pieces, packed apart for each ``group``; a sequence has the id of its least place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held, current, bits = SumOfSquares(capacity), [], None, piece_bits(capacity)

        def close() -> Iterator[pa.RecordBatch]:
            places = [b.column(b.schema.get_field_index("place")).to_numpy() for b, _ in held]
            first = np.full(state.sequences, 1 << 62, np.int64)
            for place, (_, placed) in zip(places, held, strict=True):
                np.minimum.at(first, placed[:, 0], place)
            for b, placed in held:
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(first[placed[:, 0]] << bits), pa.array(placed[:, 1])], [*b.schema.names, "sequence_id", "offset"]
                )

        for b in batches:
            group = b.column(b.schema.get_field_index("group")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                if group[begin] != current:
                    yield from close()
                    state, held, current = SumOfSquares(capacity), [], group[begin]
                part = b.slice(begin, end - begin)
                sizes = part.column(part.schema.get_field_index("length")).to_pylist()
                held.append((part, np.array([state.place(s) for s in sizes], np.int64)))
        yield from close()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in short.schema.fields)
    dealt = short.repartition(groups, "group").sortWithinPartitions("group", F.desc("length"), "place")
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_in_order(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    capacity: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """As ``pack``, but following the order of the rows of ``docs`` (see ``in_file_order``).

    The rows are cut into ranges of about ``GROUP`` documents, each packed apart. A
    sequence's id is the place of its earliest piece, ``row << piece_bits(capacity) | piece``; so
    ids are unique, and ascend with the rows' order within ranges and across them.
    """
    at = unused("place", [id_col, text_col])
    p = written(pieces(in_file_order(docs, at, [id_col, text_col]), tokenizer_path, end_id, capacity, id_col, text_col, at), "pieces")
    rows = (p.agg(F.max("place")).first()[0] or 0) + 1
    groups = max(1, round(rows / GROUP))
    short = p.filter(F.col("length") < capacity).withColumn("group", F.expr(f"place div {-(-rows // groups)}"))
    full = p.filter(F.col("length") == capacity).select(
        "*", F.expr(f"shiftleft(place, {piece_bits(capacity)}) | piece").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    # a document has one short piece at most, its piece 0
    return pack_ranges(short, capacity, groups).drop("group").unionByName(full).drop("place")
