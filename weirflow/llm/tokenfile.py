"""Token-id files: documents in ascending id order as independently coded blocks.

A dataset is a folder of part files, each a run of blocks in order. A block holds a
table of the documents that end in it (id, length in ids) and the range-coded ids;
both have checksums, so a block is read, checked and decoded alone, and a document may
cross blocks of its part. Parts are ranges of the document id. Files are written by
Spark's committed writer, so the loss of an executor leaves no half-written part, and
any store that Spark reaches serves.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.shipping import ship

from .common import slices
from .encode import loaded
from .rangecoder import decode_blocks, encode_blocks

#: Ids of a block at most and at least, ids held before blocks are coded together, blocks aimed at.
BLOCK_IDS, LEAST_IDS, HELD_IDS, LANES = 16384, 256, 6 << 20, 2048
#: Text encoded at once at most, unless one alone is longer: in more text fewer chunks are distinct.
BATCH_BYTES = 8 << 20
TABLE = struct.Struct("<III")
#: Rows of a document table that are written without compression.
PLAIN_ROWS = 8
BLOCKS = "part int, block int, n_ids long, data binary"


def pack_table(ids: list[int | None], sizes: list[int]) -> bytes:
    body = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array(sizes, "<i8").tobytes()
    body += bytes(i is None for i in ids)
    # a short table would not get shorter; one as long as its columns is plain
    if len(ids) > PLAIN_ROWS and len(packed := zlib.compress(body, 1)) < len(body):
        body = packed
    return TABLE.pack(len(ids), len(body), zlib.crc32(body)) + body


def unpack_table(data: bytes) -> tuple[list[int | None], list[int], bytes]:
    n, size, crc = TABLE.unpack_from(data)
    body = data[TABLE.size : TABLE.size + size]
    if zlib.crc32(body) != crc:
        raise ValueError("a document table is damaged")
    raw = body if size == 17 * n else zlib.decompress(body)
    null = raw[16 * n :]
    ids = [None if z else i for i, z in zip(np.frombuffer(raw[: 8 * n], "<i8").tolist(), null, strict=True)]
    return ids, np.frombuffer(raw[8 * n : 16 * n], "<i8").tolist(), data[TABLE.size + size :]


class Writer:
    """Collects documents of a part and cuts their ids into blocks."""

    def __init__(self) -> None:
        self.docs: list[tuple[int | None, int]] = []
        self.chunks: list[bytes] = []
        self.held = 0
        self.block = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.chunks.append(ids)
        self.held += len(ids) // 4

    def flush(self) -> list[tuple[int, int, bytes]]:
        """Block number, ids and bytes of all that is held; blocks are coded together."""
        if not self.docs:
            return []
        ids = np.frombuffer(b"".join(self.chunks), "<u4")
        size = int(np.clip(-(-len(ids) // LANES), LEAST_IDS, BLOCK_IDS))
        cut = [ids[i : i + size] for i in range(0, len(ids), size)] or [ids]
        ends = np.cumsum([n for _, n in self.docs])
        # a document belongs to the block that holds its last id; one without ids to the block it would start in
        home = np.clip((ends - 1) // size, 0, len(cut) - 1)
        bounds = np.searchsorted(home, np.arange(len(cut) + 1))
        out = []
        for k, coded in enumerate(encode_blocks(cut)):
            some = self.docs[bounds[k] : bounds[k + 1]]
            out.append((self.block, len(cut[k]), pack_table([d for d, _ in some], [n for _, n in some]) + coded))
            self.block += 1
        self.docs, self.chunks, self.held = [], [], 0
        return out


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write ``docs`` as a token dataset at ``path``.

    Ids (integers; null first) ascend over the parts and inside them; rows with equal
    ids are ordered by text. A null or empty text is its end id alone; a very long one
    runs over as many blocks as it needs. An empty table gives a dataset without blocks.
    Other columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, w, part = loaded(tokenizer_path), Writer(), TaskContext.get().partitionId()

        def rows() -> pa.RecordBatch:
            out = w.flush()
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(out), pa.int32()), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())],
                ["part", "block", "n_ids", "data"],
            )

        for b in slices(batches, 4096, BATCH_BYTES):
            ids = b.column(0).to_pylist()
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            for doc_id, own in zip(ids, enc.encode(texts), strict=True):
                w.add(doc_id, own + end)
            if w.held >= HELD_IDS:
                yield rows()
        yield rows()

    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, BLOCKS).write.option(
        "compression", "none"
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (or ``ids``, with ``digest`` false) of a dataset.

    ``start`` counts the ids of all documents before, over all parts. A damaged block
    raises ``ValueError``; a dataset without blocks gives an empty result.
    """
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, rest = None, 0, []
        for b in batches:
            parts, data = b.column(0).to_pylist(), b.column(3)
            begin = 0
            while begin < len(parts):
                stop, held = begin, 0
                while stop < len(parts) and held < HELD_IDS:
                    held += b.column(2)[stop].as_py()
                    stop += 1
                tables = [unpack_table(data[i].as_py()) for i in range(begin, stop)]
                out: tuple[list, ...] = ([], [], [], [], [])
                for i, ids in enumerate(decode_blocks([t[2] for t in tables]), begin):
                    if parts[i] != part:
                        part, start, rest = parts[i], 0, []
                    rest.append(ids)
                    if tables[i - begin][0]:
                        joined = np.concatenate(rest) if len(rest) > 1 else ids
                        at = 0
                        for doc, n in zip(*tables[i - begin][:2], strict=True):
                            own = joined[at : at + n]
                            for column, value in zip(out, (part, doc, start, n, zlib.crc32(own.astype("<u4").tobytes()) if digest else own.tolist()), strict=True):
                                column.append(value)
                            at += n
                            start += n
                        rest = [joined[at:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:4]), pa.array(out[4], pa.int64() if digest else pa.list_(pa.int64()))],
                    ["part", "doc_id", "start", "n_tokens", "last"],
                )
                begin = stop

    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row a part, whose number is fixed when the dataset is written
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    last = "long" if digest else "array<long>"
    # a part is a task: its number is that of the partition
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    docs = (
        blocks.repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "block")
        .mapInArrow(run, f"part int, doc_id long, start long, n_tokens long, last {last}")
    )
    return docs.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", F.col("last").alias("ids_crc32" if digest else "ids")
    )
