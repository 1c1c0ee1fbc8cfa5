"""Binary record files and fixed-layout payloads.

Files are read through Spark's binary source, so any store serves, chunk by chunk, and
every checksum is verified: a damaged file raises ``ValueError``. Each is written under a
temporary name and renamed when complete, so a retried task replaces its own files. A
partition is cut into files of bounded size; names ascend with ``arrival``, and the index
tells channels, numbers and times of each chunk.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions import lineage as L
from weirflow.shipping import ship

# Fixed values of the file formats: magic numbers, sizes, record types, compressions, type tags.
MAGIC_V0 = 0x5452454330303031
MAGIC_V2 = 0x54535245430002
MAGIC_FOOTER = 0x5453524543546000
MAGIC_SCHEMA = 0x545348434D303201
HEADER_SIZE, FOOTER_SIZE = 128, 64
CHUNK_MESSAGES, CHUNK_BYTES = 500, 1 << 20
#: Messages and payload bytes after which a partition goes on in a new file.
FILE_MESSAGES, FILE_BYTES = 200_000, 64 << 20
#: Bits of ``arrival`` for the place in a file, and of these for the place in a chunk.
FILE_BITS, CHUNK_BITS = 40, 20
DICT, CHUNK, INDEX, STATS = 1, 2, 3, 6
CODECS = {0: None, 1: "lz4_raw", 2: "zstd"}
POD_TYPES = {"double": ("<f8", 0), "float": ("<f4", 1), "int32": ("<i4", 2), "int64": ("<i8", 3), "uint32": ("<u4", 4), "uint64": ("<u8", 5), "bool": ("?", 6)}
SPARK_TYPES = {"double": "double", "float": "float", "int32": "int", "int64": "long", "uint32": "long", "uint64": "decimal(20,0)", "bool": "boolean"}
MAX_FIELDS = 4096
#: Elements of an array field that a rendering shows.
SHOWN = 16

ROW = f"channel string, seq long, ts_ns long, arrival long, payload binary, lineage {L.LINEAGE}"
_hop = pa.struct([("channel", pa.string()), ("seq", pa.int64()), ("seq_end", pa.int64())])
_lineage = pa.list_(pa.struct([("root", _hop), ("hops", pa.list_(_hop))]))
_head = struct.Struct("<BIIBIQQ")
_hops = struct.Struct("<HQQ")


class Cut(ValueError):
    """A file ends too early or does not say what it should."""


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str) -> tuple:
        s = struct.Struct("<" + form)
        if self.at + s.size > len(self.data):
            raise Cut("the data is cut short")
        self.at += s.size
        return s.unpack_from(self.data, self.at - s.size)

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Cut("the data is cut short")
        self.at += n
        return self.data[self.at - n : self.at]


def _pad(n: int) -> bytes:
    return b"\0" * (-n % 8)


def _lineage_bytes(branches, ids: dict[str, int]) -> bytes:
    hop = lambda h: _hops.pack(ids[h["channel"]], h["seq"], h["seq_end"])
    out = [struct.pack("<H", len(branches))]
    for b in branches:
        out += [hop(b["root"]), struct.pack("<H", len(b["hops"])), *map(hop, b["hops"])]
    return b"".join(out)


def _lineage_of(data: bytes, names: dict[int, str]) -> list[dict]:
    r = Reader(data)

    def hop() -> dict:
        channel, seq, end = r.take("HQQ")
        return {"channel": names.get(channel, ""), "seq": seq, "seq_end": max(seq, end)}

    out = []
    for _ in range(r.take("H")[0]):
        root = hop()
        out.append({"root": root, "hops": [hop() for _ in range(r.take("H")[0])]})
    return out


def encode_file(rows: Sequence[dict], compression: int = 2) -> bytes:
    """A version 2 file of messages in append order."""
    names: dict[str, int] = {}
    for r in rows:
        for c in [r["channel"], *(h["channel"] for b in r["lineage"] or [] for h in [b["root"], *b["hops"]])]:
            names.setdefault(c, len(names) + 1)
    body = [b"\0" * HEADER_SIZE]
    index, size = [], HEADER_SIZE
    held: list[dict] = []

    def put(x: bytes) -> None:
        nonlocal size
        body.append(x)
        size += len(x)

    def flush() -> None:
        if not held:
            return
        held.sort(key=lambda r: r["ts_ns"])
        chunk = bytearray()
        for r in held:
            blob = _lineage_bytes(r["lineage"], names) if r["lineage"] else b""
            data = r["payload"] or b""
            chunk += struct.pack("<HQQI", names[r["channel"]], r["seq"], r["ts_ns"], len(data)) + data
            chunk += _pad(len(chunk))
            chunk += struct.pack("<I", len(blob)) + blob
            if blob:
                chunk += _pad(len(chunk))
        codec = CODECS[compression]
        packed = pa.compress(bytes(chunk), codec=codec, asbytes=True) if codec else bytes(chunk)
        seqs = [r["seq"] for r in held]
        index.append((size, {names[r["channel"]] for r in held}, min(seqs), max(seqs), held[0]["ts_ns"], held[-1]["ts_ns"]))
        put(_head.pack(CHUNK, len(packed), len(chunk), compression, zlib.crc32(packed), held[0]["ts_ns"], held[-1]["ts_ns"]) + packed)
        held.clear()

    weight = 0
    stats: dict[str, list] = {}
    for r in rows:
        n = len(r["payload"] or b"")
        s = stats.setdefault(r["channel"], [0, 0, r["seq"], r["seq"], r["ts_ns"], r["ts_ns"]])
        s[:] = [s[0] + 1, s[1] + n, min(s[2], r["seq"]), max(s[3], r["seq"]), min(s[4], r["ts_ns"]), max(s[5], r["ts_ns"])]
        held.append(r)
        weight += n
        if len(held) >= CHUNK_MESSAGES or weight >= CHUNK_BYTES:
            flush()
            weight = 0
    flush()
    at_dict = size
    for name, i in names.items():
        text = name.encode()
        entry = struct.pack("<HH", i, len(text)) + text + struct.pack("<BH", 0, 3) + b"row" + struct.pack("<I", 0)
        put(bytes([DICT]) + entry + struct.pack("<I", zlib.crc32(entry)))
    at_index = size
    words = (len(names) + 15) // 16
    put(struct.pack("<BI", INDEX, len(index)))
    for o, ids, *bounds in index:
        put(struct.pack("<QH", o, words) + sum(1 << i - 1 for i in ids).to_bytes(2 * words, "little") + struct.pack("<4Q", *bounds))
    at_stats = size
    put(struct.pack("<BI", STATS, len(stats)))
    for c, s in stats.items():
        rate = s[0] / ((s[5] - s[4]) / 1e9) if s[5] > s[4] else 0.0
        put(struct.pack("<H6Qd", names[c], *s, rate))
    first, last = (rows[0]["ts_ns"], rows[-1]["ts_ns"]) if rows else (0, 0)
    put(struct.pack("<Q", max(0, last - first)))
    n_bytes = sum(s[1] for s in stats.values())
    footer = struct.pack("<4QI", MAGIC_FOOTER, at_index, at_stats, at_dict, 0)
    put((footer + struct.pack("<IQQ", zlib.crc32(footer), len(rows), n_bytes)).ljust(FOOTER_SIZE, b"\0"))
    header = struct.pack(
        "<QHHHHIQQQQQIIQQI", MAGIC_V2, 0, HEADER_SIZE, 7, 0, 0, first, 0, at_dict, at_index, at_stats, len(index), len(names), len(rows), n_bytes, compression
    ).ljust(HEADER_SIZE - 4, b"\0")
    body[0] = header + struct.pack("<I", zlib.crc32(header))
    return b"".join(body)


def decode_file(data: bytes) -> list[dict]:
    """The messages of a version 2 or version 0 file, in stored order."""
    return [{k: v for k, v in m.items() if k != "place"} for chunk in _chunks(data) for m in chunk]


def _chunks(data: bytes, channels: Sequence[str] | None = None, lo: int | None = None, hi: int | None = None) -> Iterator[list[dict]]:
    """The messages of a file chunk by chunk, each with its ``place`` in the file.

    With ``channels``, ``lo`` or ``hi`` (times, both included) chunks that cannot hold a wanted message are
    passed over by their index entries and heads; what is returned may still hold others.
    """
    if len(data) >= 8 and struct.unpack_from("<Q", data)[0] == MAGIC_V0:
        yield [m | {"place": i} for i, m in enumerate(_decode_v0(data))]
        return
    if len(data) < HEADER_SIZE + FOOTER_SIZE or struct.unpack_from("<Q", data)[0] != MAGIC_V2:
        raise Cut("not a record file")
    if struct.unpack_from("<I", data, HEADER_SIZE - 4)[0] != zlib.crc32(data[: HEADER_SIZE - 4]):
        raise Cut("the header is damaged")
    foot = data[-FOOTER_SIZE:]
    if struct.unpack_from("<Q", foot)[0] != MAGIC_FOOTER or struct.unpack_from("<I", foot, 36)[0] != zlib.crc32(foot[:36]):
        raise Cut("the footer is damaged")
    _, at_index, _, at_dict = struct.unpack_from("<4Q", foot)
    names: dict[int, str] = {}
    r = Reader(data, at_dict)
    while r.at < at_index:
        (kind,) = r.take("B")
        begin = r.at
        i, n = r.take("HH")
        name = r.raw(n).decode()
        _, n = r.take("BH")
        r.raw(n)
        r.raw(r.take("I")[0])
        if kind != DICT or zlib.crc32(data[begin : r.at]) != r.take("I")[0]:
            raise Cut("the channel dictionary is damaged")
        names[i] = name
    wanted = None if channels is None else sum(1 << i - 1 for i, name in names.items() if name in channels)
    r = Reader(data, at_index + 1)
    held: dict[int, int] = {}
    for _ in range(r.take("I")[0]):
        offset, words = r.take("QH")
        held[offset] = int.from_bytes(r.raw(2 * words), "little")
        r.take("4Q")
    number = -1
    r = Reader(data, HEADER_SIZE)
    while r.at < at_dict:
        offset = r.at
        kind, size, full, compression, crc, first, last = r.take("BIIBIQQ")
        packed = r.raw(size)
        if kind != CHUNK or zlib.crc32(packed) != crc or compression not in CODECS:
            raise Cut("a chunk is damaged")
        number += 1
        if (wanted is not None and not held.get(offset, -1) & wanted) or (lo is not None and last < lo) or (hi is not None and first > hi):
            continue
        codec = CODECS[compression]
        c = Reader(pa.decompress(packed, decompressed_size=full, codec=codec, asbytes=True) if codec else packed)
        out: list[dict] = []
        while c.at < full:
            channel, seq, ts, n = c.take("HQQI")
            payload = c.raw(n)
            c.raw(-c.at % 8)
            (n,) = c.take("I")
            blob = c.raw(n)
            if n:
                c.raw(-c.at % 8)
            out.append({"channel": names.get(channel, ""), "seq": seq, "ts_ns": ts, "payload": payload, "lineage": _lineage_of(blob, names) if n else [], "place": number << CHUNK_BITS | len(out)})
        yield out


def encode_v0(rows: Sequence[dict]) -> bytes:
    """The legacy dump of messages ``channel, seq, payload`` and ``lineage`` as text."""
    sized = lambda x: struct.pack("<I", len(x)) + x
    out = [struct.pack("<QI", MAGIC_V0, len(rows))]
    for r in rows:
        out += [sized(r["channel"].encode()), struct.pack("<Q", r["seq"]), sized(r["payload"] or b""), sized((r["lineage"] or "").encode())]
    return b"".join(out)


def _decode_v0(data: bytes) -> list[dict]:
    """The legacy dump, whose lineage is text: it is kept as the channel of a root hop without number."""
    r = Reader(data, 8)
    out = []
    for _ in range(r.take("I")[0]):
        channel = r.raw(r.take("I")[0]).decode()
        (seq,) = r.take("Q")
        payload = r.raw(r.take("I")[0])
        lineage = r.raw(r.take("I")[0]).decode()
        root = {"channel": lineage, "seq": None, "seq_end": None}
        out.append({"channel": channel, "seq": seq, "ts_ns": None, "payload": payload, "lineage": [{"root": root, "hops": []}] if lineage else []})
    return out


def write(log: DataFrame, path: str, compression: int = 2) -> None:
    """The log as files of bounded size, in order of ``arrival`` inside them and by their names.

    The path is one of Spark's; its store must be one that pyarrow writes to as well. Without a scheme it is
    in Spark's default store.
    """
    spark = log.sparkSession
    ship(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    base_uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(base_uri)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        rows: list[dict] = []
        total = files = weight = 0

        def close() -> None:
            nonlocal files, weight
            final = f"{base}/part-{task.partitionId():05d}-{files:05d}.trec"
            draft = f"{base}/_{task.taskAttemptId()}.tmp"
            with store.open_output_stream(draft) as f:
                f.write(encode_file(rows, compression))
            if store.get_file_info(final).type == pyarrow.fs.FileType.File:
                store.delete_file(final)
            store.move(draft, final)
            files, weight = files + 1, 0
            rows.clear()

        for b in batches:
            for begin in range(0, b.num_rows, CHUNK_MESSAGES):
                part = b.slice(begin, CHUNK_MESSAGES).to_pylist()
                rows += part
                total += len(part)
                weight += sum(len(r["payload"] or b"") for r in part)
                if len(rows) >= FILE_MESSAGES or weight >= FILE_BYTES:
                    close()
        if rows:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    d = log.select("channel", "seq", "ts_ns", "arrival", "payload", "lineage")
    d.repartitionByRange("arrival").sortWithinPartitions("arrival").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read(spark: SparkSession, path: str, channels: Sequence[str] | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """``channel, seq, ts_ns, arrival, payload, lineage`` of the files in a folder.

    ``arrival`` ascends over the files in order of their names and inside them, with gaps. ``channels`` and
    the times ``lo`` to ``hi`` (both included) keep only such messages, and chunks without any are not decoded.
    """
    ship(spark)
    wanted = None if channels is None else list(channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rank, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for part in _chunks(data.as_py(), wanted, lo, hi):
                    column = lambda k, kind, part=part: pa.array([r[k] for r in part], kind)
                    at = pa.array([rank << FILE_BITS | r["place"] for r in part], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [column("channel", pa.string()), column("seq", pa.int64()), column("ts_ns", pa.int64()), at, column("payload", pa.binary()), column("lineage", _lineage)],
                        ["channel", "seq", "ts_ns", "arrival", "payload", "lineage"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.trec").load(path)
    # a row a file
    ranks = files.select(F.col("path").alias("_path"), (F.row_number().over(Window.orderBy("path")) - 1).cast("bigint").alias("rank"))
    out = files.join(F.broadcast(ranks), F.col("path") == F.col("_path")).select("rank", "content").mapInArrow(run, ROW)
    if wanted is not None:
        out = out.filter(F.col("channel").isin(wanted))
    if lo is not None:
        out = out.filter(F.col("ts_ns") >= lo)
    return out if hi is None else out.filter(F.col("ts_ns") <= hi)


def seek(spark: SparkSession, path: str, ts_ns: int) -> DataFrame:
    """The first message of the files at or after a time; what is earlier is passed over by chunks."""
    return read(spark, path, lo=ts_ns).orderBy("ts_ns", "arrival").limit(1)


@dataclass(frozen=True)
class Field:
    name: str
    offset: int
    type: str
    count: int = 1


def encode_schema(type_name: str, fields: Sequence[Field]) -> bytes:
    out = struct.pack("<QH", MAGIC_SCHEMA, len(type_name.encode())) + type_name.encode() + struct.pack("<I", len(fields))
    for f in fields:
        out += struct.pack("<H", len(f.name.encode())) + f.name.encode() + struct.pack("<QBQ", f.offset, POD_TYPES[f.type][1], f.count)
    return out


def decode_schema(data: bytes) -> tuple[str, list[Field]]:
    """Type name and fields; ``Cut`` for anything incomplete or unknown."""
    r = Reader(data)
    magic, n = r.take("QH")
    if magic != MAGIC_SCHEMA or not n:
        raise Cut("not a field table")
    name = r.raw(n).decode()
    (count,) = r.take("I")
    if count > MAX_FIELDS:
        raise Cut("too many fields")
    tags = {tag: kind for kind, (_, tag) in POD_TYPES.items()}
    fields = []
    for _ in range(count):
        (n,) = r.take("H")
        if not n:
            raise Cut("a field has no name")
        field = r.raw(n).decode()
        offset, tag, many = r.take("QBQ")
        if tag not in tags:
            raise Cut("a field has an unknown type")
        fields.append(Field(field, offset, tags[tag], many))
    return name, fields


def _dtype(f: Field) -> np.dtype:
    return np.dtype((POD_TYPES[f.type][0], (f.count,))) if f.count > 1 else np.dtype(POD_TYPES[f.type][0])


def pack_pod(df: DataFrame, fields: Sequence[Field], payload: str = "payload") -> DataFrame:
    """Replace the field columns by their binary layout."""
    ship(df.sparkSession)
    names = [f.name for f in fields]
    rest = [c for c in df.columns if c not in names]
    size = max(f.offset + _dtype(f).itemsize for f in fields)
    form = np.dtype({"names": names, "formats": [_dtype(f) for f in fields], "offsets": [f.offset for f in fields], "itemsize": size})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, form)
            for f in fields:
                out[f.name] = np.array(b.column(b.schema.get_field_index(f.name)).to_pylist()).reshape(out[f.name].shape)
            raw = out.tobytes()
            data = [raw[i * size : (i + 1) * size] for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(data, pa.binary())], [*rest, payload])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest)
    return df.mapInArrow(run, f"{kinds}{payload} binary")


def decode_pod(df: DataFrame, fields: Sequence[Field], payload: str = "payload") -> DataFrame:
    """Replace a binary payload by its fields; fields past its end are null."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(b.schema.get_field_index(payload)).to_pylist()
            columns = []
            for f in fields:
                kind, end = _dtype(f), f.offset + _dtype(f).itemsize
                fits = [x is not None and len(x) >= end for x in data]
                values = np.frombuffer(b"".join(x[f.offset : end] for x, ok in zip(data, fits, strict=True) if ok), kind.base if f.count > 1 else kind)
                found = iter(values.reshape(-1, f.count).tolist() if f.count > 1 else values.tolist())
                columns.append([next(found) if ok else None for ok in fits])
            own = [pa.array(v, _arrow(f)) for f, v in zip(fields, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), *own], [*rest, *(f.name for f in fields)])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest]
    kinds += [f"{f.name} {'array<%s>' % SPARK_TYPES[f.type] if f.count > 1 else SPARK_TYPES[f.type]}" for f in fields]
    return df.mapInArrow(run, ", ".join(kinds))


def render_pod(df: DataFrame, fields: Sequence[Field] | None, payload: str = "payload") -> DataFrame:
    """Add ``text``: ``name=value`` of the fields with six significant digits, or hex where the layout is unknown."""
    if not fields:
        return df.withColumn("text", F.lower(F.hex(payload)))
    from weirflow.functions.scalars import format_g

    one = lambda c, f: format_g(c.cast("double")) if f.type in ("double", "float") else c.cast("string")
    shown = []
    for f in fields:
        places = [F.col(f"_f.{f.name}")] if f.count == 1 else [F.get(F.col(f"_f.{f.name}"), F.lit(i)) for i in range(min(f.count, SHOWN))]
        value = F.concat_ws(",", *[one(c, f) for c in places])
        shown.append(F.when(F.col(f"_f.{f.name}").isNotNull(), F.concat(F.lit(f.name + "="), value)))
    rest = df.columns
    whole = decode_pod(df.withColumn("_p", F.col(payload)), fields, "_p")
    nested = whole.select(*rest, F.struct(*[f.name for f in fields]).alias("_f"))
    return nested.select(*rest, F.concat_ws(" ", *shown).alias("text"))


def _arrow(f: Field) -> pa.DataType:
    kinds = {"double": pa.float64(), "float": pa.float32(), "int32": pa.int32(), "int64": pa.int64(), "uint32": pa.int64(), "uint64": pa.decimal128(20, 0), "bool": pa.bool_()}
    return pa.list_(kinds[f.type]) if f.count > 1 else kinds[f.type]
