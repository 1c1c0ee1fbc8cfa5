"""Removal of byte strings that a document with a smaller id also holds.

Distributed suffix sorting over the suffixes that can matter:

1. Every ``length``-byte string has an anchor, the position inside it whose ``K``-byte
   string hashes least; equal strings have equal anchors. Anchors, about one for 15
   bytes, are dealt by hash, and those that two documents share are sent back. An anchor
   that two documents of one slice share is settled there, and only its least document
   is dealt, so a part gets no more of a hot anchor than one entry a slice.
2. The text around a shared anchor, all strings that it anchors, forms a segment.
   Segments are range-partitioned by the leading bytes of the suffix at the anchor,
   between splitters taken from a sample. A splitter never parts equal leading bytes, so
   equal strings meet in one bucket. Of equal segments of a slice only the place in the
   least document goes there: the others are wholly removed, which is known at once.
3. In a bucket, equal segments are one, and the suffixes at all string starts are sorted by multikey quicksort with
   8-byte symbols, one class after another of equal distance to the anchor; only runs
   that still tie are sorted by their next symbol. Runs that agree to the full length
   are compared across segment and block boundaries by their least document id.
4. Strings found in a smaller document become byte spans of their document.

Hashes only choose what is compared; equality is decided on bytes. A copy of a text in
the same batch is settled at once: all of it is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.shipping import ship

from .common import slices
from .shingles import mix, powers

K = 20
#: Leading bytes that splitters compare.
LEAD = 16
#: Window starts of a unit, and bytes handled at once.
UNIT, BLOCK = 1 << 19, 1 << 19
#: Rows at most of a slice, and its bytes of text, for the anchors and for the segments.
ANCHOR_ROWS, ANCHOR_BYTES = 1 << 14, 8 << 20
SEGMENT_ROWS, SEGMENT_BYTES = 1 << 11, 4 << 20
#: Documents, about, from which splitters are sampled, and positions of each.
SAMPLE_DOCS, SAMPLE_KEYS = 1500, 48
#: Buckets (and hash parts) for each shuffle partition, so that partitions even out.
SPREAD = 4
WHOLE = (1 << 31) - 1
LOW48 = np.uint64((1 << 48) - 1)


def blocks_of(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in blocks: bytes, and of each unit its place in the block, text and start there."""
    parts: list[bytes] = []
    at, owner, start, size = [0], [], [], 0
    for i, t in enumerate(texts):
        for begin in range(0, len(t) - length + 1, UNIT):
            piece = t[begin : begin + UNIT + length - 1]
            parts.append(piece)
            size += len(piece)
            at.append(size)
            owner.append(i)
            start.append(begin)
            if size >= BLOCK:
                yield b"".join(parts), np.array(at), np.array(owner), np.array(start)
                parts, at, owner, start, size = [], [0], [], [], 0
    if parts:
        yield b"".join(parts), np.array(at), np.array(owner), np.array(start)


def anchor_runs(block: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: unit, first and last string start, anchor, hash of the anchor."""
    k = min(K, length)
    raw = np.frombuffer(block, np.uint8)
    n = len(raw)
    p, inverse = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    grams = mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, size = length - k + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # strings that would cross the end of a unit are none
    valid = np.zeros(len(anchor) + 1, np.int32)
    ends = np.minimum(at[1:] - length + 1, len(anchor))
    valid[at[:-1]] += 1
    valid[ends] -= 1
    starts = np.flatnonzero(np.cumsum(valid)[:-1])
    a = anchor[starts]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first, last = starts[new], starts[np.r_[new[1:], len(starts)] - 1]
    return np.searchsorted(at, first, side="right") - 1, first, last, a[new], grams[a[new]]


def hash_key(grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and 48-bit identity in it of an anchor's hash."""
    return (grams >> np.uint64(32)) % np.uint64(parts), mix(grams) & LOW48


def planes(x: np.ndarray) -> bytes:
    """Bytes of an integer array by significance, which compresses well when it is sorted."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def packed(data: bytes) -> bytes:
    """Zstandard with the size in front; shuffle compression alone leaves text half as large again."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def same_in_batch(ids: list[int | None], texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Rows to work on, and ids of those whose text a smaller id of this batch has."""
    least: dict[bytes, int] = {}
    for i, t in zip(ids, texts, strict=True):
        if i is not None and (t not in least or i < least[t]):
            least[t] = i
    rows, copies = [], []
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        if i is not None:
            (rows.append(k) if least[t] == i else copies.append(i))
    return rows, copies


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _anchors(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """``part, n, docs, data``: packed anchors of a slice for each part.

    Of an anchor the least document of the slice is dealt. Negative parts are dealt evenly: from -1 down
    they list whole copies, from -1 - ``parts`` down the documents of anchors that are shared inside the slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, ANCHOR_ROWS, ANCHOR_BYTES):
            yield one(piece.column(0).to_pylist(), _texts(piece.column(1)))

    def one(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        rows, copies = same_in_batch([i if len(t) >= length else None for i, t in zip(ids, texts, strict=True)], texts)
        keys, owners, dealt = [], [], []
        for block, at, owner, _ in blocks_of([texts[k] for k in rows], length):
            unit, _, _, _, grams = anchor_runs(block, at, length)
            part, key = hash_key(grams, parts)
            keys.append(key)
            dealt.append(part)
            owners.append(owner[unit])
        out: tuple[list, list, list, list] = ([], [], [], [])

        def add(part: int, key: np.ndarray, doc: np.ndarray) -> None:
            own, where = np.unique(doc, return_inverse=True)
            data = planes(np.diff(key, prepend=np.uint64(0))) + planes(where.astype(np.uint16))
            for column, x in zip(out, (part, len(key), own.tobytes(), data), strict=True):
                column.append(x)

        salt = next((i for i in ids if i is not None), 0) % parts
        if copies:
            for column, x in zip(out, (-1 - salt, len(copies), np.array(copies, np.int64).tobytes(), b""), strict=True):
                column.append(x)
        if keys:
            doc = np.array([ids[k] for k in rows], np.int64)
            part = np.concatenate(dealt).astype(np.int64)
            value = np.concatenate(keys) << np.uint64(14) | np.concatenate(owners).astype(np.uint64)
            del keys, dealt, owners
            order = np.lexsort((value, part))
            part, value = part[order], value[order]
            fresh = np.r_[True, (value[1:] != value[:-1]) | (part[1:] != part[:-1])]
            part, value = part[fresh], value[fresh]
            key, doc = value >> np.uint64(14), doc[(value & np.uint64((1 << 14) - 1)).astype(np.int64)]
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            least = np.minimum.reduceat(doc, cuts)
            many = np.repeat(least != np.maximum.reduceat(doc, cuts), np.diff(np.r_[cuts, len(key)]))
            if many.any():
                some = np.argsort(key[many], kind="stable")
                add(-1 - parts - salt, key[many][some], doc[many][some])
            part, key = part[cuts], key[cuts]
            bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, z in zip(bounds.tolist(), np.r_[bounds[1:], len(part)].tolist(), strict=True):
                add(int(part[a]), key[a:z], least[a:z])
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
            ["part", "n", "docs", "data"],
        )

    return docs.mapInArrow(run, "part int, n long, docs binary, data binary")


def _by_group(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Call ``work`` with the rows of each value of the first column, which is sorted; those of negative values go one by one."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield from work(held)
                held = []
            if row[0] < 0:
                yield from work([row])
            else:
                held.append(row)
    if held:
        yield from work(held)


def _copies(dealt: DataFrame, parts: int) -> DataFrame:
    """``doc_id, start, stop`` of the whole copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copies = pa.compute.and_(pa.compute.less(b.column(0), 0), pa.compute.greater_equal(b.column(0), -parts))
            for data in b.column(2).filter(copies).to_pylist():
                doc = np.frombuffer(data, np.int64)
                zero = np.zeros(len(doc), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(zero), pa.array(zero + WHOLE)], ["doc_id", "start", "stop"])

    # a filter would move below the exchange and make it another one, for which all texts are read again
    return dealt.mapInArrow(run, "doc_id long, start long, stop long")


def _shared(dealt: DataFrame, parts: int) -> DataFrame:
    """``doc_id, key``: anchors that two documents have, of each slice its least document; key -1 marks a whole copy.

    The other documents of a slice that hold the anchor are listed as well, by the slice itself.
    """

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if -parts <= rows[0][0] < 0:
            doc = np.frombuffer(rows[0][2], np.int64)
            key = np.full(len(doc), -1, np.int64)
        else:
            keys, docs = [], []
            for _, n, ids, data in rows:
                keys.append(np.cumsum(unplanes(data[: 8 * n], n, np.uint64), dtype=np.uint64))
                docs.append(np.frombuffer(ids, np.int64)[unplanes(data[8 * n :], n, np.uint16)])
            key, doc = np.concatenate(keys), np.concatenate(docs)
            if rows[0][0] >= 0:
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                many = np.minimum.reduceat(doc, cuts) != np.maximum.reduceat(doc, cuts)
                keep = np.repeat(many, np.diff(np.r_[cuts, len(key)]))
                key, doc = key[keep], doc[keep]
            key = key.view(np.int64)
        for i in range(0, len(doc), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(doc[i : i + (1 << 17)]), pa.array(key[i : i + (1 << 17)])], ["doc_id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, work)

    return dealt.sortWithinPartitions("part").mapInArrow(run, "doc_id long, key long")


def leading(raw: np.ndarray, at: np.ndarray, n: int = 8) -> np.ndarray:
    """The ``n`` bytes at each position as one big-endian number; bytes past the end count as 0."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = at + k < len(raw)
        out = out << np.uint64(8) | np.where(inside, raw[np.minimum(at + k, len(raw) - 1)], 0).astype(np.uint64)
    return out


def prefixes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ``LEAD`` bytes at each position as fixed-width strings, which compare like the bytes; zeros at their end count for nothing."""
    spot = at[:, None] + np.arange(LEAD)
    return np.where(spot < len(raw), raw[np.minimum(spot, len(raw) - 1)], np.uint8(0)).astype(np.uint8).reshape(-1).view(f"S{LEAD}")


def _splitters(docs: DataFrame, length: int, buckets: int) -> np.ndarray:
    """Quantiles of the anchors' leading bytes in a sample of bounded size; they only balance the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ANCHOR_ROWS, ANCHOR_BYTES):
            for block, at, _, _ in blocks_of([t[:UNIT] for t in _texts(b.column(1))], length):
                unit, _, _, a, _ = anchor_runs(block, at, length)
                order = np.argsort(mix(a.astype(np.uint64)), kind="stable")
                rank = np.zeros(len(a), np.int64)
                grouped = order[np.argsort(unit[order], kind="stable")]
                cuts = np.searchsorted(unit[grouped], unit[grouped])
                rank[grouped] = np.arange(len(a)) - cuts
                keys = prefixes(np.frombuffer(block, np.uint8), a[rank < SAMPLE_KEYS])
                yield pa.RecordBatch.from_arrays([pa.array(keys.tolist(), pa.binary())], ["key"])

    n = docs.count()
    step = max(1, n // SAMPLE_DOCS)
    rows = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).mapInArrow(run, "key binary").collect()
    keys = np.sort(np.array([bytes(r.key) for r in rows], f"S{LEAD}"))
    if not len(keys):
        return keys
    return np.unique(keys[np.arange(1, buckets) * len(keys) // buckets])


def _segments(joined: DataFrame, length: int, parts: int, splitters: np.ndarray) -> DataFrame:
    """``bucket, n, data, docs, starts``: distinct segments of a slice for each bucket with their places in its least document.

    Negative buckets are dealt evenly and list spans that are already known: equal segments of greater documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, SEGMENT_ROWS, SEGMENT_BYTES):
            piece = piece.filter(piece.column(2).is_valid())
            if piece.num_rows:
                yield one(piece.column(0).to_pylist(), _texts(piece.column(1)), piece.column(2))

    def one(ids: list[int], texts: list[bytes], wanted: pa.Array) -> pa.RecordBatch:
        keys = [np.sort(np.array(w.values.to_numpy(zero_copy_only=False), np.int64)) for w in wanted]
        # a whole copy has nothing to compare: the text it copies stands for it
        texts = [b"" if len(k) and k[0] == -1 else t for t, k in zip(texts, keys, strict=True)]
        count = np.array([len(k) for k in keys])
        pool = np.concatenate(keys).astype(np.uint64) if len(keys) else np.zeros(0, np.uint64)
        pool = np.unique(pool << np.uint64(11) | np.repeat(np.arange(len(keys)), count).astype(np.uint64))
        buckets: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for block, at, owner, start in blocks_of(texts, length):
            unit, first, last, a, grams = anchor_runs(block, at, length)
            _, key = hash_key(grams, parts)
            value = key << np.uint64(11) | owner[unit].astype(np.uint64)
            spot = np.minimum(np.searchsorted(pool, value), len(pool) - 1)
            hit = np.flatnonzero(pool[spot] == value)
            place = np.searchsorted(splitters, prefixes(np.frombuffer(block, np.uint8), a[hit]), side="right")
            shift = at[unit[hit]] - start[unit[hit]]
            for bucket, doc, p, q, x, off in zip(
                place.tolist(), owner[unit[hit]].tolist(), first[hit].tolist(), last[hit].tolist(), a[hit].tolist(), shift.tolist(), strict=True
            ):
                segment = bytes((x - p,)) + block[p : q + length]
                buckets.setdefault(bucket, {}).setdefault(segment, []).append((ids[doc], p - off))
        out: tuple[list, ...] = ([], [], [], [], [])
        known: list[tuple[int, int, int]] = []
        for bucket, found in buckets.items():
            for segment, v in found.items():
                least = min(v)[0]
                known += [(d, p, len(segment) - 1) for d, p in v if d != least]
                v[:] = [x for x in v if x[0] == least]
            places = [len(v) for v in found.values()]
            flat = [x for v in found.values() for x in v]
            sizes = np.array([[len(s) - 1, n] for s, n in zip(found, places, strict=True)], np.int32)
            row = (bucket, len(found), packed(planes(sizes.reshape(-1)) + b"".join(found)), np.array([d for d, _ in flat], np.int64).tobytes(), np.array([p for _, p in flat], np.int32).tobytes())
            for column, x in zip(out, row, strict=True):
                column.append(x)
        if known:
            own, begin, size = (np.array(x, np.int64) for x in zip(*known, strict=True))
            row = (-1 - ids[0] % parts, len(known), size.astype(np.int32).tobytes(), own.tobytes(), begin.astype(np.int32).tobytes())
            for column, x in zip(out, row, strict=True):
                column.append(x)
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])],
            ["bucket", "n", "data", "docs", "starts"],
        )

    return joined.mapInArrow(run, "bucket int, n long, data binary, docs binary, starts binary")


def equal_runs(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes by their first ``length`` bytes; the order, and a number for each run of equals in it.

    Multikey quicksort with symbols of 8 bytes: each level sorts only the suffixes that
    still tie, inside their runs, by the next symbol.
    """
    order = np.arange(len(at))
    run = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    for depth in range(0, length, 8):
        if not len(live):
            break
        symbol = leading(raw, at[order[live]] + depth, min(8, length - depth))
        inner = np.argsort(symbol, kind="quicksort")
        inner = inner[np.argsort(run[live][inner], kind="stable")]
        order[live] = order[live][inner]
        symbol, tied = symbol[inner], run[live]
        new = np.r_[True, (tied[1:] != tied[:-1]) | (symbol[1:] != symbol[:-1])]
        # numbers stay ascending over all runs: the place of a run's first suffix
        begin = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
        run[live] = live[begin]
        alone = new & np.r_[new[1:], True]
        live = live[~alone]
    return order, run


def _spans(segments: DataFrame, length: int, partitions: int) -> DataFrame:
    """``doc_id, start, stop``: bytes covered by strings that a smaller document has."""

    def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows[0][0] < 0:
            _, _, size, doc, start = rows[0]
            begin = np.frombuffer(start, np.int32).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(doc, np.int64)), pa.array(begin), pa.array(begin + np.frombuffer(size, np.int32))], ["doc_id", "start", "stop"]
            )
            return
        texts: dict[bytes, int] = {}
        number, docs, starts = [], [], []
        for _, n, data, doc, start in rows:
            data = unpacked(data)
            sizes = unplanes(data[: 8 * n], 2 * n, np.int32).reshape(n, 2)
            ends = (8 * n + np.cumsum(sizes[:, 0] + 1)).tolist()
            own = [texts.setdefault(data[a:z], len(texts)) for a, z in zip([8 * n, *ends[:-1]], ends, strict=True)]
            number.append(np.repeat(np.array(own, np.int64), sizes[:, 1]))
            docs.append(np.frombuffer(doc, np.int64))
            starts.append(np.frombuffer(start, np.int32).astype(np.int64))
        segment, doc, start = np.concatenate(number), np.concatenate(docs), np.concatenate(starts)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.r_[0, np.cumsum(sizes)[:-1]] + 1
        anchor, strings = raw[begin - 1].astype(np.int64), sizes - length  # one byte of a segment is its anchor's offset
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, segment, doc)
        first_string = np.r_[0, np.cumsum(strings)]
        smallest = np.zeros(first_string[-1], np.int64)
        for distance in range(length):
            # of each segment the string whose anchor lies so many bytes behind its start
            j = anchor - distance
            some = np.flatnonzero((j >= 0) & (j < strings))
            if not len(some):
                continue
            order, run = equal_runs(raw, begin[some] + j[some], length)
            cuts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            low = np.repeat(np.minimum.reduceat(least[some][order], cuts), np.diff(np.r_[cuts, len(order)]))
            smallest[(first_string[:-1] + j)[some][order]] = low
        for a in range(0, len(segment), 1 << 17):
            s, d, p = segment[a : a + (1 << 17)], doc[a : a + (1 << 17)], start[a : a + (1 << 17)]
            n = strings[s]
            row = np.repeat(np.arange(len(s)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            hit = np.flatnonzero(smallest[first_string[s][row] + j] < d[row])
            if not len(hit):
                continue
            new = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (row[hit][1:] != row[hit][:-1])])
            head, tail = hit[new], hit[np.r_[new[1:], len(hit)] - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[row[head]]), pa.array(p[row[head]] + j[head]), pa.array(p[row[tail]] + j[tail] + length)], ["doc_id", "start", "stop"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, work)

    return segments.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, start long, stop long")


def _removed(joined: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            yield one(b)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        size, gone, spans, digest = [], [], [], []
        for text, found in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            text = text or b""
            merged: list[list[int]] = []
            for x in sorted((x["start"], min(x["stop"], len(text))) for x in found or ()):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                elif x[0] < x[1]:
                    merged.append([*x])
            h, at = hashlib.sha256(), 0
            for a, z in merged:
                h.update(text[at:a])
                at = z
            h.update(text[at:])
            size.append(len(text))
            gone.append(sum(z - a for a, z in merged))
            spans.append([{"start": a, "stop": z} for a, z in merged])
            digest.append(h.hexdigest())
        pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pair))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )

    return joined.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"
    )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans``.

    ``spans`` are the maximal removed byte ranges of the UTF-8 text, from ``start`` up to
    before ``stop``. Ids are integers; a null text counts as empty. Rows with equal ids
    never remove bytes of one another, and what one of them loses they all lose where
    their texts agree; a row without id keeps all its bytes and removes none. Other
    columns are ignored; an empty table gives an empty result.
    """
    if not 2 <= length <= 250:
        raise ValueError("length is from 2 to 250 bytes")
    spark = docs.sparkSession
    ship(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = SPREAD * partitions
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    splitters = _splitters(d, length, parts)
    dealt = _anchors(d, length, parts).repartition(partitions, "part")
    wanted = _shared(dealt, parts).groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    # both joins read the texts by one exchange on the id, and copies come from the exchange of the anchors
    near = d.join(wanted, "doc_id", "left").select("doc_id", F.when(F.col("keys").isNotNull(), F.col("text")).alias("text"), "keys")
    spans = _spans(_segments(near, length, parts, splitters), length, partitions)
    found = spans.unionByName(_copies(dealt, parts)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    return _removed(d.join(found, "doc_id", "left").select("doc_id", "text", "found"))
