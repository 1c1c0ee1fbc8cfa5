"""Context-mixing range coder for token ids, many blocks at a time.

Every block starts from the same fresh model, so blocks decode alone and a set of them
runs in lockstep as numpy lanes. The model of a block:

* ids are numbered within their block, in ascending order, and the model sees these symbols;
* order 2 and order 1: contexts of the last two symbols (hashed) and of the last one (up to 1024 distinct
  ids each has its own) remember the symbol that followed and a confidence. The order-2 symbol, or without
  one the order-1 symbol, is the prediction;
* whether it is right is a binary decision, whose probability a logistic mixer blends
  from three adaptive estimates: by both confidences, by the order-1 confidence alone,
  and without context. The weights are learned as coding goes;
* order 0: an id that was not predicted is coded by the frequencies of all ids of the
  block, which are counted first and stored with it.

The coder holds an interval of 64-bit numbers and shifts 16 bits out, once an id is coded, while it is
shorter than ``SHORT``. One that still straddles a multiple of 2**48 then is cut at that multiple to its
longer part, which costs a fraction of a bit and leaves no interval too short to divide.
All lanes take the same operations, with shifts of 0 where nothing leaves, since picking lanes costs more.
Bits of ids above the low 16, where there are any, are compressed apart.

All arithmetic is on integers, so encoder and decoder agree on every machine.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa

MAGIC = b"WFID"
VERSION = 4
#: Magic, version, ids, CRC-32 of the ids, bytes of code, of frequencies and of high halves, CRC-32 of header and body.
HEADER = struct.Struct("<4sBxxxIIIIII")
#: Bits of a context's slot.
BITS = 10
SLOTS = (1 << BITS) - 1
#: Packs frequencies; with zlib most of the time goes into its start.
TABLES = pa.Codec("zstd", compression_level=1)
#: Bits of the sum of a block's frequencies: at least, and beyond those of its number of distinct ids.
LEAST_BITS, MORE_BITS = 10, 2
#: Rows of a matrix that are turned into columns at once, for the cache.
TURNED = 64

STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((p + 0.5) / (4095.5 - p))))) for p in range(4096)], np.int32)
SQUASH = np.array([max(1, min(4095, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], np.int32)
ONE, W16, W32, W36, W48 = (np.uint64(x) for x in (1, 16, 32, 36, 48))
LOW = np.uint64(0xFFFF)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Length below which an interval is shifted; a decision and an id after it leave whole steps of it.
SHORT = np.uint64(1 << 32)
#: Length below which an interval is still short after a shift, and the most by which ends differ that agree in the top 16 bits.
STILL_SHORT, AGREE = np.uint64(1 << 16), np.uint64((1 << 48) - 1)
#: Bound of a mixing weight after every eighth step; each of those between adds at most 2**13, so sums of products stay below 2**31.
LIMIT = 3 << 16
#: Change of an entry by its confidence, where its symbol was wrong (then below 2 it is replaced) and where it was right.
CHANGE = np.array([*(-((c + 1) >> 1) for c in range(8)), *(int(c < 7) for c in range(8))], np.int32)


class Lanes:
    """Models and coder states of the blocks, longest first. Tables are flat, a stretch for each lane."""

    def __init__(self, n: int):
        lane = np.arange(n)
        # rows of two: order 1 and order 2; of three: by both confidences, by that of order 1, without context
        self.lanes = n
        self.base = np.stack([lane << BITS, (n + lane) << BITS])
        self.by = np.full(136 * n, 1 << 14, np.int32)
        self.by_base = np.stack([128 * lane, 128 * n + 8 * lane])
        self.free = np.full(n, 1 << 14, np.int32)
        self.weights = np.full((3, n), 26000, np.int32)
        self.steps = 0
        self.x1 = np.zeros(n, np.uint64)
        self.x2 = np.full(n, ALL, np.uint64)

    def hold(self, distinct: int) -> None:
        """Open the contexts, for blocks of at most that many distinct ids; narrow entries leave more of them in the cache."""
        self.type = np.uint16 if distinct <= 1 << 12 else np.uint32
        self.table = np.zeros(2 * self.lanes << BITS, self.type)
        # an entry is a symbol and a confidence, marked where it is one of order 2, so that the greater of both is the prediction
        self.mark = self.type(1 << 15 if self.type is np.uint16 else 1 << 19)
        self.marks = np.array([[0], [self.mark]], self.type)
        self.change = CHANGE.astype(self.type)

    def predict(self, a: int, p1: np.ndarray, p2: np.ndarray):
        """Guesses and their probabilities after the symbols ``p1`` and, before them, ``p2`` (64 bits)."""
        at = np.empty((2, a), np.int64)
        np.bitwise_and(p1, SLOTS, out=at[0])
        order2 = at[1]
        # symbols are small and dense, so a sum spreads them
        np.multiply(p2, 421, out=order2)
        order2 += p1
        order2 &= SLOTS
        at += self.base[:, :a]
        e = self.table.take(at, mode="clip")
        c = e & 7
        # an empty entry is 0: it predicts symbol 0, without confidence
        guess = np.maximum(e[0], e[1])
        guess &= ~self.mark
        context = c[1] << 4
        context |= c[0] << 1
        context |= (e[0] ^ guess) < 8
        guess >>= 3
        places = np.empty((2, a), np.int64)
        np.add(self.by_base[0, :a], context, out=places[0])
        np.add(self.by_base[1, :a], c[0], out=places[1])
        found = np.empty((3, a), np.int32)
        self.by.take(places, mode="clip", out=found[:2])
        found[2] = self.free[:a]
        st = STRETCH.take(found >> 4, mode="clip")
        parts = self.weights[:, :a] * st
        dot = parts[0]
        dot += parts[1]
        dot += parts[2]
        dot >>= 16
        dot += 2047
        # beyond the ends of the table the mode takes its ends
        return guess, SQUASH.take(dot, mode="clip"), (at, e, c, places, found, st)

    def update(self, state, symbols: np.ndarray, hit: np.ndarray, p: np.ndarray) -> None:
        at, e, c, places, found, st = state
        a = len(symbols)
        right = hit.astype(np.int32)
        st *= (right << 12) - p
        st += 512
        st >>= 10
        w = self.weights[:, :a]
        w += st
        self.steps += 1
        if not self.steps & 7:
            np.minimum(np.maximum(w, -LIMIT, out=w), LIMIT, out=w)
        right *= 65535
        change = right - found
        change >>= 5
        change += found
        self.by[places] = change[:2]
        self.free[:a] = change[2]
        # right: more sure, up to 7; wrong: half as sure, and replaced when that is nothing
        fresh = self.marks + (symbols << 3)
        key = ((e ^ fresh) < 8).astype(self.type)
        key <<= 3
        key |= c
        now = self.change.take(key, mode="clip")
        now += e
        fresh |= 1
        self.table[at] = np.where(key < 2, fresh, now)

    def split(self, a: int, p: np.ndarray) -> np.ndarray:
        mid = self.x2[:a] - self.x1[:a]
        mid >>= np.uint64(12)
        mid *= p.astype(np.uint64)
        mid += self.x1[:a]
        return mid

    def narrow(self, hit: np.ndarray, mid: np.ndarray, step: np.ndarray, low: np.ndarray, upto: np.ndarray) -> None:
        """To the lower part up to ``mid`` where the prediction was right, else to the symbol's places in the upper one."""
        a = len(hit)
        upto *= step
        upto += mid
        self.x2[:a] = np.where(hit, mid, upto)
        low *= step
        low += mid
        low += ONE
        self.x1[:a] = np.where(hit, self.x1[:a], low)

    def cut(self, at: np.ndarray) -> None:
        """Cut intervals that straddle a multiple of 2**48 to their longer part."""
        x1, x2 = self.x1[at], self.x2[at]
        seam = x2 >> W48 << W48
        lower = seam - x1 > x2 - seam
        self.x2[at[lower]] = seam[lower] - ONE
        self.x1[at[~lower]] = seam[~lower]

    def short(self, a: int) -> np.ndarray:
        """Lanes to be shifted; their ends agree in the top 16 bits."""
        return np.flatnonzero(self.leaving(a)[0])

    def leaving(self, a: int) -> tuple[np.ndarray, bool]:
        """Whether each lane is to be shifted, and whether one may still be short after that."""
        x1, x2 = self.x1[:a], self.x2[:a]
        length = x2 - x1
        short = length < SHORT
        apart = (x1 ^ x2) > AGREE
        apart &= short
        if apart.any():
            self.cut(np.flatnonzero(apart))
            return short, True
        return short, bool(length.min(initial=ALL) < STILL_SHORT)

    def shift(self, at: np.ndarray) -> None:
        self.x1[at] <<= W16
        self.x2[at] = self.x2[at] << W16 | LOW

    def shift_some(self, some: np.ndarray, by: np.ndarray) -> None:
        """``shift`` of the lanes where ``some`` is 1 and ``by`` 16; the others have 0 in both."""
        a = len(some)
        self.x1[:a] <<= by
        x2 = self.x2[:a]
        x2 <<= by
        x2 |= some * LOW


def frequencies(group: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, bytes]]]:
    """For blocks of 16-bit ids, bits of the sum of each one's frequencies; and its distinct ids, their plan and their table.

    Frequencies are at least 1. The plan has an id's symbol, its first place and the end of its places.
    The table is the number of ids; their gaps and frequencies less 1, as two planes of low bytes and what is above them.
    """
    lens = np.array(list(map(len, group)), np.int64)
    keys = np.concatenate(group).astype(np.uint32)
    keys |= np.repeat(np.arange(len(group), dtype=np.uint32) << 16, lens)
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ 1))
    counts = np.diff(first, append=len(keys))
    keys = keys[first]
    lane, ids = keys >> 16, (keys & 0xFFFF).astype(np.int64)
    starts = np.searchsorted(lane, np.arange(len(group) + 1, dtype=np.uint32))
    distinct = np.diff(starts)
    some = np.flatnonzero(distinct)
    begin = starts[some]
    # the exponent is the bit length
    bits = np.where(distinct > 0, np.maximum(LEAST_BITS, np.frexp(distinct - 1.0)[1] + MORE_BITS), 0).astype(np.int64)
    room = (1 << bits) - distinct
    freq = 1 + counts * room[lane] // lens[lane]
    if len(some):
        most = np.zeros(len(group), np.int64)
        most[some] = np.maximum.reduceat(counts, begin)
        top = np.flatnonzero(counts == most[lane])
        top = top[np.unique(lane[top], return_index=True)[1]]
        freq[top] += (1 << bits[some]) - np.add.reduceat(freq, begin)
    upto = np.cumsum(freq)
    upto -= (upto - freq)[starts[lane]]
    plan = (np.arange(len(ids)) - starts[lane] | (upto - freq) << 16 | upto << 36).view(np.uint64)
    gaps = np.diff(ids, prepend=0) - 1
    gaps[begin] = ids[begin]
    freq -= 1
    planes = [x.astype(t) for t, shift in ((np.uint8, 0), ("<u2", 8)) for x in (gaps >> shift, freq >> shift)]
    out = []
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        table = struct.pack("<I", j - i) + TABLES.compress(b"".join([x[i:j].tobytes() for x in planes]), asbytes=True) if i < j else b""
        out.append((ids[i:j], plan[i:j], table))
    return bits, out


def unpack_frequencies(tables: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of distinct ids of blocks, all their ids and all their frequencies; a block without ids has id 0 alone."""
    counts = [struct.unpack_from("<I", t)[0] if t else 1 for t in tables]
    raw = [TABLES.decompress(t[4:], 6 * n, asbytes=True) if t else bytes(6) for t, n in zip(tables, counts, strict=True)]
    gaps, freq = (
        np.frombuffer(b"".join([r[k * n : (k + 1) * n] for r, n in zip(raw, counts, strict=True)]), np.uint8)
        + (np.frombuffer(b"".join([r[2 * (k + 1) * n : 2 * (k + 2) * n] for r, n in zip(raw, counts, strict=True)]), "<u2").astype(np.int64) << 8)
        + 1
        for k in (0, 1)
    )
    sizes = np.array(counts, np.int64)
    return sizes, _running(gaps, sizes) - 1, freq


def _running(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running totals of each block's values."""
    total = np.cumsum(values)
    before = np.r_[0, total][np.cumsum(sizes) - sizes]
    return total - np.repeat(before, sizes)


def _steps(sizes: np.ndarray):
    """Step, and lanes that still run in it; sizes fall."""
    ends = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), side="right")
    return enumerate(ends.tolist())


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of unsigned 32-bit ids as bytes: header with counts and CRC-32, then code and frequencies."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    n = len(order)
    longest = int(sizes[0]) if n else 0
    # symbol, first place and end of its places at each position: 16, 20 and 20 bits
    plan = np.zeros((longest, n), np.uint64)
    bits, tables, distinct = np.zeros(n, np.uint64), [], 0
    of = np.zeros(1 << 16, np.uint64)
    for k in range(0, n, TURNED):
        group = [blocks[i].astype(np.uint16) for i in order[k : k + TURNED]]
        bits[k : k + TURNED], counted = frequencies(group)
        some = np.zeros((len(group), longest), np.uint64)
        for row, own, (ids, own_plan, table) in zip(some, group, counted, strict=True):
            of[ids] = own_plan
            row[: len(own)] = of[own]
            tables.append(table)
            distinct = max(distinct, len(ids))
        plan[:, k : k + TURNED] = some.T
    m = Lanes(n)
    m.hold(distinct)
    words: list[np.ndarray] = []
    left: list[np.ndarray] = []
    p1, p2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
    place = np.uint64((1 << 20) - 1)
    for t, a in _steps(sizes):
        row = plan[t, :a]
        symbols = (row & LOW).view(np.int64)
        narrow = symbols.astype(m.type)
        guess, p, state = m.predict(a, p1[:a], p2[:a])
        hit = guess == narrow
        mid = m.split(a, p)
        step = m.x2[:a] - mid
        step >>= bits[:a]
        low = row >> W16
        low &= place
        m.narrow(hit, mid, step, low, row >> W36)
        more = True
        while more:
            leaving, more = m.leaving(a)
            words.append((m.x1[:a] >> W48).astype(np.uint16))
            left.append(leaving)
            some = leaving.astype(np.uint64)
            m.shift_some(some, some << np.uint64(4))
        m.update(state, narrow, hit, p)
        p2, p1 = p1, symbols
    out = np.zeros((n, len(words)), np.uint16)
    gone = np.zeros((n, len(words)), bool)
    for k in range(0, len(words), TURNED):
        for source, target in ((words, out), (left, gone)):
            part = np.zeros((min(TURNED, len(words) - k), n), target.dtype)
            for row, own in zip(part, source[k : k + TURNED], strict=True):
                row[: len(own)] = own
            target[:, k : k + len(part)] = part.T
    last = np.stack([(m.x1 >> np.uint64(48 - 16 * k)) & LOW for k in range(4)], axis=1).astype("<u2") if n else None
    stream = out[gone].astype("<u2", copy=False)
    bounds = np.cumsum([0, *np.count_nonzero(gone, axis=1)]).tolist()
    done: list[bytes] = [b""] * n
    for k, i in enumerate(order):
        code = stream[bounds[k] : bounds[k + 1]].tobytes() + last[k].tobytes()
        raw = blocks[i].astype("<u4")
        high = (raw >> 16).astype("<u2")
        high = zlib.compress(high.tobytes()) if high.any() else b""
        head = HEADER.pack(MAGIC, VERSION, len(raw), zlib.crc32(raw.tobytes()), len(code), len(tables[k]), len(high), 0)[:-4]
        body = code + tables[k] + high
        done[i] = head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body
    return done


def decode_blocks(data: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; ``ValueError`` where magic, length or a checksum is wrong."""
    heads = []
    for d in data:
        if len(d) < HEADER.size:
            raise ValueError("a block is cut short")
        magic, version, size, crc, length, table, more, body_crc = HEADER.unpack_from(d)
        body = d[HEADER.size :]
        if magic != MAGIC or version != VERSION or len(body) != length + table + more or zlib.crc32(body, zlib.crc32(d[: HEADER.size - 4])) != body_crc:
            raise ValueError("a block is damaged")
        heads.append((size, crc, body[:length], body[length : length + table], body[length + table :]))
    order = sorted(range(len(data)), key=lambda i: -heads[i][0])
    sizes = np.array([heads[i][0] for i in order], np.int64)
    n = len(order)
    longest = int(sizes[0]) if n else 0
    words = np.zeros((n, max([0, *(len(h[2]) // 2 for h in heads)]) + 4), np.uint16)
    for k, i in enumerate(order):
        words[k, : len(heads[i][2]) // 2] = np.frombuffer(heads[i][2], "<u2")
    distinct, symbols, freq = unpack_frequencies([heads[i][3] for i in order])
    known_base = np.cumsum(distinct) - distinct
    upto = _running(freq, distinct)
    # of each place, its symbol; of that, its first place and the end of its places
    slot = np.repeat((np.arange(len(symbols)) - np.repeat(known_base, distinct)).astype(np.uint16), freq)
    known = (upto - freq | upto << 32).view(np.uint64)
    sums = upto[known_base + distinct - 1].astype(np.uint64)
    slot_base = np.cumsum(sums) - sums
    # sums are powers of 2
    bits = (np.frexp(sums.astype(np.float64))[1] - 1).astype(np.uint64)
    symbols = symbols.astype(np.uint16)
    m = Lanes(n)
    m.hold(int(distinct.max(initial=0)))
    code = np.zeros(n, np.uint64)
    for k in range(4):
        code = code << W16 | words[:, k].astype(np.uint64)
    flat, read = words.reshape(-1), np.arange(n) * words.shape[1] + 4
    # four steps' symbols in a number, which makes them faster to turn
    symbols_at = np.zeros((-(-longest // 4), n), np.uint64)
    p1, p2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
    half, last = np.uint64((1 << 32) - 1), sums - ONE
    for t, a in _steps(sizes):
        guess, p, state = m.predict(a, p1[:a], p2[:a])
        mid = m.split(a, p)
        hit = code[:a] <= mid
        step = m.x2[:a] - mid
        step >>= bits[:a]
        at = code[:a] - mid
        at -= ONE
        at //= step
        np.minimum(at, last[:a], out=at)
        at += slot_base[:a]
        narrow = slot.take(at.view(np.int64), mode="clip").astype(m.type)
        row = known.take(known_base[:a] + narrow, mode="clip")
        m.narrow(hit, mid, step, row & half, row >> W32)
        narrow = np.where(hit, guess, narrow)
        more = True
        while more:
            leaving, more = m.leaving(a)
            some = leaving.astype(np.uint64)
            by = some << np.uint64(4)
            code[:a] <<= by
            # a lane that has read all its words has none leaving
            some_words = flat.take(read[:a], mode="clip") * some
            code[:a] |= some_words
            read[:a] += leaving
            m.shift_some(some, by)
        m.update(state, narrow, hit, p)
        p2, p1 = p1, narrow.astype(np.int64)
        symbols_at[t >> 2, :a] |= p1.view(np.uint64) << np.uint64(16 * (t & 3))
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for k, i in enumerate(order):
        if k % TURNED == 0:
            turned = np.ascontiguousarray(symbols_at[:, k : k + TURNED].T).astype("<u8", copy=False).view("<u2")
        out[i] = symbols[known_base[k] : known_base[k] + distinct[k]].take(turned[k % TURNED, : sizes[k]]).astype(np.uint32)
        if heads[i][4]:
            out[i] |= np.frombuffer(zlib.decompress(heads[i][4]), "<u2").astype(np.uint32) << 16
        if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][1]:
            raise ValueError("a block decodes to other ids")
    return out
