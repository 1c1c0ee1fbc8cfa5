"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter a language shares positions with all others: a slot holds a bit for
each language, so the AND of an n-gram's few slots is the mask of all languages that
contain it. The set bits of a text's masks are counted by language, corrected for the
filter's false positives, and the language with the largest count decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.shipping import ship

from .common import slices

NGRAM = 4
#: Least number of slots of the filter (as a power of two), slots for each n-gram of the largest language, probes of an n-gram.
SLOT_BITS, ROOM, PROBES = 18, 12, 3
#: Labelled documents a language that the fit samples, languages at most.
SAMPLE, LANGUAGES = 3000, 512
#: Share of a language's sampled documents that must hold an n-gram; so a language has no more n-grams than 100 times a document of its.
LEAST_SHARE = 0.01
#: Characters handled at once.
BLOCK_CHARS = 1 << 19
UNKNOWN = "und"
MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def blocks(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """Code points of the lower-cased text with each run of non-letters as one space, and whether there is a letter, block by block.

    A space is put before and behind the whole text. Each block begins with the last ``NGRAM`` - 1 code
    points of the one before, so the blocks' n-grams are those of the whole text, each once.
    """
    tail, after_letter = np.array([32], np.uint32), False
    for begin in range(0, max(len(text), 1), BLOCK_CHARS):
        # a capital sigma is lower-cased by its neighbours, which may lie in another block
        piece = text[begin : begin + BLOCK_CHARS].replace("\u03a3", "\u03c3").lower()
        c = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        is_letter = letters()[c]
        before = np.r_[after_letter, is_letter[:-1]] if len(c) else np.zeros(0, bool)
        new = np.where(is_letter, c, np.uint32(32))[is_letter | before]
        if len(c):
            after_letter = bool(is_letter[-1])
        last = begin + BLOCK_CHARS >= len(text)
        whole = np.concatenate([tail, new, np.array([32] if last and after_letter else [], np.uint32)])
        yield whole, bool(is_letter.any())
        tail = whole[-(NGRAM - 1) :]


def ngrams(c: np.ndarray) -> np.ndarray:
    """A 64-bit value of each n-gram of code points (21 bits each, the first wrapping around)."""
    if len(c) < NGRAM:
        return np.zeros(0, np.uint64)
    n = len(c) - NGRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(NGRAM):
        h = (h ^ c[k : k + n]) * MIX[0]
        h ^= h >> np.uint64(29)
    return h


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    a, b = h * MIX[1], h * MIX[2] | np.uint64(1)
    shift = np.uint64(64 - bits)
    return [((a + np.uint64(k) * b) >> shift).astype(np.int64) for k in range(PROBES)]


@dataclass(frozen=True)
class Model:
    """``masks``: 64 languages a row, a bit each for every slot."""

    langs: tuple[str, ...]
    masks: np.ndarray
    false_rate: np.ndarray
    usual: str

    @staticmethod
    def of(langs: list[str], grams: dict[str, list[int]], usual: str) -> Model:
        bits = max(SLOT_BITS, (ROOM * max(map(len, grams.values()), default=0)).bit_length())
        masks = np.zeros((-(-len(langs) // 64) or 1, 1 << bits), np.uint64)
        rate = np.zeros(len(langs))
        for i, lang in enumerate(langs):
            bit = np.uint64(1 << i % 64)
            for s in slots(np.array(grams.get(lang, []), np.int64).view(np.uint64), bits):
                masks[i // 64][s] |= bit
            rate[i] = np.mean(masks[i // 64] & bit != 0) ** PROBES
        return Model(tuple(langs), masks, rate, usual)

    def counts(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Masks' set bits by segment (a row each; none may be empty) and language."""
        out = np.zeros((len(starts), len(self.langs)), np.int64)
        at = slots(h, self.masks.shape[1].bit_length() - 1)
        for w, row in enumerate(self.masks):
            mask = row[at[0]]
            for s in at[1:]:
                mask &= row[s]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                bits = (mask >> np.uint64(i % 64) & np.uint64(1)).astype(np.uint8)
                out[:, i] = np.add.reduceat(bits, starts, dtype=np.int64)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        n_langs = len(self.langs)
        hits, total = np.zeros((len(texts), n_langs), np.int64), np.zeros(len(texts), np.int64)
        any_letter = np.zeros(len(texts), bool)
        held: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                sizes = np.array([len(x) for x in held])
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                np.add.at(hits, owner, self.counts(np.concatenate(held), starts))
                np.add.at(total, owner, sizes)
            held.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            for c, has in blocks(text or ""):
                any_letter[i] |= has
                h = ngrams(c)
                if len(h):
                    held.append(h)
                    owner.append(i)
                    size += len(h)
                if size >= BLOCK_CHARS:
                    flush()
        flush()
        if not n_langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        true = np.maximum(0.0, (hits - total[:, None] * self.false_rate) / (1 - self.false_rate))
        best = true.argmax(axis=1)
        score = np.clip(true[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        return [
            (UNKNOWN, 0.0) if not has else (self.langs[b] if s > 0 else self.usual, s)
            for has, b, s in zip(any_letter.tolist(), best.tolist(), score.tolist(), strict=True)
        ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from about ``sample`` texts of each language, chosen by a hash of the id.

    All of ``docs`` is for learning; rows without language, text or id are left out.
    An n-gram belongs to a language if ``LEAST_SHARE`` of its sampled texts, and two,
    hold it (one where a language has a single text), and all such are kept. More than
    ``LANGUAGES`` distinct languages raise ``ValueError``.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        "i is not null and text is not null and lang is not null"
    )
    counts = {r.lang: r.n for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return Model.of([], {}, UNKNOWN)
    steps = 1 << 30
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(steps, steps * sample // n))])
    some = d.filter(F.pmod(F.xxhash64("i"), F.lit(steps)) < shares[F.col("lang")])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at=0):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.unique(np.concatenate([np.unique(ngrams(c)) for c, _ in blocks(text)]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([lang] * len(h), pa.string())], ["gram", "lang"])

    sizes = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(2, n, sample))])
    texts = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, float(min(n, sample)))])
    frequent = (
        some.select("text", "lang")
        .mapInArrow(grams, "gram long, lang string")
        .groupBy("gram", "lang")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") >= sizes[F.col("lang")]) & (F.col("n") >= LEAST_SHARE * texts[F.col("lang")]))
    )
    found: dict[str, list[int]] = {}
    for r in frequent.select("gram", "lang").collect():
        found.setdefault(r.lang, []).append(r.gram)
    return Model.of(sorted(counts), found, max(sorted(counts), key=counts.get))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, in one map pass.

    A null text, or one without a letter, is ``und`` with score 0. The score is the share
    of the text's n-grams that the language holds. A text without any known n-gram gets
    the language with the most labelled texts and score 0; a model without languages
    says ``und``. Repeated rows are judged alike, texts of any length by all their n-grams;
    other columns are ignored, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.05) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language: neither ``und`` nor under ``least_score``.

    Rows stream through whole, without a shuffle. A model without languages keeps all
    texts that have a letter.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at=at):
            texts = b.column(at).to_pylist()
            if model.langs:
                keep = [lang != UNKNOWN and score >= least_score for lang, score in model.predict(texts)]
            else:
                keep = [any(map(str.isalpha, t or "")) for t in texts]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
