"""Token counts by rank-synchronous merging of ragged numpy arrays.

Texts fall into chunks at ASCII white space, which no token of a word-level BPE
crosses. Distinct chunks that are not yet counted are normalised and split into
pre-tokens, whose symbols lie in one flat array. Each round finds the lowest merge rank
of every pre-token, merges all occurrences of that pair in all pre-tokens at once, and
drops the pre-tokens that have none left; the surviving symbols are the tokens.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weirflow.shipping import ship

from .common import slices

NONE = np.int64(1 << 40)
#: Entries of the chunk cache, a worker; it is emptied when they are reached.
CACHE_ENTRIES = 400_000
#: Bytes of a chunk that stays in the cache.
CACHED_BYTES = 64
#: Text bytes handled at once.
BLOCK_BYTES = 1 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@cache
def assigned(char: str) -> bool:
    return unicodedata.category(char) != "Cn"


def certain(text: str) -> bool:
    """Whether pattern and lower case treat the text alike in every version of Unicode: code points not yet assigned may not."""
    return text.isascii() or all(map(assigned, set(text)))


class WordBpe:
    """A tokenizer file whose pre-tokens are words with an end mark, lower-cased and NFC."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        chars, suffix = byte_symbols(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cache: dict[bytes, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def pre_tokens(self, text: str) -> tuple[list[bytes], int]:
        """The pre-tokens of a chunk as bytes, and its number of special tokens."""
        parts = self.special.split(text) if self.special else [text]
        words = []
        for part in parts:
            if not certain(part):
                words += self.cut_by_library(part)
                continue
            if not part.isascii():
                # one character at a time: a final sigma stays as any other
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            words += [w.encode() for w in self.pattern.findall(part.lower())]
        return words, len(parts) - 1

    def cut_by_library(self, part: str) -> list[bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.back = {c: i for i, c in enumerate(byte_symbols())}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return [bytes(self.back[c] for c in w) for w, _ in found]

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token (none is empty)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.ones(len(words), np.int64)
        if not len(words):
            return out
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(sym), NONE)
        inside = word[:-1] == word[1:]
        rank[:-1][inside] = self.rank(sym[:-1][inside], sym[1:][inside])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            done = least == NONE
            out[word[starts[done]]] = sizes[done]
            if done.all():
                break
            live = np.repeat(~done, sizes)
            sym, word, rank = sym[live], word[live], rank[live]
            hit = rank == np.repeat(least[~done], sizes[~done])
            # of pairs that overlap, as in "aaa", every second merges, from the left
            run = hit & np.r_[False, hit[:-1]]
            if run.any():
                at = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~run, at, 0))
                hit &= (at - begin) % 2 == 0
            first = np.flatnonzero(hit)
            sym[first] = self.merged[rank[first]]
            keep = np.ones(len(sym), bool)
            keep[first + 1] = False
            sym, word, rank, new = sym[keep], word[keep], rank[keep], hit[keep]
            # only the pairs that touch a new symbol have new ranks
            touch = np.flatnonzero(new | np.r_[new[1:], False])
            rank[touch] = NONE
            pair = touch[touch + 1 < len(sym)]
            pair = pair[word[pair] == word[pair + 1]]
            rank[pair] = self.rank(sym[pair], sym[pair + 1])
        return out

    def learn(self, chunks: set[bytes]) -> list[bytes]:
        """Count the tokens of chunks that the cache does not hold, and return these."""
        new = [c for c in chunks if c not in self.cache]
        owner, words, base = [], [], []
        for i, c in enumerate(new):
            w, special = self.pre_tokens(c.decode("utf-8", "replace"))
            words += w
            owner += [i] * len(w)
            base.append(special)
        total = np.array(base, np.int64)
        np.add.at(total, np.array(owner, np.int64), self.count_words(words))
        self.cache.update(zip(new, total.tolist(), strict=True))
        return new

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of whole texts in UTF-8."""
        out: list[int] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK_BYTES):
                size += len(texts[j])
                j += 1
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
            split = [t.split() for t in texts[i:j]]
            new = self.learn(set().union(*split))
            get = self.cache.__getitem__
            out += [sum(map(get, chunks)) for chunks in split]
            for c in new:
                if len(c) > CACHED_BYTES:
                    del self.cache[c]
            i = j
        return out


_loaded: dict[tuple[str, int], WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One tokenizer a worker process, whose cache its later tasks find filled."""
    with open(path, "rb") as f:
        key = (path, zlib.crc32(f.read()))
    if key not in _loaded:
        _loaded[key] = WordBpe(path)
    return _loaded[key]


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, in one map pass without a shuffle.

    A null or empty text has no bytes and no tokens. Repeated rows are counted each, texts
    of any length whole; other columns are ignored, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for b in slices(batches):
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            n = bpe.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    ship(docs.sparkSession)
    d = docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text")
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
