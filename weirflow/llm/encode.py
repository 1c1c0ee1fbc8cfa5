"""Token ids of whole texts, as the tokenizers library gives them for a vocabulary file.

The library's own speed is the cost of packing and token files, so the merges of a file
run in tiktoken, several times as fast, with tables built from that same file:

* a byte-level vocabulary maps to byte strings ranked by their ids;
* in one with word ends a pre-token carries a closing zero byte, and the first merges are
  those of a last byte with it.

Both need ids that ascend with the merges, which is checked on loading; pre-tokens are cut
as the file says. With word ends no token crosses ASCII white space, so texts fall into chunks there,
and a worker keeps the ids of short ones. Texts that hold a special token, chunks that hold one, a zero byte
or a code point that Unicode has not assigned, and all texts of other kinds of files, go to the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from itertools import compress, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .tokens import CACHED_BYTES, WordBpe, byte_symbols, certain

# Fixed value: the pattern of byte-level pre-tokens.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ends a word; texts that hold it go to the library.
WORD_END = "\0"
#: Ends a chunk of a text cut at ASCII white space, where chunks are encoded together.
CHUNK_END = "\n"
#: Chunks whose ids a worker keeps, some 150 bytes each, and their ids, 4 bytes each; all are dropped when there are more of either.
CACHE_ENTRIES, CACHE_IDS = 1_200_000, 8_000_000


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.fast, self.words = None, None
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or not model.get("merges"):
            return
        steps = [p["type"] for p in pre.get("pretokenizers", [])]
        if model.get("end_of_word_suffix"):
            if steps == ["Split", "ByteLevel"] and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
                self.fast = self._tables(model, rf"[^{WORD_END}]+{WORD_END}")
                self.words = WordBpe(path)
                self.special.append(WORD_END.encode())
                self.pattern = regex.compile(self.words.pattern.pattern + "|" + CHUNK_END)
                # no chunk holds the character, so its id ends one
                self.mark = model["vocab"][byte_symbols()[ord(CHUNK_END)] + model["end_of_word_suffix"]]
                # ids that end a pre-token
                self.closing = np.zeros(max(model["vocab"].values()) + 1, bool)
                self.closing[[i for v, i in model["vocab"].items() if v.endswith(model["end_of_word_suffix"])]] = True
                # number of each chunk; its ids lie in one array with those of all others
                self.cache: dict[bytes, int] = {}
                self._forget()
        elif pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.fast = self._tables(model, BYTE_LEVEL)

    @staticmethod
    def _tables(model: dict, pattern: str):
        """The vocabulary as tiktoken takes it, or None where its ids do not ascend with the merges."""
        import tiktoken

        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab[a + b] for a, b in pairs]
        back = {c: i for i, c in enumerate(byte_symbols())}
        single = {c + e: (bytes([i]) + (WORD_END.encode() if e else b"")) for e in {"", suffix} for c, i in back.items()}
        if any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or not single.keys() <= vocab.keys() or max(vocab[s] for s in single) >= ids[0]:
            return None
        ranks = {word: vocab[s] for s, word in single.items()}
        for (a, b), i in zip(pairs, ids, strict=True):
            end = bool(suffix) and b.endswith(suffix)
            ranks[bytes(back[c] for c in a + (b[: -len(suffix)] if end else b)) + (WORD_END.encode() if end else b"")] = i
        return tiktoken.Encoding("weirflow", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.fast is None or self.words is None:
            return [self._one(t) for t in texts]
        # ASCII texts in lower case, where that makes no special token: fewer chunks differ
        low = [low if t.isascii() and not self._special(low := t.lower()) else t for t in texts]
        split = pc.ascii_split_whitespace(pa.array(low, pa.binary()).view(pa.string()))
        flat = split.flatten().dictionary_encode()
        if not len(flat):
            return [b""] * len(texts)
        chunks = flat.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > CACHE_ENTRIES or self.ends[self.count] > 4 * CACHE_IDS:
            self.cache.clear()
            self._forget()
        numbers = np.fromiter(map(self.cache.get, chunks, repeat(-1)), np.int64, len(chunks))
        holes = np.flatnonzero(numbers < 0)
        new = [chunks[i] for i in holes.tolist()]
        numbers[holes] = self._learn(new)
        # the ids of all chunks are taken at once
        held = pa.Array.from_buffers(pa.large_binary(), self.count, [None, pa.py_buffer(self.ends), pa.py_buffer(self.ids)])
        _, ends, ids = held.take(pa.array(numbers[flat.indices.to_numpy()])).buffers()
        bounds = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()]
        ids = memoryview(ids) if ids else b""
        out = [bytes(ids[i:j]) for i, j in pairwise(bounds.tolist())]
        for c in new:
            if len(c) > CACHED_BYTES:
                del self.cache[c]
        return out

    def _special(self, text: bytes) -> bool:
        return any(s in text for s in self.special)

    def _forget(self) -> None:
        self.ids, self.ends, self.count = np.zeros(1 << 12, "<u4"), np.zeros(1 << 10, np.int64), 0

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Append the ids of chunks of these sizes; their numbers. Ends are those in bytes."""
        first, at = self.count, int(self.ends[self.count]) // 4
        self.count += len(sizes)
        for name, need in (("ids", at + len(ids)), ("ends", self.count + 1)):
            held = getattr(self, name)
            if need > len(held):
                grown = np.zeros(max(need, 2 * len(held)), held.dtype)
                grown[: len(held)] = held
                setattr(self, name, grown)
        self.ids[at : at + len(ids)] = ids
        self.ends[first + 1 : self.count + 1] = 4 * (at + np.cumsum(sizes))
        return np.arange(first, self.count)

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Put distinct chunks into the cache; plain ones are encoded together. Their numbers."""
        numbers = np.zeros(len(new), np.int64)
        if not new:
            return numbers
        plain, text, where = new, self._joined(new), np.arange(len(new))
        if self._special(text.encode()) or not certain(text):
            odd = np.array([self._special(c) or not certain(c.decode()) for c in new])
            for i in np.flatnonzero(odd).tolist():
                own = np.frombuffer(self._by_library(new[i].decode()), "<u4")
                numbers[i] = self._keep(own, np.array([len(own)]))[0]
            where = np.flatnonzero(~odd)
            plain = [new[i] for i in where.tolist()]
            text = self._joined(plain)
        if not text.isascii():
            # one character at a time: a final sigma stays as any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if plain:
            chunks = text.lower().split(CHUNK_END)[:-1]
            # a chunk of letters alone is one pre-token; the others are cut
            lone = np.fromiter(map(str.isalpha, chunks), bool, len(chunks))
            ids = self.fast.encode_to_numpy(WORD_END.join([*compress(chunks, lone.tolist()), ""]))
            numbers[where[lone]] = self._keep(ids, np.diff(np.flatnonzero(self.closing[ids]), prepend=-1))
            if not lone.all():
                cut = self.pattern.findall(CHUNK_END.join([*compress(chunks, (~lone).tolist()), ""]))
                ids = self.fast.encode_to_numpy(WORD_END.join(cut) + WORD_END)
                sizes = np.diff(np.flatnonzero(ids == self.mark), prepend=-1) - 1
                numbers[where[~lone]] = self._keep(ids[ids != self.mark], sizes)
        self.cache.update(zip(new, numbers.tolist(), strict=True))
        return numbers

    @staticmethod
    def _joined(chunks: list[bytes]) -> str:
        return CHUNK_END.encode().join(chunks).decode() + CHUNK_END

    def _by_library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _one(self, text: bytes) -> bytes:
        plain = text.decode()
        if self.fast is None or any(s in text for s in self.special):
            return self._by_library(plain)
        return self.fast.encode_to_numpy(plain).astype("<u4", copy=False).tobytes()


_loaded: dict[tuple[str, int], Encoder] = {}


def loaded(path: str) -> Encoder:
    """One encoder a worker process."""
    with open(path, "rb") as f:
        key = (path, zlib.crc32(f.read()))
    if key not in _loaded:
        _loaded[key] = Encoder(path)
    return _loaded[key]
