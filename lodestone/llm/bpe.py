"""BPE encoding of Arrow text columns with the ``tokenizers`` library.

A BPE tokenizer works on each pre-token by itself, and corpora repeat their pre-tokens. Texts whose characters lie
below U+0250 are split here with numpy by the pre-tokenizer's rules, equal pre-tokens are found by Arrow's dictionary
encoding, and the library's model encodes each pre-token that the worker hasn't met before. All other texts, and those
that hold a special token's string, go to the library whole. Both ways give the library's ids.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOP = 0x250
LETTER, NUMBER, OTHER, SPACE, BLANK = 1, 2, 3, 4, 5
#: Characters below TOP on whose class or lower case libraries differ, and white space of two bytes: these texts go to the library.
UNSURE = {*range(0x1C, 0x20), 0x85, 0xA0, 0x130}
#: Bytes of text that are split at once, and pre-tokens kept by a worker.
CHUNK, KEPT = 2 << 20, 300_000


def _classes() -> np.ndarray:
    out = np.zeros(0x280, np.uint8)
    for c in range(TOP):
        kind = unicodedata.category(chr(c))[0]
        out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        if c == 0x20:
            out[c] = SPACE
        elif c in range(9, 14):
            out[c] = BLANK
        if c in UNSURE:
            out[c] = 0
    return out


BY_CHAR = _classes()
BY_BYTE = np.zeros(256, np.uint8)
BY_BYTE[:128] = BY_CHAR[:128]
BY_BYTE[0x80:0xCA] = OTHER  # set by its character later


def _byte_letters() -> list[str]:
    """The character by which byte-level BPE writes each byte: printable ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(other)) for b in range(256)]


def classes(b: np.ndarray) -> np.ndarray:
    """The class of each byte's character; 0: not below TOP, or unsure."""
    c = BY_BYTE[b]
    lead = np.flatnonzero((b >= 0xC2) & (b < 0xCA))
    if len(lead):
        k = BY_CHAR[((b[lead] & 0x1F).astype(np.uint16) << 6) | (b[lead + 1] & 0x3F)]
        c[lead] = k
        c[lead + 1] = k
    return c


def split(b: np.ndarray, c: np.ndarray, bounds: np.ndarray, spaced: bool) -> np.ndarray:
    """Where pre-tokens start. spaced: a space belongs to the run after it (byte level); else white space is apart and each digit is alone."""
    first = np.zeros(len(b) + 4, bool)
    first[bounds] = True
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[first[: len(c)]] = 0
    ws, was = c >= SPACE, before >= SPACE
    if spaced:
        after = np.empty_like(c)
        after[:-1] = c[1:]
        after[first[1 : len(c) + 1]] = SPACE
        start = np.where(ws, ~was | (after < SPACE), (before == BLANK) | (~was & (c != before)))
    else:
        start = np.where(ws, ~was, was | (c != before) | ((c == NUMBER) & ((b & 0xC0) != 0x80)))
    start |= first[: len(c)]
    at = np.flatnonzero(start & (b == 0x27))
    if len(at):  # 's 't 'm 'd 're 've 'll
        low = np.concatenate([b, np.zeros(3, np.uint8)])
        fold = 0 if spaced else 0x20
        x, y = low[at + 1] | fold, low[at + 2] | fold
        two = np.isin(x, np.frombuffer(b"stmd", np.uint8)) & ~first[at + 1]
        three = (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & ~first[at + 1] & ~first[at + 2]
        size = np.where(two, 2, np.where(three, 3, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        end = at + size
        start[end[end < len(b)]] = True
    return np.flatnonzero(start)


class Encoder:
    """One tokenizer file in one process, with the pre-tokens met so far."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.special = [x["content"] for x in spec["added_tokens"]]
        #: Byte level without a normalizer; else white space dropped and lower case.
        self.spaced = spec["normalizer"] is None
        self.letters = dict(enumerate(_byte_letters()))
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _piece(self, w: bytes) -> bytes:
        if not self.spaced:
            if w[0] in b"\t\n\v\f\r ":
                return b""
            w = w.decode().lower().encode()
        got = self.model.tokenize(w.decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(got)}I", *[x.id for x in got])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: the first one's position, all their ids, and the offsets of each text's ids."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        i = 0
        while i < len(texts):
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            yield i, *self._chunk(texts.slice(i, j - i), sizes[i:j])
            i = j

    def _chunk(self, texts: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        b, c = self._bytes(texts, bounds[-1])
        odd = np.zeros(n, bool)
        at = np.flatnonzero(c == 0)
        odd[np.searchsorted(bounds, at, "right") - 1] = True
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        apart = {int(k): self._whole(texts[int(k)].as_py()) for k in np.flatnonzero(odd)}
        if apart:
            texts = texts.filter(pa.array(~odd))
            sizes = np.where(odd, 0, sizes)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            b, c = self._bytes(texts, bounds[-1])
        ids, offsets = self._fast(b, c, bounds)
        if apart:
            parts = [apart[k] if k in apart else ids[offsets[k] : offsets[k + 1]] for k in range(n)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            ids = np.concatenate(parts)
        return ids, offsets

    @staticmethod
    def _bytes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts) or not n:
            return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        _, offsets, data = texts.buffers()
        first = np.frombuffer(offsets, np.int64)[texts.offset]
        b = np.frombuffer(data, np.uint8)[first : first + n]
        return b, classes(b)

    def _fast(self, b: np.ndarray, c: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(b):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        starts = split(b, c, bounds[:-1][np.diff(bounds) > 0], self.spaced)
        ends = np.append(starts, len(b)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(b)]).dictionary_encode()
        which, names = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > KEPT:
            self.known.clear()
        got = list(map(self.known.get, names))
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    got[k] = self.known[names[k]] = self._piece(names[k])
        flat = np.frombuffer(b"".join(got), "<u4")
        sizes = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        off = np.cumsum(sizes) - sizes
        each = sizes[which]
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(off[which] - upto[:-1], each) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, bounds)]


def release() -> None:
    """Give back the memory of this worker's encoders: Python workers are used again by other operators, which don't need them."""
    if Encoder._open:
        Encoder._open.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
