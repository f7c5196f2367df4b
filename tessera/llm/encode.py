"""Token ids of whole texts by a tokenizers file, through a bounded cache of chunks.

A text is cut where no token of the public byte-level and word-level BPE files can lie across: before white space that follows other characters, after a single
line feed, between letters and ASCII punctuation, and between Chinese characters and their punctuation. Chunks are found and looked up by 64-bit hashes, all at once for
a slice of texts; the library encodes those
that aren't in the cache. No cut touches white space other than blanks and line feeds. Special tokens' strings are
ordinary text."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers

from tessera.llm.common import MIXERS, powers, mix

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
SLOTS, WIDTH = 1 << 19, 10  # of the cache; chunks of more ids are encoded again in each slice
LONGEST = 1 << 21
#: White space, or what some call so, besides blanks and line feeds.
OTHERS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Chinese characters that every version of the character tables has as letters, and the punctuation between them: none changes in lower case or NFC.
HAN, HAN_POINTS = ("\u4e00", "\u9fa5"), "\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f\u300c\u300d\u300e\u300f\u300a\u300b\uff08\uff09"
_HAN_POINTS = np.array([ord(c) for c in HAN_POINTS], np.uint32)
#: Before white space that follows other characters, where no token can lie across.
BREAK = re.compile(f"(?<=[^ \n{OTHERS}])[ \n]")
#: Classes of code points: letters whose lower case and NFC are letters (none from U+0250 up, and not U+0130), ASCII punctuation without apostrophes and hyphens, white space.
LETTER, POINT, BLANK, FEED = 1, 2, 3, 4
_CLASS = np.zeros(0x251, np.uint8)
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x130), (0x131, 0x250)):
    _CLASS[_a:_b] = LETTER
for _c in ".,!?|*%$#&;:()":
    _CLASS[ord(_c)] = POINT
_CLASS[0x20], _CLASS[0x0A] = BLANK, FEED
_CODE = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, 0x251, np.uint64)
_OTHER = np.zeros(0x251, bool)
_OTHER[[ord(c) for c in OTHERS if ord(c) < 0x250]] = True
_FAR_OTHER = np.array([ord(c) for c in OTHERS if ord(c) >= 0x250], np.uint32)


def _byte_letters() -> list[str]:
    """The letter by which byte-level BPE files write each byte: printable Latin-1 as itself, the others from U+0100 up."""
    itself = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in itself else chr(next(others)) for b in range(256)]


_WRITTEN = {b: c for b, c in enumerate(_byte_letters())}


class Encoder:
    def __init__(self, path: str, slots: int = SLOTS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        state = lambda part: json.loads(part.__getstate__()) if part else {}
        before, cut = state(self.tokenizer.normalizer), json.dumps(state(self.tokenizer.pre_tokenizer))
        kinds = {n["type"] for n in before.get("normalizers", [before] if before else [])}
        self.words = type(self.tokenizer.model).__name__ == "BPE" and "ByteLevel" in cut and kinds <= {"NFC", "Replace", "Lowercase"}  # runs of letters can go to the model itself
        self.lower, self.drop = "Lowercase" in kinds, "Removed" in cut
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.keys, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.uint8)
        self.flat, self.local = np.zeros(slots * WIDTH + (1 << 18), np.uint32), slots * WIDTH  # ids by slot, then those of the slice at hand

    def direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _written(self, word: str) -> str:
        """A run of letters as the model sees it (these letters are their own NFC)."""
        if self.lower:
            word = word.lower()
        if word[0] == " ":
            word = word[1:] if self.drop else _WRITTEN[32] + word[1:].encode().decode("latin-1").translate(_WRITTEN)
        return word if word.isascii() or word[0] == _WRITTEN[32] else word.encode().decode("latin-1").translate(_WRITTEN)

    def _learn(self, chunks: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and their numbers."""
        tokenize, written = self.tokenizer.model.tokenize, self._written
        ids: list[list[int]] = [[t.id for t in tokenize(written(c))] if p else [] for c, p in zip(chunks, plain.tolist(), strict=True)]
        rest = np.flatnonzero(~plain)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for k, e in zip(some, self.tokenizer.encode_batch([chunks[k] for k in some], add_special_tokens=False), strict=True):
                ids[k] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def chunks(self, values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all chunks of some texts: where each begins among their characters, where its ids begin in self.flat and their number; and each text's first chunk (with an end)."""
        text = "".join(values)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))])
        if not n:
            return (e := np.zeros(0, np.int64)), e, e, np.zeros(len(offsets), np.int64)
        low = np.minimum(code, 0x250)
        kind = _CLASS[low]
        blank = kind >= BLANK
        other = _OTHER[low]
        far = np.flatnonzero(code >= 0x250)
        other[far[np.isin(code[far], _FAR_OTHER)]] = True
        space = blank | other
        cut = np.zeros(n + 1, bool)
        cut[1:-1] = blank[1:] & ~space[:-1]  # before white space
        cut[1:-1] |= ((kind[:-1] == LETTER) & (kind[1:] == POINT)) | ((kind[:-1] == POINT) & (kind[1:] == LETTER))
        cut[2:-1] |= (kind[1:-1] == FEED) & ~space[2:] & ~space[:-2]  # after a single line feed
        if len(far):
            han = (code >= ord(HAN[0])) & (code <= ord(HAN[1]))
            point = np.zeros(n, bool)
            point[far] = np.isin(code[far], _HAN_POINTS)
            cut[1:-1] |= (han[:-1] & point[1:]) | (point[:-1] & han[1:])
        cut[offsets] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        value = _CODE[low]
        if len(far):
            value[far] = mix(code[far].astype(np.uint64) * MIXERS[0])
        power, inverse = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value * power[:n], out=total[1:])
        h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)) | np.uint64(1)
        slot = (h >> self.shift).astype(np.int64)
        sizes = self.size[slot].astype(np.int64)
        begin = slot * WIDTH
        miss = np.flatnonzero(self.keys[slot] != h)
        if len(miss):
            u, first, inverse_ = np.unique(h[miss], return_index=True, return_inverse=True)
            a, b = start[miss[first]], end[miss[first]]
            odd = np.concatenate([[0], np.cumsum(kind != LETTER)])
            plain = (odd[b] - odd[np.minimum(b, a + (kind[a] == BLANK))] == 0) & (b - a > (kind[a] == BLANK)) if self.words else np.zeros(len(u), bool)
            ids, own = self._learn([text[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], plain)
            if self.local + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(ids), np.uint32)])
            self.flat[self.local : self.local + len(ids)] = ids
            at = np.cumsum(own) - own
            sizes[miss], begin[miss] = own[inverse_], self.local + at[inverse_]
            keep = np.flatnonzero(own <= WIDTH)
            into = (u[keep] >> self.shift).astype(np.int64)
            into, last = np.unique(into, return_index=True)  # one chunk for each slot
            self._later = (into, u[keep][last], own[keep][last], at[keep][last], ids)
        return start, begin, sizes, np.searchsorted(start, offsets)

    def _remember(self) -> None:
        """Put what the last slice learned into the cache, once its ids are read."""
        if self._later is not None:
            into, keys, own, at, ids = self._later
            self.keys[into], self.size[into] = keys, own
            self.flat[np.repeat(into * WIDTH - (np.cumsum(own) - own), own) + np.arange(own.sum())] = ids[np.repeat(at - (np.cumsum(own) - own), own) + np.arange(own.sum())]
            self._later = None

    _later = None

    def counted(self, values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each chunk of some texts begins among their characters, its number of ids, and each text's first chunk (with an end)."""
        start, _, sizes, first = self.chunks(values)
        self._remember()
        return start, sizes, first

    def count(self, text: str) -> int:
        """Number of ids of a text."""
        return int(self.counted([text])[1].sum())

    def encode(self, values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each text begins (with an end)."""
        parts: list[list[str]] = [[]]
        ends = np.zeros(len(values) + 1, np.int64)  # texts' ends among the parts
        held, n = 0, 0
        for k, v in enumerate(values):
            for x in _pieces(v) if v else ():
                if held + len(x) > LONGEST and parts[-1]:
                    parts.append([])
                    held = 0
                parts[-1].append(x)
                held, n = held + len(x), n + 1
            ends[k + 1] = n
        out, at = [], [0]
        for some in parts:
            _, begin, sizes, first = self.chunks(some)
            before = np.concatenate([[0], np.cumsum(sizes)])
            out.append(self.flat[np.repeat(begin - before[:-1], sizes) + np.arange(before[-1])])
            at += (before[first[1:]] + at[-1]).tolist()
            self._remember()
        return np.concatenate(out), np.array(at)[ends]


def _pieces(text: str) -> list[str]:
    """A very long text cut before white space, into pieces that can be encoded alone."""
    out, at = [], 0
    while len(text) - at > LONGEST and (m := BREAK.search(text, at + LONGEST // 2)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(values: list[str | None], most: int = 1 << 20):
    """Ranges of values with about so many characters."""
    at = held = 0
    for k, v in enumerate(values):
        held += len(v or "") + 1
        if held >= most:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(values):
        yield at, len(values)
