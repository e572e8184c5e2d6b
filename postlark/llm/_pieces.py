"""Texts cut into pieces by kinds of bytes, and pieces looked up once: what both tokenizers share.

Letters of ASCII and of Latin-1, digits and signs are told apart by their bytes. A unit, what stands
between blanks, with any other byte in it (or an apostrophe, which may begin a contraction) stays in one
piece, for the tokenizer's own rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from ._text import SEPARATOR

BLANK, LETTER, DIGIT, SIGN, HARD, END = range(6)
_KIND = np.full(256, HARD, np.uint8)
_KIND[33:127] = SIGN
_KIND[48:58] = DIGIT
_KIND[65:91] = _KIND[97:123] = _KIND[0xC3] = LETTER
_KIND[ord("'")] = HARD
_KIND[SEPARATOR] = BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text cut at once; a longer text is taken in parts.
PART_BYTES = 2 << 20


def parts(texts: list[bytes], most: int = PART_BYTES) -> Iterator[tuple[list[bytes], list[int]]]:
    """Lists of about ``most`` bytes, and each part's text: long texts are cut before a blank between two letters or digits."""
    held: list[bytes] = []
    owner: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > 2 * most:
            cut = at + most
            while 0 < (cut := text.find(b" ", cut)) < len(text) - 1 and not (text[cut - 1 : cut].isalnum() and text[cut + 1 : cut + 2].isalnum()):
                cut += 1
            if not at < cut < len(text) - 1:
                break
            yield [*held, text[at:cut]], [*owner, i]
            held, owner, size, at = [], [], 0, cut
        held.append(text[at:] if at else text)
        owner.append(i)
        size += len(held[-1]) + 1
        if size >= most:
            yield held, owner
            held, owner, size = [], [], 0
    if held:
        yield held, owner


def kinds(texts: list[bytes], hard: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All bytes, an END after each text, and their kinds. Where the two bytes ``hard`` follow each other, the unit is HARD too."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = _KIND[raw]
    lead = np.flatnonzero(raw == 0xC3)
    letters = (raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)
    kind[lead[letters] + 1] = LETTER
    kind[lead[~letters]] = HARD
    if hard:
        kind[np.flatnonzero((raw[:-1] == hard[0]) & (raw[1:] == hard[1]))] = HARD
    kind[np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1] = END
    if (kind == HARD).any():
        inside = (kind != BLANK) & (kind != END)
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        odd = np.logical_or.reduceat(kind == HARD, start)
        mark = np.zeros(len(raw), np.int8)
        mark[start[odd]] = 1
        mark[stop[odd]] = -1
        kind[np.cumsum(mark, dtype=np.int8).view(bool)] = HARD
    return raw, kind


def lowered(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Lower case of all letters outside HARD units."""
    out = _LOWER[raw]
    second = np.flatnonzero(raw == 0xC3) + 1
    second = second[raw[second] <= 0x9E]
    out[second] += 0x20
    return np.where(kind == HARD, raw, out)


def distinct(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The pieces of data from each start to the next: each one's number among the distinct ones, and those."""
    offsets = np.append(start, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return pieces.indices.to_numpy(), pieces.dictionary.to_pylist()


class Interned:
    """Ids of pieces: each piece's number, and its ids' place in one array.

    ``trim`` brings over ``most`` pieces down to at most half as many: those that several lookups wanted.
    """

    def __init__(self, most: int):
        self.most = most
        self._empty(1 << 14, 1 << 16)

    def _empty(self, pieces: int, ids: int) -> None:
        self.number: dict[bytes, int] = {}
        self.start, self.size, self.uses, self.flat = np.zeros(pieces, np.int64), np.zeros(pieces, np.int64), np.zeros(pieces, np.int32), np.zeros(ids, np.int32)
        self.used = 0

    def trim(self) -> None:
        if len(self.number) <= self.most and self.used <= 8 * self.most:
            return
        uses, size, often = self.uses[: len(self.number)], self.size[: len(self.number)], 2
        while (uses >= often).sum() > self.most // 2 or size[uses >= often].sum() > 4 * self.most:
            often += 1
        kept = np.flatnonzero(uses >= often)
        names = list(self.number)
        names, uses, (ids, sizes) = [names[i] for i in kept.tolist()], uses[kept], self.gather(kept)
        self._empty(len(self.start), len(self.flat))
        self.add(names, ids, sizes)
        self.uses[: len(names)] = uses // 2

    def missing(self, pieces: Iterable[bytes]) -> list[bytes]:
        number = self.number
        return [p for p in pieces if p not in number]

    def add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New pieces; ids: those of all, one piece after the other."""
        first, n, used = len(self.number), len(pieces), self.used
        while first + n > len(self.start):
            self.start, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.uses))
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.number.update(zip(pieces, range(first, first + n), strict=True))
        self.flat[used : used + len(ids)] = ids
        self.start[first : first + n] = used + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.used += len(ids)

    def of(self, piece: bytes) -> np.ndarray:
        k = self.number[piece]
        return self.flat[self.start[k] : self.start[k] + self.size[k]]

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """Of distinct pieces."""
        out = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        self.uses[out] += 1
        return out

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces by number, one after the other, and how many each has."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        place = np.repeat(self.start[numbers] - ends + size, size)
        place += np.arange(len(place))
        return self.flat[place], size
