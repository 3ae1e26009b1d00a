"""Words of many texts at once: where they lie in some bytes, and checksums of them."""

from __future__ import annotations

import numpy as np

BLANKS = b" \t\n\r\x0b\x0c"  # what ``bytes.split`` cuts at
LONG_WORD = 32  # bytes from which on a word is hashed by itself


def crc_table(polynomial: int, kind: type) -> np.ndarray:
    """What a checksum makes of each byte."""
    table = np.arange(256, dtype=kind)
    for _ in range(8):
        table = (table >> kind(1)) ^ np.where(table & kind(1), kind(polynomial), kind(0))
    return table


CRC32 = crc_table(0xEDB88320, np.uint32)  # zlib's
CRC64 = crc_table(0xC96C5795D7870F42, np.uint64)  # xz's


def crc_of(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Checksums of many short stretches of bytes, a byte of each at a time."""
    order = np.argsort((-sizes).astype(np.int16), kind="stable")  # the longest first
    begin = starts[order]
    crc = np.full(len(starts), np.iinfo(table.dtype).max, dtype=table.dtype)
    longer = len(sizes) - np.cumsum(np.bincount(sizes))
    for at, many in enumerate(longer[:-1].tolist()):  # stretches that have a byte there
        own = crc[:many]
        crc[:many] = table[own.astype(np.uint8) ^ symbols[begin[:many] + at]] ^ (own >> table.dtype.type(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


def word_bounds(blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; the first and the last byte are blank."""
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return turns[::2], turns[1::2]


def words_by_text(starts: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """Number of each text's first word, and of all words; a byte lies before every part."""
    return np.searchsorted(starts, np.cumsum([1, *(len(p) + 1 for p in parts)]))
