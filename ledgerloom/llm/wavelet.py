"""A wavelet matrix of token ids: one compressed byte string with rank and select.

Level by level, from the highest bit, the ids' bits are stored as a plane and the
ids are stably parted by it, zeros first. A plane is cut into blocks that are
compressed one by one (zstd, or raw where that is smaller) and carries the number
of ones before each block, so ``access``, ``rank`` and ``select`` touch one block
of each plane.

Layout: a header of eight little-endian 64-bit integers (magic, ids, levels,
documents, block bytes, three reserved), the zeros of each level, the compressed
document table (ids and lengths), and for each level the block offsets, the ones
before each block and the blocks.
"""

from __future__ import annotations

import numpy as np
import zstandard

MAGIC = 0x314D_574C
BLOCK = 1 << 15  # bytes of a plane in a block


def _packed(raw: bytes) -> bytes:
    small = zstandard.ZstdCompressor(level=1).compress(raw)
    return b"\x01" + small if len(small) < len(raw) else b"\x00" + raw


def _unpacked(kept: bytes) -> bytes:
    body = bytes(kept[1:])
    return zstandard.ZstdDecompressor().decompress(body) if kept[0] else body


def build(ids: np.ndarray, doc_ids: np.ndarray, doc_tokens: np.ndarray) -> bytes:
    """The file of a shard: ``ids`` of all its documents, in their order."""
    top = int(ids.max()) if len(ids) else 0
    levels = max(1, top.bit_length())
    cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    zeros, planes = [], []
    for level in range(levels):
        ones = (cur & cur.dtype.type(1 << (levels - 1 - level))).astype(bool)
        plane = np.packbits(ones, bitorder="little")
        blocks = [plane[i : i + BLOCK] for i in range(0, len(plane), BLOCK)]
        sums = np.cumsum([0, *(int(np.bitwise_count(b).sum()) for b in blocks)])
        kept = [_packed(b.tobytes()) for b in blocks]
        offsets = np.cumsum([0, *map(len, kept)])
        planes.append(
            offsets.astype("<i8").tobytes() + sums.astype("<i8").tobytes() + b"".join(kept)
        )
        rest = cur[~ones]
        zeros.append(len(rest))
        cur = np.concatenate([rest, cur[ones]])
    docs = _packed(
        np.asarray(doc_ids, dtype="<i8").tobytes() + np.asarray(doc_tokens, dtype="<i8").tobytes()
    )
    header = np.array([MAGIC, len(ids), levels, len(doc_ids), BLOCK, len(docs), 0, 0], dtype="<i8")
    starts = np.cumsum([0, *map(len, planes)]).astype("<i8")
    return b"".join(
        [header.tobytes(), np.array(zeros, dtype="<i8").tobytes(), starts.tobytes(), docs, *planes]
    )


class WaveletMatrix:
    """Reads a file of ``build`` without unpacking more than it needs."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        head = np.frombuffer(self.data[:64], dtype="<i8")
        if head[0] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, self.levels, self.n_docs, self.block, docs = (int(x) for x in head[1:6])
        at = 64
        self.zeros = np.frombuffer(self.data[at : at + 8 * self.levels], dtype="<i8")
        at += 8 * self.levels
        starts = np.frombuffer(self.data[at : at + 8 * (self.levels + 1)], dtype="<i8")
        at += 8 * (self.levels + 1)
        self._docs = self.data[at : at + docs]
        at += docs
        self.n_blocks = -(-(-(-self.n // 8)) // self.block)
        self.planes = [self.data[at + int(a) : at + int(b)] for a, b in zip(starts, starts[1:])]
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and token counts of the documents, in their order."""
        both = np.frombuffer(_unpacked(self._docs), dtype="<i8")
        return both[: self.n_docs], both[self.n_docs :]

    def _directory(self, level: int) -> tuple[np.ndarray, np.ndarray, int]:
        size = 8 * (self.n_blocks + 1)
        plane = self.planes[level]
        offsets = np.frombuffer(plane[:size], dtype="<i8")
        return offsets, np.frombuffer(plane[size : 2 * size], dtype="<i8"), 2 * size

    def _bits(self, level: int, block: int) -> np.ndarray:
        if (level, block) not in self._held:
            offsets, _, base = self._directory(level)
            raw = self.planes[level][base + int(offsets[block]) : base + int(offsets[block + 1])]
            bits = np.unpackbits(np.frombuffer(_unpacked(raw), dtype=np.uint8), bitorder="little")
            if len(self._held) >= 4 * self.levels:
                self._held.clear()
            self._held[level, block] = bits
        return self._held[level, block]

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before position ``at``."""
        block, rest = divmod(at, 8 * self.block)
        sums = self._directory(level)[1]
        return int(sums[block]) + (int(self._bits(level, block)[:rest].sum()) if rest else 0)

    def access(self, at: int) -> int:
        value = 0
        for level in range(self.levels):
            block, rest = divmod(at, 8 * self.block)
            one = int(self._bits(level, block)[rest])
            ones = self._ones(level, at)
            at = int(self.zeros[level]) + ones if one else at - ones
            value = 2 * value + one
        return value

    def _range(self, symbol: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``symbol`` in ``[start, stop)`` lie at the bottom."""
        for level in range(self.levels):
            a, b = self._ones(level, start), self._ones(level, stop)
            if symbol >> (self.levels - 1 - level) & 1:
                start, stop = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def rank(self, symbol: int, stop: int) -> int:
        """Occurrences of ``symbol`` before position ``stop``."""
        if symbol >> self.levels:
            return 0
        a, b = self._range(symbol, 0, stop)
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) bit of that value in a plane."""
        sums = self._directory(level)[1]
        width = 8 * self.block
        before = sums if bit else np.minimum(np.arange(len(sums)) * width, self.n) - sums
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = self._bits(level, block)[: self.n - block * width]
        return block * width + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def select(self, symbol: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of ``symbol``."""
        if not 0 <= k < self.count(symbol):
            raise IndexError("no such occurrence")
        at = self._range(symbol, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = symbol >> (self.levels - 1 - level) & 1
            at = self._select_bit(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids: the parting of each level undone, from the lowest bit up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        cur = np.zeros(self.n, dtype=kind)
        for level in reversed(range(self.levels)):
            offsets, _, base = self._directory(level)
            plane = self.planes[level]
            raw = b"".join(
                _unpacked(plane[base + int(a) : base + int(b)])
                for a, b in zip(offsets, offsets[1:])
            )
            bits = np.unpackbits(
                np.frombuffer(raw, dtype=np.uint8), count=self.n, bitorder="little"
            ).astype(bool)
            out = np.empty(self.n, dtype=kind)
            z = int(self.zeros[level])
            out[~bits] = cur[:z]
            out[bits] = cur[z:] | kind(1 << (self.levels - 1 - level))
            cur = out
        return cur.astype(np.uint32)
