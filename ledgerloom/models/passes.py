"""One distributed sum per iteration, shared by many candidate models.

A search over models repeats the same scan: 100 penalties times 11 fold sets,
or every term that could enter a formula. Fitting those one by one reads the
data once per candidate and iteration. Here a pass evaluates all candidates on
each block of rows, as one matrix product, and adds up what they need. Rows stay
where they are; a task returns one small array whose size depends on the number
of candidates and columns, never on rows.

Rows of a design are kept as they are meant: numbers in an array, and of each
factor the number of the slot that is set, if any. A factor of thousands of levels
costs a row one whole number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# numbers per row block inside a task (rows times candidates); bounds its memory and
# lets a block's numbers stay near the processor
BLOCK = 500_000
# slots up to which a block of rows is one dense matrix
DENSE = 256
# partial arrays added at once, in a task or on the driver: so many, and so many bytes
FAN = 64
FAN_BYTES = 64 << 20


class Block:
    """Some rows of a design of ``width`` slots: ``x`` holds those in ``dense``, and
    row ``rows[k]`` has a one in ``slots[k]``. ``layers`` part the latter so that no
    row comes twice in a layer."""

    def __init__(self, x, dense, rows, slots, layers, width: int):
        self.x, self.dense, self.width = x, dense, width
        self.rows, self.slots, self.layers = rows, slots, layers

    def __len__(self) -> int:
        return len(self.x)

    def less(self, shift) -> Block:
        """Numbers counted from ``shift``, which is over all slots."""
        return Block(
            self.x - shift[self.dense], self.dense, self.rows, self.slots, self.layers, self.width
        )

    def filled(self) -> Block:
        """The same rows with every slot among the numbers, for designs of few slots."""
        if self.width > DENSE or not self.layers:
            return self
        x = np.zeros((len(self), self.width))
        x[:, self.dense] = self.x
        x[self.rows, self.slots] = 1.0
        none = np.zeros(0, dtype=np.int64)
        return Block(x, np.arange(self.width), none, none, [], self.width)

    def where(self, mask) -> Block:
        """The rows that ``mask`` marks."""
        number = np.cumsum(mask) - 1
        own = mask[self.rows]
        before = np.append(0, np.cumsum(own))
        layers = [slice(before[s.start], before[s.stop]) for s in self.layers]
        return Block(
            self.x[mask], self.dense, number[self.rows[own]], self.slots[own], layers, self.width
        )

    def pick(self, slots: Sequence[int]) -> Block:
        """The slots given, in that order."""
        number = np.full(self.width, -1)
        number[list(slots)] = np.arange(len(slots))
        dense = number[self.dense]
        found = number[self.slots]
        own = found >= 0
        before = np.append(0, np.cumsum(own))
        layers = [slice(before[s.start], before[s.stop]) for s in self.layers]
        return Block(
            self.x[:, dense >= 0], dense[dense >= 0], self.rows[own], found[own], layers, len(slots)
        )

    def times(self, coefs):
        """Rows times ``coefs`` (slot, candidate)."""
        out = self.x @ coefs[self.dense]
        for s in self.layers:
            out[self.rows[s]] += coefs[self.slots[s]]
        return out

    def sums(self, right):
        """By slot, the sum over rows of slot times ``right`` (row, candidate)."""
        out = np.zeros((self.width, right.shape[1]))
        out[self.dense] = self.x.T @ right
        for s in self.layers:
            if s.stop > s.start:
                order = np.argsort(self.slots[s], kind="stable")
                slots = self.slots[s][order]
                first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
                out[slots[first]] += np.add.reduceat(right[self.rows[s][order]], first)
        return out

    def cross(self, weight=None):
        """By pair of slots, the sum over rows of their product, times ``weight``."""
        weight = np.ones(len(self)) if weight is None else weight
        weighted = self.x * weight[:, None]
        out = np.zeros((self.width, self.width))
        if len(self.dense):
            out[:, self.dense] = self.sums(weighted)
            out[self.dense] = out[:, self.dense].T
        codes, weights = [], []
        place = np.full(len(self), -1)
        for a in self.layers:
            place[:] = -1
            place[self.rows[a]] = self.slots[a]
            for b in self.layers:
                other = place[self.rows[b]]
                both = other >= 0
                codes.append(other[both] * self.width + self.slots[b][both])
                weights.append(weight[self.rows[b][both]])
        if codes:
            found = np.bincount(np.concatenate(codes), np.concatenate(weights), self.width**2)
            out += found.reshape(self.width, self.width)
        return out


def packed(square):
    """The upper triangle of a symmetric matrix, row by row."""
    return square[np.triu_indices(len(square))]


def unpacked(upper, width: int):
    out = np.empty((width, width))
    out[np.triu_indices(width)] = upper
    lower = np.tril_indices(width, -1)
    out[lower] = out.T[lower]
    return out


def triangle(width: int) -> int:
    return width * (width + 1) // 2


class RowBlocks:
    """The rows of a matrix frame (``x`` array, ``y``, ``fold``), summed in passes.

    With ``width`` the frame is one of ``Design.rows``: ``x`` holds the slots in
    ``dense`` and a column ``slots`` those of the factor levels that are set."""

    def __init__(self, matrix: DataFrame, width: int | None = None, dense: Sequence[int] = ()):
        coded = ["slots"] if width is not None else []
        self.rows = matrix.select(
            "x", *coded, F.col("y").cast("double"), F.col("fold").cast("int")
        )
        self.tasks = matrix.rdd.getNumPartitions()
        self.width, self.dense = width, np.array(dense, dtype=np.int64)

    def sum(self, block: Callable[..., Any], size: int, candidates: int = 1):
        """Sum of ``block(x, y, fold)`` over all row blocks.

        ``block`` gets a :class:`Block` (numpy rows, if the frame has no factor
        slots) and numpy arrays and returns a flat array of ``size`` doubles.

        The partial arrays of many partitions are added in rounds of at most
        ``FAN`` and ``FAN_BYTES`` (two arrays at least), so neither a task nor the
        driver ever holds more.
        """
        step = min(max(BLOCK // candidates, 64), 16_384)
        width, dense = self.width, self.dense

        def cut(batch, n: int):
            x = batch.column("x").flatten().to_numpy().reshape(n, -1)
            if width is None:
                return lambda i, j: x[i:j]
            lists = batch.column("slots")
            slots = lists.flatten().to_numpy().astype(np.int64)
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sizes = np.diff(cuts)

            def some(i: int, j: int) -> Block:
                own = sizes[i:j]
                rows = np.repeat(np.arange(len(own)), own)
                place = np.arange(cuts[i], cuts[min(j, n)]) - np.repeat(cuts[i:j][: len(own)], own)
                order = np.argsort(place, kind="stable")
                ends = np.cumsum(np.bincount(place, minlength=1))
                layers = [slice(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                held = slots[cuts[i] : cuts[min(j, n)]]
                return Block(x[i:j], dense, rows[order], held[order], layers, width)

            return some

        def partials(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            out = np.zeros(size)
            for batch in batches:
                n = batch.num_rows
                if n == 0:
                    continue
                y = batch.column("y").to_numpy()
                fold = batch.column("fold").to_numpy()
                some = cut(batch, n)
                for i in range(0, n, step):
                    out += block(some(i, i + step), y[i : i + step], fold[i : i + step])
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"task": pa.array([task], pa.int32()), "part": pa.array([out.tobytes()], pa.binary())}
            )

        def add(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            out = np.zeros(size)
            for batch in batches:
                for part in batch.column("part"):
                    out += np.frombuffer(part.as_buffer())
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"task": pa.array([task], pa.int32()), "part": pa.array([out.tobytes()], pa.binary())}
            )

        parts, left = self.rows.mapInArrow(partials, "task int, part binary"), self.tasks
        fan = fan_of(size)
        while left > fan:
            left = math.ceil(left / fan)
            parts = parts.repartition(left, "task").mapInArrow(add, "task int, part binary")
        total = np.zeros(size)
        for row in parts.select("part").collect():
            total += np.frombuffer(row.part)
        return total

    def typical(self):
        """The columns of some row: a shift that keeps sums of squares precise
        where values are large and differ little. Slots of factors need none.
        Empty data gives none."""
        row = self.rows.select("x").first()
        if row is None:
            raise ValueError("no complete row to fit on")
        if self.width is None:
            return np.array(row.x)
        out = np.zeros(self.width)
        out[self.dense] = row.x
        return out


def column_sums(x, y, fold):
    """Of a block of design rows, to be added up by ``RowBlocks.sum``."""
    return x.sums(np.ones((len(x), 1)))[:, 0]


def fan_of(size: int) -> int:
    """Partial arrays of ``size`` doubles that are added at once."""
    return max(2, min(FAN, FAN_BYTES // (8 * max(size, 1))))
