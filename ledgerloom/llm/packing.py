"""Best-fit decreasing packing of token sequences into windows of fixed capacity.

Overlong documents are first cut into full windows; what is left of them, and
every shorter document, is a piece of ``1 .. capacity`` tokens. Pieces are packed
over the whole corpus in decreasing size, each into the open window with the
least room that still takes it. Sizes are small integers, so this needs no pass
over the pieces on one machine: pieces of one size are interchangeable, and so
are windows with the same room. The driver gets one count for each size (at most
``capacity`` numbers, whatever the corpus holds), keeps windows as ranges by room
with a segment tree over the rooms, and places ranges of pieces into ranges of
windows. The result, a table of ranges, is bounded by the capacity as well.
Every task then looks its pieces up in it by size and rank.

Ranks number the pieces of one size: a piece knows its rank among those of its
task, and the tasks' counts are summed up per size. No task sees more than its
own pieces and one count for each task and size.

Null text is an empty text: its one piece holds the end id alone. Repeated rows
are packed one by one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text
from ledgerloom.llm.tokens import encoder
from ledgerloom.storage import cut_lineage


TEXTS = 512  # texts whose ids are held together


class Rooms:
    """Segment tree over rooms ``0 .. capacity``: which of them have open windows."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << (capacity + 1).bit_length()
        self.open = [False] * (2 * self.width)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def push(self, room: int, first: int, count: int) -> None:
        self.ranges[room].append((first, count))
        self._mark(room, True)

    def pop(self, room: int) -> tuple[int, int]:
        got = self.ranges[room].pop()
        if not self.ranges[room]:
            self._mark(room, False)
        return got

    def _mark(self, room: int, value: bool) -> None:
        at = room + self.width
        self.open[at] = value
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, size: int) -> int | None:
        """Least room of at least ``size`` with an open window."""
        at = size + self.width
        if self.open[at]:
            return size
        while at > 1:  # up to the first right neighbour that has one, then down its left side
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Ranges ``(size, first rank, pieces, first window, offset)`` for pieces
    given as counts by size. Each piece of a range lies in a window of its own."""
    rooms, windows, out = Rooms(capacity), 0, []
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = rooms.tightest(size)
            if room is None:
                room, fit = capacity, capacity // size
                first, count = windows, -(-left // fit)
                windows += count
            else:
                fit = room // size
                first, count = rooms.pop(room)
            # a window that took a piece is the tightest for the next one
            full, rest = min(count, left // fit), 0
            if full < count:
                rest = left - full * fit
            used = full + (rest > 0)
            if used < count:
                rooms.push(room, first + used, count - used)
            for k in range(fit if full else 0):
                out.append((size, rank, full, first, capacity - room + k * size))
                rank += full
            for k in range(rest):
                out.append((size, rank, 1, first + full, capacity - room + k * size))
                rank += 1
            if full and room - fit * size:
                rooms.push(room - fit * size, first, full)
            if rest and room - rest * size:
                rooms.push(room - rest * size, first + full, 1)
            left -= full * fit + rest
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def cut_pieces(
    df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str,
    keep_ids: bool,
) -> DataFrame:
    """Pieces of every document, with the rank of each among those of its task."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        encode = encoder(tokenizer_path).encode
        for batch in (b.slice(i, TEXTS) for b in batches for i in range(0, b.num_rows, TEXTS)):
            ids_of = encode(batch.column("text").to_pylist())
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    size = len(piece) // 4
                    rows.append((doc_id, start, size, crc32(piece), n, task, seen[size],
                                 piece if keep_ids else None))
                    seen[size] += 1
            columns = zip(*rows, strict=True) if rows else [()] * 8
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank", "ids"]
            kinds = [batch.schema.field("doc_id").type, *[pa.int64()] * 4, pa.int32(), pa.int64(),
                     pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names
            )

    narrow = id_and_text(df, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        cut,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "task int, rank long, ids binary",
    )


def pack(
    df: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: its place in its document and in its sequence.

    ``keep_ids`` adds the piece's ids, for ``sequences``. The pieces are written
    to the checkpoint folder once: ranks must not change when a task is repeated.
    """
    pieces = cut_lineage(
        cut_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids)
    )
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    total = by_task.groupBy("length").agg(F.sum("n").alias("n"))
    counts = {r["length"]: r["n"] for r in total.collect()}  # at most capacity rows
    plan = best_fit_decreasing(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    firsts = by_task.select(
        "length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    ranked = pieces.join(firsts, ["length", "task"]).withColumn(
        "rank", F.col("rank") + F.col("before")
    )
    narrow = ranked.drop("before", "task") if keep_ids else ranked.drop("before", "task", "ids")
    # ranges in order of size and first rank, as one sorted key
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    span = max(counts.values(), default=0) + 1
    keys = plan[:, 0] * span + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, size * span + rank, side="right") - 1
            window = plan[at, 3] + rank - plan[at, 1]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(window), pa.array(plan[at, 4])],
                [*kept, "sequence_id", "offset"],
            )

    fields = [f for f in narrow.schema.fields if f.name != "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    placed = narrow.mapInArrow(place, f"{schema}, sequence_id long, offset long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.select(*columns, *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ids, and where each document's piece lies. A group
    holds at most ``capacity`` ids. ``packed`` is a result with ``keep_ids``."""
    parts = packed.groupBy("sequence_id").agg(
        F.sort_array(
            F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))
        ).alias("pieces")
    )
    return parts.select(
        "sequence_id",
        F.aggregate(
            "pieces", F.lit(b"").cast("binary"), lambda ids, p: F.concat(ids, p["ids"])
        ).alias("ids"),
        F.transform("pieces", lambda p: p.dropFields("ids")).alias("pieces"),
    )
