"""Recurring lines by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its leading tokens, tokens
with a digit being variable from the start. In a leaf, lines are parsed in order
of their hashes: a line joins the template that shares the most tokens with it, if
these are a large enough part, and positions that differ become variable;
otherwise it starts a template. Templates found in many different documents are
recurring, and their lines are dropped.

Only what can matter meets in a leaf: equal lines have met before by their hash,
and leaves with a single distinct line or too few lines are not parsed. So lines
travel as hashes first, and then the text of those to be parsed alone: a bit map
of fixed size keeps the others back where they are read (a full map would let more
through, and change no result). The distinct lines of a leaf are parsed in steps that
are the same for every leaf: first in blocks of the last ``BLOCK_BITS[0]`` bits of
their hashes, then the templates found, in place of their lines, in blocks of fewer
bits, and in the end all that the leaf has left together. So the result depends on
the lines of a leaf alone; ``crowded`` only says from how many distinct lines on the
blocks of a leaf are dealt out over tasks instead of being parsed in one, and changes
no result. The lines of a common template become one in the first step, wherever they
are parsed; the last step takes the templates that a leaf has left in one task, each
compared with those alone that can be similar. Documents of
equal text count once, however often they are copied.

Null text has no lines. Lines of fewer than ``min_tokens`` tokens and lines whose
tokens all hold digits have no template: they recur as they stand, by the hash of
their tokens. Lines of over ``long_tokens`` tokens recur from two different texts on.
Blank lines are left alone.
Rows of one id are told apart by their text; repeated rows get the same result.
An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text
from ledgerloom.storage import cut_lineage, delete_checkpoint

VARIABLE = "<*>"
DIGIT = re.compile(rb"[0-9]")
EXACT = b"\n"  # before a line without a template: in no line, so no template's hash
MAP_BITS = 1 << 24
LEADING = 3  # leading tokens of the tree
BLOCK_BITS = (12, 6, 0)  # bits of a hash that make a block, step by step


def masked(line: bytes) -> list[bytes]:
    """Tokens of a line, variable ones masked."""
    tokens = line.split()
    if DIGIT.search(line):
        mask = VARIABLE.encode()
        tokens = [mask if DIGIT.search(t) else t for t in tokens]
    return tokens


def _hash(value: bytes) -> int:
    """As the built-in ``xxhash64`` of a string."""
    h = xxhash.xxh64_intdigest(value, 42)
    return h - (1 << 64) if h >> 63 else h


def _line_hashes(narrow: DataFrame, min_tokens: int, long_tokens: int) -> DataFrame:
    """Every line with a token as hashes; those without a template are leaves alone."""
    names = ["doc_id", "text_hash", "line_no", "line_hash", "leaf", "long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = VARIABLE.encode()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(),
                                    batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                of_text, before = _hash(raw), len(out[0])
                for i, line in enumerate(raw.split(b"\n")):
                    tokens = masked(line)
                    n = len(tokens)
                    if not n:
                        continue
                    out[2].append(i)
                    out[5].append(n > long_tokens)
                    if n < min_tokens or tokens.count(mask) == n:
                        as_is = _hash(EXACT + b" ".join(line.split()))
                        out[3].append(as_is)
                        out[4].append(as_is)
                        continue
                    out[3].append(_hash(b" ".join(tokens)))
                    out[4].append(_hash(b"%d " % n + b" ".join(tokens[:LEADING])))
                added = len(out[2]) - before
                out[0].extend([doc_id] * added)
                out[1].extend([of_text] * added)
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(),
                     pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run,
        f"doc_id {kind}, text_hash long, line_no int, line_hash long, leaf long, long boolean",
    )


def _texts_of(narrow: DataFrame, members: DataFrame, min_tokens: int) -> DataFrame:
    """``line_hash, tokens`` of lines whose hash may be among the members'."""
    at = F.col("line_hash").bitwiseAND(F.lit(MAP_BITS - 1))
    bit = F.expr(f"shiftleft(1L, CAST(line_hash & 63 AS INT))")
    words = members.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(bit).alias("bits"))
    bits = np.zeros(MAP_BITS // 64, dtype=np.int64)
    for w, b in words.collect():  # at most MAP_BITS / 64 rows
        bits[w] = b
    shared = narrow.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, set()
        for batch in batches:
            hashes, tokens_of = [], []
            for text in batch.column("text").to_pylist():
                for line in text.encode().split(b"\n"):
                    tokens = masked(line)
                    if len(tokens) < min_tokens:
                        continue
                    joined = b" ".join(tokens)
                    h = _hash(joined)
                    if int(own[(h & MAP_BITS - 1) >> 6]) >> (h & 63) & 1 and h not in seen:
                        seen.add(h)  # once for each batch of lines; the join tells the rest
                        hashes.append(h)
                        tokens_of.append(joined.decode())
            seen.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.int64()), pa.array(tokens_of, pa.string())],
                ["line_hash", "tokens"],
            )

    return narrow.select("text").mapInArrow(run, "line_hash long, tokens string")


def parse_leaf(lines: list[list[str]], similar: float) -> tuple[list[int], list[str]]:
    """Template number of each line (all of one length), and the templates.

    A line is compared with the templates that hold one of its rarest tokens at the
    same place: so many of them that a template without any is not similar enough."""
    n = len(lines[0])
    code: dict[str, int] = {}
    rows = np.array([[code.setdefault(t, len(code)) for t in line] for line in lines])
    rows[rows == code.get(VARIABLE, -1)] = -1  # of the lines, too, variable tokens match nothing
    made, count, of = np.empty((8, n), dtype=rows.dtype), 0, []
    holding: dict[tuple[int, int], list[int]] = {}  # templates by place and token
    for row in rows:
        own = [(i, t) for i, t in enumerate(row.tolist()) if t >= 0]
        needed, best = math.ceil(similar * len(own) - 1e-9), -1
        if needed > 0:
            lists = sorted((holding.get(at, ()) for at in own), key=len)
            near = np.array(sorted(set().union(*lists[: len(own) - needed + 1])), dtype=np.int64)
        else:
            near = np.arange(count)
        if len(near):
            shared = ((made[near] == row) & (row >= 0)).sum(axis=1)
            most = int(np.argmax(shared))
            best = int(near[most])
            constant = max(len(own), int((made[best] >= 0).sum()), 1)
            if shared[most] < similar * constant:
                best = -1
        if best < 0:
            if count == len(made):
                made = np.concatenate([made, np.empty_like(made)])
            made[count], best, count = row, count, count + 1
            for at in own:
                holding.setdefault(at, []).append(best)
        else:
            made[best][made[best] != row] = -1
        of.append(best)
    word = {i: t for t, i in code.items()} | {-1: VARIABLE}
    return of, [" ".join(word[int(i)] for i in made[k]) for k in range(count)]


def parse_in_steps(
    lines: list[str], similar: float, steps: tuple[int, ...] = BLOCK_BITS
) -> list[str]:
    """Template of each distinct line of a leaf; see above."""
    now = lines
    for bits in steps:
        blocks: dict[int, list[str]] = {}
        for h, kind in sorted((_hash(t.encode()), t) for t in set(now)):
            blocks.setdefault(h & (1 << bits) - 1, []).append(kind)
        after: dict[str, str] = {}
        for kinds in blocks.values():
            if len(kinds) > 1:
                of, made = parse_leaf([t.split(" ") for t in kinds], similar)
                after.update((t, made[k]) for t, k in zip(kinds, of, strict=True))
        if after:
            now = [after.get(t, t) for t in now]
    return now


def _parsed(members: DataFrame, similar: float, steps: tuple[int, ...]) -> DataFrame:
    """``leaf, line_hash, template`` of the distinct lines of leaves, leaf by leaf."""
    names = ["leaf", "line_hash", "template"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, hashes, lines = None, [], []
        done: tuple[list, ...] = ([], [], [])

        def close() -> None:
            done[0].extend([leaf] * len(lines))
            done[1].extend(hashes)
            done[2].extend(parse_in_steps(lines, similar, steps))

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(done, kinds, strict=True)]
            for column in done:
                column.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for at, h, tokens in zip(*(batch.column(c).to_pylist() for c in
                                       ("leaf", "line_hash", "tokens")), strict=True):
                if at != leaf:
                    close()
                    leaf, hashes, lines = at, [], []
                hashes.append(h)
                lines.append(tokens)
            yield batch_of()
        close()
        yield batch_of()

    placed = members.repartition("leaf").sortWithinPartitions("leaf")
    return placed.mapInArrow(run, "leaf long, line_hash long, template string")


def _dealt_out(lines: DataFrame, similar: float) -> DataFrame:
    """``line_hash, template`` of ``lines (leaf, line_hash, tokens)`` of crowded leaves:
    the same steps, the blocks of each spread over tasks."""
    state = cut_lineage(lines.select("leaf", "line_hash", F.col("tokens").alias("template")))
    for bits in BLOCK_BITS:
        own = F.xxhash64("template")
        block = F.xxhash64("leaf", own.bitwiseAND(F.lit((1 << bits) - 1)))
        kinds = state.select(
            block.alias("leaf"), own.alias("line_hash"), F.col("template").alias("tokens")
        ).distinct()
        changed = _parsed(kinds, similar, (0,)).toDF("block", "before", "after")
        same = (block == F.col("block")) & (own == F.col("before"))
        following = cut_lineage(
            state.join(changed, same, "left").select(
                "leaf", "line_hash", F.coalesce("after", "template").alias("template")
            )
        )
        delete_checkpoint(state)
        state = following
    return state.select("line_hash", "template")


def recurring_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    similar: float = 0.7,
    min_tokens: int = 3,
    long_tokens: int = 50,
    crowded: int = 2_000,
    keep_first: bool = False,
) -> DataFrame:
    """``doc_id, text_hash`` and, for documents with lines of recurring templates,
    their number, the numbers of the lines to drop and the characters in them.

    ``min_docs`` is the least number of different texts that makes a template
    recurring, at most two for lines of over ``long_tokens`` tokens; ``keep_first`` leaves the lines in the document with the smallest id.
    """
    narrow = id_and_text(df, id_col, text_col)
    least = F.when(F.col("long"), min(min_docs, 2)).otherwise(min_docs)
    lines = cut_lineage(_line_hashes(narrow, min_tokens, long_tokens))
    distinct = lines.groupBy("line_hash", "leaf").agg(
        F.count(F.lit(1)).alias("n"), F.max("long").alias("long")
    )
    mixed = (
        distinct.groupBy("leaf")
        .agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows"), F.max("long").alias("long"))
        .where((F.col("kinds") > 1) & (F.col("rows") >= least))
        .select("leaf", (F.col("kinds") > crowded).alias("crowded"))
    )
    members = cut_lineage(distinct.join(mixed, "leaf").select("leaf", "line_hash", "crowded"))
    texts = _texts_of(narrow, members, min_tokens)
    told = texts.join(members, "line_hash").dropDuplicates(["line_hash"])
    parsed = _parsed(told.where("not crowded"), similar, BLOCK_BITS).drop("leaf")
    if not members.where("crowded").isEmpty():
        parsed = parsed.unionAll(_dealt_out(told.where("crowded"), similar))
    parsed = cut_lineage(parsed).where(F.col("template").rlike(r"(^| )(?!<\*>( |$))"))
    named = lines.join(
        parsed.select("line_hash", F.xxhash64("template").alias("t")), "line_hash", "left"
    ).select("doc_id", "text_hash", "line_no", "long", F.coalesce("t", "line_hash").alias("t"))
    many_docs = (
        named.groupBy("t", "text_hash")
        .agg(F.min("doc_id").alias("first"), F.max("long").alias("long"))
        .groupBy("t")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first"),
             F.max("long").alias("long"))
        .where(F.col("n_docs") >= least).drop("long")
    )
    hits = named.join(many_docs, "t")
    drop = F.lit(True)
    if keep_first:
        drop = ~F.col("doc_id").eqNullSafe(F.col("first"))
    return hits.groupBy("doc_id", "text_hash").agg(
        F.count_distinct("line_no").alias("n_recurring"),
        F.array_sort(F.collect_set(F.when(drop, F.col("line_no")))).alias("dropped"),
    )


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: its lines, those of recurring templates, those dropped."""
    found = recurring_lines(df, id_col, text_col, **how)
    rows = id_and_text(df, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("text_hash"),
        F.length("text").cast("long").alias("n_chars"),
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
        .alias("n_lines"),
    )
    none = F.array().cast("array<int>")
    same = (rows["text_hash"] == found["text_hash"]) & rows["doc_id"].eqNullSafe(found["doc_id"])
    return rows.join(found, same, "left").select(
        rows["doc_id"], "n_lines", F.coalesce("n_recurring", F.lit(0)).alias("n_recurring"),
        F.size(F.coalesce("dropped", none)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", none).alias("dropped_lines"),
    )


def without_recurring_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how
) -> DataFrame:
    """``df`` with the lines of recurring templates cut out of its texts."""
    found = recurring_lines(df, id_col, text_col, **how)
    # all columns in one, so that none clashes with a decision's
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"),
    )
    same = (rows["hash"] == found["text_hash"]) & F.col(f"row.{id_col}").eqNullSafe(found["doc_id"])
    text = F.col(f"row.{text_col}")
    kept = F.array_join(
        F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("dropped", i)), "\n"
    )
    cut = F.when(F.size("dropped") > 0, kept).otherwise(text)
    return (
        rows.join(found, same, "left")
        .select(F.col("row").withField(text_col, cut).alias("row"))
        .select("row.*")
    )
