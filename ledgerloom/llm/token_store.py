"""Token ids of a corpus as wavelet-matrix shards, written and read by Spark.

Documents are put in order of their ids over range partitions, every task encodes
its texts and cuts its ids into shards of about ``shard_tokens``; a shard is one
row of a Parquet table, its file format one binary value (see ``wavelet``). Only
Spark writes and reads these files, so any store it reaches will do. Whole texts
are dealt once; rows of one id are dealt by a hash of their text as well, so that
no task gets a third of the corpus because an id repeats.

Null text is an empty text, null ids come first. An empty table gives an empty
store.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import id_and_text
from ledgerloom.llm.tokens import encoder
from ledgerloom.llm.wavelet import WaveletMatrix, build
from ledgerloom.storage import shared_folder

NO_ID = np.iinfo(np.int64).min  # stands for a null id inside a shard


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own among those that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_tokens(
    df: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 2,
    shard_tokens: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    end = int(end_id).to_bytes(4, "little")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_path).encode, TaskContext.get().partitionId()
        ids, docs, tokens, held, shard = [], [], [], 0, 0

        def closed() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            data = build(flat, np.array(docs), np.array(tokens))
            row = {"task": [task], "shard": [shard], "n_docs": [len(docs)], "n_tokens": [held],
                   "data": [data]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("task", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()),
                ("n_tokens", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for i in range(0, len(texts), 256):
                for doc_id, found in zip(names[i : i + 256], encode(texts[i : i + 256]), strict=True):
                    ids.append(found + end)
                    docs.append(NO_ID if doc_id is None else doc_id)
                    tokens.append(len(found) // 4 + 1)
                    held += tokens[-1]
                    if held >= shard_tokens:
                        yield closed()
                        ids, docs, tokens, held, shard = [], [], [], 0, shard + 1
        if docs:
            yield closed()

    narrow = id_and_text(df, id_col, text_col).withColumn("spread", F.xxhash64("text"))
    placed = narrow.repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread")
    placed.select("doc_id", "text").mapInArrow(
        shards, "task int, shard int, n_docs long, n_tokens long, data binary"
    ).write.option("compression", "none").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each shard, from the shards' counts alone. One row for each
    writing task is ordered as a whole; its shards are ordered within the task."""
    shards = spark.read.parquet(path).select("task", "shard", "n_tokens")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = shards.groupBy("task").agg(F.sum("n_tokens").alias("n")).select(
        "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("task_first")
    )
    within = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(
        tasks, "task"
    ).select("task", "shard", (F.col("task_first") + F.col("inner")).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Place, length and crc32 of the ids of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, shard, data in zip(*(batch.column(c) for c in ("task", "shard", "data")),
                                         strict=True):
                matrix = WaveletMatrix(data.as_buffer())
                docs, tokens = matrix.documents()
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(tokens)
                starts = ends - tokens
                crcs = [crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task.as_py()] * n, pa.int32()),
                     pa.array([shard.as_py()] * n, pa.int32()),
                     pa.array(docs, mask=docs == NO_ID), pa.array(starts), pa.array(tokens),
                     pa.array(crcs, pa.int64())],
                    ["task", "shard", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    kept = spark.read.parquet(path).select("task", "shard", "data")
    rows = kept.mapInArrow(
        read, "task int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long"
    )
    return rows.join(shard_starts(spark, path), ["task", "shard"]).select(
        "doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )


def occurrences(spark: SparkSession, path: str, token_id: int) -> DataFrame:
    """How often each shard holds a token, and where it does first: counted and
    looked up in the compressed planes, without decoding the ids."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column("data"):
                matrix = WaveletMatrix(data.as_buffer())
                n = matrix.count(token_id)
                found.append((n, matrix.select(token_id, 0) if n else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("task"), batch.column("shard"),
                 pa.array([n for n, _ in found], pa.int64()),
                 pa.array([at for _, at in found], pa.int64())],
                ["task", "shard", "n", "inner"],
            )

    kept = spark.read.parquet(path).select("task", "shard", "data")
    rows = kept.mapInArrow(look, "task int, shard int, n long, inner long")
    return rows.join(shard_starts(spark, path), ["task", "shard"]).select(
        "task", "shard", "n", (F.col("first") + F.col("inner")).alias("first_at")
    )
