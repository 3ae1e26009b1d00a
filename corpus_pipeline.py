"""The corpus pipeline: five stages, each written as Parquet and read by the next.

Rejected documents go, recurring lines are cut out of their texts (one document
keeps each), one document of each group of near copies stays, documents that hold
a benchmark item go, and what is left is packed. Every stage works on all rows its
predecessor kept.

Rows with a null or empty text are rejected by the first stage. A document whose
lines all recur elsewhere is dropped with them. Rows are told apart by id and text;
repeated rows are copies, of which one stays. Extra columns of any name pass through.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table
from ledgerloom.llm.latent import contaminated
from ledgerloom.llm.line_templates import without_recurring_lines
from ledgerloom.llm.near_copies import first_of_groups, near_copy_groups
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality_rules import quality_rules
from ledgerloom.llm.queries import TOKENIZER
from ledgerloom.llm.token_store import new_folder


def _packed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``doc_id``, ``text``: whatever a document carries besides
    cannot clash with what a stage adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def _unpacked(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """The documents again, with another text and its characters counted anew, if one
    is given."""
    row = F.col("row")
    if text is not None:
        row = row.withField("text", text)
        if "n_chars" in rows.schema["row"].dataType.names:
            kind = rows.schema["row"].dataType["n_chars"].dataType
            row = row.withField("n_chars", F.length(text).cast(kind))
    return rows.select(row.alias("row")).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that failed."""
    judged = quality_rules(_packed(docs), id_col="row").where("kept")
    return _unpacked(
        judged.select(F.col("doc_id").alias("row"), F.col("clean_text").alias("text")), F.col("text")
    )


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, from all documents but the first. Lines that
    are left without text take their document with them."""
    cut = without_recurring_lines(_packed(docs), min_docs=3, similar=0.7, keep_first=True)
    return _unpacked(cut.where(F.trim("text") != ""), F.col("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Packed documents with the hash that tells rows of one id apart."""
    return _packed(docs).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def _same(a: DataFrame, b: DataFrame):
    return (a["text_hash"] == b["text_hash"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 of their five-word shingles, the one with the smallest
    id stays; candidates are fingerprints of at most 6 differing bits."""
    rows = _keyed(docs)
    stays = first_of_groups(near_copy_groups(docs, most=6, percent=80, width=5))
    kept = rows.join(stays, _same(rows, stays), "left_semi")
    return _unpacked(kept.dropDuplicates(["doc_id", "text_hash"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each judged by its own text."""
    rows = _keyed(docs)
    keys = rows.select(F.struct("doc_id", "text_hash").alias("key"), "text")
    hits = contaminated(keys, table(spark, sf_dir, "benchmark"), id_col="key")
    hits = hits.select("doc_id.doc_id", "doc_id.text_hash").distinct()
    return _unpacked(rows.join(hits, _same(rows, hits), "left_anti"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, in sequences of 2,048."""
    return pack(docs, TOKENIZER, capacity=2048, end_id=1)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("decontamination", decontaminate),
    ("packing", packing),
]

# the last stage needs a tokenizer, which SQL has not
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_folder(spark, f"stage{k + 1}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
