"""What the operators of this package share."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# a word is a run of characters other than the ASCII white space (a fixed value)
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, null texts as empty; whatever else the
    table carries cannot clash with what the operator adds."""
    return df.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8; ``bytes.split`` cuts at the same six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def lower_words(text: str | None) -> list[bytes]:
    """As ``words_of``, with A-Z alone in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids have no remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def remainder_of(doc_id, modulus: int) -> int | None:
    return None if doc_id is None else crc32(str(doc_id).encode()) % modulus
