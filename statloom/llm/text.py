"""Small helpers shared by the operators: tables, word splitting, Arrow batches, the held-out split."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ASCII bytes that end a word: all but digits and letters. Bytes of other characters belong to words.
_ASCII_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or b in _ASCII_WORD else 32 for b in range(256)
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(data: bytes) -> list[bytes]:
    """Words of UTF-8 text: A-Z lower-cased, split at every ASCII character that is no letter or digit."""
    return data.translate(WORD_BYTES).split()


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of rows no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8 bytes, empty where null."""
    column = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that what a task holds beside the batch itself stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
