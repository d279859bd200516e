"""Words, tokens and batches shared by the text operators."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
#: A-Z to a-z, other ASCII but digits and letters to a blank; bytes of other characters stay.
_WORD_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a text whose A-Z are lower-cased
ROWS, BYTES = 256, 1 << 21  # documents, and bytes of them, handled at a time inside a task


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII digits, ASCII letters (lower-cased) and all characters beyond ASCII. Null has none."""
    return (text or b"").translate(_WORD_TABLE).split()


def tokens(text: bytes | None) -> list[bytes]:
    """Runs of anything but blank, \\t, \\n, \\v, \\f, \\r, with A-Z lower-cased. Null has none."""
    return (text or b"").lower().split()


def ascii_lower(column: Column | str) -> Column:
    """A-Z lower-cased, all else as it is. The fast built-in serves where a text is ASCII."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def fold(column: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, body): the two columns the operators need, the text as bytes. Other columns cannot clash."""
    return df.select("doc_id", F.col("text").cast("binary").alias("body"))


def slices(batch: pa.RecordBatch, rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``most_bytes`` bytes of text; a longer row is a part of its own."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(total, total[start] + most_bytes, "right")) - 1
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def map_slices(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """Row-wise Arrow job: ``make()`` runs once per task and gives the function of a slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            function = function or make()
            for part in slices(batch, rows, most_bytes):
                yield function(part)

    return df.mapInArrow(run, schema)
