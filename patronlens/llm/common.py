"""Helpers shared by the corpus operators: shared storage, hash folds, batches of text, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text whose A-Z are in lower case: runs of digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = re.compile(WORD)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


#: Each byte of a word's letters in lower case, 0 for all that lies between words.
_LETTERS = np.array([ord(c) if re.match(WORD, c := lower_ascii(chr(b))) else 0 for b in range(128)] + [*range(128, 256)], np.uint8)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (as `words_of` has them) of all texts one after another, and how many each text has."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    letters = _LETTERS.take(np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]])
    ends = ends - ends[0]
    inside = letters != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(letters)]
    first[heads] = inside[heads]  # a word does not go on into the next text
    begins = np.flatnonzero(first)
    spots = np.append(np.cumsum(inside, dtype=np.int32)[begins] - 1, np.int32(inside.sum())).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(spots), pa.py_buffer(letters[inside]))
    return words, np.diff(np.searchsorted(begins, ends))


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(lower_ascii(text)) if text else []


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; null counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(frame: DataFrame, partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage for good."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    writer = frame.write.options(**(options or {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a slice hold about `most` bytes; one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for row, size in enumerate(sizes):
            if row > begin and held + size > most:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)
