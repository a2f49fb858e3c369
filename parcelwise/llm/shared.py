"""What several operators need: the shared folder, cut lineage, learning folds, byte views of Arrow text."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: white space that parts words.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset (tests)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Rows of an Arrow batch: documents are long, and a worker holds a batch and what is made of it.
BATCH_ROWS = 1_000


def in_batches(df: DataFrame) -> DataFrame:
    """`df`, with the session's Arrow batches held to BATCH_ROWS rows from now on."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def mapped_folder(spark: SparkSession, name: str) -> str:
    """A new local path in the shared folder for files that workers map into memory.

    The shared folder must be mounted at the same place on all machines; a store without paths is refused."""
    place = urlparse(shared_folder(spark))
    if place.scheme not in ("", "file"):
        raise ValueError(f"files mapped by workers need a mounted spark.checkpoint.dir, not {place.scheme}:")
    folder = Path(unquote(place.path)) / f"{name}-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # results may be read as long as the driver lives
    return str(folder)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5. A null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with 64-bit offsets and without nulls (null: empty)."""
    texts = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return texts.fill_null("") if texts.null_count else texts


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more offset than texts)."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(ends):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[ends[0]:ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges (first, last) of texts with at most `most` bytes together, or one longer text alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last
