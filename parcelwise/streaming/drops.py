"""Archives dropped into a folder, each read once.

The batch reader skips files that are already there; as a stream, the checkpoint remembers which
files were read, and every new archive's sales are added to `sales` exactly once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..plans import jobs
from ..sources import archive

BINARY_FILE_DDL = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """Archives as (path), to be read by seeking, or where tasks cannot open the store as (path, content)."""
    columns = ["path"] if archive.seekable(folder) else ["path", "content"]
    return (spark.readStream.format("binaryFile").schema(BINARY_FILE_DDL)
            .option("pathGlobFilter", "*.[zZ][iI][pP]").option("maxFilesPerTrigger", 8)
            .load(folder).select(*columns))


def ingest_drops(spark: SparkSession, folder: str, root: str, checkpoint: str,
                 as_of: date | None = None) -> StreamingQuery:
    """Add every archive not read yet to the stored sales, what cannot be read to `bad_files`, then stop.

    Files of any name are taken. Sales are the table that the jobs write and read: a batch is a part of its present version,
    `batch-<number>`, which is replaced if the batch is run again, and archives that a job has read are skipped."""
    def append(files: DataFrame, batch: int) -> None:
        jobs.add_archives(spark, root, files, f"batch-{batch}", as_of)

    return (stream_files(spark, folder).writeStream.foreachBatch(append)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
