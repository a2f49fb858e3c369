"""Table versions in a folder.

A table is rewritten as a new version beside the old one, so a job may read the table it replaces,
and a failed write leaves the last complete version in use. Rows are added to a version as parts, each
complete or not there; a part that is written again replaces what it held.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame) -> DataFrame:
    """`df` checkpointed to the cluster's shared folder, so that rounds neither pile up in one plan nor depend on an executor's disk.
    Without a configured folder (tests), a temporary one is used."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def _versions(spark: SparkSession, root: str, name: str, complete: bool) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        folder = status.getPath()
        done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS"))
        if folder.getName().startswith("v") and (done or not complete):
            found.append(int(folder.getName()[1:]))
    return found


def next_version(spark: SparkSession, root: str, name: str) -> str:
    return f"v{max(_versions(spark, root, name, complete=False), default=0) + 1:06d}"


def write_table(df: DataFrame, root: str, name: str, partition_by: list[str] | None = None,
                sort_by: list[str] | None = None) -> str:
    """Write the next version of a table and return its path."""
    target = f"{root}/{name}/{next_version(df.sparkSession, root, name)}"
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    if partition_by and not any(f.startswith(f"{partition_by[0]}=") for f in _names(df.sparkSession, target)):
        df.limit(0).write.mode("overwrite").parquet(target)  # without folders there would be no schema to read
    return target


def _names(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [status.getPath().getName() for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    """Whether there is a complete version."""
    return bool(_versions(spark, root, name, complete=True))


def current_version(spark: SparkSession, root: str, name: str) -> str:
    """Name of the last complete version."""
    versions = _versions(spark, root, name, complete=True)
    if not versions:
        raise FileNotFoundError(f"no complete version of {root}/{name}")
    return f"v{max(versions):06d}"


def vacuum(spark: SparkSession, root: str, name: str, keep: int = 2) -> list[str]:
    """Delete all but the last `keep` complete versions (and what was left unfinished before them); for when nothing reads them."""
    complete = sorted(_versions(spark, root, name, complete=True))
    if len(complete) <= keep:
        return []
    old = [f"{root}/{name}/v{v:06d}" for v in sorted(_versions(spark, root, name, complete=False)) if v < complete[-keep]]
    for folder in [*old, *(f"{root}/{name}/parts/{v.rsplit('/', 1)[1]}" for v in old)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return old


def has_folder(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def add_part(df: DataFrame, root: str, name: str, part: str, sort_by: list[str] | None = None) -> None:
    """Add rows to the last complete version of a table, as a part that a second run of the same work replaces."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").parquet(f"{root}/{name}/parts/{current_version(df.sparkSession, root, name)}/{part}")


def parts(spark: SparkSession, root: str, name: str) -> list[str]:
    """Names of the complete parts of the last complete version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/parts/{current_version(spark, root, name)}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    folders = [status.getPath() for status in fs.listStatus(path)]
    return sorted(f.getName() for f in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def read_table(spark: SparkSession, root: str, name: str, version: str | None = None, added: list[str] | None = None,
               base: bool = True) -> DataFrame:
    """A version of a table, the last complete one if not told, with all its parts or those in `added`; without `base` these alone."""
    version = version or current_version(spark, root, name)
    folders = [f"{root}/{name}/parts/{version}/{part}" for part in (parts(spark, root, name) if added is None else added)]
    return spark.read.parquet(*([f"{root}/{name}/{version}"] if base else []), *folders)
