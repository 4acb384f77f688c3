"""Files in and out: whole files as rows, and rows written as files that appear by a rename."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """(path, content) of the files under a folder whose names end in one of the suffixes, in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.where(F.lower("path").rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$"))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, the cluster's default one where it has none, as pyarrow's file systems read it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().replace("s3a://", "s3://", 1)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (name, content), names relative to the folder, each once, and returns (name, n_bytes), read from memory.

    A file appears by a rename, so a task that runs again writes it again unharmed. Names that leave the folder raise.
    """
    spark = rows.sparkSession
    root = qualified(spark, folder)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, content in zip(names, batch.column(1), strict=True):
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name} is no name inside the folder")
                data = content.as_py() or b""
                target = f"{base}/{name}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target}.{TaskContext.get().taskAttemptId()}.part"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, target)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "n_bytes"])

    done = rows.select("name", "content").mapInArrow(write, "name string, n_bytes long")
    return done.checkpoint()
