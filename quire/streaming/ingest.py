"""New files as a stream of units; every micro-batch asks only for texts that the cache table lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.text import trim
from quire.operators.translate import Provider, translate_units


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of the lines of text files as they appear; the file's path is the document."""
    lines = spark.readStream.format("text").load(path).withColumn("doc_id", F.col("_metadata.file_path"))
    return lines.select("doc_id", trim(F.col("value")).alias("text")).where("text <> ''")


def fill_cache(units: DataFrame, cache_path: str, checkpoint: str, provider: Provider, source: str, target: str, names: tuple[str, str]) -> StreamingQuery:
    """Appends new translations to a Parquet cache. A batch that runs again finds its texts there and asks for none twice."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        schema = "chunk_hash string, translation string"
        try:
            cache = spark.read.schema(schema).parquet(cache_path)
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            cache = spark.createDataFrame([], schema)
        _, fresh = translate_units(rows, cache, provider, source, target, names, slots=2, retry_pause=0, call_pause=0)
        fresh.write.mode("append").parquet(cache_path)

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
