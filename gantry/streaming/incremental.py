"""New files as a stream: the batch operators on each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gantry.operators.dedup import digest
from gantry.sources.readers import parse


def stream_documents(spark: SparkSession, folder: str, mode: str, files_per_batch: int = 1000) -> DataFrame:
    """Rows of a mode's files as they arrive; a file is read once."""
    source = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"*_{mode}.json").option("recursiveFileLookup", True).text(folder)
    return parse(source.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document")), mode)


def first_seen(rows: DataFrame, within: list[str], content: list[str]) -> DataFrame:
    """Rows whose content is new in its program. State grows with the distinct digests, one key each."""
    return rows.withColumn("__digest", digest(*[F.col(c) for c in content])).dropDuplicates([*within, "__digest"]).drop("__digest")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once, until what is there now has been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
