"""Mining of source files as they arrive, with what is done kept by the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..extract.strings import extract_sql
from ..functions import names
from ..sources import SOURCE_ENDINGS, decoded, ending_glob

_FILES = "path string, modificationTime timestamp, length long, content binary"


def source_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 1000) -> DataFrame:
    """(file_path, content) of source files below a folder as they arrive."""
    reader = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True)
    files = reader.option("pathGlobFilter", ending_glob(SOURCE_ENDINGS)).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.col("path").alias("file_path"), decoded(F.col("content")).alias("content"))


def mine(spark: SparkSession, folder: str, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Append the SQL of files that have not been seen yet to ``target``, then stop.

    A batch is written as a whole under its number, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = extract_sql(batch, **options).withColumn("language", names.extension(F.col("file_path")))
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = source_stream(spark, folder).writeStream.foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
