"""Writers of the corpus and of the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import names


def write_corpus(results: DataFrame, folder: str) -> None:
    """One directory for each repository, replaced if it is there; others are left."""
    keyed = results.withColumn("repo_key", names.storage_key(F.col("repo_url")))
    (
        keyed.repartition("repo_key")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo_key")
        .parquet(folder)
    )


def write_repo_list(repos: DataFrame, path: str) -> None:
    repos.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_table(rows: DataFrame, path: str) -> None:
    """A full refresh of a catalogue table."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def to_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))
