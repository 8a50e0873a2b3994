"""The whole run: mine repositories, build the catalogue, link usages, plan the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks, sources
from .extract.strings import corpus
from .functions.statements import prepare
from .operators import catalogue, relational
from .plans import sandbox

TABLES = ("repos", "tables", "columns", "queries", "column_usages", "queries_executable", "queries_error")


def mine_repository(spark: SparkSession, folder: str, repo_url: str, target: str, **options) -> None:
    """Write a checkout's row of the nested corpus; its descriptive files only if it has a query."""
    mined = corpus(sources.read_sources(spark, folder), repo_url, **options)
    described = sources.read_metadata(spark, folder).agg(F.collect_list(F.struct("file_path", "file_type", "content")).alias("all")).withColumn("one", F.lit(1))
    rows = mined.withColumn("one", F.lit(1)).join(described, "one", "left")
    some = relational.number_of_queries(F.col("file_results")) > 0
    rows = rows.withColumn("metadata_files", F.when(some, F.col("all")).otherwise(F.array().cast(described.schema["all"].dataType)))
    sinks.write_corpus(rows.select("repo_name", "repo_url", "file_results", "metadata_files"), target)


def build_catalogue(spark: SparkSession, corpus_dir: str, catalogue_path: str, target: str, *, parity: bool = False, min_queries: int = 2) -> dict[str, DataFrame]:
    """Write ``repos``, ``tables``, ``columns``, ``queries`` and ``column_usages`` below ``target``; gives them read back.

    Scraped schemas come first, then what mined DDL adds to them; every table is written as one set.
    """

    def save(rows: DataFrame, name: str) -> DataFrame:
        sinks.write_table(rows, f"{target}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{target}/{name}")

    made = {n: save(t, f"scraped/{n}") for n, t in catalogue.build(sources.read_catalogue(spark, catalogue_path)).items()}
    out = {"repos": save(made["repos"], "repos")}
    out["queries"] = save(catalogue.load_queries(sources.read_corpus(spark, corpus_dir), out["repos"], min_queries=min_queries), "queries")
    new = catalogue.recover_tables(out["queries"], out["repos"], made["tables"], made["columns"], parity=parity)
    for name in ("tables", "columns"):
        out[name] = save(made[name].unionByName(new[name]), name)
    matched, _ = catalogue.usage_table(out["queries"], out["tables"], out["columns"])
    out["column_usages"] = save(matched, "column_usages")
    return out


def plan_queries(spark: SparkSession, built: dict[str, DataFrame], target: str, *, strict: bool = False, sessions: int = 4) -> tuple[DataFrame, DataFrame]:
    """Write and give ``queries_executable`` and ``queries_error`` of all SELECTs of known repositories."""
    mocks = relational.table_columns(built["tables"], built["columns"])
    asked = built["queries"].where("type = 'SELECT' and repo_id is not null").select("repo_id", F.col("id").alias("query_id"), prepare(F.col("sql")).alias("sql"))
    found = sandbox.results(spark, sandbox.plan_repositories(spark, mocks, asked, strict=strict, sessions=sessions))
    sinks.write_table(found, f"{target}/planned")
    found = spark.read.schema(found.schema).parquet(f"{target}/planned")
    good, bad = sandbox.executable(found), sandbox.errors(found, built["repos"])
    sinks.write_table(good, f"{target}/queries_executable")
    sinks.write_table(bad, f"{target}/queries_error")
    return good, bad


def success_report(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(planned, failed, rate): how many queries could be planned."""
    from .functions.reports import success_rate

    both = good.select(F.lit(1).alias("g")).unionAll(bad.select(F.lit(0).alias("g")))
    counted = both.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("planned"), F.count("*").alias("all"))
    return counted.select("planned", (F.col("all") - F.col("planned")).alias("failed"), success_rate(F.col("planned"), F.col("all")).alias("rate"))
