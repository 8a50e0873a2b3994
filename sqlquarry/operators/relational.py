"""Ids, deduplication, nested data and joins of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def with_positions(rows: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """Consecutive numbers in the given order, without one task that sees all rows.

    Rows are dealt to ranges of the order and numbered within each; the sizes of the ranges before are added.  Rows
    that are equal in all of ``order`` get numbers in any order.  The numbered rows are staged: both the sizes and the
    result need them, and what stands on the result doesn't make them again.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    within = Window.partitionBy("_range").orderBy(*keys)
    numbered = stage(dealt.withColumn("_within", F.row_number().over(within)), "positions")
    sizes = numbered.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    out = numbered.join(starts, "_range")
    return out.withColumn(name, (F.col("_before") + F.col("_within") - 1 + start).cast("long")).drop("_range", "_within", "_before")


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Costly columns, each computed once however often what follows names them.

    A filter on a plain column is pushed below it with the column's expression in it, which is then evaluated in both
    places, several times over.  A generator is as far as filters are pushed.
    """
    for name, column in columns.items():
        rows = rows.select(*(c for c in rows.columns if c != name), F.explode(F.array(column)).alias(name))
    return rows


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; with map-side combination, so a frequent key costs no more than others."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_first.{c}").alias(c) for c in rest)).select(rows.columns)


def without(rows: DataFrame, known: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows that have no match; unlike NOT IN, nulls among the known change nothing."""
    condition = [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in on.items()]
    return rows.alias("l").join(known.alias("r"), condition, "left_anti")


def flat_queries(corpus: DataFrame, *, min_queries: int = 2) -> DataFrame:
    """One row for each query of the nested corpus, from files with at least ``min_queries``."""
    files = corpus.select("repo_url", F.explode("file_results").alias("f")).select("repo_url", "f.*")
    return (
        files.where(F.size("queries") >= min_queries)
        .select("repo_url", "file_path", "header", F.col("language").alias("file_language"), F.posexplode("queries").alias("ordinal", "q"))
        .select("repo_url", "file_path", "header", "file_language", "ordinal", "q.sql", "q.line", "q.text_context", "q.text_context_offset", "q.type")
    )


def nest_queries(queries: DataFrame) -> DataFrame:
    """The inverse: one row for each repository with its files and their queries in order."""
    query = F.struct("ordinal", F.struct("name", "type", "sql", "line", "text_context", "text_context_offset").alias("q"))
    files = queries.groupBy("repo_name", "repo_url", "file_path", "language", "header").agg(F.transform(F.array_sort(F.collect_list(query)), lambda x: x["q"]).alias("queries"))
    file = F.struct("file_path", "language", "header", "queries")
    return files.groupBy("repo_name", "repo_url").agg(F.array_sort(F.collect_list(file), lambda a, b: F.when(a["file_path"] < b["file_path"], -1).when(a["file_path"] > b["file_path"], 1).otherwise(0)).alias("file_results"))


def number_of_queries(file_results: Column) -> Column:
    """How many queries a repository's files have."""
    return F.aggregate(file_results, F.lit(0), lambda n, f: n + F.coalesce(F.size(f["queries"]), F.lit(0)))


def candidates(queries: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(query_id, repo_id, sql, options): SELECTs with the columns that their text may mean, in id order.

    Repository equality carries the join; that names occur in the text is checked on its rows, first the few tables
    and then the columns of those, so a query never meets columns of a table that it doesn't mention.
    """
    q = queries.where("type = 'SELECT'").select(F.col("id").alias("query_id"), "repo_id", "sql", F.lower("sql").alias("low"))
    t = tables.where(F.length("table_name_clean") >= 3).select("repo_id", F.col("id").alias("table_id"), F.lower("table_name_clean").alias("table_name"))
    c = columns.where((F.length("column_name") >= 3) | (F.lower("column_name") == "id")).select("table_id", F.col("id").alias("column_id"), F.lower("column_name").alias("column_name"))
    met = q.join(t, "repo_id").where(F.contains("low", "table_name")).join(c, "table_id").where(F.contains("low", "column_name"))
    option = F.struct("column_id", "column_name", "table_id", "table_name")
    return met.groupBy("query_id", "repo_id").agg(F.any_value("sql", True).alias("sql"), F.array_sort(F.collect_list(option)).alias("options"))


def link_usages(usages: DataFrame, options: DataFrame) -> DataFrame:
    """Usages (query_id, name, ...) with the least column id of that name among a query's options; null if none has it.

    ``options`` is ``candidates``' result.
    """
    named = options.select("query_id", F.explode("options").alias("o")).groupBy("query_id", F.col("o.column_name").alias("name")).agg(F.min("o.column_id").alias("column_id"))
    return usages.join(named, ["query_id", "name"], "left")


def table_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(repo_id, table_id, table_name, columns): each table with its distinct (id, name, type) columns in id order."""
    t = tables.select(F.col("id").alias("table_id"), "repo_id", "table_name")
    c = columns.select("table_id", F.struct(F.col("id"), F.col("column_name").alias("name"), F.col("column_base_type").alias("type")).alias("c"))
    return t.join(c, "table_id").groupBy("repo_id", "table_id").agg(F.any_value("table_name", True).alias("table_name"), F.array_sort(F.collect_set("c")).alias("columns"))


def column_lists(columns: DataFrame) -> DataFrame:
    """(table_id, names): the column names of each table in order, double ones as often as they come."""
    return columns.groupBy("table_id").agg(F.array_sort(F.collect_list("column_name")).alias("names"))


def pending(repo_list: DataFrame, processed: DataFrame, *, seed: int | None = None) -> DataFrame:
    """Addresses that aren't processed yet, shuffled if a seed is given."""
    out = without(repo_list.select("url"), processed, {"url": "repo_url"})
    return out if seed is None else out.orderBy(F.rand(seed))
