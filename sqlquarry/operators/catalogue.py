"""The relational catalogue: repositories, tables, columns, queries and usages, each built as one set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, types
from ..parse import ddl, usages
from . import relational


def build(entries: DataFrame) -> dict[str, DataFrame]:
    """``repos``, ``tables`` and ``columns`` of catalogue entries (file_key, source, position, info, tables).

    The first entry of a repository and the first table of a name in it win, a table with its columns.  Entries on
    unknown hosts are left out.
    """
    rows = entries.withColumn("file_url", F.trim("info.URL"))
    rows = rows.withColumn("repo", names.repository(F.col("file_url"))).where("repo is not null")
    first = rows.groupBy(F.col("repo.url").alias("repo_url")).agg(F.min(F.struct("source", "position", F.col("repo.name").alias("repo_name"))).alias("f"))
    repos = relational.with_positions(first.select("repo_url", "f.source", "f.position", "f.repo_name"), ["source", "position"], start=1)
    found = rows.select(F.col("repo.url").alias("repo_url"), "source", "position", "file_url", F.posexplode(F.map_entries("tables")).alias("table_at", "t"))
    found = found.select("repo_url", "source", "position", "file_url", "table_at", F.col("t.key").alias("table_name"), F.col("t.value.COLUMNS").alias("own"))
    kept = relational.first_by(found, ["repo_url", "table_name"], ["source", "position", "table_at"])
    kept = relational.with_positions(kept, ["source", "position", "table_at"], start=1)
    tables = kept.join(repos.select("repo_url", F.col("id").alias("repo_id")), "repo_url")
    wide = kept.select(F.col("id").alias("table_id"), F.posexplode(F.map_entries("own")).alias("column_at", "c"))
    wide = relational.with_positions(wide, ["table_id", "column_at"], start=1)
    columns = typed_columns(wide.select("id", "table_id", F.col("c.key").alias("column_name"), F.coalesce("c.value.TYPE", F.lit("unknown")).alias("column_type_original"), F.coalesce("c.value.UNIQUE", F.lit(False)).alias("is_unique"), F.coalesce("c.value.NULLABLE", F.lit(True)).alias("is_nullable"), F.coalesce("c.value.IS_INDEX", F.lit(False)).alias("is_indexed"), F.coalesce("c.value.IS_PRIMARY", F.lit(False)).alias("is_primary_key")))
    return {
        "repos": repos.select("id", "repo_name", "repo_url"),
        "tables": tables.select("id", "repo_id", "table_name", names.unqualified(F.col("table_name")).alias("table_name_clean"), "file_url"),
        "columns": columns,
    }


def typed_columns(columns: DataFrame) -> DataFrame:
    """Columns with canonical, base and semantic types; types are unified once for each distinct spelling."""
    kinds = columns.select("column_type_original").distinct().withColumn("u", types.unify(F.col("column_type_original")))
    rows = columns.join(kinds, "column_type_original")
    return rows.select(
        "id",
        "table_id",
        "column_name",
        F.col("u.type").alias("column_type"),
        F.col("u.base").alias("column_base_type"),
        "column_type_original",
        types.meaning(F.col("column_name"), F.col("u.base")).alias("semantic_type"),
        "is_unique",
        "is_nullable",
        "is_indexed",
        "is_primary_key",
    )


def load_queries(corpus: DataFrame, repos: DataFrame, *, min_queries: int = 2) -> DataFrame:
    """The flat ``queries`` table: ids from 0 in order of repository, file and place; unknown repositories stay."""
    flat = relational.with_positions(relational.flat_queries(corpus, min_queries=min_queries), ["repo_url", "file_path", "ordinal"])
    joined = flat.join(repos.select("repo_url", F.col("id").alias("repo_id")), "repo_url", "left")
    return joined.select("id", "repo_id", "file_path", "header", "sql", "line", "file_language", "text_context", "text_context_offset", "type")


def recover_tables(queries: DataFrame, repos: DataFrame, tables: DataFrame, columns: DataFrame, *, parity: bool = False) -> dict[str, DataFrame]:
    """``tables`` and ``columns`` that mined DDL adds to the catalogue; the first statement for a table wins.

    With ``parity`` a key lands in ``is_unique`` and the clean name keeps its schema, as in the results to match.
    """
    made = queries.where("type = 'CREATE'").withColumn("query_table", names.ddl_table(F.col("sql"))).where("query_table is not null")
    made = made.join(repos.select(F.col("id").alias("repo_id"), "repo_url"), "repo_id")
    known = tables.select("repo_id", F.lower("table_name_clean").alias("query_table"))
    new = relational.without(made, known, {"repo_id": "repo_id", "query_table": "query_table"})
    parsed = ddl.parse_tables(new.select("id", "sql"), parity=parity).withColumnRenamed("id", "query_id")
    rows = parsed.join(new.select(F.col("id").alias("query_id"), "repo_id", "repo_url", "file_path"), "query_id")
    first = relational.first_by(rows.select("repo_id", "table_name", "query_id", "file_path", "columns"), ["repo_id", "table_name"], ["query_id"])
    last_table, last_column = (t.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] for t in (tables, columns))
    first = relational.with_positions(first, ["query_id", "repo_id", "table_name"], start=last_table + 1)
    clean = F.col("table_name") if parity else names.unqualified(F.col("table_name"))
    wide = relational.with_positions(first.select(F.col("id").alias("table_id"), F.posexplode("columns").alias("at", "c")), ["table_id", "at"], start=last_column + 1)
    key = F.coalesce("c.is_primary_key", F.lit(False))
    wide = wide.select("id", "table_id", F.col("c.name").alias("column_name"), F.coalesce("c.type", F.lit("unknown")).alias("column_type_original"), (key if parity else F.lit(False)).alias("is_unique"), F.lit(True).alias("is_nullable"), F.lit(False).alias("is_indexed"), (F.lit(False) if parity else key).alias("is_primary_key"))
    return {"tables": first.select("id", "repo_id", "table_name", clean.alias("table_name_clean"), F.col("file_path").alias("file_url")), "columns": typed_columns(wide)}


def usage_table(queries: DataFrame, tables: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``column_usages`` and the usages that match no column; only queries that mention a known column are parsed."""
    options = relational.candidates(queries, tables, columns)
    found = usages.column_usages(usages.analyse_queries(options.select("query_id", "sql")))
    linked = relational.link_usages(found, options)
    matched = linked.where("column_id is not null").select(F.col("query_id").alias("id"), "column_id", "query_id", "operator_type", "expression", "other_operand")
    return matched, linked.where("column_id is null").drop("column_id")


def type_counts(queries: DataFrame) -> DataFrame:
    """How many queries there are of each type, most first."""
    return queries.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc("type"))


def join_types(usage: DataFrame, columns: DataFrame, queries: DataFrame, base: str | None = "Float") -> DataFrame:
    """Original types of columns of a base type (None: of any) that joins compare, with their number and repositories."""
    own = columns.where(F.lit(True) if base is None else F.col("column_base_type") == base).select(F.col("id").alias("column_id"), "column_type_original", "column_base_type")
    rows = usage.where("operator_type = 'JOIN'").join(own, "column_id").join(queries.select(F.col("id").alias("query_id"), "repo_id"), "query_id")
    return rows.groupBy("column_type_original").agg(F.any_value("column_base_type", True).alias("column_base_type"), F.count("*").alias("cnt"), F.array_sort(F.collect_set("repo_id")).alias("repos")).orderBy(F.desc("cnt"), F.asc("column_type_original"))


def queries_with_joins(queries: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """SELECTs with a join, once for each column whose own and whose table's name they contain as written."""
    q = queries.where(F.contains(F.lower("sql"), F.lit("join")) & (F.col("type") == "SELECT")).select("repo_id", "sql", F.lower("sql").alias("low"))
    met = q.join(tables.select("repo_id", F.col("id").alias("table_id"), "table_name_clean"), "repo_id").where(F.contains("low", "table_name_clean"))
    return met.join(columns.select("table_id", "column_name"), "table_id").where(F.contains("low", "column_name")).select("sql")


def repair_candidates(errors: DataFrame, queries: DataFrame, *, limit: int = 50) -> DataFrame:
    """(query_id, sql, context) of the first queries that didn't parse and have a context."""
    from ..functions.statements import context

    failed = errors.where(F.contains("error_message", F.lit("Query parsing")) | F.contains("error_message", F.lit("PARSE_SYNTAX_ERROR"))).select("query_id").distinct()
    rows = failed.join(queries.where(F.length("text_context") != 0).withColumnRenamed("id", "query_id"), "query_id")
    return rows.select("query_id", "sql", context(F.col("text_context"), F.col("text_context_offset").cast("int")).alias("context")).distinct().orderBy("query_id").limit(limit)
