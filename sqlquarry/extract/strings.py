"""SQL in source files: split or extracted, tidied, tested and typed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import names, statements
from ..operators.relational import computed, nest_queries
from ..schemas import EXTRACTED
from . import lexers


def literals(files: DataFrame, *, dedupe: bool = False, first_fragment: bool = False) -> DataFrame:
    """(file_path, ordinal, string, ...) of every literal of (file_path, content), in Arrow batches."""
    schema = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("ordinal", T.LongType()), *EXTRACTED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        fields = [f.name for f in EXTRACTED.fields]
        rows: list[tuple] = []

        def emit(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), out, strict=True)], schema=out)

        for batch in batches:
            for path, content in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                language = lexers.LANGUAGES.get((path or "").rpartition(".")[2].lower())
                found = lexers.extract_strings(content, language, dedupe=dedupe, first_fragment=first_fragment)
                rows += [(path, i, *(f[n] for n in fields)) for i, f in enumerate(found)]
                while len(rows) >= 2000:
                    yield emit(rows[:2000])
                    rows = rows[2000:]
        if rows:
            yield emit(rows)

    return files.select("file_path", "content").mapInArrow(run, schema)


def script_statements(files: DataFrame) -> DataFrame:
    """The same of SQL scripts, without leaving the JVM."""
    split = files.select("file_path", "content", F.posexplode(statements.split_statements(F.col("content"))).alias("ordinal", "string"))
    return split.select(
        "file_path",
        F.col("ordinal").cast("long").alias("ordinal"),
        "string",
        F.lit("").alias("text_context"),
        statements.line_number(F.col("content"), F.col("string")).alias("line_number"),
        F.length("string").cast("long").alias("node_content_length"),
        F.lit(lexers.CONTEXT).cast("long").alias("text_context_offset"),
    )


def extract_sql(files: DataFrame, *, tables: list[str] | None = None, columns: list[str] | None = None, select_only: bool = False) -> DataFrame:
    """(file_path, ordinal, name, type, sql, line, text_context, text_context_offset) of the SQL in source files."""
    script = F.endswith("file_path", F.lit(".sql"))
    found = script_statements(files.where(script)).unionByName(literals(files.where(~script)))
    sql = computed(found, sql=statements.tidy(F.col("string"))).where("sql <> ''")
    sql = sql.where(statements.looks_like_sql(F.col("sql"), select_only=select_only) & statements.mentions(F.col("sql"), tables, columns))
    numbered = sql.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "sql", "line_number", "text_context", "text_context_offset"))).alias("found"))
    rows = numbered.select("file_path", F.posexplode("found").alias("at", "q"))
    return rows.select(
        "file_path",
        F.col("at").cast("long").alias("ordinal"),
        F.concat(F.lit("query_"), (F.col("at") + 1).cast("string")).alias("name"),
        statements.query_type(F.col("q.sql")).alias("type"),
        "q.sql",
        F.col("q.line_number").alias("line"),
        "q.text_context",
        "q.text_context_offset",
    )


def corpus(files: DataFrame, repo_url: str, **options) -> DataFrame:
    """The nested corpus row of one repository's (file_path, content); files without SQL keep an empty list."""
    repo = names.repository(F.lit(repo_url))
    queries = extract_sql(files, **options)
    query_fields = ("ordinal", "name", "type", "sql", "line", "text_context", "text_context_offset")
    joined = files.select("file_path", names.header(F.col("content")).alias("header")).join(queries, "file_path", "left")
    rows = joined.select(repo["name"].alias("repo_name"), repo["url"].alias("repo_url"), "file_path", names.extension(F.col("file_path")).alias("language"), F.when(F.max("ordinal").over(_by_file()).isNotNull(), F.col("header")).otherwise("").alias("header"), *query_fields)
    nested = nest_queries(rows)
    keep = F.transform("file_results", lambda f: f.withField("queries", F.filter(f["queries"], lambda q: q["sql"].isNotNull())))
    return nested.withColumn("file_results", keep)


def _by_file():
    from pyspark.sql import Window

    return Window.partitionBy("file_path")
