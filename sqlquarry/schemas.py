"""Schemas of the nested corpus and of the flat catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


QUERY = _struct(name=_S, type=_S, sql=_S, line=_L, text_context=_S, text_context_offset=_L)
FILE = _struct(file_path=_S, language=_S, header=_S, queries=T.ArrayType(QUERY))
METADATA = _struct(file_path=_S, file_type=_S, content=_S)
CORPUS = _struct(repo_name=_S, repo_url=_S, file_results=T.ArrayType(FILE), metadata_files=T.ArrayType(METADATA))

REPO_LIST = _struct(name=_S, url=_S, license=_S, permissive=_B)
REPOS = _struct(id=_L, repo_name=_S, repo_url=_S)
TABLES = _struct(id=_L, repo_id=_L, table_name=_S, table_name_clean=_S, file_url=_S)
COLUMNS = _struct(
    id=_L, table_id=_L, column_name=_S, column_type=_S, column_base_type=_S, column_type_original=_S, semantic_type=_S,
    is_unique=_B, is_nullable=_B, is_indexed=_B, is_primary_key=_B,
)
QUERIES = _struct(id=_L, repo_id=_L, file_path=_S, header=_S, sql=_S, line=_L, file_language=_S, text_context=_S, text_context_offset=_L, type=_S)
COLUMN_USAGES = _struct(id=_L, column_id=_L, query_id=_L, operator_type=_S, expression=_S, other_operand=_S)
EXECUTABLE = _struct(id=_L, query_id=_L, original_sql=_S, executable_sql=_S, logical_plan=_S, logical_plan_optimized=_S, physical_plan=_S)
ERRORS = _struct(id=_L, repo_id=_L, repo_url=_S, query_id=_L, error_message=_S, original_sql=_S, executable_sql=_S)

#: A schema catalogue: a JSON object with an entry for each scraped file.
CATALOGUE_COLUMN = _struct(TYPE=_S, UNIQUE=_B, NULLABLE=_B, IS_INDEX=_B, IS_PRIMARY=_B)
CATALOGUE = T.MapType(
    _S,
    _struct(
        INFO=_struct(URL=_S, LICENSE=_S, PERMISSIVE=_B),
        TABLES=T.MapType(_S, _struct(COLUMNS=T.MapType(_S, CATALOGUE_COLUMN))),
    ),
)

EXTRACTED = _struct(string=_S, text_context=_S, line_number=_L, node_content_length=_L, text_context_offset=_L)
USAGE = _struct(table_name=_S, column_name=_S, operator_type=_S, operator=_S, other_operand=_S)
ANALYSIS = _struct(n_selects=_L, n_joins=_L, n_conditions=_L, n_group_bys=_L, n_order_bys=_L, column_usages=T.ArrayType(USAGE))
DDL_COLUMN = _struct(name=_S, type=_S, is_primary_key=_B)
DDL = _struct(table_name=_S, columns=T.ArrayType(DDL_COLUMN))
