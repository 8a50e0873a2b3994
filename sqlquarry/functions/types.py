"""Canonical column types, what stands for them in mock tables, and semantic types of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .statements import strip

# Base names of the integer families, smallest first; a name counts for the first family that has it.
INTEGERS = {
    "Int8": ("bit", "int1", "int8", "tinyint"),
    "Int16": ("int16", "int2", "smallint", "smallserial"),
    "Int24": ("int24", "int3", "mediumint"),
    "Int32": ("int", "int32", "int4", "integer", "serial"),
    "Int64": ("bigint", "bigserial", "int64", "int8", "long"),
}

# Words of the other types in the order in which they are tried, with canonical and base type.
WORDS = (
    ("Float", "Float", ("float", "float4", "float8", "double", "doubleprecision", r"double\s+precision", "real", "decimal", "dec", "numeric", "number")),
    ("Enum", "Enum", ("enum", "set")),
    ("VARCHAR", "Text", ("char[ _]?varying", "string", "longvarchar", "varchar", "character", "charactervarying", "longtext", "nvarchar", "varchar2", "nvarchar2", "text", "clob")),
    ("CHAR", "Text", ("char", "nchar", "bpchar", "mediumtext", "tinytext", "character varying")),
    ("Boolean", "Boolean", ("bool", "boolean", "boolean_char")),
    ("Timestamp", "DateTime", ("date", "time", "datetime", "datetime2", "time_stamp", "timestamp", "timestamptz", "smalldatetime", "timetz", "interval")),
    ("Binary", "Binary", ("blob", "binary", "varbinary", "bytea", "image", "longblob", "mediumblob", "tinyblob")),
    ("JSON", "JSON", ("json", "jsonb")),
    ("UUID", "Int", ("uuid", "uniqueidentifier")),
    ("XML", "XML", ("xml",)),
)

# DuckDB type and sample literal of each base type.
DUCKDB = {
    "Int": ("INTEGER", "42"),
    "Float": ("DOUBLE", "3.14"),
    "Text": ("VARCHAR", "'example text'"),
    "Boolean": ("BOOLEAN", "TRUE"),
    "DateTime": ("TIMESTAMP", "'2023-10-01 12:00:00'"),
    "Binary": ("BLOB", r"'\xDEADBEEF'"),
    "JSON": ("JSON", '{"key": "value"}'),
    "UUID": ("UUID", "'123e4567-e89b-12d3-a456-426614174000'"),
    "XML": ("XML", "<root><element>value</element></root>"),
    "Enum": ("VARCHAR", "'enum_value'"),
    "ARRAY": ("ARRAY", "[1, 2, 3]"),
    "OTHER": ("OTHER", "NULL"),
}

#: Spark type and sample expression of each base type in mock tables.
SPARK = {
    "Int": ("INT", "42"),
    "Float": ("DOUBLE", "3.14D"),
    "Text": ("STRING", "'example text'"),
    "Boolean": ("BOOLEAN", "TRUE"),
    "DateTime": ("TIMESTAMP_NTZ", "TIMESTAMP_NTZ'2023-10-01 12:00:00'"),
    "Binary": ("BINARY", "X'DEADBEEF'"),
    "JSON": ("STRING", "'{\"key\": \"value\"}'"),
    "UUID": ("STRING", "'123e4567-e89b-12d3-a456-426614174000'"),
    "XML": ("STRING", "'<root><element>value</element></root>'"),
    "Enum": ("STRING", "'enum_value'"),
    "ARRAY": ("ARRAY<INT>", "array(1, 2, 3)"),
    "OTHER": ("STRING", "NULL"),
}

#: Base types whose mock table can't be created, or is created but stays empty, under the results to match.
NO_TABLE, NO_ROWS = ("XML", "ARRAY", "OTHER"), ("JSON",)

# Words in a column's name and its semantic type, in the order in which they are tried.
MEANINGS = (
    ("ID", ("id", "uuid", "guid")),
    ("AMOUNT", ("amount", "price", "cost", "value", "budget", "fee", "salary", "revenue", "expense")),
    ("COUNT", ("count", "quantity", "number", "total")),
    ("DATE", ("date", "time", "timestamp", "created", "updated", "month", "year", "day", "_at")),
    ("NAME", ("name", "title")),
    ("PASSWORD", ("password", "passcode", "secret", "token", "secret")),
    ("EMAIL", ("email",)),
    ("URL", ("url", "link")),
    ("STATUS", ("status", "state")),
    ("ADDRESS", ("address", "location", "city", "country", "zip", "postal", "street")),
    ("CATEGORY", ("category", "type", "kind")),
    ("FULL_TEXT", ("text", "description", "content", "body", "summary", "note", "comment")),
)


def integer_names(base: str) -> list[str]:
    """The spellings of an integer type with and without its sign."""
    return [base + s for s in ("", "signed", "u", "unsigned")] + [s + base for s in ("signed", "u", "unsigned")]


def integer_pattern(bases: tuple[str, ...]) -> str:
    """A pattern for all spellings of a family, as whole words."""
    return rf"\b({'|'.join(sorted({n for b in bases for n in integer_names(b)}))})\b"


def word_pattern(words: tuple[str, ...]) -> str:
    return rf"\b({'|'.join(words)})\b"


def _pair(canonical: Column | str, base: str) -> Column:
    canonical = F.lit(canonical) if isinstance(canonical, str) else canonical
    return F.struct(canonical.alias("type"), F.lit(base).alias("base"))


def unify(raw: Column) -> Column:
    """(type, base): the canonical name and the base type of a column type as a schema writes it."""
    t = F.lower(strip(raw))
    scaled = F.regexp_extract(t, r"\((\d+)(?:,(\d+))?\)", 0)
    precision = F.regexp_extract(t, r"\((\d+)(?:,(\d+))?\)", 1)
    scale = F.regexp_extract(t, r"\((\d+)(?:,(\d+))?\)", 2)
    scale = F.when(scale == "", "0").otherwise(scale)
    number = F.concat(F.lit("number("), precision, F.lit(","), scale, F.lit(")"))
    bare = F.regexp_replace(t, r"\(.*\)", "")
    unsigned = F.contains(bare, F.lit("unsigned")) | F.startswith(bare, F.lit("u"))
    out = _pair("OTHER", "OTHER")
    for canonical, base, words in reversed(WORDS):
        out = F.when(F.regexp_like(bare, F.lit("(?U)" + word_pattern(words))), _pair(canonical, base)).otherwise(out)
    for name, bases in reversed(INTEGERS.items()):
        whole = F.when(unsigned, f"U{name}").otherwise(name)
        out = F.when(F.regexp_like(bare, F.lit("(?U)" + integer_pattern(bases))), _pair(whole, "Int")).otherwise(out)
    decimal = (F.contains(t, F.lit("number")) | F.contains(t, F.lit("decimal"))) & (scaled != "")
    out = F.when(decimal & (scale == "0"), _pair(number, "Int")).when(decimal, _pair(number, "Float")).otherwise(out)
    out = F.when(t.isin("number", "numeric", "decimal"), _pair(t, "Int")).otherwise(out)
    return F.when(raw.isNull(), _pair("OTHER", "OTHER")).when(t == "array", _pair("ARRAY", "ARRAY")).otherwise(out)


def _of(table: dict[str, tuple[str, str]], base: Column, at: int) -> Column:
    out = F.lit(table["OTHER"][at])
    for name, values in table.items():
        out = F.when(base == name, values[at]).otherwise(out)
    return out


def duckdb_type(base: Column) -> Column:
    return _of(DUCKDB, base, 0)


def sample_literal(base: Column) -> Column:
    return _of(DUCKDB, base, 1)


def spark_type(base: Column) -> Column:
    return _of(SPARK, base, 0)


def meaning(name: Column, base: Column) -> Column:
    """The semantic type of a column, from its base type and the words in its name; null if nothing fits."""
    lower, numeric = F.lower(name), base.isin("Int", "Float")
    out = F.when(base == "Binary", "BINARY").when(base == "JSON", "JSON")
    for tag, words in reversed(MEANINGS):
        has = F.lit(False)
        for word in words:
            has = has | F.contains(lower, F.lit(word))
        out = F.when((has & numeric) if tag in ("AMOUNT", "COUNT") else has, tag).otherwise(out)
    return F.when(base == "Boolean", "BOOLEAN").when(base == "DateTime", "TIMESTAMP").otherwise(out)
