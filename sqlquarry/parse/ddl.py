"""Tables and columns of CREATE TABLE statements in any dialect."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schemas import DDL
from .tokens import tokens

_NOT_COLUMN = {"primary", "unique", "key", "index", "constraint", "foreign", "check", "fulltext", "spatial", "exclude", "like", "period"}
_AFTER_TYPE = {"not", "null", "default", "primary", "unique", "auto_increment", "autoincrement", "comment", "references", "check", "collate", "constraint", "generated", "as", "on", "key", "identity", "character", "charset", "virtual", "stored", "zerofill", "invisible", "encode", "distkey", "sortkey", "options"}


def _bare(name: str) -> str:
    return ".".join(p.strip().strip('`"[]') for p in name.split("."))


def parse_create_table(sql: str | None, *, parity: bool = False) -> dict | None:
    """(table_name, columns) of a statement; None for other statements.

    The table's name is qualified and in lower case.  A column's type is all of its words and numbers; with
    ``parity`` only its first word, and a key that the table names after its columns counts for none.
    """
    found = tokens(sql or "")
    low = [t[1].lower() for t in found]
    if "create" not in low[:1] or "table" not in low[:6]:
        return None
    at = low.index("table") + 1
    if low[at : at + 3] == ["if", "not", "exists"]:
        at += 3
    if at >= len(found) or found[at][0] != "name":
        return None
    table = _bare(found[at][1]).lower()
    while at < len(found) and low[at] != "(":
        if low[at] in ("as", "select"):
            return {"table_name": table, "columns": []}
        at += 1
    columns: list[dict] = []
    keys: set[str] = set()
    parts: list[list[int]] = [[]]
    depth = 0
    for i in range(at, len(found)):
        depth += (low[i] == "(") - (low[i] == ")")
        if depth == 0:
            break
        if depth == 1 and low[i] == ",":
            parts.append([])
        elif not (depth == 1 and low[i] == "(" and i == at):
            parts[-1].append(i)
    for own in parts:
        if not own or found[own[0]][0] != "name":
            continue
        first, quoted = low[own[0]], found[own[0]][1][:1] in '`"['
        words = [low[i] for i in own]
        if not quoted and first in _NOT_COLUMN:
            if "primary" in words and "key" in words:
                keys |= {_bare(found[i][1]).lower() for i in own if found[i][0] == "name" and low[i] not in ("primary", "key", "constraint", "using", "btree", "clustered")}
            continue
        kind: list[int] = []
        for i in own[1:]:
            open_ = sum((low[j] == "(") - (low[j] == ")") for j in kind)
            if not open_ and low[i] in _AFTER_TYPE and not (low[i] == "character" and not kind):
                break
            kind.append(i)
        text = ""
        for i in kind:
            glue = " " if text and found[i][0] == "name" and text[-1] not in "(," else ""
            text += glue + found[i][1]
        if parity and kind:
            text = found[kind[0]][1]
        inline = any(words[k : k + 2] == ["primary", "key"] for k in range(len(words)))
        columns.append({"name": _bare(found[own[0]][1]), "type": text or None, "is_primary_key": inline})
    if not parity:
        for c in columns:
            c["is_primary_key"] = c["is_primary_key"] or c["name"].lower() in keys
    return {"table_name": table, "columns": columns}


def parse_tables(queries: DataFrame, *, key: str = "id", sql: str = "sql", parity: bool = False) -> DataFrame:
    """(key, table_name, columns) of each statement that makes a table, in Arrow batches."""
    schema = T.StructType([T.StructField(key, queries.schema[key].dataType), *DDL.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            parsed = [(k, parse_create_table(s, parity=parity)) for k, s in zip(batch.column(key).to_pylist(), batch.column(sql).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{key: k, **p} for k, p in parsed if p], schema=out)

    return queries.select(key, sql).mapInArrow(run, schema)
