"""Names of repositories, tables, columns and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .statements import strip

_TABLE = r"""(?i)^CREATE (?:OR REPLACE )?TABLE (?:IF NOT EXISTS )?((?U)[`"\[\]\w.]+)"""


def repository(url: Column) -> Column:
    """(name, url) of a repository's canonical address; null if it isn't on one of the two hosts."""
    path = F.replace(url, F.lit("https://"), F.lit(""))
    parts = F.split(path, "/")
    host = F.when(F.contains(path, F.lit("github")), "github.com").otherwise("gitlab.com")
    owner, name = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    known = F.contains(url, F.lit("https://github")) | F.contains(url, F.lit("https://gitlab"))
    return F.when(known & name.isNotNull(), F.struct(name.alias("name"), F.concat(F.lit("https://"), host, F.lit("/"), owner, F.lit("/"), name).alias("url")))


def storage_key(url: Column) -> Column:
    """The folder name under which a repository's results are kept."""
    for gone in ("https://", "http://", "github.com/"):
        url = F.replace(url, F.lit(gone), F.lit(""))
    return F.replace(url, F.lit("/"), F.lit("_"))


def ddl_table(sql: Column) -> Column:
    """The table that a CREATE TABLE statement makes, unqualified, in lower case; null for other statements."""
    flat = F.regexp_replace(strip(sql), r"(?U)[\s\x1c-\x1f]+", " ")
    name = F.regexp_replace(F.regexp_extract(flat, _TABLE, 1), r"""^[`"\[\]]+|[`"\[\]]+$""", "")
    return F.when(F.regexp_like(flat, F.lit(_TABLE)), F.lower(F.substring_index(name, ".", -1)))


def unqualified(name: Column) -> Column:
    """What stands after the last dot."""
    return F.substring_index(name, ".", -1)


def usage_name(name: Column) -> Column:
    """A column name as a query writes it: lower case, unqualified, without quotes at its ends."""
    return F.regexp_replace(unqualified(strip(F.lower(name))), r"""^[`"\[\]]+|[`"\[\]]+$""", "")


def quoted(name: Column) -> Column:
    """An identifier in backquotes."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def extension(path: Column) -> Column:
    """What stands after the last dot of a path; unknown without a dot."""
    return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1)).otherwise("unknown")


def header(content: Column, lines: int = 30) -> Column:
    """The first lines of a file."""
    return F.substring_index(content, "\n", lines)


def parsable_ddl(sql: Column) -> Column:
    """DDL without ``unsigned`` after a decimal and without ``zerofill``."""
    sql = F.regexp_replace(sql, r"(?iU)(decimal\s*\(\s*\d+\s*,\s*\d+\s*\))\s*unsigned", "$1")
    return F.regexp_replace(sql, r"(?iU)\bzerofill\b", "")
