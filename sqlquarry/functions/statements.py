"""Splitting, tidying, classifying and preparing SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words a statement may begin with, in order.
FIRST_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "WITH")

# What counts as a sign of SQL. "CREATE TYPEUNION" is one needle, as the results to match have it.
SIGNS = (
    "SELECT", "FROM", "WHERE", "ALTER", "INSERT INTO", "INSERT OR REPLACE INTO", "VALUES", "JOIN", "LEFT", "RIGHT",
    "INNER", "OUTER", "CREATE", "TABLE", "DROP", "CREATE TYPEUNION", "GROUP BY", "ORDER BY", "HAVING", "LIMIT",
    "OFFSET",
)

#: What Python counts as white space, for Java's engine.
_SPACE = r"[\s\x1c-\x1f]"
#: Runs of text and of quoted strings up to a semicolon. Possessive, so that megabytes don't overflow the stack.
_STATEMENT = r"""(?:[^;'"]++|'[^']*+(?:'|\z)|"[^"]*+(?:"|\z))++"""


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def split_statements(sql: Column) -> Column:
    """The statements of a script: cut at semicolons outside quotes, stripped, without blank ones."""
    parts = F.regexp_extract_all(sql, F.lit(_STATEMENT), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def tidy(sql: Column) -> Column:
    """Without comments, with single blanks around punctuation, in lower case."""
    sql = F.regexp_replace(sql, r"--[^\n]*\n?", " ")
    sql = F.regexp_replace(sql, r"(?s)/\*.*?\*/", " ")
    sql = F.regexp_replace(sql, rf"(?U){_SPACE}+", " ")
    sql = F.regexp_replace(sql, r" ?([(),=<>+\-*/]) ?", " $1 ")
    return F.lower(strip(F.regexp_replace(sql, " +", " ")))


_SIGN = f"(?:{'|'.join(SIGNS)})[ ()]"
#: Two different signs, found in one pass: the first one, held fast, and one that differs from it. The fused sign begins
#: with another one, so alone it is two.
_TWO_SIGNS = rf"(?s)CREATE TYPEUNION[ ()]|(?>\A.*?({_SIGN}))(?=.*?(?!\1){_SIGN})"


def looks_like_sql(text: Column, *, select_only: bool = False) -> Column:
    """Whether a text begins with one of the words and a blank, and shows two signs of SQL."""
    upper = F.upper(text)
    words = "SELECT" if select_only else "|".join(FIRST_WORDS)
    begins = F.regexp_like(upper, F.lit(rf"(?U)\A{_SPACE}*+(?:{words}) "))
    return begins & F.regexp_like(upper, F.lit(_TWO_SIGNS))


def query_type(sql: Column) -> Column:
    """The first of the words that the statement begins with, else UNKNOWN."""
    upper, out = F.upper(sql), F.lit("UNKNOWN")
    for word in reversed(FIRST_WORDS):
        out = F.when(F.startswith(upper, F.lit(word)), word).otherwise(out)
    return out


def line_number(content: Column, needle: Column) -> Column:
    """The number of the first line that contains the needle; 1 if none does."""
    at = F.array_position(F.transform(F.split(content, "\n"), lambda line: F.contains(line, needle)), F.lit(True))
    return F.greatest(at, F.lit(1)).cast("long")


def mentions(sql: Column, tables: list[str] | None = None, columns: list[str] | None = None) -> Column:
    """Whether a statement mentions any of the tables and any of the columns; an empty list asks for nothing."""
    upper, out = F.upper(sql), F.lit(True)
    for names in (tables, columns):
        if names:
            any_of = F.lit(False)
            for name in names:
                any_of = any_of | F.contains(upper, F.lit(name.upper()))
            out = out & any_of
    return out


def prepare(sql: Column) -> Column:
    """Repairs of tidied and templated SQL, in their fixed order; parameters become ``:name``."""
    for old, new in (("`", '"'), ("> =", ">="), ("< =", "<="), ("! =", "!="), ("= =", "="), ("date_format", "strftime")):
        sql = F.replace(sql, F.lit(old), F.lit(new))
    sql = F.regexp_replace(sql, r"(?iU)limit\s+(\d+)\s*,\s*(\d+)", "limit $2 offset $1")
    sql = F.regexp_replace(sql, r"(?iU)\brand\s*\(\s*\)", "random()")
    for mark in ("%s", "%i", "%d"):
        sql = F.replace(sql, F.lit(mark), F.lit(":param_name"))
    sql = F.regexp_replace(sql, r"(?U)#\{(\w+)\}", ":$1")
    return F.regexp_replace(sql, r"(?U)\{\s*(\w+)\s*\}", ":$1")


def context(text: Column, offset: Column, before: int = 10, after: int = 100) -> Column:
    """The part of a text from ``before`` characters before ``offset`` to ``after`` past as many from its end."""
    begin = F.greatest(offset - before, F.lit(1)) if before else offset
    end = F.length(text) - offset + after + 1
    return F.substring(text, begin, F.greatest(end - begin + 1, F.lit(0)))


def underscored_statements(script: Column) -> Column:
    """The statements of a script that lines of underscores part; bracketed names lose their owners."""
    script = F.regexp_replace(script, r"(?U)\[(\w+)\.\w+(?:\.\w+)*\]", "[$1]")
    parts = F.filter(F.transform(F.split(script, "_" * 40), strip), lambda s: s != "")
    return F.transform(parts, lambda s: F.translate(s, "[]", '""'))
