"""Tokens of SQL in any dialect."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/|\#[^\n{][^\n]*)
    |(?P<string>[nN]?'(?:[^']|'')*+'?)
    |(?P<name>(?:(?:`[^`]*`|"[^"]*"|\[[^\]]*\]|[^\W\d][\w$]*)(?:\s*\.\s*(?=[`"\[\w*]))?)+(?:\*)?)
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<place>\?|:\w+|\$\d+|\$\{\w+\}|@\w+|%\w|\#?\{\s*\w+\s*\})
    |(?P<op><=>|->>|->|::|\|\||<>|!=|>=|<=|==|!\s=|>\s=|<\s=|<\s>|[-+*/%=<>&|^~!])
    |(?P<mark>[(),;])
    |(?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)


def tokens(sql: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of each token but white space and comments."""
    return [(m.lastgroup, m[0], m.start(), m.end()) for m in _TOKEN.finditer(sql) if m.lastgroup != "skip"]
