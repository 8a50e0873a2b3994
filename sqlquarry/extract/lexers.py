"""A tolerant scanner of string literals in six families of languages.

It knows comments, the ways to write a string, and enough of expressions to join literals that ``+`` connects.
It never fails: what it doesn't know it passes over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Fixed value: characters of context on each side of a literal.
CONTEXT = 400

# The language of each file ending.
LANGUAGES = {
    "py": "python", "js": "js", "jsx": "js", "ts": "js", "tsx": "js", "c": "cpp", "h": "cpp", "cpp": "cpp",
    "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "java": "java", "kt": "java", "go": "go", "cs": "csharp",
}

_ESCAPED = r"(?:[^{q}\\\n]|\\.|\\\n)*+"
_DOUBLE, _SINGLE = f'"{_ESCAPED.format(q=chr(34))}"', f"'{_ESCAPED.format(q=chr(39))}'"
_BLOCK = r'"""(?:[^"\\]|\\.|"(?!""))*+"""'
_SLASH = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/"


def _spec(comment: str, strings: dict[str, str], char: bool, plus: bool, adjacent: bool = False) -> tuple[re.Pattern, bool, bool]:
    """A scanner: group names say what was found; character literals are passed over like comments."""
    skip = comment + (f"|{_SINGLE}" if char else "")
    parts = [f"(?P<skip>{skip})", *(f"(?P<{n}>{p})" for n, p in strings.items())]
    parts += [r"(?P<op>===|!==|==|!=|<=|>=|=>|->|&&|\|\||\?\?|\+\+|--|\+=|[-*/%&|^]=|<<|>>|[-*/%&|^<>])", r"(?P<plus>\+)"]
    parts += [r"(?P<open>[(\[])", r"(?P<close>[)\]])", r"(?P<end>[;,={}?:]|:=)", r"(?P<word>[\w$.@]+)", r"(?P<line>\n)"]
    return re.compile("|".join(parts), re.DOTALL), plus, adjacent


_SPECS = {
    "python": _spec(
        r"\#[^\n]*",
        {"string": r"(?:\b[rRbBuUfFtT]{1,2})?(?:'''(?:[^'\\]|\\.|'(?!''))*+'''|" + _BLOCK + f"|{_SINGLE}|{_DOUBLE})"},
        char=False,
        plus=False,
    ),
    "js": _spec(_SLASH, {"template": r"`(?:[^`\\]|\\.)*+`", "string": f"{_DOUBLE}|{_SINGLE}"}, char=False, plus=True),
    "java": _spec(_SLASH, {"block": _BLOCK, "string": _DOUBLE}, char=True, plus=True),
    "go": _spec(_SLASH, {"template": r"`[^`]*+`", "string": _DOUBLE}, char=True, plus=True),
    "cpp": _spec(_SLASH, {"raw": r'(?:u8|[uUL])?R"(?P<mark>[^()\s\\]{0,16})\(.*?\)(?P=mark)"', "string": f"(?:u8|[uUL])?{_DOUBLE}"}, char=True, plus=True, adjacent=True),
    "csharp": _spec(_SLASH, {"verbatim": r'(?:@\$?|\$@)"(?:[^"]|"")*+"', "block": r'\$*"""(?:[^"]|"(?!""))*+"""', "string": rf"\$?{_DOUBLE}"}, char=True, plus=True),
}
_NOT_BINARY = {"=>", "->", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="}
_FRAGMENT = re.compile(r"\\|\$\{")


def content(kind: str, raw: str, *, first_fragment: bool = False) -> str:
    """What stands between a literal's quotes, as it is written."""
    if kind == "raw":
        return raw[raw.index("(") + 1 : raw.rindex(")")]
    body = raw.lstrip("rRbBuUfFtTL8$@")
    width = 3 if len(body) >= 6 and body[:3] in ('"""', "'''") else 1
    text = body[width:-width]
    if first_fragment and kind in ("string", "template"):
        cut = _FRAGMENT.search(text)
        text = text[: cut.start()] if cut else text
    return text


@dataclass
class _Chain:
    """Operands at one level of brackets, up to a comma, a semicolon or the like."""

    begin: int | None = None
    parts: list = field(default_factory=list)  # of segments that operators other than + part
    nested: list = field(default_factory=list)
    plus: bool = False
    compared: bool = False
    segment: list = field(default_factory=list)
    ready: bool = False  # an operand has just ended


class _Scan:
    def __init__(self, source: str, language: str, first_fragment: bool):
        self.source, self.first_fragment = source, first_fragment
        self.pattern, self.joins, self.adjacent = _SPECS[language]
        self.language = language

    def found(self, first: tuple[int, int], text: str, begin: int, length: int) -> dict:
        source = self.source
        near = source[max(0, first[0] - CONTEXT) : min(len(source), first[1] + CONTEXT)]
        return {"string": text, "text_context": near, "line_number": source.count("\n", 0, begin) + 1, "node_content_length": length, "text_context_offset": CONTEXT, "at": first[0]}

    def close(self, chain: _Chain, plus: bool) -> list[dict]:
        """What a finished segment gives."""
        strings, nested = chain.segment, chain.nested
        if plus and strings:
            text = "".join(t for _, t in strings)
            return [self.found(strings[0][0], text, chain.begin if chain.begin is not None else strings[0][0][0], len(text))]
        if chain.compared and self.joins:
            strings = []
        alone = [self.found(span, t, span[0], span[1] - span[0]) for span, t in strings]
        return sorted(alone + nested, key=lambda f: f["at"])

    def flush(self, chain: _Chain) -> list[dict]:
        out = chain.parts + self.close(chain, chain.plus)
        chain.parts, chain.compared = [], False
        chain.segment, chain.nested, chain.plus, chain.begin, chain.ready = [], [], False, None, False
        return out

    def run(self) -> list[dict]:
        out: list[dict] = []
        stack = [_Chain()]

        def emit(found: list[dict]) -> None:
            (stack[-2].nested if len(stack) > 1 else out).extend(found)

        for match in self.pattern.finditer(self.source):
            kind, chain = match.lastgroup, stack[-1]
            if kind == "mark":
                kind = "raw"
            if kind in ("skip", "line"):
                continue
            if kind in ("string", "template", "block", "raw", "verbatim"):
                if chain.ready and not (self.adjacent and chain.segment):
                    emit(self.flush(chain))
                elif chain.ready:
                    chain.plus = True
                if chain.begin is None:
                    chain.begin = match.start()
                chain.segment.append((match.span(), content(kind, match[0], first_fragment=self.first_fragment)))
                chain.ready = True
            elif kind == "plus":
                chain.plus, chain.ready = chain.plus or self.joins, False
            elif kind == "word":
                if chain.ready:
                    emit(self.flush(chain))
                if chain.begin is None:
                    chain.begin = match.start()
                chain.ready = True
            elif kind == "open":
                if chain.begin is None:
                    chain.begin = match.start()
                stack.append(_Chain())
            elif kind == "close":
                if len(stack) > 1:
                    emit(self.flush(chain))
                    stack.pop()
                    stack[-1].ready = True
                else:
                    emit(self.flush(chain))
            elif kind == "op" and match[0] not in _NOT_BINARY:
                chain.compared = True
                chain.parts += self.close(chain, chain.plus)
                chain.segment, chain.nested, chain.plus, chain.begin, chain.ready = [], [], False, None, False
            else:
                emit(self.flush(chain))
        while stack:
            emit(self.flush(stack[-1]))
            stack.pop()
        return out


def extract_strings(source: str | None, language: str | None, *, dedupe: bool = False, first_fragment: bool = False) -> list[dict]:
    """The string literals of a source text in order; none in a language without a scanner.

    Literals that ``+`` joins are one, without the operands between them; in C++ adjacent ones too.  Literals that
    other operators compare are left out, except in Python.  Escapes and placeholders stay as they are written;
    with ``first_fragment`` a literal ends before the first of them.  With ``dedupe`` only the first of equal
    strings stays.
    """
    if not source or language not in _SPECS:
        return []
    found = _Scan(source, language, first_fragment).run()
    if dedupe:
        found = list({f["string"]: f for f in reversed(found)}.values())[::-1]
        found.sort(key=lambda f: f["at"])
    return found
