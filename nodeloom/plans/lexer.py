"""Text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .tree import QueryError

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<float>(?:\d[\d_]*\.(?!\.)\d[\d_]*|\.\d[\d_]*|\d[\d_]*(?=[eE][+-]?\d))(?:[eE][+-]?\d+)?)
    |(?P<int>0x[0-9a-fA-F_]+|0o[0-7_]+|\d[\d_]*)
    |(?P<name>[^\W\d]\w*|`(?:[^`]|``)*`)
    |(?P<param>\$(?:\w+|`(?:[^`]|``)*`))
    |(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
    |(?P<sign><>|!=|<=|>=|=~|\.\.|\|\||\+=|[-+*/%^=<>()\[\]{}.,:;|$&!])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\\": "\\", "'": "'", '"': '"', "`": "`"}


@dataclass(frozen=True)
class Token:
    kind: str  # float, int, name, param, string, sign, end
    value: object
    start: int
    end: int
    quoted: bool = False

    @property
    def word(self) -> str:
        """The upper-case keyword that this could be."""
        return self.value.upper() if self.kind == "name" and not self.quoted else ""


def _unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        c = m[1]
        if c[0] in "uU":
            return chr(int(c[1:], 16))
        if c not in _ESCAPES:
            raise QueryError(f"unknown escape \\{c}")
        return _ESCAPES[c]

    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, body, flags=re.S)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        kind, s = m.lastgroup, m[0]
        if kind == "int":
            value = int(s.replace("_", ""), 0 if s[:2] in ("0x", "0o") else 10)
            if value > 2**63:
                raise QueryError(f"integer {s} is out of range")
            out.append(Token(kind, value, at, m.end()))
        elif kind == "float":
            out.append(Token(kind, float(s.replace("_", "")), at, m.end()))
        elif kind in ("name", "param"):
            body = s[1:] if kind == "param" else s
            quoted = body[0] == "`"
            out.append(Token(kind, body[1:-1].replace("``", "`") if quoted else body, at, m.end(), quoted))
        elif kind == "string":
            out.append(Token(kind, _unescape(s[1:-1]), at, m.end()))
        elif kind == "sign":
            out.append(Token(kind, s, at, m.end()))
        at = m.end()
    out.append(Token("end", "", len(text), len(text)))
    return out
