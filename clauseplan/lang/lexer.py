"""Tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

#: Longest first.
SIGNS = ("-->", "<=>", "++?", ":-", ":=", "++=", "+=", "*=", "..", "=>", "==", "<=", ">=", "!=", "||", "&&", "->", "++",
         "(", ")", "[", "]", "{", "}", ",", ";", ":", ".", "?", "|", "~", "<", ">", "=", "+", "-", "*", "/", "%", "^", "!", "@", "$")
_NUMBER = re.compile(r"(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?u?")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Words that are numbers wherever a value may stand.
NUMBER_WORDS = {"inf": float("inf"), "infinity": float("inf"), "nan": float("nan")}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v", "a": "\a"}


@dataclass(frozen=True)
class Token:
    kind: str  # name, number, string, quoted, sign, end
    value: object
    line: int
    start: int
    end: int


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at, line, n = 0, 1, len(source)

    def add(kind: str, value: object, end: int) -> None:
        nonlocal at, line
        out.append(Token(kind, value, line, at, end))
        line += source.count("\n", at, end)
        at = end

    while at < n:
        c = source[at]
        if c.isspace():
            line += c == "\n"
            at += 1
        elif c == "#":
            at = source.find("\n", at)
            at = n if at < 0 else at
        elif source.startswith("/*", at):
            end = source.find("*/", at + 2)
            if end < 0:
                raise ParseError("a comment is not closed", line)
            line += source.count("\n", at, end)
            at = end + 2
        elif source.startswith('"""', at):
            end = source.find('"""', at + 3)
            if end < 0:
                raise ParseError("a string is not closed", line)
            add("string", source[at + 3 : end], end + 3)
        elif c == '"':
            end = source.find('"', at + 1)
            if end < 0 or "\n" in source[at:end]:
                raise ParseError("a string is not closed", line)
            add("string", source[at + 1 : end], end + 1)
        elif c == "'":
            value, end = _escaped(source, at + 1, line)
            add("string", value, end)
        elif c == "`":
            end = source.find("`", at + 1)
            if end < 0:
                raise ParseError("a quoted name is not closed", line)
            add("quoted", source[at + 1 : end], end + 1)
        elif c == "∞":
            add("number", -1, at + 1)
        elif m := _NUMBER.match(source, at):
            word = m[0].rstrip("u")
            add("number", float(word) if re.search(r"[.eE]", word) else int(word), m.end())
        elif m := _NAME.match(source, at):
            add("name", m[0], m.end())
        else:
            for s in SIGNS:
                if source.startswith(s, at):
                    add("sign", s, at + len(s))
                    break
            else:
                raise ParseError(f"{c!r} is not expected", line)
    out.append(Token("end", None, line, n, n))
    return out


def _escaped(source: str, at: int, line: int) -> tuple[str, int]:
    out = []
    while at < len(source):
        c = source[at]
        if c == "'":
            return "".join(out), at + 1
        if c == "\n":
            break
        if c != "\\":
            out.append(c)
            at += 1
            continue
        code = source[at + 1 : at + 2]
        if code in ("x", "u"):
            width = 2 if code == "x" else 4
            digits = source[at + 2 : at + 2 + width]
            if not re.fullmatch(rf"[0-9a-fA-F]{{{width}}}", digits):
                raise ParseError(f"bad escape \\{code}{digits}", line)
            out.append(chr(int(digits, 16)))
            at += 2 + width
        else:
            out.append(_ESCAPES.get(code, code))
            at += 2
    raise ParseError("a string is not closed", line)
