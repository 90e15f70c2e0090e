"""Splitting SQL text: tokens, statements, argument lists."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^'\\]|\\.|'')*')
      | (?P<quoted>`(?:[^`]|``)*`|"(?:[^"]|"")*")
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
      | (?P<variable>@@?[A-Za-z_][\w.]*)
      | (?P<param>\?|\$\d+)
      | (?P<word>[^\W\d]\w*)
      | (?P<sign><=>|<>|!=|<=|>=|->|\|\||::|.)""",
    re.X | re.S,
)


class SqlError(ValueError):
    """A statement that can't be understood or isn't allowed."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text

    @property
    def name(self) -> str:
        """An identifier without its quotes."""
        return self.text[1:-1].replace(self.text[0] * 2, self.text[0]) if self.kind == "quoted" else self.text


def tokens(text: str) -> list[Token]:
    """The tokens of a text, without white space and comments."""
    out = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0]))
    return out


def render(parts: list[Token]) -> str:
    """Tokens as text that reads back the same."""
    out: list[str] = []
    for i, t in enumerate(parts):
        tight = i and (t.text in (".", ",", ")", "]") or parts[i - 1].text in (".", "(", "["))
        call = i and t.text in ("(", "[") and parts[i - 1].kind in ("word", "quoted") and parts[i - 1].up not in _SPACED
        out.append(t.text if not i or tight or call else f" {t.text}")
    return "".join(out)


_SPACED = {"IN", "AS", "AND", "OR", "NOT", "ON", "WHERE", "FROM", "SELECT", "OVER", "VALUES", "EXISTS", "BY", "UNION", "ALL", "EXCEPT", "INTERSECT", "JOIN", "HAVING", "WHEN", "THEN", "ELSE", "USING", "GROUP"}


def string_value(t: Token) -> str:
    """A string literal's value."""
    return re.sub(r"\\(.)|''", lambda m: {"n": "\n", "t": "\t", "0": "\0"}.get(m[1], m[1]) if m[1] else "'", t.text[1:-1], flags=re.S)


def literal(value: object) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def closing(parts: list[Token], start: int) -> int:
    """The place of the bracket that closes the one at ``start``."""
    depth = 0
    for i in range(start, len(parts)):
        if parts[i].text == "(":
            depth += 1
        elif parts[i].text == ")":
            depth -= 1
            if not depth:
                return i
    raise SqlError("a bracket isn't closed")


def split_at(parts: list[Token], sign: str = ",") -> list[list[Token]]:
    """The parts between top-level separators."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in parts:
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.up == sign:
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def statements(script: str) -> list[str]:
    """The statements of a script: split at ``;`` outside quotes, comments and BEGIN..END bodies;
    ``DELIMITER x`` lines set another separator."""
    out, current, depth, separator = [], [], 0, ";"
    first_words: list[str] = []
    at = 0
    while at < len(script):
        m = _TOKEN.match(script, at)
        word = m[0].upper()
        if word == "DELIMITER" and not first_words:
            line, _, _ = script[m.end() :].partition("\n")
            separator = line.strip()
            at = m.end() + len(line)
            continue
        if separator != ";" and script.startswith(separator, at):
            out.append("".join(current))
            current, first_words, depth, at = [], [], 0, at + len(separator)
            continue
        if m.lastgroup == "word":
            body = first_words[:1] == ["CREATE"] and any(x in ("PROCEDURE", "FUNCTION", "TRIGGER") for x in first_words)
            if word in ("BEGIN", "CASE") and body or word in ("IF", "WHILE", "LOOP", "REPEAT") and depth and (not first_words or first_words[-1] != "END"):
                depth += 1
            elif word == "END" and depth:
                depth -= 1
            elif first_words and first_words[-1] == "END" and word in ("IF", "WHILE", "LOOP", "REPEAT", "CASE"):
                pass
            first_words.append(word)
        elif m.lastgroup != "space":
            first_words.append(m[0])
        if separator == ";" and m[0] == ";" and not depth:
            out.append("".join(current))
            current, first_words = [], []
        else:
            current.append(m[0])
        at = m.end()
    out.append("".join(current))
    return [s.strip() for s in out if any(m.lastgroup != "space" for m in _TOKEN.finditer(s))]
