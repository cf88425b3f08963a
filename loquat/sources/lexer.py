"""Tokens of Swift source text: names, literals with their segments, signs; comments are skipped.

Positions are UTF-8: lines from 1, columns from 1 in bytes. String text stays undecoded, as written.
A text comes in pieces, of which only those are kept that tokens still point to: its length does not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

NAME, STRING, NUMBER, OPERATOR, SIGN, END = "name", "string", "number", "operator", "sign", "end"
MARK = "{…}"

_BLANK = re.compile(r"\s+")
#: What a look at its beginning tells, by the group that matches: blanks before it, then a comment up to the line's end, a sign, a name, a
#: literal without anything special in it, a number, an operator.
_TOKEN = re.compile(r'''(\s*)(?:(//[^\n\r]*)|(?!/\*)(?:([(){}\[\],.:;])|(`[^`\n]+`|[#@$]?[^\W\d]\w*|\$\d+)|("(?!"")[^"\\\n]*")|(0[xob][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)|([-+*/%=<>!&|^~?]+)))''')
_LINE_COMMENT = "comment"
_KINDS = (None, None, _LINE_COMMENT, SIGN, NAME, STRING, NUMBER, OPERATOR)
_COMMENT = re.compile(r"/\*|\*/")
_OPENING = re.compile(r'(#*)("""|")')
_LINE_END = re.compile(r"\r\n|\n|\r")
#: Inside a literal, only these characters can mean anything.
_TELLING = re.compile(r'["\\\n]')
#: Characters read at a time, and passed ones that are kept until it pays to cut them off.
_READ = 1 << 18


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    #: Whether a line end, or any blank, comes before it.
    fresh: bool = False
    spaced: bool = False
    #: Of strings: whether there is an interpolation, and the tokens inside each.
    interpolated: bool = False
    inner: list[list[Token]] = field(default_factory=list)


class Source:
    """A text of pieces, its tokens, and positions of offsets that have not been passed."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces = (x[i : i + _READ] for x in pieces for i in range(0, len(x), _READ))
        self.text, self.rest, self.ended = "", "", False
        #: Characters and lines that are passed, and where the lines of ``text`` begin.
        self.base, self.before, self.lines = 0, 0, [0]
        self.read(_READ)

    def read(self, least: int) -> None:
        """More text, up to a line end: what ends before it does not depend on what follows."""
        new, size = [self.rest], len(self.rest)
        while True:
            piece = next(self.pieces, None)
            if piece is None:
                self.ended, whole, self.rest = True, "".join(new), ""
                break
            new.append(piece)
            size += len(piece)
            if size >= least and "\n" in piece:
                whole = "".join(new)
                cut = whole.rindex("\n") + 1
                whole, self.rest = whole[:cut], whole[cut:]
                break
        start = self.base + len(self.text)
        self.lines += [start + m.end() for m in _LINE_END.finditer(whole)]
        self.text += whole

    def passed(self, offset: int) -> None:
        """Nothing before the offset is asked for any more."""
        if offset - self.base < _READ:
            return
        line = bisect_right(self.lines, offset) - 1
        start = self.lines[line]
        self.text = self.text[start - self.base :]
        self.base, self.before, self.lines = start, self.before + line, self.lines[line:]

    def position(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.lines, offset)
        before = self.between(self.lines[line - 1], offset)
        return self.before + line, (len(before) if before.isascii() else len(before.encode("utf-8", "surrogatepass"))) + 1

    def between(self, start: int, end: int) -> str:
        return self.text[start - self.base : end - self.base]

    def tokens(self) -> Iterator[Token]:
        at, fresh, spaced = 0, True, True
        while True:
            base, stop = self.base, self.base + len(self.text)
            for token, state in _scan(self.text, at - base, stop - base, fresh, spaced, self.ended, base):
                if token is not None:
                    yield token
                at, fresh, spaced = base + state[0], state[1], state[2]
                if self.base != base:
                    break  # what is passed was cut off meanwhile
            else:
                if self.ended and at >= stop:
                    yield Token(END, "", stop, stop, True, True)
                    return
                self.read(max(_READ, stop - at))


def _shift(token: Token, by: int) -> None:
    if by:
        token.start, token.end = token.start + by, token.end + by
        for inside in token.inner:
            for x in inside:
                _shift(x, by)


def tokens(text: str, at: int, stop: int) -> list[Token]:
    """Tokens of text[at:stop]; whatever is malformed is skipped, so any text has a result."""
    return [x for x, _ in _scan(text, at, stop, True, True, True) if x] + [Token(END, "", stop, stop, True, True)]


def _scan(text: str, at: int, stop: int, fresh: bool, spaced: bool, ended: bool, base: int = 0) -> Iterator[tuple[Token | None, tuple[int, bool, bool]]]:
    """Tokens (at the end null), each with what holds behind it: offset, whether a line end and any blank came. ``base``: of the tokens' offsets.

    Unless the text is ``ended``, what reaches ``stop`` may go on behind it and is left out."""
    plain = _TOKEN.match
    while at < stop:
        if m := plain(text, at, stop):
            kind, start, end = _KINDS[m.lastindex], m.start(m.lastindex), m.end()
            if start > at:
                fresh, spaced = fresh or "\n" in (blank := m[1]) or "\r" in blank, True
            if kind == _LINE_COMMENT:
                at, spaced = end, True
                continue
            if kind == OPERATOR and "/" in m[m.lastindex]:
                if text.startswith(("//", "/*"), start):  # a comment whose second sign lies behind the end
                    at, spaced = stop, True
                    continue
                end = min(k for k in (text.find("//", start + 1, end), text.find("/*", start + 1, end), end) if k >= 0)
            if end >= stop and not ended:
                return
            token = Token(kind, text[start + 1 : end - 1] if kind == STRING else text[start:end], start + base, end + base, fresh, spaced)
        elif m := _BLANK.match(text, at, stop):
            fresh, at, spaced = fresh or "\n" in m[0] or "\r" in m[0], m.end(), True
            continue
        elif text.startswith("/*", at):
            end = _block_comment(text, at, stop)
            if end >= stop and not ended:
                return
            fresh, at, spaced = fresh or "\n" in text[at:end], end, True
            continue
        else:
            token = text[at] in '"#' and _string(text, at, stop) or Token(SIGN, text[at], at, at + 1)
            end = token.end
            if end >= stop and not ended:
                return
            token.fresh, token.spaced = fresh, spaced
            _shift(token, base)
        at, fresh, spaced = end, False, False
        yield token, (at, fresh, spaced)
    yield None, (at, fresh, spaced)


def _block_comment(text: str, at: int, stop: int) -> int:
    depth = 0
    for m in _COMMENT.finditer(text, at, stop):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return stop


def _string(text: str, at: int, stop: int) -> Token | None:
    m = _OPENING.match(text, at, stop)
    if not m:
        return None
    hashes, quote = m[1], m[2]
    closing, escape = quote + hashes, "\\" + hashes
    parts, inner, i, begin = [], [], m.end(), m.end()
    while i < stop:
        telling = _TELLING.search(text, i, stop)
        i = telling.start() if telling else stop
        if i >= stop:
            break
        if text.startswith(closing, i):
            parts.append(text[begin:i])
            value = "".join(parts)
            return Token(STRING, _unindented(value) if len(quote) == 3 else value, at, i + len(closing), interpolated=bool(inner), inner=inner)
        if text.startswith(escape + "(", i):
            parts.append(text[begin:i])
            opened = i + len(escape) + 1
            i = _closing_bracket(text, opened, stop)
            inner.append(tokens(text, opened, i - 1))
            parts.append(MARK)
            begin = i
        elif text.startswith(escape, i):
            i += len(escape) + 1
        elif text[i] == "\n" and len(quote) == 1:
            break
        else:
            i += 1
    # Not closed: what was read so far is the literal.
    return Token(STRING, "".join([*parts, text[begin:i]]), at, max(i, m.end()), interpolated=bool(inner), inner=inner)


def _closing_bracket(text: str, at: int, stop: int) -> int:
    depth = 1
    while at < stop:
        if inside := _string(text, at, stop):
            at = inside.end
            continue
        depth += (text[at] == "(") - (text[at] == ")")
        at += 1
        if not depth:
            return at
    return stop


def _unindented(value: str) -> str:
    """Lines of a multi-line literal without the first line end and the last line's indentation."""
    lines = value.split("\n")
    if len(lines) < 2:
        return value
    indent = lines[-1]
    return "\n".join(x.removeprefix(indent) for x in lines[1:-1])
