"""Rule patterns are written in RE2's syntax; this module rewrites them for Java (Spark) and Python.

Differences that are taken care of: `$` is the end of the text, `\\s` has no vertical tab, word boundaries are
ASCII, `[` and `&&` inside a class are literal, POSIX classes, named groups, flags in the middle of a pattern,
`\\z`, `\\x{..}` and `\\Q..\\E`.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants, _parser
from typing import NamedTuple

_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_BOUND = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_NO_BOUND = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"


class Pattern:
    """A translated pattern and the names of its groups, by group number."""

    def __init__(self, text: str, names: dict[int, str]):
        self.text, self.names = text, names


def _escaped(char: str) -> str:
    return "\\" + char if char in r"\.^$|?*+()[]{}-&~#" else char


def _class(source: str, at: int) -> tuple[str, int]:
    """The class that begins at `at`, rewritten, and where it ends."""
    out, i = "[", at + 1
    if source[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while i < len(source):
        c = source[i]
        if c == "]" and not first:
            return out + "]", i + 1
        first = False
        if c == "[" and source[i + 1 : i + 2] == ":":
            end = source.index(":]", i)
            name = source[i + 2 : end]
            if name.startswith("^"):
                raise ValueError("negated POSIX classes inside classes are not supported")
            out, i = out + _POSIX[name], end + 2
        elif c == "\\":
            code, i = _escape(source, i, inside=True)
            out += code
        elif c in "[&~|":
            out, i = out + "\\" + c, i + 1
        elif c == "-" and source[i + 1 : i + 2] == "-":
            out, i = out + r"\-", i + 1
        else:
            out, i = out + c, i + 1
    raise ValueError("a class is not closed")


def _escape(source: str, i: int, inside: bool) -> tuple[str, int]:
    c = source[i + 1 : i + 2]
    if c == "x" and source[i + 2 : i + 3] == "{":
        end = source.index("}", i)
        point = int(source[i + 3 : end], 16)
        return (f"\\x{point:02X}" if point < 256 else _escaped(chr(point))), end + 1
    table = {"s": r"\t\n\f\r " if inside else r"[\t\n\f\r ]", "d": "0-9" if inside else "[0-9]", "w": "0-9A-Za-z_" if inside else "[0-9A-Za-z_]", "a": r"\x07", "v": r"\x0B"}
    if not inside:
        table |= {"S": r"[^\t\n\f\r ]", "D": "[^0-9]", "W": "[^0-9A-Za-z_]", "b": _BOUND, "B": _NO_BOUND}
    if c in table:
        return table[c], i + 2
    if c.isalnum() or c in "_":
        return "\\" + c, i + 2
    return _escaped(c) if not inside or c not in "\"'`/ ,:;<>=!@%" else c, i + 2


@lru_cache(4096)
def translate(source: str, to: str) -> Pattern:
    """`source` for `to`: java or python."""
    end_of_text = r"\z" if to == "java" else r"\Z"
    multiline = [False]
    out, names, groups, i = [], {}, 0, 0
    pending = [0]  # groups that wait to be closed where flags were set in the middle, per nesting level
    while i < len(source):
        c = source[i]
        if c == "\\":
            if source[i + 1 : i + 2] == "Q":
                end = source.find(r"\E", i)
                end = len(source) if end < 0 else end
                out.append("".join(map(_escaped, source[i + 2 : end])))
                i = end + 2
            elif source[i + 1 : i + 2] in ("z", "A"):
                out.append(end_of_text if source[i + 1] == "z" else r"\A")
                i += 2
            elif source[i + 1 : i + 2] in ("p", "P") and to == "python":
                raise ValueError("Unicode classes are not supported by this engine")
            else:
                code, i = _escape(source, i, inside=False)
                out.append(code)
        elif c == "[":
            code, i = _class(source, i)
            out.append(code)
        elif c == "$":
            out.append("(?=\\n|" + end_of_text + ")" if multiline[-1] else end_of_text)
            i += 1
        elif c == "(":
            flags = re.match(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", source[i:])
            named = re.match(r"\(\?P?<([A-Za-z_]\w*)>", source[i:])
            if flags:
                on, off = flags[1].replace("U", ""), (flags[2] or "").replace("U", "")
                inner = (multiline[-1] or "m" in on) and "m" not in off
                i += flags.end()
                text = on + (f"-{off}" if off else "")
                if flags[3] == ":":
                    out.append(f"(?{text}:")
                    pending.append(0)
                    multiline.append(inner)
                else:
                    multiline[-1] = inner
                    if text:
                        out.append(f"(?{text}:")
                        pending[-1] += 1
            else:
                if named:
                    groups += 1
                    names[groups] = named[1]
                    out.append("(")
                    i += named.end()
                elif source.startswith("(?", i):
                    raise ValueError(f"unknown group at {i}")
                else:
                    groups += 1
                    out.append("(")
                    i += 1
                pending.append(0)
                multiline.append(multiline[-1])
        elif c == ")":
            if len(pending) < 2:
                raise ValueError("a group is closed that was not opened")
            out.append(")" * (pending.pop() + 1))
            multiline.pop()
            i += 1
        elif c == "|" and pending[-1]:
            # flags hold for the rest of the group, and the alternatives after them too
            out.append("|")
            i += 1
        else:
            out.append(c)
            i += 1
    if len(pending) != 1:
        raise ValueError("a group is not closed")
    return Pattern("".join(out) + ")" * pending[0], names)


@lru_cache(4096)
def python_regex(source: str) -> tuple[re.Pattern, dict[int, str]]:
    p = translate(source, "python")
    return re.compile(p.text, re.ASCII), p.names


def java_regex(source: str) -> str:
    return translate(source, "java").text


def any_of(patterns: list[str]) -> str:
    """One pattern that matches if any of `patterns` does. Flags stay inside their alternative."""
    return "|".join(f"(?:{p})" for p in patterns)


# ---- what every match holds ----------------------------------------------------------------------------


class _Item(NamedTuple):
    """One part of a sequence in Java's syntax: whole, at its shortest, whether case folds, and the character if it is one."""

    full: str
    least: str
    fold: bool = False
    char: str = ""


def _point(code: int) -> str:
    return chr(code) if chr(code).isascii() and chr(code).isalnum() else f"\\x{{{code:x}}}"


def _members(arg, fold: bool) -> str:
    if arg[0][0] is _constants.NEGATE and fold:
        return r"[\s\S]"
    out = "["
    for op, value in arg:
        if op is _constants.NEGATE:
            out += "^"
        elif op is _constants.LITERAL:
            out += _point(value)
        elif op is _constants.RANGE:
            out += f"{_point(value[0])}-{_point(value[1])}"
        else:
            raise NotImplementedError(op)
    return out + "]"


def _items(parsed, fold: bool) -> list[_Item]:
    """The parts of a parsed pattern. Anchors, bounds and look-around are left out, so that no less matches."""
    out = []
    for op, arg in parsed:
        if op is _constants.LITERAL:
            folds = fold and chr(arg).lower() != chr(arg).upper()
            out.append(_Item(_point(arg), _point(arg), folds, chr(arg)))
        elif op is _constants.NOT_LITERAL:
            code = r"[\s\S]" if fold else f"[^{_point(arg)}]"
            out.append(_Item(code, code))
        elif op is _constants.ANY:
            out.append(_Item(r"[\s\S]", r"[\s\S]"))
        elif op is _constants.IN:
            code = _members(arg, fold)
            out.append(_Item(code, code, fold))
        elif op in (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT):
            continue
        elif op is _constants.SUBPATTERN:
            _, on, off, inner = arg
            out += _items(inner, (fold or bool(on & re.I)) and not off & re.I)
        elif op is _constants.BRANCH:
            ways = [_joined([(i.full, i.fold) for i in _items(a, fold)]) for a in arg[1]]
            code = "(?:" + "|".join(ways) + ")"
            if any(ways):
                out.append(_Item(code, code if all(ways) else ""))
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT):
            low, high, inner = arg
            parts = _items(inner, fold)
            if not parts or high == 0:
                continue
            one = len(parts) == 1 and parts[0].full == parts[0].least
            code = parts[0].full if one else "(?:" + _joined([(i.full, i.fold) for i in parts]) + ")"
            most = "," if high is _constants.MAXREPEAT else f",{high}" if high > low else ""
            out.append(_Item(f"{code}{{{low}{most}}}", f"{code}{{{low}}}" if low else "", one and parts[0].fold))
        else:
            raise NotImplementedError(op)
    return out


def _joined(parts: list[tuple[str, bool]]) -> str:
    out, folds = "", False
    for code, fold in parts:
        if fold != folds:
            out, folds = out + ("(?i)" if fold else "(?-i)"), fold
        out += code
    return out


@lru_cache(4096)
def gate(source: str) -> tuple[str, str]:
    """(text, Java pattern) that every match of `source` holds: cheap tests, of which no text with a match fails one. "" is no test.

    The pattern is the rule's own from its longest run of characters on, without what bounds it, and no longer than it must
    be at its ends. So a search begins only where that run stands, and doesn't read a word again from each of its signs.
    """
    try:
        parsed = _parser.parse(translate(source, "python").text, re.ASCII)
        items = _items(parsed, bool(parsed.state.flags & re.I))
    except (re.error, ValueError, NotImplementedError):  # what only Java knows
        return "", ""
    start, length, at = 0, 0, 0
    for k, item in enumerate(items):
        at = at if k and item.char and items[k - 1].char else k
        if item.char and k + 1 - at > length:
            start, length = at, k + 1 - at
    run = items[start : start + length]
    text = "" if any(i.fold for i in run) else "".join(i.char for i in run)
    rest = items[start:]
    while rest and not rest[0].least:
        rest = rest[1:]
    while rest and not rest[-1].least:
        rest = rest[:-1]
    if len(rest) == length and text:
        return text, ""
    ends = (0, len(rest) - 1)
    return text, _joined([(i.least if k in ends else i.full, i.fold) for k, i in enumerate(rest)])
