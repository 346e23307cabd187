"""Context windows: `within` of components and the text kept around a match."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_PART = re.compile(r"([+-]?)(\d+)([CL]?)\Z")


@dataclass(frozen=True)
class Window:
    """Lines count the match's own line; without lines, the window is in bytes."""

    lines_before: int = 0
    lines_after: int = 0
    before: int = 0
    after: int = 0
    box: bool = False
    columns: bool = False


def parse(text: str) -> Window | None:
    """`5L`, `-3L,+2L`, `100C`, `7L,200C`; a sign names one direction, the larger value holds. Empty: no window."""
    if not text.strip():
        return None
    lines, chars, box, columns = [0, 0], [0, 0], False, False
    for part in text.split(","):
        m = _PART.match(part.strip())
        if not m:
            raise ValueError(f"not a window: {text!r}")
        sign, n, unit = m[1], int(m[2]), m[3] or "C"
        if unit == "L":
            box, n, target = True, max(0, n - 1), lines
        else:
            columns, target = True, chars
        if sign != "+":
            target[0] = max(target[0], n)
        if sign != "-":
            target[1] = max(target[1], n)
    return Window(lines[0], lines[1], chars[0], chars[1], box, columns)


class Lines:
    """Line and byte-column positions of a text given by byte offsets. An empty last line isn't counted."""

    def __init__(self, data: bytes, first: int = 1):
        self.data, self.first = data, first
        self.starts = [0]
        at = data.find(b"\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = data.find(b"\n", at + 1)
        if len(self.starts) > 1 and self.starts[-1] == len(data):
            self.starts.pop()

    def at(self, offset: int) -> tuple[int, int]:
        """(line index from 0, byte column from 1)."""
        k = bisect_right(self.starts, offset) - 1
        return k, offset - self.starts[k] + 1

    def span(self, start: int, end: int) -> tuple[int, int, int, int]:
        """start line, end line, start column, end column (inclusive) of [start, end)."""
        a, b = self.at(start), self.at(max(start, end - 1))
        return self.first + a[0], self.first + b[0], a[1], b[1]

    def text(self, start: int, end: int) -> bytes:
        """The whole lines that [start, end) touches, with the last one's line end."""
        a, b = self.at(start)[0], self.at(max(start, end - 1))[0]
        stop = self.starts[b + 1] if b + 1 < len(self.starts) else len(self.data)
        return self.data[self.starts[a] : stop]

    def extract(self, window: Window, start: int, end: int) -> bytes:
        """What the window keeps around [start, end)."""
        if not window.box:
            return self.data[max(0, start - window.before) : end + window.after]
        a = max(0, self.at(start)[0] - window.lines_before)
        b = min(len(self.starts) - 1, self.at(max(start, end - 1))[0] + window.lines_after)
        stop = self.starts[b + 1] if b + 1 < len(self.starts) else len(self.data)
        if not window.columns:
            return self.data[self.starts[a] : stop].rstrip(b"\n")
        left, right = self.at(start)[1] - 1 - window.before, self.at(max(start, end - 1))[1] + window.after
        rows = self.data[self.starts[a] : stop].rstrip(b"\n").split(b"\n")
        return b"\n".join(r[max(0, left) : right] for r in rows)


def holds(window: Window | None, primary, other) -> bool:
    """Whether `other` stands in the window around `primary`; both have start, end, span (lines and columns)."""
    if window is None:
        return True
    if not window.box:
        return primary.start - window.before <= other.start < primary.end + window.after
    a, b, left, right = primary.span
    c, _, column, _ = other.span
    if not a - window.lines_before <= c <= b + window.lines_after:
        return False
    if window.columns and a == b:
        return left - window.before <= column <= right + window.after
    return True
