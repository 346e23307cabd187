"""Decoding passes: percent, Unicode escapes, hex and base64 runs in a text become what they say.

A pass gives the new text and, for each decoded run, where it stands in the new and in the original text.
All positions are in bytes.
"""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass

KINDS = ("percent", "unicode", "hex", "base64")
_RUN = re.compile(
    rb"(?P<percent>%[0-9A-Fa-f]{2}(?:[^\n]*%[0-9A-Fa-f]{2})?)"
    rb"|(?P<points>U\+[0-9A-Fa-f]{4}(?:[\t\n\v\f\r ]+U\+[0-9A-Fa-f]{4}(?=[\t\n\v\f\r ]|\Z))*(?=[\t\n\v\f\r ]|\Z))"
    rb"|(?P<escapes>(?:\\{1,2}[uU][0-9A-Fa-f]{4})+)"
    rb"|(?P<run>[0-9A-Za-z_/+-]{16,}={0,2})"
)
_HEX = re.compile(rb"[0-9A-Fa-f]{32,}\Z")


@dataclass
class Segment:
    """A decoded run: [start, end) in the decoded text, the whole of [low, high) in the original."""

    start: int
    end: int
    low: int
    high: int
    kinds: int
    depth: int


def printable(data: bytes) -> bool:
    return all(9 <= b <= 0x7E for b in data)


def _percent(run: bytes) -> bytes | None:
    out = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), run)
    return out if printable(out) else None


def _units(values: list[str]) -> bytes:
    return "".join("�" if 0xD800 <= int(v, 16) < 0xE000 else chr(int(v, 16)) for v in values).encode()


def _hex(run: bytes) -> bytes | None:
    if len(run) % 2 or not any(48 <= b <= 57 for b in run):
        return None
    out = binascii.unhexlify(run)
    return out if printable(out) else None


def _base64(run: bytes) -> bytes | None:
    body = run.rstrip(b"=")
    if len(body) < 16 or not any(c in b"0123456789+/-_" for c in body):
        return None
    for altchars, text in ((None, run), (b"-_", body + b"=" * (-len(body) % 4))):
        try:
            out = base64.b64decode(text, altchars, validate=True)
        except (binascii.Error, ValueError):
            continue
        if out and printable(out):
            return out
    return None


def _decoded(m: re.Match) -> tuple[int, bytes] | None:
    """(kind, what it says) of a run, None if it says nothing."""
    if m["percent"]:
        out = _percent(m["percent"])
        return (1, out) if out is not None else None
    if m["points"]:
        return 2, _units([x.decode() for x in re.findall(rb"[0-9A-Fa-f]{4}", m["points"])])
    if m["escapes"]:
        return 2, _units([x.decode() for x in re.findall(rb"[uU]([0-9A-Fa-f]{4})", m["escapes"])])
    run = m["run"]
    if _HEX.match(run):
        out = _hex(run)
        return (4, out) if out is not None else None
    out = _base64(run)
    return (8, out) if out is not None else None


def decode_pass(data: bytes, before: list[Segment], depth: int) -> tuple[bytes, list[Segment]]:
    """One pass over `data`; `before` are the segments of the pass that made it."""
    parts, segments, at, size = [], [], 0, 0
    for m in _RUN.finditer(data):
        found = _decoded(m)
        if found is None:
            continue
        kind, text = found
        start, end = m.span()
        parts += [data[at:start], text]
        size += start - at
        low, high, kinds = map_back(before, start, end), map_back(before, start, end, True), kind
        for s in before:
            if s.start < end and start < s.end:
                kinds |= s.kinds
        segments.append(Segment(size, size + len(text), low, high, kinds, depth))
        size += len(text)
        at = end
    if not segments:
        return data, []
    return b"".join([*parts, data[at:]]), sorted(segments + _carried(before, segments_in(data, segments)), key=lambda s: s.start)


def segments_in(data: bytes, fresh: list[Segment]) -> list[tuple[int, int, int]]:
    """(start, end, growth up to its end) of each fresh run, in the text that was decoded."""
    out, shift = [], 0
    runs = iter(m.span() for m in _RUN.finditer(data) if _decoded(m) is not None)
    for segment, (start, end) in zip(fresh, runs):
        shift += (segment.end - segment.start) - (end - start)
        out.append((start, end, shift))
    return out


def _carried(before: list[Segment], runs: list[tuple[int, int, int]]) -> list[Segment]:
    """Earlier segments that no fresh run touches, at their places in the new text."""
    out = []
    for s in before:
        if any(a < s.end and s.start < b for a, b, _ in runs):
            continue
        shift = max(((b, g) for a, b, g in runs if b <= s.start), default=(0, 0))[1]
        out.append(Segment(s.start + shift, s.end + shift, s.low, s.high, s.kinds, s.depth))
    return out


def map_back(segments: list[Segment], start: int, end: int, last: bool = False) -> int:
    """The original position of the start (or the end) of [start, end): whole runs for what touches one."""
    position = end if last else start
    shift = 0
    for s in segments:
        if last and s.start < position <= s.end or not last and s.start <= position < s.end:
            return s.high if last else s.low
        if s.end <= (position - 1 if last else position):
            shift = s.high - s.end
    return position + shift


def names(kinds: int) -> list[str]:
    return [n for k, n in enumerate(KINDS) if kinds >> k & 1]
