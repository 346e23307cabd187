"""Scalar functions on values, as columns and in plain Python: entropy, hashes, masks, links, word statistics."""

from __future__ import annotations

import base64
import hashlib
import hmac
import math
import re
from collections import Counter
from functools import cache
from pathlib import Path
from urllib.parse import quote, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_entropy(value: str | bytes) -> float:
    """Shannon entropy over the bytes of a value, in bits."""
    data = value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0


def rune_entropy(value: str) -> float:
    """The entropy that a finding carries: characters are counted, the length is in bytes."""
    n = len(value.encode("utf-8", "surrogatepass"))
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def entropy(value: Column) -> Column:
    """byte_entropy as a Column: n log n of each distinct byte's count, in the JVM.

    The bytes are bound to a variable: inside a lambda, they would be cut out of the value again for each distinct one.
    """
    digits = F.hex(F.encode(value, "UTF-8"))
    each = F.regexp_extract_all(digits, F.lit(".."), F.lit(0))

    def total(found: Column) -> Column:
        n = F.size(found).cast("double")
        counts = F.transform(F.array_distinct(found), lambda b: F.size(F.filter(found, lambda x: x == b)).cast("double"))
        return F.aggregate(counts, F.lit(0.0), lambda s, c: s - c / n * F.log2(c / n))

    return F.when(F.length(digits) > 0, F.transform(F.array(each), total)[0]).otherwise(0.0)


def fingerprint(value: str | bytes, key: bytes | None = None) -> str:
    """SHA-256 of the value; with a key, HMAC-SHA-256 behind the word hmac-sha256."""
    data = value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value
    return f"hmac-sha256:{hmac.new(key, data, 'sha256').hexdigest()}" if key else hashlib.sha256(data).hexdigest()


def fingerprint_column(value: Column, key: bytes | None = None) -> Column:
    """fingerprint as a Column, keyed or not."""
    if not key:
        return F.sha2(value.cast("binary"), 256)
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))
    return F.concat(F.lit("hmac-sha256:"), F.sha2(F.concat(outer, first), 256))


_FINGERPRINT = re.compile(r"(?:hmac-sha256:)?[0-9a-f]{64}\Z")


def parse_fingerprint(text: str) -> tuple[bool, str]:
    """(keyed, hex digest)."""
    text = text.strip()
    if not _FINGERPRINT.match(text):
        raise ValueError(f"not a fingerprint: {text!r}")
    return text.startswith("hmac-sha256:"), text.removeprefix("hmac-sha256:")


def load_ignore(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """(fingerprints without repeats, bad lines by number) of an ignore file; # begins a comment."""
    good, bad = {}, []
    for k, line in enumerate(text.splitlines(), 1):
        line = line.partition("#")[0].strip()
        if line:
            try:
                parse_fingerprint(line)
                good[line] = None
            except ValueError:
                bad.append((k, line))
    return list(good), bad


def mask(value: str, percent: float) -> str:
    """The first part of a value; `percent` of it is hidden. 100 hides all."""
    if percent >= 100:
        return "REDACTED"
    keep = round(len(value) * (100 - max(0.0, percent)) / 100)  # half to even
    return value[:keep] + "..."


def mask_column(value: Column, percent: float) -> Column:
    if percent >= 100:
        return F.lit("REDACTED")
    return F.concat(F.left(value, F.bround(F.length(value) * (100 - max(0.0, percent)) / 100).cast("int")), F.lit("..."))


def redact_url(url: str) -> str:
    """A URL without user, query and fragment."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return url.partition("?")[0].partition("#")[0]
    return urlunsplit((parts.scheme, parts.netloc.rpartition("@")[2], parts.path, "", ""))


def redact_url_column(url: Column) -> Column:
    bare = F.regexp_replace(url, r"[?#][\s\S]*$", "")
    return F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1")


#: How each host writes a link to lines of a file: (path, first line, last line).
LINKS = {
    "github": ("{base}/blob/{sha}/{path}{plain}", "#L{a}", "-L{b}"),
    "gitlab": ("{base}/-/blob/{sha}/{path}{plain}", "#L{a}", "-{b}"),
    "bitbucket": ("{base}/src/{sha}/{path}", "#lines-{a}", ":{b}"),
    "gitea": ("{base}/src/commit/{sha}/{path}{display}", "#L{a}", "-L{b}"),
}


def scm_link(platform: str, base: str, sha: str, path: str, start: int, end: int) -> str:
    """A link to lines of a file at a commit; inner paths of archives are cut at `!`."""
    if not base or not sha:
        return ""
    outer = path.partition("!")[0]
    if not outer:
        return f"{base}/-/commit/{sha}" if platform == "gitlab" else f"{base}/commit/{sha}"
    safe = outer.replace("%", "%25").replace(" ", "%20")
    if platform == "azure":
        return f"{base}/commit/{sha}?path=/{safe}" + (f"&line={start}&lineEnd={end if end != start else start + 1}&lineStartColumn=1&lineEndColumn=10000000&type=2&lineStyle=plain&_a=files" if path == outer else "")
    if platform not in LINKS:
        return ""
    page, first, last = LINKS[platform]
    rendered = outer.lower().endswith((".md", ".ipynb"))
    link = page.format(base=base, sha=sha, path=safe, plain="?plain=1" if rendered else "", display="?display=source" if rendered else "")
    if path == outer and start:
        link += first.format(a=start) + (last.format(b=end) if end != start else "")
    return link


# ---- words and tokens ----------------------------------------------------------------------------------


class TokenCounter:
    """Counts the tokens of values by byte-pair ranks from a .tiktoken file; without one, ratios are 0."""

    def __init__(self, ranks_path: str | None = None, words: frozenset[str] = frozenset()):
        self.words = words
        self.ranks = None
        if ranks_path:
            with open(ranks_path, "rb") as f:
                self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}

    def count(self, value: str) -> int:
        return sum(self._count(m.group().encode("utf-8", "surrogatepass")) for m in _SPLIT.finditer(value))

    def _count(self, piece: bytes) -> int:
        if piece in self.ranks:
            return 1
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)

    def ratio(self, value: str) -> float:
        """Bytes for each token."""
        if self.ranks is None or not value:
            return 0.0
        if len(value) < 20:
            value = value.replace("\r", "").replace("\n", "")
        n = self.count(value)
        return len(value.encode("utf-8", "surrogatepass")) / n if n else 0.0

    def has_word(self, value: str, least: int) -> bool:
        low = value.lower()
        return any(low[i:j] in self.words for i in range(len(low)) for j in range(i + least, min(len(low), i + 24) + 1)) if self.words else False

    def fails_efficiency(self, value: str) -> bool:
        """Whether a value reads like words: a dictionary word, or few tokens for its length."""
        if self.ranks is None:
            return False
        if self.has_word(value, 5):
            return True
        return self.ratio(value) >= (2.1 if len(value) < 12 and self.has_word(value, 4) else 2.5)


_SPLIT = re.compile(r"'(?:[sdmt]|ll|ve|re)|[^\r\n\w]?[^\W\d_]+|\d{1,3}| ?[^\s\w]+[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+|_", re.I)


@cache
def token_counter(ranks_path: str | None, words_path: str | None) -> TokenCounter:
    words = frozenset(w.strip().lower() for w in Path(words_path).read_text().splitlines() if w.strip()) if words_path else frozenset()
    return TokenCounter(ranks_path, words)
