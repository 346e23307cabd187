"""Detection inside one fragment: keyword gate, matching, filters, precedence, components, decoding passes.

Everything here is local to a fragment, so a scan needs no shuffle. The kernel keeps ordered state (what was
accepted before suppresses what comes later) and byte positions, which columns can't express; rules that need
neither run natively (see operators.native).
"""

from __future__ import annotations

import base64
import itertools
import json
import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np

from ..config import CONFIDENCE, Config, Rule
from ..functions import context, decoding, dialect, expressions, text

MARKERS = ("sieveline:allow", "scan:allow")
MOST_SETS = 100


@dataclass(frozen=True)
class Options:
    decode_depth: int = 0
    match_context: str = ""
    min_confidence: str = ""
    allow_markers: tuple[str, ...] | None = MARKERS
    fingerprint_key: bytes | None = None
    ignored: frozenset[str] = frozenset()
    ranks_path: str | None = None
    words_path: str | None = None

    def check(self) -> Options:
        if self.min_confidence and self.min_confidence not in CONFIDENCE:
            raise ValueError(f"unknown confidence {self.min_confidence!r}")
        for f in self.ignored:
            if text.parse_fingerprint(f)[0] != bool(self.fingerprint_key):
                raise ValueError("ignored fingerprints and the fingerprint key are of different kinds")
        return self


@dataclass
class Found:
    """A match on its way to being a finding. start, end: bytes of the original text."""

    rule: Rule
    full: str
    value: str
    captures: dict[str, str]
    start: int
    end: int
    span: tuple[int, int, int, int]
    line: str
    context: str
    encodings: list[str]
    depth: int
    confidence: str
    sets: list[list[Found]] = field(default_factory=list)
    truncated: bool = False

    @property
    def place(self):
        return (self.rule.id, self.span, self.value)


def trie_pattern(words: list[str]) -> str:
    """One pattern that finds any of the words, with shared beginnings."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node) -> str:
        if "" in node:
            return ""  # a shorter word is enough to know that one occurs
        parts = [re.escape(c) + build(n) for c, n in sorted(node.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return build(root)


def fold(raw: str) -> str:
    """Lower case for keywords: ASCII, and the two signs that fold to s and k."""
    return raw.lower().replace("ſ", "s").replace("K", "k")


class Text:
    """A text with character and byte positions."""

    def __init__(self, raw: str):
        self.raw, self.data = raw, raw.encode("utf-8", "surrogatepass")
        self.plain = len(self.data) == len(raw)
        self._ends = None

    def byte(self, char: int) -> int:
        if self.plain:
            return char
        if self._ends is None:
            cp = np.frombuffer(self.raw.encode("utf-32-le", "surrogatepass"), np.uint32)
            self._ends = np.concatenate(([0], np.cumsum(1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF))))
        return int(self._ends[char])


def functions(options: Options, promote) -> dict[str, Any]:
    counter = text.token_counter(options.ranks_path, options.words_path)

    def matches_any(value, patterns):
        if not isinstance(patterns, list):
            patterns = [patterns]
        if not patterns or not all(isinstance(p, str) for p in patterns):
            return False
        found = dialect.python_regex(dialect.any_of(patterns))[0]
        return any(found.search(v) for v in value) if isinstance(value, list) else found.search(value) is not None

    def set_confidence(level):
        if level not in CONFIDENCE:
            raise expressions.ExpressionError(f"unknown confidence {level!r}")
        promote(level)
        return False

    def find_match(value, pattern):
        m = dialect.python_regex(pattern)[0].search(value)
        return m.group() if m else ""

    each = lambda v: v if isinstance(v, list) else [v]
    return {
        "matchesAny": matches_any,
        "findMatch": find_match,
        "containsAny": lambda v, terms: any(t.lower() in x.lower() for x in each(v) for t in terms),
        "startsWithAny": lambda v, prefixes: any(x.startswith(tuple(prefixes)) for x in each(v)),
        "intersects": lambda v, others: bool(set(each(v)) & set(others)),
        "entropy": text.byte_entropy,
        "tokenRatio": counter.ratio,
        "failsTokenEfficiency": counter.fails_efficiency,
        "setConfidence": set_confidence,
        "crypto.sha256": text.fingerprint,
        "len": len,
        "lower": str.lower,
        "upper": str.upper,
        "trim": lambda s, *c: s.strip(*c),
        "trimPrefix": lambda s, p: s.removeprefix(p),
        "trimSuffix": lambda s, p: s.removesuffix(p),
        "hasPrefix": str.startswith,
        "hasSuffix": str.endswith,
        "split": lambda s, sep, *n: s.split(sep, *n),
        "join": lambda xs, sep="": sep.join(xs),
        "max": lambda *v: max(v[0] if len(v) == 1 else v),
        "min": lambda *v: min(v[0] if len(v) == 1 else v),
        "sum": sum,
        "abs": abs,
        "first": lambda xs: xs[0] if xs else None,
        "last": lambda xs: xs[-1] if xs else None,
        "replace": lambda s, a, b: s.replace(a, b),
        "repeat": lambda s, n: s * n,
        "indexOf": lambda s, x: s.find(x),
        "lastIndexOf": lambda s, x: s.rfind(x),
        "get": lambda m, k: m.get(k) if isinstance(m, dict) else m[k] if 0 <= k < len(m) else None,
        "keys": lambda m: list(m),
        "values": lambda m: list(m.values()),
        "toJSON": json.dumps,
        "fromJSON": json.loads,
        "fromBase64": lambda s: base64.b64decode(s, validate=True).decode("utf-8", "replace"),
        "toBase64": lambda s: base64.b64encode(s.encode()).decode(),
        "string": str,
        "int": int,
        "float": float,
    }


class Kernel:
    def __init__(self, config: Config, options: Options = Options()):
        self.config, self.options = config, options.check()
        self.order = sorted(config.rules, key=lambda r: -r.specificity)
        self.hashes = config.rule_hashes()
        keywords: dict[str, list[str]] = {}
        for r in self.order:
            for k in r.keywords:
                keywords.setdefault(k, []).append(r.id)
        self.keywords = keywords
        self.gate = re.compile(trie_pattern(list(keywords))) if keywords else None
        self.open = {r.id for r in self.order if not r.keywords}
        self.global_filter = expressions.parse(config.filter) if config.filter.strip() else None
        self.filters = {r.id: expressions.parse(r.filter) for r in self.order if r.filter.strip()}
        self.window = context.parse(options.match_context)

    def eligible(self, raw: str) -> set[str]:
        """Rules of which a keyword occurs in the text, and those without keywords."""
        low = fold(raw)
        if self.gate is None or not self.gate.search(low):
            return self.open
        return self.open | {i for k, ids in self.keywords.items() if k in low for i in ids}

    def scan(self, raw: str, start_line: int = 1, attributes: dict[str, str] | None = None, first: bool = True) -> list[Found]:
        """The findings of one fragment."""
        attributes = dict(attributes or {})
        if not raw and not attributes.get("path"):
            return []
        state = _Fragment(self, raw, max(1, start_line or 1), attributes)
        for depth in range(self.options.decode_depth + 1):
            names = self.eligible(state.now.raw)
            if names:
                for rule in self.order:
                    if rule.id in names and not rule.skip_report:
                        state.apply(rule, depth, first)
            if depth == self.options.decode_depth or not state.decode(depth + 1):
                break
        return state.finished()


class _Fragment:
    def __init__(self, kernel: Kernel, raw: str, start_line: int, attributes: dict[str, str]):
        self.kernel, self.attributes = kernel, attributes
        self.source = self.now = Text(raw)
        self.lines = context.Lines(self.source.data, start_line)
        self.segments: list[decoding.Segment] = []
        self.depth = 0
        self.accepted: list[Found] = []
        self.sha = attributes.get("git.sha", "")
        self.path = attributes.get("path", "")

    def decode(self, depth: int) -> bool:
        data, segments = decoding.decode_pass(self.now.data, self.segments, depth)
        if not segments:
            return False
        self.now, self.segments, self.depth = Text(data.decode("utf-8", "replace")), segments, depth
        return True

    def apply(self, rule: Rule, depth: int, first: bool) -> None:
        options = self.kernel.options
        if not rule.regex:
            if depth == 0 and first:
                found = self.path_only(rule)
                if found:
                    self.report(found)
            return
        for found in self.matches(rule, suppress=True):
            if rule.components and not self.assemble(found):
                continue
            self.report(found)

    def report(self, found: Found) -> None:
        options = self.kernel.options
        least, level = options.min_confidence, found.confidence
        if least and level in CONFIDENCE and CONFIDENCE.index(level) < CONFIDENCE.index(least):
            return
        if options.ignored and text.fingerprint(found.value, options.fingerprint_key) in options.ignored:
            return
        self.accepted.append(found)

    def path_matches(self, rule: Rule) -> bool:
        return not rule.path or bool(self.path) and dialect.python_regex(rule.path)[0].search(self.path) is not None

    def path_only(self, rule: Rule) -> Found | None:
        if not self.path_matches(rule):
            return None
        found = Found(rule, f"file detected: {self.path}", "", {}, 0, 0, (0, 0, 0, 0), "", "", [], 0, self.confidence(rule))
        return found if self.passes(rule, found, self.finding_map(found, "", 0, 0, "0")) else None

    def confidence(self, rule: Rule) -> str:
        return rule.confidence or self.attributes.get("confidence", "")

    def matches(self, rule: Rule, suppress: bool) -> list[Found]:
        """The matches of a rule that pass markers, suppression and filters."""
        if not self.path_matches(rule):
            return []
        regex, names = dialect.python_regex(rule.regex)
        raw, out = self.now.raw, []
        for m in regex.finditer(raw):
            full = m.group()
            if not full:
                continue
            begin, stop = m.span()
            start, end = self.now.byte(begin), self.now.byte(stop)
            encodings, line = [], None
            if self.depth == 0:
                full = full.strip("\n")
                stop = begin + len(full)
                end = self.now.byte(stop)
                low, high = start, end
            else:
                touched = [s for s in self.segments if s.depth == self.depth and s.start < end and start < s.end]
                if not touched:
                    continue
                kinds = 0
                for s in touched:
                    kinds |= s.kinds
                encodings = decoding.names(kinds)
                low, high = decoding.map_back(self.segments, start, end), decoding.map_back(self.segments, start, end, True)
                line = raw[raw.rfind("\n", 0, begin) + 1 :].partition("\n")[0]
            source_line = self.lines.text(low, high).decode("utf-8", "replace")
            if self.kernel.options.allow_markers and any(x in source_line for x in self.kernel.options.allow_markers):
                continue
            groups = m.groups()
            if rule.value_group:
                value = groups[rule.value_group - 1] or ""
            else:
                value = next((g for g in groups if g), full)
            captures = {n: groups[k - 1] for k, n in names.items() if groups[k - 1]}
            found = Found(rule, full, value, captures, low, high, self.lines.span(low, high), source_line, "", encodings, self.depth, self.confidence(rule))
            if suppress and self.suppressed(found, self.accepted):
                continue
            if self.kernel.window:
                found.context = self.lines.extract(self.kernel.window, low, high).decode("utf-8", "replace")
            values = self.finding_map(found, raw, begin, stop, repr(text.rune_entropy(value)))
            if line is not None:
                values["line"] = line
            if self.passes(rule, found, values):
                out.append(found)
        return out

    def finding_map(self, found: Found, raw: str, begin: int, stop: int, entropy: str) -> dict[str, Any]:
        before = max(raw.rfind("\n", 0, begin), raw.rfind("\r", 0, begin)) + 1
        after = [x for x in (raw.find("\n", stop), raw.find("\r", stop)) if x >= 0]
        return expressions.Strings(
            secret=found.value, match=found.full, line=found.line, rule_id=found.rule.id, description=found.rule.description, confidence=found.confidence, context=found.context,
            captures=expressions.Strings(found.captures), entropy=entropy, fragment_raw=raw, match_start_idx=begin, match_end_idx=stop, match_line_start_idx=before, match_line_end_idx=min(after, default=len(raw)),
        )

    def passes(self, rule: Rule, found: Found, values: dict[str, Any]) -> bool:
        """Both filters; an error keeps the finding."""

        def promote(level):
            found.confidence = values["confidence"] = level

        calls = functions(self.kernel.options, promote) if self.kernel.global_filter or rule.id in self.kernel.filters else {}
        env = {"finding": values, "attributes": expressions.Strings(self.attributes)}
        for node in (self.kernel.global_filter, self.kernel.filters.get(rule.id)):
            if node is not None:
                try:
                    if expressions.evaluate(node, env, calls):
                        return False
                except expressions.ExpressionError:
                    pass
        return True

    def suppressed(self, found: Found, others: list[Found]) -> bool:
        """Whether a more specific finding on the same line has the value."""
        for other in others:
            if other is found:
                continue
            if other.span[0] == found.span[0] and other.rule.id != found.rule.id and other.rule.specificity > found.rule.specificity and found.value in other.value:
                return True
            for part in {id(c): c for s in other.sets for c in s}.values():
                if part.span[0] == found.span[0] and part.rule.id != found.rule.id and other.rule.id != found.rule.id and part.rule.specificity > found.rule.specificity and found.value in part.value:
                    return True
        return False

    def assemble(self, found: Found) -> bool:
        """Add component sets; False if a required component is missing."""
        lists = []
        for component in found.rule.components:
            rule = self.kernel.config.rule(component.id)
            window = context.parse(component.within)
            parts = [p for p in self.matches(rule, suppress=False) if context.holds(window, found, p)]
            if self.kernel.options.ignored:
                parts = [p for p in parts if text.fingerprint(p.value, self.kernel.options.fingerprint_key) not in self.kernel.options.ignored]
            if not parts:
                if not component.optional:
                    return False
                continue
            lists.append(parts)
        if lists:
            sets = list(itertools.islice(itertools.product(*lists), MOST_SETS + 1))
            found.truncated = len(sets) > MOST_SETS
            found.sets = [list(s) for s in sets[:MOST_SETS]]
        return True

    def finished(self) -> list[Found]:
        parts = {p.place for f in self.accepted for s in f.sets for p in s}
        kept = [f for f in self.accepted if f.place not in parts or f.sets]
        return [f for f in kept if not self.suppressed(f, kept)]


def as_row(found: Found, kernel: Kernel, attributes: dict[str, str]) -> dict[str, Any]:
    """A finding as the dictionary that the findings schema describes."""
    path = attributes.get("path", "")

    def match(f: Found):
        return {"full": f.full, "value": f.value, "fingerprint": text.fingerprint(f.value, kernel.options.fingerprint_key) if f.value else "", "captures": f.captures, "line": f.line, "context": f.context}

    def location(f: Found):
        return dict(zip(("path", "start_line", "end_line", "start_column", "end_column"), (path, *f.span)))

    def part(f: Found):
        optional = next((c.optional for c in found.rule.components if c.id == f.rule.id), False)
        return {"rule_id": f.rule.id, "rule_hash": kernel.hashes[f.rule.id], "optional": optional, "match": match(f), "location": location(f), "encodings": f.encodings, "decode_depth": f.depth}

    shown = {k: v for k, v in attributes.items() if k not in ("path", "fs.first_fragment", "confidence")}
    if "git.message" in shown and "\n" in shown["git.message"]:
        shown["git.message"] = shown["git.message"].partition("\n")[0] + "..."
    return {
        "rule_id": found.rule.id, "rule_hash": kernel.hashes[found.rule.id], "description": found.rule.description, "confidence": found.confidence, "encodings": found.encodings, "decode_depth": found.depth,
        "match": match(found), "attributes": shown, "location": location(found), "component_sets": [{"components": [part(p) for p in s]} for s in found.sets], "component_sets_truncated": found.truncated, "tags": list(found.rule.tags),
    }


@lru_cache(8)
def kernel_for(config: Config, options: Options) -> Kernel:
    """One kernel for each worker process and configuration."""
    return Kernel(config, options)
