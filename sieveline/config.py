"""Rule configurations: the data model, the TOML loader, validation, and hashes."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from .functions import context, dialect, expressions

CONFIDENCE = ("low", "medium", "high")
FILTER_FUNCTIONS = {"matchesAny", "findMatch", "containsAny", "startsWithAny", "intersects", "entropy", "tokenRatio", "failsTokenEfficiency", "setConfidence", "crypto.sha256"}
NATIVE = {"split", "join", "len", "max", "min", "last", "first", "replace", "lastIndexOf", "indexOf", "get", "toJSON", "fromJSON", "fromBase64", "toBase64", "string", "int", "float", "lower", "upper", "trim", "trimPrefix", "trimSuffix", "hasPrefix", "hasSuffix", "repeat", "keys", "values", "any", "all", "none", "one", "filter", "map", "count", "find", "abs", "floor", "ceil", "round", "sum", "type"}


class ConfigError(ValueError):
    """A configuration that can't be used."""


@dataclass(frozen=True)
class Component:
    id: str
    optional: bool = False
    within: str = ""


@dataclass(frozen=True)
class Rule:
    id: str
    description: str = ""
    regex: str = ""
    path: str = ""
    value_group: int = 0
    keywords: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    specificity: int = 0
    confidence: str = ""
    filter: str = ""
    skip_report: bool = False
    components: tuple[Component, ...] = ()
    validate: str = ""
    analyze: str = ""
    revoke: str = ""


@dataclass(frozen=True)
class Config:
    title: str = ""
    description: str = ""
    rules: tuple[Rule, ...] = ()
    prefilter: str = ""
    filter: str = ""
    min_version: str = ""
    _by_id: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        self._by_id.clear()
        self._by_id.update({r.id: r for r in self.rules})

    def rule(self, rule_id: str) -> Rule:
        if rule_id not in self._by_id:
            raise ConfigError(f"there is no rule {rule_id!r}")
        return self._by_id[rule_id]

    def check(self) -> Config:
        """Raise ConfigError for the first thing that is wrong; return the configuration."""
        seen = set()
        for r in self.rules:
            if not r.id:
                raise ConfigError("a rule has no id")
            if r.id in seen:
                raise ConfigError(f"rule id {r.id!r} is used twice")
            seen.add(r.id)
            if not r.regex and not r.path:
                raise ConfigError(f"{r.id}: neither regex nor path")
            if r.confidence and r.confidence not in CONFIDENCE:
                raise ConfigError(f"{r.id}: unknown confidence {r.confidence!r}")
            for name in ("regex", "path"):
                if getattr(r, name):
                    try:
                        compiled, _ = dialect.python_regex(getattr(r, name))
                    except Exception as e:
                        raise ConfigError(f"{r.id}: {name}: {e}") from e
                    if name == "regex" and r.value_group > compiled.groups:
                        raise ConfigError(f"{r.id}: valueGroup {r.value_group}, but {compiled.groups} groups")
            if r.value_group < 0:
                raise ConfigError(f"{r.id}: valueGroup is negative")
            _check_expression(r.filter, f"{r.id}: filter")
            for c in r.components:
                other = self._by_id.get(c.id)
                if other is None or other is r:
                    raise ConfigError(f"{r.id}: component {c.id!r} is no other rule")
                if other.components:
                    raise ConfigError(f"{r.id}: component {c.id!r} has components of its own")
                if not other.regex:
                    raise ConfigError(f"{r.id}: component {c.id!r} has no regex")
                try:
                    context.parse(c.within)
                except ValueError as e:
                    raise ConfigError(f"{r.id}: {e}") from e
            if len({c.id for c in r.components}) != len(r.components):
                raise ConfigError(f"{r.id}: a component is listed twice")
        _check_expression(self.filter, "filter")
        _check_expression(self.prefilter, "prefilter")
        return self

    def hash(self) -> str:
        """Names the whole configuration: filters and every rule."""
        data = _text(self.prefilter) + _text(self.filter) + _uvarint(len(self.rules))
        return hashlib.sha256(data + b"".join(map(_rule_bytes, self.rules))).hexdigest()

    def rule_hash(self, rule_id: str) -> str:
        """Names a rule and the rules of its components."""
        rule = self.rule(rule_id)
        return hashlib.sha256(_rule_bytes(rule) + b"".join(_rule_bytes(self.rule(c.id)) for c in rule.components)).hexdigest()

    def rule_hashes(self) -> dict[str, str]:
        return {r.id: self.rule_hash(r.id) for r in self.rules}

    def only(self, ids: set[str]) -> Config:
        """The rules `ids`; what they use as components stays too, without reports of its own."""
        missing = ids - set(self._by_id)
        if missing:
            raise ConfigError(f"there is no rule {sorted(missing)[0]!r}")
        used = {c.id for i in ids for c in self.rule(i).components} - ids
        return replace(self, rules=tuple(replace(r, skip_report=True) if r.id in used else r for r in self.rules if r.id in ids | used), _by_id={})

    def without(self, ids: set[str]) -> Config:
        """No rules `ids`, and none that need one of them as a component."""
        missing = ids - set(self._by_id)
        if missing:
            raise ConfigError(f"there is no rule {sorted(missing)[0]!r}")
        kept = [r for r in self.rules if r.id not in ids and not any(c.id in ids and not c.optional for c in r.components)]
        return replace(self, rules=tuple(replace(r, components=tuple(c for c in r.components if c.id not in ids)) for r in kept), _by_id={})


def _check_expression(source: str, where: str) -> None:
    if not source.strip():
        return
    try:
        called = expressions.names_called(expressions.parse(source))
    except ValueError as e:
        raise ConfigError(f"{where}: {e}") from e
    unknown = called - FILTER_FUNCTIONS - NATIVE
    if unknown:
        raise ConfigError(f"{where}: unknown function {sorted(unknown)[0]}")


def _uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _varint(n: int) -> bytes:
    return _uvarint(n << 1 ^ (n >> 63) if n >= 0 else (-n << 1) - 1)


def _text(value: str) -> bytes:
    data = value.encode()
    return _uvarint(len(data)) + data


def _texts(values: tuple[str, ...]) -> bytes:
    return _uvarint(len(values)) + b"".join(map(_text, values))


def _rule_bytes(r: Rule) -> bytes:
    """Every field with its length before it, in a fixed order."""
    components = b"".join(_text(c.id) + _text(c.within) + bytes([c.optional]) for c in r.components)
    head = _text(r.id) + _text(r.description) + _text(r.regex) + _text(r.path) + _varint(r.value_group) + _texts(r.keywords) + _texts(r.tags)
    tail = _varint(r.specificity) + _text(r.confidence) + _text(r.filter) + bytes([r.skip_report]) + _uvarint(len(r.components)) + components
    return head + tail + _text(r.validate) + _text(r.analyze) + _text(r.revoke)


_TOP = {"title", "description", "rules", "minVersion", "prefilter", "filter", "extend"}
_RULE = {"id": "id", "description": "description", "valueGroup": "value_group", "regex": "regex", "path": "path", "tags": "tags", "specificity": "specificity", "confidence": "confidence", "keywords": "keywords", "components": "components", "skipReport": "skip_report", "validate": "validate", "analyze": "analyze", "revoke": "revoke", "filter": "filter"}
_COMPONENT = {"id", "optional", "within"}
_EXTEND = {"path", "useDefault", "disabledRules"}


def _known(keys, allowed, where: str) -> None:
    unknown = set(keys) - set(allowed)
    if unknown:
        raise ConfigError(f"{where}: unknown key {sorted(unknown)[0]!r}")


def rule_from(raw: dict, k: int = 0) -> Rule:
    """A rule from its TOML table, the k-th."""
    where = f"rule {raw.get('id', k)!r}"
    _known(raw, _RULE, where)
    fields = {_RULE[name]: value for name, value in raw.items()}
    for c in fields.get("components", ()):
        _known(c, _COMPONENT, f"{where}: component")
    fields["components"] = tuple(Component(**c) for c in fields.get("components", ()))
    fields["keywords"] = tuple(w.lower() for w in fields.get("keywords", ()))
    fields["tags"] = tuple(fields.get("tags", ()))
    return Rule(**{"id": "", **fields})


def parse_config(text: str, folder: Path | None = None, depth: int = 0) -> Config:
    """A configuration from TOML. `extend` may go two levels deep; paths are relative to `folder`."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    _known(data, _TOP, "configuration")
    rules = [rule_from(raw, k) for k, raw in enumerate(data.get("rules", ()))]
    own = Config(data.get("title", ""), data.get("description", ""), tuple(rules), data.get("prefilter", ""), data.get("filter", ""), data.get("minVersion", ""))
    extend = data.get("extend")
    if extend:
        _known(extend, _EXTEND, "extend")
        if extend.get("path") and extend.get("useDefault"):
            raise ConfigError("extend: either path or useDefault")
        if depth >= 2:
            raise ConfigError("extend: more than two levels")
        if extend.get("useDefault"):
            base = default_config()
        elif extend.get("path"):
            path = (folder or Path()) / extend["path"]
            base = parse_config(path.read_text(), path.parent, depth + 1)
        else:
            base = Config()
        own = merged(base, own, set(extend.get("disabledRules", ())))
    return own.check() if depth == 0 else own


def merged(base: Config, child: Config, disabled: set[str]) -> Config:
    """The child's rules replace the base's of the same id; filters hold if either holds."""
    rules = {r.id: r for r in base.rules if r.id not in disabled} | {r.id: r for r in child.rules}
    either = lambda a, b: f"({a.strip()}) || ({b.strip()})" if a.strip() and b.strip() else a or b
    return Config(child.title or base.title, child.description or base.description, tuple(rules[i] for i in sorted(rules)), either(base.prefilter, child.prefilter), either(base.filter, child.filter), child.min_version or base.min_version)


def load_config(path: str) -> Config:
    return parse_config(Path(path).read_text(), Path(path).parent)


def default_config() -> Config:
    """The built-in catalog with the default filters."""
    from . import rules

    return rules.default()
