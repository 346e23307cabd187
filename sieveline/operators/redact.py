"""Redaction: every value of a finding, its components and captures is replaced wherever it stands."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import text


def secrets_of(finding: dict) -> list[str]:
    """All values to hide, the longest first."""
    found = set()

    def add(match):
        if match:
            found.update(x for x in (match.get("value"), *dict(match.get("captures") or {}).values()) if x)

    add(finding.get("match"))
    for one in finding.get("component_sets") or ():
        for part in one.get("components") or ():
            add(part.get("match"))
    return sorted(found, key=lambda s: (-len(s), s))


def redact_finding(finding: dict, percent: float) -> dict:
    """The finding with its secrets masked in one pass; fingerprints stay."""
    secrets = secrets_of(finding)
    if not secrets:
        return finding
    pattern = re.compile("|".join(map(re.escape, secrets)))

    def walk(x, name=""):
        if isinstance(x, str):
            return x if name in ("fingerprint", "rule_id", "rule_hash", "fragment_id") else pattern.sub(lambda m: text.mask(m.group(), percent), x)
        if isinstance(x, dict):
            return {k: walk(v, k) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, name) for v in x]
        if isinstance(x, tuple):
            return tuple(walk(v, name) for v in x)
        return x

    return walk(finding)


def redact(findings: DataFrame, percent: float = 100) -> DataFrame:
    """Findings with their secrets hidden."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(findings.schema)

    def run(batches):
        for batch in batches:
            rows = [redact_finding(r, percent) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return findings.mapInArrow(run, findings.schema)


def to_wire(finding: dict) -> dict:
    """What is written of a finding: no line, no empty optional fields."""

    def match(m):
        out = {"full": m.get("full") or "", "value": m.get("value") or ""}
        return out | {k: dict(m[k]) if k == "captures" else m[k] for k in ("fingerprint", "captures", "context") if m.get(k)}

    def compact(d, keep=()):
        return {k: v for k, v in d.items() if k in keep or v not in (None, "", 0, [], {}, False)}

    out = {k: finding.get(k) for k in ("rule_id", "rule_hash", "description", "confidence", "encodings", "decode_depth")}
    out["match"] = match(finding["match"])
    out["attributes"] = dict(finding.get("attributes") or {})
    out["location"] = compact(finding["location"])
    out["component_sets"] = [{"components": [compact({**c, "match": match(c["match"]), "location": compact(c["location"])}) for c in s["components"]]} for s in finding.get("component_sets") or ()]
    out["component_sets_truncated"] = finding.get("component_sets_truncated")
    out["tags"] = finding.get("tags")
    if finding.get("analysis"):
        out["analysis"] = compact(finding["analysis"])
    return compact(out, ("rule_id", "description", "confidence", "match", "location"))


def dumps(finding: dict) -> str:
    return json.dumps(to_wire(finding), ensure_ascii=False)
