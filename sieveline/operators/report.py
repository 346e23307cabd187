"""Writers: JSON lines, JSON arrays, the report envelope, and text for people."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import summary
from .redact import dumps, to_wire
from .staging import stage

SCHEMA_VERSION = "1"


def json_lines(findings: DataFrame) -> DataFrame:
    """(value): one envelope {schema_version, finding} for each finding."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": [f'{{"schema_version": "{SCHEMA_VERSION}", "finding": {dumps(r)}}}' for r in batch.to_pylist()]})

    return findings.mapInArrow(run, "value string")


def write_jsonl(findings: DataFrame, path: str, with_scan: bool = True) -> None:
    """Text files of finding lines and, last, a file with the scan record."""
    findings = stage(findings, "report") if with_scan else findings
    json_lines(findings).write.mode("overwrite").text(path)
    if with_scan:
        row = summary.scan_summary(findings).first().asDict()
        findings.sparkSession.createDataFrame([(json.dumps({"schema_version": SCHEMA_VERSION, "scan": row}),)], "value string").coalesce(1).write.mode("append").text(path)


def write_json(findings: Iterable[dict], out, scan: dict | None = None) -> int:
    """Stream {schema_version, findings, scan} to a file object; returns how many findings there were."""
    out.write(f'{{"schema_version": "{SCHEMA_VERSION}", "findings": [')
    n = 0
    for n, finding in enumerate(findings, 1):
        out.write(("," if n > 1 else "") + "\n " + json.dumps(to_wire(finding), ensure_ascii=False, indent=1).replace("\n", "\n "))
    out.write(("\n" if n else "") + "]" + (f', "scan": {json.dumps(scan)}' if scan is not None else "") + "}\n")
    return n


def as_dicts(findings: DataFrame) -> Iterator[dict]:
    """Findings one by one, a partition at a time."""
    for row in findings.toLocalIterator():
        yield row.asDict(recursive=True)


def pretty(finding: dict, width: int = 100) -> str:
    """A finding for a terminal: where, the line, a mark under the value, components, analysis."""
    place, match = finding["location"], finding["match"]
    head = f"{finding['rule_id']} ({finding.get('confidence') or 'no confidence'})  {place.get('path') or '-'}:{place.get('start_line')}:{place.get('start_column')}"
    line = "".join(c if c.isprintable() else "." for c in (match.get("line") or match.get("full") or "").split("\n")[0])
    number = str(place.get("start_line") or "")
    at = max(line.find(match.get("value") or ""), 0)
    left = max(0, at - width // 2)
    shown = line[left : left + width]
    out = [head, f"  {number} | {shown}", f"  {' ' * len(number)} | {' ' * (at - left)}{'^' * max(1, min(len(match.get('value') or ''), width - (at - left)))}"]
    for k, one in enumerate(finding.get("component_sets") or (), 1):
        out += [f"  set {k}: " + ", ".join(f"{c['rule_id']} at line {c['location']['start_line']}" for c in one["components"])]
    if finding.get("component_sets_truncated"):
        out.append("  more sets were left out")
    if finding.get("analysis"):
        a = finding["analysis"]
        out.append(f"  status {a.get('status')}" + (f", severity {a['severity']}" if a.get("severity") else "") + (f": {a['reason']}" if a.get("reason") else ""))
    return "\n".join(out)


def exit_code(num_findings: int, complete: bool = True) -> int:
    """1 for findings, 2 for a scan that did not end, else 0."""
    return 1 if num_findings else 0 if complete else 2
