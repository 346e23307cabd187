"""Scan, validate, filter by status, count: the whole run over a DataFrame of fragments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import summary, validate
from .scan import Scanner
from .staging import stage


@dataclass
class Result:
    findings: DataFrame
    summary: DataFrame


class Pipeline:
    def __init__(self, scanner: Scanner, client: validate.Client | None = None, analyze: validate.Client | None = None, statuses: tuple[str, ...] = ()):
        self.scanner, self.client, self.analyze, self.statuses = scanner, client, analyze, statuses

    def run(self, fragments: DataFrame, excluded: tuple[str, ...] = ()) -> Result:
        """Scans now, and once: findings are staged. Counts are made before the status filter."""
        found = stage(self.scanner.scan(fragments, excluded), "findings")
        if self.client is not None:
            found = validate.validate(found, self.client, self.analyze)
        counted = summary.scan_summary(found)
        if self.statuses and self.client is not None:
            found = validate.only_status(found, self.statuses)
        return Result(found, counted)
