"""Validation and analysis of findings by an injected client; nothing here opens a connection by itself.

Credentials are looked up once: findings are reduced to distinct (rule, value, captures, components), the
client is asked for each, and answers are joined back. Errors are not remembered between runs.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ANALYSIS
from .staging import stage
from . import summary

RESULTS = ("valid", "invalid", "revoked", "unknown", "needs_validation", "error")
CAPABILITIES = ("read", "write", "admin", "create_credentials", "manage_users", "read_secrets")
Client = Callable[[dict], dict]


class Limiter:
    """A request budget: a total, and a rate without bursts. Refused requests need validation later."""

    def __init__(self, total: int | None = None, per_second: float | None = None, clock=time.monotonic):
        self.total, self.per_second, self.clock = total, per_second, clock
        self.used, self.next_at = 0, 0.0

    def take(self) -> bool:
        now = self.clock()
        if self.total is not None and self.used >= self.total or self.per_second is not None and now < self.next_at:
            return False
        self.used += 1
        if self.per_second is not None:
            self.next_at = now + 1 / self.per_second
        return True


def check_result(result: dict) -> dict:
    """A client's answer in the closed form that is stored; anything else is an error."""
    if not isinstance(result, dict) or result.get("result") not in RESULTS:
        return {"status": "error", "reason": "the client gave no known result"}
    unknown = set(result) - {"result", "reason", "metadata", "identity", "capabilities", "severity"}
    if unknown:
        return {"status": "error", "reason": f"unknown field {sorted(unknown)[0]}"}
    listed = [c for c in CAPABILITIES if c in (result.get("capabilities") or ())]
    return {"status": result["result"], "reason": result.get("reason") or "", "capabilities": listed, "identity": result.get("identity"), "metadata": result.get("metadata"), "severity": result.get("severity")}


def severity_of(capabilities) -> str:
    return "high" if set(capabilities) & set(summary.HIGH) else "medium" if "read" in capabilities else "unknown"


def ask(client: Client, credential: dict, limiter: Limiter | None = None, analyze: Client | None = None) -> dict:
    """The analysis of one credential; `analyze` is asked only about valid ones, its failure keeps the status."""
    if limiter is not None and not limiter.take():
        return {"status": "needs_validation", "reason": "the request budget is used up"}
    try:
        answer = check_result(client(credential))
    except Exception as e:  # noqa: BLE001 - whatever the client raises is its answer
        return {"status": "error", "reason": str(e)[:2000]}
    if answer["status"] == "valid":
        if analyze is not None:
            try:
                more = check_result({"result": "valid"} | analyze(credential))
                answer |= {k: more[k] for k in ("capabilities", "identity", "metadata") if more.get(k)}
            except Exception:  # noqa: BLE001
                answer["severity"] = "unknown"
        answer["severity"] = answer.get("severity") or severity_of(answer.get("capabilities") or ())
    return answer


def credential_key():
    parts = F.transform("component_sets", lambda s: F.transform(s["components"], lambda c: F.concat(c["rule_id"], F.lit("="), c["match"]["value"])))
    captures = F.array_sort(F.transform(F.map_entries(F.coalesce("match.captures", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.sha2(F.to_json(F.struct("rule_id", "match.value", captures.alias("c"), parts.alias("p"))), 256)


def validate(findings: DataFrame, client: Client, analyze: Client | None = None, total_per_task: int | None = None) -> DataFrame:
    """Findings with `analysis`. Each credential is asked for once, now: the answers are staged and go back by key.

    Findings that cost a scan should be staged by the caller, as Pipeline does: they are read twice here.
    """
    keyed = findings.withColumn("credential", credential_key())
    distinct = keyed.groupBy("credential").agg(F.any_value("rule_id").alias("rule_id"), F.any_value("match.value").alias("value"), F.max("component_sets_truncated").alias("truncated"))

    def run(batches):
        limiter = Limiter(total_per_task) if total_per_task is not None else None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a = ask(client, {"rule_id": r["rule_id"], "value": r["value"]}, limiter, analyze)
                if r["truncated"] and a["status"] != "valid":
                    a = a | {"status": "needs_validation"}
                rows.append({"credential": r["credential"], "status": a["status"], "reason": a.get("reason") or "", "severity": a.get("severity") or "", "identity": str(a["identity"]) if a.get("identity") else None, "capabilities": a.get("capabilities") or [], "metadata": str(a["metadata"]) if a.get("metadata") else None})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string()) for n in ("credential", "status", "reason", "severity", "identity")] + [("capabilities", pa.list_(pa.string())), ("metadata", pa.string())]))

    answers = stage(distinct.mapInArrow(run, "credential string, status string, reason string, severity string, identity string, capabilities array<string>, metadata string"), "answers")
    analysis = F.struct("status", F.col("reason").alias("status_reason"), F.lit(None).cast("string").alias("status_metadata"), "reason", "severity", "identity", "capabilities", "metadata").cast(ANALYSIS).alias("analysis")
    return keyed.join(answers.select("credential", analysis), "credential", "left").drop("credential")


def only_status(findings: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The status filter; findings without analysis count as none."""
    return findings.where(F.coalesce(F.nullif("analysis.status", F.lit("")), F.lit("none")).isin(*wanted))


def revoke(client: Client, credential: dict, confirmed: bool = False) -> dict:
    """Ask a client to revoke one credential; refused unless it is confirmed."""
    if not confirmed:
        raise PermissionError("revocation must be confirmed")
    answer = client(credential)
    if answer.get("result") not in ("revoked", "unknown", "error"):
        return {"status": "error", "reason": "the client gave no known result"}
    return {"status": answer["result"], "reason": answer.get("reason", "")}
