"""The registered queries of the scan engine, each over whole tables, with SQL that DuckDB can run where SQL can say it."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import tarfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Component, Config, Rule
from ..functions import context, decoding, dialect, text
from ..operators import native, redact, report, summary, validate
from ..operators.native import LineRule
from ..operators.pipeline import Pipeline
from ..operators.scan import Scanner, attribute, compile_prefilter, fragments_of, prefiltered, scan_text_udtf
from ..operators.staging import stage
from ..rules import FILTER, PREFILTER, SKIPPED, default
from ..sources import chunks, git, remote

TOKEN = r"""(?i)token[ \t]{0,5}[=:][ \t]{0,5}["']?([a-z0-9]{20,64})"""
EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,6})"
IPV4 = r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b"
CARD = r"\b([0-9]{16})\b"
HEX = r"\b([a-f0-9]{40})\b"
LICENSE = r"(Licensed under the [A-Za-z]+)"

LINE_RULES = [
    LineRule("token", TOKEN, 1, 10, "high"),
    LineRule("email", EMAIL, 1, 0, "medium"),
    LineRule("ipv4", IPV4, 1, 0, "low"),
    LineRule("card", CARD, 1, 0, "low"),
    LineRule("hex", HEX, 1, -10, "medium"),
    LineRule("license", LICENSE, 1, 0, ""),
]
SMOKE = Config(
    title="smoke",
    rules=(
        Rule("token", "a token", TOKEN, keywords=("token",), confidence="high", specificity=10, filter="entropy(finding.secret) < 2.5", components=(Component("email", True, "20L"),)),
        Rule("email", "an address", EMAIL, keywords=("@",), confidence="medium"),
        Rule("ipv4", "an address of a machine", IPV4, confidence="low"),
        Rule("card", "a card number", CARD, confidence="low"),
        Rule("hex", "a long hex number", HEX, confidence="medium", specificity=-10),
        Rule("license", "a licence line", LICENSE, keywords=("licensed",)),
    ),
).check()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _docs(spark, sf_dir):
    return _read(spark, sf_dir, "documents")


def _found(spark, sf_dir) -> DataFrame:
    return native.findings(_docs(spark, sf_dir), "doc_id", "text", LINE_RULES)


def _fragments(spark, sf_dir) -> DataFrame:
    return fragments_of(_docs(spark, sf_dir), "doc_id", "text", "documents")


def _doc_id(column="fragment_id"):
    return F.split_part(F.col(column), F.lit("/"), F.lit(2)).cast("bigint")


def merged_config() -> Config:
    """The built-in rules and the smoke rules together."""
    base = default()
    return Config("all", "", base.rules + SMOKE.rules, base.prefilter, base.filter).check()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan: all rules, five decoding passes, over every document."""
    found = Scanner(merged_config(), decode_depth=5).scan(_fragments(spark, sf_dir))
    return found.select("fragment_id", "rule_id", "confidence", "decode_depth", F.col("match.value").alias("value"), F.col("match.fingerprint").alias("fingerprint"), "location.start_line", "location.start_column", "location.end_column")


# ---- SQL pieces ----------------------------------------------------------------------------------------


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents WHERE text IS NOT NULL)"


def _found_sql() -> str:
    parts = [f"SELECT doc_id, line_no, line, '{r.id}' AS rule_id, {r.specificity}::BIGINT AS specificity, '{r.confidence}' AS confidence, unnest(regexp_extract_all(line, {_q(r.regex)}, {r.group})) AS value, unnest(regexp_extract_all(line, {_q(r.regex)}, 0)) AS whole, generate_subscripts(regexp_extract_all(line, {_q(r.regex)}, 0), 1) AS nth FROM lines" for r in LINE_RULES]
    return f"WITH {_LINES}, found AS ({' UNION ALL '.join(parts)})"


FOUND = _found_sql()
#: found with `ahead`, the part of the line before the value: a match that comes again stands at its next occurrence
PLACED = FOUND + """, placed AS (
  SELECT *, substr(line, 1, (list_sum(list_transform(list_slice(string_split(line, whole), 1, again), lambda x: length(x))) + (again - 1) * length(whole) + length(string_split(whole, value)[1]))::BIGINT) AS ahead
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, rule_id, whole ORDER BY nth) AS again FROM found)
)"""
ENTROPY_SQL = """(SELECT coalesce(-sum(c / n * log2(c / n)), 0) FROM (SELECT count(*)::DOUBLE AS c, any_value(n) AS n FROM (SELECT unnest(range(strlen(value))) AS i, strlen(value)::DOUBLE AS n) GROUP BY substr(value, (i + 1)::INT, 1)))"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


# ---- matching ------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, unnest(regexp_extract_all(text, {_q(TOKEN)}, 1)) AS value FROM documents")
def regex_values(spark, sf_dir):
    """Every match of a pattern, by document."""
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(dialect.java_regex(TOKEN)), F.lit(1))).alias("value"))


GATE = {"tokens": ["token", "secret"], "addresses": ["@"], "license": ["licensed under", "copyright"], "markup": ["<html", "<p>"]}


@query(" UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule_id FROM documents WHERE {' OR '.join(f'contains(lower(text), {_q(w)})' for w in words)}" for rule, words in GATE.items()))
def keyword_gate(spark, sf_dir):
    """Which rules may match which documents, by keyword."""
    return native.keyword_gate(_docs(spark, sf_dir), "doc_id", "text", GATE)


_NAMES = ["logo.PNG", "src/app.py", "go.sum", "vendor/modules.txt", "web/package-lock.json", "conf/key.p12", "README.md", "lib/jquery-3.1.min.js"]
_NAME_SQL = "CASE page_id % 8 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NAMES)) + " END"


def _named_pages(spark, sf_dir) -> DataFrame:
    """Pages as fragments whose paths look like a repository's."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % 8 + 1).cast("int"))
    return _read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("raw"), F.lit(1).alias("start_line"), F.create_map(F.lit("path"), name).alias("attributes"), F.col("page_id").cast("string").alias("fragment_id"))


@query(f"SELECT page_id, {_NAME_SQL} AS path FROM pages WHERE NOT regexp_matches({_NAME_SQL}, {_q(dialect.any_of(SKIPPED))})")
def prefilter_path(spark, sf_dir):
    """The default prefilter as a column."""
    return _named_pages(spark, sf_dir).where(~compile_prefilter(PREFILTER)).select("page_id", attribute("path").alias("path"))


@query(f"SELECT page_id FROM pages WHERE {_NAME_SQL} NOT IN ('src/app.py', 'README.md')")
def path_exclusion(spark, sf_dir):
    """Fragments whose path isn't in a list of excluded ones."""
    return prefiltered(_named_pages(spark, sf_dir), Config(), ("src/app.py", "README.md")).select("page_id")


@query(f"SELECT page_id::VARCHAR AS fragment_id, 'pkcs12-file' AS rule_id, 'file detected: ' || {_NAME_SQL} AS full_text FROM pages WHERE {_NAME_SQL} LIKE '%.p12'")
def path_only_rule(spark, sf_dir):
    """A rule without pattern reports paths, once for each file."""
    config = Config(rules=(Rule("pkcs12-file", path=r"(?i)\.p(?:12|fx)$"),))
    found = Scanner(config).scan(_named_pages(spark, sf_dir))
    return found.select("fragment_id", "rule_id", F.col("match.full").alias("full_text"))


@query(FOUND + " SELECT doc_id, line_no, rule_id, value FROM found")
def native_findings(spark, sf_dir):
    """All line rules in one pass over the lines."""
    return _found(spark, sf_dir).select("doc_id", "line_no", "rule_id", "value")


# ---- filters -------------------------------------------------------------------------------------------


@query(FOUND + f" SELECT doc_id, rule_id, value, round({ENTROPY_SQL}, 6) AS entropy FROM found WHERE round({ENTROPY_SQL}, 6) >= 3")
def entropy_filter(spark, sf_dir):
    """Values of at least three bits of entropy a byte."""
    found = _found(spark, sf_dir).withColumn("entropy", F.round(text.entropy(F.col("value")), 6))
    return found.where("entropy >= 3").select("doc_id", "rule_id", "value", "entropy")


@query(FOUND + " SELECT doc_id, rule_id, value FROM found WHERE NOT (regexp_matches(value, '^(?:1|2)|7$') OR contains(lower(value), 'apache') OR starts_with(value, '9'))")
def global_filter(spark, sf_dir):
    """A filter expression, compiled to columns, drops findings of all rules."""
    drop = 'matchesAny(finding.secret, [`^(?:1|2)|7$`]) || containsAny(finding.secret, ["APACHE"]) || startsWithAny(finding.secret, ["9"])'
    from ..functions import expressions

    column = expressions.to_column(expressions.parse(drop), {"finding": {"secret": F.col("value")}.__getitem__})
    return _found(spark, sf_dir).where(~column).select("doc_id", "rule_id", "value")


@query(FOUND + f" SELECT doc_id, rule_id, value FROM found WHERE NOT (rule_id = 'card' AND ({ENTROPY_SQL} < 2.5 OR length(value) < 3)) AND NOT (rule_id = 'ipv4' AND value IN ('127.0.0.1') OR rule_id = 'ipv4' AND starts_with(value, '1'))")
def rule_filters(spark, sf_dir):
    """Filters of single rules."""
    own = {"card": "let s = finding.secret; entropy(s) < 2.5 || len(s) < 3", "ipv4": 'finding.secret in ["127.0.0.1"] || finding.secret startsWith "1"'}
    rules = [LineRule(r.id, r.regex, r.group, r.specificity, r.confidence, own.get(r.id, "")) for r in LINE_RULES]
    return native.findings(_docs(spark, sf_dir), "doc_id", "text", rules).select("doc_id", "rule_id", "value")


@query(FOUND + " SELECT doc_id, line_no, rule_id, value FROM found WHERE NOT contains(line, ' the ')")
def allow_marker(spark, sf_dir):
    """Findings whose source line has no marker."""
    return native.without_markers(_found(spark, sf_dir), (" the ",)).select("doc_id", "line_no", "rule_id", "value")


@query(FOUND + " SELECT doc_id, rule_id, value, sha256(value) AS fingerprint FROM found")
def value_fingerprint(spark, sf_dir):
    """SHA-256 of each value."""
    return _found(spark, sf_dir).select("doc_id", "rule_id", "value", text.fingerprint_column(F.col("value")).alias("fingerprint"))


@query(FOUND + " SELECT doc_id, rule_id, value FROM found WHERE sha256(value) NOT IN (SELECT sha256(value) FROM found WHERE doc_id % 3 = 0)")
def ignore_anti_join(spark, sf_dir):
    """Findings whose fingerprint isn't in a table of ignored ones."""
    found = stage(_found(spark, sf_dir).select("doc_id", "rule_id", "value"), "found")  # both sides read it: one scan of the texts
    ignored = found.where("doc_id % 3 = 0").select(text.fingerprint_column(F.col("value")).alias("fingerprint"))
    return native.not_ignored(found, ignored).select("doc_id", "rule_id", "value")


@query(FOUND + " SELECT doc_id, rule_id, value, confidence FROM found WHERE confidence <> 'low'")
def min_confidence(spark, sf_dir):
    """Findings of medium confidence or more; without a level they stay."""
    return native.at_least(_found(spark, sf_dir), "medium").select("doc_id", "rule_id", "value", "confidence")


# ---- joins ---------------------------------------------------------------------------------------------


@query(FOUND + " SELECT doc_id, line_no, rule_id, value FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.rule_id <> b.rule_id AND b.specificity > a.specificity AND contains(b.value, a.value))")
def specificity_precedence(spark, sf_dir):
    """A more specific rule's finding on the same line covers others."""
    return native.most_specific(_found(spark, sf_dir), "doc_id").select("doc_id", "line_no", "rule_id", "value")


_NEAR = " FROM (SELECT * FROM found WHERE rule_id = 'ipv4') p {how} JOIN (SELECT doc_id AS d, line_no AS part_line, rule_id AS part_rule, value AS part_value FROM found WHERE rule_id IN ('card', 'token')) c ON p.doc_id = c.d AND c.part_line BETWEEN p.line_no - 4 AND p.line_no + 4"


def _near(spark, sf_dir, optional: bool = False) -> DataFrame:
    rule = F.col("rule_id")
    return native.near(_found(spark, sf_dir), rule == "ipv4", rule.isin("card", "token"), "doc_id", 4, 4, optional)


@query(FOUND + " SELECT doc_id, line_no, value, part_rule, part_line, part_value" + _NEAR.format(how="INNER"))
def component_proximity(spark, sf_dir):
    """Findings with a required component within five lines."""
    return _near(spark, sf_dir).select("doc_id", "line_no", "value", "part_rule", "part_line", "part_value")


@query(FOUND + " SELECT doc_id, line_no, value, part_rule, part_line, part_value" + _NEAR.format(how="LEFT"))
def component_optional(spark, sf_dir):
    """The same with an optional component."""
    return _near(spark, sf_dir, optional=True).select("doc_id", "line_no", "value", "part_rule", "part_line", "part_value")


@query(FOUND + ", n AS (SELECT doc_id, line_no, value, count(*) AS c" + _NEAR.format(how="INNER") + " GROUP BY ALL) SELECT doc_id, line_no, value, least(c, 1)::BIGINT AS n_sets, c > 1 AS truncated FROM n")
def component_sets_capped(spark, sf_dir):
    """Component sets up to a cap, and whether there were more."""
    return native.capped_sets(_near(spark, sf_dir), ["doc_id", "line_no", "value"], 1).withColumn("n_sets", F.col("n_sets").cast("bigint"))


# ---- places and contexts -------------------------------------------------------------------------------


@query(PLACED + " SELECT doc_id, line_no, rule_id, value, (strlen(ahead) + 1)::BIGINT AS start_column, (strlen(ahead) + strlen(value))::BIGINT AS end_column FROM placed")
def location_line_col(spark, sf_dir):
    """Lines from 1, columns in bytes from 1, the end inclusive."""
    return native.location(_found(spark, sf_dir)).select("doc_id", "line_no", "rule_id", "value", "start_column", F.col("end_column").cast("bigint").alias("end_column"))


@query(PLACED + " SELECT doc_id, line_no, rule_id, value, substr(line, greatest(1, length(ahead) + 1 - 10), length(value) + 10 + least(10, length(ahead))) AS context FROM placed")
def context_window_cols(spark, sf_dir):
    """Ten characters around each value, inside its line."""
    found = _found(spark, sf_dir).withColumn("ahead", F.col("ahead").cast("int"))
    cut = F.substring("line", F.greatest(F.lit(1), F.col("ahead") - 9), F.length("value") + 10 + F.least(F.lit(10), F.col("ahead")))
    return found.select("doc_id", "line_no", "rule_id", "value", cut.alias("context"))


# ---- the kernel ----------------------------------------------------------------------------------------

_KERNEL_SQL = FOUND + " SELECT doc_id, rule_id, line_no AS start_line, value FROM found a WHERE rule_id <> 'none' AND NOT EXISTS (SELECT 1 FROM found b WHERE a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.rule_id <> b.rule_id AND b.specificity > a.specificity AND contains(b.value, a.value))"
PLAIN = Config(rules=tuple(Rule(r.id, regex=r.regex, specificity=r.specificity, confidence=r.confidence) for r in LINE_RULES)).check()


def _line_of(found: DataFrame) -> DataFrame:
    return found.select(_doc_id().alias("doc_id"), "rule_id", F.col("location.start_line").cast("bigint").alias("start_line"), F.col("match.value").alias("value"))


@query(_KERNEL_SQL)
def kernel_scan(spark, sf_dir):
    """The kernel, with gate, precedence and places, gives what the native path and SQL give."""
    return _line_of(Scanner(PLAIN).scan(_fragments(spark, sf_dir)))


@query()
def default_rules_scan(spark, sf_dir):
    """The whole catalog with default filters and five decoding passes over all documents."""
    return flagship(spark, sf_dir)


@query()
def pages_scan(spark, sf_dir):
    """The catalog over the HTML of all pages."""
    found = Scanner(merged_config(), decode_depth=2).scan(fragments_of(_read(spark, sf_dir, "pages"), "page_id", "html", "pages", url="url"))
    return found.select("fragment_id", "rule_id", "confidence", F.col("match.value").alias("value"), "location.start_line", F.element_at("attributes", "url").alias("url"))


def _encoded(spark, sf_dir, encode, pattern: str) -> DataFrame:
    """Documents' tokens behind an encoding, scanned with decoding."""
    values = regex_values(spark, sf_dir).withColumn("raw", F.concat(F.lit("data: "), encode(F.concat(F.lit('token = "'), F.col("value"), F.lit('"'))), F.lit(" end")))
    fragments = values.select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("fragment_id"), "raw", F.lit(1).alias("start_line"), F.create_map(F.lit("path"), F.lit("x")).alias("attributes"))
    config = Config(rules=(Rule("token", regex=pattern, keywords=("token",)),)).check()
    found = Scanner(config, decode_depth=3).scan(fragments)
    return found.select(_doc_id().alias("doc_id"), F.col("match.value").alias("value"), F.array_join("encodings", ",").alias("encodings"), F.col("decode_depth").cast("bigint").alias("decode_depth"))


def _base64(c):
    """Base64 without the line ends that the function puts in."""
    return F.regexp_replace(F.base64(c.cast("binary")), "[\r\n]", "")


def _decode_sql(kind: str, depth: int = 1) -> str:
    return f"SELECT doc_id, unnest(regexp_extract_all(text, {_q(TOKEN)}, 1)) AS value, '{kind}' AS encodings, {depth}::BIGINT AS decode_depth FROM documents"


@query(_decode_sql("base64"))
def decode_base64(spark, sf_dir):
    """Tokens behind base64 are found in the decoded text."""
    return _encoded(spark, sf_dir, _base64, TOKEN)


@query(_decode_sql("hex"))
def decode_hex(spark, sf_dir):
    """Tokens behind hex."""
    return _encoded(spark, sf_dir, lambda c: F.lower(F.hex(c)), TOKEN)


@query(_decode_sql("percent"))
def decode_percent(spark, sf_dir):
    """Tokens whose every byte is a percent escape."""
    return _encoded(spark, sf_dir, lambda c: F.regexp_replace(F.hex(c), "(..)", "%$1"), TOKEN)


@query(_decode_sql("unicode"))
def decode_unicode(spark, sf_dir):
    r"""Tokens whose every sign is a \u escape."""
    return _encoded(spark, sf_dir, lambda c: F.regexp_replace(F.hex(c), "(..)", r"\\\\u00$1"), TOKEN)


@query(_decode_sql("base64", 2))
def decode_twice(spark, sf_dir):
    """Base64 inside base64: the second pass finds it."""
    return _encoded(spark, sf_dir, lambda c: _base64(_base64(c)), TOKEN)


# ---- redaction, validation, summaries ------------------------------------------------------------------


@query(FOUND + " SELECT doc_id, rule_id, left(value, round_even(length(value) * 0.25, 0)::INT) || '...' AS masked FROM found")
def redact_mask(spark, sf_dir):
    """Values with three quarters hidden."""
    return _found(spark, sf_dir).select("doc_id", "rule_id", text.mask_column(F.col("value"), 75).alias("masked"))


@query(_KERNEL_SQL.replace("SELECT doc_id, rule_id, line_no AS start_line, value FROM", "SELECT doc_id, rule_id, 'REDACTED' AS value, sha256(value) AS fingerprint, contains(line, 'REDACTED') AS planted FROM"))
def redact_records(spark, sf_dir):
    """Whole records without their secrets; fingerprints stay."""
    found = redact.redact(Scanner(PLAIN).scan(_fragments(spark, sf_dir)), 100)
    return found.select(_doc_id().alias("doc_id"), "rule_id", F.col("match.value").alias("value"), F.col("match.fingerprint").alias("fingerprint"), (~F.col("match.line").contains("REDACTED")).alias("planted"))


def fake_client(credential: dict) -> dict:
    """A client for tests: the answer depends on the value's digest alone."""
    n = int(hashlib.sha256(credential["value"].encode()).hexdigest()[:2], 16) % 4
    return {"result": ("valid", "invalid", "revoked", "unknown")[n], "capabilities": ["read", "write"] if n == 0 and credential["rule_id"] == "token" else ["read"]}


_STATUS_SQL = "CASE ('0x' || substr(sha256(value), 1, 2))::INT % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'revoked' ELSE 'unknown' END"


@query(FOUND + f" SELECT doc_id, max(struct_pack(r := list_position(['none', 'error', 'invalid', 'unknown', 'revoked', 'needs_validation', 'valid'], {_STATUS_SQL}), s := {_STATUS_SQL})).s AS status FROM found GROUP BY doc_id")
def status_rollup(spark, sf_dir):
    """The most telling status of each document's findings."""
    digest = F.conv(F.substring(F.sha2("value", 256), 1, 2), 16, 10).cast("int") % 4
    status = F.element_at(F.array(*map(F.lit, ("valid", "invalid", "revoked", "unknown"))), digest + 1)
    return summary.rolled_up(_found(spark, sf_dir).withColumn("status", status), ["doc_id"])


@query(FOUND + f" SELECT doc_id, rule_id, value, {_STATUS_SQL} AS status, CASE WHEN {_STATUS_SQL} <> 'valid' THEN '' WHEN rule_id = 'token' THEN 'high' ELSE 'medium' END AS severity FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.rule_id <> b.rule_id AND b.specificity > a.specificity AND contains(b.value, a.value))")
def validated_findings(spark, sf_dir):
    """Findings with the answers of a client; each credential is asked for once."""
    found = Pipeline(Scanner(PLAIN), fake_client).run(_fragments(spark, sf_dir)).findings
    return found.select(_doc_id().alias("doc_id"), "rule_id", F.col("match.value").alias("value"), F.col("analysis.status").alias("status"), F.col("analysis.severity").alias("severity"))


@query("SELECT event_type, CASE WHEN list_has_any(c, ['admin', 'create_credentials', 'manage_users', 'read_secrets', 'write']) THEN 'high' WHEN list_contains(c, 'read') THEN 'medium' ELSE 'unknown' END AS severity, count(*) AS n FROM (SELECT event_type, CASE event_id % 3 WHEN 0 THEN ['read', 'write'] WHEN 1 THEN ['read'] ELSE ['list'] END AS c FROM events) GROUP BY ALL")
def severity_derivation(spark, sf_dir):
    """Severity from capabilities, counted over all events."""
    events = _read(spark, sf_dir, "events")
    held = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("read"), F.lit("write"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("read"))).otherwise(F.array(F.lit("list")))
    return events.select("event_type", summary.severity(held).alias("severity")).groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(FOUND + " SELECT count(*) AS num_findings, count(*) FILTER (confidence = 'high') AS confidence_high, count(*) FILTER (confidence = 'medium') AS confidence_medium, count(*) FILTER (confidence = 'low') AS confidence_low, count(*) FILTER (confidence = '') AS confidence_none, 0::BIGINT AS confidence_other FROM found")
def scan_summary(spark, sf_dir):
    """The counts of a report."""
    return summary.scan_summary(_found(spark, sf_dir))


@query(FOUND + " SELECT rule_id, count(*) AS n, count(DISTINCT value) AS n_values FROM found GROUP BY rule_id")
def findings_by_rule(spark, sf_dir):
    """Findings and distinct values of each rule."""
    return summary.by_rule(_found(spark, sf_dir))


@query("SELECT coalesce(sum(strlen(text)), 0)::BIGINT AS bytes_scanned FROM documents")
def bytes_scanned(spark, sf_dir):
    """How many bytes a scan reads."""
    return summary.bytes_scanned(_fragments(spark, sf_dir))


@query(FOUND + " SELECT count(*) AS n, sum(length(value))::BIGINT AS value_chars FROM found a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.rule_id <> b.rule_id AND b.specificity > a.specificity AND contains(b.value, a.value))")
def report_lines(spark, sf_dir):
    """JSON lines of a report, read back as JSON."""
    lines = report.json_lines(Scanner(PLAIN).scan(_fragments(spark, sf_dir)))
    value = F.get_json_object("value", "$.finding.match.value")
    return lines.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(value)).cast("bigint").alias("value_chars"))


# ---- sources -------------------------------------------------------------------------------------------


@query("SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents WHERE text <> '') GROUP BY doc_id")
def chunked_reader(spark, sf_dir):
    """Long texts in chunks: lines and starts stay right, nothing is lost."""
    parts = chunks.text_to_fragments(_docs(spark, sf_dir).where("text <> ''"), "doc_id", "text", "documents")
    doc = F.split_part(attribute("path"), F.lit("/"), F.lit(2)).cast("bigint")
    newlines = F.length("raw") - F.length(F.replace("raw", F.lit("\n"), F.lit("")))
    return parts.groupBy(doc.alias("doc_id")).agg((F.sum(newlines) + 1).cast("bigint").alias("n_lines"))


def _pack(kind: str):
    def run(batches):
        for batch in batches:
            files = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, out = (body or "").encode(), io.BytesIO()
                if kind == "zip":
                    with zipfile.ZipFile(out, "w") as z:
                        z.writestr("a.txt", data)
                else:
                    with tarfile.open(fileobj=out, mode="w:gz") as t:
                        info = tarfile.TarInfo("a.txt")
                        info.size = len(data)
                        t.addfile(info, io.BytesIO(data))
                files.append((f"documents/{key}.{'zip' if kind == 'zip' else 'tgz'}", out.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files], pa.binary())], names=["path", "content"])

    return run


_ARCHIVE_SQL = "SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars FROM documents"


def _archived(spark, sf_dir, kind) -> DataFrame:
    packed = _docs(spark, sf_dir).select("doc_id", "text").mapInArrow(_pack(kind), "path string, content binary")
    parts = chunks.contents_to_fragments(packed, 2)
    doc = F.regexp_extract(attribute("path"), r"^documents/(-?\d+)\.", 1).cast("bigint")
    return parts.groupBy(doc.alias("doc_id")).agg(F.sum(F.length("raw")).cast("bigint").alias("n_chars"))


@query(_ARCHIVE_SQL)
def archive_zip(spark, sf_dir):
    """Every document in a zip file of its own, read back through the archive source."""
    return _archived(spark, sf_dir, "zip")


@query(_ARCHIVE_SQL)
def archive_tar_gz(spark, sf_dir):
    """Every document in a compressed tar file: two levels are opened."""
    return _archived(spark, sf_dir, "tgz")


@query("SELECT doc_id, text || chr(10) AS raw, 7::BIGINT AS start_line FROM documents WHERE text <> ''")
def git_patch(spark, sf_dir):
    """Documents as added lines of a patch, read back by the patch source."""
    body = F.concat(F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    n = F.size(F.split("text", "\n"))
    patch = F.concat(F.lit("commit 0123456789abcdef0123456789abcdef01234567\nAuthor: A B <a@b.c>\nDate:   2024-01-01\n\n    message\n\ndiff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,0 +7,"), n.cast("string"), F.lit(" @@\n"), body, F.lit("\n"))
    parts = git.patches_to_fragments(_docs(spark, sf_dir).where("text <> ''").select("doc_id", patch.alias("patch")), "doc_id", "patch")
    return parts.select(F.split_part("fragment_id", F.lit(":"), F.lit(1)).cast("bigint").alias("doc_id"), "raw", F.col("start_line").cast("bigint").alias("start_line"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-z]+://)[^/@]*@', '\\1') AS bare FROM pages")
def url_redaction(spark, sf_dir):
    """URLs without user, query and fragment."""
    return _read(spark, sf_dir, "pages").select("page_id", text.redact_url_column(F.col("url")).alias("bare"))


# ---- table function, streams ---------------------------------------------------------------------------


@query(_KERNEL_SQL)
def scan_table_function(spark, sf_dir):
    """The scan as a table function in SQL."""
    scan_text_udtf(spark, PLAIN)
    _docs(spark, sf_dir).createOrReplaceTempView("sieveline_documents")
    return spark.sql("SELECT doc_id, f.rule_id, CAST(f.start_line AS BIGINT) AS start_line, f.value FROM sieveline_documents, LATERAL scan_text(text) AS f")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    """Counts by hour and type (an extension), by the window of the streaming operator."""
    from ..streaming import scan

    return scan.rate(_read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("hour", F.col("hour").cast("timestamp_ntz"))
