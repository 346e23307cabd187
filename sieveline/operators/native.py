"""The native path: findings of single-line rules, and what follows them, as columns and joins.

A rule is native if its pattern stays inside a line, it has no components and its filter compiles to columns.
Each pattern has a gate (dialect.gate): texts that pass none aren't split, and a rule's regexp runs on lines that pass its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIDENCE
from ..functions import dialect, expressions, text


@dataclass(frozen=True)
class LineRule:
    id: str
    regex: str
    group: int = 1
    specificity: int = 0
    confidence: str = ""
    filter: str = ""


def lines(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return df.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), "\n")).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("bigint"))


def findings(df: DataFrame, key: str, body: str, rules: list[LineRule]) -> DataFrame:
    """(key, line_no, line, rule_id, specificity, confidence, value, ahead) of every match; ahead: characters of the line before the value."""
    rows = lines(df.where(F.col(body).isNotNull() & _any(body, rules)), key, body).where(_any("line", rules))
    each = [F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.specificity).cast("bigint").alias("specificity"), F.lit(r.confidence).alias("confidence"), F.when(may_match(F.col("line"), r.regex), _matches(F.col("line"), dialect.java_regex(r.regex), r.group)).alias("values")) for r in rules]
    found = rows.withColumn("r", F.explode(F.array(*each))).select(key, "line_no", "line", "r.rule_id", "r.specificity", "r.confidence", F.explode("r.values").alias("v"))
    before = F.length(F.call_function("substring_index", F.col("line"), F.col("v.whole"), F.col("v.nth")))
    kept = found.withColumns({"value": F.col("v.value"), "ahead": (before + F.instr(F.col("v.whole"), F.col("v.value")) - 1).cast("bigint")}).drop("v")
    for r in rules:
        if r.filter:
            env = {"finding": {"secret": F.col("value"), "line": F.col("line"), "rule_id": F.col("rule_id"), "confidence": F.col("confidence")}.__getitem__}
            drop = F.coalesce(expressions.to_column(expressions.parse(r.filter), env), F.lit(False))
            kept = kept.where((F.col("rule_id") != r.id) | ~drop)
    return kept


def may_match(body: Column, regex: str) -> Column:
    """Whether a text passes the gate of a pattern: true wherever a line of it has a match, and rarely elsewhere."""
    held, pattern = dialect.gate(regex)
    tests = ([body.contains(held)] if held else []) + ([body.rlike(pattern)] if pattern else [])
    return reduce(Column.__and__, tests, F.lit(True))


def _any(column: str, rules: list[LineRule]) -> Column:
    return reduce(Column.__or__, [may_match(F.col(column), r.regex) for r in rules], F.lit(False))


def _matches(line: Column, pattern: str, group: int) -> Column:
    """(value, whole, nth) of each match; nth: how often the whole match has come in the line, with this one.

    The pairs are bound to a variable: inside a lambda, an expression would be computed again for each element.
    """
    values, wholes = (F.regexp_extract_all(line, F.lit(pattern), F.lit(g)) for g in (group, 0))

    def numbered(pairs):
        def number(pair, i):
            nth = F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda p: p["w"] == pair["w"]))
            return F.struct(pair["v"].alias("value"), pair["w"].alias("whole"), nth.alias("nth"))

        return F.transform(pairs, number)

    return F.transform(F.array(F.arrays_zip(values.alias("v"), wholes.alias("w"))), numbered)[0]


def without_markers(found: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """Findings whose source line has none of the markers (case counts)."""
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.col("line").contains(m)
    return found.where(~marked)


def at_least(found: DataFrame, least: str) -> DataFrame:
    """Findings of at least that confidence; unset or custom levels stay."""
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    return found.where((rank == 0) | (rank >= CONFIDENCE.index(least) + 1))


def not_ignored(found: DataFrame, ignored: DataFrame, key: bytes | None = None) -> DataFrame:
    """Anti join with a table of fingerprints; Spark broadcasts it if its size allows."""
    named = found.withColumn("fingerprint", text.fingerprint_column(F.col("value"), key))
    return named.join(ignored.select("fingerprint").distinct(), "fingerprint", "left_anti")


def most_specific(found: DataFrame, key: str) -> DataFrame:
    """Findings that no more specific finding of another rule on the same line has the value of.

    One pass and one shuffle by document and line; the findings of a line are few.
    """
    line = F.collect_list(F.struct("rule_id", "specificity", "value")).over(Window.partitionBy(key, "line_no"))
    better = F.exists("others_", lambda o: (o["rule_id"] != F.col("rule_id")) & (o["specificity"] > F.col("specificity")) & o["value"].contains(F.col("value")))
    return found.withColumn("others_", line).where(~better).drop("others_")


def near(found: DataFrame, primary: Column, part: Column, key: str, before: int, after: int, optional: bool = False) -> DataFrame:
    """The findings `primary` with each `part` on the lines [line - before, line + after] of the same document.

    One pass and one shuffle: a range frame holds the parts in reach, and no more. Without any, a finding goes
    unless parts are optional.
    """
    band = Window.partitionBy(key).orderBy("line_no").rangeBetween(-before, after)
    one = F.when(part, F.struct(F.col("line_no").alias("part_line"), F.col("rule_id").alias("part_rule"), F.col("value").alias("part_value")))
    rows = found.where(primary | part).withColumn("parts_", F.collect_list(one).over(band)).where(primary)
    explode = F.explode_outer if optional else F.explode
    return rows.withColumn("part_", explode("parts_")).select("*", "part_.*").drop("part_", "parts_")


def capped_sets(joined: DataFrame, keys: list[str], most: int = 100) -> DataFrame:
    """The first `most` components of each finding, by place, and whether there were more."""
    order = Window.partitionBy(*keys).orderBy("part_line", "part_value")
    rows = joined.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most + 1)
    return rows.groupBy(*keys).agg(F.least(F.count("part_value"), F.lit(most)).alias("n_sets"), (F.count("part_value") > most).alias("truncated"))


def location(found: DataFrame) -> DataFrame:
    """+ start_column and end_column (bytes, from 1, inclusive) of the value in its line."""
    ahead = F.octet_length(F.substring("line", F.lit(1), F.col("ahead").cast("int"))).cast("bigint")
    return found.withColumn("start_column", ahead + 1).withColumn("end_column", ahead + F.octet_length("value"))


def keyword_gate(df: DataFrame, key: str, body: str, rules: dict[str, list[str]]) -> DataFrame:
    """(key, rule_id) for rules of which a keyword occurs (any case). For small rule sets; else the kernel's trie."""
    low = F.lower(F.col(body))

    def any_keyword(words: list[str]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w.lower())
        return found

    each = F.array(*[F.when(any_keyword(words), F.lit(rule)) for rule, words in rules.items()])
    return df.select(key, F.explode(F.array_compact(each)).alias("rule_id"))
