"""The native path on texts that are odd or large."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sieveline.functions import dialect, text
from sieveline.operators import native
from sieveline.operators.native import LineRule
from sieveline.plans import catalog

#: Queries on native.findings that were measured at 1 GB.
MEASURED = [
    "entropy_filter",
    "ignore_anti_join",
    "context_window_cols",
    "rule_filters",
    "component_sets_capped",
    "native_findings",
    "scan_summary",
    "findings_by_rule",
    "global_filter",
    "status_rollup",
    "specificity_precedence",
    "value_fingerprint",
]


def test_no_text_with_a_match_fails_a_gate(spark):
    """Pieces of matches in any order, and the gates of patterns of all kinds."""
    patterns = [r.regex for r in catalog.LINE_RULES] + [r"(?i)k(?:a|b)+c$", r"^abc$", r"(x+)?(y+)z", r"[^a]b", r"a(?:|b)c", r"\bé+ü", r"a*", r"(?i)[^é]K", r"x.{2}(?i:aB)1?c", r"(?:ab)*cd?", r"\p{Lu}x", r"(?:a|b{2}){2}@"]
    rng = random.Random(7)
    pieces = ["token", "ToKeN", " = ", ":", '"', "a1" * 12, "a.b", "@", "x.org", "1.22.3.4", "7" * 16, "0f" * 20, "Licensed under the MIT", "k", "K", "abc", "é", "ü", "x", "x77AB", "abb@", "yz", "b", "B1", "c", "cd", " ", "\n"]
    texts = [("".join(rng.choices(pieces, k=rng.randint(1, 9))),) for _ in range(3000)] + [("abc",), ("",)]
    rows = spark.createDataFrame(texts, "body string")
    for p in patterns:
        java = dialect.java_regex(p)
        hits = rows.select("body", F.exists(F.split("body", "\n"), lambda line: line.rlike(java)).alias("hit"), native.may_match(F.col("body"), p).alias("gate"))
        assert hits.where("hit").count() and not hits.where("hit AND NOT gate").count(), p


def test_gates():
    assert dialect.gate(catalog.LICENSE)[0] == "Licensed under the "
    assert dialect.gate(catalog.EMAIL)[0] == "@" and dialect.gate(catalog.EMAIL)[1].startswith(r"\x{40}[A-Za-z0-9")
    assert dialect.gate(catalog.CARD) == ("", "[0-9]{16}")
    assert dialect.gate(r"\bab+?$") == ("a", "ab{1}") and dialect.gate(r"a*") == dialect.gate(r"\p{Lu}") == ("", "")


def test_a_rule_may_be_bound_to_its_line(spark):
    rows = spark.createDataFrame([(1, "x\nab1\ny"), (2, None), (3, "")], "k long, body string")
    assert [(r.k, r.line_no, r.value) for r in native.findings(rows, "k", "body", [LineRule("r", r"^(ab1)$")]).collect()] == [(1, 2, "ab1")]


@pytest.mark.parametrize("name", MEASURED)
def test_a_long_word_is_read_once(spark, tmp_path, name):
    """A search from each of its letters takes minutes."""
    docs = spark.createDataFrame([(1, "z" * 250_000 + "\n token = " + "a1b2c3d4e5" * 2 + " 12.34.56.78 7777777777777777\n"), (2, "z" * 250_000)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    assert catalog.QUERIES[name](spark, str(tmp_path)).count()
    assert time.monotonic() - began < 30


def test_entropy_of_odd_values(spark):
    values = ["", "a", "ab", "aab", "é1é", "\0\xff", "0123456789abcdef" * 40, None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.entropy(F.col("v")).alias("e"))
    assert {r.v: round(r.e, 9) for r in rows.collect()} == {v: round(text.byte_entropy(v or ""), 9) for v in values}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"hex\(", plan)) == 2, "once for the bytes, once for their number"


def test_ignored_findings_come_from_one_scan(spark, tmp_path):
    """Both sides of the join read findings; neither searches the texts again."""
    value = "a1b2c3d4e5" * 2
    docs = spark.createDataFrame([(3, f"token={value}"), (4, f"token={value}\ntoken={value[::-1]}"), (5, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES["ignore_anti_join"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [(4, "token", value[::-1])]
    assert not any("documents.parquet" in f for f in df.inputFiles())


def test_many_matches_on_one_line_have_their_contexts(spark, tmp_path):
    """A pattern runs over a line twice, for values and whole matches, and not again for each of its matches."""
    n = 300
    line = " ".join(f"user{k % (n - 1)}@example.org" for k in range(n))
    spark.createDataFrame([(1, line)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.QUERIES["context_window_cols"](spark, str(tmp_path))
    at = [m.start() for m in re.finditer("user", line)]
    assert sorted(r.context for r in df.collect()) == sorted(line[max(0, a - 10) : a + len(r) + 10] for a, r in zip(at, line.split()))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2 * len(catalog.LINE_RULES)
