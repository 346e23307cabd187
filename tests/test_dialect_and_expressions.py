import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.functions import dialect, expressions, text
from sieveline.operators.kernel import Options, functions


@pytest.mark.parametrize(
    ("pattern", "value", "found"),
    [
        ("a$", "a", True), ("a$", "a\n", False), (r"\s", "\v", False), (r"\bx\b", "éx", True), ("[a[b]", "[", True), ("[&&a]", "&", True),
        ("(?P<my_name>a)b", "ab", True), ("a(?i)b", "aB", True), ("a(?i)b", "AB", False), (r"\x{41}", "A", True), (r"\Qa.b\E", "a.b", True), (r"\Qa.b\E", "axb", False),
        ("[[:alnum:]]+", "x9", True), ("(?s)a.b", "a\nb", True), ("(?m)^b$", "a\nb\nc", True), (r"x\z", "x", True), ("(?-i:A)", "a", False), (r"[\s\d]", "7", True), ("a|(?i)b", "B", True),
    ],
)
def test_python_means_what_re2_means(pattern, value, found):
    assert (dialect.python_regex(pattern)[0].search(value) is not None) == found
    if "\v" not in value:
        assert duckdb.execute("SELECT regexp_matches(?, ?)", [value, pattern]).fetchone()[0] == found


@settings(max_examples=40, deadline=None)
@given(st.sampled_from([r"(?i)tok[a-z]{1,3}\s*=\s*([a-z0-9]{2,5})", r"\b([0-9]{2,4})\b", r"x[^\n]{0,3}$", "(a|b)+c?"]), st.text("abc x=09tok\n\té", max_size=30))
def test_engines_agree(pattern, value):
    theirs = duckdb.execute("SELECT regexp_extract_all(?, ?)", [value, pattern]).fetchone()[0]
    assert [m.group() for m in dialect.python_regex(pattern)[0].finditer(value)] == theirs


def test_java_agrees(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("éx a\n",), ("X[&",), ("a\v",)], "v string")
    for pattern in (r"\bx\b", "a$", "[a[b&&c]", r"\s$", "(?P<n_m>X)"):
        got = [r[0] for r in rows.select(F.col("v").rlike(dialect.java_regex(pattern))).collect()]
        assert got == [dialect.python_regex(pattern)[0].search(r[0]) is not None for r in rows.collect()]


FINDING = {"finding": expressions.Strings(secret="Abc123xyz", line="key = Abc123xyz"), "attributes": expressions.Strings(path="a/b.py")}


@pytest.mark.parametrize(
    ("source", "value"),
    [
        ('finding.secret contains "123" && !(finding["line"] startsWith "x")', True), ('let s = finding.secret; len(s) > 3 ? s[0:3] : ""', "Abc"), ('attributes["none"] == ""', True),
        ('"a" in ["a", "b"]', True), ('"c" not in ["a"]', True), ("1 + 2 * 3 == 7 and not false", True), ('any(["x", "yy"], {len(#) == 2})', True), ('filter([1, 2, 3], # > 1)', [2, 3]),
        ('matchesAny(finding.secret, ["^Z", `\\d{3}`])', True), ('containsAny(finding.secret, ["ABC"])', True), ('startsWithAny(finding.secret, ["abc"])', False), ('nil ?? "d"', "d"),
        ('findMatch(finding.secret, "[0-9]+")', "123"), ("max(1, 5) - min(2, 3)", 3), ('split("a,b", ",")[1]', "b"), ('crypto.sha256("a") startsWith "ca978112"', True), ('{"k": 1}.k', 1),
    ],
)
def test_evaluate(source, value):
    assert expressions.evaluate(expressions.parse(source), FINDING, functions(Options(), lambda level: None)) == value


def test_errors():
    for bad in ("a +", "foo(1", "'x", "let a 1; a"):
        with pytest.raises(expressions.ExpressionError):
            expressions.parse(bad)
    with pytest.raises(expressions.ExpressionError):
        expressions.evaluate(expressions.parse("nothing(1)"), {}, {})


def test_columns_agree_with_the_interpreter(spark):
    from pyspark.sql import functions as F

    values = ["Abc123xyz", "", "zzz", "path/ÄÖ"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for source in ('matchesAny(finding.secret, [`^Z`, `\\d{3}`]) || finding.secret == ""', 'containsAny(finding.secret, ["ABC", "ä"])', 'let s = finding.secret; len(s) > 3 && !(s endsWith "z")', "entropy(finding.secret) >= 1.5"):
        node = expressions.parse(source)
        got = [r[0] for r in rows.select(expressions.to_column(node, {"finding": {"secret": F.col("v")}.__getitem__})).collect()]
        assert got == [expressions.evaluate(node, {"finding": {"secret": v}}, functions(Options(), lambda level: None)) for v in values]


def test_scalars(spark):
    from pyspark.sql import functions as F

    assert text.byte_entropy("aabb") == 1.0 and text.byte_entropy("") == 0.0
    assert text.mask("abcdefgh", 75) == "ab..." and text.mask("abc", 100) == "REDACTED"
    assert text.redact_url("https://u:p@h.x/a?b=1#c") == "https://h.x/a"
    row = spark.createDataFrame([("secret",)], "v string").select(text.fingerprint_column(F.col("v"), b"k"), text.fingerprint_column(F.col("v")), text.mask_column(F.col("v"), 50)).first()
    assert tuple(row) == (text.fingerprint("secret", b"k"), text.fingerprint("secret"), text.mask("secret", 50))
    assert text.load_ignore("# c\n" + "a" * 64 + "\nbad\n" + "a" * 64) == (["a" * 64], [(3, "bad")])
    assert text.scm_link("github", "https://g/x", "abc", "d/e f.md", 3, 5) == "https://g/x/blob/abc/d/e%20f.md?plain=1#L3-L5"
    assert text.TokenCounter().ratio("abc") == 0.0 and not text.TokenCounter().fails_efficiency("password")
