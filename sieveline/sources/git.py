"""Git patches and repositories as fragments: the added lines of each hunk, with the commit's attributes."""

from __future__ import annotations

import re
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FRAGMENT

_HUNK = re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
_COMMIT = re.compile(r"commit ([0-9a-f]{7,64})")
_ZERO = re.compile(r"0+\Z")


def _unquote(path: str) -> str:
    if path.startswith('"'):
        return path[1:-1].encode().decode("unicode_escape").encode("latin-1").decode("utf-8", "replace")
    return path


def parse_patch(patch: str):
    """(attributes, start line, added text) of each hunk of `git log -p` output; deleted files are left out."""
    commit: dict[str, str] = {}
    path, message, lines, start, at = "", [], [], 0, 0
    old_left = new_left = 0

    def flush():
        if lines and path:
            head = commit | {"git.message": "\n".join(message).strip()} if commit else {}
            return dict(head) | {"path": path, "resource": "git.patch"}, start, "".join(lines)
        return None

    for raw in patch.split("\n"):
        if old_left > 0 or new_left > 0:
            sign = raw[:1]
            if sign == "+":
                lines.append(raw[1:] + "\n")
                new_left -= 1
                continue
            if sign == "-":
                old_left -= 1
                continue
            if sign in (" ", ""):
                old_left, new_left = old_left - 1, new_left - 1
                continue
            if sign == "\\":
                continue
        if raw.startswith("\\ No newline") and lines:
            lines[-1] = lines[-1].removesuffix("\n")
            continue
        hunk = _HUNK.match(raw)
        if hunk:
            found = flush()
            if found:
                yield found
            start, lines = int(hunk[1]), []
            sizes = re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@", raw)
            old_left, new_left = (int(x) if x else 1 for x in sizes.groups())
        elif raw.startswith("@@@"):
            raise ValueError("combined diffs are not supported")
        elif raw.startswith("diff --git ") or _COMMIT.match(raw):
            found = flush()
            if found:
                yield found
            lines = []
            if raw.startswith("diff"):
                path = ""
            else:
                commit, message, path = {"git.sha": _COMMIT.match(raw)[1]}, [], ""
        elif raw.startswith("+++ "):
            name = _unquote(raw[4:].split("\t")[0])
            path = "" if name == "/dev/null" else name.removeprefix("b/")
        elif raw.startswith("Author:") and commit:
            m = re.match(r"Author:\s*(.*?)\s*<([^>]*)>", raw)
            if m:
                commit |= {"git.author_name": m[1], "git.author_email": m[2]}
        elif raw.startswith("Date:") and commit:
            commit["git.date"] = raw[5:].strip()
        elif raw.startswith("    ") and commit and not path:
            message.append(raw[4:])
    found = flush()
    if found:
        yield found


def patches_to_fragments(df: DataFrame, key: str, patch: str) -> DataFrame:
    """Rows that hold patch text as fragments."""
    schema = pa.schema([("fragment_id", pa.string()), ("raw", pa.string()), ("start_line", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string()))])

    def run(batches):
        for batch in batches:
            rows = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for attributes, line, added in parse_patch(body or ""):
                    rows.append({"fragment_id": f"{name}:{attributes['path']}:{line}", "raw": added, "start_line": line, "attributes": list(attributes.items())})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.select(F.col(key).cast("string"), patch).mapInArrow(run, FRAGMENT)


def _git(repository: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", repository, *arguments], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def history(spark: SparkSession, repository: str, revisions: tuple[str, ...] = ("--all",), chunks: int = 4) -> DataFrame:
    """The history of a repository that every executor can read: commits in chunks, one `git show` process each."""
    commits = _git(repository, "rev-list", *revisions).split()
    parts = [commits[k::chunks] for k in range(chunks) if commits[k::chunks]]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(parts)] or [(0, [])], "part int, commits array<string>").repartition(max(1, len(parts)))

    def run(batches):
        for batch in batches:
            for names in batch.column(1).to_pylist():
                text = _git(repository, "show", "--patch", "--unified=0", "--no-color", "--diff-filter=d", *names) if names else ""
                yield pa.RecordBatch.from_pydict({"key": [repository], "patch": [text]})

    return patches_to_fragments(rows.mapInArrow(run, "key string, patch string"), "key", "patch")


def staged(spark: SparkSession, repository: str) -> DataFrame:
    """What is added to the index."""
    return patches_to_fragments(spark.createDataFrame([(repository, _git(repository, "diff", "--cached", "--unified=0", "--no-color"))], "key string, patch string"), "key", "patch")


def working_tree(spark: SparkSession, repository: str) -> DataFrame:
    """What is added to tracked files and not in the index."""
    return patches_to_fragments(spark.createDataFrame([(repository, _git(repository, "diff", "--unified=0", "--no-color"))], "key string, patch string"), "key", "patch")


def messages(spark: SparkSession, repository: str) -> DataFrame:
    """Commit messages, annotated tags and reflog entries as fragments."""
    rows = []
    for block in _git(repository, "log", "--all", "--format=%H%x00%an%x00%ae%x00%B%x01").split("\x01"):
        if block.strip():
            sha, name, mail, body = block.strip("\n").split("\0", 3)
            rows.append((f"commit:{sha}", body, 1, {"resource": "git.commit_message", "git.sha": sha, "git.author_name": name, "git.author_email": mail}))
    for block in _git(repository, "for-each-ref", "refs/tags", "--format=%(objecttype)%00%(refname:short)%00%(contents)%01").split("\x01"):
        kind, _, rest = block.strip("\n").partition("\0")
        if kind == "tag":
            name, _, body = rest.partition("\0")
            rows.append((f"tag:{name}", body, 1, {"resource": "git.tag_message", "git.tag": name}))
    for k, line in enumerate(_git(repository, "reflog", "--all", "--format=%H%x00%gs").splitlines()):
        sha, _, body = line.partition("\0")
        rows.append((f"reflog:{k}", body, 1, {"resource": "git.reflog", "git.sha": sha}))
    return spark.createDataFrame(rows, FRAGMENT)


def pre_receive_revisions(text: str) -> list[str]:
    """Revision arguments for lines `old new ref` of a pre-receive hook; deletions are left out."""
    ranges, created = [], []
    for line in text.splitlines():
        if not line.strip():
            continue
        parts = line.split()
        if len(parts) != 3:
            raise ValueError(f"not `old new ref`: {line!r}")
        old, new, _ = parts
        if _ZERO.match(new):
            continue
        if _ZERO.match(old):
            created.append(new)
        else:
            ranges.append(f"{old}..{new}")
    return ranges + ([*created, "--not", "--all"] if created else [])
