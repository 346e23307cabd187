"""Targets that need a network: recognised and described here; a fetcher must be injected to read them."""

from __future__ import annotations

import hashlib
import hmac
import io
import json
import re
import tarfile
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import redact_url
from ..schema import FRAGMENT

#: What each provider can list, and the resource each kind gets.
KINDS = {
    "github": ("repos", "forks", "prs", "pr-comments", "issues", "issue-comments", "actions", "action-artifacts", "discussions", "releases", "release-assets", "gists"),
    "gitlab": ("repos", "forks", "mrs", "mr-comments", "issues", "issue-comments", "snippets", "releases", "release-assets", "ci-jobs", "ci-artifacts"),
    "huggingface": ("repos", "discussions", "prs", "buckets"),
}
_HOSTS = {"github.com": "github", "gitlab.com": "gitlab", "huggingface.co": "huggingface", "hf.co": "huggingface"}


def detect_source(target: str) -> tuple[str, dict[str, str]]:
    """(kind of source, what the target names). Local paths first, then providers, object stores, git, plain URLs."""
    if Path(target).exists():
        return ("git" if (Path(target) / ".git").exists() else "filesystem"), {"path": target}
    parts = urlsplit(target)
    if parts.scheme in ("s3", "s3a"):
        return "s3", {"bucket": parts.netloc, "prefix": parts.path.lstrip("/")}
    if parts.scheme in ("docker", "oci"):
        return "container", {"image": parts.netloc + parts.path}
    provider = _HOSTS.get((parts.hostname or "").removeprefix("www."))
    if provider:
        return provider, {"owner": parts.path.strip("/").partition("/")[0], "repo": parts.path.strip("/"), "kind": _kind(provider, parts.path)}
    if target.endswith(".git") or parts.scheme in ("git", "ssh"):
        return "git", {"url": redact_url(target)}
    if parts.scheme in ("http", "https"):
        return "url", {"url": redact_url(target)}
    raise ValueError(f"nothing is known about {target!r}")


def _kind(provider: str, path: str) -> str:
    found = {"pull": "prs", "pulls": "prs", "merge_requests": "mrs", "issues": "issues", "releases": "releases", "discussions": "discussions", "snippets": "snippets", "actions": "actions"}
    return next((found[p] for p in path.strip("/").split("/")[2:] if p in found), "repos")


Fetcher = Callable[[str, str, str], list[dict]]


def provider_fragments(spark: SparkSession, provider: str, target: str, kinds: tuple[str, ...], fetch: Fetcher) -> DataFrame:
    """Resources of a provider. fetch(provider, target, kind) lists {id, text, attributes}; one task for each kind."""
    unknown = set(kinds) - set(KINDS[provider])
    if unknown:
        raise ValueError(f"{provider} has no {sorted(unknown)[0]}")
    schema = pa.schema([("fragment_id", pa.string()), ("raw", pa.string()), ("start_line", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string()))])

    def run(batches):
        for batch in batches:
            for kind in batch.column(0).to_pylist():
                rows = [{"fragment_id": f"{provider}:{x['id']}", "raw": x["text"], "start_line": 1, "attributes": list(({"resource": f"{provider}.{kind}"} | x.get("attributes", {})).items())} for x in fetch(provider, target, kind)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.createDataFrame([(k,) for k in kinds], "kind string").repartition(max(1, len(kinds))).mapInArrow(run, FRAGMENT)


def no_network(provider: str, target: str, kind: str) -> list[dict]:
    """The fetcher where there is no network."""
    raise ConnectionError(f"{provider} {kind}: no client was given")


# ---- container images ----------------------------------------------------------------------------------


def image_entries(data: bytes):
    """(layer, path, change, content) of a docker-save archive: change is add, delete or opaque."""
    with tarfile.open(fileobj=io.BytesIO(data)) as image:
        manifest = json.load(image.extractfile("manifest.json"))
        for k, name in enumerate(manifest[0]["Layers"]):
            with tarfile.open(fileobj=io.BytesIO(image.extractfile(name).read())) as layer:
                for m in layer:
                    folder, _, base = m.name.removeprefix("./").rpartition("/")
                    prefix = f"{folder}/" if folder else ""
                    if base == ".wh..wh..opq":
                        yield k, prefix, "opaque", b""
                    elif base.startswith(".wh."):
                        yield k, prefix + base[4:], "delete", b""
                    elif m.isfile():
                        yield k, prefix + base, "add", layer.extractfile(m).read()


def image_fragments(images: DataFrame) -> DataFrame:
    """(image, content) rows as fragments of every layer; path_state: visible, overwritten or deleted by the next layer that changes the path."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(zip(*((name, *e) for e in image_entries(content))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1], pa.int32()), pa.array(rows[2]), pa.array(rows[3]), pa.array(rows[4], pa.binary())], names=["image", "layer", "path", "change", "content"])

    entries = images.select("image", "content").mapInArrow(run, "image string, layer int, path string, change string, content binary")
    later = Window.partitionBy("image", "path").orderBy("layer").rowsBetween(1, Window.unboundedFollowing)
    state = F.first("change").over(later)
    marked = entries.withColumn("state", F.when(state.isNull(), "visible").when(state == "add", "overwritten").otherwise("deleted"))
    files = marked.where("change = 'add'")
    path = F.concat("image", F.lit("!"), "path")
    attributes = F.create_map(F.lit("path"), path, F.lit("resource"), F.lit("container.file"), F.lit("container.path_state"), "state", F.lit("container.layer"), F.col("layer").cast("string"))
    return files.select(F.concat(path, F.lit("#"), F.col("layer").cast("string")).alias("fragment_id"), F.decode("content", "UTF-8").alias("raw"), F.lit(1).alias("start_line"), attributes.alias("attributes"))


# ---- request signing -----------------------------------------------------------------------------------


def sign_v4(method: str, url: str, headers: dict[str, str], body: bytes, access: str, secret: str, region: str, service: str, now: datetime | None = None) -> dict[str, str]:
    """Headers with an AWS version 4 signature."""
    now = now or datetime.now(UTC)
    stamp, day = now.strftime("%Y%m%dT%H%M%SZ"), now.strftime("%Y%m%d")
    parts = urlsplit(url)
    all_headers = {k.lower(): " ".join(v.split()) for k, v in headers.items()} | {"host": parts.netloc, "x-amz-date": stamp}
    names = ";".join(sorted(all_headers))
    query = "&".join(sorted("=".join(quote(x, safe="-_.~%") for x in (q.partition("=")[::2])) for q in parts.query.split("&") if q))
    request = "\n".join([method, quote(parts.path or "/", safe="/-_.~%"), query, *(f"{k}:{all_headers[k]}" for k in sorted(all_headers)), "", names, hashlib.sha256(body).hexdigest()])
    scope = f"{day}/{region}/{service}/aws4_request"
    text = "\n".join(["AWS4-HMAC-SHA256", stamp, scope, hashlib.sha256(request.encode()).hexdigest()])
    key = f"AWS4{secret}".encode()
    for part in (day, region, service, "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    signature = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    return headers | {"X-Amz-Date": stamp, "Authorization": f"AWS4-HMAC-SHA256 Credential={access}/{scope}, SignedHeaders={names}, Signature={signature}"}


