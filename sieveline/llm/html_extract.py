"""Main text of web pages by a site style tree (operator 9).

Pages of one host are merged: nodes of their DOMs with the same path of tags, ids and classes are one element
node of the site's tree; the sequences of children met below it are its style nodes; the texts met in it are
its content features. Importance, from counts over all pages of the host (m: pages that have the node):
  presentation   -sum p log_m p over its style nodes (1 if m is 1)
  content        1 - the mean of log_m (pages that share a text), weighted by pages
  composite      (1 - g^l) * presentation + g^l * the mean over its children, g = 0.9, l style nodes;
                 for a node without children, its content importance
A node seen on m distinct pages is judged by (m * importance + PRIOR) / (m + PRIOR), as few pages say little, and
branches at or below THRESHOLD are removed from each page, inside marked content too; inline elements go with their block. What HTML itself says is a
prior that needs no statistics: nav, aside, footer, form, script and the like, and ids or classes all of whose words
name menus, adverts, notices, comments and so on (`share-buttons`, but not `share-price`), have no importance. A page's
main content is what it marks as such (article, main, role=main), else what is left of the whole page. Pages of a host
whose text by marks alone is the same count once: copies of an article are no template. Where the tree would leave
nothing of the content, it stays.

What a page has is packed and goes once to its (host, text). Counts are then summed per (host, path, feature) before and after one shuffle, so a host with a third of all pages
is no single task; what is gathered per host is its distinct paths. Both passes read pages where they lie.

Results for edge cases: null and empty html give the empty text; markup that is not closed or nested wrongly
is closed as browsers do (roughly); a null url is a host of its own without name; repeated rows give equal
values; columns besides page_id, url and html are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, stage, table

PRIOR, THRESHOLD, DECAY = 2.0, 0.3, 0.9
DEEP = 512  # how far up an end tag is matched, as browsers limit nesting
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
NOISE_TAGS = frozenset("head script style noscript iframe template svg canvas object embed nav aside footer form button select textarea input dialog menu noembed noframes title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img picture".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt tr td th tbody thead tfoot body".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("ul ol dl table select article section main div body nav aside footer".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices notification alert menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments disqus respond replies share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager skip search copyright disclaimer".split()
)
#: Words that say nothing by themselves; beside a word of NOISE_WORDS they leave its meaning.
NEUTRAL_WORDS = frozenset("area bar block bottom box button buttons container footer global group header icon icons inner item items left link links list main media outer page panel primary right row secondary section site slot top unit widget wrap wrapper zone".split())
_TAG = re.compile(r"/?[a-zA-Z][^\s/>]*")
_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Page:
    """A DOM in arrays: tags, names, parents, and the stream of texts (node, text) and breaks (node, None)."""

    def __init__(self, source: str):
        self.tags, self.names, self.words, self.parents, self.main = ["#root"], [""], [frozenset()], [-1], [False]
        self.stream: list[tuple[int, str | None]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        """One pass, linear in the source and its nesting is kept by counts, so stray end tags cost nothing."""
        stack, at, n = [0], 0, len(source)
        self.depth = Counter()  # how many of each tag are open
        last = {q: source.rfind(q) for q in "\"'>"}
        stream = self.stream
        while at < n:
            start = source.find("<", at)
            if start < 0 or last[">"] < start and not source.startswith("<!--", start):
                stream.append((stack[-1], source[at:]))
                return
            if start > at:
                stream.append((stack[-1], source[at:start]))
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                at = n if end < 0 else end + 3
                continue
            name = _TAG.match(source, start + 1)
            if name is None:
                if source[start + 1 : start + 2] in ("!", "?"):
                    at = source.find(">", start) + 1
                else:
                    stream.append((stack[-1], "<"))
                    at = start + 1
                continue
            stop = self._tag_end(source, name.end(), last)
            tag, attributes, at = name[0].lower(), source[name.end() : stop], stop + 1
            if tag[0] == "/":
                self._close(stack, tag[1:])
                continue
            if tag in CLOSES_P and self.depth["p"]:
                self._end(stack, {"p"}, SCOPE)
            if tag in ENDS and any(self.depth[x] for x in ENDS[tag]):
                self._end(stack, ENDS[tag], SCOPE - {"div", "section", "article"} if tag == "li" else {"table", "dl", "select"})
            node = self._open(tag, attributes, stack[-1])
            if tag not in INLINE:
                stream.append((stack[-1], None))
            if tag in VOID or attributes.endswith("/") and tag not in RAW:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at) if self._ends(source, tag, at) else None
                stream.append((node, source[at : end.start() if end else n]))
                at = end.end() if end else n
                continue
            stack.append(node)
            self.depth[tag] += 1

    def _tag_end(self, source: str, at: int, last: dict[str, int]) -> int:
        """Where the tag's `>` stands; one in quotes doesn't count if the quote is closed before the source ends."""
        first = source.find(">", at)
        while True:
            sign = _END.search(source, at)
            if sign is None:
                return first
            if sign[0] == ">":
                return sign.start()
            if last[sign[0]] <= sign.start():
                return first  # the quote is never closed
            at = source.find(sign[0], sign.end()) + 1
            if at > last[">"]:
                return first

    def _ends(self, source: str, tag: str, at: int) -> bool:
        """Whether an end tag of a raw element may follow; where it can't is noted, so that it is looked for once."""
        known = self.__dict__.setdefault("raw", {})
        if tag not in known:
            known[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", source, re.I)), default=-1)
        return known[tag] >= at

    def _close(self, stack: list[int], tag: str) -> None:
        if not self.depth[tag]:
            if tag == "p":
                self.stream.append((stack[-1], None))
            return
        for k in range(len(stack) - 1, 0, -1):
            if len(stack) - k > DEEP:
                return
            if self.tags[stack[k]] == tag:
                if tag not in INLINE:
                    self.stream.append((stack[k], None))
                self._pop(stack, k)
                return
            if tag in INLINE and self.tags[stack[k]] not in INLINE:
                return  # an inline end tag doesn't end blocks

    def _pop(self, stack: list[int], k: int) -> None:
        for node in stack[k:]:
            self.depth[self.tags[node]] -= 1
        del stack[k:]

    def _end(self, stack: list[int], which: set[str], scope) -> None:
        """Close the innermost of `which` that is open inside the scope."""
        for k in range(len(stack) - 1, max(0, len(stack) - DEEP), -1):
            tag = self.tags[stack[k]]
            if tag in which:
                self.stream.append((stack[k], None))
                self._pop(stack, k)
                return
            if tag in scope:
                return

    def _open(self, tag: str, attributes: str, parent: int) -> int:
        named = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        marks = f"{named.get('id', '')} {named.get('class', '')}".strip()
        words, named_noise = frozenset(), frozenset()
        for mark in marks.split():
            of = frozenset(w.lower() for w in _WORDS.findall(mark))
            words |= of
            if of & NOISE_WORDS and not of - NOISE_WORDS - NEUTRAL_WORDS - {w for w in of if w.isdigit()}:
                named_noise |= of & NOISE_WORDS
        role = named.get("role", "").lower()
        if role in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"):
            words |= {"nav"}
            named_noise |= {"nav"}
        if "hidden" in named or "display:none" in named.get("style", "").replace(" ", "").lower():
            words |= {"popup"}
            named_noise |= {"popup"}
        self.tags.append(tag)
        self.names.append(f"{tag}.{'.'.join(sorted(words - {str(x) for x in words if x.isdigit()}))}" if words else tag)
        self.words.append(named_noise)
        self.parents.append(parent)
        self.main.append((tag in ("article", "main") or role == "main") and not named_noise)
        return len(self.tags) - 1

    def paths(self) -> list[int]:
        """A 64-bit name of each node's path."""
        out = [0]
        for name, parent in zip(self.names[1:], self.parents[1:]):
            out.append(xxhash.xxh64_intdigest(name, out[parent] & 0xFFFFFFFF ^ out[parent] >> 32 & 0xFFFFFFFF))
        return [x - (1 << 64) if x >> 63 else x for x in out]

    def noise(self, low: frozenset[int] = frozenset(), named: bool = True) -> list[bool]:
        """Which nodes stand in a branch that is removed. low: paths of low importance at this host. named: whether names of ids and classes count."""
        n = len(self.tags)
        holds, inside = [False] * n, [False] * n
        for k in range(n - 1, 0, -1):
            if self.main[k] or holds[k]:
                holds[self.parents[k]] = True
        paths = self.paths() if low else None
        out = [False] * n
        for k in range(1, n):
            p, tag = self.parents[k], self.tags[k]
            inside[k] = inside[p] or self.main[k]
            marked = tag in NOISE_TAGS or tag == "header" and not inside[k] or named and bool(self.words[k])
            judged = paths is not None and tag not in INLINE and paths[k] in low  # a word of a sentence is no branch
            out[k] = out[p] or tag not in ("html", "body") and not holds[k] and not self.main[k] and (marked or judged)
        return out

    def text(self, low: frozenset[int] = frozenset()) -> str:
        """The main text."""
        noise = self.noise(low)
        found = self._marked(noise) or low and self._marked(self.noise()) or self._blocks([not x for x in noise])
        # names of classes alone never empty a page
        return found or low and self._blocks([not x for x in self.noise()]) or self._blocks([not x for x in self.noise(named=False)])

    def _marked(self, noise: list[bool]) -> str:
        inside = [False] * len(self.tags)
        for k in range(1, len(self.tags)):
            inside[k] = not noise[k] and (self.main[k] or inside[self.parents[k]])
        return self._blocks(inside)

    def _blocks(self, use: list[bool]) -> str:
        blocks, held = [], []
        for node, text in self.stream:
            if text is None:
                if held:
                    blocks.append("".join(held))
                    held = []
            elif use[node]:
                held.append(text)
        blocks.append("".join(held))
        return " ".join(" ".join(entities.unescape(b) if "&" in b else b for b in blocks).split())

    def features(self) -> set[tuple[int, int, int, int]]:
        """(path, path of the parent, kind, feature): kind 0 a style node, 1 a text, 2 the node itself."""
        paths, below, texts = self.paths(), [[] for _ in self.tags], {}
        for k in range(1, len(self.tags)):
            siblings = below[self.parents[k]]
            if not siblings or siblings[-1] != self.names[k]:  # a run of equal children counts once
                siblings.append(self.names[k])
        for node, text in self.stream:
            if text and not text.isspace():
                texts.setdefault(node, []).append(text)
        out = set()
        for k in range(1, len(self.tags)):
            parent = paths[self.parents[k]]
            out.add((paths[k], parent, 2, 0))
            if below[k]:
                out.add((paths[k], parent, 0, _digest("\0".join(below[k]))))
            if k in texts:
                out.add((paths[k], parent, 1, _digest(" ".join("".join(texts[k]).split()))))
        return out


def _digest(text: str) -> int:
    x = xxhash.xxh64_intdigest(text)
    return x - (1 << 64) if x >> 63 else x


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def tree_counts(pages: DataFrame) -> DataFrame:
    """(host, path, parent, kind, feature, n): distinct texts of the host whose page has the feature."""

    def pack(batch):
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(source or "")
            features = np.array(sorted(page.features()), "<i8").reshape(-1, 4)
            yield host, _digest(page.text()), features.T.tobytes()

    def packed(batch):
        rows = list(pack(batch))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], names=["host", "content", "features"])

    def run(batches):
        for batch in batches:
            total: Counter = Counter()
            for host, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.update((host, *f) for f in np.frombuffer(features, "<i8").reshape(4, -1).T.tolist())
            if total:
                columns = list(zip(*total))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(list(total.values()), pa.int64())], names=["host", "path", "parent", "kind", "feature", "n"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(arrow_map(packed), "host string, content bigint, features binary")
    once = rows.groupBy("host", "content").agg(F.max("features").alias("features")).select("host", "features")
    counts = once.mapInArrow(run, "host string, path bigint, parent bigint, kind tinyint, feature bigint, n bigint")
    return counts.groupBy("host", "path", "parent", "kind", "feature").agg(F.sum("n").alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """(host, path, parent, pages, styles, presentation, content) of each element node."""
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))
    n = F.col("n").cast("double")
    sums = counts.groupBy("host", "path", "parent").agg(
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("pages"),
        F.count(F.when(F.col("kind") == 0, 1)).alias("styles"),
        of(0, n).alias("n0"),
        of(0, n * F.log(n)).alias("s0"),
        of(1, n).alias("n1"),
        of(1, n * F.log(n)).alias("s1"),
    )
    base = F.log(F.col("pages").cast("double"))
    presentation = F.when((F.col("pages") > 1) & (F.col("n0") > 0), F.least(F.lit(1.0), (F.log("n0") - F.col("s0") / F.col("n0")) / base)).otherwise(1.0)
    content = F.when((F.col("pages") > 1) & (F.col("n1") > 0), F.greatest(F.lit(0.0), 1 - F.col("s1") / F.col("n1") / base)).otherwise(F.when(F.col("n1") > 0, 1.0))
    return sums.select("host", "path", "parent", "pages", "styles", presentation.alias("presentation"), content.alias("content"))


def composite(nodes: pd.DataFrame) -> dict[int, float]:
    """Composite importance of each path of one host."""
    children: dict[int, list[int]] = {}
    rows = {r.path: r for r in nodes.itertuples()}
    for r in rows.values():
        children.setdefault(r.parent, []).append(r.path)
    out: dict[int, float] = {}
    todo = [p for p, r in rows.items() if r.parent not in rows]
    while todo:
        path = todo[-1]
        missing = [c for c in children.get(path, ()) if c not in out and c != path]
        if missing:
            todo += missing
            continue
        todo.pop()
        r, below = rows[path], [(out[c], rows[c].pages) for c in children.get(path, ()) if c in out]
        content = None if r.content is None or math.isnan(r.content) else r.content
        if content is not None:
            below.append((content, r.pages))
        mean = sum(v * w for v, w in below) / sum(w for _, w in below) if below else 1.0
        keep = DECAY ** max(1, r.styles)
        out[path] = (1 - keep) * r.presentation + keep * mean if children.get(path) else mean
    return out


def low_paths(pages: DataFrame, prior: float = PRIOR, threshold: float = THRESHOLD) -> DataFrame:
    """(host, low): the paths of low importance of each host that has some."""

    def judge(nodes: pd.DataFrame) -> pd.DataFrame:
        of = composite(nodes)
        low = [r.path for r in nodes.itertuples() if (r.pages * of[r.path] + prior) / (r.pages + prior) <= threshold]
        return pd.DataFrame({"host": pd.Series([nodes.host.iloc[0]] if low else [], dtype=object), "low": pd.Series([low] if low else [], dtype=object)})

    return importance(tree_counts(pages)).groupBy("host").applyInPandas(judge, "host string, low array<bigint>")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    rules = stage(low_paths(pages), "style-tree").withColumnRenamed("host", "h")

    def kernel(batch):
        texts = [Page(source or "").text(frozenset(low or ())) for source, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html").join(rules, host_of(F.col("url")) == F.col("h"), "left").select("page_id", "url", "html", "low")
    return rows.mapInArrow(arrow_map(kernel), "page_id bigint, url string, text string, n_chars bigint")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all of `pages`."""
    return main_text(table(spark, sf_dir, "pages"))
