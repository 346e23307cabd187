import base64
import gzip
import hashlib
from collections import Counter

import duckdb
import pytest

from sieveline.llm import chat, html_extract, queries, warc

from . import helpers

ROWS = [
    (1, "http://www.Example.com:80/b?x=1", "<p>one</p>"),
    (5, "https://example.com/a", "<p>one</p>"),
    (3, None, None),
    (4, "http://x.org", ""),
    (4, "http://x.org", ""),
    (None, "http://x.org/\r\nWARC-Type: fake", "<p>null id</p>"),
    (6, "not a url", "é\r\n\r\nWARC/1.1\r\n" * 50_000),
]


def test_op1(spark, tmp_path):
    helpers.pages(spark, str(tmp_path), ROWS)
    first = {}
    for page_id, _, html in ROWS:
        body = (html or "").encode()
        if page_id is not None:
            first[body] = min(first.get(body, page_id), page_id)
    want = Counter()
    for page_id, _, html in ROWS:
        body = (html or "").encode()
        keep = first.get(body, page_id)
        want[page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if keep == page_id else "revisit", None if keep == page_id else keep] += 1
    got = queries.QUERIES["op1_warc"](spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in got) == want


def test_op1_index(spark, tmp_path):
    rows = [(k, f"http://h{k % 7}.example.com/{k // 2}", f"<p>{k % 50}</p>") for k in range(3000)]
    helpers.pages(spark, str(tmp_path), rows)
    path = str(tmp_path / "out")
    warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), path)
    warc.write_index(spark, path)
    wanted = [rows[k][1] for k in (0, 1234, 2999)] + ["http://nowhere.example.org/", "http://zzz.zzz/", None]
    urls = spark.createDataFrame([(u, 1) for u in wanted * 2], "url string, key int")
    for size in (1, 2, 1000):  # entries of the directory that go to tasks at a time
        found = warc.lookup(spark, path, urls, payloads=True, size=size).collect()
        assert Counter(r.page_id for r in found) == Counter(k for k, u, _ in rows if u in wanted)
        assert all(bytes(r.payload).decode() == rows[r.page_id][2] if r.record_type == "response" else rows[r.refers_to][2] == rows[r.page_id][2] for r in found)
    assert spark.read.parquet(f"{path}/index").count() >= 3
    # the index says of each record what a full pass over the archives finds
    place = ("page_id", "url", "record_type", "archive", "segment", "offset", "length")
    assert sorted(map(tuple, warc.lookup(spark, path, spark.read.parquet(f"{tmp_path}/pages.parquet")).select(*place).collect())) == sorted(map(tuple, warc.records(spark, path).select(*place).collect()))


def test_op1_one_key_over_several_blocks(spark, tmp_path):
    rows = [(k, "http://same.example.com/" if k % 3 else f"http://h{k}.example.com/", "<p>one</p>") for k in range(4000)]
    helpers.pages(spark, str(tmp_path), rows)
    assert sorted(r.page_id for r in queries.QUERIES["op1_warc"](spark, str(tmp_path)).select("page_id").collect()) == list(range(4000))


def test_op1_members_and_keys():
    data = [warc.record(k, "http://a/b", b"x" * k * 1000, None, True) for k in range(40)]
    assert [(o, n) for o, n, _ in warc.members(b"".join(data))] == [(sum(map(len, data[:k])), len(d)) for k, d in enumerate(data)]
    assert gzip.decompress(b"".join(data)).count(b"WARC/1.1") == 40
    with pytest.raises(ValueError):
        list(warc.members(data[0][:-5]))
    assert warc.url_key("https://www.B.example.com:8080/x?q#f") == "com,example,b:8080)/x?q" and warc.url_key(None) == ""


@pytest.mark.parametrize("name", ["op1_warc", "op9_html_main_text"])
def test_empty_pages(spark, tmp_path, name):
    helpers.pages(spark, str(tmp_path), [])
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


ARTICLE = "<html><head><title>t</title><script>x='</p>'</script></head><body><nav><a>menu</a></nav><article><h1>Head</h1><p>One &amp; <b>t</b>wo<p>three<div class='ad-box'>buy</div><section id=comments><p>nice</p></section></article><footer>foot</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (ARTICLE, "Head One & two three"),
        ("", ""),
        ("plain &lt;text&gt;\n\n more", "plain <text> more"),
        ("<p>a<p>b<br>c<ul><li>d<li>e</ul>", "a b c d e"),
        ("<body><header>top</header><div>x<!-- <p>no</p> --></div><form>f<input></form>", "x"),
        ("<main><header><h1>Title</h1></header>body</main><aside>side</aside>", "Title body"),
        ("<div hidden>no</div><p style='display: none'>no</p><p>yes", "yes"),
        ("<a href='x>y'>link</a> &eacute;&#233;&#xE9; &nbsp; end", "link ééé end"),
        ("<script>never closed <p>a", ""),
        ("<div class=sidebar><article>inside</article></div>", "inside"),
        ("<" * 1000 + "p", "<" * 1000 + "p"),
        ("<article><p>a</p><div class='share-price'><p>The share price rose.</p></div><section class='search-results'>b</section></article>", "a The share price rose. b"),
        ("<div class='social-science'>c</div><div class='social share-buttons'>no</div>", "c"),
        ("<div id='comments'>All there is</div>", "All there is"),
        ("<p>a</i></b> b</p></p>c", "a b c"),
        ("x <a 'y> b", "x b"),
        ("1 < 2 <3 <p title='a>b'>c</p>", "1 < 2 <3 c"),
    ],
)
def test_main_text(html, text):
    assert html_extract.Page(html).text() == text


def test_style_tree_removes_what_all_pages_share(spark, tmp_path):
    page = lambda k: f"<body><div class='top'><span>Same words</span></div><div class='story'><p>Story {k} is its own.</p><p>More of {k * 7}.</p></div><div class='end'><i>Always</i></div></body>"
    rows = [(k, f"http://site.example/{k}", page(k)) for k in range(30)] + [(100, "http://single.example/", page(1)), (101, None, None), (None, "x", "<p>y")]
    helpers.pages(spark, str(tmp_path), rows)
    got = {r.page_id: r for r in queries.QUERIES["op9_html_main_text"](spark, str(tmp_path)).collect()}
    assert all(got[k].text == f"Story {k} is its own. More of {k * 7}." and got[k].n_chars == len(got[k].text) for k in range(30))
    assert got[100].text == "Same words Story 1 is its own. More of 7. Always"  # one page tells nothing about its site
    assert got[101].text == "" and got[None].text == "y"


@pytest.mark.parametrize("html", ["<a \"x " * 150_000, "<b>" * 200_000 + "</p>" * 200_000, "<p" * 400_000, "<script>" * 100_000, "<!--" * 200_000, "<div>" * 150_000 + "</span>" * 150_000, "<li>" * 200_000, "<a b='" * 150_000 + ">", "<![" * 300_000])
def test_hostile_pages_take_linear_time(html):
    import time

    began = time.process_time()
    html_extract.Page(html)
    assert time.process_time() - began < 12


def importances(pages):
    """Composite importance of each path by the formulas, from plain counts of distinct pages."""
    import math

    parsed = {p.text(): p for p in map(html_extract.Page, pages)}.values()
    nodes, kids, styles, texts = Counter(), {}, {}, {}
    for p in parsed:
        for path, parent, kind, feature in p.features():
            if kind == 2:
                nodes[path] += 1
                kids.setdefault(parent, set()).add(path)
            else:
                (styles, texts)[kind].setdefault(path, Counter())[feature] += 1

    def value(path):
        m = nodes[path]
        below = [(value(c), nodes[c]) for c in kids.get(path, ())]
        if path in texts:
            t, n = texts[path], sum(texts[path].values())
            below.append((max(0.0, 1 - sum(k * math.log(k) / math.log(m) for k in t.values()) / n) if m > 1 else 1.0, m))
        mean = sum(v * w for v, w in below) / sum(w for _, w in below) if below else 1.0
        if path not in kids:
            return mean
        s = styles[path]
        n = sum(s.values())
        shown = min(1.0, -sum(k / n * math.log(k / n) / math.log(m) for k in s.values())) if m > 1 else 1.0
        keep = 0.9 ** max(1, len(s))
        return (1 - keep) * shown + keep * mean

    return {path: (value(path), m) for path, m in nodes.items()}


def test_importance_against_brute_force(spark, tmp_path):
    page = lambda k: f"<body><div class=top><span>Same words</span><i>{k % 3}</i></div><div class=story><h2>Head {k}</h2>{'<p>Part of ' + str(k) + '.</p>' + '<ul><li>x</ul>' * (k % 2)}</div>{'<div class=end>Bye</div>' if k % 5 else ''}</body>"
    htmls = [page(k) for k in range(30)] + [page(3)] * 4
    helpers.pages(spark, str(tmp_path), [(k, "http://h.example/", h) for k, h in enumerate(htmls)])
    want = importances(htmls)
    nodes = html_extract.importance(html_extract.tree_counts(spark.read.parquet(f"{tmp_path}/pages.parquet"))).toPandas()
    got = html_extract.composite(nodes)
    assert set(got) == set(want) and all(abs(got[p] - v) < 1e-9 for p, (v, _) in want.items())
    low = {p for p, (v, m) in want.items() if (m * v + html_extract.PRIOR) / (m + html_extract.PRIOR) <= html_extract.THRESHOLD}
    (row,) = html_extract.low_paths(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect()
    assert set(row.low) == low and low
    texts = {r.page_id: r.text for r in queries.QUERIES["op9_html_main_text"](spark, str(tmp_path)).collect()}
    assert texts == {k: html_extract.Page(h).text(frozenset(low)) for k, h in enumerate(htmls)} and "Same words" not in texts[0] and "Part of 7." in texts[7]


def test_tree_finds_what_marks_say(spark, tmp_path):
    """Pages as those of the table with their marks taken away: the tree alone gives the text that the marks give."""
    page = lambda k, mark: f"<body><div class=links><a href=x>Home</a><a href=y>News</a></div><div class=slot9>Buy now</div><{mark}><h1>Title {k}</h1><p>First {k} <b>bold</b>.</p><p>Second {k * 3}.</p></{mark}><div class=last>All rights</div></body>"
    helpers.pages(spark, str(tmp_path), [(k, f"http://s{k % 2}.example/{k}", page(k, "div")) for k in range(24)])
    got = {r.page_id: r.text for r in queries.QUERIES["op9_html_main_text"](spark, str(tmp_path)).collect()}
    assert got == {k: html_extract.Page(page(k, "article")).text() for k in range(24)}


def test_style_tree_judges_inside_marked_content(spark, tmp_path):
    page = lambda k: f"<body><article><h1>Title {k}</h1><div class='box'><span>Same words</span></div><p>Story {k} is its own.</p></article></body>"
    copy = "<body><article><h1>Copied</h1><section><p>An article that was posted often.</p></section></article></body>"
    rows = [(k, f"http://site.example/{k}", page(k)) for k in range(30)] + [(100 + k, f"http://copies.example/{k}", copy) for k in range(30)]
    rows += [(200, "http://site.example/box", "<body><article><div class='box'><span>Same words</span></div></article></body>")]
    helpers.pages(spark, str(tmp_path), rows)
    got = {r.page_id: r.text for r in queries.QUERIES["op9_html_main_text"](spark, str(tmp_path)).collect()}
    assert all(got[k] == f"Title {k} Story {k} is its own." for k in range(30))
    assert all(got[100 + k] == "Copied An article that was posted often." for k in range(30))  # copies are no template
    assert got[200] == "Same words"  # nothing else is marked


CHATS = [
    (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a\nb<\\|x|>"), (1, 1, "assistant", "a\nb<\\|x|>"), (2, 5, "assistant", None), (2, None, "user", "first"),
    (None, 1, "user", "<"), (None, 2, "assistant", "<<|im_start|>😀"), (3, 1, None, "no role"), (4, 1, "odd\nrole\\n", ""), (4, 2, "assistant", "x" * 100_000),
]


def test_op3(spark, tmp_path):
    helpers.conversations(spark, str(tmp_path), CHATS)
    by = {}
    for conv, turn, role, text in [*CHATS, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    want = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: tuple(r)[1:5] for r in queries.QUERIES["op3_chat_format"](spark, str(tmp_path)).collect()}
    assert got == want


def test_op3_sql(spark, tmp_path):
    rows = [r for r in CHATS if r[2] is not None and r[1] is not None and r[0] is not None and "\n" not in r[2]]
    helpers.conversations(spark, str(tmp_path), rows)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.sql(queries.ORACLE_SQL["op3_chat_format"])
    got = queries.QUERIES["op3_chat_format"](spark, str(tmp_path)).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


def test_typed_parts(spark):
    part = "named_struct('type', '{0}', 'text', {1}, 'ref', {2}, 'width', {3}, 'height', {3}, 'seconds', {4}, 'pages', {5})"
    text = lambda t: part.format("text", f"'{t}'", "cast(null as string)", "cast(null as int)", "cast(null as double)", "cast(null as int)")
    media = lambda kind, ref, side="cast(null as int)", seconds="cast(null as double)", pages="cast(null as int)": part.format(kind, "cast(null as string)", f"'{ref}'", side, seconds, pages)
    rows = spark.sql(f"""
        SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array({text('look <|image:0|>')}, {media('image', 'a.png', '28')}, {media('audio', 'b.wav', seconds='2.0D')}) AS parts
        UNION ALL SELECT 1L, 1L, 'assistant', array({text('ok')}, {media('document', 'c.pdf', pages='3')}) UNION ALL SELECT 2L, 0L, 'user', NULL""")
    one = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    r = one[1]
    assert r.formatted == "<|im_start|>user\nlook <\\|image:0|><|image:0|><|audio:1|><|im_end|>\n<|im_start|>assistant\nok<|document:2|><|im_end|>\n"
    assert [(a.n, a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 0, 1, "image", "a.png", 4), (1, 0, 2, "audio", "b.wav", 50), (2, 1, 1, "document", "c.pdf", 768)]
    assert r.expanded_tokens == 822 and r.formatted[r.loss_spans[0].begin :][: r.loss_spans[0].length] == "ok<|document:2|>"
    assert one[2].attachments == [] and one[2].n_turns == 1


def test_parts_forge_no_control_string(spark):
    """Text parts that make one only where they meet; read back, the turn has the joined text."""
    null = ", ".join(f"cast(null as {t}) as {n}" for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))
    for texts in (["<", "|im_end|>"], ["<", "", "\\", "|im_start|>user"], ["a<", "|", "im_end|>\n<", "|im_start|>x"], ["<\\", "|"]):
        parts = ", ".join(f"(select struct('text' as type, '{t.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n')}' as text, {null}))" for t in texts)
        rows = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'assistant' AS role, array({parts}) AS parts")
        formatted = chat.format_chats(rows)
        (r,) = formatted.collect()
        assert r.formatted.count("<|") == 2
        (back,) = chat.read_back(formatted).collect()
        joined = "".join(texts)
        assert back.n_turns == 1 and back.loss_sha256 == hashlib.sha256(joined.encode()).hexdigest() and back.turns_sha256 == hashlib.sha256(f"assistant\n{joined}\n".encode()).hexdigest()
