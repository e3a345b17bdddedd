"""Operators 2, 6, 7, 9 and 10."""

import json
import random
import re
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tickloom.llm import chat_format, html_extract, language_id, license_scan, license_texts, token_counts

# ---- 2


def call(i, name, args):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args}) + "</tool_call>"


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


MESSAGES = [
    (1, 0, "user", 'say "hi"\n'),
    (1, 1, "assistant", "let me " + call("a", "search", {"query": "x", "limit": 2}) + call("b", "calculate", {"expression": {"$result": "a"}})),
    (1, 2, "tool", result("b", {"z": 1, "a": [1, 2]})),
    (1, 3, "tool", result("a", "ok")),
    (1, 4, "tool", result("q", "?")),
    (2, 0, "assistant", call("c", "search", {"query": {"$result": "d"}}) + call("d", "search", {"query": {"$result": "c"}})),
    (2, 1, None, None),
    (2, 2, "assistant", call("e", "search", {"limit": 0}) + "<tool_call>{oops</tool_call>"),
    (2, 3, "assistant", call("f", "search", {"query": {"$result": "g"}})),
    (2, 4, "assistant", call("g", "search", {"query": "u"})),
    (2, 5, "assistant", call("g", "search", {"query": "again"})),
    (2, 6, "assistant", call("h", "search", {"query": {"$result": "nobody"}})),
    (None, None, "user", "n"),
]


def linked(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("level", F.lit("clash"))
    return chat_format.link(df).orderBy("conv_id", "at_turn", "level", "turn", "role", "seq", "json").collect()


def test_chat_links_orders_and_validates(spark):
    rows = linked(spark, MESSAGES * 2)
    one = [r for r in rows if r.conv_id == 1]
    assert [(r.kind, r.call_id, r.status) for r in one] == [("message", None, "message"), ("message", None, "message"), ("call", "a", "linked"), ("result", "a", "linked"), ("call", "b", "linked"), ("result", "b", "linked"), ("result", "q", "orphan")]
    two = {(r.call_id, r.status): r for r in rows if r.conv_id == 2 and r.kind == "call" and r.call_id}
    assert set(two) == {("c", "cyclic"), ("d", "cyclic"), ("e", "unanswered"), ("f", "unanswered"), ("g", "unanswered"), ("g", "repeated"), ("h", "unanswered")}
    assert not two["e", "unanswered"].valid and not two["h", "unanswered"].valid and two["f", "unanswered"].valid
    assert (two["g", "unanswered"].at_turn, two["g", "unanswered"].level) < (two["f", "unanswered"].at_turn, two["f", "unanswered"].level)
    for r in rows:  # canonical: reading and writing again changes nothing
        assert chat_format.canonical(json.loads(r.json)) == r.json
    assert len(rows) == len(linked(spark, MESSAGES)) and linked(spark, []) == []


def test_chat_order_on_random_graphs(spark):
    rng = random.Random(4)
    rows, needs = [], {}
    for c in range(12):
        ids = [f"i{k}" for k in range(8)]
        for k, i in enumerate(ids):
            needs[c, i] = [x for x in rng.sample(ids[:k], min(k, 2))] if k else []
            args = {"query": "q", "list": [{"$result": x} for x in needs[c, i]]}
            rows.append((c, rng.randrange(6), "assistant", call(i, "any", args)))
            if rng.random() < 0.8:
                rows.append((c, rng.randrange(6), "tool", result(i, i)))
    place, calls = {}, {}
    for n, r in enumerate(linked(spark, rows)):
        if r.status in ("linked", "unanswered"):
            (calls if r.kind == "call" else place)[r.conv_id, r.call_id] = n
    assert len(calls) == 96
    for (c, i), n in calls.items():
        assert place.get((c, i), n + 1) > n
        for x in needs[c, i]:
            assert calls[c, x] < n and place.get((c, x), 0) < n


def test_chat_odd_values(spark):
    messages = [
        (1, 0, "assistant", '<tool_call>{"id":"s","name":"search","arguments":{"query":"\\ud800"}}</tool_call>'),
        (1, 1, "tool", '{"tool_call_id":"s","content":1e999}'),
        (1, 2, "assistant", '<tool_call>{"id":{"x":1},"name":["n"],"arguments":{}}</tool_call><tool_call>{"id":7,"name":"search","arguments":{"query":1e999}}</tool_call>'),
        (1, 3, "tool", '{"tool_call_id":7,"content":"\\udfff!"}'),
        (1, 4, "assistant", call("r", "any", {"a": {"$result": ["s"]}})),
        (1, 5, "assistant", '<tool_call>{"id":"\\ud800","name":"search","arguments":{"\\ud801":1,"query":"x"}}</tool_call><tool_call>[1]</tool_call>'),
        (1, 6, "tool", '{"tool_call_id":true,"content":1}'),
    ]
    rows = linked(spark, messages)
    got = {(r.turn, r.kind, r.seq): r for r in rows}
    assert got[0, "call", 0].status == got[1, "result", 0].status == "linked" and got[0, "call", 0].valid and not got[1, "result", 0].valid
    assert json.loads(got[0, "call", 0].json)["arguments"]["query"] == "\ud800"
    assert got[2, "call", 0].call_id is None and "name" not in json.loads(got[2, "call", 0].json)
    assert got[2, "call", 1].call_id == "7" and got[2, "call", 1].status == got[3, "result", 0].status == "linked" and not got[2, "call", 1].valid
    assert not got[4, "call", 0].valid and got[5, "call", 0].call_id == "\\ud800" and not got[5, "call", 0].valid and not got[5, "call", 1].valid
    assert got[6, "result", 0].call_id is None and len(rows) == 9
    assert {r.n_messages for r in linked(spark, messages * 3)} == {3}


def slow_levels(turns, needs):
    """Places of the calls by looking at them again and again until nothing changes."""
    place = {}
    while True:
        new = {i: max([(turns[i], 1)] + [(max(t, turns[i]), l + 2 if t >= turns[i] else 1) for t, l in (place[n] for n in needs[i])]) for i in turns if i not in place and all(n in place for n in needs[i])}
        if not new:
            return place
        place |= new


def test_chat_levels_equal_brute_force(spark, monkeypatch):
    rng = random.Random(22)
    calls, edges, want = [], [], {}
    for conv in range(30):
        n = 60 if conv % 3 == 0 else 14
        turns = {f"c{k}": rng.randrange(5) for k in range(n)}
        ids = list(turns)
        needs = {i: ({ids[k - 1]} if conv % 3 == 0 else set(rng.sample(ids[:k], min(k, rng.randrange(3))))) if k else set() for k, i in enumerate(ids)}
        if conv % 5 == 0:  # a cycle, and what waits for it
            needs[ids[4]] |= {ids[7]}
        place = slow_levels(turns, needs)
        calls += [(conv, i, t) for i, t in turns.items()]
        edges += [(conv, i, x) for i, xs in needs.items() for x in xs]
        want |= {(conv, i): p for i, p in place.items()}
    rounds = []
    cut = chat_format.cut
    monkeypatch.setattr(chat_format, "cut", lambda df: rounds.append(1) or cut(df))
    got = chat_format.levels(spark.createDataFrame(calls, "conv_id long, call_id string, turn long"), spark.createDataFrame(edges, "conv_id long, call_id string, need string"))
    assert {(r.conv_id, r.call_id): (r.at_turn, r.level) for r in got.collect()} == want
    assert len(rounds) < 70  # chains of 60 take no 60 rounds of five tables


def test_chat_schema_rules():
    s = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 3}, "s": {"type": ["string", "null"], "enum": ["a", None]}, "l": {"type": "array", "items": {"type": "number"}}}, "required": ["n"], "additionalProperties": False}
    ok = chat_format.validate
    assert ok({"n": 2, "s": "a", "l": [1, 2.5]}, s) == [] and ok({"n": 1.0, "s": None}, s) == []
    for bad in ({}, {"n": 0}, {"n": 4}, {"n": True}, {"n": 1, "s": "b"}, {"n": 1, "l": ["x"]}, {"n": 1, "x": 1}, [], None):
        assert ok(bad, s)
    assert chat_format.split_message("assistant", "x <tool_call>NaN</tool_call>", {})[1]["errors"] == ["no JSON"]


# ---- 6

PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, lots of them, and so on, for ever.</p></div>
<div id=main><article><h2>Title &amp; more</h2><p>First  paragraph,
with a <b>bold</b> word &lt;tag&gt;, and enough text, to score.<p>Second one, not closed, with <a href=x>a link</a> in it, fine<br>after break.
<ul><li>item one, a</li><li>item two</li></ul><form><p>Your name, please, now</p><input></form>
<div class="ad">Buy, buy, buy, buy, buy</div></article>
<div class="comments"><p>I think, therefore, I comment, a lot, here, now.</p></div></div>
<aside><p>Related, stuff, here, and, there.</p></aside><footer>&copy; us, them, all</footer></body></html>"""


def test_html_keeps_the_article():
    assert html_extract.main_text(PAGE) == "Title & more First paragraph, with a bold word <tag>, and enough text, to score. Second one, not closed, with a link in it, fine after break. item one, a item two"


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("  \n", ""),
        ("<nav>only menus</nav>", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<p>&amp;lt;</p>", "&lt;"),
        ("<p>a<!-- x --><p>b", "a b"),
        ("<div><p>one</p>bare<p>two</p></div>", "one bare two"),
        ("<p>unclosed <b>bold <i>x</p><p>next</p>", "unclosed bold x next"),
        ("<script>never closed", ""),
        ("<p>x < y and z</p>", "x < y and z"),
        ("<article><p hidden>no</p><p>yes</p></article>", "yes"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_html_edges(page, text):
    assert html_extract.main_text(page) == text


def test_html_keeps_uneven_parts():
    long = "".join(f"<p>Paragraph {k} of the first part, with commas, and more, and enough text in it to score three points or more, as it has over one hundred letters.</p>" for k in range(6))
    short = "<section><p>The short part, of one paragraph.</p></section><ul><li>an item</li></ul><table><tr><td>cell</td></tr></table><figure>a figure</figure>"
    end = " The short part, of one paragraph. an item cell a figure"
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<main><div><div>", "</div></div></main>")):
        text = html_extract.main_text(f"<body>{open_}<h1>Head</h1><section>{long}</section>{short}{close}</body>")
        assert text.startswith("Head Paragraph 0") and text.endswith(end) and "Paragraph 5" in text, open_
    page = f"<body><div><a href=/>Home</a> <a href=/b>Other pages</a></div><div>{long}</div>bare <b>bold</b> <a href=x>a</a> text<p>after</p><ul><li><a href=/c>list of links</a></li></ul></body>"
    text = html_extract.main_text(page)
    assert text.endswith("letters. bare bold a text after") and text.startswith("Paragraph 0")
    page = f"<main><div><a href=/>Home</a> <a href=/b>Other pages</a></div><article><section>{long}</section><section><p>end</p></section></article><div>after it</div></main>"
    text = html_extract.main_text(page)
    assert text.endswith("letters. end after it") and text.startswith("Paragraph 0")


def test_html_frame(spark):
    long = "<article>" + "<p>word, word, word.</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, "u", PAGE, "t", None), (2, None, None, "t", 1), (3, "u", long, None, 2), (3, "u", long, None, 2)], "page_id long, url string, html string, text string, other int")
    rows = html_extract.extract(df).collect()
    assert [len(r.text) == r.n_chars for r in rows] == [True] * 4 and len(rows[2].text) == 20_000 * 18 - 1 and rows[0].other is None
    assert html_extract.extract(df.limit(0)).count() == 0


LONG = [f"Paragraph {k} of the text, with commas, and more, and enough words in it to score three points or more, as it has over one hundred letters." for k in range(4)]
BODY, WHOLE = "".join(f"<p>{x}</p>" for x in LONG), " ".join(LONG)
TALK = "".join(f"<p>I think, therefore, I comment, a lot, here, now, and for very long, until nobody, at all, can read it, ever, and so on {k}.</p>" for k in range(8))


@pytest.mark.parametrize(
    "page,before,after",
    [
        (f'<div id=content>{BODY}</div><div class="comment-body">{TALK}</div>', "", ""),
        (f"<article>{BODY}<div class='comment-body'>{TALK}</div></article>", "", ""),
        (f"<div class='main-nav'>Home, sweet, home, and, so, on</div><div class='cookie-text'>We, use, cookies, on, this</div><div class=post>{BODY}</div><div class='ad-content'>Buy, now, and, more</div>", "", ""),
        (f"<p data-x=it's>first words here</p>{BODY}<p title=don't>last</p>", "first words here", "last"),
        (f"<a href = \"x>y\">a</a><div title='a>b' data-y=\"it's\">{BODY}</div>", "", ""),
        (f"<article>{BODY}<div class=remark>A short remark.</div><section><p>End.</p></section></article>", "", "A short remark. End."),
        (f"<div id=page><div class=intro><p>Lead.</p></div><div class=body>{BODY}</div><div><p>Bye.</p></div></div><div>© 2024 Us. All rights reserved.</div>", "Lead.", "Bye."),
        (f"<div class='content with-sidebar'>{BODY}</div><div class=sidebar>{TALK}</div>", "", ""),
        (f"<div id=primary><article class='post-12 post category-ads tag-comments'>{BODY}</article><ol class=commentlist><li class=comment><article class='comment-body'>{TALK}</article></li></ol></div>", "", ""),
        (f"<table><tr><td class=navbar>{TALK}</td><td>{BODY}</td></tr></table>", "", ""),
        (f"<main>{BODY}<dl><dt>Term</dt><dd>Meaning</dd></dl><blockquote>Quote.</blockquote><pre>code  x</pre></main>", "", "Term Meaning Quote. code x"),
        (f"<ul><li><a href=1>One page</a></li><li><a href=2>Two page</a></li></ul><div>{BODY}<ul><li><a href=3>Source</a> of it all, at length</li></ul></div>", "", "Source of it all, at length"),
        (f"<div>{BODY}<figure><img src=x><figcaption>Cap.</figcaption></figure></div>", "", "Cap."),
        (f"<div class=wrapper><h1>Head</h1><h2>A</h2>{BODY}<h2>B</h2><p>x</p></div>", "Head A", "B x"),
        (f"<div role=navigation>{TALK}</div><div role=main>{BODY}</div><div role=contentinfo>{TALK}</div>", "", ""),
        (f"<div class=mainNav>{TALK}</div><div>{BODY}</div><div id=siteFooter>{TALK}</div>", "", ""),
    ],
)
def test_html_varied_markup(page, before, after):
    assert html_extract.main_text(f"<html><body>{page}</body></html>") == " ".join(filter(None, (before, WHOLE, after)))


class SlowText(HTMLParser):
    """All text of a well-formed page by another parser: blocks joined by one space, scripts left out."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.skip = [""], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "nav", "aside", "form")
        if tag in html_extract.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "nav", "aside", "form")
        if tag in html_extract.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if not self.skip:
            self.blocks[-1] += data

    def text(self):
        return " ".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_html_articles_against_another_parser():
    rng = random.Random(6)
    words = ["alpha", "beta,", "&amp;", "&eacute;t&#233;", "x&lt;y", "ﬁn", "don't", "<b>bold</b>", "<a href='u?a=1&b=2'>go</a>", "<br>", "<i class=it's>i</i>", "<!-- p> -->", "one  \n two"]
    for _ in range(300):
        inline = lambda n: " ".join(rng.choice(words) for _ in range(n))

        def block(depth):
            kind = rng.choice(["p", "h2", "blockquote", "div", "section", "ul", "table", "junk"] if depth < 3 else ["p"])
            if kind == "junk":
                return rng.choice([f"<nav>{inline(3)}</nav>", f"<script>var a = '<p>{rng.random()}</p>';</script>", "<style>p > b {}</style>", f"<aside><p>{inline(4)}</p></aside>", f"<form>{inline(2)}<input></form>"])
            if kind in ("p", "h2", "blockquote"):
                return f"<{kind}>{inline(rng.randrange(1, 12))}</{kind}>"
            if kind == "ul":
                return "<ul>" + "".join(f"<li>{inline(3)}</li>" for _ in range(3)) + "</ul>"
            if kind == "table":
                return "<table><tr>" + "".join(f"<td>{inline(2)}</td>" for _ in range(3)) + "</tr></table>"
            return f"<{kind} data-k='{rng.random()}'>" + "".join(block(depth + 1) for _ in range(rng.randrange(1, 4))) + f"</{kind}>"

        article = "<article>" + BODY + "".join(block(0) for _ in range(rng.randrange(6))) + "</article>"
        assert html_extract.main_text(f"<html><head><title>t</title></head><body><nav>{TALK}</nav>{article}<footer>{TALK}</footer></body></html>") == SlowText(article).text()


# ---- 7

VOCABULARY = {"en": "the of and that with this from there which house water people thing", "de": "der die und das nicht mit haus wasser leute sich werden ein zwischen", "fr": "le la les des est dans avec maison eau monde pour qui cette", "es": "el los las una con para casa agua gente cuando porque donde esta"}


def sentences(lang, rng, n):
    return " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k * 10 + j, sentences(x, rng, 60), x) for j, x in enumerate(VOCABULARY) for k in range(60)] + [(9999, None, "en"), (9998, "x", None)], "doc_id long, text string, lang string")
    page = lambda t, lang="": f"<html{lang}><body><p>{t}</p></body></html>"
    rows, truth = [], {}
    for i in range(200):
        x = rng.choice(list(VOCABULARY))
        truth[i] = x
        rows.append((i, f"http://h{x}.example.org/{i}", page(sentences(x, rng, 15), f" lang={rng.choice([x, x, x, 'en'])}" if rng.random() < 0.7 else "")))
    rows += [(1000, "http://hde.example.org/x", page("123")), (1001, None, None), (1002, "http://other.example.com/", page("", ' lang="fr-CA"')), (1003, "bad url", page("", " lang=xx")), (1003, "bad url", page("", " lang=xx"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit(0))
    got = {r.page_id: r for r in language_id.identify(df, docs).collect()}
    assert len(got) == 204
    assert sum(got[i].lang == x for i, x in truth.items()) >= 0.98 * 200
    assert got[1000].lang == "de" and got[1000].text_p == 0.25  # the host decides
    assert got[1002].lang == "fr" and all(0 < r.p <= 1 for r in got.values())
    assert language_id.identify(df.limit(0), docs).count() == 0
    assert {r.lang for r in language_id.identify(df, docs.limit(0)).collect()} == {None}


def test_host_priors_leave_the_page_out(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k * 10 + j, sentences(x, rng, 60), x) for j, x in enumerate(VOCABULARY) for k in range(30)], "doc_id long, text string, lang string")
    df = spark.createDataFrame([(1, "http://alone.example.net/", f"<p>{sentences('fr', rng, 4)}</p>")], "page_id long, url string, html string")
    r = language_id.identify(df, docs).first()
    assert r.p == pytest.approx(r.text_p)  # no other page: even priors


# ---- 9


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string, licence int")


def test_licences(spark):
    mit = license_scan.TEMPLATES["MIT"][1]
    rows = [
        ("LICENSE", license_scan.TEMPLATES["Apache-2.0"][1]),
        ("a/LICENSE.txt", "Some project\n" + mit + "\nmore words here that dilute the whole of it " * 5),
        ("a/b/code.py", "import x"),
        ("a/b/own.py", "# Licensed under CC BY-NC 4.0.\nfrom other import thing\nprint(thing)"),
        ("c/plain.txt", "nothing about it"),
        ("c/d/empty", ""),
        ("c/d/null", None),
        (None, "Released under the MIT License."),
        ("c/long", "word " * 50_000 + "\nAll rights reserved."),
        ("c/none", "it is not the law that we may license plate numbers by mail"),
    ]
    got = license_scan.scan(files(spark, [(p, t, 1) for p, t in rows] * 2)).collect()
    assert len(got) == 2 * len(rows)
    by = {r.path: (r.licence, r.origin) for r in got}
    assert by["LICENSE"] == ("Apache-2.0", "own") and by["a/LICENSE.txt"] == ("MIT", "own") and by["a/b/code.py"] == ("MIT", "inherited")
    assert by["a/b/own.py"] == ("CC-BY-NC-4.0", "own") and by["c/plain.txt"] == ("Apache-2.0", "inherited") and by["c/d/null"] == ("Apache-2.0", "inherited")
    assert by[None] == ("MIT", "own") and by["c/long"] == ("Proprietary", "own") and by["c/none"] == ("Apache-2.0", "inherited")
    assert license_scan.scan(files(spark, [])).count() == 0
    alone = license_scan.scan(files(spark, [("x/y", "no licence", 1)])).first()
    assert (alone.licence, alone.origin) == (None, "none")


MIT_FILE = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_wrapped_and_whole_licences(spark):
    import textwrap

    code = "\nimport os\nprint(os.sep)\n" * 40
    wrap = lambda text, mark, width: "\n".join(mark + line for line in textwrap.wrap(text, width))
    gpl, bsd = license_scan.TEMPLATES["GPL-3.0"][1], license_scan.TEMPLATES["BSD-3-Clause"][1]
    rows = [
        ("m/terms.txt", MIT_FILE),
        ("m/code.py", code),
        ("g/main.c", "/*\n" + wrap(gpl, " * ", 66) + "\n */" + code),
        ("g/main.m4", "first line\n" + wrap(gpl, "dnl ", 50) + code),
        ("b/main.py", "# Copyright 2020 Some Body.\n" + wrap(bsd, "# ", 76) + "\n#" + code),
        ("p/page.txt", "many other words of a page " * 30 + bsd + " and more of the same page, which goes on and on" * 9),
        ("x/main.py", "# a program of a library\n# in version 3 of the form that is not here" + code),
        ("r/whole.txt", license_texts.FULL["Apache-2.0"]),
        ("r/code.py", code),
    ]
    by = {r.path: r for r in license_scan.scan(files(spark, [(p, t, 1) for p, t in rows])).collect()}
    assert {p: (r.licence, r.origin) for p, r in by.items()} == {
        "m/terms.txt": ("MIT", "own"),
        "m/code.py": ("MIT", "inherited"),
        "g/main.c": ("GPL-3.0", "own"),
        "g/main.m4": ("GPL-3.0", "own"),
        "b/main.py": ("BSD-3-Clause", "own"),
        "p/page.txt": ("BSD-3-Clause", "own"),
        "x/main.py": (None, "none"),
        "r/whole.txt": ("Apache-2.0", "own"),
        "r/code.py": ("Apache-2.0", "inherited"),
    }
    assert by["g/main.c"].score == 1.0 and by["g/main.c"].line == 2 and by["m/terms.txt"].line == 0 and by["b/main.py"].line == 2


def test_anchors_lose_no_match():
    templates, squares, other, anchors = license_scan._model(license_scan.LEAST)
    has = set(anchors)
    rng = random.Random(0)
    for _ in range(3000):
        _, _, ts, norm = rng.choice(templates)
        unit = {t for t in ts if rng.random() < 0.8} | {rng.choice(["the", "foo", "of"]) for _ in range(rng.randrange(3))}
        if not unit or unit & has:
            continue
        tf = {t: license_scan.tf(rng.choice([1, 1, 2, 5])) for t in unit}
        size = sum(w * w * squares.get(t, other) for t, w in tf.items())
        assert all(sum(tf[t] * ts2[t] * squares[t] for t in unit & set(ts2)) / (size**0.5 * n2) < license_scan.LEAST for _, _, ts2, n2 in templates)


def brute_licence(text, least=license_scan.LEAST):
    """(licence, score, line) by the cosine of every line, every run that is laid over a template by an anchor, and the whole text."""
    import math

    templates, squares, other, anchors = license_scan._model(least)
    full, full_squares, full_other = license_scan._full_model()

    def cosine(unit, vector, norm, weights, unknown, sets):
        tf = {t: 1.0 if sets else 1 + math.log(n) for t, n in unit.items()}
        size = sum(w * w * weights.get(t, unknown) for t, w in tf.items())
        dot = sum(tf[t] * (1.0 if sets else vector[t]) * weights[t] for t in tf if t in vector)
        return round(dot / (math.sqrt(size) * norm), 6) if size else 0.0

    found = []
    units = [(0, 0, license_scan.counts(text))] + [(k, 0, license_scan.counts(x)) for k, x in enumerate(text.split("\n"), 1)]
    bare = [re.sub(r"(?i)^[ \t]*(dnl|rem)(?=[ \t])", "", x) for x in text.split("\n")]
    stream = [(m[0], k) for k, x in enumerate(bare, 1) for m in re.finditer(license_scan.TERM, x.lower())]
    # a run is laid over a template so that an anchor has the same place in both, and has as many of its terms as a match with it needs
    for term, _, q, width, need, ts in license_scan._starts(templates, squares, set(anchors), least):
        for f in {max(p - q, 0) for p, (t, _) in enumerate(stream) if t == term}:
            run = [t for t, _ in stream[f : f + width]]
            units += [(stream[f][1], 1, Counter(run))] if len(set(run) & set(ts)) >= need else []
    for line, run, unit in units:
        if set(unit) & set(anchors):
            found += [((False, x, -k, not run, -line), name, x, line) for k, name, ts, norm in templates if (x := cosine(unit, ts, norm, squares, other, False)) >= least]
    found += [((True, x, -k, True, 0), name, x, 0) for k, name, ts, norm in full if (x := cosine(units[0][2], dict.fromkeys(ts), norm, full_squares, full_other, True)) >= least]
    return max(found)[1:] if found else None


def test_scores_are_the_brute_force_cosines(spark):
    rng = random.Random(9)
    notices = [x for ts in license_scan.TEMPLATES.values() for x in ts]
    plain = "the code of a program is in this file and may use other words version 2 copyright list".split()
    texts = []
    for k in range(40):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(0, 3)):
            some = [w for w in rng.choice(notices).split() if rng.random() < 0.93]
            at = rng.randrange(len(words))
            words[at:at] = some + some[: rng.randrange(2)]
        lines = []
        while words:
            n = rng.randrange(1, 14)
            lines.append(rng.choice(["", "# ", "dnl "]) + " ".join(words[:n]))
            words = words[n:]
        texts.append("\n".join(lines))
    texts += [license_texts.FULL["MIT"], " ".join(license_texts.FULL["BSD-2-Clause"].split()[:-8] + ["more"] * 5), "permission permission permission hereby granted"]
    got = {r.path: (r.licence, r.score, r.line) for r in license_scan.own_licences(files(spark, [(str(k), t, 1) for k, t in enumerate(texts)])).collect()}
    want = {str(k): x for k, t in enumerate(texts) if (x := brute_licence(t))}
    assert got.keys() == want.keys() and len(want) > 15
    for k, (licence, score, line) in want.items():
        assert got[k][0] == licence and got[k][1] == pytest.approx(score, abs=2e-6) and (got[k][2] == line or got[k][1] < 1), k


def test_a_file_of_many_notices_takes_linear_time(spark):
    import time

    rng = random.Random(1)
    notices = [license_scan.TEMPLATES[x][0] for x in ("Apache-2.0", "MIT", "GPL-2.0")]
    text = "\n".join(" ".join(f"word{rng.randrange(3000)}" for _ in range(6)) + "\n" + rng.choice(notices) for _ in range(2000))
    assert len(text.split()) > 25_000
    began = time.perf_counter()
    [row] = license_scan.own_licences(files(spark, [("a/THIRD-PARTY", text, 1)])).collect()
    assert (row.licence, row.score, row.line) == ("MIT", 1.0, next(k for k, x in enumerate(text.split("\n"), 1) if x == notices[1])) and time.perf_counter() - began < 40


def test_licences_run_no_python_on_executors(spark):
    plan = license_scan.scan(files(spark, [("a/b", "Released under the MIT License.", 1)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- 10


def test_token_counts_are_those_of_the_tokenizer(spark):
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.VOCABULARY)
    pieces = [(f"{i}" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    exact = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    rng = random.Random(7)
    texts = ["", None, " ", "  two  spaces ", "line\nbreak\n\n", "日本語 😀 ﷽", "▁ already", "<s> </s> <unk>", "\x00\x01", "a" * 30_000, "x y " * 20_000]
    texts += ["".join(rng.choice("abcdeé \n▁ß漢") for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    for i, t in enumerate(texts):
        want = len(exact.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
        assert got[i] == want, t
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_viterbi_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 4))): float(-rng.randrange(1, 5)) for _ in range(5)}
        bytes_ = rng.random() < 0.5
        low = min(pieces.values())
        counter = token_counts.Counter(list(pieces.items()), low, bytes_, cached=3)
        text = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 9)))
        s = "▁" + text.replace(" ", "▁")
        best, back = [0.0], [(None, None)]
        for e in range(1, len(s) + 1):
            top = None
            for b in range(e):
                score = pieces.get(s[b:e], low - 10 if e - b == 1 else None)
                if score is not None and (top is None or best[b] + score > top[0]):
                    top = best[b] + score, b
            best.append(top[0])
            back.append((top[1], s[top[1] : e]))
        e, out = len(s), []
        while e:
            out.append(back[e][1])
            e = back[e][0]
        n, unknown = 0, False
        for p in reversed(out):
            new = p not in pieces
            n += (len(p.encode()) if bytes_ else not unknown) if new else 1
            unknown = new
        assert counter.of(text) == (n, best[-1]), (pieces, text)


def test_fractional_scores_are_added_from_the_start():
    rng = random.Random(10)
    for _ in range(40):
        alphabet = "abc▁"
        pieces = list({"".join(rng.choice(alphabet[:3]) for _ in range(rng.randrange(1, 4))) for _ in range(12)} | {"▁", "▁a", "▁b", "▁ab"})
        scored = [(p, -rng.randrange(1, 60) / 10) for p in sorted(pieces)]
        counter = token_counts.Counter(scored, -6.0, rng.random() < 0.5)
        assert not counter.whole and counter.parts.pattern != ".+"
        for _ in range(100):
            text = "".join(rng.choice("aabbc  d") for _ in range(rng.randrange(1, 40)))
            assert counter.of(text) == counter._search("▁" + text.replace(" ", "▁"))


def test_chat_levels_write_each_settled_call_once(spark, monkeypatch):
    written, cut = [], chat_format.cut

    def counted(df):
        out = cut(df)
        if "place" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(chat_format, "cut", counted)
    calls = spark.createDataFrame([(1, f"c{k}", 0) for k in range(12)], "conv_id long, call_id string, turn long")
    needs = spark.createDataFrame([(1, f"c{k}", f"c{k - 1}") for k in range(1, 12)], "conv_id long, call_id string, need string")
    got = {r.call_id: r.level for r in chat_format.levels(calls, needs).collect()}
    assert got == {f"c{k}": 2 * k + 1 for k in range(12)} and sum(written) <= 12
