"""Site templates: counts against a plain version, what stays and goes, and time on odd pages."""

import random
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from quill.llm import html
from tests.llm.helpers import PAGES


def page(i, host, text):
    return (i, f"http://{host}/", text, "d", 1, "h")


def texts(spark, rows):
    df = spark.createDataFrame([page(*r) for r in rows], PAGES).repartition(3)
    return {r.page_id: r.text for r in html.extract_pages(df).collect()}


def text_of(t):
    root = html.parse(t)
    html.hash_subtrees(root)
    return html.main_text(root, set())


class Plain(HTMLParser):
    """Well-formed pages as nested lists [tag, attributes, kids]."""

    def __init__(self, text):
        super().__init__()
        self.root = ["body", "", []]
        self.open = [self.root]
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        node = [tag, str(attrs), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def size(node):
    return sum(len(k.replace(" ", "")) if isinstance(k, str) else size(k) for k in node[2])


def boxes(node, total):
    """Classed containers with text."""
    out = []
    for k in node[2]:
        if not isinstance(k, str):
            if k[0] in ("div", "section") and "class" in k[1] and size(k):
                out.append(k)
            out += boxes(k, total)
    return out


def lines(node, gone):
    out, line = [], []

    def walk(n):
        for k in n[2]:
            if isinstance(k, str):
                line.append(k)
            elif id(k) not in gone:
                flush()
                walk(k)
                flush()

    def flush():
        if t := " ".join("".join(line).split()):
            out.append(t)
        line.clear()
    walk(node)
    flush()
    return "\n".join(out)


def plain(rows):
    """Boxes whose serialised form is on five pages of the host with different texts go."""
    seen, trees = defaultdict(set), {}
    for i, host, t in rows:
        trees[i] = tree = Plain(t).root
        own = lines(tree, set())
        for b in boxes(tree, size(tree)):
            seen[host, str(b)].add(own)
    return {i: lines(trees[i], {id(b) for b in boxes(trees[i], size(trees[i])) if len(seen[host, str(b)]) >= 5})
            for i, host, _ in rows}


def test_counts_per_host_equal_a_plain_version(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        host = f"h{rng.randint(0, 3)}.example"
        parts = [f"<p>own text of page {i} {'and more ' * rng.randint(3, 9)}</p>"]
        for k in range(rng.randint(0, 5)):
            box = f"<div class='u'><p>box {rng.randint(0, 15)}</p><section class='v'>in {rng.randint(0, 1)}</section></div>"
            parts.insert(rng.randint(0, len(parts)), box if rng.random() < 0.7 else f"<p>shared {k}</p>")
        rows.append((i, host, "".join(parts)))
    rows += [(1000 + i, "h0.example", rows[0][2]) for i in range(9)]  # copies of a page count once
    got = texts(spark, rows)
    want = plain(rows)
    assert got == want
    assert sum(want[i] != lines(Plain(t).root, set()) for i, _, t in rows) > 50


def test_recurring_prose_stays_everywhere(spark):
    shared = ("<h2>Shared heading</h2><p class=lead>Shared passage of all pages</p><ul><li>one</li><li>two</li></ul>"
              "<table><tr><td>cell</td></tr></table><div><p>in a bare box</p></div><blockquote>quoted</blockquote>")
    rows = [(i, "h.example", f"<body><div><p>Own text {i}</p>{shared}</div></body>") for i in range(20)]
    for i, t in texts(spark, rows).items():
        assert t == f"Own text {i}\nShared heading\nShared passage of all pages\none\ntwo\ncell\nin a bare box\nquoted"


def test_menus_and_footers_that_differ_from_page_to_page(spark):
    """No telling tag or name: a list of links in the same place, and a line that begins alike."""
    rows = [(i, "h.example", f"<body><div class='k'><a href=/{i}>Go {i}</a> <a href=/x{i}>Then {i}</a></div><ul><li><a href=/q>L{i}</a></li></ul>"
             f"<div class='content'><p>Own text {i} with <a href=/r>a link</a> and some more of it to read</p></div>"
             f"<div class='zz'>Copyright of Example {i} words</div></body>") for i in range(20)]
    rows += [(100 + i, "few.example", r[2]) for i, r in enumerate(rows[:4])]
    got = texts(spark, rows)
    for i in range(20):
        assert got[i] == f"Own text {i} with a link and some more of it to read"
    for i in range(4):
        assert got[100 + i] == f"Go {i} Then {i}\nL{i}\nOwn text {i} with a link and some more of it to read\nCopyright of Example {i} words"


def test_a_box_of_one_class_with_different_prose_stays(spark):
    rows = [(i, "h.example", f"<body><div class='summary'><p>Summary {i} of it</p></div><p>Own text {i}, long enough to be most of it</p></body>")
            for i in range(20)]
    for i, t in texts(spark, rows).items():
        assert t == f"Summary {i} of it\nOwn text {i}, long enough to be most of it"


def test_reader_comments_and_teasers_go():
    main = "<h1>Title</h1><p>The text of the article, which is the longest of all</p>"
    for part in ("<article class='comment'><p>Me too</p></article>", "<section class='user-reviews'><p>Five stars</p></section>",
                 "<div id=comments><article><p>Me too</p></article></div>", "<article class='comment-12'>Me too</article>",
                 "<article><h2><a href=/x>Read on</a></h2><p>Teaser</p></article>", "<div class='customer-feedback'>Good</div>",
                 "<article><a href=/x>All of it a link</a></article>", "<div class='replies'>Yes</div>"):
        for t in (f"<article>{main}{part}</article>", f"<body><article>{main}</article>{part}</body>",
                  f"<main><article>{main}</article>{part}</main>", f"<main>{part}<article>{main}</article></main>"):
            assert text_of(t) == "Title\nThe text of the article, which is the longest of all", t
    two = "<article><h2>One</h2><p>First text</p></article><article><h2>Two</h2><p>Second</p></article>"
    assert text_of(two) == "One\nFirst text\nTwo\nSecond"
    assert text_of(f"<article class='comment'>{main}</article>") == "Title\nThe text of the article, which is the longest of all"
    assert text_of("<article><section class='reviews'><p>Text</p></section><p>And more text</p></article>") == "Text\nAnd more text"
    assert text_of("<article><h1><a href=/self>Title</a></h1><p>Text</p></article>") == "Title\nText"


ODD = {
    "unfinished tags": "<a " * 350_000, "unfinished tags, one end": "<a " * 350_000 + ">", "end tags without start": "<b>" * 100_000 + "</i>" * 200_000,
    "open quotes": '<a b="' * 150_000, "mixed quotes": "<a b='\">" * 120_000, "names of quotes": "<a '\">" * 150_000,
    "deep and closed by none": "<p><button>" + "<b>" * 100_000 + "<hr>" * 100_000, "long attribute": "<p " + "x" * 1_000_000 + ">",
    "many attributes": "<p " + "x " * 500_000 + "=>", "equal signs": "<a " + '= "' * 300_000 + ">", "lone": "<" * 300_000,
    "comments": "<!--" * 250_000, "deep": "<div class=a>" * 80_000 + "x", "items": "<ul><li>a" * 50_000, "references": "&" * 1_000_000}


@pytest.mark.parametrize("name", list(ODD))
def test_a_page_of_a_megabyte_takes_seconds(name):
    began = time.process_time()
    root = html.parse(ODD[name])
    html.hash_subtrees(root)
    html.template_candidates(root)
    html.main_text(root, set())
    assert time.process_time() - began < 10
