"""Main text of web pages by site template removal.

1. Every page is parsed into elements, and what could be template is counted per
   host in Spark, over the whole body, inside main content and outside: the
   hashes of the subtrees that are boxes, and outside main content also their
   slots.  A slot is the path of tags and names from the root, whatever the text;
   with it goes whether most of the box is links, and its first words.  Pages of
   equal text count once, so the passages of a page with many copies are no
   template.
2. Template is a subtree found on ``MIN_PAGES`` pages of its host, a slot that is
   links on so many pages and on ``LINK_SHARE`` of those that have it (a menu that
   differs from page to page), and a slot that begins with the same words on so
   many and on ``LEAD_SHARE`` (a copyright line).  The templates are joined back
   to what each page holds, so no list grows with the host.
3. Each page drops its template boxes and the elements that are boilerplate by
   tag, role, class or id; the rest of its main content is the text.  A name is
   boilerplate as a whole (``sidebar``) or as a compound of known parts
   (``share-bar``), not for a part alone (``has-sidebar``).

A box is a landmark (``nav``, ``footer`` and the like), one of ``BOXES`` with a
class, id or role of its own, or, outside main content, a list or block that is
mostly links; it holds no main content, and inside main content not half of the
text, which goes for slots everywhere.  Paragraphs, headings, lists, tables and bare containers are prose: they stay wherever they
recur, for passages that many articles share are article text.

Main content is the outermost ``article`` or ``main`` elements, or the body when
there are none.  Of several articles those that are comments by name, or teasers
(the heading or most of the text is a link), go; the largest always stays.

Text: character references decoded, white space inside a block turned into one
space and trimmed, blocks joined by a line feed in page order.

Defined cases: null or empty html gives empty text; a null url has the host of
all null urls; repeated rows are separate pages; unclosed elements end where
their parent ends or an element follows that cannot stand inside them, an
unfinished tag at the end is dropped; a page of any length is parsed whole, in
time linear in its length; an empty table gives an empty result.  Other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm.common import materialise

MIN_PAGES, LINK_SHARE, LEAD_SHARE, LEAD_WORDS = 5, 0.8, 0.5, 3
SALTS = 16

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul caption".split())
SKIP = frozenset(
    "head script style noscript template textarea title iframe object embed svg canvas math nav aside form footer menu "
    "button select input option datalist dialog map audio video".split())
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "thead": ("thead tbody tfoot tr td th", ("table",)), "tbody": ("thead tbody tfoot tr td th", ("table",)),
    "tfoot": ("thead tbody tfoot tr td th", ("table",)), "option": ("option", ("select", "datalist", "optgroup")),
    "optgroup": ("option optgroup", ("select",)), "body": ("head", ()),
}
ENDS_P = BLOCK - frozenset("html body li dd dt td th tr tbody thead tfoot caption option optgroup summary legend".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice "
    "notices nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets "
    "comment comments disqus respond reply replies share sharing social related teaser teasers newsletter subscribe "
    "popup modal pagination pager toolbar login signup".split())
# what readers write: one part of each
READERS = frozenset("user users reader readers customer customers visitor visitors member members guest".split())
READER_TEXTS = frozenset("review reviews feedback opinion opinions question questions discussion rating ratings".split())
COMPOUND_PARTS = frozenset(
    "site page main top bottom left right global primary secondary sub mobile desktop bar box list links link buttons "
    "button icons icon wrapper wrap container section area block slot unit inner item items form panel overlay message "
    "tabs toggle count posts articles stories blog google".split())
OWN_PARTS = frozenset("post article entry".split())
NUMBER_PART = re.compile(r"[0-9]+(?:x[0-9]+)?")
# tags that hold main content only if no other is there
LANDMARKS = frozenset("nav aside footer menu dialog".split())
WRAPPERS = LANDMARKS | {"form", "header"}
BOXES = frozenset("div section details fieldset center address ins".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINK_LISTS = frozenset("ul ol dl table p div section".split())
NAME_PARTS = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"[0-9]+")
# A tag ends at the first ">" outside a quoted value; a quote that is not closed is a character.  Nothing is tried twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)>", re.S)
ATTR = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "main", "size", "links", "slot", "lead", "linked")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag, self.attrs = tag, attrs
        self.kids: list = []
        self.hash = 0
        self.main = False  # is main content or holds it
        self.size = 0  # characters of text that no tag drops, without white space
        self.links = 0  # those inside links
        self.slot = 0  # hash of the path of tags and names from the root
        self.lead: tuple[str, ...] = ()  # first words
        self.linked: bool | None = None  # whether the first heading is a link; None without heading

    @property
    def linky(self) -> bool:
        return 2 * self.links > self.size


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds text, open, close."""
    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:], ""
            return
        m = TOKEN.match(html, lt) if lt < last or html.startswith("<!--", lt) else None
        if m is None:
            # a lone "<" is text; an unfinished tag at the end is dropped
            nxt = html.find("<", lt + 1)
            end = n if nxt < 0 else nxt
            cut = lt if html[lt + 1:lt + 2].isalpha() or html[lt + 1:lt + 2] == "/" else end
            if cut > at:
                yield "text", html[at:cut], ""
            at = end
            continue
        if lt > at:
            yield "text", html[at:lt], ""
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            yield "close", name, ""
            continue
        yield "open", name, m.group(3)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else n
            yield "text", html[at:stop], ""
            at = stop


class Stack:
    """The open elements, and where those of each tag are."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def nearest(self, tags) -> int:
        """Place of the innermost open element of ``tags``; 0, the root's, without any."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def end(self, ended, within) -> None:
        """Close the open elements named in ``ended`` inside the nearest one of ``within``."""
        limit = self.nearest(within)
        while (at := self.nearest(ended)) > limit:
            self.cut(at)


def parse(html: str | None) -> Node:
    """Element tree of a page."""
    root = Node("html", "")
    stack = Stack(root)
    for kind, name, attrs in tokens(html or ""):
        if kind == "text":
            stack.nodes[-1].kids.append(name)
        elif kind == "close":
            if at := stack.nearest((name,)):
                stack.cut(at)
        elif name != "html":
            if name in ENDS_P:
                stack.end(("p",), ("article", "main", "section", "div", "td", "th", "button"))
            if name in CLOSES:
                ended, within = CLOSES[name]
                stack.end(ended.split(), within)
            node = Node(name, attrs)
            stack.nodes[-1].kids.append(node)
            if name not in VOID and not attrs.endswith("/"):
                stack.push(node)
    return root


def post_order(root: Node) -> list[Node]:
    """Elements with children before parents."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    return out[::-1]


def own_names(attrs: str) -> list[str]:
    """The values of class, id and role, split, without digits."""
    if "=" not in attrs:
        return []
    return [DIGITS.sub("", w) for name, *v in ATTR.findall(attrs) if name.lower() in ("class", "id", "role")
            for w in "".join(v).lower().split()]


def hash_subtrees(root: Node) -> list[Node]:
    """Sets all that ``Node`` says of an element and its subtree; elements with children before parents."""
    nodes = post_order(root)
    for node in nodes:
        node.main = node.tag in ("article", "main")
        h = xxhash.xxh64(f"{node.tag} {node.attrs}".encode("utf-8", "replace"))
        for k in node.kids:
            if isinstance(k, Node):
                h.update(k.hash.to_bytes(8, "little"))
                node.main |= k.main
                node.size += k.size
                node.links += k.links
                if node.linked is None:
                    node.linked = k.linked
                if len(node.lead) < LEAD_WORDS:
                    node.lead = (*node.lead, *k.lead)[:LEAD_WORDS]
            elif t := " ".join(k.split()):
                h.update(b"\x00" + t.encode("utf-8", "replace"))
                node.size += len(t) - t.count(" ")
                if len(node.lead) < LEAD_WORDS:
                    node.lead = (*node.lead, *t.split(None, LEAD_WORDS)[:LEAD_WORDS])[:LEAD_WORDS]
        node.hash = h.intdigest()
        if node.tag == "a":
            node.links = node.size
        if node.tag in HEADINGS:
            node.linked = node.linky
        if node.tag in SKIP and node.tag != "form":
            node.size = node.links = 0
    root.slot = 1
    for node in reversed(nodes):
        for k in node.kids:
            if isinstance(k, Node):
                k.slot = xxhash.xxh64_intdigest(f"{node.slot} {k.tag} {' '.join(own_names(k.attrs))}".encode("utf-8", "replace"))
    return nodes


def main_size(root: Node) -> int:
    """Characters of the main content."""
    if not root.main:
        return root.size
    size, todo = 0, [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            size += node.size
        else:
            todo += [k for k in node.kids if isinstance(k, Node) and k.main]
    return size


def reached(root: Node) -> bool:
    """Whether some main content lies in none of ``LANDMARKS``."""
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            return True
        todo += [k for k in node.kids if isinstance(k, Node) and k.main and k.tag not in LANDMARKS]
    return False


def text_size(node: Node) -> int:
    """Characters of a subtree, those included that the tag drops."""
    return node.size or len(node.lead)


def is_box(node: Node, total: int, inside: bool) -> bool:
    """Whether a subtree can be template; inside main content (of ``total`` characters) not if it is half of that."""
    if node.main or not text_size(node) or inside and 2 * node.size >= total or node.tag in ("html", "head", "body"):
        return False
    if node.tag in LANDMARKS or node.tag in WRAPPERS:
        return True
    if node.tag in BOXES and own_names(node.attrs):
        return True
    return not inside and node.tag in LINK_LISTS and node.linky


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def keyed(slot: int, what: str) -> int:
    return signed(xxhash.xxh64_intdigest(f"{slot} {what}".encode("utf-8", "replace")))


def slot_keys(node: Node, total: int) -> list[tuple[int, float]]:
    """What a box says of its slot (that it is links, how it begins), and on which share of the slot's pages it must hold.

    Nothing, if it is half of the page's text (``total``).
    """
    if 2 * node.size >= total:
        return []
    out = [(keyed(node.slot, "links"), LINK_SHARE)] if node.linky and node.size else []
    return out + [(keyed(node.slot, "lead " + " ".join(node.lead)), LEAD_SHARE)] * (len(node.lead) == LEAD_WORDS)


Candidate = tuple[int, "int | None", float, bool]


def template_candidates(root: Node) -> list[Candidate]:
    """(key, key of the slot it is a share of, that share, whether the page's text can hold it) of all boxes, once each."""
    out: dict[int, Candidate] = {}
    whole, total = not root.main, main_size(root)
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.tag in RAW or node.tag == "head":
            continue
        inside = inside or node.tag in ("article", "main")
        if node is not root and is_box(node, total, inside):
            own = inside or whole
            out[signed(node.hash)] = (signed(node.hash), None, 0.0, own)
            if not inside:
                slot = signed(node.slot)
                out[slot] = (slot, None, 0.0, False)
                for k, share in slot_keys(node, root.size):
                    out[k] = (k, slot, share, own)
        todo += [(k, inside) for k in node.kids if isinstance(k, Node)]
    return sorted(out.values(), key=lambda x: x[0])


def is_template(node: Node, template: set[int], root: Node, total: int, inside: bool) -> bool:
    if not template or node is root or not is_box(node, total, inside):
        return False
    return signed(node.hash) in template or not inside and any(k in template for k, _ in slot_keys(node, root.size))


def boiler_name(word: str, inside_main: bool) -> bool:
    """Whether a class or id names boilerplate, as a whole or as a compound of known parts."""
    parts = [p for p in NAME_PARTS.split(word) if p]
    own_header = inside_main or not OWN_PARTS.isdisjoint(parts)  # holds the title
    boiler = any(p in BOILER_NAMES and not (own_header and p == "header") for p in parts)
    readers = not READERS.isdisjoint(parts) and not READER_TEXTS.isdisjoint(parts)
    known = (BOILER_NAMES, COMPOUND_PARTS, OWN_PARTS, READERS, READER_TEXTS) if readers else (BOILER_NAMES, COMPOUND_PARTS, OWN_PARTS)
    return (boiler or readers) and all(any(p in k for k in known) or NUMBER_PART.fullmatch(p) for p in parts)


def is_boilerplate(node: Node, inside_main: bool, spared: bool = False) -> bool:
    """By tag, role, class and id; an article's own header (its title) stays, and what is ``spared`` goes by no name."""
    if node.tag in SKIP or (node.tag == "header" and not inside_main):
        return not (spared and node.tag in WRAPPERS)
    if not node.attrs or spared:
        return False
    if "=" not in node.attrs:
        return "hidden" in node.attrs.lower().split()
    for name, *values in ATTR.findall(node.attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in BOILER_ROLES:
            return True
        if name in ("class", "id") and node.tag not in ("body", "main"):
            if any(boiler_name(word, inside_main) for word in value.split()):
                return True
    return False


def largest_main(root: Node) -> tuple[int, set[int]]:
    """Characters of the largest article, and the elements around the largest main content (its own first), by ``id``."""
    parent: dict[int, Node] = {}
    articles, outer = [0], []
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.tag == "article":
            articles.append(node.size)
        if node.tag in ("article", "main") and not inside:
            outer.append(node)
            inside = True
        for k in node.kids:
            if isinstance(k, Node) and k.main:
                parent[id(k)] = node
                todo.append((k, inside))
    around: set[int] = set()
    node = max(outer, key=lambda n: n.size, default=None)
    while node is not None:
        around.add(id(node))
        node = parent.get(id(node))
    return max(articles), around


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the main content; ``hash_subtrees`` has run."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if t := " ".join(unescape("".join(line)).split()):
            blocks.append(t)
        line.clear()

    whole, total = not root.main, main_size(root)
    plain = reached(root)
    largest, around = largest_main(root)

    def spared(node: Node, inside: bool) -> bool:
        if node.tag == "article":
            return node.size >= largest
        if inside:
            return 2 * node.size > total
        return id(node) in around and not (plain and node.tag in LANDMARKS)

    # (node or text or None for "a block ends", inside main content)
    todo: list[tuple[object, bool]] = [(root, whole)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                line.append(node)
        else:
            starts = node.tag in ("article", "main")
            own = inside and not whole or starts
            gone = is_boilerplate(node, own, spared(node, inside))
            if node.tag == "article" and node.size < largest:
                gone = gone or node.linky or bool(node.linked)
            if gone or is_template(node, template, root, total, own):
                if inside and node.tag in BLOCK:
                    flush()
                continue
            if node.tag == "br":
                line.append("\n")
                continue
            if node.tag in BLOCK:
                flush()
                todo.append((None, inside))
            todo += [(k, inside or starts) for k in reversed(node.kids)]
    flush()
    return "\n".join(blocks)


# --- Spark side ---------------------------------------------------------------------------------

def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("key", "slot", "share", "own")
    keys = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True))))
    for b in batches:
        texts, seen = [], []
        for html in b.column(2).to_pylist():
            root = parse(html)
            hash_subtrees(root)
            seen.append([dict(zip(names, c, strict=True)) for c in template_candidates(root)])
            texts.append(signed(xxhash.xxh64_intdigest(main_text(root, set()).encode("utf-8", "replace"))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.int64()), pa.array(seen, keys)],
                                         names=["host", "page", "text", "seen"])


def template_keys(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key) of the templates, from (host, text, seen): counts over the host's distinct texts."""
    every = found.select("host", "text", F.explode("seen").alias("c")).select("host", "text", "c.key", "c.slot", "c.share")
    counts = every.distinct().groupBy("host", "key").agg(F.count("*").alias("n"), F.min("slot").alias("slot"),
                                                         F.min("share").alias("share"))
    counts = materialise(counts.filter(F.col("n") >= min_pages), "subtree-counts")
    pages = counts.filter("slot IS NULL").select("host", F.col("key").alias("slot"), F.col("n").alias("pages"))
    shares = counts.filter("slot IS NOT NULL").join(pages, ["host", "slot"]).filter(F.col("n") >= F.col("share") * F.col("pages"))
    kept = counts.filter("slot IS NULL").select("host", "key").unionByName(shares.select("host", "key"))
    return materialise(kept, "templates")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, page, template): keys of the page's own boxes that are template on its host, from (host, page, html)."""
    found = materialise(pages.select("host", "page", "html").mapInArrow(
        _hashes, "host string, page binary, text long, seen array<struct<key:long,slot:long,share:double,own:boolean>>"), "subtrees")
    kept = template_keys(found, min_pages)
    # a box of the whole site is one hot key: salted
    salt = F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int")
    own = found.select("host", "page", F.explode("seen").alias("c"), salt.alias("salt")).filter("c.own")
    spread = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = own.select("host", "page", "salt", F.col("c.key").alias("key")).join(spread, ["host", "key", "salt"])
    return materialise(hits.groupBy("host", "page").agg(F.sort_array(F.collect_set("key")).alias("template")), "page-templates")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for html, template in zip(b.column(2).to_pylist(), b.column(3), strict=True):
            root = parse(html)
            hash_subtrees(root)
            known = set(template.values.to_numpy().tolist()) if template.is_valid else set()
            texts.append(main_text(root, known))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
            names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    p = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"),
                     F.unhex(F.md5(F.coalesce(F.col("html"), F.lit("")))).alias("page"))
    t = site_templates(p, min_pages)
    p = p.join(t, ["host", "page"], "left").select("page_id", "url", "html", "template")
    kind = pages.schema["page_id"].dataType.simpleString()
    return p.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
