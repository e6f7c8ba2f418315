"""Main text of web pages by equivalence-class template deduction.

Pages of one host are made from a template.  A token is an element at its path
(labels of the block elements around it, with their classes; containers that
share a label with an earlier sibling are numbered) or a run of text at a path.
For every host and token the vector of its counts over the host's different
pages is summed into a fingerprint (page hash times count), which merges in any
order: a page's copies are taken once, and a host with very many pages is
aggregated map-side first and never gathered.  Tokens with one fingerprint
share their occurrence vector: they are an equivalence class.  Classes of two
tokens or more that stand on ``FREQUENT`` of the pages are valid.  They nest by
the paths of their elements and make the template (``Template``).

Texts in valid classes are the template's own; all other text fills its slots.
The article is found by going down the nested classes: from an element that
stands once on a page to the one inside it, as long as the latter's slots hold
``MOST`` of the text (links and named asides apart), and not past a heading.
Inside the article a container whose whole text is the template's own is a
notice and is left out; a paragraph is never left out for being repeated.
Names decide only where the template can't: which elements are asides (nav,
footer, an advert by its class), how far an article element reaches around the
slots found, and everything on a page that has no template (one different page
in its host, or another layout than most).

Defined results: null or empty html gives an empty text; a null url belongs to
the host ""; repeated pages each get a row; extra columns are ignored; no rows
give no rows.  Parsing takes time and memory in proportion to the page, whatever
is left open or nested in it.
"""

from __future__ import annotations

import functools
import hashlib
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, materialize

#: A class is valid from this share of a host's different pages on.
FREQUENT = 0.5
#: An element is gone down to while it holds this share of the text around it.
MOST = 0.6
#: Templates up to this many bytes in all are broadcast; beyond it pages and templates are joined by host.
BROADCAST_BYTES = 8 << 20

# Element names and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form script style noscript template button select textarea iframe object svg canvas head menu dialog title audio video map datalist input".split())
RAW = frozenset("script style title textarea iframe noscript xmp noembed noframes template".split())
CLOSES_P = BLOCK - {"option", "optgroup", "body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "legend", "summary"}
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promos promotion sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended trending comment comments commentlist disqus reply replies respond footer toolbar widget widgets copyright disclaimer skip search".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
REGION_WORDS = frozenset("article content main post entry story".split())
#: Elements that a template's places are made of; others (paragraphs, items, cells) are content.
CONTAINERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form header hgroup main menu nav ol section table tbody td ul".split())
HEADINGS = frozenset("h1 h2".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_P_STOPS = frozenset("div article section td body li main blockquote aside nav form".split())
_WORD = re.compile(r"[a-z0-9]+")


def _marks(tag: str, attributes: str, inside: bool):
    """(label, dropped, region) of an element; ``inside``: within an article or main element."""
    dropped, region, label = tag in DROPPED or (tag == "header" and not inside), tag in ("article", "main"), tag
    if attributes.strip(" /\n\t"):
        names = []
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                names.append(value.lower())
            elif key == "role":
                dropped |= value.lower() in ASIDE_ROLES
                region |= value.lower() in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                dropped = True
        if names and tag not in ("body", "html"):
            words = set(_WORD.findall(" ".join(names)))
            dropped |= bool(words & ASIDE_WORDS) or (bool(words & HEADER_WORDS) and not inside)
            region |= bool(words & REGION_WORDS) and not dropped and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "span", "a", "li")
            label = f"{tag}.{' '.join(sorted(re.sub(r'[0-9]{3,}', '#', n) for n in names))}"
    return label, dropped, region


_MARK = 0xFFFFFFFFFFFFFFFF


def _h(text: str) -> int:
    """63-bit hash that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def _child(path: int, label: int) -> int:
    """Name of the element with a label at a path, 63 bits."""
    x = ((path ^ label) * 0x9E3779B97F4A7C15 + label) & _MARK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MARK
    return (x ^ (x >> 32)) >> 1


def _tags(html: str):
    """(text before, "/" of an end tag, name, attributes) of each tag, in one pass.

    Comments, declarations and the raw text of scripts and the like are skipped.
    Quoted values may hold a ">"; if a quote is left open to the end of the
    page, tags from there on end at their first ">".  A "<" with no ">" after
    it is text.
    """
    at = begin = 0
    n, last, loose = len(html), html.rfind(">"), False
    while True:
        i = html.find("<", at)
        if i < 0 or i + 1 >= n:
            break
        c = html[i + 1]
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            yield html[begin:i], "", "", ""
            at = begin = n if end < 0 else end + 3
            continue
        if i > last:
            break
        if c in "!?" or (c == "/" and not (i + 2 < n and html[i + 2].isascii() and html[i + 2].isalpha())):
            end = html.find(">", i)
            yield html[begin:i], "", "", ""
            at = begin = end + 1
            continue
        m = _NAME.match(html, i + 1)
        if not m:
            at = i + 1
            continue
        end = -1
        if not loose:
            k = m.end()
            while True:
                q = _QUOTE.search(html, k)
                if not q:
                    break
                if not q.group(1):
                    end = q.start()
                    break
                k = html.find(q.group(1), q.end()) + 1
                if not k:
                    break
            loose = end < 0
        if end < 0:
            end = html.find(">", m.end())
            if end < 0:
                break
        tag = m.group(2).lower()
        yield html[begin:i], m.group(1), tag, html[m.end() : end]
        at = begin = end + 1
        if tag in RAW and not m.group(1):
            stop = _raw_end(tag).search(html, at)
            at = begin = stop.end() if stop else n
    yield html[begin:], "", "", ""


def _closed_by(tag):
    """Elements that the start of a block element closes, each with those that it does not reach beyond."""
    if tag in CLOSES_P:
        yield "p", _P_STOPS
    if tag == "li":
        yield "li", ("ul", "ol")
    elif tag in ("td", "th"):
        yield tag, ("tr", "table")
    elif tag in ("tr", "dt", "dd", "option"):
        yield tag, ("table", "dl", "select")


@functools.lru_cache(64)
def _raw_end(tag):
    return re.compile(rf"</{tag}\s*>", re.I)


class Page:
    """What one pass over a page finds.

    blocks: [path, text, dropped, strength, inside] in page order; strength is 2
    in an article or main element, 1 in a container named like one, else 0;
    inside tells whether the block stands in the region and in none of the boxes.
    elements: [path, parent path, label, tag, strength, dropped, text, links] of
    every block element; text and links count the characters of the element's
    whole content that stand outside and inside of links.
    """

    def __init__(self, html: str, region: int | None = None, boxes=frozenset()):
        self.blocks: list[list] = []
        self.elements: list[list] = []
        self.found = False
        self._parse(html, region, boxes)

    def _parse(self, html, region, boxes):
        blocks, elements = self.blocks, self.elements
        # an open element: (tag, path, dropped, strength, place in elements, inside, link)
        root = ("", 0, False, 0, -1, False, False)
        stack: list[tuple] = []
        opened: dict[str, list[int]] = {}  # places in the stack by tag
        siblings: dict[int, dict[str, int]] = {}
        buffer: list[str] = []
        labels: dict[str, int] = {}
        state, links = root, 0

        def flush():
            nonlocal links
            if buffer:
                text = " ".join(unescape("".join(buffer)).split())
                buffer.clear()
                if text:
                    linked = min(links, len(text))
                    blocks.append([state[1], text, state[2], state[3], state[5]])
                    if not state[2] and state[4] >= 0:
                        elements[state[4]][6] += len(text) - linked
                        elements[state[4]][7] += linked
                links = 0

        def close(i):
            nonlocal state
            for x in stack[i:]:
                opened[x[0]].pop()
            del stack[i:]
            state = stack[-1] if stack else root

        for text, closing, tag, attributes in _tags(html):
            if text:
                buffer.append(text)
                if state[6]:
                    links += len(text)
            if not tag:
                continue
            block = tag in BLOCK
            if closing:
                if not opened.get(tag):
                    if block:
                        flush()
                    continue
                i = opened[tag][-1]
                if block or any(s[0] in BLOCK or s[2] != state[2] for s in stack[i:]) or stack[i][2] != (stack[i - 1][2] if i else False):
                    flush()
                close(i)
                continue
            if tag == "br":
                buffer.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                if tag == "title":
                    flush()
                continue
            if attributes.endswith("/") and not block:
                continue
            if block:
                flush()
                for want, stops in _closed_by(tag):
                    if opened.get(want) and opened[want][-1] > max((opened[x][-1] for x in stops if opened.get(x)), default=-1):
                        close(opened[want][-1])
            label, dropped, named = _marks(tag, attributes, state[3] == 2)
            dropped |= state[2]
            if dropped != state[2] and not block:
                flush()
            strength = max(state[3], (2 if tag in ("article", "main") else 1) if named else 0)
            path, place, inside = state[1], state[4], state[5]
            if block and tag not in ("html", "body"):
                if tag in CONTAINERS:
                    seen = siblings.setdefault(place, {})
                    seen[label] = nth = seen.get(label, 0) + 1
                    if nth > 1:
                        label = f"{label}[{nth}]"
                if label not in labels:
                    labels[label] = _h(label)
                path = _child(path, labels[label])
                if path == region:
                    inside = self.found = True
                elif path in boxes:
                    inside = False
                elements.append([path, state[1], label, tag, strength, dropped, 0, 0, place])
                place = len(elements) - 1
            state = (tag, path, dropped, strength, place, inside, state[6] or tag == "a")
            opened.setdefault(tag, []).append(len(stack))
            stack.append(state)
        flush()
        for x in reversed(elements):  # an element comes after the one that holds it
            if x[8] >= 0:
                elements[x[8]][6] += x[6]
                elements[x[8]][7] += x[7]


def page_tokens(html: str):
    """(tokens, content) of a page.

    Tokens are [kind, token, parent, label, strength, count, text, links]: kind 0
    an element at its path, 1 a text at its path (its label is null, its text
    the characters of all its occurrences).  Equal contents have equal tokens.
    """
    page = Page(html)
    held: dict = {}
    for path, parent, label, _, strength, dropped, text, links, _ in page.elements:
        x = held.get(path)
        if x is None:
            held[path] = [0, path, parent, label, 0 if dropped else strength, 1, text, links]
        else:
            x[5] += 1
            x[6] += text
            x[7] += links
    for path, text, dropped, _, _ in page.blocks:
        if not dropped:
            token = _child(path, _h(text))
            x = held.get(token)
            if x is None:
                held[token] = [1, token, path, None, 0, 1, len(text), 0]
            else:
                x[5] += 1
                x[6] += len(text)
    tokens = list(held.values())
    content = 0
    for x in tokens:
        content = (content + _child(x[1], x[5])) & _MARK
    return tokens, content >> 1


_TOKEN = "kind int, token long, parent long, label string, strength int, count long, text long, links long"


def _page_rows(batches):
    """(host, content, tokens) of each page with html."""
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["kind", "token", "parent", "label", "strength", "count", "text", "links"]
    for batch in batches:
        hosts, contents, flat, ends = [], [], [], [0]
        for host, html in zip(batch.column("host"), batch.column("html")):
            html = html.as_py()
            if html:
                tokens, content = page_tokens(html)
                hosts.append(host.as_py())
                contents.append(content)
                flat += tokens
                ends.append(len(flat))
        values = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], k) for i, k in enumerate(kinds)], names)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["host", "content", "tokens"])


class Template:
    """Nested valid classes of a host, from its frequent tokens.

    ``rows``: dicts with the token's columns and its fingerprint f1, f2 and
    ``pages``.  region: the element that holds the article, or None; boxes:
    containers inside it whose whole text is the template's own; classes:
    (elements and texts, parent class or -1) of each valid class.
    """

    def __init__(self, rows):
        tags = {r["token"]: r for r in rows if r["kind"] == 0}
        members: dict = {}
        for r in rows:
            members.setdefault((r["f1"], r["f2"]), []).append(r)
        valid = sorted((m for m in members.values() if len(m) > 1), key=lambda m: (-m[0]["pages"], min(r["token"] for r in m)))
        self.class_of = {r["token"]: i for i, m in enumerate(valid) for r in m}
        self.tags = tags
        self.own: dict = {}  # characters of the template's own texts below each element
        for r in rows:
            if r["kind"] and r["token"] in self.class_of:
                for at in self.up(r["parent"]):
                    self.own[at] = self.own.get(at, 0) + r["text"]
        self.classes = [(len(m), self.parent_class(m)) for m in valid]
        self.region = self.find_region()
        self.boxes = self.find_boxes()

    def up(self, path):
        """An element and all around it."""
        while path in self.tags:
            yield path
            path = self.tags[path]["parent"]

    def parent_class(self, members):
        """Class of the nearest element around the class's elements that belongs to another class."""
        own = {r["token"] for r in members}
        for r in members:
            for at in self.up(r["parent"]):
                if at not in own and at in self.class_of:
                    return self.class_of[at]
        return -1

    def filled(self, path):
        """Characters of the slots in an element."""
        return max(0, self.tags[path]["text"] - self.own.get(path, 0))

    def find_region(self):
        inside: dict = {}
        for path, r in self.tags.items():
            inside.setdefault(r["parent"], []).append(path)

        def places(path):
            """Nearest containers of valid classes below a path that stand once on a page."""
            out, todo = [], list(inside.get(path, ()))
            while todo:
                x = todo.pop()
                if self.tags[x]["count"] == self.tags[x]["pages"] and x in self.class_of and _tag(self.tags[x]) in CONTAINERS:
                    out.append(x)
                else:
                    todo += inside.get(x, ())
            return out

        at, total = 0, sum(self.filled(x) for x in inside.get(0, ()))
        while total:
            best = max(places(at), key=lambda x: (self.filled(x), -x), default=None)
            if best is None or self.filled(best) < MOST * total:
                break
            if at and any(_tag(self.tags[x]) in HEADINGS for x in inside.get(at, ())):
                break
            at, total = best, self.filled(best)
        if not at:
            return None
        if not self.tags[at]["strength"]:
            return at
        # the innermost element that bears the name
        while self.tags[at]["parent"] in self.tags and self.tags[self.tags[at]["parent"]]["strength"] == self.tags[at]["strength"] and not _named(self.tags[at]):
            at = self.tags[at]["parent"]
        return at

    def find_boxes(self):
        if self.region is None:
            return []
        most = self.filled(self.region)
        out = []
        for path, r in self.tags.items():
            own = self.own.get(path, 0)
            if own and path != self.region and path in self.class_of and _tag(r) in CONTAINERS and not self.filled(path) and own <= most and self.region in self.up(path):
                out.append(path)
        return sorted(out)


def _tag(row) -> str:
    return re.split(r"[.\[]", row["label"], maxsplit=1)[0]


def _named(row) -> bool:
    """The label itself is an article's."""
    return _tag(row) in ("article", "main") or bool(set(_WORD.findall(row["label"].lower())) & REGION_WORDS)


_TEMPLATE = "host string, pages long, region long, boxes array<bigint>, classes array<struct<tokens:int,parent:int>>"


def _template(table):
    import pyarrow as pa

    rows = table.to_pylist()
    t = Template(rows)
    classes = pa.array([[{"tokens": n, "parent": p} for n, p in t.classes]], pa.list_(pa.struct([("tokens", pa.int32()), ("parent", pa.int32())])))
    return pa.table({"host": pa.array([rows[0]["host"]], pa.string()), "pages": pa.array([rows[0]["n"]], pa.int64()), "region": pa.array([t.region], pa.int64()), "boxes": pa.array([t.boxes], pa.list_(pa.int64())), "classes": classes})


def deduce_templates(pages: DataFrame) -> DataFrame:
    """One row for each host with two different pages or more: host, pages (different ones), region, boxes, classes.

    A host's frequent tokens are at most twice as many as its mean page has, so
    its template is made in one place, whatever the number of its pages.
    """
    found = pages.select(host_column(F.col("url")).alias("host"), "html").mapInArrow(frugal(_page_rows), f"host string, content long, tokens array<struct<{_TOKEN.replace(' ', ':').replace(',:', ',')}>>")
    different = materialize(found.groupBy("host", "content").agg(F.first("tokens").alias("tokens")), "contents")
    hosts = _small(materialize(different.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "hosts"), F.octet_length("host") + 16)
    tokens = different.select("host", "content", F.explode("tokens").alias("t")).select("host", "content", "t.*")
    # 31 bits of a hash of page and count, so that sums over four thousand million pages fit
    sums = [F.sum(c).alias(c) for c in ("count", "text", "links")] + [F.sum(F.xxhash64("content", "count", F.lit(i)).bitwiseAND(F.lit(0x7FFFFFFF))).alias(f"f{i}") for i in (1, 2)]
    tokens = tokens.groupBy("host", "kind", "token").agg(
        F.max("parent").alias("parent"), F.max("label").alias("label"), F.max("strength").alias("strength"), *sums, F.count(F.lit(1)).alias("pages")
    )
    # most texts stand on one page only: they fill slots
    frequent = tokens.where("pages >= 2").join(hosts, "host").where(F.col("pages") >= FREQUENT * F.col("n"))
    return frequent.groupBy("host").applyInArrow(_template, _TEMPLATE)


def _small(table: DataFrame, weight) -> DataFrame:
    """The table marked for broadcast if its rows weigh ``BROADCAST_BYTES`` or less."""
    return F.broadcast(table) if (table.agg(F.sum(weight).alias("w")).first()["w"] or 0) <= BROADCAST_BYTES else table


def extract(html: str | None, region: int | None = None, boxes=frozenset()) -> str:
    """Main text of a page, given its host's template."""
    if not html:
        return ""
    page = Page(html, region, boxes)
    if page.found:
        return "\n".join(b[1] for b in page.blocks if b[4] and not b[2])
    slots = [b for b in page.blocks if not b[2]]
    strength = max((b[3] for b in slots), default=0)
    return "\n".join(b[1] for b in slots if b[3] == strength)


def _extract_rows(batches):
    import pyarrow as pa

    for batch in batches:
        region, boxes = batch.column("region").to_pylist(), batch.column("boxes")
        texts = [extract(html.as_py(), region[i], frozenset(boxes[i].as_py() or ())) for i, html in enumerate(batch.column("html"))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``."""
    templates = materialize(deduce_templates(pages), "templates").where("region is not null").select("host", "region", "boxes")
    templates = _small(templates, F.octet_length("host") + 8 * F.size("boxes") + 64)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_column(F.col("url")).alias("host"))
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "region", "boxes")
    return joined.mapInArrow(frugal(_extract_rows), "page_id long, url string, text string, n_chars long")


def host_column(url):
    """The host of a url, lower-cased; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))
