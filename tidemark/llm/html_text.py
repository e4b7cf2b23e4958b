"""Main text of web pages: removal of site templates plus semantic rules.

Every block element of a page is hashed with all that is below it, once with its
words and once by its shape and place.  Spark counts in how many different pages
of a host each hash occurs; subtrees that recur across most of them are template
and are deleted: those with equal words wherever they stand, those of one shape
outside the place that holds most of the text of the host's pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stable import settled
from .url_rules import host_of

#: A subtree is template if it occurs in at least this many different pages of its host ...
MIN_PAGES = 8
#: ... and in at least this share of them.
MIN_SHARE = 0.5
#: Template tables up to this many rows are sent to every task; larger ones are joined by host.
BROADCAST_TEMPLATES = 200_000

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("script style textarea title xmp iframe noembed noframes head noscript template svg math canvas object audio video map nav header footer aside form button select option datalist dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table caption colgroup tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = BLOCK - frozenset("body head html td th tr tbody thead tfoot caption colgroup option optgroup legend".split())
#: Start tags that end an open element of these names, up to the given containers.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("table tr".split())),
    "th": (frozenset("td th".split()), frozenset("table tr".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "body": (frozenset(["head"]), frozenset()),
}
# Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc header masthead topbar footer bottombar copyright colophon complementary contentinfo search toolbar "
    "comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations widget widgets".split()
)
#: Words before a mark that make it tell of the page's layout: the element is not itself what is marked.
QUALIFIERS = frozenset("no non not without with has had hide hidden".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _is_marked(value: str) -> bool:
    for token in value.split():
        parts = [p.lower() for p in _PART.findall(token)]
        if any(p in MARKS and not QUALIFIERS.intersection(parts[:k]) for k, p in enumerate(parts)):
            return True
    return False


def _read(name: str, attributes: str) -> tuple[bool, bool, str]:
    """Whether an element is dropped, whether only for its marks, and its look: name, words of class, id and role, and where a link leads."""
    if not attributes:
        return name in DROPPED, False, name
    marked, words, leads = False, set(), ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            marked = marked or _is_marked(value)
            words.update(w.lower() for w in _PART.findall(value) if not w.isdigit())
        elif key == "href":
            leads = "@out" if "//" in value[:8] else "@in"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return name not in ("html", "body"), False, name
    look = f"{name}{leads}." + ".".join(sorted(words)) if words else name + leads
    if name in DROPPED or name in ("html", "body"):
        return name in DROPPED, False, look
    return marked, marked, look


def _is_article(name: str, attributes: str) -> bool:
    if name == "article":
        return True
    return "articlebody" in attributes.lower() if attributes and "=" in attributes else False


class _Node:
    __slots__ = ("name", "look", "drop", "marked", "article", "main", "items", "block")

    def __init__(self, name: str, drop: bool = False, marked: bool = False, look: str = "", article: bool = False, main: bool = False):
        self.name, self.look, self.drop, self.marked, self.article, self.main = name, look or name, drop, marked, article, main
        self.block = name in BLOCK
        self.items: list = []


class _Open:
    """The open elements, with the places of each name and of the blocks among them, so that no question needs a walk."""

    def __init__(self, root: _Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.block:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def top(self, names: frozenset | tuple[str, ...]) -> int:
        """Place of the last opened element of these names; 0 if there is none."""
        return max((at[-1] for n in names if (at := self.places.get(n))), default=0)

    def cut(self, place: int) -> None:
        """Close this element and all below it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.name].pop()
            if node.block:
                self.blocks.pop()

    def close(self, name: str) -> None:
        """An end tag: it closes the last element of its name, but one of an inline element does not reach beyond a block."""
        place = self.top((name,))
        if place and (name in BLOCK or not self.blocks or self.blocks[-1] < place):
            self.cut(place)


_P, _P_STOP = frozenset(["p"]), frozenset("table td th button object article section div body".split())


def parse(page: str) -> _Node:
    """A tree of elements and raw text; broken markup is mended the way browsers do in the common cases.

    Every character is looked at a fixed number of times, whatever the page: after
    the first tag whose quotes never close, tags end at the next ``>``.
    """
    root = _Node("#page")
    tree = _Open(root)
    stack = tree.stack
    at, end, quotes = 0, len(page), True
    while at < end:
        start = page.find("<", at)
        if start < 0:
            stack[-1].items.append(page[at:])
            break
        following = page[start + 1 : start + 2]
        closing = following == "/"
        m = _NAME.match(page, start + 1 + closing)
        if m is None and following not in ("!", "?", "/") or not following:
            # no markup: up to the next sign it is text
            more = page.find("<", start + 1)
            stack[-1].items.append(page[at : more if more > 0 else end])
            at = more if more > 0 else end
            continue
        if start > at:
            stack[-1].items.append(page[at:start])
        if m is None:
            comment = page.startswith("<!--", start)
            stop = page.find("-->", start + 2) if comment else page.find(">", start)
            if stop < 0 and not comment:
                stack[-1].items.append(page[start:])
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        stop = _ATTRIBUTES.match(page, m.end()).end() if quotes else end
        if stop == end or page[stop] != ">":
            quotes = False
            stop = page.find(">", m.end())
        if stop < 0:
            stack[-1].items.append(page[start:])
            break
        at = stop + 1
        name, attributes = m[0].lower(), page[m.end() : stop]
        if closing:
            if name == "p" and not tree.top(_P):
                stack[-1].items.append(_Node("p"))
            tree.close(name)
            continue
        if name in CLOSES_P and (place := tree.top(_P)) and place > tree.top(_P_STOP):
            tree.cut(place)
        if name in IMPLIED:
            names, stops = IMPLIED[name]
            while (place := tree.top(names)) and place > tree.top(stops):
                tree.cut(place)
        node = _Node(name, *_read(name, attributes), _is_article(name, attributes), name == "main" or 'role="main"' in attributes)
        stack[-1].items.append(node)
        if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            close = _RAW_END[name].search(page, at)
            node.items.append(page[at : close.start() if close else end])
            stop = page.find(">", close.end()) if close else -1
            at = end if stop < 0 else stop + 1
            continue
        tree.push(node)
    return root


def _text_of(raw: str) -> str:
    return html.unescape(raw) if "&" in raw else raw


#: Turns the key of a place that holds a host's text into that of the innermost such place.
INNERMOST = 0x5EED


def _host_key(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host) - (1 << 63)


def _key(host: str, kind: str, what: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}\0{kind}{what}") - (1 << 63)


def subtrees(root: _Node, host: str) -> Iterator[tuple[int, _Node]]:
    """Hash, with the host in it, and node of every block element that holds text, and last of the page.  Inline elements count as part of their block."""
    # children before parents, without recursion: nesting may be deep
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.items if isinstance(x, _Node))
    known: dict[int, tuple[str, bool]] = {}
    digest = xxhash.xxh3_64_hexdigest
    for node in reversed(order):
        parts, some = [node.name], False
        for x in node.items:
            if isinstance(x, str):
                words = " ".join(_text_of(x).split())
                if words:
                    parts.append("=" + words)
                    some = True
            else:
                below, texted = known[id(x)]
                parts.append(below)
                some = some or texted
        own = digest("\0".join(parts))
        known[id(node)] = own, some
        if node is root or some and node.block and node.name not in ("html", "body"):
            yield _key(host, "", own), node


def _sizes(root: _Node) -> dict[int, int]:
    """Characters of text in and below every element, by its id; style and script hold none."""
    order, parent, sizes = [root], [0], []
    for k, node in enumerate(order):  # grows while it is read
        own = 0
        if node.name not in RAW:
            for x in node.items:
                if isinstance(x, str):
                    own += len(x.strip())
                else:
                    order.append(x)
                    parent.append(k)
        sizes.append(own)
    for k in range(len(order) - 1, 0, -1):
        sizes[parent[k]] += sizes[k]
    return {id(node): size for node, size in zip(order, sizes, strict=True)}


def _shape(node: _Node, out: dict[int, str]) -> str:
    """Look of an element and of the kinds of elements below it; words, numbers of equal items and inline marks do not count.  ``out`` keeps what is known."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        if id(n) not in out:
            order.append(n)
            todo.extend(x for x in n.items if isinstance(x, _Node))
    for n in reversed(order):
        kinds = {"#" if isinstance(x, str) or not x.block and x.name not in ("a", "img", "input", "iframe", "video") else out[id(x)] for x in n.items}
        out[id(n)] = xxhash.xxh3_64_hexdigest("\0".join([n.look, *sorted(kinds)]))
    return out[id(node)]


def layout(root: _Node, host: str, contents: set[int] | frozenset | None = None) -> Iterator[tuple[str, int, int, _Node]]:
    """Kind, key, depth and node of the page's layout, from the top.

    ``holds`` are elements with at least half of the page's text, keyed by the
    looks on the way to them.  ``shape`` are blocks beside those that hold text,
    keyed by that way and their shape, but for headings.  Nothing is given from
    below the innermost element that holds half and of which there is no other
    beside it with the same look, as there is of paragraphs, or from below an
    article.  With the host's ``contents``, nothing is given from
    its innermost place or below, and no shape of an element whose look and way are
    those of an element around that place.
    """
    sizes, shapes = _sizes(root), {}
    total = sizes[id(root)]
    todo = [(x, "", 1, False) for x in root.items if isinstance(x, _Node)]
    while todo and total:
        node, way, depth, several = todo.pop()
        if not sizes.get(id(node)):
            continue
        way = xxhash.xxh3_64_hexdigest(f"{way}/{node.look}")
        place = _key(host, "^", way)
        looks = Counter(x.look for x in node.items if isinstance(x, _Node) and sizes.get(id(x)))
        below = [(x, way, depth + 1, looks[x.look] > 1) for x in node.items if isinstance(x, _Node)]
        if 2 * sizes[id(node)] >= total:
            if several:
                continue
            yield "holds", place, depth, node
            inner = any(2 * sizes.get(id(x), 0) >= total and not twin for x, _, _, twin in below)
            if not (node.article or node.main) and (place ^ INNERMOST not in contents if contents is not None else inner):
                todo.extend(below)
        elif contents is None or place ^ INNERMOST not in contents:
            if node.block and node.name not in HEADINGS and (contents is None or place not in contents):
                yield "shape", _key(host, "~", f"{way} {_shape(node, shapes)}"), depth, node
            todo.extend(below)


def template_nodes(root: _Node, host: str, wanted: set[int] | frozenset, exact: bool = True) -> frozenset[int]:
    """Ids of the page's nodes that are template: its exact subtrees, if the host has any, and its shapes outside the host's content."""
    if not wanted:
        return frozenset()
    out = {id(n) for k, n in subtrees(root, host) if k in wanted} if exact else set()
    return frozenset(out | {id(n) for kind, k, _, n in layout(root, host, wanted) if kind == "shape" and k in wanted})


def _lines(tops: list[_Node], deleted: set[int] | frozenset, rules: bool = True) -> str:
    """Text of the given elements, a line for every block."""
    lines: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        line = " ".join("".join(buffer).split())
        buffer.clear()
        if line:
            lines.append(line)

    for top in tops:
        todo: list = top.items[::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                buffer.append(_text_of(x))
            elif x is None:
                flush()
            elif id(x) in deleted or (x.drop if rules else x.name in RAW or x.name == "head"):
                if x.block:
                    flush()
            elif x.name in ("br", "wbr"):
                buffer.append(" " if x.name == "br" else "")
            else:
                if x.block:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.items))
        flush()
    return "\n".join(lines)


def rest_text(root: _Node, deleted: set[int] | frozenset) -> str:
    """All blocks outside head, styles, scripts and template nodes."""
    return _lines([root], deleted, rules=False)


def main_text(root: _Node, deleted: set[int] | frozenset = frozenset()) -> str:
    """Blocks of the article, one a line.  ``deleted`` holds the ids of template nodes.

    The article is the outermost <article> elements (or those marked as article
    body), else <main>, else the whole page.  Marks on such an element or around it
    give way where it holds more text than all that the marks leave.
    """

    def inside(test) -> tuple[list[_Node], list[_Node]]:
        """Outermost nodes of the test in the order of the page, and those of them that only marks drop."""
        got, behind, todo = [], [], [(root, 0)]
        while todo:
            node, marks = todo.pop()
            if node.drop and not node.marked or id(node) in deleted:
                continue
            marks += node.marked
            if not test(node):
                todo.extend((x, marks) for x in reversed(node.items) if isinstance(x, _Node))
            elif not (node.marked and marks > 1):
                # one that is marked below another mark, as a comment among comments, is not the article
                got.append(node)
                if marks:
                    behind.append(node)
        return got, behind

    articles, mains = inside(lambda n: n.article), inside(lambda n: n.main)
    plain = [[n for n in got if n not in behind] for got, behind in (articles, mains)]
    text = _lines(plain[0] or plain[1] or [root], deleted)
    for (got, behind), seen in zip((articles, mains), plain, strict=True):
        spared = [n for n in behind if len(_lines([n], deleted)) > len(text)]
        if spared:
            return _lines([n for n in got if n in seen or n in spared], deleted)
    return text


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host_key, kind, depth, subtree, page, words): subtrees and layout of every page, which is known by the hash of its whole tree.

    Subtree 0 stands for the page itself; ``words`` is the hash, with its words, of
    an element that holds half of the page's text, else 0.
    """
    for batch in batches:
        rows = []
        for host, page in dict.fromkeys(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            key = _host_key(host)
            root = parse(page or "")
            *below, (whole, _) = subtrees(root, host)
            exact = {id(n): k for k, n in below}
            own = {(0, 0, 0): 0} | {(1, 0, k): 0 for k in exact.values()}
            for kind, k, depth, n in layout(root, host):
                own.setdefault((3, depth, k) if kind == "holds" else (2, 0, k), exact.get(id(n), 0) if kind == "holds" else 0)
            rows += [(key, *x, whole, words) for x, words in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(6)], ["host_key", "kind", "depth", "subtree", "page", "words"])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host_key, kind, subtree): what recurs in many pages of a host, and where its content stands.

    Kind 1 are subtrees with their words.  Kind 2 are shapes, as of menus and
    footers whose words vary: the looks of the elements, of those around them and
    of their links.  As articles recur in shape too, shapes count only for hosts
    whose pages mostly hold their text in one place, with words that vary, and
    only outside it.  Kind 3 are the ways to that place, and the innermost one
    once more as kind 4; see ``layout``.

    Pages of equal structure and text count once, so copies of a page do not
    make it a template.  Pages without host are no site and have no templates.  A host has at most as many of them as its pages have subtrees on average,
    divided by ``min_share``.
    """
    hosted = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html")).filter("host != ''")
    found = hosted.mapInArrow(_found, "host_key long, kind long, depth long, subtree long, page long, words long").distinct()
    counts = found.groupBy("host_key", "kind", "depth", "subtree", "words").agg(F.count("*").alias("n")).groupBy("host_key", "kind", "depth", "subtree").agg(F.sum("n").alias("pages"), F.max("n").alias("alike"))
    many = settled(counts.filter(F.col("pages") >= min_pages))
    hosts = many.filter("kind = 0").select("host_key", F.col("pages").alias("host_pages"))
    most = many.filter("kind != 0").join(hosts, "host_key").filter(F.col("pages") >= min_share * F.col("host_pages"))
    # html and body have no hash of words and so are no place of content
    ways = most.filter("kind = 3")
    inner = ways.filter("2 * alike <= pages").groupBy("host_key").agg(F.max(F.struct("depth", "pages", "subtree")).alias("inner"))
    ways = ways.join(inner, "host_key")
    around = ways.filter("depth < inner.depth OR subtree = inner.subtree").select("host_key", F.lit(3).cast("long").alias("kind"), "subtree")
    place = inner.select("host_key", F.lit(4).cast("long").alias("kind"), F.col("inner.subtree").bitwiseXOR(F.lit(INNERMOST).cast("long")).alias("subtree"))
    shapes = most.filter("kind = 2").join(inner.select("host_key"), "host_key", "left_semi")
    return most.filter("kind = 1").unionByName(shapes).select("host_key", "kind", "subtree").unionByName(around).unionByName(place)


def extract(pages: DataFrame, carry: list[str] | None = None, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, rules: bool = True) -> DataFrame:
    """text and n_chars of every row, beside the ``carry`` columns (all but the page by default).

    Site templates are deleted first; then the rules on element names and marks
    choose among what is left.  Without ``rules`` only templates, styles and
    scripts go.

    Null or empty pages give an empty text; pages without host lose no templates.
    Rows stay as they are, repeated ones and equal ids included; carried
    columns named like a result are replaced; an empty table gives an empty
    result.  Whole pages are parsed, whatever their length.
    """
    names = ("text", "n_chars")
    carry = [c for c in ([x for x in pages.columns if x != html_col] if carry is None else carry) if c not in names]
    found = settled(templates(pages, url_col, html_col, min_pages, min_share))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    known, worded = frozenset(), frozenset()
    head = found.limit(BROADCAST_TEMPLATES + 1).collect()
    if len(head) <= BROADCAST_TEMPLATES:
        known, worded = frozenset(r.subtree for r in head), frozenset(r.host_key for r in head if r.kind == 1)
    else:
        by_host = found.groupBy("host_key").agg(F.collect_list("subtree").alias("subtrees"))
        keyed = rows.select("host").distinct().mapInArrow(_host_keys, "host string, host_key long").join(by_host, "host_key").select("host", "subtrees")
        rows = rows.join(settled(keyed), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            listed = batch.column(batch.schema.get_field_index("subtrees")).to_pylist() if "subtrees" in batch.schema.names else None
            hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
            for i, page in enumerate(batch.column(batch.schema.get_field_index("html")).to_pylist()):
                root = parse(page or "")
                wanted = known if listed is None else frozenset(listed[i] or ())
                exact = listed is not None or _host_key(hosts[i]) in worded
                deleted = template_nodes(root, hosts[i], wanted, exact)
                texts.append(main_text(root, deleted) if rules else rest_text(root, deleted))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", *names])

    schema = rows.select("row").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema).select("row.*", *names)


def _host_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_host_key, batch.column(0).to_pylist()), pa.int64())], ["host", "host_key"])
