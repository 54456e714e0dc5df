"""HTML extraction by wrapper induction: DOM trees of same-host pages are aligned by simple tree matching."""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import lean, named, slices, written

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|<(?P<broken>/?[A-Za-z][^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z0-9]+")

# Fixed values of HTML: elements without content, with raw text, and those that end an open one of the same group.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: Elements, roles and words of class or id that name a part which is no article text.
DROP_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas dialog menu title audio video map xmp noembed noframes".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar tablist".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer comment comments commentlist reply replies respond disqus discussion share sharing social related recommended widget pagination pager toolbar skip".split()
)
MAIN_WORDS = frozenset("article content main post entry story body text".split())


class Node:
    __slots__ = ("children", "drop", "index", "main", "parent", "shape", "size", "tag", "text")

    def __init__(self, tag: str, attrs: str = "", parent: "Node | None" = None):
        self.tag, self.children, self.text, self.parent = tag, [], "", parent
        self.drop, self.main = _roles(tag, attrs) if attrs else (tag in DROP_TAGS, tag in ("article", "main"))


def _roles(tag: str, attrs: str) -> tuple[bool, bool]:
    drop, main = tag in DROP_TAGS, tag in ("article", "main")
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words = _TOKEN.findall(value)
            drop |= tag not in ("html", "body", "article", "main") and not DROP_WORDS.isdisjoint(words)
            drop |= tag in ("article", "main") and not {"comment", "comments", "ad", "ads", "advert", "sponsored", "related"}.isdisjoint(words)
            main |= tag in ("div", "section") and bool(words) and MAIN_WORDS.issuperset(words)
        elif name == "role":
            drop |= value in DROP_ROLES
            main |= value in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            drop = True
    return drop, main


def parse(source: str) -> Node:
    """The tree of a page. Text nodes are children of tag ``#``; unclosed and misnested tags end as HTML has it, a tag
    cut off by the end of the page is dropped."""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)

    def add(text: str) -> None:
        if text:
            node = Node("#", parent=stack[-1])
            node.text = html.unescape(text) if "&" in text else text
            stack[-1].children.append(node)

    while at < n:
        m = _MARKUP.search(source, at)
        if not m:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        if m["cdata"]:
            add(m["cdata"])
        tag = m["tag"]
        if not tag and m["broken"]:
            tag = re.match(r"/?([^\s/>]*)", m["broken"])[1]
        if not tag or (at == n and not m[0].endswith(">")):
            continue
        tag = tag.lower()
        if m["close"] or (m["broken"] or "").startswith("/"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES[tag]:
                    break
        node = Node(tag, m["attrs"] or "", stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            inner = source[at : end.start()] if end else source[at:]
            at = end.start() if end else n
            if inner and tag in ("textarea", "title"):
                text = Node("#", parent=node)
                text.text = html.unescape(inner)
                node.children.append(text)
            if end:
                stack.append(node)
        elif tag not in VOID and not (m["attrs"] or "").endswith("/"):
            stack.append(node)
    return root


def annotate(root: Node, shapes: dict) -> list[Node]:
    """Number the nodes in page order and give each the size of its subtree and a number for its shape."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.index = len(order)
        order.append(node)
        todo.extend(reversed(node.children))
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.shape = shapes.setdefault((node.tag, *(c.shape for c in node.children)), len(shapes))
    return order


def align(a: Node, b: Node, known: dict) -> list[tuple[Node, Node]]:
    """The pairs of a largest top-down, order-keeping match of two trees (simple tree matching)."""
    sys.setrecursionlimit(1_000_000)  # a page may be nested however deep
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if x.shape == y.shape:
            todo.extend(zip(x.children, y.children))
            continue
        left, right = x.children, y.children
        at, to, other = 0, len(left), len(right)  # what both have alike at their beginnings and ends is paired without a table
        while at < min(to, other) and left[at].shape == right[at].shape:
            todo.append((left[at], right[at]))
            at += 1
        while to > at and other > at and left[to - 1].shape == right[other - 1].shape:
            to, other = to - 1, other - 1
            todo.append((left[to], right[other]))
        if to > at and other > at:
            todo.extend(_best_children(left[at:to], right[at:other], known))
    return pairs


def _weight(x: Node, y: Node, known: dict) -> int:
    """How many nodes the best match of two trees pairs; by shape, so equal subtrees are matched once."""
    if x.tag != y.tag:
        return 0
    if x.shape == y.shape:
        return x.size
    key = (x.shape, y.shape)
    if key not in known:
        known[key] = 1 + (_table(x.children, y.children, known)[-1][-1] if x.children and y.children else 0)
    return known[key]


def _table(left: list[Node], right: list[Node], known: dict) -> list[list[int]]:
    rows = [[0] * (len(right) + 1)]
    for x in left:
        above, row = rows[-1], [0]
        for j, y in enumerate(right):
            w = _weight(x, y, known)
            row.append(max(row[j], above[j + 1], above[j] + w) if w else max(row[j], above[j + 1]))
        rows.append(row)
    return rows


def _best_children(left: list[Node], right: list[Node], known: dict) -> list[tuple[Node, Node]]:
    rows = _table(left, right, known)
    i, j, pairs = len(left), len(right), []
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((left[i], right[j]))
    return pairs


MIN_PAGES = 4  # different pages a template is induced from at least
CONSTANT_SHARE = 0.5  # of a slot's pages, from which its text is template


#: Elements whose text no page shows.
HIDDEN = RAW | frozenset("head noscript template".split())
LINK_SHARE = 0.7  # of a slot's text over all pages, from which it is a list of links


@dataclass
class Slots:
    """What the wrapper says of one page: its text nodes that are template, the element in the slot where the content of the
    host's pages lies (None where no slot stands out), and the elements in slots that hold links."""

    template: set[int]
    content: Node | None = None
    links: set[int] = field(default_factory=set)


def _amounts(order: list[Node], template: set[int]) -> tuple[list[int], list[int]]:
    """Characters of varying text below each node of a page, outside links and in them."""
    plain, linked, inside = [0] * len(order), [0] * len(order), [False] * len(order)
    for x in order:
        inside[x.index] = x.tag == "a" or (x.parent is not None and inside[x.parent.index])
    for x in reversed(order):
        if x.tag == "#" and x.index not in template:
            (linked if inside[x.index] else plain)[x.index] = len(x.text.strip())
        if x.tag in HIDDEN:
            plain[x.index] = linked[x.index] = 0
        if x.parent is not None:
            plain[x.parent.index] += plain[x.index]
            linked[x.parent.index] += linked[x.index]
    return plain, linked


def _holds_blocks(x: Node) -> bool:
    return any(c.tag != "#" and c.tag not in INLINE for c in x.children)


def _content_slot(wrapper: Node, plain: Counter) -> int | None:
    """The slot where most text lies: from the root on, the child that holds blocks and at least half of what is there."""
    x, found = wrapper, None
    while True:
        best = max((c for c in x.children if _holds_blocks(c) and c.tag not in HIDDEN), key=lambda c: (plain[c.index], -c.index), default=None)
        if best is None or not plain[best.index] or 2 * plain[best.index] < plain[x.index]:
            return found
        x, found = best, best.index


def induce(trees: list[Node], shapes: dict) -> list[Slots]:
    """For each page of a host what its slots are.

    The page of middle size is the wrapper; every other is aligned with it. A slot of the wrapper whose text is the
    same on more than ``CONSTANT_SHARE`` of the different pages is constant, and the nodes that hold that text there
    are template. Of what varies, the amounts of text and of linked text in each slot, summed over the different pages, say
    where the content lies and which slots only link. Fewer than ``MIN_PAGES`` different pages say nothing.
    """
    orders = [annotate(t, shapes) for t in trees]
    distinct: dict[tuple, int] = {}
    for k, order in enumerate(orders):
        distinct.setdefault(tuple(n.text for n in order if n.text), k)
    if len(distinct) < MIN_PAGES:
        return [Slots(set()) for _ in trees]
    by_size = sorted(distinct.values(), key=lambda k: (len(orders[k]), k))
    wrapper, known = trees[by_size[len(by_size) // 2]], {}
    pairs = [align(wrapper, t, known) for t in trees]
    aligned = [[(x.index, y.index, " ".join(y.text.split())) for x, y in p if y.tag == "#"] for p in pairs]
    seen: dict[int, Counter] = {}
    for k in distinct.values():
        for slot, _, text in aligned[k]:
            seen.setdefault(slot, Counter())[text] += 1
    constant = {(slot, text) for slot, texts in seen.items() for text, n in texts.items() if n > CONSTANT_SHARE * len(distinct) and n >= MIN_PAGES}
    out = [Slots({index for slot, index, text in row if (slot, text) in constant}) for row in aligned]
    plain, linked, pages = Counter(), Counter(), Counter()
    for k in distinct.values():
        p, q = _amounts(orders[k], out[k].template)
        for x, y in pairs[k]:
            plain[x.index] += p[y.index]
            linked[x.index] += q[y.index]
            pages[x.index] += 1
    content = _content_slot(wrapper, plain)
    linking = {s for s, n in pages.items() if n >= MIN_PAGES and linked[s] > LINK_SHARE * (linked[s] + plain[s])}
    for slots, row in zip(out, pairs):
        slots.content = next((y for x, y in row if x.index == content), None)
        slots.links = {y.index for x, y in row if x.index in linking and _holds_blocks(y)}
    return out


def _varying(node: Node, template: set[int]) -> int:
    """Characters of varying text under a node, outside parts that are furniture by name."""
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        if not x.drop:
            total += len(x.text.strip()) if x.tag == "#" and x.index not in template else 0
            todo.extend(x.children)
    return total


def _regions(root: Node, template: set[int]) -> list[Node]:
    """Where the varying text lies, in page order. Named regions (article, main, a container called so) are evidence: the
    article with the most varying text and its sibling articles are it, or main where it has more than twice their
    varying text. Where these hold less than half of the page's varying text, or none is named, it is the whole page."""
    found, todo = [], [(root, None)]
    while todo:
        x, above = todo.pop()
        if x.drop:
            continue
        if x.main:
            found.append((x, above))
        todo.extend((c, x) for c in reversed(x.children))
    pick = lambda pairs: max(pairs, key=lambda p: _varying(p[0], template), default=None)
    article, main = (pick([p for p in found if p[0].tag == tag]) for tag in ("article", "main"))
    articles = [x for x, above in found if article and x.tag == "article" and above is article[1]]
    of = lambda nodes: sum(_varying(x, template) for x in nodes)
    best = pick(found)
    chosen = [main[0]] if main and of([main[0]]) > 2 * of(articles) else articles or ([best[0]] if best else [])
    return chosen if chosen and 2 * of(chosen) >= of([root]) else [root]


def _within(x: Node | None, nodes: list[Node]) -> bool:
    while x is not None:
        if any(x is n for n in nodes):
            return True
        x = x.parent
    return False


def _chosen(root: Node, slots: Slots, names: bool) -> list[Node]:
    """The regions of the article: the content's slot; where names show a region too, of one inside the other the named one,
    of two that lie apart the one with more varying text."""
    if not names:
        return [slots.content or root]
    named_ = _regions(root, slots.template)
    if slots.content is None or slots.content.drop:
        return named_
    if named_ == [root]:
        return [slots.content]
    apart = not _within(slots.content, named_) and not any(_within(x, [slots.content]) for x in named_)
    more = apart and _varying(slots.content, slots.template) > sum(_varying(x, slots.template) for x in named_)
    return [slots.content] if more else named_


def article_text(root: Node, slots: Slots, names: bool = True) -> str:
    """The blocks of the article, joined by blank lines: the varying text of the regions where it lies, without the slots that
    only link. With ``names`` parts whose element, role, class or id names a menu, header, footer, sidebar, notice, advert,
    form, script or reader comments are left out too."""
    template, regions = slots.template, _chosen(root, slots, names)
    left_out = (lambda x: x.drop or (x.tag == "header" and regions == [root])) if names else (lambda x: x.tag in HIDDEN)
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append(text)

    todo: list = list(reversed(regions))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif x.tag == "#":
            if x.index not in template:
                parts.append(x.text)
        elif x.tag == "br":
            parts.append(" ")
        elif not left_out(x) and x.index not in slots.links:
            if x.tag not in INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return "\n\n".join(blocks)


GROUP_BYTES = 32 << 20  # of pages that a task aligns at once; a group with more, of repeated or very long pages, goes in parts
BROADCAST_HOSTS = 200_000  # of more than one group; beyond that their sizes are joined by a shuffle


def extract(pages: DataFrame, *, group_pages: int = 32, names: bool = True, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Extract the main text of every page (page_id, url, html): page_id, url, text, n_chars (code points).

    Pages of a host are dealt by hash to groups of about ``group_pages``, so that a host of any size spreads over many
    tasks, and each group induces its wrapper. The host is what stands between ``//`` and the next ``/``, ``?`` or
    ``#`` of the url, in lower case; pages without one share a host of their own. A null or empty html gives an empty
    text. Repeated rows are extracted one by one and count once for the template; an empty table gives no rows. Without
    ``names`` the wrapper's slots alone decide.
    """
    p = pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url"), F.coalesce(named(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^/?#]*//([^/?#]*)", 1)))
    large = written(p.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") > group_pages), "hosts")
    sizes = F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large
    salt = F.pmod(F.xxhash64("page_id", "html"), F.ceil(F.coalesce("pages", F.lit(1)) / F.lit(group_pages)))
    # one key of both: a grouping by host and salt would keep the join's partitions by host, and a large host one task
    dealt = p.join(sizes, "host", "left").withColumn("group", F.concat_ws("/", salt.cast("string"), "host"))

    def texts_of(group: pa.Table) -> pa.RecordBatch:
        group = group.sort_by([("page_id", "ascending"), ("url", "ascending")])
        trees = [parse(x) for x in group.column("html").to_pylist()]
        texts = [article_text(t, s, names) for t, s in zip(trees, induce(trees, {}))]
        return pa.RecordBatch.from_arrays([group.column("page_id").combine_chunks(), group.column("url").combine_chunks(), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in slices(batches, 4 * group_pages, GROUP_BYTES, "html"):
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= 4 * group_pages or size >= GROUP_BYTES:
                yield texts_of(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
        if held:
            yield texts_of(pa.Table.from_batches(held))

    return dealt.select("group", "page_id", "url", "html").groupBy("group").applyInArrow(lean(run), "page_id long, url string, text string, n_chars long")
