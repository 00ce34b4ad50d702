"""Main text of web pages by wrapper induction over the pages of a host.

1. Pages are parsed into trees of elements; siblings with one label (tag and classes) are one
   node, so that paragraphs and list items of any number align.
2. Per task and host the trees are aligned into a wrapper by simple tree matching (the largest
   match of ordered children under equal roots); wrappers of tasks are aligned in turn, first
   within salted parts of a host. A wrapper holds one entry per node, however many pages.
3. A node whose text is the same on all pages is template; nodes whose text varies are slots.
   Menus, headers, footers, notices, adverts, forms, comments and scripts, known by element,
   role or class, are never content. The content is the article (else main) element; on hosts
   without one it is the smallest node that holds most of the varying text.
4. Each page is aligned with the wrapper of its host and its content slots are read out.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmark.llm._common import pieces, shuffle_parts, written
from rowmark.llm.url_filter import host_of

#: Distinct pages on which a node must be the same to be template within an article.
TEMPLATE_PAGES = 5
#: Share of the varying text that the content node of a host without article element must hold.
CONTENT_SHARE = 0.7
#: Levels of a wrapper; elements nested deeper count to the node at that level.
DEPTH = 100
_SALTS = 32

# Elements and class words of the HTML language and of common page designs.
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
_NEVER = frozenset(
    "head nav menu header footer aside form button select option svg canvas object audio video map dialog script style "
    "textarea title noscript iframe xmp noembed noframes template".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription popup modal overlay sidebar aside widget widgets related "
    "recommended recommendations share sharing social breadcrumb breadcrumbs menu menus navbar nav navigation topbar "
    "toolbar footer header masthead comment comments disqus replies respond pagination pager login signup skip".split()
)
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
#: What swallows the rest of a page without a `>`.
_UNCLOSED = re.compile(r"<[!?]")
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WHITE = re.compile(r"[\x20\x09-\x0D]+")

Path = tuple[str, ...]


def _cut_short(tag: str) -> bool:
    """Whether a comment or CDATA section was not closed."""
    if tag.startswith("<!--"):
        return len(tag) < 7 or not tag.endswith("-->")
    return tag.startswith("<![CDATA[") and not tag.endswith("]]>")


@dataclass(slots=True)
class Block:
    """Text of a block element: its path, whether it lies in an article (2) or main (1) element."""

    path: Path
    level: int
    heading: bool
    text: str
    linked: int = 0
    #: Numbers of the open elements with a class word, and of the article or main element.
    ruled: tuple[int, ...] = ()
    area: int | None = None


@dataclass(slots=True)
class _Open:
    tag: str
    path: Path
    never: bool
    level: int
    headings_only: bool
    heading: bool
    link: bool
    ruled: tuple[int, ...] = ()
    area: int | None = None


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def _never(attributes: dict[str, str]) -> bool:
    if attributes.get("role", "").lower() in _ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _class_word(attributes: dict[str, str]) -> bool:
    words = _WORD.findall(attributes.get("class", "") + " " + attributes.get("id", ""))
    return any(w.lower() in _CLASSES for w in words)


def _label(tag: str, attributes: dict[str, str]) -> str:
    classes = " ".join(sorted({w.lower() for w in _WORD.findall(attributes.get("class", ""))}))
    return f"{tag}.{classes}" if classes else tag


def blocks(page: str) -> list[Block]:
    """The texts of a page that may be content, in page order.

    Elements with a class word are left out, unless the word speaks of the layout: an article
    (or main) element with more text than all such elements without a class word is content,
    with those on its path; on pages without either, or if only headings of it would be left, an
    element that holds most of the text.
    """
    return _blocks(page, True) or _blocks(page, False)


def _weight(found: list[Block]) -> int:
    return sum(max(0, len(b.text) - b.linked) for b in found)


def _cleared(found: list[Block], areas: dict[int, tuple[Path, tuple[int, ...]]]) -> list[Block]:
    """Blocks without those under class words that do not speak of the layout."""
    if not any(b.ruled for b in found):
        return found
    fine: set[int] = set()
    inside: dict[int, list[Block]] = {}
    for block in found:
        if block.area is not None and block.ruled == areas[block.area][1]:
            inside.setdefault(block.area, []).append(block)
    named = {area: _weight(held) for area, held in inside.items() if areas[area][1]}
    plain = [b for b in found if not b.ruled]
    if named:
        best = max(named, key=lambda x: named[x])
        if named[best] > _weight([b for b in plain if b.level]):
            for path, ruled in areas.values():
                if path == areas[best][0]:
                    fine.update(ruled)
    kept = [b for b in found if fine.issuperset(b.ruled)]
    level = max((b.level for b in kept), default=0)
    rest = [b for b in kept if b.level == level and not (level and b.heading)]
    own: dict[tuple[int, ...], list[Block]] = {}
    for block in found:
        if block.level == level and not fine.issuperset(block.ruled):
            own.setdefault(block.ruled, []).append(block)
    if own and (not level or not _weight(rest)):  # of an article only headings are left
        best, held = max(own.items(), key=lambda x: _weight(x[1]))
        if _weight(held) >= CONTENT_SHARE * (_weight(held) + _weight(rest)):
            fine.update(best)
    return [b for b in found if fine.issuperset(b.ruled)]


def _blocks(page: str, inline_classes: bool) -> list[Block]:
    stack = [_Open("", (), False, 0, False, False, False)]
    out: list[Block] = []
    areas: dict[int, tuple[Path, tuple[int, ...]]] = {}
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = _WHITE.sub(" ", "".join(buffer)).strip(" ")
            if text:
                top = next((x for x in reversed(stack) if x.tag not in _INLINE), stack[0])
                out.append(Block(top.path, top.level, top.heading, text, linked, top.ruled, top.area))
            buffer.clear()
        linked = 0

    def close(at: int) -> None:
        if any(x.tag not in _INLINE for x in stack[at:]):
            flush()
        del stack[at:]

    def add(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if text and not top.never and not (top.headings_only and not top.heading):
            text = entities.unescape(text) if "&" in text else text
            buffer.append(text)
            if top.link:
                linked += len(text)

    position, lowered = 0, None
    closed = page.rfind(">") + 1  # no tag ends behind this: nothing there is searched for one
    while True:
        found = _TAG.search(page, position, closed) if position < closed else None
        if found is None:
            left = _UNCLOSED.search(page, position)
            add(page[position:] if left is None else page[position : left.start()])
            break
        if _cut_short(found[0]):  # a comment that goes on to the end of the page
            add(page[position : found.start()])
            break
        if found.start() > position:
            add(page[position : found.start()])
        position = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        tag, ends = name.lower(), (found[1] or found[4])
        if ends:
            for at in range(len(stack) - 1, 0, -1):
                if stack[at].tag == tag:
                    close(at)
                    break
                if tag in _INLINE and stack[at].tag not in _INLINE:
                    break
            continue
        if tag == "br":
            buffer.append(" ") if buffer else None
            continue
        if tag in _RAW:
            lowered = page.lower() if lowered is None else lowered
            end = _raw_end(page, lowered, tag, position)
            position = end
            continue
        inline = tag in _INLINE
        if not inline:
            _close_implied(stack, tag, close)
            flush()
        if tag in _VOID:
            continue
        top = stack[-1]
        rest = found[3] or found[6] or ""
        attributes = _attributes(rest) if rest and rest != "/" else {}
        level = top.level
        if not top.never:
            if tag == "article" or attributes.get("itemprop") == "articleBody":
                level = 2
            elif level < 1 and (tag == "main" or attributes.get("role") == "main"):
                level = 1
        inside_header = tag == "header" and level == 2
        never = top.never or (tag in _NEVER and not inside_header) or (bool(attributes) and not inside_header and _never(attributes))
        word = bool(attributes) and not inside_header and _class_word(attributes)
        if inline and inline_classes:
            never = never or word
        if tag in ("html", "body"):
            never = word = False
        path = top.path if inline or len(top.path) >= DEPTH else (*top.path, _label(tag, attributes))
        ruled = (*top.ruled, found.start()) if word and not inline and not never else top.ruled
        area = top.area
        if level > top.level:
            area = found.start()
            areas[area] = path, ruled
        stack.append(
            _Open(
                tag, path, never, level, top.headings_only or inside_header, top.heading or tag in _HEADINGS, top.link or tag == "a",
                ruled, area,
            )
        )
    flush()
    return _cleared(out, areas)


def _raw_end(page: str, lowered: str, tag: str, position: int) -> int:
    """Behind the end tag of an element whose content is no markup."""
    if len(lowered) != len(page):  # lower-casing changed the length: look again without it
        found = re.compile(f"</{tag}[^>]*>", re.I).search(page, position)
        return found.end() if found else len(page)
    at = lowered.find(f"</{tag}", position)
    if at < 0:
        return len(page)
    end = page.find(">", at)
    return len(page) if end < 0 else end + 1


def _close_implied(stack: list[_Open], tag: str, close) -> None:
    """End the elements that the start of a block ends: an open paragraph, list item, table cell."""
    for at in range(len(stack) - 1, 0, -1):
        if stack[at].tag == "p":
            close(at)
            break
        if stack[at].tag not in _INLINE:
            break
    if tag in _CLOSED_BY:
        ended, bounds = _CLOSED_BY[tag]
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in bounds:
                break
            if stack[at].tag in ended:
                close(at)
                break


@dataclass(slots=True)
class Node:
    """A node of a wrapper: pages with text here, smallest and largest text hash, characters.

    seen: the smallest hashes of distinct pages with text here, TEMPLATE_PAGES at most.
    """

    children: dict[str, Node] = field(default_factory=dict)
    pages: int = 0
    low: int = 0
    high: int = 0
    chars: int = 0
    linked: int = 0
    level: int = 0
    heading: bool = False
    seen: list[int] = field(default_factory=list)

    def count(self, low: int, high: int, pages: int, chars: int, linked: int, seen: list[int]) -> None:
        self.low = min(self.low, low) if self.pages else low
        self.high = max(self.high, high) if self.pages else high
        self.pages += pages
        self.chars += chars
        self.linked += linked
        if self.seen != seen:
            self.seen = sorted({*self.seen, *seen})[:TEMPLATE_PAGES]

    def varies(self) -> bool:
        return self.low != self.high or len(self.seen) == 1

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


def tree_of(found: list[Block]) -> Node:
    """A page as a wrapper of its own."""
    import xxhash

    def hashed(text: str) -> int:
        return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1

    root, texts = Node(), {}
    page = hashed("\n".join(b.text for b in found))
    for block in found:
        entry = texts.setdefault(block.path, [[], 0, block.level, block.heading])
        entry[0].append(block.text)
        entry[1] += block.linked
    for path, (parts, linked, level, heading) in texts.items():
        node = root
        for label in path:
            node = node.children.setdefault(label, Node())
        text = " ".join(parts)
        key = hashed(text)
        node.count(key, key, 1, len(text), linked, [page])
        node.level, node.heading = level, heading
    return root


def matching(a: Node, b: Node) -> tuple[float, list[tuple[str, str]]]:
    """Simple tree matching of two nodes: its size, and the matched pairs of children.

    Children match in order if their labels are equal, or for half if only their elements are.
    """
    left, right = list(a.children), list(b.children)
    if left == right:
        return 1 + sum(matching(a.children[x], b.children[x])[0] for x in left), [(x, x) for x in left]
    weight = [[_likeness(a, b, x, y) for y in right] for x in left]
    best = [[0.0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(1, len(left) + 1):
        for j in range(1, len(right) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + weight[i - 1][j - 1])
    pairs, i, j = [], len(left), len(right)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((left[i - 1], right[j - 1]))
            i, j = i - 1, j - 1
    return best[-1][-1] + 1, pairs[::-1]


def _likeness(a: Node, b: Node, x: str, y: str) -> float:
    if x.partition(".")[0] != y.partition(".")[0] or (x != y and (x in b.children or y in a.children)):
        return 0
    return (1 if x == y else 0.5) * matching(a.children[x], b.children[y])[0]


def absorb(wrapper: Node, other: Node) -> Node:
    """Align another tree with the wrapper and add its counts; nodes without a match are added."""
    if other.pages:
        wrapper.count(other.low, other.high, other.pages, other.chars, other.linked, other.seen)
        wrapper.level, wrapper.heading = max(wrapper.level, other.level), wrapper.heading or other.heading
    matched = {y: x for x, y in matching(wrapper, other)[1]}
    for label, child in other.children.items():
        name = matched.get(label, label)
        absorb(wrapper.children[name], child) if name in wrapper.children else wrapper.children.setdefault(name, child)
    return wrapper


def to_json(node: Node) -> list:
    numbers = [node.pages, node.low, node.high, node.chars, node.linked, node.level, int(node.heading), *node.seen]
    return [numbers, {k: to_json(c) for k, c in node.children.items()}]


def from_json(value: list) -> Node:
    pages, low, high, chars, linked, level, heading, *seen = value[0]
    return Node({k: from_json(c) for k, c in value[1].items()}, pages, low, high, chars, linked, level, bool(heading), seen)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host and batch."""
    for batch in batches:
        wrappers: dict[str, Node] = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if host:
                tree = tree_of(blocks(page or ""))
                wrappers[host] = absorb(wrappers[host], tree) if host in wrappers else tree
        yield _rows(wrappers)


def _rows(wrappers: dict[str, Node]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(wrappers), pa.string()), pa.array([json.dumps(to_json(w)) for w in wrappers.values()], pa.string())],
        names=["host", "wrapper"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of one host, which lie together and sorted, into one."""
    host, wrapper = None, None
    for batch in batches:
        for name, value in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            node = from_json(json.loads(value))
            if name != host:
                if wrapper is not None:
                    yield _rows({host: wrapper})
                host, wrapper = name, node
            else:
                absorb(wrapper, node)
    if wrapper is not None:
        yield _rows({host: wrapper})


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from all pages (host, html)."""
    parts = shuffle_parts(pages.sparkSession)
    ddl = "host string, wrapper string"
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(_SALTS)).alias("salt")
    first = pages.select("host", "html").mapInArrow(_partial, ddl)
    salted = first.select("host", "wrapper", salt).repartition(parts, "host", "salt").sortWithinPartitions("host", "salt")
    merged = salted.select("host", "wrapper").mapInArrow(_merge, ddl)
    return merged.repartition(parts, "host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge, ddl)


def _varying(node: Node) -> int:
    own = node.chars - node.linked if node.pages and node.varies() else 0
    return max(0, own) + sum(_varying(c) for c in node.children.values())


class Reader:
    """Reads pages of one host by its wrapper."""

    def __init__(self, wrapper: Node | None):
        self.wrapper = wrapper
        self.places: dict[Path, tuple[Node, Path] | None] = {}
        self.region: Path = ()
        if wrapper is not None:
            node, total = wrapper, _varying(wrapper)
            while total:
                label, child = max(((k, c) for k, c in node.children.items()), key=lambda x: _varying(x[1]), default=("", None))
                if child is None or _varying(child) < CONTENT_SHARE * total:
                    break
                node, self.region = child, (*self.region, label)

    def place(self, path: Path, tree: Node) -> tuple[Node, Path] | None:
        """The wrapper's node for a path of a page, by aligning the page's tree."""
        wrapper, mine, names = self.wrapper, tree, []
        for label in path:
            name = {y: x for x, y in matching(wrapper, mine)[1]}.get(label, label)
            if name not in wrapper.children:
                return None
            wrapper, mine = wrapper.children[name], mine.children[label]
            names.append(name)
        return wrapper, tuple(names)

    def text(self, page: str) -> str:
        found = blocks(page)
        level = max((b.level for b in found), default=0)
        kept = [b for b in found if b.level == level]
        if self.wrapper is None or self.wrapper.size() == 1:
            return " ".join(b.text for b in kept)
        tree, out = None, []
        for block in kept:
            at = self.places.get(block.path)
            if at is None and block.path not in self.places:
                tree = tree or tree_of(found)
                at = self.places[block.path] = self.place(block.path, tree)
            if level:
                constant = at and not block.heading and len(at[0].seen) >= TEMPLATE_PAGES and not at[0].varies()
                if not (constant and self.region_varies()):
                    out.append(block.text)
            elif at is None or (at[1][: len(self.region)] == self.region and (at[0].varies() or not self.region_varies())):
                out.append(block.text)
        return " ".join(out)

    def region_varies(self) -> bool:
        if not hasattr(self, "_varies"):
            self._varies = _varying(self.wrapper) > 0
        return self._varies


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    readers: dict[str | None, Reader] = {}
    for batch in pieces(batches, "html"):
        texts = []
        columns = (batch.column(c).to_pylist() for c in ("host", "html", "wrapper"))
        for host, page, wrapper in zip(*columns, strict=True):
            reader = readers.get(host)
            if reader is None:
                if len(readers) > 256:
                    readers.clear()
                reader = readers[host] = Reader(from_json(json.loads(wrapper)) if wrapper else None)
            texts.append(reader.text(page or ""))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            schema=_TEXTS,
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Character references are decoded, white space (blank, tab to carriage return) within a block
    is one blank, blocks are joined by one blank. Null, empty and text-free html gives the empty
    text. Pages without a host are read by themselves, without a wrapper. Repeated pages are
    read each. An empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host_of(F.col("url").cast("string")).alias("host")
    )
    wrappers = written(induce(rows))
    return (
        rows.join(wrappers, "host", "left")
        .select("page_id", "url", "html", "host", "wrapper")
        .mapInArrow(_read, "page_id long, url string, text string, n_chars long")
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
