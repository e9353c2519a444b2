"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that is theirs and not links or boilerplate; the page votes for the
path of its best container, the deepest one that holds all of that text, a path being tags with generalised classes (digits out, sorted). Votes are counted per host, and
each page is read again with its host's winning path. A page without that path falls back on its own best
container.

Defined results: null or empty html, and html without content, give an empty text; unclosed and stray tags
are tolerated as browsers do; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fresh, scratch, small_batches
from .url_filter import split_url

BROADCAST_ROWS = 20_000  # winning paths (at most MAX_PATH characters each) up to which the join is a broadcast one
MAX_PATH = 400  # longer paths end in a digest of the whole

# Fixed values of the HTML standard: elements without content, with raw text, other elements whose content is no text of the page, those
# among them that may close themselves, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe".split())
APART = frozenset("template object svg math select button canvas audio video".split())
FOREIGN = frozenset("svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body html blockquote".split())
HEADINGS, TITLE = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(["h1"])
# What an opening tag closes, up to the given scope.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "option": ("option", "select"),
}
# Boilerplate: by tag; and less surely by form or by a class, id or role all of whose words are BOILER_WORDS or PLAIN_WORDS, with one of the former,
# or whose last word is one of LAST_WORDS, if none of STATE_WORDS, which describe a page, is among them.
BOILER_TAGS = frozenset("nav aside footer menu dialog".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo cookie cookies "
    "copyright disqus footer gdpr header login masthead menu menus nav navbar navigation newsletter notice notices paywall popup promo promos promoted "
    "recommended related replies respond rss search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe toolbar "
    "widget widgets".split()
)
PLAIN_WORDS = frozenset(
    "area articles author bar block body bottom box button buttons col column container content desktop entry form global group icons inner item items law left "
    "legal link links list main meta mobile modal outer overlay page panel policy post posts primary reader readers right secondary section site slot sticky "
    "stories story thread top unit user users wrap wrapper".split()
)
LAST_WORDS = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comments consent copyright disqus footer nav navbar navigation newsletter notice notices paywall "
    "promo promos sidebar sidebars".split()
)
STATE_WORDS = frozenset("allow closed disabled enabled has have hide is no non not open show with without".split())
PART_WORDS = frozenset("block box content entry item main page panel post section story".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>|[^>]*>)|[^<]+|<", re.S
)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?=;|$)", re.I)


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    path: str
    parent: Node | None
    sure: bool  # boilerplate by tag or hidden, or below such an element
    doubt: bool = False  # boilerplate if it is a small part of the page and holds no article
    inside: bool = False  # it is, or is below, an article or main element
    boiler: bool = False
    mark: bool = False  # scratch of one walk over the nodes
    holds: bool = False  # an article or main element
    mass: int = 0  # characters below that are not surely boilerplate, without links
    chars: int = 0  # of content below
    children: list = field(default_factory=list)


class Block(NamedTuple):
    text: str
    node: Node
    home: Node  # the container that holds it
    weight: int  # characters outside links


def _attributes(attrs: str) -> dict[str, str]:
    """Values by name in lower case; of several with one name the first counts, as in browsers."""
    found: dict[str, str] = {}
    for name, *values in ATTR.findall(attrs):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _hidden(named: dict[str, str]) -> bool:
    """By the attribute hidden (until-found is text that can be found), a style of its own, or aria-hidden."""
    bare = "hidden" in named and named["hidden"].strip().lower() != "until-found"
    return bare or named.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN.search(named.get("style", "")))


def _label(named: dict[str, str]) -> str:
    """Generalised class for the path."""
    classes = {re.sub(r"\d+", "", c.lower()) for c in named.get("class", "").split()}
    return ".".join(sorted(c for c in classes if c))


def _bounded(path: str) -> str:
    """A parent's digest is part of its children's paths, so it stands for all that is above."""
    if len(path) <= MAX_PATH:
        return path
    digest = blake2b(path.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    return f"{path[: MAX_PATH - len(digest) - 1]}#{digest}"


def _doubtful(named: dict[str, str], inside: bool) -> bool:
    """inside: of an article or main element, where a header is no boilerplate; nor is the header of a part of the page."""
    for token in " ".join(named.get(name, "") for name in ("class", "id", "role")).split():
        named_by = re.findall(r"[^\W\d_]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
        words = set(named_by)
        if "header" in words and (inside or words & PART_WORDS):
            continue
        if words & BOILER_WORDS and words <= BOILER_WORDS | PLAIN_WORDS:
            return True
        if named_by and named_by[-1] in LAST_WORDS and not words & STATE_WORDS:
            return True
    return False


def parse(html: str) -> tuple[list[Node], list[Block]]:
    """The nodes, parents first, and the blocks of content in page order. If all would be boilerplate, what is so by words alone counts
    as content, and if nothing is left even so, everything. Time is linear in the page, but for elements that are closed
    across many open ones."""
    root = node = Node("html", "html", None, False)
    nodes, blocks = [root], []
    is_open: Counter[str] = Counter()  # elements of each tag that are open
    last_end: dict[str, int] = {}  # where the last end tag of an element without text begins
    buffer: list[str] = []
    link = 0  # how deep in links
    linked = 0
    pos, size = 0, len(html)
    last_close = html.rfind(">")

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                home = node
                while home.tag not in CONTAINERS and home.parent:
                    home = home.parent
                blocks.append(Block(text, node, home, max(0, len(text) - linked)))
        linked = 0

    def leave(to: Node) -> None:
        nonlocal node, link
        while node is not to:
            is_open[node.tag] -= 1
            node = node.parent
        link = 0

    while pos < size:
        if pos > last_close:  # no tag ends any more
            rest = html[pos:]
            buffer.append(rest[: rest.find("<!--")] if "<!--" in rest else rest)
            break
        m = TOKEN.match(html, pos)
        pos = m.end()
        tag = m["tag"]
        if tag is None:
            text = m[0]
            if not text.startswith("<") or text == "<":
                buffer.append(text)
                if link:
                    linked += len(text.strip())
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag == "br":
                buffer.append(" ")
            elif tag in BLOCKS:
                if is_open[tag]:
                    flush()
                    up = node
                    while up.tag != tag:
                        up = up.parent
                    leave(up.parent)
                elif tag == "p":
                    flush()
            continue
        attrs = m["attrs"]
        if tag in RAW or tag in APART:
            if tag in FOREIGN and attrs.endswith("/>"):
                continue
            if tag not in last_end:
                ends = [e.start() for e in re.finditer(rf"</{tag}\s*>", html, re.I)]
                last_end[tag] = ends[-1] if ends else -1
            if last_end[tag] >= pos:
                pos = re.compile(rf"</{tag}\s*>", re.I).search(html, pos).end()
            elif tag in RAW:
                pos = size  # as browsers do
            continue
        if tag in VOID:
            if tag == "br" or tag == "wbr":
                buffer.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag == "a":
            link += 1
        if tag not in BLOCKS:
            continue
        flush()
        if tag == "html" or (tag == "body" and is_open[tag]):
            continue
        inner, scope = CLOSES.get(tag, ("p", ""))
        inner = {*inner.split(), "p"}
        if any(is_open[t] for t in inner):
            stop = set(scope.split()) | CONTAINERS
            up, shut = node, None
            while up.parent and up.tag not in stop:
                if up.tag in inner:
                    shut = up
                up = up.parent
            if up.parent and up.tag in inner:
                shut = up
            if shut:
                leave(shut.parent)
        named = _attributes(attrs) if len(attrs) > 1 else {}
        label = _label(named)
        inside = node.inside
        sure = node.sure or tag in BOILER_TAGS or (tag != "body" and _hidden(named)) or (tag == "header" and not inside)
        sure = sure or (tag == "form" and node.tag not in ("html", "body"))  # below body it may wrap the page
        doubtful = bool(named) and _doubtful(named, inside)
        if not sure and (tag == "main" or (tag == "article" and not doubtful)):
            up = node
            while up and not up.holds:
                up.holds = True
                up = up.parent
        doubt = tag == "form" or (doubtful and tag not in ("body", "article", "main"))
        path = _bounded(f"{node.path}/{tag}" + (f".{label}" if label else ""))
        node = Node(tag, path, node, sure, doubt, inside or tag in ("article", "main"))
        is_open[tag] += 1
        node.parent.children.append(node)
        nodes.append(node)
    flush()
    return nodes, _content(nodes, blocks)


def _content(nodes: list[Node], blocks: list[Block]) -> list[Block]:
    """The blocks that are no boilerplate; marks the nodes that are, and sums up the characters of the others."""
    for b in blocks:
        if not b.node.sure:
            b.node.mass += b.weight
    for n in reversed(nodes[1:]):
        n.parent.mass += n.mass
    root = nodes[0]
    tests = (
        lambda n: n.sure or (n.doubt and not n.holds and n.mass * 2 <= root.mass),
        lambda n: n.sure,
        lambda n: False,
    )
    kept: list[Block] = []
    for boiler in tests:
        for n in nodes:  # parents come first
            n.boiler = boiler(n) or bool(n.parent and n.parent.boiler)
        if kept := [b for b in blocks if not b.node.boiler]:
            break
    for b in kept:
        b.home.chars += b.weight
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
    return kept


def _mark_below(nodes: list[Node], tops: Callable[[Node], bool]) -> None:
    """Marks the nodes that tops() picks, and all below them."""
    for n in nodes:
        n.mark = tops(n) or bool(n.parent and n.parent.mark)


def _up(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def _deepest(node: Node) -> Node:
    """The deepest container below node with all of its content."""
    while whole := [c for c in node.children if c.chars and c.chars == node.chars]:
        node = whole[0]
    while node.tag not in CONTAINERS and node.parent:
        node = node.parent
    return node


def best_container(nodes: list[Node], blocks: list[Block]) -> Node:
    """The deepest container with all content of the main element, if there is one with a third of the text, or else of the page.
    If that is the page itself, labels of one or two words in containers of their own don't count."""
    root = nodes[0]
    _mark_below(nodes, lambda n: n.tag == "main" and n.chars > 0)
    mains = [n for n in nodes if n.mark and not n.parent.mark]
    if len(mains) == 1 and mains[0].chars * 3 >= root.chars:
        return _deepest(mains[0])
    node = _deepest(root)
    if node.tag in ("html", "body"):
        for child in node.children:
            if child.chars * 10 >= node.chars * 8 and child.chars:
                _mark_below(nodes, lambda n: n is child)
                rest = [b for b in blocks if b.weight and not b.home.mark]
                if all(b.home is not node and len(b.text.split()) <= 2 and not _within(b.node, HEADINGS) for b in rest):
                    return _deepest(child)
    return node


def _within(node: Node, tags: frozenset[str]) -> bool:
    """Whether node is, or is in, one of these elements, up to its container."""
    while node.tag not in tags:
        if node.tag in CONTAINERS or not node.parent:
            return False
        node = node.parent
    return True


def vote(html: str | None) -> tuple[str, int] | None:
    nodes, blocks = parse(html or "")
    if not blocks:
        return None
    best = best_container(nodes, blocks)
    return best.path, best.chars


def extract(html: str | None, path: str | None) -> str:
    """Blocks below the elements with this path, or below the page's own best container. Of the rest of the page, the
    first-order headings and what stands directly in an ancestor of these elements belong to the article too, unless it is links."""
    nodes, blocks = parse(html or "")
    if not blocks:
        return ""
    chosen: Callable[[Node], bool] = lambda n: n.path == path
    _mark_below(nodes, chosen)
    if not path or not any(b.home.mark for b in blocks):
        best = best_container(nodes, blocks)
        chosen = lambda n: n is best
        _mark_below(nodes, chosen)
    above: set[int] = set()
    for b in blocks:
        if b.home.mark and id(b.home) not in above:
            n = b.home
            while n and id(n) not in above:
                above.add(id(n))
                n = n.parent
    return "\n\n".join(b.text for b in blocks if b.home.mark or (b.weight and (id(b.home) in above or _within(b.node, TITLE))))


def _mapped(df: DataFrame, inputs: int, made, name: str, kind: T.DataType) -> DataFrame:
    """df with its last `inputs` columns replaced by made(*their values)."""
    small_batches(df.sparkSession)
    keep = df.schema.fields[: len(df.columns) - inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):  # few whole pages at a time
                part = batch.slice(at, 32)
                args = [part.column(i) for i in range(len(keep), part.num_columns)]
                out = [made(*(a[i].as_py() for a in args)) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(out, arrow)], [*(f.name for f in keep), name])

    arrow = pa.string() if isinstance(kind, T.StringType) else pa.struct([("path", pa.string()), ("chars", pa.int64())])
    return df.mapInArrow(run, T.StructType([*keep, T.StructField(name, kind)]))


def extract_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages without their html, with the column text added."""
    keep = [f"`{c}`" for c in pages.columns if c not in (html, "text")]
    host, path, source = (fresh(pages, n) for n in ("_host", "_path", "_html"))
    of_url: Column = split_url(F.col(f"`{url}`"))[0]
    rows = pages.select(*keep, of_url.alias(host), F.col(f"`{html}`").cast("string").alias(source))
    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("chars", T.LongType())])
    voted = _mapped(rows.select(host, source), 1, _as_dict, "vote", kind).filter("vote is not null")
    votes = voted.groupBy(host, F.col("vote.path").alias(path)).agg(F.count("*").alias("pages"), F.sum("vote.chars").alias("chars"))
    place = F.row_number().over(Window.partitionBy(host).orderBy(F.desc("pages"), F.desc("chars"), path))
    winners = scratch(votes.withColumn("place", place).filter("place = 1").select(host, path), "html-paths")
    if winners.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        winners = F.broadcast(winners)
    joined = rows.join(winners, host, "left").select(*keep, source, path)
    return _mapped(joined, 2, extract, "text", T.StringType())


def _as_dict(html: str | None) -> dict | None:
    got = vote(html)
    return None if got is None else {"path": got[0], "chars": got[1]}
