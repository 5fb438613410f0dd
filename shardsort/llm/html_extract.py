"""Main text of web pages by equivalence-class template deduction.

Every page is cut into tokens: its block elements, each in the context of its ancestors' tags and
names, and those blocks of text that could belong to a template. Over the pages of a host a token
has an occurrence vector (how often it comes in each page). Vectors are never gathered: a token's
fingerprint is the exclusive or, over pages, of a hash of the page and the count, so equal vectors
have equal fingerprints and every figure of a token is added up before the shuffle, whatever the
size of a host. Tokens that share a fingerprint form a class. Elements that come in enough pages are
the host's template, each class nested in that of its parent; what stands directly in a template
element is a slot. The template, not the single page, gives each slot its part, from all pages
together: whether its text varies, its share of text and of links, whether it is a record of a
repeated class, and what its names mean. A page's main text is what its article slots hold.

A page without a template is one slot and stays whole.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardsort.llm.common import arrow_rows, bounded_batches, durable, salted_join, written

#: Elements in at least this share of a host's different pages are in its template.
SUPPORT = 0.1
#: Text that so many different pages of a host share, and this share of those with its element, is template.
TEXT_PAGES, TEXT_SUPPORT = 3, 0.5
#: From this share of links among its characters on a box outside an article is a menu.
LINK_SHARE = 0.75
#: An article element counts as the article where it holds this share of the text that varies.
ARTICLE_SHARE = 0.5
#: Records (of comments, say) go where other text is at least this share of theirs.
RECORD_SHARE = 0.25
#: Sums of tokens that a task holds before it passes them on.
SUMS = 200_000
#: Templates are sent to every task if they have at most this many numbers (8 bytes each).
BROADCAST_NUMBERS = 4_000_000
#: Groups of equal pages that may be sent to every task.
BROADCAST_COPIES = 200_000
#: Templates that a worker keeps ready.
READY = 2_000

# What HTML elements and their usual names mean.
RAW = frozenset("script style noscript template iframe textarea title".split())
MUTE = frozenset("svg object canvas select button audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("head nav header footer aside form menu dialog fieldset".split())
ASIDE_NAMES = frozenset(
    """ad adbox ads adsbygoogle adsense adslot advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer
    header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related reply replies
    respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets""".split()
)
#: Words that with a name of asides make one up ("ad-slot", "related-posts"), unlike those of a title.
ASIDE_PARTS = frozenset(
    """articles bar block box btn button buttons container content form global group icons inner item items link links list main menu module nav page panel placeholder posts
    primary secondary section site slot stories top unit wrap wrapper""".split()
)
#: These make up such a compound too, but their header is the article's own.
OWN_PARTS = frozenset("article blog entry post".split())
#: Elements whose id is a slug of their own text.
TITLED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
#: Elements that are part of something larger: no unit or record of their own.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 hgroup caption dd dt figcaption legend li summary tbody td tfoot th thead tr".split())
#: Elements of running text.
FLOW = PARTS | frozenset("p ul ol dl dir table blockquote pre figure center details dialog address".split())
#: Lists and boxes, which may be menus.
BOXES = BLOCKS - PARTS - MAIN - frozenset("html body p pre blockquote figure center".split())
CLOSES_P = BLOCKS - {"html", "head", "body"}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NUMBER = re.compile(r"\d+")
_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW | MUTE}

#: Kinds of tokens, as bits: a block of text; and elements by the meaning of their tag and names.
TEXT, NAMED_ASIDE, ARTICLE, FLOWS, HEADING, UNIT, BOX = (1 << k for k in range(7))
#: Marks a page's own row among its tokens.
PAGE = 0


class Element:
    """An open block element in the context of those around it."""

    __slots__ = ("above", "in_article", "kind", "name", "path", "token", "unit")

    def __init__(self, name: str, path: str, kind: int, above: Element | None):
        self.name, self.path, self.kind, self.above = name, path, kind, above
        self.token = token_of(path)
        self.in_article = bool(kind & ARTICLE) or above is not None and above.in_article
        self.unit = self if kind & UNIT else above.unit if above is not None else None


@dataclass
class Block:
    """A block of text, the element it stands in, its characters within links, its own token.

    The token is 0 (none) for running text of an article that stands in no named unit: a sentence
    that articles repeat is still part of them.
    """

    text: str
    element: Element
    linked: int
    token: int


@dataclass
class Page:
    """Blocks in order, and the elements with their counts."""

    blocks: list[Block] = field(default_factory=list)
    elements: dict[int, Element] = field(default_factory=dict)
    counts: Counter = field(default_factory=Counter)

    def content(self) -> int:
        """Equal for pages of equal text."""
        return token_of("\n".join(b.text for b in self.blocks if not _named_aside(b.element)))

    def tokens(self) -> list[tuple[int, int, int, int, int, int, int]]:
        """(token, parent, kind, count, characters outside and within links, hash of the own text) of each."""
        plain, linked, own = Counter(), Counter(), {}
        texts: dict[int, list] = {}
        for b in self.blocks:
            at = b.element.token
            plain[at] += len(b.text) - b.linked
            linked[at] += b.linked
            own.setdefault(at, []).append(b.text)
            if b.token:
                texts.setdefault(b.token, [b, 0])[1] += 1
        rows = []
        for token, e in self.elements.items():
            parent = e.above.token if e.above is not None else PAGE
            rows.append((token, parent, e.kind, self.counts[token], plain[token], linked[token], token_of("\n".join(own[token])) if token in own else 0))
        rows += [(token, b.element.token, TEXT, count, len(b.text) - b.linked, b.linked, 0) for token, (b, count) in texts.items()]
        return rows


def token_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def names_aside(token: str, compounds: bool = True) -> bool:
    """Whether a class or id, as a whole, is a name of asides, or a compound of nothing but one and parts.

    Hyphens, underscores, digits and capitals make no difference to a whole name.
    """
    if token.lower().replace("-", "").replace("_", "") in ASIDE_NAMES:
        return True
    words = [word.lower() for word in _NAME.findall(token)] if compounds else []
    if "".join(words) in ASIDE_NAMES:
        return True
    if "header" in words and not OWN_PARTS.isdisjoint(words):
        return False
    return not ASIDE_NAMES.isdisjoint(words) and ASIDE_NAMES | ASIDE_PARTS | OWN_PARTS >= set(words)


def _named_aside(element: Element | None) -> bool:
    while element is not None:
        if element.kind & NAMED_ASIDE:
            return True
        element = element.above
    return False


def _opened(name: str, attributes: str, above: Element) -> Element:
    names, aside = [], name in ASIDE
    if attributes and name not in ("html", "body"):  # their names tell of the single page
        for kind, *value in _ATTRIBUTE.findall(attributes):
            value = value[0] or value[1] or value[2]
            names.append(value)
            if kind.lower() == "role":
                aside = aside or value.lower() in ASIDE_ROLES
            elif not aside and not (name in TITLED and kind.lower() == "id"):
                aside = any(names_aside(token, name not in MAIN) for token in value.split())
    path = f"{above.path}/{name}"
    if name in MAIN:  # so do theirs
        return Element(name, path + ("!" if aside else ""), NAMED_ASIDE if aside else ARTICLE, above)
    if names:
        path += _NUMBER.sub("0", "." + ".".join(names))
    kind = NAMED_ASIDE * aside | FLOWS * (name in FLOW) | HEADING * (name in HEADINGS) | BOX * (name in BOXES)
    if names and not aside and name not in PARTS:
        kind |= UNIT
    return Element(name, path, kind, above)


def parse(html: str | None) -> Page:
    """Elements and text blocks of a page; null counts as empty.

    Character references are decoded, white space within a block becomes one space, the ends are
    trimmed. Block elements part blocks, other markup does not; a line break is white space.
    Unclosed elements end with what encloses them; unclosed scripts, styles and the like reach to
    the end of the page and hold no text. A name of asides counts as a whole class or id, or with
    words like box or list (with an article or main element only alone; ids of headings and
    paragraphs never count).
    """
    page, at, text, html = Page(), 0, [], html or ""
    stack = [Element("", "", 0, None)]
    page.elements[stack[0].token] = stack[0]
    page.counts[stack[0].token] = 1
    unending: set[str] = set()  # elements that hold no text and have no further end
    linked, links = 0, False

    def close_block() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(references.unescape("".join(text)).split())
            top = stack[-1]
            if joined:
                bare = top.in_article and not (top.unit is not None and top.unit.in_article)
                own = 0 if bare or _named_aside(top) else token_of(f"{top.path}\n{joined}")
                page.blocks.append(Block(joined, top, min(linked, len(joined)), own))
            text = []
        linked = 0

    while True:
        found = _TAG.search(html, at)
        piece = html[at : found.start()] if found else html[at:]
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)
        if found is None:
            break
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        name, end = name.lower(), found[1] or found[4]
        if name in _END:
            if not end and name not in unending and not (name in MUTE and (found[3] or "").endswith("/")):
                over = _END[name].search(html, at)
                if over:
                    at = over.end()
                elif name in RAW:
                    at = len(html)
                else:
                    unending.add(name)
            continue
        if name not in BLOCKS:
            if name == "br":
                text.append(" ")
            elif name == "a":
                links = not end
            continue
        close_block()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            continue
        if stack[-1].name == "p" and name in CLOSES_P:
            stack.pop()
        if name in ("li", "dt", "dd", "tr", "td", "th") and stack[-1].name == name:
            stack.pop()
        opened = _opened(name, found[3] or found[6] or "", stack[-1])
        page.elements.setdefault(opened.token, opened)
        page.counts[opened.token] += 1
        if name not in VOID:
            stack.append(opened)
    close_block()
    return page


@dataclass(frozen=True)
class Template:
    """The part of every template element: all that are known, those that go, those that are the article.

    ``texts`` are the tokens of text blocks that belong to the template.
    """

    known: frozenset[int] = frozenset()
    out: frozenset[int] = frozenset()
    article: frozenset[int] = frozenset()
    texts: frozenset[int] = frozenset()


@dataclass
class _Node:
    """A template element and the figures of its slot, over all pages of the host."""

    token: int
    parent: int
    kind: int
    pages: int
    count: int
    plain: int
    linked: int
    fingerprint: int
    varies: bool
    below: list = field(default_factory=list)
    weight: int = 0  # characters outside links that vary, in the subtree
    text: tuple[int, int] = (0, 0)  # all characters of the subtree, and those in links


def deduce(rows: Iterable[tuple], pages: int, text_pages: int = TEXT_PAGES, text_support: float = TEXT_SUPPORT) -> Template:
    """The template of a host from its tokens: (token, parent, kind, n_pages, count, plain, linked, fingerprint, low, high).

    Slots with a name of asides go, and so do article elements whose text is the same on all pages,
    records of a repeated class (two texts or more that come as often as the record, and no heading)
    where there is other text, and boxes of links. The article is the outermost article elements
    where they hold enough of the text that varies; otherwise every other slot is.
    """
    nodes: dict[int, _Node] = {}
    texts = []
    for token, parent, kind, n_pages, count, plain, linked, fingerprint, low, high in rows:
        if kind & TEXT:
            texts.append((token, parent, n_pages))
        else:
            nodes[token] = _Node(token, parent, kind, n_pages, count, plain, linked, fingerprint, n_pages < text_pages or low != high)
    roots = []
    for node in nodes.values():
        (nodes[node.parent].below if node.parent in nodes else roots).append(node)
    order, waiting = [], list(roots)  # parents first
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting.extend(node.below)
    out = {n.token for n in order if n.kind & NAMED_ASIDE}

    def weigh() -> int:
        for n in reversed(order):
            if n.token in out:
                n.weight, n.text = 0, (0, 0)
                continue
            n.weight = n.plain * n.varies + sum(c.weight for c in n.below)
            n.text = (n.plain + n.linked + sum(c.text[0] for c in n.below), n.linked + sum(c.text[1] for c in n.below))
        return sum(n.weight for n in roots)

    total = weigh()
    out |= {n.token for n in order if n.kind & ARTICLE and n.pages >= text_pages and n.text[0] and not n.weight and total}
    total = weigh()

    def subtree(node: _Node) -> list[_Node]:
        found, left = [], [node]
        while left:
            n = left.pop()
            if n.token not in out:
                found.append(n)
                left.extend(n.below)
        return found

    def top(chosen: set[int]) -> list[_Node]:
        """Those chosen that stand in no other chosen one and in nothing that goes."""
        found, left = [], list(roots)
        while left:
            n = left.pop()
            if n.token in out:
                continue
            if n.token in chosen:
                found.append(n)
            else:
                left.extend(n.below)
        return found

    repeated = {n.token for n in order if not n.kind & (FLOWS | ARTICLE) and n.count > n.pages}
    records = []
    for n in top(repeated):
        own = subtree(n)
        alike = [m for m in own if m.fingerprint == n.fingerprint and m.plain + m.linked]
        if len(alike) >= 2 and not any(m.kind & HEADING for m in own):
            records.append(n)
    held = sum(n.weight for n in records)
    if held and total - held >= RECORD_SHARE * held:
        out |= {n.token for n in records}
        total = weigh()
    inside = set()  # article elements and all within them
    for n in order:
        if n.kind & ARTICLE or n.parent in inside:
            inside.add(n.token)
    boxes = top({n.token for n in order if n.kind & BOX and n.token not in inside and n.text[0] and n.text[1] >= LINK_SHARE * n.text[0]})
    out |= {n.token for n in boxes if n.text[1]}
    total = weigh()
    found = [n for n in top({n.token for n in order if n.kind & ARTICLE}) if n.weight]
    article = {n.token for n in found} if total and sum(n.weight for n in found) >= ARTICLE_SHARE * total else set()
    shared = {t for t, parent, n in texts if parent in nodes and n >= text_pages and n >= text_support * nodes[parent].pages}
    return Template(frozenset(nodes), frozenset(out), frozenset(article), frozenset(shared))


def main_text(page: Page, template: Template) -> str:
    """The blocks of the page's article slots, by the host's template; all blocks where there is none.

    Template text goes: within an article by whole units of which nothing else is left (elements
    with a class or id), elsewhere block by block. An element that the template does not know is
    judged by its own names. A page of which that leaves nothing keeps its template text.
    """
    if not template.known:
        return "\n\n".join(b.text for b in page.blocks)
    seen: dict[int, tuple[bool, bool]] = {}

    def part(element: Element | None) -> tuple[bool, bool]:
        """(goes, is within the article)"""
        if element is None:
            return False, False
        if id(element) not in seen:
            goes, within = part(element.above)
            known = element.token in template.known
            goes = goes or (element.token in template.out if known else bool(element.kind & NAMED_ASIDE))
            within = within or (element.token in template.article if known else bool(element.kind & ARTICLE))
            seen[id(element)] = goes, within
        return seen[id(element)]

    left = [b for b in page.blocks if not part(b.element)[0]]
    inner = [b for b in left if part(b.element)[1]]
    blocks = inner or left
    varied: set[int] = set()
    for b in blocks:
        if b.token not in template.texts:
            unit = b.element.unit
            while unit is not None and id(unit) not in varied:
                varied.add(id(unit))
                unit = unit.above.unit if unit.above is not None else None
    chosen = []
    for b in blocks:
        unit = b.element.unit if b.element.in_article else None
        whole = unit is not None and unit.in_article and id(unit) in varied
        if b.token not in template.texts or whole:
            chosen.append(b)
    return "\n\n".join(b.text for b in chosen or blocks)


def host_of(url: Column) -> Column:
    """A URL's host as `url_filter.split_url` gives it, as a column expression."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.when(at > 0, F.translate(host, upper, upper.lower())), F.lit(""))


_FIGURES = ("token", "parent", "kind", "count", "plain", "linked", "own")


def parsed(pages: DataFrame) -> DataFrame:
    """(host, content, weight, nonce) and the figures of the tokens, as lists, of each page.

    ``weight`` is a hash of the row and ``nonce`` a random number, so repeated rows differ too; the
    table has to be written before it is used twice.
    """
    kinds = {"host": pa.string(), "content": pa.int64(), "weight": pa.int64(), "nonce": pa.int64(), **{name: pa.list_(pa.int64()) for name in _FIGURES}}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from secrets import randbits

        for batch in batches:
            rows = []
            for page_id, url, html, host in arrow_rows(batch, "page_id", "url", "html", "host"):
                page = parse(html)
                rows.append((host, page.content(), token_of(f"{page_id} {url} {html}"), randbits(63), *zip(*page.tokens(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    lists = ", ".join(f"{name} array<long>" for name in _FIGURES)
    return pages.select("page_id", "url", "html", "host").mapInArrow(run, f"host string, content long, weight long, nonce long, {lists}")


def different(table: DataFrame) -> DataFrame:
    """One page of each group of equal text on a host."""
    first = F.min(F.struct("weight", "nonce"))
    groups = durable(table.groupBy("host", "content").agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1"))
    chosen = groups.select("host", "content", F.col("first.weight").alias("of_weight"), F.col("first.nonce").alias("of_nonce"))
    joined = salted_join(table, chosen, ["host", "content"], "left", BROADCAST_COPIES)
    return joined.filter("of_nonce is null or (weight = of_weight and nonce = of_nonce)").drop("of_weight", "of_nonce")


_SUM = "host string, token long, parent long, kind long, n_pages long, count long, plain long, linked long, fingerprint long, low long, high long"
_SUM_NAMES = [part.split()[0] for part in _SUM.split(", ")]


def occurrences(table: DataFrame) -> DataFrame:
    """The figures of every token of each host, over its different pages; token PAGE counts the pages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            for host, weight, nonce, *lists in arrow_rows(batch, "host", "weight", "nonce", *_FIGURES):
                page = f"{weight} {nonce} "
                for token, parent, kind, count, plain, linked, own in [(PAGE, PAGE, 0, 1, 0, 0, 0), *zip(*lists, strict=True)]:
                    vector = token_of(page + str(count))
                    held = sums.get((host, token))
                    if held is None:
                        sums[(host, token)] = [parent, kind, 1, count, plain, linked, vector, own, own]
                        continue
                    held[2] += 1
                    held[3] += count
                    held[4] += plain
                    held[5] += linked
                    held[6] ^= vector
                    held[7] = min(held[7], own)
                    held[8] = max(held[8], own)
            if len(sums) >= SUMS:
                yield _sums(sums)
                sums = {}
        yield _sums(sums)

    partial = table.select("host", "weight", "nonce", *_FIGURES).mapInArrow(run, _SUM)
    added = [F.sum(name).alias(name) for name in ("n_pages", "count", "plain", "linked")]
    return partial.groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.bit_or("kind").alias("kind"), *added, F.bit_xor("fingerprint").alias("fingerprint"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _sums(sums: dict) -> pa.RecordBatch:
    columns = [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64())]
    columns += [pa.array([v[k] for v in sums.values()], pa.int64()) for k in range(9)]
    return pa.RecordBatch.from_arrays(columns, names=_SUM_NAMES)


def templates(counted: DataFrame, support: float = SUPPORT, text_pages: int = TEXT_PAGES, text_support: float = TEXT_SUPPORT) -> DataFrame:
    """(host, known, out, article, texts): the template of every host, as lists of tokens.

    Rare tokens are passed over before a host's are brought together, so a template holds at most
    the tokens of an average page over ``support``.
    """
    pages = durable(counted.filter(F.col("token") == PAGE).select("host", F.col("n_pages").alias("of")))
    frequent = counted.filter(F.col("token") != PAGE).filter((F.col("kind").bitwiseAND(TEXT) == 0) | (F.col("n_pages") >= text_pages))
    frequent = salted_join(frequent, pages, ["host"], "inner", BROADCAST_COPIES)
    is_text = F.col("kind").bitwiseAND(TEXT) != 0
    frequent = frequent.filter(F.col("n_pages") >= F.when(is_text, support * text_support).otherwise(support) * F.col("of"))
    names = ("token", "parent", "kind", "n_pages", "count", "plain", "linked", "fingerprint", "low", "high")
    gathered = frequent.groupBy("host").agg(F.max("of").alias("of"), F.array_sort(F.collect_list(F.struct(*names))).alias("rows"))
    parts = ("known", "out", "article", "texts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deduce(map(dict.values, rows), of, text_pages, text_support) for of, rows in arrow_rows(batch, "of", "rows")]
            columns = [pa.array([sorted(getattr(t, part)) for t in found], pa.list_(pa.int64())) for part in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["host", *parts])

    return gathered.mapInArrow(run, "host string, " + ", ".join(f"{part} array<long>" for part in parts))


def extract(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", support: float = SUPPORT, text_pages: int = TEXT_PAGES, text_support: float = TEXT_SUPPORT
) -> DataFrame:
    """Per page: page_id, url, text (empty if there is none), n_chars (its code points).

    The blocks of the article slots of the host's template in page order, joined by two line feeds.
    Every host has a template of its own, be it from one page: elements in at least ``support`` of
    its different pages. One rule holds for hosts of any size: only text that ``text_pages``
    different pages share (and ``text_support`` of those with its element) is known to be template,
    so on hosts with fewer pages text goes by the part of its slot alone. Equal pages of a host
    count as one. Null html counts as empty; null and malformed urls are one host; pages of any
    length are parsed whole; repeated rows are returned as often as they come; other columns are not
    read; an empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    plain = plain.withColumn("host", host_of(F.col("url")))
    counted = durable(occurrences(different(written(parsed(plain)))))
    deduced = durable(templates(counted, support, text_pages, text_support))
    numbers = deduced.agg(F.coalesce(F.sum(F.size("known") + F.size("out") + F.size("article") + F.size("texts")), F.lit(0))).head()[0]
    framed = salted_join(plain, deduced, ["host"], "left", BROADCAST_COPIES if numbers <= BROADCAST_NUMBERS else 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, Template] = {}
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(part)) for part in ("known", "out", "article", "texts")]
            texts = []
            for k, (host, page) in enumerate(arrow_rows(batch, "host", "html")):
                if host not in ready:
                    if len(ready) >= READY:
                        ready.clear()
                    ready[host] = Template(*(frozenset(part[k].as_py() or ()) for part in lists))
                texts.append(main_text(parse(page), ready[host]))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    wanted = framed.select("page_id", "url", "html", "host", "known", "out", "article", "texts")
    return wanted.mapInArrow(run, "page_id long, url string, text string, n_chars long")
