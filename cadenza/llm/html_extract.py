"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from one template. A token is a tag or a word at its place in the tree of elements; tokens with
the same vector of occurrences over a group of same-host pages form an equivalence class. The classes of tokens that
every page of a layout has once, in one order and each inside the ones around it, are the template's skeleton; what
lies between its tokens are slots, and classes that repeat nest in them. An element that occurs more than once is told
from its like by the tokens of the skeleton that it holds. The article stands in an element of the skeleton in which a
class of text blocks repeats, as paragraphs do: the one with the heading of the first rank, else the first after it. A
list of remarks or teasers repeats elements that hold blocks in turn, and a notice repeats nothing. Where nothing repeats,
the text is what stands in slots. Elements that HTML itself, or a class name, calls chrome are no slots of the article.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, texts_of
from .vectors import groups_of

HEAD = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TELLING = re.compile(r"class|id|role|itemprop|hidden", re.IGNORECASE)
DIGITS = re.compile(r"\d+")
# HTML's own lists of elements.
RAW = set("script style noscript template textarea svg iframe object canvas xmp".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table article section div body html main".split())
# What is never part of an article: elements, roles, and whole class and id names.
CHROME_TAGS = set("nav aside footer form button select input dialog menu head title fieldset".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu form".split())
CHROME_NAMES = set(
    "ad ads advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored sidebar comment comments reply replies"
    " respond disqus cookie cookies consent gdpr notice notices notification alert newsletter subscribe signup login share sharing social related"
    " recommended breadcrumb breadcrumbs menu nav navbar navigation footer header masthead popup modal overlay widget toolbar pagination pager skip"
    " site-header site-footer page-header page-footer main-nav site-nav nav-menu main-menu side-bar comment-list comment-form comments-area comments-section"
    " related-posts related-articles share-buttons social-share cookie-banner cookie-notice cookie-consent newsletter-signup ad-slot ad-container ad-banner".split())
MAIN_NAMES = set("article articlebody article-body article-content main main-content content post post-body post-content entry entry-content story story-body".split())


class Paths:
    """Places in the tree of elements (tags, classes and ids on the way from the root) as numbers that pages share."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.up, self.label = [0], [""]

    def below(self, up: int, label: str) -> int:
        at = self.known.get((up, label))
        if at is None:
            at = self.known[up, label] = len(self.up)
            self.up.append(up)
            self.label.append(label)
        return at

    def text(self, path: int) -> str:
        out = []
        while path:
            out.append(self.label[path])
            path = self.up[path]
        return "".join(f"/{x}" for x in reversed(out))


class Node:
    """An element: its place, the block it belongs to, and what is known of it.

    ``sure`` tells of chrome by element or role, here or around; ``named`` is the nearest element around, itself
    included, whose name is one of chrome; ``main`` tells of a main element around, ``links`` of a link.
    """

    __slots__ = ("tag", "path", "block", "up", "sure", "named", "main", "links", "header", "own_name", "called", "words", "holds_main", "void")

    def __init__(self, tag: str, path: int, up: Node | None) -> None:
        self.tag, self.path, self.up = tag, path, up
        self.block = self
        self.sure = self.main = self.links = self.called = self.own_name = self.holds_main = False
        self.named = self.header = self.void = None
        self.words = 0


class Page:
    """What a page consists of, in order: blocks of text with their element, and the elements that were opened (their
    places, and blocks as negative numbers, in ``order``; themselves in ``elements``)."""

    def __init__(self) -> None:
        self.blocks: list[tuple[Node, str]] = []
        self.order: list[int] = []
        self.elements: list[Node] = []
        self.named: list[Node] = []
        self.mains: list[Node] = []


def _told(attrs: str) -> tuple[str, set[str], str, bool]:
    """(class and id for the place, their whole names, role, hidden)."""
    if not TELLING.search(attrs):
        return "", set(), "", False
    label, names, role, hidden = "", set(), "", False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c)
        if name in ("class", "id"):
            value = value.strip().lower()
            label += "." + DIGITS.sub("#", value)
            names.update(value.split())
        elif name in ("role", "itemprop"):
            role = value.strip().lower()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
    return label, names, role, hidden


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page in order, each character read a bounded number of times: ``text`` with the text,
    ``open`` with tag and attributes, ``close`` with the tag. Comments, declarations and raw elements vanish.

    A quote in a tag reaches to the next one of its kind. Once such a tag doesn't end, quotes are no longer heeded, and
    once no ``>`` is left, what follows is text.
    """
    at, n, quotes, find = 0, len(html), True, html.find
    start = 0
    while True:
        at = find("<", at)
        if at < 0:
            break
        m = HEAD.match(html, at)
        if m is None:
            if not html.startswith(("<!", "<?"), at):
                at += 1
                continue
            if at > start:
                yield "text", "", html[start:at]
            if html.startswith("<!--", at):
                end = find("-->", at + 4)
                end = n if end < 0 else end + 3
            elif html.startswith("<![CDATA[", at):
                end = find("]]>", at)
                yield "text", "", html[at + 9 : n if end < 0 else end]
                end = n if end < 0 else end + 3
            else:
                end = find(">", at)
                end = n if end < 0 else end + 1
            at = start = end
            continue
        end = m.end()
        attrs = m[3]
        if quotes and end < n and html[end] != ">":
            while end < n and html[end] != ">":
                end = find(html[end], end + 1)
                if end < 0:
                    break
                end = PLAIN.match(html, end + 1).end()
            if not 0 <= end < n:
                quotes = False
            else:
                attrs = html[m.end(2) : end]
        if not quotes or end >= n:
            end = find(">", m.end(2))
            if end < 0:
                break
            attrs = html[m.end(2) : end]
        if at > start:
            yield "text", "", html[start:at]
        tag = m[2].lower()
        at = start = end + 1
        if m[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, attrs
        if tag in RAW and not attrs.endswith("/"):
            close = re.compile(f"</{tag}[\\s>/]", re.IGNORECASE).search(html, at)
            end = find(">", close.start()) if close else -1
            at = start = n if end < 0 else end + 1
    if start < n:
        yield "text", "", html[start:]


def parse(html: str, paths: Paths | None = None) -> Page:
    """Blocks and elements of a page; elements left open close as HTML has it, comments and scripts vanish."""
    page, paths = Page(), paths or Paths()
    root = Node("", 0, None)
    stack = [root]
    # of the open elements: how many of each tag, and of each inline tag since the last block
    opened: Counter[str] = Counter()
    inline: list[Counter[str]] = [Counter()]
    text: list[str] = []
    places: list[Node] = []

    def flush() -> None:
        block = " ".join(unescape("".join(text)).split())
        text.clear()
        node = places[0]
        # an inline element speaks for its block only if like ones hold all of the text
        if node is not node.block and not (all(_suspect(x) for x in places) or all(x.links for x in places)):
            node = node.block
        places.clear()
        if block:
            page.order.append(~len(page.blocks))
            page.blocks.append((node, block))

    def close(upto: int) -> None:
        for node in reversed(stack[upto:]):
            opened[node.tag] -= 1
            if node.tag in INLINE:
                inline[-1][node.tag] -= 1
            else:
                inline.pop()
                if text:
                    flush()
        del stack[upto:]

    for kind, tag, rest in tokens(html):
        if kind == "text":
            if not rest.isspace():
                places.append(stack[-1])
                text.append(rest)
            elif text:
                text.append(rest)
            continue
        if kind == "close":
            if not opened[tag]:
                if tag in ("br", "p") and text:
                    text.append(" ")
                continue
            if tag in INLINE and not inline[-1][tag]:
                continue  # an inline end doesn't reach out of its block
            i = len(stack) - 1
            while stack[i].tag != tag:
                i -= 1
            close(i)
            continue
        if tag == "br":
            if text:
                text.append(" ")
            continue
        if tag in RAW:
            continue
        if tag in CLOSES_P and opened["p"]:
            i = len(stack) - 1
            while i > 0 and stack[i].tag != "p" and stack[i].tag in INLINE:
                i -= 1
            if stack[i].tag == "p":
                close(i)
        if tag in SIBLINGS and any(opened[x] for x in SIBLINGS[tag]):
            i = len(stack) - 1
            while i > 0 and stack[i].tag not in SIBLINGS[tag] and stack[i].tag not in SCOPES:
                i -= 1
            if stack[i].tag in SIBLINGS[tag]:
                close(i)
        is_inline = tag in INLINE
        if not is_inline and text:
            flush()
        up = stack[-1]
        label, names, role, hidden = _told(rest) if rest else ("", (), "", False)
        node = Node(tag, up.path if is_inline else paths.below(up.path, tag + label), up)
        if is_inline:
            node.block = up.block
        else:
            page.order.append(node.path)
            page.elements.append(node)
        node.links = up.links or tag == "a"
        node.sure = up.sure or hidden or tag in CHROME_TAGS or role in CHROME_ROLES
        node.named, node.main, node.header = up.named, up.main, up.header
        if tag == "header" and not up.main:
            node.header = node
        semantic = tag in ("article", "main") or role in ("main", "article", "articlebody")
        if names and tag not in ("html", "body", "article", "main") and not CHROME_NAMES.isdisjoint(names):
            node.named, node.own_name = node, True
            page.named.append(node)
        called = bool(names) and tag in ("div", "section", "td") and not MAIN_NAMES.isdisjoint(names)
        if semantic or called:
            if not up.main:
                x = node.named
                while x is not None and not x.holds_main:
                    x.holds_main = True
                    x = x.up.named
            if semantic or not node.own_name:
                node.main = True
                node.called = not semantic
                page.mains.append(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] += 1
            if is_inline:
                inline[-1][tag] += 1
            else:
                inline.append(Counter())
    close(1)
    if text:
        flush()
    for node, block in page.blocks:
        if node.named is not None:
            node.named.words += block.count(" ") + 1
    for node in reversed(page.named):
        if node.up.named is not None:
            node.up.named.words += node.words
    return page


def _suspect(node: Node) -> bool:
    return node.sure or node.named is not None or node.header is not None


def equivalence_classes(pages: list[Page]) -> dict[tuple[int, ...], set[tuple[int, str]]]:
    """Tokens by their vector of occurrences over the pages; a token is (place, '') for a tag or (place, word).

    Tags are counted on all pages. Of words only those that all pages have at a place are followed, which is what the
    classes of a template need: from the page with the fewest words on, words that a page misses are let go.
    """
    counts: dict[tuple[int, str], list[int]] = {}
    for i, page in enumerate(pages):
        for path, n in Counter(x for x in page.order if x >= 0).items():
            counts.setdefault((path, ""), [0] * len(pages))[i] = n
    alive: dict[int, set[str]] = defaultdict(set)
    by_size = sorted(range(len(pages)), key=lambda i: (sum(len(b) for _, b in pages[i].blocks), i))
    words: dict[tuple[int, str], list[int]] = {}
    for step, i in enumerate(by_size):
        found: Counter[tuple[int, str]] = Counter()
        for node, block in pages[i].blocks:
            place = node.block.path
            if not step:
                found.update((place, w) for w in block.split())
            elif place in alive:
                own = alive[place]
                found.update((place, w) for w in block.split() if w in own)
        alive = defaultdict(set)
        for (place, w), n in found.items():
            alive[place].add(w)
            words.setdefault((place, w), [0] * len(pages))[i] = n
        if not alive:
            break
    counts |= {(place, w): words[place, w] for place, own in alive.items() for w in own}
    classes: dict[tuple[int, ...], set[tuple[int, str]]] = defaultdict(set)
    for token, vector in counts.items():
        classes[tuple(vector)].add(token)
    return classes


def differentiate(pages: list[Page], paths: Paths) -> None:
    """Places anew: of elements that pages have several times at a place, the one around a tag that every page has once
    gets a place of its own, told by the first such tag in it."""
    counts = [Counter(x for x in page.order if x >= 0) for page in pages]
    once = {x for x in counts[0] if all(c[x] == 1 for c in counts)}
    if all(paths.up[x] in once or not paths.up[x] for x in once):
        return
    for page in pages:
        marks: dict[int, str] = {}
        for node in page.elements:
            if node.path in once:
                up = node.up.block
                while up.path and up.path not in once and id(up) not in marks:
                    marks[id(up)] = paths.label[node.path]
                    up = up.up.block
        new: dict[int, int] = {0: 0}
        for node in page.elements:
            label = paths.label[node.path]
            if id(node) in marks:
                label += f"~{marks[id(node)]}"
            new[id(node)] = paths.below(new[id(node.up.block) if node.up.block.path else 0], label)
        for node in page.elements:
            node.path = new[id(node)]
        at = iter(page.elements)
        page.order = [x if x < 0 else next(at).path for x in page.order]


def in_one_order(orders: list[list]) -> list:
    """The most tokens of the first order that stand in it in all others too, found order by order."""
    kept = orders[0]
    for other in orders[1:]:
        seen = {t: i for i, t in enumerate(other)}
        ends: list[int] = []
        tops: list[int] = []
        back: list[int] = []
        for i, t in enumerate(kept):
            at = seen.get(t, -1)
            k = bisect_left(ends, at) if at >= 0 else -1
            back.append(tops[k - 1] if k > 0 else -1)
            if k < 0:
                continue
            if k == len(ends):
                ends.append(at)
                tops.append(i)
            else:
                ends[k], tops[k] = at, i
        line, i = [], tops[-1] if tops else -1
        while i >= 0:
            line.append(kept[i])
            i = back[i]
        kept = line[::-1]
    return kept


def skeleton(pages: list[Page], paths: Paths, classes: dict[tuple[int, ...], set[tuple[int, str]]] | None = None) -> list[tuple[int, str]]:
    """Tokens of the valid class that each page has once, in page order: those that stand in one order in every page,
    each in an element that is itself one of them."""
    classes = equivalence_classes(pages) if classes is None else classes
    once = classes.get((1,) * len(pages), set())
    spoken = {place for place, word in once if word}

    def order(page: Page) -> list[tuple[int, str]]:
        out = []
        for x in page.order:
            if x >= 0:
                if (x, "") in once:
                    out.append((x, ""))
            elif (place := page.blocks[~x][0].block.path) in spoken:
                out += [(place, w) for w in page.blocks[~x][1].split() if (place, w) in once]
        return out

    valid: list[tuple[int, str]] = []
    inside = {0}
    for place, word in in_one_order([order(p) for p in pages]):
        if (place if word else paths.up[place]) in inside:
            valid.append((place, word))
            if not word:
                inside.add(place)
    return valid


class Template:
    """A layout of a host's pages: its skeleton, the blocks that all pages share, and the element of the article."""

    def __init__(self, pages: list[Page], paths: Paths) -> None:
        self.paths = paths
        differentiate(pages, paths)
        self.frame = skeleton(pages, paths)
        self.elements = [place for place, word in self.frame if not word]
        said: dict[int, set[str]] = defaultdict(set)
        for place, word in self.frame:
            if word:
                said[place].add(word)
        # blocks that every page has: all their words are in classes of the template
        self.shared = set.intersection(*({(n.block.path, b) for n, b in p.blocks} for p in pages))
        self.semantic = {n.path for p in pages for n in p.mains if not n.called and not n.sure}
        slots: list[int] = [0] * len(paths.up)
        fixed: list[int] = [0] * len(paths.up)
        often: set[int] = set()
        for page in pages:
            seen: set[int] = set()
            for node, block in page.blocks:
                place = node.block.path
                if node.sure or node.links or node.named is not None and not node.named.holds_main:
                    continue
                if (place, block) in self.shared:
                    fixed[place] += block.count(" ") + 1
                elif place in said:
                    slots[place] += sum(w not in said[place] for w in block.split())
                else:
                    slots[place] += block.count(" ") + 1
                if place in seen:
                    often.add(place)
                seen.add(place)
        # elements of the skeleton in which a class of blocks repeats, and not all of its text is the template's
        known = set(self.elements)
        repeats = {paths.up[x] for x in often if x not in known and paths.up[x] in known and slots[x]}
        for at in range(len(slots) - 1, 0, -1):  # places come after the ones around them
            slots[paths.up[at]] += slots[at]
            fixed[paths.up[at]] += fixed[at]
        found = self._article(repeats)
        self.container = self._container(slots, found)
        self._within: dict[int, bool] = {0: False}
        c = self.container
        self.loose = c is not None and not self._whole_page(c)
        # what all pages share is the article's own in its element, and the template's where that wasn't told
        self.cuts = c is not None and not self._marked(c) and (found is None or not self.loose) and len(pages) > 2 and slots[c] >= fixed[c]

    def _whole_page(self, place: int) -> bool:
        return re.split(r"[.~]", self.paths.label[place])[0] in ("body", "html")

    def _article(self, repeats: set[int]) -> int | None:
        """The outermost of the elements in which blocks repeat, the whole page only if there is no other: the one around
        the heading of the first rank, else the first after it, else the first."""
        inner = [x for x in self.elements if x in repeats and not self._whole_page(x)]
        if not inner:
            return next((x for x in self.elements if x in repeats), None)
        outer = [x for x in inner if not any(y in repeats and not self._whole_page(y) for y in self._around(self.paths.up[x]))]
        order = {x: i for i, x in enumerate(self.elements)}
        for head in (x for x in self.elements if re.split(r"[.]", self.paths.label[x])[0] == "h1"):
            around = set(self._around(head))
            for x in outer:
                if x in around:
                    return x
            for x in outer:
                if order[x] > order[head]:
                    return x
        return outer[0]

    def _around(self, place: int) -> list[int]:
        out = []
        while place:
            out.append(place)
            place = self.paths.up[place]
        return out

    def _marked(self, place: int) -> bool:
        return any(p in self.semantic for p in self._around(place))

    def _container(self, slots: list[int], found: int | None) -> int | None:
        """The article's element; where none was told, the innermost of the skeleton that holds all slots. The article
        or main element around it, or the one inside it that has any, comes first."""
        best = found
        if best is None:
            for place in self.elements:
                if slots[0] and slots[place] == slots[0]:
                    best = place
        if best is None:
            return None
        around = [p for p in self._around(best) if p in self.semantic]
        articles = [p for p in around if self.paths.label[p].startswith("article")]
        if around:
            return (articles or around)[-1]
        inner = [p for p in self.elements if p in self.semantic and slots[p]]
        return inner[0] if inner else best

    def within(self, place: int) -> bool:
        """Whether a place is the article's element or in it."""
        if self.container is None:
            return False
        trail = []
        while place not in self._within:
            if place == self.container:
                self._within[place] = True
                break
            trail.append(place)
            place = self.paths.up[place]
        for p in trail:
            self._within[p] = self._within[place]
        return self._within[place]


def _dropped(page: Page, template: Template | None):
    """A function that tells whether an element is chrome: surely, as a page's header, or by a name. A name outside of
    main elements that holds one, or holds the deduced article's element, is not believed."""
    around = set(template._around(template.container)) if template and template.container is not None else set()
    for node in page.named:
        outer = node.up.named
        node.void = (node.holds_main and not node.up.main or node.path in around) and (outer is None or outer.void)

    def dropped(node: Node) -> bool:
        if node.sure or node.named is not None and not node.named.void:
            return True
        h = node.header
        return h is not None and not (template is not None and template.loose and template.within(h.path))

    return dropped


def extract(page: Page, template: Template | None) -> str:
    """A page's blocks in the article's element of its template, without chrome and blocks of template words. A heading
    of the first rank stands outside that element if there is none in it. A page without a template, or without that
    element, is read by its own marks: its main elements, else all that isn't chrome."""
    dropped = _dropped(page, template)
    if template is not None and any(template.within(n.block.path) for n, _ in page.blocks):
        own, titles = [], []
        headed = any(n.block.tag == "h1" and template.within(n.block.path) for n, _ in page.blocks)
        for node, block in page.blocks:
            if template.within(node.block.path):
                if not dropped(node) and not (template.cuts and (node.block.path, block) in template.shared):
                    own.append(block)
            elif not headed and not own and node.block.tag == "h1" and not dropped(node) and (node.block.path, block) not in template.shared:
                titles.append(block)
        return "\n".join(titles + own)
    left = [(n, b) for n, b in page.blocks if not dropped(n)]
    if page.mains:
        left = [(n, b) for n, b in left if n.main] or ([] if any(not n.called for n in page.mains) else left)
    out = [b for _, b in left]
    if not out:  # where nothing else is left, a name hides its own words, but no blocks in it
        out = [b for n, b in page.blocks if not n.sure and n.header is None and n.named is not None and n.block is not n.named.block]
    return "\n".join(out)


def layouts(pages: list[Page]) -> list[list[int]]:
    """Pages (by number) that share a layout: of the classes of tags that pages have once, the one with most tokens in
    all tells the pages of the first layout; the rest is parted again. Pages that share with no other are left out."""
    left, out = list(range(len(pages))), []
    counts = [Counter(x for x in p.order if x >= 0) for p in pages]
    while len(left) > 1:
        vectors: dict[int, list[int]] = defaultdict(list)
        for k, i in enumerate(left):
            for path, n in counts[i].items():
                if n == 1:
                    vectors[path].append(k)
        classes = Counter(tuple(v) for v in vectors.values() if len(v) > 1)
        if not classes:
            break
        best = min(classes, key=lambda v: (-classes[v] * len(v), v))
        out.append([left[k] for k in best])
        taken = set(best)
        left = [i for k, i in enumerate(left) if k not in taken]
    return out


def texts_of_pages(htmls: list[str]) -> list[str]:
    """Main texts of pages of one host; equal pages teach once."""
    paths = Paths()
    first: dict[str, int] = {}
    which = [first.setdefault(h, len(first)) for h in htmls]
    pages = [parse(h, paths) for h in first]
    own: list[Template | None] = [None] * len(pages)
    for group in layouts(pages):
        if len(group) > 1:
            template = Template([pages[i] for i in group], paths)
            for i in group:
                own[i] = template
    texts = [extract(p, t) for p, t in zip(pages, own, strict=True)]
    return [texts[i] for i in which]


def main_texts(pages: DataFrame, group: int = 128, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of ``pages``: key, url, text (main text, empty if none), n_chars (its code points).

    The text is the article without menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles
    and comments. Character references are decoded, white space in a block becomes one space, blocks are trimmed, empty
    ones left out and the rest joined in page order by one newline; ``br`` and inline elements don't end a block.
    Null and empty pages give an empty text. Null keys and urls and repeated rows give a row each, urls without a host
    are one host; other columns are left out; an empty table gives no rows.

    Pages travel compressed to their host and are read ``group`` at a time, so memory doesn't grow with a host; a
    host with more pages than that is dealt to several tasks by a hash of the page. The template, and with it the text of
    a page without an article or main element, is that of the pages it is read with. Of pages of two layouts each has
    its own template; a page that shares its layout with no other is read by its own marks.
    """
    spark = pages.sparkSession
    short_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col("u"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select(pages[key].alias("k"), pages[url].alias("u"), pages[html].alias("t")).withColumn("host", host)
    counts = rows.groupBy("host").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    # at most 100,000 hosts have that share of all pages
    large = {r[0]: -(-r[1] // group) for r in counts.where((F.col("count") > group) & (F.col("count") > 1e-5 * total)).collect()}
    tasks = spark.sparkContext.broadcast(large)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress(t.encode("utf-8"), 4) for t in texts_of(batch, "t")]
            salt = [zlib.crc32(z) % tasks.value.get(h, 1) for z, h in zip(packed, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(salt, pa.int32()), batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["host", "salt", "k", "u", "z"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in groups_of(batches, 2, most=group):
            text = texts_of_pages([zlib.decompress(z).decode("utf-8") for z in t.column("z").to_pylist()])
            yield pa.RecordBatch.from_arrays([t.column("k").combine_chunks(), t.column("u").combine_chunks(), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["k", "u", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    sent = rows.select("k", "u", "t", "host").mapInArrow(send, f"host string, salt int, k {kind}, u string, z binary")
    sent = sent.repartition("host", "salt").sortWithinPartitions("host", "salt", "k")
    return sent.mapInArrow(read, f"k {kind}, u string, text string, n_chars long").withColumnsRenamed({"k": key, "u": url})
