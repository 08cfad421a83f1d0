"""Main text of web pages by tree scoring.

Every paragraph passes points for its length and commas to its ancestors, in full to its
parent, half to the next and a falling share to LEVELS above; a container's points are
discounted by its link density. The best container and those siblings that look
like parts of the same article are kept, without page furniture.

Pages are independent: one pass over each page's tags, in map tasks, with no shuffle. Every step
takes time in proportion to the page, also for pages without the end of a tag, a comment or an
element: positions of open elements are looked up by name, and sums go up the tree once.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*')|=)*+>""")
_COMMENT_END = re.compile(r"--!?>")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Ancestors that a paragraph passes points to.
LEVELS = 24
# Fixed values of HTML: elements without content, those whose content is no markup, and those that make a block of their own.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style title textarea iframe noembed xmp".split()}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
# Elements that never hold main text, and words in class, id or role that name page furniture.
DROPPED = frozenset("head nav footer aside form button select option dialog menu noscript template svg canvas object audio video fieldset search datalist".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs comment comments contentinfo complementary cookie cookies consent dialog discussion disqus disclaimer footer footnav form gdpr masthead menu menubar modal nav navbar navigation navigations newsletter notice notices notification overlay pager pagination popup promo promoted promotion related recommended replies reply respond search share sharing sharebar sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets alert".split()
)
#: The same words run together with others.
_FUSED = re.compile(r"comment(?!ar)|advert|sponsor|newsletter|breadcrumb|disqus|(?:side|top|main|site|foot|sub)(?:nav|menu|bar)$|^(?:nav|menu)(?:bar|list|links|items?)$|(?:page|site)footer$")
_WRAPPERS = frozenset("has no with without layout".split())
_INLINE = frozenset("ad ads advert advertisement sponsored promo share sharing social newsletter".split())
_TALK = frozenset("comment comments reply replies respond discussion disqus".split())
MAIN = frozenset("article main".split())
#: An open element is closed by the start of one of these.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option", "optgroup"}}
_CLOSES = {tag: [kind for kind, by in CLOSED_BY.items() if tag in by] for tag in set().union(*CLOSED_BY.values())}
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": {"td", "th", "button", "object"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def _names(attrs):
    if not attrs or attrs.isspace():
        return frozenset()
    return {w.lower() for m in _NAMED.finditer(attrs) for w in _TOKENS.findall(m[2] or m[3] or m[4] or "")}


def _furniture(tag, names):
    """Whether an element's names say that it holds page furniture."""
    if not names or tag in ("html", "body"):
        return False
    part = bool(names & {"article", "content", "entry", "post", "story", "main"})
    if tag in MAIN:
        # a reader's comment or a teaser may be an article of its own
        return not part and bool(names & (_TALK | {"related", "teaser", "promo", "ad", "ads", "sponsored"}))
    found = names & FURNITURE
    if names & _WRAPPERS:
        found = found - {"sidebar", "sidebars", "nav", "menu"}
    return bool(found) or any(_FUSED.search(n) for n in names) or "header" in names and not part


def tags(page: str):
    """(start, end, closing, name, attributes) of every tag in page order; the name is None for what is no element.

    A comment or an element of RAW text without its end reaches to the end of the page. A tag ends at the first > outside
    quotes; if there is none, this page's quotes no longer count. What has no > at all is text.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            found = _COMMENT_END.search(page, at + 4)
            end = found.end() if found else len(page)
            yield at, end, False, None, ""
            at = end
            continue
        if at > last:
            # no tag can end, but a comment may still begin
            at += 1
            continue
        name = _NAME.match(page, at)
        if name is None:
            if page[at + 1] in "!?/":
                end = page.index(">", at) + 1
                yield at, end, False, None, ""
                at = end
            else:
                at += 1
            continue
        found = _QUOTED.match(page, name.end()) if quotes else None
        if found is None:
            quotes = False
        end = found.end() if found else page.find(">", name.end()) + 1
        if not end:
            at += 1
            continue
        tag = name[2].lower()
        if not name[1] and tag in RAW:
            close = RAW[tag].search(page, end)
            stop = page.find(">", close.end()) + 1 if close else 0
            yield at, stop or len(page), False, None, ""
            at = stop or len(page)
            continue
        yield at, end, bool(name[1]), tag, page[name.end() : end - 1]
        at = end


class _Open:
    """The open elements, innermost last, and where those of a name, and of all blocks, stand among them."""

    def __init__(self):
        self.stack, self.tags, self.owner = [0], ["#root"], [0]
        self.places, self.blocks = {}, []

    def push(self, node, tag):
        at, owner = len(self.stack), self.owner[-1]
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
            owner = node
        self.owner.append(owner)
        self.stack.append(node)
        self.tags.append(tag)

    def cut(self, at):
        """Close the element at a place and all within."""
        while len(self.stack) > at:
            self.stack.pop()
            self.owner.pop()
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tag):
        """The place of the innermost element of a name; 0 if none is open."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def close(self, kind):
        """Close the innermost element of a kind, unless another that holds it back is within."""
        at = self.last(kind)
        if not at:
            return
        held = max(map(self.last, _STOPS.get(kind, ())), default=0)
        if at > held and (kind != "p" or self.blocks[-1] == at):
            self.cut(at)

    def imply(self, tag):
        """Close the elements whose end tags are left out before ``tag``."""
        for kind in _CLOSES.get(tag, ()):
            self.close(kind)
        self.close("p")
        while tag in HEADINGS and self.tags[-1] in HEADINGS:
            self.cut(len(self.stack) - 1)


class _Tree:
    """Elements in page order (tag, parent, dropped) and blocks of text (element, text, characters in links).

    strict: forms are dropped with all they hold.
    """

    def __init__(self, page, strict=True):
        self.tag, self.parent = ["#root"], [-1]
        # by kind; by name
        self.gone, named, talk = [False], [False], [False]
        self.blocks = []
        parts, linked, links = [], 0, 0
        opened = _Open()
        at = 0

        def close_block():
            nonlocal parts, linked
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    self.blocks.append((opened.owner[-1], text, min(linked, len(text))))
            parts, linked = [], 0

        def add(raw):
            nonlocal linked
            if raw and not self.gone[opened.stack[-1]]:
                parts.append(raw)
                if links:
                    linked += len(raw.strip())

        for start, end, closing, tag, attrs in tags(page):
            add(page[at:start])
            at = end
            if tag is None:
                continue
            if closing:
                k = opened.last(tag)
                if tag in VOID or not k:
                    continue
                if opened.blocks and opened.blocks[-1] >= k:
                    # an inline end tag does not close blocks
                    if tag not in BLOCK:
                        continue
                    close_block()
                    links = 0
                elif tag == "a":
                    links = max(0, links - 1)
                opened.cut(k)
                continue
            if tag == "br":
                parts.append(" ") if parts else None
                continue
            if tag in BLOCK:
                close_block()
                opened.imply(tag)
            if tag in VOID:
                continue
            above = opened.stack[-1]
            names = _names(attrs)
            kind = tag in DROPPED and (strict or tag != "form")
            kind = kind or tag == "header" and not any(map(opened.last, MAIN)) or tag not in BLOCK and bool(names & _INLINE)
            self.tag.append(tag)
            self.parent.append(above)
            self.gone.append(self.gone[above] or kind)
            named.append(_furniture(tag, names))
            talk.append(bool(names & _TALK))
            if not attrs.rstrip().endswith("/") or tag in BLOCK:
                opened.push(len(self.tag) - 1, tag)
                if tag == "a":
                    links += 1
        add(page[at:])
        close_block()
        # a name doesn't make furniture of what holds the article itself, unless that is talk
        size = len(self.tag)
        in_talk, holds = [False] * size, [False] * size
        for k in range(1, size):
            up = self.parent[k]
            in_talk[k] = in_talk[up] or named[up] and talk[up]
        for k in range(size - 1, 0, -1):
            if holds[k] or self.tag[k] in MAIN and not named[k] and not self.gone[k] and not in_talk[k]:
                holds[self.parent[k]] = True
        self.dropped = self.gone
        for k in range(1, size):
            self.dropped[k] = self.dropped[k] or named[k] and not holds[k] or self.dropped[self.parent[k]]

    def above(self, n):
        while n >= 0:
            yield n
            n = self.parent[n]

    def sums(self, own):
        """Each element's own number and those of all within."""
        total = list(own)
        for k in range(len(total) - 1, 0, -1):
            total[self.parent[k]] += total[k]
        return total


def scores(tree, blocks):
    """Each element's points less the share of links, its characters, and that share."""
    size = len(tree.tag)
    points, chars, linked = [0.0] * size, [0] * size, [0] * size
    for owner, text, in_links in blocks:
        worth = (1.0 if len(text) >= 25 else 0.2) + text.count(",") + min(len(text) / 100, 3.0)
        worth *= 1 - in_links / len(text)
        chars[owner] += len(text)
        linked[owner] += in_links
        # a paragraph scores for its containers; text that stands in a container itself, for that
        first = owner if tree.tag[owner] in ("div", "section", "article", "main", "body", "td", "#root", "html") else tree.parent[owner]
        for depth, n in zip(range(LEVELS), tree.above(first)):
            points[n] += worth if depth == 0 else worth / 2 if depth == 1 else worth / (3 * depth)
    chars, linked = tree.sums(chars), tree.sums(linked)
    density = [y / x if x else 0.0 for x, y in zip(chars, linked)]
    return [p * (1 - d) for p, d in zip(points, density)], chars, density


def main_text(page: str | None) -> str:
    """The page's main text: blocks in page order, joined by \\n; empty if there is none.

    Pages may be malformed and of any length: see ``tags`` for what has no end; end tags that close nothing are
    ignored, and elements without an end tag reach as far as what holds them. Of equal scores the first element wins.
    """
    if not page:
        return ""
    tree = _Tree(page)
    if all(tree.dropped[owner] for owner, _, _ in tree.blocks):
        # a form may hold the whole page
        tree = _Tree(page, strict=False)
    blocks = [b for b in tree.blocks if not tree.dropped[b[0]]]
    if not blocks:
        return ""
    size = len(tree.tag)
    score, chars, density = scores(tree, blocks)
    anchors = tree.sums([int(t == "a") for t in tree.tag])
    # the outermost of equal containers
    best = max(range(size), key=lambda n: (score[n], -n))
    best = next((n for n in tree.above(best) if tree.tag[n] in MAIN), best)
    while tree.tag[best] in ("ul", "ol", "li", "table", "tbody", "tr", "blockquote", "dl") and tree.parent[best] > 0:
        best = tree.parent[best]
    roots = {best}
    if best:
        for n in range(size):
            if n == best or tree.parent[n] != tree.parent[best] or tree.dropped[n] or not chars[n]:
                continue
            alike = score[n] >= max(10.0, 0.2 * score[best]) and density[n] < 0.5
            if alike or tree.tag[n] in HEADINGS or tree.tag[n] == "p" and chars[n] > 80 and density[n] < 0.25:
                roots.add(n)
    # from each element up to its root: whether it has one, and passes a list of links, a header, a heading
    kept, menu, header, heading, body = ([False] * size for _ in range(5))
    for n in range(size):
        if n in roots:
            kept[n], body[n] = True, tree.tag[n] in MAIN
            continue
        up = tree.parent[n]
        if up < 0 or not kept[up]:
            continue
        kept[n] = True
        # of an article's own lists only those that a name or a place marks as navigation are none of its text, and these are dropped
        body[n] = body[up] or tree.tag[n] in MAIN
        menu[n] = menu[up] or not body[n] and tree.tag[n] in ("ul", "ol", "div", "table", "dl") and anchors[n] >= 3 and density[n] > 0.6
        header[n] = header[up] or tree.tag[n] == "header"
        heading[n] = heading[up] or tree.tag[n] in HEADINGS
    wanted = [kept[n] and not menu[n] and (not header[n] or heading[n]) for n in range(size)]
    return "\n".join(text for owner, text, _ in blocks if wanted[owner])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null or empty html, and pages without main text, give an empty text and 0. Each row
    stands for itself, so repeated rows and ids are all returned; other columns are ignored.
    """

    @K.tidy
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    head = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in head.schema}
    return head.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
