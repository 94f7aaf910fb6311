"""Main text of web pages by tree scoring.

Paragraphs pass points, for their length and commas, to their ancestors; a container's points are
discounted by its link density.  The best container, grown to the article that holds it, and those of its
siblings that are not mostly links or, beside an article, score well are kept; menus, forms, adverts, reader comments and the like are cut out first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of the main text.
DROP = frozenset("script style noscript template iframe object embed svg canvas math audio video form button input select option textarea label fieldset dialog menu nav footer aside head title".split())
#: Of those, the ones that some pages are wrapped in.
WRAPS = frozenset("form fieldset aside dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag that ends an open <p>, and which open elements another one of their kind ends.
ENDS_P = BLOCK - {"body", "html"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div body html main blockquote".split())
#: Words of classes and ids: of parts that are no article wherever the word stands, and those that say so only alone or before a word of place.
SURE = "ads?|advert\\w*|advertisement|sponsor\\w*|promo\\w*|breadcrumbs?|comments?|commentlist|disqus|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|login|sidebar|menu|nav|navbar|navigation|topbar|masthead|footer|toolbar|pagination|pager"
UNSURE = "notice|alert|banner|overlay|share|sharing|social|side|widget|related|recommend\\w*|replies|reply|respond|discussion|skip"
PLACE = "area|articles?|bar|block|box|btn|buttons?|col|column|container|content|form|icons?|items?|links?|list|panel|posts?|section|stories|text|title|to|tools?|widget|wrap|wrapper"
JUNK = re.compile(rf"(?:^|[\s_-])(?:{SURE})(?:$|[\s_-])|(?:^|\s)(?:[a-z]+[_-])?(?:{UNSURE})(?:$|\s|[_-](?:{PLACE})(?:$|[\s_-]))", re.I)
PAGE_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
KEEP = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog toolbar".split())
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "junk", "marked", "points", "chars", "linked", "open_p", "in_article")

    def __init__(self, tag: str, parent: Node | None, junk: bool, marked: bool = False):
        self.tag, self.parent, self.junk, self.marked = tag, parent, junk, marked
        self.kids: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = 0
        #: The <p> that a block's opening tag would end here, and whether an article or main is around.
        self.open_p = self if tag == "p" else None if parent is None or tag in SCOPE else parent.open_p
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)


class Tree(HTMLParser):
    """A tolerant tree: unclosed elements end where their parents or the next of their kind do.

    Pages may be nested as deeply as they like: nothing here or below recurses, and end tags without an open element
    cost nothing.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in VOID:
            self.at.kids.append(" " if tag != "hr" else Node("hr", self.at, False))
            return
        if tag in ENDS_P and self.at.open_p is not None:
            self.end(self.at.open_p)
        if tag in CLOSES:
            self.end_open(CLOSES[tag], SCOPE - {"div"} if tag in ("td", "th", "tr") else SCOPE)
        a = {k: v or "" for k, v in attrs}
        marks = f"{a.get('class', '')} {a.get('id', '')}"
        header = tag == "header" and not self.at.in_article
        junk = (tag in DROP and tag not in WRAPS) or header
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        marked = tag in WRAPS or hidden or a.get("role", "").lower() in ROLES or (tag not in KEEP and JUNK.search(marks) is not None)
        marked = marked or (tag not in KEEP and PAGE_HEADER.search(marks) is not None and not self.at.in_article)
        node = Node(tag, self.at, junk or marked, marked and not junk)
        self.at.kids.append(node)
        self.at = node
        self.open[tag] += 1

    def end(self, node: Node) -> None:
        """Close ``node`` and all that is open in it."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent

    def end_open(self, tags: set[str], scope: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        n = self.at
        while n is not None and n.tag not in tags:
            if n.tag in scope:
                return
            n = n.parent
        if n is not None and n.parent is not None:
            self.end(n)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body") or not self.open[tag]:
            return
        n = self.at
        while n is not None and n.tag != tag:
            if tag not in BLOCK and n.tag in BLOCK:
                return  # an inline end tag does not end a block
            n = n.parent
        if n is not None and n.parent is not None:
            self.end(n)

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def blocks(node: Node) -> Iterator[tuple[Node, str, int]]:
    """(element, text, linked characters) of each block of text in page order, without junk."""
    buf: list[str] = []
    linked = 0
    owner = node
    stack: list[tuple[Node, int, bool]] = [(node, 0, node.tag == "a")]

    def take() -> str:
        text = SPACE.sub(" ", "".join(buf)).strip()
        buf.clear()
        return text

    while stack:
        n, i, link = stack.pop()
        if i < len(n.kids):
            stack.append((n, i + 1, link))
            k = n.kids[i]
            if isinstance(k, str):
                if not buf:
                    owner = n
                buf.append(k)
                linked += len(k) if link else 0
            elif not k.junk:
                if k.tag in BLOCK and (t := take()):
                    yield owner, t, linked
                if k.tag in BLOCK:
                    linked = 0
                stack.append((k, 0, link or k.tag == "a"))
        elif n.tag in BLOCK:
            if t := take():
                yield owner, t, linked
            linked = 0
    if t := take():
        yield owner, t, linked


def weigh(chars: int, commas: int) -> float:
    return 1.0 + commas + min(chars // 100, 3)


def points(text: str) -> float:
    return weigh(len(text), text.count(","))


def free_wrappers(root: Node) -> None:
    """Elements cut for their class, id, role or style, and forms and the like, are kept after all if they wrap the page: where nothing outside
    them is an article or main and they hold one and a quarter of the points, or else more than three quarters of the points."""
    walk, order = [root], []
    while walk:
        n = walk.pop()
        order.append(n)
        walk += [k for k in n.kids if isinstance(k, Node) and (k.marked or not k.junk)]
    if not any(n.marked for n in order):
        return
    inner: dict[Node, tuple[float, bool]] = {}
    bare: dict[Node, tuple[int, int]] = {}  # characters and commas that belong to the next block around
    for n in reversed(order):  # each after what it holds
        own = [(len(k.strip()), k.count(",")) if isinstance(k, str) else bare.get(k, (0, 0)) for k in n.kids]
        chars, commas = sum(c for c, _ in own), sum(c for _, c in own)
        kids = [inner[k] for k in n.kids if isinstance(k, Node) and k in inner]
        mine = 0.0
        if n.tag not in BLOCK and n is not root:
            bare[n] = chars, commas
        elif chars:
            mine = weigh(chars, commas)
        inner[n] = (mine + sum(v for v, _ in kids), n.tag in ("article", "main") or any(h for _, h in kids))
    whole, held = inner[root]
    walk, cut = [root], []
    while walk:
        n = walk.pop()
        for k in n.kids:
            if isinstance(k, Node) and k in inner:
                (cut if k.marked else walk).append(k)
                held = held and not (k.tag in ("article", "main") and not k.marked)
        if not walk:  # all outside of marks is seen
            wrap = [k for k in cut if (inner[k][1] and 4 * inner[k][0] > whole if held else 4 * inner[k][0] > 3 * whole)] if held or not inner[root][1] else []
            for k in wrap:
                k.junk = k.marked = False
            walk, cut = wrap, [k for k in cut if k.marked]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, joined by an empty line; empty if there is none."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    free_wrappers(tree.root)
    found = False
    for owner, text, linked in blocks(tree.root):
        n = owner
        while n.tag not in BLOCK and n.parent is not None:
            n = n.parent
        if n.tag in ("p", "pre", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "dd", "dt", "figcaption") and n.parent is not None:
            n = n.parent
        n.points += points(text)
        n.chars += len(text)
        n.linked += min(linked, len(text))
        found = True
    if not found:
        return ""
    scored, walk = [], [tree.root]
    while walk:
        n = walk.pop()
        scored.append(n)
        walk += [k for k in reversed(n.kids) if isinstance(k, Node) and not k.junk]
    for n in reversed(scored):  # each element after what it holds: half of its points go up
        if n.parent is not None:
            n.parent.points += n.points / 2
            n.parent.chars += n.chars
            n.parent.linked += n.linked

    def worth(n: Node) -> float:
        return n.points * (1 - n.linked / max(n.chars, 1))

    best = max(scored, key=worth)  # of equals the one that the walk met first
    top = worth(best)
    n: Node | None = best
    while n is not None:
        if n.tag in ("article", "main"):
            best = n
            if n.tag == "article":
                break
        n = n.parent
    return "\n\n".join(t for k in beside(best, top, worth) for _, t, _ in blocks(k))


def beside(best: Node, top: float, worth: Callable[[Node], float]) -> list[Node]:
    """The best container with what stands next to it, in page order.

    Beside an article or main, its like that score well; beside any other container, all that is not mostly links, bare
    text too.  Further up, as long as there is no other block, bare text that is not mostly links.
    """
    keep, n = [best], best
    loose = best.tag not in ("article", "main")
    while n.parent is not None:
        before, after = [], []
        alone = not any(isinstance(k, Node) and k is not n and not k.junk and k.tag in BLOCK for k in n.parent.kids)
        if n is not best and not (loose and alone):
            break
        side, run = before, Node("span", None, False)
        for k in [*n.parent.kids, None]:
            if k is not None and k is not n and (isinstance(k, str) or (not k.junk and k.tag not in BLOCK)):
                run.kids.append(k)
                continue
            if loose and run.kids and mostly_text(run):
                side.append(run)
            run = Node("span", None, False)
            if k is n:
                side = after
            elif k is not None and not k.junk and k.tag != "hr" and (loose or (k.tag == best.tag and worth(k) >= max(0.2 * top, 1.0))) and mostly_text(k):
                side.append(k)
        keep = [*before, *keep, *after]
        n = n.parent
    return keep


def mostly_text(n: Node) -> bool:
    text = links = 0
    for _, t, linked in blocks(n):
        text += len(t)
        links += min(linked, len(t))
    return text > 0 and links <= text / 4


def extract(pages: DataFrame, *, html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with ``text_col`` (an input column of that name is replaced).

    Null and empty pages, and pages without text, give an empty string; repeated rows give repeated results, an
    empty table none; pages may be of any length and depth.
    """
    from pyspark.sql import types as T

    pages = pages.drop(text_col)
    schema = T.StructType([*pages.schema.fields, T.StructField(text_col, T.StringType())])
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, text_col])

    return pages.mapInArrow(run, schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
ORACLES: dict[str, str] = {}
