"""Main text of HTML pages by scoring the tree of elements.

A block with running text is a paragraph. It earns points for its length and its commas and passes them to the elements
around it: all to its parent, half to the next, less to those beyond. An element's points are discounted by the share of
its text that is in links. The best element is the article; elements beside it are kept if they score well or read like
running text. Elements that are something else by their tag, role or style never count. A word of a class or id only
casts doubt: what is in doubt has a share of its points, and hands none on. Inside the article it stays if it reads like
running text, unless its class says nothing but that it is something else.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Element names of HTML by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt "
    "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
NOT_TEXT = frozenset(
    "annotation annotation-xml aside audio button canvas datalist dialog embed footer form head header iframe input map menu nav noframes "
    "noscript object optgroup option progress script select style svg template textarea title video".split()
)
# Elements that end an open paragraph of the same kind.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("article section div main body table ul ol dl blockquote td th html".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OTHER_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising adverting banner banners breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus donate feedback footer "
    "footnav gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification "
    "notifications pager pagination paywall popup promo promos promoted promotion recommended related replies "
    "reply respond rss share sharing shoutbox sidebar sidebars signup skyscraper social sponsor sponsored subscribe "
    "subscription tagcloud toolbar topbar".split()
)
# Words that say where an element is or what it is for its layout, and nothing about its text.
FRAME_WORDS = frozenset(
    "area bar block body bottom box button buttons column container content group inner item items left link links list "
    "outer panel post posts right row section text thread title top widget widgets wrap wrapper".split()
)
ARTICLES = frozenset(("article", "main"))
# What an article element may be instead of the article.
OTHER_ARTICLES = frozenset("comment comments related replies reply promo sponsored teaser".split())
# Words by which a class of its own says that an element holds the article.
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RUNNING = frozenset("p pre td li blockquote dd".split())
# Points.
MIN_PARAGRAPH_CHARS = 25
CHARS_PER_POINT = 100
MAX_LENGTH_POINTS = 3
ARTICLE_POINTS = 25
SIBLING_SHARE = 0.2
MIN_SIBLING_POINTS = 10
MAX_SIBLING_LINKS = 0.25
# Of what stands between two kept siblings.
MAX_INNER_LINKS = 0.5
SENTENCE_ENDS = tuple(".!?…。！？:;\"'”’»)")
DOUBT_SHARE = 0.2

_WORD = r"[a-z]+"
# A page "with a sidebar" is not one.
_ABOUT_OTHERS = r"\b(?:has|no|with|without)[-_ ]+[a-z]+"
_HIDDEN = r"display\s*:\s*none|visibility\s*:\s*hidden"


class _Node:
    __slots__ = ("tag", "parent", "block", "parts", "other", "doubt", "doubted", "points", "chars", "linked")

    def __init__(self, tag: str, parent: _Node | None, other: bool, doubt: str = ""):
        self.tag, self.parent, self.other = tag, parent, other
        self.block: _Node = parent.block if tag in INLINE and parent is not None else self
        # The attribute that casts doubt on the element, and whether it or an element around it is in doubt.
        self.doubt = doubt
        self.doubted = bool(doubt) and tag not in INLINE or parent is not None and parent.doubted
        self.parts: list[_Node | str] = []
        self.points = 0.0
        self.chars = self.linked = 0

    def links(self) -> float:
        return self.linked / self.chars if self.chars else 0.0

    def score(self) -> float:
        return self.points * (1 - self.links())

    def reads(self) -> bool:
        """Whether an element inside the article belongs to it, in spite of the words of its class or id."""
        if not self.doubt:
            return True
        if self.links() >= MAX_SIBLING_LINKS:
            return False
        return self.tag in INLINE or self.doubt != "sure" and self.points > 0


def _is_other(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is not part of an article, by its tag, role or style."""
    if tag in NOT_TEXT:
        return True
    if tag in ("html", "body"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and (value or "").strip().lower() in ROLES:
            return True
        if name == "style" and re.search(_HIDDEN, value or "", re.I):
            return True
    return False


def _words(value: str) -> set[str]:
    """Words of a class or id, which are cut at case changes, too: "siteFooter"."""
    return set(re.findall(_WORD, re.sub(_ABOUT_OTHERS, " ", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())))


def _doubt(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """The attribute, class before id, whose words say that an element is something else; "sure" if one of its classes
    says only that; empty if none does."""
    if tag in ("html", "body"):
        return ""
    words = OTHER_ARTICLES if tag in ARTICLES else OTHER_WORDS
    found = ""
    for name, value in attrs:
        if name not in ("class", "id") or not value:
            continue
        if name == "id" and tag in HEADINGS:
            continue  # made from the title
        if name == "class" and any(one.lower() in CONTENT_WORDS for one in value.split()):
            continue
        said = _words(value)
        if name == "id" and tag == "section" and not said <= words:
            continue  # made from a title, too
        if words.isdisjoint(said):
            continue
        if name == "id":
            found = found or "id"
        elif any(one and not words.isdisjoint(one) and one <= words | FRAME_WORDS for one in map(_words, value.split())):
            found = "sure"
        elif found != "sure":
            found = "class"
    return found


class _Tree(HTMLParser):
    """Builds the tree as browsers do where it matters for text: open paragraphs end before a block, end tags without
    an open element do nothing, and what is open at the end of the page is closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("html", None, False)
        self.nodes = [self.root]
        # How many elements of each kind are open; inline ones by the block they are in.
        self.open: Counter = Counter()

    def parse_marked_section(self, i, report=1):
        """What browsers take for a comment, whatever word it begins with."""
        return self.parse_bogus_comment(i, 0)

    def _key(self, node: _Node):
        return (node.tag, id(node.block)) if node.tag in INLINE else node.tag

    def _close(self, node: _Node) -> None:
        """Close an open element and all that is open inside it."""
        while self.here is not node.parent:
            self.open[self._key(self.here)] -= 1
            self.here = self.here.parent

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr"):
                self.here.parts.append(" ")
            return
        if tag not in INLINE:
            self._end_open(("p",))
            if tag in ENDS:
                self._end_open(ENDS[tag])
        node = _Node(tag, self.here, self.here.other or _is_other(tag, attrs), _doubt(tag, attrs))
        self.here.parts.append(node)
        self.nodes.append(node)
        self.here = node
        self.open[self._key(node)] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE and self.here.tag == tag and tag not in SCOPES and tag != "p":
            self._close(self.here)

    def _end_open(self, tags: tuple[str, ...]) -> None:
        if not any(self.open[tag] > 0 for tag in tags):
            return
        node = self.here
        while node is not None and node.tag not in tags:
            if node.tag in SCOPES and node.tag not in tags:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self._close(node)

    def handle_endtag(self, tag):
        # An inline end tag does not close blocks, and one without its element does nothing.
        if self.open[(tag, id(self.here.block)) if tag in INLINE else tag] <= 0:
            return
        node = self.here
        while node.tag != tag:
            node = node.parent
        self._close(node)

    def handle_data(self, data):
        if not self.here.other:
            self.here.parts.append(data)


def _own_text(node: _Node) -> str:
    """The text of a block that is not in blocks of its own."""
    found, todo = [], [iter(node.parts)]
    while todo:
        for part in todo[-1]:
            if isinstance(part, str):
                found.append(part)
            elif part.tag in INLINE and not part.other and part.reads():
                todo.append(iter(part.parts))
                break
        else:
            todo.pop()
    return " ".join("".join(found).split())


def _whole_text(parts: list[_Node | str], doubts: bool = True) -> str:
    """All text of what is given, in page order; blocks are apart by a space. With ``doubts``, elements in doubt inside
    them count only if they read like running text."""
    found: list[str] = []
    todo: list[Iterator] = [iter(parts)]
    while todo:
        for part in todo[-1]:
            if isinstance(part, str):
                found.append(part)
            elif not part.other and (len(todo) == 1 or not doubts or part.reads()):
                todo.append(iter(part.parts))
                if part.tag not in INLINE:
                    found.append(" ")
                    # A block ends where its parts do.
                    todo[-1] = iter([*part.parts, " "])
                break
        else:
            todo.pop()
    return " ".join("".join(found).split())


def _with_siblings(best: _Node, needed: float) -> list[_Node | str]:
    """The best container and what belongs to it of that beside it: what scores well or reads like sentences, all
    unmarked between these, and the headings right before."""

    def belongs(node: _Node | str) -> bool:
        if isinstance(node, str) or node.other or node.tag in INLINE or node.doubt or node.links() >= MAX_SIBLING_LINKS:
            return False
        return node.score() >= needed or node.chars >= MIN_PARAGRAPH_CHARS and _whole_text([node]).endswith(SENTENCE_ENDS)

    beside = best.parent.parts
    kept = [i for i, node in enumerate(beside) if node is best or belongs(node)]
    first, last = kept[0], kept[-1]
    inside = [
        node for node in beside[first : last + 1]
        if isinstance(node, str) or node is best or not node.other and not node.doubt and node.links() < MAX_INNER_LINKS
    ]
    headings: list[_Node | str] = []
    for node in reversed(beside[:first]):
        if isinstance(node, str):
            if node.strip():
                break
        elif node.tag in HEADINGS and not node.other and not node.doubt:
            headings.insert(0, node)
        elif not node.other and not node.doubt:
            break
    return headings + inside


def main_text(html: str) -> str:
    """The article of a page as one line of text; empty if there is none. Whatever the markup, there is a tree: what
    browsers take for a comment is one, end tags without their element do nothing."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = [node for node in tree.nodes if not node.other]

    # Lengths from the leaves up: children come after their parents.
    for node in reversed(nodes):
        node.chars += sum(len(part.strip()) for part in node.parts if isinstance(part, str))
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None and (not node.doubt or node.tag in INLINE):
            node.parent.chars += node.chars
            node.parent.linked += node.linked

    for node in nodes:
        if node.tag in INLINE:
            continue
        text = _own_text(node)
        if len(text) < MIN_PARAGRAPH_CHARS:
            continue
        points = 1 + text.count(",") + min(len(text) // CHARS_PER_POINT, MAX_LENGTH_POINTS)
        up, level = (node.parent if node.tag == "p" or node.parent is not None else node), 0
        if node.tag not in RUNNING or node.doubt:
            node.points += points  # running text straight in a container
        below = node
        while up is not None and (below is up or not below.doubt):
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            below, up, level = up, up.parent, level + 1

    for node in nodes:
        if node.tag in ARTICLES and node.chars:
            node.points += ARTICLE_POINTS
    weight = lambda node: node.score() * (DOUBT_SHARE if node.doubted else 1)
    blocks = [node for node in nodes if node.tag not in INLINE]
    best = max(blocks, key=weight)
    if best.points == 0:
        return _whole_text([tree.root]) or _whole_text([tree.root], doubts=False)
    if best.parent is None:
        return _whole_text([best])
    return _whole_text(_with_siblings(best, max(MIN_SIBLING_POINTS, SIBLING_SHARE * best.score())))


@F.arrow_udf(StringType())
def extract_text(pages: pa.Array) -> pa.Array:
    """Main texts of whole pages; a null page has the empty text."""
    return pa.array([main_text(page.as_py()) if page.is_valid else "" for page in pages], pa.string())


def extract(pages: DataFrame, html: str = "html", into: str = "text", chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text of ``html`` and its length in code points in place of ``html``.

    Null and empty pages, and pages without any text, have the empty text. Rows are handled one by one where they are:
    repeated rows, null ids and other columns stay as they are, but for those named like the new ones, which are
    replaced. An empty table stays empty. Nothing is shuffled.
    """
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in (html, into, chars)]
    found = pages.select(*keep, extract_text(F.col(f"`{html}`")).alias(into))
    return found.withColumn(chars, F.char_length(F.col(f"`{into}`")).cast("bigint"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages)
