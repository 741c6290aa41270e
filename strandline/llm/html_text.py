"""Main text of web pages by tree scoring.

One pass reads tags into a tree. A paragraph that ends passes points to what it stands in: one, one for each comma and
up to three for its length, whole to the parent, half to the next ancestor, a third and a quarter beyond. Points count
by the share of an element's text that isn't links. The container with most is the article (or the article or main element
it lies in, with others beside it that have a fifth of its text or more); else siblings that score well, or read like
paragraphs of it, are kept too. Scripts, forms, menus,
headers, footers and asides have no points and no text.

Nor have elements whose class or id says advert, notice or comment. This is decided when all are measured: an article
or main element (but one in an article, as comments are) and what holds most of the page's paragraph text stay, the
latter unless the only article or main elements with text stand beside it, as with a long advert and a short article.
Elements of one parent whose names have such a word and one of content are judged together, as parts of one text.
Of names such as comments or cookies, which also long texts beside an article have, what holds most stays only where
no article, main or element named as content has paragraphs outside of it, and an article or main if it does either.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Elements of HTML and words that sites use in class and id.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_DROPPED = frozenset("aside audio button canvas datalist dialog embed fieldset footer form head iframe input label legend math menu meter nav noembed noframes noscript object optgroup option output progress script select style svg template textarea title video xmp".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_PARAGRAPHS = frozenset("blockquote dd dt figcaption h2 h3 h4 h5 h6 li p pre td".split())
_ENDS_SAME = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_ENDS_SAME = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS_SAME.items()}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_START = {"article": 10, "main": 8, "section": 4, "div": 5, "blockquote": 3, "pre": 3, "td": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "form": -3}
_BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
_BAD = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner banners breadcrumb breadcrumbs callout comment comments commentlist consent cookie cookies copyright cta disclaimer disqus donate feedback footer "
    "gdpr masthead menu menus nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription teaser toolbar tooltip trending widget widgets".split()
)
#: These count only where no word of _GOOD stands with them, as in article-header.
_DOUBTFUL = frozenset("announcement byline form header login modal notification overlay responses search skip tags toc".split())
_GOOD = frozenset("article body content entry main post story text".split())
#: Names of what stands beside an article and may be longer.
_BESIDE = frozenset("comment comments commentlist consent cookie cookies copyright disclaimer disqus gdpr newsletter popup recommended related replies reply respond responses trending".split())
#: What comes after these in a name is what an element has, or what it is about.
_ABOUT = frozenset("category has no tag with".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|\d+")
_COMMAS = re.compile("[,،、，]")
_SHORT = 25


class _Node:
    __slots__ = ("tag", "parent", "children", "dropped", "points", "named", "mixed", "depth", "article", "main", "within", "doubt", "declared", "text", "text_commas", "blocks", "score", "length", "links", "anchors", "commas", "own", "read", "beside", "around")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, points: float, named: str = "", mixed: bool = False):
        self.tag, self.parent, self.children, self.dropped, self.points, self.named, self.mixed = tag, parent, [], dropped, points, named, mixed
        self.depth = parent.depth + 1 if parent else 0
        # what this lies in: the nearest article, main element, element named as beside one and element of a bad name; how many articles
        self.article = parent and (parent if parent.tag == "article" else parent.article)
        self.main = parent and (parent if parent.tag == "main" else parent.main)
        self.within = parent and (parent if parent.named == "beside" else parent.within)
        self.doubt = parent and (parent if parent.named in ("bad", "beside") else parent.doubt)
        self.declared = parent.declared + parent.declares() if parent else 0
        self.around = parent and (parent if parent.tag in _BLOCKS or not parent.parent else parent.around)  # the next block up
        self.text = self.text_commas = self.blocks = 0
        self.reset()

    def reset(self) -> None:
        """read: characters of paragraphs without links; beside: those of them in elements named as beside an article."""
        self.score, self.length, self.own, self.commas = self.points, self.text, self.text, self.text_commas
        self.links = self.anchors = self.read = self.beside = 0

    def declares(self) -> bool:
        return self.tag in ("article", "main") and self.named != "beside"

    def density(self) -> float:
        return self.links / self.length if self.length else 0.0

    def worth(self) -> float:
        return self.score * (1 - self.density())


def _named(attributes: str) -> tuple[bool, str, float]:
    """Whether role or style rule an element out; what class and id say: good, bad, beside or nothing; the points they give."""
    points, good, bad, beside = 0.0, False, False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "role" and value in _BAD_ROLES:
            return True, "", 0.0
        if name in ("class", "id"):
            names = [_own_words(x) for x in value.split()]
            words = set().union(*names)
            some = bool(words & _GOOD)
            if words & _BAD or words & _DOUBTFUL and not some:
                bad, beside = True, beside or bool(words & _BESIDE)
            good = good or any(x and x <= _GOOD for x in names)
            points += 10 if some else 0
    return False, "beside" if beside else "good" if good else "bad" if bad else "", points


def _own_words(name: str) -> set[str]:
    words = _WORD.findall(name)
    return set(words[: next((i for i, w in enumerate(words) if w in _ABOUT), len(words))])


class _Reader:
    """Reads tags into a tree, rules elements out and scores the others in the order in which they end."""

    def __init__(self):
        self.top = self.at = _Node("", None, False, 0.0)
        self.doubted: list[_Node] = []
        self.scored: list[_Node] = []
        self.articles: list[_Node] = []
        self.open: dict[str, list[_Node]] = defaultdict(list)  # elements of each tag that are open, the innermost last
        self.blind: set[int] = set()  # places of quotes from which no tag ends

    def text(self, data: str) -> None:
        node = self.at
        if node.dropped:
            return
        data = html.unescape(data) if "&" in data else data
        node.children.append(data)
        n = len(" ".join(data.split()))
        node.text += n
        node.text_commas += len(_COMMAS.findall(data)) if n else 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            if self.at.tag == "p" or self.at.tag not in _BLOCKS and self._open("p"):
                self.end("p")
            if tag in _ENDS_SAME:
                same, within = (max((self.open[x][-1] for x in tags if self.open[x]), key=lambda node: node.depth, default=self.top) for tags in _ENDS_SAME[tag])
                if same.depth > within.depth:
                    self._leave(same)
        up = self.at
        inside = up.tag == "article" or up.article is not None
        dropped = up.dropped or tag in _DROPPED or tag == "header" and not inside
        points, named, more = float(_START.get(tag, 0)), "", 0.0
        if attributes and not dropped and tag not in ("html", "body"):
            dropped, named, more = _named(attributes)
            points += more
            if tag == "header" and inside:
                dropped, named = False, ""
        node = _Node(tag, up, dropped, points, named, named == "bad" and more > 0)
        up.children.append(node)
        up.blocks += tag in _BLOCKS
        if named in ("bad", "beside"):
            self.doubted.append(node)
        if tag not in _VOID:
            self.at = node
            self.open[tag].append(node)

    def _leave(self, node: _Node) -> None:
        """End an open element and those in it."""
        while self.at is not node.parent:
            self.open[self.at.tag].pop()
            self.at = self.at.parent

    def _open(self, tag: str) -> bool:
        """Whether such an element is the next block around."""
        return bool(self.open[tag]) and self.at.around.tag == tag

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        node = self.open[tag][-1]
        if tag not in _BLOCKS and self.at is not node and (self.at.tag in _BLOCKS or self.at.around.depth > node.depth):
            return  # an inline element ends within its block
        self._leave(node)

    def tag_end(self, page: str, i: int) -> int:
        """Place of the > that ends a tag whose name ends at i, quoted ones not counted; -1 if none does.

        Where a search ended in vain, any other one that meets one of its quotes does, too, and isn't made again."""
        met = []
        while (m := _MARK.search(page, i)) and m[0] != ">":
            i = -1 if m.start() in self.blind else page.find(m[0], m.end())
            met.append(m.start())
            if i < 0:
                break
            i += 1
        if m and m[0] == ">":
            return m.start()
        self.blind.update(met)
        return -1

    def measure(self) -> None:
        """Lengths and scores of what isn't ruled out."""
        self.scored, self.articles, todo = [], [], [(self.top, False)]
        while todo:
            node, ends = todo.pop()
            if ends:
                self._end(node)
                continue
            node.reset()
            if node.tag in ("article", "main"):
                self.articles.append(node)
            todo.append((node, True))
            todo.extend((x, False) for x in reversed(node.children) if isinstance(x, _Node) and not x.dropped)

    def _end(self, node: _Node) -> None:
        up = node.parent
        if not up:
            return
        if node.tag == "a":
            node.links, node.anchors = node.length, node.anchors + 1
        if node.tag in _PARAGRAPHS or node.tag in _BLOCKS and node.own >= _SHORT:
            self._pass_points(node)
        up.length += node.length
        up.links += node.links
        up.anchors += node.anchors
        up.commas += node.commas
        up.read += node.read
        up.beside += node.read if node.named == "beside" else node.beside
        if node.tag not in _BLOCKS:
            up.own += node.own

    def rule_out(self) -> bool:
        """Whether any element is ruled out by its name."""
        clean: set[_Node | None] = set()  # elements beside an article (None: the page) that hold content with paragraphs of its own
        articles: dict[_Node | None, int] = defaultdict(int)  # elements of a bad name, and the articles with text right in them
        todo = [self.top]
        while todo:
            x = todo.pop()
            if (x.declares() or x.named == "good") and x.read > x.beside:
                clean.add(x.within)
            if x.declares() and x.length > x.links:
                articles[x.doubt] += 1
            todo.extend(c for c in x.children if isinstance(c, _Node) and not c.dropped)
        holds = {x: articles[x] > 0 for x in self.doubted}
        for x in reversed(self.doubted):  # inner ones first
            if x.doubt and x.named == "bad":
                holds[x.doubt] |= holds[x]
        parts: dict[_Node, float] = defaultdict(float)  # what a text has that was split among elements with names both good and bad
        for x in self.doubted:
            if x.mixed:
                parts[x.parent] += x.read
        outside: dict[_Node | None, bool] = {None: False}
        around = {None: 0}
        for x in self.doubted:  # outer ones first
            around[x] = around[x.doubt] + articles[x.doubt]
            other = around[x] > x.declared  # an article that isn't around it
            most, declared = 2 * (parts[x.parent] if x.mixed else x.read) > self.top.read, x.tag in ("article", "main") and x.article is None
            if x.named == "beside":
                outside[x] = outside[x.within] or x.within in clean
                x.dropped = not (most and declared or (most or declared) and not outside[x] and not other)
            else:
                x.dropped = not (declared or most and (holds[x] or not other))
        return any(x.dropped for x in self.doubted)

    def _pass_points(self, node: _Node) -> None:
        if node.length < _SHORT or node.tag == "li" and node.density() > 0.5:
            return
        if node.tag not in _PARAGRAPHS:  # text right in a container
            points, to, share = (1 + node.commas + min(node.own / 100, 3)) * (node.own / node.length), node, 1
        elif node.blocks and node.own < _SHORT:
            return  # what stands in it has passed points
        else:
            points, to, share = 1 + node.commas + min(node.length / 100, 3), node.parent, 1
        if node.tag not in _HEADINGS:
            node.read += (node.own if node.blocks else node.length) * (1 - node.density())
        while to.parent and share <= 4:
            if to.tag in _BLOCKS:
                to.score += points / share
                self.scored.append(to)
                share += 1
            to = to.around


def parse(page: str) -> _Reader:
    reader, i, n = _Reader(), 0, len(page)
    while i < n:
        j = page.find("<", i)
        if j < 0:
            j = n
        if j > i:
            reader.text(page[i:j])
        if j == n:
            break
        if page.startswith("<!--", j):
            k = page.find("-->", j + 4)
            i = n if k < 0 else k + 3
        elif page[j + 1 : j + 2] in ("!", "?"):
            k = page.find(">", j)
            i = n if k < 0 else k + 1
        elif not (m := _NAME.match(page, j)):
            reader.text("<")
            i = j + 1
        elif (k := reader.tag_end(page, m.end())) < 0:
            k = page.find(">", j)  # a tag with an odd quote
            i = n if k < 0 else k + 1
        else:
            i, tag, attributes = k + 1, m[2].lower(), page[m.end() : k]
            if m[1]:
                reader.end(tag)
                continue
            reader.start(tag, attributes)
            if tag in _RAW:
                k = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(page, i)
                i = k.start() if k else n
            elif attributes.endswith("/") and tag not in _BLOCKS and reader.at.tag == tag:
                reader.end(tag)
    reader.measure()
    if reader.doubted and reader.rule_out():
        reader.measure()
    return reader


def _chosen(reader: _Reader) -> list[_Node]:
    best = max((x for x in reader.scored if not x.dropped), key=_Node.worth, default=None)
    if best is None or best.worth() <= 0:
        return [max(reader.articles, key=lambda x: x.length)] if reader.articles else [reader.top]
    if any(x.tag == "article" for x in reader.articles):
        best = best if best.tag == "article" else best.article or best
    else:
        best = best if best.tag == "main" else best.main or best
    if best.tag in ("article", "main") and best.parent:
        # an element that says it is the article is all of it; a text may be split among several, or a page have some
        return [x for x in best.parent.children if x is best or isinstance(x, _Node) and x.tag == best.tag and not x.dropped and not x.named and 5 * x.read >= best.read > 0]
    if best.tag in ("body", "html") or not best.parent:
        return [best]
    bar = max(10.0, 0.2 * best.worth())

    def belongs(x: _Node) -> bool:
        if x is best:
            return True
        if x.dropped or not x.length:
            return False
        if x.tag == "p":
            return x.length > 80 and x.density() < 0.25
        return x.tag in _HEADINGS or x.tag in _BLOCKS and x.tag not in ("ul", "ol", "table") and x.worth() >= bar

    return [x for x in best.parent.children if isinstance(x, _Node) and belongs(x)]


def main_text(page: str) -> str:
    """Blocks of the article's text, one a line; empty if there is none."""
    blocks, now = [], []

    def flush() -> None:
        if text := " ".join("".join(now).split()):
            blocks.append(text)
        now.clear()

    for root in _chosen(parse(page)):
        todo: list = [root]
        declared = root.tag in ("article", "main")  # its lists of links are its own, as of references
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                now.append(x)
            elif x.tag == "br":
                now.append(" ")
            elif not x.dropped and not (not declared and not x.article and x.tag in ("ul", "ol", "div", "section", "table") and x is not root and x.anchors >= 3 and x.density() > 0.66):
                if x.tag in _BLOCKS:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
        flush()
    return "\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages.

    White space in a block becomes one space, br too; blocks are in page order, one a line. Null and empty html, and
    pages without text, give an empty text. Containers that tie go to the first. Ids and urls may be null; repeated
    rows are extracted alike, and rows of one id each by its own html. A very long page is one row's work, in
    proportion to its length, however its tags are nested. Without pages there are no rows; other columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracted, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
