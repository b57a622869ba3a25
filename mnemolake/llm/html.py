"""HTML extraction: text-to-tag ratios over streaming parser events.

The standard library's parser cuts a page into lines, one for each block element; what lies inside elements that are
never main text (menus, forms, buttons, scripts ...) isn't read at all. Each line has a ratio: characters outside links
for each of its tags. The ratios are smoothed with a Gaussian and split at their standard deviation into two clusters; the lines
above are seeds. Seed text, that is what the ratios say, then decides three things:
* whether an element that is named after what surrounds an article (class, id or role) is that or a wrapper of the text;
* which article or main element is the page's, if one holds a good part of the seed text;
* else which is the smallest container that holds nearly all of it.
Of an article or main element all lines are given, but for what surrounding elements hold. Of a container, lines of
links in a row are a menu, and go, where MENU_LINES of them or more are in the lower cluster.

Defined results: null, empty and text-free pages give the empty text; broken markup is read as far as it goes; equal
pages give equal rows. Time is linear in the page, also where elements are never closed.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import arrow_map

#: Elements of HTML by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset(("td", "th"))
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
#: Elements that are never main text.
DROPPED = frozenset("aside audio button canvas datalist dialog footer form frameset head iframe label map menu nav noframes noscript object option script select style svg template textarea title video".split())
#: A class, id or role that starts with one of these words names what surrounds an article.
SURROUND = frozenset("ads adsbygoogle adsense adslot advert adverts breadcrumb breadcrumbs commentlist disqus footnav gdpr masthead navbar outbrain sidebar sidenav sponsored taboola tagcloud".split())
#: So does one of these words among nothing but words of place and form, as in "comments", "post-comments" or "cookie-notice".
AROUND = SURROUND | frozenset(
    "ad advertisement advertisements advertising alert alertdialog banner comment comments complementary consent contentinfo cookie cookies copyright disclaimer dialog feedback footer login menu menubar modal nav navigation newsletter notice notices"
    " notification notifications overlay pager pagination paywall popup promo promoted promotion recommendations recommended related replies reply respond rss search share sharing shares signup skip social sponsor sponsors subscribe subscription"
    " teaser teasers toolbar topbar tracking widget widgets".split()
)
#: Words of place and form.
PLACES = frozenset(
    "a all also and area article articles bar block body bottom box btn button buttons by center column container content entry fixed follow for form full global google group has header holder home icons in inner item items large layout left links link list"
    " local main message more new no of on page panel post posts primary read region right row secondary section site slot small stories sticky story text the this thread title to top unit us wide wrap wrapper you your zone".split()
)
#: A new one closes open ones of the first list, up to the nearest other block.
_CLOSES = {"li": "p li", "dt": "p dt dd", "dd": "p dt dd", "tr": "p tr td th", "td": "p td th", "th": "p td th"}
_CLOSES = {k: frozenset(v.split()) for k, v in _CLOSES.items()}
_PARAGRAPH = frozenset(("p",))
_WHOLE = frozenset(("html", "body", "main"))
_SMALL = frozenset("p li tr td th pre h1 h2 h3 h4 h5 h6 dt dd".split())
_TOKEN = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: The share of seed text that an article or main element has to hold, and that a container has to.
ELEMENT_SHARE, CONTAINER_SHARE = 0.25, 0.8
#: So many lines of links in a row are a menu; a line is one of links if at most this share of it is outside them.
MENU_LINES, OUTSIDE_SHARE = 3, 0.1
#: Attributes that mark an advert.
ADVERT_DATA = ("data-ad", "data-ad-slot", "data-ad-client", "data-ad-unit", "data-google-query-id")


class _Node:
    """A block element: what it is named after (None, or whether the word leads), whether an article or main is inside it, its seed text."""

    __slots__ = ("name", "up", "named", "holds", "seed", "out", "within")

    def __init__(self, name: str, up: _Node | None, named: bool | None):
        self.name, self.up, self.named, self.holds, self.seed, self.out = name, up, named, False, 0, False
        #: the outermost article and main at or above it
        self.within = dict(up.within) if up and (up.within or name in ("article", "main")) else {} if name in ("article", "main") else up.within if up else {}
        if name in ("article", "main"):
            self.within.setdefault(name, self)


class _Line:
    __slots__ = ("text", "weight", "tags", "node")

    def __init__(self, text: str, links: int, tags: int, node: _Node):
        self.text, self.weight, self.tags, self.node = text, len(text) - min(links, len(text)), tags, node


class _Reader(HTMLParser):
    """Collects lines and the blocks that they are in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [_Node("", None, None)]
        self.lines: list[_Line] = []
        self.open: list[tuple[str, bool, _Node | None]] = []  # element, whether it starts something dropped, its node if it is a block
        self.places: dict[str, list[int]] = {}  # where elements of a name are in open
        self.blocks: list[int] = []
        self.parts: list[str] = []
        self.links = self.tags = self.drop = 0

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers aren't needed."""
        return j

    def _node(self) -> _Node:
        return self.open[self.blocks[-1]][2] if self.blocks else self.nodes[0]

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(_Line(text, self.links, self.tags, self._node()))
        self.parts, self.links, self.tags = [], 0, 0

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            name, dropping, node = self.open.pop()
            self.places[name].pop()
            self.drop -= dropping
            if node is not None:
                self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block, cell = tag in BLOCKS, tag in CELLS
        if (block or cell) and not self.drop:
            if block:
                self.cut()
            else:
                self.parts.append(" ")
            closed = _CLOSES.get(tag, _PARAGRAPH)
            while self.blocks and self.open[self.blocks[-1]][0] in closed:
                self._pop_to(self.blocks[-1])
        elif tag == "br" and not self.drop:
            self.parts.append(" ")
        if not self.drop:
            self.tags += 1
        if tag in VOID:
            return
        up = self._node()
        named = None if self.drop else self._named(tag, attrs, up)
        dropping = tag in DROPPED or tag == "header" and not up.within or self._hidden(tag, attrs) or named is not None and not (block or cell)
        node = None
        if block or cell:
            node = _Node(tag, up, named)
            self.nodes.append(node)
            self.blocks.append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, dropping, node))
        self.drop += dropping

    def _hidden(self, tag: str, attrs: list) -> bool:
        if tag in _WHOLE:
            return False
        return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _UNSEEN.search(value) for name, value in attrs)

    def _named(self, tag: str, attrs: list, up: _Node) -> bool | None:
        """Whether a class, id or role starts with a word for what surrounds an article; None where none has such a word."""
        if tag in _WHOLE:
            return None
        found = None
        for name, value in attrs:
            if name in ADVERT_DATA:
                return True
            if name in ("class", "id", "role") and value:
                for one in value.lower().split():
                    tokens = _TOKEN.findall(one)
                    if not tokens:
                        continue
                    plain = all(t in AROUND or t in PLACES for t in tokens)
                    if tokens[0] in SURROUND or plain and tokens[0] in AROUND:
                        return True
                    if plain and tag != "article" and not AROUND.isdisjoint(tokens):
                        found = False
                    if plain and "header" in tokens and not up.within and not {"article", "entry", "post", "story", "title"} & set(tokens) and ("site" in tokens or "page" in tokens or up.name == "body"):
                        found = False
        return found

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCKS
        if not self.drop:
            if block:
                self.cut()
            elif tag == "br" or tag in CELLS:
                self.parts.append(" ")
            self.tags += 1
        places = self.places.get(tag)
        # an inline element doesn't end beyond the block that it would end in
        if places and (block or tag in CELLS or not self.blocks or places[-1] > self.blocks[-1]):
            self._pop_to(places[-1])

    def handle_data(self, data: str) -> None:
        if not self.drop:
            self.parts.append(data)
            if self.places.get("a"):
                self.links += len(data.strip())


def _smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = 2
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    edged = np.concatenate([np.full(reach, x[0]), x, np.full(reach, x[-1])])
    return np.convolve(edged, kernel / kernel.sum(), mode="valid")


def _ratios(lines: list[_Line]) -> np.ndarray:
    return _smooth(np.array([x.weight / max(1, x.tags) for x in lines], dtype=np.float64))


def _weigh(nodes: list[_Node], seeds: list[_Line]) -> int:
    """Gives each block the seed text inside it; returns that of the page. A block comes after the one that it is in."""
    for node in nodes:
        node.seed = 0
    for line in seeds:
        line.node.seed += line.weight
    for node in reversed(nodes):
        if node.up:
            node.up.seed += node.seed
    return nodes[0].seed


def _judge(nodes: list[_Node], total: int) -> None:
    """Marks blocks that are named after what surrounds an article, and all inside them.

    Such a block stays if it holds most seed text and either an article or main element, or the word doesn't lead.
    """
    for node in reversed(nodes):
        if node.up and (node.holds or node.name in ("article", "main")):
            node.up.holds = True
    for node in nodes[1:]:
        named = node.named is not None and (2 * node.seed <= total or node.named and not node.holds)
        node.out = node.up.out or named


def _without_menus(lines: list[_Line], low: set[_Line]) -> list[_Line]:
    """Lines without runs of links that have MENU_LINES in the lower cluster; all of them where nothing but links is left."""
    out, run = [], []
    for line in [*lines, None]:
        if line is not None and line.weight <= OUTSIDE_SHARE * len(line.text):
            run.append(line)
            continue
        out += run if len(low.intersection(run)) < MENU_LINES else []
        run = []
        if line is not None:
            out.append(line)
    return out if any(x.weight > OUTSIDE_SHARE * len(x.text) for x in out) else lines


def _region(nodes: list[_Node], lines: list[_Line], seeds: list[_Line], low: set[_Line]) -> list[_Line]:
    """The lines of the selected region, of lines that are in none that surrounds. low: those of the lower cluster."""
    total = _weigh(nodes, seeds)
    for element in ("article", "main"):
        held = {line.node.within[element]: None for line in lines if element in line.node.within}
        best = max(held, key=lambda node: node.seed, default=None)
        if best is not None and best.seed >= ELEMENT_SHARE * total:
            return [x for x in lines if x.node.within.get(element) is best]
    # descend from the page while one block holds nearly all seed text
    heaviest: dict[_Node, _Node] = {}
    for node in nodes[1:]:
        if node.up not in heaviest or node.seed > heaviest[node.up].seed:
            heaviest[node.up] = node
    chosen = nodes[0]
    while (down := heaviest.get(chosen)) is not None and down.name not in _SMALL and down.seed >= CONTAINER_SHARE * total:
        chosen = down
    inside = {chosen}
    for node in nodes:
        if node.up in inside:
            inside.add(node)
    return _without_menus([x for x in lines if x.node in inside], low)


def main_text(page: str) -> str:
    reader = _Reader()
    reader.feed(page)
    reader.close()
    reader.cut()
    nodes, lines = reader.nodes, reader.lines
    if not lines:
        return ""
    ratios = _ratios(lines)
    upper = ratios >= ratios.std()
    above = [x for x, up in zip(lines, upper, strict=True) if up]
    _judge(nodes, _weigh(nodes, above))
    live = [x for x in lines if not x.node.out]
    seeds = [x for x in above if not x.node.out] or live
    return "\n".join(x.text for x in _region(nodes, live, seeds, {x for x, up in zip(lines, upper, strict=True) if not up}))


@arrow_map(pa.string())
def _main_text(page: str | None) -> str:
    return main_text(page or "")


def extract_text(html: Column) -> Column:
    """The main text of each page; null gives the empty text."""
    return _main_text(html.cast("string"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", extract_text(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
