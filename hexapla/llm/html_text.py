"""Main text of web pages by composite text density.

Every DOM node gets a composite density: its characters per tag, damped by the share of them in links and weighed by
what its tag, role, class and id say. Tags such as nav and footer, and names such as advert or comments, never take a
node away: they weigh its density by `NAMED`, and its characters and tags count that much less in the nodes above it. A
node's density sum adds up those of its children and of its own text; the node with the largest sum leads to the article.

The threshold is `SLACK` times the smallest density on the path from body to that node. The maximum-sum subtree below
every node that reaches it is content. The container is the highest node on the path of whose text all but `STRAY` is content
by then (body only if no `HOLDERS` element is below it on the path): inside it a block goes only if it is below the threshold and most of its text is in links or
something speaks against it, as short paragraphs of an article fall below any threshold. The tags article and main have
no part in this.

What speaks against a node says nothing if almost all of the page's text is in nodes of the same name (a wrapper called
"with-sidebar", a form around the page), unless as much text as a quarter of theirs is in article or main elsewhere.

Defined results: null or empty html gives an empty text; markup that the parser gives up on is stripped by
pattern; a page without body counts as its own body; `br` and table cells are white space inside their block;
scripts, styles, form controls and hidden elements have no text; of equal sums the outermost node counts, in page
order; repeated rows are treated alone; an empty table gives an empty one; further columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hexapla.llm.common import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Without text of the page: code, replaced elements and form controls.
DROPPED = frozenset("script style noscript template iframe svg canvas object button select option textarea input head".split())
#: Tags, roles, and words and stems of class and id that speak against a node.
TAGS = frozenset("nav footer aside header dialog menu form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
WORDS = frozenset("ad ads adv nav menu toc login signup tags share sharing byline meta pager pagination toolbar consent gdpr".split())
STEMS = ("advert", "sponsor", "promo", "banner", "sidebar", "sidenav", "navbar", "navigation", "breadcrumb", "footer", "masthead", "comment", "respond",
    "disqus", "cookie", "notice", "popup", "modal", "overlay", "social", "related", "recommend", "newsletter", "subscri", "widget", "disclaimer", "siteheader")
KEPT = frozenset("html body article main".split())
NAMED = 0.01  # the weight of a node that something speaks against
SLACK = 0.5
STRAY = 0.34
FEW = 8  # names are void on nodes with so many times the text of all others
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("article section main div td center table".split())
#: A start tag in the first set ends an open element of the second, up to the nearest element of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def _suspicions(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> set[str]:
    """What speaks against the node: its tag, role, and words and stems of class and id."""
    if tag in KEPT:
        return set()
    found = {f"<{tag}>"} if tag in TAGS and not (tag == "header" and in_article) else set()
    for name, value in attrs:
        if value and name == "role" and value.strip().lower() in ROLES:
            found.add(f"role {value.strip().lower()}")
        if value and name in ("class", "id"):
            for n in _NAME.findall(_CAMEL.sub("-", value).lower()):
                if n in WORDS:
                    found.add(n)
                elif n.startswith(STEMS):
                    found.add(next(x for x in STEMS if n.startswith(x)))
    return found


class _Tree(HTMLParser):
    """Nodes as parallel lists in page order; a node's text pieces are kept with their place."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.noise = ["#root"], [-1], [False]
        self.suspect: dict[int, set[str]] = {}
        self.pieces: list[tuple[int, str, int]] = []  # (node, text, nodes begun so far), in page order
        self.open = [0]
        self.articles = 0

    def _add(self, tag: str, noise: bool) -> int:
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.noise.append(noise or self.noise[self.open[-1]])
        return len(self.tag) - 1

    def _pop_to(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.articles -= self.tag[node] == "article"
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            for d in range(len(self.open) - 1, 0, -1):
                name = self.tag[self.open[d]]
                if name == "p":
                    self._pop_to(d)
                    break
                if name in BLOCKS:
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for d in range(len(self.open) - 1, 0, -1):
                name = self.tag[self.open[d]]
                if name in ends:
                    self._pop_to(d)
                    break
                if name in stops:
                    break
        node = self._add(tag, tag in DROPPED or _hidden(attrs))
        if words := _suspicions(tag, attrs, bool(self.articles)):
            self.suspect[node] = words
        if tag not in VOID:
            self.open.append(node)
            self.articles += tag == "article"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for d in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[d]] == tag:
                self._pop_to(d)
                return
            if tag == "p" and self.tag[self.open[d]] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        node = self.open[-1]
        if not self.noise[node]:
            self.pieces.append((node, data, len(self.tag)))


def composite_density(c: float, t: float, lc: float, lt: float, body_ratio: float) -> float:
    """Characters per tag, times a logarithm whose base grows, and whose argument falls, with the share of links.

    c, t: characters and tags below a node; lc, lt: those in links; body_ratio: the body's share of linked characters."""
    if c <= 0:
        return 0.0
    t = max(t, 1.0)
    base = math.log(c / max(c - lc, 1.0) * lc + body_ratio * c + math.e)
    return c / t * max(math.log(c / max(lc, 1.0) * t / max(lt, 1.0)), 0.0) / max(math.log(base), 0.05) if lc or c > 1 else c


def _below(values: list[float], parent: list[int]) -> list[float]:
    """Sums of each node's value and those below it."""
    out = list(values)
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i]
    return out


def _suspects(tree: _Tree, own: list[int]) -> set[int]:
    """Nodes that something speaks against which isn't void."""
    if not tree.suspect:
        return set()
    n, tag, parent = len(tree.tag), tree.tag, tree.parent
    in_article, under = [False] * n, [False] * n
    for i in range(1, n):
        in_article[i] = in_article[parent[i]] or tag[i] in ("article", "main")
        under[i] = under[parent[i]] or i in tree.suspect
    chars = _below(own, parent)
    stated = _below([own[i] if in_article[i] else 0 for i in range(n)], parent)
    free = sum(own[i] for i in range(n) if not under[i])  # text that nothing speaks against
    size, held, above = dict[str, int](), dict[str, int](), dict[int, frozenset[str]]()
    for i in range(1, n):  # each name's outermost nodes
        up = above.get(parent[i], frozenset())
        new = tree.suspect.get(i, set()) - up
        for w in new:
            size[w] = size.get(w, 0) + chars[i]
            held[w] = held.get(w, 0) + stated[i]
        if up or new:
            above[i] = up | new
    void = {w for w in size if size[w] > FEW * free and size[w] > 4 * (stated[0] - held[w]) and 2 * size[w] > chars[0]}
    return {i for i, names in tree.suspect.items() if names - void}


class Densities:
    """Weights, densities and density sums of a page's nodes."""

    def __init__(self, tree: _Tree):
        n, tag, parent = len(tree.tag), tree.tag, tree.parent
        own, own_links, linked = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[parent[i]] or tag[i] == "a"
        for node, text, _ in tree.pieces:
            size = len(text) - text.count(" ")
            own[node] += size
            own_links[node] += size if linked[node] else 0
        suspects = _suspects(tree, own)
        self.suspect = [False] * n  # or below such a node
        for i in range(1, n):
            self.suspect[i] = self.suspect[parent[i]] or i in suspects
        self.weight = [0.0 if tree.noise[i] else NAMED if self.suspect[i] else 1.0 for i in range(n)]
        self.tree = tree
        # Counts that weigh on the nodes above, and the plain ones of the text alone.
        weighed = lambda values: _below([v * w for v, w in zip(values, self.weight, strict=True)], parent)
        self.chars, self.links = weighed(own), weighed(own_links)
        tags, link_tags = weighed([1] * n), weighed([int(x) for x in linked])
        self.plain_chars, self.plain_links = _below(own, parent), _below(own_links, parent)
        self.body = next((i for i in range(n) if tag[i] == "body"), 0)
        if not self.plain_chars[self.body]:
            self.body = 0
        ratio = self.links[self.body] / self.chars[self.body] if self.chars[self.body] else 0.0
        self.density, self.sums = [0.0] * n, [0.0] * n
        for i in range(n):
            w = self.weight[i]
            if w:  # a node's own weight is on all of its counts, and so cancels out of them
                self.density[i] = w * composite_density(self.chars[i] / w, (tags[i] - w) / w, self.links[i] / w, (link_tags[i] - linked[i] * w) / w, ratio)
                self.sums[i] += w * composite_density(own[i], 1, own_links[i], int(linked[i] and own[i] > 0), ratio)
        for i in range(1, n):
            self.sums[parent[i]] += self.density[i]


def _content(tree: _Tree) -> list[bool] | None:
    """For each node, whether it is content; None if the page has no text."""
    d = Densities(tree)
    n, tag, parent, density, sums, body = len(tree.tag), tree.tag, tree.parent, d.density, d.sums, d.body
    if not d.plain_chars[body]:
        return None
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[parent[i]] and not tree.noise[i]
    top = list(range(n))  # the largest-sum node below each node, the outermost and first among equals
    for i in range(n - 1, body, -1):
        if inside[i] and (sums[top[i]], -top[i]) >= (sums[top[parent[i]]], -top[parent[i]]):
            top[parent[i]] = top[i]
    best = top[body]
    path = [best]
    while path[-1] != body:
        path.append(parent[path[-1]])
    threshold = SLACK * min(density[i] for i in path)
    kept = [False] * n
    for i in range(body, n):
        if inside[i] and density[i] >= threshold:
            kept[top[i]] = True
    drop = [False] * n
    for i in range(body + 1, n):
        against = d.suspect[i] and not d.suspect[best] or 2 * d.plain_links[i] > d.plain_chars[i] and tag[i] in BLOCKS and tag[i] not in HEADINGS
        drop[i] = inside[i] and i not in path and against and density[i] < threshold
    # The container: unmarked text that nothing speaks against is what would come in by taking a node whole.
    marked, out = [False] * n, [False] * n
    for i in range(body, n):
        up = i != body
        out[i] = not inside[i] or up and out[parent[i]] or drop[i]
        marked[i] = (kept[i] or up and marked[parent[i]]) and not out[i]
    own = [0.0] * n
    for node, text, _ in tree.pieces:
        own[node] += len(text) - text.count(" ")
    stray = _below([own[i] if not marked[i] and not out[i] else 0.0 for i in range(n)], parent)
    taken = _below([own[i] if not out[i] else 0.0 for i in range(n)], parent)
    container = best
    loose = not any(tag[i] in HOLDERS for i in path if i != body)  # the article's paragraphs stand in body itself
    for i in path:
        if (i != body or loose) and stray[i] <= STRAY * taken[i]:
            container = i
    kept[container] = True
    holder = parent[container] if container != body else body
    for i in range(body, n):  # the headings beside it
        if inside[i] and tag[i] in HEADINGS and parent[i] == holder and not d.suspect[i]:
            kept[i] = True
    for i in range(1, n):
        kept[i] = (kept[i] or kept[parent[i]]) and inside[i] and not drop[i]
    return kept


def extract(page: str | None) -> str:
    if not page:
        return ""
    tree = _Tree()
    try:
        tree.feed(page)
        tree.close()
    except AssertionError:
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", page)
        return " ".join(entities.unescape(bare).split())
    kept = _content(tree)
    if kept is None:
        return ""
    tag, parent = tree.tag, tree.parent
    block = [0] * len(tag)
    for i in range(1, len(tag)):
        block[i] = i if tag[i] in BLOCKS else block[parent[i]]
    out: list[str] = []
    now: list[str] = []
    at, last = None, 1
    for node, text, begun in tree.pieces:
        if not kept[node]:
            continue
        # Another block, or a block element that began and ended since the last piece, starts a new one.
        if block[node] != at or any(tag[i] in BLOCKS for i in range(last, begun)):
            out.append("".join(now))
            now = []
        elif any(tag[i] in ("br", "td", "th") for i in range(last, begun)):
            now.append(" ")
        now.append(text)
        at, last = block[node], begun
    out.append("".join(now))
    return "\n".join(x for x in (" ".join(b.split()) for b in out) if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """The contract's row for each page: page_id, url, text, n_chars."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long")
