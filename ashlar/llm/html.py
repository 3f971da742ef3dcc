"""Main text of web pages by consensus host paths.

Every page's containers are scored alone; the best one's path, as generalised
tag-class steps, is the page's vote. Votes are counted for each host in Spark.
Each page is then extracted again by the winning paths of its host, so that a
page whose own best guess goes wrong follows its siblings.

A page is read in one pass whose cost grows with its length only: a tag ends at
its ``>`` or at the next ``<``, open elements are found by tag, and paths are
nodes of a tree that point to their parents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, tune

#: A container must hold this share of the best score; of those that do, the deepest wins.
DEEPEST_SHARE = 0.8
#: A path wins on its host with at least this share of the votes, or with the most: at most 50 paths of a host win.
VOTE_SHARE = 0.02
#: A winning path is followed where it holds this share of the page's own best score (or the heading that the page's own best lacks).
NEAR_SHARE = 0.5

# Element kinds of the HTML standard, and names that pages give to what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("article main section div td body".split())
DROPPED = frozenset("nav footer aside script style noscript template iframe svg button select textarea dialog head title object canvas audio video menu input".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
DROPPED_NAMES = frozenset(
    "ad ads adv adbox advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist respond "
    "disqus replies share sharing social related recommended recommendations pagination pager search skip".split()
)
#: Names that also paragraphs, list items, spans and articles go by.
SMALL_NAMES = frozenset("ad ads adv advert adverts advertisement adsense adslot sponsor sponsored promo promoted cookie cookies consent newsletter breadcrumb breadcrumbs comment comments share sharing related".split())
#: Words beside a name that say where or how, not what.
NEUTRAL = frozenset(
    "area box wrap wrapper block container holder list section widget widgets main top bottom left right site page primary secondary global inner outer panel unit slot bar form link links item items content "
    "text body row col column group module region zone thread posts post articles article stories entry js inline fixed sticky large small mobile desktop icon icons button buttons label toggle".split()
)
#: Names whose element is not the article even if it holds an article or the page's title.
FIRM_NAMES = SMALL_NAMES | frozenset("header masthead topbar banner navbar nav navigation menu commentlist respond replies disqus recommended recommendations subscribe popup modal signup login".split())
NAMED = frozenset("div section ul ol dl table tbody tr td th figure details center ins".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
ALSO_CLOSES = {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}
ARTICLE_NAMES = frozenset("post entry article content story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^>"'<=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(>?)""")
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_STATE = re.compile(r"(?i)\b(?:has|with|without|no|is|show|hide|layout)[-_][\w-]+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none")
_HOST = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _attributes(text: str) -> dict[str, str]:
    held: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        held.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return held


_NO_ATTRIBUTES: dict[str, str] = {}


def _core(token: str) -> list[str]:
    """Words of a class or id that tell what an element is."""
    return [w for w in (w.lower() for w in _WORDS.findall(token)) if w not in NEUTRAL]


def _names(tag: str, held: dict[str, str]) -> set[str]:
    """The unwanted names that an element goes by.

    A class counts by its first or last telling word (``site-footer``, ``ad-300x250``),
    an id only if all its telling words are such names: ids are often made of headings.
    Names of states (``has-sidebar``) say nothing about the element.
    """
    if tag in ("html", "body") or tag in HEADINGS or not ("class" in held or "id" in held):
        return set()
    classes = [_core(t) for t in _STATE.sub(" ", held.get("class", "")).split()]
    if tag not in NAMED:
        return {w for core in classes for w in core if all(x in SMALL_NAMES for x in core)}
    found = {w for core in classes if core for w in (core[0], core[-1]) if w in DROPPED_NAMES}
    own = _core(_STATE.sub(" ", held.get("id", "")))
    return found | set(own) if all(w in DROPPED_NAMES for w in own) else found


def _hidden(tag: str, held: dict[str, str]) -> bool:
    """Whether an element is unwanted whatever it holds."""
    if tag in DROPPED:
        return True
    if not held:
        return False
    return held.get("role", "").lower() in DROPPED_ROLES or "hidden" in held or held.get("aria-hidden") == "true" or bool(_HIDDEN.search(held.get("style", "")))


def _step(tag: str, held: dict[str, str]) -> str:
    """Tag and sorted classes, digits generalised."""
    if "class" not in held:
        return tag
    names = sorted({re.sub(r"\d+", "#", n) for n in held["class"].lower().replace(">", " ").split()})
    return ".".join([tag, *names])


def _slug(text: str) -> str:
    return re.sub(r"\W+", "-", text.lower()).strip("-")


class Open:
    """An open element: its path node, whether it is dropped, and its outermost doubtful element."""

    __slots__ = ("tag", "node", "dropped", "header", "link", "article", "doubt")

    def __init__(self, tag: str, node: int, dropped: bool, header: bool, link: bool, article: bool, doubt: int):
        self.tag, self.node, self.dropped, self.header, self.link, self.article, self.doubt = tag, node, dropped, header, link, article, doubt


class Page:
    """The blocks of a page and the tree of its paths; equal paths are one node, a parent comes before its children."""

    def __init__(self, html: str):
        self.tags: list[str] = ["body"]  # the root stands for a body that is not written
        self.steps: list[str] = [""]
        self.parent: list[int] = [0]
        self.depth: list[int] = [0]
        self.known: dict[tuple[int, str], int] = {}
        #: Text, innermost container, linked characters and heading flag of every block.
        self.texts: list[str] = []
        self.at: list[int] = []
        self.links: list[int] = []
        self.heads: list[bool] = []
        self._read(html)
        self._sum()

    def _node(self, above: int, step: str, tag: str) -> int:
        node = self.known.setdefault((above, step), len(self.tags))
        if node == len(self.tags):
            self.tags.append(tag)
            self.steps.append(step)
            self.parent.append(above)
            self.depth.append(self.depth[above] + 1)
        return node

    def _read(self, html: str) -> None:
        stack: list[Open] = []
        places: dict[str, list[int]] = {}
        block_at: list[int] = []  # places of open elements that are not inline
        container_at: list[int] = []
        doubts: list[tuple[int, frozenset | set, str, list[bool]]] = []  # parent, names, id, [holds the article]
        owners: list[int] = []
        pending: list[str] = []
        linked = 0
        heading = 0  # open headings

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(pending).split()) if pending else ""
            pending.clear()
            links, linked = linked, 0
            if not text:
                return
            top = stack[-1] if stack else None
            doubt = top.doubt if top else -1
            if heading and doubt >= 0 and not doubts[doubt][3][0] and doubts[doubt][2] and _slug(text) == doubts[doubt][2]:
                hold(doubt)
            self.texts.append(text)
            self.at.append(stack[container_at[-1]].node if container_at else 0)
            self.links.append(links)
            self.heads.append(heading > 0)
            owners.append(doubt)

        def hold(doubt: int) -> None:
            while doubt >= 0 and not doubts[doubt][3][0]:
                doubts[doubt][3][0] = True
                doubt = doubts[doubt][0]

        def close(to: int) -> None:
            nonlocal heading
            while len(stack) > to:
                tag = stack.pop().tag
                places[tag].pop()
                if tag not in INLINE:
                    block_at.pop()
                    if tag in CONTAINERS:
                        container_at.pop()
                    elif tag in HEADINGS:
                        heading -= 1

        def last(tag: str) -> int:
            held = places.get(tag)
            return held[-1] if held else -1

        def close_open(tag: str, bounds: tuple) -> None:
            """Closes an open ``tag`` unless one of ``bounds`` lies above it."""
            to = last(tag)
            if to >= 0 and all(last(b) < to for b in bounds):
                close(to)

        def add(text: str) -> None:
            nonlocal linked
            top = stack[-1] if stack else None
            if top and (top.dropped or (top.header and not heading)):
                return
            if "&" in text:
                text = unescape(text)
            pending.append(text)
            if top and top.link:
                linked += len(text.strip())

        raw_ends: dict[str, bool] = {}
        at, n = 0, len(html)
        while at < n:
            to = html.find("<", at)
            if to < 0:
                add(html[at:])
                break
            if to > at:
                add(html[at:to])
            found = _TAG.match(html, to)
            if not found:
                at = self._not_a_tag(html, to, add)
                continue
            at = found.end()
            if not found[4] and at >= n:
                break  # the page ends inside a tag
            tag = found[2].lower()
            if found[1]:
                to = last(tag)
                if to < 0 or (tag in INLINE and block_at and block_at[-1] > to) or (tag == "p" and container_at and container_at[-1] > to):
                    continue
                if tag not in INLINE:
                    flush()
                close(to)
                continue
            if tag == "br":
                add(" ")
                continue
            if tag not in INLINE and not (tag in VOID and tag != "hr"):
                flush()
            if tag in CLOSES_P:
                to = last("p")
                if to >= 0 and not (container_at and container_at[-1] > to) and last("li") < to and last("blockquote") < to:
                    close(to)
            if tag in SAME_CLOSES:
                close_open(tag, SAME_CLOSES[tag])
                if tag in ALSO_CLOSES:
                    close_open(ALSO_CLOSES[tag], SAME_CLOSES[tag])
            elif tag == "a" and last("a") > (block_at[-1] if block_at else -1):
                close(last("a"))
            if tag in VOID:
                continue
            held = _attributes(found[3]) if found[3] and not found[3].isspace() else _NO_ATTRIBUTES
            if found[3].endswith("/") and tag in ("svg", "path"):
                continue
            above = stack[-1] if stack else None
            inside = bool(above and above.article)
            names = _names(tag, held) if held else set()
            own_header = tag == "header" or (inside and names == {"header"})
            dropped = bool(above and above.dropped) or _hidden(tag, held) or (own_header and not inside)
            doubt = above.doubt if above else -1
            if not dropped and tag in ("article", "main", "h1") and doubt >= 0:
                if tag == "main" or not doubts[doubt][1] & FIRM_NAMES:
                    hold(doubt)
            if not dropped and not own_header and (names or tag == "form"):
                doubts.append((doubt, names, _slug(held.get("id", "")) if not names & FIRM_NAMES else "", [False]))
                doubt = len(doubts) - 1
            step = _step(tag, held)
            article = inside or tag in ("article", "main") or any(w in ARTICLE_NAMES for w in re.split(r"[.\-_]", step))
            node = self._node(above.node if above else 0, step, tag)
            places.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                block_at.append(len(stack))
                if tag in CONTAINERS:
                    container_at.append(len(stack))
                elif tag in HEADINGS:
                    heading += 1
            stack.append(Open(tag, node, dropped, (own_header and inside) or bool(above and above.header), tag == "a" or bool(above and above.link), article, doubt))
            if tag in RAW and raw_ends.get(tag, True):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                raw_ends[tag] = bool(end)
                if end:
                    if not dropped:
                        add(html[at : end.start()])
                    at = end.start()
                elif tag in ("script", "style"):
                    at = n
        flush()
        kept: list[bool] = []
        for parent, _, _, holds in doubts:
            kept.append(holds[0] and (parent < 0 or kept[parent]))
        alive = [i for i, owner in enumerate(owners) if owner < 0 or kept[owner]]
        self.texts, self.at, self.links, self.heads = ([x[i] for i in alive] for x in (self.texts, self.at, self.links, self.heads))

    @staticmethod
    def _not_a_tag(html: str, at: int, add) -> int:
        """Passes a comment, a declaration or a plain ``<``; where reading goes on."""
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            return end + 3 if end >= 0 else len(html)
        if html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            add(html[at + 9 : end] if end >= 0 else html[at + 9 :])
            return end + 3 if end >= 0 else len(html)
        if html[at + 1 : at + 2] in ("!", "?", "/"):
            end = html.find(">", at)
            return end + 1 if end >= 0 else len(html)
        add("<")
        return at + 1

    def _sum(self) -> None:
        """Score, linked characters and headings of each path, over the blocks below it."""
        n = len(self.tags)
        self.score, self.chars, self.linked, self.headed, self.direct = [0.0] * n, [0] * n, [0] * n, [False] * n, [0.0] * n
        for text, node, links, head in zip(self.texts, self.at, self.links, self.heads):
            self.score[node] += len(text) - 2.0 * links
            self.chars[node] += len(text)
            self.linked[node] += links
            self.direct[node] += len(text) - 2.0 * links
            self.headed[node] |= head
        for node in range(n - 1, 0, -1):
            above = self.parent[node]
            self.score[above] += self.score[node]
            self.chars[above] += self.chars[node]
            self.linked[above] += self.linked[node]
            self.headed[above] |= self.headed[node]

    def path(self, node: int) -> str:
        steps = []
        while node:
            steps.append(self.steps[node])
            node = self.parent[node]
        return ">".join(reversed(steps))

    def find(self, path: str) -> int:
        """The node of a path, 0 if the page has none."""
        node = 0
        for step in path.split(">"):
            node = self.known.get((node, step), 0)
            if not node:
                return 0
        return node

    def best(self) -> int:
        """The deepest container with nearly the best score, raised to what belongs to it; 0 (the whole page) without any.

        Its article is taken whole. Elsewhere an ancestor is taken that has text of its
        own (a title, a lead) beside the container, unless what is added is mostly links.
        """
        holders = [i for i, tag in enumerate(self.tags) if tag in CONTAINERS]
        top = max((self.score[i] for i in holders), default=0.0)
        if top <= 0:
            return 0
        node = max((i for i in holders if self.score[i] >= DEEPEST_SHARE * top), key=lambda i: (self.depth[i], self.score[i], self.steps[i], -i))
        above, article = node, 0
        while above:
            if self.tags[above] == "article":
                article = above
            above = self.parent[above]
        node = article or node
        own, above = node, self.parent[node]
        while above and self.tags[above] not in ("body", "html"):
            more = self.chars[above] - self.chars[own]
            if self.tags[above] in CONTAINERS and self.direct[above] > 0 and 2 * (self.linked[above] - self.linked[own]) <= more and more <= (1 / DEEPEST_SHARE - 1) * self.chars[own]:
                node = above
            above = self.parent[above]
        return node

    def text(self, node: int) -> str:
        under = [False] * len(self.tags)
        under[node] = True
        for i in range(node + 1, len(under)):
            under[i] = under[self.parent[i]]
        return "\n".join(t for t, at in zip(self.texts, self.at) if under[at])


def extract(html: str | None, winners: list[str] | None) -> str:
    """Text by the first winning path that suits the page, else by its own best container, else of the whole page."""
    page = Page(html or "")
    own = page.best()
    for path in winners or ():
        node = page.find(path)
        if node and page.chars[node] and (page.score[node] >= NEAR_SHARE * page.score[own] or (page.headed[node] and not page.headed[own])):
            return page.text(node)
    return page.text(own)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths, scores = [], [], []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host = host_of(url)
            if not html or not host:
                continue
            page = Page(html)
            own = page.best()
            if own:
                hosts.append(host)
                paths.append(page.path(own))
                scores.append(page.score[own])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and its winning paths, most votes first; pages without a host do not vote."""
    tune(pages.sparkSession)
    votes = pages.select("url", "html").mapInArrow(_votes, "host string, path string, score double")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.col("score").cast("decimal(38,0)")).alias("score"))
    order = F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")
    totals = counted.groupBy("host").agg(F.sum("votes").alias("total"), F.min(order).alias("most"))
    strong = counted.join(totals, "host").where(f"path = most.path or votes >= {VOTE_SHARE} * total")
    ordered = F.array_sort(F.collect_list(order))
    return strong.groupBy("host").agg(ordered.alias("won")).selectExpr("host", "transform(won, x -> x.path) as paths")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages(page_id, url, html, ...)``.

    Null, empty and textless pages give an empty text. A page without a host
    goes by its own best container alone. The winners, one row for each host, are
    joined by host; Spark broadcasts them only below its size threshold and
    otherwise splits hot hosts. Repeated rows each keep a row; other columns are
    ignored. A page of any length is read whole, in time and memory that grow
    with its length; an empty table gives an empty result.
    """
    tune(pages.sparkSession)
    winners = keep(winning_paths(pages)).withColumnRenamed("host", "site")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(html, paths) for html, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST.pattern, 1), F.lit("")))
    rows = pages.select("page_id", "url", "html").withColumn("host", host)
    rows = rows.join(winners, rows.host == winners.site, "left").select("page_id", "url", "html", "paths")
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
