"""HTML extraction by consensus paths of each host.

Pass one parses every page into text blocks, scores the page's containers by the
share of running text they hold, and votes on each container's path. A path is the
chain of container tags with their classes, digits removed, from the page's root.
Spark adds up, per host and path, the pages that have the path and the shares it
holds there; a path wins where these agree that it holds nine tenths of the text. A
host with several templates so has a winner for each. Pass two joins the winners to
the pages and extracts again, from the elements on the deepest winning path that the
page has; a page without one uses its own best container, and so does one of which
the winner holds next to nothing.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are left out, inside the container too. Some tags always are such; other
elements are by the name in a class, id or role, if the whole name says so and the
element does not hold most of the page's running text and its main heading or article,
if there is one (comments may). A form that
holds most of it keeps its text but not its controls and labels.

Blocks are in page order; white space in a block is one space; character references
are decoded. Unclosed and stray tags are tolerated: an element ends with the one
around it. Parsing takes time and memory in proportion to the page, however deep its
elements are nested: paths are interned, and one over ``PATH_CHARS`` goes by a digest.

Votes are added up in each task before the shuffle. A host's winners are held by one
page in ``SUPPORT`` at least, which bounds their number. Null html is empty and gives
an empty text; a null or odd URL belongs to the empty host. Repeated rows give repeated
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.catalog import register
from citemill.llm.common import staged, table

SHARE_MIN = 0.9
# A page's main heading counts as this share of its text at least, so a container without it does not win.
HEADING_SHARE = 0.25
# An element with this share of a page's running text is not noise by its name.
MOST = 0.5
# A winner with less of a page's running text than this is not used for the page.
USED_MIN = 0.25
# A winning path is on two pages and on one in so many of its host's pages.
SUPPORT = 100
PATH_CHARS = 512

# HTML's own lists of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea iframe".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section"
    " summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - set("body html head title caption td th tr tbody thead tfoot option optgroup legend button".split())
CLOSES_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
CONTAINERS = set("article blockquote center div main section table tbody td tr".split())

NOT_TEXT = set(
    "head title nav footer aside button dialog menu script style textarea noscript template iframe svg select option"
    " optgroup datalist label legend output canvas object audio video".split()
)
NOISE_ROLES = set("navigation banner complementary contentinfo search dialog alert menu menubar alertdialog".split())
COMMENT_WORDS = set("comment comments commentlist disqus reply replies respond".split())
NOISE_WORDS = COMMENT_WORDS | set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar"
    " navigation menu breadcrumb breadcrumbs sidebar rail footer"
    " cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup login share"
    " sharing social related recommended recommendations widget widgets masthead toolbar pagination pager skip paywall".split()
)
# Words that a noise name may have beside a noise word; with any other word a name is no noise name.
NEUTRAL_WORDS = set(
    "site page main top bottom left right box block list item items section wrap wrapper container inner outer area bar links"
    " link post posts article articles content text form primary secondary global local column col row group panel unit slot"
    " header js my the your reader user area app web mobile desktop".split()
)
HEADER_WORDS = {"header", "topbar", "masthead"}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>"']*(?:(?:"[^"]*"|'[^']*')[^<>"']*)*)>|<[!?/][^>]*>|<[A-Za-z][^<>]*>""",
    re.S,
)
_P_WITHIN = frozenset("div article section td li main blockquote".split())
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS_OF_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_DIGITS = re.compile(r"\d+")


class Block:
    """One run of text: its words joined, its link share, the path around it, and whether it is noise or a main heading."""

    __slots__ = ("text", "links", "path", "noise", "heading")

    def __init__(self, text: str, links: float, path: int, noise: bool, heading: bool):
        self.text, self.links, self.path, self.noise, self.heading = text, links, path, noise, heading

    @property
    def weight(self) -> float:
        """Running text: characters outside of links."""
        return len(self.text) * (1 - self.links)


class Page:
    """A page's blocks, and its container paths by number: each one's parent, depth and name. Path 0 is the root."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parents, self.depths, self.names = [0], [0], [""]
        self._numbers: dict[tuple[int, str], int] = {}

    def path(self, parent: int, label: str) -> int:
        number = self._numbers.get((parent, label))
        if number is None:
            number = self._numbers[parent, label] = len(self.parents)
            name = f"{self.names[parent]}/{label}"
            if len(name) > PATH_CHARS:
                name = "#" + hashlib.blake2b(name.encode(), digest_size=16).hexdigest()
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.names.append(name)
        return number

    def within(self, path: int) -> list[bool]:
        """For each path, whether it is the given one or below it. Parents have smaller numbers."""
        inside = [False] * len(self.parents)
        inside[path] = True
        for i in range(path + 1, len(inside)):
            inside[i] = inside[self.parents[i]]
        return inside


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def noise_name(name: str) -> str:
    """"comment", "noise" or "" for a class or id: all of its words must be noise words or neutral, one the former."""
    words = [w.lower() for w in _WORDS_OF_NAME.findall(name)]
    words = [w for w in words if not w.isdigit()]
    found = [w for w in words if w in NOISE_WORDS]
    if not found or any(w not in NOISE_WORDS and w not in NEUTRAL_WORDS for w in words):
        return ""
    return "comment" if any(w in COMMENT_WORDS for w in found) else "noise"


def _named_noise(tag: str, given: dict[str, str], in_article: bool) -> str:
    """Whether an element's names make it noise, unless it holds most of the page."""
    names = given.get("class", "").split() + given.get("id", "").split()
    kinds = {noise_name(name) for name in names}
    if "comment" in kinds:
        return "comment"
    if tag in ("html", "body", "article", "main"):
        return ""
    if tag in ("form", "fieldset") or given.get("role", "").lower() in NOISE_ROLES or "hidden" in given or "noise" in kinds:
        return "noise"
    words = {w.lower() for name in names for w in _WORDS_OF_NAME.findall(name)}
    return "noise" if words and not in_article and words <= HEADER_WORDS | NEUTRAL_WORDS and words & HEADER_WORDS else ""


def _label(tag: str, given: dict[str, str]) -> str:
    names = sorted({_DIGITS.sub("", c.lower()) for c in given.get("class", "").split()} - {""})
    return ".".join([tag, *names])


class _Open:
    """An open element: whether it is noise by its tag, the innermost element that is noise by name, its path, inside an article."""

    __slots__ = ("tag", "hard", "soft", "path", "in_article")

    def __init__(self, tag: str, hard: bool, soft: int, path: int, in_article: bool):
        self.tag, self.hard, self.soft, self.path, self.in_article = tag, hard, soft, path, in_article


class _Parser:
    def __init__(self, text: str):
        self.text, self.page = text, Page()
        self.stack = [_Open("", False, 0, 0, False)]
        # Places in the stack of each open tag.
        self.where: dict[str, list[int]] = defaultdict(list)
        # Elements that are noise by name: the one around each, and its kind; 0 stands for none.
        self.soft_parents, self.soft_kinds = [0], [""]
        self.marks: list[int] = []  # for each block the innermost of these; -1 for noise by tag
        self.signs: list[bool] = []  # whether it is a main heading or in an article
        self.pieces: list[str] = []
        self.link_chars = 0
        self.no_end: set[str] = set()

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                top = self.stack[-1]
                self.page.blocks.append(
                    Block(text, min(1.0, self.link_chars / len(text)), top.path, top.hard, bool(self.where["h1"]))
                )
                self.marks.append(-1 if top.hard else top.soft)
                self.signs.append(bool(self.where["h1"]) or top.in_article)
            self.pieces.clear()
        self.link_chars = 0

    def close(self, tag: str, within: frozenset[str] | set[str] = frozenset()) -> None:
        places = self.where[tag]
        if not places or any(self.where[w] and self.where[w][-1] > places[-1] for w in within):
            return
        for entry in reversed(self.stack[places[-1] :]):
            self.where[entry.tag].pop()
            self.stack.pop()

    def add(self, text: str) -> None:
        if text:
            self.pieces.append(text)
            if self.where["a"]:
                self.link_chars += len(text.strip())

    def raw_end(self, tag: str, at: int) -> int | None:
        """Where the text of a raw element ends; None if it never does."""
        if tag not in self.no_end:
            end = re.compile(rf"</{tag}\s*>", re.I).search(self.text, at)
            if end:
                return end.end()
            self.no_end.add(tag)
        return None

    def open(self, tag: str, raw: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag in CLOSES_P:
                self.close("p", _P_WITHIN)
            if tag in CLOSES_SAME:
                self.close(tag, CLOSES_SAME[tag])
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS:
            self.pieces.append(" ")
            return
        given, top = _attributes(raw), self.stack[-1]
        hard = top.hard or tag in NOT_TEXT or tag == "header" and not top.in_article
        soft, path = top.soft, top.path
        if not hard and (kind := _named_noise(tag, given, top.in_article)):
            self.soft_parents.append(soft)
            self.soft_kinds.append(kind)
            soft = len(self.soft_kinds) - 1
        # Inside an article or main element no deeper container stands for itself.
        if tag in CONTAINERS and not top.in_article:
            path = self.page.path(path, _label(tag, given))
        if tag not in BLOCKS and hard and not top.hard:
            self.flush()  # what came before is text, what comes is not
        self.where[tag].append(len(self.stack))
        self.stack.append(_Open(tag, hard, soft, path, top.in_article or tag in ("article", "main")))

    def run(self) -> Page:
        text, at, size = self.text, 0, len(self.text)
        while at < size:
            m = _TAG.search(text, at)
            if m is None:
                self.add(text[at:])
                break
            self.add(text[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if tag in BLOCKS or self.where[tag] and tag in NOT_TEXT:
                    self.flush()
                self.close(tag)
                continue
            if tag in RAW and (end := self.raw_end(tag, at)) is not None:
                at = end
                self.pieces.append(" ")
                continue
            self.open(tag, m[3])
        self.flush()
        self.settle()
        return self.page

    def settle(self) -> None:
        """Decide which elements are noise by name: those that do not hold most of the running text, and comments."""
        weights, signs = [0.0] * len(self.soft_kinds), [0] * len(self.soft_kinds)
        for block, mark, sign in zip(self.page.blocks, self.marks, self.signs):
            if mark >= 0:
                weights[mark] += block.weight
                signs[mark] += sign
        for i in range(len(weights) - 1, 0, -1):
            weights[self.soft_parents[i]] += weights[i]
            signs[self.soft_parents[i]] += signs[i]
        bad = [False] * len(weights)
        for i in range(1, len(weights)):
            # Where the page has a main heading or an article, what is spared must have it.
            spared = self.soft_kinds[i] != "comment" and weights[i] > MOST * weights[0] and (signs[i] or not signs[0])
            bad[i] = bad[self.soft_parents[i]] or not spared
        for block, mark in zip(self.page.blocks, self.marks):
            block.noise = mark < 0 or bad[mark]


def parse(page: str) -> Page:
    """The page's blocks in order and its container paths."""
    return _Parser(page).run()


def container_shares(page: Page) -> list[float]:
    """Share of the page's running text that each container path holds; none without text."""
    weights = [0.0 if b.noise else b.weight for b in page.blocks]
    floor = HEADING_SHARE * sum(weights)
    first = next((i for i, b in enumerate(page.blocks) if b.heading and not b.noise), None)
    if first is not None:
        weights[first] = max(weights[first], floor)
    total = sum(weights)
    shares = [0.0] * len(page.parents)
    if not total:
        return shares
    for block, weight in zip(page.blocks, weights):
        shares[block.path] += weight / total
    for i in range(len(shares) - 1, 0, -1):
        shares[page.parents[i]] += shares[i]
    return shares


def own_path(page: Page, shares: list[float]) -> int:
    """The deepest path with enough of this page's text."""
    fit = [i for i, share in enumerate(shares) if share >= SHARE_MIN]
    return max(fit, key=lambda i: (page.depths[i], shares[i], page.names[i]), default=0)


def main_text(page: Page, winners: list[str] | None) -> str:
    """The blocks within the deepest winning path that the page has, noise left out, joined by an empty line."""
    shares, wanted = container_shares(page), set(winners or ())
    found = [i for i, name in enumerate(page.names) if name in wanted and shares[i] >= USED_MIN]
    path = max(found, key=lambda i: (page.depths[i], shares[i], page.names[i])) if found else own_path(page, shares)
    inside = page.within(path)
    return "\n\n".join(b.text for b in page.blocks if not b.noise and inside[b.path])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], list] = defaultdict(lambda: [0, 0.0, 0])
        for host, html_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = parse(html_ or "")
            for name, share, depth in zip(page.names, container_shares(page), page.depths):
                if share or not depth:
                    vote = votes[host, name]
                    vote[0] += 1
                    vote[1] += share
                    vote[2] = depth
        n, share, depth = zip(*votes.values()) if votes else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([host for host, _ in votes], pa.string()),
                pa.array([path for _, path in votes], pa.string()),
                pa.array(n, pa.int64()),
                pa.array(share, pa.float64()),
                pa.array(depth, pa.int32()),
            ],
            ["host", "path", "n", "share", "depth"],
        )


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and paths: those that hold nine tenths of the text of the host's pages that have them."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(
        _vote, "host string, path string, n long, share double, depth int"
    )
    # Rounded, so that the order in which shares are added up does not decide.
    summed = staged(
        votes.groupBy("host", "path").agg(
            F.sum("n").alias("n"), F.round(F.sum("share"), 6).alias("share"), F.max("depth").alias("depth")
        ),
        "path-votes",
    )
    totals = summed.where("path = ''").select("host", F.col("n").alias("pages"))
    agreed = summed.where((F.col("depth") > 0) & (F.col("n") >= 2) & (F.col("share") >= SHARE_MIN * F.col("n")))
    return (
        agreed.join(totals, "host")
        .where(F.col("n") * SUPPORT >= F.col("pages"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
    )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, _, pages, paths = (c.to_pylist() for c in batch.columns)
        found = [main_text(parse(page or ""), path) for page, path in zip(pages, paths)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(found, pa.string())],
            ["page_id", "url", "text"],
        )


def extract_main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    winners = staged(winning_paths(pages), "winning-paths")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    # No hint: Spark knows the written table's size, which grows with the hosts.
    joined = rows.join(winners, "host", "left")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(
        _extract, "page_id long, url string, text string"
    )


@register("op4_host_paths")
def op4_host_paths(spark: SparkSession, folder: str) -> DataFrame:
    texts = extract_main_texts(table(spark, folder, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
