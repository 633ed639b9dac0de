"""Main-text extraction by line-block distribution.

Markup is stripped into lines, one per block element or line break. Every line has a
size: the length of its text times a weight. Sizes are summed over sliding windows of lines: a
region begins where the sum surges and ends where it dives to nothing. The region with the highest
sum is main text, and so are others that reach the threshold (lower where the whole page has little text, higher for
regions that weigh less). Then what belongs to a region that stays, stays with it, however short: lines of the same marked
article, and lines in the containers that hold the region's lines, tables and nested blocks too.

Weights: text in a marked article weighs more, runs of short links little, page furniture little. What is furniture by its tag, or
by a whole class, id or role of which each word is one of furniture or says nothing (``cookie-notice``, not ``social-history``), is left out with what it holds.
Names that articles use as well (``related``, ``share``) count only if the element does not hold text like an article's. An
element that holds most of the page's text is a wrapper and its name does not count. Where weights change, and in part
between containers, empty lines come in.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "page_id bigint, url string, text string, n_chars bigint"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*+>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
_RAW_END = re.compile(r"</[a-zA-Z]+\s*>$")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'>]++)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Which elements end a line, hold other blocks, and are furniture by their tag. Fixed values of HTML and of common page templates.
_BREAKS = frozenset("address blockquote br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section summary table tbody td tfoot th thead tr ul article aside nav header footer form body html head".split())
_HOLDERS = frozenset("html head body div section article main aside nav header footer form ul ol dl table details fieldset figure blockquote center menu dialog button label span p li td tr".split())
_SMALL = frozenset("p li td tr span label".split())  # hold text rather than blocks
_FURNITURE = frozenset("head nav footer aside form button menu dialog object canvas".split())
_ARTICLE = frozenset(("article", "main"))
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promos promotion promotions sidebar aside menu nav navbar subnav sidenav topnav navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup comment comments disqus respond pagination pager toolbar contentinfo complementary alertdialog commentlist commentform adsbygoogle".split()
)
_WEAK = frozenset("banner share sharing social related recommended recommendations search reply replies login alert overlay widget widgets".split())  # articles have sections of such names too
# Words of names that say where an element stands or what shape it has.
_NEUTRAL = frozenset("main site page post article entry global primary secondary top bottom left right inner outer fixed sticky mobile desktop list lists item items box bar area section sections wrapper wrap container content block blocks panel row col column button buttons btn btns link links icon icons form field input posts articles stories story news header head title body text slot unit placement display message messages thread threads count container1 inline small large mini big new bg js the".split())
_COMMENTS = frozenset("comment comments commentlist commentform disqus respond reply replies".split())  # may hold most of a page
_COMMENT_TITLE = re.compile(r"\(?\d+\)?\s+(?:reader\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)|(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)\s*\(\d+\)|leave a (?:comment|reply)", re.I)
_TOPS = frozenset(("header", "masthead", "topbar"))  # unless they are the article's own
_NEVER_FURNITURE = frozenset(("html", "body", "article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_FAINT, _MARKED = 0.02, 4.0  # weights


class Line(NamedTuple):
    text: str
    linked: int  # characters in links
    weight: float
    container: int  # the element that holds the line's block
    mark: int  # the outermost marked article around it; 0 for none
    around: tuple[int, ...]  # the containers around its own, inner ones first, but for the page's body


class _Open:
    __slots__ = ("around", "article", "container", "hint", "tag")

    def __init__(self, tag: str, container: int, hint: int, article: int, around: tuple | None):
        self.tag, self.container, self.hint, self.article, self.around = tag, container, hint, article, around


def lines(page: str, gap: int = 3) -> tuple[list[Line], bool]:
    """The page's lines, empty ones included, and whether an article is marked. Linear in the page, whatever it leaves open."""
    rows: list[tuple[str, int, int, int, int, tuple | None]] = []  # text, characters in links, hint, mark, container, chain of those around
    parents, wraps = [-1], [0]  # per hinted element, the next one around it, and its kind (``_furniture``); 0 is none
    root = _Open("", 0, 0, 0, None)
    stack: list[_Open] = [root]
    opened: Counter[str] = Counter()
    words: list[str] = []
    linked, in_link, containers, marks = 0, 0, 0, 0

    def flush(blank: int = 0) -> None:
        nonlocal linked
        top = stack[-1]
        text = " ".join(entities.unescape("".join(words)).split()) if words else ""
        if text:
            rows.append((text, min(linked, len(text)), top.hint, top.article, top.container, top.around))
        words.clear()
        linked = 0
        rows.extend([("", 0, top.hint, top.article, top.container, None)] * blank)

    end = page.rfind(">") + 1  # no tag ends beyond
    p, unclosed = 0, False
    for m in _TOKEN.finditer(page, 0, end):
        if m.start() > p:
            words.append(page[p : m.start()])
            if in_link:
                linked += m.start() - p
        p = m.end()
        tag = m[3] or m[6]
        if tag is None:
            unclosed = p == end and (bool(m[1]) and not _RAW_END.search(m[0]) or m[0].startswith("<!--") and not m[0].endswith("-->"))
            continue
        tag, closes, attrs = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "a":
            in_link = 0 if closes else 1
            continue
        if tag not in _BREAKS and tag not in _HOLDERS and tag not in _FURNITURE:
            continue
        before = stack[-1]
        blank = 1 if tag in _HOLDERS and tag not in ("p", "li", "span") else 0
        if blank and tag not in _SMALL and before.around is None and (closes or not before.container):
            blank = gap  # between blocks of the page's body
        if tag in _BREAKS:
            flush(blank)
        if closes:
            if tag in _HEADINGS and rows and not before.hint and before.tag in ("div", "section") and _COMMENT_TITLE.fullmatch(rows[-1][0]):
                parents.append(0)
                wraps.append(3)
                before.hint = len(parents) - 1  # what follows in it are readers' comments
                rows[-1] = (*rows[-1][:2], before.hint, *rows[-1][3:])
            if not opened[tag]:
                continue
            top = None
            while top is None or top.tag != tag:  # each is closed once
                flush()
                top = stack.pop()
                opened[top.tag] -= 1
        else:
            if tag in _VOID or tag not in _HOLDERS and tag not in _FURNITURE or attrs.endswith("/"):
                continue
            if tag in ("p", "li", "td", "tr") and before.tag == tag or tag == "body" and before.tag == "head":
                flush()
                opened[stack.pop().tag] -= 1  # closed by the next one
            top = stack[-1]
            hint, container, around = top.hint, top.container, top.around
            named = _attributes(attrs) if attrs else {}
            if kind := _furniture(tag, named, bool(top.article)):
                flush()
                parents.append(hint)
                wraps.append(kind)
                hint = len(parents) - 1
            if tag not in _SMALL and tag not in ("html", "body"):
                containers += 1
                around, container = (container, around) if container else None, containers
            article = top.article
            if not article and (tag in _ARTICLE or named.get("role", "").lower() == "main"):
                marks += 1
                article = marks
            if article != top.article:
                flush()
            stack.append(_Open(tag, container, hint, article, around))
            opened[tag] += 1
        after = stack[-1]
        if after.hint != before.hint or after.article != before.article:
            flush()
            rows.extend([("", 0, after.hint, after.article, after.container, None)] * gap)
            in_link = 0
    if p < len(page) and not unclosed:
        tail = page.find("<!--", p)
        words.append(page[p : tail if tail >= 0 else None])
    flush()
    weights = _weights(rows, parents, wraps)
    return [Line(text, n, weights[hint] * (_MARKED if article else 1.0), container, article, around) for text, n, hint, article, container, around in rows], marks > 0


def _attributes(attrs: str) -> dict[str, str]:
    """Of each attribute the first value; empty without one."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _kinds(name: str, article: bool) -> set[str]:
    """Of a whole class, id or role: its words of furniture, if all others say nothing."""
    words = [w.rstrip("0123456789") for w in _SPLIT.split(name.lower()) if w.rstrip("0123456789")]
    found = {w for w in words if w in _WORDS or w in _WEAK or w in _TOPS and not article}
    return found if all(w in found or w in _NEUTRAL for w in words) else set()


def _furniture(tag: str, named: dict[str, str], article: bool) -> int:
    """0 for what is no furniture by tag or attributes, 1 for what may still be a wrapper of the whole page, 2 for what is if it holds no text like an article's, 3 for what is in any case."""
    if tag == "form":
        return 1
    if tag in _FURNITURE or tag == "header" and not article:
        return 3
    if not named or tag in _NEVER_FURNITURE:
        return 0
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(named.get("style", "")):
        return 1
    found = set().union(*(_kinds(n, article) for n in (*named.get("class", "").split(), named.get("id", ""), named.get("role", ""))))
    return 0 if not found else 3 if found & _COMMENTS else 2 if found <= _WEAK else 1


def _weights(rows: list[tuple], parents: list[int], wraps: list[int], most: float = 0.5, times: int = 4, prose: int = 200, line: int = 80, links: float = 0.2) -> list[float]:
    """The weight of text in each hinted element: faint, or as around it if the element is but a wrapper, or an article's part with a weak name.

    A wrapper holds more than ``most`` of the page's text that is no link and ``times`` as much as stands in no hinted element,
    and the marked article, if there is one. Text like an article's: ``prose`` characters in lines of ``line`` and more, of which few are links.
    """
    n = len(parents)
    total, marked, long, chars, linked = [0] * n, [False] * n, [0] * n, [0] * n, [0] * n
    for text, in_links, hint, article, *_ in rows:
        total[hint] += len(text) - in_links
        chars[hint] += len(text)
        linked[hint] += in_links
        long[hint] += len(text) if len(text) >= line else 0
        marked[hint] |= bool(article and text)
    page, free, mark = sum(total), total[0], any(marked)
    wrapper = [False] * n
    for e in range(n - 1, 0, -1):  # inner ones first
        marked[parents[e]] |= marked[e]
        wrapper[e] = wraps[e] in (1, 2) and total[e] > max(most * page, times * free) and (marked[e] or not mark)
        wrapper[e] |= wraps[e] == 2 and long[e] >= prose and linked[e] <= links * chars[e]
        if wrapper[e]:
            for x in (total, chars, linked, long):
                x[parents[e]] += x[e]
    out = [1.0] * n
    for e in range(1, n):
        out[e] = out[parents[e]] * (1.0 if wrapper[e] else _FAINT)
    return out


class Region(NamedTuple):
    peak: float  # highest sum of sizes in a window
    chars: int
    linked: int
    weight: float
    lines: list[int]


def link_runs(rows: list[Line], share: float = 0.6, least: int = 2, longest: int = 60) -> list[bool]:
    """Menus: at least ``least`` lines after one another that are mostly link and on average shorter than ``longest``; longer ones are titles or references."""
    out = [False] * len(rows)
    run: list[int] = []
    for i in [*(i for i, r in enumerate(rows) if r.text), -1]:
        if i >= 0 and rows[i].linked > share * len(rows[i].text):
            run.append(i)
            continue
        if len(run) >= least and sum(len(rows[k].text) for k in run) < longest * len(run):
            for k in run:
                out[k] = True
        run = []
    return out


def regions(rows: list[Line], window: int = 3) -> list[Region]:
    """Each run of lines of one weight up to a dive: a whole window without text."""
    runs = link_runs(rows)
    weight = [r.weight * (_FAINT if run else 1.0) for r, run in zip(rows, runs, strict=True)]
    n, out, i = len(rows), [], 0
    while i < n:
        if not rows[i].text:
            i += 1
            continue
        block, j, empty = [], i, 0
        while j < n and empty < window:
            if rows[j].text:
                if weight[j] != weight[i] or runs[j] != runs[i]:
                    break
                block.append(j)
                empty = 0
            else:
                empty += 1
            j += 1
        sizes = [len(rows[k].text) * weight[k] for k in range(i, block[-1] + 1)]
        total, peak = 0.0, 0.0
        for k, x in enumerate(sizes):
            total += x - (sizes[k - window] if k >= window else 0.0)
            peak = max(peak, total)
        out.append(Region(peak, sum(len(rows[k].text) for k in block), sum(rows[k].linked for k in block), weight[i], block))
        i = block[-1] + 1
    return out


def surges(rows: list[Line], window: int = 3, threshold: int = 86, most_links: float = 0.5, share: float = 0.2, faint_share: float = 0.25) -> list[str]:
    """The lines between surge and dive points of the distribution of sizes over windows of lines.

    The region with the highest sum (the first, on a tie) stays. One that weighs as much or more must reach the threshold, or that share
    of the highest sum if this is less; one that weighs less must reach both the threshold and its share. Regions mostly of
    links stay only if there are no others; then the one with the highest sum does, and those that weigh as much. With a region stay the
    other lines of its marked article, links too, and in unmarked text those in the containers of its lines that are no menu.
    """
    found = regions(rows, window)
    good = [r for r in found if r.linked <= most_links * r.chars]
    if not good:
        top = max(found, key=lambda r: r.peak, default=None)
        return [rows[k].text for r in found if r.weight == top.weight for k in r.lines]
    top = max(good, key=lambda r: r.peak)
    kept = [r for r in good if r is top or r.peak >= (min(threshold, share * top.peak) if r.weight >= top.weight else max(threshold, faint_share * top.peak))]
    stays = {k for r in kept for k in r.lines}
    whole = {(rows[k].mark, rows[k].weight) for k in stays if rows[k].mark and rows[k].weight >= 1}
    homes = {(rows[k].container, rows[k].weight) for k in stays}
    inner = {(c, w) for c, w in homes if c}  # the page's body holds everything
    runs = link_runs(rows)
    held: dict[tuple, bool] = {}

    def inside(around: tuple | None, weight: float) -> bool:
        """Is one of the containers around a home? Each is asked once."""
        way = []
        while around is not None and (key := (around[0], weight)) not in held:
            held[key] = key in inner
            way.append(key)
            if held[key]:
                break
            around = around[1]
        found = around is not None and held[around[0], weight]
        for key in way:
            held[key] = found
        return found

    def belongs(r: Line, run: bool) -> bool:
        if r.mark:
            return (r.mark, r.weight) in whole
        return not run and r.linked <= most_links * len(r.text) and ((r.container, r.weight) in homes or inside(r.around, r.weight))

    return [r.text for k, r in enumerate(rows) if r.text and (k in stays or belongs(r, runs[k]))]


def main_text(page: str | None) -> str:
    """The page's article as one line of text; empty for a null, empty or textless page."""
    return " ".join(surges(lines(page)[0])) if page else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of each row of ``pages``, from its whole html.

    Returns page_id, url (both as they are, null too), text (empty if none) and n_chars, its code points. Markup left open
    runs to the end of the page; a page of any length or depth is read whole, in time linear in it; of regions that tie for
    the highest sum the first counts; repeated rows are repeated; an empty table gives none; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_pydict(
                {"page_id": batch.column("page_id"), "url": batch.column("url").cast(pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )

    return pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html")).mapInArrow(scan, OUT)
