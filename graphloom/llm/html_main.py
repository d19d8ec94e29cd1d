"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element; an element that never holds article text, by its tag, role or
class, leaves a window of empty lines. Within an article names tell so much of containers only, not of headings,
paragraphs, tables, figures or what runs in a line, and an id, which may be an anchor, less than a class. Buttons and
lists to choose from are text of a line that has more of its own than of theirs. The text lengths of a sliding window of lines are summed. Text surges where that
sum rises from nothing and dives where it falls back to nothing; a stretch between is dense if its sum reaches a share of
the page's level, and the article is what lies from the first dense stretch's surge to the last one's dive: short lines
between them stay, and lines of links, which count nothing, if the dense text beyond them is longer than they are. The level is that of full lines at most, so one huge paragraph
hides no ordinary one. `article` and `main` break ties only: stretches too thin for windows to decide stay if they are in
the same element as the text, and thin ends of a stretch and stretches apart from it go if they are in none.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, texts

#: Elements whose text is no text of the page, elements and names that hold no article text, block elements.
SILENT = "script style noscript template iframe canvas audio video textarea title".split()
CONTROLS = "button select".split()
CHROME = "nav header footer aside form menu dialog".split()
CHROME_ROLES = "navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split()
CHROME_NAMES = """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side-bar
aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager header site-header page-header footer site-footer page-footer
masthead comment comments comment-list commentlist reader-comments disqus respond reply replies notice notices cookie cookies cookie-notice
cookie-banner consent gdpr alert popup modal overlay newsletter toolbar search searchbox""".split()
#: Names that tell the same outside of an article only: inside one they may hold its own text.
CHROME_NAMES_OUTSIDE = """banner subscribe subscription signup login share sharing social social-share related related-posts related-articles
recommended widget""".split()
#: Names that tell the same as a part of a longer one (`ad-slot`, `comments-area`), unless the longer one begins or goes on like these.
CHROME_PARTS = """ad ads advert adverts advertisement sponsored promo sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination
footer masthead comment comments disqus cookie cookies consent newsletter popup modal""".split()
NOT_CHROME_PARTS = "no has with without content layout".split()
#: Elements of reader comments, even if each comment is an article of its own.
COMMENT_NAMES = "comment comments comment-list commentlist reader-comments disqus".split()
#: Within an article: elements whose class tells, those whose id tells as well, and names of adverts that tell of any but a heading.
CONTAINERS, CONTAINERS_BY_ID = "div section ul ol aside details ins".split(), "div ul ol aside".split()
ADVERT_NAMES, HEADINGS = "ad ads adv advert adverts advertisement advertising sponsored".split(), "h1 h2 h3 h4 h5 h6 hgroup".split()
#: Where an element that nothing closes ends at the latest.
UNCLOSED_UNTIL = "article main section h1 h2 p".split()
BLOCKS = """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()

WINDOW, SURGE_SHARE, MAX_LINK_SHARE = 3, 0.1, 0.6
#: Characters of a full line: what a line has beyond them lifts the level no more.
FULL_LINE = 300
_UNTIL = frozenset(UNCLOSED_UNTIL)
_BLOCKS, _CHROME, _VOID = frozenset(BLOCKS), frozenset(CHROME), frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES, _OUTSIDE, _ROLES, _COMMENTS = frozenset(CHROME_NAMES), frozenset(CHROME_NAMES_OUTSIDE), frozenset(CHROME_ROLES), frozenset(COMMENT_NAMES)
_CONTROLS, _CONTAINERS, _BY_ID, _ADVERTS, _HEADINGS = map(frozenset, (CONTROLS, CONTAINERS, CONTAINERS_BY_ID, ADVERT_NAMES, HEADINGS))
_PARTS, _NOT_PARTS = frozenset(CHROME_PARTS), frozenset(NOT_CHROME_PARTS)
_RAW = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(SILENT)})\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
# a tag with its quoted values whole; else, where quotes don't close, up to the next >
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]*>")
# every attribute, so that no value is taken for a name
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _named_chrome(names: list[str], in_article: bool) -> bool:
    if not _NAMES.isdisjoint(names) or not in_article and not _OUTSIDE.isdisjoint(names):
        return True
    return any(not _PARTS.isdisjoint(parts) and _NOT_PARTS.isdisjoint(parts) for parts in (n.split("-") for n in names if "-" in n))


def _named(element: str, key: str, names: list[str], in_article: bool) -> bool:
    """Whether the names in an element's class or id tell that it is chrome."""
    if element == "article":
        return not _COMMENTS.isdisjoint(names)
    if element in _HEADINGS:
        return key == "class" and not in_article and _named_chrome(names, in_article)
    if not in_article:
        return _named_chrome(names, in_article)
    if element not in (_CONTAINERS if key == "class" else _BY_ID):
        return not _ADVERTS.isdisjoint(names) if key == "class" else element == "section" and not _COMMENTS.isdisjoint(names)
    return _named_chrome(names, in_article)


def _is_chrome(name: str, attributes: str, in_article: bool) -> bool:
    if name in _CHROME:
        return not (name == "header" and in_article)  # an article's own header holds its heading
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values).lower(), key.lower()
        if key in ("class", "id"):
            names = value.replace("_", "-").split()
            if _named(name, key, names, in_article):
                return True
        elif name != "article" and (key == "role" and value in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true"):
            return True
    return False


def _closings(tags: list[tuple]) -> dict[int, int]:
    """Positions of opening tags and of the tags that close them; what nothing closes is left out."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, (_, _, closing, name, _) in enumerate(tags):
        if not closing:
            opened.setdefault(name, []).append(i)
        elif opened.get(name):
            found[opened[name].pop()] = i
    return found


#: Text, characters of it in links, number of its outermost article (main: negative; neither: 0). Gaps have no text.
Line = tuple[str, int, int]
_GAP: list[Line] = [("", 0, 0)] * WINDOW


def lines_of(page: str) -> list[Line]:
    """Lines of the page; an element of chrome is a gap of as many empty lines as a window has."""
    page = _RAW.sub(" ", page)
    tags = [(m.start(), m.end(), "/" in (m[1], m[4]), (m[2] or m[5] or "").lower(), m[3] or m[6] or "") for m in _TAG.finditer(page)]
    closings = _closings(tags)
    lines: list[Line] = []
    words: list[tuple[str, bool]] = []  # and whether they are a control's
    pending: list[str] = []
    links, in_link, inside, articles = 0, False, [], 0
    controls_until = -1  # number of the tag that ends the control

    def flush() -> None:
        nonlocal links
        text = html.unescape("".join(pending))
        pending.clear()
        words.append((text, i <= controls_until))
        if in_link:
            links += len(text.strip())

    def close() -> None:
        nonlocal links
        own = "".join(w for w, of_control in words if not of_control)
        if len(own.strip()) > sum(len(w.strip()) for w, of_control in words if of_control):
            own = "".join(w for w, _ in words)
        text = " ".join(own.split())
        if text:
            lines.append((text, min(links, len(text)), inside[0] if inside else 0))
        words.clear()
        links = 0

    at, i = 0, 0
    while i < len(tags):
        start, end, closing, name, attributes = tags[i]
        pending.append(page[at:start])
        at = end
        block = name in _BLOCKS
        if name == "a":
            flush()
            in_link = not closing
        elif name == "br":
            flush()
            words.append((" ", False))
        elif name == "option":
            flush()
            words.append((" ", True))
        elif block or name in _CONTROLS or (attributes and not closing and name not in _VOID):
            chrome = not closing and name not in _VOID and not attributes.endswith("/") and _is_chrome(name, attributes, bool(inside))
            if block or chrome or name in _CONTROLS:
                flush()
            if block:
                close()
            if name in _CONTROLS and not closing and not chrome and i > controls_until:
                # one that nothing closes ends where the next block does
                controls_until = closings.get(i) or next((k for k in range(i + 1, len(tags)) if tags[k][3] in _BLOCKS), len(tags))
            if chrome:
                if i in closings:
                    i = closings[i]
                    at = tags[i][1]
                else:  # nothing closes it
                    i = next((k for k in range(i + 1, len(tags)) if tags[k][3] in _UNTIL), len(tags)) - 1
                    at = tags[i + 1][0] if i + 1 < len(tags) else len(page)
                if block:
                    lines += _GAP
            elif name in ("article", "main"):
                if closing and inside:
                    inside.pop()
                elif not closing:
                    articles += 1
                    inside.append(inside[0] if inside else articles if name == "article" else -articles)
        i += 1
    pending.append(page[at:])
    flush()
    close()
    return lines


def stretches(own: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """From surge to dive, end exclusive: lines between which no window has a sum of nothing; and the sums of each line's window."""
    sums = [sum(own[i : i + WINDOW]) for i in range(len(own))]
    found: list[tuple[int, int]] = []
    for i, n in enumerate(own):
        if n and found and i - found[-1][1] < WINDOW:
            found[-1] = (found[-1][0], i + 1)
        elif n:
            found.append((i, i + 1))
    return found, sums


def _reached(lines: list[Line], own: list[int], dense: list[tuple[int, int]], peak: int, step: int) -> int:
    """Number of the last dense stretch going one way from the peak's: beyond links, while the text there is longer than they are."""
    last, text, links, at = peak, 0, 0, peak
    while 0 <= at + step < len(dense):
        before, after = sorted((dense[at], dense[at + step]))
        links += sum(len(lines[i][0]) for i in range(before[1], after[0]) if not own[i])
        at += step
        text += sum(own[slice(*dense[at])])
        if text > links:
            last, text, links = at, 0, 0
    return last


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in order, white space within a block as one space, joined by line feeds."""
    lines = lines_of(page or "")
    own = [0 if links > MAX_LINK_SHARE * len(text) else len(text) for text, links, _ in lines]
    runs, sums = stretches(own)
    if not runs:
        return ""
    least = SURGE_SHARE * min(max(sums), WINDOW * FULL_LINE)
    dense = [run for run in runs if max(sums[run[0] : run[1]]) >= least]
    peak = max(range(len(dense)), key=lambda k: (sum(own[slice(*dense[k])]), -k))
    dense = dense[_reached(lines, own, dense, peak, -1) : _reached(lines, own, dense, peak, 1) + 1]
    element = [e for _, _, e in lines]
    # ties: elements that the dense stretches meet and their siblings, if most of the text is in them
    met = {element[i] for run in dense for i in range(*run) if own[i]} - {0}
    if met and 2 * sum(own[i] for run in dense for i in range(*run) if element[i]) > sum(own[i] for run in dense for i in range(*run)):
        dense = [run for run in dense if any(element[i] for i in range(*run))]
        met |= {e for e, n in zip(element, own) if n and e * max(met) > 0 or n and e * min(met) > 0}
        (surge, _), (_, dive) = dense[0], dense[-1]
        while surge < dive and not element[surge] and own[surge] < least:
            surge += 1
        while surge < dive and not element[dive - 1] and own[dive - 1] < least:
            dive -= 1
    else:
        (surge, _), (_, dive) = dense[0], dense[-1]
    inside = [i for i, e in enumerate(element) if e in met]
    surge, dive = min([surge, *inside[:1]]), max([dive, *[i + 1 for i in inside[-1:]]])
    return "\n".join(text for text, _, _ in lines[surge:dive] if text)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each whole page.

    Null and empty pages, and pages whose lines are all links, give the empty text. Of equal peaks the first counts.
    Character references are decoded, broken markup is read as it stands, and nothing of the article is dropped or
    cut. Repeated rows get equal results; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def work(batch: pa.RecordBatch) -> dict:
        found = [main_text(page) for page in texts(batch, "html")]
        return {"page_id": column(batch, "page_id"), "url": column(batch, "url"), "text": found, "n_chars": [len(t) for t in found]}

    return map_batches(rows, "page_id bigint, url string, text string, n_chars bigint", work)
