"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block element's text; elements of the kinds that are never
the article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) become empty lines, and link text counts nothing. The lengths of the lines are summed over
a sliding window. Where the sums rise over a share of the page's highest sum is a surge, where they
fall below it again a dive; the lines between are the text, trimmed to the lines that made the sums
rise and fall. Short lines next to it, such as a title or a last remark, have no sum of their own: they
stay where they are in the same article, or the same container, as lines between a surge and its dive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Lines in a window.
WINDOW = 3
#: A surge is a rise over this share of the page's highest sum.
SURGE = 0.2

#: Element names of the HTML standard (HEAD: what a head holds).
RAW = "script style noscript template svg math iframe object audio video canvas title textarea select"
APART = "nav header footer aside form menu dialog button fieldset"
MARKED = "article main"
HEAD = "base basefont bgsound link meta noscript script style template title"
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr"
VOID = "area base br col embed hr img input link meta param source track wbr"
HOMES = "div article main"
#: Names of class, id and role for what is never the article. Each has to be the whole
#: name, or all of its parts have to be such names or PLAIN ones. ALWAYS: also inside an article, and however much text they hold.
MENUS = "menu nav navbar navigation breadcrumb breadcrumbs topnav subnav toolbar pagination share sharing"
HEADERS = "header masthead banner topbar"
FOOTERS = "footer colophon contentinfo"
SIDEBARS = "sidebar sidenav aside complementary widget widgets"
NOTICES = "notice notices alert cookie cookies consent gdpr disclaimer popup modal"
ADVERTS = "ad ads adbox adslot adunit adsbygoogle advert adverts advertisement advertisements advertising sponsored promo promoted"
FORMS = "form login signin signup subscribe subscription newsletter respond"
COMMENTS = "comment comments disqus replies"
PLAIN = "area bar block bottom box btn button buttons col column container content footer global group header inner item items left links list main menu outer page panel primary reader right secondary section site social top user wrap wrapper"
NOT_WITHIN = "notice notices alert cookie cookies consent gdpr disclaimer popup modal menu header banner footer form content navigation"
RAW, APART, MARKED, HEAD, INLINE, VOID, HOMES, COMMENTS, PLAIN, NOT_WITHIN = (
    frozenset(x.split()) for x in (RAW, APART, MARKED, HEAD, INLINE, VOID, HOMES, COMMENTS, PLAIN, NOT_WITHIN)
)
FURNITURE = frozenset(" ".join((MENUS, HEADERS, FOOTERS, SIDEBARS, NOTICES, ADVERTS, FORMS)).split()) | COMMENTS

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCK = re.compile(r"h[1-6]|p|li|dt|dd|td|th|pre|blockquote|figcaption|caption")
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)|display\s*:\s*none", re.I)

#: A line: its text, weight, the outermost article (else the main element) it is in, its container, and that one's own container.
Line = tuple[str, int, int, int, int]
EMPTY: Line = ("", 0, -1, -1, -1)

EXTRACTED = "page_id long, url string, text string, spans array<struct<first:int,last:int>>"


def is_apart(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's kind, or that it is hidden, keeps it out of the article."""
    if name == "head" or name in APART and not (inside and name == "header"):
        return True
    return name not in ("main", "body", "html") and bool(HIDDEN.search(attributes))


def furniture(name: str, attributes: str, inside: bool) -> bool | None:
    """Whether an element's names tell something other than the article; None if reader comments.

    Inside an article the names of notices, menus and the like may be its subject and don't count,
    nor does any id but that of comments or adverts, nor a name of a heading or paragraph.
    """
    if name in ("main", "body", "html") or not attributes or inside and BLOCK.fullmatch(name):
        return False
    known = FURNITURE - NOT_WITHIN if inside else FURNITURE
    for kind, *values in NAMED.findall(attributes):
        for word in "".join(values).split():
            parts = {x.lower() for x in PARTS.findall(word)}
            if known.isdisjoint(parts) or not (known | PLAIN).issuperset(parts):
                continue
            if name in MARKED and not parts <= COMMENTS | PLAIN and kind.lower() != "role":
                continue  # an article about something, unless it is a comment
            if inside and kind.lower() == "id" and word.lower() not in COMMENTS | {"ad", "ads", "adbox", "adslot", "adunit", "sidebar", "sidenav"}:
                continue
            return None if not COMMENTS.isdisjoint(parts) else True
    return False


def _raw_end(html: str, name: str, at: int) -> int:
    """The end of an element whose content isn't markup; the page's end if it isn't closed."""
    found = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
    return found.end() if found else len(html)


def lines(html: str, spared: frozenset[int] | None = frozenset(), masses: dict[int, tuple[int, int]] | None = None) -> Iterator[Line]:
    """The page's lines. A line's weight is the length of its text outside links. A removed element
    leaves empty lines of a window's height.

    Elements at the places `spared` are kept whatever their names (None: all are). masses gets the
    weight in each element that its names make furniture, and that of articles in it, by place, if that is kept."""
    html = COMMENT.sub("", html)
    open_: list[tuple[str, bool]] = []  # names, and whether furniture begins there (in one at most)
    begun: list[tuple[int, int, int]] = []  # place, the weight before it, and that of articles; place -1 without a name of furniture
    within = [(-1, -1, False, -1)]  # container, its own container, whether in an article, and the outermost article or main
    seen = marked = 0
    names: Counter[str] = Counter()
    hidden = inside = links = hidden_at = 0
    last = html.rfind(">")
    parts: list[str] = []
    weight, at = 0, 0

    def line() -> Iterator[Line]:
        nonlocal parts, weight
        if text := " ".join(unescape("".join(parts)).split()):
            home, outer, _, unit = within[-1]
            yield text, weight, unit, home, outer
        parts, weight = [], 0

    def close(upto: int) -> None:
        nonlocal hidden, inside, links
        while len(open_) > upto:
            name, apart = open_.pop()
            place, before, marked_before = begun.pop()
            within.pop()
            if place >= 0 and masses is not None:
                masses[place] = seen - before, marked - marked_before
            names[name] -= 1
            hidden -= apart
            inside -= name in MARKED
            links -= name == "a"

    while True:
        tag = TAG.search(html, at) if at <= last else None
        piece = html[at : tag.start() if tag else len(html)]
        if names["head"] and (piece.strip() or tag and not tag[1] and not tag[4] and (tag[2] or tag[5]).lower() not in HEAD):  # its end may be left out
            close(next(k for k in range(len(open_)) if open_[k][0] == "head"))
        if piece and not hidden:
            parts.append(piece)
            if not links:
                weight += len(piece) - piece.count(" ")
                seen += len(piece) - piece.count(" ")
                marked += (len(piece) - piece.count(" ")) * (inside > 0)
        if not tag:
            break
        at = tag.end()
        shut, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        name = name.lower()
        if name not in INLINE:
            yield from line()
        if shut:
            for k in range(len(open_) - 1, -1, -1) if names[name] else ():
                if open_[k][0] == name:
                    if any(apart for _, apart in open_[k:]):
                        yield from line()
                        yield from (EMPTY,) * WINDOW
                    close(k)
                    break
        elif name in RAW:
            if not attributes.endswith("/"):
                at = _raw_end(html, name, at)
        elif name not in VOID and not attributes.endswith("/"):
            if name in MARKED and hidden and open_[hidden_at][0] not in MARKED:  # furniture that was never closed
                close(hidden_at)
                yield from (EMPTY,) * WINDOW
            if name == "p" and open_ and open_[-1][0] == "p" or name == "li" and open_ and open_[-1][0] == "li" or name == "a" and links:
                close(next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name))
            place, named = tag.start(), False if hidden else furniture(name, attributes, inside > 0)
            apart = not hidden and is_apart(name, attributes, inside > 0) or named is not False and spared is not None and place not in spared
            if apart:
                yield from line()
                yield from (EMPTY,) * WINDOW
            if apart:
                hidden_at = len(open_)
            open_.append((name, apart))
            home, outer, article, unit = within[-1]
            if name in HOMES:
                home, outer = place, home
            if name == "article" and not article or name == "main" and unit < 0:
                article, unit = name == "article", place
            within.append((home, outer, article, unit))
            begun.append((place if named else -1, seen, marked))
            names[name] += 1
            hidden += apart
            inside += name in MARKED
            links += name == "a"
    yield from line()
    close(0)


def page_lines(html: str) -> list[Line]:
    """The lines of a page. An element with most of its text is no furniture, whatever its names, but for
    reader comments, and where the page marks an article outside of it; and where nothing would be
    left, none is."""
    masses: dict[int, tuple[int, int]] = {}
    whole = list(lines(html, None, masses))
    if not masses and not any(x in html for x in ("omment", "isqus", "eplies")):
        return whole
    most, marks = sum(weight for _, weight, *_ in whole) / 2, any(weight and unit >= 0 for _, weight, unit, *_ in whole)
    found = list(lines(html, frozenset(place for place, (mass, marked) in masses.items() if mass > most and (marked or not marks))))
    return found if any(weight for _, weight, *_ in found) else whole


def block_sums(weights: list[int]) -> list[int]:
    """The weight of the window that begins at each line."""
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    n = len(weights)
    return [total[min(n, i + WINDOW)] - total[i] for i in range(n)]


def between(weights: list[int]) -> list[bool]:
    """Which lines are between a surge and its dive.

    The first line kept of a run of high windows is the last one from which the first window still
    is high; the last line kept is the first one up to which the last window is.
    """
    n, block = len(weights), block_sums(weights)
    least = max(1, SURGE * max(block, default=0))
    kept = [False] * n
    for surge, dive in _runs([b >= least for b in block]):
        first, held = min(n, surge + WINDOW), 0
        while held < least:
            first -= 1
            held += weights[first]
        last, held = dive - 2, 0
        while held < least:
            last += 1
            held += weights[last]
        first, last = min(first, last), max(first, last)
        kept[first : last + 1] = [True] * (last + 1 - first)
    return kept


def main_lines(found: list[Line]) -> list[tuple[int, int]]:
    """[first, last): the runs of lines that are kept: those between surges and dives, and what is in one piece with them.

    In one piece are the lines of an article (or, outside any, of a main element); else those
    of a container; containers that hold one line each, like paragraphs, are taken together if something
    but the page itself holds them. Of lines that are in no container, those go on from kept ones
    that follow with nothing but furniture between.
    """
    weights = [weight for _, weight, *_ in found]
    if not any(weights):  # nothing but links: then they are the text
        weights = [len(text) for text, *_ in found]
    kept = between(weights)
    lone = Counter(home for text, _, _, home, _ in found if text)

    def piece(line: Line) -> tuple[int, int] | None:
        _, _, unit, home, outer = line
        if unit >= 0:
            return unit, 0
        if home >= 0 and lone[home] == 1:
            return (outer, 1) if outer >= 0 else None
        return (home, 2) if home >= 0 else None

    pieces = {piece(x) for x, k, w in zip(found, kept, weights) if k and w} - {None}
    kept = [bool(x[0]) and (k or piece(x) in pieces) for x, k in zip(found, kept)]
    for way in (range(len(found)), range(len(found) - 1, -1, -1)):
        on = False
        for i in way:
            text, _, unit, home, _ = found[i]
            free = unit < 0 and home < 0 and weights[i] > 0
            if text:
                on = kept[i] = kept[i] or on and free
                on = on and free
    return _runs(kept)


def _runs(kept: list[bool]) -> list[tuple[int, int]]:
    """[first, last) of each run of kept lines."""
    ends = [i for i in range(len(kept) + 1) if (i < len(kept) and kept[i]) != (i > 0 and kept[i - 1])]
    return list(zip(ends[::2], ends[1::2]))


def extract(html: str | None) -> tuple[str, list[tuple[int, int]]]:
    """A page's main text, and the runs of lines it came from."""
    found = page_lines(html or "")
    runs = main_lines(found)
    return " ".join(found[i][0] for a, b in runs for i in range(a, b) if found[i][0]), runs


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, spans): the main text of every row's whole html.

    A null or empty page has an empty text and no spans; very long ones are read whole, in time
    linear in their length. Repeated rows give a row each; an empty table gives no rows; other
    columns are not read, whatever their names. Of equal sums the first is the page's highest, which
    changes nothing. One pass, no shuffle.
    """
    small_batches(pages.sparkSession, rows=256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            out = [extract(x) for x in batch.column(2).to_pylist()]
            spans = [[{"first": a, "last": b} for a, b in runs] for _, runs in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in out], pa.string()), pa.array(spans, kind)], names=["page_id", "url", "text", "spans"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, EXTRACTED)
