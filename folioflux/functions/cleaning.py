"""Cleaning of one text, in plain Python; `text.clean` runs it over Arrow batches.

Rules on lines can be written with Spark's array functions or as expressions over the whole text;
measured, both took several times as long.
"""

from __future__ import annotations

import re

from ..config import DEFAULT, Settings
from .patterns import MARKERS, TOC_ENDS, TOC_LINES, URL

TOC_LINE, TOC_END = re.compile("|".join(TOC_LINES)), re.compile(TOC_ENDS)
TITLE = "TABLE OF CONTENTS"
LINK = re.compile(URL)
BLANKS, MANY_BREAKS, MORE_BREAKS, CONTROLS = re.compile(r"[ \t]{2,}|\t"), re.compile(r"\n{4,}"), re.compile(r"\n{3,}"), re.compile(r"[\f\r\x0b]")
# A break, the white space after it, and a page number's line; without one the white space is passed over once.
NUMBER = re.compile(r"\n\s*+(\d{1,4}\s*\n)?")
PAGE = re.compile(r"\n\s*+(Page \d+ of \d+\s*\n)?", re.I)
BEFORE_MARK, AFTER_END = re.compile(r"\s++([.,;:!?])"), re.compile(r"([.!?])\s*([a-z])")
KEPT, NAMED = re.compile(MARKERS), re.compile(r"[A-Z0-9]+[.:]\s*[A-Z]")


def is_toc_line(bare: str) -> bool:
    """Whether a stripped line looks like an entry of a table of contents; each kind has two dots or ends in a digit."""
    return (".." in bare or bare[-1:].isdecimal()) and TOC_LINE.search(bare) is not None


def remove_toc(text: str) -> str:
    """Drop everything before the line that ends a table of contents, and lines that look like its entries anywhere."""
    lines = text.split("\n")
    bare = [x.strip() for x in lines]
    first = 0
    if TITLE in text.upper():
        titles = [TITLE in x.upper() for x in bare]
        title = next((k for k, x in enumerate(titles) if x), len(lines))
        first = next((k for k in range(title + 1, len(lines)) if not titles[k] and TOC_END.search(bare[k])), 0)
    return "\n".join(x for x, b in zip(lines[first:], bare[first:]) if not is_toc_line(b))


def _one_blank(text: str) -> str:
    """Runs of spaces and tabs as one space; most texts have none."""
    return BLANKS.sub(" ", text) if "  " in text or "\t" in text else text


def spaced(text: str) -> str:
    """No white space before punctuation, one space between the end of a sentence and a small letter."""
    return AFTER_END.sub(r"\1 \2", BEFORE_MARK.sub(r"\1", text))


def fix_spacing(text: str) -> str:
    """Spacing around punctuation, with URLs left as they are; a URL stands for an ordinary character."""
    links = LINK.findall(text) if "http" in text else []
    if not links:
        return spaced(text)
    between = spaced(LINK.sub("\x01", text)).split("\x01")
    return "".join(x for pair in zip(between, [*links, ""]) for x in pair)


def _stays(bare: str, s: Settings) -> bool:
    return len(bare) > s.min_line_chars or bool(KEPT.search(bare.upper()) or NAMED.match(bare)) or bare.startswith("===")


def clean(text: str, s: Settings = DEFAULT) -> str:
    """Clean extracted text but keep its lines: tables of contents, page numbers and very short lines go."""
    text = CONTROLS.sub("", MANY_BREAKS.sub("\n\n\n", _one_blank(remove_toc(text))))
    for rule in (NUMBER, PAGE):
        text = rule.sub(lambda m: "\n" if m[1] else m[0], text)
    return fix_spacing("\n".join(x for x in text.split("\n") if _stays(x.strip(), s))).strip()


def final_cleanup(text: str, shield_urls: bool = True) -> str:
    """White space and punctuation of a finished chunk; URLs stay as they are, unless told otherwise."""
    text = MORE_BREAKS.sub("\n\n", _one_blank(text))
    return (fix_spacing(text) if shield_urls else spaced(text)).strip()
