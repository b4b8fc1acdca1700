"""Chunks of one text, in plain Python: what the column functions of `chunking` run over Arrow batches.

A text is cut by a few passes over its words, sentences or lines, each linear in the text. Where the
plain rules would lose text (lines before the first heading, headings with nothing below, the tail
after the last punctuation mark) these functions keep it; compat=True loses it, or repeats it, as
those rules do.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from ..config import DEFAULT, Settings
from ..functions.cleaning import final_cleanup
from .structure import HEADINGS

SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+")
PARAGRAPH_GAP = re.compile(r"\n\s*\n")
WIDE_GAP = re.compile(r"\n\s*\n\s*\n")
STOP = re.compile(r"[.!?;,]$")
MARK_GAP = re.compile(r"(?<=[.!?;:,])\s*")
KINDS = [(re.compile(pattern, re.I), level) for _, pattern, level, _ in HEADINGS]
ANY_KIND = re.compile("|".join(pattern for _, pattern, _, _ in HEADINGS), re.I)


def n_words(text: str) -> int:
    return len(text.split())


class _Packer:
    """Parts joined while they fit; what is full is put away."""

    def __init__(self, by: str) -> None:
        self.by, self.done, self.parts, self.n = by, [], [], 0

    def put(self, part: str, n: int, goes_on: bool) -> None:
        if not goes_on:
            self.flush()
        self.parts.append(part)
        self.n += n

    def flush(self) -> None:
        if joined := self.joined():
            self.done.append(joined)
        self.parts, self.n = [], 0

    def joined(self) -> str:
        kept = self.parts
        while len(kept) > 1 and not kept[0]:  # nothing is joined to an empty start
            kept = kept[1:]
        return self.by.join(kept)

    def all(self) -> list[str]:
        self.flush()
        return self.done


def split_at_punctuation(sentence: str, s: Settings = DEFAULT, ahead: int = 50, compat: bool = False) -> list[str]:
    """A long sentence cut after the first word from target_words on that ends in . ! ? ; or ,

    If none is among the `ahead` words from max_words on, it is cut at max_words. compat: the look
    ahead begins at target_words, and the words it passed over begin the next chunk too.
    """
    words = sentence.split()
    stop, following = len(words), [0] * len(words)  # the first stop at or after each word
    for k in range(len(words) - 1, -1, -1):
        if STOP.search(words[k]):
            stop = k
        following[k] = stop
    out, at = [], 0
    while at < len(words):
        cut = upto = len(words)
        for k in range(at + s.target_words - 1, min(len(words), at + s.max_words)):
            if compat:
                if following[k] < min(len(words), k + 50):
                    cut, upto = k + 1, following[k] + 1
                    break
                if k == at + s.max_words - 1:
                    cut = upto = k + 1
            elif following[k] == k:
                cut = upto = k + 1
                break
            elif k == at + s.max_words - 1:  # a stop a little further on, or none
                cut = upto = following[k] + 1 if following[k] < min(len(words), k + ahead) else k + 1
        out.append(" ".join(words[at:upto]))
        at = cut
    return out


def pack_sentences(text: str, s: Settings = DEFAULT, compat: bool = False) -> list[str]:
    """Sentences packed to target_words; one of over max_words is cut at punctuation."""
    packer = _Packer(" ")
    for part in SENTENCE_GAP.split(text):
        n = n_words(part)
        if n > s.max_words:
            packer.flush()
            packer.done += split_at_punctuation(part, s, compat=compat)
        else:
            packer.put(part, n, packer.n + n <= s.target_words)
    return packer.all()


def _pack_paragraphs(paragraphs: list[str], split: Callable[[str], list[str]], s: Settings) -> list[str]:
    packer = _Packer("\n\n")
    for part in paragraphs:
        n = n_words(part)
        if packer.n + n > s.target_words and n > s.max_words:
            packer.flush()
            packer.done += split(part)
        else:
            packer.put(part, n, packer.n + n <= s.target_words)
    return packer.all()


def fallback_chunks(text: str, s: Settings = DEFAULT, compat: bool = False) -> list[str]:
    """Chunks of a text without headings: paragraphs packed to target_words, long ones by sentences."""
    paragraphs = (WIDE_GAP if WIDE_GAP.search(text) else PARAGRAPH_GAP).split(text)
    return _pack_paragraphs([p for p in map(str.strip, paragraphs) if p], lambda part: split_plain(part, s, compat), s)


def split_plain(text: str, s: Settings = DEFAULT, compat: bool = False) -> list[str]:
    """A long text by its paragraphs, or by its sentences where it has one paragraph only."""
    inner = PARAGRAPH_GAP.split(text)
    return _pack_paragraphs(inner, lambda p: pack_sentences(p, s, compat), s) if len(inner) > 1 else pack_sentences(text, s, compat)


def table_aware_split(text: str, s: Settings = DEFAULT) -> list[str]:
    """A section's text split around its marked tables; an extension that chunk() does not use.

    A table of up to max_table_words stays whole, with the text before it where both fit in that; a
    larger one is cut between lines at target_words. Text after the last table is a chunk, or split
    if over max_words. An end marker closes the table that the last start marker before it opened.
    """
    lines, out, after, opened = text.split("\n"), [], 0, None
    for k, line in enumerate(lines):
        if "=== TABLE" not in line:
            continue
        if "START ===" in line:
            opened = k
        elif "END ===" in line:
            if opened is not None:
                before, table = "\n".join(lines[after:opened]), "\n".join(lines[opened : k + 1])
                both = f"{before}\n{table}" if before.strip() else table
                if n_words(table) > s.max_table_words:
                    packer = _Packer("\n")
                    for row in lines[opened : k + 1]:
                        n = n_words(row)
                        packer.put(row, n, packer.n + n <= s.target_words or not packer.joined())
                    out += [before, *packer.all()]
                else:
                    out += [both] if n_words(both) <= s.max_table_words else [before, table]
                after = k + 1
            opened = None
    rest = "\n".join(lines[after:])
    out += split_plain(rest, s) if n_words(rest) > s.max_words else [rest]
    return [c for c in out if c.strip()]


def merge_small(chunks: list[str], s: Settings = DEFAULT) -> list[str]:
    """Neighbours joined by a blank line where one is under min_words and both fit in max_words."""
    out: list[str] = []
    sizes: list[int] = []
    for chunk in chunks:
        n = n_words(chunk)
        if sizes and not sizes[-1]:
            out[-1], sizes[-1] = chunk, n
        elif sizes and min(sizes[-1], n) < s.min_words and sizes[-1] + n <= s.max_words:
            out[-1], sizes[-1] = f"{out[-1]}\n\n{chunk}", sizes[-1] + n
        else:
            out.append(chunk)
            sizes.append(n)
    if sizes and not out[-1]:
        out.pop()
    return out


def overlap_text(before: str, chunk: str, s: Settings = DEFAULT) -> str:
    """What is repeated of the chunk before: its last whole sentences of up to overlap_words; else its
    last words; else the first words of the chunk itself; else nothing."""
    room, kept = s.overlap_words, []
    for sentence in reversed([x for x in map(str.strip, SENTENCE_GAP.split(before.strip())) if x]):
        room -= n_words(sentence)
        if room < 0:
            break
        kept.append(sentence)
    if kept:
        return " ".join(reversed(kept))
    for words, last in ((before.split(), True), (chunk.split(), False)):
        if len(words) >= s.overlap_words:
            return " ".join(words[-s.overlap_words :] if last else words[: s.overlap_words])
    return ""


def apply_overlap(chunks: list[str], s: Settings = DEFAULT) -> list[str]:
    """Each chunk but the first with the overlap from the one before it (as it was) in front."""
    if not s.overlap_words:
        return chunks
    extra = ["", *(overlap_text(a, b, s) for a, b in zip(chunks, chunks[1:]))]
    return [f"{e} {c}" if e else c for e, c in zip(extra, chunks)]


def pack_parts(parts: list[str], target: int) -> list[str]:
    """Parts joined by spaces while at most `target` words; blank results go."""
    packer = _Packer(" ")
    for part in parts:
        n = n_words(part)
        packer.put(part, n, packer.n + n <= target)
    return [c for c in map(str.strip, packer.all()) if c]


def split_oversized(chunk: str, s: Settings = DEFAULT, compat: bool = False) -> list[str]:
    """A chunk of over max_words split at paragraphs, else at sentences, else at punctuation."""
    target = int(s.target_words * 0.9)
    for gap in (PARAGRAPH_GAP, SENTENCE_GAP):
        if gap.search(chunk):
            found = pack_parts(gap.split(chunk), target)
            if found and all(n_words(c) <= s.max_words for c in found):
                return found
    parts = [p for p in MARK_GAP.split(chunk) if p]
    if compat:
        parts = [p for p in parts if p[-1] in ".!?;:,"]
    return pack_parts(parts, target)


def enforce_size(chunks: list[str], s: Settings = DEFAULT, compat: bool = False) -> list[str]:
    """Chunks of over max_words split; a run without any punctuation is cut at max_words."""
    out: list[str] = []
    for chunk in chunks:
        for part in [chunk] if n_words(chunk) <= s.max_words else split_oversized(chunk, s, compat):
            out += [part] if compat or n_words(part) <= s.max_words else split_at_punctuation(part, s, ahead=0)
    return out


def finish(chunks: list[str], s: Settings = DEFAULT, compat: bool = False) -> list[str]:
    """The final pass: clean, drop empty, merge small, overlap, enforce the size."""
    cleaned = [c for c in (final_cleanup(c, not compat) for c in chunks) if c]
    return enforce_size(apply_overlap(merge_small(cleaned, s), s), s, compat)


class Section(NamedTuple):
    """A heading and the lines up to the next one; next_idx is the first section after its subtree."""

    idx: int
    line: int
    level: int
    parent: int | None
    next_idx: int
    text: str
    before: int  # words of earlier sections
    subtree: int  # words of it and of what is below
    has_content: bool


def level_of(bare: str) -> int | None:
    """The level of a heading line, None for other lines; the first kind that fits counts."""
    return next((level for kind, level in KINDS if kind.match(bare)), None) if ANY_KIND.match(bare) else None


def section_tree(lines: list[str]) -> list[Section]:
    """A document's sections. A section's parent is the last heading before it of a lower level, its end
    the next one of its own level or a lower one: a pass forward and one back with one number a level."""
    bare = [x.strip() for x in lines]
    heads = [(k, level) for k, b in enumerate(bare) if (level := level_of(b)) is not None]
    n = len(heads)
    parents, nexts, seen = [], [n] * n, [-1] * 8
    for i, (_, level) in enumerate(heads):
        parents.append(max(seen[:level], default=-1))
        seen[level] = i
    seen = [n] * 8
    for i in range(n - 1, -1, -1):
        level = heads[i][1]
        nexts[i] = min(seen[: level + 1])
        seen[level] = i
    texts, words, filled = [], [0], [0]
    for (k, _), stop in zip(heads, [*(k for k, _ in heads[1:]), len(lines)]):
        content = "\n".join(lines[k + 1 : stop])
        texts.append(f"{bare[k]}\n{content}" if content.strip() else bare[k])
        words.append(words[-1] + n_words(bare[k]) + n_words(content))
        filled.append(filled[-1] + sum(1 for b in bare[k + 1 : stop] if b))
    return [
        Section(i, k, level, parents[i] if parents[i] >= 0 else None, nexts[i], texts[i], words[i], words[nexts[i]] - words[i], filled[nexts[i]] > filled[i])
        for i, (k, level) in enumerate(heads)
    ]


def runs(sections: list[Section], s: Settings = DEFAULT, compat: bool = False) -> list[tuple[int, int]]:
    """Runs [first, stop) of sections that make the chunks.

    From a section, children with their whole subtrees are added in order while the run's words are
    at most max_words. The next run starts at the first section after it that has content (with
    compat; else at the next one).
    """
    out, i = [], 0
    total = [x.before for x in sections] + ([sections[-1].before + sections[-1].subtree] if sections else [])
    while i < len(sections):
        if compat and not sections[i].has_content:
            i += 1
            continue
        stop = i + 1
        while stop < sections[i].next_idx and total[sections[stop].next_idx] - total[i] <= s.max_words:
            stop = sections[stop].next_idx
        out.append((i, stop))
        i = stop
    return out


def hierarchical_chunks(text: str, s: Settings = DEFAULT, compat: bool = False) -> list[str]:
    """The unfinished chunks of a text with headings: runs of whole sections. No headings, no chunks."""
    lines = text.split("\n")
    sections = section_tree(lines)
    found = ["\n".join(x.text for x in sections[a:b]) for a, b in runs(sections, s, compat)]
    before = "\n".join(lines[: sections[0].line]) if sections and not compat else ""
    return [before, *found] if before.strip() else found  # the lines before the first heading are a run of their own


def chunk(text: str, s: Settings = DEFAULT, compat: bool = False) -> list[str]:
    """All chunks of a cleaned text: none if blank, one if short, by headings, or by sentences."""
    if n_words(text) <= s.max_words:
        one = final_cleanup(text, not compat)
        return [one] if one else []
    if any(ANY_KIND.match(x.strip()) for x in text.split("\n")):
        return finish(hierarchical_chunks(text, s, compat), s, compat)
    return fallback_chunks(text, s, compat)
