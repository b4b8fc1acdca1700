"""Patterns that both Java and Python understand."""

from __future__ import annotations

#: White space as Python's str methods see it.
W = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: What a URL looks like.
URL = r'https?://[^\s<>"{}|\\^`\[\]]+[^\s<>"{}|\\^`\[\].,;!?)]'
#: Lines of a table of contents.
TOC_LINES = [r"\.{3,}", rf"{W}+\d+$", rf"\.{{2,}}{W}*\d+", r"^\d+\.\d+\..*\d+$", rf"^[A-Z]\.{W}+.*\d+$"]
#: What ends a table of contents, at a line's start; and one phrase anywhere in it.
TOC_ENDS = r"^(SECTION 1:|1\.|CHAPTER|PART|APPENDIX)|GENERAL ISSUANCE INFORMATION"
#: Lines that stay however short.
MARKERS = "SECTION|CHAPTER|PART|DODD|DODI|APPENDIX|TABLE"
