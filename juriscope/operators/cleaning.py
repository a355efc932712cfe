"""Cleaning of legal text with exact offsets into the source.

Every cleaner rewrites matches and carries the source offset of each character along, so the
composition of all edits is exact. The chain's cheap character-level steps also exist as native
Column expressions (``clean_column``) for queries that need no offsets.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Block-level tags and named entities.
BLOCK_TAGS = frozenset("p div br hr h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote section article header footer pre dl dt dd center".split())
ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&sect;": "§", "&para;": "¶", "&mdash;": "—", "&ndash;": "–"}
SPACES = "\t\n\r\xa0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"


class Traced:
    """Text whose every character knows its offset in the source; the last entry is the source's end."""

    def __init__(self, text: str):
        self.text, self._origin = text, None

    @property
    def origin(self) -> np.ndarray:
        """Made when it is first asked for: most texts are cleaned without an edit."""
        if self._origin is None:
            self._origin = np.arange(len(self.text) + 1, dtype=np.int64)
        return self._origin

    def edit(self, pattern: re.Pattern, replace: Callable[[re.Match], str]) -> None:
        pieces, origins, at = [], [], 0
        for m in pattern.finditer(self.text):
            new = replace(m)
            if new == m[0]:
                continue
            a, b = m.span()
            pieces += [self.text[at:a], new]
            own = self.origin[a : b + 1]
            spread = np.minimum(np.arange(len(new)), max(0, b - a - 1))
            origins += [self.origin[at:a], own[spread] if b > a else np.full(len(new), self.origin[a])]
            at = b
        if pieces:
            self._origin = np.concatenate([*origins, self.origin[at:]])
            self.text = "".join(pieces) + self.text[at:]

    def translate(self, chars: str, to: str) -> None:
        """One character for one; replacing the few that are there is far quicker than a table."""
        for c in set(self.text).intersection(chars):
            self.text = self.text.replace(c, to)

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        if self._origin is None:
            return start, max(start, end)
        if end <= start:
            return int(self.origin[start]), int(self.origin[start])
        return int(self.origin[start]), int(self.origin[end - 1]) + 1

    def segments(self) -> list[dict]:
        """Runs in which clean and source offsets advance together."""
        if not self.text:
            return []
        starts = np.flatnonzero(np.diff(self.origin[:-1], prepend=self.origin[0] - 2) != 1)
        ends = np.append(starts[1:], len(self.text))
        return [{"clean_pos": int(s), "orig_pos": int(self.origin[s]), "len": int(e - s)} for s, e in zip(starts, ends, strict=True)]


_SCRIPT = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I)
_CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
_TAGS = re.compile(r"(?:\s*(?:</?[a-zA-Z][^<>]*>|<!--.*?-->|<[!?][^<>]*>))+\s*", re.S)
_TAG_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")


def strip_html(doc: Traced) -> None:
    """Tags go: a block tag ends a sentence, a line break or a tag between words leaves a space."""
    if "<" not in doc.text:
        return
    doc.edit(_SCRIPT, lambda m: "")
    doc.edit(_CDATA, lambda m: m[1])
    text = doc.text

    def replace(m: re.Match) -> str:
        before = text[m.start() - 1] if m.start() else ""
        after = text[m.end()] if m.end() < len(text) else ""
        names = {n.lower() for n in _TAG_NAME.findall(m[0])}
        spaced = m[0][0].isspace() or m[0][-1].isspace()
        if not before or not after:
            return ""
        if names & (BLOCK_TAGS - {"br"}):
            return " " if before in ".!?;:," else ". "
        if "br" in names or spaced:
            return " "
        return " " if before.isalnum() and after.isalnum() else ""

    doc.edit(_TAGS, replace)


_ENTITY = re.compile("|".join(map(re.escape, ENTITIES)))
_NUMBERED = re.compile(r"&#(?:([xX])([0-9a-fA-F]{1,6})|([0-9]{1,7}));")


def decode_entities(doc: Traced) -> None:
    if "&" not in doc.text:
        return
    doc.edit(_ENTITY, lambda m: ENTITIES[m[0]])

    def number(m: re.Match) -> str:
        code = int(m[2], 16) if m[1] else int(m[3])
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]

    doc.edit(_NUMBERED, number)


_DIVIDED_NUMBER = re.compile(r"(?<=\d)-[ \t]*\r?\n[ \t]*(?=\d)")
_DIVIDED_WORD = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*(?=\w)")


def rejoin_hyphens(doc: Traced) -> None:
    if "\n" not in doc.text or "-" not in doc.text:
        return
    doc.edit(_DIVIDED_NUMBER, lambda m: "-")
    doc.edit(_DIVIDED_WORD, lambda m: "")


_PAGE_BREAK = re.compile(r"(?:^|\n)[ \t]*[-–—][ \t]*\d+[ \t]*[-–—][ \t]*(?:\n|$)")


def strip_page_breaks(doc: Traced) -> None:
    # the first line, or one after a line's end
    if "\n" not in doc.text and not doc.text.lstrip(" \t").startswith(("-", "–", "—")):
        return
    doc.edit(_PAGE_BREAK, lambda m: " ")


def replace_spaces(doc: Traced) -> None:
    doc.translate(SPACES, " ")


_BLANKS = re.compile(r"  +")


def collapse_spaces(doc: Traced) -> None:
    if "  " in doc.text:
        doc.edit(_BLANKS, lambda m: " ")


def normalize_whitespace(doc: Traced) -> None:
    """Both steps in one: any white space becomes a blank, and runs of blanks one."""
    replace_spaces(doc)
    collapse_spaces(doc)


# Marks, soft hyphens, fractions, the numero sign and square units, whose compatibility forms read as letters and digits.
_NO_LETTERS = re.compile("[™®©℠\u00ad¼-¾⅐-⅞№㎀-㏿℀-⅏]")
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


#: A character that the steps below may change: none of ASCII, no section or paragraph mark.
_ODD = re.compile(r"[^\x00-\x7f§¶]")


def normalize_unicode(doc: Traced) -> None:
    if doc.text.isascii() or _ODD.search(doc.text) is None:
        return
    doc.edit(_NO_LETTERS, lambda m: "")
    doc.edit(_BEYOND_ASCII, lambda m: m[0] if all(c in "§¶–—‘’“”…′″†‡°" for c in m[0]) else unicodedata.normalize("NFKC", m[0]))


_DASH_BETWEEN = re.compile(r"(?<=[A-Za-z])—(?=[A-Za-z])")
_DASHES = re.compile("[—―]+")


def normalize_dashes(doc: Traced) -> None:
    if doc.text.isascii() or _ODD.search(doc.text) is None:
        return
    doc.edit(_DASH_BETWEEN, lambda m: "-")
    doc.edit(_DASHES, lambda m: "---")
    doc.translate("‐‑‒–", "-")


def fix_quotes(doc: Traced) -> None:
    if doc.text.isascii() or _ODD.search(doc.text) is None:
        return
    doc.translate("“”„", '"')
    doc.translate("‘’‚", "'")


_ELLIPSIS = re.compile("…")
_ZERO_WIDTH = re.compile("[\u200b\u200c\u200d\u2060]")


def normalize_typography(doc: Traced) -> None:
    if doc.text.isascii() or _ODD.search(doc.text) is None:
        return
    doc.translate("\u2032\u2033", "'")
    doc.edit(_ELLIPSIS, lambda m: "...")
    doc.edit(_ZERO_WIDTH, lambda m: "")


# Abbreviations that are printed with and without inner blanks.
_SPACING = [
    (re.compile(r"\bU\.\s*S\.\s*C\."), "U.S.C."), (re.compile(r"\bC\.\s*F\.\s*R\."), "C.F.R."), (re.compile(r"\b([NS])\.\s+([EW])\."), r"\1.\2."),
    (re.compile(r"\bU\.\s+S\.(?=\s)"), "U.S."), (re.compile(r"\bS\.\s+Ct\."), "S.Ct."), (re.compile(r"\bL\.\s+Ed\."), "L.Ed."), (re.compile(r"\bF\.\s+Supp\."), "F.Supp."),
]
#: The same without the word's beginning: a form that begins with a letter is looked for far quicker.
_SPACING_SIGNS = [re.compile(p.pattern.removeprefix(r"\b")) for p, _ in _SPACING]
_SERIES_SIGN = re.compile(r"\.\s+\d+[a-z]")
_SERIES_GAP = re.compile(r"(?<=[A-Za-z]\.)\s+(?=\d+[a-z]+\b(?!\s+Cir\.))")
#: What each of these edits needs in the text before it changes anything.
_SPACED = re.compile(r"\.\s+(?:[SCFREW]\.|Ct\.|Ed\.|Supp\.|\d+[a-z])")
_ILLINOIS = re.compile(r"\bIll\.\s+App\.\Z")


def reporter_spacing(doc: Traced) -> None:
    """Blanks inside reporters go, and those before a series ("So. 2d"), but not before a circuit; Illinois Appellate keeps its blank."""
    if _SPACED.search(doc.text) is None:
        return
    for (pattern, new), sign in zip(_SPACING, _SPACING_SIGNS, strict=True):
        if sign.search(doc.text) is not None:
            doc.edit(pattern, lambda m, new=new: m.expand(new))
    if _SERIES_SIGN.search(doc.text) is None:
        return
    doc.edit(_SERIES_GAP, lambda m: " " if _ILLINOIS.search(m.string[max(0, m.start() - 12) : m.start()]) else "")


#: The default chain; its order is part of the semantics.
CLEANERS = (strip_html, decode_entities, rejoin_hyphens, strip_page_breaks, replace_spaces, collapse_spaces, normalize_unicode, normalize_dashes, fix_quotes, normalize_typography, reporter_spacing)


def remove_ocr_artifacts(doc: Traced) -> None:
    doc.edit(re.compile("_+"), lambda m: "")


def strip_diacritics(doc: Traced) -> None:
    doc.edit(re.compile(r"[^\x00-\x7f]+"), lambda m: "".join(c for c in unicodedata.normalize("NFD", m[0]) if not unicodedata.combining(c)))


def strip_emphasis(doc: Traced) -> None:
    """Markdown stars around words; star pages (*12) and escaped stars stay."""
    for stars in (3, 2, 1):
        doc.edit(re.compile(rf"(?<![\\*])\*{{{stars}}}(?![\s*\d])([^*\n]+?)(?<![\s\\*])\*{{{stars}}}(?!\*)"), lambda m: m[1])


def clean_text(text: str | None, cleaners=CLEANERS, more=()) -> Traced:
    """The cleaned text; null is empty."""
    doc = Traced(text or "")
    for cleaner in (*cleaners, *more):
        cleaner(doc)
    return doc


def clean_column(text: Column) -> Column:
    """The character-level part of the chain (entities, white space, dashes, quotes) in native expressions."""
    out = F.coalesce(text, F.lit(""))
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    out = F.translate(out, SPACES, " " * len(SPACES))
    out = F.regexp_replace(out, "  +", " ")
    return F.translate(out, "‐‑‒–“”„‘’‚′", "----\"\"\"''''")


def strip_html_column(text: Column) -> Column:
    """Tags without regard to their neighbours: script and style bodies go, other tags become a space."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^<>]*>", " "), r"\s+", " "))
