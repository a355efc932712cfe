"""Scalar parsers and formatters: pincites, dates, courts, party names, keys, hashes."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_MONTH = r"(?:Jan(?:uary|\.)?|Feb(?:ruary|\.)?|Mar(?:ch|\.)?|Apr(?:il|\.)?|May|Jun(?:e|\.)?|Jul(?:y|\.)?|Aug(?:ust|\.)?|Sept?(?:ember|\.)?|Oct(?:ober|\.)?|Nov(?:ember|\.)?|Dec(?:ember|\.)?)"
_DATES = (
    (re.compile(rf"\b({_MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"), ("m", "d", "y")),
    (re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b"), ("y", "m", "d")),
    (re.compile(r"\b(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\b"), ("m", "d", "y")),
    (re.compile(rf"\b(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}})\b"), ("d", "m", "y")),
    (re.compile(rf"\b({_MONTH})\s+(\d{{4}})\b"), ("m", "y")),
    (re.compile(r"\b(\d{4})\b"), ("y",)),
)
DATE = re.compile("|".join(p.pattern for p, _ in _DATES))


def plausible_year(year: int, as_of_year: int) -> bool:
    return 1700 <= year <= as_of_year + 1


def parse_date(text: str | None, as_of_year: int = 2026) -> dict | None:
    """iso, year, month, day of the first plausible date in any of six forms; partial dates keep what they have."""
    found = _first_date(text, as_of_year) if text is None or len(text) <= _SHORT else _first_date.__wrapped__(text, as_of_year)
    return dict(found) if found else None


#: Longer texts are not kept by the functions that remember what they have seen.
_SHORT = 256


@lru_cache(maxsize=1 << 13)
def _first_date(text: str | None, as_of_year: int) -> dict | None:
    for pattern, parts in _DATES:
        for m in pattern.finditer(text or ""):
            got = dict(zip(parts, m.groups()[: len(parts)], strict=True))
            year = int(got["y"])
            if len(got["y"]) == 2:
                year += 1900 if year >= 50 else 2000
            month = got.get("m")
            month = None if month is None else int(month) if month.isdigit() else MONTHS[month[:3].lower()]
            day = int(got["d"]) if "d" in got else None
            if not plausible_year(year, as_of_year) or month is not None and not 1 <= month <= 12:
                continue
            if day is not None and not 1 <= day <= (29 if month == 2 else 30 if month in (4, 6, 9, 11) else 31):
                day = None
            iso = f"{year:04d}" + (f"-{month:02d}" if month else "") + (f"-{day:02d}" if month and day else "")
            return {"iso": iso, "year": year, "month": month, "day": day if month else None}
    return None


_PINCITE = re.compile(r"(?P<star>\*)?(?P<page>\d+)(?:\s*[-–—]\s*\*?(?P<end>\d+))?(?:\s+(?P<note>nn?|note)\s*\.?\s*(?P<foot>\d+)(?:[-–—](?P<footend>\d+))?)?\Z")
_PARAGRAPH = re.compile(r"(?:¶¶?|paras?\.?)\s*(\d+)(?:[-–—](\d+))?\Z")


def expand_end(start: int, end: str) -> int:
    """123-25 means 125: a shorter end replaces the last digits of the start."""
    return int(str(start)[: -len(end)] + end) if len(end) < len(str(start)) else int(end)


def parse_pincite(text: str | None) -> dict | None:
    """page, end_page, footnote, star, paragraph of a pincite; None if it is none."""
    raw = (text or "").strip()
    if raw.isdecimal() and raw.isascii():  # as most are printed
        return {"page": int(raw), "end_page": None, "footnote": None, "star": False, "paragraph": None, "raw": raw}
    raw = re.sub(r"^(?:at\s+)?(?:pp?\.\s*)?", "", raw)
    if m := _PARAGRAPH.match(raw):
        return {"page": None, "end_page": None, "footnote": None, "star": False, "paragraph": int(m[1]), "raw": raw}
    if m := _PINCITE.match(raw):
        page = int(m["page"])
        return {"page": page, "end_page": expand_end(page, m["end"]) if m["end"] else None, "footnote": int(m["foot"]) if m["foot"] else None, "star": bool(m["star"]), "paragraph": None, "raw": raw}
    return None


@lru_cache(maxsize=1 << 13)
def normalize_court(court: str | None) -> str | None:
    """No space between a dot and the letter after it; abbreviations and numbered courts end with a period; blank is None."""
    found = re.sub(r"\.\s+(?=[A-Za-z])", ".", (court or "").strip())
    open_ended = found[-1:].isascii() and found[-1:].isalpha() and ("." in found or re.match(r"\d+\w*\s+[A-Za-z]", found))
    return found + "." if open_ended else found or None


_SUFFIX = re.compile(r",?\s+(?:inc|corp|co|ltd|llc|llp|lp|l\.l\.c|p\.c|n\.a|company|corporation|incorporated|limited)\.?\Z")


@lru_cache(maxsize=1 << 14)
def normalize_party(name: str | None) -> str | None:
    """Lower case without et al., aliases, corporate suffixes and a leading article."""
    if not name:
        return None
    out = re.sub(r"\s+", " ", name.strip().lower())
    out = re.sub(r",?\s+et\s+al\.?\Z", "", re.sub(r",?\s+(?:d/b/a|a/k/a|f/k/a)\b.*", "", out))
    while (shorter := _SUFFIX.sub("", out)) != out and shorter:
        out = shorter
    return re.sub(r"\A(?:the|a|an)\s+", "", out).strip(" ,") or None


def content_hash(exact: str, prefix: str = "", suffix: str = "") -> str:
    """FNV-1a (64 bits) over the UTF-16 units of the NFC text, as 16 hex digits."""
    value = 0xCBF29CE484222325
    raw = unicodedata.normalize("NFC", f"{exact}\0{prefix}\0{suffix}").encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        value = ((value ^ (raw[i] | raw[i + 1] << 8)) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{value:016x}"


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def roman(text: str) -> int | None:
    """The value of a Roman numeral."""
    values = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
    numbers = [values.get(c) for c in text.upper()]
    if not numbers or None in numbers:
        return None
    return sum(-n if i + 1 < len(numbers) and n < numbers[i + 1] else n for i, n in enumerate(numbers))


def to_roman(n: int) -> str:
    out = ""
    for value, mark in ((50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += mark * (n // value)
        n %= value
    return out


def reporter_key(c: dict) -> str | None:
    """volume reporter page; without the page where it is blank."""
    if not c.get("volume") or not c.get("reporter"):
        return None
    parts = [c["volume"], c["reporter"]] + ([str(c["page"])] if c.get("page") is not None else [])
    return " ".join(parts)


def bluebook(c: dict) -> str:
    """A citation in a canonical written form."""
    kind, g = c["type"], c.get
    pin = f", {g('pincite')}" if g("pincite") is not None else ""
    year = f" ({g('year')})" if g("year") else ""
    sub = g("subsection") or ""
    if kind == "case":
        paren = " ".join(str(x) for x in (None if g("court") == "scotus" else g("court"), g("year")) if x)
        return (f"{g('case_name')}, " if g("case_name") else "") + f"{g('volume')} {g('reporter')} {'___' if g('page') is None else g('page')}{pin}" + (f" ({paren})" if paren else "")
    if kind in ("statute", "regulation"):
        return (f"{g('title')} " if g("title") is not None else "") + f"{g('code')} § {g('section')}{sub}" + (" et seq." if g("has_et_seq") else "")
    if kind == "neutral":
        return f"{g('year')} {g('court') or g('database')} {g('number')}{pin}"
    if kind == "journal":
        return f"{g('volume')} {g('journal')} {g('page')}{pin}{year}"
    if kind == "constitutional":
        where = {"US": "U.S."}.get(g("jurisdiction"), g("jurisdiction"))
        place = f"art. {to_roman(g('article'))}" if g("article") else f"amend. {to_roman(g('amendment'))}" if g("amendment") else "pmbl."
        return (f"{where} " if where else "") + f"Const. {place}" + (f", § {g('section')}" if g("section") else "") + (f", cl. {g('clause')}" if g("clause") else "")
    if kind == "publicLaw":
        return f"Pub. L. No. {g('congress')}-{g('number')}"
    if kind == "federalRegister":
        return f"{g('volume')} Fed. Reg. {g('page')}{year}"
    if kind == "statutesAtLarge":
        return f"{g('volume')} Stat. {g('page')}{pin}{year}"
    if kind == "id":
        return "Id." + (f" at {g('pincite')}" if g("pincite") is not None else "")
    if kind == "supra":
        return (f"{g('party_name')}, " if g("party_name") else "") + "supra" + (f", at {g('pincite')}" if g("pincite") is not None else "")
    if kind == "shortFormCase":
        return (f"{g('party_name')}, " if g("party_name") else "") + f"{g('volume')} {g('reporter')} at {g('pincite')}"
    if kind in ("federalRule", "stateRule"):
        return f"{g('rule_set')} {g('rule')}{sub}"
    if kind == "restatement":
        return f"Restatement ({g('edition')}) of {g('subject')} § {g('section')}{sub}"
    if kind == "treatise":
        return f"{g('volume')} {g('work')} § {g('section')}{year}"
    if kind == "annotation":
        return f"{g('volume')} {g('series')} {g('page')}{year}"
    if kind == "docket":
        return (f"{g('case_name')}, " if g("case_name") else "") + f"No. {g('number')} ({' '.join(str(x) for x in (g('court'), g('year')) if x)})"
    if kind == "treaty":
        return f"{g('series')} No. {g('number')}" if g("number") else f"{g('volume')} {g('series')} {g('page')}"
    if kind == "canon":
        return f"Canon {g('number')}{sub}"
    return re.sub(r"\s+", " ", c["matched_text"])


#: Words whose period does not end a sentence.
_SHORTENED = frozenset("v vs no inc corp co ltd st mr mrs ms dr jr sr cir id cf ct app supp ed rev stat art sec ch para pp p e.g i.e u.s f d s n w e cal mass tex ill pa va md".split())


def sentence_bounds(text: str, start: int, end: int) -> tuple[int, int]:
    """The sentence around a span; abbreviations do not end it."""
    lo, hi = 0, len(text)
    for m in re.finditer(r"[.!?][\"')\]]*\s+(?=[A-Z\"'(])", text):
        word = re.search(r"[\w.]*\Z", text[: m.start()])[0].lower()
        if text[m.start()] == "." and (word in _SHORTENED or re.fullmatch(r"[a-z]|.*\.[a-z]|\d+[a-z]+", word)):
            continue
        if m.end() <= start:
            lo = m.end()
        elif m.start() >= end - 1:
            hi = m.end()
            break
    return lo, hi


def surrounding(text: str, start: int, end: int, unit: str = "sentence", most: int | None = None) -> str:
    """The sentence or paragraph around a span, at most ``most`` characters of it, cut evenly around the span."""
    if unit == "paragraph":
        lo = text.rfind("\n\n", 0, start)
        hi = text.find("\n\n", end)
        lo, hi = (0 if lo < 0 else lo + 2), (len(text) if hi < 0 else hi)
    else:
        lo, hi = sentence_bounds(text, start, end)
    if most is not None and hi - lo > most:
        spare = max(0, most - (end - start)) // 2
        lo, hi = max(lo, start - spare), min(hi, end + spare)
    return text[lo:hi].strip()


def token_bounded(text: str, needle: str) -> list[int]:
    """Where needle stands in text as whole words."""
    return [m.start() for m in re.finditer(re.escape(needle), text) if needle and not re.match(r"\w", text[m.start() - 1 : m.start()] or " ") and not re.match(r"\w", text[m.end() : m.end() + 1] or " ")]


def durable_locator(text: str, start: int, end: int) -> dict | None:
    """A locator that survives edits elsewhere: quote, 32 characters of its sentence on either side, occurrence, hash; None for a bad span."""
    if not 0 <= start < end <= len(text):
        return None
    lo, hi = sentence_bounds(text, start, end)
    exact, prefix, suffix = text[start:end], text[max(lo, start - 32) : start], text[end : min(hi, end + 32)]
    before = token_bounded(text[:start], exact)
    return {"v": 1, "exact": exact, "prefix": prefix, "suffix": suffix, "start": start, "end": end, "occurrence": len(before), "content_hash": content_hash(exact, prefix, suffix)}
