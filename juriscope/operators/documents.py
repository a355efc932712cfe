"""From one document's text to its citations: scan, dedup, parse, generate, filter, structure."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import groupby

from . import parsers as ps
from .cleaning import CLEANERS, Traced, clean_text
from .patterns import Pattern, outline, patterns


@dataclass(frozen=True)
class Options:
    """What a run of the engine may vary; the year is a parameter so that results do not age."""

    as_of_year: int = 2026
    resolve: bool = True
    remove_false_positives: bool = False
    detect_footnotes: bool = False
    exclude_parenthetical_children: bool = False
    scope: str = "none"  # none, paragraph, section (as paragraph), footnote
    party_threshold: float = 0.8
    id_confidence_floor: float | None = None
    paragraph_pattern: str = r"\n\s*\n"
    patterns: tuple[Pattern, ...] | None = None
    cleaners: tuple = CLEANERS
    more_cleaners: tuple = ()

    def with_(self, **changes) -> Options:
        return replace(self, **changes)


@lru_cache(maxsize=16)
def _literals(table: tuple[Pattern, ...]) -> tuple[str, ...]:
    return tuple({n: None for p in table for n in p.needles})


@lru_cache(maxsize=4096)
def _possible(table: tuple[Pattern, ...], present: tuple[str, ...]) -> list[tuple[int, Pattern]]:
    """The patterns that a text with these literals may match, with their priorities; a repeated id has its first one's."""
    first: dict[str, int] = {}
    here = set(present)
    ranked = [(first.setdefault(p.id, k), p) for k, p in enumerate(table)]
    return [(k, p) for k, p in ranked if not p.needles or not here.isdisjoint(p.needles)]


@lru_cache(maxsize=4096)
def _outlined(table: tuple[Pattern, ...], present: tuple[str, ...]) -> tuple[str, ...]:
    """What the outline is searched for: the signs of the patterns that a text with these literals may match."""
    return tuple({s: None for _, p in _possible(table, present) for s in p.signs})


@lru_cache(maxsize=4096)
def _likely(table: tuple[Pattern, ...], present: tuple[str, ...], seen: tuple[str, ...]) -> list[tuple]:
    """Priority, pattern, search and accept of the patterns that a text with these literals and signs may match."""
    here = set(seen)
    return [(k, p, p.regex.search, p.accept) for k, p in _possible(table, present) if not p.signs or not here.isdisjoint(p.signs)]


def _matches(text: str, table: tuple[Pattern, ...] | None) -> list[dict]:
    """Every match of every pattern, by start, then by priority; "match" is the match itself."""
    out = []
    table = patterns() if table is None else table
    low = text.lower()
    present = tuple([n for n in _literals(table) if n in low])
    shape = outline(low)
    for priority, p, search, accept in _likely(table, present, tuple([s for s in _outlined(table, present) if s in shape])):
        m = search(text)
        while m is not None:
            a, b = m.span()
            if a == b or accept is not None and not accept(m):
                m = search(text, a + 1)
                continue
            out.append({"start": a, "end": b, "text": m[0], "type": p.type, "pattern_id": p.id, "priority": priority, "match": m})
            m = search(text, b)
    out.sort(key=lambda t: (t["start"], t["priority"]))
    return out


def with_groups(tokens: list[dict]) -> list[dict]:
    for t in tokens:
        t["groups"] = t.pop("match").groupdict()
    return tokens


def scan(text: str, table: tuple[Pattern, ...] | None = None) -> list[dict]:
    """Every match of every pattern, by start, then by priority."""
    return with_groups(_matches(text, table))


class Cover:
    """A union of spans, kept as disjoint sorted ones."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, b - 1)
        return k > 0 and self.ends[k - 1] > a

    def joined(self, spans) -> Cover:
        return Cover([*zip(self.starts, self.ends, strict=True), *spans])


def dedup(tokens: list[dict]) -> list[dict]:
    """Tokens inside a kept one of no worse priority go; then better priority wins where two overlap."""
    kept: list[dict] = []
    open_: list[dict] = []  # kept tokens that reach beyond the present start
    reach, apart = -1, True
    for t in sorted(tokens, key=lambda t: (t["start"], -t["end"], t["priority"])):
        if t["start"] >= reach:  # where most tokens stand: after all kept ones
            kept.append(t)
            open_, reach = [t], t["end"]
            continue
        open_ = [o for o in open_ if o["end"] > t["start"]]
        if not any(o["end"] >= t["end"] and (o["priority"] < t["priority"] or o["priority"] == t["priority"] and o["end"] - o["start"] > t["end"] - t["start"]) for o in open_):
            kept.append(t)
            open_.append(t)
            reach, apart = max(reach, t["end"]), False
    if apart:
        return kept
    accepted: list[dict] = []
    better = Cover()
    for _, same in groupby(sorted(kept, key=lambda t: (t["priority"], t["start"])), key=lambda t: t["priority"]):
        fresh = [t for t in same if not better.meets(t["start"], t["end"])]
        accepted += fresh
        better = better.joined((t["start"], t["end"]) for t in fresh) if fresh else better
    accepted.sort(key=lambda t: (t["start"], t["priority"]))
    return accepted


_COMMA_GAP = re.compile(r"\s*[,;]\s*(?:(?:\*?\d+(?:\s*-\s*\*?\d+)?(?:\s+nn?\.?\s*\d+)?)\s*,\s*)*\Z")


def parallel_runs(tokens: list[dict], text: str) -> dict[int, int]:
    """Index of each secondary token of a parallel run, with the index of the run's first token."""
    out: dict[int, int] = {}
    case = ("federal-reporter", "supreme-court", "state-reporter")
    for i, t in enumerate(tokens):
        if t["pattern_id"] not in case or i in out:
            continue
        last = t
        for j in range(i + 1, len(tokens)):
            n = tokens[j]
            gap = text[last["end"] : n["start"]]
            if n["pattern_id"] not in case or len(gap) > 80:
                break
            bracket = "[" in gap and text[n["end"] : n["end"] + 1] == "]"
            if not bracket and not _COMMA_GAP.match(gap) or ")" in text[t["end"] : n["start"]]:
                break
            opened = text.find("(", n["end"], n["end"] + 200)
            closes = opened >= 0 and ps.matched_paren(text, opened) > 0
            if not bracket and not closes and not re.match(r"\s*[.;]", text[n["end"] :]):
                break
            out[j] = i
            last = n
            if bracket:
                break
    return out


# Words that make a reporter implausible, and reporters that are codes or not American.
_PROSE = frozenset("The In On At By For And Or But Of To From With This That These Those Under Section Rule Article Chapter Page Vol Volume No Number Day Days Year Years Month Months Street Avenue Road Plaintiff Defendant Court January February March April May June July August September October November December".split())
_MONTHS = frozenset("January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec".split())
# Words of sentences that no reporter has; a small volume before them is a paragraph's number.
_SENTENCE_WORDS = frozenset("the a an in on at but and for by to with from as if so nor yet not no then when where who what how that this these those he she it they we his her its their our was were is are has had been being did does do may shall will would could should held said found made took gave see also january february march april june july august september october november december".split())
_BLOCKED = frozenset("I.C.J. I.L.M. U.N.T.S. E.C.R. E.H.R.R. Q.B. A.C. Ch. W.L.R. All E.R. S.C.R. D.L.R. C.L.R. U.S.C. C.F.R. I.R.C. R.C. M.C.L. O.C.G.A. N.J.S.A. Stat.".split())


@lru_cache(maxsize=1 << 14)
def _month_words(reporter: str) -> tuple[bool, bool]:
    """Whether a reporter is the name of a month, and whether one of its several words is."""
    words = [w.strip(".,") for w in reporter.split()]
    return len(words) == 1 and words[0] in _MONTHS, len(words) > 1 and any(w in _MONTHS and len(w) > 3 for w in words)


def hard_false(c: dict, as_of_year: int) -> bool:
    """Never a citation: a date read as one, an impossible volume or page."""
    reporter = c.get("reporter") or c.get("journal")
    if reporter:
        month, dated = _month_words(reporter)
        volume, page = c.get("volume_num"), c.get("page")
        if month and volume is not None and 1 <= volume <= 31 and page is not None and 1700 <= page <= as_of_year + 5:
            return True
        if dated:
            return True
    if c["type"] in ("case", "journal", "shortFormCase"):
        if c.get("volume_num") is not None and (c["volume_num"] == 0 or c["volume_num"] > 999_999) or c.get("page") == 0:
            return True
    return False


def soft_false(c: dict, source: str) -> str | None:
    """Why a citation is doubtful; None if it is not."""
    if c["type"] in ("case", "journal", "shortFormCase"):
        reporter = c.get("reporter") or c.get("journal") or ""
        if reporter in _BLOCKED:
            return "blocked reporter"
        words = reporter.split()
        if not _PROSE.isdisjoint(words) or (len(reporter) > 12 and "." not in reporter):
            return "implausible reporter"
        v = c.get("volume_num")
        if v is not None and v > 2000 and not 1900 <= v <= 2099:
            return "implausible volume"
        if "-" in (c.get("volume") or "") and re.fullmatch(r"\d{2}-\d{3,}", c["volume"]):
            return "docket number as volume"
        if v is not None and 1 <= v <= 20 and "." not in reporter and any(w in _SENTENCE_WORDS for w in reporter.lower().split()):
            return "paragraph number as volume"
        if v is not None and 1900 <= v <= 2099 and reporter.startswith("Fed. R."):
            return "rule as reporter"
    if c["type"] in ("case", "journal", "federalRegister", "statutesAtLarge") and c.get("year") is not None and c["year"] < 1750:
        return "implausible year"
    a, b = c["source_start"], c["source_end"]
    if c["type"] in ("case", "shortFormCase") and "\n" in source[a:b].strip():
        return None if "\n\n" not in source[a:b] else "crosses lines"
    return None


_MORE_SECTIONS = re.compile(r"\s*(?:,\s*(?:and\s+|or\s+|&\s*)?|\s+and\s+|\s*&\s*)(\d+[A-Za-z0-9\-]*(?:\.\d+[A-Za-z0-9\-]*)*(?:\([^)]*\))*)(?!\s*(?:U\.?S\.?C|C\.?F\.?R|[A-Z][a-z]*\.))(?=[\s,.;)]|\Z)")
_CHAINED = re.compile(r"\s*;\s*(?:and\s+)?(art(?:icle)?\.?|amend(?:ment)?\.?)\s+([IVX]+|\d+)(?:,?\s*§\s*([\w-]+))?(?:,?\s*cl\.?\s*(\d+))?")
_BARE_PARTY = re.compile(r",\s+at\s+(\*?\d+(?:-\d+)?)\b")
_WORD_START = re.compile(r"(?<![^\W_])[^\W_]")
# Parties that too many cases share for a bare name to mean one.
_COMMON_PARTIES = frozenset(("state", "people", "united states", "commonwealth", "doe", "roe", "board", "city", "county"))
_BARE_SECTION = re.compile(r"(?<![\w§])§\s*(\d+[A-Za-z0-9.:]*(?:-\d+[A-Za-z0-9]*)?(?:\([^)]*\))*)")


def generate(cites: list[dict], text: str) -> list[dict]:
    """Rows that the text implies: chained constitutional provisions, listed sections, bare sections, bare parties."""
    more: list[dict] = []
    spans = sorted((c["start"], c["end"]) for c in cites)
    starts = [a for a, _ in spans]
    taken = Cover(spans)

    def free(a: int, b: int) -> bool:
        return not taken.meets(a, b)

    def add(base: dict, a: int, b: int, **fields) -> dict:
        row = {k: v for k, v in base.items() if k not in ("subsection", "subsection_end", "section_end", "has_et_seq", "clause", "article", "amendment", "pincite", "pincite_info")}
        row |= {"start": a, "end": b, "matched_text": text[a:b], "generated": True} | fields
        more.append(row)
        return row

    for c in cites:
        at = c["end"]
        if c["type"] == "constitutional" and c.get("jurisdiction"):
            while (m := _CHAINED.match(text, at)) is not None:
                place = {"amendment" if m[1].lower().startswith("am") else "article": ps.numeral(m[2])}
                a = m.start(1)
                if free(a, m.end()):
                    add(c, a, m.end(), section=m[3], **place, **({"clause": int(m[4])} if m[4] else {}))
                at = m.end()
            if c["pattern_id"] == "state-const-prose-plural-section":
                for m in list(re.finditer(r"\d+", c["matched_text"].split(" of ")[0]))[1:]:
                    add(c, c["start"] + m.start(), c["start"] + m.end(), section=m[0], article=c.get("article"))
        if c["type"] == "statute" and "§§" in c["matched_text"]:
            while (m := _MORE_SECTIONS.match(text, at)) is not None:
                add(c, m.start(1), m.end(1), **ps.parse_body(m[1]))
                at = m.end()
        if c["type"] in ("statute", "regulation") and c.get("code") and not c.get("generated"):
            k = bisect_right(starts, c["start"])
            stop = min(len(text), c["end"] + 300, spans[k][0] if k < len(spans) else len(text))
            for m in _BARE_SECTION.finditer(text, at, stop) if text.find("§", at, stop) >= 0 else ():
                if free(m.start(), m.end()) and not re.match(r"\d+-\d+-\d+", m[1]):
                    add(c, m.start(), m.end(), confidence=max(0.6, round(c["confidence"] - 0.1, 2)), **ps.parse_body(m[1].rstrip(".")))
    for m in _BARE_LIST.finditer(text) if "§§" in text else ():
        if free(m.start(), m.end()):
            head = {"type": "statute", "pattern_id": "bare-section-list", "code": "§", "confidence": 0.3}
            add(head, m.start(), m.end(), **ps.parse_body(m[1]))
            at = m.end()
            while (n := _MORE_SECTIONS.match(text, at)) is not None:
                add(head, n.start(1), n.end(1), **ps.parse_body(n[1]))
                at = n.end()
    anchors: dict[str, list[dict]] = {}
    for c in cites:
        if c["type"] == "case" and c.get("case_name"):
            for name in (c.get("plaintiff"), c.get("defendant")):
                if name and len(name) >= 3 and name.lower() not in _COMMON_PARTIES:
                    anchors.setdefault(name, []).append(c)
    if anchors:
        longest = max(map(len, anchors))
        for m in _BARE_PARTY.finditer(text):
            lo = max(0, m.start() - longest)
            # the names that may end here begin where a word begins; the longest known one is meant
            begins = [w.start() for w in _WORD_START.finditer(text, lo, m.start()) if w.start() > lo or lo == 0 or not text[lo - 1].isalnum()]
            a = next((k for k in begins if text[k : m.start()] in anchors), None)
            if a is None:
                continue
            name = text[a : m.start()]
            known = anchors[name]
            k = bisect_right(known, a, key=lambda c: c["end"])
            if k and free(a, m.end()):
                c, info = known[k - 1], ps.s.parse_pincite(m[1])
                more.append({"type": "shortFormCase", "pattern_id": "bare-party", "start": a, "end": m.end(), "matched_text": text[a : m.end()], "volume": c["volume"], "volume_num": c["volume_num"], "reporter": c["reporter"], "page": c["page"], "party_name": name, "party_norm": ps.s.normalize_party(name), "pincite": info["page"], "pincite_info": info, "confidence": 0.85, "generated": True})
    out = cites + more
    out.sort(key=lambda c: c["start"])
    return out


_NM_SIGNAL = re.compile(r"\bNMSA\b|\bN\.\s?M\.|\bNew\s+Mexico\b")
_UPSTREAM = re.compile(r"(?P<DC>\bD\.\s?C\.|\bDistrict\s+of\s+Columbia\b)|(?P<VA>\bVa\.|\bVirginia\b)|(?P<GA>\bGa\.|\bGeorgia\b)")
_BARE_LIST = re.compile(r"(?<![\w.])§§\s*(\d+[A-Za-z0-9\-]*(?:\.\d+)*(?:\([^)]*\))*)(?=\s*(?:,|and\b|&|or\b))")


def place(cites: list[dict], text: str) -> None:
    """Jurisdictions that the surroundings of bare sections and bare codes decide."""
    context = None
    for c in sorted(cites, key=lambda c: c["start"]):
        if c.get("pattern_id") == "nm-bare-section" and not c.get("generated"):
            sentence = re.split(r"(?<=[a-z)])\.\s", text[c["end"] : c["end"] + 200], maxsplit=1)[0]
            if re.search(r",\s*MCA\b", sentence):
                c["jurisdiction"], c["code"] = "MT", "MCA"
            elif context in ("WV", "CO", "MT"):
                c["jurisdiction"], c["code"] = context, {"WV": "W. Va. Code", "CO": "C.R.S.", "MT": "MCA"}[context]
            elif not _NM_SIGNAL.search(text[max(0, c["start"] - 200) : c["start"]]) and context != "NM":
                c["jurisdiction"], c["code"] = None, None
        elif c.get("pattern_id") in ("va-bare-code", "ga-pre-1983") and c["matched_text"].startswith("Code"):
            signals = list(_UPSTREAM.finditer(text, max(0, c["start"] - 400), c["start"]))
            if signals and signals[-1]["DC"]:
                c["jurisdiction"], c["code"] = "DC", "D.C. Code"
        if c["type"] == "statute" and c.get("jurisdiction") in ("WV", "CO", "MT", "NM") and not c.get("generated"):
            context = c["jurisdiction"]


_SIGNALS = (("see, e.g.,", r"[Ss]ee,\s+e\.g\.,"), ("see also", r"[Ss]ee\s+also"), ("see generally", r"[Ss]ee\s+generally"), ("but see", r"[Bb]ut\s+see"), ("but cf.", r"[Bb]ut\s+cf\."), ("compare", r"[Cc]ompare"), ("contra", r"[Cc]ontra"), ("accord", r"[Aa]ccord"), ("cf.", r"[Cc]f\."), ("e.g.,", r"[Ee]\.g\.,"), ("see", r"[Ss]ee"))
_SIGNAL_END = re.compile("(?:" + "|".join(f"(?P<s{k}>{r})" for k, (_, r) in enumerate(_SIGNALS)) + r"),?\s*\Z")
_LINK = re.compile(r"\s*;\s*(.*)\Z", re.S)


#: The ends that a signal may have, without the comma after it.
_SIGNAL_ENDS = ("see", "See", "also", "generally", "cf.", "Cf.", "ompare", "ontra", "ccord", ".g.")


def signal_before(text: str, at: int, floor: int) -> str | None:
    if not text[max(floor, at - 80) : at].rstrip().removesuffix(",").removesuffix(",").endswith(_SIGNAL_ENDS):
        return None
    m = _SIGNAL_END.search(text[max(floor, at - 80) : at])
    return next(_SIGNALS[int(k[1:])][0] for k, v in m.groupdict().items() if v) if m else None


def structure(cites: list[dict], text: str) -> None:
    """Signals, string citations, history links, parallel captions and nesting."""
    floor = 0
    for c in cites:
        begin = c["full_span"][0]
        c["signal"] = signal_before(text, begin, min(floor, begin)) or c.get("signal")
        floor = max(floor, c["end"])
    for a, b in zip(cites, cites[1:], strict=False):
        if a.get("signal") == "compare" and re.fullmatch(r"[\s,;.)]*with\s+", text[a["full_span"][1] : b["full_span"][0]]):
            b["signal"] = "compare"
    # history: the i-th entry of a case and the next case at or after its end
    for i, c in enumerate(cites):
        for h in c.get("history") or []:
            if h.get("inner"):
                continue  # says what became of the case, without a citation
            for j in range(i + 1, len(cites)):
                o = cites[j]
                if o["type"] == "case" and o["start"] >= h["end"] - 1 and not o.get("parallel_secondary"):
                    if o["start"] - h["end"] <= 160 and o.get("history_of") is None:
                        o["history_of"], o["history_signal"] = i, h["signal"]
                        if not o.get("case_name") and c.get("case_name"):
                            for key in ("case_name", "plaintiff", "defendant", "plaintiff_norm", "defendant_norm"):
                                o[key] = c.get(key)
                    break
    # string citations: anchors separated by a semicolon and at most a signal
    anchors = [i for i, c in enumerate(cites) if not c.get("parallel_secondary")]
    last_end = {}
    for i, c in enumerate(cites):
        owner = c["parallel_primary"] if c.get("parallel_secondary") else i
        last_end[owner] = max(last_end.get(owner, 0), c["full_span"][1], c["end"])
    group: list[int] = []
    n = 0

    def close() -> None:
        nonlocal group, n
        if len(group) > 1:
            for k, i in enumerate(group):
                cites[i] |= {"string_group_id": f"sc-{n}", "string_group_index": k, "string_group_size": len(group)}
            n += 1
        group = []

    for a, b in zip(anchors, [*anchors[1:], None], strict=False):
        if not group:
            group = [a]
        linked = False
        if b is not None and cites[b].get("history_of") is None:
            m = _LINK.match(text[last_end[a] : cites[b]["full_span"][0]]) if cites[b]["full_span"][0] >= last_end[a] else None
            linked = bool(m) and (m[1] == "" or _SIGNAL_END.fullmatch(m[1]) is not None)
        if linked:
            group.append(b)
        else:
            close()
    # nesting: the narrowest parenthesis of another citation that holds this one; both sides in text order
    holes = sorted((p["start"], p["end"], i, k) for i, c in enumerate(cites) for k, p in enumerate(c.get("parentheticals") or []))
    around: list[tuple[int, int, int, int]] = []
    at = 0
    for j in sorted(range(len(cites)), key=lambda j: cites[j]["start"]):
        c = cites[j]
        while at < len(holes) and holes[at][0] < c["start"]:
            around.append(holes[at])
            at += 1
        around = [h for h in around if h[1] > c["start"]]
        holding = [h for h in around if h[2] != j and c["end"] <= h[1]]
        if holding:
            _, _, i, k = min(holding, key=lambda h: (h[1] - h[0], h[2], h[3]))
            c["nested_in"] = i
            cites[i]["parentheticals"][k].setdefault("children", []).append(j)


def extract(source: str | None, options: Options = Options()) -> tuple[Traced, list[dict]]:
    """The cleaned text and the citations of one document, in order. Null and empty texts have none."""
    doc = clean_text(source, options.cleaners, options.more_cleaners)
    text = doc.text
    tokens = with_groups(dedup(_matches(text, options.patterns)))
    secondary = parallel_runs(tokens, text)
    cites: list[dict] = []
    at_token: dict[int, int] = {}
    floor = 0
    for i, t in enumerate(tokens):
        if t["pattern_id"] in ("id", "ibid", "supra", "shortFormCase"):
            c = ps.parse_short(t, text)
        elif t["type"] == "case":
            c = ps.parse_case(t, text, options.as_of_year, floor, i in secondary)
        elif t["type"] == "statute":
            c = ps.parse_statute(t, text)
        elif t["type"] == "constitutional":
            c = ps.parse_constitutional(t, text)
        else:
            c = ps.parse_other(t, text, options.as_of_year, floor)
        if c is None:
            continue
        c |= {"start": t["start"], "end": t["end"], "matched_text": t["text"], "pattern_id": t["pattern_id"]}
        c.setdefault("full_span", (t["start"], t["end"]))
        if i in secondary:
            c["run_of"] = secondary[i]
        at_token[i] = len(cites)
        c["token"] = i
        cites.append(c)
        floor = max(floor, t["end"])
    firsts = {}
    for c in cites:
        run = c.pop("run_of", None)
        if run is not None and run in at_token:
            head = cites[at_token[run]]
            firsts.setdefault(run, head)
            c["group_head"] = c_head = head
            for key in ("year", "court", "date", "normalized_court", "case_name", "plaintiff", "defendant", "plaintiff_norm", "defendant_norm"):
                if c.get(key) is None and c_head.get(key) is not None:
                    c[key] = c_head[key]
            c["confidence"] = ps.case_confidence(c, options.as_of_year)
    for head in firsts.values():
        head["group_id"] = f"{head['volume']}-{re.sub(r'\s+', '.', head['reporter'])}-{head['page'] if head['page'] is not None else '___'}"
    for c in cites:
        if "group_head" in c:
            c["group_id"], c["parallel_secondary"] = c["group_head"]["group_id"], True
    cites = generate(cites, text)
    place(cites, text)
    kept = []
    for c in cites:
        c.setdefault("full_span", (c["start"], c["end"]))
        c["source_start"], c["source_end"] = doc.source_span(c["start"], c["end"])
        if hard_false(c, options.as_of_year):
            continue
        reason = soft_false(c, source or "")
        if reason and options.remove_false_positives:
            continue
        c["warnings"] = [reason] if reason else []
        if reason:
            c["confidence"] = 0.1
        kept.append(c)
    index = {id(c): i for i, c in enumerate(kept)}
    for i, c in enumerate(kept):
        c["cite_idx"], c["id"] = i, f"c{i}"
        head = c.pop("group_head", None)
        if head is not None:
            c["parallel_primary"] = index.get(id(head), i)
    structure(kept, text)
    if options.exclude_parenthetical_children:
        kept = [c for c in kept if c.get("nested_in") is None]
    if options.detect_footnotes:
        from .zones import footnotes, zone_numbers

        marks = zone_numbers(footnotes(source or ""), [c["source_start"] for c in kept])
        for c, number in zip(kept, marks, strict=True):
            c["footnote_number"] = number
    seen: set[str] = set()
    for c in kept:
        if c["type"] == "case":
            c["first_of_reporter"] = c["reporter"] not in seen
            seen.add(c["reporter"])
    if options.resolve:
        from .resolver import resolve

        resolve(kept, text, source or "", options)
    return doc, kept
