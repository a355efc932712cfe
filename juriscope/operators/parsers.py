"""From a token to a citation: one small parser for each type."""

from __future__ import annotations

import re
from functools import lru_cache

from ..functions import scalars as s
from . import lexicon as lx
from . import patterns as p

# Reporters that raise a case's confidence, and court inference by reporter.
KNOWN_REPORTERS = ("F.", "F.2d", "F.3d", "F.4th", "F.Supp.", "F.Supp.2d", "F.Supp.3d", "F.App'x", "U.S.", "S.Ct.", "L.Ed.", "L.Ed.2d", "P.", "P.2d", "P.3d", "A.", "A.2d", "A.3d", "N.E.", "N.E.2d", "N.E.3d", "N.W.", "N.W.2d", "S.E.", "S.E.2d", "S.W.", "S.W.2d", "S.W.3d", "So.", "So.2d", "So.3d", "Cal.", "Cal.2d", "Cal.3d", "Cal.4th", "Cal.5th", "Cal.App.", "Cal.App.2d", "Cal.App.3d", "Cal.App.4th", "Cal.App.5th", "Cal.Rptr.", "Cal.Rptr.2d", "Cal.Rptr.3d", "N.Y.", "N.Y.2d", "N.Y.3d", "N.Y.S.", "N.Y.S.2d", "N.Y.S.3d", "A.D.", "A.D.2d", "A.D.3d", "Ill.", "Ill.2d", "B.R.", "T.C.", "Fed.Cl.")
_KNOWN = frozenset(KNOWN_REPORTERS)
PREFIXES = ("In the Matter of the Application of", "In the Matter of the Estate of", "In the Matter of", "In the Interest of", "In re", "In Re", "Ex parte", "Ex Parte", "Matter of", "Petition of", "Application of", "Adoption of", "Guardianship of", "Conservatorship of", "Estate of", "Succession of", "Marriage of", "State ex rel.", "United States ex rel.", "People ex rel.", "Commonwealth ex rel.", "Ex rel.")
SIGNALS = ("see, e.g.,", "see also", "but see", "see generally", "but cf.", "compare", "contra", "accord", "see", "cf.", "e.g.,", "also", "with", "and")
_SIGNAL = re.compile(r"\A(?:(?:See,?\s+e\.g\.,|See\s+also,?|But\s+see,?|See\s+generally,?|But\s+cf\.,?|Compare|Contra,?|Accord,?|See,?|Cf\.,?|E\.g\.,|In|Under|Citing|citing|Quoting|quoting|also|And|and|But|with|See|see|cf\.)\s+)+(?=[A-Z])")
_CONNECTORS = frozenset("of the and & for in on at to ex rel. de la du van von der den et al. al d/b/a a/k/a f/k/a by y e ex parte re in".split())
#: Words whose period does not end a sentence inside a case name.
ABBREVIATIONS = frozenset("v vs no inc corp co ltd st mr mrs ms dr jr sr bros assn ass'n dep't dept gov't int'l nat'l fed u.s us ins mfg mut elec ry r.r rr bd comm'n comm educ univ hosp dist cnty twp sch sec'y att'y gen assocs assoc auth ctr cent chem constr corr dev dir distrib div enter entm't envtl equip exch fid fin found grp guar hous indem indus info inst inv lab liab loc mach maint mgmt mem'l merch metro mun prod prop prot pub rd ref reg'l rehab ret sav sec serv soc sys tech tel transp tr util cas com commc'ns consol coop def e.g i.e cf id ibid al rel s n e w a b c d f g h i j k l m o p q r t x y z".split())

# Words that open an explanatory parenthetical, and the kinds of separate opinions.
_EXPLAINS = frozenset("holding finding stating noting explaining quoting citing discussing describing recognizing applying rejecting adopting requiring".split())
_OPINIONS = (
    ("concurring in part and dissenting in part", "mixed", "in_part"), ("concurring in the judgment", "concurrence", "in_judgment"), ("concurring in part", "concurrence", "in_part"), ("dissenting in part", "dissent", "in_part"),
    ("dissenting from denial of", "dissent", "from_denial"), ("concurring", "concurrence", None), ("dissenting", "dissent", None), ("joining", "majority", None),
)
_JUSTICES = re.compile(r"(?P<names>[A-Z][a-z]+(?:(?:,\s+(?:and\s+)?|\s+and\s+)[A-Z][a-z]+)*),?\s*(?:C\.J|JJ?)\.,?\s*(?P<role>\S.*)", re.S)
_WHOLE_DISPOSITION = re.compile(r"\s*(?:(?P<plurality>plurality\s+opinion\b)|(?P<mem>mem\.\s*\Z)|(?P<table>unpublished\s+table\s+decision\b))", re.I)
_LAST_DISPOSITION = re.compile(r"\(?\b(en\s+banc|in\s+bank|per\s+curiam)\s*\)?\s*\Z", re.I)
_NO_COURT = re.compile(r"\b(?:en banc|in bank|per curiam|mem\.|plurality|unpublished|table)\b\.?|\(\s*\)", re.I)


def _phrase(printed: str) -> str:
    """A history phrase: any white space between words, apostrophes may be missing."""
    return re.escape(printed).replace(r"\ ", r"\s+").replace("'", "'?") + (r"(?=[\s,;(\[]|\Z)" if printed == "cert. den." else "" if printed.endswith(".") else r"\b")


_PHRASES = sorted(((p, n) for n, phrases in lx.HISTORY.items() for p in phrases), key=lambda x: -len(x[0]))
_SIGNAL_PHRASE = "|".join(f"(?P<h{k}>{_phrase(p)})" for k, (p, _) in enumerate(_PHRASES))
_QUALIFIED = r"(?:\s+(?:in\s+part|mem\.|per\s+curiam|sub\s+nom\.|and\s+remanded|as\s+moot|by\s+statute))*"
_HISTORY = re.compile(rf"\s*[,;]?\s*(?:{_SIGNAL_PHRASE}){_QUALIFIED}\.?,?\s*", re.I)
#: How each of them begins: most places where one is looked for do not.
_HISTORY_BEGINS = re.compile(rf"\s*[,;]?\s*[{re.escape(''.join(sorted({printed[0].lower() for printed, _ in _PHRASES})))}]", re.I)
_INNER_HISTORY = re.compile(rf"\s*,\s*(?:{_SIGNAL_PHRASE})", re.I)


def _signal_of(m: re.Match) -> tuple[str, str]:
    """The normalised history signal of a match, and its phrase as printed."""
    group = next(k for k, v in m.groupdict().items() if v)
    return _PHRASES[int(group[1:])][1], m[group]


def squeezed(text: str) -> str:
    return " ".join(text.split())


def canonical_reporter(text: str) -> str:
    return squeezed(text)


_BRACKET = re.compile(r"[()]")


def matched_paren(text: str, start: int, most: int = 2000) -> int:
    """The end of the balanced parenthesis that opens at start, or -1."""
    depth = 0
    if text[start : start + 1] not in ("(", ")"):
        return start + 1 if start < len(text) and most > 0 else -1
    stop = text.find(")", start, start + most)
    if stop < 0 or text[start] == "(" and text.find("(", start + 1, stop) < 0:
        return stop + 1 or -1
    for m in _BRACKET.finditer(text, start, min(len(text), start + most)):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            return m.end()
    return -1


def infer_court(reporter: str | None) -> dict | None:
    """Level, jurisdiction, state and confidence that a reporter implies; reporters of several states less surely."""
    known = _court_of(reporter)
    return dict(known) if known else None


@lru_cache(maxsize=1 << 14)
def _court_of(reporter: str | None) -> dict | None:
    found = lx.find_reporter(reporter) if reporter else None
    if found is None or not found[1] or re.sub(r"\s", "", found[0]) != re.sub(r"\s", "", reporter):
        return None
    _, level, jurisdiction, state = found
    return {"level": level, "jurisdiction": jurisdiction, "state": state, "confidence": 0.7 if jurisdiction == "state" and state is None else 1.0}


def _explains(content: str) -> str | None:
    """The word that opens an explanatory parenthetical."""
    word = re.match(r"[A-Za-z]+", content)
    return word[0].lower() if word and word[0].lower() in _EXPLAINS else None


def parse_paren(content: str, as_of_year: int) -> dict:
    """A metadata parenthesis (court, date, history after the year, disposition, justices and scope of an opinion), or an explanatory one."""
    return dict(_paren(content, as_of_year))


@lru_cache(maxsize=1 << 12)
def _paren(content: str, as_of_year: int) -> dict:
    out: dict = {"text": content}
    kind = _explains(content)
    if kind or content.count("(") > content.count(")"):
        return {"text": content, "type": kind or "other"}
    if m := _JUSTICES.fullmatch(content.strip()):
        role = re.sub(r"\s+", " ", m["role"].strip().rstrip(".,").lower())
        _, disposition, scope = next((o for o in _OPINIONS if role.startswith(o[0])), (None, None, None))
        out["justices"] = re.split(r",\s+and\s+|,\s+|\s+and\s+", m["names"])
        out |= {k: v for k, v in (("disposition", disposition), ("scope", scope)) if v}
        return out
    if m := _WHOLE_DISPOSITION.match(content):
        return out | {"disposition": {"plurality": "plurality opinion", "mem": "mem.", "table": "unpublished table decision"}[m.lastgroup]}
    date = s.parse_date(content, as_of_year)
    court = content
    if date:
        out |= {"date": date, "year": date["year"]}
        tail = content.rfind(str(date["year"])) + 4
        if (h := _INNER_HISTORY.match(content, tail)) is not None:
            out["inner_history"] = _signal_of(h)
            court = content[:tail]
    if m := _LAST_DISPOSITION.search(court):
        out["disposition"], court = squeezed(m[1].lower()), court[: m.start()]
    if date is None and "disposition" not in out:
        return {"text": content, "type": "other"}
    court = squeezed(_NO_COURT.sub("", s.DATE.sub("", court))).strip(" ,;")
    if date and court and re.search("[A-Za-z]", court):
        out["court"] = court
    return out


_VERSUS = re.compile(r"\s+(?:v|vs)\.?\s+")
_WORDS = re.compile(r"\S+")
_CAPTION_STARTS = re.compile(r"[A-Z0-9'\"]")
_LEADING_WORD = re.compile(r"(?:of|the|and|for|in|on|at|to|by|&|al\.)\s+(?!re\b)")
_WITHIN = re.compile(r"\A(?:In\s+re|In\s+the\s+(?:Matter|Interest))\b")


@lru_cache(maxsize=1 << 14)
def _is_boundary(word: str) -> bool:
    """A word that ends a sentence: a period after something that is no abbreviation."""
    if not re.search(r"[.?!]['\"]?\Z", word):
        return False
    stem = word.rstrip("'\"").rstrip(".?!").lower().strip("(,")
    return not (stem in ABBREVIATIONS or "." in stem or (len(stem) == 1 and stem.isalpha()) or word.rstrip("'\"").endswith(("?", "!")) is True and False)


def case_name(text: str, end: int, floor: int, reach: int = 150) -> tuple[str, int] | None:
    """The caption that ends before ``end``, and where it starts; not beyond floor or reach characters."""
    lo = max(floor, end - reach)
    window = text[lo:end]
    while (shorter := window.rstrip().rstrip(",;(")) != window:
        window = shorter
    if not window:
        return None
    # a semicolon or an open bracket ends the reach of a caption
    for mark in ("; ", "[", " ("):
        k = window.rfind(mark)
        if k >= 0 and ")" not in window[k:]:
            lo, window = lo + k + len(mark), window[k + len(mark) :]
    found = list(_VERSUS.finditer(window))
    if found:
        v = found[-1]
        defendant = window[v.end() :]
        if any(_is_boundary(w) for w in defendant.split()[:-1]) or not _CAPTION_STARTS.match(defendant):
            return None
        words = [(m.start(), m[0]) for m in _WORDS.finditer(window, 0, v.start())]
        start = None
        for at, word in reversed(words):
            bare = word.strip(",'\"")
            if start is not None and _is_boundary(word):
                break
            if bare[:1].isupper() or bare[:1].isdigit() or bare.lower() in _CONNECTORS:
                if start is not None and word.endswith((":", ";")):
                    break
                start = at
            else:
                break
        if start is None:
            return None
        name = window[start:]
        return _trim(name, lo + start)
    for prefix in PREFIXES:
        k = window.rfind(prefix)
        if k >= 0 and (k == 0 or not window[k - 1].isalnum()) and not any(_is_boundary(w) for w in window[k:].split()[len(prefix.split()) : -1]):
            return _trim(window[k:], lo + k)
    return None


def _trim(name: str, start: int) -> tuple[str, int] | None:
    if m := _SIGNAL.match(name):
        if not _WITHIN.match(name):
            name, start = name[m.end() :], start + m.end()
    while (m := _LEADING_WORD.match(name)) is not None:
        name, start = name[m.end() :], start + m.end()
    return (name, start) if name else None


def parties(name: str) -> dict:
    """plaintiff, defendant, prefix and normalised names of a caption."""
    return dict(_parties(name))


@lru_cache(maxsize=1 << 13)
def _parties(name: str) -> dict:
    prefix = next((x for x in PREFIXES if name.startswith(x + " ")), None)
    v = _VERSUS.search(name)
    if v and not (prefix in ("In re", "Ex parte")):
        a, b = name[: v.start()].strip(" ,"), name[v.end() :].strip(" ,")
        return {"plaintiff": a, "defendant": b, "plaintiff_norm": s.normalize_party(a), "defendant_norm": s.normalize_party(b), **({"procedural_prefix": prefix} if prefix else {})}
    if prefix:
        return {"plaintiff": name, "plaintiff_norm": s.normalize_party(name[len(prefix) :]), "procedural_prefix": prefix}
    return {}


_PIN_AFTER = re.compile(r",\s+(?:at\s+)?(\*?\d+(?:\s*-\s*\*?\d+)?(?:\s+(?:nn?|note)\s*\.?\s*\d+)?|¶¶?\s*\d+(?:-\d+)?)(?=\s*[,.;()\[\]]|\s*\Z|\s+\()(?!\s*,?\s+[A-Z][A-Za-z.]*\d?[a-z.]*\s+\d)")
_YEAR_FIRST = re.compile(r"\s*\(((?:[A-Z][^()]*\s)?)((?:17|18|19|20)\d{2})\)\s*\Z")
_NEXT_CORE = re.compile(r",\s+\d+\s+[A-Z][A-Za-z.\d'& ]*?\s+(?:\d+|_{3,}|-{3,})(?=[\s,.;()]|\Z)")


_BLANK = re.compile(r"\s*")


def parse_case(token: dict, text: str, as_of_year: int, floor: int, parallel: bool) -> dict:
    g = token["groups"]
    reporter = canonical_reporter(g["reporter"])
    page = g.get("page") or g.get("page2")
    blank = page is None or not page[0].isdigit()
    volume = g["volume"]
    out = {"type": "case", "volume": volume, "volume_num": int(volume) if volume.isdigit() else None, "reporter": reporter, "page": None if blank else int(page.split("-")[0]), "has_blank_page": blank or None}
    if g.get("nvolume"):
        out |= {"nominative_volume": int(g["nvolume"]), "nominative_reporter": g["nreporter"]}
    at = token["end"]
    pins = []
    while text.startswith(",", at) and (m := _PIN_AFTER.match(text, at)) is not None:
        pins.append(s.parse_pincite(m[1]))
        at = m.end()
    if pins and pins[0]:
        out |= {"pincite": pins[0]["page"], "pincite_info": pins[0], "more_pincites": [x for x in pins[1:] if x]}
    # parallel citations stand between a core and its parenthesis
    while text.startswith(",", at) and (m := _NEXT_CORE.match(text, at)) is not None:
        at = m.end()
        while (m := _PIN_AFTER.match(text, at)) is not None:
            at = m.end()
    parens, history, full_end = [], [], token["end"] if not pins else at
    meta: dict = {}
    while True:
        k = _BLANK.match(text, at).end()
        if k < len(text) and text[k] == "(" and k - at <= 2:
            stop = matched_paren(text, k)
            if stop < 0:
                break
            node = parse_paren(text[k + 1 : stop - 1], as_of_year)
            node |= {"start": k, "end": stop}
            if "type" in node:
                parens.append(node)
            else:
                for key in ("court", "year", "date", "disposition", "justices", "scope"):
                    if key in node and key not in meta:
                        meta[key] = node[key]
                if "inner_history" in node:
                    name, raw = node["inner_history"]
                    history.append({"signal": name, "raw_signal": raw, "end": stop, "ord": len(history), "inner": True})
                if node["text"].strip() in ("U", "UV"):
                    meta["unpublished"] = True
            at = full_end = stop
            continue
        if _HISTORY_BEGINS.match(text, at) and (h := _HISTORY.match(text, at)) is not None:
            name, raw = _signal_of(h)
            history.append({"signal": name, "raw_signal": raw, "end": h.end(), "ord": len(history)})
            if re.match(r"\s*\d+\s+[A-Z]|[A-Z]", text[h.end() : h.end() + 12] or ""):
                break
            at = h.end()
            continue
        break
    out |= meta
    out["parentheticals"] = [{"text": n["text"], "type": n["type"], "start": n["start"], "end": n["end"]} for n in parens]
    out["history"] = history
    if "court" not in out and reporter in ("U.S.", "S.Ct.", "L.Ed.", "L.Ed.2d"):
        out["court"] = "scotus"
    out["normalized_court"] = s.normalize_court(out.get("court"))
    start = name_end = token["start"]
    # California style: the year stands between the caption and the citation
    if text[max(floor, start - 60) : start].rstrip().endswith(")") and (m := _YEAR_FIRST.search(text, max(floor, start - 60), start)) is not None:
        name_end = m.start()
        if "year" not in out:
            out["year"], out["date"] = int(m[2]), s.parse_date(m[2], as_of_year)
            if m[1] and "court" not in out:
                out["court"], out["normalized_court"] = m[1].strip(), s.normalize_court(m[1])
    if not parallel and (found := case_name(text, name_end, floor)) is not None:
        name, start = found
        out["case_name"] = squeezed(name).rstrip(",")
        out |= parties(out["case_name"])
    out["full_span"] = (start, max(full_end, token["end"]))
    out["inferred_court"] = infer_court(reporter)
    known = lx.find_reporter(reporter)
    out["normalized_reporter"] = known[0] if known else None
    out["confidence"] = case_confidence(out, as_of_year)
    return out


def case_confidence(c: dict, as_of_year: int) -> float:
    """In hundredths: 20, and 30 for a known reporter, 20 for a year, 15 for a name, 10 for a court; at least 50 with a blank page."""
    known = c["reporter"] in _KNOWN
    points = 20 + 30 * known + 20 * bool(c.get("year") and c["year"] <= as_of_year) + 15 * bool(c.get("case_name")) + 10 * bool(c.get("court"))
    return (max(points, 50) if c.get("has_blank_page") else points) / 100


_SUBSECTION = re.compile(r"\s*((?:\s*(?:\([^)]*\)|\[[^\]]*\]))+)")
_RANGE = re.compile(r"\A(\d+[A-Za-z]?(?:\.\d+)?)[-–](\d+[A-Za-z]?(?:\.\d+)?)\Z")


def parse_body(body: str, ranges: bool = False) -> dict:
    """section, subsection, et seq. and (where ranges may stand) the end of a section range."""
    out: dict = {}
    rest = body.strip()
    if m := re.search(r"\s*et\s+seq\.?\Z", rest):
        out["has_et_seq"], rest = True, rest[: m.start()]
    if m := re.search(r",?\s+(?:subd\.|subdivision|paragraphs?|pars?\.)\s+", rest):
        rest = rest[: m.start()] + rest[m.end() :]
    tail = re.search(r"\s*[-–—]+\s*(\([A-Za-z0-9]+\))\Z", rest)
    if tail:
        rest = rest[: tail.start()]
    k = min((i for i in (rest.find("("), rest.find("[")) if i >= 0), default=len(rest))
    section, sub = rest[:k].strip(), re.sub(r"\s+", "", rest[k:])
    if ranges and (m := _RANGE.match(section)):
        section, out["section_end"] = m[1], m[2]
    out["section"] = section
    if sub:
        out["subsection"] = sub
        if tail:
            out["subsection_end"] = tail[1]
    return out


#: pattern id: (code, jurisdiction, confidence in hundredths); None: as the token says.
STATUTES = {
    "prose": ("U.S.C.", "US", 85), "irc": ("I.R.C.", "US", 95), "ussg": ("U.S.S.G.", "US", 95), "bankruptcy-code-postfix": ("U.S.C.", "US", 95), "bankruptcy-code-prefix": ("U.S.C.", "US", 95), "rsa-chapter": ("RSA", "NH", 95),
    "oh-chapter": ("R.C.", "OH", 95), "ors-chapter": ("ORS", "OR", 95), "ny-cplr-bare": ("N.Y. C.P.L.R.", "NY", 95), "ny-acronym-bare": (None, "NY", 95), "lpra": ("L.P.R.A.", "PR", 95), "ny-bare-named-code": (None, "NY", 90),
    "chapter-act": ("ILCS", "IL", 95), "ill-rev-stat": ("Ill. Rev. Stat.", "IL", 95), "rlh": ("RLH", "HI", 95), "colorado-prose": (None, "CO", 90), "florida-postfix": ("Fla. Stat.", "FL", 95), "florida-prefix-spelled": ("Fla. Stat.", "FL", 95),
    "idaho-postfix": ("Idaho Code", "ID", 95), "mca-postfix": ("MCA", "MT", 95), "tca-postfix": ("T.C.A.", "TN", 95), "rcw-chapter-postfix": ("RCW", "WA", 95), "wi-stats-postfix": ("Wis. Stat.", "WI", 95), "rrs-1943": ("R.R.S. 1943", "NE", 95),
    "rigl-1956": ("G.L. 1956", "RI", 95), "md-article-letter": (None, "MD", 95), "minn-st-year-edition": ("Minn. Stat.", "MN", 95), "ksa-year-edition": ("K.S.A.", "KS", 95), "ic-year-edition": ("IC", "IN", 95), "wv-code-1931": ("W. Va. Code", "WV", 90),
    "nyc-admin-code": ("N.Y.C. Admin. Code", "NY", 95), "ga-pre-1983": (None, "GA", 85), "va-bare-code": ("Va. Code", "VA", 90), "nm-bare-section": ("NMSA 1978", "NM", 90), "ca-bare-code": (None, "CA", 95),
    "ala-code-prefix": ("Code of Alabama 1940", "AL", 95), "ala-title-trailer": ("Code of Alabama 1940", "AL", 95), "ala-tit-bare": ("Code of Alabama 1940", "AL", 95), "mass-chapter": (None, "MA", 95), "named-code": (None, None, 95),
}
_ADMIN = {"nmac": ("NMAC", "NM"), "nmac2": ("NMAC", "NM"), "oar": ("OAR", "OR"), "comar": ("COMAR", "MD"), "idapa": ("IDAPA", "ID"), "arm": ("ARM", "MT")}
_YEAR_PAREN = re.compile(r"\s*\(((?:[A-Z][A-Za-z.&' ]*?\s+)?)((?:17|18|19|20)\d{2})(?:\s+([A-Za-z. ]+))?\)")


_NAMED_STATES = {lx.bare(k): v for k, v in lx.NAMED_CODE_STATES.items()}
_CA_PRINTED = {lx.bare(c): c for c in lx.CA_CODES} | {lx.bare(a): c for a, c in lx.CA_ALIASES.items()}
_STATES = {lx.bare(k): v for k, v in lx.STATES.items()}


def parse_statute(token: dict, text: str) -> dict:
    kind, g = token["pattern_id"], token["groups"]
    out: dict = {"type": "statute"}
    title = int(g["title"]) if g.get("title") else None
    double = "§§" in token["text"]
    points = 95
    if kind == "state-admin-code":
        key = next(k for k in _ADMIN if g.get(k))
        code, jurisdiction = _ADMIN[key]
        out |= {"code": code, "jurisdiction": jurisdiction, "section": g[key]}
    elif kind in ("usc", "cfr"):
        out |= parse_body(g["body"], ranges=double)
        out |= {"code": "U.S.C." if kind == "usc" else "C.F.R.", "jurisdiction": "US"}
        out["type"] = "statute" if kind == "usc" else "regulation"
        points += 5
    elif kind == "abbreviated-code":
        out |= parse_body(g["body"], ranges=double)
        code, jurisdiction = lx.find_state_code(squeezed(g["code"]))
        code = code or squeezed(g["code"])
        out |= {"code": code, "jurisdiction": jurisdiction}
        points = (95 if g.get("mark") else 85) if jurisdiction else (60 if g.get("mark") else 40)
        points += 5 * (title is not None)
    else:
        code, jurisdiction, points = STATUTES[kind]
        out |= parse_body(g["body"] if g.get("body") else g.get("chapter") or "", ranges=kind in ("named-code", "ca-bare-code") and double)
        code = code or squeezed(g["code"]).rstrip(",")
        if kind == "named-code":
            jurisdiction = _NAMED_STATES[lx.bare(g["state"])]
        elif kind == "ny-acronym-bare":
            code = f"N.Y. {code}"
        elif kind == "mass-chapter":
            out["chapter"] = g["chapter"]
            if not g.get("body"):
                out["section"] = None
        elif kind in ("bankruptcy-code-postfix", "bankruptcy-code-prefix"):
            title = 11
        elif kind == "chapter-act":
            code = g["act"]
        elif kind == "ca-bare-code":
            code = _CA_PRINTED[lx.bare(code)]
        elif kind == "prose":
            points += 5
        out |= {"code": code, "jurisdiction": jurisdiction}
        if g.get("year"):
            out["year"] = int(g["year"])
        if kind == "rrs-1943" and g.get("year"):
            out["edition_label"] = "Reissue"
        if kind == "rigl-1956" and g.get("year"):
            out["edition_label"] = "Reenactment"
        if g.get("edition"):
            out["edition_label"] = "Supp."
    if title is not None:
        out["title"] = title
    if out.get("subsection"):
        points += 5
    if "year" not in out and (m := _YEAR_PAREN.match(text, token["end"])):
        out["year"] = int(m[2])
        if m[1].strip():
            out["publisher"] = m[1].strip()
        if m[3]:
            out["edition_label"] = m[3].strip()
    out["confidence"] = min(points, 100) / 100
    return out


_ORDINALS = {w.lower(): i + 1 for i, w in enumerate(p.ORDINAL_WORDS)}


def numeral(text: str | None) -> int | None:
    if not text:
        return None
    low = re.sub(r"\s+", "-", text.strip().lower())
    if m := re.match(r"\d+", low):
        return int(m[0])
    return _ORDINALS.get(low) or s.roman(text)


def parse_constitutional(token: dict, text: str) -> dict:
    kind, g = token["pattern_id"], token["groups"]
    out: dict = {"type": "constitutional"}
    points = {"us-constitution": 90, "state-constitution": 90, "bare-constitution": 70, "constitutional-historical-reform": 85}.get(kind, 50 if kind.startswith("bare-") else 85)
    if kind == "us-constitution" or kind.startswith("bare-amendment"):
        out["jurisdiction"] = "US"
    elif g.get("state"):
        out["jurisdiction"] = _STATES.get(lx.bare(g["state"]))
    elif g.get("name"):
        out["jurisdiction"] = lx.STATE_NAMES.get(squeezed(g["name"]).title())
    number = numeral(g.get("number") or g.get("ordinal"))
    amendment = bool(g.get("ordinal")) or (g.get("kind") or "").lower().startswith("am")
    if g.get("preamble"):
        out["preamble"] = True
    elif number is not None:
        out["amendment" if amendment else "article"] = number
    if g.get("sections"):
        out["section"] = re.findall(r"\d+", g["sections"])[0]
    elif g.get("section"):
        out["section"] = g["section"]
    if g.get("clause"):
        out["clause"] = int(g["clause"])
    if kind in ("us-constitution", "state-constitution") and out.get("section"):
        points = 95
    out["confidence"] = points / 100
    return out


_RULE_SETS = {"civ": "Fed. R. Civ. P.", "cri": "Fed. R. Crim. P.", "evi": "Fed. R. Evid.", "app": "Fed. R. App. P.", "ban": "Fed. R. Bankr. P.", "frcp": "Fed. R. Civ. P.", "fre": "Fed. R. Evid.", "frap": "Fed. R. App. P.", "frcrp": "Fed. R. Crim. P.", "frbp": "Fed. R. Bankr. P."}
_STATE_RULES = {"id-rcp": ("ID", "I.R.C.P."), "id-rcp-spelled": ("ID", "I.R.C.P."), "nc-rap": ("NC", "N.C. R. App. P."), "nc-rcp": ("NC", "N.C. R. Civ. P."), "sc-scacr-postfix": ("SC", "SCACR"), "rcfc": ("US", "RCFC"), "hcn-rcp": ("HCN", "HCN R. Civ. P."), "tcrcp": ("T.C.", "T.C.R.C.P.")}
_EDITIONS = {"1st": "First", "2d": "Second", "3d": "Third", "4th": "Fourth"}


def _split_rule(rule: str) -> dict:
    k = rule.find("(")
    return {"rule": rule if k < 0 else rule[:k], "subsection": None if k < 0 else rule[k:]}


def _year_after(text: str, end: int, reach: int) -> int | None:
    m = re.compile(r"[^()]{0,%d}?\((?:[^()]*\s)?((?:17|18|19|20)\d{2})\)" % reach).match(text, end)
    return int(m[1]) if m and ";" not in m[0] else None


def parse_other(token: dict, text: str, as_of_year: int, floor: int) -> dict | None:
    """Everything but cases, statutes, constitutions and short forms."""
    kind, t, g = token["pattern_id"], token["type"], token["groups"]
    end = token["end"]
    number = lambda k: int(g[k].replace(",", "")) if g.get(k) and g[k].replace(",", "").isdigit() else None
    pin = _PIN_AFTER.match(text, end)
    info = s.parse_pincite(pin[1]) if pin else None
    pinned = {"pincite": info["page"], "pincite_info": info} if info else {}
    if t == "neutral":
        blank = g["number"].startswith("[")
        out = {"type": t, "year": int(g["year"]), "number": "" if blank else g["number"], "confidence": 1.0}
        if kind == "westlaw":
            out["database"] = "WL"
        elif kind == "lexis":
            out["database"] = squeezed(g["database"])
        elif kind == "ny-slip-op":
            out["database"] = "NY Slip Op"
        elif kind == "tc-memo":
            out["court"] = "T.C. Memo."
        else:
            out["database" if g["court"] in ("WL", "BL") else "court"] = squeezed(g["court"])
        if kind == "state-vendor-neutral-hyphenated-ms":
            out["court"] = f"{g['court']}-{g['suffix']}"
        if g.get("unpublished") or g["number"].endswith("-U"):
            out["unpublished"] = True
        m = re.compile(r",?\s+at\s+(\*?\d+(?:-\*?\d+)?)").match(text, end)
        if m:
            info = s.parse_pincite(m[1])
            pinned, end = {"pincite": info["page"], "pincite_info": info}, m.end()
        if "database" in out and (k := re.compile(r"\s*\(").match(text, end)) and (stop := matched_paren(text, k.end() - 1)) > 0:
            node = parse_paren(text[k.end() : stop - 1], as_of_year)
            out |= {x: node[x] for x in ("court", "date") if x in node}
        if (found := case_name(text, token["start"], floor)) is not None:
            out["case_name"] = squeezed(found[0]).rstrip(",")
        return out | pinned
    if t == "journal":
        journal = squeezed(g["journal"])
        words = journal.split(" ")
        if len(words) > 1 and "." not in journal and all(len(w) > 2 for w in words):
            return None  # prose between two numbers
        year = _year_after(text, pin.end() if pin else end, 30)
        return {"type": t, "volume": g["volume"], "volume_num": number("volume"), "journal": journal, "page": number("page"), "year": year, "confidence": 0.6} | pinned
    if t == "publicLaw":
        return {"type": t, "congress": int(g["congress"]), "number": g["number"], "confidence": 0.9}
    if t in ("federalRegister", "statutesAtLarge"):
        at = pin.end() if pin and t == "statutesAtLarge" else end
        out = {"type": t, "volume": g["volume"], "volume_num": number("volume"), "page": number("page"), "year": _year_after(text, at, 64 if t == "federalRegister" else 16), "confidence": 0.9}
        return out | (pinned if t == "statutesAtLarge" else {})
    if t == "sessionLaw":
        ca = kind == "ca-session-law"
        return {"type": t, "jurisdiction": "CA" if ca else "NV", "code": "Cal. Stats." if ca else "Nev. Stat.", "year": int(g["year"]), "chapter": g["chapter"], "section": g.get("section"), "page": int(re.match(r"\d+", g["page"])[0]) if g.get("page") else None, "confidence": 0.95}
    if t == "treaty":
        return {"type": t, "series": re.sub(r"\s", "", g["series"]), "number": g.get("number"), "volume": g.get("volume"), "page": number("page"), "confidence": 0.9}
    if t == "legislativeMaterial":
        if kind == "legmat-cong-rec":
            return {"type": t, "series": "congressionalRecord", "volume": g["volume"], "volume_num": number("volume"), "number": g["page"], "confidence": 0.9}
        return {"type": t, "series": "report", "court": "House" if g["chamber"][0] == "H" else "Senate", "number": g["number"], "congress": number("congress"), "page": number("page"), "year": number("year"), "confidence": 0.9}
    if t == "localOrdinance":
        return {"type": t, "code": "CCCO", "jurisdiction": "Clark County, NV", "section": g["section"], "confidence": 0.9}
    if t == "canon":
        return {"type": t, "number": g["number"], "subsection": g["subsection"] or None, "rule_set": "Code of Judicial Conduct" if g.get("set") else None, "confidence": 0.9}
    if t == "docket":
        found = case_name(text, token["start"], floor)
        if found is None:
            return None
        name = squeezed(found[0]).rstrip(",")
        node = parse_paren(g["paren"], as_of_year)
        return {"type": t, "number": g["number"], "case_name": name, "court": node.get("court"), "normalized_court": s.normalize_court(node.get("court")), "year": int(g["year"]), "confidence": 0.7, "full_span": (found[1], end)} | parties(name)
    if t == "federalRule":
        key = re.sub(r"[.\s]", "", g["set"]).lower()
        return {"type": t, "rule_set": _RULE_SETS.get(key) or _RULE_SETS[key[:3]], "confidence": 0.95, "jurisdiction": "US"} | _split_rule(g["rule"])
    if t == "stateRule":
        jurisdiction, name = _STATE_RULES[kind]
        out = {"type": t, "rule_set": name, "jurisdiction": jurisdiction, "confidence": 0.95} | _split_rule(g["rule"])
        return out | ({"confidence": 1.0} if out["subsection"] else {})
    if t == "restatement":
        return {"type": t, "edition": _EDITIONS.get(g["edition"], g["edition"]), "subject": re.sub(r"\Athe\s+", "", squeezed(g["subject"])), "confidence": 0.95} | parse_body(g["body"])
    if t == "treatise":
        year = re.search(r"(?:17|18|19|20)\d{2}", g.get("edition") or "")
        return {"type": t, "volume": g["volume"], "volume_num": number("volume"), "work": g.get("work") or g.get("work2"), "section": g["section"], "edition": g.get("edition"), "year": int(year[0]) if year else None, "confidence": 0.9}
    if t == "annotation":
        return {"type": t, "volume": g["volume"], "volume_num": number("volume"), "series": re.sub(r"\s", "", g["series"]), "page": number("page"), "year": _year_after(text, end, 16), "confidence": 0.95}
    return None


_PARTY_SIGNAL = re.compile(r"\A(?:See(?:\s+also)?|But\s+see|In|Under|Cf\.|Accord|Compare|The|As|And)\s+")


_OPENS = re.compile(r"\s*\(")
_ID_SECTION = re.compile(r"\s*(?:at\s+)?§§?\s*([\w.\-]+(?:\([^)]*\))*)")


def parse_short(token: dict, text: str) -> dict:
    """Id., supra and short-form case citations."""
    kind, g = token["pattern_id"], token["groups"]
    info = s.parse_pincite(g.get("pin") or g.get("pin2"))
    out: dict = {"pincite": info["page"], "pincite_info": info} if info else {}
    k = _OPENS.match(text, token["end"])
    if k and (stop := matched_paren(text, k.end() - 1)) > 0 and "(" not in text[k.end() : stop - 1]:
        content = text[k.end() : stop - 1]
        out["parentheticals"] = [{"text": content, "type": _explains(content) or "other", "start": k.end() - 1, "end": stop}]
    if kind in ("id", "ibid"):
        points = 100 if token["text"][0] == "I" else 85
        if "," in token["text"][:4]:
            points = min(points, 90 if token["text"][0] == "I" else 70)
        before = text[max(0, token["start"] - 200) : token["start"]].rstrip()[-12:]
        if before and before[-1] not in ".;:!?)]\"'—" and not re.search(r"[.;:!?)\]\"'—]\Z|\b(?:[Ss]ee|[Cc]f\.|also|[Aa]ccord|[Bb]ut)\Z", before):
            points = min(points, 40)
        section = _ID_SECTION.match(text, token["end"])
        return {"type": "id", "confidence": points / 100, "section": section[1].rstrip(".") if section else None} | out
    if kind == "supra":
        party = g.get("party")
        if party:
            party = squeezed(party)
            while (m := _PARTY_SIGNAL.match(party)) is not None and m.end() < len(party):
                party = party[m.end() :]
            party = party.rstrip(",")
        place = g.get("section") or (f"Part {g['part']}" if g.get("part") else None)
        return {"type": "supra", "party_name": party, "section": place, "confidence": 0.9 if party else 0.8} | out
    reporter = canonical_reporter(g["reporter"]).rstrip(",")
    party = squeezed(g["party"]) if g.get("party") else None
    if party:
        while (m := _PARTY_SIGNAL.match(party)) is not None and m.end() < len(party):
            party = party[m.end() :]
    return {"type": "shortFormCase", "volume": g["volume"], "volume_num": int(g["volume"]) if g["volume"].isdigit() else None, "reporter": reporter, "party_name": party, "party_norm": s.normalize_party(party), "confidence": 0.7 if reporter in _KNOWN else 0.4} | out
