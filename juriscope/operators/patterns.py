"""What citations look like: one form for each of 101 kinds. Order is priority, and priority is semantics.

A form is put together from the parts that citations share (numbers, sections, pincites, printed
names from ``lexicon``) by small functions, one for each shape: volume-name-page, code-section,
section-code, rule, provision. What a regular expression says badly, a form says in ``accept``, which
sees the match and may refuse it; the search then goes on one character later.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from math import prod
from re import _constants as _c
from re import _parser as _p

from . import lexicon as lx
from .lexicon import by_letter, one_of, tolerant


@dataclass(frozen=True, eq=False)
class Pattern:
    id: str
    type: str
    regex: re.Pattern
    accept: Callable[[re.Match], bool] | None = None
    needles: tuple[str, ...] = ()  # a text that holds none of these, whatever its case, cannot match
    signs: tuple[str, ...] = ()  # nor can one whose outline holds none of these


# ---------------------------------------------------------------- literals that a match must hold


def needles(regex: str) -> tuple[str, ...]:
    """Lower-case strings of which every match holds at least one, whatever its case; empty if there are none of use.

    For a sequence the best set of one of its parts, for alternatives the union of theirs.
    """

    def better(a: tuple, b: tuple) -> tuple:
        # the rarer set: long shortest member, few members
        score = lambda s: (min(len(x) for x in s) * 4 - len(s), len(s[0])) if s else (-999, 0)
        return max(a, b, key=score)

    def of(items) -> tuple:
        best, run = (), ""
        for op, arg in items:
            if op is _c.LITERAL:
                run += chr(arg).lower()
                best = better(best, (run,))
                continue
            if op is _c.AT:
                continue
            run = ""
            if op is _c.SUBPATTERN:
                best = better(best, of(arg[3]))
            elif op is _c.BRANCH:
                parts = [of(x) for x in arg[1]]
                if all(parts) and sum(map(len, parts)) <= 24:
                    best = better(best, tuple(dict.fromkeys(n for x in parts for n in x)))
            elif op is _c.IN and all(o is _c.LITERAL for o, _ in arg) and len(arg) <= 4:
                best = better(best, tuple({chr(c).lower(): 1 for _, c in arg}))
            elif op is _c.MAX_REPEAT and arg[0] > 0:
                best = better(best, of(arg[2]))
        return best

    return of(_p.parse(regex))


_BLANK_BYTES = b" \t\n\r\f\v"
_OUTLINE = bytes.maketrans(b"123456789" + _BLANK_BYTES, b"0" * 9 + b" " * len(_BLANK_BYTES))


def outline(low: str) -> str:
    """A lower-case text with every digit as 0 and every run of white space as one blank, blanks around it."""
    words = low.encode("utf-8", "surrogatepass").translate(_OUTLINE).split()
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "


def signs(regex: str) -> tuple[str, ...]:
    """Strings of which the outline of every text with a match holds at least one; empty if there are none of use.

    Walks through the form with all endings that what has matched so far may have in the outline: at any place that
    every match passes, one of them is in the text. The set that is expected least often is taken.
    """
    reach, most, few = 6, 256, 12
    often = {"0": 0.1, " ": 0.16, ".": 0.05, ",": 0.02}
    best: tuple[float, tuple[str, ...]] = (0.02, ())

    def offer(state: set[str]) -> None:
        nonlocal best
        for ends in (state, {x[-4:] for x in state}, {x[-3:] for x in state}):
            if len(ends) <= few and all(ends):
                expected = sum(prod(often.get(ch, 0.04) for ch in x) for x in ends)
                best = min(best, (expected + len(ends) * 1e-4, tuple(sorted(ends))))

    def add(state: set[str], ch: str) -> set[str]:
        ch = " " if ch in " \t\n\r\f\v" else "0" if ch in "0123456789" else ch.lower()
        return {x if ch == " " and x.endswith(" ") else (x + ch)[-reach:] for x in state}

    def single(items) -> set[str] | None:
        """The characters that a set of few stands for."""
        if len(items) == 1 and items[0][0] is _c.CATEGORY:
            return {_c.CATEGORY_DIGIT: {"0"}, _c.CATEGORY_SPACE: {" "}}.get(items[0][1])
        return {chr(x) for _, x in items} if len(items) <= 4 and all(op is _c.LITERAL for op, _ in items) else None

    def of(items, state: set[str], sure: bool) -> set[str]:
        for op, arg in items:
            if op is _c.LITERAL:
                state = add(state, chr(arg))
            elif op is _c.AT or op is _c.ASSERT_NOT:
                continue
            elif op is _c.ASSERT:
                of(arg[1], {""}, sure)  # takes no text, but what it holds is there
            elif op is _c.SUBPATTERN:
                state = of(arg[3], state, sure)
            elif op is _c.BRANCH:
                state = set().union(*(of(x, state, False) for x in arg[1]))
            elif op is _c.IN and (chars := single(arg)) is not None:
                state = set().union(*(add(state, ch) for ch in chars))
            elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
                least, greatest, part = arg
                once = state
                for _ in range(min(least, 4)):
                    once = of(part, once, sure)
                if len(part) == 1 and part[0][0] is _c.IN and single(part[0][1]) == {" "}:
                    state = once | add(state, " ")  # any number of them is one blank
                elif least == greatest <= 4:
                    state = once
                elif greatest == 1:
                    state = state | of(part, state, False)
                else:  # after more turns it ends as one turn does
                    state = (state if least == 0 else once) | of(part, {""}, False)
            else:
                state = {""}
            state = state if len(state) <= most else {""}
            if sure:
                offer(state)
        return state

    of(_p.parse(regex), {""}, True)
    return best[1]


# ---------------------------------------------------------------- shared parts


def named(name: str, regex: str) -> str:
    return f"(?P<{name}>{regex})"


def maybe(*regex: str) -> str:
    return f"(?:{''.join(regex)})?"


def nth(n: int) -> str:
    return f"{n}{'th' if 10 <= n % 100 <= 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


VOLUME = r"\d+(?:-\d+)?"
YEAR = r"(?:1[7-9]|2[01])\d\d"
GROUPED = r"\d{1,3}(?:,\d{3})+|\d+"
#: A page or its place holder; what follows must not go on as a word, a ratio or a share.
BLANK = r"(?:_{3,}|-{3,})"
PAGE_OVER = r"(?![\w/:&%$+=])"
UNASSIGNED = r"\[[-_]{2,}\]"
SERIES = r"\d{1,2}(?:d|st|nd|rd|th)"

#: One section number: digits and letters, then further parts after a dot, colon, slash or hyphen.
SECTION = r"\d+[A-Za-z0-9]*(?:(?:[.:/]|-+\.?)[A-Za-z0-9]+)*"
COMMA_SECTION = r"\d+[A-Za-z0-9]*(?:(?:[.:/]|-+\.?)[A-Za-z0-9]+|,\d+)*"
#: What stands in a subsection's brackets: (a), (12), (iv), (a-1), (1.5); never a year, never a word.
_LABEL = r"(?:\d{1,3}[A-Za-z]{0,2}|[A-Za-z]{1,2}|[ivxlIVXL]{1,5})(?:[.-][A-Za-z0-9]{1,3})*"
SUBSECTIONS = rf"(?:\s*(?:\({_LABEL}\)|\[{_LABEL}\]))*"
TO_SUBSECTION = rf"(?:\s*[-–—]+\s*\({_LABEL}\))?"
SUBDIVISION = rf"(?:,?\s+(?:subd\.|subdivision|paragraphs?|pars?\.)\s+(?:\s*(?:\({_LABEL}\)|\[{_LABEL}\]))+)?"
ET_SEQ = maybe(r"\s*", tolerant("et seq."))
BODY = SECTION + SUBSECTIONS + TO_SUBSECTION + ET_SEQ
SIGN = "§§?"
MARK = r"(?:§§?|[Ss]ections?\b|[Ss]ec\.|[Ss]ec\b)"
#: Not inside a word.
OPEN = r"(?<![A-Za-z0-9])"

ORDINAL_WORDS = "First Second Third Fourth Fifth Sixth Seventh Eighth Ninth Tenth Eleventh Twelfth Thirteenth Fourteenth Fifteenth Sixteenth Seventeenth Eighteenth Nineteenth Twentieth".split()
ORDINAL_WORDS += [f"Twenty-{w}" for w in ORDINAL_WORDS[:7]]
ORDINAL = "(?:" + "|".join([*(w.replace("-", r"[-\s]") for w in reversed(ORDINAL_WORDS)), *(nth(n) for n in range(len(ORDINAL_WORDS), 0, -1))]) + ")"

#: A run of capitalised words, as reporters and journals are printed: "Cal. App. 4th", "Harv. L. Rev.".
_HEAD = r"[A-Z][\w.&']*"
_WORD = r"[A-Z][A-Za-z.&']*"
PHRASE = rf"{_HEAD}(?:\s+(?:{_HEAD}|&|{SERIES}(?!\w)\.?))*?"
JOURNAL = rf"{_WORD}(?:\s+(?:{_WORD}|&|{SERIES}(?!\w)\.?))*?"
#: What stands for a reporter before "at": prose too, which the rules for false positives then mark.
SHORT_PHRASE = rf"{_HEAD}(?:\s+(?:[A-Za-z&][\w.&']*|{SERIES}(?!\w)\.?)){{0,12}}?"
#: A party's name in a short form; bounded, so that capitalised prose costs no more than its length.
_CAPITAL = r"[A-Z][A-Za-z'\-]+\.?"
PARTY = rf"{_CAPITAL}(?:,?\s+(?:(?:v\.?|&)\s+)?{_CAPITAL}){{0,24}}"

_RANGE = r"\d+(?:\s*-\s*\*?\d+)?"
PIN = rf"(?:(?:¶¶?|\bparas?\b\.?)\s*{_RANGE}|\*?{_RANGE}(?:\s+(?:nn?|note)\b\s*\.?\s*{_RANGE})?)"
AT = r"at\s+(?:pp?\.\s*)?"


def pinned(name: str = "pin", comma: bool = True) -> str:
    """A pincite after "at", after a comma unless another citation begins there, or a bare paragraph mark."""
    lead = rf",?\s*{AT}|,?\s*(?=¶|paras?\b)" + (r"|,\s+(?!\d+\s+[A-Z])" if comma else "")
    return maybe(f"(?:{lead})", named(name, PIN))


# ---------------------------------------------------------------- shapes


def volume_page(name: str, page: str = r"\d+", volume: str = VOLUME) -> str:
    """volume, name, page."""
    return rf"\b{named('volume', volume)}\s+{name}\s+{named('page', page)}\b"


def reported(reporter: str, nominative: bool = False, dashed: bool = True) -> str:
    """volume, reporter, page of a case: a number, a place holder, a number with a hyphen before a year in brackets, or,
    after a comma, a number at which the phrase ends."""
    other = maybe(r"\(", named("nvolume", r"\d+"), r"\s+", named("nreporter", r"[A-Z][A-Za-z.]+"), r"\)\s+") if nominative else ""
    hyphen = r"\d+-\d+(?=\s+\(\d{4}\))|" if dashed else r"\d+-\d+|"
    return rf"\b{named('volume', VOLUME)}\s+{named('reporter', reporter)}(?:\s+{other}{named('page', hyphen + rf'(?:\d+|{BLANK}){PAGE_OVER}')}|\s*,\s+{named('page2', rf'(?:\d+|{BLANK})')}(?![\w/:&%$+=\s]|-\d))"


def code_section(code: str, mark: str = SIGN, body: str = BODY, title: str = "") -> str:
    """[title] code mark section."""
    # where a title may stand, the code begins with a capital: nothing else is tried at other boundaries
    head = r"(?=[\dA-Z])" + maybe(named("title", r"\d+"), r"\s+") if title == "optional" else named("title", r"\d+") + r"\s*,?\s+" if title else ""
    return rf"\b{head}{code}\s*,?\s*(?:{mark})\s*{named('body', body)}"


def section_code(code: str, mark: str = MARK, body: str = BODY) -> str:
    """mark section, code."""
    return rf"{OPEN}{mark}\s*{named('body', body)},?\s+{code}"


def rule(rule_set: str, flags: str = "") -> str:
    """A set of rules and a rule's number."""
    return rf"{flags}\b{rule_set}\s+{named('rule', rf'\d+(?:\.\d+)?{SUBSECTIONS}')}"


# ---------------------------------------------------------------- refusals


def _before(m: re.Match, reach: int = 80) -> str:
    return m.string[max(0, m.start() - reach) : m.start()]


_DOCKET_BEFORE = re.compile(r"\b(?:Case|Cause|Docket)\s+No\.\s+[\w-]*\Z")
_CONST_BEFORE = re.compile(r"\bConst\.?,?\s\Z")


def _no_docket(m: re.Match) -> bool:
    return not _DOCKET_BEFORE.search(_before(m))


def _no_const(m: re.Match) -> bool:
    return not _CONST_BEFORE.search(_before(m, 12))


def _own_const(m: re.Match) -> bool:
    """A bare "Const." has no state's initials before it."""
    return not re.search(r"(?:\.|[A-Z])\s\Z", _before(m, 2))


def _case_phrase(m: re.Match) -> bool:
    """Neither a short form, nor a conjunction, nor a journal, nor a set of rules."""
    words = m["reporter"].split()
    if words[0].rstrip(".") in ("Id", "Ibid") and len(words) == 1 or words[0] in ("AND", "OR") and len(words) == 1:
        return False
    page = m["page"] or m["page2"]
    return not any(re.match(r"L\.(?:[JQR]|\Z)", w) for w in words[1:]) and not (len(words) > 1 and words[-1] == "R." and page[0].isdigit())


def _journal_phrase(m: re.Match) -> bool:
    return m["journal"].rstrip(".") not in ("Id", "Ibid")


def _no_longer_number(m: re.Match) -> bool:
    """Two parts only: "12-34", but not the start of "12-34-5" or "12-34.5"."""
    return not re.match(r"[-.]?\d|-", m.string[m.end("body") : m.end("body") + 2]) and re.fullmatch(r"\d+-\d+[A-Za-z0-9]?(?:\(.*\))*", m["body"]) is not None


def _virginia(m: re.Match) -> bool:
    return not (m["state"].startswith("V") and re.search(r"W\.\s?\Z", _before(m, 3)))


# ---------------------------------------------------------------- the forms by family


def _neutral() -> list[tuple]:
    year, number = named("year", YEAR), named("number", r"\d+")
    any_year = named("year", r"\d{4}")
    il = r"IL\s+App\s+\(\d{1,2}(?:st|d|nd|rd|th)\)"
    ok = r"OK\s+(?:CIV\s+APP|CR|AG)"
    return [
        ("state-vendor-neutral-hyphenated-ms", "neutral", rf"\b{year}-{named('court', '[A-Z]+')}-{number}-{named('suffix', '[A-Z]+')}\b", _no_docket),
        ("state-vendor-neutral-hyphenated", "neutral", rf"\b{year}-{named('court', '[A-Z][A-Za-z]+')}-{number}\b", _no_docket),
        ("state-vendor-neutral", "neutral", rf"\b{any_year}\s+{named('court', rf'{il}|{ok}|[A-Z][A-Z](?:\s+App\b\.?)?')}\s+{named('number', r'\d+(?:-U)?')}\b"),
        ("ny-slip-op", "neutral", rf"\b{year}\s+{tolerant('N.Y.')}\s+{tolerant('Slip Op.')}\s+{named('number', rf'\d+|{UNASSIGNED}')}{maybe(named('unpublished', r'\(UV?\)|\[U\]'))}"),
        ("westlaw", "neutral", rf"\b{any_year}\s+WL\s+{named('number', rf'\d+\b|{UNASSIGNED}')}"),
        ("tc-memo", "neutral", rf"\b{tolerant('T.C. Memo.', True)}\s+{any_year}-{number}\b"),
        ("lexis", "neutral", rf"\b{any_year}\s+{named('database', r'[A-Z][A-Za-z.\s]{0,40}?\sLEXIS')}\s+{number}\b"),
    ]


def _official() -> list[tuple]:
    """Session laws, registers, treaties, reports of Congress, ordinances, canons, dockets."""
    session_year = named("year", r"(?:18|19|20)\d\d")
    chapter = tolerant("ch.", True) + r"\s+" + named("chapter", r"\d+")
    congress = maybe(r",?\s+", named("congress", r"\d+"), r"(?:st|d|nd|rd|th)\s+Cong\.")
    session = maybe(r",?\s+", named("session", SERIES), r"\s+Sess\.?")
    docket = maybe(r"(?:C\.A\.|Civ(?:il(?:\s+Action)?|\.)|Case|Adv\.|Docket)\s+")
    return [
        ("public-law", "publicLaw", rf"\b(?:{tolerant('Pub. L.', True)}|Public\s+Law)\s?(?:No\.)?\s?{named('congress', r'\d+')}-{named('number', r'\d+')}\b"),
        ("federal-register", "federalRegister", volume_page(tolerant("Fed. Reg.", True), GROUPED)),
        ("statutes-at-large", "statutesAtLarge", volume_page(r"Stat\.", GROUPED)),
        ("compact-law-review", "journal", volume_page(named("journal", r"[A-Z][A-Za-z.]+L\.(?:Rev|J|Q)\."))),
        ("ca-session-law", "sessionLaw", rf"\bStats\.\s+{session_year},?\s+{chapter}{maybe(r',?\s*§§?\s*', named('section', r'\d+(?:\s*[,-]\s*\d+)*'))}{maybe(r',?\s*pp?\.\s*', named('page', _RANGE))}"),
        ("nv-session-law", "sessionLaw", rf"\b{session_year}\s+Nev\.\s+Stats?\b\.?,?\s+{chapter}{maybe(r',?\s*§§?\s*', named('section', _RANGE))}{maybe(r',?\s*at\s+', named('page', _RANGE))}"),
        ("treaty-series-no", "treaty", rf"\b{named('series', tolerant('T.I.A.S.') + '|Bevans')}\s+No\.?\s+{named('number', r'\d+')}"),
        ("treaty-volume-page", "treaty", volume_page(named("series", f"{tolerant('U.N.T.S.')}|{tolerant('U.S.T.')}"), volume=r"\d+")),
        ("legmat-report", "legislativeMaterial", rf"\b{named('chamber', tolerant('H.R.') + r'|H\.?|S\.?')}\s*Rep\.?\s+No\.?\s+{named('number', VOLUME)}{maybe(r',?\s+pt\.\s+\d+')}{congress}{session}{maybe(r',?\s+(?:p\.\s*|at\s+)?', named('page', r'\d+'))}{maybe(r'\s*\(', named('year', r'\d{4}'), r'\)')}"),
        ("legmat-cong-rec", "legislativeMaterial", volume_page(tolerant("Cong. Rec.", True), r"[HSE]?\d+", r"\d+")),
        ("ccco-ordinance", "localOrdinance", rf"\bCCCO\s+§\s*{named('section', r'\d+(?:\.\d+)*' + SUBSECTIONS)}"),
        ("canon", "canon", rf"\bCanon\s+{named('number', r'\d+')}{named('subsection', rf'(?:\({_LABEL}\))*')}{maybe(named('set', r'\s+of\s+the\s+Code\s+of\s+Judicial\s+Conduct'))}"),
        ("docket-paren-court-year", "docket", rf"\b{docket}No\.\s+{named('number', r'[A-Za-z\d]+(?::[A-Za-z\d]+)?(?:[-\s][A-Za-z\d]+)*')}\s+\({named('paren', rf'[^()]+\s{named('year', r'\d{4}')}')}\)"),
    ]


def _short() -> list[tuple]:
    # after nothing, white space, or an opening mark
    fresh = r"(?<![^\s\"'(\[—])"
    note = maybe(r"\s+note\s+", named("note", r"\d+"))
    part = rf"§§?\s*{named('section', SECTION)}|{tolerant('Part')}\s+{named('part', r'[IVX]+|[A-Z0-9]+')}\b"
    return [
        ("id", "case", rf"{fresh}[Ii]d(?:\s*\.|\s*,(?=\s+at\s)){pinned()}"),
        ("ibid", "case", rf"{fresh}[Ii]bid\s*\.{pinned()}"),
        ("supra", "case", rf"{maybe(r'\b', named('party', PARTY), r'\s*,?\s+')}\[supra{maybe(rf'(?:,\s+|\s+{AT})', named('pin', r'\d+(?:-\d+)?'))}\]"),
        ("supra", "case", rf"\b{named('party', PARTY)}\s*,?\s+supra{note}{pinned()}"),
        ("supra", "case", rf"(?<![^\s;.])supra(?:\s+note\s+{named('note', r'\d+')}{pinned(comma=False)}|\s+{AT}{named('pin2', PIN)}|\s+(?:{part}))"),
        ("shortFormCase", "case", rf"\b(?=[A-Z\d]){maybe(named('party', PARTY), r',\s+')}{named('volume', VOLUME)}\s+{named('reporter', SHORT_PHRASE)}\s*,?\s+at\s+(?:pp?\.\s*|pages?\s+)?{named('pin', PIN)}\b"),
    ]


def _rules() -> list[tuple]:
    fed = tolerant("Fed. R.", True)
    procedure = lambda x: rf"{x}\.\s?(?:P\.|Proc\.)"
    sets = "|".join([procedure("Civ"), procedure("Crim"), r"Evid\.", procedure("App"), procedure("Bankr")])
    acronyms = "|".join(["FRCP", "FRE", "FRAP", "FRCrP", "FRBP", *(tolerant(x, True) for x in ("F.R.C.P.", "F.R.E.", "F.R.A.P.", "F.R.Cr.P.", "F.R.B.P."))])
    spelled = "|".join(tolerant(x) for x in ("Civil Procedure", "Criminal Procedure", "Evidence", "Appellate Procedure", "Bankruptcy Procedure"))
    return [
        ("fed-rule-abbreviated", "federalRule", rule(rf"(?:{fed}|Fed\.\s?Rules?)\s?{named('set', sets)}")),
        ("fed-rule-spelled", "federalRule", rule(rf"Federal\s+Rules?\s+of\s+(?:the\s+)?{named('set', spelled)}", "(?i)")),
        ("fed-rule-acronym", "federalRule", rule(named("set", acronyms))),
        ("id-rcp", "stateRule", rule(tolerant("I.R.C.P.", True))),
        ("id-rcp-spelled", "stateRule", rule(r"Idaho\s+Rules?\s+of\s+Civil\s+Procedure", "(?i)")),
        ("nc-rap", "stateRule", rule(tolerant("N.C. R. App. P.", True))),
        ("nc-rcp", "stateRule", rule(tolerant("N.C. R. Civ. P.", True))),
        ("sc-scacr-postfix", "stateRule", rule("Rule") + r",\s*SCACR\b"),
        ("rcfc", "stateRule", rule("RCFC")),
        ("hcn-rcp", "stateRule", rule(tolerant("HCN R. Civ. P.", True))),
        ("tcrcp", "stateRule", rule(tolerant("T.C.R.C.P.", True))),
    ]


def _secondary() -> list[tuple]:
    edition = "|".join(["First", "Second", "Third", "Fourth", "1st", "2d", "3d", "4th"])
    alr = rf"(?:{tolerant('A.L.R.')})(?:\s?Fed\b\.?)?(?:\s?{SERIES})?"
    author = r"[A-Z][A-Za-z.]*(?:\s+(?:&\s+)?[A-Z][A-Za-z.]*)*,\s+"
    return [
        ("restatement", "restatement", rf"\bRestatement\s+\({named('edition', edition)}\)\s+(?:of\s+)?{named('subject', r"[A-Za-z][A-Za-z\s,.&'-]{1,80}?")}\s+§§?\s*{named('body', SECTION + SUBSECTIONS)}"),
        ("bare-journal", "journal", volume_page(named("journal", "|".join(re.escape(w) for w in sorted(lx.BARE_JOURNALS, key=len, reverse=True))), volume=r"\d+")),
        ("alr-annotation", "annotation", volume_page(named("series", alr), volume=r"\d+")),
        ("treatise", "treatise", rf"\b{named('volume', r'\d+[A-Z]?')}\s+(?:{named('work', one_of(lx.TREATISES, True))}|{author}{named('work2', one_of(lx.BARE_TREATISES, True))}){maybe(r'\s+\(', named('edition', '[^)]+'), r'\)')}\s+§§?\s*{named('section', r'\d+(?:[.:][A-Za-z0-9]+)*' + rf'(?:\[{_LABEL}\])?' + rf'(?:\({_LABEL}\))*')}"),
    ]


def _federal_codes() -> list[tuple]:
    usc = rf"(?:{tolerant('U.S.C.A.')}|{tolerant('U.S.C.S.')}|{tolerant('U.S.C.')}|United\s+States\s+Code)"
    # the number of a section has no dots in the Code, and one at most in the Regulations
    return [
        ("usc", "statute", code_section(usc, maybe(named("mark", MARK)), rf"\d+[A-Za-z0-9-]*(?<!-){SUBSECTIONS}{TO_SUBSECTION}{ET_SEQ}", "required")),
        ("cfr", "statute", code_section(tolerant("C.F.R."), rf"Part\s+|pt\.\s+|(?:{named('mark', SIGN)}|[Ss]ections?|[Ss]ec\.?)?", rf"\d+(?:\.\d+)?[A-Za-z0-9-]*(?<!-){SUBSECTIONS}{TO_SUBSECTION}{ET_SEQ}", "required")),
        ("irc", "statute", code_section(tolerant("I.R.C."))),
    ]


def _cases() -> list[tuple]:
    series = maybe(r"\s?", SERIES)
    return [
        ("federal-reporter", "case", reported(rf"{tolerant('F. Supp.', True)}{series}|{tolerant("F. App'x", True)}|F\.(?:{SERIES})?", dashed=False)),
        ("supreme-court", "case", reported(rf"{tolerant('U.S.', True)}|{tolerant('S. Ct.', True)}|{tolerant('L. Ed.', True)}{series}", nominative=True)),
        ("state-reporter", "case", reported(PHRASE), _case_phrase),
    ]


def _constitutions() -> list[tuple]:
    article, amendment = r"art(?:icle|s)?\.?", r"am(?:en)?d(?:men)?t?s?\.?"
    roman = r"[IVX]+|\d+"
    sections = maybe(r"[,;]?\s*§\s*", named("section", r"[\w-]+")) + maybe(r"[,;]?\s*cl\.?\s*", named("clause", r"\d+"))
    body = rf"(?:(?:{named('kind', f'{article}|{amendment}')}\s+{named('number', rf'(?:{ORDINAL}|{roman})')}\b|{named('ordinal', ORDINAL)}\s+{amendment}){sections}|{named('preamble', r'[,;]?\s*(?:pmbl|preamble)\b')})"
    us = rf"(?:{tolerant('U.S.')}\s+Const\b\.?|United\s+States\s+Constitution)"
    state = named("state", one_of(lx.STATES))
    of_state = rf"of\s+the\s+{named('name', one_of(lx.STATE_NAMES))}\s+"
    number, label = named("number", roman), named("section", r"[\w()-]+")
    old, new = rf"{named('kind', f'{article}|{amendment}')}\s+{named('number', '[IVXLC]+|[0-9]+')}", rf"(?:{article}|{amendment})\s+{named('number2', '[IVXLC]+|[0-9]+')}"
    at = lambda n: maybe(r"[,;]?\s*(?:§|section)\s*", named(n, r"[\w-]+"))
    return [
        ("constitutional-historical-reform", "constitutional", rf"(?i:{maybe(named('anchor', rf'{tolerant("U.S.")}\s+Const\b\.?|[A-Za-z][A-Za-z.]{{0,15}}\s+Const\b\.?'), r',?\s+')}former\s+{old}{at('section')}\s*\(\s*now\s+{new}{at('section2')}\s*\))"),
        ("us-constitution", "constitutional", rf"(?i:\b{us},?\s+{body})"),
        ("state-constitution", "constitutional", rf"(?i:\b{state}(?:(?<=\.)\s*|\s+)Const\b\.?,?\s+{body})"),
        ("bare-constitution", "constitutional", rf"\bConst\b\.?,?\s+{body}", _own_const),
        ("bare-article", "constitutional", rf"\bArt\b\.?\s+{number}[,;]\s*§\s*{named('section', r'[\w-]+')}{maybe(r'[,;]\s*cl\.?\s*', named('clause', r'\d+'))}", _no_const),
        ("bare-article-section", "constitutional", rf"\bArt(?:icle)?\b\.?\s+{number}\s*[,;]\s*(?:Section|§)\s*{label}", _no_const),
        ("state-const-prose-declaration", "constitutional", rf"(?i:\bart(?:icle)?\b\.?\s+{named('number', r'\d+')}\s+{of_state}(?:Declaration\s+of\s+Rights|Constitution)\b)"),
        ("state-const-prose-section-article", "constitutional", rf"\bSection\s+{label}\s*,\s*Article\s+{number}\s+{of_state}Constitution\b"),
        ("state-const-prose-article-first", "constitutional", rf"(?i:\bart(?:icle)?\b\.?\s+{number}[,\s]+section\s+{label},?\s+{of_state}Constitution\b)"),
        ("state-const-prose-plural-section", "constitutional", rf"\bSections\s+{named('sections', r'\d+(?:[\s,]+(?:and\s+)?\d+)+')}\s+of\s+Article\s+{number}\s+{of_state}Constitution\b"),
        ("bare-amendment-word", "constitutional", rf"\b{named('ordinal', ORDINAL)}\s+(?:[Aa]mend(?:ment|\b)|[Aa]mdt\b)\.?", _no_const),
        ("bare-amendment-coord", "constitutional", rf"\b{named('ordinal', ORDINAL)}(?=(?:,\s+{ORDINAL})*,?\s+(?:and\s+)?{ORDINAL}\s+[Aa]mendments?\b)", _no_const),
    ]


def _state_codes() -> list[tuple]:
    year = named("year", r"\d{4}")
    supplement = r"(?:\s*(?:\([^()]*\)|\[[^\[\]]*\]))*"  # New York: any bracketed text
    ny = maybe(tolerant("N.Y."), r"\s*")
    recompiled = maybe(r",?\s+(?:as\s+)?[Rr]ecompiled\s+", named("recompiled", r"\d{4}"))
    alabama = r"Code(?:\s+of\s+Alabama)?,?\s+"
    state = named("state", one_of(lx.NAMED_CODE_STATES))
    word = r"(?:&|[A-Z][A-Za-z.&']*)"
    triple = r"\d+[A-Z]?-\d+[A-Z]?-\d+[A-Z]?"
    massachusetts = "|".join([tolerant("Mass. Gen. Laws"), r"General\s+Laws", tolerant("M.G.L.A."), tolerant("M.G.L."), tolerant("A.L.M."), tolerant("G.L.")])
    florida = rf"Florida\s+Statutes|{tolerant('Fla. Stat.', True)}"
    dotted = lambda n: r"\.".join([r"\d+"] * n)
    admin = "|".join([
        rf"NMAC\s+{named('nmac', dotted(4) + r'(?:\([A-Z]\))?')}", rf"{named('nmac2', dotted(4) + r'(?:\([A-Z]\))?')}\s+NMAC", rf"OAR\s+{named('oar', r'\d+-\d+-\d+')}",
        rf"COMAR\s+{named('comar', dotted(4) + '[A-Z]?')}", rf"IDAPA\s+{named('idapa', dotted(5))}", rf"{named('arm', dotted(3) + r'(?:\(\d+\))?')},\s+ARM\b",
    ])
    return [
        ("ussg", code_section(rf"(?:{tolerant('U.S.S.G.', True)}|USSG)")),
        ("bankruptcy-code-postfix", rf"{SIGN}\s*{named('body', BODY)}\s+of\s+the\s+Bankruptcy\s+Code"),
        ("bankruptcy-code-prefix", code_section(r"Bankruptcy\s+Code")),
        ("rsa-chapter", rf"\bRSA\s+(?:\[chapter\]|chapter|ch\.?)\s+{named('body', r'\d+(?:-[A-Z])?')}"),
        ("oh-chapter", rf"\b{tolerant('R.C.')}\s+Chapter\s+{named('body', r'\d+')}"),
        ("ors-chapter", rf"\bORS\s+chapter\s+{named('body', r'\d+')}"),
        ("prose", rf"\b[Ss]ection\s+{named('body', rf'\d+[A-Za-z0-9-]*{SUBSECTIONS}')}\s+of\s+title\s+{named('title', r'\d+')}\b"),
        ("ny-cplr-bare", code_section(ny + tolerant("C.P.L.R."), maybe(SIGN), SECTION + supplement)),
        ("ny-acronym-bare", code_section(ny + named("code", "|".join(lx.NY_ACRONYMS)), maybe(SIGN), SECTION + supplement)),
        ("lpra", code_section(tolerant("L.P.R.A."), title="required")),
        ("named-code", rf"\b{named('code', rf'{state}\s+{word}(?:,?\s+{word})*')}\s*{SIGN}\s*{named('body', SECTION + SUBSECTIONS + SUBDIVISION + TO_SUBSECTION + ET_SEQ)}", _virginia),
        ("ny-bare-named-code", code_section(named("code", rf"{one_of(lx.NY_LAWS)}\s+Law"), SIGN, SECTION + supplement)),
        ("mass-chapter", rf"\b{named('code', massachusetts)}\s*(?:ch|c)\b\.?\s*{named('chapter', r'\w+')}{maybe(rf',?\s*{MARK}\s*', named('body', rf'\w+(?:[./-]\w+)*{SUBSECTIONS}{ET_SEQ}'))}"),
        ("chapter-act", rf"\b{named('title', r'\d+')}\s+(?:ILCS|{tolerant('Ill. Comp. Stat.')})\s*(?:Ann\b\.?\s+)?{named('act', r'\d+')}/{named('body', BODY)}"),
        ("ill-rev-stat", rf"\b{tolerant('Ill. Rev. Stat.')},?\s+{year},?\s+[Cc]h(?:ap)?\.\s+{named('title', r'\d+')}[A-Z]?,?\s+pars?\.\s+{named('body', BODY)}"),
        ("rlh", rf"\bRLH\s+{year}\s+§\s+{named('body', BODY)}"),
        ("colorado-prose", rf"\b[Ss]ection\s+{named('body', SECTION + SUBSECTIONS)},?\s+{named('code', one_of(c for s, *cs in lx.STATE_CODES if s == 'CO' for c in cs if c.startswith('Colo')) + r'(?:\s+19\d\d)?')}"),
        ("florida-postfix", section_code(f"(?:{florida})")),
        ("florida-prefix-spelled", rf"\bFlorida\s+Statutes?\s*§?\s*{named('body', BODY)}"),
        ("idaho-postfix", section_code(one_of(["Idaho Code Ann.", "Idaho Code"]))),
        ("mca-postfix", section_code("MCA")),
        ("tca-postfix", section_code(tolerant("T.C.A."))),
        ("rcw-chapter-postfix", rf"\b[Cc]hapter\s+{named('body', dotted(2))}\s+RCW"),
        ("state-admin-code", rf"\b(?:{admin})"),
        ("wi-stats-postfix", section_code(r"(?:Stats|STATS)\.", body=rf"\d+\.\d+[A-Za-z0-9]?{SUBSECTIONS}[A-Za-z0-9]*{ET_SEQ}")),
        ("rrs-1943", section_code(tolerant("R.R.S.") + r"\s+1943" + maybe(r",\s+Reissue\s+", year))),
        ("rigl-1956", rf"\b{tolerant('G.L.')}\s+1956\s*{maybe(r'\(', year, r'\s+Reenactment\)')}\s*,?\s*{SIGN}\s*{named('body', BODY)}"),
        ("md-article-letter", rf"\b{named('code', '|'.join(tolerant(a) for a in lx.MD_ARTICLES))}\s*{SIGN}\s*{named('body', BODY)}"),
        ("minn-st-year-edition", rf"\bMinn\.?\s+St(?:at)?\b\.?\s+{named('year', r'19\d\d')},\s*§\s*{named('body', BODY)}"),
        ("ksa-year-edition", rf"\b{tolerant('K.S.A.')}\s+{year}{maybe(r'\s+', named('edition', r'Supp\b\.?'))}\s+{named('body', COMMA_SECTION + SUBSECTIONS)}"),
        ("ic-year-edition", rf"\bIC\s+{year},\s*{named('body', BODY)}"),
        ("abbreviated-code", code_section(named("code", by_letter(c for _, *cs in lx.STATE_CODES for c in cs)), maybe(named("mark", MARK)), COMMA_SECTION + SUBSECTIONS + TO_SUBSECTION + ET_SEQ, "optional")),
        ("wv-code-1931", rf"\bCode,?{maybe(r'\s+', named('year', '1931'))},\s+{named('body', r'\d+-\d+[A-Z]?-\d+[A-Za-z0-9]?' + rf'(?:\({_LABEL}\))*')}"),
        ("nyc-admin-code", code_section(rf"(?:(?:{tolerant('N.Y.C.')}|NYC)\s+Admin\b\.?\s+Code|New\s+York\s+City\s+Administrative\s+Code)", SIGN, rf"\d+-\d+[A-Za-z0-9]?(?:\({_LABEL}\))*"), _no_longer_number),
        ("ga-pre-1983", rf"\b{named('code', r'Code(?:\s+Ann\b\.?)?')}\s+§\s*{named('body', rf'\d+-\d+[A-Za-z0-9]?(?:\({_LABEL}\))*')}", _no_longer_number),
        ("va-bare-code", rf"\b(?:Virginia\s+)?Code\s+§\s*{named('body', rf'(?:\d+\.\d+-\d+(?:\.\d+)?|\d+-\d+\.\d+)(?:\({_LABEL}\))*')}"),
        ("nm-bare-section", rf"{OPEN}(?:§\s*|[Ss]ection\s+){named('body', triple + rf'(?:\({_LABEL}\)|\[{_LABEL}\])*')}"),
        ("ca-bare-code", rf"\b{named('code', one_of([*lx.CA_CODES, *lx.CA_ALIASES]))},?\s*{SIGN}\s*{named('body', SECTION + SUBSECTIONS + SUBDIVISION + TO_SUBSECTION + ET_SEQ)}"),
        ("ala-code-prefix", rf"\b{alabama}{named('year', '1940')},?\s+T(?:itle|it)?\b\.?\s+{named('title', r'\d+')},?\s+§\s+{named('body', SECTION + SUBSECTIONS)}"),
        ("ala-title-trailer", rf"\bTitle\s+{named('title', r'\d+')},?\s+{MARK}\s+{named('body', SECTION + SUBSECTIONS)},?\s+{alabama}{year}{recompiled}"),
        ("ala-tit-bare", rf"\bTit\.\s+{named('title', r'\d+')},?\s+§\s+{named('body', SECTION + SUBSECTIONS)}{maybe(r',?\s+', alabama, year, recompiled)}"),
    ]


def forms() -> list[tuple]:
    """id, type, regular expression[, accept] of every form by falling priority."""
    statutes = [(i, "statute", r, *rest) for i, r, *rest in _state_codes()]
    journals = [("law-review", "journal", volume_page(named("journal", JOURNAL)), _journal_phrase)]
    return [*_neutral(), *_official(), *_short(), *_rules(), *_secondary(), *_federal_codes(), *_cases(), *_constitutions(), *statutes, *journals]


def pattern(id: str, type: str, regex: str, accept: Callable[[re.Match], bool] | None = None) -> Pattern:
    """A form compiled: ASCII classes, and the literals without which it cannot match."""
    return Pattern(id, type, re.compile(regex, re.ASCII), accept, needles(regex), signs(regex))


@cache
def patterns() -> tuple[Pattern, ...]:
    """All patterns, most specific first; compiled once in each process."""
    return tuple(pattern(*f) for f in forms())


#: What the cleaning chain may turn into something else, so that a text must be cleaned before one can tell: tags, entities,
#: words divided at a line's end, page numbers between lines, and characters other than ASCII and those that stay as they are.
UNCLEAN = r"[<&]|-[ \t]*\r?\n|\n[ \t]*-[ \t]*\d|[^\x00-\x7FÀ-ÖØ-öø-ÿ‐-―‘-„…]"
#: For texts without any of that: what every form's match holds, in the dialect of the JVM. A number before or after a
#: capitalised word, a section mark, or one of the words that forms without such numbers are made of.
SHAPES = (
    r"\d[A-Z]?\s*,?\s+[A-Z]", r"\([A-Z0-9]+\)\s*,?\s+[A-Z]", r"\d-[A-Z]", "§", r"[A-Z][A-Za-z.']*[\s,]*\d", r"\bNo\.\s", r"\bch?\b\.?\s*\w",
    r"(?i:\b(?:id|ibid)\b\s*[.,]|supra|\bconst|amend|amdt|\barts?\b|article|\bformer\s|(?:chapter|procedure|evidence|title|supp)\b\]?\.?\s*\d|\bsec(?:tions?|s)?\b)",
)
#: A text that matches none of this holds no citation; tested in the JVM before Python sees the row.
GATE = "|".join([UNCLEAN, *SHAPES])
#: A part of the gate that most texts with citations pass; far quicker to test than all of it.
FIRST_GATE = SHAPES[0]
