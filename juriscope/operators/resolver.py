"""Short forms to the authorities they mean: one forward pass over a document's citations."""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

from ..functions.scalars import levenshtein, normalize_party
from .zones import depths, footnotes, paragraphs, zone_numbers

#: A caption in running text, from which an unmatched short form takes its name.
_SIDE = r"[A-Z][\w.'&/-]*(?:\s+(?:of\s+|the\s+|&\s+)*[A-Z][\w.'&/-]*)*"
_PROSE_CAPTION = re.compile(rf"\b({_SIDE})\s+vs?\.\s+({_SIDE})")
_LEADING_SIGNAL = re.compile(r"(?:In(?!\s+re\b)|See(?:\s+also)?|Compare|But(?:\s+see)?|Cf\.?|Also)\s+", re.I)
_SHORT = ("id", "supra", "shortFormCase")
_FAMILY = {"case": "case", "docket": "case", "neutral": "case", "statute": "statute", "regulation": "statute", "constitutional": "statute"}


def similarity(a: str, b: str) -> float:
    if a == b:
        return 1.0
    longest = max(len(a), len(b))
    if longest == 0 or abs(len(a) - len(b)) > longest * 0.5:
        return 0.0
    return 1 - (_edits(a, b) if longest <= 64 else levenshtein(a, b)) / longest


_edits = lru_cache(maxsize=1 << 14)(levenshtein)
_CAPITALIZED = re.compile(r"\b[A-Z][a-z]{3,}\b")
_NAME_PARTS = re.compile(r"[A-Z][a-z]{3,}")
_SIDES = re.compile(r"\s+vs?\.?\s+")
_A_VERSUS = re.compile(r"\bv\.\s")


def _authority(c: dict) -> str:
    return c.get("group_id") or f"{c.get('volume')}-{c.get('reporter')}-{c.get('page')}"


def _prose_captions(text: str, c: dict) -> list[tuple[str, str]]:
    """Plaintiff and defendant of the captions before a short form; only those that have its party, where it names one."""
    sides = [(m[1][s.end() :] if (s := _LEADING_SIGNAL.match(m[1])) else m[1], m[2]) for m in _PROSE_CAPTION.finditer(text, max(0, c["start"] - 400), c["start"])]
    party = normalize_party(c.get("party_name"))
    if not party:
        return sides
    return [s for s in sides if any(x and (x in party or party in x) for x in map(normalize_party, s))]


class _Recent:
    """The authorities that an Id. may mean at one level of a scope: the nearest, and the nearest of each family.

    An unresolved short form hides what stands before it.
    """

    def __init__(self):
        self.nearest: dict[str | None, int] = {}

    def see(self, target: int, family: str | None) -> None:
        self.nearest[None] = target
        if family:
            self.nearest[family] = target

    def hide(self) -> None:
        self.nearest.clear()

    def best(self, family: str | None) -> int | None:
        return self.nearest.get(family, self.nearest.get(None))


class _Parties:
    """Case citations of a scope by party name; close names are found once for each name asked for."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.by_name: dict[str, dict[str, int]] = {}  # name: authority: its first citation with that name
        self.by_length: dict[int, list[str]] = {}
        self.asked: dict[str, tuple[int, dict[str, float]]] = {}
        self.order: list[str] = []

    def add(self, name: str, authority: str, k: int) -> None:
        if name not in self.by_name:
            self.by_name[name] = {}
            self.by_length.setdefault(len(name), []).append(name)
            self.order.append(name)
        self.by_name[name].setdefault(authority, k)

    def close(self, name: str) -> dict[str, float]:
        """Known names with a similarity of at least the threshold."""
        seen, found = self.asked.get(name, (0, {}))
        if seen < len(self.order):
            longest = len(name) / max(self.threshold, 0.01)
            for other in self.order[seen:]:
                if len(other) <= longest and len(other) >= len(name) * self.threshold:
                    score = similarity(name, other)
                    if score >= self.threshold:
                        found[other] = score
            self.asked[name] = (len(self.order), found)
        return found

    def authorities(self, sides: list[str]) -> dict[str, tuple[int, float]]:
        """authority: its first matching citation and the worst side's best score."""
        out: dict[str, tuple[int, float]] | None = None
        for side in sides:
            here: dict[str, tuple[int, float]] = {}
            for name, score in self.close(side).items():
                for authority, k in self.by_name[name].items():
                    j, old = here.get(authority, (k, 0.0))
                    here[authority] = (min(j, k), max(old, score))
            out = here if out is None else {a: (max(out[a][0], k), min(out[a][1], score)) for a, (k, score) in here.items() if a in out}
        return out or {}


@lru_cache(maxsize=1 << 14)
def _plain(reporter: str) -> str:
    return re.sub(r"[\s.]", "", reporter).lower()


def _reporter(c: dict) -> tuple:
    return c["volume"], _plain(c["reporter"])


def resolve(cites: list[dict], text: str, source: str, options) -> None:
    """Adds ``resolution`` to every short form: resolved_to (cite_idx), confidence, failure, warnings.

    One pass; what a short form may mean is kept in tables by scope, so the work grows with the text.
    """
    depth = depths(text, [c["start"] for c in cites])
    places = [c["source_start"] for c in cites]
    if options.scope == "footnote":
        scope = [n or 0 for n in zone_numbers(footnotes(source), places)]
    elif options.scope in ("paragraph", "section"):
        edges = paragraphs(source, options.paragraph_pattern)
        scope = [bisect_right(edges, x) for x in places]
    else:
        scope = [0] * len(cites)
    target: list[int | None] = [None] * len(cites)
    main: dict[int, _Recent] = {}
    every: dict[int, _Recent] = {}
    parties: dict[int, _Parties] = {}
    volumes: dict[tuple, dict[tuple, int]] = {}  # scope, volume, reporter: (plaintiff, defendant): last citation
    full_before = False
    previous: dict[tuple[int, bool], int] = {}  # the last citation of a scope, and the last that is no aside
    # the body's citations can be seen from footnotes
    reach = lambda k: (scope[k], 0) if options.scope == "footnote" and scope[k] else (scope[k],)

    for k, c in enumerate(cites):
        aside = depth[k] > 0 or c.get("nested_in") is not None
        here, mains = every.setdefault(scope[k], _Recent()), main.setdefault(scope[k], _Recent())
        predecessor = previous.get((scope[k], aside))
        previous[scope[k], True] = k
        if not aside:
            previous[scope[k], False] = k
        if c["type"] not in _SHORT:
            target[k] = k
            full_before = True
            if not c.get("parallel_secondary"):
                family = _FAMILY.get(c["type"])
                here.see(k, family)
                if not aside:
                    mains.see(k, family)
                if c["type"] == "case":
                    known = parties.setdefault(scope[k], _Parties(options.party_threshold))
                    for name in {x for x in (c.get("plaintiff_norm"), c.get("defendant_norm")) if x}:
                        known.add(name, _authority(c), k)
            if c["type"] == "case":
                same = volumes.setdefault((scope[k], *_reporter(c)), {})
                pair = (c.get("plaintiff_norm"), c.get("defendant_norm"))
                same.pop(pair, None)  # the last place of a dict is the latest citation
                same[pair] = k
            continue
        found, confidence, failure, warnings, chained = None, 0.0, None, [], None
        if c["type"] == "id":
            family = "statute" if c.get("section") else "case" if c.get("pincite") is not None else None
            best = (here if aside else mains).best(family)
            if best is not None:
                found, confidence = best, 1.0
                before = text[max(0, c["start"] - 80) : c["start"]]
                called = set(_CAPITALIZED.findall(before.rsplit(". ", 1)[-1])) if "v." in before else ()
                names = set(_NAME_PARTS.findall(cites[found].get("case_name") or "")) if called else ()
                if called and names and _A_VERSUS.search(before) and not called & names:
                    confidence, warnings = 0.75, ["the names before it are not of its antecedent"]
            elif predecessor is not None:
                # what it means is not known, but where it points is
                chained, warnings = predecessor, ["chained to the citation before it by position only"]
            else:
                failure = "Antecedent citation outside scope boundary" if full_before else "No preceding citation found"
            if options.id_confidence_floor is not None and found is not None and confidence < options.id_confidence_floor:
                found, failure = None, "Below the confidence floor"
            if found is not None and cites[found]["type"] == "case":
                for key in ("case_name", "plaintiff", "defendant"):
                    c[key] = cites[found].get(key)
        elif c["type"] == "supra":
            name = c.get("party_name")
            if name:
                sides = [x for x in (normalize_party(x) for x in _SIDES.split(name)) if x]
                hits: dict[str, tuple[int, float]] = {}
                for z in reach(k):
                    if z in parties and sides:
                        for authority, hit in parties[z].authorities(sides).items():
                            hits[authority] = min(hits.get(authority, hit), hit, key=lambda h: (-h[1], h[0]))
                if hits:
                    top = max(score for _, score in hits.values())
                    best_hits = [j for j, score in hits.values() if score == top]
                    if len(best_hits) == 1:
                        found, confidence = best_hits[0], top
                    elif len({cites[j].get("year") for j in best_hits}) > 1:
                        found = max(best_hits, key=lambda j: (cites[j].get("year") or 0, j))
                        confidence, warnings = min(0.5, top), ["several authorities match; the latest is taken"]
                    else:
                        failure = "Several authorities match"
                else:
                    failure = "No matching party"
        else:
            fits = {pair: j for z in reach(k)[::-1] for pair, j in volumes.get((z, *_reporter(c)), {}).items()}
            party = c.get("party_norm")
            own = [j for pair, j in fits.items() if party and any(x and party in x for x in pair)]
            if own:
                found, confidence = max(own), 0.98
            elif fits:
                found, confidence = max(fits.values()), 0.95
            else:
                failure = "No full citation with this volume and reporter"
                prose = _prose_captions(text, c)
                if prose:
                    c["plaintiff"], c["defendant"] = prose[-1]
                    c["case_name"] = " v. ".join(prose[-1])
        target[k] = found
        for recent in (here,) if aside else (here, mains):
            if found is None:
                recent.hide()
            else:
                recent.see(found, _FAMILY.get(cites[found]["type"]))
        if c["type"] != "supra" or c.get("party_name"):
            c["resolution"] = {"resolved_to": cites[found]["cite_idx"] if found is not None else None, "confidence": confidence if found is not None else 0.7 if chained is not None else None, "failure_reason": failure, "warnings": warnings, "antecedent": None if chained is None else cites[chained]["cite_idx"]}
    _inherit_pincites(cites, target, depth)


def _inherit_pincites(cites: list[dict], target: list[int | None], depth: list[int]) -> None:
    """A short form without pincite takes the last numeric one in its unbroken run of the same authority."""
    fruitless: set[int] = set()  # short forms whose run has no pincite
    for k, c in enumerate(cites):
        if c["type"] not in _SHORT or c.get("pincite") is not None or target[k] is None or cites[target[k]]["type"] not in ("case", "journal", "neutral"):
            continue
        fruitless.add(k)
        for j in range(k - 1, -1, -1):
            if depth[j] > depth[k] or cites[j].get("parallel_secondary"):
                continue
            if target[j] != target[k] or j in fruitless and depth[j] == depth[k]:
                break
            if cites[j].get("pincite") is not None:
                c["pincite"], c["pincite_inherited_from"] = cites[j]["pincite"], cites[j]["cite_idx"]
                fruitless.discard(k)
                break
