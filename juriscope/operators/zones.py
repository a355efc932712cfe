"""Zones of a document: footnotes, quotations, paragraphs, brackets; quotes attributed to citations; prose between them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

_TAG_NOTE = re.compile(r"<(footnote|fn)\b[^>]*>|<(\w+)\b[^>]*\b(?:class|id)\s*=\s*[\"'][^\"']*\b(?:footnote|fn)[^\"']*[\"'][^>]*>", re.I)
_LABEL = re.compile(r"(?:label|id)\s*=\s*[\"']\D*(\d+)", re.I)
_RULE = re.compile(r"^[ \t]*[_\-—*]{5,}[ \t]*$", re.M)
_MARKER = re.compile(r"^[ \t]*(?:FN\s*(\d+)\.?|\[(\d+)\]|\^?(\d+)[.)]|n\.?\s*(\d+)\b)\s+", re.M)


def footnotes(source: str) -> list[dict]:
    """start, end, number of footnotes in source offsets: marked up, else below a rule of dashes."""
    out = []
    if "<" in source:
        nth = 0
        for m in _TAG_NOTE.finditer(source):
            if out and m.start() < out[-1]["end"]:
                continue
            tag = m[1] or m[2]
            depth, end = 1, len(source)
            for t in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(source, m.end()):
                depth += -1 if t[1] else 1
                if depth == 0:
                    end = t.end()
                    break
            nth += 1
            label = _LABEL.search(m[0]) or re.match(r"\s*(?:<[^>]+>\s*)*(\d+)", source[m.end() : end])
            out.append({"start": m.start(), "end": end, "number": int(label[1]) if label else nth})
        if out:
            return out
    for rule in _RULE.finditer(source):
        if len(rule[0].strip()) < 8 and rule.start() < len(source) / 4:
            continue
        marks = list(_MARKER.finditer(source, rule.end()))
        for a, b in zip(marks, marks[1:] + [None], strict=True):
            out.append({"start": a.start(), "end": b.start() if b else len(source), "number": int(next(x for x in a.groups() if x))})
        break
    return out


def zone_numbers(zones: list[dict], places: list[int]) -> list[int | None]:
    """The number of the first zone that holds each place; zones in order of their starts."""
    starts, reach = [z["start"] for z in zones], []
    for z in zones:  # how far the zones up to here reach, so that a search can stop
        reach.append(max(z["end"], reach[-1] if reach else 0))
    out: list[int | None] = []
    for place in places:
        k, found = bisect_right(starts, place) - 1, None
        while k >= 0 and reach[k] > place:
            if zones[k]["end"] > place:
                found = zones[k]["number"]
            k -= 1
        out.append(found)
    return out


_QUOTE = re.compile(r"\"[^\"\n]{1,600}\"|“[^”\n]{1,600}”")
_BLOCK = re.compile(r"(?:^>[^\n]*(?:\n|\Z))+", re.M)


def quotations(text: str) -> list[dict]:
    """start, end, block of quoted passages."""
    out = [{"start": m.start(), "end": m.end(), "block": True} for m in _BLOCK.finditer(text)]
    inside = zone_numbers([b | {"number": 1} for b in out], [m.start() for m in _QUOTE.finditer(text)])
    out += [{"start": m.start(), "end": m.end(), "block": False} for m, blocked in zip(_QUOTE.finditer(text), inside, strict=True) if not blocked]
    return sorted(out, key=lambda z: z["start"])


_DEPTH = re.compile(r"[()\[\]\n]")


def depths(text: str, places: list[int]) -> list[int]:
    """How many brackets are open at each place (ascending); a sentence end outside brackets resets."""
    out, depth, at = [], 0, 0
    for place in places:
        for ch in _DEPTH.findall(text, at, place):
            if ch in "([":
                depth += 1
            elif ch in ")]":
                depth = max(0, depth - 1)
            elif ch == "\n":
                depth = 0
        at = place
        out.append(depth)
    return out


def paragraphs(source: str, pattern: str) -> list[int]:
    """The offsets at which paragraphs after the first begin."""
    return [m.end() for m in re.finditer(pattern, source)]


def attribute_quotes(text: str, cites: list[dict]) -> list[dict]:
    """Each quotation with the citation that follows it closely, and how sure that is."""
    out = []
    starts = [c["start"] for c in cites]
    holes = sorted((p["start"], p["end"], k) for k, c in enumerate(cites) for p in c.get("parentheticals") or [])
    around: list[tuple[int, int, int]] = []
    at = 0
    for q in quotations(text):
        after = bisect_left(starts, q["end"])
        follow = cites[after] if after < len(cites) else None
        while at < len(holes) and holes[at][0] <= q["start"]:
            around.append(holes[at])
            at += 1
        around = [h for h in around if h[1] > q["start"]]
        owner = min((h[2] for h in around if q["end"] <= h[1]), default=None)
        inside = None if owner is None else cites[owner]
        long = q["block"] or len(text[q["start"] : q["end"]].split()) >= 50
        row = {"start": q["start"], "end": q["end"], "cite_idx": None, "confidence": None, "kind": "unattributed"}
        gap = follow["start"] - q["end"] if follow else None
        if inside is not None:
            row |= {"cite_idx": inside["cite_idx"], "confidence": 0.95, "kind": "parenthetical"}
        elif follow is not None and long and gap <= 200:
            row |= {"cite_idx": follow["cite_idx"], "confidence": 0.98 if gap < 50 else 0.9, "kind": "block"}
        elif follow is not None and not long and gap <= 100 and not re.search(r"[.!?]\s+(?=[A-Z])(?!See\b|Id\b|Cf\b)[A-Z][a-z]+\s+[a-z]", text[q["end"] : follow["start"]]):
            row |= {"cite_idx": follow["cite_idx"], "confidence": 0.85, "kind": "inline"}
        out.append(row)
    return out


def prose(text: str, cites: list[dict]) -> list[dict]:
    """The stretches of text between citations (by full span)."""
    out, cursor = [], 0
    for c in cites:
        a, b = c["full_span"]
        if a > cursor:
            out.append({"start": cursor, "end": a, "before": c["cite_idx"]})
        cursor = max(cursor, b)
    if cursor < len(text):
        out.append({"start": cursor, "end": len(text), "before": None})
    return out


# fixed values: characters that annotation escapes in quoted text
_ESCAPES = str.maketrans({"<": "&lt;", ">": "&gt;", "&": "&amp;", '"': "&quot;", "'": "&#39;", "/": "&#x2F;"})
_TAG = re.compile(r"<(?=[A-Za-z!/])[^>]*>?")
#: Characters on either side of a citation that a callback sees.
_SURROUNDING = 30


def _outside_tags(a: int, b: int, starts: list[int], ends: list[int]) -> tuple[int, int] | None:
    """The span widened so that no tag is split; None where one tag holds all of it."""
    i, j = bisect_right(starts, a - 1) - 1, bisect_right(starts, b - 1) - 1
    in_a, in_b = i >= 0 and a < ends[i], j >= 0 and b < ends[j]
    if in_a and in_b and i == j or a >= b:
        return None
    return starts[i] if in_a else a, ends[j] if in_b else b


def annotate(text: str, cites: list[dict], before: str = "<cite>", after: str = "</cite>", callback=None, escape: bool = True, span: tuple[str, str] = ("source_start", "source_end")) -> tuple[str, list[int], list[dict]]:
    """text with each citation wrapped; containers win, then higher confidence.

    callback(citation, surrounding text) replaces the citation where it is given; otherwise the
    citation stands, escaped for HTML, between before and after. No tag is split: spans widen to
    whole tags, and a citation inside one tag is skipped. span names the fields of the position.
    Also the skipped citations, and where each annotated one was and is (cite_idx, start, end, new_start, new_end).
    """
    tags = [m.span() for m in _TAG.finditer(text)]
    starts, ends = [t[0] for t in tags], [t[1] for t in tags]
    kept, skipped = [], []
    spans = [(_outside_tags(c[span[0]], c[span[1]], starts, ends), c) for c in cites]
    skipped += [c["cite_idx"] for s, c in spans if s is None]
    for s, c in sorted(((s, c) for s, c in spans if s is not None), key=lambda x: (x[0][0], -x[0][1])):
        if kept and s[0] < kept[-1][0][1]:
            if s[1] > kept[-1][0][1] and c["confidence"] > kept[-1][1]["confidence"]:
                skipped.append(kept.pop()[1]["cite_idx"])
            else:
                skipped.append(c["cite_idx"])
                continue
        kept.append((s, c))
    out, moved, at, length = [], [], 0, 0
    for (a, b), c in kept:
        quoted = text[a:b]
        mark = callback(c, text[max(0, a - _SURROUNDING) : b + _SURROUNDING]) if callback else before + (quoted.translate(_ESCAPES) if escape else quoted) + after
        out += [text[at:a], mark]
        length += a - at
        moved.append({"cite_idx": c["cite_idx"], "start": a, "end": b, "new_start": length, "new_end": length + len(mark)})
        length += len(mark)
        at = b
    return "".join(out) + text[at:], sorted(skipped), moved
