"""Properties of the engine: the gate, the forms' literals, the resolver's tables, growth with the text."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from juriscope.operators import lexicon as lx
from juriscope.operators.documents import Cover, Options, dedup, extract
from juriscope.operators.patterns import GATE, outline, patterns

GATED = re.compile(GATE, re.ASCII)


@pytest.mark.parametrize("form", patterns(), ids=lambda p: p.id)
def test_gate_and_needles_keep_every_match(form):
    """Whatever a form matches passes the gate and holds one of the form's literals."""

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck), database=None)
    @given(st.from_regex(form.regex))
    def check(text):
        m = form.regex.search(text)
        if m is not None:
            assert not form.needles or any(n in m[0].lower() for n in form.needles)
            # a list of ordinals is looked ahead, so the whole text counts
            assert GATED.search(text)

    check()


@pytest.mark.parametrize("form", [p for p in patterns() if p.signs], ids=lambda p: p.id)
def test_signs_keep_every_match(form):
    """Whatever a form matches, alone or in a text, has one of the form's signs in its outline."""

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck), database=None)
    @given(st.from_regex(form.regex))
    def check(text):
        for x in (text, f"See {text}; so", text.replace(" ", "\n \t")):
            if form.regex.search(x) is not None:
                shape = outline(x.lower())
                assert any(s in shape for s in form.signs)

    check()


SENTENCES = (
    "Adams v. Baker, 500 F.2d 100 (1974).", "Id. at 105.", "See 42 U.S.C. § 1983.", "Baker, supra, at 112.", "under section 5 of title 18 it is", "the Fourteenth Amendment", "U.S. Const. art. I, § 8", "Mass. Gen. Laws c. 93A", "Ibid.",
    "supra Part II", "Rule 12, SCACR", "2019 WL 55555", "Fed. R. Civ. P. 12(b)(6)", "article 12 of the Massachusetts Declaration of Rights", "Pub. L. No. 111-148", "Canon 3", "CPLR 3211", "chapter 49.60 RCW",
)


@pytest.mark.parametrize("text", SENTENCES)
def test_gate_sees_through_markup(text):
    """A citation in a marked-up text passes the gate, whatever the markup does to its words."""
    wrapped = [text, f"<p>{text}</p>", text.replace(" ", "&nbsp;"), f"<em>{text[:3]}</em>{text[3:]}", text.replace("§", "&sect;"), text[0] + "-\n" + text[1:], text.replace(" ", "\n"), text.replace(" ", " "), "﻿" + text]
    for x in wrapped:
        if extract(x)[1]:
            assert GATED.search(x), x


def test_gate_stops_plain_prose():
    for text in ("there is nothing to see here", "we met in 1990 and again later, at noon", "", "he said: yes, 12 of them were there"):
        assert not GATED.search(text) and not extract(text)[1]


def test_supra_by_section_and_part():
    c = extract("As in supra § 3 and supra Part II here.")[1]
    assert [(x["type"], x["section"]) for x in c] == [("supra", "3"), ("supra", "Part II")]


@pytest.mark.parametrize(("text", "code", "state", "section"), [("R. C. 713.15", "R.C.", "OH", "713.15"), ("Colorado Revised Statutes Annotated § 13-1-2", "Colorado Revised Statutes Annotated", "CO", "13-1-2"), ("Water Code § 13000", "Water Code", "CA", "13000"), ("75 P. S. § 1037", "P.S.", "PA", "1037"), ("Health & Safety Code § 12", "Health & Saf. Code", "CA", "12")])
def test_code_spellings(text, code, state, section):
    c = extract(f"See {text}.")[1][0]
    assert (c["code"], c["jurisdiction"], c["section"]) == (code, state, section)


def test_no_subsection_from_publishers():
    for text in ("42 U.S.C. § 1983 (West)", "42 U.S.C. § 1983 (Supp. III)", "42 U.S.C. § 1983 (West 2010)"):
        assert extract(text)[1][0].get("subsection") is None


def test_numero_sign_is_no_docket():
    assert extract("№ 5 (D. Me. 2013)")[1] == []


def test_reporter_spacing():
    assert extract("123 Ill. App. 3d 456 (1984)")[1][0]["reporter"] == "Ill. App. 3d"
    assert extract("725 F. 2d 1091 (B.A.P. 9th Cir. 1984)")[1][0]["court"] == "B.A.P. 9th Cir."


def test_small_volume_in_prose():
    c = extract("2 In July 5 it rained")[1]
    assert all(x["warnings"] or x["confidence"] <= 0.4 for x in c)


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12), st.integers(0, 6)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_dedup_against_pairs(spans):
    """The sweep against all pairs of tokens."""
    tokens = [{"start": a, "end": a + n, "priority": p, "nth": k} for k, (a, n, p) in enumerate(spans)]
    kept = []
    for t in sorted(tokens, key=lambda t: (t["start"], -t["end"], t["priority"])):
        if not any(o["start"] <= t["start"] and t["end"] <= o["end"] and (o["priority"] < t["priority"] or o["priority"] == t["priority"] and o["end"] - o["start"] > t["end"] - t["start"]) for o in kept):
            kept.append(t)
    accepted = []
    for t in sorted(kept, key=lambda t: (t["priority"], t["start"])):
        if not any(o["priority"] < t["priority"] and o["start"] < t["end"] and t["start"] < o["end"] for o in accepted):
            accepted.append(t)
    assert sorted(t["nth"] for t in dedup(tokens)) == sorted(t["nth"] for t in accepted)


def test_cover():
    c = Cover([(5, 9), (1, 3), (8, 12)])
    assert [c.meets(*x) for x in ((3, 5), (2, 3), (11, 13), (12, 20), (0, 1))] == [False, True, True, False, False]


NAMES = ("Adams", "Baker", "Carter", "Diaz", "Smith", "Smyth")


def _random_text(rng):
    a, b = rng.choice(NAMES), rng.choice(NAMES)
    v, p, r = rng.randint(1, 2), rng.randint(100, 102), rng.choice(("F.2d", "U.S."))
    return rng.choice((f"{a} v. {b}, {v} {r} {p} (199{rng.randint(0, 2)}). ", "Id. at 105. ", "Id. ", "42 U.S.C. § 1983. ", f"{a}, supra, at 12. ", f"{a}, {v} {r} at {p}. ", "(Id. at 7.) ", "\n\n", "Id. § 5. "))


def _slow_resolution(cites, scope):
    """resolved_to of Id. and of short forms by walking back over all earlier citations."""
    from juriscope.operators.resolver import _FAMILY, _SHORT, _reporter

    out = {}
    full = lambda j: j if cites[j]["type"] not in _SHORT else out.get(j, cites[j]["resolution"]["resolved_to"])
    aside = lambda j: cites[j]["aside"]
    for k, c in enumerate(cites):
        if c["type"] == "id":
            family = "statute" if c.get("section") else "case" if c["own_pin"] else None
            best = None
            for j in range(k - 1, -1, -1):
                if aside(j) and not aside(k) or scope[j] != scope[k]:
                    continue
                t = full(j)
                if t is None:
                    break
                fits = family is None or _FAMILY.get(cites[t]["type"]) == family
                best = t if best is None or fits else best
                if fits:
                    break
            out[k] = best
        elif c["type"] == "shortFormCase":
            fits = [j for j in range(k) if cites[j]["type"] == "case" and _reporter(cites[j]) == _reporter(c) and scope[j] == scope[k]]
            named = [j for j in fits if c.get("party_norm") and any(c["party_norm"] in (x or "") for x in (cites[j].get("plaintiff_norm"), cites[j].get("defendant_norm")))]
            out[k] = max(named or fits, default=None)
    return out


@pytest.mark.parametrize("kind", ["none", "paragraph"])
def test_resolution_against_walking_back(kind):
    rng = random.Random(7)
    for _ in range(150):
        text = "".join(_random_text(rng) for _ in range(rng.randint(2, 25)))
        cites = extract(text, Options(scope=kind))[1]
        for c in cites:
            c["aside"] = text[: c["source_start"]].rsplit("\n", 1)[-1].count("(") > text[: c["source_start"]].rsplit("\n", 1)[-1].count(")")
            c["own_pin"] = c.get("pincite") is not None and c.get("pincite_inherited_from") is None
        scope = [text[: c["source_start"]].count("\n\n") if kind == "paragraph" else 0 for c in cites]
        want = _slow_resolution(cites, scope)
        assert {k: cites[k]["resolution"]["resolved_to"] for k in want} == want, text


def test_id_chained_by_position():
    c = extract("Zorro, supra, at 3. Id.")[1]
    assert c[1]["resolution"]["resolved_to"] is None and c[1]["resolution"]["antecedent"] == 0 and c[1]["resolution"]["confidence"] == 0.7


def test_work_grows_with_the_text():
    """Ten times the text takes about ten times as long, not a hundred times."""
    base = "The court decided Smith v. Jones, 500 F.2d 123, 125 (9th Cir. 1995) (quoting Roe v. Poe, 5 F.3d 6 (1990)). See 42 U.S.C. § 1983; Id. at 126. Smith, supra, at 4. Jones, at 5. Id. "

    def took(n):
        began = time.perf_counter()
        extract(base * n)
        return time.perf_counter() - began

    took(10)
    assert took(600) < 25 * max(min(took(60), took(60)), 0.02)


def test_reporters_and_codes():
    assert lx.find_reporter("f. 2nd")[0] == "F.2d" and lx.find_reporter("Zzz.") is None
    assert lx.find_named_code("CA", "Civ. Proc. Code") == "CCP" and lx.find_named_code("NY", "Unknown") is None
    assert len(lx.HISTORY) == 38
