"""The citation engine on single texts."""

import time

import pytest

from juriscope.functions import scalars as s
from juriscope.operators import zones
from juriscope.operators.cleaning import Traced, clean_text, strip_diacritics, strip_emphasis
from juriscope.operators.documents import Options, dedup, extract, scan
from juriscope.operators.patterns import patterns


def cites(text, **options):
    return extract(text, Options(**options))[1]


@pytest.mark.parametrize(
    ("text", "fields"),
    [
        ("Adams v. Baker, 500 F.2d 123 (9th Cir. 2020)", {"type": "case", "volume_num": 500, "reporter": "F.2d", "page": 123, "court": "9th Cir.", "year": 2020, "case_name": "Adams v. Baker", "plaintiff": "Adams", "defendant": "Baker", "confidence": 0.95}),
        ("See Adams v. Baker, 500 F. Supp. 2d 123, 125-27 (D. Mass. Mar. 3, 2004)", {"reporter": "F.Supp.2d", "pincite": 125, "court": "D. Mass.", "year": 2004, "case_name": "Adams v. Baker", "signal": "see"}),
        ("In re Carter, 250 S.W.3d 100 (Tex. 2019)", {"procedural_prefix": "In re", "case_name": "In re Carter", "court": "Tex."}),
        ("Adams v. Baker, 410 U. S. 113 (1973)", {"reporter": "U.S.", "court": "scotus", "year": 1973}),
        ("Adams v. Baker, 5 U.S. (1 Cranch) 137 (1803)", {"page": 137, "nominative_volume": 1, "nominative_reporter": "Cranch"}),
        ("Adams v. Baker, 500 F.3d ___ (9th Cir. 2023)", {"page": None, "has_blank_page": True, "confidence": 0.95}),
        ("75 P.3d 200 (Nev. 2016) (en banc)", {"disposition": "en banc", "court": "Nev."}),
        ("42 U.S.C. § 1983(a)(1)", {"type": "statute", "title": 42, "code": "U.S.C.", "section": "1983", "subsection": "(a)(1)", "jurisdiction": "US", "confidence": 1.0}),
        ("29 C.F.R. § 1910.12(b)", {"type": "regulation", "code": "C.F.R.", "section": "1910.12", "subsection": "(b)"}),
        ("42 U.S.C. § 1983 et seq.", {"section": "1983", "has_et_seq": True}), ("Fla. Stat. § 90.1 (2001)", {"code": "Fla. Stat.", "jurisdiction": "FL", "year": 2001}),
        ("Cal. Penal Code § 148", {"code": "Cal. Penal Code", "jurisdiction": "CA", "section": "148"}), ("2019 WL 55555", {"type": "neutral", "database": "WL", "number": "55555", "confidence": 1.0}),
        ("2011 IL App (1st) 101234", {"type": "neutral", "court": "IL App (1st)", "number": "101234"}), ("101 Yale L.J. 900 (1992)", {"type": "journal", "journal": "Yale L.J.", "page": 900, "year": 1992}),
        ("Pub. L. No. 111-148", {"type": "publicLaw", "congress": 111, "number": "148"}), ("81 Fed. Reg. 12,345 (2016)", {"type": "federalRegister", "page": 12345, "year": 2016}),
        ("U.S. Const. amend. XIV, § 1", {"type": "constitutional", "jurisdiction": "US", "amendment": 14, "section": "1", "confidence": 0.95}), ("the Fifth Amendment", {"amendment": 5, "jurisdiction": "US"}),
        ("Fed. R. Civ. P. 12(b)(6)", {"type": "federalRule", "rule_set": "Fed. R. Civ. P.", "rule": "12", "subsection": "(b)(6)"}), ("Restatement (2d) of Torts § 402A", {"type": "restatement", "edition": "Second", "subject": "Torts", "section": "402A"}),
        ("Adams v. Baker, No. 12-345 (D. Me. 2013)", {"type": "docket", "number": "12-345", "court": "D. Me.", "year": 2013, "case_name": "Adams v. Baker"}), ("10 A.L.R.3d 55", {"type": "annotation", "series": "A.L.R.3d"}),
    ],
)
def test_fields(text, fields):
    c = cites(f"It was said. {text}.")[0]
    assert {k: c.get(k) for k in fields} == fields


def test_parallel_group():
    c = cites("Adams v. Baker, 410 U.S. 113, 93 S. Ct. 705, 35 L. Ed. 2d 147 (1973)")
    assert [x["reporter"] for x in c] == ["U.S.", "S.Ct.", "L.Ed.2d"] and {x["group_id"] for x in c} == {"410-U.S.-113"}
    assert all(x["case_name"] == "Adams v. Baker" and x["year"] == 1973 for x in c)


def test_resolution_chain():
    text = "Adams v. Baker, 500 F.2d 100 (1974). Id. at 105. Carter v. Diaz, 9 F.3d 1 (1993). Adams, 500 F.2d at 110. Baker, supra, at 112. Id."
    c = cites(text)
    assert [(x["type"], (x.get("resolution") or {}).get("resolved_to")) for x in c] == [("case", None), ("id", 0), ("case", None), ("shortFormCase", 0), ("supra", 0), ("id", 0)]
    assert c[-1]["pincite"] == 112 and c[-1]["pincite_inherited_from"] == 4


def test_unresolved():
    assert cites("Id. at 5.")[0]["resolution"]["failure_reason"] == "No preceding citation found"
    assert cites("Adams v. Baker, 500 F.2d 100 (1974). Zorro, supra, at 3.")[1]["resolution"]["failure_reason"] == "No matching party"


def test_scopes():
    text = "Adams v. Baker, 500 F.2d 100 (1974).\n\nId. at 3."
    assert cites(text)[1]["resolution"]["resolved_to"] == 0
    assert cites(text, scope="paragraph")[1]["resolution"]["resolved_to"] is None


def test_history_and_string_cites():
    c = cites("Adams v. Baker, 5 F.3d 1 (1993), aff'd, 510 U.S. 2 (1994).")
    assert c[1]["history_of"] == 0 and c[1]["history_signal"] == "affirmed" and c[1]["case_name"] == "Adams v. Baker"
    c = cites("See Adams v. Baker, 5 F.3d 1 (1993); see also Carter v. Diaz, 6 F.3d 2 (1994).")
    assert [(x["string_group_id"], x["string_group_index"], x["signal"]) for x in c] == [("sc-0", 0, "see"), ("sc-0", 1, "see also")]


def test_nesting_and_exclusion():
    text = "Adams v. Baker, 5 F.3d 1 (1993) (quoting Carter v. Diaz, 6 F.3d 2 (1990))."
    assert cites(text)[1]["nested_in"] == 0
    assert len(cites(text, exclude_parenthetical_children=True)) == 1


def test_generated_rows():
    assert [x["section"] for x in cites("See 42 U.S.C. §§ 1981, 1983 and 1985.")] == ["1981", "1983", "1985"]
    c = cites("Under 42 U.S.C. § 1983 it is so; but § 1988 differs.")
    assert c[1]["code"] == "U.S.C." and c[1]["section"] == "1988" and c[1]["confidence"] == 0.9
    c = cites("Adams v. Baker, 5 F.3d 1 (1993). Later, Adams, at 12, said so.")
    assert c[1]["type"] == "shortFormCase" and c[1]["pincite"] == 12


def test_false_positives():
    assert cites("On 12 May 1999 it rained.") == []
    c = cites("see 200 I.L.M. 300 here")
    assert c[0]["confidence"] == 0.1 and c[0]["warnings"]
    assert cites("see 200 I.L.M. 300 here", remove_false_positives=True) == []


def test_offsets_point_into_the_source():
    source = "<div>See&nbsp;Adams v. Baker,  410 U. S. 113</div><p>and 42 U.S.C. § 1983</p>"
    found = cites(source)
    assert [source[c["source_start"] : c["source_end"]] for c in found] == ["410 U. S. 113", "42 U.S.C. § 1983"]
    for c in found:
        assert 0 <= c["source_start"] < c["source_end"] <= len(source) and c["full_span"][0] <= c["start"] < c["end"] <= c["full_span"][1]


def test_cleaning():
    assert clean_text("a <b>b</b><p>c</p>d &amp; e").text.startswith("a b. c. d & e")
    assert clean_text("re-\nmand 12-\n13").text == "remand 12-13"
    assert clean_text("x — “y” … z­").text == 'x --- "y" ... z'
    doc = Traced("**bold** *12 é")
    strip_emphasis(doc)
    strip_diacritics(doc)
    assert doc.text == "bold *12 e"
    assert clean_text(None).text == "" and extract(None)[1] == [] and extract("")[1] == []


def test_pattern_table():
    ids = [p.id for p in patterns()]
    assert len(ids) == 101 and ids[0].startswith("state-vendor") and ids[-1] == "law-review" and ids.count("supra") == 3


def test_dedup_prefers_the_specific():
    tokens = dedup(scan("100 Harv. L. Rev. 5 and 42 U.S.C. § 1983"))
    assert [t["pattern_id"] for t in tokens] == ["law-review", "usc"]


@pytest.mark.parametrize("text", ["1" * 3000, "A. " * 1500, "(" * 3000, "500 F.2d " * 400, "v. " * 1000, "§ " * 1500, "Id. at " * 400, "12 A" + " B" * 800])
def test_bad_inputs_are_fast(text):
    patterns()
    began = time.time()
    extract(text)
    assert time.time() - began < 0.5


def test_zones():
    text = 'He said "it is so." Adams v. Baker, 5 F.3d 1 (1993).'
    assert zones.attribute_quotes(text, cites(text))[0]["kind"] == "inline"
    assert zones.footnotes("a<footnote>1 x</footnote>b")[0]["number"] == 1
    assert [z["number"] for z in zones.footnotes("text " * 20 + "\n__________\n1. one\n2. two\n")] == [1, 2]
    marked, skipped, moved = zones.annotate(text, cites(text), "[", "]")
    assert "[5 F.3d 1]" in marked and skipped == []
    assert zones.prose(text, cites(text))[0]["start"] == 0


def test_scalars():
    assert s.parse_pincite("123-25 n.4") == {"page": 123, "end_page": 125, "footnote": 4, "star": False, "paragraph": None, "raw": "123-25 n.4"}
    assert s.parse_pincite("¶ 12")["paragraph"] == 12 and s.parse_pincite("*5")["star"] and s.parse_pincite("x") is None
    assert s.parse_date("Jan. 5, 2020")["iso"] == "2020-01-05" and s.parse_date("1/2/98")["year"] == 1998
    assert s.parse_date("Feb. 31, 2020")["iso"] == "2020-02" and s.parse_date("none") is None
    assert s.normalize_party("The Acme Co., Inc., et al.") == "acme" and s.levenshtein("kitten", "sitting") == 3
    assert s.roman("XIV") == 14 and s.to_roman(14) == "XIV" and s.content_hash("a") == s.content_hash("a") != s.content_hash("b")
    assert s.bluebook(cites("Adams v. Baker, 500 F.2d 123 (9th Cir. 2020)")[0]) == "Adams v. Baker, 500 F.2d 123 (9th Cir. 2020)"


def test_annotation_keeps_tags_whole():
    one = {"cite_idx": 0, "confidence": 0.9, "source_start": 2, "source_end": 9}
    text = 'a <b class="x">5 U.S. 1</b> & c'
    marked, skipped, moved = zones.annotate(text, [one | {"source_start": 15, "source_end": 25}], "{", "}", escape=False)
    assert marked == 'a <b class="x">{5 U.S. 1</b>} & c' and not skipped
    assert moved == [{"cite_idx": 0, "start": 15, "end": 27, "new_start": 15, "new_end": 29}]
    assert zones.annotate(text, [one | {"source_start": 5, "source_end": 10}]) == (text, [0], [])
    assert zones.annotate("x < 5 & 6", [one | {"source_start": 2, "source_end": 7}])[0] == "x <cite>&lt; 5 &amp;</cite> 6"
    seen = []
    assert zones.annotate("see 5 U.S. 1.", [one | {"source_start": 4, "source_end": 12}], callback=lambda c, around: seen.append(around) or "#")[0] == "see #."
    assert seen == ["see 5 U.S. 1."]
