"""The table functions extract_citations(text) and tokenize(text)."""

from __future__ import annotations


class ExtractCitations:
    def eval(self, text: str):
        from ..operators.citations import FIELDS, row_of
        from ..operators.documents import extract

        for c in extract(text)[1]:
            row = row_of(c)
            yield tuple(row.get(n) for n in FIELDS.names)


#: Functions for one type of citation each.
SINGLE = {
    "extract_case": "case", "extract_statute": "statute", "extract_constitutional": "constitutional", "extract_neutral": "neutral", "extract_journal": "journal", "extract_public_law": "publicLaw",
    "extract_federal_register": "federalRegister", "extract_statutes_at_large": "statutesAtLarge", "extract_federal_rule": "federalRule", "extract_restatement": "restatement", "extract_treatise": "treatise", "extract_annotation": "annotation",
}


def of_type(kind: str) -> type:
    """The table function that gives the citations of one type only."""

    class OfType:
        def eval(self, text: str):
            from ..operators.citations import FIELDS, row_of
            from ..operators.documents import Options, extract

            # only short forms are resolved, and none of these types is one
            for c in extract(text, Options(resolve=False))[1]:
                if c["type"] == kind:
                    row = row_of(c)
                    yield tuple(row.get(n) for n in FIELDS.names)

    return OfType


TOKEN = "token string, start int, end int, type string, pattern_id string"


class Tokenize:
    """Candidates of the pattern scan over cleaned text, before parsing; overlapping ones resolved."""

    def eval(self, text: str):
        from ..operators.cleaning import clean_text
        from ..operators.documents import dedup, scan

        for t in dedup(scan(clean_text(text).text)):
            yield t["text"], t["start"], t["end"], t["type"], t["pattern_id"]
