"""Registered queries of the citation engine and their SQL oracles.

The supplied tables hold no legal text, so most queries render it from numeric columns, run the
engine over every row, and are compared with plain arithmetic on the same columns.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import register
from ..operators import citations as c
from ..operators import lexicon as lx
from ..operators.cleaning import clean_column, strip_html_column
from ..operators.documents import Options
from ..sources import readers
from ..streaming import citations as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def stored(cites: DataFrame) -> DataFrame:
    """Citations that several views read: extracted once, kept by the executors, extracted again only where one is lost."""
    return cites.persist(StorageLevel.MEMORY_AND_DISK)


# the numbers from which texts are rendered; the same expressions in Spark SQL and DuckDB
VOLUME, PAGE = "(o_orderkey % 900 + 1)", "(o_orderkey % 1500 + 1)"
REPORTERS = ("U.S.", "F.2d", "F.3d", "F.Supp.2d", "P.2d", "N.E.2d")
REPORTER = "CASE o_custkey % 6 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REPORTERS)) + " END"
YEAR = "year(o_orderdate)"
COURT = "CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 4 THEN 'Cal.' WHEN 5 THEN 'Ohio' ELSE '9th Cir.' END"
NAMES = ("Smith", "Jones", "Acme Corp.", "Brown", "Garcia", "Miller", "Davis", "Wilson")
NAME = "CASE {0} % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
PLAINTIFF, DEFENDANT = NAME.format("o_orderkey"), NAME.format("(o_custkey + 3)")
CITE = f"concat({VOLUME}, ' ', {REPORTER}, ' ', {PAGE})"
PAREN = f"concat('(', CASE WHEN {COURT} IS NULL THEN '' ELSE concat({COURT}, ' ') END, {YEAR}, ')')"
FULL = f"concat({PLAINTIFF}, ' v. ', {DEFENDANT}, ', ', {CITE}, ' ', {PAREN})"


def rendered(spark: SparkSession, sf_dir: str, text: str, table: str = "orders", key: str = "o_orderkey") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"CAST({key} AS BIGINT) AS doc_id", f"{text} AS text")


def cases(spark: SparkSession, sf_dir: str, options: Options = Options(), fields=None) -> DataFrame:
    return c.extract_citations(rendered(spark, sf_dir, f"concat('The court decided ', {FULL}, '. The rest followed.')"), options, fields=fields)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each reporter over all rendered opinions."""
    return c.reporter_summary(cases(spark, sf_dir, fields=("type", "reporter", "year", "first_of_reporter")))


query("reporter_summary", f"SELECT {REPORTER} AS reporter, count(*) AS cites, count(DISTINCT o_orderkey) AS documents, CAST(min({YEAR}) AS INTEGER) AS first_year, CAST(max({YEAR}) AS INTEGER) AS last_year FROM orders GROUP BY 1")(flagship)


@query("case_core", f"SELECT o_orderkey AS doc_id, CAST({VOLUME} AS BIGINT) AS volume_num, {REPORTER} AS reporter, CAST({PAGE} AS BIGINT) AS page, CAST({YEAR} AS INTEGER) AS year, coalesce({COURT}, 'scotus') AS court FROM orders")
def case_core(spark, sf_dir):
    return cases(spark, sf_dir).filter("type = 'case'").select("doc_id", "volume_num", "reporter", "page", "year", "court")


@query("case_confidence", "SELECT o_orderkey AS doc_id, CAST(95 AS INTEGER) AS hundredths FROM orders")
def case_confidence(spark, sf_dir):
    return cases(spark, sf_dir).select("doc_id", F.round(F.col("confidence") * 100).cast("int").alias("hundredths"))


_NORM = "lower(replace({0}, ' Corp.', ''))"


@query("case_parties", f"SELECT o_orderkey AS doc_id, concat({PLAINTIFF}, ' v. ', {DEFENDANT}) AS case_name, {PLAINTIFF} AS plaintiff, {DEFENDANT} AS defendant, {_NORM.format(PLAINTIFF)} AS plaintiff_norm, {_NORM.format(DEFENDANT)} AS defendant_norm FROM orders")
def case_parties(spark, sf_dir):
    return cases(spark, sf_dir).select("doc_id", "case_name", "plaintiff", "defendant", "plaintiff_norm", "defendant_norm")


@query("procedural_captions", f"SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'In re' WHEN 1 THEN 'Ex parte' ELSE 'Matter of' END AS procedural_prefix, concat(CASE o_orderkey % 3 WHEN 0 THEN 'In re' WHEN 1 THEN 'Ex parte' ELSE 'Matter of' END, ' ', {PLAINTIFF}) AS case_name FROM orders")
def procedural_captions(spark, sf_dir):
    text = f"concat('It was so held. ', CASE o_orderkey % 3 WHEN 0 THEN 'In re' WHEN 1 THEN 'Ex parte' ELSE 'Matter of' END, ' ', {PLAINTIFF}, ', ', {CITE}, ' ', {PAREN}, '.')"
    return c.extract_citations(rendered(spark, sf_dir, text)).select("doc_id", "procedural_prefix", "case_name")


@query("case_spans", f"SELECT o_orderkey AS doc_id, CAST(length('The court decided ') AS INTEGER) AS full_start, CAST(length('The court decided ') + length({FULL}) AS INTEGER) AS full_end, CAST(length('The court decided ') + length({FULL}) - length({PAREN}) - 1 - length({CITE}) AS INTEGER) AS core_start FROM orders")
def case_spans(spark, sf_dir):
    return cases(spark, sf_dir).select("doc_id", F.col("full_span.start").alias("full_start"), F.col("full_span.end").alias("full_end"), F.col("span.start").alias("core_start"))


@query("pincites", f"SELECT o_orderkey AS doc_id, CAST({PAGE} + 3 AS INTEGER) AS pincite, CAST(CASE WHEN o_orderkey % 2 = 0 THEN {PAGE} + 5 END AS INTEGER) AS end_page FROM orders")
def pincites(spark, sf_dir):
    text = f"concat({PLAINTIFF}, ' v. ', {DEFENDANT}, ', ', {CITE}, ', ', {PAGE} + 3, CASE WHEN o_orderkey % 2 = 0 THEN concat('-', {PAGE} + 5) ELSE '' END, ' ', {PAREN}, '.')"
    return c.extract_citations(rendered(spark, sf_dir, text)).select("doc_id", "pincite", F.col("pincite_info.end_page").alias("end_page"))


@query("blank_pages", f"SELECT o_orderkey AS doc_id, CAST({VOLUME} AS BIGINT) AS volume_num, {REPORTER} AS reporter, true AS has_blank_page, CAST(NULL AS BIGINT) AS page FROM orders")
def blank_pages(spark, sf_dir):
    """All six reporters, U.S. too."""
    text = f"concat({PLAINTIFF}, ' v. ', {DEFENDANT}, ', ', {VOLUME}, ' ', {REPORTER}, CASE WHEN o_orderkey % 2 = 0 THEN ' ___ ' ELSE ' --- ' END, {PAREN}, '.')"
    return c.extract_citations(rendered(spark, sf_dir, text)).select("doc_id", "volume_num", "reporter", "has_blank_page", "page")


@query("court_inference", f"SELECT level, count(*) AS cites FROM (SELECT CASE {REPORTER} WHEN 'U.S.' THEN 'supreme' WHEN 'F.Supp.2d' THEN 'trial' WHEN 'P.2d' THEN 'unknown' WHEN 'N.E.2d' THEN 'unknown' ELSE 'appellate' END AS level FROM orders) GROUP BY level")
def court_inference(spark, sf_dir):
    return cases(spark, sf_dir).groupBy(F.col("inferred_court.level").alias("level")).agg(F.count("*").alias("cites"))


@query("reporter_lookup", f"SELECT {REPORTER} AS reporter, count(*) AS cites, CASE {REPORTER} WHEN 'P.2d' THEN 'state' WHEN 'N.E.2d' THEN 'state' ELSE 'federal' END AS court_jurisdiction FROM orders GROUP BY 1, 3")
def reporter_lookup(spark, sf_dir):
    dim = F.broadcast(c.reporters(spark).select("reporter", "court_jurisdiction"))
    return cases(spark, sf_dir).select("reporter").join(dim, "reporter").groupBy("reporter", "court_jurisdiction").agg(F.count("*").alias("cites"))


@query("reporter_validation", "SELECT o_orderkey AS doc_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 35 END AS INTEGER) AS hundredths FROM orders")
def reporter_validation(spark, sf_dir):
    text = f"concat({PLAINTIFF}, ' v. ', {DEFENDANT}, ', ', {VOLUME}, CASE WHEN o_orderkey % 2 = 0 THEN ' F.2d ' ELSE ' Xyz. ' END, {PAGE}, ' (9th Cir. ', {YEAR}, ').')"
    return c.validate(c.extract_citations(rendered(spark, sf_dir, text))).select("doc_id", F.round(F.col("validated") * 100).cast("int").alias("hundredths"))


@query("dispositions", "SELECT o_orderkey AS doc_id, CASE o_orderkey % 2 WHEN 0 THEN 'en banc' ELSE 'per curiam' END AS disposition FROM orders")
def dispositions(spark, sf_dir):
    text = f"concat({FULL}, CASE o_orderkey % 2 WHEN 0 THEN ' (en banc)' ELSE ' (per curiam)' END, '.')"
    return c.extract_citations(rendered(spark, sf_dir, text)).select("doc_id", "disposition")


@query("parentheticals", "SELECT o_orderkey AS doc_id, 'holding' AS type, concat('holding that rule ', o_orderkey % 97, ' applies') AS text FROM orders")
def parentheticals(spark, sf_dir):
    text = f"concat({FULL}, ' (holding that rule ', o_orderkey % 97, ' applies).')"
    rows = c.extract_citations(rendered(spark, sf_dir, text)).filter("type = 'case'").select("doc_id", F.explode("parentheticals").alias("p"))
    return rows.select("doc_id", "p.type", "p.text")


# ---------------------------------------------------------------- statutes and other sources

TITLE, SECTION = "(p_size % 50 + 1)", "(p_partkey % 9000 + 100)"


@query("statutes_federal", f"SELECT p_partkey AS doc_id, CAST(k AS INTEGER) AS cite_idx, CASE k WHEN 0 THEN 'statute' ELSE 'regulation' END AS type, CASE k WHEN 0 THEN 'U.S.C.' ELSE 'C.F.R.' END AS code, CAST({TITLE} AS INTEGER) AS title, CASE k WHEN 0 THEN CAST({SECTION} AS VARCHAR) ELSE concat({SECTION}, '.', p_size) END AS section, CASE k WHEN 0 THEN concat('(a)(', p_size, ')') END AS subsection FROM part, (VALUES (0), (1)) t(k)")
def statutes_federal(spark, sf_dir):
    text = f"concat('See ', {TITLE}, ' U.S.C. § ', {SECTION}, '(a)(', p_size, '); ', {TITLE}, ' C.F.R. § ', {SECTION}, '.', p_size, '.')"
    return c.extract_citations(rendered(spark, sf_dir, text, "part", "p_partkey")).select("doc_id", "cite_idx", "type", "code", "title", "section", "subsection")


STATE = (("Fla. Stat.", "FL"), ("Ohio Rev. Code", "OH"), ("Utah Code Ann.", "UT"), ("N.C. Gen. Stat.", "NC"), ("Idaho Code", "ID"), ("Wis. Stat.", "WI"), ("Nev. Rev. Stat.", "NV"), ("Tenn. Code Ann.", "TN"), ("W. Va. Code", "WV"), ("Mich. Comp. Laws", "MI"))
_CODE = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(STATE)) + " END"
_JURISDICTION = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(STATE)) + " END"


@query("statutes_state", f"SELECT p_partkey AS doc_id, {_CODE} AS code, {_JURISDICTION} AS jurisdiction, CAST({SECTION} AS VARCHAR) AS section, CAST(CASE WHEN p_size % 2 = 0 THEN 2001 END AS INTEGER) AS year FROM part")
def statutes_state(spark, sf_dir):
    text = f"concat('Under ', {_CODE}, ' § ', {SECTION}, CASE WHEN p_size % 2 = 0 THEN ' (2001)' ELSE '' END, ' it is so.')"
    return c.extract_citations(rendered(spark, sf_dir, text, "part", "p_partkey")).select("doc_id", "code", "jurisdiction", "section", "year")


NAMED = (("Cal. Penal Code", "CA"), ("N.Y. Penal Law", "NY"), ("Tex. Fam. Code", "TX"), ("Md. Code", "MD"), ("Va. Code", "VA"), ("Ala. Code", "AL"))
_NAMED = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(NAMED)) + " END"
_NAMED_J = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(NAMED)) + " END"


@query("statutes_named", f"SELECT p_partkey AS doc_id, {_NAMED} AS code, {_NAMED_J} AS jurisdiction, CAST({SECTION} AS VARCHAR) AS section FROM part")
def statutes_named(spark, sf_dir):
    return c.extract_citations(rendered(spark, sf_dir, f"concat('as in ', {_NAMED}, ' § ', {SECTION}, ' and so on')", "part", "p_partkey")).select("doc_id", "code", "jurisdiction", "section")


FORMS = (
    ("section {} of title 42", "U.S.C.", "US"), ("I.R.C. § {}", "I.R.C.", "US"), ("U.S.S.G. § {}", "U.S.S.G.", "US"), ("§ {} of the Bankruptcy Code", "U.S.C.", "US"), ("RSA chapter {}", "RSA", "NH"), ("ORS chapter {}", "ORS", "OR"),
    ("R.C. Chapter {}", "R.C.", "OH"), ("CPLR {}", "N.Y. C.P.L.R.", "NY"), ("EPTL {}", "N.Y. EPTL", "NY"), ("21 L.P.R.A. § {}", "L.P.R.A.", "PR"), ("Labor Law § {}", "Labor Law", "NY"), ("735 ILCS 5/{}", "5", "IL"),
    ("section {}, Florida Statutes", "Fla. Stat.", "FL"), ("Florida Statutes § {}", "Fla. Stat.", "FL"), ("section {}, Idaho Code", "Idaho Code", "ID"), ("§ {}, MCA", "MCA", "MT"), ("§ {}, T.C.A.", "T.C.A.", "TN"), ("§ {}, R.R.S. 1943", "R.R.S. 1943", "NE"),
    ("HG § {}", "HG", "MD"), ("K.S.A. 1973 {}", "K.S.A.", "KS"), ("IC 1971, {}", "IC", "IN"), ("Pen. Code § {}", "Pen. Code", "CA"), ("Bus. & Prof. Code, § {}", "Bus. & Prof. Code", "CA"), ("Code 1940, T. 15, § {}", "Code of Alabama 1940", "AL"),
    ("Tit. 7, § {}", "Code of Alabama 1940", "AL"), ("RLH 1955 § {}", "RLH", "HI"), ("Ill. Rev. Stat. 1981, ch. 38, par. {}", "Ill. Rev. Stat.", "IL"), ("G.L. 1956 § {}", "G.L. 1956", "RI"),
)
_FORM = "CASE p_partkey % {0} ".format(len(FORMS)) + " ".join("WHEN {0} THEN concat('{1}', {2}, '{3}')".format(i, f.split("{}")[0], SECTION, f.split("{}")[1]) for i, (f, _, _) in enumerate(FORMS)) + " END"
_FORM_CODE = "CASE p_partkey % {0} ".format(len(FORMS)) + " ".join(f"WHEN {i} THEN '{x}'" for i, (_, x, _) in enumerate(FORMS)) + " END"
_FORM_J = "CASE p_partkey % {0} ".format(len(FORMS)) + " ".join(f"WHEN {i} THEN '{x}'" for i, (_, _, x) in enumerate(FORMS)) + " END"


@query("statutes_forms", f"SELECT p_partkey AS doc_id, {_FORM_CODE} AS code, {_FORM_J} AS jurisdiction, CAST({SECTION} AS VARCHAR) AS section FROM part")
def statutes_forms(spark, sf_dir):
    """Prefix, postfix, chapter and edition forms of statutes."""
    return c.extract_citations(rendered(spark, sf_dir, f"concat('The rule of ', {_FORM}, ' governs here')", "part", "p_partkey")).select("doc_id", "code", "jurisdiction", "section")


OTHERS = (
    ("2020 WL {}", "neutral"), ("2020 NY Slip Op {}", "neutral"), ("2010-Ohio-{}", "neutral"), ("2021 U.S. LEXIS {}", "neutral"), ("T.C. Memo. 2002-{}", "neutral"), ("Pub. L. No. 117-{}", "publicLaw"), ("85 Fed. Reg. {}", "federalRegister"),
    ("124 Stat. {}", "statutesAtLarge"), ("100 Harv. L. Rev. {}", "journal"), ("Stats. 1998, ch. {}", "sessionLaw"), ("T.I.A.S. No. {}", "treaty"), ("H.R. Rep. No. 99-{}", "legislativeMaterial"), ("CCCO § {}", "localOrdinance"),
    ("Canon {}", "canon"), ("Fed. R. Civ. P. {}", "federalRule"), ("I.R.C.P. {}", "stateRule"), ("Restatement (Second) of Torts § {}", "restatement"), ("5 Wigmore on Evidence § {}", "treatise"), ("100 A.L.R.2d {}", "annotation"),
    ("U.S. Const. amend. XIV, § {}", "constitutional"), ("Cal. Const. art. I, § {}", "constitutional"), ("Art. I, § {}", "constitutional"),
)
_OTHER = f"CASE p_partkey % {len(OTHERS)} " + " ".join("WHEN {0} THEN concat('{1}', {2})".format(i, f.split("{}")[0], SECTION) for i, (f, _) in enumerate(OTHERS)) + " END"
_OTHER_TYPE = f"CASE p_partkey % {len(OTHERS)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(OTHERS)) + " END"


@query("other_types", f"SELECT p_partkey AS doc_id, {_OTHER_TYPE} AS type, {_OTHER} AS matched_text FROM part")
def other_types(spark, sf_dir):
    """One citation of every other type: span and type of each."""
    return c.extract_citations(rendered(spark, sf_dir, f"concat('as shown in ', {_OTHER}, ' among others')", "part", "p_partkey")).select("doc_id", "type", "matched_text")


@query("constitutional_parts", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'US' ELSE 'CA' END AS jurisdiction, CAST(CASE WHEN p_partkey % 2 = 0 THEN 14 END AS INTEGER) AS amendment, CAST(CASE WHEN p_partkey % 2 = 1 THEN 1 END AS INTEGER) AS article, CAST(p_size AS VARCHAR) AS section FROM part")
def constitutional_parts(spark, sf_dir):
    text = "concat('under ', CASE WHEN p_partkey % 2 = 0 THEN 'U.S. Const. amend. XIV, § ' ELSE 'Cal. Const. art. I, § ' END, p_size, ' it is')"
    return c.extract_citations(rendered(spark, sf_dir, text, "part", "p_partkey")).select("doc_id", "jurisdiction", "amendment", "article", "section")


@query("rules", "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'Fed. R. Civ. P.' ELSE 'Fed. R. Evid.' END AS rule_set, CAST(p_size AS VARCHAR) AS rule, '(b)(6)' AS subsection FROM part")
def rules(spark, sf_dir):
    text = "concat('by ', CASE WHEN p_partkey % 2 = 0 THEN 'FRCP ' ELSE 'Federal Rules of Evidence ' END, p_size, '(b)(6) and')"
    return c.extract_citations(rendered(spark, sf_dir, text, "part", "p_partkey")).select("doc_id", "rule_set", "rule", "subsection")


@query("section_lists", f"SELECT p_partkey AS doc_id, CAST(k AS INTEGER) AS cite_idx, 'U.S.C.' AS code, CAST({SECTION} + k AS VARCHAR) AS section FROM part, (VALUES (0), (1), (2)) t(k)")
def section_lists(spark, sf_dir):
    text = f"concat('See 42 U.S.C. §§ ', {SECTION}, ', ', {SECTION} + 1, ' and ', {SECTION} + 2, '.')"
    return c.extract_citations(rendered(spark, sf_dir, text, "part", "p_partkey")).select("doc_id", "cite_idx", "code", "section")


@query("docket_citations", f"SELECT o_orderkey AS doc_id, concat('24-', o_orderkey) AS number, CAST({YEAR} AS INTEGER) AS year, 'D. Mass.' AS court FROM orders")
def docket_citations(spark, sf_dir):
    text = f"concat({PLAINTIFF}, ' v. ', {DEFENDANT}, ', No. 24-', o_orderkey, ' (D. Mass. ', {YEAR}, ').')"
    return c.extract_citations(rendered(spark, sf_dir, text)).filter("type = 'docket'").select("doc_id", "number", "year", "court")


# ---------------------------------------------------------------- structure

_PARALLEL = f"concat({PLAINTIFF}, ' v. ', {DEFENDANT}, ', ', {VOLUME}, ' U.S. ', {PAGE}, ', ', {VOLUME} + 7, ' S.Ct. ', {PAGE} + 9, CASE WHEN o_orderkey % 2 = 0 THEN concat(', ', {VOLUME} + 11, ' L.Ed.2d ', {PAGE} + 13) ELSE '' END, ' (', {YEAR}, ')')"


@query("parallel_groups", f"SELECT o_orderkey AS doc_id, concat({VOLUME}, '-U.S.-', {PAGE}) AS group_id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS members FROM orders")
def parallel_groups(spark, sf_dir):
    groups = c.parallel_groups(c.extract_citations(rendered(spark, sf_dir, f"concat('In ', {_PARALLEL}, ', we held.')")))
    return groups.select("doc_id", "group_id", F.size("members").alias("members"))


@query("parallel_captions", f"SELECT o_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS captioned, CAST(min({YEAR}) AS INTEGER) AS year FROM orders, (VALUES (0), (1), (2)) t(k) WHERE k < 2 OR o_orderkey % 2 = 0 GROUP BY 1")
def parallel_captions(spark, sf_dir):
    rows = c.extract_citations(rendered(spark, sf_dir, f"concat('In ', {_PARALLEL}, ', we held.')"))
    return rows.filter("case_name is not null").groupBy("doc_id").agg(F.count("*").alias("captioned"), F.min("year").alias("year"))


_STRING = f"concat('See ', {FULL}, '; ', CASE WHEN o_orderkey % 2 = 0 THEN 'see also ' ELSE '' END, {DEFENDANT}, ' v. ', {PLAINTIFF}, ', ', {VOLUME} + 1, ' F.3d ', {PAGE}, ' (2d Cir. ', {YEAR}, ').')"


@query("string_citations", "SELECT o_orderkey AS doc_id, CAST(k AS INTEGER) AS cite_idx, 'sc-0' AS string_group_id, CAST(k AS INTEGER) AS string_group_index, CAST(2 AS INTEGER) AS string_group_size, CASE WHEN k = 0 THEN 'see' WHEN o_orderkey % 2 = 0 THEN 'see also' END AS signal FROM orders, (VALUES (0), (1)) t(k)")
def string_citations(spark, sf_dir):
    return c.extract_citations(rendered(spark, sf_dir, _STRING)).select("doc_id", "cite_idx", "string_group_id", "string_group_index", "string_group_size", "signal")


_HISTORY = f"concat({FULL}, CASE o_orderstatus WHEN 'F' THEN ', aff''d, ' WHEN 'O' THEN ', rev''d, ' ELSE ', vacated, ' END, {VOLUME} + 5, ' U.S. ', {PAGE} + 1, ' (', {YEAR}, ').')"


@query("history_links", "SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'affirmed' WHEN 'O' THEN 'reversed' ELSE 'vacated' END AS history_signal, CAST(0 AS INTEGER) AS history_of FROM orders")
def history_links(spark, sf_dir):
    text = _HISTORY.replace("''d", "\\'d")
    return c.extract_citations(rendered(spark, sf_dir, text)).filter("cite_idx = 1").select("doc_id", "history_signal", "history_of")


@query("nested_citations", "SELECT o_orderkey AS doc_id, CAST(1 AS INTEGER) AS cite_idx, CAST(0 AS INTEGER) AS nested_in FROM orders")
def nested_citations(spark, sf_dir):
    text = f"concat({FULL}, ' (quoting Roe v. Wade, ', {VOLUME} + 2, ' U.S. ', {PAGE}, ' (1973)).')"
    return c.extract_citations(rendered(spark, sf_dir, text)).filter("nested_in is not null").select("doc_id", "cite_idx", "nested_in")


# ---------------------------------------------------------------- resolution

_RESOLVE = f"concat({FULL}, '. Id. at ', {PAGE} + 2, '. Then 42 U.S.C. § 1983 was read. ', {DEFENDANT}, ', ', {VOLUME}, ' ', {REPORTER}, ' at ', {PAGE} + 4, '. ', {DEFENDANT}, ', supra, at ', {PAGE} + 6, '. Id.')"


@query("resolution", f"SELECT o_orderkey AS doc_id, CAST(k AS INTEGER) AS cite_idx, CASE k WHEN 1 THEN 'id' WHEN 3 THEN 'shortFormCase' WHEN 4 THEN 'supra' ELSE 'id' END AS type, CAST(0 AS INTEGER) AS resolved_to, CAST({PAGE} + CASE k WHEN 1 THEN 2 WHEN 3 THEN 4 ELSE 6 END AS INTEGER) AS pincite FROM orders, (VALUES (1), (3), (4), (5)) t(k)")
def resolution(spark, sf_dir):
    rows = c.extract_citations(rendered(spark, sf_dir, _RESOLVE), fields=("cite_idx", "type", "pincite", "resolution")).filter("resolution is not null")
    return rows.select("doc_id", "cite_idx", "type", F.col("resolution.resolved_to").alias("resolved_to"), "pincite")


@query("pincite_inheritance", "SELECT o_orderkey AS doc_id, CAST(5 AS INTEGER) AS cite_idx, CAST(4 AS INTEGER) AS pincite_inherited_from FROM orders")
def pincite_inheritance(spark, sf_dir):
    return c.extract_citations(rendered(spark, sf_dir, _RESOLVE)).filter("pincite_inherited_from is not null").select("doc_id", "cite_idx", "pincite_inherited_from")


@query("case_groups", f"SELECT o_orderkey AS doc_id, concat({VOLUME}, '-', {REPORTER}, '-', {PAGE}) AS case_key, CAST(5 AS BIGINT) AS mentions, CAST(1 AS BIGINT) AS full_mentions, CAST(4 AS BIGINT) AS short_mentions FROM orders")
def case_groups(spark, sf_dir):
    return c.case_groups(c.extract_citations(rendered(spark, sf_dir, _RESOLVE), fields=c.GROUP_FIELDS))


@query("graph_edges", "SELECT o_orderkey AS doc_id, edge, CAST(a AS INTEGER) AS from_idx, CAST(b AS INTEGER) AS to_idx FROM orders, (VALUES ('resolves-to', 1, 0), ('resolves-to', 3, 0), ('resolves-to', 4, 0), ('resolves-to', 5, 0), ('pincite-inherit', 5, 4)) t(edge, a, b)")
def graph_edges(spark, sf_dir):
    return c.graph_edges(c.extract_citations(rendered(spark, sf_dir, _RESOLVE), fields=c.EDGE_FIELDS)).select("doc_id", "edge", "from_idx", "to_idx")


_WEB = f"concat({PLAINTIFF}, ' v. ', {DEFENDANT}, ', ', {VOLUME}, ' U.S. ', {PAGE}, ', ', {VOLUME} + 1, ' S. Ct. ', {PAGE} + 1, ' (', {YEAR}, ') (quoting Roe v. Poe, 5 F.3d 6 (1990)), aff''d, 7 U.S. 8 (1999). See Coe v. Loe, 9 F.3d 10 (1991); see also Foe v. Moe, 11 F.3d 12 (1992). Zorro, supra, at 3. Id.')"


@query("graph_all_edges", "SELECT o_orderkey AS doc_id, edge, CAST(a AS INTEGER) AS from_idx, CAST(b AS INTEGER) AS to_idx FROM orders, (VALUES ('parallel', 0, 1), ('in-parenthetical-of', 2, 0), ('history-of', 3, 0), ('string-cite', 4, 5), ('antecedent', 7, 6)) t(edge, a, b)")
def graph_all_edges(spark, sf_dir):
    """The other five kinds of edges."""
    return c.graph_edges(c.extract_citations(rendered(spark, sf_dir, _WEB.replace("''", "\\'")), fields=c.EDGE_FIELDS)).select("doc_id", "edge", "from_idx", "to_idx")


@query("paragraph_scope", "SELECT o_orderkey AS doc_id, o_orderkey % 2 = 0 AS resolved FROM orders")
def paragraph_scope(spark, sf_dir):
    """Id. in another paragraph than its antecedent stays unresolved."""
    text = f"concat({FULL}, '. More.', CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '\\n\\n' END, 'Id. at 5.')"
    rows = c.extract_citations(rendered(spark, sf_dir, text), Options(scope="paragraph")).filter("type = 'id'")
    return rows.select("doc_id", F.col("resolution.resolved_to").isNotNull().alias("resolved"))


# ---------------------------------------------------------------- documents

@query("footnote_tags", f"SELECT o_orderkey AS doc_id, CAST(k AS INTEGER) AS cite_idx, CAST(CASE WHEN k = 1 THEN o_orderkey % 50 + 1 END AS INTEGER) AS footnote_number FROM orders, (VALUES (0), (1)) t(k)")
def footnote_tags(spark, sf_dir):
    text = f"concat('Text ', {FULL}, '. <footnote label=\"', o_orderkey % 50 + 1, '\">Brown v. Board, 347 U.S. 483 (1954).</footnote> End.')"
    return c.extract_citations(rendered(spark, sf_dir, text), Options(detect_footnotes=True)).select("doc_id", "cite_idx", "footnote_number")


@query("footnote_zones", "SELECT o_orderkey AS doc_id, CAST(o_orderkey % 50 + 1 AS INTEGER) AS number, CAST(5 AS INTEGER) AS start FROM orders")
def footnote_zones(spark, sf_dir):
    return c.footnote_zones(rendered(spark, sf_dir, "concat('Text <footnote label=\"', o_orderkey % 50 + 1, '\">note</footnote> End.')")).select("doc_id", "number", "start")


@query("prose_spans", f"SELECT o_orderkey AS doc_id, CAST(CASE k WHEN 0 THEN 0 ELSE 18 + length({FULL}) END AS INTEGER) AS start, CAST(CASE k WHEN 0 THEN 18 ELSE 18 + length({FULL}) + 19 END AS INTEGER) AS \"end\" FROM orders, (VALUES (0), (1)) t(k)")
def prose_spans(spark, sf_dir):
    docs = rendered(spark, sf_dir, f"concat('The court decided ', {FULL}, '. The rest followed')")
    return c.prose_spans(docs).select("doc_id", "start", "end")


@query("quote_attribution", "SELECT o_orderkey AS doc_id, CAST(0 AS INTEGER) AS cite_idx, 'inline' AS kind FROM orders")
def quote_attribution(spark, sf_dir):
    return c.quote_attributions(rendered(spark, sf_dir, f"concat('The court held \"rule ', o_orderkey, ' applies.\" ', {FULL}, '.')")).select("doc_id", "cite_idx", "kind")


@query("annotate", f"SELECT o_orderkey AS doc_id, concat('The court decided ', {PLAINTIFF}, ' v. ', {DEFENDANT}, ', <cite>', {CITE}, '</cite> ', {PAREN}, '.') AS annotated FROM orders")
def annotate(spark, sf_dir):
    return c.annotated(rendered(spark, sf_dir, f"concat('The court decided ', {FULL}, '.')")).select("doc_id", "annotated")


@query("annotate_callback", f"SELECT o_orderkey AS doc_id, concat('The court decided ', {PLAINTIFF}, ' v. ', {DEFENDANT}, ', [case ', {CITE}, '] ', {PAREN}, '.') AS annotated, CAST(18 + length({PLAINTIFF}) + 4 + length({DEFENDANT}) + 2 AS INTEGER) AS new_start FROM orders")
def annotate_callback(spark, sf_dir):
    docs = rendered(spark, sf_dir, f"concat('The court decided ', {FULL}, '.')")
    marked = c.annotated(docs, callback=lambda cite, around: f"[{cite['type']} {cite['matched_text']}]")
    return marked.select("doc_id", "annotated", F.col("moved")[0]["new_start"].alias("new_start"))


@query("bluebook", f"SELECT o_orderkey AS doc_id, {FULL} AS bluebook, {CITE} AS reporter_key FROM orders")
def bluebook(spark, sf_dir):
    return cases(spark, sf_dir).select("doc_id", "bluebook", "reporter_key")


@query("source_offsets", f"SELECT o_orderkey AS doc_id, CAST(6 + length({PLAINTIFF}) + 4 + length({DEFENDANT}) + 2 + 4 AS INTEGER) AS start, {CITE} AS key FROM orders")
def source_offsets(spark, sf_dir):
    """Offsets point into the source, whatever cleaning removed before them."""
    text = f"concat('<p>In&#32;', {PLAINTIFF}, ' v. ', {DEFENDANT}, ', ', {CITE}, ' ', {PAREN}, '.</p>')"
    return readers.projection(stored(c.extract_citations(rendered(spark, sf_dir, text)))).select("doc_id", F.col("start"), "key")


@query("false_positives", "SELECT o_orderkey AS doc_id, count(*) AS cites FROM orders, (VALUES (0)) t(k) WHERE o_orderkey % 2 = 1 GROUP BY 1")
def false_positives(spark, sf_dir):
    """A date and a blocked reporter are dropped; a case stays."""
    text = f"concat('On 12 May 1999 the ', CASE WHEN o_orderkey % 2 = 0 THEN '200 I.L.M. 300' ELSE {CITE} END, ' came.')"
    return c.extract_citations(rendered(spark, sf_dir, text), Options(remove_false_positives=True)).groupBy("doc_id").agg(F.count("*").alias("cites"))


@query("cleaned_length", "SELECT o_orderkey AS doc_id, concat('Roe & Co. - ', o_orderkey, ' \"x\"') AS clean_text FROM orders")
def cleaned_length(spark, sf_dir):
    return c.cleaned(rendered(spark, sf_dir, "concat('<b>Roe</b> &amp;  Co. – ', o_orderkey, ' “x”')")).select("doc_id", "clean_text")


@query("native_cleaning", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style) *>', ' ', 'gi'), '<[^<>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM pages")
def native_cleaning(spark, sf_dir):
    """Tags and white space in JVM expressions only."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", strip_html_column(F.col("html")).alias("text"))


_CLEANED = "html"
for _name, _char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("sect", "§"), ("para", "¶"), ("mdash", "—"), ("ndash", "–")):
    _CLEANED = f"replace({_CLEANED}, '&{_name};', '{_char}')"
_CLEANED = rf"regexp_replace({_CLEANED}, '[\t\n\r\x{{A0}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]', ' ', 'g')"
_CLEANED = f"translate(regexp_replace({_CLEANED}, ' +', ' ', 'g'), '‐‑‒–“”„‘’‚′', '----\"\"\"{2 * 4 * chr(39)}')"


@query("native_entities", f"SELECT page_id, {_CLEANED} AS text FROM pages")
def native_entities(spark, sf_dir):
    """The whole text of all pages: entities, white space folded, dashes and quotes."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", clean_column(F.col("html")).alias("text"))


_PLAIN = "concat('there is nothing to see here but ', regexp_replace(lower(o_orderpriority), '[^a-z]+', ' '{g}), ' words')"
_GATED = "CASE o_orderkey % 4 WHEN 0 THEN {plain} WHEN 1 THEN 'We agree. <em>Id</em>. The holding stands.' WHEN 2 THEN concat('See IRC &sect; ', o_orderkey % 900 + 1, ' there.') ELSE concat('It said sec-\n', 'tion ', o_orderkey % 900 + 1, ' of title 42 so') END"


@query("gate", "SELECT CAST(o_orderkey % 4 AS INTEGER) AS kind, count(*) AS docs, CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS passed FROM orders GROUP BY 1")
def gate(spark, sf_dir):
    """The documents of each kind, and how many of them reach Python: plain prose does not, citations behind tags, entities and line ends do."""
    text = _GATED.format(plain=_PLAIN.format(g=""))
    docs = rendered(spark, sf_dir, text)
    return docs.select(F.expr("CAST(doc_id % 4 AS INT)").alias("kind"), c.may_cite("text").alias("passes")).groupBy("kind").agg(F.count("*").alias("docs"), F.count_if("passes").alias("passed"))


@query("gate_citations", "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 1 THEN 'id' ELSE 'statute' END AS type, CASE WHEN o_orderkey % 4 > 1 THEN CAST(o_orderkey % 900 + 1 AS VARCHAR) END AS section FROM orders, (VALUES (0)) t(k) WHERE o_orderkey % 4 > 0")
def gate_citations(spark, sf_dir):
    """The citations behind tags, entities and divided words, all found; plain prose has none."""
    return c.extract_citations(rendered(spark, sf_dir, _GATED.format(plain=_PLAIN.format(g="")))).select("doc_id", "type", "section")


@query("year_first", f"SELECT o_orderkey AS doc_id, CAST({YEAR} AS INTEGER) AS year, concat({PLAINTIFF}, ' v. ', {DEFENDANT}) AS case_name FROM orders")
def year_first(spark, sf_dir):
    """The year between caption and citation."""
    text = f"concat('It was so. ', {PLAINTIFF}, ' v. ', {DEFENDANT}, ' (', {YEAR}, ') ', {VOLUME}, ' Cal.3d ', {PAGE}, '.')"
    return c.extract_citations(rendered(spark, sf_dir, text)).select("doc_id", "year", "case_name")


@query("bare_code_jurisdiction", "SELECT p_partkey AS doc_id, CASE p_partkey % 2 WHEN 0 THEN 'DC' ELSE 'VA' END AS jurisdiction FROM part")
def bare_code_jurisdiction(spark, sf_dir):
    text = f"concat('The ', CASE p_partkey % 2 WHEN 0 THEN 'District of Columbia' ELSE 'Virginia' END, ' court read Code § 18.2-', {SECTION}, ' so')"
    return c.extract_citations(rendered(spark, sf_dir, text, "part", "p_partkey")).select("doc_id", "jurisdiction")


@query("bare_section_jurisdiction", "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'NM' WHEN 1 THEN 'MT' END AS jurisdiction FROM part")
def bare_section_jurisdiction(spark, sf_dir):
    text = f"concat('The ', CASE p_partkey % 3 WHEN 0 THEN 'New Mexico' ELSE 'local' END, ' law in Section 41-2-', {SECTION}, CASE p_partkey % 3 WHEN 1 THEN ' (1978), MCA' ELSE '' END, ' says so')"
    return c.extract_citations(rendered(spark, sf_dir, text, "part", "p_partkey")).filter("pattern_id = 'nm-bare-section'").select("doc_id", "jurisdiction")


@query("bare_section_lists", f"SELECT p_partkey AS doc_id, CAST(k AS INTEGER) AS cite_idx, '§' AS code, CAST({SECTION} + k AS VARCHAR) AS section FROM part, (VALUES (0), (1)) t(k)")
def bare_section_lists(spark, sf_dir):
    return c.extract_citations(rendered(spark, sf_dir, f"concat('as in §§ ', {SECTION}, ' and ', {SECTION} + 1, ', it is')", "part", "p_partkey")).select("doc_id", "cite_idx", "code", "section")


@query("compare_signal", "SELECT o_orderkey AS doc_id, CAST(k AS INTEGER) AS cite_idx, 'compare' AS signal FROM orders, (VALUES (0), (1)) t(k)")
def compare_signal(spark, sf_dir):
    text = f"concat('Compare ', {FULL}, ' with ', {DEFENDANT}, ' v. ', {PLAINTIFF}, ', ', {VOLUME} + 1, ' F.3d ', {PAGE}, ' (2d Cir. ', {YEAR}, ').')"
    return c.extract_citations(rendered(spark, sf_dir, text)).select("doc_id", "cite_idx", "signal")


@query("inferred_names", f"SELECT o_orderkey AS doc_id, concat({PLAINTIFF}, ' v. ', {DEFENDANT}) AS case_name, {PLAINTIFF} AS plaintiff, {DEFENDANT} AS defendant FROM orders")
def inferred_names(spark, sf_dir):
    """A short form without its full citation takes the caption named in the text before it; where the short form names its party, a nearer caption is of others."""
    text = f"concat('We discussed this in ', {PLAINTIFF}, ' v. ', {DEFENDANT}, ' at length', CASE {YEAR} % 2 WHEN 0 THEN concat(' and not in Roe v. Doe before it. ', {PLAINTIFF}, ', ') ELSE ', see ' END, {VOLUME}, ' F.2d at ', {PAGE}, '.')"
    return c.extract_citations(rendered(spark, sf_dir, text)).filter("type = 'shortFormCase'").select("doc_id", "case_name", "plaintiff", "defendant")


@query("context_sentence", f"SELECT o_orderkey AS doc_id, concat('The court decided ', {CITE}, ' here.') AS context FROM orders")
def context_sentence(spark, sf_dir):
    return c.contexts(rendered(spark, sf_dir, f"concat('Nothing was clear. The court decided ', {CITE}, ' here. Then it rose.')")).select("doc_id", "context")


@query("locators", f"SELECT o_orderkey AS doc_id, {CITE} AS exact, 'The court decided ' AS prefix, CAST(37 AS INTEGER) AS start, CAST(0 AS INTEGER) AS occurrence FROM orders")
def locators(spark, sf_dir):
    return c.locators(rendered(spark, sf_dir, f"concat('Nothing was clear. The court decided ', {CITE}, ' here. Then it rose.')")).select("doc_id", "exact", "prefix", "start", "occurrence")


# ---------------------------------------------------------------- closed vocabularies: every value of each

def _cases(key: str, values) -> str:
    quoted = [str(v).replace("'", "''") if v is not None else None for v in values]
    return f"CASE {key} % {len(quoted)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(quoted)) + " END"


def _spark(sql: str) -> str:
    """Quotes in literals as Spark wants them."""
    return sql.replace("''", "\\'")


_PHRASES = [(p, n) for n, phrases in lx.HISTORY.items() for p in phrases]
_PHRASE, _PHRASE_SIGNAL = _cases("o_orderkey", [p for p, _ in _PHRASES]), _cases("o_orderkey", [n for _, n in _PHRASES])


@query("history_signals", f"SELECT o_orderkey AS doc_id, {_PHRASE_SIGNAL} AS signal, {_PHRASE} AS raw_signal FROM orders")
def history_signals(spark, sf_dir):
    """All phrases of all 38 history signals."""
    text = f"concat({PLAINTIFF}, ' v. ', {DEFENDANT}, ', ', {CITE}, ' ', {PAREN}, ', ', {_spark(_PHRASE)}, ', and more.')"
    rows = c.extract_citations(rendered(spark, sf_dir, text)).select("doc_id", F.explode("history").alias("h"))
    return rows.select("doc_id", "h.signal", "h.raw_signal")


@query("inner_history", f"SELECT o_orderkey AS doc_id, 'Tex. App.---Dallas' AS court, CAST({YEAR} AS INTEGER) AS year, {_cases('o_orderkey', ['no_pet', 'writ_refused', 'pet_denied', 'writ_dismissed'])} AS signal FROM orders")
def inner_history(spark, sf_dir):
    """History inside the parenthesis of court and year."""
    phrase = _spark(_cases("o_orderkey", ["no pet.", "writ ref'd n.r.e.", "pet. denied", "writ dism'd w.o.j."]))
    text = f"concat({PLAINTIFF}, ' v. ', {DEFENDANT}, ', ', {VOLUME}, ' S.W.3d ', {PAGE}, ' (Tex. App.---Dallas ', {YEAR}, ', ', {phrase}, ').')"
    return c.extract_citations(rendered(spark, sf_dir, text)).select("doc_id", "court", "year", F.col("history")[0]["signal"].alias("signal"))


_OPINIONS = (("Brennan, J., dissenting", "dissent", None, 1), ("Roberts, C.J., concurring", "concurrence", None, 1), ("Kennedy, J., concurring in the judgment", "concurrence", "in_judgment", 1), ("Brennan and Marshall, JJ., dissenting", "dissent", None, 2), ("Roberts, C.J., concurring in part and dissenting in part", "mixed", "in_part", 1), ("plurality opinion", "plurality opinion", None, None), ("mem.", "mem.", None, None), ("in bank", "in bank", None, None))


@query("opinions", f"SELECT o_orderkey AS doc_id, {_cases('o_orderkey', [o[1] for o in _OPINIONS])} AS disposition, {_cases('o_orderkey', [o[2] for o in _OPINIONS])} AS scope, CAST({_cases('o_orderkey', [o[3] for o in _OPINIONS])} AS INTEGER) AS justices FROM orders")
def opinions(spark, sf_dir):
    """Who wrote separately, and how far."""
    text = f"concat({FULL}, ' (', {_cases('o_orderkey', [o[0] for o in _OPINIONS])}, ').')"
    return c.extract_citations(rendered(spark, sf_dir, text)).select("doc_id", "disposition", "scope", F.when(F.col("justices").isNotNull(), F.size("justices")).alias("justices"))


_REPORTERS = [(printed, level, jurisdiction, state) for printed, level, jurisdiction, state in lx.reporter_table().values() if level]


@query("court_levels", f"SELECT o_orderkey AS doc_id, {_cases('o_orderkey', [r[1] for r in _REPORTERS])} AS level, {_cases('o_orderkey', [r[2] for r in _REPORTERS])} AS jurisdiction, {_cases('o_orderkey', [r[3] for r in _REPORTERS])} AS state FROM orders")
def court_levels(spark, sf_dir):
    """What every reporter of the table says of its court."""
    text = f"concat({PLAINTIFF}, ' v. ', {DEFENDANT}, ', ', {VOLUME}, ' ', {_cases('o_orderkey', [r[0] for r in _REPORTERS])}, ' ', {PAGE}, ' (', {YEAR}, ').')"
    return c.extract_citations(rendered(spark, sf_dir, text)).select("doc_id", "inferred_court.level", "inferred_court.jurisdiction", "inferred_court.state")


_VARIANTS = (("F. 2d", "F.2d"), ("f.2d", "F.2d"), ("F.2nd", "F.2d"), ("n.e.2d", "N.E.2d"), ("Cal. App. 4th", "Cal.App.4th"), ("So. 3rd", "So.3d"), ("u. s.", "U.S."), ("Ohio St. 3d", "Ohio St.3d"))


@query("reporter_variants", f"SELECT o_orderkey AS doc_id, {_cases('o_orderkey', [v[1] for v in _VARIANTS])} AS reporter FROM orders")
def reporter_variants(spark, sf_dir):
    """Printed variants looked up whatever their case, spacing and scanned series."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS doc_id", f"{_cases('o_orderkey', [v[0] for v in _VARIANTS])} AS printed")
    return c.find_reporters(rows, "printed").select("doc_id", "reporter")


# "PS" before a section mark is an article of Maryland, which comes first
_SPELLINGS = [(s, s, state) for state, *cs in lx.STATE_CODES for s in cs if s != "PS"]
_SPELLINGS += [("R. C.", "R.C.", "OH"), ("O. R. C.", "R.C.", "OH"), ("Colorado Revised Statutes Ann.", "CRS", "CO"), ("A. R.S.", "A.R.S.", "AZ"), ("N. J. S. A.", "N.J.S.A.", "NJ"), ("Pa. C. S.", "Pa.C.S.", "PA"), ("Burns' Indiana Statutes Annotated", "Ind. Ann. Stat.", "IN")]


@query("state_spellings", f"SELECT p_partkey AS doc_id, {_cases('p_partkey', [x[1] for x in _SPELLINGS])} AS code, {_cases('p_partkey', [x[2] for x in _SPELLINGS])} AS jurisdiction, CAST({SECTION} AS VARCHAR) AS section FROM part")
def state_spellings(spark, sf_dir):
    """Every printed spelling of every state code, and some spaced ones, which take the canonical form."""
    text = f"concat('Under ', {_spark(_cases('p_partkey', [x[0] for x in _SPELLINGS]))}, ' § ', {SECTION}, ' it is so.')"
    return c.extract_citations(rendered(spark, sf_dir, text, "part", "p_partkey")).select("doc_id", "code", "jurisdiction", "section")


#: pattern, type, text with the place of a number; the citation ends where the text does, unless a bar marks its end.
_MORE = (
    ("state-vendor-neutral-hyphenated-ms", "neutral", "2019-CT-{}-SCT"), ("state-vendor-neutral", "neutral", "2012 ND {}"), ("state-vendor-neutral", "neutral", "2011 IL App (1st) {}-U"), ("compact-law-review", "journal", "15 Harv.L.Rev. {}"),
    ("nv-session-law", "sessionLaw", "1975 Nev. Stat., ch. {}"), ("treaty-volume-page", "treaty", "40 U.S.T. {}"), ("legmat-cong-rec", "legislativeMaterial", "120 Cong. Rec. H{}"), ("supra", "supra", "[supra, {}]"), ("supra", "supra", "supra note {}"),
    ("supra", "supra", "supra § {}"), ("id-rcp-spelled", "stateRule", "Idaho Rule of Civil Procedure {}"), ("nc-rap", "stateRule", "N.C. R. App. P. {}"), ("nc-rcp", "stateRule", "N.C. R. Civ. P. {}"), ("sc-scacr-postfix", "stateRule", "Rule {}, SCACR"),
    ("rcfc", "stateRule", "RCFC {}"), ("hcn-rcp", "stateRule", "HCN R. Civ. P. {}"), ("tcrcp", "stateRule", "T.C.R.C.P. {}"), ("bare-journal", "journal", "12 JAMA {}"), ("bankruptcy-code-prefix", "statute", "Bankruptcy Code § {}"),
    ("mass-chapter", "statute", "Mass. Gen. Laws ch. 93A, § {}"), ("colorado-prose", "statute", "section {}, Colo. Rev. Stat. 1973"), ("rcw-chapter-postfix", "statute", "chapter 49.{} RCW"), ("state-admin-code", "statute", "OAR 123-45-{}"),
    ("state-admin-code", "statute", "IDAPA 01.02.03.04.{}"), ("wi-stats-postfix", "statute", "sec. 9.{}, Stats."), ("minn-st-year-edition", "statute", "Minn. St. 1971, § {}"), ("wv-code-1931", "statute", "Code, 1931, 5-1-{}"),
    ("nyc-admin-code", "statute", "NYC Admin. Code § 7-{}"), ("ga-pre-1983", "statute", "Code Ann. § 26-{}"), ("ala-title-trailer", "statute", "Title 7, § {}, Code of Alabama 1940"), ("ca-bare-code", "statute", "Water Code § {}"),
    ("bare-constitution", "constitutional", "Const. art. I, § {}"), ("bare-article-section", "constitutional", "Article III, Section {}"), ("state-const-prose-declaration", "constitutional", "article {} of the Massachusetts Declaration of Rights"),
    ("state-const-prose-section-article", "constitutional", "Section {}, Article I of the Texas Constitution"), ("state-const-prose-article-first", "constitutional", "article I, section {} of the California Constitution"),
    ("constitutional-historical-reform", "constitutional", "Cal. Const., former art. VI, § {} (now art. VI, § 10)"), ("ibid", "id", "Ibid."),
)
_MORE_TEXT = f"CASE p_partkey % {len(_MORE)} " + " ".join("WHEN {} THEN concat('{}', {}, '{}')".format(i, t.partition("{}")[0], SECTION if "{}" in t else "''", t.partition("{}")[2]) for i, (_, _, t) in enumerate(_MORE)) + " END"


@query("more_forms", f"SELECT p_partkey AS doc_id, {_cases('p_partkey', [m[0] for m in _MORE])} AS pattern_id, {_cases('p_partkey', [m[1] for m in _MORE])} AS type, {_MORE_TEXT} AS matched_text FROM part")
def more_forms(spark, sf_dir):
    """The forms that the other queries do not render."""
    return c.extract_citations(rendered(spark, sf_dir, f"concat('it was so: ', {_MORE_TEXT}, ' and that was all')", "part", "p_partkey")).select("doc_id", "pattern_id", "type", "matched_text")


@query("amendments", "SELECT o_orderkey AS doc_id, CAST(k AS INTEGER) AS cite_idx, CASE k WHEN 2 THEN 'bare-amendment-word' ELSE 'bare-amendment-coord' END AS pattern_id, CAST(4 + k AS INTEGER) AS amendment FROM orders, (VALUES (0), (1), (2)) t(k)")
def amendments(spark, sf_dir):
    """Every ordinal of a list of amendments."""
    return c.extract_citations(rendered(spark, sf_dir, "concat('under the Fourth, Fifth, and Sixth Amendments by order ', lower(o_orderpriority))")).select("doc_id", "cite_idx", "pattern_id", "amendment")


@query("plural_sections", f"SELECT p_partkey AS doc_id, CAST(k AS INTEGER) AS cite_idx, CAST({SECTION} + k AS VARCHAR) AS section, 'TX' AS jurisdiction, CAST(1 AS INTEGER) AS article FROM part, (VALUES (0), (1)) t(k)")
def plural_sections(spark, sf_dir):
    text = f"concat('as in Sections ', {SECTION}, ' and ', {SECTION} + 1, ' of Article I of the Texas Constitution')"
    return c.extract_citations(rendered(spark, sf_dir, text, "part", "p_partkey")).select("doc_id", "cite_idx", "section", "jurisdiction", "article")


_NAMED_LOOKUP = [(state, names[-1], short) for state, entries in lx.NAMED_CODES.items() for short, *names in entries]


@query("named_code_lookup", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}', '{}')".format(a, b.replace("'", "''"), s) for a, b, s in sorted(set(_NAMED_LOOKUP))) + ") t(state, name, short)")
def named_code_lookup(spark, sf_dir):
    """Every named code found by its longest printed name."""
    register.register(spark)
    rows = spark.createDataFrame(sorted({(a, b) for a, b, _ in _NAMED_LOOKUP}), "state string, name string")
    return rows.select("state", "name", register.find_named_code("state", "name").alias("short"))



# ---------------------------------------------------------------- functions, sources, streams

@query("fn_parse_pincite", "SELECT p_partkey AS doc_id, CAST(p_partkey + 1200 AS INTEGER) AS page, CAST(p_partkey + 1200 + 10 - (p_partkey + 1200) % 10 - 1 AS INTEGER) AS end_page, CAST(p_size AS INTEGER) AS footnote FROM part")
def fn_parse_pincite(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("doc_id"), register.parse_pincite(F.expr("concat('at ', p_partkey + 1200, '-9 n. ', p_size)")).alias("p")).select("doc_id", "p.page", "p.end_page", "p.footnote")


@query("fn_parse_date", "SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def fn_parse_date(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("doc_id"), register.parse_date(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("d")).select("doc_id", "d.iso", "d.month")


@query("fn_normalize_party", "SELECT c_custkey AS doc_id, concat('acme ', c_custkey) AS party FROM customer")
def fn_normalize_party(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("doc_id"), register.normalize_party(F.expr("concat('The Acme ', c_custkey, ', Inc., et al.')")).alias("party"))


@query("fn_normalize_court", "SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'D.Mass.' WHEN 1 THEN '9th Cir.' WHEN 2 THEN 'scotus' END AS court FROM customer")
def fn_normalize_court(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("doc_id"), register.normalize_court(F.expr("CASE c_custkey % 4 WHEN 0 THEN 'D. Mass' WHEN 1 THEN ' 9th Cir' WHEN 2 THEN 'scotus' ELSE ' ' END")).alias("court"))


@query("fn_tokenize", f"SELECT o_orderkey AS doc_id, {CITE} AS token, 'case' AS type FROM orders")
def fn_tokenize(spark, sf_dir):
    register.register(spark)
    rendered(spark, sf_dir, f"concat('The court decided ', {CITE}, '.')").createOrReplaceTempView("rendered_tokens")
    return spark.sql("SELECT doc_id, x.token, x.type FROM rendered_tokens, LATERAL tokenize(text) x")


@query("fn_clean_text", "SELECT p_partkey AS doc_id, concat('page ', p_partkey, ' \"of\" ', p_size, '-', p_partkey) AS clean FROM part")
def fn_clean_text(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("doc_id"), register.clean_text(F.expr("concat('page   ', p_partkey, ' \u201cof\u201d ', p_size, '\u2013', p_partkey)")).alias("clean"))


_FNV = "lambda h, x: (xor(CAST(h AS UBIGINT), CAST(x AS UBIGINT))::HUGEINT * 1099511628211) % 18446744073709551616"


@query("fn_content_hash", f"SELECT c_custkey AS doc_id, lower(lpad(hex(CAST(list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(string_split(c_name, ''), lambda x: unicode(x)::HUGEINT), [0::HUGEINT, 0::HUGEINT]), {_FNV}) AS UBIGINT)), 16, '0')) AS hash FROM customer")
def fn_content_hash(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("doc_id"), register.content_hash(F.col("c_name")).alias("hash"))


@query("party_similarity_join", "WITH n AS (SELECT p_name AS name, count(*) AS parts FROM part GROUP BY 1) SELECT a.name AS name, b.name AS other, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance, CAST(a.parts * b.parts AS BIGINT) AS pairs FROM n a JOIN n b ON a.name < b.name AND levenshtein(a.name, b.name) <= 2")
def party_similarity_join(spark, sf_dir):
    """All pairs of names within two edits, and how many pairs of rows have them."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("parts"))
    found = c.similar_names(names.select("name"), 2)
    left, right = names.withColumnRenamed("parts", "a"), names.select(F.col("name").alias("other"), F.col("parts").alias("b"))
    return found.join(left, "name").join(right, "other").select("name", "other", "distance", (F.col("a") * F.col("b")).alias("pairs"))


@query("table_function", f"SELECT o_orderkey AS doc_id, {REPORTER} AS reporter FROM orders")
def table_function(spark, sf_dir):
    register.register(spark)
    rendered(spark, sf_dir, f"concat('The court decided ', {FULL}, '.')").createOrReplaceTempView("rendered_opinions")
    return spark.sql("SELECT doc_id, x.reporter FROM rendered_opinions, LATERAL extract_citations(text) x")


@query("stream_summary", f"SELECT {REPORTER} AS reporter, count(*) AS cites FROM orders GROUP BY 1")
def stream_summary(spark, sf_dir):
    """The batch query on a stream: files in, Parquet out, then the same aggregate."""
    folder = tempfile.mkdtemp() if spark.conf.get("spark.checkpoint.dir", None) is None else f"{spark.conf.get('spark.checkpoint.dir')}/stream-{spark.sparkContext.applicationId}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    source = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir if sf_dir.endswith("/") else sf_dir + "/")
    docs = source.selectExpr("o_orderkey AS doc_id", f"concat('The court decided ', {FULL}, '.') AS text")
    import uuid

    out, mark = f"{folder}/out-{uuid.uuid4().hex}", f"{folder}/mark-{uuid.uuid4().hex}"
    streaming.run_to_table(spark, docs, out, mark)
    return spark.read.parquet(out).groupBy("reporter").agg(F.count("*").alias("cites"))


@query("single_type_functions", f"SELECT o_orderkey AS doc_id, 'case' AS type, {CITE} AS matched_text FROM orders UNION ALL SELECT o_orderkey, 'statute', concat('42 U.S.C. § ', o_orderkey % 900 + 1) FROM orders")
def single_type_functions(spark, sf_dir):
    """extract_case and extract_statute over the same texts."""
    register.register(spark)
    texts = rendered(spark, sf_dir, f"concat('The court decided ', {CITE}, ' and read 42 U.S.C. § ', o_orderkey % 900 + 1, '.')")
    c.spread(texts).createOrReplaceTempView("rendered_both")
    one = "SELECT doc_id, x.type, x.matched_text FROM rendered_both, LATERAL {}(text) x"
    return spark.sql(one.format("extract_case") + " UNION ALL " + one.format("extract_statute"))
