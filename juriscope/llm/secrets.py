"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean query over lower-case trigrams (an AND of
ORs of ANDs). An inverted index of the trigrams that queries name is built over the documents:
posting lists of row keys, cut into blocks of bounded size. The query is answered by intersecting
and uniting postings within each block, and only candidates meet the expression itself. A rule
without mandatory trigrams (``hex``) scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

try:
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # Python before 3.11
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    """A kind of secret: scan finds matches; those whose measured group is shorter than least are dropped."""

    kind: str
    scan: str
    measured: int = 0
    least: int = 0
    ignore_case: bool = False


#: The three base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Kinds that the scan adds to the base.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
)
RULES = BASE + ADDED

#: An exact set of strings is given up beyond so many members.
MOST_EXACT = 64
#: Postings in one block of the index, on average.
BLOCK_POSTINGS = 50_000
#: Candidates up to this count (16 bytes each) are broadcast, more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Matches located in one inner fold; keeps the cost of very many matches in one text linear.
FOLD = 256


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """An AND of clauses; a clause is an OR of sets of trigrams that must all occur (lower case).

    Empty: nothing is mandatory.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(exact: set[str]) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}
        if sets and all(sets):
            clauses.append(sorted(sets, key=sorted))

    def exact_of(items) -> set[str] | None:
        """The strings a sequence can be, if few; None otherwise."""
        run = {""}
        for op, arg in items:
            some = one(op, arg)
            if some is None or len(run) * len(some) > MOST_EXACT:
                return None
            run = {a + b for a in run for b in some}
        return run

    def one(op, arg) -> set[str] | None:
        if op is _c.LITERAL:
            return {chr(arg).lower()}
        if op is _c.IN and all(o is _c.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is _c.SUBPATTERN:
            return exact_of(arg[3])
        if op is _c.BRANCH:
            parts = [exact_of(x) for x in arg[1]]
            return None if any(x is None for x in parts) else set().union(*parts)
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] <= 1:
            inner = exact_of(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        return None

    run = {""}
    for op, arg in _p.parse(pattern):
        some = one(op, arg)
        if some is None:
            close(run)
            run = {""}
        elif len(run) * len(some) > MOST_EXACT:
            close(run)
            run = some
        else:
            run = {a + b for a in run for b in some}
    close(run)
    return clauses


def java_pattern(rule: Rule) -> str:
    return ("(?i)" if rule.ignore_case else "") + rule.scan


def build_index(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """block, lists: for each block of rows a map from trigram to the sorted keys of rows that hold it."""
    folded = keyed.select("key", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = materialise(folded.select("key", F.explode(found).alias("trigram")).distinct(), "postings")
    blocks = postings.count() // BLOCK_POSTINGS + 1
    lists = postings.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))


def answer(query: list[list[frozenset[str]]], lists: Column) -> Column:
    """The keys of a block that satisfy a query."""
    empty = F.array().cast("array<bigint>")
    result = None
    for clause in query:
        united = None
        for trigrams in clause:
            both = None
            for t in sorted(trigrams):
                keys = F.coalesce(F.try_element_at(lists, F.lit(t)), empty)
                both = keys if both is None else F.array_intersect(both, keys)
            united = both if united is None else F.array_union(united, both)
        result = united if result is None else F.array_intersect(result, united)
    return result


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key, kinds: the rows that may match, with the rules they may match."""
    answers = [index.select(F.explode(answer(trigram_query(r.scan), F.col("lists"))).alias("key"), F.lit(r.kind).alias("kind")) for r in rules]
    rows = answers[0]
    for more in answers[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def located(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind, end>> in code points: the leftmost non-overlapping matches, short ones dropped.

    The gaps between matches (split) and the matches (extract all) come from the same scan of the
    text, so running sums of their lengths are the positions.
    """
    pattern = java_pattern(rule)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = matches if rule.measured == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.measured))
    steps = F.zip_with(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match")), measured,
        lambda x, m: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("match"), (F.length(m) >= rule.least).alias("kept")),
    )
    span = "array<struct<start:int,kind:int,end:int>>"
    none = F.array().cast(span)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["match"]
        one = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["kept"], F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def fold(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["outs"], r["out"]).alias("outs")))[0]

    def walk(pairs: Column) -> Column:
        n = F.size(pairs) - 1  # the last gap has no match
        chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / FOLD).cast("int")), lambda c: F.slice(pairs, c * FOLD + 1, F.least(F.lit(FOLD), n - c * FOLD)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("outs"))
        return F.flatten(F.aggregate(chunks, start, fold)["outs"])

    found = F.transform(F.array(steps), walk)[0]  # steps is evaluated once
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, found: the spans of all rules in every row of docs, by start, then by order of the rule.

    Null texts are empty and hold nothing; rows that repeat are scanned each; a text of any length
    is scanned whole; an empty table gives an empty result; of other columns none is read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"))
    indexed = tuple(r for r in rules if trigram_query(r.scan))
    if indexed:
        trigrams = sorted({t for r in indexed for clause in trigram_query(r.scan) for s in clause for t in s})
        some = materialise(candidates(build_index(keyed, trigrams), indexed), "candidates")
        if some.count() <= MOST_BROADCAST:
            some = F.broadcast(some)
        keyed = keyed.join(some, "key", "left")
    else:
        keyed = keyed.withColumn("kinds", F.lit(None).cast("array<string>"))
    parts = []
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    for order, rule in enumerate(rules):
        spans = located(F.col("text"), rule, order)
        parts.append(F.when(F.array_contains("kinds", rule.kind), spans).otherwise(none) if rule in indexed else spans)
    return keyed.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def op8_secrets(docs: DataFrame) -> DataFrame:
    found = F.col("found")

    def number(k: int) -> Column:
        return F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k].kind}")

    base = F.filter(found, lambda s: s["kind"] < len(BASE))
    return scan(docs).select("doc_id", *map(number, range(len(BASE))), F.sha2(joined(base, RULES), 256).alias("base_sha256"), joined(found, RULES).alias("spans"))


def _oracle() -> str:
    parts = []
    for order, r in enumerate(RULES):
        pattern = java_pattern(r).replace("'", "''")
        parts.append(f"""
    SELECT rid, {order} AS k, '{r.kind}' AS kind, unnest(generate_series(1, len(m))) AS i, m, g, s FROM (
      SELECT rid, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {r.measured}) AS g,
             string_split_regex(text, '{pattern}') AS s FROM d)""")
    least = "[" + ", ".join(str(r.least) for r in RULES) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
placed AS (
  SELECT rid, k, kind, len(m[i]) AS n, coalesce(list_sum(list_transform(s[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) AS start
  FROM hits WHERE len(g[i]) >= {least}[k + 1]),
spans AS (SELECT rid, k, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS one FROM placed)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(one, ',' ORDER BY start, k) FILTER (k < 3), '')) AS base_sha256,
  coalesce(string_agg(one, ',' ORDER BY start, k) FILTER (k IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (rid) GROUP BY d.rid, d.doc_id
"""


ORACLE = _oracle()
