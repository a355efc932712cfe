"""Citations as rows: the engine over DataFrames.

One Arrow pass per document does what needs text and order (narrow, no shuffle); a JVM-side test
keeps documents without any trigger from reaching Python at all. Everything after that is
relational: views below group, join and aggregate the exploded rows, always with doc_id first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import scalars
from . import zones
from .cleaning import CLEANERS
from .documents import Options, extract
from .patterns import FIRST_GATE, GATE

_STR, _INT, _DBL, _BOOL = pa.string(), pa.int32(), pa.float64(), pa.bool_()
_SPAN = pa.struct([("start", _INT), ("end", _INT)])
_DATE = pa.struct([("iso", _STR), ("year", _INT), ("month", _INT), ("day", _INT)])
_PIN = pa.struct([("page", _INT), ("end_page", _INT), ("footnote", _INT), ("star", _BOOL), ("paragraph", _INT), ("raw", _STR)])
#: The wide, sparse row of a citation; fields that a type lacks are null.
FIELDS = pa.schema([
    ("cite_idx", _INT), ("id", _STR), ("type", _STR), ("pattern_id", _STR), ("matched_text", _STR), ("span", _SPAN), ("source_span", _SPAN), ("full_span", _SPAN), ("confidence", _DBL),
    ("volume", _STR), ("volume_num", pa.int64()), ("reporter", _STR), ("page", pa.int64()), ("has_blank_page", _BOOL), ("pincite", _INT), ("pincite_info", _PIN), ("more_pincites", pa.list_(_PIN)), ("pincite_inherited_from", _INT),
    ("court", _STR), ("normalized_court", _STR), ("inferred_court", pa.struct([("level", _STR), ("jurisdiction", _STR), ("state", _STR), ("confidence", _DBL)])), ("year", _INT), ("date", _DATE),
    ("case_name", _STR), ("plaintiff", _STR), ("defendant", _STR), ("plaintiff_norm", _STR), ("defendant_norm", _STR), ("procedural_prefix", _STR), ("disposition", _STR), ("justices", pa.list_(_STR)), ("scope", _STR), ("normalized_reporter", _STR), ("unpublished", _BOOL),
    ("nominative_volume", _INT), ("nominative_reporter", _STR), ("title", _INT), ("code", _STR), ("section", _STR), ("section_end", _STR), ("subsection", _STR), ("subsection_end", _STR), ("jurisdiction", _STR),
    ("chapter", _STR), ("publisher", _STR), ("edition_label", _STR), ("has_et_seq", _BOOL), ("article", _INT), ("amendment", _INT), ("clause", _INT), ("preamble", _BOOL), ("rule_set", _STR), ("rule", _STR),
    ("journal", _STR), ("series", _STR), ("number", _STR), ("database", _STR), ("congress", _INT), ("edition", _STR), ("subject", _STR), ("work", _STR), ("party_name", _STR), ("party_norm", _STR),
    ("group_id", _STR), ("parallel_secondary", _BOOL), ("parallel_primary", _INT), ("parentheticals", pa.list_(pa.struct([("text", _STR), ("type", _STR), ("start", _INT), ("end", _INT), ("children", pa.list_(_INT))]))),
    ("nested_in", _INT), ("history", pa.list_(pa.struct([("signal", _STR), ("raw_signal", _STR), ("ord", _INT)]))), ("history_of", _INT), ("history_signal", _STR), ("signal", _STR),
    ("string_group_id", _STR), ("string_group_index", _INT), ("string_group_size", _INT), ("footnote_number", _INT), ("generated", _BOOL), ("first_of_reporter", _BOOL), ("warnings", pa.list_(_STR)),
    ("resolution", pa.struct([("resolved_to", _INT), ("confidence", _DBL), ("failure_reason", _STR), ("warnings", pa.list_(_STR)), ("antecedent", _INT)])), ("bluebook", _STR), ("reporter_key", _STR), ("content_hash", _STR),
])


def _spark_type(t: pa.DataType) -> T.DataType:
    if pa.types.is_struct(t):
        return T.StructType([T.StructField(f.name, _spark_type(f.type)) for f in t])
    if pa.types.is_list(t):
        return T.ArrayType(_spark_type(t.value_type))
    return {_STR: T.StringType(), _INT: T.IntegerType(), pa.int64(): T.LongType(), _DBL: T.DoubleType(), _BOOL: T.BooleanType()}[t]


CITATION = T.StructType([T.StructField(f.name, _spark_type(f.type)) for f in FIELDS])


_SPANS = frozenset(("span", "source_span", "full_span"))
_DERIVED = _SPANS | {"bluebook", "reporter_key", "content_hash"}
#: The fields that the views below read, for extract_citations.
GROUP_FIELDS = ("cite_idx", "type", "group_id", "volume", "reporter", "page", "resolution.resolved_to")
EDGE_FIELDS = ("cite_idx", "group_id", "nested_in", "history_of", "pincite_inherited_from", "string_group_id", "resolution.resolved_to", "resolution.antecedent")


def named_fields(names: Iterable[str]) -> pa.Schema:
    """The fields of these names; "field.part" is a struct of those of its parts that are named."""
    parts: dict[str, list[str]] = {}
    for name in names:
        head, _, part = name.partition(".")
        parts.setdefault(head, []).append(part)
    whole = lambda head: FIELDS.field(head)
    return pa.schema([whole(h) if "" in p else pa.field(h, pa.struct([whole(h).type.field(x) for x in dict.fromkeys(p)])) for h, p in parts.items()])


def with_derived(c: dict, names: list[str] = FIELDS.names) -> dict:
    """A citation with the fields that are derived from others; keys that are no fields stay and are ignored."""
    for name in _SPANS.intersection(names):
        c[name] = dict(zip(("start", "end"), c["full_span"] if name == "full_span" else (c["start"], c["end"]) if name == "span" else (c["source_start"], c["source_end"]), strict=True))
    if "bluebook" in names:
        c["bluebook"] = scalars.bluebook(c)
    if "reporter_key" in names:
        c["reporter_key"] = scalars.reporter_key(c)
    if "content_hash" in names:
        c["content_hash"] = scalars.content_hash(c["matched_text"])
    return c


def row_of(c: dict) -> dict:
    """A citation as a row of FIELDS."""
    c = with_derived(dict(c))
    return {k: c[k] for k in FIELDS.names if k in c}


#: Texts handed to the engine at once; documents are far larger than other rows.
_SLICE = 64


#: Inputs below this size may come as one file; they are dealt out before the engine runs.
_SMALL_BYTES = 256 << 20


def spread(docs: DataFrame) -> DataFrame:
    """Small inputs over all cores, since the work is in the rows; large ones keep their splits and are not shuffled."""
    if docs.isStreaming:
        return docs
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism * 2) if size < _SMALL_BYTES else docs


def may_cite(text: Column | str, options: Options = Options()) -> Column:
    """False only where a text holds no citation, null and empty ones among them; a JVM expression.

    With other cleaners or patterns than the default ones nothing is known, so any text may.
    """
    column = F.col(text) if isinstance(text, str) else text
    if options.patterns is not None or options.cleaners is not CLEANERS or options.more_cleaners:
        return F.coalesce(F.length(column) > 0, F.lit(False))
    return F.coalesce(F.regexp_like(column, F.lit(FIRST_GATE)) | F.regexp_like(column, F.lit(GATE)), F.lit(False))


def extract_citations(docs: DataFrame, options: Options = Options(), text: str = "text", key: str = "doc_id", fields: Iterable[str] | None = None) -> DataFrame:
    """key and the fields of a citation (all of them, or those named, or "field.part"), one row each, for all documents.

    The rows of a document stay together. Null and empty texts give no rows; a text of any length is read whole.
    """
    chosen_fields = FIELDS if fields is None else named_fields(fields)
    out = pa.schema([(key, pa.string()), *chosen_fields])
    names = chosen_fields.names
    derived = not _DERIVED.isdisjoint(names)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                keys, rows = [], []
                for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    cites = extract(x, options)[1]
                    keys += [k] * len(cites)
                    rows += [with_derived(c, names) for c in cites] if derived else cites
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([r.get(f.name) for r in rows], f.type) for f in chosen_fields)], schema=out)

    schema = T.StructType([T.StructField(key, T.StringType()), *(T.StructField(f.name, _spark_type(f.type)) for f in chosen_fields)])
    chosen = docs.select(F.col(key).cast("string").alias(key), F.col(text).alias("text")).filter(may_cite("text", options))
    rows = spread(chosen).mapInArrow(run, schema)
    return rows.withColumn(key, F.col(key).cast(kind))


def per_document(docs: DataFrame, function, schema: str, options: Options = Options()) -> DataFrame:
    """doc_id and the rows that function(source, cleaned text, citations) returns as dicts."""
    target = to_arrow_schema(T.StructType.fromDDL(f"doc_id string, {schema}"))
    names = target.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part, rows = batch.slice(at, _SLICE), []
                for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    doc, cites = extract(x, options)
                    rows += [{"doc_id": k} | {n: r.get(n) for n in names} for r in function(x or "", doc.text, cites)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)

    kind = docs.schema["doc_id"].dataType
    rows = spread(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")).mapInArrow(run, f"doc_id string, {schema}")
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


def quote_attributions(docs: DataFrame, options: Options = Options()) -> DataFrame:
    return per_document(docs, lambda source, text, cites: zones.attribute_quotes(text, cites), "start int, end int, cite_idx int, confidence double, kind string", options)


def prose_spans(docs: DataFrame, options: Options = Options()) -> DataFrame:
    return per_document(docs, lambda source, text, cites: zones.prose(text, cites), "start int, end int, before int", options)


def footnote_zones(docs: DataFrame) -> DataFrame:
    return per_document(docs, lambda source, text, cites: zones.footnotes(source), "start int, end int, number int", Options(resolve=False))


def annotated(docs: DataFrame, before: str = "<cite>", after: str = "</cite>", options: Options = Options(), callback=None, escape: bool = True, clean: bool = False) -> DataFrame:
    """doc_id, annotated, skipped (cite_idx), moved (places before and after); clean: marks in the cleaned text, not in the source."""
    span = ("start", "end") if clean else ("source_start", "source_end")

    def one(source, text, cites):
        marked, skipped, moved = zones.annotate(text if clean else source, cites, before, after, callback, escape, span)
        return [{"annotated": marked, "skipped": skipped, "moved": moved}]

    return per_document(docs, one, "annotated string, skipped array<int>, moved array<struct<cite_idx:int,start:int,end:int,new_start:int,new_end:int>>", options)


def contexts(docs: DataFrame, unit: str = "sentence", most: int | None = None, options: Options = Options()) -> DataFrame:
    """doc_id, cite_idx, context: the sentence or paragraph of the source around each citation."""

    def one(source, text, cites):
        return [{"cite_idx": c["cite_idx"], "context": scalars.surrounding(source, c["source_start"], c["source_end"], unit, most)} for c in cites]

    return per_document(docs, one, "cite_idx int, context string", options)


def locators(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, cite_idx and a durable locator of each citation in the source."""

    def one(source, text, cites):
        return [{"cite_idx": c["cite_idx"]} | (scalars.durable_locator(source, c["source_start"], c["source_end"]) or {}) for c in cites]

    return per_document(docs, one, "cite_idx int, v int, exact string, prefix string, suffix string, start int, end int, occurrence int, content_hash string", options)


def analyze(docs: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    """All views of a corpus by name: citations, edges, parallel and case groups, quotes, prose, footnotes."""
    cites = extract_citations(docs, options)
    return {"citations": cites, "edges": graph_edges(cites), "parallels": parallel_groups(cites), "cases": case_groups(cites), "quotes": quote_attributions(docs, options), "prose": prose_spans(docs, options), "footnotes": footnote_zones(docs)}


def cleaned(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, clean_text and the segments that map it onto the source."""
    from .cleaning import clean_text

    def one(source, text, cites):
        doc = clean_text(source, options.cleaners, options.more_cleaners)
        return [{"clean_text": doc.text, "segments": doc.segments()}]

    return per_document(docs, one, "clean_text string, segments array<struct<clean_pos:int,orig_pos:int,len:int>>", options.with_(patterns=()))


# ---------------------------------------------------------------- relational views over citation rows


def parallel_groups(cites: DataFrame) -> DataFrame:
    """doc_id, group_id, members (ids in document order) of groups with at least two."""
    groups = cites.filter("group_id is not null").groupBy("doc_id", "group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cite_idx", "id"))), lambda x: x["id"]).alias("members"))
    return groups.filter(F.size("members") >= 2)


def case_groups(cites: DataFrame) -> DataFrame:
    """doc_id, case_key, mentions, full_mentions, short_mentions: full cites and the short forms that resolve to them.

    The citations are read once and shuffled once: a short form goes to the place of the cite that it means.
    """
    key = F.coalesce("group_id", F.concat_ws("-", "volume", F.regexp_replace("reporter", r"\s+", "."), F.coalesce(F.col("page").cast("string"), F.lit("___"))))
    full = F.col("type") == "case"
    short = F.col("type").isin("id", "supra", "shortFormCase") & F.col("resolution.resolved_to").isNotNull()
    placed = cites.filter(full | short).select("doc_id", F.when(full, F.col("cite_idx")).otherwise(F.col("resolution.resolved_to")).alias("place"), F.when(full, key).alias("case_key"))
    places = placed.repartition("doc_id").groupBy("doc_id", "place").agg(F.collect_list("case_key").alias("keys"), F.count_if(F.col("case_key").isNull()).alias("shorts"))
    return places.select("doc_id", F.explode("keys").alias("case_key"), "shorts").groupBy("doc_id", "case_key").agg(
        (F.count("*") + F.sum("shorts")).alias("mentions"), F.count("*").alias("full_mentions"), F.sum("shorts").alias("short_mentions")
    )


def graph_edges(cites: DataFrame) -> DataFrame:
    """doc_id, edge, from_idx, to_idx: the document's citation graph, without self-edges or repeats;
    antecedent: the citation just before a short form in its scope, by position.

    The citations are read once. What a citation points to itself needs only its row; the members of parallel and
    string groups, and only they, meet by document and group. One shuffle, by document, serves groups and repeats.
    """
    pointers = (("resolves-to", "resolution.resolved_to"), ("antecedent", "resolution.antecedent"), ("in-parenthetical-of", "nested_in"), ("history-of", "history_of"), ("pincite-inherit", "pincite_inherited_from"))
    groups = (("parallel", "group_id"), ("string-cite", "string_group_id"))
    entry = lambda kind, target, member: F.struct(F.lit(kind).alias("edge"), target.cast("int").alias("to_idx"), member.cast("string").alias("member_of"))
    entries = F.array(*(entry(k, F.col(t), F.lit(None)) for k, t in pointers), *(entry(k, F.lit(None), F.col(n)) for k, n in groups))
    flat = cites.select("doc_id", F.col("cite_idx").alias("from_idx"), F.inline(entries)).filter("to_idx is not null or member_of is not null")
    links = """CASE edge
        WHEN 'parallel' THEN flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> named_struct('from_idx', x.from_idx, 'to_idx', y.from_idx))))
        WHEN 'string-cite' THEN transform(slice(m, 1, size(m) - 1), (x, i) -> named_struct('from_idx', x.from_idx, 'to_idx', m[i + 1].from_idx))
        ELSE m END"""
    grouped = flat.repartition("doc_id").groupBy("doc_id", "edge", "member_of").agg(F.sort_array(F.collect_set(F.struct("from_idx", "to_idx"))).alias("m"))
    return grouped.select("doc_id", "edge", F.inline(F.expr(links))).filter("from_idx <> to_idx").dropDuplicates(["doc_id", "edge", "from_idx", "to_idx"])


def reporter_summary(cites: DataFrame) -> DataFrame:
    """reporter, cites, documents (input rows that cite it), first_year, last_year over the corpus.

    The first citation of a reporter in each document is marked where it is extracted, so documents are
    counted before the shuffle and none of their keys travels.
    """
    return cites.filter("type = 'case'").groupBy("reporter").agg(F.count("*").alias("cites"), F.count_if("first_of_reporter").alias("documents"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def reporters(spark: SparkSession) -> DataFrame:
    """The reporter dimension: reporter, key (lower case, no spaces or dots), level, jurisdiction, state."""
    from . import lexicon as lx
    from .parsers import KNOWN_REPORTERS

    rows = {lx.bare(r): (r, lx.bare(r), None, None, None) for r in KNOWN_REPORTERS}
    rows |= {key: (printed, key, level or None, jurisdiction, state) for key, (printed, level, jurisdiction, state) in lx.reporter_table().items()}
    return spark.createDataFrame(list(rows.values()), "reporter string, key string, level string, court_jurisdiction string, state string")


def validate(cites: DataFrame, boost: float = 0.2, penalty: float = 0.3) -> DataFrame:
    """cites with ``validated``: confidence raised where the reporter is in the dimension, lowered where it is not."""
    dim = F.broadcast(reporters(cites.sparkSession).select(F.col("reporter").alias("known")))
    joined = cites.join(dim, F.col("reporter") == F.col("known"), "left")
    score = F.when(F.col("type") != "case", F.col("confidence")).when(F.col("known").isNotNull(), F.least(F.lit(1.0), F.col("confidence") + boost)).otherwise(F.greatest(F.lit(0.0), F.col("confidence") - penalty))
    return joined.withColumn("validated", F.round(score, 2)).drop("known")


def find_reporters(rows: DataFrame, printed: str) -> DataFrame:
    """rows with ``reporter``: the reporter that the printed form means, whatever its case and spacing; null if unknown.

    The key is made in the JVM and the dimension, of fewer than 200 rows, is broadcast.
    """
    key = F.regexp_replace(F.lower(F.col(printed)), r"[.\s']", "")
    fixed = F.regexp_replace(key, r"(?<=[23])(?:nd|rd|ds|cl)$", "d")
    dim = F.broadcast(reporters(rows.sparkSession).select("reporter", "key"))
    return rows.withColumn("key", fixed).join(dim, "key", "left").drop("key")


def similar_names(names: DataFrame, edits: int) -> DataFrame:
    """name, other, distance: all pairs of distinct names (name < other) within so many edits.

    A longer name that is within ``edits`` of a shorter one holds one of the shorter's edits + 1 parts unchanged,
    at most ``edits`` places away; names meet on those parts only, and the bounded distance decides. Null names take
    no part; names shorter than edits + 1 have empty parts, which meet every name of nearly their length.
    """
    n = names.select("name").filter("name is not null").distinct().withColumn("size", F.length("name"))
    parts = edits + 1
    # part i of a name of length l starts at l * i / parts
    at = lambda size, i: F.floor(size * i / parts).cast("int")
    number = F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("part")
    short = n.select(F.col("name").alias("short"), F.col("size").alias("length"), number)
    start = at(F.col("length"), F.col("part"))
    short = short.withColumn("piece", F.substring("short", start + 1, at(F.col("length"), F.col("part") + 1) - start))
    long = n.select(F.col("name").alias("long"), "size", F.explode(F.sequence(F.greatest(F.col("size") - edits, F.lit(0)), F.col("size"))).alias("length")).select("*", number)
    begin, width = at(F.col("length"), F.col("part")), at(F.col("length"), F.col("part") + 1) - at(F.col("length"), F.col("part"))
    places = F.sequence(F.greatest(begin - edits, F.lit(0)), F.greatest(F.least(begin + edits, F.col("size") - width), F.greatest(begin - edits, F.lit(0))))
    long = long.withColumn("piece", F.explode(F.array_distinct(F.transform(places, lambda k: F.substring(F.col("long"), k + 1, width)))))
    met = short.join(long, ["length", "part", "piece"]).filter("short <> long").select(F.least("short", "long").alias("name"), F.greatest("short", "long").alias("other")).distinct()
    return met.withColumn("distance", F.levenshtein("name", "other", edits)).filter("distance >= 0")
