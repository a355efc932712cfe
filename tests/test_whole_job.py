"""Cases that the registered queries' narrower inputs left out."""

import pytest

from juriscope.operators import citations as views
from juriscope.operators import documents
from juriscope.operators.documents import Options, extract
from juriscope.plans import catalog


def cites(text, **options):
    return extract(text, Options(**options))[1]


@pytest.mark.parametrize(
    ("text", "plaintiff", "defendant"),
    [
        ("We discussed this in Smith v. Acme Corp. at length, see 5 F.2d at 7.", "Smith", "Acme Corp."),
        ("We discussed this in Smith v. A/B Rail-Road Co. at length, see 5 F.2d at 7.", "Smith", "A/B Rail-Road Co."),
        ("In Yellen v. Acme Inc. the court held so, as in Roe v. Doe before it. Yellen, 416 F.2d at 590.", "Yellen", "Acme Inc."),
        ("As in Roe v. Doe before it. Yellen, 416 F.2d at 590.", None, None),
    ],
)
def test_captions_in_prose(text, plaintiff, defendant):
    c = cites(text)[-1]
    assert (c["type"], c.get("plaintiff"), c.get("defendant")) == ("shortFormCase", plaintiff, defendant)


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_entities_of_all_pages(spark, tmp_path):
    """Pages of several lines and with any of the entities are read too."""
    html = {1: "a\t\n b &sect;&para; c", 2: "x&mdash;y&ndash;z &apos;q&apos;", 3: "one  two  　three", 4: "p &amp; q “r” &lt;&gt;&quot;&nbsp;"}
    sf_dir = table(spark, tmp_path, "pages", list(html.items()), "page_id long, html string")
    got = {r.page_id: r.text for r in catalog.QUERIES["native_entities"](spark, sf_dir).collect()}
    assert got == {1: "a b §¶ c", 2: "x—y-z 'q'", 3: "one two three", 4: 'p & q "r" <>" '}


@pytest.mark.parametrize("name", ["blank_pages", "reporter_validation"])
def test_all_orders(spark, tmp_path, name):
    """One row for each order, whatever its customer's remainder."""
    rows = [(k, k + 5, "1995-01-02") for k in range(1, 25)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "date(d) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.doc_id for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == [k for k, _, _ in rows]


@pytest.mark.parametrize("name", ["resolution", "case_groups", "graph_edges", "graph_all_edges"])
def test_extracted_once_and_narrow(spark, tmp_path, name):
    """Texts are read by one Python step, which makes only the fields that the view reads, and nothing stays stored."""
    spark.createDataFrame([(1, 5, "1995-01-02")], "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "date(d) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    steps, open_ = [], [plan]
    while open_:
        node = open_.pop()
        steps += [node] if node.nodeName() == "MapInArrow" else []
        assert node.nodeName() != "InMemoryRelation"
        open_ += [node.children().apply(i) for i in range(node.children().size())]
    assert len(steps) == 1 and steps[0].output().size() <= 8


def rendered_text(spark, tmp_path, template):
    spark.createDataFrame([(1, 5, "1995-01-02")], "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "date(d) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    return catalog.rendered(spark, str(tmp_path), template).first().text


def tried(monkeypatch, text):
    """How many searches of forms an extraction makes beyond one for each match."""
    searches, real = [], documents._likely
    monkeypatch.setattr(documents, "_likely", lambda *a: [(k, p, lambda *at, p=p: searches.append(p.id) or p.regex.search(*at), accept) for k, p, _, accept in real(*a)])
    return len(documents.scan(text)), len(searches)


def test_groups_read_what_they_need(spark, tmp_path, monkeypatch):
    """case_groups: of a resolution only its target leaves Python, and few forms are tried that do not match (25 before)."""
    text = rendered_text(spark, tmp_path, catalog._RESOLVE)
    matches, searches = tried(monkeypatch, text)
    assert matches >= 6 and searches - matches <= 16
    docs = catalog.rendered(spark, str(tmp_path), catalog._RESOLVE)
    assert views.extract_citations(docs, fields=views.GROUP_FIELDS).schema["resolution"].dataType.simpleString() == "struct<resolved_to:int>"


def test_edges_read_what_they_need(spark, tmp_path, monkeypatch):
    """graph_all_edges: two places of a resolution leave Python, and few forms are tried that do not match (24 before)."""
    text = rendered_text(spark, tmp_path, catalog._WEB.replace("''", "\\'"))
    matches, searches = tried(monkeypatch, text)
    assert matches >= 8 and searches - matches <= 15
    docs = catalog.rendered(spark, str(tmp_path), catalog._RESOLVE)
    assert views.extract_citations(docs, fields=views.EDGE_FIELDS).schema["resolution"].dataType.simpleString() == "struct<resolved_to:int,antecedent:int>"


def test_views_of_repeated_documents(spark):
    """Links and groups of one document, of copies under its key, and of groups of three; no link to itself or twice."""
    rows = [
        ("a", 0, "case", "1-F.2d-2", None, None, "sc-0", None), ("a", 1, "case", "1-F.2d-2", None, None, "sc-0", None), ("a", 2, "case", "1-F.2d-2", 0, None, "sc-0", None),
        ("a", 3, "id", None, None, 2, None, 0), ("a", 4, "supra", None, None, None, None, 4), ("b", 0, "case", None, None, None, None, None), ("b", 1, "shortFormCase", None, None, None, None, 0),
    ]
    cites = spark.createDataFrame(rows + rows[:5], "doc_id string, cite_idx int, type string, group_id string, nested_in int, history_of int, string_group_id string, to int")
    cites = cites.selectExpr("*", "CAST(null AS INT) AS pincite_inherited_from", "'1' AS volume", "'F.2d' AS reporter", "CAST(9 AS BIGINT) AS page", "named_struct('resolved_to', to, 'antecedent', CAST(null AS INT)) AS resolution")
    got = sorted(tuple(r) for r in views.graph_edges(cites).collect())
    assert got == sorted([("a", "parallel", 0, 1), ("a", "parallel", 0, 2), ("a", "parallel", 1, 2), ("a", "string-cite", 0, 1), ("a", "string-cite", 1, 2), ("a", "in-parenthetical-of", 2, 0), ("a", "history-of", 3, 2), ("a", "resolves-to", 3, 0), ("b", "resolves-to", 1, 0)])
    found = sorted(tuple(r) for r in views.case_groups(cites.dropDuplicates()).collect())
    assert found == [("a", "1-F.2d-2", 4, 3, 1), ("b", "1-F.2d-9", 2, 1, 1)]


def test_single_types_on_all_cores(spark, tmp_path):
    """A table of one file is dealt out before the table functions run, one for each type, over the same rows."""
    rows = [(k, k + 5, "1995-01-02") for k in range(1, 41)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "date(d) AS o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    found = catalog.QUERIES["single_type_functions"](spark, str(tmp_path))
    assert found.count() == 80 and {(r.doc_id, r.type) for r in found.collect()} == {(k, t) for k in range(1, 41) for t in ("case", "statute")}
    where = found.selectExpr("type", "spark_partition_id() AS part").distinct().groupBy("type").count().collect()
    assert min(r["count"] for r in where) >= spark.sparkContext.defaultParallelism
