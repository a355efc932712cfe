"""HTML rendering, the quality classifier and the pipeline."""

import random
import re
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from juriscope.llm import quality
from juriscope.llm.html_layout import extract, op7_html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"), ("<table><tr><td>ab<td>c<tr><td>d<td>ef</table>", "ab | c\nd  | ef"),
        ("a<script>var x='<p>'</script>b<style>p{}</style>c", "abc"), ("<head><title>t</title></head><body>x", "x"), ("<p hidden>a</p>b<div style='display: none'>c</div>", "b"), ("a &amp; b&nbsp;c", "a & b\xa0c"),
        ("<pre>a\n  b</pre>", "a\n  b"), ("x<br>y", "x\ny"), ("<!-- a -->b<!-- c", "b"), ("a < b", "a < b"), (None, ""), ("", ""), ("<div>" * 3000 + "x", "x"), ("<b>a</b>  <i>b</i>", "a b"), ("<img alt='pic'>", "pic"),
    ],
)
def test_rendering(page, text):
    assert extract(page) == text


def test_pages(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, "u", None), (None, "u", "<ul><li>x")]
    got = op7_html(spark.createDataFrame(rows, "page_id long, text string, html string")).collect()
    assert sorted(map(str, (r.text for r in got))) == ["", "- x", "a", "a"]
    assert op7_html(spark.createDataFrame([], "page_id long, html string")).collect() == []


def good(i):
    return " ".join(f"{'aeiou'[(i + k) % 5]}{'nrst'[(i * k) % 4]}ing" for k in range(60)) + "."


def bad(i):
    return " ".join(f"{'AEIOU'[(i + k) % 5]}ING!!" for k in range(60))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, good(i) if i % 3 else bad(i), "en", f"s{i % 4}") for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, "en", "s0"), (901, "", None, None), (None, "x", "en", "s1")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, 1, 0), (901, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(labelled):
    docs, labels = labelled
    got = quality.op9_quality(docs, labels).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held) and len(held) > 50
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95


def test_quality_without_labels(spark, labelled, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.op9_quality(labelled[0], none).count() == 303
    assert quality.op9_quality(no_docs, labelled[1]).collect() == []


def test_network_covers_the_whole_text():
    """A change anywhere, even at the end of a very long text, reaches the score."""
    net = quality.Network.fresh(1)
    text = b"abc " * 50_000
    scores = quality.predict(net, [text, text[:-8] + b"\xf0\x9f\x98\x80ZZZZ"])
    assert len(scores) == 2 and quality.predict(net, [b""]).shape == (1,)
    assert scores[0] != scores[1]


def test_pipeline(spark, labelled, tmp_path):
    docs, labels = labelled
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, good(1))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, seen, str(tmp_path))
        path = str(tmp_path / name)
        after.write.parquet(path)
        after = spark.read.parquet(path)
        if name != "sharding":
            assert after.columns == docs.columns
        seen = after
    ids = {r.doc_id for r in seen.collect()}
    assert ids and not any(i is not None and i < 300 and i % 3 == 0 for i in ids)  # rejected texts are gone
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen.count()


def test_rows_below_a_spanning_cell():
    """A cell over several rows keeps its column in the rows below, up to the end of its row group."""
    below = lambda page: [line.index("z") for line in extract(page).splitlines() if "z" in line]
    spanning = "<table><tr><td rowspan=3>long one<td>y<tr><td>z<tr><td>z</table>"
    assert below(spanning) == [below("<table><tr><td>long one<td>y<tr><td>u<td>z</table>")[0]] * 2
    grouped = "<table><tbody><tr><td rowspan=0>long one<td>y<tbody><tr><td>z<td>w</table>"
    assert below(grouped) == [0]


def test_raw_end_after_growing_letters():
    """Letters that lower-case to two characters do not move the end of a raw element."""
    assert extract("\u0130" * 12 + "<SCRIPT>x</Script>seen <b>too</b>") == "\u0130" * 12 + "seen too"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td><ul><li>a<li>b</ul><td>x<tr><td>c<td>y</table>", "- a | x\n- b\nc   | y"), ("<table><tr><td><p>one<p>two</table>", "one\n\ntwo"),
        ("<table><tr><td><table><tr><td>a<td>b</table><td>side</table>", "a | b\nside"), ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b></div>", "b"),
        ("<style>.x, p.y{display:none} @media print{.z{display:none}} #k{visibility:hidden}</style><p class='w x'>a<p class=y>b</p><i class=y>c</i><p class=z>d<p id=k>e", "c\n\nd"),
        ("<details><summary>s</summary>t</details><details open><summary>u</summary>v</details>", "s\nu\nv"), ("<pre>\na\n b</pre>", "a\n b"), ("<p>a</p><table><tr><td colspan=1000>b<td>c<tr><td>d<td>e</table>", "a\n\nb     | c\nd | e"),
        ("<p style='x'>a<p style='y' STYLE='display:none'>b", "a\n\nb"), ("<blockquote>a<blockquote>b</blockquote>c</blockquote>d", "  a\n\n    b\n\n  c\n\nd"), ("<table role=presentation><tr><td>a<td>b</table>", "a\nb"),
    ],
)
def test_layout(page, text):
    assert extract(page) == text


def plain_tree(page):
    """The builder with a stack that is walked element by element."""
    from juriscope.llm import html_layout as h

    root = h.Node("html", {})
    stack = [root]

    def close(names, stops):
        again = True
        while again:
            again = False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in names:
                    del stack[k:]
                    again = True
                    break
                if stack[k].tag in stops:
                    break

    for slash, tag, text in re.findall(r"<(/?)(\w+)>|([^<]+)", page):
        if text:
            stack[-1].children.append(text)
        elif slash:
            if tag == "p" and all(n.tag != "p" for n in stack):
                stack[-1].children.append(h.Node("p", {}))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("table", "td", "th") and tag not in ("table", "tbody", "thead", "tfoot", "tr", "body", "html"):
                    break
        else:
            if tag in h._CLOSES_P:
                close({"p"}, h._P_STOPS)
            if tag in h.CLOSES:
                close(*h.CLOSES[tag])
            stack[-1].children.append(h.Node(tag, {}))
            stack.append(stack[-1].children[-1])
    return root


def test_tree_against_walking_the_stack():
    from juriscope.llm import html_layout as h

    shape = lambda n: n if isinstance(n, str) else (n.tag, [shape(c) for c in n.children])
    rng = random.Random(3)
    tags = "p div b ul li table tr td th tbody dl dt dd option select span".split()
    for _ in range(600):
        page = "".join(rng.choice((f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "x ")) for _ in range(rng.randint(1, 60)))
        assert shape(h.build(page)) == shape(plain_tree(page)), page


@pytest.mark.parametrize("unit", ["<div>", "<p><div>", "<blockquote>", "<ul><li>", "<table><tr><td>", "<b>x", "</div>", "<td>y", "<a href='", "<dl><dd>", "<p>a<table><td><div>"])
def test_long_pages_take_time_in_proportion(unit):
    """Nested or unclosed tags without end: eight times the page takes about eight times as long."""
    took, sizes = [], []
    for size in (50_000, 400_000):
        page = unit * (size // len(unit)) + "end"
        began = time.perf_counter()
        sizes.append(len(extract(page)) / len(page))
        took.append(time.perf_counter() - began)
    assert took[1] < 20 * max(took[0], 0.02) and took[1] < 10 and max(sizes) < 50


def test_output_grows_with_the_page():
    page = "<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 2000 + "<tr><td colspan=1000>c<td colspan=1000>d" * 300 + "</table>"
    text = extract(page)
    assert len(text) < 20 * len(page) and "x" * 20_000 in text
