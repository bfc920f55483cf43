"""XML books, web exports, proof routes and paths on small inputs."""

from __future__ import annotations

import random
import re
import time

from lemmaflow.functions import tex, text
from lemmaflow.operators import regions, views
from lemmaflow.plans import graph
from lemmaflow.sources import books, markup
from pyspark.sql import functions as F

XML = """<chapter><!-- <theorem/> --><definition xml:id="d"><title>A &amp; B</title><statement>Sets<idx>no</idx>.</statement></definition>
<theorem xml:id="t"><statement><p>See <xref ref="d"/>.</p></statement><proof>By <xref ref="d"/> and <xref ref="t"/>.</proof></theorem><proof>Stray <xref ref="d"/></proof>
<lemma xml:id="l"><statement>So</statement></lemma><remark><p>x</p></remark><proof><![CDATA[<xref ref="d"/>]]>By <xref ref="t"/>, <xref ref="t"/>, <xref ref="two"/> and <xref/></proof>
<claim xml:id="two"/><fact xml:id="two"/><fact><statement>Open"""

WXR = """<rss xmlns:wp="http://w" xmlns:content="http://c"><channel><title>Book</title>
<item><title>Two  words</title><wp:post_id>7</wp:post_id><wp:post_parent>3</wp:post_parent><wp:menu_order>1</wp:menu_order><wp:post_type>chapter</wp:post_type><wp:status>publish</wp:status><content:encoded><![CDATA[<h1>Theorem</h1>]]></content:encoded></item>
<item><title>Part</title><wp:post_id>3</wp:post_id><wp:menu_order>2</wp:menu_order><wp:post_type>part</wp:post_type><wp:status>web-only</wp:status><wp:postmeta><wp:meta_key>pb_part_content</wp:meta_key><wp:meta_value>Intro</wp:meta_value></wp:postmeta><wp:postmeta><wp:meta_key>pb_part_content</wp:meta_key><wp:meta_value>later</wp:meta_value></wp:postmeta></item>
<item><title>Off</title><wp:post_id>9</wp:post_id><wp:post_type>chapter</wp:post_type><wp:status>publish</wp:status><wp:postmeta><wp:meta_key>pb_export</wp:meta_key><wp:meta_value>Off</wp:meta_value></wp:postmeta></item>
<item><title>Front</title><wp:post_id>4</wp:post_id><wp:post_type>front-matter</wp:post_type><wp:status>publish</wp:status></item>
<item><title>Alone</title><wp:post_id>x</wp:post_id><wp:post_parent>99</wp:post_parent><wp:post_type>chapter</wp:post_type><wp:status>publish</wp:status></item>
</channel></rss>"""


def units(spark, *texts):
    return spark.createDataFrame([("S", f"u{n}", n, t) for n, t in enumerate(texts)], "component string, unit string, ordinal int, content string")


def test_xml_book(spark):
    made = markup.extract_xml(units(spark, XML, "", None))
    nodes = {(r.node, r.node_class, r.title, r.statement) for r in made["node"].collect()}
    assert nodes == {("d", "support", "A & B", "Sets ."), ("t", "theorem-like", "", "See ."), ("l", "theorem-like", "", "So"), ("two", "theorem-like", "", ""), ("fact-u0-0002", "theorem-like", "", "Open")}
    assert {(r.theorem, r.target, r.role, r.occurrences) for r in made["dependency"].collect()} == {("t", "d", "definition", 1), ("l", "t", "logical", 2)}
    assert {(r.theorem, tuple(r.targets)) for r in made["route"].collect()} == {("t", ("d",)), ("l", ("t",))}
    references = sorted((r.owner, r.basis, r.ref, r.status) for r in made["reference"].collect())
    assert references == [("l", "proof-xref", "missing-ref-attribute", "unresolved"), ("l", "proof-xref", "t", "resolved"), ("l", "proof-xref", "t", "resolved"), ("l", "proof-xref", "two", "unresolved"), ("t", "proof-xref", "d", "resolved"), ("t", "proof-xref", "t", "unresolved"), ("t", "statement-xref", "d", "resolved")]
    included = markup.includes(units(spark, '<a><xi:include href="ch/u1.ptx"/></a>', "<b/>"))
    assert [(r.src, r.dst) for r in included.collect()] == [("u0", "u1")]


def test_export(spark, tmp_path):
    (tmp_path / "book.xml").write_text(WXR)
    items = markup.read_export(spark, str(tmp_path / "book.xml"), "B")
    assert {(r.post_id, r.content, r.exported) for r in items.collect()} == {(7, "<h1>Theorem</h1>", True), (3, "Intro", True), (9, "", False), (4, "", True), (-1, "", True)}
    assert [r.title for r in markup.ordered_items(items).orderBy("position").collect()] == ["Front", "Part", "Two words", "Alone"]


def test_alternative_proofs(spark):
    proof = "\\begin{proof}[%s] x \\end{proof}\n"
    book = "\\begin{theorem}\\label{a} y \\end{theorem}\n" + proof % "First proof" + proof % "Remark" + proof % "Second proof" + "\\begin{theorem}\\label{b} y \\end{theorem}\n" + proof % "Third proof" + proof % "Hint"
    routes = books.extract_tex(units(spark, book))["route"]
    assert sorted((r.theorem, r.route) for r in routes.collect()) == [("u0:a", 1), ("u0:a", 3), ("u0:b", 1)]


def test_first_paths(spark):
    edges = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 4, 0), (3, 4, 0), (3, 5, 1), (6, 5, 0)], "src int, dst int, seq int")
    roots = spark.createDataFrame([(6, 2), (1, 1)], "root int, seq int")
    found = graph.first_paths(edges, roots, spark.createDataFrame([(4,), (5,), (1,), (8,)], "target int"))
    assert sorted((r.target, r.position, r.node) for r in found.collect()) == [(1, 1, 1), (4, 1, 1), (4, 2, 2), (4, 3, 4), (5, 1, 1), (5, 2, 3), (5, 3, 5)]


def test_views(spark):
    rows = spark.createDataFrame([(1, "provisional", None, {"doi": "1"}), (2, "gold", "t", {}), (3, "provisional", "u", None)], "id int, status string, title string, ids map<string,string>")
    gold = spark.createDataFrame([(1, "gold", "new", {"doi": "2", "arxiv": "3"}), (2, "gold", "x", {}), (3, "open", "x", {})], "id int, status string, title string, ids map<string,string>")
    done, refused = views.promote(rows, gold, "id", ["ids"], {}, [])
    assert [(r.id, r.status, r.title, r.ids) for r in done.collect()] == [(1, "gold", "new", {"doi": "1", "arxiv": "3"})]
    assert {(r.id, r.reason) for r in refused.collect()} == {(2, "existing row is not provisional"), (3, "new row is not gold")}
    one = spark.range(1).select(views.locator_pieces(F.lit("L1; L2")).alias("a"), views.locator_pieces(F.lit(None).cast("string")).alias("b"), text.edition_year(F.lit("<edition>Third, 2019</edition>")).alias("c"), text.edition_year(F.lit("Released in May 2020")).alias("d"), text.edition_year(F.lit("x")).alias("e"), text.identity_text(F.lit("Émile &amp; Co.")).alias("f"))
    assert tuple(one.first()) == (2, 0, 2019, 2020, None, "e mile co")
    same = text.same_identity(F.lit("a"), F.lit("a"), F.lit("b c"), F.lit("b"))
    assert spark.range(1).select(same.alias("x"), text.same_identity(F.lit(""), F.lit(""), F.lit("b"), F.lit("b")).alias("y")).first() == (True, False)


def test_tags_of_random_text_as_by_backtracking():
    """The linear scanner against the plain pattern, which is slow on tags that never end."""
    tag = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    rng = random.Random(3)
    pieces = ["<a", "<b", "</a", ">", "/>", '"', "'", " x=", " y='1'", ' z="2 > 1"', "<!--", "-->", "<![CDATA[", "]]>", "text ", "<", "=", "\n", "W:i="]
    for _ in range(4000):
        source = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        plain = [(m.start(), m.end(), bool(m[1]), m[2]) for m in tag.finditer(source) if m[2]]
        assert [(t["start"], t["end"], t["closing"], t["name"]) for t in text.tags_of(source, xml=True)] == plain, source


def test_long_pages_and_units_take_seconds(spark):
    began = time.time()
    pages = spark.createDataFrame([("c", "u", "<a " * 350_000), ("c", "v", "<p>x" * 200_000), ("c", "w", "<a " + "x" * 1_000_000 + ">")], "component string, unit string, content string")
    assert {r["unit"]: r["n"] for r in markup.elements(pages).groupBy("unit").agg(F.count("*").alias("n")).collect()} == {"v": 200_000, "w": 1}
    body = "\n".join(("\\section{a}", "text here", "")[k % 3] for k in range(500_000))
    lines = regions.lines_of(spark.createDataFrame([("c", "u", body)], "component string, unit string, content string"))
    labels = lines.where("line % 3 = 2").select("component", "unit", "line")
    assert regions.prose_ranges(lines, labels).where("start_line = line and end_line = line").count() == 166_667
    assert regions.section_ranges(lines).where("end_line = start_line + 1").count() == 166_666 + 1
    assert time.time() - began < 120


def test_xml_names_keep_their_case(spark):
    rows = spark.createDataFrame([("<Sec xml:Id='A'>x</Sec><script><b></script>",)], "s string").select(F.explode(text.scan_tags(F.col("s"), xml=True)).alias("t")).select("t.*").collect()
    assert [(r["name"], r["attributes"]) for r in rows] == [("Sec", {"xml:Id": "A"}), ("Sec", {}), ("script", {}), ("b", {}), ("script", {})]


def test_build_conditionals_keep_offsets(spark):
    source = "a\n\\ifdefined\\x\nx\ny\r\n\\fi\nb \\ifdefined\\x 1\\fi\\ifdefined\\x 2\\fi c \\ifdefined\\x open"
    got = spark.createDataFrame([(source,), ("plain",), (None,)], "s string").select(tex.without_build_conditionals(F.col("s"), r"\\ifdefined\\x").alias("o"))
    first, second, third = [r["o"] for r in got.collect()]
    assert first == "a\n" + " " * 12 + "\n \n \r\n   \nb " + " " * 17 + " " * 17 + " c \\ifdefined\\x open" and len(first) == len(source)
    assert (second, third) == ("plain", None)
