"""Integrity rules by mutation, shards by fault, graphs by brute force, merges, books and the queue stream."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from lemmaflow.functions import identifiers, text
from lemmaflow.operators import merge, metrics, sets
from lemmaflow.plans import graph, rules
from lemmaflow.sources import books, shards
from lemmaflow.streaming import queue
from pyspark.sql import functions as F

EVIDENCE = "evidence struct<status:string,units:array<string>,actor:string,sha256:string,reviewer:string,reviewed_sha256:string>"
SCHEMAS = {
    "component": "component string, extraction_status string, graph_status string",
    "source_unit": "component string, unit string, ordinal int, content_sha256 string",
    "unit_inventory": f"component string, unit string, theorems array<string>, supports array<string>, artifacts array<string>, theorem_free boolean, {EVIDENCE}",
    "node": f"component string, node string, node_class string, {EVIDENCE}",
    "external_input": f"component string, input string, {EVIDENCE}",
    "dependency": f"component string, dependency string, dependent string, prerequisite_type string, prerequisite string, {EVIDENCE}",
    "proof_route": f"component string, route string, theorem string, kind string, dependency_ids array<string>, locator string, {EVIDENCE}",
    "reference": f"component string, reference string, owner string, basis string, ref string, pinpoint string, locator string, status string, target_type string, target string, dependency string, {EVIDENCE}",
}
OK = ("reviewed", ["u1"], "a", "h", "b", "h")


def valid():
    return {
        "component": [["c", "reviewed", "reviewed-complete"]],
        "source_unit": [["c", "u1", 1, "h"]],
        "unit_inventory": [["c", "u1", ["t1"], ["d1"], [], False, OK]],
        "node": [["c", "t1", "theorem-like", OK], ["c", "d1", "support", OK]],
        "external_input": [["c", "x1", OK]],
        "dependency": [["c", "e1", "t1", "node", "d1", OK]],
        "proof_route": [["c", "r1", "t1", "proof", ["e1"], "p1", OK]],
        "reference": [["c", "f1", "t1", "proof-xref", "d", None, "p1", "resolved", "node", "d1", "e1", OK]],
    }


def found(spark, tables):
    frames = {k: spark.createDataFrame([tuple(r) for r in rows], SCHEMAS[k]) for k, rows in tables.items()}
    return {r.rule for r in rules.validate_book_graph(frames).collect()}


MUTATIONS = [
    ("unit-ordinal", lambda t: t["source_unit"][0].__setitem__(2, 2)),
    ("entity-id-once", lambda t: t["external_input"][0].__setitem__(1, "t1")),
    ("no-self-dependency", lambda t: t["dependency"][0].__setitem__(4, "t1")),
    ("acyclic", lambda t: t["dependency"].append(["c", "e2", "d1", "node", "t1", OK])),
    ("prerequisite-exists", lambda t: t["dependency"][0].__setitem__(4, "zz")),
    ("external-input-exists", lambda t: t["dependency"].append(["c", "e2", "t1", "external-input", "zz", OK])),
    ("dependency-once", lambda t: t["dependency"].append(["c", "e2", "t1", "node", "d1", OK])),
    ("complete-theorem-routed", lambda t: t["proof_route"].clear()),
    ("route-theorem", lambda t: t["proof_route"][0].__setitem__(2, "d1")),
    ("route-dependency-exists", lambda t: t["proof_route"][0].__setitem__(4, ["e1", "e9"])),
    ("root-without-dependencies", lambda t: t["proof_route"][0].__setitem__(3, "root-attestation")),
    ("node-review-independent", lambda t: t["node"][0].__setitem__(3, ("reviewed", ["u1"], "a", "h", "a", "h"))),
    ("node-review-current", lambda t: t["node"][0].__setitem__(3, ("reviewed", ["u1"], "a", "h", "b", "old"))),
    ("node-evidence-unit", lambda t: t["node"][0].__setitem__(3, ("reviewed", ["u9"], "a", "h", "b", "h"))),
    ("inventory-class", lambda t: t["unit_inventory"][0].__setitem__(4, ["d1"])),
    ("inventory-covers-nodes", lambda t: t["unit_inventory"][0].__setitem__(3, [])),
    ("inventory-covers-units", lambda t: t["source_unit"].append(["c", "u2", 2, "h"])),
    ("theorem-free-flag", lambda t: t["unit_inventory"][0].__setitem__(5, True)),
    ("inventory-current", lambda t: t["source_unit"][0].__setitem__(3, "new")),
    ("citation-to-input", lambda t: t["reference"][0].__setitem__(3, "proof-citation")),
    ("proof-reference-has-dependency", lambda t: t["reference"][0].__setitem__(10, None)),
    ("reference-matches-dependency", lambda t: t["reference"][0].__setitem__(2, "d1")),
    ("complete-references-resolved", lambda t: t["reference"][0].__setitem__(7, "unresolved")),
    ("complete-without-artifacts", lambda t: t["node"].append(["c", "a1", "source-artifact", OK])),
    ("graph-after-extraction", lambda t: t["component"][0].__setitem__(1, "awaiting-edition")),
]


def test_valid_tables_have_no_violation(spark):
    assert found(spark, valid()) == set()


def test_mutations(spark):
    """All mutations at once, one component each, so that the rules run only once."""
    merged = {k: [] for k in SCHEMAS}
    for n, (_, mutate) in enumerate(MUTATIONS):
        tables = valid()
        mutate(tables)
        for k, rows in tables.items():
            merged[k] += [[f"c{n}", *r[1:]] for r in rows]
    frames = {k: spark.createDataFrame([tuple(r) for r in rows], SCHEMAS[k]) for k, rows in merged.items()}
    rules_found = {r.rule for r in rules.validate_book_graph(frames).collect()}
    assert {rule for rule, _ in MUTATIONS} <= rules_found


def test_snapshot_rules(spark):
    papers = spark.createDataFrame([("p", {"doi": "10.1/A"}), ("q", {"doi": "https://doi.org/10.1/a"}), ("r", {})], "paper_id string, identifiers map<string,string>")
    edges = spark.createDataFrame([("e", "p", "q"), ("f", "p", "z"), ("g", "q", "q")], "edge_id string, citing string, cited string")
    work = spark.createDataFrame([("p",), ("y",)], "paper_id string")
    assert {r.rule for r in rules.validate_snapshot(papers, edges, work).collect()} == {"identifier-owner", "cited-exists", "no-self-citation", "queue-paper"}


def test_shards(spark, tmp_path):
    rng = random.Random(1)
    rows = [(c, k, i, '{"n":"' + "é" * rng.randint(0, 40) + '"}') for c in ("S1", "S2") for k in ("node", "edge") for i in range(50)]
    records = spark.createDataFrame(rows, "component string, collection string, ordinal long, record string")
    folder = str(tmp_path / "book")
    shards.write(records, folder, 300)
    assert sorted(map(tuple, shards.read(spark, folder).collect())) == sorted(rows)
    assert shards.verify(spark, folder).count() == 0
    assert spark.read.parquet(folder + "/index").where("byte_length > 300").count() == 0
    one = sorted(Path(folder, "shards").rglob("part-*.txt"))[0]
    one.write_bytes(one.read_bytes().replace(b"n", b"m", 1))
    Path(one.parent, f".{one.name}.crc").unlink(missing_ok=True)
    assert {r.rule for r in shards.verify(spark, folder).collect()} == {"digest"}
    with pytest.raises(Exception, match="exceeds the shard limit"):
        shards.encode(records, 20).count()


def test_graphs_against_brute_force(spark):
    rng = random.Random(2)
    for cyclic in (False, True):
        pairs = {(a, b) for a in range(1, 40) for b in rng.sample(range(a), min(a, 2))} | ({(3, 30), (30, 3)} if cyclic else set())
        after = {}
        for a, b in pairs:
            after.setdefault(a, set()).add(b)

        def reach(a, after=after):
            seen, todo = set(), [a]
            while todo:
                for b in after.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            return seen

        edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
        nodes = spark.range(40).withColumnRenamed("id", "node")
        roots = spark.createDataFrame([(39,), (20,)], "root long")
        assert {(r.root, r.node) for r in graph.closure(edges, roots).collect()} == {(a, b) for a in (39, 20) for b in reach(a) | {a}}
        assert {r.node for r in graph.on_cycles(nodes, edges).collect()} == {a for a in range(40) if a in reach(a)}
        order = graph.reading_order(edges.withColumn("seq", F.col("dst")), roots.where("root = 39")).orderBy("position").collect()
        assert [r.node for r in order][-1] == 39 and {r.node for r in order} == reach(39) | {39}
        if not cyclic:
            place = {r.node: r.position for r in order}
            assert all(place[b] < place[a] for a, b in pairs if a in place)


def test_pointer_chains(spark):
    pointers = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "node string, next string")
    assert {(r.node, r.last if not r.broken else None) for r in graph.end_of_chain(pointers).collect()} == {("a", "c"), ("b", "c"), ("x", None), ("y", None)}


def test_identifiers(spark):
    rows = [("doi", "https://dx.doi.org/10.1/AB", "10.1/ab"), ("doi", "  ", None), ("arxiv", "https://arxiv.org/pdf/2401.00001v2.pdf", "2401.00001"), ("openAlex", "https://openalex.org/works/w12?x", "W12"), ("openAlex", "A12", None), ("isbn", "ISBN-13: 978-0 1x", "97801X"), ("semanticScholar", "https://www.semanticscholar.org/paper/AbC", "abc"), ("other", "x", None)]
    df = spark.createDataFrame(rows, "kind string, value string, expected string")
    assert df.where(~identifiers.stable_identifier(F.col("kind"), F.col("value")).eqNullSafe(F.col("expected"))).count() == 0
    loose = df.select(identifiers.corpus_identifier(F.lit("openAlex"), F.lit("a12")).alias("x")).first()
    assert loose.x == "A12"
    got = spark.createDataFrame([("a%20b+", "Ünï: Code_x"), ("a%zz", "***")], "u string, s string").select(identifiers.percent_decode("u"), identifiers.slug("s"), identifiers.http_url(F.lit("../y"), F.lit("http://a.b/c/d"))).collect()
    assert [tuple(r) for r in got] == [("a b+", "u-ni-code-x", "http://a.b/y"), ("a%zz", "id-item", "http://a.b/y")]


def test_text(spark):
    df = spark.createDataFrame([("a\\% b % gone\nc \\\\% gone too",)], "t string")
    assert df.select(text.without_comments(F.col("t"))).first()[0] == "a\\% b \nc \\\\"
    assert df.select(text.semantic_kind(F.lit("Theorem 1.2"))["kind"], text.semantic_kind(F.lit("Sum rule"), True)["kind"], text.semantic_kind(F.lit("Outlook"))["kind"]).first() == ("theorem", "algorithm", None)


def test_merges(spark):
    a = spark.createDataFrame([("p", {"doi": "1"}, ["x", "y"])], "id string, ids map<string,string>, tags array<string>")
    b = spark.createDataFrame([("p", {"doi": "2", "isbn": "3"}, ["y", "z"]), ("q", {}, ["w"])], a.schema)
    both = merge.upsert(a, b, "id", {"ids": merge.merge_maps, "tags": lambda x, y: merge.union_by(x, y, lambda t: t)})
    rows = {r.id: r for r in both.collect()}
    assert rows["p"].ids == {"doi": "1", "isbn": "3"} and rows["p"].tags == ["x", "y", "z"] and not rows["p"].added and rows["q"].added
    again = merge.upsert(both.drop("added"), b, "id", {"ids": merge.merge_maps, "tags": lambda x, y: merge.union_by(x, y, lambda t: t)})
    assert sorted(again.drop("added").collect()) == sorted(both.drop("added").collect())


def test_states(spark):
    proposals = "array<struct<id:string,kind:string,decision:string>>"
    rows = [(None, [("1", "duplicate-component", None), ("2", "exact-edition", "rejected")], "candidate-duplicate"), ("2", [("2", "exact-edition", "approved")], "verified-exact-edition"), (None, [], "unresolved")]
    df = spark.createDataFrame(rows, f"selected string, proposals {proposals}, expected string")
    assert df.where(metrics.resolution_state(F.col("selected"), F.col("proposals")) != F.col("expected")).count() == 0
    checks = spark.createDataFrame([(None, [("1", "exact-edition", None)], [("1", "incompatible"), ("1", "needs-adapter"), ("9", "candidate-produced")])], f"selected string, proposals {proposals}, a array<struct<proposal_id:string,outcome:string>>")
    assert checks.select(metrics.importer_state(F.col("selected"), F.col("proposals"), F.col("a"))).first()[0] == "needs-adapter"


def test_queue_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"paper_id":"p","outcome":"complete","at":"2024-01-01"}\n{"paper_id":"q","outcome":"failed","at":"2024-01-02"}\n')
    before = spark.createDataFrame([("r", "blocked", ["resolve-identifiers"], 2, "2023")], "paper_id string, state string, tasks array<string>, attempts int, updated_at string")
    for n in (1, 2):
        stream = spark.readStream.schema("paper_id string, outcome string, at string").option("maxFilesPerTrigger", 1).json(str(source))
        queue.start(stream, str(tmp_path / "q"), before, str(tmp_path / "ck")).awaitTermination()
        rows = {r.paper_id: r for r in spark.read.schema(before.schema).parquet(queue.version(str(tmp_path / "q"), n)).collect()}
        (source / "2.json").write_text('{"paper_id":"q","outcome":"incomplete","at":"2024-01-03"}\n')
    assert rows["p"].state == "complete-direct-neighborhood" and rows["q"].attempts == 2 and rows["q"].tasks == ["fetch-outgoing"] and rows["r"].attempts == 2
    fresh = merge.reactivate(spark.createDataFrame([tuple(rows["r"])], before.schema), spark.createDataFrame([("r", "2025")], "paper_id string, retrieved_at string")).first()
    assert (fresh.state, fresh.updated_at) == ("metadata-fetched", "2025")
    assert sets.repeated(spark.createDataFrame([(1,), (1,)], "a int"), ["a"]).first().n == 2


BOOK = r"""\section{One}
\begin{definition}[Base] \label{def-a} A thing. \end{definition}
\begin{theorem}\label{thm-b} % \label{not-this}
Things exist. \end{theorem}
\begin{proof} By \ref{def-a} and \ref{missing}. \end{proof}
\begin{proof}[Another proof] Clear. \end{proof}
\begin{lemma}\label{lem-c} Small. \end{lemma}
\section{Two}
\begin{proof} Stray, by \ref{thm-b}. \end{proof}
\begin{theorem}\label{thm-d} Large. \end{theorem}
\begin{proof} Use \ref{thm-b}, \ref{thm-b} and \ref{dup}. \end{proof}
\begin{remark}\label{dup} x \end{remark}\begin{remark}\label{dup} y \end{remark}
"""


def test_tex_book(spark):
    units = spark.createDataFrame([("S", "u", 1, BOOK)], "component string, unit string, ordinal int, content string")
    made = books.extract_tex(units)
    assert {(r.label, r.node_class) for r in made["node"].collect()} == {("def-a", "support"), ("thm-b", "theorem-like"), ("lem-c", "theorem-like"), ("thm-d", "theorem-like"), ("dup", "support")}
    assert {(r.theorem, r.target, r.occurrences, r.role) for r in made["dependency"].collect()} == {("u:thm-b", "u:def-a", 1, "definition"), ("u:thm-d", "u:thm-b", 2, "logical")}
    assert sorted((r.theorem, r.route, r.targets) for r in made["route"].collect()) == [("u:thm-b", 1, ["u:def-a"]), ("u:thm-d", 1, ["u:thm-b"])]
    assert {(r.ref, r.reason) for r in made["unresolved"].collect()} == {("missing", "missing"), ("dup", "ambiguous")}
    pages = spark.createDataFrame([(1, "<h1>Theorem &amp; more</h1><script>'<h2>no</h2>'</script><h3>Other</h3>")], "id int, html string")
    assert [(r.level, r.title, r.kind) for r in books.html_candidates(pages, "id", "html").orderBy("position").collect()] == [(1, "Theorem & more", "theorem"), (3, "Other", None)]
