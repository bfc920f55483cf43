"""Joins that keep repeated rows, identifiers, strong components, audits and the ledger."""

from __future__ import annotations

import random

from lemmaflow.functions import identifiers, text
from lemmaflow.operators import audits, joins, merge, provider
from lemmaflow.plans import corpus, graph, ledger
from pyspark.sql import functions as F


def test_innermost_against_all_pairs(spark):
    rng = random.Random(2)
    ranges = [(rng.choice("ab"), s, s + rng.choice([0, 1, 2, 7, 60, 500]), k) for k in range(80) for s in [rng.randrange(-50, 600)]]
    points = [(rng.choice("abc"), rng.randrange(-60, 700), k % 5) for k in range(200)] + [("a", 10, 1)] * 3 + [(None, 5, 1), ("a", None, 2)]
    p = spark.createDataFrame(points, "g string, at long, n int").withColumn("extra", F.create_map(F.lit("k"), F.lit("v")))
    r = spark.createDataFrame(ranges, "g string, s long, e long, name int")
    got = sorted((str(x.g), str(x.at), x.n, str(x.name)) for x in joins.innermost(p, r, ["g"], "at", "s", "e", ["name"]).collect())

    def best(g, at):
        inside = [(s, k) for h, s, e, k in ranges if g is not None and at is not None and h == g and s <= at < e]
        return max(inside)[1] if inside else None

    assert got == sorted((str(g), str(at), n, str(best(g, at))) for g, at, n in points)
    assert joins.innermost(p, r.limit(0), ["g"], "at", "s", "e", ["name"]).where("name is not null").count() == 0


def test_longest_prefix_keeps_rows(spark):
    rows = spark.createDataFrame([("abcd", 1), ("abcd", 1), ("ab", 2), ("x", 3), (None, 4), ("", 5)], "t string, n int")
    prefixes = spark.createDataFrame([("a",), ("abc",), ("abc",), ("b",), ("",)], "p string")
    got = sorted((r.n, str(r.matched)) for r in joins.longest_prefix(rows, "t", prefixes, "p").collect())
    assert got == [(1, "abc"), (1, "abc"), (2, "a"), (3, "None"), (4, "None"), (5, "None")]


def test_unique_ids_of_null_names(spark):
    rows = spark.createDataFrame([(1, None, "fall"), (2, None, "fall"), (3, "", "Fall"), (4, "Ünï Çode", "x"), (5, None, None)], "k int, name string, back string")
    got = [r.stable_id for r in identifiers.unique_ids(rows, "k", "name", "back").orderBy("k").collect()]
    assert got[0] == "fall" and got[1].startswith("fall-") and got[2].startswith("fall-") and got[3] == "u-ni-c-ode" and got[4] == "id-item"
    assert len(set(got)) == 5


def test_addresses_and_venues(spark):
    one = spark.createDataFrame([("https://H.org:80//a%20b//c/?q", "http://h.org", "mailto:x")], "a string, b string, c string")
    r = one.select(*[identifiers.page_key(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(r) == ("h.org:80/a b/c", "h.org/", None)
    v = lambda *x: identifiers.venue(*[F.lit(y).cast("string") for y in x]).alias("v")
    assert one.select(v("J", "1", "2", "3", "9")).first().v == "J, volume 1, issue 2, pages 3-9"
    assert one.select(v(None, "1", None, "3", "3")).first().v == "Venue not supplied by OpenAlex, volume 1, pages 3"
    assert one.select(v(" ", None, None, None, "3")).first().v == "Venue not supplied by OpenAlex"


def test_inferred_license(spark):
    rows = [("creativecommons.org/licenses/by/4.0/", None), ("creativecommons.org/licenses/by/4.0/ creativecommons.org/licenses/by-sa/4.0/", None), ("none", None), ("creativecommons.org/licenses/by/4.0/", "creativecommons.org/licenses/by-sa/4.0/"), ("GNU Free Documentation License, Version 1.3 or any later version", "x")]
    got = [r.x for r in spark.createDataFrame(rows, "a string, b string").select(text.inferred_license(F.col("a"), F.col("b")).alias("x")).collect()]
    assert [r.name for r in got] == ["CC-BY-4.0", None, None, "CC-BY-4.0", "GFDL-1.3-or-later"]
    assert got[0].address == "https://creativecommons.org/licenses/by/4.0/" and "conflict" in got[3].note and "multiple" in got[1].note


def test_strong_components_against_reachability(spark):
    rng = random.Random(9)
    for n, m in ((12, 20), (20, 24), (6, 30)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {(a, b) for a, b in edges}
        for k in range(n):
            reach |= {(a, d) for a, b in reach if b == k for c, d in reach if c == k}
        expected = {frozenset(b for b in range(n) if b == a and (a, a) in reach or (a, b) in reach and (b, a) in reach) for a in range(n)} - {frozenset()}
        got = {}
        for r in graph.strong_components(spark.createDataFrame(list(edges), "src long, dst long")).collect():
            got.setdefault(r.component, set()).add(r.node)
        assert {frozenset(x) for x in got.values()} == expected


def test_reviewed_cycles(spark):
    rows = [("a", ["b"], "q"), ("b", ["a"], "q"), ("c", ["d"], "q"), ("d", ["c"], None), ("e", [], None)]
    t = {"statement": spark.createDataFrame(rows, "statement string, dependencies array<string>, cluster string")}
    assert {(r.entity, r.detail) for r in corpus.cycle_rules(t).collect()} == {("c", "d"), ("d", "c")}


RECORD = "direction string, paper_id string, bib_key string, title string, authors array<string>, date string, venue string, identifiers map<string,string>, lines array<int>, evidence string, reuse string"
AUDIT = audits.Audit("seed", "2026-01-01", "audit:one", "2401.1", "https://a.org/src", "https://a.org/q", "W1")


def test_audit_merges_once(spark):
    records = spark.createDataFrame([
        ("outgoing", "p1", "Key1", "One", ["A"], "2020", "V", {"internal": "k1", "doi": "10.1/One"}, [3, 9], None, None),
        ("outgoing", "p2", "Key2", "Two", ["B"], "2021", "V", {"internal": "k2", "doi": "10.1/two"}, [4], "reviewed-existing-record", "old"),
        ("outgoing", "p3", "Key3", "Three", ["B"], "2021", "V", {"internal": "k3", "doi": "10.1/three"}, [4], None, None),
        ("incoming", "openalex-w7", None, "Seven", ["C"], "2022", "V", {"openAlex": "W7"}, None, None, None),
    ], RECORD)
    entry = f"array<{audits.ENTRY}>"
    papers = spark.createDataFrame([("seed", "S", {}, []), ("old", "Old two", {"doi": "https://doi.org/10.1/TWO"}, [("Crossref reference metadata", "10.1/two", "2026-01-01", None)]), ("q3", "Other", {"doi": "10.1/three"}, [])], f"paper_id string, title string, identifiers map<string,string>, provenance {entry}")
    papers = papers.withColumns({"coverage": F.lit(None).cast(provider.COVERAGE), "links": F.array().cast("array<struct<label:string,url:string>>"), "history": F.array().cast(audits.HISTORY)})
    edges = audits.audit_edges(records, AUDIT).limit(0)
    queue = spark.createDataFrame([("old", "blocked", ["resolve-identifiers"], 2, "t", "e")], "paper_id string, state string, tasks array<string>, attempts int, updated_at string, last_error string")
    first = audits.merge_audit(papers, edges, queue, records, AUDIT)
    assert [(r.rule, r.entity, r.detail) for r in first["refused"].collect()] == [("undeclared-reuse", "p3", "q3")]
    assert {r.paper_id for r in first["added_papers"].collect()} == {"p1", "openalex-w7"}
    by_id = {r.paper_id: r for r in first["papers"].collect()}
    assert by_id["old"].title == "Old two" and [e.provider for e in by_id["old"].provenance] == ["arXiv source bibliography", "reviewed direct-neighborhood audit"]
    made = {r.edge_id: r for r in first["edges"].collect()}
    assert set(made) == {"citation-seed-key1", "citation-seed-key2", "citation-openalex-w7-seed"}
    assert made["citation-seed-key1"].provenance[0].record_id == "2401.1:Key1:lines-3-9" and made["citation-seed-key2"].cited == "old"
    rows = {r.paper_id: r for r in first["queue"].collect()}
    assert rows["p1"].state == "blocked" and rows["openalex-w7"].state == "metadata-fetched" and rows["old"].attempts == 2
    view = lambda x, name: sorted(map(str, x[name].collect()))
    again = audits.merge_audit(first["papers"], first["edges"], first["queue"], records, AUDIT)
    assert again["added_papers"].count() == 0 and view(again, "edges") == view(first, "edges") and view(again, "queue") == view(first, "queue")

    seeded = audits.update_seed(audits.update_seed(first["papers"], AUDIT, (48, 28), 6, "note"), AUDIT, (48, 28), 6, "note").where("paper_id = 'seed'").first()
    assert seeded.coverage.outgoing_found == 48 and seeded.coverage.searches == 6 and len(seeded.history) == 1
    row = audits.update_seed_queue(merge.merge_queue(queue, queue.select(F.lit("seed").alias("paper_id"), F.lit("open").alias("state"), "tasks", F.lit(5).alias("attempts"), F.lit("2027").alias("updated_at"), "last_error")), AUDIT, "err").where("paper_id = 'seed'").first()
    assert (row.state, row.attempts, row.updated_at) == ("neighbors-fetched", 5, "2027")
    assert {r.rule for r in audits.audit_rules(records.unionByName(records.limit(1)), {"outgoing": 4, "incoming": 2}).collect()} == {"bib-key-once", "endpoint-once", "record-count"}


def test_assembly(spark):
    frame = lambda *ids: spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "paper_id string, n int")
    made, clashes = audits.assemble(frame("a", "b"), frame("b", "c", "d"), frame("d", "a"))
    assert sorted((r.paper_id, r.n) for r in made.collect()) == [("a", 0), ("b", 1), ("c", 1), ("d", 0)]
    assert [(r.rule, r.entity) for r in clashes.collect()] == [("pack-collides", "a")]


def test_graphs_and_ledger(spark):
    fields = ("editionId", "stableLocator", "sourceRepository", "sourceRevision", "artifactSha256")
    edition = lambda i: (i, "l", "r", "v", "s")
    kind = "struct<" + ",".join(f"{n}:string" for n in fields) + ">"
    proposal = spark.createDataFrame([("c1", "e1", "exact-edition", edition("e1")), ("c2", "e2", "exact-edition", edition("e2"))], f"component string, proposal string, kind string, edition {kind}")
    pin = proposal.select("proposal", ledger.pin_digest().alias("pin"))
    done = pin.select(F.when(F.col("proposal") == "e1", "c1").otherwise("c2").alias("component"), "proposal", F.lit("candidate-produced").alias("outcome"), F.col("pin").alias("pin_sha256"), F.lit("x").alias("extraction_sha256"), F.lit("g").alias("graph_sha256"), F.lit("me").alias("by"), F.lit("t").alias("at"))
    record = spark.createDataFrame([("c1", "e1"), ("c2", None)], "component string, selected string")
    graphs = spark.createDataFrame([("c1", edition("e1"), "x", "g", "me", "t", True), ("c2", edition("e2"), "x", "g", "me", "later", True), ("c3", edition("e3"), "x", "g", "me", "t", False)], f"component string, edition {kind}, extraction_sha256 string, graph_sha256 string, actor string, completed_at string, reviewed boolean")
    got = {(r.rule, r.entity) for r in ledger.graph_rules(graphs, {"proposal": proposal, "record": record, "assessment": done}).collect()}
    assert got == {("graph-has-record", "c3"), ("edition-matches-once", "c3"), ("reviewed-graph-verified", "c2"), ("assessment-of-graph", "c2")}
    records = spark.createDataFrame([("S0001", 1, [("a", "A"), ("a", "B")]), ("X2", 2, [("Bad Id", "")]), ("S0003", 2, [])], "record string, ordinal int, components array<struct<id:string,label:string>>")
    assert {r.rule for r in ledger.registry_rules(records).collect()} == {"component-once", "record-form", "component-form", "record-has-components", "record-ordinal-once"}
    assert [r.path for r in ledger.expected_components(records.limit(1)).collect()] == ["S0001/a.json"] * 2
