"""Rules of reading programs by mutation, and the coverage summary."""

from __future__ import annotations

from lemmaflow.plans import programs

SCHEMAS = {
    "part": "program string, part string, number int",
    "chapter": "program string, chapter string, slug string, number int, part string, prerequisites array<string>, clusters array<string>",
    "family": "program string, family string",
    "band": "program string, band string, clusters array<string>",
    "cluster": "program string, cluster string, slug string, status string, families array<string>, nodes array<string>, reviewer string",
    "route": "program string, cluster string, route string, kind string, dependency_kind string, review_state string, equivalence string, prerequisites array<string>, parent string, reviewer string",
    "residual": "program string, cluster string, residual string, status string, families array<string>, reviewer string",
    "record": "program string, record string, state string, duplicate_of string, editions array<string>",
    "edition": "program string, edition string, inventory string",
    "occurrence": "program string, occurrence string, disposition string, decision string, relation string, claims array<string>, residuals array<string>",
    "claim": "program string, claim string, status string, targets int",
}
BOOK = {
    "source": "program string, source string, record string",
    "chapter": "program string, chapter string, number int",
    "notation": "program string, notation string, first_node string",
    "node": "program string, node string, slug string, section string, chapter string, kind string, trainable boolean, proof_goal string, prerequisites array<string>, notations array<string>, sources array<string>",
}


def frames(spark, tables, schemas=SCHEMAS):
    return {k: spark.createDataFrame([tuple(r) for r in rows], schemas[k]) for k, rows in tables.items()}


def rules_of(df):
    return {r.rule for r in df.collect()}


def broken(valid, changes):
    """The valid tables once for each change, under a program name of its own."""
    tables = {k: [] for k in valid()}
    for n, (_, change) in enumerate(changes):
        t = valid()
        change(t)
        for k, rows in t.items():
            tables[k] += [[f"p{n}", *r[1:]] for r in rows]
    return tables


def roadmap():
    return {
        "part": [["p", "P01", 1], ["p", "P02", 2]],
        "chapter": [["p", "R001", "a", 1, "P01", [], ["k"]], ["p", "R002", "b", 2, "P02", ["R001"], ["k"]]],
    }


ROADMAP_CHANGES = [
    ("chapter-id", lambda t: t["chapter"][1].__setitem__(1, "R009")),
    ("chapter-order", lambda t: t["chapter"][1].__setitem__(3, 3)),
    ("part-not-empty", lambda t: t["part"].append(["p", "P03", 3])),
    ("part-contiguous", lambda t: (t["chapter"][0].__setitem__(4, "P02"), t["chapter"][1].__setitem__(4, "P01"))),
    ("prerequisite-earlier", lambda t: t["chapter"][0].__setitem__(5, ["R002"])),
    ("prerequisite-acyclic", lambda t: t["chapter"][0].__setitem__(5, ["R002"])),
    ("prerequisite-exists", lambda t: t["chapter"][1].__setitem__(5, ["R007"])),
]


def test_roadmap(spark):
    assert not rules_of(programs.validate_roadmap(frames(spark, roadmap())))
    found = rules_of(programs.validate_roadmap(frames(spark, broken(roadmap, ROADMAP_CHANGES))))
    assert {rule for rule, _ in ROADMAP_CHANGES} <= found


def book():
    return {
        "source": [["p", "s", "S1"]], "chapter": [["p", "c", 1]], "notation": [["p", "n", "a"]],
        "node": [["p", "a", "a", "1.1", "c", "theorem", True, "goal", [], ["n"], ["s"]], ["p", "b", "b", "1.2", "c", "idea", False, None, ["a"], [], []]],
    }


TEXTBOOK_CHANGES = [
    ("section-of-chapter", lambda t: t["node"][0].__setitem__(3, "2.1")),
    ("trainable-has-goal", lambda t: t["node"][0].__setitem__(7, None)),
    ("trainable-kind", lambda t: t["node"][0].__setitem__(5, "idea")),
    ("notation-first-node", lambda t: t["notation"][0].__setitem__(2, "z")),
    ("source-exists", lambda t: t["node"][0].__setitem__(10, ["z"])),
]


def test_textbook(spark):
    assert not rules_of(programs.validate_textbook(frames(spark, book(), BOOK)))
    found = rules_of(programs.validate_textbook(frames(spark, broken(book, TEXTBOOK_CHANGES), BOOK)))
    assert {rule for rule, _ in TEXTBOOK_CHANGES} <= found


def compression():
    return {
        "family": [["p", "f"], ["p", "g"]], "band": [["p", "b", ["k"]]], "cluster": [["p", "k", "k", "reviewed", ["f", "g"], ["n"], "x"]],
        "route": [["p", "k", "r1", "canonical", "minimized", "reviewed", "exact", [], "r2", "x"], ["p", "k", "r2", "source", "original", "draft", "open", [], None, None]],
        "residual": [["p", "k", "d", "draft", ["f"], None]],
    }


COMPRESSION_CHANGES = [
    ("cluster-in-one-band", lambda t: t["band"].append(["p", "b2", ["k"]])),
    ("one-canonical-route", lambda t: t["route"][0].__setitem__(3, "source")),
    ("minimized-from-original", lambda t: t["route"][0].__setitem__(8, "r1")),
    ("route-review-evidence", lambda t: t["route"][1].__setitem__(9, "x")),
    ("residual-family-exists", lambda t: t["residual"][0].__setitem__(4, ["z"])),
    ("route-prerequisite-not-itself", lambda t: t["route"][1].__setitem__(7, ["k"])),
]


def test_compression(spark):
    assert not rules_of(programs.validate_compression(frames(spark, compression())))
    found = rules_of(programs.validate_compression(frames(spark, broken(compression, COMPRESSION_CHANGES))))
    assert {rule for rule, _ in COMPRESSION_CHANGES} <= found


def test_crosswalk_and_reviewers(spark):
    branch = spark.createDataFrame([("p", "a", "A"), ("p", "b", "B")], "program string, branch string, title string")
    lens = spark.createDataFrame([("p", "l", "a", "A")], "program string, lens string, branch string, title string")
    record = spark.createDataFrame([("p", "S1", "cite", "a"), ("p", "S2", "two", "b")], "program string, record string, citation string, branch string")
    shown = spark.createDataFrame([("p", "l", "S1", "cite"), ("p", "l", "S2", "other")], "program string, lens string, record string, citation string")
    assert rules_of(programs.validate_crosswalk(lens, shown, branch, record)) == {"branch-covered", "representative-registered", "representative-in-branches"}
    reviews = spark.createDataFrame([("p", "r1", "x"), ("p", "r2", "y"), ("p", "r3", None)], "program string, entity string, reviewer string")
    allowed = spark.createDataFrame([("p", "x")], "program string, actor string")
    assert [r.entity for r in programs.unauthorized_reviews(reviews, allowed).collect()] == ["r2"]


def test_coverage(spark):
    t = {
        "record": [["p", "S1", "resolved-editions", None, ["e1"]], ["p", "S2", "duplicate-record", "S1", []], ["p", "S3", "unresolved", None, []],
                   ["p", "S4", "duplicate-record", "S5", []], ["p", "S5", "duplicate-record", "S4", []], ["p", "S6", "resolved-editions", None, ["e1", "e2"]]],
        "edition": [["p", "e1", "audited-complete"], ["p", "e2", "started"]],
        "occurrence": [["p", "o1", "bridge", "verified", "equal", ["c1"], []], ["p", "o2", "bridge", "verified", "overlapping", ["c1"], []],
                       ["p", "o3", "specialist-extension", "verified", "equal", [], ["d1"]], ["p", "o4", "unresolved", "verified", "equal", [], []], ["p", "o5", "bridge", "verified", "equal", ["c2"], []]],
        "claim": [["p", "c1", "reviewed", 1], ["p", "c2", "reviewed", 0]],
        "residual": [["p", "k", "d1", "reviewed", [], "x"]],
    }
    row = programs.coverage_summary(frames(spark, t)).first().asDict()
    assert row == {
        "program": "p", "source_records": 6, "resolved_records": 5, "complete_records": 2, "editions": 2, "complete_editions": 1, "theorem_occurrences": 5,
        "classified_occurrences": 4, "terminal_occurrences": 2, "verified_mappings": 1, "verified_residuals": 1, "unresolved_occurrences": 1, "complete": False,
    }
