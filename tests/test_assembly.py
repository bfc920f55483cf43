"""Citations, digests and whole components against plain loops."""

from __future__ import annotations

import hashlib
import json
import random
import re

import pytest
from lemmaflow.functions import tex
from lemmaflow.operators import citations
from lemmaflow.sources import assembly, component_files
from pyspark.sql import functions as F

SHA = "a" * 64
EDITION = "component string, source_record string, identity string, captured_at string, label string, publication_year int, publisher string, locator string, access_kind string, license_spdx string, license_url string, license_note string, repository string, revision string, extraction_note string, graph_note string, distribution string"
PINNED = assembly.Style("latex", "latex", "chapter", "latex-importer")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def compact(value):
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def edition(component="book", record="S0001", **other):
    row = dict(zip([c.split()[0] for c in EDITION.split(", ")], [component, record, compact({"componentId": component, "sourceRecordId": record}), "2024-05-06T07:08:09Z", "Book é \"x\"", 2024, None, "https://h.org/b", "open", None, None, "none", "https://h.org/r", "b" * 40, "e", "g", None]))
    return tuple((row | other).values())


def context(line, n):
    bare = re.sub(r"\\cite(?:\[[^\]]*\])?\{[^{}]+\}", "[citation]", re.sub(r"\\ref\{[^{}]+\}", "[reference]", line.split("%")[0]))
    return " ".join(bare.split())[:240] or f"Explicit source reference on line {n}."


def plain_references(units, proofs):
    groups, wrong = {}, set()
    for unit, owner, start, end in proofs:
        lines = re.split("\r?\n", units[unit])
        for n in range(start, min(end, len(lines)) + 1):
            text = lines[n - 1].split("%")[0]
            found = list(re.finditer(r"\\cite(?:\[([^\]]*)\])?\{([^{}]+)\}", text))
            if len(found) != len(re.findall(r"\\cite\b", text)):
                wrong.add((unit, n))
            for m in found:
                pinpoint = (m[1] or "").strip() or None
                for key in filter(None, (k.strip() for k in m[2].split(","))):
                    groups.setdefault((owner, key, pinpoint), []).append((unit, {"key": key, "pinpoint": pinpoint, "lineNumber": n, "context": context(lines[n - 1], n)}))
    rows = {}
    for (owner, key, pinpoint), seen in groups.items():
        id_ = f"ref-{owner}-to-cite-{sha(key + chr(0) + (pinpoint or ''))[:12]}-proof-citation"
        rows[id_] = (key, pinpoint, "; ".join(f"{u}.tex:L{o['lineNumber']}" for u, o in seen), sha(json.dumps([o for _, o in seen], indent=2, ensure_ascii=False) + "\n"))
    return rows, wrong


def test_citations(spark):
    rng = random.Random(5)
    pieces = ["\\cite{A}", "\\cite[ p. 3 ]{A, B,, A}", "\\cite[]{B}", "\\cite{no", "% \\cite{C}", "\\cite [x]{D}", "so é \\ref{x}", "", "\t", "\\citep{Z}"]
    units, proofs = {}, []
    for u in range(12):
        lines = [" ".join(rng.choices(pieces, k=rng.randint(0, 4))) for _ in range(rng.randint(1, 25))]
        units[f"u{u}"] = rng.choice(["\n", "\r\n"]).join(lines)
        at = 1
        while at <= len(lines):
            end = at + rng.randint(0, 4)
            proofs.append((f"u{u}", f"u{u}-o{rng.randint(0, 2)}", at, end))
            at = end + 1
    table = spark.createDataFrame([("c", k, v) for k, v in units.items()] + [("c", "none", None)], "component string, unit string, content string")
    spots = spark.createDataFrame([("c", *p) for p in proofs] + [("c", "u0", "back", 3, 2), ("c", "none", "x", 1, 2)], "component string, unit string, owner string, start_line int, end_line int")
    found, wrong = citations.proof_citations(table, spots)
    known = spark.createDataFrame([("c", "u1-o0", "A", None, "input", "dep")] * 2, "component string, owner string, key string, pinpoint string, target string, dependency string")
    got = citations.citation_references(found, known).collect()
    rows, broken = plain_references(units, proofs)
    assert len(got) == len(rows) and {r["reference"]: (r["key"], r["pinpoint"], r["locator"], r["evidence_sha256"]) for r in got} == rows
    assert {(r["unit"], r["line"]) for r in wrong.collect()} == broken and broken
    assert {r["owner"] for r in got if r["status"] == "resolved"} <= {"u1-o0"}


def test_phrases(spark):
    units = spark.createDataFrame([("c", "u", "By ZORN'S lemma\nzorn's Lemma % zorn's lemma\nother é É")], "component string, unit string, content string")
    proofs = spark.createDataFrame([("c", "u", "a", 1, 1), ("c", "u", "a", 2, 3), ("c", "u", "b", 1, 3)], "component string, unit string, owner string, start_line int, end_line int")
    phrases = spark.createDataFrame([("c", "a", "zorn's lemma"), ("c", "a", "É"), ("c", "b", "none")], "component string, owner string, pattern string")
    found = citations.phrase_occurrences(units, proofs, phrases)
    assert sorted((r["pattern"], r["line"], r["matched"]) for r in found.collect()) == [("zorn's lemma", 1, "ZORN'S lemma"), ("zorn's lemma", 2, "zorn's Lemma"), ("É", 3, "É"), ("É", 3, "é")]
    assert {(r["owner"], r["pattern"]): (r["occurrences"], r["proofs"]) for r in citations.phrase_groups(found).collect()} == {("a", "zorn's lemma"): (2, [1, 2]), ("a", "É"): (2, [2])}


def test_lines_of_offsets(spark):
    text = "aé\n\n𝔸b\n"
    got = spark.createDataFrame([(text, list(range(len(text)))), (None, [0])], "t string, at array<int>").select(tex.lines_at("t", "at").alias("n")).collect()
    assert got[0]["n"] == [text[:k].count("\n") + 1 for k in range(len(text))] and got[1]["n"] == [1]


@pytest.mark.parametrize("spaces", [0, 2])
def test_file_digests(spark, spaces):
    files = [("c", n, f"p/{n}\"é.tex", f"text {n}" if n else "") for n in range(30)] + [("d", 1, "x", None)]
    made = {r["component"]: r["sha256"] for r in assembly.file_digests(spark.createDataFrame(files, "component string, ordinal int, path string, content string"), spaces).collect()}
    for c in "cd":
        entries = [{"path": p, "contentSha256": sha(t or "")} for k, _, p, t in files if k == c]
        assert made[c] == sha(json.dumps(entries, indent=2, ensure_ascii=False) + "\n" if spaces else compact(entries))


def test_import_digests(spark):
    rows = [("c", n, f"p{n % 3}", n // 3 + 1, SHA, f"t{n}", f"a{n}") for n in range(12)]
    instances = spark.createDataFrame(rows, "component string, ordinal int, path string, path_occurrence int, context_digest string, content string, active_content string")
    sources = spark.createDataFrame([("c", "m.tex", "AB", ["x\"y", "z"]), ("e", "n.tex", "CD", [])], "component string, entry_file string, revision string, configuration array<string>")
    made = {r["component"]: r["sha256"] for r in assembly.instance_digests(instances, sources).collect()}
    listed = [{"path": p, "ordinal": n, "pathOccurrence": k, "contextDigest": d, "contentSha256": sha(t), "activeContentSha256": sha(a)} for _, n, p, k, d, t, a in rows]
    assert made["c"] == sha(compact({"entryFile": "m.tex", "sourceRevision": "ab", "configurationFiles": ["x\"y", "z"], "orderedImportInstances": listed}))
    assert made["e"] == sha(compact({"entryFile": "n.tex", "sourceRevision": "cd", "configurationFiles": [], "orderedImportInstances": []}))


def test_record_digests_and_metadata(spark):
    rng = random.Random(2)
    lists = {c: {k: [{"id": f"{k}{n}", "é": "\"\n"} for n in range(rng.randint(0, 40))] for k in component_files.COLLECTIONS} for c in ("a", "b")} | {"empty": {k: [] for k in component_files.COLLECTIONS}}
    rows = [(c, k, n, compact(r)) for c, parts in lists.items() for k, records in parts.items() for n, r in enumerate(records)]
    rng.shuffle(rows)
    records = spark.createDataFrame(rows, "component string, collection string, ordinal long, record string").repartition(5)
    editions = spark.createDataFrame([edition(c) for c in lists], EDITION)
    files = spark.createDataFrame([(c, SHA) for c in lists], "component string, sha256 string")
    made = {r["component"]: r for r in assembly.assemble(editions, files, records, PINNED).collect()}
    for c, parts in lists.items():
        graph = {k: parts[k] for k in list(component_files.COLLECTIONS)[2:]}
        whole = {"sourceUnits": parts["sourceUnits"], "unitInventories": parts["unitInventories"]}
        row, metadata = made[c], json.loads(made[c]["metadata"])
        assert (row["unit_manifest_sha256"], row["extraction_sha256"], row["graph_sha256"]) == (sha(compact(parts["sourceUnits"])), sha(compact(whole)), sha(compact(graph)))
        assert list(metadata) == list(component_files.METADATA) and metadata["exactEdition"]["editionId"] == "s0001-latex-bbbbbbbbbbbb" and metadata["exactEdition"]["label"] == 'Book é "x"'
        assert metadata["graphState"]["graphAudit"] == {"actorId": "latex-importer", "completedAt": "2024-05-06T07:08:09Z", "artifactSha256": row["graph_sha256"], "nodeCount": len(parts["nodes"]), "externalInputCount": len(parts["externalInputs"]), "directDependencyCount": len(parts["directDependencies"]), "proofRouteCount": len(parts["proofRoutes"]), "referenceCount": len(parts["references"])}
    web = assembly.assemble(editions, files, records, assembly.Style("web", "web-export", "web-node", "w", pinned=False, finished=False)).first()
    state = json.loads(web["metadata"])
    assert state["exactEdition"]["editionId"] == "s0001-web-aaaaaaaaaaaa" and (state["extractionState"]["status"], state["extractionState"]["extractionAudit"], state["graphState"]["status"]) == ("extracting", None, "building")


def test_tex_component(spark, tmp_path):
    one = "\\begin{definition}\\label{d}X.\\end{definition}\n\n\\begin{theorem}[Big]\\label{t}It holds.\\end{theorem}\n\\begin{proof}\nBy \\ref{d}, \\ref{gone}\nand \\cite[Thm 1]{W}.\n\\end{proof}"
    units = spark.createDataFrame([("book", "two", 2, "words only"), ("book", "one", 1, one)], "component string, unit string, ordinal int, content string")
    records = assembly.tex_records(units, spark.createDataFrame([("book", "2024-01-01T00:00:00Z")], "component string, captured_at string"), "me").persist()
    got = {}
    for r in records.orderBy("collection", "ordinal").collect():
        got.setdefault(r["collection"], []).append(json.loads(r["record"]))
    assert [(u["id"], u["ordinal"], u["contentSha256"]) for u in got["sourceUnits"]] == [("unit-one", 1, sha(one)), ("unit-two", 2, sha("words only"))]
    assert [(i["theoremNodeIds"], i["supportNodeIds"], i["theoremFreeAttestation"]) for i in got["unitInventories"]] == [(["one:t"], ["one:d"], False), ([], [], True)]
    assert [n["id"] for n in got["nodes"]] == ["one:d", "one:t"] and [e["id"] for e in got["directDependencies"]] == ["dep-one:t-to-one:d"]
    assert got["proofRoutes"][0]["dependencyIds"] == ["dep-one:t-to-one:d"]
    assert sorted((r["basis"], r["ref"], r["resolution"]["status"]) for r in got["references"]) == [("proof-citation", "W", "unresolved"), ("proof-xref", "gone", "unresolved")]
    cited = next(r for r in got["references"] if r["basis"] == "proof-citation")
    assert (cited["locator"], cited["pinpoint"], cited["ownerNodeId"]) == ("one.tex:L6", "Thm 1", "one:t")
    editions = spark.createDataFrame([edition()], EDITION)
    heads = assembly.assemble(editions, assembly.file_digests(units.select("component", "ordinal", F.col("unit").alias("path"), "content")), records, PINNED)
    assert not assembly.assembly_rules(editions, heads, PINNED).collect()
    component_files.write_components(records, heads.select("component", "source_record", "metadata", "distribution"), str(tmp_path))
    back = component_files.read_components(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, records.collect()))


def test_rules_of_nothing(spark):
    editions = spark.createDataFrame([edition(revision=None, captured_at=None, record="X1")], EDITION)
    none = spark.createDataFrame([], "component string, sha256 string")
    records = spark.createDataFrame([], "component string, collection string, ordinal long, record string")
    made = assembly.assemble(editions, none, records, PINNED)
    assert {r["rule"] for r in assembly.assembly_rules(editions, made, PINNED).collect()} == {"artifact-missing", "no-source-unit", "revision", "source-record", "captured-at"}
    assert not assembly.assemble(editions.limit(0), none, records, PINNED).collect()
