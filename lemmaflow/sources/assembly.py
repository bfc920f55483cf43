"""Whole components from records (EXT08, EXT10, EXT13, EXT16): digests in their order, exact edition, audits, and the
rules that bind them to their source.

Records are (component, collection, ordinal, record), as component files hold them. Digests over a list follow its
order, so each is made as a sorted stream of its own (component and digest are the key), never held whole;
contents of files are digested in their rows first, and only 64 digits of each go on. Everything else is
counts and columns. Components without records have the digests of empty lists and counts of zero.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..common import stash
from ..functions import tex, text
from ..functions.json_text import json_text, quoted
from ..operators.citations import citation_references, proof_citations
from . import books
from .component_files import PHASE

#: fixed values: what stands before each collection in the text that a digest is made of, and at its end
LAYOUTS = {
    "unit_manifest_sha256": (("[", "sourceUnits"), ("]", None)),
    "extraction_sha256": (('{"sourceUnits":[', "sourceUnits"), ('],"unitInventories":[', "unitInventories"), ("]}", None)),
    "graph_sha256": (
        ('{"nodes":[', "nodes"), ('],"externalInputs":[', "externalInputs"), ('],"directDependencies":[', "directDependencies"),
        ('],"proofRoutes":[', "proofRoutes"), ('],"references":[', "references"), ("]}", None),
    ),
}
#: fixed values: counts of the two audits, by collection
EXTRACTION_COUNTS = {"sourceUnits": "sourceUnitCount", "unitInventories": "unitInventoryCount"}
GRAPH_COUNTS = {"nodes": "nodeCount", "externalInputs": "externalInputCount", "directDependencies": "directDependencyCount", "proofRoutes": "proofRouteCount", "references": "referenceCount"}


@dataclass(frozen=True)
class Style:
    """What editions of one kind of source share. ``pinned``: they name a full revision of a repository; else the artifact
    names them, and their address is one of the web. ``finished``: extraction is done, and both audits are given."""

    name: str
    source_format: str
    unit_kind: str
    actor: str
    pinned: bool = True
    finished: bool = True


def stream_digests(rows: DataFrame, by: list[str], order: list[str], separator: str = ",") -> DataFrame:
    """rows: (by.., order.., text, listed). (by.., sha256) of the texts in their order; the separator stands between two that
    are both listed."""
    # by a hash of the key: a repartition by the key itself is left out above a join on it, which may then change its own
    kept = rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order).select(*[F.col(c).cast("string").alias(c) for c in by], "text", "listed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, after = None, hashlib.sha256(), False
        for batch in batches:
            for *key, value, listed in zip(*[batch[c] for c in by], batch["text"], batch["listed"]):
                if key != now:
                    if now is not None:
                        yield pd.DataFrame([[*now, digest.hexdigest()]], columns=[*by, "sha256"])
                    now, digest, after = key, hashlib.sha256(), False
                digest.update(((separator if after and listed else "") + value).encode())
                after = listed
        if now is not None:
            yield pd.DataFrame([[*now, digest.hexdigest()]], columns=[*by, "sha256"])

    return kept.mapInPandas(run, ", ".join(f"`{c}` string" for c in by) + ", sha256 string")


def record_digests(components: DataFrame, records: DataFrame) -> DataFrame:
    """(component, unit_manifest_sha256, extraction_sha256, graph_sha256) of all ``components``."""
    piece = lambda name, place, said: F.struct(F.lit(name).alias("digest"), F.lit(place).alias("place"), F.lit(said).alias("text"))
    frames = F.array(*[piece(name, place, said) for name, layout in LAYOUTS.items() for place, (said, _) in enumerate(layout)])
    frame = components.select("component").distinct().select("component", F.explode(frames).alias("p")).select("component", "p.*", F.lit(-1).cast("long").alias("ordinal"), F.lit(False).alias("listed"))
    uses = [(collection, F.struct(F.lit(name).alias("digest"), F.lit(place).alias("place"))) for name, layout in LAYOUTS.items() for place, (_, collection) in enumerate(layout) if collection]
    spread = F.array_compact(F.array(*[F.when(F.col("collection") == collection, use) for collection, use in uses]))
    listed = records.join(components.select("component").distinct(), "component", "left_semi").select("component", F.explode(spread).alias("p"), F.col("record").alias("text"), F.col("ordinal").cast("long").alias("ordinal"))
    rows = frame.unionByName(listed.select("component", "p.*", "text", "ordinal", F.lit(True).alias("listed")))
    made = stream_digests(rows, ["component", "digest"], ["place", "ordinal"])
    return made.groupBy("component").agg(*[F.max(F.when(F.col("digest") == name, F.col("sha256"))).alias(name) for name in LAYOUTS])


def manifest_digests(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """entries: (component, ordinal, entry) as JSON; heads: (component, opening), what stands before a list that is a key of
    an object. (component, sha256) of the list, or of the object."""
    rows = entries.select("component", F.lit(1).alias("place"), F.col("ordinal").cast("long").alias("ordinal"), F.col("entry").alias("text"), F.lit(True).alias("listed"))
    known = (heads if heads is not None else entries.select("component").distinct().withColumn("opening", F.lit(""))).select("component", "opening")
    ends = F.array(F.struct(F.lit(0).alias("place"), F.concat("opening", F.lit("[")).alias("text")), F.struct(F.lit(2).alias("place"), F.concat(F.lit("]"), F.when(F.col("opening") == "", "").otherwise("}")).alias("text")))
    frame = known.select("component", F.explode(ends).alias("p")).select("component", "p.place", F.lit(0).cast("long").alias("ordinal"), "p.text", F.lit(False).alias("listed"))
    return stream_digests(rows.unionByName(frame), ["component"], ["place", "ordinal"])


def file_digests(files: DataFrame, spaces: int = 0) -> DataFrame:
    """files: (component, ordinal, path, content). (component, sha256) of the list of their paths and digests, compact or with
    an element a line and a line end."""
    value = F.struct("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("contentSha256"))
    typed = StructType().add("path", StringType()).add("contentSha256", StringType())
    if not spaces:
        return manifest_digests(files.select("component", "ordinal", json_text(value, typed).alias("entry")))
    inner = f"\n{' ' * spaces}"
    rows = files.select("component", F.lit(1).alias("place"), F.col("ordinal").cast("long").alias("ordinal"), json_text(value, typed, spaces, level=1).alias("text"), F.lit(True).alias("listed"))
    ends = F.array(F.struct(F.lit(0).alias("place"), F.lit("[" + inner).alias("text")), F.struct(F.lit(2).alias("place"), F.lit("\n]\n").alias("text")))
    frame = files.select("component").distinct().select("component", F.explode(ends).alias("p")).select("component", "p.place", F.lit(0).cast("long").alias("ordinal"), "p.text", F.lit(False).alias("listed"))
    return stream_digests(rows.unionByName(frame), ["component"], ["place", "ordinal"], "," + inner)


def instance_digests(instances: DataFrame, sources: DataFrame) -> DataFrame:
    """instances: (component, ordinal, path, path_occurrence, context_digest, content, active_content), imports in their order;
    sources: (component, entry_file, revision, configuration), the last one an array of paths."""
    typed = StructType().add("path", "string").add("ordinal", "long").add("pathOccurrence", "long").add("contextDigest", "string").add("contentSha256", "string").add("activeContentSha256", "string")
    value = F.struct(
        "path", F.col("ordinal").cast("long").alias("ordinal"), F.col("path_occurrence").cast("long").alias("pathOccurrence"), F.col("context_digest").alias("contextDigest"),
        F.sha2("content", 256).alias("contentSha256"), F.sha2("active_content", 256).alias("activeContentSha256"),
    )
    listed = F.concat(F.lit("["), F.array_join(F.transform("configuration", quoted), ","), F.lit("]"))
    opening = F.concat(F.lit('{"entryFile":'), quoted(F.col("entry_file")), F.lit(',"sourceRevision":'), quoted(F.lower("revision")), F.lit(',"configurationFiles":'), listed, F.lit(',"orderedImportInstances":'))
    return manifest_digests(instances.select("component", "ordinal", json_text(value, typed).alias("entry")), sources.select("component", opening.alias("opening")))


def _typed(rows: DataFrame, value: Column) -> Column:
    return json_text(value, rows.select(value.alias("v")).schema["v"].dataType)


def assemble(editions: DataFrame, artifacts: DataFrame, records: DataFrame, style: Style) -> DataFrame:
    """editions: (component, source_record, identity, captured_at, label, publication_year, publisher, locator, access_kind,
    license_spdx, license_url, license_note, repository, revision, extraction_note, graph_note, distribution), identity and distribution as
    JSON; artifacts: (component, sha256). Headers (component, source_record, metadata, distribution) for
    ``component_files.write_components``, and artifact_sha256, the digests and the counts of collections."""
    counts = records.groupBy("component").agg(*[F.count_if(F.col("collection") == c).alias(n) for c, n in {**EXTRACTION_COUNTS, **GRAPH_COUNTS}.items()])
    known = artifacts.select("component", F.col("sha256").alias("artifact_sha256"))
    rows = editions.join(known, "component", "left").join(record_digests(editions, records), "component", "left").join(counts, "component", "left").fillna(0, [*EXTRACTION_COUNTS.values(), *GRAPH_COUNTS.values()])
    text_ = lambda c: F.col(c).cast("string").alias(c)
    named = F.left(F.col("revision") if style.pinned else F.col("artifact_sha256"), F.lit(12))
    edition = F.struct(
        F.concat(F.lower("source_record"), F.lit(f"-{style.name}-"), named).alias("editionId"), "label", F.col("publication_year").cast("int").alias("publicationYear"), F.trim(text_("publisher")).alias("publisher"),
        F.col("locator").alias("stableLocator"), F.col("artifact_sha256").alias("artifactSha256"), F.col("unit_manifest_sha256").alias("unitManifestSha256"), F.lit(style.unit_kind).alias("sourceUnitKind"),
        F.lit(style.source_format).alias("sourceFormat"), F.col("access_kind").alias("accessKind"), text_("license_spdx").alias("licenseSpdx"), text_("license_url").alias("licenseUrl"), F.col("license_note").alias("licenseNote"),
        text_("repository").alias("sourceRepository"), text_("revision").alias("sourceRevision"),
    )

    def state(status: str, audit: str, digest: str, named: dict[str, str], note: str) -> Column:
        made = F.struct(F.lit(style.actor).alias("actorId"), F.col("captured_at").alias("completedAt"), F.col(digest).alias("artifactSha256"), *named.values())
        return F.struct(F.lit(status).alias("status"), (made if style.finished else F.lit(None).cast("string")).alias(audit), F.lit(None).cast("string").alias("independentReview"), F.col(note).alias("note"))

    extraction = state("extracted" if style.finished else "extracting", "extractionAudit", "extraction_sha256", EXTRACTION_COUNTS, "extraction_note")
    graph = state("extracted" if style.finished else "building", "graphAudit", "graph_sha256", GRAPH_COUNTS, "graph_note")
    metadata = F.concat(
        F.lit(f'{{"phase":"{PHASE}","identity":'), "identity", F.lit(',"exactEdition":'), _typed(rows, edition),
        F.lit(',"extractionState":'), _typed(rows, extraction), F.lit(',"graphState":'), _typed(rows, graph), F.lit("}"),
    )
    return rows.select("component", "source_record", metadata.alias("metadata"), "distribution", "artifact_sha256", *LAYOUTS, *EXTRACTION_COUNTS.values(), *GRAPH_COUNTS.values())


def assembly_rules(editions: DataFrame, assembled: DataFrame, style: Style, bound: DataFrame | None = None) -> DataFrame:
    """Violations (component, rule, detail) of what ``assemble`` was given and made. bound: (component, expected_sha256, title,
    author, found_title, found_author), what the source itself must be and say; a null digest is not asked for."""
    rows = editions.join(assembled.select("component", "artifact_sha256", "sourceUnitCount"), "component", "left")
    checks = [
        ("captured-at", ~tex.captured_at_valid(F.col("captured_at")), F.col("captured_at")), ("artifact-missing", F.col("artifact_sha256").isNull(), F.lit("")),
        ("no-source-unit", F.coalesce("sourceUnitCount", F.lit(0)) == 0, F.lit("")), ("publisher", F.coalesce(F.trim(F.col("publisher").cast("string")) == "", F.lit(False)), F.col("publisher")),
        ("source-record", ~F.regexp_like(F.coalesce("source_record", F.lit("")), F.lit(r"^S\d{4}$")), F.col("source_record")),
        ("revision", ~F.regexp_like(F.coalesce("revision", F.lit("")), F.lit("(?i)^[0-9a-f]{40}$")), F.col("revision")) if style.pinned else ("locator", ~F.regexp_like(F.coalesce("locator", F.lit("")), F.lit(r"(?i)^https?://[^\s/]+")), F.col("locator")),
    ]
    if bound is not None:
        rows = rows.join(bound, "component", "left")
        same = lambda a, b: text.identity_text(F.col(a)) == text.identity_text(F.col(b))
        blank = lambda c: text.identity_text(F.col(c)) == ""
        one, two = text.identity_text("author"), text.identity_text("found_author")
        checks += [
            ("artifact-digest-form", ~F.regexp_like("expected_sha256", F.lit("^[a-f0-9]{64}$")), F.col("expected_sha256")),
            ("artifact-digest", F.regexp_like("expected_sha256", F.lit("^[a-f0-9]{64}$")) & (F.col("expected_sha256") != F.col("artifact_sha256")), F.col("artifact_sha256")),
            ("title", blank("title") | ~same("title", "found_title"), F.col("found_title")), ("author", blank("author") | blank("found_author") | ~(F.contains(one, two) | F.contains(two, one)), F.col("found_author")),
        ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))) for rule, wrong, detail in checks]))
    return rows.select("component", F.explode(found).alias("v")).select("component", "v.rule", "v.detail")


def count_mismatches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """found: (component, environment), a row for each environment that is there; expected: (component, environment, expected), what an
    audit of the revision counted. (component, environment, expected, actual) where they differ; environments that no audit names are free."""
    counted = found.groupBy("component", "environment").agg(F.count("*").alias("actual"))
    both = expected.join(counted, ["component", "environment"], "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    return both.where("expected <> actual").select("component", "environment", F.col("expected").cast("long").alias("expected"), "actual")


def _evidence(unit: Column, locator: Column, captured_at: Column, digest: Column, actor: str, note: Column) -> Column:
    audit = F.struct(F.lit(actor).alias("actorId"), captured_at.alias("capturedAt"), digest.alias("artifactSha256"))
    return F.struct(F.lit("captured").alias("status"), F.array(unit).alias("sourceUnitIds"), locator.alias("locator"), audit.alias("captureAudit"), F.lit(None).cast("string").alias("independentReview"), note.alias("note"))


def tex_records(units: DataFrame, captured: DataFrame, actor: str, resolved: DataFrame | None = None) -> DataFrame:
    """Records of TeX units (component, unit, ordinal, content): units, inventories, nodes, dependencies, routes, and as references
    what stays unresolved and what proofs cite. captured: (component, captured_at). A component's order is one order: units
    by ordinal, then places in them."""
    # texts are parsed once; nodes and edges are written, as seven kinds of records come from them
    made = books.extract_tex(units, found=stash(books.nodes_of(units), "tex-environments"))
    made |= {name: stash(made[name], f"tex-{name}") for name in ("node", "dependency")}
    unit_id = lambda c="unit": F.concat(F.lit("unit-"), F.col(c))
    locator = F.concat("unit", F.lit(".tex"))
    order = units.select("component", "unit", F.col("ordinal").alias("unit_order"))
    dated = units.select("component", "unit", F.col("ordinal").alias("unit_order"), F.sha2("content", 256).alias("digest")).join(captured, "component")
    unit = F.struct(unit_id().alias("id"), F.col("unit_order").cast("long").alias("ordinal"), F.col("unit").alias("label"), locator.alias("locator"), F.col("digest").alias("contentSha256"))

    nodes = made["node"].join(order, ["component", "unit"])
    held = nodes.groupBy("component", "unit").agg(F.array_sort(F.collect_list(F.struct("start", "node", "node_class"))).alias("held"))
    ids = lambda which: F.transform(F.filter(F.coalesce("held", F.array().cast("array<struct<start:int,node:string,node_class:string>>")), lambda x: x["node_class"] == which), lambda x: x["node"])
    inventories = dated.join(held, ["component", "unit"], "left").withColumn("theorems", ids("theorem-like")).withColumn("support", ids("support"))
    counted = F.concat(F.size("theorems").cast("string"), F.lit(" theorem-like and "), F.size("support").cast("string"), F.lit(" support nodes in the whole unit."))
    inventory = F.struct(
        unit_id().alias("sourceUnitId"), F.col("theorems").alias("theoremNodeIds"), F.col("support").alias("supportNodeIds"), F.array().cast("array<string>").alias("sourceArtifactNodeIds"), (F.size("theorems") == 0).alias("theoremFreeAttestation"),
        _evidence(unit_id(), locator, F.col("captured_at"), F.col("digest"), actor, counted).alias("evidence"),
    )
    node = F.struct(F.col("node").alias("id"), F.col("node_class").alias("nodeClass"), "kind", "title", "statement", unit_id().alias("sourceUnitId"))

    spots = nodes.select("component", F.col("node").alias("theorem"), "unit", "unit_order", "start").dropDuplicates(["component", "theorem"])
    edge_id = lambda target: F.concat(F.lit("dep-"), F.col("theorem"), F.lit("-to-"), target)
    edges = made["dependency"].join(spots, ["component", "theorem"])
    edge = F.struct(edge_id(F.col("target")).alias("id"), F.col("theorem").alias("theoremNodeId"), F.struct(F.lit("node").alias("type"), F.col("target").alias("id")).alias("prerequisite"), "role", F.col("occurrences").cast("long").alias("occurrences"))
    routes = made["route"].join(spots, ["component", "theorem"])
    route = F.struct(F.concat(F.lit("route-"), "theorem", F.lit("-"), F.col("route").cast("string")).alias("id"), F.col("theorem").alias("theoremNodeId"), F.lit("proof").alias("kind"), F.transform("targets", edge_id).alias("dependencyIds"))

    lost = made["unresolved"].join(spots, ["component", "theorem"])
    missing = F.struct(F.concat(F.lit("ref-"), "theorem", F.lit("-to-unresolved-"), F.left(F.sha2("ref", 256), F.lit(10)), F.lit("-proof")).alias("id"), F.col("theorem").alias("ownerNodeId"), F.lit("proof-xref").alias("basis"), "ref", F.struct(F.lit("unresolved").alias("status"), F.col("reason").alias("note")).alias("resolution"))
    cited = _tex_citations(units, made, resolved).join(spots.drop("unit"), [F.col("owner") == F.col("theorem"), F.col("c") == F.col("component")]).join(captured, "component")
    source = F.when(F.col("target").isNotNull(), F.struct(F.lit("external-input").alias("type"), F.col("target").alias("id")))
    citation = F.struct(
        F.col("reference").alias("id"), F.col("owner").alias("ownerNodeId"), F.lit("proof-citation").alias("basis"), F.col("key").alias("ref"), "pinpoint", "context", "locator",
        F.struct("status", source.alias("target"), F.col("dependency").cast("string").alias("directDependencyId")).alias("resolution"),
        _evidence(unit_id(), F.col("locator"), F.col("captured_at"), F.col("evidence_sha256"), actor, F.concat(F.col("occurrences").cast("string"), F.lit(" citations in proofs, merged by key and pinpoint."))).alias("evidence"),
    )

    none = F.lit("")
    parts = [
        ("sourceUnits", dated, unit, F.lit(0), none, none), ("unitInventories", inventories, inventory, F.lit(0), none, none), ("nodes", nodes, node, F.col("start"), F.col("node"), none),
        ("directDependencies", edges, edge, F.col("start"), F.col("theorem"), F.col("target")), ("proofRoutes", routes, route, F.col("start"), F.col("theorem"), F.col("route").cast("string")),
        ("references", lost, missing, F.col("start"), F.col("theorem"), F.col("ref")), ("references", cited, citation, F.col("start"), F.col("theorem"), F.col("reference")),
    ]
    # each kind is a table of its own, so that no plan holds the JSON of all
    rows = [stash(df.select("component", F.lit(name).alias("collection"), F.col("unit_order").cast("long").alias("o"), at.cast("long").alias("at"), a.alias("a"), b.alias("b"), _typed(df, value).alias("record")), f"tex-{name}") for name, df, value, at, a, b in parts]
    number = F.row_number().over(W.partitionBy("component", "collection").orderBy("o", "at", "a", "b", "record")) - 1
    return reduce(DataFrame.unionByName, rows).select("component", "collection", number.cast("long").alias("ordinal"), "record")


def _tex_citations(units: DataFrame, made: dict[str, DataFrame], resolved: DataFrame | None) -> DataFrame:
    """References of what proofs cite, by the theorem that owns the proof; the component is called c."""
    listed = made["proof"].groupBy("component", "unit").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("theorem").alias("owner")))).alias("p"))
    held = listed.join(units.select("component", "unit", "content"), ["component", "unit"])
    first, last = tex.lines_at("content", F.transform("p", lambda x: x["start"])), tex.lines_at("content", F.transform("p", lambda x: x["end"] - 1))
    zipped = held.select("component", "unit", "p", first.alias("a"), last.alias("b")).select("component", "unit", F.explode(F.arrays_zip("p", "a", "b")).alias("x"))
    proofs = zipped.select("component", "unit", "x.p.owner", F.col("x.a").alias("start_line"), F.col("x.b").alias("end_line"))
    citations, _ = proof_citations(units, proofs)
    known = resolved if resolved is not None else citations.select("component", "owner", "key", "pinpoint", F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("dependency")).limit(0)
    return citation_references(citations, known).withColumnRenamed("component", "c")
