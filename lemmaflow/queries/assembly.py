"""Queries of citations in proofs and of whole components on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import shared_folder, stash, table
from ..operators import citations
from ..sources import assembly, component_files
from .files import _PARTS, _RECORDS, part_components
from .scalars import query

_PINNED = assembly.Style("latex", "latex", "chapter", "latex-importer")
_EXPORT = assembly.Style("export", "web-export", "web-node", "export-importer", pinned=False, finished=False)


def _proofs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A unit for each brand: three lines a part, the second one of its proof; parts of one size class are one owner."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    pinpoint = F.when(size % 4 == 0, F.concat(F.lit("[ Thm "), (size % 3).cast("string"), F.lit("]"))).when(size % 4 == 1, "[ ]").otherwise("")
    keys = F.concat(F.lit("K"), (size % 5).cast("string"), F.when(size % 2 == 0, F.lit(", M")).otherwise(""))
    broken = F.when(size % 11 == 0, F.lit(" \\cite{open")).otherwise("")
    line = F.concat(F.lit("By \\cite"), pinpoint, F.lit("{"), keys, F.lit("} it is Clearly so, clearly"), broken, F.lit(" % \\cite{no} clearly"))
    three = F.concat(F.lit("\\begin{proof}\n"), line, F.lit("\n\\end{proof}"))
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", three.alias("text"), (size % 7).alias("owner")))).alias("rows"))
    units = rows.select(F.lit("parts").alias("component"), F.col("p_brand").alias("unit"), F.array_join(F.transform("rows", lambda x: x["text"]), "\n").alias("content"))
    spots = rows.select(F.col("p_brand").alias("unit"), F.posexplode("rows").alias("n", "r"))
    proofs = spots.select(F.lit("parts").alias("component"), "unit", F.concat("unit", F.lit("/"), F.col("r.owner").cast("string")).alias("owner"), (3 * F.col("n") + 1).alias("start_line"), (3 * F.col("n") + 3).alias("end_line"))
    return units, proofs


_SPOTS = """p AS (SELECT *, p_brand || '/' || p_size % 7 AS owner, 3 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) - 1 AS line FROM part),
k AS (SELECT *, 0 AS place, 'K' || p_size % 5 AS key FROM p UNION ALL SELECT *, 1, 'M' FROM p WHERE p_size % 2 = 0),
c AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN 'Thm ' || p_size % 3 END AS pin FROM k)"""
_CONTEXT = "'By [citation] it is Clearly so, clearly' || CASE WHEN p_size % 11 = 0 THEN ' \\cite{open' ELSE '' END"


@query(f"""WITH {_SPOTS}, g AS (SELECT owner, key, pin AS pinpoint, first({_CONTEXT} ORDER BY line, place) AS context, string_agg(p_brand || '.tex:L' || line, '; ' ORDER BY line, place) AS locator, count(*)::INTEGER AS occurrences,
sha256('[' || chr(10) || string_agg('  {{' || chr(10) || '    "key": "' || key || '",' || chr(10) || '    "pinpoint": ' || coalesce('"' || pin || '"', 'null') || ',' || chr(10) || '    "lineNumber": ' || line || ',' || chr(10) || '    "context": "' || replace({_CONTEXT}, '\\', '\\\\') || '"' || chr(10) || '  }}', ',' || chr(10) ORDER BY line, place) || chr(10) || ']' || chr(10)) AS evidence FROM c GROUP BY ALL)
SELECT 'ref-' || owner || '-to-cite-' || left(sha256(encode(key) || '\\x00'::BLOB || encode(coalesce(pinpoint, ''))), 12) || '-proof-citation' AS reference, owner, key, pinpoint, context, locator, occurrences, evidence, CASE WHEN key = 'M' AND pinpoint IS NULL THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN key = 'M' AND pinpoint IS NULL THEN 'input-M' END AS target FROM g""")
def ext_proof_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each owner as references; M without a pinpoint is known."""
    units, proofs = _proofs(spark, d)
    found, _ = citations.proof_citations(units, proofs)
    owners = proofs.select("component", "owner").distinct()
    known = owners.select("component", "owner", F.lit("M").alias("key"), F.lit(None).cast("string").alias("pinpoint"), F.lit("input-M").alias("target"), F.lit("d").alias("dependency"))
    return citations.citation_references(found, known).select("reference", "owner", "key", "pinpoint", "context", "locator", "occurrences", F.col("evidence_sha256").alias("evidence"), "status", "target")


@query("SELECT p_brand AS unit, 3 * n - 1 AS line FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE p_size % 11 = 0")
def val_citation_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a citation that does not end in them."""
    return citations.proof_citations(*_proofs(spark, d))[1].select("unit", F.col("line").cast("long").alias("line"))


@query(f"""WITH {_SPOTS} SELECT owner, 'clear(ly)?' AS pattern, 2 * count(*) AS occurrences, string_agg((line - 1)::VARCHAR, ',' ORDER BY line) AS proofs FROM p WHERE p_size % 7 < 5 GROUP BY owner
UNION ALL SELECT owner, 'by \\\\cite\\{{', count(*), string_agg((line - 1)::VARCHAR, ',' ORDER BY line) FROM p WHERE p_size % 7 >= 3 AND p_size % 4 > 1 GROUP BY owner""")
def ext_proof_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Owners below 5 are asked for one phrase, those from 3 for another."""
    units, proofs = _proofs(spark, d)
    owners = proofs.select("component", "owner", F.substring_index("owner", "/", -1).cast("int").alias("k")).distinct()
    phrases = owners.where("k < 5").select("component", "owner", F.lit("clear(ly)?").alias("pattern")).unionByName(owners.where("k >= 3").select("component", "owner", F.lit(r"by \\cite\{").alias("pattern")))
    groups = citations.phrase_groups(citations.phrase_occurrences(units, proofs, phrases))
    return groups.select("owner", "pattern", "occurrences", F.array_join("proofs", ",").alias("proofs"))


def _editions(spark: SparkSession, d: str) -> DataFrame:
    """An edition for each brand, with a fault by the number of the brand."""
    brand = F.col("p_brand")
    n = F.try_to_number(F.regexp_extract(brand, r"(\d+)$", 1), F.lit("99")).cast("int").alias("n")
    named = table(spark, d, "part").select(brand, n).distinct()
    n = F.col("n")
    component = F.lower(F.replace(brand, F.lit("#"), F.lit("-")))
    text = lambda s: F.lit(s).cast("string")
    return named.select(
        component.alias("component"), F.concat(F.lit("S"), F.lpad(n.cast("string"), 4, "0")).alias("source_record"), F.concat(F.lit('{"componentId":"'), component, F.lit('"}')).alias("identity"), F.when(n % 7 == 0, "never").otherwise("2024-05-06T07:08:09Z").alias("captured_at"),
        brand.alias("label"), (1980 + n).alias("publication_year"), F.when(n % 5 == 0, " ").when(n % 2 == 0, " P ").alias("publisher"), F.when(n % 3 == 0, "ftp://h").otherwise("https://h.org/x").alias("locator"), F.lit("open").alias("access_kind"), text(None).alias("license_spdx"),
        text(None).alias("license_url"), F.lit("none seen").alias("license_note"), text("https://h.org/r").alias("repository"), F.when(n % 3 == 0, "abc").otherwise(F.sha1(brand)).alias("revision"), F.lit("e").alias("extraction_note"), F.lit("g").alias("graph_note"), text(None).alias("distribution"), "n",
    )


def _files(spark: SparkSession, d: str) -> DataFrame:
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    return table(spark, d, "part").where("p_size % 2 = 0").select(brand.alias("component"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".tex")).alias("path"), F.col("p_name").alias("content"))


_ASSEMBLED = f"""p AS ({_PARTS}), r AS ({_RECORDS}), n AS (SELECT component, '[' || string_agg(record, ',' ORDER BY ordinal) || ']' AS nodes, count(*) AS n_nodes FROM r WHERE collection = 'nodes' GROUP BY component),
e AS (SELECT component, '[' || string_agg(record, ',' ORDER BY ordinal) || ']' AS edges FROM r WHERE collection = 'directDependencies' GROUP BY component),
f AS (SELECT component, sha256('[' || string_agg('{{"path":"src/' || p_partkey || '.tex","contentSha256":"' || sha256(p_name) || '"}}', ',' ORDER BY p_partkey) || ']') AS artifact FROM p WHERE p_size % 2 = 0 GROUP BY component),
b AS (SELECT DISTINCT component, p_brand, regexp_extract(p_brand, '(\\d+)$', 1)::INTEGER AS n FROM p)"""


@query(f"""WITH {_ASSEMBLED} SELECT component, artifact AS artifact_sha256, sha256('[]') AS unit_manifest_sha256, sha256('{{"sourceUnits":[],"unitInventories":[]}}') AS extraction_sha256, sha256('{{"nodes":' || nodes || ',"externalInputs":[],"directDependencies":' || edges || ',"proofRoutes":[],"references":[]}}') AS graph_sha256,
n_nodes AS nodes, 's' || lpad(n::VARCHAR, 4, '0') || '-latex-' || left(CASE WHEN n % 3 = 0 THEN 'abc' ELSE sha1(p_brand) END, 12) AS edition, CASE WHEN n % 5 = 0 THEN '' WHEN n % 2 = 0 THEN 'P' END AS publisher, 'extracted' AS status, n_nodes::VARCHAR AS audited FROM n JOIN e USING (component) JOIN b USING (component) LEFT JOIN f USING (component)""")
def ext_component_edition(spark: SparkSession, d: str) -> DataFrame:
    """Digests, edition and audits of a component for each brand."""
    made = assembly.assemble(_editions(spark, d), assembly.file_digests(_files(spark, d)), part_components(table(spark, d, "part"))[0], _PINNED)
    said = lambda path: F.get_json_object("metadata", path)
    return made.select("component", "artifact_sha256", *assembly.LAYOUTS, F.col("nodeCount").alias("nodes"), said("$.exactEdition.editionId").alias("edition"), said("$.exactEdition.publisher").alias("publisher"), said("$.graphState.status").alias("status"), said("$.graphState.graphAudit.nodeCount").alias("audited"))


@query(f"""WITH {_ASSEMBLED}, x AS (SELECT * FROM b LEFT JOIN f USING (component))
SELECT component, 'captured-at' AS rule, 'never' AS detail FROM x WHERE n % 7 = 0 UNION ALL SELECT component, 'artifact-missing', '' FROM x WHERE artifact IS NULL UNION ALL SELECT component, 'no-source-unit', '' FROM x
UNION ALL SELECT component, 'publisher', ' ' FROM x WHERE n % 5 = 0 UNION ALL SELECT component, 'locator', 'ftp://h' FROM x WHERE n % 3 = 0 UNION ALL SELECT component, 'artifact-digest-form', 'XYZ' FROM x WHERE n % 4 = 1
UNION ALL SELECT component, 'artifact-digest', artifact FROM x WHERE n % 4 = 2 AND artifact IS NOT NULL UNION ALL SELECT component, 'title', 'other' FROM x WHERE n % 6 = 1 UNION ALL SELECT component, 'author', '' FROM x WHERE n % 6 = 2""")
def val_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Editions of exports bound to what the source says, with planted violations."""
    editions, artifacts = _editions(spark, d), assembly.file_digests(_files(spark, d))
    made = assembly.assemble(editions, artifacts, part_components(table(spark, d, "part"))[0], _EXPORT)
    n = F.col("n")
    digest = F.when(n % 4 == 1, "XYZ").when(n % 4 == 2, F.sha2("label", 256)).when(n % 4 == 3, F.col("sha256"))
    bound = editions.join(artifacts, "component", "left").select("component", digest.alias("expected_sha256"), F.concat("label", F.lit("  B&amp;C")).alias("title"), F.lit("Ann Bee").alias("author"), F.when(n % 6 == 1, "other").otherwise(F.concat(F.upper("label"), F.lit(" b & c"))).alias("found_title"), F.when(n % 6 == 2, "").otherwise("ann bee, Cy Dee").alias("found_author"))
    return assembly.assembly_rules(editions, made, _EXPORT, bound)


@query("""WITH c AS (SELECT p_brand, p_size % 5 AS k, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT DISTINCT p_brand FROM part), x AS (SELECT p_brand, k::BIGINT AS k, CASE WHEN k = 1 THEN 3 ELSE coalesce(n, 0) + CASE WHEN k = 7 THEN 1 ELSE 0 END END AS expected, coalesce(n, 0) AS actual FROM b CROSS JOIN (SELECT unnest([0, 1, 2, 7]) AS k) LEFT JOIN c USING (p_brand, k))
SELECT p_brand AS component, 'e' || k AS environment, expected, actual FROM x WHERE expected <> actual""")
def val_environment_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of an audit: 0 and 2 are as found, 1 is always 3, 7 stands nowhere."""
    parts = table(spark, d, "part").select(F.col("p_brand").alias("component"), F.concat(F.lit("e"), (F.col("p_size") % 5).cast("string")).alias("environment"))
    counts = parts.groupBy("component", "environment").agg(F.count("*").alias("n"))
    names = parts.select("component").distinct().withColumn("environment", F.explode(F.array(*[F.lit(f"e{k}") for k in (0, 1, 2, 7)])))
    expected = names.join(counts, ["component", "environment"], "left").withColumn("expected", F.when(F.col("environment") == "e1", 3).when(F.col("environment") == "e7", 1).otherwise(F.coalesce("n", F.lit(0))))
    return assembly.count_mismatches(parts, expected)


@query("""WITH p AS (SELECT lower(replace(p_brand, '#', '-')) AS component, *, p_size % 3 <> 0 AS thm FROM part), c AS (SELECT component, count(*) AS nodes, count(*) FILTER (WHERE thm) AS routes FROM p GROUP BY component),
u AS (SELECT p.component, p.p_partkey AS src, t.p_partkey AS dst FROM p JOIN p t ON t.component = p.component AND t.p_partkey < p.p_partkey AND (t.p_partkey = p.p_partkey // 2 OR t.p_partkey = p.p_partkey // 3) WHERE p.thm),
e AS (SELECT component, count(*) AS edges FROM u GROUP BY component), l AS (SELECT p.component, p_partkey, p_partkey // k AS t FROM p, (SELECT unnest([2, 3]) AS k) WHERE thm AND p_partkey // k > 0),
m AS (SELECT component, count(DISTINCT (p_partkey, t)) AS missing FROM l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.component = l.component AND p.p_partkey = l.t) GROUP BY component), d AS (SELECT * FROM (SELECT component, nodes FROM c))
SELECT component, 1::BIGINT AS units, nodes, coalesce(edges, 0) AS edges, routes, coalesce(missing, 0) + routes AS refs FROM c LEFT JOIN e USING (component) LEFT JOIN m USING (component)""")
def snk_tex_components(spark: SparkSession, d: str) -> DataFrame:
    """From TeX to component files and back: a component for each brand, its parts as statements; theorems use part k div 2 and k
    div 3 and cite one work. What the audit of the stored index counted is what is read."""
    key = F.col("p_partkey")
    links = F.concat(*[F.when(F.floor(key / k) > 0, F.format_string("\\ref{p%d} ", F.floor(key / k))).otherwise("") for k in (2, 3)])
    theorem = F.format_string("\\begin{theorem}\\label{p%d} Part %d holds. \\end{theorem}\n\\begin{proof}\nBy %s and \\cite[p. 3]{W} all\nis clear. \\end{proof}", key, key, links)
    one = F.when(F.col("p_size") % 3 != 0, theorem).otherwise(F.format_string("\\begin{definition}\\label{p%d} Part %d.\n\\end{definition}", key, key))
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), one.alias("text")))).alias("rows"))
    component = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    units = stash(rows.select(component.alias("component"), F.lit("u").alias("unit"), F.lit(1).alias("ordinal"), F.array_join(F.transform("rows", lambda x: x["text"]), "\n").alias("content")), "tex-units")
    editions = _editions(spark, d).withColumn("identity", F.concat(F.lit('{"componentId":"'), "component", F.lit('","sourceRecordId":"'), "source_record", F.lit('"}')))
    records = stash(assembly.tex_records(units, editions.select("component", "captured_at"), _PINNED.actor), "tex-records")
    heads = assembly.assemble(editions, assembly.file_digests(units.select("component", "ordinal", F.lit("u.tex").alias("path"), "content"), 2), records, _PINNED)
    folder = f"{shared_folder(spark).rstrip('/')}/components-{uuid.uuid4().hex}"
    component_files.write_components(records, stash(heads.select("component", "source_record", "metadata", "distribution"), "tex-heads"), folder)
    n = lambda name: F.count_if(F.col("collection") == name)
    read = component_files.read_components(spark, folder).groupBy("component").agg(n("sourceUnits").alias("units"), n("nodes").alias("nodes"), n("directDependencies").alias("edges"), n("proofRoutes").alias("routes"), n("references").alias("refs"))
    audit = lambda path: F.get_json_object("metadata", path).cast("long")
    stored = component_files.read_components(spark, folder, index_only=True).select("component", audit("$.extractionState.extractionAudit.sourceUnitCount").alias("a"), audit("$.graphState.graphAudit.nodeCount").alias("b"), audit("$.graphState.graphAudit.directDependencyCount").alias("c"), audit("$.graphState.graphAudit.proofRouteCount").alias("d"), audit("$.graphState.graphAudit.referenceCount").alias("e"))
    return read.join(stored, "component").where("a = units and b = nodes and c = edges and d = routes and e = refs").drop("a", "b", "c", "d", "e")
