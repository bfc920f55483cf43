"""The ledger of sources: which edition a component is taken from, and who approved it
(ID40-ID42, PRJ14, PRJ20-PRJ22, JOIN33-JOIN35, AGG05, VAL24, VAL25, VAL28, VAL29).

Tables: expected (component, record, ordinal, component_id, label); record (component, revision,
selected); lead (component, lead, disposition, proposal); proposal (component, proposal, kind,
edition struct, target, evidence_locator, evidence_sha256, reason, actor, audit_sha256, decision,
reviewer, review_sha256, license struct (status, distribution, decision, reviewer, sha256));
blocker (component, blocker, domain, state, resolution, proposal); assessment (component,
assessment, proposal, outcome, pin_sha256, extraction_sha256, graph_sha256, by, at);
administrator (actor). Violations are rows (rule, entity, detail).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import importer_state, resolution_state
from .rules import Tables, holds, refers, unique

#: fixed values: order in which open domains are listed
DOMAINS = ("identity", "acquisition", "license", "importer")
PIN = ("artifactSha256", "sourceRepository", "sourceRevision", "stableLocator")
LICENSE = ("accessKind", "editionId", "licenseNote", "licenseSpdx", "licenseUrl", "stableLocator")


def subject_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of a subject written as JSON with keys in order, nulls included."""
    text = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(text, 256)


def sorted_struct(value: str, names: tuple[str, ...]) -> Column:
    """The named fields of a struct column, in order of their names."""
    return F.struct(*[F.col(f"{value}.{n}").alias(n) for n in sorted(names)])


def proposal_digest(edition_fields: tuple[str, ...], revision: Column) -> Column:
    """What an audit of a proposal is bound to. Reads the columns of proposal."""
    common = {"sourceSetRevision": revision, "bookGraphId": F.col("component"), "kind": F.col("kind"), "id": F.col("proposal")}
    exact = subject_digest(common | {"edition": sorted_struct("edition", edition_fields)})
    names = {"targetBookGraphId": "target", "evidenceLocator": "evidence_locator", "evidenceSha256": "evidence_sha256", "reason": "reason"}
    return F.when(F.col("kind") == "exact-edition", exact).otherwise(subject_digest(common | {k: F.col(c) for k, c in names.items()}))


def license_digest(revision: Column) -> Column:
    """What a licence review is bound to; null unless the proposal is of an exact edition."""
    fields = {"sourceSetRevision": revision, "bookGraphId": F.col("component"), "distributionClass": F.col("license.distribution")}
    return F.when(F.col("kind") == "exact-edition", subject_digest(fields | {n: F.col(f"edition.{n}") for n in LICENSE}))


def pin_digest() -> Column:
    """What a source pin is bound to. Reads the column edition."""
    return subject_digest({n: F.col(f"edition.{n}") for n in PIN})


def expected_components(records: DataFrame) -> DataFrame:
    """records: (record, ordinal, components array of (id, label)). One row for each component."""
    rows = records.select("record", "ordinal", F.explode("components").alias("c"))
    return rows.select(F.concat_ws(":", "record", "c.id").alias("component"), "record", "ordinal", F.col("c.id").alias("component_id"), F.col("c.label").alias("label"), F.concat("record", F.lit("/"), "c.id", F.lit(".json")).alias("path"))


def registry_rules(records: DataFrame) -> DataFrame:
    """Rules of the registry from which the components come."""
    listed = expected_components(records)
    placed = records.select("record", "ordinal", F.substr("record", F.lit(2)).try_cast("long").alias("number"))
    return reduce(DataFrame.unionByName, [
        holds(placed, "record-form", F.regexp_like("record", F.lit("^S[0-9]{4}$")), F.col("record")),
        holds(records, "record-has-components", F.size("components") > 0, F.col("record")),
        holds(listed, "component-form", F.regexp_like("component_id", F.lit("^[a-z0-9][a-z0-9-]*$")) & (F.length("label") > 0), F.col("component")),
        unique(listed, "component-once", ["component"]),
        unique(records, "record-ordinal-once", ["ordinal"]),
    ])


def record_rules(t: Tables, revision: str, edition_fields: tuple[str, ...]) -> DataFrame:
    """All violations of the resolution records."""
    record, lead, proposal, blocker, assessment = (t[n] for n in ("record", "lead", "proposal", "blocker", "assessment"))
    admin = t["administrator"].select(F.col("actor").alias("a")).distinct()
    name = lambda own: F.concat_ws(":", "component", own)
    p = proposal.withColumns({"bound": proposal_digest(edition_fields, F.lit(revision)), "license_bound": license_digest(F.lit(revision)), "name": name("proposal")})
    reviewed, exact = p.where("decision is not null"), p.where("kind = 'exact-edition'")
    verified, candidate = exact.where("license.status <> 'candidate'"), exact.where("license.status = 'candidate'")
    approved = p.where("decision = 'approved'").groupBy("component").agg(F.count("*").alias("n"), F.min("proposal").alias("one"))
    chosen = record.join(approved, "component", "left")
    known = proposal.select(F.col("component").alias("c"), F.col("proposal").alias("p"), F.col("kind").alias("k"), pin_digest().alias("pin"))
    judged = assessment.join(known, (F.col("component") == F.col("c")) & (F.col("proposal") == F.col("p")), "left").withColumn("name", name("assessment"))
    hashes = [F.col(c) for c in ("pin_sha256", "extraction_sha256", "graph_sha256")]
    produced = (F.col("pin_sha256") == F.col("pin")) & hashes[1].isNotNull() & hashes[2].isNotNull()
    promoted, rest = lead.where("disposition = 'promoted'"), lead.where("disposition <> 'promoted'")
    me = F.col("name")

    def unauthorised(rows: DataFrame, rule: str, actor: Column) -> DataFrame:
        return refers(rows.withColumn("who", actor), rule, "name", ["who"], admin, ["a"])

    return reduce(DataFrame.unionByName, [
        refers(record, "record-expected", "component", ["component"], t["expected"], ["component"]),
        holds(record, "record-current", F.col("revision") == revision, F.col("component")),
        unique(record, "record-once", ["component"]),
        *[unique(df, f"{own}-once", ["component", own]) for df, own in ((lead, "lead"), (proposal, "proposal"), (blocker, "blocker"), (assessment, "assessment"))],
        holds(p, "audit-current", F.col("audit_sha256") == F.col("bound"), me),
        unauthorised(reviewed, "reviewer-authorised", F.col("reviewer")),
        holds(reviewed, "review-independent", F.col("reviewer") != F.col("actor"), me),
        holds(reviewed, "review-current", F.col("review_sha256") == F.col("bound"), me),
        holds(exact, "proposal-is-edition", F.col("proposal") == F.col("edition.editionId"), me),
        holds(candidate, "candidate-license", F.col("license.decision").isNull() & (F.col("license.distribution") == "review-required"), me),
        holds(verified, "license-approved", F.col("license.decision") == "approved", me),
        unauthorised(verified, "license-reviewer-authorised", F.col("license.reviewer")),
        holds(verified, "license-review-independent", F.col("license.reviewer") != F.col("actor"), me),
        holds(verified, "license-review-current", F.col("license.sha256") == F.col("license_bound"), me),
        holds(p.where("kind <> 'exact-edition'"), "no-self-duplicate", F.col("target") != F.col("component"), me),
        holds(approved, "approved-once", F.col("n") == 1, F.col("component"), F.col("n")),
        holds(chosen.where("n is null"), "selected-is-approved", F.col("selected").isNull(), F.col("component"), F.col("selected")),
        holds(chosen.where("n = 1"), "approved-is-selected", F.col("selected") == F.col("one"), F.col("component"), F.col("one")),
        refers(promoted, "lead-proposal", "lead", ["component", "proposal"], proposal, ["component", "proposal"]),
        holds(rest, "lead-not-promoted", F.col("proposal").isNull(), name("lead")),
        holds(blocker, "blocker-resolution", (F.col("state") == "resolved") == F.col("resolution").isNotNull(), name("blocker")),
        refers(blocker.where("proposal is not null"), "blocker-proposal", "blocker", ["component", "proposal"], proposal, ["component", "proposal"]),
        holds(judged, "assessment-of-edition", F.col("k") == "exact-edition", me),
        holds(judged.where("outcome = 'candidate-produced' and k = 'exact-edition'"), "assessment-current", produced, me),
        holds(judged.where("outcome = 'not-tested'"), "untested-without-hashes", F.coalesce(*hashes).isNull(), me),
    ])


def graph_rules(graphs: DataFrame, t: Tables) -> DataFrame:
    """Rules between stored graphs and the ledger. graphs: (component, edition struct,
    extraction_sha256, graph_sha256, actor, completed_at, reviewed); their editions are
    matched with those of proposals as whole structs."""
    same = graphs.join(t["proposal"].where("kind = 'exact-edition'").select("component", "edition", "proposal"), ["component", "edition"])
    matches = graphs.select("component").join(same.groupBy("component").agg(F.count("*").alias("n"), F.min("proposal").alias("proposal")), "component", "left")
    one = matches.where("n = 1").join(t["record"].select("component", "selected"), "component", "left").join(graphs, "component")
    done = t["assessment"].where("outcome = 'candidate-produced'").join(t["proposal"].select("component", "proposal", pin_digest().alias("pin")), ["component", "proposal"]).where("pin_sha256 = pin")
    keys = {"extraction_sha256": "extraction_sha256", "graph_sha256": "graph_sha256", "actor": "by", "completed_at": "at"}
    done = done.select("component", "proposal", *[F.col(c).alias(k) for k, c in keys.items()]).distinct()
    me = F.col("component")
    return reduce(DataFrame.unionByName, [
        refers(graphs, "graph-has-record", "component", ["component"], t["record"], ["component"]),
        holds(matches, "edition-matches-once", F.col("n") == 1, me, F.coalesce("n", F.lit(0))),
        holds(one.where("selected is not null"), "graph-of-selected", F.col("selected") == F.col("proposal"), me),
        holds(one.where("reviewed"), "reviewed-graph-verified", F.col("selected") == F.col("proposal"), me),
        refers(one, "assessment-of-graph", "component", ["component", "proposal", *keys], done, ["component", "proposal", *keys]),
    ])


def resolution_manifest(t: Tables) -> DataFrame:
    """A row for each expected component: states, counts and open domains in their order."""
    lists = {
        "proposals": t["proposal"].groupBy("component").agg(F.collect_list(F.struct(F.col("proposal").alias("id"), "kind", "decision")).alias("proposals")),
        "assessments": t["assessment"].groupBy("component").agg(F.collect_list(F.struct(F.col("proposal").alias("proposal_id"), "outcome")).alias("assessments")),
        "domains": t["blocker"].where("state = 'open'").groupBy("component").agg(F.collect_set("domain").alias("domains")),
        "lead_count": t["lead"].groupBy("component").agg(F.count("*").alias("lead_count")),
    }
    rows = t["expected"].join(t["record"].select("component", "selected", F.lit(True).alias("has_record")), "component", "left")
    for df in lists.values():
        rows = rows.join(df, "component", "left")
    has = F.coalesce("has_record", F.lit(False))
    filled = rows.withColumns({
        "proposals": F.coalesce("proposals", F.array().cast("array<struct<id:string,kind:string,decision:string>>")),
        "assessments": F.coalesce("assessments", F.array().cast("array<struct<proposal_id:string,outcome:string>>")),
        "domains": F.coalesce("domains", F.array().cast("array<string>")),
    })
    listed = F.filter(F.array(*[F.lit(d) for d in DOMAINS]), lambda d: F.array_contains("domains", d))
    return filled.select(
        *t["expected"].columns,
        "selected",
        F.when(has, resolution_state(F.col("selected"), F.col("proposals"))).otherwise("unresolved").alias("resolution_state"),
        F.when(has, importer_state(F.col("selected"), F.col("proposals"), F.col("assessments"))).otherwise("not-assessed").alias("importer_state"),
        F.when(has, F.coalesce("lead_count", F.lit(0))).otherwise(0).cast("long").alias("lead_count"),
        F.when(has, F.size("proposals")).otherwise(0).cast("long").alias("proposal_count"),
        F.when(has, listed).otherwise(F.array().cast("array<string>")).alias("open_domains"),
    )


def resolution_summary(manifest: DataFrame) -> DataFrame:
    """One row of counts over the manifest's rows."""
    state = lambda s: F.count_if(F.col("resolution_state") == s)
    return manifest.agg(
        F.count("*").alias("components"), state("unresolved").alias("unresolved"), state("candidate-exact-edition").alias("candidate_editions"),
        state("verified-exact-edition").alias("verified_editions"), state("candidate-duplicate").alias("candidate_duplicates"), state("verified-duplicate").alias("verified_duplicates"),
        F.count_if(F.size("open_domains") > 0).alias("blocked"), F.count_if(F.col("importer_state") == "candidate-produced").alias("produced"),
    )
