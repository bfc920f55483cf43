"""Strict structure and provider envelopes."""

from __future__ import annotations

import copy
import gzip
import hashlib
import json
import random

from lemmaflow.operators import provider
from lemmaflow.plans import structure
from lemmaflow.sources import envelopes
from pyspark.sql import functions as F

A = structure.Allowed
RULES = [
    A("$", ("object",)), A("$.id", ("string",), pattern="^S[0-9]{4}$"), A("$.year", ("whole",), nullable=True), A("$.share", ("number",), required=False),
    A("$.nodes", ("list",)), A("$.nodes[]", ("object",)), A("$.nodes[].kind", ("string",), values=("lemma", "theorem")), A("$.nodes[].open", ("boolean",)),
    A("$.nodes[].tags", ("list",)), A("$.nodes[].tags[]", ("string",)), A("$.meta", ("object",), nullable=True), A("$.meta.note", ("string",)),
]
GOOD = {"id": "S0001", "year": None, "share": 1, "nodes": [{"kind": "lemma", "open": True, "tags": ["a", ""]}, {"kind": "theorem", "open": False, "tags": []}], "meta": {"note": "é"}}


def test_one_planted_violation_of_each_kind(spark):
    def changed(edit):
        made = copy.deepcopy(GOOD)
        edit(made)
        return json.dumps(made)

    cases = {
        "good": (json.dumps(GOOD), set()), "broken": ("{", {("$", "json")}), "list": ("[]", {("$", "type")}), "null": ("null", {("$", "null")}),
        "unknown": (changed(lambda d: d["nodes"][1].update(x={"y": 1})), {("$.nodes[1].x", "unknown-key")}),
        "missing": (changed(lambda d: d["nodes"][0].pop("open")), {("$.nodes[0].open", "missing-key")}),
        "two": (changed(lambda d: [d.pop("id"), d.pop("share"), d.update(year="x")]), {("$.id", "missing-key"), ("$.year", "type")}),
        "fraction": (changed(lambda d: d.update(year=1.5, share=0.25)), {("$.year", "type")}),
        "nulls": (changed(lambda d: [d["nodes"][0]["tags"].append(None), d.update(meta=None)]), {("$.nodes[0].tags[2]", "null")}),
        "value": (changed(lambda d: d["nodes"][0].update(kind="Lemma")), {("$.nodes[0].kind", "value")}),
        "pattern": (changed(lambda d: d.update(id="S1")), {("$.id", "pattern")}),
        "none": (None, {("$", "json")}),
    }
    docs = spark.createDataFrame([(k, d) for k, (d, _) in cases.items()], "k string, document string")
    got: dict[str, set] = {}
    for r in structure.violations(docs, "k", RULES).collect():
        got.setdefault(r["k"], set()).add((r["at"], r["rule"]))
    assert {k: got.get(k, set()) for k in cases} == {k: v for k, (_, v) in cases.items()}


def test_random_documents_against_a_plain_walk(spark):
    rng = random.Random(3)
    known = {r.path: r for r in RULES}

    def value(depth=0):
        return rng.choice([1, 2.5, True, None, "lemma", "S0001", {}, [], *([{k: value(depth + 1) for k in rng.sample(["id", "year", "nodes", "kind", "open", "tags", "meta", "note"], 3)}, [value(depth + 1) for _ in range(2)]] if depth < 4 else [])])

    def kind(v):
        return "null" if v is None else "boolean" if isinstance(v, bool) else "whole" if isinstance(v, int) else "number" if isinstance(v, float) else "string" if isinstance(v, str) else "list" if isinstance(v, list) else "object"

    def walk(path, at, v, out):
        rule, k = known.get(path), kind(v)
        if rule is None:
            out.add((at, "unknown-key"))
            return
        if k == "null":
            out |= set() if rule.nullable else {(at, "null")}
        elif k not in rule.kinds and not (k == "whole" and "number" in rule.kinds):
            out.add((at, "type"))
        elif k == "string" and rule.values and v not in rule.values:
            out.add((at, "value"))
        elif k == "string" and rule.pattern and v != "S0001":
            out.add((at, "pattern"))
        if k == "object":
            needed = {p.rpartition(".")[2] for p, r in known.items() if r.required and p.rpartition(".")[0] == path and not p.endswith("[]")}
            out |= {(f"{at}.{n}", "missing-key") for n in needed - set(v)}
            for n, x in v.items():
                walk(f"{path}.{n}", f"{at}.{n}", x, out)
        if k == "list":
            for n, x in enumerate(v):
                walk(f"{path}[]", f"{at}[{n}]", x, out)

    docs = {k: {**GOOD, **{n: value() for n in rng.sample(list(GOOD), 2)}} for k in range(150)}
    expected = {}
    for k, d in docs.items():
        walk("$", "$", d, expected.setdefault(k, set()))
    got = {k: set() for k in docs}
    for r in structure.violations(spark.createDataFrame([(k, json.dumps(d)) for k, d in docs.items()], "k int, document string"), "k", RULES).collect():
        got[r["k"]].add((r["at"], r["rule"]))
    assert got == expected


def test_envelopes(spark, tmp_path):
    def put(url, body, name=None, retrieved="t1", raw=None):
        content = json.dumps({"url": url, "retrievedAt": retrieved, **({} if body is None else {"body": body})}) if raw is None else raw
        name = name or hashlib.sha256(url.encode()).hexdigest()
        (tmp_path / f"{name}.json.gz").write_bytes(gzip.compress(content.encode()))

    address = lambda f, c: spark.range(1).select(envelopes.collection_url(F.lit(f), F.lit(c).cast("string"), 2)).first()[0]
    assert address("cites:W1|W2", None) == "https://api.openalex.org/works?filter=cites%3AW1%7CW2&per-page=2"
    work = lambda k: {"id": f"https://openalex.org/W{k}", "doi": f"https://doi.org/10.1/{k}", "title": f"T {k}", "authorships": [{"author": {"display_name": "Ann"}}, {"raw_author_name": "Bo"}], "publication_year": 2000 + k, "primary_location": {"landing_page_url": None, "source": {"display_name": "J"}}, "referenced_works": [f"W{k + 1}"], "odd": {"new": 1}}
    put(address("cites:W1", "*"), {"results": [work(1), work(2)], "meta": {"next_cursor": "b="}})
    put(address("cites:W1", "b="), {"results": [work(3)], "meta": {"next_cursor": None}})
    put(address("cites:W2", "*"), {"results": [], "meta": {"next_cursor": "gone"}})
    put(address("cites:W3", "*"), {"results": {"no": "list"}})
    put(address("cites:W4", "*"), {"results": [], "meta": {"next_cursor": "*"}})
    put(address("cites:W4", "x"), {"results": [], "meta": {"next_cursor": "*"}})
    put("https://a.org/1", {"x": 1})
    put("https://a.org/2", None)
    put("https://a.org/3", {}, retrieved=5)
    put("https://a.org/4", {}, name="0" * 64)
    put("https://a.org/5", {}, raw="{no json")
    found = envelopes.read_envelopes(spark, str(tmp_path))
    assert sorted(r["rule"] for r in found.where("rule is not null").collect()) == ["body", "json", "retrieved-at", "url"]
    paged = envelopes.pages(found)
    assert sorted((r["filter"], r["cursor"], r["rule"]) for r in paged.where("rule is not null").collect()) == [("cites:W2", "*", "missing-page"), ("cites:W3", "*", "results"), ("cites:W4", "*", "repeated-cursor"), ("cites:W4", "x", "repeated-cursor")]
    papers = provider.papers_of(envelopes.works(paged)).collect()
    assert sorted((r["paper_id"], r["title"], tuple(r["authors"]), r["date"], r["identifiers"]["doi"]) for r in papers) == [(r["paper_id"], f"T {k}", ("Ann", "Bo"), str(2000 + k), f"10.1/{k}") for k, r in enumerate(sorted(papers, key=lambda r: r["title"]), 1)]
