"""Component files: both forms, pruning, unsafe paths, and writers that fail."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from lemmaflow.functions import json_text, text
from lemmaflow.sources import component_files as files
from pyspark.sql import functions as F

META = {"phase": files.PHASE, "identity": {"componentId": "one", "sourceRecordId": "S0001"}, "exactEdition": {"name": "É \"2\"", "year": None}, "extractionState": "done", "graphState": ["a", 1.5]}
OPEN = json.dumps({"class": "open-derived-data", "note": "free"})


def tables(spark, content, component="one", distribution=OPEN):
    rows = [(component, key, n, json.dumps(r, separators=(",", ":"), ensure_ascii=False)) for key, records in content.items() for n, r in enumerate(records)]
    meta = META | {"identity": {"componentId": component, "sourceRecordId": "S0001"}}
    heads = [(component, "S0001", files.compact(meta), distribution)]
    return spark.createDataFrame(rows, "component string, collection string, ordinal long, record string"), spark.createDataFrame(heads, "component string, source_record string, metadata string, distribution string")


def content(n, seed=1):
    rng = random.Random(seed)
    return {"nodes": [{"id": f"n{k}", "t": "ü" * rng.randint(0, 30), "x": None} for k in range(n)], "references": [{"to": [k, {"a": 1}]} for k in range(5)], "sourceUnits": [{"id": "u"}]}


def logical(parts, component="one"):
    of = lambda k: parts.get(k, [])
    meta = META | {"identity": {"componentId": component, "sourceRecordId": "S0001"}}
    document = {"schemaVersion": "1.0.0", **{k: meta[k] for k in files.METADATA[:3]}, "sourceUnits": of("sourceUnits"), "unitInventories": of("unitInventories")}
    return document | {"graph": {k: of(k) for k in files.COLLECTIONS if k not in ("sourceUnits", "unitInventories")}, "extractionState": meta["extractionState"], "graphState": meta["graphState"]}


def state(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}


def found(df):
    return sorted((r["component"], r["collection"], r["ordinal"], r["record"]) for r in df.collect())


def test_both_forms_and_digests(spark, tmp_path):
    parts = content(200)
    records, heads = tables(spark, parts)
    files.write_components(records, heads, str(tmp_path), limit=900)
    index = json.loads((tmp_path / "S0001/one.json").read_text())
    assert list(index) == list(files.INDEX_KEYS) and len(index["collections"]["nodes"]) > 5
    assert index["logicalContentSha256"] == files.sha256(files.compact(logical(parts)))
    assert index["componentSha256"] == files.sha256(files.compact({k: v for k, v in index.items() if k != "componentSha256"}))
    (tmp_path / "S0001/two.json").write_text(json.dumps(logical(parts, "two")))
    expected = sorted([("one", *r[1:]) for r in found(records)] + [("two", *r[1:]) for r in found(records)])
    assert found(files.read_components(spark, str(tmp_path))) == expected
    assert found(files.read_components(spark, f"file:{tmp_path}")) == expected


def test_pruning_opens_no_shard(spark, tmp_path):
    records, heads = tables(spark, content(50))
    files.write_components(records, heads, str(tmp_path))
    for path in tmp_path.rglob("*.jsonl"):
        if "references" not in str(path):
            path.write_bytes(b"broken")
    only = files.read_components(spark, str(tmp_path)).where("collection = 'references'")
    assert only.count() == 5 and only.rdd.getNumPartitions() == 1
    (row,) = files.read_components(spark, str(tmp_path), index_only=True).collect()
    assert json.loads(row["metadata"]) == META and not row["whole"]
    assert files.read_components(spark, str(tmp_path)).where("component = 'other'").count() == 0
    with pytest.raises(Exception, match="bytes differ from the index"):
        files.read_components(spark, str(tmp_path)).count()


@pytest.mark.parametrize("path", ["../x.jsonl", "/etc/x.jsonl", "one\\nodes\\x", "one/nodes/../nodes/000000-{d}.jsonl", "one/nodes//000000-{d}.jsonl", "two/nodes/000000-{d}.jsonl", "one/nodes/000001-{d}.jsonl", "one/nodes/000000-{d}.jsonl\0", 7, None])
def test_unsafe_paths(tmp_path, path):
    digest = "a" * 64
    assert files.safe_path(f"one/nodes/000000-{digest}.jsonl", "one", "nodes", 0, digest)
    assert not files.safe_path(path.replace("{d}", digest) if isinstance(path, str) else path, "one", "nodes", 0, digest)


def test_index_that_leads_elsewhere_is_refused_before_a_read(spark, tmp_path):
    records, heads = tables(spark, content(5))
    files.write_components(records, heads, str(tmp_path))
    target = tmp_path / "S0001/one.json"
    index = json.loads(target.read_text())
    index["collections"]["nodes"][0]["path"] = "../secret.jsonl"
    index["componentSha256"] = files.component_digest(index)
    target.write_text(json.dumps(index))
    with pytest.raises(Exception, match="unsafe path"):
        files.read_components(spark, str(tmp_path)).count()
    index["collections"]["nodes"] = []
    target.write_text(json.dumps(index))
    with pytest.raises(Exception, match="digest is stale"):
        files.read_components(spark, str(tmp_path)).count()


@pytest.mark.parametrize("data, what", [(b'{"a":1}\r\n', "line ends"), (b'{"a":1}', "line ends"), (b'{"a": 1}\n', "canonical"), (b"{\n", "no JSON"), (b'{"a":1}\n{"a":1}\n', "number of records"), (b"\xff\n", "UTF-8")])
def test_bad_shards(data, what):
    shard = {"byteLength": len(data), "sha256": files.sha256(data), "recordCount": 1}
    with pytest.raises(files.InvalidComponent, match=what):
        files.shard_records(data, shard, "nodes shard 0")


def test_refresh_drops_old_shards_and_keeps_the_distribution(spark, tmp_path):
    files.write_components(*tables(spark, content(60)), str(tmp_path), limit=600)
    first = state(tmp_path)
    files.write_components(*tables(spark, content(40, 2), distribution=None), str(tmp_path), limit=600)
    index = json.loads((tmp_path / "S0001/one.json").read_text())
    named = {f"S0001/{s['path']}" for shards in index["collections"].values() for s in shards}
    assert index["distribution"] == json.loads(OPEN)
    assert set(state(tmp_path)) == named | {"S0001/one.json"} and set(first) != set(state(tmp_path))
    again = state(tmp_path)
    files.write_components(*tables(spark, content(40, 2), distribution=None), str(tmp_path), limit=600)
    assert state(tmp_path) == again


def test_failures_leave_the_old_version(spark, tmp_path):
    files.write_components(*tables(spark, content(60)), str(tmp_path), limit=600)
    before = state(tmp_path)
    records, heads = tables(spark, content(80, 3))
    late = records.withColumn("record", F.when((F.col("collection") == "references") & (F.col("ordinal") == 4), F.raise_error(F.lit("a task fails midway"))).otherwise(F.col("record")))
    with pytest.raises(Exception, match="a task fails midway"):
        files.write_components(late, heads, str(tmp_path), limit=600)
    assert state(tmp_path) == before
    with pytest.raises(Exception, match="stopped before the old shards go"):
        files.write_components(records, heads, str(tmp_path), limit=600, failOnCommit="true")
    assert state(tmp_path) == before
    fresh = tmp_path / "fresh"
    with pytest.raises(Exception, match="stopped before the old shards go"):
        files.write_components(records, heads, str(fresh), limit=600, failOnCommit="true")
    assert not [p for p in fresh.rglob("*") if p.is_file()]


def test_json_in_a_stated_order(spark):
    numbers = [0.0, -0.0, 1.0, -2.5, 0.1, 1e21, 1e20, 123456789012345680000.0, 1.5e300, 1e-6, 1e-7, -1.25e-9, 100.0, 0.000123, 1e7, 12345678.9, 2e22, 5e-324, float("nan"), float("inf")]
    shown = ["0", "0", "1", "-2.5", "0.1", "1e+21", "100000000000000000000", "123456789012345680000", "1.5e+300", "0.000001", "1e-7", "-1.25e-9", "100", "0.000123", "10000000", "12345678.9", "2e+22", "5e-324", "null", "null"]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(numbers)], "k int, x double").orderBy("k").select(json_text.number(F.col("x"))).collect()]
    assert got == [s.replace("5e-324", "4.9e-324") if g == "4.9e-324" else s for g, s in zip(got, shown)]

    schema = "v struct<z:string,a:array<struct<q:long,n:string>>,`k\"e`:boolean,e:array<int>,o:struct<p:string>,w:string>"
    rng = random.Random(2)
    text = lambda: "".join(rng.choice('aé漢\U0001f600"\\/\b\t\n\f\r\x00\x0b\x1f\x7f ') for _ in range(rng.randint(0, 12)))
    values = [{"z": text(), "a": [{"q": rng.randint(-5, 5), "n": rng.choice([None, text()])} for _ in range(rng.randint(0, 3))], 'k"e': rng.choice([True, False, None]), "e": [], "o": rng.choice([None, {"p": None}]), "w": None} for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], schema)
    kind = df.schema["v"].dataType
    rows = df.select(json_text.json_text(F.col("v"), kind).alias("c"), json_text.json_text(F.col("v"), kind, 2).alias("p"), json_text.json_text(F.col("v"), kind, absent=("w", "n")).alias("s"), json_text.digest(F.col("v"), kind, without="a").alias("d")).collect()

    def short(v):
        return {k: ([short(x) for x in y] if isinstance(y, list) else y) for k, y in v.items() if not (k in ("w", "n") and y is None)}

    for v, r in zip(values, rows):
        assert r["c"] == files.compact(v)
        assert r["p"] == json.dumps(v, indent=2, ensure_ascii=False)
        assert r["s"] == files.compact(short(v))
        assert r["d"] == files.sha256(files.compact({k: x for k, x in v.items() if k != "a"}))


def test_shards_reach_python_in_bounded_batches(spark, tmp_path, monkeypatch):
    """F16: a task's shards were one batch."""
    monkeypatch.setattr(files, "BATCH_BYTES", 1000)
    sizes = tmp_path / "sizes"
    sizes.mkdir()

    def count(batches):
        for n, batch in enumerate(batches):
            (sizes / f"{n}-{len(batch)}").touch()
            yield batch

    rows = spark.range(200, numPartitions=1).select(F.repeat(F.lit("x"), 500).alias("x"))
    with files.small_batches(spark):
        assert rows.mapInPandas(count, "x string").count() == 200
    found = [int(p.name.split("-")[1]) for p in sizes.iterdir()]
    assert sum(found) == 200 and max(found) < 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_environments_as_rows(spark, monkeypatch):
    """F16: all environments of a text were one list in Python."""
    monkeypatch.setattr(text, "_ROWS", 2)
    inner = "\\begin{proof}By it. % \\begin{x}\n\\end{proof}"
    texts = ["".join(f"\\begin{{theorem}}[T{k}] {inner} \\end{{theorem}}" for k in range(4)), "none", None, "\\begin{remark} open \\begin{lemma} too"]
    units = spark.createDataFrame(list(enumerate(texts)), "unit int, content string")
    listed = units.select("unit", F.inline(text.tex_environments("content"))).collect()
    made = text.tex_environment_rows(units, "content")
    assert made.columns == ["unit", "start", "end", "environment", "title", "body"]
    assert sorted(map(tuple, made.drop("title").collect())) == sorted((r.unit, r.start, r.end, r.environment, r.body) for r in listed) and len(listed) == 10
    assert sorted(r.title or "" for r in made.collect()) == sorted(r.title or "" for r in listed)
