"""Component files as a data source: one JSON document, or an index and shards (SRC05, SRC07-SRC09, SRC20, SRC40,
SNK05-SNK08, SNK14). ``<folder>/<source record>/<component>.json`` is either the document itself or an
index that names shards below ``<folder>/<source record>/<component>/``.

Reading plans one partition a shard. A filter on component or collection opens no other shard, and
``columns=index`` opens the indexes only. Paths, shapes and digests of an index are checked before
any shard is opened, and every shard before it gives a row.

Writing puts shards first, under the names of their content, in tasks; a shard that is there already is left.
Commit then swaps each index in by renaming and removes what only the old one named. A task or commit that
fails removes the files it made and leaves indexes and shards as they were. Digests over the
logical document follow its order, so they are made as a stream, one component at a time. The driver holds
the indexes that it writes, some 200 bytes for each shard of up to 5 MiB. Files are reached by
``pyarrow.fs``, so folders may be local paths or addresses of a store it knows.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from .shards import MAX_BYTES, encode

#: fixed values: versions, collections in their order with the folders of their shards, keys of indexes and descriptors, classes of distribution
STORED, LOGICAL = "1.1.0", "1.0.0"
COLLECTIONS = {
    "sourceUnits": "source-units",
    "unitInventories": "unit-inventories",
    "nodes": "nodes",
    "externalInputs": "external-inputs",
    "directDependencies": "direct-dependencies",
    "proofRoutes": "proof-routes",
    "references": "references",
}
METADATA = ("phase", "identity", "exactEdition", "extractionState", "graphState")
INDEX_KEYS = ("storageSchemaVersion", "logicalSchemaVersion", "logicalContentSha256", "componentSha256", "distribution", "metadata", "collections")
SHARD_KEYS = ("schemaVersion", "path", "recordCount", "byteLength", "sha256")
DISTRIBUTIONS = ("open-derived-data", "metadata-only", "restricted-derived-data", "review-required")
PHASE = "source-dependency-graph"
#: bytes that a task's Python takes at once
BATCH_BYTES = 8 << 20
_TOP = ("sourceUnits", "unitInventories")
_DIGEST = re.compile("[a-f0-9]{64}")


class InvalidComponent(ValueError):
    """A file that is not what its index says, or an index that must not be followed."""


def compact(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def sha256(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def component_digest(index: dict) -> str:
    """The digest of an index without that digest."""
    return sha256(compact({k: index[k] for k in INDEX_KEYS if k != "componentSha256"}))


def _need(holds: bool, what: str) -> None:
    if not holds:
        raise InvalidComponent(what)


def _keys(value, wanted, what: str) -> None:
    _need(isinstance(value, dict) and set(value) == set(wanted), f"{what}: unexpected or missing fields")


def safe_path(path, component: str, folder: str, ordinal: int, digest: str) -> bool:
    """Only the one path that a shard of this place and content has is safe."""
    plain = isinstance(path, str) and not set("\\\0") & set(path) and not path.startswith("/") and ".." not in path.split("/") and posixpath.normpath(path) == path
    return plain and path == f"{component}/{folder}/{ordinal:06d}-{digest}.jsonl"


def check_index(index: dict, path: str) -> None:
    """Raises InvalidComponent for an index whose shards must not be read."""
    _keys(index, INDEX_KEYS, "index")
    _need((index["storageSchemaVersion"], index["logicalSchemaVersion"]) == (STORED, LOGICAL), "index: unknown version")
    for key in ("logicalContentSha256", "componentSha256"):
        _need(isinstance(index[key], str) and bool(_DIGEST.fullmatch(index[key])), f"index: {key} is no digest")
    _keys(index["distribution"], ("class", "note"), "distribution")
    note = index["distribution"]["note"]
    _need(index["distribution"]["class"] in DISTRIBUTIONS and isinstance(note, str) and bool(note.strip()), "distribution: unknown class or no note")
    _keys(index["metadata"], METADATA, "metadata")
    _need(index["metadata"]["phase"] == PHASE, "metadata: unknown phase")
    identity = index["metadata"]["identity"]
    component, record = (str(identity.get(k)) for k in ("componentId", "sourceRecordId")) if isinstance(identity, dict) else ("", "")
    _need(bool(re.fullmatch("[a-z0-9][a-z0-9-]*", component)) and bool(re.fullmatch(r"S\d{4}", record)), "identity: unsafe id")
    _need(path.split("/")[-2:] == [record, f"{component}.json"], "index: not at the place of its identity")
    _keys(index["collections"], COLLECTIONS, "collections")
    seen: set[str] = set()
    for key, folder in COLLECTIONS.items():
        _need(isinstance(index["collections"][key], list), f"{key}: no list of shards")
        for n, shard in enumerate(index["collections"][key]):
            _keys(shard, SHARD_KEYS, f"{key} shard {n}")
            counts = all(type(shard[k]) is int and shard[k] > 0 for k in ("recordCount", "byteLength"))
            _need(shard["schemaVersion"] == STORED and counts and shard["byteLength"] <= MAX_BYTES, f"{key} shard {n}: version or size")
            _need(isinstance(shard["sha256"], str) and bool(_DIGEST.fullmatch(shard["sha256"])), f"{key} shard {n}: no digest")
            _need(safe_path(shard["path"], component, folder, n, shard["sha256"]), f"{key} shard {n}: unsafe path {shard['path']!r}")
            _need(shard["path"] not in seen, f"{key} shard {n}: repeated path")
            seen.add(shard["path"])
    _need(index["componentSha256"] == component_digest(index), "index: component digest is stale")


def shard_records(data: bytes, shard: dict, what: str) -> list[str]:
    """The lines of a shard, if it is exactly what its descriptor says."""
    _need(len(data) == shard["byteLength"] and sha256(data) == shard["sha256"], f"{what}: bytes differ from the index")
    try:
        text = data.decode()
    except UnicodeDecodeError as error:
        raise InvalidComponent(f"{what}: not UTF-8") from error
    _need(text.endswith("\n") and "\r" not in text, f"{what}: line ends")
    lines = text[:-1].split("\n")
    _need(len(lines) == shard["recordCount"] and all(lines), f"{what}: number of records")
    for n, line in enumerate(lines):
        try:
            again = compact(json.loads(line))
        except json.JSONDecodeError as error:
            raise InvalidComponent(f"{what}: record {n} is no JSON") from error
        _need(again == line, f"{what}: record {n} is not in canonical form")
    return lines


def collections_of(document: dict) -> dict[str, list]:
    return {key: document[key] if key in _TOP else document["graph"][key] for key in COLLECTIONS}


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder.rstrip("/")
    return pafs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder).rstrip("/"))


def _read(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path) as stream:
        return stream.read()


def _replace(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Write beside ``path`` and rename, so that readers see the old bytes or the new ones."""
    fs.create_dir(posixpath.dirname(path), recursive=True)
    beside = f"{posixpath.dirname(path)}/.{posixpath.basename(path)}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(beside) as stream:
            stream.write(data)
        fs.move(beside, path)
    finally:
        if fs.get_file_info(beside).type != pafs.FileType.NotFound:
            fs.delete_file(beside)


@dataclass
class Part(InputPartition):
    """A shard, or a document or index as a whole."""

    path: str
    component: str
    collection: str | None = None
    before: int = 0
    shard: dict | None = None


class ComponentReader(DataSourceReader):
    def __init__(self, folder: str, index_only: bool):
        self.folder, self.index_only = folder, index_only
        self.components: set[str] | None = None
        self.collections: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            name, values = {EqualTo: lambda: (f.attribute, {f.value}), In: lambda: (f.attribute, set(f.value))}.get(type(f), lambda: (None, None))()
            if name in (("component",), ("collection",)) and not (name == ("collection",) and self.index_only):
                known = getattr(self, f"{name[0]}s")
                setattr(self, f"{name[0]}s", values if known is None else known & values)
            else:
                yield f

    def partitions(self):
        fs, root = _filesystem(self.folder)
        parts: list[Part] = []
        infos = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        folders = [i.path for i in infos if i.type == pafs.FileType.Directory]
        for folder in sorted(folders):
            for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.path):
                name = posixpath.basename(info.path)
                if info.type != pafs.FileType.File or not name.endswith(".json") or name.startswith("."):
                    continue
                component = name[: -len(".json")]
                if self.components is None or component in self.components:
                    parts += self._planned(fs, info.path, component)
        return parts

    def _planned(self, fs: pafs.FileSystem, path: str, component: str) -> list[Part]:
        if self.index_only:
            return [Part(path, component)]
        document = json.loads(_read(fs, path))
        if document.get("schemaVersion") == LOGICAL:
            return [Part(path, component)]
        check_index(document, path)
        parts = []
        for key, shards in document["collections"].items():
            before = 0
            for shard in shards:
                if self.collections is None or key in self.collections:
                    parts.append(Part(f"{posixpath.dirname(path)}/{shard['path']}", component, key, before, shard))
                before += shard["recordCount"]
        return parts

    def read(self, part: Part | None):
        if part is None:  # nothing was planned
            return
        fs, _ = _filesystem(self.folder)
        if part.shard:
            for n, line in enumerate(shard_records(_read(fs, part.path), part.shard, f"{part.component} {part.collection}")):
                yield part.component, part.collection, part.before + n, line
            return
        document = json.loads(_read(fs, part.path))
        if self.index_only:
            whole = document.get("schemaVersion") == LOGICAL
            if not whole:
                check_index(document, part.path)
            kept = document if whole else document["metadata"]
            yield part.component, whole, compact({k: kept.get(k) for k in METADATA}), None if whole else compact(document["distribution"]), None if whole else document["logicalContentSha256"], None if whole else document["componentSha256"]
            return
        for key, records in collections_of(document).items():
            if self.collections is None or key in self.collections:
                for n, record in enumerate(records):
                    yield part.component, key, n, compact(record)


@dataclass
class Written(WriterCommitMessage):
    """Descriptors and headers of a task, and the files it made."""

    shards: list[tuple[str, str, str, int, dict]]
    headers: dict[tuple[str, str], dict]
    created: list[str]


class ComponentWriter(DataSourceWriter):
    """Takes rows (source_record, component, collection, shard, record_count, content); a row without a collection
    holds the component's header as content: metadata, distribution and the digest of its logical document."""

    def __init__(self, folder: str, fail_on_commit: bool = False):
        self.folder, self.fail_on_commit = folder, fail_on_commit

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = _filesystem(self.folder)
        done = Written([], {}, [])
        try:
            for row in rows:
                if row["collection"] is None:
                    done.headers[row["source_record"], row["component"]] = json.loads(row["content"])
                    continue
                data = row["content"].encode()
                digest = sha256(data)
                path = f"{row['component']}/{COLLECTIONS[row['collection']]}/{row['shard']:06d}-{digest}.jsonl"
                full = f"{root}/{row['source_record']}/{path}"
                if fs.get_file_info(full).type == pafs.FileType.NotFound:
                    _replace(fs, full, data)
                    done.created.append(full)
                elif _read(fs, full) != data:
                    raise InvalidComponent(f"{path}: another content under this name")
                shard = dict(zip(SHARD_KEYS, (STORED, path, row["record_count"], len(data), digest)))
                done.shards.append((row["source_record"], row["component"], row["collection"], row["shard"], shard))
        except BaseException:
            self._remove(fs, done.created)
            raise
        return done

    def _remove(self, fs: pafs.FileSystem, paths: list[str]) -> None:
        for path in paths:
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_file(path)

    def _named(self, fs: pafs.FileSystem, path: str) -> tuple[bytes | None, set[str]]:
        """The bytes of an index, and the files it names."""
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None, set()
        data = _read(fs, path)
        index = json.loads(data)
        named = (s["path"] for shards in index.get("collections", {}).values() for s in shards)
        return data, {f"{posixpath.dirname(path)}/{p}" for p in named}

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _filesystem(self.folder)
        done = [m for m in messages if m is not None]
        old: dict[str, bytes | None] = {}
        try:
            obsolete: set[str] = set()
            for (record, component), header in sorted({k: v for m in done for k, v in m.headers.items()}.items()):
                path = f"{root}/{record}/{component}.json"
                old[path], before = self._named(fs, path)
                shards = {key: [] for key in COLLECTIONS}
                for *_, key, n, shard in sorted((s for m in done for s in m.shards if s[:2] == (record, component)), key=lambda s: (s[2], s[3])):
                    shards[key].append(shard)
                distribution = header.get("distribution") or (json.loads(old[path]).get("distribution") if old[path] else None)
                distribution = distribution or {"class": "review-required", "note": "The licence of the source has not been reviewed."}
                index = {"storageSchemaVersion": STORED, "logicalSchemaVersion": LOGICAL, "logicalContentSha256": header["logicalContentSha256"], "componentSha256": ""}
                index |= {"distribution": distribution, "metadata": header["metadata"], "collections": shards}
                index["componentSha256"] = component_digest(index)
                check_index(index, path)
                _replace(fs, path, (json.dumps(index, indent=2, ensure_ascii=False) + "\n").encode())
                obsolete |= before - self._named(fs, path)[1]
            if self.fail_on_commit:
                raise InvalidComponent("stopped before the old shards go")
        except BaseException:
            for path, data in old.items():
                if data is not None:
                    _replace(fs, path, data)
                elif fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)
            self.abort(messages)
            raise
        self._remove(fs, sorted(obsolete))

    def abort(self, messages: list[Written | None]) -> None:
        """Files that this run made go; those that an index names had been there and are in no list."""
        fs, _ = _filesystem(self.folder)
        for message in messages:
            if message is not None:
                self._remove(fs, message.created)


class ComponentFiles(DataSource):
    """format("component_files") with the option path; columns=index gives a row a component from its index alone."""

    @classmethod
    def name(cls) -> str:
        return "component_files"

    def _index_only(self) -> bool:
        return self.options.get("columns") == "index"

    def schema(self) -> str:
        if self._index_only():
            return "component string, whole boolean, metadata string, distribution string, logical_sha256 string, component_sha256 string"
        return "component string, collection string, ordinal long, record string"

    def reader(self, schema) -> ComponentReader:
        return ComponentReader(self.options["path"], self._index_only())

    def writer(self, schema, overwrite: bool) -> ComponentWriter:
        return ComponentWriter(self.options["path"], self.options.get("failOnCommit") == "true")


def read_components(spark: SparkSession, folder: str, index_only: bool = False) -> DataFrame:
    """(component, collection, ordinal, record) of all component files, or a row for each index."""
    spark.dataSource.register(ComponentFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("component_files").option("columns", "index" if index_only else "records").load(folder)


def logical_digests(records: DataFrame, headers: DataFrame) -> DataFrame:
    """headers: (component, metadata), the JSON of the METADATA keys. (component, sha256) of each logical document.
    The digest follows one order, so a component is read as a sorted stream, never held whole."""
    place = F.array_position(F.array(*[F.lit(k) for k in COLLECTIONS]), F.col("collection")).cast("int")
    rows = records.select("component", place.alias("place"), "ordinal", "record").unionByName(headers.select("component", F.lit(0).alias("place"), F.lit(0).cast("long").alias("ordinal"), F.col("metadata").alias("record")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, digest, at, first, metadata = None, None, 0, True, {}
        keys = list(COLLECTIONS)

        def upto(place: int) -> None:
            """Write the ends and beginnings of collections up to that one; len(keys) + 1 closes the document."""
            nonlocal at, first
            while at < place:
                at, first = at + 1, True
                text = "]," if at > 1 else ""
                if at <= len(keys):
                    text += ('"graph":{' if at == len(_TOP) + 1 else "") + f'"{keys[at - 1]}":['
                digest.update(text.encode() if at <= len(keys) else ("]}" + "".join(f',"{k}":{compact(metadata[k])}' for k in METADATA[3:]) + "}").encode())

        def close() -> pd.DataFrame:
            upto(len(keys) + 1)
            return pd.DataFrame({"component": [component], "sha256": [digest.hexdigest()]})

        for batch in batches:
            for name, place, record in zip(batch["component"], batch["place"], batch["record"]):
                if name != component:
                    if component is not None:
                        yield close()
                    component, digest, at, first, metadata = name, hashlib.sha256(), 0, True, json.loads(record)
                    digest.update(("{" + f'"schemaVersion":"{LOGICAL}",' + "".join(f'"{k}":{compact(metadata[k])},' for k in METADATA[:3])).encode())
                    continue
                upto(place)
                digest.update(("" if first else ",").encode() + record.encode())
                first = False
        if component is not None:
            yield close()

    # by a hash of the key: a repartition by the key itself is left out above a join on it, which may then change its own
    return rows.repartition(F.xxhash64("component")).sortWithinPartitions("component", "place", "ordinal").mapInPandas(run, "component string, sha256 string")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands Python no more than BATCH_BYTES at once, or one row: 10,000 shards, as a batch has else, are all of a task's."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write_components(records: DataFrame, headers: DataFrame, folder: str, limit: int = MAX_BYTES, **options: str) -> None:
    """records: (component, collection, ordinal, record); headers: (component, source_record, metadata, distribution),
    the last two as JSON, distribution may be null: then the old index's stays. Replaces the components in headers."""
    spark = records.sparkSession
    spark.dataSource.register(ComponentFiles)
    shards = encode(records, limit).join(headers.select("component", "source_record"), "component")
    shards = shards.select("source_record", "component", "collection", "shard", F.col("record_count").cast("int").alias("record_count"), "content")
    digests = logical_digests(records.join(headers.select("component"), "component", "left_semi"), headers)
    parts = F.concat(F.lit('{"metadata":'), "metadata", F.lit(',"distribution":'), F.coalesce("distribution", F.lit("null")), F.lit(',"logicalContentSha256":"'), "sha256", F.lit('"}'))
    heads = headers.join(digests, "component").select("source_record", "component", F.lit(None).cast("string").alias("collection"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("int").alias("record_count"), parts.alias("content"))
    with small_batches(spark):
        shards.unionByName(heads).write.format("component_files").mode("append").options(**options).save(folder)
