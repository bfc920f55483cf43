"""Language ID, source mixing, WARC records and the pipeline."""

from __future__ import annotations

import gzip
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from time import time
from urllib.parse import urljoin

import corpus_pipeline
import pandas as pd
from lemmaflow.llm import language_id, source_mix, warc
from lemmaflow.llm.common import table
from pyspark.sql import functions as F

from test_near_dedup import plain_kept
from test_words import lower, plain_line_dedup

SF = "/root/testdata/sf0.001"


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert right >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_cases(make, nasty):
    rows = [*nasty, (300, "12 34 !!", "en", None)]
    docs = make(rows, "1 as language_found")
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for k in (200, 201, 202, 300):
        assert (by_id[k].lang_pred, by_id[k].score) == ("und", 0.0)
    assert language_id.accepted(docs).columns == docs.columns
    assert language_id.identify(make([])).count() == 0
    assert {r.lang_pred for r in language_id.identify(make([(1, "some text")])).collect()} == {"und"}


def plain_bayes(train, text):
    """(language, posterior) by counting n-grams in dictionaries."""
    def grams(x):
        padded = f" {x.lower()} "
        found = []
        for n in language_id.ORDERS:
            for i in range(len(padded) - n + 1):
                h = n
                for c in padded[i : i + n]:
                    h = (h * 0x100000001B3 + ord(c)) % 2**64
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
                found.append((h ^ h >> 31) >> 64 - language_id.BITS)
        return found

    counts, docs = defaultdict(Counter), Counter()
    for x, lang in train:
        counts[lang].update(grams(x))
        docs[lang] += 1
    logs = {}
    for lang in sorted(docs):
        total = sum(counts[lang].values()) + language_id.SMOOTHING * 2**language_id.BITS
        logs[lang] = math.log(docs[lang] / docs.total()) + sum(math.log((counts[lang][g] + language_id.SMOOTHING) / total) for g in grams(text))
    best = max(logs, key=logs.get)
    return best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())


def test_language_against_plain_counts(make, monkeypatch):
    rows = [(k, " ".join(f"{'abcdefgh'[k % 8]}{'xyz'[j % 3]}o" for j in range(5 + k % 7)), f"l{k % 8}", None) for k in range(60)]
    rows += [(100, "ax ñandú 漢字", None, None), (101, "", "l1", None), (102, None, "l1", None)]
    train = [(t, lang) for i, t, lang, _ in rows if zlib.crc32(str(i).encode()) % 5 and t is not None and lang is not None]
    for most in (language_id.BLOCK_LANGUAGES, 3):
        monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", most)
        for r in language_id.identify(make(rows, "1 as p")).collect():
            text = next(t for i, t, *_ in rows if i == r.doc_id)
            lang, score = plain_bayes(train, text) if text else ("und", 0.0)
            assert r.lang_pred == lang and abs(r.score - score) < 1e-9
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_long_texts_are_read_whole():
    text = "abc déf " * 70_000
    n = sum(len(b) for b in language_id.ngram_buckets(text))
    points = len(text) + 2
    assert n == sum(points - k + 1 for k in language_id.ORDERS)


def test_mix(spark):
    docs = table(spark, SF, "documents")
    got = source_mix.mix(docs).collect()
    again = {(r.doc_id, r.taken) for r in source_mix.mix(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in got} and len(got) == docs.count()
    size, taken, target, own = defaultdict(int), defaultdict(int), {}, {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source], own[r.source] = r.target, r.source_size
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, total = dict.fromkeys(order, 0.0), sum(size.values())
    free = set(order)
    while free:
        level = (total - sum(goal[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        for s in over or free:
            goal[s] = 3 * size[s] if over else weight[s] * level
        free = free - over if over else set()
    for s in order:
        assert own[s] == size[s] and abs(target[s] - goal[s]) < 1e-6 * total
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 60


def test_mix_cases(make, nasty):
    docs = make(nasty, "1 as copy")
    assert source_mix.mix(docs).count() == len(nasty)
    taken = source_mix.take(docs)
    assert taken.columns == [*docs.columns, "copy_"]
    words = sum(r.taken for r in source_mix.mix(docs).collect())
    assert taken.select(F.sum(source_mix.word_count(F.col("text")))).first()[0] == words
    assert source_mix.mix(make([])).count() == 0 and source_mix.take(make([])).count() == 0
    assert source_mix.take(make([(1, None), (2, "")])).count() == 0


def test_flight_keeps_totals():
    import numpy as np

    rng = np.random.default_rng(1)
    p, size = rng.random(200).tolist(), rng.integers(1, 500, 200).tolist()
    q = source_mix.flight(p, size, rng)
    assert sum(0 < x < 1 for x in q) <= 2
    assert abs(sum(p) - sum(q)) < 1e-6 and abs(sum(a * b for a, b in zip(p, size)) - sum(a * b for a, b in zip(q, size))) < 1e-3


PAGES = [
    (1, "http://a.org/x/", "<html><head><title>A &amp; B</title><script>var a='</p>';</script></head><body><p>One<br>two &eacute;</p><!-- gone --><a href='../y?q=1&amp;r=2'>go <b>on</b></a><div title=\"a>b\">three</div>"),
    (2, None, None), (3, "http://b.org", ""), (3, "http://b.org", ""), (None, "http://c.org", "<p>open <script>never closed"), (5, "http://[bad", "plain <a href=x>text"),
]


def test_derivatives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("block", F.lit(1))
    source = warc.responses(pages)
    made = warc.derive(source)
    rows = made.collect()
    assert len(rows) == 2 * len(PAGES)
    of = {(r.refers_to, r.record_type): r for r in rows}
    first = next(r for r in source.collect() if r.target_uri == "http://a.org/x/")
    text, about = of[first.record_id, "conversion"], json.loads(of[first.record_id, "metadata"].block)
    assert text.block.decode() == "A & B\nOne\ntwo é\ngo on\nthree"
    assert about["html"] == {"title": "A & B", "links": [{"url": "http://a.org/y?q=1&r=2", "text": "go on"}]}
    assert about["source"]["record_id"] == first.record_id and ["WARC-Date", first.date] in about["source"]["warc_headers"]
    assert about["conversion"]["record_id"] == text.record_id and about["source"]["block_digest"] == warc.sha1_digest(bytes(first.block))
    headers = {h.name: h.value for h in text.headers}
    assert headers["WARC-Refers-To"] == first.record_id and headers["WARC-Block-Digest"] == warc.sha1_digest(bytes(text.block))

    every = source.unionByName(made)
    warc.write_warc(every, str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w"))
    view = lambda df: sorted((r.record_type, r.record_id, str(r.refers_to), bytes(r.block), str([(h.name, h.value) for h in r.headers])) for r in df.collect())
    assert view(back) == view(every) and back.where("not complete").count() == 0
    assert warc.derive(every.limit(0)).count() == 0


class Plain(HTMLParser):
    """Text and links of a well-formed page, by the parser of the standard library."""

    def __init__(self):
        super().__init__()
        self.pieces, self.links, self.skip, self.title, self.in_title = [], [], 0, "", False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.skip += 1
        if tag in warc._BLOCKS:
            self.pieces.append("\n")
        if tag == "a" and "href" in dict(attrs):
            self.links.append([dict(attrs)["href"], ""])
            self.pieces.append(None)
        self.in_title = tag == "title" or self.in_title

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.skip -= 1
        if tag in warc._BLOCKS:
            self.pieces.append("\n")
        if tag == "a":
            self.pieces.append(None)
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if not self.skip:
            self.pieces.append(data.replace("\n", " ").replace("\r", " "))
            self.title += data if self.in_title else ""


def test_derivatives_against_another_parser(spark):
    pages = table(spark, SF, "pages")
    records = warc.responses(pages).select("record_id", "target_uri").collect()
    html = {r.url: r.html for r in pages.collect()}
    uri = {r.record_id: r.target_uri for r in records}
    made = warc.derive(warc.responses(pages)).collect()
    assert len(made) == 2 * len(records)
    for r in made:
        plain = Plain()
        plain.feed(html[uri[r.refers_to]] or "")
        plain.close()
        if r.record_type == "conversion":
            lines = (" ".join(x.split()) for x in "".join(p or "" for p in plain.pieces).split("\n"))
            assert r.block.decode() == "\n".join(x for x in lines if x)
        else:
            about = json.loads(r.block)
            assert about["html"]["title"] == " ".join(plain.title.split())
            assert [x["url"] for x in about["html"]["links"]] == [urljoin(uri[r.refers_to], x.strip()) for x, _ in plain.links]


def test_hostile_pages_take_one_pass():
    began = time()
    for text in ("<a " * 300_000, "<a href='x" * 100_000, "<!x" * 300_000, "<script " * 100_000, "<x" + "=" * 300_000, "</script " * 100_000, "<!-- x" * 100_000):
        warc.page_parts(text, "http://a.org/")
    assert time() - began < 10
    for charset in ("idna", "undefined", "hex", "nothing-known"):
        assert warc.decoded(b"a\xff", [["Content-Type", f"text/html; charset={charset}"]]) == "a\ufffd"
    assert warc.decoded(b"a\xe9", [["content-type", "text/html; charset='latin-1'"]]) == "a\xe9"


def test_read_bytes_and_versions(spark, tmp_path):
    every, nested = bytes(range(256)), b"x\r\n\r\nWARC/1.0\r\nWARC-Type: inner\r\n\r\nbody\r\n\r\nWARC/1.1\r\n"
    made = spark.createDataFrame([("response", "<urn:1>", every), ("resource", "<urn:2>", nested), ("resource", "<urn:3>", None), ("resource", "<urn:4>", b"\r\n")], "record_type string, record_id string, block binary")
    made = made.withColumn("headers", F.array(F.struct(F.lit("WARC-Type").alias("name"), F.col("record_type").alias("value")), F.struct(F.lit("WARC-Record-ID").alias("name"), F.col("record_id").alias("value"))))
    warc.write_warc(made.coalesce(1), str(tmp_path / "w"))
    back = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert {k: bytes(r.block) for k, r in back.items()} == {"<urn:1>": every, "<urn:2>": nested, "<urn:3>": b"", "<urn:4>": b"\r\n"}
    assert all(r.complete for r in back.values()) and back["<urn:1>"].record_type == "response"

    many = made.where("record_id in ('<urn:1>', '<urn:2>')").withColumn("record_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.concat("record_id", k.cast("string")))))
    warc.write_warc(many.coalesce(1), str(tmp_path / "many"))
    (plain,) = (tmp_path / "many").glob("part-*")
    data = plain.read_bytes()
    (tmp_path / "zipped").mkdir()
    (tmp_path / "zipped" / "part.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "many" / "older.warc").write_bytes(data.replace(b"WARC/1.1\r\nWARC-T", b"WARC/1.0\r\nWARC-T").replace(b"<urn:", b"<old:"))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", usual):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for folder, names in (("many", ("<urn:", "<old:")), ("zipped", ("<urn:",))):
                rows = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / folder)).collect()}
                assert set(rows) == {f"{n}{k}>{m}" for n in names for k in (1, 2) for m in range(1, 41)} and all(r.complete for r in rows.values())
                assert all(len(r.block) == len(every if ":1>" in k else nested) for k, r in rows.items())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)

    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = b"WARC/1.0\r\nwarc-type: response\r\nX: a\r\n b\r\nContent-Length: 12\r\n\r\nshort\r\n\r\n"
    (tmp_path / "old.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one) + gzip.compress(two))
    old = warc.read_warc(spark, str(tmp_path / "old.warc.gz")).collect()
    assert [(r.record_type, r.complete) for r in old] == [("warcinfo", True), ("warcinfo", True), ("response", False)]
    assert bytes(old[0].block) == b"abc" and next(h.value for h in old[2].headers if h.name == "X") == "a b"


def test_columns_are_written_as_headers(spark, tmp_path):
    """A record's columns and its headers may differ: the columns are written."""
    listed = [("x", "1"), ("WARC-Record-ID", "<urn:old>"), ("warc-type", "resource"), ("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>"), ("WARC-RECORD-ID", "<urn:second>"), ("Content-Length", "99")]
    rows = [("<urn:new>", None, "http://a.org/", b"abc", listed), ("<urn:bare>", "metadata", None, b"", None), (None, "response", None, b"z", listed)]
    made = spark.createDataFrame(rows, "record_id string, record_type string, target_uri string, block binary, headers array<struct<name:string,value:string>>")
    warc.write_warc(made, str(tmp_path / "w"))
    back = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    pairs = {k: [tuple(h) for h in r.headers] for k, r in back.items()}
    assert pairs["<urn:new>"] == [("x", "1"), ("WARC-Record-ID", "<urn:new>"), *listed[2:6], ("WARC-Target-URI", "http://a.org/"), ("Content-Length", "3")]
    assert pairs["<urn:bare>"] == [("WARC-Type", "metadata"), ("WARC-Record-ID", "<urn:bare>"), ("Content-Length", "0")]
    assert pairs["<urn:old>"] == [*listed[:2], ("warc-type", "response"), *listed[3:6], ("Content-Length", "1")]
    assert {k: (r.record_type, r.target_uri, bytes(r.block), r.complete) for k, r in back.items()} == {"<urn:new>": ("resource", "http://a.org/", b"abc", True), "<urn:bare>": ("metadata", None, b"", True), "<urn:old>": ("response", None, b"z", True)}


def test_separators_that_spark_overlooks(spark, tmp_path):
    """Blocks that end in line ends, hold separators or nothing else, cut at all places: every record comes back."""
    cut = b"\r\n\r\nWARC/1."
    blocks = [b"\r\n" * k for k in range(5)] + [cut, cut + cut, b"a" + cut + b"1\r\n", b"\r\n" + cut + b"\r\n", b"b" * 90 + b"\r\n"]
    rows = [(f"<urn:{k}>", "resource", blocks[k % len(blocks)]) for k in range(60)]
    made = spark.createDataFrame(rows, "record_id string, record_type string, block binary").withColumn("headers", F.array().cast("array<struct<name:string,value:string>>"))
    warc.write_warc(made.coalesce(1), str(tmp_path / "w"))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (61, 64, 67):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            back = warc.read_warc(spark, str(tmp_path / "w")).collect()
            assert sorted((r.record_id, r.record_type, bytes(r.block)) for r in back) == sorted(rows) and all(r.complete for r in back)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)

    def read(*pieces):
        frame = pd.DataFrame({"file": "f", "piece": pieces})
        return [(r.record_type, r.block, r.complete) for made in warc._records(iter([frame])) for r in made.itertuples()]

    one, two = b"1\r\nWARC-Type: a\r\nContent-Length: 2\r\n\r\n\r\n", b"1\r\nWARC-Type: b\r\nX: WARC/1.0\r\nContent-Length: 12\r\n\r\n" + cut + b"2"
    bare, short = b"1\r\nWARC-Type: c\r\n\r\nx", b"1\r\nWARC-Type: d\r\nContent-Length: 12\r\n\r\nshort"
    assert read(*cut.join([b"WARC/1." + one, two, bare, short, one + b"\r\n"]).split(b"WARC/1.")) == [("a", b"\r\n", True), ("b", cut + b"2", True), ("c", b"x", False), ("d", b"short", False), ("a", b"\r\n", True)]


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    last = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, last, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns, name
            assert 0 < made.count() <= last.count()
        last = made
    out = corpus_pipeline.run(spark, SF)
    assert sorted(out.select("doc_id", "copy").collect()) == sorted(last.select("doc_id", "copy").collect())


def test_pipeline_against_plain_stages(spark, tmp_path, make):
    """All stages over a small table, each against plain loops over what the one before it left."""
    rng = random.Random(12)
    pools = {"aa": ["la", "lo", "li", "lu"], "bb": ["kri", "kro", "kra", "kru"]}
    word = lambda lang: "".join(rng.choice(pools[lang]) for _ in range(rng.randint(2, 4)))
    page = lambda lang, n: "\n".join(" ".join(word(lang) for _ in range(rng.randint(6, 12))) for _ in range(n))
    rows = [(k, page(("aa", "bb")[k % 2], rng.randint(3, 8)), ("aa", "bb")[k % 2], f"s{k % 3}") for k in range(36)]
    rows += [(40, rows[3][1], "bb", "s0"), (41, rows[4][1] + "\nlalo extra", "aa", "s1"), (42, None, "aa", "s1"), (43, "", None, None), (44, "12 34", "aa", "s0")]
    near = rows[5][1].replace("\n", " ").split()
    rows += [(50, " ".join(near), "bb", "s1"), (51, " ".join(["krikra", *near[1:]]), "bb", "s1")]
    item = " ".join(rows[8][1].split()[:12])
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    train = [(t, lang) for i, t, lang, _ in rows if zlib.crc32(str(i).encode()) % 5 and t is not None and lang is not None]
    accepted = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t) and plain_bayes(train, t)[1] >= 0.5]
    lines = plain_line_dedup(accepted)
    single = dict(plain_kept([(i, t) for i, t in lines.items()]))
    letters = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(letters(item)[i : i + 10]) for i in range(3)}
    clean = {i: t for i, t in single.items() if not windows & {tuple(letters(t)[j : j + 10]) for j in range(len(letters(t)) - 9)}}
    assert len(rows) > len(accepted) > len(lines) > len(single) > len(clean) > 20

    docs = table(spark, str(tmp_path), "documents")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, (dict(accepted), lines, single, clean)):
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = Counter(r.doc_id for r in mixed)
    assert {r.doc_id: r.text for r in mixed}.items() <= clean.items() and max(times.values()) <= 3
    size, taken, source = Counter(), Counter(), {r[0]: r[3] for r in rows}
    for i, t in clean.items():
        size[source[i]] += len(t.split())
        taken[source[i]] += len(t.split()) * times[i]
    level = sum(size.values()) / 8  # sources weigh 5, 2 and 1; none is above three times its size here
    for k, s in enumerate(sorted(size)):
        goal = (5, 2, 1)[k] * level
        assert goal <= 3 * size[s] and abs(taken[s] - goal) <= max(len(t.split()) for t in clean.values())


def test_pipeline_of_empty_tables(spark, tmp_path, make):
    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
