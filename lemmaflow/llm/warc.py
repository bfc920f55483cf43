"""Operator 9, WARC derivative builder.

A response record gives two more records: a ``metadata`` record, whose block is a JSON
object with the source's WARC headers, HTTP status and headers, digests, title and
outgoing links, and a ``conversion`` record, whose block is the plain text of the page.
Both name the response in WARC-Refers-To and keep its target, date and payload digest;
the metadata record names the conversion record as well, so that the three are linked.
Every record is judged alone and nothing is shuffled.

Records are rows (record_type, record_id, refers_to, target_uri, date, content_type,
headers: all WARC headers in order, block). write_warc() and read_warc() exchange them with
WARC files. The beginning of a version is the separator of Spark's text source, so large files are
split among tasks and no file is held whole; headers and blocks that hold such bytes themselves are put
together again, blocks by their Content-Length, and blocks stay bytes. (With the line ends before the version
in the separator, records were lost where a split or buffer ended between them: the text source looks for a
separator anew in the next buffer only, so one that begins like its own middle can be overlooked.)
Versions 1.0 and 1.1 are read, 1.1 is written.

Defined cases: a null page or block is an empty one and still gives both records; a
record without target has no such header; other record types give no derivatives; a body is
decoded by the charset it names, or as UTF-8 if that is unknown or no charset of text, and bytes
that don't fit become replacement characters; malformed markup never fails and is read in
one pass, and an unclosed tag, script, style or comment runs to the end; ids come from the
source's id, so repeated rows give repeated records. Reading: a record without the blank line
after its headers has an empty block; one that ends before its length is there is not
``complete``. Writing: where a record's columns and its headers differ, the columns are written.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, "
    "content_type string, headers array<struct<name:string,value:string>>, block binary"
)
_DATE = "1970-01-01T00:00:00Z"
_VERSION = "WARC/1.1"
#: the inside of a tag; quotes count only after an equals sign, and every repeat gives nothing
#: back, so that a text is read in one pass
_INSIDE = r"""((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|template)(?=[\s/>]){_INSIDE}.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+){_INSIDE}|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: elements that end a line of text
_BLOCKS = frozenset("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())


def record_id(*parts: Column) -> Column:
    """A record id that depends on the parts alone, in the form of a name-based UUID."""
    digest = F.sha1(F.concat_ws("\u0001", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-5$3-8$4-$5"), F.lit(">"))


def sha1_digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def page_parts(source: str, base: str | None) -> tuple[str, str, list[dict]]:
    """Title, text and links (url, text) of a page."""
    pieces: list[str] = []
    links: list[dict] = []
    title, in_title, opened, at = None, None, None, 0
    for m in _TOKEN.finditer(source):
        pieces.append(html.unescape(source[at : m.start()]).replace("\r", " ").replace("\n", " "))
        at = m.end()
        name = (m[4] or "").lower()
        if name == "title":
            if not m[3]:
                in_title = len(pieces)
            elif in_title is not None and title is None:
                title = "".join(pieces[in_title:])
        elif name == "a":
            if opened is not None:
                links.append({"url": opened[0], "text": " ".join("".join(pieces[opened[1] :]).split())})
                opened = None
            if not m[3] and (ref := _HREF.search(m[5])):
                target = html.unescape(next(x for x in ref.groups() if x is not None)).strip()
                try:
                    target = urljoin(base or "", target)
                except ValueError:
                    pass
                opened = (target, len(pieces))
        if name in _BLOCKS:
            pieces.append("\n")
    pieces.append(html.unescape(source[at:]).replace("\r", " ").replace("\n", " "))
    if opened is not None:
        links.append({"url": opened[0], "text": " ".join("".join(pieces[opened[1] :]).split())})
    lines = (" ".join(line.split()) for line in "".join(pieces).split("\n"))
    return " ".join((title or "").split()), "\n".join(line for line in lines if line), links


def http_parts(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """Status line, headers and body of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [[k.strip(), v.strip()] for k, _, v in (line.partition(":") for line in lines)], body


def decoded(body: bytes, headers: list[list[str]]) -> str:
    """The body as text, by the charset of its headers if that is one."""
    for name, value in headers:
        if name.lower() == "content-type" and (m := re.search(r"charset=[\"']?([\w.:-]+)", value)):
            try:
                return body.decode(m[1], "replace")
            except (LookupError, ValueError):  # no charset of text, or one that can't replace
                break
    return body.decode("utf-8", "replace")


def _derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            block = r.block or b""
            status, http, body = http_parts(block)
            title, text, links = page_parts(decoded(body, http), r.target_uri)
            plain, payload = text.encode("utf-8", "surrogatepass"), sha1_digest(body)
            source = [[h["name"], h["value"]] for h in (() if r.headers is None else r.headers)]
            about = {
                "source": {"record_id": r.record_id, "warc_headers": source, "block_digest": sha1_digest(block)},
                "http": {"status": status, "headers": http, "payload_digest": payload, "payload_length": len(body)},
                "html": {"title": title, "links": links},
                "conversion": {"record_id": r.text_id, "block_digest": sha1_digest(plain), "length": len(plain)},
            }
            made = (
                ("metadata", r.about_id, "application/json", json.dumps(about, ensure_ascii=False).encode("utf-8", "surrogatepass"), [("WARC-Concurrent-To", r.text_id)]),
                ("conversion", r.text_id, "text/plain; charset=utf-8", plain, []),
            )
            for kind, name, content, own, more in made:
                headers = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", r.record_id), *more]
                if r.target_uri is not None:
                    headers.append(("WARC-Target-URI", r.target_uri))
                if r.date is not None:
                    headers.append(("WARC-Date", r.date))
                headers += [("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", sha1_digest(own)), ("Content-Type", content), ("Content-Length", str(len(own)))]
                rows.append((kind, name, r.record_id, r.target_uri, r.date, content, [{"name": k, "value": v} for k, v in headers], own))
        yield pd.DataFrame(rows, columns=["record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "headers", "block"])


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of all response records."""
    rows = records.where(F.col("record_type") == "response").select("record_id", "target_uri", "date", "headers", "block")
    rows = rows.withColumns({"about_id": record_id(F.col("record_id"), F.lit("metadata")), "text_id": record_id(F.col("record_id"), F.lit("conversion"))})
    return rows.mapInPandas(_derive, RECORD)


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of fetched pages (page_id, url, html)."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body), F.lit("\r\n\r\n"))
    rows = pages.select(F.lit("response").alias("record_type"), record_id(F.col("page_id").cast("string"), F.col("url")).alias("record_id"), F.lit(None).cast("string").alias("refers_to"), F.col("url").alias("target_uri"), F.lit(_DATE).alias("date"), F.lit("application/http; msgtype=response").alias("content_type"), F.concat(head, body).alias("text"))
    headers = [("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("Content-Type", F.col("content_type")), ("Content-Length", F.octet_length("text"))]
    listed = F.filter(F.array(*[_header(k, v) for k, v in headers]), lambda h: h.isNotNull())
    return rows.withColumn("headers", listed).withColumn("block", F.encode("text", "UTF-8")).drop("text")


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as uncompressed WARC files, one for each partition. Content-Length is
    written as the block's own length, and the values of the record's other columns as those of
    their headers: of the first of that name, or of one more at the end. Null columns, and those
    that ``records`` lacks, leave the headers as they are."""
    block = F.coalesce("block", F.lit(b""))
    own = F.filter(F.coalesce("headers", F.array()), lambda h: F.lower(h["name"]) != "content-length")
    names = F.transform(own, lambda h: F.lower(h["name"]))
    told = [(name, F.array_position(names, name.lower()), F.col(column).cast("string")) for column, name in _NAMED.items() if column in records.columns]
    said = F.transform(own, lambda h, k: F.concat(h["name"], F.lit(": "), F.coalesce(*[F.when(at == k + 1, value) for _, at, value in told], h["value"])))
    more = [F.when(at == 0, F.concat(F.lit(f"{name}: "), value)) for name, at, value in told]
    lines = F.concat(said, F.array(*more, F.concat(F.lit("Content-Length: "), F.octet_length(block))))
    head = F.concat(F.lit(f"{_VERSION}\r\n"), F.array_join(lines, "\r\n"), F.lit("\r\n\r\n"))
    rows = records.select(F.concat(F.encode(head, "UTF-8"), block).cast("string").alias("value"))
    rows.write.option("lineSep", _END.decode()).text(path)


_END = b"\r\n\r\n"
_MARK = b"WARC/1."
_READ = RECORD + ", complete boolean"
_NAMED = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type"}


def _head(piece: bytes) -> tuple[list[dict], int, int | None]:
    """Headers of a record, where its block starts, and how long it should be."""
    end = piece.find(_END)
    lines = piece[: end if end >= 0 else len(piece)].decode("utf-8", "replace").split("\r\n")[1:]
    headers: list[dict] = []
    for line in lines:
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t") and headers:
            headers[-1]["value"] += " " + line.strip()
        elif colon:
            headers.append({"name": name.strip(), "value": value.strip()})
    said = next((h["value"] for h in headers if h["name"].lower() == "content-length"), "")
    return headers, len(piece) if end < 0 else end + len(_END), int(said) if said.isdecimal() else None


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """batches: (file, piece) in the order of the files, each file's pieces together: what stands
    before its first mark, and after each. A mark begins a record if it comes after an empty line
    and the length of the one before does not go beyond it."""
    held: list[bytes] = []
    source, missing, head = None, 0, None

    def put(*more: bytes) -> None:
        nonlocal held, missing, head
        held += more
        if head is not None:
            missing -= sum(map(len, more))
        elif _END in more[-1]:
            held = [b"".join(held)]
            head = _head(held[0])
            missing = (head[2] or 0) - (len(held[0]) - head[1])

    def rows(ended: bool) -> list[tuple]:
        whole = b"".join(held)
        if not whole:
            return []
        headers, start, length = head or _head(whole)
        block = whole[start:]
        if length is not None and len(block) >= length and not block[length:].strip(b"\r\n"):
            block = block[:length]
        elif ended:
            block = block.removesuffix(_END)
        first = {}
        for h in headers:
            first.setdefault(h["name"].lower(), h["value"])
        return [(*[first.get(x.lower()) for x in _NAMED.values()], headers, block, length == len(block))]

    for batch in batches:
        made = []
        for file, piece in zip(batch["file"], batch["piece"]):
            if source != file:
                made += rows(False)
                source, held, head = file, [], None
                if piece.strip(b"\r\n"):
                    put(piece)
            elif held and not (held[-1].endswith(_END) and missing < len(_MARK)):
                put(_MARK, piece)
            else:
                made += rows(True)
                held, head = [], None
                put(piece)
        yield pd.DataFrame(made, columns=[*_NAMED, "headers", "block", "complete"])
    yield pd.DataFrame(rows(False), columns=[*_NAMED, "headers", "block", "complete"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed or gzipped WARC files, with a column ``complete``: false for
    a block that isn't as long as its Content-Length says. A record ends where its length says, so a file's
    pieces are read in one order: as they come from a gzipped file, which is never split; those of
    other files, which may come from several splits, are brought together by file first."""
    text = spark.read.option("lineSep", _MARK.decode()).text(path)
    packed = F.col("_metadata.file_name").endswith(".gz")
    piece = [F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")]
    whole = text.where(packed).select(*piece)
    split = text.where(~packed).select(*piece, F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    split = split.repartition("file").sortWithinPartitions("file", "split", "place").select("file", "piece")
    made = [rows.mapInPandas(_records, _READ) for rows in (whole, split)]
    return made[0].unionByName(made[1])


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return made.select("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", F.array_join(lines, "\n").alias("warc_headers"), F.octet_length("block").cast("long").alias("block_length"), F.decode("block", "UTF-8").alias("block"))
