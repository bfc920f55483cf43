"""Text, markup and display functions on columns (TXT01-TXT04, TXT11-TXT22, TXT33-TXT35, TXT38-TXT43, TXT46-TXT51, TXT53-TXT55, TXT58, TXT60, TXT62, TXT64-TXT67, TXT71, TXT72)."""

from __future__ import annotations

import html
import io
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructType

#: fixed values: licences, the patterns that show them and their addresses
LICENSES = {
    "GFDL-1.2-or-later": (r"(?i)GNU Free Documentation License,?\s*Version 1\.2\s+or any later version", "https://www.gnu.org/licenses/old-licenses/fdl-1.2.html"),
    "GFDL-1.3-or-later": (r"(?i)GNU Free Documentation License,?\s*Version 1\.3\s+or any later version", "https://www.gnu.org/licenses/fdl-1.3.html"),
    "CC-BY-NC-SA-4.0": (r"(?i)creativecommons\.org/licenses/by-nc-sa/4\.0/", "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    "CC-BY-SA-4.0": (r"(?i)creativecommons\.org/licenses/by-sa/4\.0/", "https://creativecommons.org/licenses/by-sa/4.0/"),
    "CC-BY-4.0": (r"(?i)creativecommons\.org/licenses/by/4\.0/", "https://creativecommons.org/licenses/by/4.0/"),
}


def collapse(value: Column) -> Column:
    """Runs of white space, of any script, as one space; none at either end."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def squeeze_lines(value: Column) -> Column:
    """Single blanks, none around line ends, at most one empty line."""
    blanks = F.regexp_replace(F.regexp_replace(value, r"[ \t\f\u000B]+", " "), r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(blanks, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def without_comments(value: Column) -> Column:
    """TeX text without comments; an escaped per cent sign does not start one."""
    return F.regexp_replace(value, r"(?m)(?<!\\)((?:\\\\)*)%.*$", "$1")


def tex_statement(value: Column) -> Column:
    """TeX without comments and labels, white space collapsed."""
    return collapse(F.regexp_replace(without_comments(value), r"\\label\{[^{}]*\}", ""))


def plain_tex(value: Column) -> Column:
    """TeX text without commands, braces and math signs."""
    bare = F.regexp_replace(F.regexp_replace(value, r"\\(?:label|begin|end)\{[^{}]*\}", " "), "~", " ")
    return collapse(F.regexp_replace(F.regexp_replace(bare, r"\\[A-Za-z]+\*?", " "), r"[{}$]", ""))


def clean_title(value: Column) -> Column:
    return F.regexp_replace(tex_statement(value), r"[.\s]+$", "")


def math_delimiters(markdown: Column) -> Column:
    """\\( \\) and \\[ \\] as single and double dollar signs."""
    inline = F.regexp_replace(markdown, r"\\\((.*?)\\\)", r"\$$1\$")
    return F.regexp_replace(inline, r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")


def strip_tags(value: Column) -> Column:
    """Text of HTML without script and style bodies, comments and tags; entities stay."""
    bare = F.regexp_replace(value, r"(?is)<(script|style)\b[^>]*>.*?</(?:script|style)\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    return collapse(F.regexp_replace(bare, r"<[^>]*>", " "))


@F.pandas_udf(StringType())
def decode_entities(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(StringType())
def identity_text(values: pd.Series) -> pd.Series:
    """Text for the comparison of titles and names: compatibility forms, ASCII letters and digits only."""
    return values.map(lambda v: re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKD", html.unescape(v or "")).lower()).strip())


def same_identity(title: Column, other_title: Column, author: Column, other_author: Column) -> Column:
    """True if the titles agree and one author line contains the other (all of identity_text())."""
    given = (F.length(title) > 0) & (F.length(author) > 0) & (F.length(other_author) > 0)
    return F.coalesce(given & (title == other_title) & (F.contains(author, other_author) | F.contains(other_author, author)), F.lit(False))


def edition_year(value: Column) -> Column:
    """The year in an edition's text, or else that of a phrase "released in"; null without one."""
    year = F.nullif(F.regexp_extract(value, r"(?is)<edition\b[^>]*>[^<]*?\b((?:19|20|21)[0-9]{2})\b", 1), F.lit(""))
    released = F.nullif(F.regexp_extract(value, r"(?i)\breleased\s+in\s+(?:[a-z]+\s+)?((?:19|20|21)[0-9]{2})\b", 1), F.lit(""))
    return F.coalesce(year, released).cast("int")


def line_number(text: Column, offset: Column) -> Column:
    """The line, from 1, that holds the character at an offset from 0."""
    return F.size(F.split(F.left(text, offset), "\n"))


def labels(text: Column) -> Column:
    return F.regexp_extract_all(without_comments(text), F.lit(r"\\label\{([^{}]+)\}"))


def citations(text: Column) -> Column:
    """Keys of all cite commands, split at commas."""
    found = F.regexp_extract_all(without_comments(text), F.lit(r"\\cite(?:\[[^\]]*\])?\{([^{}]+)\}"))
    return F.transform(F.flatten(F.transform(found, lambda x: F.split(x, ","))), lambda x: F.trim(x))


def bibliography_keys(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"@\w+\s*\{\s*([^,\s]+)\s*,"))


def licenses(text: Column) -> Column:
    """Names of all licences that a text shows, in the order of the table."""
    return F.filter(F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.lit(name)) for name, (p, _) in LICENSES.items()]), lambda x: x.isNotNull())


def license_of(text: Column) -> Column:
    """The licence, if exactly one is shown."""
    found = licenses(text)
    return F.when(F.size(found) == 1, F.get(found, 0))


def license_address(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for n, (_, url) in LICENSES.items() for x in (n, url)]), name)


def inferred_license(edition: Column, repository: Column) -> Column:
    """A struct (name, address, note): the one licence that the edition's text shows, and how
    it stands to that of the repository's licence file (null without a file)."""
    own, other = licenses(edition), F.coalesce(licenses(repository), F.array().cast("array<string>"))
    one, two = F.when(F.size(own) == 1, F.get(own, 0)), F.when(F.size(other) == 1, F.get(other, 0))
    many = lambda place, found: F.concat(F.lit(f"The {place} contains multiple distinct license markers ("), F.array_join(found, ", "), F.lit("); governing license identification remains pending review."))
    note = (
        F.when(F.size(own) > 1, many("active book source", own))
        .when(F.size(other) > 1, many("repository-level license file", other))
        .when(one != two, F.concat(F.lit("The active book source states "), one, F.lit(", while the repository-level license file states "), two, F.lit(". This candidate edition metadata follows the active book source; the conflict remains pending review.")))
        .when(one.isNotNull(), F.concat(F.lit("Candidate license metadata inferred from the active pinned book source ("), one, F.lit("); not independently reviewed.")))
        .otherwise("No unambiguous edition-level license was detected in the active pinned book source; license identification remains pending review.")
    )
    return F.struct(one.alias("name"), license_address(one).alias("address"), note.alias("note"))


#: fixed rules: start of a heading, class and kind of its node
_STARTS = (
    ("theorem", "theorem-like", "theorem"), ("lemma", "theorem-like", "lemma"), ("proposition", "theorem-like", "proposition"),
    ("corollary", "theorem-like", "corollary"), ("claim", "theorem-like", "claim"), ("definition", "support", "definition"),
    ("notation", "support", "notation"), ("axiom", "support", "axiom"), ("assumption", "support", "assumption"),
)


def semantic_kind(label: Column, textbox: bool = False) -> Column:
    """A struct (node_class, kind) for a heading or box label; null if it names nothing."""
    bare = F.regexp_replace(collapse(label), "^[\\s:–—-]+|[\\s:–—-]+$", "")

    def kind(a: str, b: str) -> Column:
        return F.struct(F.lit(a).alias("node_class"), F.lit(b).alias("kind"))

    chain = F.when(F.lit(False), kind("", ""))
    for word, cls, name in _STARTS:
        chain = chain.when(F.regexp_like(bare, F.lit(rf"(?i)^{word}(?:\b|[:.0-9])")), kind(cls, name))
    chain = chain.when(F.regexp_like(bare, F.lit(r"(?i)\balgorithm\b")), kind("support", "algorithm"))
    if textbox:
        chain = chain.when(F.regexp_like(bare, F.lit(r"(?i)^examples?\b")), kind("support", "example"))
        chain = chain.when(F.regexp_like(bare, F.lit(r"(?i)\brule\b")), kind("support", "algorithm"))
    return chain.when(F.regexp_like(bare, F.lit(r"(?i)\b(?:rule|propert(?:y|ies)|identity|law)\b")), kind("theorem-like", "named-result"))


def dependency_role(node_class: Column, kind: Column) -> Column:
    """The role of an edge, from what it points to; raw artifacts first."""
    return (
        F.when(node_class == "source-artifact", "source-artifact")
        .when(kind.isin("definition", "notation"), kind)
        .when(kind.isin("axiom", "assumption"), "assumption")
        .when(kind.isin("algorithm", "calculation"), "calculation")
        .otherwise("logical")
    )


def search_text(*parts: Column) -> Column:
    """The lower-case text that substring search looks into; nulls are left out."""
    return F.lower(F.concat_ws(" ", *parts))


def enum_label(value: Column) -> Column:
    spaced = F.replace(value, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substr(spaced, F.lit(2)))


def ratio(value: Column, total: Column) -> Column:
    return F.concat(F.format_number(value, 0), F.lit(" / "), F.format_number(total, 0))


def percent(value: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), F.coalesce(F.try_divide(value * 100.0, total), F.lit(0.0)))


def long_date(value: Column) -> Column:
    """A date in words; what is no date stays as it is."""
    return F.coalesce(F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "MMMM d, yyyy"), value)


_OPENING = re.compile(r"<!--|<!\[CDATA\[|<(/?)([A-Za-z][\w:-]*)")
_ATTRIBUTE = re.compile(r"""(?<![\w:-])([\w:-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_TAGS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("closing", BooleanType()).add("single", BooleanType()).add("name", StringType()).add("attributes", MapType(StringType(), StringType())))


def _tag_ends(source: str) -> tuple[array, array]:
    """The places of > and quotes, and for each the place of the > at which a tag ends that reads on from
    there, -1 without one. A quote leads to what follows its partner; each place is looked at once."""
    places = array("i", (m.start() for m in re.finditer("[>\"']", source)))
    ends, quotes = array("i", [-1]) * (len(places) + 1), {'"': -1, "'": -1}
    for k in range(len(places) - 1, -1, -1):
        mark = source[places[k]]
        if mark == ">":
            ends[k] = places[k]
        else:
            ends[k] = ends[quotes[mark] + 1] if quotes[mark] >= 0 else -1
            quotes[mark] = k
    return places, ends


def tags_of(source: str, xml: bool = False) -> Iterator[dict]:
    """The tags of a text in order, in time linear in its length."""
    places, ends = _tag_ends(source)
    kept = (lambda x: x) if xml else str.lower
    at, skip = 0, None
    while m := _OPENING.search(source, at):
        if m[2] is None:
            close = source.find("-->" if m[0] == "<!--" else "]]>", m.end())
            at = len(source) if close < 0 else close + 3
            continue
        end = ends[bisect_left(places, m.end())]
        if end < 0:
            at = m.end()
            continue
        name, closing, at = kept(m[2]), bool(m[1]), end + 1
        if skip and not (closing and name == skip):
            continue
        skip = name if not xml and name in ("script", "style") and not closing else None
        attributes = {kept(a[1]): html.unescape(next(x for x in a.groups()[1:] if x is not None)) for a in _ATTRIBUTE.finditer(source, m.end(), end)}
        yield {"start": m.start(), "end": end + 1, "closing": closing, "single": not closing and source[end - 1] == "/", "name": name, "attributes": attributes}


def scan_tags(source: Column, xml: bool = False, names: list[str] | None = None) -> Column:
    """All tags of HTML or XML texts with offsets and attributes, or those of ``names`` only; comments and CDATA sections are
    skipped. In HTML, script and style bodies are skipped too and names are in lower case; XML names stay as they are. Tags
    are gathered as Arrow columns, some 30 bytes each and their attributes, not as objects."""
    kept = None if names is None else frozenset(names)

    @F.arrow_udf(_TAGS)
    def found(sources: pa.Array) -> pa.Array:
        starts, ends, rows, pairs = array("i"), array("i"), array("i", [0]), array("i", [0])
        closing, single = bytearray(), bytearray()
        tag_names, keys, values = [], [], []
        for source in sources:
            for tag in tags_of(source.as_py() or "", xml):
                if kept is not None and tag["name"] not in kept:
                    continue
                starts.append(tag["start"])
                ends.append(tag["end"])
                closing.append(tag["closing"])
                single.append(tag["single"])
                tag_names.append(sys.intern(tag["name"]))
                keys += map(sys.intern, tag["attributes"])
                values += tag["attributes"].values()
                pairs.append(len(keys))
            rows.append(len(starts))
        flags = lambda x: pa.array(np.frombuffer(bytes(x), dtype=bool))
        whole = lambda x: pa.array(np.frombuffer(x.tobytes(), dtype=np.int32))
        attributes = pa.MapArray.from_arrays(whole(pairs), pa.array(keys, pa.string()), pa.array(values, pa.string()))
        tags = pa.StructArray.from_arrays([whole(starts), whole(ends), flags(closing), flags(single), pa.array(tag_names, pa.string()), attributes], _TAGS.elementType.names)
        return pa.ListArray.from_arrays(whole(rows), tags)

    return found(source)


def tag_rows(texts: DataFrame, source: str, xml: bool = False) -> DataFrame:
    """``scan_tags`` as rows (n, start, end, ..) beside the other columns of ``texts``, for texts of any number of tags: a task
    holds one text and some rows, no list of all."""
    kinds = StructType([*StructType().add("n", IntegerType()), *_TAGS.elementType])
    return rows_of(texts, [source], kinds, lambda x: ({"n": n, **tag} for n, tag in enumerate(tags_of(x or "", xml))))


def cut_rows(texts: DataFrame, source: str, starts: str, stops: str) -> DataFrame:
    """``cuts`` as rows (n, piece) beside the other columns of ``texts``, n being the place in the lists of offsets."""
    kinds = StructType().add("n", IntegerType()).add("piece", StringType())
    return rows_of(texts, [source, starts, stops], kinds, lambda x, a, b: ({"n": n, "piece": x[i:j]} for n, (i, j) in enumerate(zip(a or (), b or ()))))


def rows_of(texts: DataFrame, sources: list[str], kinds: StructType, found: Callable[..., Iterable[dict]]) -> DataFrame:
    """What ``found`` lists for the columns ``sources`` of each row, as rows beside the other columns, some at a time."""
    kept = [c for c in texts.columns if c not in sources]
    schema = StructType([*texts.select(*kept).schema, *kinds])
    arrow = to_arrow_schema(kinds)

    def column(field: pa.Field, values: list) -> pa.Array:
        return pa.array([None if v is None else list(v.items()) for v in values] if pa.types.is_map(field.type) else values, field.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(len(kept) + k) for k in range(len(sources))]
            each = ((row, x) for row in range(batch.num_rows) for x in found(*(v[row].as_py() for v in values)))
            while listed := list(islice(each, _ROWS)):
                at = pa.array([row for row, _ in listed], pa.int32())
                same = [batch.column(k).take(at) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*same, *(column(f, [x[f.name] for _, x in listed]) for f in arrow)], [*kept, *arrow.names])

    return texts.select(*kept, *sources).mapInArrow(run, schema)


def joined_lines(rows: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, content): the lines of a key in their order, with line ends between, without nulls. A task reads its keys as one
    sorted stream and holds one text."""
    kind = to_arrow_schema(rows.select(key).schema).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines, started, first = None, io.BytesIO(), False, True

        def text() -> pa.RecordBatch:
            # the bytes as they are, a text of its own would be another copy
            ends = pa.py_buffer(array("i", [0, lines.tell()]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([held], kind), pa.StringArray.from_buffers(1, ends, pa.py_buffer(lines.getbuffer()))], [key, "content"])

        for batch in batches:
            for one, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not started or one != held:
                    if started:
                        yield text()
                    held, lines, started, first = one, io.BytesIO(), True, True
                if line is not None:
                    lines.write(line.encode() if first else b"\n" + line.encode())
                    first = False
        if started:
            yield text()

    sorted_ = rows.select(key, order, line).repartition(F.xxhash64(key)).sortWithinPartitions(key, order)
    schema = StructType([*rows.select(key).schema, *StructType().add("content", StringType())])
    return sorted_.select(key, line).mapInArrow(run, schema)


@F.pandas_udf(ArrayType(StringType()))
def cuts(sources: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
    """The pieces of each text between the offsets. A column's substr() reads a text from its start for every piece."""
    return pd.Series([None if text is None or a is None else [text[i:j] for i, j in zip(a, b)] for text, a, b in zip(sources, starts, stops)], dtype=object)


_SPANS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("environment", StringType()).add("title", StringType()).add("body", StringType()))


_ENVIRONMENT = re.compile(r"\\(begin|end)\s*\{([A-Za-z*]+)\}(?:\[([^\]]*)\])?")
#: rows of environments that a task hands on at once
_ROWS = 5_000


def _environments(source: str | None) -> Iterator[tuple]:
    """(start, end, environment, title, body) of a text, each when it ends."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    text = re.sub(r"(?<!\\)%[^\n]*", blank, source or "")
    text = re.sub(r"(?<=\\begin\{verbatim\}).*?(?=\\end\{verbatim\})", blank, text, flags=re.S)
    open_ = []
    for m in _ENVIRONMENT.finditer(text):
        if m[1] == "begin":
            open_.append((m[2], m.start(), m.end(), m[3]))
        elif any(o[0] == m[2] for o in open_):
            while open_:
                name, start, inner, title = open_.pop()
                yield start, m.end(), name, title, text[inner : m.start()]
                if name == m[2]:
                    break
    for name, start, inner, title in open_:
        yield start, len(text), name, title, text[inner:]


@F.pandas_udf(_SPANS)
def tex_environments(sources: pd.Series) -> pd.Series:
    """Environments of TeX texts, nested ones included, in order of their start; comments
    and verbatim bodies are blanked first, an unclosed one runs to the end."""
    return sources.map(lambda x: [dict(zip(_SPANS.elementType.names, f)) for f in sorted(_environments(x), key=lambda f: f[:2])])


def tex_environment_rows(texts: DataFrame, source: str) -> DataFrame:
    """``tex_environments`` as rows beside the other columns of ``texts``, for texts of any number of
    environments: a task holds one text and some rows, no list of all."""
    kept = [c for c in texts.columns if c != source]
    schema = texts.select(*kept).schema
    for field in _SPANS.elementType:
        schema = schema.add(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *key, text in batch[[*kept, source]].itertuples(index=False, name=None):
                found = _environments(text)
                while rows := list(islice(found, _ROWS)):
                    yield pd.DataFrame([(*key, *r) for r in rows], columns=schema.names)

    return texts.select(*kept, source).mapInPandas(run, schema)


def tex_sections(content: Column) -> Column:
    """Sectioning commands as rows (start, environment, title), for inline()."""
    pattern = r"\\(?:chapter|section|subsection)\*?\{[^{}]*\}"
    pieces = F.split(content, pattern, -1)
    found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    lengths = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.length(F.element_at(pieces, i)) + F.when(i > 1, F.length(F.get(found, i - 2))).otherwise(0))
    starts = F.transform(F.sequence(F.lit(1), F.size(found)), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x))
    rows = F.transform(F.arrays_zip(starts.alias("start"), found.alias("found")), lambda x: F.struct(x["start"].alias("start"), F.lit("section").alias("environment"), F.regexp_extract(x["found"], r"\{([^{}]*)\}", 1).alias("title")))
    return F.when(F.size(found) > 0, rows)
