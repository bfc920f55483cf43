"""TeX and import helpers on columns: contexts, arguments, tags, paths, notes (TXT05, TXT06, TXT10, TXT13,
TXT27-TXT32, TXT44, TXT45, TXT52, TXT56, TXT57, TXT59, TXT61, TXT63, TXT68, TXT69, ID20, ID30, ID34, ID36, ID37, ID45)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .identifiers import permalink
from .text import clean_title, collapse, squeeze_lines, tex_statement, without_comments

_INVOCATION = "array<struct<start:int,end:int,starred:boolean,optional:array<string>,required:array<string>>>"


def line_context(line: Column, number: Column) -> Column:
    """A line of TeX in short, references and citations named only."""
    bare = F.regexp_replace(without_comments(line), r"\\ref\{[^{}]+\}", "[reference]")
    shown = F.left(collapse(F.regexp_replace(bare, r"\\cite(?:\[[^\]]*\])?\{[^{}]+\}", "[citation]")), F.lit(240))
    return F.when(F.length(shown) > 0, shown).otherwise(F.concat(F.lit("Explicit source reference on line "), number.cast("string"), F.lit(".")))


@F.pandas_udf(ArrayType(IntegerType()))
def lines_at(contents: pd.Series, offsets: pd.Series) -> pd.Series:
    """The lines, from 1, in which the offsets of a text stand."""
    breaks = lambda text: np.flatnonzero(np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4") == 10)
    return pd.Series([(np.searchsorted(breaks(text), at) + 1).tolist() for text, at in zip(contents, offsets)], dtype=object)


def shortened(value: Column, most: int = 400) -> Column:
    """The text, or its start and three dots in ``most`` characters."""
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.left(value, F.lit(most - 3)), F.lit("...")))


def source_context(text: Column, start: Column, end: Column) -> Column:
    """The whole lines from offset ``start`` to ``end``, white space collapsed, at most 400 characters."""
    before = F.substring_index(F.left(text, start), "\n", -1)
    after = F.substring_index(F.substr(text, end + 1), "\n", 1)
    return shortened(tex_statement(F.concat(before, F.substr(text, start + 1, end - start), after)))


def proof_body(raw: Column) -> Column:
    """The text of a proof environment without its begin and end."""
    inner = F.regexp_replace(raw, r"^\s*\\begin\{proof\}(?:\[[^\]]*\])?", "")
    return squeeze_lines(F.regexp_replace(inner, r"\\end\{proof\}\s*$", ""))


def slogan(raw: Column) -> Column:
    """The cleaned text of a slogan environment; null without one."""
    found = F.regexp_extract(raw, r"(?s)\\begin\{slogan\}(.*?)\\end\{slogan\}", 1)
    return F.when(F.regexp_like(raw, F.lit(r"(?s)\\begin\{slogan\}.*?\\end\{slogan\}")), clean_title(found))


#: fixed values: TeX of a manuscript and the Markdown in its place, applied in this order
_MARKDOWN = (
    (r"\\label(?:\[[^\]]*\])?\{[^}]*\}", ""),
    (r"\\tag\{[^}]*\}", ""),
    (r"\\begin\{equation\*?\}", "\n\\$\\$\n"),
    (r"\\end\{equation\*?\}", "\n\\$\\$\n"),
    (r"\\begin\{align\*?\}", "\n\\$\\$\n\\\\begin{aligned}\n"),
    (r"\\end\{align\*?\}", "\n\\\\end{aligned}\n\\$\\$\n"),
    (r"\\begin\{enumerate\}(?:\[[^\]]*\])?", "\n"),
    (r"\\end\{enumerate\}", "\n"),
    (r"\\item\s*", "\n1. "),
    (r"\\[Cc]ref\{([^}]*)\}", r"the source statement \\\\($1\\\\)"),
    (r"\\eqref\{([^}]*)\}", r"the source equation \\\\($1\\\\)"),
    (r"\\emph\{([^{}]*)\}", "*$1*"),
    (r"\\textsc\{([^{}]*)\}", r"\\\\text{$1}"),
    (r"\n{3,}", "\n\n"),
)


def latex_to_markdown(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for pattern, shown in _MARKDOWN:
        out = F.regexp_replace(out, pattern, shown.replace("\\\\\\\\", "\\\\"))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def statement_kind(kind: Column, environment: Column, imported: Column) -> Column:
    """The kind of a statement from its record's kind and environment."""
    return (
        F.when(kind.isin("definition", "notation"), kind).when(environment.isin("proposition", "lemma", "corollary"), environment)
        .when(F.coalesce(imported, F.lit(False)), "imported-result").otherwise("theorem")
    )


def whole_number(value: Column, fallback: int = 0) -> Column:
    """The number that a text is; the fallback for anything else or what is beyond 2**53."""
    number = F.when(F.regexp_like(F.trim(value), F.lit(r"^-?[0-9]+$")), F.trim(value).try_cast("long"))
    return F.coalesce(F.when(F.abs(number) < (1 << 53), number), F.lit(fallback)).cast("long")


def captured_at_valid(value: Column) -> Column:
    return F.coalesce(value.try_cast("timestamp").isNotNull(), F.lit(False))


def export_timestamp(xml: Column, address: Column) -> Column:
    """A struct (value, basis, generator): from the export's own comment, else from digits in its file's name."""
    comment = r'(?i)<!--\s*generator="([^"]+)"\s+created="(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?)"\s*-->'
    name = r"(?:^|[^0-9])(\d{4})[-_]?([01]\d)[-_]?([0-3]\d)[T_.-]?([0-2]\d)[-_:]?([0-5]\d)(?:[-_:]?([0-5]\d))?(?:Z)?(?=[^0-9]|$)"
    part = lambda k: F.regexp_extract(F.coalesce(address, F.lit("")), name, k)
    said, generator = F.nullif(F.regexp_extract(xml, comment, 2), F.lit("")), F.nullif(F.regexp_extract(xml, comment, 1), F.lit(""))
    seconds = F.when(part(6) == "", "00").otherwise(part(6))
    named = F.when(part(1) != "", F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit(" "), F.concat_ws(":", part(4), part(5), seconds)))
    basis = F.when(said.isNotNull(), "generator-comment").when(named.isNotNull(), "source-filename")
    return F.struct(F.coalesce(F.replace(said, F.lit("T"), F.lit(" ")), named).alias("value"), basis.alias("basis"), generator.alias("generator"))


def edition_label(title: Column, subtitle: Column, edition: Column) -> Column:
    """Title and subtitle of a book, and its edition unless they name it."""
    filled = lambda c: F.nullif(collapse(c), F.lit(""))
    line = F.nullif(F.concat_ws(": ", filled(title), filled(subtitle)), F.lit(""))
    known = F.contains(F.lower(line), F.lower(filled(edition)))
    return F.coalesce(F.when(filled(edition).isNotNull() & ~known, F.concat(line, F.lit(", "), filled(edition))), line, filled(edition), F.lit("Pinned official PreTeXt edition"))


def artifact_title(kind: Column, label: Column, raw: Column, heading: Column) -> Column:
    """The heading of a section, else the start of the source, else its label."""
    preview = F.regexp_replace(F.regexp_replace(squeeze_lines(raw), r"^\\begin\{[^{}]+\}(?:\[[^\]]*\])?", ""), r"\\end\{[^{}]+\}$", "")
    shown = F.left(F.regexp_replace(preview, r"^\s+|\s+$", ""), F.lit(160))
    named = F.concat(F.lit("Referenced source "), kind, F.lit(": "), F.coalesce(F.nullif(shown, F.lit("")), label))
    return F.coalesce(F.when(kind == "section", F.nullif(squeeze_lines(heading), F.lit(""))), named)


def formal_source_url(own: Column, repository: Column, commit: Column, file: Column, line: Column) -> Column:
    return F.coalesce(own, permalink(repository, commit, file, line))


def tags_match(tags: Column, expression: Column) -> Column:
    """True if any tag of a comma-separated expression is set. tags: map of name to boolean."""
    names = F.filter(F.transform(F.split(expression, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.exists(names, lambda x: F.coalesce(F.try_element_at(tags, x), F.lit(False)))


def tag_digest(tags: Column) -> Column:
    """SHA-256 of the tags as JSON pairs in order of their names."""
    pairs = F.array_sort(F.map_entries(tags))
    shown = F.transform(pairs, lambda e: F.concat(F.lit('["'), e["key"], F.lit('",'), e["value"].cast("string"), F.lit("]")))
    return F.sha2(F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]")), 256)


def plain_path(path: Column) -> Column:
    """A path without doubled slashes, dots and steps up, forward slashes only; null if it
    is absolute or leaves its root."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(done) > 0) & ~F.coalesce(F.element_at(done, -1) == "..", F.lit(False))
        return F.when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(x)))

    walked = F.aggregate(parts, empty, step)
    return F.when(~F.startswith(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")) & ~F.coalesce(F.get(walked, 0) == "..", F.lit(False)), F.array_join(walked, "/"))


def source_path(path: Column) -> Column:
    """A plain path of a TeX file, with its ending."""
    plain = plain_path(path)
    return F.when(F.endswith(plain, F.lit(".tex")), plain).otherwise(F.concat(plain, F.lit(".tex")))


def resolve_import(owner: Column, directory: Column, filename: Column, starred: Column) -> Column:
    """The path of an imported file: below ``content`` if starred, else beside its owner."""
    base = F.when(starred, "content").otherwise(F.regexp_replace(owner, "/?[^/]*$", ""))
    return source_path(F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(directory, F.lit("")), filename))


def reference_target(file_id: Column, optional: Column, required: Column) -> Column:
    """The full label of a reference whose optional arguments replace parts of the file's own id."""
    given, n = F.transform(optional, lambda x: F.trim(x)), F.size(optional)
    own = lambda k: F.get(file_id, k)
    parts = F.when(n == 0, F.array(own(0), own(1), own(2))).when(n == 1, F.array(own(0), own(1), F.get(given, 0))).when(n == 2, F.array(own(0), F.get(given, 0), F.get(given, 1))).otherwise(F.slice(given, 1, 3))
    return F.concat_ws(":", parts, F.trim(required))


def encoded_anchor(anchor: Column) -> Column:
    """An anchor as part of an address; null for an empty one."""
    out = F.replace(F.url_encode(anchor), F.lit("+"), F.lit("%20"))
    for code, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.when(F.length(anchor) > 0, out)


def blanked(text: Column) -> Column:
    """A blank for every character but line ends."""
    return F.regexp_replace(text, r"[^\n\r]", " ")


def without_build_conditionals(source: Column, start: str, end: str = r"\\fi") -> Column:
    """TeX in which conditionals that are known to be complete, from ``start`` to the next ``end``, are blanked
    where they stand, so that offsets and lines stay. One that does not end is left."""
    pattern = rf"(?s){start}.*?{end}"
    pieces, found = F.split(source, pattern, -1), F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    blanks = F.transform(found, blanked)
    return F.array_join(F.transform(pieces, lambda x, k: F.concat(x, F.coalesce(F.get(blanks, k), F.lit("")))), "")


def _balanced(source: str, at: int, open_: str, close: str) -> int:
    """The offset after the bracket that closes the one at ``at``; -1 without one."""
    depth, k = 0, at
    while k < len(source):
        c = source[k]
        if c == "\\":
            k += 1
        elif c == open_:
            depth += 1
        elif c == close:
            depth -= 1
            if not depth:
                return k + 1
        k += 1
    return -1


_TOKEN = re.compile(r"\\(?:[A-Za-z@]+|.)|.", re.S)
_SPACE = re.compile(r"\s*")


def invocations(source: Column, name: str, optional: int = 0, required: int = 1, star: bool = False) -> Column:
    """All uses of a command with their arguments: (start, end, starred, optional, required).
    An argument without braces is the next command or character; a use that lacks an argument
    gives none."""
    start = re.compile(rf"\\{name}(?![A-Za-z@])")

    def one(text: str, at: int):
        k = _SPACE.match(text, at + len(name) + 1).end()
        starred = star and text[k : k + 1] == "*"
        k = _SPACE.match(text, k + 1).end() if starred else k
        lists: tuple[list[str], list[str]] = ([], [])
        while len(lists[0]) < optional and text[k : k + 1] == "[":
            end = _balanced(text, k, "[", "]")
            if end < 0:
                return None
            lists[0].append(text[k + 1 : end - 1])
            k = _SPACE.match(text, end).end()
        while len(lists[1]) < required:
            if text[k : k + 1] == "{":
                end = _balanced(text, k, "{", "}")
                if end < 0:
                    return None
                lists[1].append(text[k + 1 : end - 1])
            else:
                token = _TOKEN.match(text, k)
                if not token:
                    return None
                end = token.end()
                lists[1].append(token[0])
            k = _SPACE.match(text, end).end()
        return at, k, bool(starred), *lists

    @F.pandas_udf(_INVOCATION)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[r for m in start.finditer(t or "") if (r := one(t, m.start()))] for t in texts], dtype=object)

    return found(source)


@F.pandas_udf(ArrayType(StringType()))
def split_top_level(values: pd.Series) -> pd.Series:
    """The parts between commas that stand in no braces, trimmed, empty ones left out."""

    def one(text: str | None) -> list[str]:
        parts, depth, start = [], 0, 0
        for k, c in enumerate(text or ""):
            if c == "{":
                depth += 1
            elif c == "}" and depth:
                depth -= 1
            elif c == "," and not depth:
                parts.append(text[start:k])
                start = k + 1
        return [p.strip() for p in (*parts, (text or "")[start:]) if p.strip()]

    return values.map(one)
