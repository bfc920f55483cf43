"""Source artifacts by label against plain loops over the lines."""

from __future__ import annotations

import random
import re

from lemmaflow.operators import artifacts
from pyspark.sql import functions as F

HEAD = re.compile(r"^\s*\\(chapter|section|subsection|subsubsection|paragraph)\b")
RANKS = ["chapter", "section", "subsection", "subsubsection", "paragraph"]
BOUND = re.compile(r"\\(?:begin|end)\{(?:proof|lemma|proposition|theorem|definition|situation)\}")


def plain(lines, local):
    clean = [line.split("%")[0] for line in lines]
    spots = [n for n, line in enumerate(clean, 1) for x in re.findall(r"\\label\{([^{}]+)\}", line) if x == local]
    if len(spots) != 1:
        return "no-line" if not spots else "several-lines"
    at, stack, ranges = spots[0], [], []
    for n, line in enumerate(clean, 1):
        for what, name in re.findall(r"\\(begin|end)\{([^{}]+)\}", line):
            if what == "begin":
                stack.append((name, n))
            else:
                ranges.append((*stack.pop(), n))
    around = lambda names: min((r for r in ranges if r[0] in names and r[1] <= at <= r[2]), key=lambda r: r[2] - r[1], default=None)

    def prose():
        stop = lambda line: not line.strip() or HEAD.match(line) or BOUND.search(line)
        a = b = at
        while a > 1 and not stop(clean[a - 2]):
            a -= 1
        while b < len(clean) and not stop(clean[b]):
            b += 1
        return a, b

    word = local.split("-")[0]
    if re.match("(section|subsection|subsubsection|paragraph)-", local):
        start = next((n for n in range(at, 0, -1) if HEAD.match(clean[n - 1])), None)
        if start is None:
            return "no-range"
        rank = RANKS.index(HEAD.match(clean[start - 1])[1])
        end = next((n - 1 for n in range(start + 1, len(clean) + 1) if (m := HEAD.match(clean[n - 1])) and RANKS.index(m[1]) <= rank), len(clean))
        while end > start and not clean[end - 1].strip():
            end -= 1
        return "section", start, end
    if word in artifacts.NAMED:
        found = around([word])
        return (word, *found[1:]) if found else "no-range"
    if word == "equation":
        found = around(artifacts.MATH)
        return ("equation", *(found[1:] if found else prose()))
    if word == "item":
        box = around(artifacts.LISTS)
        if not box:
            return "no-range"
        depth, items = 0, []
        for n in range(box[1], box[2] + 1):
            for what in re.findall(r"\\(begin|end)\{(?:enumerate|itemize|description)\}", clean[n - 1]):
                depth += 1 if what == "begin" else -1
            if depth == 1 and "\\item" in clean[n - 1]:
                items.append(n)
        start = max((n for n in items if n <= at), default=None)
        return ("item", start, min((n for n in items if n > at), default=box[2]) - 1) if start else "no-range"
    return ("prose", *prose())


def test_artifacts(spark):
    rng = random.Random(21)
    words = ["item", "equation", "remark", "example", "section", "lemma", "subsection"]
    names = ["enumerate", "itemize", "align*", "remark", "example", "proof", "equation"]
    units, wanted = [], []
    for u in range(40):
        lines, open_, labels = [], [], 0
        for _ in range(rng.randint(5, 60)):
            kind = rng.random()
            text = rng.choice(["words here", "", "\\item one", "more % \\label{item-0} \\begin{x}", "\\item[a] two"])
            if kind < 0.15:
                open_.append(rng.choice(names))
                text = f"\\begin{{{open_[-1]}}}" + rng.choice(["", " \\item first"])
            elif kind < 0.3 and open_:
                text = f"\\end{{{open_.pop()}}}"
            elif kind < 0.36:
                text = f"\\{rng.choice(RANKS[1:])}{{A {{b}}}}"
            if rng.random() < 0.3:
                labels += 1
                text += f"\\label{{{rng.choice(words)}-{labels if rng.random() < 0.9 else 1}}}"
            lines.append(text)
        lines += [f"\\end{{{n}}}" for n in reversed(open_)]
        unit = f"u{u}" if u % 2 else f"u{u}-part"
        units.append(("c", unit, "\n".join(lines)))
        wanted += [(unit, f"{w}-{k}") for w in words for k in range(1, 6)]
    made, wrong = artifacts.source_artifacts(spark.createDataFrame(units, "component string, unit string, content string"), spark.createDataFrame([("c", f"{u}-{x}") for u, x in wanted] + [("c", "none-1")], "component string, label string"))
    got = {r["label"]: (r["kind"], r["start_line"], r["end_line"]) for r in made.collect()} | {r["label"]: r["rule"] for r in wrong.collect()}
    content = {u: t.split("\n") for _, u, t in units}
    assert got.pop("none-1") == "no-unit"
    assert got == {f"{u}-{x}": plain(content[u], x) for u, x in wanted}
    assert {x[0] for x in got.values() if isinstance(x, tuple)} == {"item", "equation", "remark", "example", "section", "prose"}
    row = made.where("kind = 'section'").select("title", F.split("source", "\n")[0].alias("head")).first()
    assert row["title"].startswith("A {b}") and "\\" in row["head"]


def test_environments_that_do_not_match(spark):
    lines = spark.createDataFrame([("c", "a", 1, "\\begin{x}\\begin{y}"), ("c", "a", 2, "\\end{x}"), ("c", "a", 3, "\\end{y}"), ("c", "b", 1, "\\begin{x}"), ("c", "d", 1, "\\begin{x}\\end{x}"), ("c", "e", 4, "\\end{x}")], "component string, unit string, line int, text string")
    ranges, wrong = artifacts.environment_ranges(lines)
    assert [(r["unit"], r["start_line"], r["end_line"]) for r in ranges.collect()] == [("d", 1, 1)]
    assert {r["unit"] for r in wrong.collect()} == {"a", "b", "e"}
