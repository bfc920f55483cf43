"""Tags over nested blocks and unfolded imports against a plain machine that walks the text."""

from __future__ import annotations

import random
import re

from lemmaflow.plans import tags
from lemmaflow.sources import macros
from pyspark.sql import functions as F


def braces(source, at):
    depth = 0
    for k in range(at, len(source)):
        depth += {"{": 1, "}": -1}.get(source[k], 0)
        if not depth:
            return k


def put(state, names, value):
    for name in (x.strip() for x in names.split(",")):
        state[name], state["not" + name] = value, not value


def plain(source, state):
    """Active text and imports (offset, name, tags)."""
    state, kept, imports = dict(state), list(source), []
    first = dict(state)

    def blank(a, b):
        for k in range(a, b):
            kept[k] = kept[k] if kept[k] in "\r\n" else " "

    def walk(a, b):
        while m := re.compile(r"\\(iftag|tagtrue|tagfalse|olimport)\{").search(source, a, b):
            args, at = [], m.end() - 1
            for _ in range(3 if m[1] == "iftag" else 1):
                end = braces(source, at)
                args.append((at + 1, end))
                at = re.compile(r"\s*").match(source, end + 1).end()
            word = source[slice(*args[0])]
            if m[1] == "iftag":
                arm = args[1] if any(state.get(x.strip()) for x in word.split(",")) else args[2]
                blank(m.start(), arm[0])
                blank(arm[1], at)
                walk(*arm)
            elif m[1] == "olimport":
                imports.append((m.start(), word, dict(state)))
            else:
                put(state, word, m[1] == "tagtrue")
            a = at

    walk(0, len(source))
    active, state, at, off = "".join(kept), first, 0, []
    while m := re.compile(r"\\(tagtrue|tagfalse|begin)\{([^}]*)\}").search(active, at):
        at = m.end()
        if m[1] != "begin":
            put(state, m[2], m[1] == "tagtrue")
            continue
        depth, k = 1, m.end()
        while depth:
            n = re.compile(r"\\(begin|end)\{tagblock\}").search(active, k)
            depth, k = depth + (1 if n[1] == "begin" else -1), n.end()
        word = re.compile(r"\{([^}]*)\}").match(active, m.end())[1]
        if not any(state.get(x.strip()) for x in word.split(",")):
            off.append((m.start(), k))
            at = k
    for a, b in off:
        blank(a, b)
    return "".join(kept), [i for i in imports if not any(a <= i[0] < b for a, b in off)]


def random_text(rng, depth=0, names=()):
    out = []
    for _ in range(rng.randint(0, 5)):
        word = rng.choice(["a", "b", "c", "nota", "b,notc", "c , a"])
        kind = rng.random()
        if kind < 0.25:
            out.append(f"\\tag{rng.choice(['true', 'false'])}{{{rng.choice(['a', 'b', 'c', 'a,b'])}}} ")
        elif kind < 0.5 and depth < 4:
            out.append(f"\\iftag{{{word}}}{{{random_text(rng, depth + 1, names)}}}\n{{{random_text(rng, depth + 1, names)}}} ")
        elif kind < 0.6 and depth == 0:
            out.append(f"\\begin{{tagblock}}{{{word}}}x\n{random_text(rng, 4, names)}\\end{{tagblock}}")
        elif kind < 0.75 and names:
            out.append(f"\\olimport{{{rng.choice(names)}}}")
        else:
            out.append(rng.choice(["text ", "é\n", "x\r\n", "{g} "]))
    return "".join(out)


FIRST = {"a": True, "nota": False}


def test_active_text_of_random_nesting(spark):
    rng = random.Random(8)
    sources = {f"u{k}": random_text(rng, names=["v"]) + ("" if k % 2 else random_text(rng)) for k in range(60)}
    sources |= {"empty": "", "deep": "\\iftag{a}{" * 30 + "x" + "}{y}" * 30}
    units = spark.createDataFrame(list(sources.items()), "unit string, content string")
    contexts = units.select(F.col("unit").alias("context"), "unit", "content", F.create_map(F.lit("a"), F.lit(True), F.lit("nota"), F.lit(False)).alias("tags"))
    texts, imports = tags.evaluated(contexts, tags.tokens(units))
    assert {r["unit"]: r["active"] for r in texts.collect()} == {u: plain(s, FIRST)[0] for u, s in sources.items()}
    got = sorted((r["unit"], r["name"], sorted(r["tags"].items())) for r in imports.collect())
    assert got == sorted((u, name, sorted(t.items())) for u, s in sources.items() for _, name, t in plain(s, FIRST)[1])


def test_unfolding(spark):
    rng = random.Random(5)
    names = [f"f{k}" for k in range(9)]
    files = {f"f{k}.tex": "\\tagtrue{c}" + "".join(random_text(rng, 2, names[k + 1 :]) for _ in range(3)) for k in range(9)}
    files["f0.tex"] = "\\olimport{f1}\\tagfalse{a}\\olimport{f1}\\olimport{gone} \\olimport{f3}\\iftag{b}{}{\\olimport{loop}}"
    files["loop.tex"] = "\\tagtrue{b}\\olimport{loop}\\olimport{f5}"
    expected, missing, cyclic = [], set(), []

    def visit(unit, state, path, above):
        key = (unit, tuple(sorted(state.items())))
        if key in above:
            cyclic.append((unit, path))
            return
        expected.append((unit, path))
        text = files[unit]
        order = {m.start(): n for n, m in enumerate(re.finditer(r"\\(?:iftag|tagtrue|tagfalse|olimport)\b", text))}
        for at, name, after in plain(text, state)[1]:
            if f"{name}.tex" not in files:
                missing.add(f"{name}.tex")
            else:
                visit(f"{name}.tex", after, (*path, order[at]), above | {key})

    visit("f0.tex", FIRST, (), frozenset())
    units = spark.createDataFrame(list(files.items()), "unit string, content string")
    entry = spark.createDataFrame([("f0.tex", FIRST)], "unit string, tags map<string,boolean>")
    made = tags.unfolded(units, entry)
    rows = sorted(made["instance"].collect(), key=lambda r: r["ordinal"])
    assert [(r["unit"], tuple(r["path"])) for r in rows] == expected and len(expected) > 12
    assert [r["ordinal"] for r in rows] == list(range(1, len(expected) + 1))
    assert all(r["occurrence"] == sum(u == r["unit"] for u, _ in expected[: r["ordinal"]]) for r in rows)
    assert {r["unit"] for r in made["missing"].collect()} == missing
    assert sorted((r["unit"], tuple(r["path"])) for r in made["cyclic"].collect()) == sorted(cyclic) and cyclic


def test_reference_and_citation_macros(spark):
    text = r"\olref{a} \Olref[sec]{b} \olref[f][s]{c}\olref[p][f][s]{d} \cref{x, {y,z} ,} \eqref{e}\Cref{} \tagrefs{big/{k1},small/k2,/no,none, big/{fig:k3}} \olreference{no} \citep*[see~][p.~\label{l} 3]{k1,k2} \cite{k3} \citet[ ]{k4}\citeyearpar[][7]{k5} \cite[open{k6}"
    units = spark.createDataFrame([("u", text, ["p0", "f0", "s0"], {"big": True, "small": False}), ("v", None, None, None)], "unit string, content string, file_id array<string>, tags map<string,boolean>")
    got = sorted((r["start"], r["key"], r["command"]) for r in macros.references(units).collect())
    assert [(k, c) for _, k, c in got] == [("p0:f0:s0:a", "olref"), ("p0:f0:sec:b", "Olref"), ("p0:f:s:c", "olref"), ("p:f:s:d", "olref"), ("x", "cref"), ("y,z", "cref"), ("e", "eqref"), ("fig:k3", "tagrefs"), ("k1", "tagrefs")]
    assert all(text[a:].startswith("\\" + c) for a, _, c in got)
    cited = sorted((r["start"], r["key"], r["command"], r["pinpoint"]) for r in macros.citations(units).collect())
    assert [r[1:] for r in cited] == [("k1", "citep*", "see; p. 3"), ("k2", "citep*", "see; p. 3"), ("k3", "cite", None), ("k4", "citet", None), ("k5", "citeyearpar", "7")]
