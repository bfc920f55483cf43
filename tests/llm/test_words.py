"""Quality, decontamination, SimHash and line dedup against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import xxhash
from lemmaflow.llm import decontaminate, line_dedup, quality, simhash
from pyspark.sql import functions as F

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def key(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_quality(make, nasty):
    rows = [*nasty, (300, "a # b * <c> $%&|\n\na b\n a b\na b\n", None, None)]

    def plain(text):
        found = SPACE.findall(text or "")
        grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        n = Counter(grams)
        inside = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        lines = (text or "").split("\n")
        dup = sum(1 for i, x in enumerate(lines) if SPACE.search(x) and x in set(lines[:i]))
        failed = len(found) < 10 or 100 * len(inside) > 20 * len(found)
        return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed

    got = quality.judge(make(rows, "1 as q")).collect()
    assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == key((r[0], *plain(r[1])) for r in rows)
    assert not any(r.kept for r in got if r.base_failed) and any(r.kept for r in got)
    assert quality.judge(make([])).count() == 0


def test_coverage_and_verdicts_against_plain_loops(make, nasty):
    rows = [(k, r[1]) for k, r in enumerate(nasty)] + [(1000, "a b c d e f g h i j\n" * 3 + " ".join(f"w{k}" for k in range(60))), (1001, "é è ê ë\nx\né è ê ë\n" + " ".join(f"w{k}" for k in range(12)))]

    def plain(text):
        found, lines = SPACE.findall(text or ""), (text or "").split("\n")
        total = max(sum(map(len, found)), 1)
        covered = []
        for n in quality.MOST_COVERED:
            grams = [tuple(found[i : i + n]) for i in range(len(found) - n + 1)]
            times = Counter(grams)
            inside = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + n)}
            covered.append(sum(len(found[j]) for j in inside) / total)
        seen, repeated = set(), 0
        for x in lines:
            repeated += sum(map(len, SPACE.findall(x))) if x in seen else 0
            seen.add(x)
        grams = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
        inside = {j for i, g in enumerate(grams) if Counter(grams)[g] > 1 for j in range(i, i + 5)} if len(grams) < 500 else set()
        failed = len(found) < 10 or 100 * len(inside) > 20 * len(found)
        return covered, repeated / total, failed, not failed and repeated / total <= quality.MOST_LINE_CHARS and all(c <= m for c, m in zip(covered, quality.MOST_COVERED.values()))

    for r in quality.judge(make(rows)).collect():
        text = rows[r.doc_id][1] if r.doc_id < 1000 else next(t for i, t in rows if i == r.doc_id)
        covered, lines, failed, kept = plain(text)
        assert all(abs(x - y) < 1e-9 for x, y in zip(r.coverage, covered)) and abs(r.line_coverage - lines) < 1e-9
        if r.n_words < 500:
            assert (r.base_failed, r.kept) == (failed, kept)


def test_coverage_decides_beyond_the_base_rule(make):
    w = lambda name, n: " ".join(f"{name}{k:03}" for k in range(n))
    rows = [(1, f"{w('a', 12)} {w('b', 100)} {w('a', 12)} {w('c', 76)}"), (2, f"{w('a', 9)} {w('b', 100)} {w('a', 9)} {w('c', 82)}"), (3, w("a", 200))]
    rows.append((4, f"{w('a', 6)} {w('b', 100)} {w('a', 6)} {w('c', 88)}"))
    got = {r.doc_id: r for r in quality.judge(make(rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert abs(got[1].coverage[5] - 0.12) < 1e-9
    assert [got[k].kept for k in (1, 2, 3, 4)] == [False, True, True, True]


def test_decontamination(spark, make, nasty, monkeypatch):
    rows = [*nasty, (300, "One two, THREE four. five six seven eight nine ten eleven!", None, None), (301, "tiny item", None, None), (302, "a tiny item. And a tiny ITEM", None, None)]
    long = nasty[0][1].split()
    items = [(1, " ".join(long[45:70])), (2, "one two three four five six seven eight nine ten"), (3, "tiny item"), (4, None), (5, "..."), (6, "never found words of ten or more in any text here zz"), (10, " ".join(long[50:62])), (None, "tiny"), (3, "and a")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def plain(text):
        found = word.findall(lower(text))
        hit, seen = set(), set()
        for name, item in items:
            own = word.findall(lower(item))
            n = min(10, len(own))
            for w in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ():
                for i in range(len(found) - n + 1):
                    if tuple(found[i : i + n]) == w:
                        hit.update(range(i, i + n))
                        seen.add("" if name is None else str(name))
        return len(found), len(hit), ",".join(sorted(seen)), bool(hit)

    def longest(text):
        found, best = word.findall(lower(text)), 0
        for _, item in items:
            own = word.findall(lower(item))
            for i in range(len(own)):
                for j in range(len(found)):
                    k = 0
                    while i + k < len(own) and j + k < len(found) and own[i + k] == found[j + k]:
                        k += 1
                    best = max(best, k)
        return best

    expected = key((r[0], *plain(r[1])) for r in rows)
    docs = make(rows, "1 as leak")
    far = {(r[0], r[1]): longest(r[1]) for r in rows if r[1] and len(r[1]) < 3000}
    for block in (decontaminate.BLOCK_BYTES, 30):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        found = decontaminate.match(docs, benchmark, "found").collect()
        assert key((r.doc_id, r.found.n_words, r.found.n_hit, ",".join(r.found["items"]), r.found.contaminated) for r in found) == expected
        for r in found:
            assert sum(x.end - x.start for x in r.found.locations) == r.found.n_hit
            if r.found.contaminated and (r.doc_id, r.text) in far:
                assert r.found.longest_match == far[r.doc_id, r.text]
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(1 for r in expected if r[4] == "False")
    assert decontaminate.match(make([]), benchmark).count() == 0
    assert decontaminate.match(docs, benchmark).columns == [*docs.columns, "leak_"]
    assert decontaminate.match(docs, benchmark.limit(0)).where("leak_.contaminated").count() == 0


def test_words_that_repeat_cost_no_pairs():
    from time import time

    began = time()
    queries = decontaminate.Queries([("a", "w " * 5000), ("b", "w"), ("c", "w " * 12 + "x")])
    (n, runs, items, longest), other = decontaminate.search(queries, ["w " * 60_000, "x w x"])
    assert (n, runs, items, longest) == (60_000, [(0, 60_000)], ["a", "b", "c"], 5000)
    assert other == (3, [(1, 2)], ["b"], 2)  # "w x" is the end of the third item
    assert time() - began < 30


def plain_simhash(text):
    found = SPACE.findall(lower(text))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + 4]).encode(), 42) for i in range(max(1, len(found) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    group = {p: {p} for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    return group


def test_simhash(make, nasty, spark):
    docs = make(nasty, "1 as fp")
    expected = [(r[0], plain_simhash(r[1])) for r in nasty]
    group = plain_components({p for _, p in expected})
    least = lambda p: min((i for i, q in expected if q in group[p] and i is not None), default=None)
    got = simhash.group(docs).collect()
    assert key(got) == key((i, f"{p:016x}", least(p)) for i, p in expected)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({id(g) for g in group.values()})
    assert simhash.group(make([])).count() == 0 and simhash.deduplicate(make([])).count() == 0


def test_links_of_large_buckets(spark):
    import random

    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    prints = set()
    for s in seeds:
        for _ in range(60):
            x = s
            for _ in range(rng.randint(0, 7)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    group = plain_components(prints)
    sizes = sorted(len(g) for g in {id(g): g for g in group.values()}.values() if len(g) > 1)
    for most in (1024, 2):
        labels = simhash.components(simhash.links(table, most)).collect()
        assert sorted(Counter(r.label for r in labels).values()) == sizes


def test_every_close_pair_shares_a_table():
    from itertools import combinations

    kept = [m & (1 << 64) - 1 for m in simhash.masks()]
    for bits in combinations(range(0, 64, 3), 4):
        x = sum(1 << b for b in bits)
        assert any(not x & m for m in kept)


def test_line_dedup(make, nasty):
    rows = [*nasty, (400, "a\nb\nc\nd", None, None), (401, "x\na\n\nb\nc\ny", None, None), (402, " ".join(["w"] * 60) + "\nz", None, None), (403, "q\n" + " ".join(["w"] * 60), None, None)]
    rows = [(r[0], r[1].replace(" ", "\n", 40) if r[1] and r[0] and r[0] < 12 else r[1], *r[2:]) for r in rows]
    docs = make(rows, "1 as removed")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    expected = con.sql(line_dedup.OP10_SQL).fetchall()
    marked = line_dedup.mark(docs, "gone")
    text = F.coalesce(line_dedup.kept_text(F.col("text"), F.col("gone")), F.lit(""))
    got = marked.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)), F.size("gone"), F.sha2(text, 256)).collect()
    assert key(got) == key((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in expected)
    kept = line_dedup.deduplicate_lines(docs)
    assert kept.columns == docs.columns
    by_id = {r.doc_id: r for r in kept.collect()}
    assert by_id[401].text == "x\n\ny" and by_id[401].n_chars == 4
    assert by_id[403].text == "q" and by_id[400].text == "a\nb\nc\nd"
    assert line_dedup.deduplicate_lines(make([])).count() == 0


def plain_runs(text):
    """(spots, lines) by definition: the shortest runs of 50 words from each line both ways, and windows of three."""
    lines = [(i, x) for i, x in enumerate((text or "").split("\n")) if SPACE.search(x)]
    runs = {(i, i + 3) for i in range(len(lines) - 2)}
    count = lambda i, j: sum(len(SPACE.findall(x)) for _, x in lines[i:j])
    for i in range(len(lines)):
        runs |= {(i, j) for j in [next((j for j in range(i + 1, len(lines) + 1) if count(i, j) >= 50), None)] if j}
        runs |= {(j, i + 1) for j in [next((j for j in range(i, -1, -1) if count(j, i + 1) >= 50), None)] if j is not None}
    return [([n for n, _ in lines[i:j]], tuple(x for _, x in lines[i:j])) for i, j in runs]


def plain_line_dedup(rows):
    """rows: (id, text) with different ids. The texts without later repeated runs, and without those that have no word left."""
    first, gone = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for spots, unit in sorted(plain_runs(text)):
            if first.setdefault(unit, (doc, spots[0])) != (doc, spots[0]):
                gone.setdefault(doc, set()).update(spots)
    kept = {doc: text if doc not in gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc]) for doc, text in rows}
    return {doc: text for doc, text in kept.items() if doc not in gone or SPACE.search(text)}


def test_line_dedup_of_pairs(make):
    w = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    a, b, c, d = w("a", 23), w("b", 46), w("c", 24), w("d", 25)
    rows = [(1, f"{a}\n{b}"), (2, f"x\n\n{a}\n\n{b}\ny"), (3, f"{b}\n{a}"), (4, f"{c}\n{d}"), (5, f"{c}\n{d}\nz"), (6, f"{a}\n{b}"), (None, f"{a}\n{b}\nlast"), (7, f"{w('l', 60)}\nshort"), (8, f"head\n{w('l', 60)}\nshort")]
    rows += [(20 + k, f"{w('p', 30)}\n{w('q', 30)}\nown {k}") for k in range(300)]
    kept = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(make(rows)).collect()}
    assert kept == plain_line_dedup(rows)
    assert 6 not in kept and kept[2] == "x\n\n\ny" and kept[None] == "last" and kept[5] == f"{c}\n{d}\nz" and kept[8] == "head"
    assert kept[3] == f"{b}\n{a}" and sum(text.startswith("own") for text in kept.values()) == 299


def test_hashes_are_of_the_kept_text():
    assert hashlib.sha256(b"").hexdigest()[:8] == "e3b0c442"


def test_only_selected_lines_become_rows(make):
    lines = [f"line {k * 7919 % 1000} of text" for k in range(1000)]
    docs = make([(1, "\n".join(lines)), (2, "\n".join(["other", *lines[300:303], "lines", *lines[500:502]]))])
    rows = docs.select("doc_id", "text", F.md5("text").alias("key"))
    made = line_dedup.postings(rows).collect()
    of = {d: {r["at"]: len(r["runs"]) for r in made if r["doc_id"] == d} for d in (1, 2)}
    assert len(of[1]) < 700 and sum(of[1].values()) == 998 and min(of[1].values()) >= 1
    one = {r["print"] for r in made if r["doc_id"] == 1}
    assert any(r["print"] in one and 1 <= r["at"] <= 3 for r in made if r["doc_id"] == 2)
    assert {r.doc_id: r.removed for r in line_dedup.mark(docs).collect()} == {1: [], 2: [1, 2, 3]}


def test_items_in_pieces(spark, make, monkeypatch):
    """Long items and many equal ones: every window is found, and no block passes its bound."""
    rng = random.Random(31)
    words = lambda rng, n: " ".join(rng.choice(["ab", "cde", "fghij", "k", "lmnop", "q1"]) + str(rng.randint(0, 60)) for _ in range(n))
    item = words(rng, 900)
    split = item.split()
    docs = make([(k, " ".join(split[7 * k : 7 * k + 10])) for k in range(120)] + [(500, words(rng, 50)), (501, " ".join(split[3:400]))])
    rows = spark.range(3000).select(F.lit("a").alias("item_id"), F.lit(item).alias("text")).unionByName(spark.createDataFrame([("b", None), ("c", ""), ("d", "two words")], "item_id string, text string"))
    whole = {r["doc_id"]: r["leak"] for r in decontaminate.match(docs, rows).collect()}
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 300)
    monkeypatch.setattr(decontaminate, "OVERLAP_BYTES", 60)
    parts = decontaminate.pieces(item, 300, 60)
    assert len(parts) > 15 and max(map(len, parts)) <= 300
    for block in (decontaminate.BLOCK_BYTES, 900):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        items, blocks = decontaminate._blocks(rows)
        sizes = [r["n"] for r in items.groupBy(F.pmod(F.xxhash64("i", "text"), F.lit(blocks)).alias("k")).agg(F.sum(F.length("text")).alias("n")).collect()]
        assert (blocks > 1) == (block == 900) and max(sizes) <= 2 * block + 300
        cut = {r["doc_id"]: r["leak"] for r in decontaminate.match(docs, rows).collect()}
        assert cut.keys() == whole.keys() and all(cut[k]["locations"] == whole[k]["locations"] and cut[k]["items"] == whole[k]["items"] for k in cut)
    assert sum(x["contaminated"] for x in whole.values()) == 121
