"""MinHash with odd sketches against plain sets, and against SQL."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from lemmaflow.llm import odd_sketch

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def plain_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows):
    sets = [plain_set(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                top[find(i)] = find(j)
    ids: dict[int, list] = {}
    for k, r in enumerate(rows):
        ids.setdefault(find(k), []).append(r[0])
    out = []
    for k, r in enumerate(rows):
        known = [i for i in ids[find(k)] if i is not None]
        least = min(known) if known else None
        out.append((r[0], len(sets[k]), least, r[0] == least))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def run(docs):
    return order(tuple(r[c] for c in COLUMNS) for r in odd_sketch.group(docs).collect())


@pytest.fixture
def close_texts():
    """Chains and stars of near copies: neighbours are linked, texts further apart are not."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, at = [], 0
    for size in (30, 90, 300):
        base = [word() for _ in range(size)]
        chain = list(base)
        for _ in range(8):
            rows.append((at, " ".join(chain)))
            at += 1
            chain[rng.randrange(size)] = word()
        for _ in range(40):  # each differs from the base in few words, from the others in more
            changed = list(base)
            for _ in range(max(1, size // 75)):
                changed[rng.randrange(size)] = word()
            rows.append((at, " ".join(changed)))
            at += 1
    rng.shuffle(rows)
    return rows


def test_plain(make, nasty, close_texts):
    rows = nasty + [(1000 + i, t, "en", "s1") for i, t in close_texts]
    assert run(make([r[:4] for r in rows], "1 AS fp").repartition(6)) == order(plain(rows))


def test_blocks_and_widths(spark, make, close_texts, monkeypatch):
    """Cells of three sets, and one offer of each set in the first round."""
    monkeypatch.setattr(odd_sketch, "WIDTHS", (1, None))
    small = odd_sketch.cells
    monkeypatch.setattr(odd_sketch, "cells", lambda members, labels, sets, block_rows: small(members, labels, sets, 3))
    assert run(make(close_texts)) == order(plain(close_texts))


def test_only_cells_find_links(spark, make, close_texts, monkeypatch):
    """Without the first links, every pair comes from a cell."""
    monkeypatch.setattr(odd_sketch, "_near", lambda pairs, sets: pairs.limit(0))
    monkeypatch.setattr(odd_sketch, "WIDTHS", (None,))
    assert run(make(close_texts)) == order(plain(close_texts))


def test_every_pair_of_a_bucket_meets_once(spark):
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)]
    members = spark.createDataFrame([(7, f) for f in prints], "key long, fp long")
    labels = spark.createDataFrame([(f, prints[0] if k < 35 else f) for k, f in enumerate(prints)], "node long, label long")
    sets = spark.createDataFrame([(f, 10, [0] * 16, [0] * 32) for f in prints], "fp long, n long, sketch array<long>, whole array<long>")
    dealt = odd_sketch.cells(members, labels, sets, 4).toPandas()
    met = []
    for _, cell in dealt.groupby("cell"):
        assert len(cell) <= 30
        met += [(a, b) for a, la in cell[cell["offers"]][["fp", "label"]].itertuples(index=False) for b, lb in cell[cell["taken"]][["fp", "label"]].itertuples(index=False) if la != lb]
    main = set(prints[:35])
    wanted = {frozenset((a, b)) for a in prints for b in prints if a != b and not (a in main and b in main)}
    assert {frozenset(x) for x in met} == wanted
    assert max(pd.Series([frozenset(x) for x in met]).value_counts()) <= 2


def test_samples_are_fair():
    """Samples agree as often as sets do, about as spread as independent draws; bitmaps keep to their bound."""
    rng = np.random.default_rng(9)
    for share in (0.85, 0.6):
        agreed = []
        for _ in range(300):
            n = int(rng.integers(20, 900))
            common = round(share * n)
            rest = (n - common) // 2
            x = rng.integers(-(1 << 62), 1 << 62, common + 2 * rest)
            a, b = x[: common + rest], np.concatenate((x[:common], x[common + rest :]))
            s, t = odd_sketch.samples(a), odd_sketch.samples(b)
            real = common / len(x)
            same = int((s == t).sum())
            agreed.append((same - 240 * real) / (240 * real * (1 - real)) ** 0.5)
            one, two = odd_sketch.odd_sketch(np.stack((s, t))).view(np.uint64)
            bits = int(np.bitwise_count(one ^ two).sum())
            one, two = odd_sketch.whole_sketch([a, b]).view(np.uint64)
            assert bits <= 2 * (240 - same) and np.bitwise_count(one ^ two).sum() <= 2 * rest
            if real >= 0.85:
                keys = odd_sketch.band_keys(np.stack((s, t)))
                assert bits <= odd_sketch.MOST_BITS and set(keys[0]) & set(keys[1])
        assert abs(np.mean(agreed)) < 0.25 and np.std(agreed) < 1.25


def test_empty_table(make):
    assert run(make([])) == []


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.sql(odd_sketch.OP12_SQL).project(", ".join(COLUMNS)).fetchall()
    got = odd_sketch.op12_odd_sketch(spark, SF)
    assert order(tuple(r[c] for c in COLUMNS) for r in got.collect()) == order(expected)
