"""The pipeline's near dedup against all pairs of shingle sets."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from lemmaflow.llm import near_dedup, simhash

from test_words import SPACE, key, lower


def plain_shingles(text):
    found = SPACE.findall(lower(text))
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def plain_kept(rows):
    places = sorted({(r[0] is None, r[0] or 0, near_key(r[1])): r for r in rows}.items())
    sets = [plain_shingles(r[1]) for _, r in places]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [(places[x][1][0], places[x][1][1]) for x in sorted(set(label))]


def near_key(text):
    import hashlib

    return hashlib.md5((text or "").encode()).digest()


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def sample(rng):
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(6, 160))) for _ in range(40)]
    texts = base + [changed(rng, rng.choice(base), rng.randint(1, 5)) for _ in range(120)]
    shared = " ".join(f"s{k}" for k in range(40))
    texts += [f"{shared} {' '.join(f'x{rng.randrange(10**6)}' for _ in range(rng.randint(5, 14)))}" for _ in range(60)]
    texts += [base[3], base[3].upper(), base[3].replace(" ", "\n"), "", " \n", "few words", "Few  words"]
    return texts


def test_near_dedup(make, nasty, monkeypatch):
    rng = random.Random(8)
    rows = [*nasty, *[(1000 + k, t) for k, t in enumerate(sample(rng))]]
    rows += [(1003, "another text under the same id as one that is a copy of others"), (1043, "and one more text of its own under an id")]
    docs = make(rows, "1 as kept_id")
    expected = key(plain_kept(rows))
    for limit in (near_dedup.FREQUENT, 0):
        monkeypatch.setattr(near_dedup, "FREQUENT", limit)
        kept = corpus_pipeline.one_of_each_group(None, docs, "")
        assert kept.columns == docs.columns
        assert key((r.doc_id, r.text) for r in kept.collect()) == expected
    assert corpus_pipeline.one_of_each_group(None, make([]), "").count() == 0


def test_pairs_beyond_four_bits(make):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    far = next(x for x in iter(lambda: changed(rng, text, 2), None) if (simhash.fingerprint(x) ^ simhash.fingerprint(text)).bit_count() > 6)
    a, b = plain_shingles(text), plain_shingles(far)
    assert 0.8 <= len(a & b) / len(a | b) < 1
    kept = corpus_pipeline.one_of_each_group(None, make([(1, text), (2, far)]), "").collect()
    assert Counter(r.doc_id for r in kept) == {1: 1}


def test_a_passage_is_one_bucket(spark):
    sets = [(10, 40, [7, 1, 2, 3, 5]), (20, 41, [1, 2, 3, 5]), (20, 41, [1, 2, 3, 5]), (30, 42, [8, 5]), (40, 43, [9])]
    met = near_dedup.meets(spark.createDataFrame(sets, "fp long, size int, prefix array<long>")).collect()
    assert sorted((r.h, r.fp, r.size, r.at, r.first, r.first_size, r.first_at) for r in met) == [(1, 10, 40, 1, 10, 40, 1), (1, 20, 41, 0, 10, 40, 1), (5, 10, 40, 4, 10, 40, 4), (5, 20, 41, 3, 10, 40, 4), (5, 30, 42, 1, 10, 40, 4)]


def test_parities_lose_no_similar_pair(spark):
    rng = random.Random(4)
    rows, similar, apart = [], [], []
    for n in (1, 5, 9, 70, 700, 3000):
        for k in (0, 1, n // 10, n // 9, n // 8, n // 2, n):
            a = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
            b = a[k:] + [rng.randrange(-(2**63), 2**63) for _ in range(k)]
            similar.append(5 * (n - k) >= 4 * (n + k))
            apart.append(k >= n // 2 and 70 <= n <= 700)
            rows.append((n, *(near_dedup.parities(np.unique(np.array(x, np.int64))).tolist() for x in (a, b))))
    pairs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n int, a array<long>, b array<long>")
    near = [r.near for r in pairs.select("k", near_dedup.near_parities("n", "a", "n", "b").alias("near")).orderBy("k").collect()]
    assert all(found for found, must in zip(near, similar) if must) and any(similar)
    assert not any(found for found, far in zip(near, apart) if far) and any(apart)
