from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lemmaflow.llm import suffix_dedup


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    n = suffix_dedup.LENGTH
    seen = Counter(raw[i : i + n] for raw in raws for i in range(len(raw) - n + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - n + 1):
            if seen[raw[i : i + n]] > 1:
                gone[i + 1 : i + n + 1] = True
        runs = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[1 : len(raw) + 1]])
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def compare(docs, rows, **more):
    found = suffix_dedup.deduplicate(docs, **more).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found)
    assert got == sorted((str(r[0]), *b) for r, b in zip(rows, brute([r[1] for r in rows])))


@pytest.mark.parametrize("group_rows", [1024, 2])
def test_equals_brute_force(make, nasty, group_rows):
    rng = random.Random(3)
    rows = [r for r in nasty if r[0] != 207]
    long = "".join(rng.choice("abcd ") for _ in range(900))
    rows += [(300 + k, "".join(rng.choice("xy") for _ in range(rng.randint(0, 300))) + long[rng.randint(0, 450) : rng.randint(500, 900)] + "".join(rng.choice("xy") for _ in range(200)), None, None) for k in range(40)]
    compare(make(rows, "1 as print"), rows, group_rows=group_rows)


def test_no_rows(make):
    assert suffix_dedup.deduplicate(make([])).count() == 0


def test_order_and_common_prefixes():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 6))) + b"q" * rng.choice([0, 5, 90, 100]) + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 5))) for _ in range(300)]
    order, shared = suffix_dedup.deep_shallow(strings)
    ordered = [strings[i] for i in order]
    assert ordered == sorted(strings) and sorted(order) == list(range(300))
    assert shared.tolist() == [suffix_dedup.common_prefix(a, b) for a, b in zip(ordered, ordered[1:])]


def test_anchors_of_pieces(monkeypatch):
    raw = random.Random(2).randbytes(9000)
    whole = [x.tolist() for x in suffix_dedup.anchors(raw)]
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    cut = dict(zip(*[x.tolist() for x in suffix_dedup.anchors(raw)[:2]]))
    assert set(whole[0]) <= set(cut) and all(cut[a] == g for a, g in zip(*whole[:2]))


def test_many_equal_rows_without_id(make):
    rng = random.Random(21)
    text = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    rows = [(None, text)] * 1000 + [(1, text[:300])]
    got = suffix_dedup.deduplicate(make(rows)).collect()
    assert len(got) == 1001 and all(r.n_removed == (6000 if r.doc_id is None else 0) for r in got)
    assert {len(r.spans) for r in got if r.doc_id is None} == {1}
