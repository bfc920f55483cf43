"""Alignment of two tokenizers against plain loops over another library's tokens."""

from __future__ import annotations

import hashlib
from collections import Counter
from pathlib import Path

import pytest
import sentencepiece
from lemmaflow.llm import token_align
from tokenizers import Tokenizer


def plain_tokens():
    one = Tokenizer.from_file(token_align.BYTE_BPE)
    one.encode_special_tokens = True
    letters = {**{chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in letters)}
    two = sentencepiece.SentencePieceProcessor(model_file=token_align.PIECE_BPE)

    def piece(k):
        name = two.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if name.startswith("<0x") else name.replace("▁", " ").encode()

    def both(text):
        a = [(k, bytes(letters[c] for c in one.id_to_token(k))) for k in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(k, piece(k)) for k in two.encode(text)]
        raw = (" " + text).encode()
        return (a, b) if text and all(b"".join(p for _, p in x) == raw for x in (a, b)) else ([], [])

    return both


def spans(tokens):
    at = 0
    for k, piece in tokens:
        yield k, at, at + len(piece)
        at += len(piece)


def plain(rows):
    both, texts = plain_tokens(), []
    for doc_id, text in rows:
        a, b = (list(spans(x)) for x in both(text or ""))
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        parts, start = [], 0
        for cut in cuts:
            parts.append([(start, cut), [k for k, x, y in a if start <= x and y <= cut], [k for k, x, y in b if start <= x and y <= cut]])
            start = cut
        links = [(p, q) for p, x, y in a for q, u, v in b if x < v and u < y]
        texts.append((doc_id, len(a), len(b), parts, links))
    counts = Counter(pair for t in texts for pair in set(t[4]))
    highest = Counter()
    for (p, _), n in counts.items():
        highest[p] = max(highest[p], n)
    out = []
    for doc_id, n_a, n_b, parts, links in texts:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, x, y in parts)
        digest = hashlib.sha256(written.encode()).hexdigest() if parts else ""
        out.append((doc_id, n_a, n_b, len(parts), len(links), sum(counts[x] == highest[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return out, counts, texts


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["<|endoftext|> <s> </s> <unk>", "a▁b", "x\x00y", " ", "  two  spaces\n\n\ttabs ", "漢字かな \U0001f600\U0001f468‍\U0001f469 ﬁ ñ", "é  x", "<0x41>", "1234567 98.76", "don't  'S", "﻿x\r\n"]


@pytest.fixture
def rows(nasty):
    short = [(r[0], r[1] if r[1] is None else r[1][:2500]) for r in nasty]
    return short + [(300 + k, x) for k, x in enumerate(ODD)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("chunk", [token_align.CHUNK_BYTES, 3000])
def test_scored(spark, make, rows, monkeypatch, chunk):
    if chunk == 3000:  # several streams and chunks in a task
        docs = make(rows, "1 AS chunk").coalesce(2)
        small = token_align._streams
        monkeypatch.setattr(token_align, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(token_align, "_streams", lambda batches: small(batches, 1000))
    else:
        docs = make(rows, "'x' AS pairs").repartition(5)
    got = token_align.scored(docs)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert order(tuple(r[c] for c in COLUMNS) for r in got.collect()) == order(plain(rows)[0])


def test_pair_counts_and_groups(spark, make, rows):
    _, counts, texts = plain(rows)
    docs = make(rows)
    assert {(r["a"], r["b"]): r["documents"] for r in token_align.pair_counts(docs).collect()} == dict(counts)
    got = [(r["doc_id"], [[(g["start"], g["end"]), g["a"], g["b"]] for g in r["groups"]]) for r in token_align.groups(docs).collect()]
    assert sorted(got, key=repr) == sorted(((t[0], t[3]) for t in texts), key=repr)


def test_long_text_and_one_word(spark, make):
    """Texts of a megabyte, one of them without a space."""
    found = {r["doc_id"]: r for r in token_align.scored(make([(1, "word " * 200_000), (2, "ab" * 30_000), (3, "word " * 10)])).collect()}
    assert found[1]["n_groups"] == found[1]["n_a"] == found[1]["n_links"]
    assert found[2]["n_a"] > 0 and found[3]["n_a"] == 11


def test_empty_table_and_file(spark, make, tmp_path):
    assert token_align.scored(make([])).collect() == []
    copy = tmp_path / "other.json"
    copy.write_bytes(Path(token_align.BYTE_BPE).read_bytes())
    assert token_align.pair_counts(make([(1, "some words")]), byte_bpe=str(copy)).count() > 0
