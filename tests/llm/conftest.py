from __future__ import annotations

import random
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """A documents table from (doc_id, text[, lang, source])."""

    def build(rows, extra: str = ""):
        full = [(*r, *(None,) * (4 - len(r)), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.selectExpr("*", *([extra] if extra else []))

    return build


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    pool = random.Random(5)
    known = ["".join(pool.choice(string.ascii_lowercase) for _ in range(pool.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(known) for _ in range(n))


@pytest.fixture
def nasty():
    """Texts with nulls, empties, repeats, near copies, long and non-ASCII texts."""
    rng = random.Random(11)
    texts = [words(rng, rng.randint(1, 200)) for _ in range(60)]
    passage = words(rng, 90)
    for k in range(12):
        texts[k] = words(rng, 40) + " " + passage + " " + words(rng, 30)
    rows = [(k, t, "en", f"s{k % 4}") for k, t in enumerate(texts)]
    rows += [(100 + k, texts[k % 3], "en", None) for k in range(8)]  # exact copies
    rows += [(120 + k, texts[20] + f" {k}", "de", "s9") for k in range(6)]  # near copies
    rows += [(5, texts[5], "en", "s1"), (5, texts[5], "en", "s1")]  # repeated rows
    rows += [(None, texts[7], None, "s1"), (None, None, None, None), (200, None, "en", "s0"), (201, "", "en", "s0"), (202, " \n\t ", "en", "s0"), (203, "é" * 500 + " ñandú 漢字 " * 60, "fr", "s2")]
    rows += [(204, "ab" * 3000, "en", "s2"), (205, "\n".join(["same line of words here"] * 20), "en", "s2"), (206, "x\x00y " + texts[30][:200], "en", "s2")]
    rows.append((207, words(rng, 30_000), "en", "s3"))
    return rows
