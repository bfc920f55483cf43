"""Operator 8, quality rules: repetition coverage.

Words become 64-bit rolling hashes; windows of several lengths are combined from them
in numpy, and the characters inside windows that occur twice or more in the text are
measured, as are the characters of lines that repeat an earlier line. One task reads
one text at a time; nothing is shuffled.

Defined cases: null and empty texts have no words and fail; a document is judged alone,
so copies and repeated rows are judged alike; a line without a word never counts as a
repeated line; a text is always read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .common import table

BASE_WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of words in repeated base windows
#: window length in words: largest share of word characters inside repeated windows
MOST_COVERED = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: largest share of word characters in lines that repeat an earlier line
MOST_LINE_CHARS = 0.30
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_coverage double, coverage array<double>, base_failed boolean, kept boolean"
_PIECE = 1 << 20


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, characters and starts of the words; long texts in pieces cut between words."""
    hashes, chars, places, at = [], [], [], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and rolling.NOT_SPACE[data[end]]:
            end += 1
        piece = data[at:end]
        starts, ends = rolling.word_bounds(piece, rolling.NOT_SPACE)
        hashes.append(rolling.span_hashes(rolling.prefix_sums(piece), starts, ends))
        points = np.concatenate(([0], np.cumsum((piece & 0xC0) != 0x80)))
        chars.append(points[ends] - points[starts])
        places.append(starts + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(chars), np.concatenate(places)


def repeated_words(hashes: np.ndarray, n: int) -> np.ndarray:
    """True for each word inside a window of ``n`` words that occurs twice or more."""
    windows = rolling.combine(hashes, n)
    inside = np.zeros(len(hashes) + 1, np.int64)
    if len(windows) > 1:
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        again = np.zeros(len(windows), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = np.flatnonzero(again)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + n, -1)
    return np.cumsum(inside[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The columns of _SCHEMA for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    hashes, chars, places = _words(data)
    n_words, word_chars = len(hashes), int(chars.sum())

    seen: set[bytes] = set()
    n_dup_lines, dup_chars, at = 0, 0, 0
    sums = np.concatenate(([0], np.cumsum(chars)))
    for line in raw.split(b"\n"):
        end = at + len(line)
        if line in seen:
            first, last = np.searchsorted(places, (at, end))
            if last > first:
                n_dup_lines += 1
                dup_chars += int(sums[last] - sums[first])
        seen.add(line)
        at = end + 1

    inside = {n: repeated_words(hashes, n) for n in {BASE_WINDOW, *MOST_COVERED}}
    n_repeat = int(inside[BASE_WINDOW].sum())
    coverage = [float(chars[inside[n]].sum() / max(word_chars, 1)) for n in MOST_COVERED]
    line_coverage = dup_chars / max(word_chars, 1)
    base_failed = n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words
    kept = not base_failed and line_coverage <= MOST_LINE_CHARS and all(c <= most for c, most in zip(coverage, MOST_COVERED.values()))
    return n_words, word_chars, int(_SYMBOLS[data].sum()), n_dup_lines, n_repeat, line_coverage, coverage, base_failed, kept


def repetition(text: Column) -> Column:
    """A struct of the measures and verdicts for a text column."""

    @F.pandas_udf(_SCHEMA)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(x) for x in texts], columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    return measured(text)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and the measures and verdicts for each row of ``docs``."""
    return docs.select("doc_id", repetition(F.col("text")).alias("q")).select("doc_id", "q.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_coverage"]
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *columns)
