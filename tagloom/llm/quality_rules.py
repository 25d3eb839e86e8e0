"""Quality rules from a suffix array: repeated text inside each document.

Every document becomes a sequence of units, its words.  The suffixes of some
documents, about BATCH_UNITS units, are sorted together by prefix doubling; the
first unit's key holds the document, so suffixes of two documents never compare
equal and one vectorised sort serves them all.  Texts leave their Arrow batch one
by one, so a task holds its batch and the words of those documents, whatever the
batch's size.  Neighbours in the order give
the longest common prefixes, so for every position the length of the longest
substring that starts there and occurs again.  The union of those maximal
repeats is the covered part of the text; its fraction and the longest repeat are
limited.

A word is one unit however long it is.  Repeats of characters inside and between
overlong words, which texts without spaces consist of, are measured by themselves:
as their share of all characters of the text.  ``covered`` is the larger share.

Nothing is shuffled: a document is judged where it is read.

Defined cases: a null text has no words; a text without words has zero counts
and fails the rules; rows are judged one by one, so equal rows get equal
results; an empty table gives an empty table; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Repeats shorter than this many units are ordinary language.
MIN_REPEAT = 8
#: A document is rejected if repeats cover more than this share of its units.
MAX_COVERED = 0.25
#: A document is rejected if a repeat is longer than this many units.
MAX_LONGEST = 120
#: Words of more code points are searched for repeated characters too.
LONG_WORD = 64
#: Base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20

# Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
# The separators of words.
SPACES = b" \t\n\x0b\x0c\r"
#: Units sorted together at most, unless one document is longer.
BATCH_UNITS = 50_000

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered double, longest_repeat long"
)


def longest_repeats(codes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each unit the length of the longest substring of its document that starts there and occurs again.

    ``codes`` are unit codes, ``docs`` the non-decreasing document numbers.
    """
    n = len(codes)
    result = np.zeros(n, np.int64)
    if n < 2:
        return result
    ends = np.searchsorted(docs, docs, side="right")
    first = docs.astype(np.int64) * (int(codes.max()) + 1) + codes
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int32)  # one is kept for each doubling
    ordered = first[order]
    starts = np.r_[True, ordered[1:] != ordered[:-1]]
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    ranks, step = [rank], 1
    active = _tied(rank, np.arange(n))
    while len(active):
        ahead = active + step
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        a, s = rank[active][by], second[by]
        at = np.arange(len(by))
        group = np.maximum.accumulate(np.where(np.r_[True, a[1:] != a[:-1]], at, 0))
        part = np.maximum.accumulate(np.where(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])], at, 0))
        rank = rank.copy()
        rank[active[by]] = a + part - group
        active = _tied(rank, active)
        ranks.append(rank)
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    same = np.flatnonzero(ranks[0][suffixes[1:]] == ranks[0][suffixes[:-1]])
    left, right = suffixes[same], suffixes[same + 1]
    common = np.zeros(len(same), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        p, q = left + common, right + common
        inside = (p < ends[left]) & (q < ends[right])
        equal = inside & (ranks[level][np.minimum(p, n - 1)] == ranks[level][np.minimum(q, n - 1)])
        common += np.where(equal, 1 << level, 0)
    np.maximum.at(result, left, common)
    np.maximum.at(result, right, common)
    return result


def _tied(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Positions of ``among`` whose rank another one shares."""
    r = rank[among]
    return among[np.bincount(r, minlength=len(rank))[r] > 1]


def repeat_spans(length: np.ndarray, docs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of all repeats of at least ``least`` units."""
    begin = np.flatnonzero(length >= least)
    if not len(begin):
        return begin, begin
    reach = np.maximum.accumulate(begin + length[begin])
    new = np.r_[True, (begin[1:] > reach[:-1]) | (docs[begin[1:]] != docs[begin[:-1]])]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(begin) - 1]
    return begin[new], reach[last]


def covered_by_windows(length: np.ndarray, docs: np.ndarray, window: int, n_docs: int) -> np.ndarray:
    """Units per document inside windows of a fixed length that occur twice or more."""
    start, end = repeat_spans(np.where(length >= window, window, 0), docs, window)
    return np.bincount(docs[start], end - start, n_docs).astype(np.int64) if len(start) else np.zeros(n_docs, np.int64)


def _repeats(sequences: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest repeats of many documents' units, the documents' numbers and lengths."""
    counts = np.fromiter(map(len, sequences), np.int64, len(sequences))
    docs = np.repeat(np.arange(len(sequences)), counts)
    codes, _ = pd.factorize(np.fromiter(chain.from_iterable(sequences), object, int(counts.sum())))
    return longest_repeats(codes, docs), docs, counts


def _covered(sequences: list[list], min_repeat: int):
    length, docs, counts = _repeats(sequences)
    start, end = repeat_spans(length, docs, min_repeat)
    covered = np.bincount(docs[start], end - start, len(sequences)) if len(start) else np.zeros(len(sequences))
    longest = np.zeros(len(sequences), np.int64)
    np.maximum.at(longest, docs, length)
    windows = covered_by_windows(length, docs, WINDOW, len(sequences))
    return covered / np.maximum(counts, 1), longest, windows


def _long_characters(words: list[bytes]) -> list:
    """The characters of the overlong words, each word ended by a number of its own."""
    out: list = []
    for i, w in enumerate(words):
        text = w.decode()
        if len(text) > LONG_WORD:
            out += [*text, i]
    return out


def measure_texts(texts: Iterable[str | None], min_repeat: int = MIN_REPEAT) -> pd.DataFrame:
    """The measures of some texts; see MEASURES."""
    parts, group, size = [], [], 0
    for text in texts:
        raw = (text or "").encode()
        group.append(raw)
        size += len(raw) // 6
        if size > BATCH_UNITS:
            parts.append(_measure(group, min_repeat))
            group, size = [], 0
    if group or not parts:
        parts.append(_measure(group, min_repeat))
    return pd.concat(parts, ignore_index=True)


def _measure(raws: list[bytes], min_repeat: int) -> pd.DataFrame:
    words = [raw.split() for raw in raws]
    covered, longest, windows = _covered(words, min_repeat)
    chars = [len(raw.decode()) - sum(raw.count(c) for c in SPACES) for raw in raws]
    long = [i for i, ws in enumerate(words) if ws and len(max(ws, key=len)) > LONG_WORD]
    if long:
        units = [_long_characters(words[i]) for i in long]
        own, _, _ = _covered(units, min_repeat)
        for i, share, within in zip(long, own, units):
            covered[i] = max(covered[i], share * len(within) / chars[i])
    lines = [[line for line in raw.split(b"\n") if line.strip()] for raw in raws]
    columns = {
        "n_words": [len(ws) for ws in words],
        "word_chars": chars,
        "n_symbols": [len(raw) - len(raw.translate(None, SYMBOLS)) for raw in raws],
        "n_dup_lines": [len(ls) - len(set(ls)) for ls in lines],
        "n_repeat_words": windows,
        "covered": covered,
        "longest_repeat": longest,
    }
    return pd.DataFrame(columns)


def measure_array(texts: pa.Array, min_repeat: int = MIN_REPEAT) -> pa.StructArray:
    """The measures of an Arrow array of texts, of which one at a time is a Python string."""
    measures = measure_texts((t.as_py() for t in texts), min_repeat)
    columns = [pa.array(measures[f.split()[0]], {"long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in MEASURES.split(", ")]
    return pa.StructArray.from_arrays(columns, names=[f.split()[0] for f in MEASURES.split(", ")])


def repetition_measures(text: Column | str, min_repeat: int = MIN_REPEAT) -> Column:
    """A struct of the measures of a text."""

    @F.arrow_udf(MEASURES)
    def measure(texts: pa.Array) -> pa.Array:
        return measure_array(texts, min_repeat)

    return measure(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def judge(
    docs: DataFrame,
    text: str = "text",
    *,
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
    into: str = "rules",
) -> DataFrame:
    """``docs`` with a struct ``into``: the measures, ``base_failed`` and ``kept``."""
    m = F.col(into)
    failed = base_failed(m)
    kept = ~failed & (m["covered"] <= max_covered) & (m["longest_repeat"] <= max_longest)
    measured = docs.withColumn(into, repetition_measures(F.col(text), min_repeat))
    return measured.withColumn(into, m.withField("base_failed", failed).withField("kept", kept))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass the rules, with their own columns."""
    into = "rules"
    while into in docs.columns:
        into += "_"
    return judge(docs, text, into=into).where(F.col(into)["kept"]).drop(into)
