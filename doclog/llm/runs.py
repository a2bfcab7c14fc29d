"""Periodic runs: stretches of words that repeat themselves at once, found by a sparse dynamic program over diagonals.

A diagonal is a lag q; its match length at word i is the number of words in a row, up to i, that equal the word q before them. A run
with period q and n words is a match of n - q on diagonal q that no neighbour extends. A task takes the texts of a batch as one
sequence of numbers, a word having another number in each text, so that no match crosses.

Lags below DENSE are compared word by word. A longer diagonal q counts only once q words in a row match, so for lags from k to 2k - 1
(k = 12, 24, 48 ...) it is the earlier occurrences of the last k words, not of one word, that lengthen diagonals; words whose last k
words come once in their text are left out for all longer lags. Words come in order and in blocks: what a block leaves active is
carried on, and a diagonal that ends is judged at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lags that are compared word by word, and the fewest words of a run.
DENSE = LEAST = 12
#: Words, and pairs of occurrences, that a task looks at together; a text is never parted.
WORDS, PAIRS = 1 << 18, 1 << 20


class Run(NamedTuple):
    start: int
    length: int
    period: int


class _Found:
    """Periods of runs by their first and last word. Of a stretch's periods the smallest counts, and that one is found first."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}

    def add(self, first: np.ndarray, last: np.ndarray, period: np.ndarray) -> None:
        good = last - first + 1 >= np.maximum(LEAST, 2 * period)
        for s, e, q in zip(first[good].tolist(), last[good].tolist(), period[good].tolist(), strict=True):
            self.period.setdefault((s, e), q)

    def starts(self, n: int, k: int) -> np.ndarray:
        """For each word the first word of the run, of a period up to k / 2, that holds its last k words; else -1."""
        out = np.full(n, -1)
        for (s, e), q in self.period.items():
            if 2 * q <= k <= e - s + 1:
                out[s + k - 1 : e + 1] = s
        return out


def _stretches(rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of numbers without a gap."""
    gap = np.flatnonzero(np.diff(rising) != 1)
    return rising[np.concatenate([[0], gap + 1])[: len(rising)]], rising[np.concatenate([gap, [len(rising) - 1]])[: len(rising)]]


def _again(n: int, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of equal keys, for each of `n` words (-1: not among `at`, or its key comes once), and the words that have one."""
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    more = count[which] > 1
    out = np.full(n, -1)
    out[at[more]] = which[more]
    return out, at[more]


def _joined(cls: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the pairs of classes `shift` words before and at each word of `at`."""
    at = at[at >= shift]
    at = at[cls[at - shift] >= 0]
    return _again(len(cls), at, cls[at - shift] * len(cls) + cls[at])


def _short_lags(found: _Found, cls: np.ndarray) -> None:
    for q in range(1, min(DENSE, len(cls))):
        hit = np.flatnonzero((cls[q:] == cls[:-q]) & (cls[q:] >= 0))
        first, last = _stretches(hit)
        found.add(first, last + q, np.full(len(first), q))


def _long_lags(found: _Found, cls: np.ndarray, at: np.ndarray, k: int) -> None:
    """Diagonals k to 2k - 1. `cls` has the class of each word's last k words, `at` the words that have one, in order."""
    n = len(cls)
    held = np.sort(cls[at] * n + at)
    # inside a run of a short period, lags are multiples of that period and have no runs of their own: look before that run only
    run = found.starts(n, k)[at]
    nearest = np.where(run >= 0, np.maximum(k, at - k - run + 2), k)
    low = np.searchsorted(held, cls[at] * n + np.maximum(at - 2 * k + 1, 0))
    many = np.maximum(np.searchsorted(held, cls[at] * n + np.maximum(at - nearest + 1, 0)) - low, 0)
    at, low, many = at[many > 0], low[many > 0], many[many > 0]
    ended = lambda lag, first, last: found.add(first - k + 1 - lag, last, lag)
    lags = firsts = np.empty(0, np.int64)  # active diagonals and the first word of each one's matches, which reach the word `upto`
    upto, begin, cut = -2, 0, np.cumsum(many)
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(cut, (cut[begin - 1] if begin else 0) + PAIRS, "right")))
        here, each = at[begin:end], many[begin:end]
        word = np.repeat(here, each)
        earlier = held[np.arange(len(word)) + np.repeat(low[begin:end] - np.cumsum(each) + each, each)] % n
        first, last = _stretches(np.sort((word - earlier) * n + word))
        lag, first, last = first // n, first % n, last % n
        on = np.flatnonzero(first == here[0]) if here[0] == upto + 1 else np.empty(0, np.int64)
        goes = np.isin(lags, lag[on])
        ended(lags[~goes], firsts[~goes], np.full((~goes).sum(), upto))
        first[on[np.searchsorted(lag[on], lags[goes])]] = firsts[goes]
        upto, begin = int(here[-1]), end
        open_ = last == upto
        ended(lag[~open_], first[~open_], last[~open_])
        lags, firsts = lag[open_], first[open_]
    ended(lags, firsts, np.full(len(lags), upto))


def runs_of(texts: list[list[str]]) -> list[list[Run]]:
    """Runs of each sequence of words, by start, then period: the words that no neighbour extends, with their smallest period, at least LEAST and two periods long."""
    sizes = [len(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out: list[list[Run]] = [[] for _ in texts]
    n = int(bounds[-1])
    if n < LEAST:
        return out
    codes = pd.factorize(pd.Series([w for t in texts for w in t], dtype=object))[0].astype(np.int64)
    found = _Found()
    cls, at = _again(n, np.arange(n), np.repeat(np.arange(len(texts)), sizes) * (int(codes.max()) + 1) + codes)
    _short_lags(found, cls)
    for shift in (1, 2, 4, 4):  # the last 2, 4, 8 and 12 words
        cls, at = _joined(cls, at, shift)
    k = DENSE
    while len(at):
        _long_lags(found, cls, at, k)
        cls, at = _joined(cls, at, k)
        k *= 2
    for (s, e), q in found.period.items():
        text = int(np.searchsorted(bounds, s, "right")) - 1
        out[text].append(Run(s - int(bounds[text]), e - s + 1, q))
    for runs in out:
        runs.sort(key=lambda r: (r.start, r.period))
    return out


def without_repeats(words: list[str], runs: list[Run]) -> list[str]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        gone[r.start + r.period] += 1
        gone[r.start + r.length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, alter: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, from 0 on, in order) and the text without its repeats, words joined by
    blanks, of each row of `docs` (doc_id, text); other columns are left out.

    A null text has no words. Rows stand for themselves, so repeated ids and copies are no matter. `alter` gets a row's id and words
    and gives the words to look at. A task holds the words of a batch, or of one text where that is longer.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[list[str]] = []
        size = 0

        def told() -> pa.RecordBatch:
            runs = runs_of(texts)
            kept = [" ".join(without_repeats(t, r)) for t, r in zip(texts, runs, strict=True)]
            spans = [[r._asdict() for r in x] for x in runs]
            kind = pa.list_(pa.struct([(name, pa.int64()) for name in Run._fields]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        for batch in rows:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = WORD.findall(text.as_py() or "")
                ids.append(doc_id)
                texts.append(alter(doc_id, words) if alter else words)
                size += len(texts[-1])
                if size >= WORDS:
                    yield told()
                    ids, texts, size = [], [], 0
        if ids:
            yield told()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(batches), SCHEMA)
