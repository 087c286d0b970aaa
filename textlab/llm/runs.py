"""Runs of repeated words by the dictionary of basic factors.

A basic factor is a stretch of 2**k words. Level by level every position gets the name of
the factor that starts there: equal names, equal words; the name of a factor is that of its
two halves. The next occurrence of a factor, if it is at most twice its length away,
proposes its distance as a period; occurrences in arithmetic progression propose the same
one and are taken together. A proposal is extended to both sides as long as words that far
apart are equal, and what several levels found is kept once.

Every run with period q and at least three repetitions is proposed: at the level whose
factor length lies in [q, 2q) the factor at its start occurs again q words later and, as q
is the smallest period, not before. Only positions whose factor occurs elsewhere in their
document go on to the next level, so most texts end after a few levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textlab.llm.common import bounded_batches

MIN_WORDS = 24
MIN_REPEATS = 3
# Texts handled together, and the piece of a text that is split at a time, in bytes.
_TOGETHER = 1 << 20
# Rounds in which all proposals grow by one word; what then still grows is left to `_reach`.
_ROUNDS = 32

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
NEW = [T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("best_run", RUN),
       T.StructField("collapsed", T.StringType())]


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of the words of all texts, where each text starts (and the end), and the word
    of every number. Words are split at space, tab, LF, VT, FF and CR, as ``bytes.split``
    does; long texts are split piece by piece, so only numbers are kept for all words."""
    numbers: dict[bytes, int] = {}
    parts, starts = [np.zeros(0, np.int64)], [0]
    for text in texts:
        at, n = 0, 0
        while at < len(text):
            to = at + _TOGETHER
            while to < len(text) and text[to] not in b" \t\n\v\f\r":
                to += 1
            words = text[at:to].split()
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words),
                                     np.int64, len(words)))
            n += len(words)
            at = to
        starts.append(starts[-1] + n)
    return np.concatenate(parts), np.array(starts), list(numbers)


def proposals(codes: np.ndarray, starts: np.ndarray, repeats: int = MIN_REPEATS) -> Iterator[tuple]:
    """Per level ``low, high, period`` of the stretches in which words ``period`` apart are
    known to be equal: ``codes[x] == codes[x + period]`` for low <= x < high."""
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(codes))
    name = owner * (int(codes.max(initial=0)) + 1) + codes
    longest = int(sizes.max(initial=0)) // repeats  # no longer period has enough repetitions
    names = np.empty(len(codes), np.int64)
    half = 1
    while len(at) and half < 2 * longest:
        order = np.argsort(name, kind="stable")
        place, sorted_names = at[order], name[order]
        same = sorted_names[1:] == sorted_names[:-1]
        gap = place[1:] - place[:-1]
        near = same & (gap <= 2 * half)
        if near.any():
            yield _progressions(place[:-1][near], gap[near], half)
        # Factors that occur once in their document are done.
        again = np.zeros(len(at), bool)
        again[1:] = same
        again[:-1] |= same
        names.fill(-1)
        names[place[again]] = (np.cumsum(np.concatenate(([True], ~same))) - 1)[again]
        at = at[names[at] >= 0]
        at = at[at + 2 * half <= starts[owner[at] + 1]]
        at = at[names[at + half] >= 0]
        name = names[at] * (len(codes) + 1) + names[at + half]
        half *= 2


def _progressions(place: np.ndarray, gap: np.ndarray, half: int):
    """Occurrences with the same distance to the next one whose factors touch."""
    order = np.lexsort((place, gap))
    place, gap = place[order], gap[order]
    new = np.ones(len(place), bool)
    new[1:] = (gap[1:] != gap[:-1]) | (place[1:] - place[:-1] > half)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return place[first], place[last] + half, gap[first]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal leading elements of two views of one length, read in growing pieces."""
    at, step = 0, 64
    while at < len(a):
        unequal = a[at : at + step] != b[at : at + step]
        if unequal.any():
            return at + int(unequal.argmax())
        at, step = at + step, step * 2
    return len(a)


def runs_of(
    codes: np.ndarray, starts: np.ndarray, least: int = MIN_WORDS, repeats: int = MIN_REPEATS
) -> np.ndarray:
    """All runs as rows ``text, start, length, period``, by text, start and period: maximal
    stretches of at least ``least`` words whose smallest period fits in ``repeats`` times
    (three or more)."""
    if repeats < 3:
        raise ValueError("repeats must be 3 or more")
    found: dict[tuple[int, int], int] = {}
    covered: dict[int, list[tuple[int, int]]] = {}
    for low, high, period in proposals(codes, starts, repeats):
        text = np.searchsorted(starts, low, "right") - 1
        begin, end = starts[text], starts[text + 1]
        low, high = low.copy(), high.copy()
        grow_l = grow_r = np.arange(len(low))
        for _ in range(_ROUNDS):
            grow_l = grow_l[low[grow_l] > begin[grow_l]]
            grow_l = grow_l[codes[low[grow_l] - 1] == codes[low[grow_l] - 1 + period[grow_l]]]
            low[grow_l] -= 1
            grow_r = grow_r[high[grow_r] + period[grow_r] < end[grow_r]]
            grow_r = grow_r[codes[high[grow_r]] == codes[high[grow_r] + period[grow_r]]]
            high[grow_r] += 1
            if not len(grow_l) and not len(grow_r):
                break
        growing = np.zeros(len(low), bool)
        growing[grow_l] = growing[grow_r] = True
        size = high + period - low
        for i in np.flatnonzero(growing | (size >= np.maximum(least, repeats * period))).tolist():
            a, b, p = int(low[i]), int(high[i]), int(period[i])
            known = covered.setdefault(p, [])
            if any(x <= a and b <= y for x, y in known[-4:]):
                continue
            if growing[i]:
                s, e = int(begin[i]), int(end[i])
                a -= _reach(codes[s:a][::-1], codes[s + p : a + p][::-1])
                b += _reach(codes[b : e - p], codes[b + p : e])
            known.append((a, b))
            if b + p - a >= max(least, repeats * p):
                key = (a, b + p)
                found[key] = min(p, found.get(key, p))
    rows = np.array([(a, b - a, p) for (a, b), p in found.items()], np.int64).reshape(-1, 3)
    text = np.searchsorted(starts, rows[:, 0], "right") - 1
    rows = np.column_stack([text, rows[:, 0] - starts[text], rows[:, 1:]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def collapsed_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run ``start, length, period`` contains after
    its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def collapse_runs(
    docs: DataFrame, text: str = "text", least: int = MIN_WORDS, repeats: int = MIN_REPEATS
) -> DataFrame:
    """``docs`` with ``runs``, ``best_run`` and ``collapsed``.

    ``runs`` holds ``start, length, period`` (in words, from 0) of every run by start, then
    period; ``best_run`` is the one with the greatest length / period, compared exactly,
    ties by start and period, null without a run; ``collapsed`` is the words outside of
    repetitions, joined by one space: of each run the first period stays. Whole texts are
    read. A null or empty text, or one of white space, has no words, no run and an empty
    ``collapsed``. Every input row gives one output row; columns with the names of the new
    ones are replaced, others pass through.
    """
    docs = docs.drop(*[f.name for f in NEW])
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, text):
                rows, best, kept = _collapse(part[text], least, repeats)
                new = [pa.array(rows, kind), pa.array(best, kind.value_type), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *new], names=[*part.schema.names, *(f.name for f in NEW)])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + NEW))


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``_TOGETHER`` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch[text]).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + _TOGETHER, "right")))
        yield batch.slice(at, to - at)
        at = to


def _collapse(texts: pa.Array, least: int, repeats: int):
    raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    codes, starts, words = word_codes(raw)
    found = runs_of(codes, starts, least, repeats)
    cuts = np.searchsorted(found[:, 0], np.arange(len(raw) + 1)).tolist()
    rows, best, kept = [], [], []
    for i in range(len(raw)):
        own = found[cuts[i] : cuts[i + 1], 1:]
        each = [dict(zip(("start", "length", "period"), r)) for r in own.tolist()]
        rows.append(each)
        best.append(min(each, default=None, key=lambda r: (
            -Fraction(r["length"], r["period"]), r["start"], r["period"])))
        ids = codes[starts[i] : starts[i + 1]]
        if each:
            ids = ids[collapsed_words(len(ids), own)]
        kept.append(b" ".join(map(words.__getitem__, ids.tolist())).decode())
    return rows, best, kept
