"""Periodic run detection by sparse diagonals of earlier occurrences.

A lag q is a diagonal: where word i equals word i - q it grows by one, else it ends. A run of
smallest period q has length 4q or more, so 3q words or more match on its diagonal. With s the
power of two that has s <= q < 2s, all of these stand in stretches of 2s matching words, and only
the nearest earlier occurrence of the stretch that ends at a word can belong to such a diagonal:
if a nearer lag d < q held as well, d and q would be periods of at least q + d common words, so
would their greatest common divisor (Fine and Wilf), and q were not the smallest. So at each of
the log n scales a word adds to one diagonal at most: work is n log n for any text, also for one
word repeated throughout, and a diagonal that grows needs no further test of its period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of documents that are searched at once, about; a longer document is searched by itself.
PORTION = 400_000


def planted_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the periodic tail that the contract of op12 gives to ids whose crc32 ends in 0; a null id gets none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Codes of pairs: equal where both parts are."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1].astype(np.int64)


def runs_of(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in documents that stand one after the other: code and
    document number of each word. Sorted by start, then period.

    Scale by scale: `at` holds the first positions of stretches of `size` words that occur twice in
    their document, as only these can make longer ones that do.
    """
    n = len(code)
    starts, lengths, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, held, size = np.arange(n), np.unique(code, return_inverse=True)[1].astype(np.int64), 1
    while len(at):
        # Stretches of twice the size: the two halves are both known, or the stretch occurs once.
        place = np.full(n + size, -1, np.int64)
        place[at] = held
        second = place[at + size]
        inside = np.zeros(len(at), bool)
        ends = at + 2 * size <= n
        inside[ends] = doc[at[ends]] == doc[at[ends] + 2 * size - 1]
        both = inside & (second >= 0)
        at, held, size = at[both], _joined(held[both], second[both]), 2 * size
        lag = np.zeros(len(at), np.int64)
        by = np.argsort(held, kind="stable")
        again = (held[by[1:]] == held[by[:-1]]) & (doc[at[by[1:]]] == doc[at[by[:-1]]])
        lag[by[1:][again]] = (at[by[1:]] - at[by[:-1]])[again]
        # A diagonal goes on while the next word's lag is the same, and ends with the last such word.
        live = np.flatnonzero((lag >= size // 2) & (lag < size))
        if len(live):
            fresh = np.concatenate(([True], (np.diff(at[live]) != 1) | (np.diff(lag[live]) != 0) | (doc[at[live[1:]]] != doc[at[live[:-1]]])))
            first = np.flatnonzero(fresh)
            grown = np.diff(np.concatenate((first, [len(live)])))
            q, begin = lag[live[first]], at[live[first]] - lag[live[first]]
            length = grown + size - 1 + q
            long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
            starts.append(begin[long])
            lengths.append(length[long])
            periods.append(q[long])
        repeated = np.zeros(len(at), bool)
        repeated[by[1:][again]] = True
        repeated[by[:-1][again]] = True
        at, held = at[repeated], held[repeated]
    start, length, period = np.concatenate(starts), np.concatenate(lengths), np.concatenate(periods)
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _described(doc_id, words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """The output row of one document, its runs counted from its first word."""
    if not len(start):
        joined = b" ".join(words)
        return (doc_id, 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(joined).hexdigest(), None)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    goes = np.cumsum(edge[:-1]) > 0
    kept = [w for w, gone in zip(words, goes.tolist(), strict=True) if not gone]
    best = np.lexsort((period, start, -length))[0]
    s, n, q = (int(x[best]) for x in (start, length, period))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    joined = b" ".join(kept)
    return (doc_id, len(start), s, n, q, 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(joined).hexdigest(), joined.decode())


def _searched(ids: list, split: list[list[bytes]]) -> list[tuple]:
    """Output rows of some documents, searched together."""
    size = np.array([len(w) for w in split], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    codes: dict[bytes, int] = {}
    code = np.fromiter(map(codes.setdefault, chain.from_iterable(split), count()), np.int64, int(size.sum()))
    start, length, period = runs_of(code, np.repeat(np.arange(len(split)), size))
    cut = np.searchsorted(start, np.concatenate((begin, [len(code)])))
    # The runs of a document without words lie between equal cuts.
    return [_described(i, w, start[a:b] - o, length[a:b], period[a:b]) for i, w, a, b, o in zip(ids, split, cut[:-1], cut[1:], begin, strict=True)]


def _portions(pdf: pd.DataFrame, plant: bool) -> Iterator[list[tuple]]:
    ids, split, held = [], [], 0
    for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
        doc_id = None if pd.isna(doc_id) else int(doc_id)
        words = (text or "").encode().split()
        words = planted_tail(words, doc_id) if plant else words
        if split and held + len(words) > PORTION:
            yield _searched(ids, split)
            ids, split, held = [], [], 0
        ids.append(doc_id)
        split.append(words)
        held += len(words)
    if split:
        yield _searched(ids, split)


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed")


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per row of docs (doc_id long, text): doc_id, n_runs; start, length, period, exponent_milli of
    the longest run (ties: smallest start, then period); runs_sha256, collapsed_sha256, collapsed.

    Words are maximal runs without ASCII white space. A run is a stretch of words with smallest
    period q and length of at least max(6, 4q) that neither neighbouring word extends. collapsed
    is the text without the words that a run holds after its first q words, and null where there
    is no run (the text stays as it is). Null and blank texts have no words and no run, so four
    nulls and hashes of nothing. Every row is searched by itself: repeated rows and null ids keep
    their rows, ties can't arise, extra columns are ignored, an empty table gives an empty table.
    plant: give documents the periodic tails of planted_tail() first.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in _portions(pdf, plant):
                out = pd.DataFrame(rows, columns=COLUMNS)
                numbers = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")
                yield out.astype({c: "Int64" for c in numbers})

    whole = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, collapsed string"
    return docs.select("doc_id", "text").mapInPandas(search, whole)
