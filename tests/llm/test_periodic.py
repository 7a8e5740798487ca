"""Periodic runs against a plain search of every lag."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from arenalake.llm import periodic


def brute_runs(words):
    """Every lag word by word; a stretch counts under its smallest period alone."""
    found = []
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            stretch = words[start:j]
            if length >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                found.append((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant):
    words = (text or "").encode().split()
    if plant and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def words_of(rng):
    out = []
    for _ in range(rng.randrange(1, 6)):
        kind = rng.random()
        root = [rng.choice("abcde") for _ in range(rng.randrange(1, 12))]
        if kind < 0.6:
            out += root * rng.randrange(1, 8) + root[: rng.randrange(0, len(root))]
        elif kind < 0.8:
            out += (root * 4 + [rng.choice("xyz")]) * rng.randrange(1, 6)
        else:
            out += [rng.choice("ab") for _ in range(rng.randrange(0, 40))]
    return out


def test_runs_of_random_words_against_every_lag():
    rng = random.Random(5)
    for _ in range(400):
        docs = [words_of(rng) for _ in range(rng.randrange(1, 4))]
        names = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
        code = np.array([names[w] for d in docs for w in d], np.int64)
        number = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        want, base = [], 0
        for d in docs:
            want += [(s + base, n, q) for s, n, q in brute_runs(d)]
            base += len(d)
        assert list(zip(*(x.tolist() for x in periodic.runs_of(code, number)), strict=True)) == want


@pytest.mark.parametrize("plant", [False, True])
def test_documents_against_every_lag(spark, plant, monkeypatch):
    monkeypatch.setattr(periodic, "PORTION", 150)
    rng = random.Random(9)
    rows = [(i, " ".join(words_of(rng)), 1, "clash") for i in range(120)]
    rows += [(200, None, 1, ""), (201, "", 1, ""), (202, " \t\n ", 1, ""), (None, "a a a a a a a", 1, ""), (203, "a\x0ba\x0ca\ra\na\ta", 1, "")]
    rows += [(204, "one two " * 7, 1, ""), (205, "x " * 5, 1, ""), (206, "x y " * 4, 1, ""), (207, "x y z " * 4 + "x", 1, ""), (3, "b b b b b b", 1, ""), (3, "b b b b b b", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, words string")
    got = [tuple(r)[:8] for r in periodic.find_runs(df, plant).collect()]
    assert sorted(got, key=repr) == sorted((expected(i, t, plant) for i, t, *_ in rows), key=repr)
    assert any(g[1] > 1 for g in got)


def test_one_word_repeated_and_very_long_texts_take_n_log_n():
    n = 300_000
    start, length, period = periodic.runs_of(np.zeros(n, np.int64), np.zeros(n, np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [n], [1])
    root = np.random.default_rng(3).integers(0, 50, n // 4)  # four times a root of 75,000 words
    start, length, period = periodic.runs_of(np.tile(root, 4), np.zeros(4 * len(root), np.int64))
    assert (0, 4 * len(root), len(root)) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    nested = np.tile(np.concatenate((np.zeros(999, np.int64), [1])), 300)  # runs of one word inside a run of 1,000
    found = set(zip(*(x.tolist() for x in periodic.runs_of(nested, np.zeros(len(nested), np.int64))), strict=True))
    assert (0, 300_000, 1000) in found and len(found) == 301


def test_empty_table(spark):
    assert periodic.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
