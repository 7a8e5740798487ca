"""Substring dedup with a compressed FM-index per shard.

A window is 50 consecutive words. Windows are dealt to shards by the smallest of their 8-word
hashes, so equal windows always meet, and a shard holds only passages whose key occurs in two
documents or more. Each shard builds an FM-index (word alphabet, wavelet matrix over the
Burrows-Wheeler transform) of its passages and streams them through it by backward search. What
goes from a document is what the interval of its window says: the smallest document in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenalake.llm.common import discard, hot_limit, join_apart, materialise

WINDOW, GRAM = 50, 8
#: A passage holds the windows of one run of equal keys, this many at most.
RUN = 64
#: 8-word hashes found this often in the sample of one document in SAMPLE give way to rarer ones.
HOT, SAMPLE, HOT_MOST = 60, 50, 50_000
#: Passages of a shard, about; keys with more than that are broadcast, MOST_CROWDED of them at most.
SHARD_ROWS, MOST_CROWDED = 12_000, 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to 64-bit hash; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(words: list[bytes], cache: _Hashes) -> np.ndarray:
    if len(cache) > 400_000:
        cache.clear()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _polynomial(h: np.ndarray, size: int) -> np.ndarray:
    """Mixed hash of every `size` consecutive values."""
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _MIX + h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _sliding_min(v: np.ndarray, span: int) -> np.ndarray:
    size = 1
    while 2 * size <= span:
        v, size = np.minimum(v[: len(v) - size], v[size:]), 2 * size
    return np.minimum(v[: len(v) - (span - size)], v[span - size :]) if size < span else v


def window_runs(h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: key, first window, number of windows, hash of the words they cover.

    The key depends on the window's words alone (and on `hot`, which is the same everywhere): its
    smallest 8-word hash, with hot ones ranked behind all others.
    """
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none, none, none, none
    g = _polynomial(h, GRAM) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
        g = np.where(hot[at] == g, g | np.uint64(1 << 63), g)
    low = _sliding_min(g, WINDOW - GRAM + 1)
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    size = np.diff(np.concatenate((first, [len(low)])))
    if size.max() > RUN:
        parts = -(-size // RUN)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size = np.repeat(first, parts) + inner * RUN, np.minimum(RUN, np.repeat(size, parts) - inner * RUN)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h)))))
    covered = (sums[first + size + WINDOW - 1] - sums[first]) * _powers(len(h), inverse=True)[first]
    covered = (covered ^ (covered >> np.uint64(31))) * _MIX
    return low[first].view(np.int64), first.astype(np.int64), size.astype(np.int64), covered.view(np.int64)


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = 0xD1B54A32D192ED03
    base = pow(base, -1, 1 << 64) if inverse else base
    out, size, step = np.ones(n, np.uint64), 1, base
    while size < n:  # doubling: the second half is the first one times base^size
        end = min(n, 2 * size)
        out[size:end] = out[: end - size] * np.uint64(step)
        step, size = step * step % (1 << 64), 2 * size
    return out


class FMIndex:
    """FM-index over integer words (0 separates passages), for patterns of up to `depth` words.

    Suffixes are sorted by their first `depth` words, by prefix doubling. That is enough: rows
    before a pattern's interval are exactly the suffixes that compare less on its length, so the
    backward step C[c] + rank(c, i) stays exact while the pattern is no longer than `depth`.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.depth = depth
        rank, size = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while size < depth:
            step = min(size, depth - size)
            ahead = np.concatenate((rank[step:] + 1, np.zeros(step, np.int64)))[:n]
            rank = np.unique(rank * (int(rank.max()) + 3) + ahead, return_inverse=True)[1].astype(np.int64)
            size += step
        self.sa = np.argsort(rank, kind="stable")
        ordered = rank[self.sa]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        self.class_of = np.cumsum(new) - 1
        self.class_start = np.flatnonzero(new)
        self.class_end = np.concatenate((self.class_start[1:], [n]))
        bwt = text[self.sa - 1]
        counts = np.bincount(text)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.levels = max(1, int(text.max()).bit_length())
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        left = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((left >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view("<u8")
            sums = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.rows.append((packed, sums, int(n - bit.sum())))
            left = np.concatenate((left[~bit], left[bit]))
        self.origin = self._descend(np.arange(len(counts)), np.zeros(len(counts), np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (packed, sums, zeros) in enumerate(self.rows):
            word = i >> 6
            ones = sums[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((c >> (self.levels - 1 - k)) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols of the transform."""
        return self._descend(c, i) - self.origin[c]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of c followed by the patterns of [lo, hi)."""
        both = self.rank(np.concatenate((c, c)), np.concatenate((lo, hi)))
        return self.before[c] + both[: len(c)], self.before[c] + both[len(c) :]

    def at_most(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals cut back to `depth` words: the parent step where a match has outgrown them."""
        k = self.class_of[lo]
        return self.class_start[k], self.class_end[k]


def matched_windows(split: list[list[bytes]], owners: np.ndarray, highest: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each passage the starts of its windows that some document of the passage, highest at most, has
    to give up, and the smallest owner of each such window.

    All passages stream through the index of all, one word per step and from the right, each
    keeping its interval and the length of its match. A passage's own text is in the index, so no
    interval is empty. Where the match reaches the window, the interval is cut back to the window's
    length and its smallest owner is read.
    """
    codes: dict[bytes, int] = {}
    lengths = np.array([len(w) for w in split], np.int64)
    text = np.zeros(int(lengths.sum()) + len(split), np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    for at, words in zip(begins, split, strict=True):
        text[at : at + len(words)] = [codes.setdefault(w, len(codes) + 1) for w in words]
    owner_of = np.repeat(np.arange(len(split)), lengths + 1)
    index = FMIndex(text, WINDOW)
    least = np.minimum.reduceat(owners[owner_of[index.sa]], index.class_start)
    order = np.argsort(-lengths, kind="stable")
    lo, hi = np.zeros(len(split), np.int64), np.full(len(split), len(text), np.int64)
    none = np.zeros(0, np.int64)
    found_p, found_at, found_least = [none], [none], [none]
    sorted_len = -lengths[order]
    for step in range(int(lengths.max(initial=0))):
        live = order[: np.searchsorted(sorted_len, -step, side="left")]
        at = lengths[live] - 1 - step
        lo[live], hi[live] = index.extend(text[begins[live] + at], lo[live], hi[live])
        if step + 1 >= WINDOW:
            lo[live], hi[live] = index.at_most(lo[live])
            smallest = least[index.class_of[lo[live]]]
            hit = smallest < highest[live]
            found_p.append(live[hit])
            found_at.append(at[hit])
            found_least.append(smallest[hit])
    which, at, smallest = np.concatenate(found_p), np.concatenate(found_at), np.concatenate(found_least)
    by = np.lexsort((at, which))
    which, at, smallest = which[by], at[by], smallest[by]
    cuts = np.searchsorted(which, np.arange(len(split) + 1))
    return [(at[a:b], smallest[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _digest(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def _search_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each passage the runs of windows with one smallest owner, and a digest of the words they cover."""
    split = [p.encode().split() for p in pdf["passage"]]
    which, out = [], {"frm": [], "to": [], "least": [], "words": []}
    for i, (at, least) in enumerate(matched_windows(split, pdf["owner"].to_numpy(np.int64), pdf["highest"].to_numpy(np.int64))):
        if len(at):
            new = np.flatnonzero((np.diff(at) != 1) | (np.diff(least) != 0)) + 1
            first, last = np.concatenate(([0], new)), np.concatenate((new, [len(at)])) - 1
            frm, to = at[first].tolist(), (at[last] + 1).tolist()
            which += [i] * len(frm)
            out["frm"] += frm
            out["to"] += to
            out["least"] += least[first].tolist()
            out["words"] += [_digest(split[i][a : b + WINDOW - 1]) for a, b in zip(frm, to, strict=True)]
    held = {c: pdf[c].to_numpy()[which] for c in ("key", "covered", "n")}
    return pd.DataFrame(held | out).astype("int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sample_grams(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    cache = _Hashes()
    for batch in texts:
        hashes = (word_hashes(t.encode().split(), cache) for t in batch)
        yield pd.Series([np.unique(_polynomial(h, GRAM) >> np.uint64(1)).view(np.int64) if len(h) >= GRAM else np.zeros(0, np.int64) for h in hashes])


def hot_grams(docs: DataFrame) -> np.ndarray:
    """Very common 8-word hashes, from one document in SAMPLE. They only steer the dealing of
    windows to shards: any list, an empty one included, leads to the same result."""
    some = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0) & F.col("text").isNotNull())
    counted = some.select(F.explode(_sample_grams("text")).alias("g")).groupBy("g").count()
    top = counted.where(F.col("count") >= HOT).orderBy(F.desc("count"), "g").limit(HOT_MOST)
    return np.sort(np.array([r["g"] for r in top.select("g").collect()], np.int64).view(np.uint64))


def _runs_of(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Runs of windows of every document: doc_id, th, key, covered, first, size."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Hashes()
        for pdf in batches:
            parts = [window_runs(word_hashes(t.encode().split(), cache), hot) for t in pdf["text"]]
            times = [len(p[0]) for p in parts]
            key, first, size, covered = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
            yield pd.DataFrame({
                "doc_id": np.repeat(pdf["doc_id"].to_numpy(), times), "th": np.repeat(pdf["th"].to_numpy(), times),
                "key": key, "covered": covered, "first": first, "size": size,
            })

    return docs.select("doc_id", "th", "text").mapInPandas(runs, "doc_id bigint, th bigint, key bigint, covered bigint, first int, size int")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Words first to first + size + WINDOW - 1 of each span."""
    for texts, spans in batches:
        out = []
        for t, rows in zip(texts, spans, strict=True):
            words = t.encode().split()
            out.append([b" ".join(words[r["first"] : r["first"] + r["size"] + WINDOW - 1]).decode() for r in rows])
        yield pd.Series(out)


@F.pandas_udf(T.StructType().add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType()).add("kept", T.StringType()))
def _keep(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """What is left of each text without the words of the windows that start in [frm, to) of its ranges."""
    for texts, ranges in batches:
        rows = []
        for t, cover in zip(texts, ranges, strict=True):
            words = (t or "").encode().split()
            kept = words
            if cover is not None and len(cover):
                edge = np.zeros(len(words) + 1, np.int64)
                for r in cover:
                    if _digest(words[r["frm"] : r["to"] + WINDOW - 1]) != r["words"]:
                        raise ValueError("two passages agree in all 127 bits of their hashes")
                    edge[r["frm"]] += 1
                    edge[r["to"] + WINDOW - 1] -= 1
                kept = [w for w, n in zip(words, np.cumsum(edge).tolist(), strict=False) if n <= 0]
            joined = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
        yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept"])


def covered_ranges(docs: DataFrame, share_equal: bool = True) -> DataFrame:
    """Window starts to remove as (doc_id, th, frm, to, words). docs has doc_id, th, text, none of them null.

    Equal passages (by two hashes) are indexed and streamed once, with the smallest doc_id that holds
    them (the owner); the smallest owner that the index gives for a window decides for all documents
    that hold the passage, and the words it decided on are compared by digest before they go. Without
    share_equal every run is a passage of its own; the result is the same.
    """
    runs = _runs_of(docs, hot_grams(docs))
    if not share_equal:
        runs = runs.withColumn("covered", F.xxhash64("covered", "doc_id", "th", "first"))
    runs = materialise(runs, "runs")
    keys = runs.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    keys = materialise(keys.select("key", "n"), "keys")
    limit = hot_limit(runs.count())
    shared = materialise(join_apart(runs, keys, ["key"], "n", limit).drop("n"), "runs-shared")
    discard(runs)
    owned = shared.groupBy("key", "covered").agg(F.min(F.struct("doc_id", "th", "first", "size")).alias("o"), F.max("doc_id").alias("highest"), F.count("*").alias("n"))
    owned = materialise(owned.select("key", "covered", "highest", "n", "o.*"), "passages")
    wanted = owned.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "size", "key", "covered", "highest", "n")).alias("spans"))
    cut = docs.join(wanted, ["doc_id", "th"]).select(
        F.col("doc_id").alias("owner"), F.explode(F.arrays_zip(_cut("text", "spans").alias("passage"), F.col("spans").alias("span"))).alias("p")
    )
    cut = cut.select("owner", F.col("p.passage").alias("passage"), *[F.col(f"p.span.{c}").alias(c) for c in ("key", "covered", "highest", "n")])
    found = _in_shards(cut, owned).groupBy("g").applyInPandas(
        _search_shard, "key bigint, covered bigint, n bigint, frm bigint, to bigint, least bigint, words bigint"
    )
    found = materialise(found, "found")
    gone = join_apart(shared, found, ["key", "covered"], "n", limit).where(F.col("least") < F.col("doc_id"))
    return gone.select("doc_id", "th", (F.col("first") + F.col("frm")).alias("frm"), (F.col("first") + F.col("to")).alias("to"), "words")


def _in_shards(cut: DataFrame, owned: DataFrame) -> DataFrame:
    """Passages with the group g in which they are indexed together, SHARD_ROWS of them, about.

    Keys share shards. The passages of a key with more than a shard are split into blocks, and every
    two blocks (and every block by itself) make a group, so that all of them meet.
    """
    total = owned.count()
    many = max(SHARD_ROWS, total // MOST_CROWDED)
    crowded = owned.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > many)  # MOST_CROWDED keys at most
    blocks = F.coalesce(F.ceil(2 * F.col("held") / SHARD_ROWS), F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64("covered"), F.col("blocks")).cast("int")
    dealt = cut.join(F.broadcast(crowded), "key", "left").withColumn("blocks", blocks).withColumn("part", part)
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "part").alias("row"), F.greatest(o, "part").alias("col")))
    shard = F.pmod(F.xxhash64("key"), F.lit(-(-max(1, total) // SHARD_ROWS)))
    none = F.lit(-1)
    alone = F.struct(shard.alias("a"), none.alias("row"), none.alias("col"))
    return dealt.withColumn("m", F.explode(meets)).select(
        *cut.columns, F.when(F.col("blocks") == 1, alone).otherwise(F.struct(F.col("key").alias("a"), "m.row", "m.col")).alias("g")
    )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept.

    Words are maximal runs without ASCII white space, unchanged. A word goes if a window of 50
    words over it also starts in a document with a smaller doc_id; windows are judged on the
    input. Null text has no words; texts of under 50 words keep all. Repeated rows (one doc_id)
    don't remove from each other; equal ones are searched once, however many there are. A row with a null doc_id neither loses words nor takes any.
    Extra columns are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    base = base.where("doc_id is not null")
    again = materialise(base.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    size = again.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    ranges = covered_ranges(once(base, again) if size[0] else base)
    ranges = ranges.groupBy("doc_id", "th").agg(F.collect_set(F.struct("frm", "to", "words")).alias("ranges"))
    limit = hot_limit(size[2] or 0)
    if (size[1] or 0) > limit:  # rows of such a key stay where they are: a thousand keys at most
        hot = F.broadcast(again.where(F.col("n") > limit).select("doc_id", "th"))
        apart = base.join(hot, ["doc_id", "th"], "left_semi").join(F.broadcast(ranges.join(hot, ["doc_id", "th"], "left_semi")), ["doc_id", "th"], "left")
        found = apart.unionByName(base.join(hot, ["doc_id", "th"], "left_anti").join(ranges, ["doc_id", "th"], "left"))
    else:
        found = base.join(ranges, ["doc_id", "th"], "left")
    done = found.select("doc_id", _keep("text", "ranges").alias("k"))
    alone = docs.where("doc_id is null").select("doc_id", _keep("text", F.lit(None).cast("array<struct<frm:bigint,to:bigint,words:bigint>>")).alias("k"))
    return done.unionByName(alone).select("doc_id", "k.*")


def once(base: DataFrame, again: DataFrame) -> DataFrame:
    """base with one row of each (doc_id, th); again: those that are repeated. Only repeated rows are dealt anew."""
    keys = ["doc_id", "th"]
    return base.join(again.select(*keys), keys, "left_anti").unionByName(base.join(again.select(*keys), keys, "left_semi").dropDuplicates(keys))
