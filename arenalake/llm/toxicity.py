"""Toxicity scores from the nearest labelled examples (exact TF-IDF cosine, block-max index)."""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arenalake.llm.common import give_back, materialise

#: Labelled examples kept per class, the ones with the smallest hash of their doc_id (bounded sample).
EXAMPLES = {1: 2000, 0: 4000}
#: Every term that this many examples hold is indexed.
LEAST_HELD = 2
#: A term weighs its IDF times |z|, how far its shares among toxic and other examples differ; at least this, so that none weighs nothing.
LEAST_STRENGTH = 0.1
#: Terms held by more than one in SPREAD examples, the DENSE most frequent at most, are kept as dense columns; the others as inverted lists.
SPREAD, DENSE = 24, 1024
#: Texts whose cosines are made at once.
AT_ONCE = 128
NEIGHBOURS, BLOCK, PRIOR_WEIGHT = 15, 64, 0.5
#: Besides the word itself its first letters are a term, so inflected and compound words meet. More
#: beginnings than one (4, 5 and 6) found no more toxic documents of the held-out fold.
PREFIXES = (5,)
STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_"
#: A word or beginning found this often in a text is a term of its own: term frequency in steps.
STEPS = (1, 2, 3, 5, 8)


def terms_of(word: str) -> list[str]:
    w = word.lower().strip(STRIP)
    return [w] + [f"{w[:n]}~" for n in PREFIXES if len(w) > n] if w else []


def stepped(base: str, step: int) -> str:
    return base if step == 1 else f"{base}#{step}"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _terms_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        counts = (Counter(f for w in (t or "").split() for f in terms_of(w)) for t in batch)
        yield pd.Series([[stepped(f, s) for f, n in c.items() for s in STEPS if s <= n] for c in counts])


class _Hits(dict):
    """Numbers of the kept words and beginnings of a word, found when it is first asked for."""

    def __init__(self, base: dict[str, int]):
        super().__init__()
        self.base = base

    def __reduce__(self):
        return _Hits, (self.base,)

    def __missing__(self, word: str) -> tuple[int, ...]:
        """terms_of() looked up; most new words are numbers and names without a kept term, so this is kept short."""
        get, w = self.base.get, word.lower().strip(STRIP)
        found = [get(w)] if w else []
        for n in PREFIXES:
            if len(w) > n:
                found.append(get(w[:n] + "~"))
        hits = self[word] = tuple([f for f in found if f is not None])
        return hits


class Vocabulary:
    """Numbers of the kept terms, found by the word or beginning that they count."""

    def __init__(self, terms: list[str]):
        number = {t: i for i, t in enumerate(terms)}
        bases = sorted({t.rpartition("#")[0] or t for t in terms} | set(terms))
        self.base = {b: i for i, b in enumerate(bases)}
        #: Term number by base and step, -1 where it isn't kept.
        self.steps = np.array([[number.get(stepped(b, s), -1) for s in STEPS] for b in bases], np.int32).reshape(-1, len(STEPS))
        self.cache = _Hits(self.base)

    def terms(self, text: str | None) -> np.ndarray:
        if len(self.cache) > 200_000:
            self.cache.clear()
        counts = Counter(chain.from_iterable(map(self.cache.__getitem__, (text or "").split())))
        if not counts:
            return np.zeros(0, np.int32)
        found = self.steps[np.fromiter(counts, np.int64, len(counts))]
        often = np.fromiter(counts.values(), np.int64, len(counts))
        return np.sort(found[(found >= 0) & (np.array(STEPS) <= often[:, None])])


@dataclass
class BlockMaxIndex:
    """Rare terms as inverted lists; frequent ones as dense columns over blocks of consecutive
    examples, with each block's largest weight per term."""

    ids: np.ndarray
    labels: np.ndarray
    scale: np.ndarray
    #: Column of a frequent term, -1 for a rare one.
    column: np.ndarray
    #: Inverted lists of the rare terms one after the other: start of each term's, example, weight.
    start: np.ndarray
    doc: np.ndarray
    weight: np.ndarray
    dense: np.ndarray
    most: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, rows: list, n_terms: int, strength: np.ndarray | None = None) -> BlockMaxIndex:
        """strength: what the terms' IDF is multiplied by, 1 if not given."""
        term = np.concatenate([np.zeros(0, np.int32), *[np.asarray(r, np.int32) for r in rows]])
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        df = np.bincount(term, minlength=n_terms)
        scale = (np.log((1 + len(ids)) / (1 + df)) + 1) * (1.0 if strength is None else strength)
        weight = scale[term]
        norm = np.sqrt(np.bincount(doc, weight**2, minlength=len(rows)))
        weight /= norm[doc]
        column = np.full(n_terms, -1, np.int64)
        often = np.argsort(-df, kind="stable")[:DENSE]
        often = often[df[often] * SPREAD > len(rows)]
        column[often] = np.arange(len(often))
        blocks = -(-len(rows) // BLOCK)
        dense = np.zeros((blocks * BLOCK, len(often)))
        held = column[term] >= 0
        dense[doc[held], column[term[held]]] = weight[held]
        dense = dense.reshape(blocks, BLOCK, len(often))
        term, doc, weight = term[~held], doc[~held], weight[~held]
        start = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=n_terms))))
        along = np.argsort(term, kind="stable").astype(np.int32)
        del term, held
        doc = doc[along]
        return cls(ids, labels, scale, column, start, doc, weight[along], dense, dense.max(axis=1))

    def _normed(self, terms: np.ndarray) -> np.ndarray:
        raw = self.scale[terms]
        return raw / math.sqrt(float(raw @ raw)) if len(raw) else raw

    def weights(self, terms) -> list[tuple[int, float]]:
        """Normalised weights (term, weight). Frequency is in the terms' steps, so each weighs its scale."""
        terms = np.asarray(terms, np.int64)
        return list(zip(terms.tolist(), self._normed(terms).tolist(), strict=True))

    def _rare(self, queries: list) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the queries' rare terms (query x example), and their weights of frequent terms."""
        part, full = np.zeros((len(queries), len(self.dense) * BLOCK)), np.zeros((len(queries), self.dense.shape[2]))
        for i, terms in enumerate(queries):
            terms = np.asarray(terms, np.int64)
            w, at = self._normed(terms), self.column[terms]
            full[i, at[at >= 0]] = w[at >= 0]
            rare, w = terms[at < 0], w[at < 0]
            begin, n = self.start[rare], self.start[rare + 1] - self.start[rare]
            at = np.arange(int(n.sum()))
            at += np.repeat(begin - (np.cumsum(n) - n), n)  # the lists one after the other
            weight = self.weight[at]
            weight *= np.repeat(w, n)
            part[i] = np.bincount(self.doc[at], weight, minlength=part.shape[1])
        return part, full

    def nearest_of(self, queries: list, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the k examples of highest cosine (position, cosine), ties to the smaller position.

        Rare terms are summed for all examples. A block's bound is its largest such sum and the sum
        of its maxima over the query's frequent terms. The quarter of the blocks with the largest
        bounds is completed first; then those whose bound still reaches the k-th cosine found. What
        is left can't enter.
        """
        out = []
        for begin in range(0, len(queries), AT_ONCE):
            some = queries[begin : begin + AT_ONCE]
            score, full = self._rare(some)
            own = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if without is not None:
                own = np.nonzero(without[begin : begin + AT_ONCE, None] == self.ids)
            bound = score.reshape(len(some), -1, BLOCK).max(axis=2, initial=0.0) + full @ self.most.T
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, : max(4, bound.shape[1] // 4)], True, axis=1)
            self._complete(score, full, first)
            score[own] = 0.0
            rank = min(k, score.shape[1])
            kth = np.partition(score, -rank, axis=1)[:, -rank] if rank else np.zeros(len(some))
            self._complete(score, full, ~first & (bound >= kth[:, None] - 1e-12))
            score[own] = 0.0
            for row in np.round(score[:, : len(self.ids)], 12):
                hit = np.flatnonzero(row > 0) if len(row) <= k else np.flatnonzero((row > 0) & (row >= np.partition(row, -k)[-k]))
                best = hit[np.lexsort((hit, -row[hit]))[:k]]
                out.append((best, row[best]))
        return out

    def _complete(self, score: np.ndarray, full: np.ndarray, active: np.ndarray) -> None:
        """Adds the frequent terms in the active blocks (query x block)."""
        for b in range(active.shape[1]):
            q = np.flatnonzero(active[:, b])
            if len(q):
                score[q, b * BLOCK : (b + 1) * BLOCK] += full[q] @ self.dense[b].T

    def nearest(self, terms, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([terms], k, None if without is None else np.array([without]))[0]


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    index: BlockMaxIndex
    prior: float
    sampled: float
    slope: float
    shift: float

    def votes(self, queries: list, without: np.ndarray | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Share of toxic examples among each query's neighbours, drawn to the prior; the neighbours and
        their cosines. A neighbour weighs its cosine, and makes up for the rate at which its class was sampled."""
        out = []
        for at, cosine in self.index.nearest_of(queries, NEIGHBOURS, without):
            toxic = self.index.labels[at]
            weight = cosine * np.where(toxic > 0, self.prior / self.sampled, (1 - self.prior) / (1 - self.sampled))
            out.append(((float(weight @ toxic) + PRIOR_WEIGHT * self.prior) / (float(weight.sum()) + PRIOR_WEIGHT), at, cosine))
        return out

    def packed(self, terms: list[str], strength: np.ndarray, rows: list[np.ndarray]) -> bytes:
        """What the model is built from, a fraction of its size."""
        index = (self.index.ids, self.index.labels, np.array([len(r) for r in rows]), np.concatenate([np.diff(r, prepend=0) for r in rows]), strength)
        return zlib.compress(pickle.dumps(("\n".join(terms), index, (self.prior, self.sampled, self.slope, self.shift))), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> ToxicityModel:
        words, (ids, labels, size, steps, strength), numbers = pickle.loads(zlib.decompress(data))
        terms = words.split("\n")
        rows = [np.cumsum(r, dtype=np.int32) for r in np.split(steps, np.cumsum(size)[:-1])]
        return cls(Vocabulary(terms), BlockMaxIndex.build(ids, labels, rows, len(terms), strength), *numbers)

    def calibrated(self, share: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * share + self.shift))))


#: The model a Python worker built last, by its name: tasks of one worker build it once.
_built: dict[str, ToxicityModel] = {}


def _model(name: str, data: bytes) -> ToxicityModel:
    if name not in _built:
        _built.clear()
        _built[name] = ToxicityModel.unpacked(data)
        give_back()
    return _built[name]


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic curve through (x, y) with row weights w, by Newton steps with a little ridge."""
    a, b = 1.0, 0.0
    pos, neg = float((w * y).sum()), float((w * (1 - y)).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, v = w * (p - target), w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * x).sum() + 1e-3 * a, g.sum() + 1e-3 * b])
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame) -> bytes | None:
    """A packed model fitted on a bounded sample of labelled documents outside the held-out fold; None
    without both classes or without a term that two examples share.

    A doc_id with several labels counts as toxic if any of them says so.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id")) != 0)
    known = materialise(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    share = known.agg(F.avg("toxic")).first()[0]
    hashed = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = hashed.where("toxic = 1").limit(EXAMPLES[1]).unionByName(hashed.where("toxic = 0").limit(EXAMPLES[0]))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 6,000 ids
    texts = materialise(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "examples")
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    each = texts.select("toxic", F.explode(_terms_udf("text")).alias("term"))
    df = each.groupBy("term").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    held = df.where(F.col("pos") + F.col("neg") >= LEAST_HELD).orderBy("term").toArrow()
    terms = held["term"].to_pylist()  # bounded by EXAMPLES and the words of a text
    pos, neg = (held[c].to_numpy().astype(float) for c in ("pos", "neg"))
    p = (pos + neg) / (n[0] + n[1])
    z = (pos / n[1] - neg / n[0]) / np.sqrt(p * (1 - p) * (1 / n[1] + 1 / n[0]) + 1e-12)
    if not terms:
        return None
    strength = np.maximum(np.abs(z), LEAST_STRENGTH)
    del held, pos, neg, p, z
    vocabulary = Vocabulary(terms)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def held_terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([vocabulary.terms(t) for t in batch])

    found = texts.select("doc_id", "toxic", held_terms("text").alias("t")).toArrow().sort_by("doc_id").combine_chunks()
    ids, y, lists = found["doc_id"].to_numpy(), found["toxic"].to_numpy(), [x.values.to_numpy() for x in found["t"]]
    # Examples whose strongest terms are alike share blocks, so that bounds differ.
    heaviest = [(r[np.argsort(-strength[r], kind="stable")[:4]]).tolist() for r in lists]
    order = sorted(range(len(lists)), key=lambda i: (heaviest[i], i))
    ids, y, lists = ids[order], y[order], [lists[i].copy() for i in order]
    del found, heaviest
    give_back()
    index = BlockMaxIndex.build(ids, y, lists, len(terms), strength)
    model = ToxicityModel(vocabulary, index, float(share), n[1] / (n[0] + n[1]), 1.0, 0.0)
    votes = np.array([v[0] for v in model.votes(lists, ids)])
    weight = np.where(y > 0, share / n[1], (1 - share) / n[0]) * len(y)
    model.slope, model.shift = _platt(votes, y, weight)
    data = model.packed(terms, strength, lists)
    del model, index, vocabulary, held_terms, lists, terms
    give_back()
    return data


def score_column(docs: DataFrame, labels: DataFrame) -> Column:
    """A column over docs.text with score and evidence, from a model fitted on docs and labels."""
    spark = docs.sparkSession
    name, data = uuid.uuid4().hex, fit(docs, labels)
    model = spark.sparkContext.broadcast(data)  # bounded by EXAMPLES and the words of a text
    evidence = T.ArrayType(T.StructType().add("doc_id", T.LongType()).add("toxic", T.IntegerType()).add("cosine", T.DoubleType()))

    kind = T.StructType().add("score", T.DoubleType()).add("evidence", evidence)
    arrow = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])))])

    @F.arrow_udf(kind)
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = _model(name, model.value) if model.value is not None else None
        for batch in texts:
            out = []
            for begin in range(0, len(batch), AT_ONCE):  # a batch's texts stay in Arrow, a few are strings at a time
                some = batch.slice(begin, AT_ONCE).to_pylist()
                if m is None:
                    out += [{"score": 0.0, "evidence": []} for _ in some]
                    continue
                for share, at, cosine in m.votes([m.vocabulary.terms(t) for t in some]):
                    seen = zip(m.index.ids[at[:3]].tolist(), m.index.labels[at[:3]].tolist(), cosine[:3].tolist(), strict=True)
                    out.append({"score": m.calibrated(share), "evidence": [dict(zip(("doc_id", "toxic", "cosine"), e, strict=True)) for e in seen]})
            yield pa.array(out, arrow)

    return scored(F.col("text"))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, evidence (up to three neighbours).

    Labels are read only for doc_ids whose crc32 mod 5 is not 0; only the text makes the score.
    Null and empty texts, and texts without a known term, get the calibrated prior. Without
    labelled examples of both classes every score is 0. A null doc_id is scored and not held out.
    Repeated rows keep their rows; extra columns are ignored.
    """
    s = docs.select("doc_id", score_column(docs, labels).alias("s"))
    return s.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("s.score").alias("score"),
        (F.col("s.score") >= 0.5).cast("int").alias("predicted"), F.col("s.evidence").alias("evidence"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more; columns unchanged."""
    return docs.withColumn("__s", score_column(docs, labels)).where("__s.score < 0.5").select(*docs.columns)
