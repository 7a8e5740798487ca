"""Mixing to target weights by soft membership (DataFrame functions only)."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalake.llm.common import materialise

BUCKETS = 4096
#: Labelled rows the classifier is fitted on: those with the smallest hash of their doc_id (bounded sample).
LABELLED_MOST = 12_000
#: Weight of the common word distribution in each domain's, in words.
SMOOTHING = 2000
#: Words of a text are no independent witnesses: its mean log-probability ratio per word, over the whole
#: text, counts as often as it has words, but this often at most, so that long texts don't get certain.
EVIDENCE = 300
#: Expected shares of tokens by domain.
TARGETS = {"clean": 0.90, "rough": 0.08, "toxic": 0.02}
#: Steps of the fit, and how near a domain's share must come to its target.
ROUNDS, TOLERANCE = 40, 1e-3


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def _buckets(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int") + 1)


def _sum_at(values: Column) -> Column:
    """Sum of values (an array literal) over the buckets of a text."""
    return F.aggregate("__b", F.lit(0.0), lambda total, b: total + F.element_at(values, b))


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain from the label table: toxic, else rough where quality is 0, else clean.

    A doc_id with several labels takes the worst; rows without any label are left out.
    """
    domain = F.when(F.max("toxic") == 1, "toxic").when(F.min("quality") == 0, "rough").otherwise("clean")
    return labels.where("doc_id is not null and coalesce(toxic, quality) is not null").groupBy("doc_id").agg(domain.alias("domain"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[dict[str, float], dict[str, list[float]]]:
    """Naive Bayes over hashed words: log prior of each domain, and log probability of each bucket in it.

    labelled: doc_id, domain; only documents of docs count. A domain without examples has the words of all.
    """
    known = labelled.where(F.col("domain").isin(domains)).join(docs.select("doc_id"), "doc_id", "left_semi")
    known = materialise(known, "domains")
    shares = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_MOST)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # LABELLED_MOST ids at most
    counted = (
        texts.select("domain", F.explode(F.array_distinct(_buckets(words(F.col("text"))))).alias("b"))
        .groupBy("domain", "b").agg(F.count("*").alias("n")).collect()
    )  # fmt: skip  # at most BUCKETS rows per domain
    total = sum(shares.values()) + len(domains)
    prior = {d: math.log((shares.get(d, 0) + 1) / total) for d in domains}
    counts = {d: np.zeros(BUCKETS) for d in domains}
    for r in counted:
        counts[r["domain"]][r["b"] - 1] = r["n"]
    common = sum(counts.values()) + 0.5
    common /= common.sum()
    # Towards the words of all domains, so that words a small domain lacks speak for no domain.
    logp = {d: np.log((n + SMOOTHING * common) / (n.sum() + SMOOTHING)).tolist() for d, n in counts.items()}
    return prior, logp


def posteriors(docs: DataFrame, prior: dict[str, float], logp: dict[str, list[float]]) -> DataFrame:
    """docs with n_tokens and p_<domain>: what Bayes' rule gives for the words, tempered to EVIDENCE of them."""
    tokens = words(F.col("text"))
    held = docs.withColumn("__b", _buckets(tokens)).withColumn("n_tokens", F.size("__b").cast("long"))
    domains = list(prior)
    weight = F.least(F.col("n_tokens"), F.lit(EVIDENCE)) / F.greatest(F.col("n_tokens"), F.lit(1))
    base = np.array(logp[domains[0]])
    for d in domains[1:]:
        ratio = F.lit(np.array(logp[d]) - base)
        held = held.withColumn(f"__l_{d}", _sum_at(ratio) * weight + (prior[d] - prior[domains[0]]))
    top = F.greatest(F.lit(0.0), *[F.col(f"__l_{d}") for d in domains[1:]]) if len(domains) > 1 else F.lit(0.0)
    part = {d: F.exp((F.col(f"__l_{d}") if d != domains[0] else F.lit(0.0)) - top) for d in domains}
    whole = sum(part.values(), F.lit(0.0))
    return held.select(*docs.columns, "n_tokens", *[(part[d] / whole).alias(f"p_{d}") for d in domains])


def measured_targets(held: DataFrame, domains: list[str], keep: str, rest: float) -> dict[str, float]:
    """Targets from the expected shares of held's tokens: the other domains get `rest` of what they
    have, and keep all else, so never less than its present share."""
    sums = held.agg(F.sum("n_tokens").alias("all"), *[F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in domains]).first()
    total = float(sums["all"] or 0)
    out = {d: rest * float(sums[d]) / total if total and d != keep else 0.0 for d in domains}
    return out | {keep: 1 - sum(out.values())}


def fit_rates(held: DataFrame, targets: dict[str, float], rounds: int = ROUNDS, keep: str | None = None) -> tuple[Column, bool]:
    """Column of nonnegative rates over held (n_tokens, p_<domain>), by projected gradient from rate 1; and
    whether every domain's expected total is within TOLERANCE of its target share of all tokens.

    Minimises the squares of expected domain totals minus targets of the same sum. The gradient of
    a document is its posteriors times the totals' errors, preconditioned by the Gram matrix of the
    documents that are free to move, and projected on rates of 0 or more; a step that does not
    lessen the squares is halved. Each step is one distributed sum per domain and pair of domains;
    only those sums come to the driver, and rates stay an expression over the posteriors. Rows that
    belong to the domain `keep` with probability 0.5 or more have rates of 1 or more. Targets that
    no rates can meet leave the nearest totals found, and False.
    """
    domains = list(targets)
    p = {d: F.col(f"p_{d}") for d in domains}
    n, scale = F.col("n_tokens"), sum(targets.values())
    least = F.when(p[keep] >= 0.5, 1.0).otherwise(0.0) if keep else F.lit(0.0)

    def measured(moves: list[list[float]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Errors of the totals after the moves, Gram matrix of the rows above their least rate; both by token."""
        rate = _descended([p[d] for d in domains], moves, least)
        free = F.when(F.col("__rate") > least, n).otherwise(0) if moves else n
        sums = [F.sum(n * p[d] * F.col("__rate")).alias(d) for d in domains]
        grams = [F.sum(free * p[a] * p[b]).alias(f"g_{a}_{b}") for a in domains for b in domains]
        row = held.withColumn("__rate", rate).agg(F.sum("n_tokens").alias("all"), *sums, *grams).first()
        total = float(row["all"] or 0)
        off = np.array([(row[d] or 0.0) / total - targets[d] / scale for d in domains]) if total else np.zeros(len(domains))
        gram = np.array([[(row[f"g_{a}_{b}"] or 0.0) / max(total, 1.0) for b in domains] for a in domains])
        return off, gram, total

    moves: list[list[float]] = []
    off, gram, total = measured(moves)
    part = 1.0
    for _ in range(rounds if total else 0):
        if np.abs(off).max() <= TOLERANCE or part < 1 / 64:
            break
        step = part * np.linalg.solve(gram + 1e-3 * np.eye(len(domains)), off)
        tried = measured([*moves, step.tolist()])
        if tried[0] @ tried[0] < 0.98 * (off @ off):
            moves.append(step.tolist())
            off, gram, part = tried[0], tried[1], 1.0
        else:
            part /= 2
    return _descended([p[d] for d in domains], moves, least), bool(np.abs(off).max() <= TOLERANCE)


def _descended(p: list[Column], moves: list[list[float]], least: Column) -> Column:
    """Rate after the moves so far: from 1, each takes off its weights times the posteriors, down to `least`."""
    if not moves:
        return F.lit(1.0)
    state = lambda rate, post, low: F.struct(rate.alias("rate"), post.alias("post"), low.alias("low"))
    taken = lambda s, m: sum((s["post"][i] * m[i] for i in range(len(p))), F.lit(0.0))
    path = F.array(*[F.array(*map(F.lit, m)) for m in moves])
    start = state(F.lit(1.0), F.array(*p), least)
    return F.aggregate(path, start, lambda s, m: state(F.greatest(s["low"], s["rate"] - taken(s, m)), s["post"], s["low"]), lambda s: s["rate"])


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, p_<domain>, rate, on_target.

    Rates are nonnegative, and rate x tokens x posterior sums to each domain's target share of
    all tokens, within TOLERANCE; on_target is false in every row where no such rates were found.
    Null and blank texts have no tokens and the prior as posterior. Repeated rows count as often as
    they occur; null ids keep their rows and have no label; extra columns are ignored. Without
    labelled rows all domains are alike. An empty table gives an empty table.
    """
    prior, logp = fit_classifier(docs, label_domains(labels), list(targets))
    held = materialise(posteriors(docs.select("doc_id", "text"), prior, logp).drop("text"), "posteriors")
    rate, met = fit_rates(held, targets)
    return held.withColumn("rate", rate).withColumn("on_target", F.lit(met))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep: str | None = None, rest: float = 0.5) -> DataFrame:
    """docs repeated by their rates: the whole part, and once more where a hash of the row falls under the rest.

    With keep, targets only names the domains: see measured_targets. Rows mainly of that domain all
    stay then. Equal rows are repeated or go alike; null ids and null and blank texts have no label
    and are drawn like others. Warns where the targets can't be met. Columns stay as they are.
    """
    # The texts stay out of the table of posteriors; equal (doc_id, text) have equal rates.
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), "text", F.xxhash64("doc_id", "text").alias("__h"))
    prior, logp = fit_classifier(docs, label_domains(labels), list(targets))
    held = posteriors(keyed.select("__h", "text"), prior, logp).drop("text")
    held = materialise(held, "posteriors")
    rate, met = fit_rates(held, measured_targets(held, list(targets), keep, rest) if keep else targets, keep=keep)
    if not met:
        warnings.warn("mixing: no rates meet the targets; the nearest found are used", stacklevel=2)
    scored = posteriors(keyed, prior, logp).withColumn("__r", rate)
    draw = F.pmod(F.xxhash64(F.lit("draw"), "__h"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("__r") + 1 - draw).cast("int")
    return scored.select("__row", F.explode(F.array_repeat(F.lit(1), copies))).select("__row.*")
