"""Quality classifier: a weak-label model by expectation-maximisation, then a hashed linear scorer."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arenalake.llm.common import materialise
from arenalake.llm.mixing import words

FEATURES = 1 << 14
#: Documents the linear scorer is fitted on, with the smallest hashes of their doc_id (bounded sample).
FITTED_MOST = 12_000
ABSTAIN, ROUNDS = 2, 100


def labellers() -> dict[str, Column]:
    """Heuristics that vote 0 (poor), 1 (good) or 2 (abstain), over the columns of statistics().

    A lack of one fault says little, so fault finders abstain where they find nothing; the two
    that attest prose look at several measures together.
    """
    c = F.col
    per_word = lambda x: c(x) / F.greatest(c("n_words"), F.lit(1))
    fault = lambda found: F.when(found, 0).otherwise(ABSTAIN)
    varied = per_word("n_distinct") >= 0.25 + 5 / (c("n_words") + 10)
    sober = (per_word("n_symbols") < 0.08) & (per_word("n_capitals") < 0.08) & (per_word("n_shouts") < 0.03)
    return {
        "empty": fault(c("n_words") < 1),
        "repetition": fault(~varied),
        "symbols": fault(per_word("n_symbols") > 0.25),
        "capitals": fault(per_word("n_capitals") > 0.3),
        "shouting": fault(per_word("n_shouts") > 0.1),
        "word_length": fault((per_word("n_chars") < 3) | (per_word("n_chars") > 14)),
        "prose": F.when(varied & sober & (c("n_words") >= 1), 1).when(~varied & ~sober, 0).otherwise(ABSTAIN),
        "sentences": F.when(sober & per_word("n_stops").between(0.02, 0.4), 1).when(per_word("n_stops") < 0.005, 0).otherwise(ABSTAIN),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """Counts per text that the labellers look at; docs keeps its columns doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", "text", words(F.col("text")).alias("__w"))  # once, for both sizes
    return split.select(
        "doc_id", "text", F.size("__w").alias("n_words"), F.size(F.array_distinct("__w")).alias("n_distinct"),
        F.length(text).alias("n_chars"), F.regexp_count(text, F.lit(r"[#$%&*|<>{}=_~^]+")).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[A-ZÄÖÜÉÑ]{3,}")).alias("n_capitals"), F.regexp_count(text, F.lit("!{2,}")).alias("n_shouts"),
        F.regexp_count(text, F.lit(r"[.?!](?=\s|$)")).alias("n_stops"),
    )


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of class 1 per vote pattern, its prior, and P(vote | class) as (labeller, class, vote).

    Labellers are independent given the class. Starts from the majority of the votes; class 1 is the
    one where the labellers vote 1 more, whichever way the rounds turned.
    """
    ones, zeros = (votes == 1).sum(1), (votes == 0).sum(1)
    post = (ones + 1) / (ones + zeros + 2)
    prior, table = 0.5, np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        before = post
        weight = np.stack((counts * (1 - post), counts * post))
        prior = float((weight[1].sum() + 1) / (weight.sum() + 2))
        for j in range(votes.shape[1]):
            for v in range(3):
                table[j, :, v] = weight[:, votes[:, j] == v].sum(axis=1) + 1
        table /= table.sum(axis=2, keepdims=True)
        logit = np.log(prior / (1 - prior)) + sum(np.log(table[j, 1, votes[:, j]] / table[j, 0, votes[:, j]]) for j in range(votes.shape[1]))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if len(post) == 0 or np.abs(post - before).max() < 1e-9:
            break
    if (table[:, 1, 1] - table[:, 0, 1] + table[:, 0, 0] - table[:, 1, 0]).sum() < 0:
        return 1 - post, 1 - prior, table[:, ::-1]
    return post, prior, table


def _terms(text: Column) -> Column:
    """Words, and the last three characters of each, which carry punctuation and case."""
    w = words(text)
    return F.concat(w, F.transform(w, lambda x: F.concat(F.lit("~"), F.right(x, F.lit(3)))))


def score_quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, votes, posterior, score, predicted.

    posterior is the label model's for the pattern of votes over all documents, score the linear
    model's. No gold label is read. Null text is empty text. Repeated rows count as often as they
    occur; null ids keep their rows; extra columns are ignored. Where all posteriors agree there is
    nothing to fit, and the score is the posterior. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rules = labellers()
    pattern = F.concat(*[v.cast("string") for v in rules.values()])
    voted = statistics(docs).select("doc_id", "text", pattern.alias("votes"))
    counted = materialise(voted.groupBy("votes").count(), "votes").collect()  # 3 ** 8 rows at most
    if not counted:
        return spark.createDataFrame([], "doc_id long, votes string, posterior double, score double, predicted int")
    votes = np.array([[int(c) for c in r["votes"]] for r in counted])
    post, _, _ = expectation_maximisation(votes, np.array([r["count"] for r in counted], float))
    of = spark.createDataFrame([(r["votes"], float(p)) for r, p in zip(counted, post, strict=True)], "votes string, posterior double")
    chosen = docs.select("doc_id", "text").join(F.broadcast(docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FITTED_MOST)), "doc_id")
    sample = statistics(chosen).select("text", pattern.alias("votes")).join(F.broadcast(of), "votes")
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="terms", outputCol="features")
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight"))))
    rows = sample.select(_terms(F.col("text")).alias("terms"), sides.alias("s")).select("terms", "s.*").where("weight > 0.001")
    rows = materialise(hashing.transform(rows).select("features", "label", "weight"), "quality-sample")
    if rows.select("label").distinct().count() < 2:
        return voted.join(F.broadcast(of), "votes").select("doc_id", "votes", "posterior", F.col("posterior").alias("score"), (F.col("posterior") >= 0.5).cast("int").alias("predicted"))
    model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=25, standardization=False).fit(rows)
    scored = model.transform(hashing.transform(voted.join(F.broadcast(of), "votes").withColumn("terms", _terms(F.col("text")))))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "votes", "posterior", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
