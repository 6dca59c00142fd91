"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text and their beginnings, since insults are
inflected: a stem tells more than each of its forms.

Labels say toxic or not. Among the toxic, severity is read off the texts: a feature's
evidence is its smoothed log odds between toxic and clean labelled documents; toxic
documents with more evidence than their median have grade 2, the others grade 1,
clean ones grade 0. One weight per feature is shared by both thresholds:
P(grade >= k) = logistic(weights · features - threshold_k). The expected severity is the
sum of these probabilities. A document is rejected if grade 1 or more is likelier than not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import label_sample, sampled_texts
from docflow.llm.decontaminate import item_words

#: Most labelled documents of either class that are learned from.
SAMPLE_PER_CLASS = 8000
#: Lengths in bytes of the word beginnings.
STEMS = (4, 5, 6, 7, 8)
#: Features whose counts in toxic and clean documents differ by at least this chi-square
#: statistic, and are likelier in toxic ones, are kept, the strongest first. Benign words
#: thus never outweigh an insult, and a text without any feature is clean.
MIN_CHI_SQUARE = 20.0
MAX_FEATURES = 4096
RIDGE = 0.3
GRADES = 2


def features_of(text: str | None) -> set[bytes]:
    """Distinct words, and beginnings of longer words (marked by a star)."""
    words = set(item_words(text))
    stems = {w[:n] + b"*" for n in STEMS for w in words if len(w) > n}
    return words | stems


@dataclass
class Grader:
    weights: dict[bytes, float]
    thresholds: np.ndarray

    def grades(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2); each feature of a text counts once."""
        found = self.weights.keys() & features_of(text) if text else ()
        total = sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + np.exp(self.thresholds - total))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, features: int, prior: np.ndarray):
    """Weights and rising thresholds by penalised maximum likelihood.

    ``rows``: feature numbers of each document; ``prior``: shares of the grades, to
    which documents are weighted. Gradient steps with momentum; the gap of
    the thresholds is kept positive by its logarithm.
    """
    weight = np.zeros(features)
    share = np.bincount(grades, minlength=GRADES + 1) / max(1, len(grades))
    cost = np.where(share > 0, prior / np.where(share > 0, share, 1), 0)[grades]
    cost = cost / max(cost.sum(), 1e-9)
    above = np.clip(1 - np.cumsum(prior)[:GRADES], 1e-4, 1 - 1e-4)
    first = -np.log(above[0] / (1 - above[0]))
    gap = np.log(max(1e-2, -np.log(above[1] / (1 - above[1])) - first))
    lengths = np.array([len(r) for r in rows])
    of = np.repeat(np.arange(len(rows)), lengths)
    at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    moment = [np.zeros(features + 2), np.zeros(features + 2)]
    for step in range(1, 601):
        score = np.bincount(of, weights=weight[at], minlength=len(rows))
        p1 = 1 / (1 + np.exp(first - score))
        p2 = 1 / (1 + np.exp(first + np.exp(gap) - score))
        likelihood = np.choose(grades, (1 - p1, p1 - p2, p2)).clip(1e-12)
        d1 = np.choose(grades, (-p1 * (1 - p1), p1 * (1 - p1), 0 * p1)) / likelihood
        d2 = np.choose(grades, (0 * p2, -p2 * (1 - p2), p2 * (1 - p2))) / likelihood
        pull = cost * (d1 + d2)
        slope = np.bincount(at, weights=pull[of], minlength=features)
        slope -= RIDGE * weight / max(1, len(rows))
        full = np.concatenate((slope, [-pull.sum(), -(cost * d2).sum() * np.exp(gap)]))
        moment[0] = 0.9 * moment[0] + 0.1 * full
        moment[1] = 0.99 * moment[1] + 0.01 * full**2
        rate = 0.05 / (1 + step / 200)
        ahead = moment[0] / (1 - 0.9**step)
        move = rate * ahead / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-9)
        weight = weight + move[:features]
        first, gap = first + move[-2], gap + move[-1]
    return weight, np.array([first, first + np.exp(gap)])


def fit(docs: DataFrame, labels: DataFrame) -> Grader:
    """Learn from at most ``SAMPLE_PER_CLASS`` labelled documents of either class.

    Without labelled documents of both classes every document has grade 0.
    """
    sample = label_sample(labels, "toxic", SAMPLE_PER_CLASS)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [sorted(features_of(t)) for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "words": words})

    chosen = sampled_texts(docs, sample)
    table = chosen.select("y", "text").mapInPandas(split, "y int, words array<binary>")
    sizes = {r["y"]: r["n"] for r in table.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Grader({}, np.array([50.0, 51.0]))
    counts = table.select("y", F.explode("words").alias("word")).groupBy("word")
    counts = counts.agg(
        F.sum("y").cast("double").alias("t"), F.sum(1 - F.col("y")).cast("double").alias("c")
    )
    total = float(clean + toxic)
    shared = F.col("t") * (clean - F.col("c")) - F.col("c") * (toxic - F.col("t"))
    margin = (F.col("t") + F.col("c")) * (total - F.col("t") - F.col("c")) * clean * toxic
    chi = F.when(margin > 0, total * shared * shared / margin).otherwise(0.0)
    features = (
        counts.where((F.col("t") + F.col("c")) >= 5)
        .withColumn("chi", chi)
        .where(F.col("chi") >= MIN_CHI_SQUARE)
        .where(F.col("t") * clean > F.col("c") * toxic)
        .orderBy(F.col("chi").desc(), "word")
        .limit(MAX_FEATURES)
        .collect()
    )
    names = [bytes(r["word"]) for r in features]
    odds = np.array(
        [
            np.log((r["t"] + 0.5) / (toxic + 1)) - np.log((r["c"] + 0.5) / (clean + 1))
            for r in features
        ]
    )
    number = {w: i for i, w in enumerate(names)}

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                [number[f] for f in number.keys() & features_of(t)] for t in batch["text"]
            ]
            yield pd.DataFrame({"y": batch["y"], "at": found})

    data = chosen.select("y", "text").mapInPandas(sparse, "y int, at array<long>").toPandas()
    rows = [np.sort(np.asarray(a, dtype=np.int64)) for a in data["at"]]
    order = sorted(range(len(rows)), key=lambda i: (data["y"][i], rows[i].tolist()))
    rows = [rows[i] for i in order]
    y = data["y"].to_numpy()[order]
    evidence = np.array([odds[r].clip(0).sum() for r in rows])
    middle = np.median(evidence[y == 1])
    grades = np.where(y == 0, 0, np.where(evidence > middle, 2, 1))
    known = labels.where(F.col("toxic").isNotNull())
    share = float(known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0])
    severe = float((grades == 2).sum() / max(1, (grades > 0).sum()))
    prior = np.array([1 - share, share * (1 - severe), share * severe])
    weights, thresholds = fit_ordinal(rows, grades, len(names), prior)
    return Grader(dict(zip(names, weights.tolist(), strict=True)), thresholds)


GRADED = "severity double, p_toxic double, p_severe double, grade int"


def graded(text: Column, grader: Grader, spark) -> Column:
    """Struct of expected severity, P(grade >= 1), P(grade >= 2) and the likeliest grade.

    Null and empty texts have no words: they get what the thresholds alone give.
    """
    shared = spark.sparkContext.broadcast(grader)

    @F.pandas_udf(GRADED)
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = np.array([shared.value.grades(t) for t in texts]).reshape(-1, GRADES)
            shares = np.stack((1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]), axis=1)
            yield pd.DataFrame(
                {
                    "severity": p.sum(axis=1),
                    "p_toxic": p[:, 0],
                    "p_severe": p[:, 1],
                    "grade": shares.argmax(axis=1).astype(np.int32),
                }
            )

    return compute(text)


def toxicity_grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, p_toxic, p_severe, grade, rejected) of all documents."""
    grader = fit(docs, labels)
    result = graded(F.col("text"), grader, docs.sparkSession)
    return docs.select("doc_id", result.alias("g")).select(
        "doc_id", "g.*", (F.col("g.p_toxic") >= 0.5).alias("rejected")
    )


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not rejected; all their columns stay."""
    grader = fit(docs, labels)
    result = graded(F.col("text"), grader, docs.sparkSession)
    return docs.where(result["p_toxic"] < 0.5)
