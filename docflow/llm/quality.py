"""Quality by nearest labelled neighbours in a latent-semantic space.

A text's terms are its shapes: characters are mapped to classes (small and capital
letters, digits, line ends, each common mark), runs of one class are joined, and runs of
one to three classes are counted over the whole text; a few more terms say
how often words and lines repeat and how long words are. Term weights from a labelled
sample, cut to its strongest singular directions, give each text a unit vector. The labelled
vectors are broadcast; every document's cosines with all of them are computed
exactly, block by block, and the labels of the nearest are averaged by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import id_crc, label_sample, sampled_texts

#: Most labelled documents of either class that are learned from.
SAMPLE_PER_CLASS = 3000
DIRECTIONS = 48
NEIGHBOURS = 41
#: Labelled vectors compared at once.
VECTOR_BLOCK = 1024
#: Neighbour weights are similarities to this power.
SHARPNESS = 4

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[]_{|}~"
_CLASSES = 6 + len(_MARKS)
_EXTRA = 32
TERMS = _CLASSES + _CLASSES**2 + _CLASSES**3 + _EXTRA


def _class_table() -> np.ndarray:
    table = np.full(256, 5, dtype=np.int64)  # other
    table[[9, 11, 12, 13, 32]] = 0
    table[10] = 1
    for low, high, kind in ((97, 122, 2), (128, 255, 2), (65, 90, 3), (48, 57, 4)):
        table[low : high + 1] = kind
    for i, mark in enumerate(_MARKS):
        table[ord(mark)] = 6 + i
    return table


_TABLE = _class_table()


def _step(value: float, steps: int) -> int:
    return min(steps - 1, int(value * steps))


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and counts of a text; none for null or blank texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    kinds = _TABLE[np.frombuffer(data, dtype=np.uint8)]
    kinds = kinds[np.concatenate(([True], kinds[1:] != kinds[:-1]))]
    pairs = kinds[:-1] * _CLASSES + kinds[1:]
    triples = pairs[:-1] * _CLASSES + kinds[2:]
    found = np.concatenate(
        (kinds, pairs + _CLASSES, triples + _CLASSES + _CLASSES**2)
    )
    numbers, counts = np.unique(found, return_counts=True)
    lines = data.split(b"\n")
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    extra = TERMS - _EXTRA + np.array(
        [
            _step(len(set(words)) / len(words) * 0.999, 8),
            8 + _step(len(set(lines)) / len(lines) * 0.999, 8),
            16 + _step(min(0.999, repeats), 8),
            24 + min(7, len(data) // len(words) // 2),
        ]
    )
    # the four descriptions weigh as much as the most frequent shape
    weight = np.full(len(extra), counts.max(initial=1))
    return np.concatenate((numbers, extra)), np.concatenate((counts, weight))


@dataclass
class Space:
    """Chosen terms, their weights, the projection, labelled vectors and labels."""

    columns: np.ndarray
    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _matrix(rows: list[tuple], columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted rows of unit length over the chosen terms."""
    place = np.full(TERMS, -1, dtype=np.int64)
    place[columns] = np.arange(len(columns))
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for i, (numbers, counts) in enumerate(rows):
        at = place[numbers]
        known = at >= 0
        out[i, at[known]] = np.log1p(counts[known])
    out *= weights
    return _unit(out)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1)


_TERMS = "y int, numbers array<long>, counts array<double>"


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Space:
    """Learn from at most ``SAMPLE_PER_CLASS`` labelled documents of either class.

    The ids are chosen by their hash, so the sample does not depend on the order
    of rows; labels without a document are left out. The classes
    weigh in the vote as in the labels: the prior is kept.
    """
    sample = label_sample(labels, label, SAMPLE_PER_CLASS)
    prior = labels.where(F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double")))
    prior = prior.first()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(y, *terms(t)) for y, t in zip(batch["y"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["y", "numbers", "counts"])

    chosen = sampled_texts(docs, sample)
    table = chosen.select("y", "text").mapInPandas(run, _TERMS).toPandas()
    rows = list(zip(table["numbers"], table["counts"], strict=True))
    rows = [(np.asarray(n, dtype=np.int64), np.asarray(c)) for n, c in rows]
    y = table["y"].to_numpy(dtype=np.float64)
    numbers = [n for n, _ in rows]
    in_docs = np.bincount(
        np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64), minlength=TERMS
    )
    columns = np.flatnonzero(in_docs >= max(2, len(rows) // 400))
    weights = np.log((1 + len(rows)) / (1 + in_docs[columns])).astype(np.float32) + 0.1
    matrix = _matrix(rows, columns, weights)
    _, directions = np.linalg.eigh(matrix.T.astype(np.float64) @ matrix)
    projection = directions[:, ::-1][:, :DIRECTIONS].astype(np.float32)
    # the sample holds the classes in other shares than the labels do
    prior = 0.5 if prior is None else float(prior)
    return Space(columns, weights, projection, _unit(matrix @ projection), y, prior)


def vote(texts: list[str | None], space: Space) -> np.ndarray:
    """Share of label 1 among the nearest labelled documents, by similarity."""
    if not len(space.labels):
        return np.full(len(texts), space.prior)
    rows = [terms(t) for t in texts]
    own = _unit(_matrix(rows, space.columns, space.weights) @ space.projection)
    best = np.zeros((len(texts), 0), dtype=np.float32)
    labels = np.zeros((len(texts), 0))
    for start in range(0, len(space.labels), VECTOR_BLOCK):
        block = own @ space.vectors[start : start + VECTOR_BLOCK].T
        best = np.concatenate((best, block), axis=1)
        marks = np.broadcast_to(space.labels[start : start + VECTOR_BLOCK], block.shape)
        labels = np.concatenate((labels, marks), axis=1)
        if best.shape[1] > NEIGHBOURS:
            near = np.argpartition(-best, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
            best = np.take_along_axis(best, near, axis=1)
            labels = np.take_along_axis(labels, near, axis=1)
    share = space.labels.mean()
    # votes count as the classes stand in all labels, not in the sample
    up = space.prior / share if share > 0 else 0.0
    down = (1 - space.prior) / (1 - share) if share < 1 else 0.0
    weight = np.maximum(best, 0).astype(np.float64) ** SHARPNESS
    good = (weight * labels).sum(axis=1) * up
    bad = (weight * (1 - labels)).sum(axis=1) * down
    total = good + bad
    return np.where(total > 0, good / np.where(total > 0, total, 1), space.prior)


def scored(text: Column, space: Space, spark) -> Column:
    """Quality of a text between 0 and 1; null, empty and blank texts get the prior."""
    shared = spark.sparkContext.broadcast(space)

    @F.pandas_udf("double")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [texts.iloc[i : i + 1000] for i in range(0, len(texts), 1000)]
            found = [vote(p.tolist(), shared.value) for p in parts]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    return compute(text)


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents.

    Labels of ids whose crc32 leaves ``part`` when divided by ``parts`` are not learned
    from. Only texts enter the score.
    """
    held_out = F.pmod(id_crc("doc_id"), F.lit(parts)) == part
    space = fit(docs, labels.where(~held_out))
    score = scored(F.col("text"), space, docs.sparkSession)
    return (
        docs.select("doc_id", "text")
        .select("doc_id", held_out.alias("held_out"), score.alias("score"))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
