from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from docflow.llm import quality, toxicity
from docflow.llm.queries import quality_neighbours
from tests.llm.conftest import table

MIDDLE = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_quality_of_held_out_documents(llm):
    labels = llm.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "quality")
    rows = quality_neighbours(llm, MIDDLE).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    assert right > 0.95 and len({r.predicted for r in rows}) == 2


def test_votes_are_exact(llm):
    """Blocks of labelled vectors give what one full product gives."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("aB1.| \n!"), 80)) for _ in range(60)]
    docs = table(llm, list(enumerate(texts)))
    labels = table(llm, [(i, int(i % 3 > 0), 0) for i in range(60)], LABELS)
    space = quality.fit(docs, labels)
    whole = quality.vote(texts, space)
    quality_block, quality.VECTOR_BLOCK = quality.VECTOR_BLOCK, 7
    try:
        assert np.allclose(quality.vote(texts, space), whole)
    finally:
        quality.VECTOR_BLOCK = quality_block
    rows = [quality.terms(t) for t in texts]
    own = quality._unit(quality._matrix(rows, space.columns, space.weights) @ space.projection)
    sims = own @ space.vectors.T
    near = np.argsort(-sims[0])[: quality.NEIGHBOURS]
    weight = np.maximum(sims[0][near], 0) ** quality.SHARPNESS
    good = (weight * space.labels[near]).sum() * space.prior / space.labels.mean()
    bad = (weight * (1 - space.labels[near])).sum() * (1 - space.prior) / (1 - space.labels.mean())
    assert np.isclose(whole[0], good / (good + bad), atol=1e-5)


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "word " * 60_000), (4, "word"), (None, "no id")]


def test_quality_edges(llm):
    docs = table(llm, EDGES).withColumn("score", F.lit("clash"))
    labels = table(llm, [(1, 1, 0), (4, 0, 0), (9, None, None), (None, 1, 1), (4, 1, 0)], LABELS)
    for some in (labels, labels.limit(0)):
        got = quality.quality_scores(docs, some).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert all(r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.quality_scores(docs.limit(0), labels).collect() == []


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(2)
    grades = rng.choice(3, 900, p=[0.6, 0.25, 0.15])
    rows = [np.flatnonzero(rng.random(6) < 0.1 + 0.25 * g) for g in grades]
    prior = np.bincount(grades) / 900
    weights, thresholds = toxicity.fit_ordinal(rows, grades, 6, prior)
    assert (weights > 0.3).all() and thresholds[0] < thresholds[1]
    # at the optimum the mean probabilities are the shares of the grades
    score = np.array([weights[r].sum() for r in rows])
    for k, share in ((0, prior[1:].sum()), (1, prior[2])):
        assert abs((1 / (1 + np.exp(thresholds[k] - score))).mean() - share) < 0.02


def test_toxicity_of_documents(llm):
    docs = llm.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    labels = llm.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "toxic")
    learned = labels.where("doc_id % 2 = 0")
    rows = toxicity.toxicity_grades(docs, learned).join(labels, "doc_id").where("doc_id % 2 = 1")
    rows = rows.collect()
    clean = [r for r in rows if r.toxic == 0]
    assert np.mean([not r.rejected for r in clean]) > 0.98
    assert np.mean([r.rejected == bool(r.toxic) for r in rows]) > 0.9
    assert all(np.isclose(r.severity, r.p_toxic + r.p_severe) for r in rows)
    assert all(r.p_severe <= r.p_toxic for r in rows)


def test_toxicity_edges(llm):
    rows = [(i, "you fool" if i % 4 == 1 else "fine words") for i in range(40)]
    labels = table(llm, [(i, 0, int(i % 4 == 1)) for i in range(40)] + [(None, 0, 1), (41, 0, None)], LABELS)
    docs = table(llm, rows + [(100, None), (101, ""), (101, ""), (None, "YOU FOOL! " * 50_000)])
    docs = docs.withColumn("severity", F.lit("clash")).withColumn("g", F.lit(1))
    got = {(r.doc_id, r.rejected) for r in toxicity.toxicity_grades(docs, labels).collect()}
    assert {(1, True), (2, False), (None, True)} <= got and (100, True) not in got
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 4 = 1 AND doc_id < 40").isEmpty()
    assert toxicity.clean_documents(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.toxicity_grades(docs.limit(0), labels).collect() == []


def test_a_repeated_id_counts_once(llm):
    from docflow.llm import common

    docs = table(llm, [(1, "b"), (1, "a"), (1, None), (2, None), (3, "c")] + [(1, "b")] * 50)
    sample = table(llm, [(1, 0), (2, 1)], "doc_id long, y int")
    got = sorted(map(tuple, common.sampled_texts(docs, sample).collect()))
    assert got == [(1, "a", 0), (2, None, 1)]
    rows = [(i, f"fine calm word{i % 5} text") for i in range(30)]
    rows += [(100 + i, f"vile nasty word{i % 5} text") for i in range(30)]
    labels = table(llm, [(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    once = toxicity.fit(table(llm, rows), labels)
    more = toxicity.fit(table(llm, rows + [rows[0]] * 300), labels)
    assert repr(once) == repr(more)
