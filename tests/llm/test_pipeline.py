from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from docflow.llm import toxicity
from docflow.llm.queries import tokenizer_path
from docflow.llm.tokens import encoder
from tests.llm.test_decontaminate import plain as plain_hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_on_its_input(llm, small):
    docs = llm.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = llm.read.parquet(f"{small}/labels.parquet")

    clean = stages["toxicity"](llm, docs, small)
    assert clean.columns == COLUMNS
    rejected = toxicity.toxicity_grades(docs, labels).where("rejected").select("doc_id").collect()
    kept = {r.doc_id for r in clean.collect()}
    assert kept == set(range(200)) - {r.doc_id for r in rejected}

    single = stages["near_duplicates"](llm, docs, small)
    assert single.columns == COLUMNS
    rows = {r.doc_id: r.text for r in single.collect()}
    every = {r.doc_id: r.text for r in docs.collect()}
    assert set(every.values()) == {every[i] for i in every if every[i] in set(every.values())}
    exact = {}
    for i in sorted(every):
        exact.setdefault(every[i], i)
    assert set(rows) <= set(exact.values())  # no exact copy is left

    unhit = stages["decontamination"](llm, docs, small)
    assert unhit.columns == COLUMNS
    items = [(r.item_id, r.text) for r in llm.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {r[0] for r in plain_hits(list(every.items()), items) if r[4]}
    assert {r.doc_id for r in unhit.collect()} == set(every) - bad

    mixed = stages["mixing"](llm, docs, small)
    assert mixed.columns == COLUMNS
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) == set(every) and max(times.values()) <= 2

    archived = stages["token_archive"](llm, docs, small).collect()
    encode = encoder(tokenizer_path())
    for r in archived:
        ids = np.append(encode([every[r.doc_id]])[0], 2).astype("<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_run(llm, small):
    result = corpus_pipeline.run(llm, small)
    assert {"doc_id", "start", "n_tokens"} <= set(result.columns)
    rows = sorted(result.collect(), key=lambda r: r.start)
    assert rows and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
