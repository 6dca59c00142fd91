from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docflow.llm import mixing
from tests.llm.conftest import table

SOURCED = "doc_id long, text string, source string"


def corpus(llm):
    rows = []
    for source, docs in (("big", 600), ("mid", 200), ("low", 60)):
        rows += [(len(rows) + i, "w " * (5 + i % 9), source) for i in range(docs)]
    return rows, table(llm, rows, SOURCED)


def tokens_by_source(rows):
    out = Counter()
    for _, text, source in rows:
        out[source] += len((text or "").split())
    return out


def weights(shares, a):
    raw = {s: p**a for s, p in shares.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w.values())


def test_entropy_target_and_budgets(llm):
    rows, docs = corpus(llm)
    sizes = tokens_by_source(rows)
    total = sum(sizes.values())
    got = mixing.mixed(docs, mixing.Recipe(0.9, None, 3000, 500)).collect()
    found = {r.mix_source: r.mix_weight for r in got}
    assert entropy(found) >= 0.9 * math.log(3) - 1e-9
    # one grid step further the entropy would fall short
    shares = {s: n / total for s, n in sizes.items()}
    a = math.log(found["big"] / found["low"]) / math.log(shares["big"] / shares["low"])
    assert entropy(weights(shares, a + 2e-6)) < 0.9 * math.log(3)
    spent = Counter()
    passes = defaultdict(Counter)
    for r in got:
        spent[r.mix_source] += r.mix_tokens
        passes[r.mix_source][r.doc_id] += 1
    for source, weight in found.items():
        assert 0 <= weight * 3000 - spent[source] <= 14  # less than one document is left
        assert max(passes[source].values()) - min(passes[source].values()) <= 1
    assert {r.mix_block for r in got} == set(range(6))


def test_repetition_limit(llm):
    rows, docs = corpus(llm)
    total = sum(tokens_by_source(rows).values())
    got = mixing.mixed(docs, mixing.Recipe(1.0, 2.0)).collect()
    assert max(Counter(r.doc_id for r in got).values()) == 2
    assert sum(r.mix_tokens for r in got) <= total
    covered = mixing.mixed(docs, mixing.Recipe(None, 1.5, "cover")).collect()
    assert {r.doc_id for r in covered} == {r[0] for r in rows}
    assert max(Counter(r.doc_id for r in covered).values()) == 2
    same = mixing.mixed(docs, mixing.Recipe(None, None)).collect()
    assert Counter(r.doc_id for r in same) == Counter(r[0] for r in rows)


def test_passes_are_different_permutations(llm):
    _, docs = corpus(llm)
    got = mixing.schedule(docs, mixing.Recipe(None, 3.0, "cover", 200)).where("source = 'low'")
    places = defaultdict(dict)
    for r in got.collect():
        places[r.mix_pass][r.doc_id] = (r.mix_block, r.mix_rank)
    orders = [sorted(p, key=p.get) for _, p in sorted(places.items())]
    assert len(orders) == 3 and orders[0] != orders[1]


def test_ranks_count_a_block(llm):
    _, docs = corpus(llm)
    got = mixing.schedule(docs, mixing.Recipe(block_tokens=300)).collect()
    by_block = defaultdict(list)
    for r in got:
        by_block[r.mix_block].append(r.mix_rank)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_block.values())


def test_edges(llm):
    rows = [(1, None, None), (2, "a b", None), (2, "a b", None), (None, "c", "s"), (3, "", "empty"),
            (4, "w " * 50_000, "s")]
    docs = table(llm, rows, SOURCED).withColumn("mix_block", F.lit("old")).withColumn("h", F.lit(1))
    got = mixing.mixed(docs, mixing.Recipe(None, None))
    assert got.columns == ["doc_id", "text", "source", "h", *mixing.NEW]
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2, 2, 3, 4]
    assert mixing.mixed(docs.limit(0)).collect() == []
    only_empty = table(llm, [(1, "", "a"), (2, None, "b")], SOURCED)
    assert mixing.mixed(only_empty).count() == 2


@pytest.mark.parametrize("entropy_share", [0.0, 0.5, 1.0])
def test_equal_sources_stay_equal(llm, entropy_share):
    rows = [(i, "x y z", f"s{i % 4}") for i in range(40)]
    got = mixing.mixed(table(llm, rows, SOURCED), mixing.Recipe(entropy_share)).collect()
    assert len(got) == 40 and all(abs(r.mix_weight - 0.25) < 1e-12 for r in got)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_that_share_an_id_fill_their_quota(llm, doc_id):
    rows = [(doc_id, "a b c d", "many")] * 400
    rows += [(1000 + i, "e f g h", "few") for i in range(40)]
    got = mixing.mixed(table(llm, rows, SOURCED), mixing.Recipe(1.0, None, 400, 40)).collect()
    spent, blocks = Counter(), set()
    for r in got:
        spent[r.mix_source] += r.mix_tokens
        if r.mix_source == "many":
            blocks.add(r.mix_block)
    assert spent == {"many": 200, "few": 200}
    assert len(blocks) > 5


def test_columns_named_like_inner_ones_stay(llm):
    """The rows of the same mixture without the extra columns, and each with its own values."""
    _, docs = corpus(llm)
    names = ("mix_key", "whole", "weight", "passes", "budget", "last_hash", "tokens", "own_3", "cells", "h")
    crowded = docs.select("*", *[(F.col("doc_id") * k).alias(c) for k, c in enumerate(names, 1)])
    got = mixing.mixed(crowded)
    assert got.columns == [*crowded.columns, *mixing.NEW]
    rows = got.collect()
    assert all(r[c] == r.doc_id * k for r in rows for k, c in enumerate(names, 1))
    wanted = mixing.mixed(docs).collect()
    key = lambda r: (r.doc_id, r.text, r.source, *[r[c] for c in mixing.NEW])
    assert sorted(map(key, rows)) == sorted(map(key, wanted))
