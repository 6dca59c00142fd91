from __future__ import annotations

import re

from pyspark.sql import functions as F

from docflow.llm import decontaminate as dc
from tests.llm.conftest import table

ITEM = "item_id long, text string"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            iw = words(item)
            width = min(13, len(iw))
            windows = {tuple(iw[i : i + width]) for i in range(len(iw) - width + 1)} if iw else ()
            for i in range(len(w) - width + 1):
                if width and tuple(w[i : i + width]) in windows:
                    hit.update(range(i, i + width))
                    names.add("null" if name is None else str(name))
        out.append((doc_id, len(w), len(hit), sorted(names), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def found(docs, items, **more):
    h = F.col("h")
    rows = dc.with_hits(docs, items, "h", **more).select(
        "doc_id", h["n_words"], dc.n_hit(h), h["items"], dc.contaminated(h)
    )
    return sorted(map(tuple, rows.collect()), key=repr)


def test_whole_table(llm, small):
    docs = llm.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    items = llm.read.parquet(f"{small}/benchmark.parquet")
    wanted = plain(docs.collect(), [(r.item_id, r.text) for r in items.collect()])
    assert any(r[4] for r in wanted)
    assert found(docs, items) == wanted
    # a benchmark too long for one broadcast is taken in blocks, with the same result
    assert found(docs, items, block_words=300) == wanted


LONG = " ".join(f"w{i}" for i in range(30))


def test_edges(llm):
    docs = [(1, None), (2, ""), (3, LONG.upper()), (3, LONG.upper()), (4, "a b, SHORT item! c"),
            (5, "short"), (None, f"{LONG} {LONG}"), (6, "Ünï short; item")]
    items = [(1, LONG), (2, "short item"), (3, None), (4, "..."), (None, "w3"), (5, LONG), (2, "zz")]
    assert found(table(llm, docs), table(llm, items, ITEM)) == plain(docs, items)
    assert found(table(llm, docs), table(llm, [], ITEM)) == plain(docs, [])
    assert found(table(llm, []), table(llm, items, ITEM)) == []


def test_removal(llm):
    docs = table(llm, [(1, f"Keep this, {LONG} - and that."), (2, "clean text"), (3, None)])
    docs = docs.withColumn("_extra", F.lit(7)).withColumn("_hits", F.lit(1)).withColumn("hits", F.lit(2))
    items = table(llm, [(1, LONG)], ITEM)
    kept = dc.clean_documents(docs, items)
    assert kept.columns == ["doc_id", "text", "_extra", "_hits", "hits"]
    assert sorted((r.doc_id, r._hits, r.hits) for r in kept.collect()) == [(2, 1, 2), (3, 1, 2)]
    cut = {r.doc_id: r.text for r in dc.without_spans(docs, items).collect()}
    assert dc.without_spans(docs, items).columns == docs.columns
    assert cut == {1: "Keep this,  - and that.", 2: "clean text", 3: None}


def test_blocks_are_bounded(llm):
    long = " ".join(f"w{i}" for i in range(300))
    items = [(1, "ABC DEF " * 20), (2, long)] + [(3, "one two three " * 10)] * 50
    named = table(llm, [(str(i), t) for i, t in items], "name string, text string")
    blocks = list(dc._blocks(named, 60))
    assert all(sum(len(dc.item_words(t)) for _, t in b) <= 60 for b in blocks)
    assert sum(name == "3" for b in blocks for name, _ in b) == 1
    docs = [(i, " ".join(f"w{j}" for j in range(i, i + 13))) for i in range(0, 290, 7)]
    docs.append((999, "abc def " * 10))
    assert found(table(llm, docs), table(llm, items, ITEM), block_words=60) == plain(docs, items)
