from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.llm import iblt
from tests.llm.conftest import table


def digests(texts):
    return iblt.Digests(texts, {})


def plain_likeness(a, b):
    x, y = (Counter(iblt.paragraph_digests(t, {}) if t else []) for t in (a, b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


text = st.text(alphabet="ab \n", max_size=300)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(text, text), min_size=1, max_size=8))
def test_peeling_gives_the_exact_likeness(pairs):
    left, right = zip(*pairs, strict=True)
    got = iblt.likeness(digests(list(left)), digests(list(right)))
    assert np.allclose(got, [plain_likeness(a, b) for a, b in pairs])


def test_long_and_different_texts_need_larger_sketches():
    a = "\n".join(f"line {i}" for i in range(5000))
    b = "\n".join(f"other {i}" for i in range(5000))
    got = iblt.likeness(digests([a, a]), digests([b, a + "\nend"]))
    assert got[0] == 0 and 0.99 < got[1] < 1


def plain(rows):
    low = -(2**63)
    order = sorted(rows, key=lambda r: (-(low if r[0] is None else r[0]), r[1] or ""))
    out = []
    for i, (doc_id, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        near = (plain_likeness(t, edited), plain_likeness(t, after))
        out.append((doc_id, len(t), digest, *[round(x, 9) for x in near]))
    return sorted(out, key=repr)


def got(frame):
    rows = frame.select("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next").collect()
    return sorted(((*r[:3], *[round(x, 9) for x in r[3:]]) for r in rows), key=repr)


def test_edges_and_stretches(llm):
    rows = [(i, f"text {i} " * (i % 7) + "\né" * i) for i in range(40)]
    rows += [(5, None), (5, "again"), (None, "no id"), (8, ""), (8, "")]
    docs = table(llm, rows)
    for stretches in (1, 2, 7, 100):
        assert got(iblt.with_edits(docs, stretches)) == plain(rows)
    assert got(iblt.with_edits(table(llm, [(3, "alone here")]))) == plain([(3, "alone here")])
    assert got(iblt.with_edits(table(llm, []))) == []


def test_whole_table(llm, small):
    docs = llm.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    frame = iblt.with_edits(docs)
    assert got(frame) == plain(rows)
    by_text = {}
    texts = dict(rows)
    for r in frame.collect():
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)
