from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docflow.llm import phrases
from tests.llm.conftest import table

DOCS = "lang string, text string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counts(docs):
    found: dict[str, Counter] = {}
    for lang, text in docs:
        own = found.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            own[""] += len(words)
            for k in range(1, 6):
                own.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return found


def plain(docs, least, reported):
    out = []
    for lang, own in counts(docs).items():
        often = {p: a for p, a in own.items() if p and a >= least}
        rows = []
        for phrase, a in often.items():
            words = phrase.split(" ")
            if len(words) < 2 or any(
                b >= a and f" {phrase} " in f" {longer} " and longer != phrase
                for longer, b in often.items()
            ):
                continue
            cuts = []
            for k in range(1, len(words)):
                left, r = often[" ".join(words[:k])], often[" ".join(words[k:])]
                cuts.append((1000 * a * own[""] // (left * r), k, left, r))
            score, _, left, r = min(cuts)
            rows.append((-score, -a, phrase.encode(), left, r))
        for rank, (score, a, phrase, left, r) in enumerate(sorted(rows)[:reported], 1):
            out.append((lang, rank, phrase.decode(), -a, left, r, own[""], -score))
    return sorted(out)


def got(frame):
    assert frame.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in frame.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "Big", "é", "x1", "cat", "ß-y", " z", "😀", "q"]
    passage = "One two three, four five six seven eight"
    docs = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!?"]) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.3:
            text += passage
        docs.append((rng.choice(["en", "en", "fr", None]), text))
    return docs


@pytest.mark.parametrize("sample", [0.001, 0.5])
def test_as_plain_counting(llm, sample):
    """Also with a sample that proposes nothing, so that each length needs a pass of its own."""
    docs = [*corpus(1, 120), ("en", None), ("en", ""), (None, "One two three")]
    frequent = phrases.frequent_phrases(table(llm, [(a or "und", b or "") for a, b in docs], DOCS), 9, sample)
    want = {(lang, p): a for lang, own in counts(docs).items() for p, a in own.items() if a >= 9 or not p}
    assert {(r.lang, r.phrase): r.n for r in frequent.collect()} == want


def test_scores_and_ranks(llm):
    docs = corpus(2, 150)
    frame = table(llm, docs, DOCS)
    for name in ("phrase", "n", "a", "words", "k", "left", "salt", "rank", "l"):
        frame = frame.withColumn(name, phrases.F.lit(7))
    assert got(phrases.collocations(frame, 8, 25)) == plain(docs, 8, 25)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    text = "a b c. d e f " * 500 + "x" * 3000 + " a b"
    whole = Counter()
    everything = np.full(4, ~np.uint64(0))
    for block in (1 << 20, 100):
        monkeypatch.setattr(phrases, "BLOCK", block)
        batch = pa.RecordBatch.from_pydict({"lang": ["x"] * 3, "text": [text, "a b", text[:90]]})
        found = Counter()
        blocks = list(phrases._blocks(batch))
        assert len(blocks) == 1 if block > 100 else len(blocks) > 50
        for langs, texts in blocks:
            for _, names, _, n in phrases.border_counts(phrases.Block(langs, texts), everything):
                for name, count in zip(names.to_pylist(), n, strict=True):
                    found[name] += int(count)
        want = counts([("x", text), ("x", "a b"), ("x", text[:90])])["x"]
        assert found == want
        whole.update(found)


def test_filter_holds_all_proposals(llm):
    rng = np.random.default_rng(3)
    hashes = rng.integers(-(2**63), 2**63, 6000)
    made = phrases.hash_filter(table(llm, [(int(h),) for h in hashes[:3000]], "hash long"))
    assert phrases._member(made, hashes[:3000].view(np.uint64)).all()
    assert phrases._member(made, hashes[3000:].view(np.uint64)).mean() < 0.05
    assert not phrases.hash_filter(table(llm, [], "hash long")).any()


def test_hashes_stand_for_phrases():
    """Equal phrases have equal hashes at any place and in any block; others do not."""
    texts = ["a b c d e f", "x a b c d e f", "b a", "a b. c d"]
    seen: dict[int, set] = {}
    for langs in (["x"] * 4, ["y"] * 4):
        block = phrases.Block(pa.array(langs), pa.array(texts))
        at = block.is_word
        for length in range(1, 6):
            places, _, _, _ = block.phrases(length, at)
            lang, names = block.named(places, length)
            for hash_, key in zip(block.hashes[places].tolist(), zip(lang.to_pylist(), names.to_pylist()), strict=True):
                seen.setdefault(hash_, set()).add(key)
            mask = np.zeros(len(at), bool)
            mask[places] = True
            at = np.append(mask[:-1] & mask[1:], False)
    assert all(len(keys) == 1 for keys in seen.values())
    assert len(seen) == sum(len(c) - 1 for c in counts([("x", t) for t in texts] + [("y", t) for t in texts]).values())


def test_empty_table(llm):
    assert got(phrases.collocations(table(llm, [], DOCS))) == []


def test_products_beyond_64_bits(llm):
    row = llm.range(1).selectExpr(
        "cast(9000000000000000 as decimal(18,0)) * cast(8000000000000000 as decimal(18,0)) as above",
        "cast(7000000000000000 as decimal(18,0)) * cast(6000000000000000 as decimal(18,0)) as below",
    ).selectExpr("(cast(above as decimal(35,0)) * cast(1000 as decimal(4,0))) div below as s").first()
    assert row.s == 1000 * 9 * 8 // (7 * 6)
