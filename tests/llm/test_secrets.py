from __future__ import annotations

import time

import hashlib
import random
import re

from pyspark.sql import functions as F

from docflow.llm import secrets
from docflow.llm.queries import secret_scan
from tests.llm.conftest import table

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)


def plain(text):
    text = text or ""
    found = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    found.sort(key=lambda x: (x[0], x[2]))
    counts = [sum(x[2] == k for x in found) for k in range(3)]
    return counts, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, b, k in found)


def check(rows, frame):
    got = frame.select(
        "doc_id", "n_assign", "n_access", "n_hex", secrets.spelled(F.col("base")).alias("base")
    )
    wanted = [(i, *plain(t)[0], plain(t)[1]) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_whole_table(llm, small):
    docs = llm.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(rows, secrets.find_secrets(docs))
    for r in secret_scan(llm, small).collect():
        base = plain(dict(rows)[r.doc_id])[1]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))


def test_models_add_random_runs_only(llm):
    rng = random.Random(4)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(rng.choice(["tion", "er", "con", "pre", "ing", "al"]) for _ in range(6))
    noise = lambda: "".join(rng.choice(chars) for _ in range(32))
    rows = [(i, f"é {word()} token={noise()} and {word()}") for i in range(200)]
    lone = noise().replace("0", "x")
    rows += [(500, f"see {lone} there"), (501, f"see {word()} there")]
    spans = {
        r.doc_id: r.spans
        for r in secrets.find_secrets(table(llm, rows))
        .select("doc_id", secrets.spelled(F.col("spans")).alias("spans"))
        .collect()
    }
    assert spans[500] == f"model:4:{4 + len(lone)}" and spans[501] == ""
    assert sum("model" in s for s in spans.values()) == 1


def test_edges(llm):
    rows = [(1, None), (2, ""), (3, "token=short"), (3, "token=short"), (None, "😀 é AKIA" + "Q" * 14),
            (4, "token:secret:abcdefghijklmn API_KEY = 'abcdefghijkl' ApiKey=\"x=yyyyyyyyyyyy"),
            (5, "0123456789abcdef" * 9000), (6, "PASSWD:0123456789abcdef0"), (7, "AKIAAKIA"),
            (8, "ſecret=abcdefghijklmn toKen=abcdefghijklmn"), (9, "=" * 40)]
    docs = table(llm, rows).withColumn("base", F.lit(0)).withColumn("ratios", F.lit(0))
    check(rows, secrets.find_secrets(docs))
    assert secrets.find_secrets(docs.limit(0)).collect() == []
    alone = table(llm, [(1, "abcdefghijklmnopqrstuvw")])
    assert secrets.find_secrets(alone).first().spans == []


def test_time_grows_with_the_spans(llm):
    """One text with thousands of secrets, so that what is done per span shows."""
    text = " ".join(f"{i:024x}" if i % 2 else f"token = {'k%d' % i * 8}" for i in range(3000))
    start = time.time()
    [row] = secrets.find_secrets(table(llm, [(1, text)])).collect()
    assert (row.n_assign, row.n_hex) == (1500, 1500) and time.time() - start < 60
