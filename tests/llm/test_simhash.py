from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from docflow.llm import simhash
from docflow.llm.components import components
from tests.llm.conftest import table


def plain_print(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), seed=42) for i in range(n)
    ]
    value = 0
    for bit in range(64):
        if 2 * sum(h >> bit & 1 for h in hashes) > n:
            value |= 1 << bit
    return value


def plain_groups(prints, distance):
    """prints: (doc_id, fingerprint); smallest id that can be reached, for each row."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [least.get(root(i)) for i in range(len(prints))]


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def test_whole_table_against_all_pairs(llm, small):
    docs = llm.read.parquet(f"{small}/documents.parquet")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [(i, plain_print(t)) for i, t in texts]
    wanted = [
        (i, signed(p), g)
        for (i, p), g in zip(prints, plain_groups(prints, 2), strict=True)
    ]
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == wanted


def test_edges(llm):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One  TWO"), (4, "one two"), (None, "one two"),
            (5, "x" * 200_000), (None, None)]
    docs = table(llm, rows).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(9))
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)
    zero = [(i, 0, 1) for i in (1, 2, 3, None)]
    two = signed(plain_print("one two"))
    one = signed(plain_print("x" * 200_000))
    assert got == sorted([*zero, (4, two, 4), (4, two, 4), (None, two, 4), (5, one, 5)], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_links_connect_like_all_pairs(llm):
    """Small keys, crowded keys and chains give the same components as all pairs."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(3):  # crowds: hundreds within a few bits, sharing most segments
        centre = rng.getrandbits(64)
        for _ in range(120):
            value = centre
            for _ in range(rng.randint(0, 5)):
                value ^= 1 << rng.randrange(64)
            prints.add(value)
    chain = rng.getrandbits(64)
    for bit in range(0, 60, 2):
        prints.add(chain)
        chain ^= 3 << bit
    ordered = sorted(prints)
    for distance in (0, 1, 2):
        fps = table(llm, [(signed(p),) for p in ordered], "fp long")
        linked = simhash.links(fps, distance).collect()
        for a, b in linked:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= distance
        found = {r.node: r.root for r in components(simhash.links(fps, distance)).collect()}
        numbered = [(i, p) for i, p in enumerate(ordered)]
        groups = plain_groups(numbered, distance)
        roots = [found.get(signed(p), signed(p)) for p in ordered]
        assert len(set(zip(groups, roots, strict=True))) == len(set(groups)) == len(set(roots))


def test_components_of_paths_and_stars(llm):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, components(table(llm, edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}
    assert components(table(llm, [], "a long, b long")).collect() == []


def test_one_of_each(llm):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (2, text), (2, text), (None, text), (9, "else"), (None, "new"), (None, "new")]
    docs = table(llm, rows)
    names = ("_simhash_key", "simhash_key", "fp", "component_id", "n")
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns
    got = sorted(map(tuple, one.collect()), key=repr)
    assert got == sorted([(2, text, *names), (9, "else", *names), (None, "new", *names)], key=repr)
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_one_of_each_is_the_smallest_of_its_component(llm):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        base = words[(i % 12) * 30 : (i % 12) * 30 + 200]
        if i >= 12 and rng.random() < 0.7:
            base = [*base[:-1], f"end{i}"]
        rows.append((i, " ".join(base)))
    docs = table(llm, rows)
    wanted = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == wanted
    assert len(wanted) < len(rows)


def test_unlike_texts_of_one_id_stay(llm):
    text = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(1, text), (1, other), (1, other), (2, other), (3, "else")]
    got = sorted(map(tuple, simhash.one_of_each(table(llm, rows)).collect()))
    assert got == sorted([(1, text), (1, other), (3, "else")])
