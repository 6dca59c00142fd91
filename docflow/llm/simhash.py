"""SimHash near-duplicates, candidates pruned by the pigeonring principle.

A fingerprint has 64 bits, cut into ``distance + 1`` segments on a ring. If two
fingerprints differ in at most ``distance`` bits, some chain of consecutive
segments starts at an equal segment and has, at each length l, at most
``l * distance / segments`` different bits. For a chain of two that budget is one
bit, so the start segment plus one half of the next segment is equal in both:
that pair of values is the index key. Candidates of one key pass the budgets of
the longer chains, then the full Hamming check.

Only distinct fingerprints are compared. A key shared by more than
``BUCKET_PAIRS`` of them is not paired up: each of its members lists the 65
fingerprints within one bit of itself, and two members within two bits meet in at
least one of these, so the smallest member of each list links them. That way is
exact for a distance of up to two, linear in the members, and used for no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import saved, spaced_words, unused
from docflow.llm.components import components

BITS = 64
SEED = 42
#: Members of a key up to which all its pairs are made.
BUCKET_PAIRS = 24


def fingerprint_of(words: list[bytes], shingle_words: int) -> int:
    """Unsigned SimHash of the word shingles, repeats included; zero without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    width = min(shingle_words, len(words))
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(text[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8"
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle_words: int = 3) -> Column:
    """SimHash of a text as a signed long."""

    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = [fingerprint_of(spaced_words(t), shingle_words) for t in texts]
            yield pd.Series(np.array(values, dtype=np.uint64).astype(np.int64))

    return compute(text)


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments; they cover all 64 bits."""
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(value: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << width) - 1))


def _keys(value: Column, distance: int) -> Column:
    """Index keys: segment i with either half of segment i + 1."""
    segments = _segments(distance + 1)
    keys = []
    for i, (shift, width) in enumerate(segments):
        after, wide = segments[(i + 1) % len(segments)]
        half = wide // 2
        for j, (low, bits) in enumerate(((after, half), (after + half, wide - half))):
            key = F.shiftleft(F.lit(2 * i + j).cast("long"), 56)
            key = key.bitwiseOR(F.shiftleft(_part(value, shift, width), 20))
            keys.append(key.bitwiseOR(_part(value, low, bits)))
    return F.array(*keys)


def _chain_fits(left: Column, right: Column, key: Column, distance: int) -> Column:
    """Chains from the key's segment on keep within their budgets at each length."""
    segments = _segments(distance + 1)
    differ = left.bitwiseXOR(right)
    counts = [F.bit_count(_part(differ, *s)) for s in segments]
    starts = []
    for i in range(len(segments)):
        total, fits = counts[i], F.lit(True)
        for length in range(2, len(segments) + 1):
            total = total + counts[(i + length - 1) % len(segments)]
            fits = fits & (total <= length * distance // len(segments))
        starts.append((F.shiftrightunsigned(key, 57) == i) & fits)
    result = starts[0]
    for start in starts[1:]:
        result = result | start
    return result


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Links ``a < b`` that connect all distinct fingerprints within ``distance`` bits.

    ``prints`` has one row per distinct fingerprint ``fp``. The links hold every
    pair of the keys with few members; for the others enough pairs to connect
    what is within the distance. No link is longer than ``distance``.
    """
    if not 0 <= distance <= 2:
        raise ValueError("exact for distances from 0 to 2")
    if distance == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("a < b")
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"), distance)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = saved(keyed.join(sizes, "key"), "simhash-keys")

    few = (
        shared.where(F.col("n") <= BUCKET_PAIRS)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )
    pairs = (
        few.select("key", "fps", F.posexplode("fps").alias("i", "a"))
        .select("key", "a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
        .where(_chain_fits(F.col("a"), F.col("b"), F.col("key"), distance))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select("a", "b")
    )

    crowded = shared.where(F.col("n") > BUCKET_PAIRS).select("fp").distinct()
    flips = [F.shiftleft(F.lit(1).cast("long"), i) for i in range(BITS)]
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(f) for f in flips])
    near = crowded.select("fp", F.explode(around).alias("ball"))
    first = near.groupBy("ball").agg(F.min("fp").alias("a"), F.max("fp").alias("top"))
    stars = (
        near.join(first.where("a < top").select("ball", "a"), "ball")
        .where(F.col("a") < F.col("fp"))
        .select("a", F.col("fp").alias("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    )
    return pairs.union(stars).distinct()


def near_duplicates(
    docs: DataFrame, shingle_words: int = 3, distance: int = 2
) -> DataFrame:
    """(doc_id, fp, component_id) of each document row.

    Texts without words have fingerprint zero and are linked like any other. The
    component id is the smallest doc id that can be reached over links; rows
    without a doc id take part in linking but never name a component. Repeated
    rows are repeated in the result.
    """
    prints = saved(
        docs.select("doc_id", fingerprint(F.col("text"), shingle_words).alias("fp")),
        "simhash-prints",
    )
    classes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    found = components(links(classes.select("fp"), distance))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    named = saved(named, "simhash-named")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = saved(
        named.join(smallest, "root").select("fp", "component_id"), "simhash-members"
    )
    return prints.join(members, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, shingle_words: int = 3, distance: int = 2) -> DataFrame:
    """One document of each component of ``near_duplicates``, the one with the smallest id.

    All columns stay, whatever their names. Rows with one id and one text are one document,
    of which one row stays; rows with one id and other texts are documents of their own.
    Rows without id come last, so they stay only in groups without any id. No rows: no result.
    """
    number = F.col("doc_id").cast("long")
    key = F.struct(
        number.isNull().alias("last"),
        F.coalesce(number, F.lit(0)).alias("id"),
        F.xxhash64("text").alias("text_hash"),
    )
    name = unused(docs, "simhash_key")
    keyed = docs.withColumn(name, key)
    found = near_duplicates(keyed.select(F.col(name).alias("doc_id"), "text"), shingle_words, distance)
    first = found.where("doc_id = component_id")
    kept = saved(first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "simhash-kept")
    # shuffled at any size: the ids kept grow with the corpus, and a plan that turns
    # from broadcast to shuffle on the way makes its cost hard to foresee
    result = keyed.join(
        kept.select(F.col("doc_id").alias(name)).hint("shuffle_merge"), name, "left_semi"
    )
    if not kept.where("n > 1").isEmpty():
        result = result.dropDuplicates([name])
    return result.drop(name)
