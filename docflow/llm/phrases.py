"""Phrase collocation mining by Toivonen's method.

A sample of the documents proposes phrases: those of one to five words that are frequent in
it at a lowered threshold. A pass over all documents then counts the proposed phrases and
their negative border: the phrases that were not proposed although both their parts, without
the last and without the first word, were. (All single words are counted.) Proposed phrases are
counted by text, the border by 64-bit hashes: no such count can come out too low, so what stays
below the threshold is not frequent. A border phrase that reaches it is a failure of the
sample. An expansion pass counts the failures by text, and every phrase that a failure, or a
phrase counted because of one, is the first or last part of. That closes the border: the
parts of a frequent phrase are frequent, so either both were proposed and the phrase was counted
in the first pass, or one of them is a failure or counted because of one, and so is the phrase.

Proposals, frequent phrases and failures travel to the tasks as bit filters of bounded
size. What passes a filter wrongly is only counted in vain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.common import saved
from docflow.session import spread

LONGEST = 5
LEAST = 100
REPORTED = 2000
#: Share of the documents that proposes phrases.
SAMPLE = 1 / 8

#: Bytes of text that a task turns into numbers at once; longer texts are cut between pieces.
BLOCK = 4 << 20
#: Bits of the filter per proposed phrase, and of the largest filter (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27
_PROBES = 3
#: Named counts that a task holds before it gives them out.
HELD = 300_000
_SALTS = 32

# odd multipliers of the words' hashes by place, and of the language's
_PLACES = np.array([xxhash.xxh3_64_intdigest(f"place {i}") | 1 for i in range(LONGEST)], np.uint64)
_BREAK = "."
_SEPARATORS = r"[.,;:!?\x0A-\x0D]"
_COUNTS = "lang string, phrase string, n long"
_BORDER = "lang string, phrase string, hash long, n long"


def _hashes(texts: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(t) for t in texts.cast(pa.binary()).to_pylist()], np.uint64)


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bit numbers of each hash in a filter of ``bits`` (a power of two)."""
    mixed = hashes ^ (hashes >> np.uint64(29))
    for _ in range(_PROBES):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        yield (mixed & np.uint64(bits - 1)).astype(np.int64)


def _member(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for bit in _probes(hashes, len(filter_) * 64):
        found &= (filter_[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """Bit filter of the stored table ``hashes`` (hash), as 64-bit words.

    Bits are set in the tasks and merged before they reach the driver: at most
    ``MOST_BITS``, whatever the number of phrases.
    """
    wanted = max(hashes.count() * BITS_EACH, 1 << 12)
    bits = min(1 << (wanted - 1).bit_length(), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch["hash"].to_numpy().view(np.uint64)
            bit = np.unique(np.concatenate(list(_probes(own, bits))))
            start = np.flatnonzero(np.diff(bit >> 6, prepend=-1))
            value = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bit[start] >> 6), pa.array(value.view(np.int64))], ["at", "value"]
            )

    merged = hashes.select("hash").mapInArrow(run, "at long, value long")
    words = merged.groupBy("at").agg(F.bit_or("value").alias("value")).toPandas()
    filter_ = np.zeros(bits // 64, np.uint64)
    filter_[words["at"].to_numpy(np.int64)] = words["value"].to_numpy(np.int64).view(np.uint64)
    return filter_


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(languages, texts) of at most ``BLOCK`` bytes; a longer text is cut at separators."""
    langs, texts = batch["lang"], batch["text"]
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > BLOCK:
            yield langs.slice(start, at - start), texts.slice(start, at - start)
            start, held = at, 0
        if size > BLOCK:
            text = texts[at].as_py().encode()
            cut = 0
            while cut < len(text):
                stop = cut + BLOCK
                while stop < len(text) and text[stop] not in b".,;:!?\n\x0b\x0c\r":
                    stop += 1
                part = text[cut:stop].decode()
                yield langs.slice(at, 1), pa.array([part], pa.string())
                cut = stop
            start, held = at + 1, 0
        else:
            held += size
    if start < len(sizes):
        yield langs.slice(start), texts.slice(start)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each value among the distinct ones, their counts, their first indices)."""
    codes, kinds = pd.factorize(values)
    first = np.empty(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, np.bincount(codes, minlength=len(kinds)), first


class Block:
    """Words of some texts as numbers, and the phrases found so far at each place."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        marked = pc.replace_substring_regex(pc.ascii_lower(texts), _SEPARATORS, f" {_BREAK} ")
        marked = pc.binary_join_element_wise(marked, f" {_BREAK}", "")
        split = pc.ascii_split_whitespace(marked)
        of_text = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        flat = split.flatten()
        shown = pc.not_equal(flat, "")
        of_text = of_text[shown.to_numpy(zero_copy_only=False)]
        flat = flat.filter(shown).dictionary_encode()
        kinds = langs.dictionary_encode()
        self.langs, self.spelled = kinds.dictionary, flat.dictionary
        self.word = flat.indices.to_numpy().astype(np.int64)
        self.lang = kinds.indices.to_numpy().astype(np.int64)[of_text]
        self.is_word = pc.not_equal(self.spelled, _BREAK).to_numpy(zero_copy_only=False)[self.word]
        self.each = _hashes(self.spelled)[self.word]
        self.hashes = self.each * _PLACES[0] + _hashes(self.langs)[self.lang]
        # numbers of the phrases that start at a place: equal for equal phrases of one length
        self.gram = self.lang * len(self.spelled) + self.word

    def phrases(self, length: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """(places, number of the phrase at each, counts, a first place) of the phrases of
        ``length`` words that start where ``at`` says; the phrases one word shorter came before."""
        places = np.flatnonzero(at)
        if length > 1:
            last = places + length - 1
            self.gram[places] = self.gram[places] * len(self.spelled) + self.word[last]
            self.hashes[places] += self.each[last] * _PLACES[length - 1]
        codes, counts, first = _distinct(self.gram[places])
        self.gram[places] = codes
        return places, codes, counts, places[first]

    def named(self, first: np.ndarray, length: int) -> tuple[pa.Array, pa.Array]:
        words = [self.spelled.take(pa.array(self.word[first + i])) for i in range(length)]
        return (
            self.langs.take(pa.array(self.lang[first])),
            pc.binary_join_element_wise(*words, " "),
        )


def hash_counts(
    block: Block, known: np.ndarray | None, length: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of the phrases of ``length`` words whose parts both pass ``known``."""
    at = block.is_word
    for k in range(1, length + 1):
        places, codes, counts, first = block.phrases(k, at)
        if not len(places):
            return
        heads = block.hashes[first]
        if k == length:
            yield heads, counts
        else:
            at = _followed(at, places, _member(known, heads)[codes])


def _followed(at: np.ndarray, places: np.ndarray, passed: np.ndarray) -> np.ndarray:
    """Places where one phrase that passed starts and another at the next word."""
    passes = np.zeros(len(at), bool)
    passes[places] = passed
    return np.append(passes[:-1] & passes[1:], False)


def border_counts(block: Block, known: np.ndarray) -> Iterator[tuple]:
    """(languages, phrases, hashes, counts): phrases that pass ``known`` with their text, and
    without it those that do not but whose parts do. The empty phrase counts all words of
    a language."""
    totals = np.bincount(block.lang[block.is_word], minlength=len(block.langs))
    nothing = np.zeros(len(totals), np.int64)
    yield block.langs, pa.array([""] * len(totals), pa.string()), nothing, totals
    at = block.is_word
    for length in range(1, LONGEST + 1):
        places, codes, counts, first = block.phrases(length, at)
        if not len(places):
            return
        heads = block.hashes[first]
        member = _member(known, heads)
        yield *block.named(first[member], length), heads[member], counts[member]
        nameless = pa.nulls(int((~member).sum()), pa.string())
        yield nameless, nameless, heads[~member], counts[~member]
        at = _followed(at, places, member[codes])


def expansion_counts(
    block: Block, often: np.ndarray, fresh: np.ndarray
) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(languages, phrases, counts) of the phrases that pass ``fresh``, and of those with a part
    that does or was itself counted for this, both parts passing ``often`` or being such."""
    at, opened = block.is_word, np.zeros(len(block.word), bool)
    for length in range(1, LONGEST + 1):
        places, codes, counts, first = block.phrases(length, at)
        if not len(places):
            return
        heads = block.hashes[first]
        follows, known = opened[first], _member(often, heads)
        new = follows | known & _member(fresh, heads)
        yield *block.named(first[new], length), counts[new]
        at = _followed(at, places, (follows | known)[codes])
        starts = np.zeros(len(at), bool)
        starts[places] = new[codes]
        opened = np.append(starts[:-1] | starts[1:], False)


def _combined(tables: Iterator[pa.Table], keys: list[str]) -> Iterator[pa.Table]:
    """Counts of several blocks added up, so that a task gives out a phrase once and not
    once per block; given out early where more than ``HELD`` phrases would be held.
    Border phrases, counted by hash, are mostly met once and pass as they are."""
    held: list[pa.Table] = []
    for table in tables:
        if table.schema.names[0] != "lang" or table["lang"].null_count == table.num_rows:
            yield table
            continue
        held.append(table)
        if sum(t.num_rows for t in held) > HELD:
            merged = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum")])
            held = [merged.rename_columns([*keys, "n"])]
            if 2 * held[0].num_rows > HELD:
                yield held.pop()
    if held:
        merged = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum")])
        yield merged.rename_columns([*keys, "n"])


def _passed(docs: DataFrame, count, schema: str, *filters: np.ndarray | None) -> DataFrame:
    """One pass over the blocks of ``docs`` with broadcast filters."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(f) if f is not None else None for f in filters]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = [f.value if f else None for f in shared]
        tables = (
            pa.table([_plain(c) for c in columns], names)
            for batch in batches
            for langs, texts in _blocks(batch)
            for columns in count(Block(langs, texts), *values)
        )
        for table in _combined(tables, names[:-1]):
            yield from table.to_batches(max_chunksize=100_000)

    return docs.mapInArrow(run, schema)


def _plain(column) -> pa.Array:
    if isinstance(column, np.ndarray):
        return pa.array(column.view(np.int64) if column.dtype == np.uint64 else column)
    return column


def _proposed(docs: DataFrame, least: int) -> np.ndarray:
    """Filter of the phrases that occur ``least`` times in the sample, found length by length."""
    found, filter_ = None, None
    for length in range(1, LONGEST + 1):
        counts = _passed(docs, partial(hash_counts, length=length), "hash long, n long", filter_)
        summed = counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        longer = saved(summed.select("hash"), "phrases-proposed")
        found = longer if found is None else found.unionByName(longer)
        filter_ = hash_filter(found)
    return filter_


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: float = SAMPLE) -> DataFrame:
    """(lang, phrase, n) of all phrases of one to five words that occur at least ``least`` times.

    The empty phrase counts all words of a language. ``docs`` has lang and text, both
    without nulls. The sample decides only how much is left to the expansion: every count is
    over all documents.
    """
    drawn = saved(docs.sample(fraction=sample, seed=1), "phrases-sample")
    expected = least * sample
    lowered = max(2, floor(expected - 1.5 * sqrt(expected)))
    proposals = _proposed(drawn, lowered)
    counts = _passed(docs, border_counts, _BORDER, proposals)
    summed = counts.groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n"))
    often = saved(summed.where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases-often")
    found = often.where("phrase IS NOT NULL").select("lang", "phrase", "n")
    failures = saved(often.where("phrase IS NULL").select("hash"), "phrases-failures")
    if failures.isEmpty():
        return found
    known = hash_filter(often.where("phrase IS NULL OR phrase <> ''").select("hash"))
    counts = _passed(docs, expansion_counts, _COUNTS, known, hash_filter(failures))
    summed = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # either pass counts a phrase wholly, so one counted by both has one count
    both = found.unionByName(summed).groupBy("lang", "phrase").agg(F.max("n").alias("n"))
    return saved(both, "phrases-found")


def _parts(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, reported: int = REPORTED) -> DataFrame:
    """Each language's ``reported`` best phrases of two to five words, by their weakest cut.

    ``docs`` has lang and text; other columns are ignored, whatever their names. A null
    lang is ``und``, a null or empty text has no words. Repeated rows count again. Texts are
    lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at
    blanks and tabs, at any length. A phrase within a longer one that occurs as often is dropped. Ties
    end with the phrase in byte order. An empty table has no result rows.

    Result: lang, rank, phrase, a, l, r, n, score.
    """
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    frequent = frequent_phrases(texts, least)
    totals = saved(
        frequent.where("phrase = ''").select("lang", F.col("n").alias("words")), "phrases-totals"
    )
    words = F.split("phrase", " ")
    counts = frequent.where("phrase <> ''").select(
        "lang", "phrase", F.col("n").alias("a"), words.alias("words")
    )
    size = F.size("words")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda k: F.transform(
                F.sequence(F.lit(1), size - k + 1), lambda i: _parts(F.col("words"), i, k)
            ),
        )
    )
    covered = counts.where(size > 2).select(
        "lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer")
    )
    # counts and covering counts meet in one aggregate, combined in the tasks that made them
    kept = (
        counts.where(size > 1)
        .select("lang", "phrase", "a", F.lit(0).cast("long").alias("longer"))
        .unionByName(covered.withColumn("a", F.lit(None).cast("long")))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
        .where("longer < a")
        .select("lang", "phrase", "a", words.alias("words"))
    )
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select(
        "lang",
        "phrase",
        "a",
        "k",
        _parts(F.col("words"), F.lit(1), F.col("k")).alias("left"),
        _parts(F.col("words"), F.col("k") + 1, size).alias("right"),
    )
    known = counts.select("lang", "phrase", "a")
    for part, count in (("left", "l"), ("right", "r")):
        side = known.withColumnsRenamed({"phrase": part, "a": count})
        cuts = cuts.join(spread(side), ["lang", part])
    cuts = cuts.join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "words", "l", "r")}
    cuts = cuts.withColumn("above", wide["a"] * wide["words"]).withColumn("below", wide["l"] * wide["r"])
    # whole-number division of decimals of 38 digits: exact beyond 64 bits
    score = F.expr("(cast(above as decimal(35,0)) * cast(1000 as decimal(4,0))) div below")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "words").agg(weakest)
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    first = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    # the best of each share of a language, then the best of those
    best = scored.withColumn("salt", salt).withColumn("first", first).where(F.col("first") <= reported)
    return (
        best.withColumn("rank", rank)
        .where(F.col("rank") <= reported)
        .select(
            "lang",
            F.col("rank").cast("long").alias("rank"),
            "phrase",
            "a",
            F.col("cut.l").alias("l"),
            F.col("cut.r").alias("r"),
            F.col("words").alias("n"),
            F.col("cut.score").cast("long").alias("score"),
        )
    )
