"""Benchmark decontamination: hash set of benchmark windows over document windows.

The windows of the benchmark (13 consecutive words, or the whole of a shorter
item) are broadcast as hashes with their words. Each document's windows are
looked up by hash and verified word by word. A benchmark of more than
``BLOCK_WORDS`` words is taken in blocks of items: documents pass one block after
the other and carry what they hit, so a broadcast stays bounded whatever the size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import unused

WINDOW = 13
#: Words of benchmark text that one broadcast may hold.
BLOCK_WORDS = 2_000_000

#: A-Z lower-cased, other ASCII characters outside 0-9 and a-z blank.
_TABLE = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32
    for i in range(256)
)
#: The same words in a text as it is, capitals included.
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

HITS = (
    "n_words long, hits array<struct<start: int, stop: int>>, items array<string>, "
    "spans array<struct<start: int, stop: int>>"
)


def item_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WindowSet:
    """The distinct windows of some items, by length, with the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, text in items:
            words = item_words(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            width = min(WINDOW, len(ids))
            if width:
                for i in range(len(ids) - width + 1):
                    owners[tuple(ids[i : i + width])].add(name)
        by_width = defaultdict(list)
        for window in owners:
            by_width[len(window)].append(window)
        self.tables = []
        for width, windows in sorted(by_width.items()):
            rows = np.array(windows, dtype=np.int64)
            factors, hashes = self._distinct_hashes(rows)
            order = np.argsort(hashes)
            names = [sorted(owners[windows[i]]) for i in order]
            self.tables.append((width, factors, hashes[order], rows[order], names))

    @staticmethod
    def _distinct_hashes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for seed in range(64):
            factors = np.random.default_rng(seed).integers(1, 2**63, rows.shape[1], np.uint64)
            hashes = ((rows + 1).astype(np.uint64) * (factors | np.uint64(1))).sum(axis=1)
            if len(np.unique(hashes)) == len(hashes):
                return factors | np.uint64(1), hashes
        raise ValueError("no hash without collisions found")

    def find(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(start, width, item names) of each occurrence.

        ``ids`` are the words of many documents in a row, ``ends`` for each word
        the end of its document.
        """
        unknown = np.concatenate(([0], np.cumsum(ids < 0)))
        places = np.arange(len(ids))
        for width, factors, hashes, rows, names in self.tables:
            at = places[places + width <= ends]
            at = at[unknown[at + width] == unknown[at]]
            if not len(at):
                continue
            keys = np.zeros(len(at), dtype=np.uint64)
            for j in range(width):
                keys += (ids[at + j] + 1).astype(np.uint64) * factors[j]
            found = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
            same = hashes[found] == keys
            at, found = at[same], found[same]
            exact = (ids[at[:, None] + np.arange(width)] == rows[found]).all(axis=1)
            for start, k in zip(at[exact].tolist(), found[exact].tolist(), strict=True):
                yield start, width, names[k]


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, stop in sorted(intervals):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return [(a, b) for a, b in merged]


def _char_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word intervals as code point intervals."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in hits]


def _scan(texts: pd.Series, before: pd.DataFrame | None, windows: WindowSet) -> pd.DataFrame:
    words = [item_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    stops = np.cumsum(sizes)
    get = windows.vocabulary.get
    ids = np.fromiter(
        (get(w, -1) for w in chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum())
    )
    hits: dict[int, list] = defaultdict(list)
    items: dict[int, set] = defaultdict(set)
    for start, width, names in windows.find(ids, np.repeat(stops, sizes)):
        row = int(np.searchsorted(stops, start, side="right"))
        first = start - int(stops[row] - sizes[row])
        hits[row].append((first, first + width))
        items[row].update(names)
    if before is not None:
        for row, (old, names) in enumerate(zip(before["hits"], before["items"], strict=True)):
            hits[row] += [(h["start"], h["stop"]) for h in old]
            items[row].update(names)
    out = []
    for row, text in enumerate(texts):
        merged = _merged(hits.get(row, []))
        spans = _char_spans(text, merged) if merged else []
        pair = [[{"start": a, "stop": b} for a, b in x] for x in (merged, spans)]
        out.append((int(sizes[row]), pair[0], sorted(items.get(row, ())), pair[1]))
    return pd.DataFrame(out, columns=["n_words", "hits", "items", "spans"])


def _pass(text: Column, before: Column | None, items: list, spark) -> Column:
    shared = spark.sparkContext.broadcast(WindowSet(items))
    if before is None:

        @F.pandas_udf(HITS)
        def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield _scan(texts, None, shared.value)

        return first(text)

    @F.pandas_udf(HITS)
    def further(
        batches: Iterator[tuple[pd.Series, pd.DataFrame]],
    ) -> Iterator[pd.DataFrame]:
        for texts, old in batches:
            yield _scan(texts, old, shared.value)

    return further(text, before)


def _pieces(text: str | None, size: int) -> list[str | None]:
    """A text of at most ``size`` words, or pieces that hold each of its windows."""
    words = item_words(text)
    if len(words) <= size:
        return [text]
    step = max(1, size - WINDOW + 1)
    cuts = range(0, max(1, len(words) - WINDOW + 1), step)
    parts = (b" ".join(words[i : i + step + WINDOW - 1]) for i in cuts)
    return [p.decode("utf-8", "surrogatepass") for p in parts]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """(name, text) of all items, dealt into lists of at most ``block_words`` words.

    Only a piece as short as a window may be longer. There is at least one list.
    """

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_pieces(t, block_words) for t in texts], dtype=object)

    rows = benchmark.distinct().select("name", F.explode(pieces("text")).alias("text"))
    items, held = [], 0
    for name, text in rows.toLocalIterator():
        n = len(item_words(text))
        if items and held + n > block_words:
            yield items
            items, held = [], 0
        items.append((name, text))
        held += n
    yield items


def with_hits(
    docs: DataFrame, benchmark: DataFrame, column: str = "_hits", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Add a struct of n_words, hit word intervals, hit items and hit character spans.

    Null and empty texts have no words and no hits; items without words have no
    windows; an item without id is called ``null``. Rows with one item id are one
    item. An empty benchmark hits nothing. A column of the given name is replaced,
    all others stay.
    """
    spark = docs.sparkSession
    named = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text"
    )
    result = docs
    for block, items in enumerate(_blocks(named, block_words)):
        before = F.col(column) if block else None
        result = result.withColumn(column, _pass(F.col("text"), before, items, spark))
    return result


def n_hit(hits: Column) -> Column:
    """Number of hit words."""
    return F.aggregate(
        hits["hits"], F.lit(0).cast("long"), lambda n, h: n + (h["stop"] - h["start"])
    )


def contaminated(hits: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= hits["n_words"])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without the contaminated ones; all columns and other rows stay."""
    name = unused(docs, "hits")
    marked = with_hits(docs, benchmark, name)
    return marked.where(~contaminated(F.col(name))).drop(name)


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, hit passages cut out of their texts."""
    name = unused(docs, "hits")
    marked = with_hits(docs, benchmark, name)
    kept = F.concat(
        F.aggregate(
            F.col(name)["spans"],
            F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
            lambda acc, s: F.struct(
                F.concat(
                    acc["text"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
                ).alias("text"),
                s["stop"].alias("at"),
            ),
            lambda acc: F.concat(
                acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))
            ),
        )
    )
    return marked.withColumn(
        "text", F.when(F.size(F.col(name)["spans"]) > 0, kept).otherwise(F.col("text"))
    ).drop(name)
