"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: at line ends, and inside a line behind each word
whose own hash ends in three zero bits, so a change moves no boundary but its own.
Each paragraph's 64-bit digest (with its occurrence number, so that repeats
count) is added to one of the cells of each of three rows. A cell keeps a count,
the xor of the digests and the xor of their checksums. Two sketches of one size subtract cell by
cell; cells that hold one digest are peeled off until nothing is left, which
gives the digests only one text has. If cells are left, both texts are sketched
again with twice the cells.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 3
#: Cells of a row in a stored fingerprint; comparisons start with it.
BASE_CELLS = 8
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = values + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def paragraph_digests(text: str, cuts: dict[bytes, bool]) -> list[int]:
    """One digest per paragraph, in order. ``cuts`` remembers which words end one."""
    digests = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        start, words = 0, line.split(b" ")
        for i, word in enumerate(words):
            cut = cuts.get(word)
            if cut is None:
                if len(cuts) > 200_000:
                    cuts.clear()
                cut = cuts[word] = zlib.crc32(word) & 7 == 0
            if cut or i + 1 == len(words):
                part = b" ".join(words[start : i + 1])
                digests.append(xxhash.xxh3_64_intdigest(part))
                start = i + 1
    return digests


class Digests:
    """Digests of a batch of texts: values, the text of each, texts' sizes."""

    def __init__(self, texts: list[str], cuts: dict[bytes, bool]):
        lists = [paragraph_digests(t, cuts) if t else [] for t in texts]
        self.sizes = np.array([len(x) for x in lists], dtype=np.int64)
        self.of = np.repeat(np.arange(len(lists)), self.sizes)
        raw = np.array([d for x in lists for d in x], dtype=np.uint64)
        order = np.lexsort((raw, self.of))
        value, of = raw[order], self.of[order]
        new = np.ones(len(raw), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        occurrence = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
        self.of = of
        self.values = _mixed(_mixed(value, 1) + occurrence.astype(np.uint64), 2)


class Sketches:
    """Cells of the sketches of some texts, all with one number of cells a row."""

    def __init__(self, texts: int, cells: int):
        self.cells = cells
        size = texts * ROWS * cells
        self.count = np.zeros(size, dtype=np.int64)
        self.keys = np.zeros(size, dtype=np.uint64)
        self.checks = np.zeros(size, dtype=np.uint64)

    def add(self, of: np.ndarray, values: np.ndarray, signs: np.ndarray) -> None:
        checks = _mixed(values, 9)
        for row in range(ROWS):
            local = _mixed(values, 3 + row) % np.uint64(self.cells)
            at = (of * ROWS + row) * self.cells + local.astype(np.int64)
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.keys, at, values)
            np.bitwise_xor.at(self.checks, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, sign) of each recovered digest, and per text whether cells are left."""
        of_out, sign_out = [], []
        width = ROWS * self.cells
        while True:
            ones = np.flatnonzero(np.abs(self.count) == 1)
            ones = ones[_mixed(self.keys[ones], 9) == self.checks[ones]]
            if not len(ones):
                break
            of, values, signs = ones // width, self.keys[ones], self.count[ones]
            order = np.lexsort((values, of))
            of, values, signs = of[order], values[order], signs[order]
            new = np.ones(len(of), dtype=bool)
            new[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
            of, values, signs = of[new], values[new], signs[new]
            self.add(of, values, -signs)
            of_out.append(of)
            sign_out.append(signs)
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        failed = left.reshape(-1, width).any(axis=1)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        return join(of_out), join(sign_out), failed


def fingerprints(digests: Digests) -> list[str]:
    """The cells of each text's base sketch as hex text."""
    sketch = Sketches(len(digests.sizes), BASE_CELLS)
    sketch.add(digests.of, digests.values, np.ones(len(digests.of), dtype=np.int64))
    packed = np.empty((len(sketch.count), 5), dtype="<u4")
    packed[:, 0] = sketch.count
    packed[:, 1:3] = sketch.keys.reshape(-1, 1).view("<u4").reshape(-1, 2)
    packed[:, 3:5] = sketch.checks.reshape(-1, 1).view("<u4").reshape(-1, 2)
    rows = packed.reshape(len(digests.sizes), -1)
    return [r.tobytes().hex() for r in rows]


def likeness(left: Digests, right: Digests) -> np.ndarray:
    """Shared paragraphs over all paragraphs of two versions, from peeled sketches.

    Two texts without paragraphs are alike (1).
    """
    total = len(left.sizes)
    only_left, only_right = (np.zeros(total, dtype=np.int64) for _ in range(2))
    pending, cells = np.arange(total), BASE_CELLS
    a_of, b_of = left.of, right.of
    a_values, b_values = left.values, right.values
    while len(pending):
        place = np.full(total, -1, dtype=np.int64)
        place[pending] = np.arange(len(pending))
        keep_a, keep_b = place[a_of] >= 0, place[b_of] >= 0
        a_of, a_values = a_of[keep_a], a_values[keep_a]
        b_of, b_values = b_of[keep_b], b_values[keep_b]
        sketch = Sketches(len(pending), cells)
        sketch.add(place[a_of], a_values, np.ones(len(a_of), dtype=np.int64))
        sketch.add(place[b_of], b_values, -np.ones(len(b_of), dtype=np.int64))
        of, signs, failed = sketch.peel()
        done = ~failed
        for sign, found in ((1, only_left), (-1, only_right)):
            counts = np.bincount(of[signs == sign], minlength=len(pending))
            found[pending[done]] = counts[done]
        pending, cells = pending[failed], cells * 2
    shared = left.sizes - only_left
    union = left.sizes + only_right
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def _edited(text: str, after: str) -> str:
    """The last third of the code points replaced by the first of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


#: Texts of a batch are sketched together up to this many characters.
SKETCH_CHARS = 4_000_000


def _compare(rows: list[tuple], cuts: dict[bytes, bool]) -> pd.DataFrame:
    """``rows``: (doc_id, text, next text)."""
    texts, following = [r[1] for r in rows], [r[2] for r in rows]
    edits = [_edited(t, a) for t, a in zip(texts, following, strict=True)]
    own, changed, after = (Digests(x, cuts) for x in (texts, edits, following))
    digest = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]
    return pd.DataFrame(
        {
            "doc_id": pd.array([r[0] for r in rows], dtype="Int64"),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": digest,
            "fingerprint": fingerprints(own),
            "edited_fingerprint": fingerprints(changed),
            "near_edited": likeness(own, changed),
            "near_next": likeness(own, after),
        }
    )


def _walk(batches: Iterator) -> Iterator[pd.DataFrame]:
    """Pairs each row with the next one of its stretch; the rows come sorted.

    Only the row in hand and one batch are kept.
    """
    cuts: dict[bytes, bool] = {}
    held, rows, chars = None, [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("stretch", "ahead", "doc_id", "text")]
        for stretch, ahead, doc_id, text in zip(*columns, strict=True):
            text = text or ""
            if held is not None and held[0] == stretch:
                rows.append((held[1], held[2], text))
                chars += 2 * len(held[2]) + len(text)
            held = None if ahead else (stretch, doc_id, text)
            if chars > SKETCH_CHARS or len(rows) > 4000:
                yield _compare(rows, cuts)
                rows, chars = [], 0
    if rows:
        yield _compare(rows, cuts)


def with_edits(docs: DataFrame, stretches: int | None = None) -> DataFrame:
    """Each document against its edited version and the next document.

    The order is by falling doc id (rows without id last, equal ids by text); the
    last is followed by the first. Ids are cut into stretches at ids that occur;
    the rows of such an id are also sent, marked, to the stretch above, whose last
    row needs them. So texts move once and no task sees more than its stretches.
    Null texts count as empty. Without rows the result is empty; repeated rows
    are repeated. Columns other than doc_id and text are not read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretches = stretches or 4 * parts
    lowest = F.lit(-(2**63)).cast("long")
    slim = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), lowest).alias("place"), "doc_id", "text"
    )
    shares = [i / stretches for i in range(1, stretches)]
    ends = slim.agg(
        F.max("place").alias("top"),
        F.percentile_approx("place", shares or [0.5], max(10_000, 50 * stretches)).alias("at"),
    ).first()
    if ends.top is None:
        return spark.createDataFrame([], OUT)
    bounds = np.unique(np.array([*(ends.at or []), ends.top], dtype=np.int64))

    @F.pandas_udf("array<struct<stretch: long, ahead: boolean>>")
    def targets(places: pd.Series) -> pd.Series:
        values = places.to_numpy(dtype=np.int64)
        stretch = np.searchsorted(bounds, values)
        on_bound = bounds[stretch] == values
        last = len(bounds) - 1
        return pd.Series(
            [
                [{"stretch": s, "ahead": False}]
                + ([{"stretch": 0 if s == last else s + 1, "ahead": True}] if b else [])
                for s, b in zip(stretch.tolist(), on_bound.tolist(), strict=True)
            ]
        )

    dealt = slim.withColumn("target", F.explode(targets("place"))).select(
        "target.stretch", "target.ahead", "place", "doc_id", "text"
    )
    order = [F.col("stretch"), F.col("ahead"), F.col("place").desc(), F.col("text")]
    sorted_rows = dealt.repartition(parts, "stretch").sortWithinPartitions(*order)

    def run(batches):
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("n_chars", pa.int64()),
                *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
                ("near_edited", pa.float64()),
                ("near_next", pa.float64()),
            ]
        )
        for frame in _walk(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    return sorted_rows.select("stretch", "ahead", "doc_id", "text").mapInArrow(run, OUT)
