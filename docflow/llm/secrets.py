"""Secret scan: fixed patterns, and two character Markov models.

Patterns find assignments, access keys and hex strings. Long runs of identifier
characters elsewhere are judged by the mean log-likelihood ratio of their character
pairs under two first-order models: random strings, learned from the runs that patterns
mark as secrets, and ordinary identifiers, learned from the unmarked runs without digits.
Unmarked runs with digits are not learned from, only judged: there the unmarked secrets
would be. Both are counted over the whole corpus. Everything is expressed in columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import saved

KINDS = ("assign", "access", "hex", "model")
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?"
    "([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_CHARS = 12
#: Runs are matched greedily, so a least length in the pattern drops the same
#: matches as a test of their length.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
RUN = "[A-Za-z0-9+/_=-]{16,}"
#: Unmarked runs of this form are the labelled ordinary identifiers.
ORDINARY = "^[A-Za-z_-]+$"
#: Characters a run can consist of.
ALPHABET = 66
#: Weight of a character's own share against counted pairs.
SMOOTHING = 10.0
#: Least mean log-likelihood ratio per character pair, in nats.
MIN_RATIO = 0.5

_SPANS = "array<struct<start:int,stop:int,text:string>>"


def _spans(text: Column, pattern: str, found: Column, values: Column | None = None, keep=None) -> Column:
    """(start, stop, text) of all matches; ``found`` are their texts, in order.

    Positions are sums of the lengths of matches and of the gaps between them.
    ``keep(row, i)``: whether match i (from 0) stays; ``row`` has the matches' ``values``.
    """
    kind = f"struct<at:int,spans:{_SPANS}>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")).cast(kind)

    def placed(both: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.length(F.get(both["gaps"], i))
            match = F.get(both["found"], i)
            stop = begin + F.length(match)
            span = F.struct(begin.alias("start"), stop.alias("stop"), match.alias("text"))
            more = F.array_append(acc["spans"], span)
            kept = more if keep is None else F.when(keep(both, i), more).otherwise(acc["spans"])
            return F.struct(stop.alias("at"), kept.alias("spans")).cast(kind)

        return F.aggregate(
            F.sequence(F.lit(0), F.size(both["found"]) - 1), start, step, lambda acc: acc["spans"]
        )

    # one-element transform: binds gaps and matches, so that the text is cut once
    # and not once per span
    parts = [F.split(text, pattern, -1).alias("gaps"), found.alias("found")]
    if values is not None:
        parts.append(values.alias("values"))
    all_spans = F.get(F.transform(F.array(F.struct(*parts)), placed), F.lit(0))
    return F.when(F.size(found) > 0, all_spans).otherwise(F.array().cast(_SPANS))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")),
    )


def _scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base spans, other runs with whether a base span touches them)."""
    text = F.col("text")
    found = docs.select(
        F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).select(
        "doc_id",
        "text",
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("assigns"),
        F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)).alias("accesses"),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)).alias("hexes"),
        F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("runs"),
    )
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))

    def long_enough(row: Column, i: Column) -> Column:
        return F.length(F.get(row["values"], i)) >= ASSIGN_CHARS

    placed = found.select(
        "doc_id",
        _spans(text, ASSIGN, F.col("assigns"), values, long_enough).alias("assign"),
        _spans(text, ACCESS, F.col("accesses")).alias("access"),
        _spans(text, HEX, F.col("hexes")).alias("hex"),
        _spans(text, RUN, F.col("runs")).alias("run"),
    )
    base = F.array_sort(
        F.concat(*[_tagged(F.col(k), i) for i, k in enumerate(KINDS[:3])])
    )
    placed = placed.withColumn("base", base)

    def touched(run: Column) -> Column:
        return F.exists(
            F.col("base"), lambda b: (b["start"] < run["stop"]) & (run["start"] < b["stop"])
        )

    judged = F.transform(
        "run",
        lambda r: F.struct(
            r["start"].alias("start"),
            r["stop"].alias("stop"),
            r["text"].alias("text"),
            touched(r).alias("secret"),
        ),
    )
    return placed.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        "base",
        judged.alias("runs"),
    )


def _pair(text: Column, i: Column) -> Column:
    """Number of the character pair at 1-based place i: both are ASCII."""
    return F.ascii(F.substring(text, i, F.lit(1))) * 128 + F.ascii(
        F.substring(text, i + 1, F.lit(1))
    )


def _ratios(scanned: DataFrame) -> DataFrame:
    """One row: the log-likelihood ratio of each character pair, as an array.

    The counts have at most two rows per pair of the alphabet.
    """
    runs = scanned.select(F.explode("runs").alias("r")).where(
        F.col("r.secret") | F.col("r.text").rlike(ORDINARY)
    )
    pairs = runs.select(
        F.col("r.secret").alias("secret"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("r.text") - 1), lambda i: _pair(F.col("r.text"), i)
            )
        ).alias("pair"),
    )
    counts = pairs.groupBy("pair").agg(
        F.count(F.when(F.col("secret"), 1)).alias("random"),
        F.count(F.when(~F.col("secret"), 1)).alias("plain"),
    )
    counts = saved(counts, "secret-pairs")
    grid = counts.sparkSession.range(128 * 128).select(F.col("id").cast("int").alias("pair"))
    classes = ("random", "plain")
    full = grid.join(counts, "pair", "left").select(
        "pair",
        F.floor(F.col("pair") / 128).alias("first"),
        (F.col("pair") % 128).alias("second"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in classes],
    )
    firsts = full.groupBy("first").agg(*[F.sum(c).alias(f"{c}_first") for c in classes])
    seconds = full.groupBy("second").agg(*[F.sum(c).alias(f"{c}_second") for c in classes])
    totals = {c: counts.agg(F.coalesce(F.sum(c), F.lit(0)).alias(c)).scalar() for c in classes}
    joined = full.join(firsts, "first").join(seconds, "second")

    def log_chance(c: str) -> Column:
        """Of the second character after the first, smoothed by its own share."""
        share = (F.col(f"{c}_second") + 1) / (totals[c] + ALPHABET)
        return F.log((F.col(c) + SMOOTHING * share) / (F.col(f"{c}_first") + SMOOTHING))

    ratio = log_chance("random") - log_chance("plain")
    rows = joined.select(F.struct("pair", ratio.alias("ratio")).alias("x"))
    ordered = F.sort_array(F.collect_list("x"))
    return rows.agg(F.transform(ordered, lambda x: x["ratio"]).alias("ratios"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) of each document row.

    ``base`` and ``spans`` are arrays of (start, kind, stop) by start and kind, in code
    points, stop excluded; kind counts in ``KINDS``. Spans are the base ones and the runs
    that no base span touches and whose mean ratio passes ``MIN_RATIO``. Null and empty
    texts have none. Without any secret to learn from nothing is added.
    """
    scanned = saved(_scan(docs), "secret-scan")
    ratios = saved(_ratios(scanned), "secret-ratios").scalar()
    table = F.col("ratios")

    def random_like(run: Column) -> Column:
        pairs = F.sequence(F.lit(1), F.length(run["text"]) - 1)
        total = F.aggregate(
            pairs, F.lit(0.0), lambda acc, i: acc + F.get(table, _pair(run["text"], i))
        )
        return ~run["secret"] & (total >= MIN_RATIO * F.size(pairs))

    added = _tagged(F.filter("runs", random_like), KINDS.index("model"))
    open_runs = F.exists("runs", lambda r: ~r["secret"])
    return scanned.withColumn("ratios", F.when(open_runs, ratios)).select(
        "doc_id",
        *[f"n_{k}" for k in KINDS[:3]],
        "base",
        F.array_sort(F.concat("base", added)).alias("spans"),
    )


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end`` texts joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":",
                F.get(names, s["kind"]),
                s["start"].cast("string"),
                s["stop"].cast("string"),
            ),
        ),
        ",",
    )
