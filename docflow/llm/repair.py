"""Conversation structure repair: cheapest edits by a cost DP, least audit by path ranking.

A conversation should read ``(s?(ua)+)?`` in its role initials. Its rows may be kept,
reroled or deleted and turns inserted; every edit has a cost. The places between rows
times the four states of that pattern are the nodes of a graph, edits are its arcs:

    K keep 0    R rerole to user or assistant 1    D delete 2    I insert a turn 5

Blank and duplicate rows must be deleted; a truncated row that stays costs 5 more. The
cost DP leaves the arcs of cheapest paths. The nodes of these arcs are ranked by the least
audit (string of edit letters) of length 1, 2, 4, 8, ... that starts at them: a rank of
twice the length is the rank of (own rank, rank at the own pointer's end), and pointers
double along. The ranks pick the least arc of a node, the doubled pointers give the
path's letters.

A conversation is cut into segments of at most ``SEGMENT`` rows. A segment is a 4 x 4
matrix of costs between states, matrices of one conversation are multiplied from its end,
and then every segment is solved on its own for each state it may be entered in. Only
these summaries, one per segment, meet per conversation. The digest of a repaired
conversation is taken while its rows stream by, so no conversation has to fit in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.common import saved
from docflow.operators.ordered import dense_index

#: Rows of one conversation that are solved together.
SEGMENT = 2048
#: Nodes ranked together in a Python worker.
NODES = 1 << 19

BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_FAR = 1 << 50
# states: nothing yet, after s, after u, after a
_START, _S, _U, _A = range(4)
_INITIALS = "sua"
# the state that an inserted or reroled turn leads to: an assistant after a user, else a user
_TURN = np.array([_U, _U, _A, _U])
# by initial (s, u, a, any other) and state: the state after a kept row, -1 where it may not stay
_KEPT = np.array([[_S, -1, -1, -1], [_U, _U, -1, _U], [-1, -1, _A, -1], [-1, -1, -1, -1]])
# letters of the arcs in ASCII order
_LETTERS = "DIKR"
_MUST_DELETE, _CUT_OFF, _PAD = 4, 8, 16


def _insert_closure() -> np.ndarray:
    """Cheapest insertions between two states."""
    cost = np.full((4, 4), _FAR)
    for state in range(4):
        cost[state, state] = 0
        for n in (1, 2):
            to = _TURN[state] if n == 1 else _TURN[_TURN[state]]
            cost[state, to] = min(cost[state, to], n * INSERT)
    return cost


def _times(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Product of cost matrices (or of a matrix and a vector of costs)."""
    if right.ndim == left.ndim:
        return np.minimum((left[..., :, :, None] + right[..., None, :, :]).min(-2), _FAR)
    return np.minimum((left + right[..., None, :]).min(-1), _FAR)


def _row_costs(code: int) -> np.ndarray:
    """Costs between states over one row, without insertions."""
    cost = np.full((4, 4), _FAR)
    more = TRUNCATED if code & _CUT_OFF else 0
    for state in range(4):
        cost[state, state] = DELETE
        if not code & _MUST_DELETE:
            to = _TURN[state]
            cost[state, to] = min(cost[state, to], REROLE + more)
            to = _KEPT[code & 3, state]
            if to >= 0:
                cost[state, to] = min(cost[state, to], KEEP + more)
    return cost


_CLOSURE = _insert_closure()
# insertions, then the row; the pad of a shorter segment changes nothing
_STEPS = np.stack(
    [_times(_CLOSURE, _row_costs(code)) for code in range(_PAD)]
    + [np.where(np.eye(4, dtype=bool), 0, _FAR)]
)
#: Costs to the end of a conversation, by state behind its last row.
_END = _CLOSURE[:, [_START, _A]].min(1)


def _padded(codes: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(codes), max(map(len, codes))), _PAD)
    for row, code in zip(out, codes, strict=True):
        row[: len(code)] = code
    return out


def segment_costs(codes: list[np.ndarray]) -> np.ndarray:
    """Cost matrix of each segment: insertions and rows, no insertion behind the last row."""
    padded = _padded(codes)
    total = np.broadcast_to(_STEPS[_PAD], (len(codes), 4, 4))
    for place in range(padded.shape[1] - 1, -1, -1):
        total = _times(_STEPS[padded[:, place]], total)
    return total


def _cheapest(padded: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Costs to the end from each node (segment, place, state)."""
    size, width = padded.shape
    costs = np.empty((size, width + 1, 4), np.int64)
    costs[:, width] = ends
    for place in range(width - 1, -1, -1):
        costs[:, place] = _times(_STEPS[padded[:, place]], costs[:, place + 1])
    return costs


def _optimal_arcs(
    padded: np.ndarray, lengths: np.ndarray, costs: np.ndarray, last: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per node and letter: whether that arc is on a cheapest path, and its target node.

    Nodes behind a segment's last row belong to the next segment, but for the
    insertions at the end of a conversation.
    """
    size, width = padded.shape
    place = np.arange(width + 1)
    first = (np.arange(size) * (width + 1))[:, None, None]
    state = np.arange(4)
    code = np.concatenate([padded, np.full((size, 1), _PAD)], 1)
    is_row = (place < lengths[:, None])[:, :, None]
    stays = is_row & ((code & _MUST_DELETE) == 0)[:, :, None]
    more = np.where(code & _CUT_OFF, TRUNCATED, 0)[:, :, None]
    after = np.concatenate([costs[:, 1:], costs[:, -1:]], 1)
    kept = _KEPT[code & 3]
    is_kept = stays & (kept >= 0)
    kept = np.maximum(kept, 0)

    def behind(states: np.ndarray) -> np.ndarray:
        return np.take_along_axis(after, np.broadcast_to(states, after.shape), 2)

    open_end = is_row | ((place == lengths[:, None]) & last[:, None])[:, :, None]
    on_path = np.stack(
        [
            is_row & (costs == DELETE + after),
            open_end & (costs == INSERT + costs[:, :, _TURN]),
            is_kept & (costs == KEEP + more + behind(kept)),
            stays & (costs == REROLE + more + behind(_TURN)),
        ],
        -1,
    )
    here = (first + place[None, :, None]) * 4
    there = here + np.where(is_row, 4, 0)
    shape = costs.shape
    target = np.stack(
        [np.broadcast_to(t, shape) for t in (there + state, here + _TURN, there + kept, there + _TURN)],
        -1,
    )
    return on_path.reshape(-1, 4), target.reshape(-1, 4)


def _ranked(on_path: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(letter of the least arc of each node, -1 at ends; pointers over 1, 2, 4, ... letters).

    The rank of a node at length n orders it by its least audit of n letters;
    a shorter audit comes before its continuations. All arcs of one node have
    different letters, so the ranks of length 1 single out an arc; longer
    audits start with it.
    """
    nodes = np.arange(len(on_path))
    rank = np.where(on_path.any(1), np.argmax(on_path, 1) + 1, 0)
    letter = rank - 1
    step = np.where(rank > 0, target[nodes, np.maximum(letter, 0)], nodes)
    pointers = [step]
    while (on_path[pointers[-1]]).any():
        pair = rank * (int(rank.max()) + 1) + rank[pointers[-1]]
        rank = np.unique(pair, return_inverse=True)[1]
        pointers.append(pointers[-1][pointers[-1]])
    return letter, pointers


def _followed(start: np.ndarray, pointers: list[np.ndarray]) -> np.ndarray:
    """The nodes of the path from each start, by doubled pointers; ends repeat."""
    path = start[:, None]
    for pointer in pointers:
        path = np.concatenate([path, pointer[path]], 1)
    return path


def solve_segments(
    codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray, entries: list[int]
) -> list[list[tuple[str, int, int]]]:
    """Per segment and entry state: least cheapest audit, its cost, state behind it."""
    padded = _padded(codes)
    lengths = np.array([len(c) for c in codes])
    costs = _cheapest(padded, ends)
    letter, pointers = _ranked(*_optimal_arcs(padded, lengths, costs, last))
    size, width = padded.shape
    start = (np.arange(size) * (width + 1) * 4)[:, None] + np.array(entries)
    path = _followed(start.ravel(), pointers)
    letters, stop = letter[path], path[:, -1]
    flat = costs.ravel()
    spent = flat[path[:, 0]] - flat[stop]
    found = [
        ("".join(_LETTERS[i] for i in row if i >= 0), int(c), int(s) & 3)
        for row, c, s in zip(letters, spent, stop, strict=True)
    ]
    return [found[i : i + len(entries)] for i in range(0, len(found), len(entries))]


def _chunks(lengths: list[int]) -> Iterator[np.ndarray]:
    """Segments of like length, few enough that their nodes fit into ``NODES``."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * (lengths[order[stop]] + 1) * 4 <= NODES:
            stop += 1
        yield order[start:stop]
        start = stop


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    return np.split(flat, np.cumsum(sizes)[:-1])


_MATRIX = "segment long, costs array<long>"
_PATHS = "segment long, audits array<string>, spent array<long>, exits array<int>"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = _lists(batch["codes"])
        out = np.empty((len(codes), 16), np.int64)
        for part in _chunks([len(c) for c in codes]):
            out[part] = segment_costs([codes[i] for i in part]).reshape(len(part), 16)
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(out.tolist(), pa.list_(pa.int64()))],
            [*batch.schema.names[:-1], "costs"],
        )


def _solver(single: bool):
    """Solve segments; ``single`` ones are a whole conversation and entered at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_START] if single else [0, 1, 2, 3]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _lists(batch["codes"])
            if single:
                ends = np.broadcast_to(_END, (len(codes), 4))
                last = np.ones(len(codes), bool)
            else:
                ends = np.stack(_lists(batch["ends"]))
                last = batch["last"].to_numpy(zero_copy_only=False)
            found: list = [None] * len(codes)
            for part in _chunks([len(c) for c in codes]):
                solved = solve_segments([codes[i] for i in part], ends[part], last[part], entries)
                for i, paths in zip(part, solved, strict=True):
                    found[i] = paths
            columns = [
                pa.array([[p[k] for p in paths] for paths in found], pa.list_(kind))
                for k, kind in enumerate((pa.string(), pa.int64(), pa.int32()))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["segment"], *columns],
                ["conv_id", "segment", "audits", "spent", "exits"],
            )

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its segments' matrices in order; out: the costs behind each."""
    for batch in batches:
        for conv, segments, costs in zip(
            batch["conv_id"], batch["segments"].to_pylist(), batch["costs"].to_pylist(), strict=True
        ):
            ends = [_END]
            for matrix in reversed(costs[1:]):
                ends.append(_times(np.array(matrix).reshape(4, 4), ends[-1]))
            rows = len(segments)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv.as_py()] * rows, batch["conv_id"].type),
                    pa.array(segments, pa.int64()),
                    pa.array([e.tolist() for e in reversed(ends)], pa.list_(pa.int64())),
                    pa.array([i == rows - 1 for i in range(rows)]),
                ],
                ["conv_id", "segment", "ends", "last"],
            )


def _with_conv(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([df.schema["conv_id"], *T.StructType.fromDDL(more).fields])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults of the contract put in.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2 removes
    its ``[.!?]``, 3 repeats it, 4 makes its role ``user``. A null counts as one blank, in the
    key and as role or text; turn and conv_id stay null.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
    text = (
        F.when(F.col("_kind") == 1, "")
        .when(F.col("_kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    return (
        marked.where(F.col("_kind") != 0)
        .withColumn("text", text)
        .withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("_copy", F.explode(F.expr("sequence(1, if(_kind = 3, 2, 1))")))
        .select("conv_id", "turn", "role", "text")
    )


def _identity() -> Column:
    """Digest of conversation, role and text; equal only for rows that agree in all three."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    parts = [F.length(conv).cast("string"), conv, F.length("role").cast("string"), F.col("role")]
    return F.sha2(F.concat_ws(":", *parts, F.col("text")).cast("binary"), 256)


def _faults(placed: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, code, blank, duplicate, truncated) of placed rows."""
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    letter = F.substring("role", 1, 1)
    # an empty role has no initial, like one that starts with another letter
    initial = F.lit(len(_INITIALS))
    for place, known in enumerate(_INITIALS):
        initial = F.when(letter == known, place).otherwise(initial)
    slim = placed.select(
        "conv_id",
        "turn",
        "pos",
        _identity().alias("same"),
        (shown == "").alias("blank"),
        F.right(shown, F.lit(1)).isin(".", "!", "?").alias("ended"),
        initial.alias("initial"),
    )
    first = slim.groupBy("same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    judged = slim.join(first, "pos", "left")
    blank = F.col("blank")
    again = ~blank & F.col("is_first").isNull()
    cut_off = ~blank & ~again & ~F.col("ended")
    code = (
        F.col("initial")
        + F.when(blank | again, _MUST_DELETE).otherwise(0)
        + F.when(cut_off, _CUT_OFF).otherwise(0)
    )
    return judged.select(
        "conv_id",
        "turn",
        "pos",
        code.cast("int").alias("code"),
        blank.alias("blank"),
        again.alias("duplicate"),
        cut_off.alias("truncated"),
    )


def _segments(faults: DataFrame) -> DataFrame:
    """(conv_id, segment, first, codes, illegal): rows in order; the first row behind a
    segment only tells whether the two are a legal pair."""
    segment = F.floor(F.col("pos") / SEGMENT).cast("long")
    homes = F.when(F.col("pos") % SEGMENT == 0, F.array(segment, segment - 1)).otherwise(
        F.array(segment)
    )
    rows = faults.select("conv_id", F.explode(homes).alias("segment"), "pos", "code")
    gathered = (
        rows.groupBy("conv_id", "segment")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
        .where(F.floor(F.col("rows")[0]["pos"] / SEGMENT) == F.col("segment"))
    )
    own = F.filter("rows", lambda r: F.floor(r["pos"] / SEGMENT) == F.col("segment"))
    initials = F.transform("rows", lambda r: r["code"].bitwiseAND(3))
    pairs = F.zip_with(
        F.slice("initials", 1, F.size("initials") - 1),
        F.slice("initials", 2, F.size("initials") - 1),
        lambda a, b: a * 4 + b,
    )
    legal = [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]
    return gathered.withColumn("initials", initials).select(
        "conv_id",
        "segment",
        F.col("rows")[0]["pos"].alias("first"),
        F.size(F.filter(pairs, lambda p: ~p.isin(legal))).cast("long").alias("illegal"),
        F.transform(own, lambda r: r["code"]).alias("codes"),
    )


def _matched(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by conversation and segment; rows without conv_id match each other."""
    other = right.withColumnsRenamed({"conv_id": "_conv", "segment": "_segment"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment"))
    return left.join(other, same, how).drop("_conv", "_segment")


def _audits(segments: DataFrame) -> DataFrame:
    """(conv_id, segment, audit, spent): the least cheapest edits of each segment."""
    slim = segments.select("conv_id", "segment", "codes")
    spans = segments.groupBy("conv_id").agg(
        F.min("segment").alias("low"), F.max("segment").alias("high")
    ).where("low < high")
    many = saved(
        spans.select("conv_id", F.explode(F.sequence("low", "high")).alias("segment")), "repair-long"
    )
    single = _matched(slim, many, "left_anti")
    parts = _matched(slim, many, "left_semi")
    schema = _with_conv(segments, _PATHS)
    alone = single.mapInArrow(_solver(True), schema).select(
        "conv_id", "segment", F.col("audits")[0].alias("audit"), F.col("spent")[0].alias("spent")
    )
    matrices = parts.mapInArrow(_matrices, _with_conv(segments, _MATRIX))
    in_order = F.sort_array(F.collect_list(F.struct("segment", "costs")))
    summary = matrices.groupBy("conv_id").agg(in_order.alias("s"))
    ends = summary.select(
        "conv_id", F.col("s.segment").alias("segments"), F.col("s.costs").alias("costs")
    ).mapInArrow(_ends, _with_conv(segments, "segment long, ends array<long>, last boolean"))
    solved = saved(
        _matched(parts, ends)
        .select("conv_id", "segment", "ends", "last", "codes")
        .mapInArrow(_solver(False), schema),
        "repair-solved",
    )
    entered = (
        solved.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("segment", "exits"))).alias("s"))
        .select("conv_id", F.col("s.segment").alias("segments"), F.col("s.exits").alias("exits"))
        .mapInArrow(_entries, _with_conv(segments, "segment long, entry int"))
    )
    chosen = _matched(solved, entered).select(
        "conv_id",
        "segment",
        F.get("audits", F.col("entry")).alias("audit"),
        F.get("spent", F.col("entry")).alias("spent"),
    )
    return alone.unionByName(chosen)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: the state in which each segment is entered."""
    for batch in batches:
        for conv, segments, exits in zip(
            batch["conv_id"], batch["segments"].to_pylist(), batch["exits"].to_pylist(), strict=True
        ):
            states = [_START]
            for by_entry in exits[:-1]:
                states.append(by_entry[states[-1]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv.as_py()] * len(segments), batch["conv_id"].type),
                    pa.array(segments, pa.int64()),
                    pa.array(states, pa.int32()),
                ],
                ["conv_id", "segment", "entry"],
            )


_EMPTY = hashlib.sha256(b"").hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each repaired conversation from its rows in order, an edit before its row."""
    conv, digest, kind = None, None, None
    edit, last, empty = "", "", True

    def add(role: str, text: str) -> None:
        nonlocal last, empty
        digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        last, empty = role[:1], False

    def turn() -> str:
        return "assistant" if last == "u" else "user"

    def ended() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(done[0], kind), pa.array(done[1], pa.string())], ["conv_id", "repaired_sha256"]
        )

    done: tuple[list, list] = ([], [])
    for batch in batches:
        kind = batch["conv_id"].type
        columns = (batch[c].to_pylist() for c in ("conv_id", "edit", "role", "text"))
        for key, letters, role, text in zip(*columns, strict=True):
            if digest is None or key != conv:
                if digest is not None:
                    done[0].append(conv)
                    done[1].append(digest.hexdigest())
                conv, digest, last, empty = key, hashlib.sha256(), "", True
            if letters is not None:
                edit = letters
                continue
            for letter in edit:
                if letter == "K":
                    add(role, text)
                elif letter == "R":
                    add(turn(), text)
                elif letter == "I":
                    add(turn(), "")
        if done[0]:
            yield ended()
            done = ([], [])
    if digest is not None:
        done[0].append(conv)
        done[1].append(digest.hexdigest())
        yield ended()


def _repaired_digests(placed: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256). Rows and their edits meet sorted by conversation and place;
    one conversation is hashed in one task, as a SHA-256 must be, but never held there."""
    per_row = F.regexp_extract_all("audit", F.lit("I*[DKR](?:I+$)?"), F.lit(0))
    edits = audits.select("conv_id", "first", F.posexplode(per_row).alias("at", "edit")).select(
        "conv_id",
        (F.col("first") + F.col("at")).alias("pos"),
        "edit",
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"),
    )
    rows = placed.select("conv_id", "pos", F.lit(None).cast("string").alias("edit"), "role", "text")
    dealt = rows.unionByName(edits).repartition("conv_id")
    in_order = dealt.sortWithinPartitions("conv_id", "pos", F.col("edit").asc_nulls_last())
    return in_order.select("conv_id", "edit", "role", "text").mapInArrow(
        _digests, _with_conv(placed, "repaired_sha256 string")
    )


def repaired(original: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``original`` from its ``rows``.

    Both have conv_id; ``rows`` also turn, role and text without nulls in the last two. Other columns
    are ignored, whatever their names. Rows are ordered by turn (nulls first), role and text;
    equal rows follow each other and all but the first are duplicates. Rows without conv_id are
    one conversation. An empty role or one with another first letter than s, u or a can only be
    reroled or deleted. A conversation without rows has zeros, an empty audit and the digest
    of the empty string; an empty table has no result rows. Texts may be of any length.

    Result: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.
    """
    # equal rows are told apart by their place in the input, so that they spread over tasks
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn(
        "_row", F.monotonically_increasing_id()
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    placed = dense_index(numbered, order, "pos").drop("_row")
    faults = saved(_faults(placed), "repair-faults")
    segments = saved(_segments(faults), "repair-segments")
    audits = _audits(segments)
    audits = saved(
        _matched(segments.select("conv_id", "segment", "first", "illegal"), audits), "repair-audits"
    )
    counts = faults.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"),
        *[F.count_if(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    parts = F.sort_array(F.collect_list(F.struct("segment", "audit")))
    paths = audits.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"),
        F.sum("spent").alias("cost"),
        F.array_join(parts["audit"], "").alias("audit"),
    )
    digests = _repaired_digests(placed, audits)
    values = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    everything = original.select("conv_id").distinct()
    for part in (counts, paths, digests):
        everything = everything.unionByName(part, allowMissingColumns=True)
    merged = everything.groupBy("conv_id").agg(
        *[F.max(c).alias(c) for c in (*values, "audit", "repaired_sha256")]
    )
    return merged.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in values],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"),
    )


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repaired`` of the damaged rows of a table of conversations."""
    return repaired(conversations, damaged(conversations))
