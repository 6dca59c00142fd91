from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from docflow.llm import repair
from docflow.llm.queries import conversation_repair
from tests.llm.conftest import table

ROWS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\f\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired lines) by a plain search; rows are (role, text, must go, truncated)."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        turn = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[turn]
        if inserted < 2:
            cost, audit, lines = best(i, turn, inserted + 1)
            found.append((cost + 5, "I" + audit, (f"{name}:", *lines)))
        if i < len(rows):
            role, text, must_go, cut = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, lines))
            if not must_go:
                cost, audit, lines = best(i + 1, turn, 0)
                found.append((cost + 1 + 5 * cut, "R" + audit, (f"{name}:{text}", *lines)))
                if role[:1] in NEXT[state]:
                    cost, audit, lines = best(i + 1, NEXT[state][role[:1]], 0)
                    found.append((cost + 5 * cut, "K" + audit, (f"{role}:{text}", *lines)))
        return min(found) if found else (10**9, "", ())

    return best(0, "", 0)


def plain(rows):
    out = []
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((t is not None, t or 0, role, text) for c, t, role, text in after if c == conv)
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, judged, faults = set(), [], [0, 0, 0]
        for _, _, role, text in own:
            shown = text.rstrip(BLANKS)
            blank = not shown
            again = not blank and (role, text) in seen
            cut = not blank and not again and shown[-1] not in ".!?"
            seen.add((role, text))
            judged.append((role, text, blank or again, cut))
            faults = [n + f for n, f in zip(faults, (blank, again, cut))]
        initials = [role[:1] for role, *_ in judged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(tuple(judged))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *faults, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def got(frame):
    assert frame.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    ]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u", None]
    texts = ["Yes.", "No!", "cut off", "", " \n", "Why?  ", "a.b", None, "Yes."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            at = None if rng.random() < 0.05 else turn + (rng.random() < 0.2)
            role = rng.choice(roles) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            rows.append((None if conv == 3 else conv, at, role, rng.choice(texts) if rng.random() < 0.5 else f"t{turn}."))
    rng.shuffle(rows)
    return rows


def test_whole_table(llm, small):
    rows = [tuple(r) for r in llm.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(conversation_repair(llm, small)) == plain(rows)


@pytest.mark.parametrize("segment", [2048, 3])
def test_random_conversations(llm, monkeypatch, segment):
    """Also with segments so short that most conversations have several."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = conversations(5, 40, 11)
    assert got(repair.damage_and_repair(table(llm, rows, ROWS))) == plain(rows)


def test_one_conversation_owns_most_rows(llm, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    rows = [(r[0] and 1, t, *r[2:]) for t, r in enumerate(conversations(9, 60, 9))]
    rows += [(7, t, "user", "same") for t in range(3)] + [(7, 2, "user", "same")] * 40
    assert got(repair.damage_and_repair(table(llm, rows, ROWS))) == plain(rows)


def test_ranks_agree_with_the_audits_they_stand_for():
    """Nodes in the order of their ranks have their whole audits in ASCII order."""
    rng = random.Random(1)
    codes = [repair.np.array([rng.choice([0, 1, 2, 3, 5, 9, 10, 14]) for _ in range(9)])]
    padded = repair._padded(codes)
    costs = repair._cheapest(padded, repair._END[None])
    on_path, target = repair._optimal_arcs(padded, repair.np.array([9]), costs, repair.np.array([True]))
    letter, pointers = repair._ranked(on_path, target)

    def audit(node):
        text = ""
        while letter[node] >= 0:
            text += "DIKR"[letter[node]]
            node = target[node, letter[node]]
        return text

    whole = [audit(n) for n in range(len(letter))]
    path = repair._followed(repair.np.arange(len(letter)), pointers)
    assert ["".join("DIKR"[i] for i in row if i >= 0) for row in letter[path]] == whole


def test_edges(llm):
    assert got(repair.damage_and_repair(table(llm, [], ROWS))) == []
    # the only row is dropped, all turns missing, a very long text, clashing columns
    dropped = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    whole = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    rows = [(dropped, 0, "user", "x."), (whole, 0, "user", "y " * 2_000_000 + "."), (None, None, None, None)]
    frame = table(llm, rows, ROWS)
    for name in ("pos", "segment", "code", "audit", "gaps", "_row", "_copy", "_kind"):
        frame = frame.withColumn(name, repair.F.lit(1))
    assert got(repair.damage_and_repair(frame)) == plain(rows)
    empty = [r for r in got(repair.damage_and_repair(frame)) if r[0] == dropped]
    assert empty == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
