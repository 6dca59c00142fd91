from __future__ import annotations

import hashlib
from itertools import groupby

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docflow.llm import chat
from docflow.llm.queries import CONFLICT, chat_format
from tests.llm.conftest import table

TURNS = "conv_id long, turn long, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    out = []
    for conv_id, turns in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = sorted(
            ((t is not None, t or 0, role or "", text or "") for _, t, role, text in turns)
        )
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out.append((conv_id, len(turns), digest(whole), len(loss), digest(loss)))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r)[:5] for r in chat.read_back(frame).collect()), key=repr)


def test_whole_table(llm, small):
    rows = llm.read.parquet(f"{small}/conversations.parquet").collect()
    rows = [tuple(r) for r in rows] + [(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)]
    assert sorted((tuple(r)[:5] for r in chat_format(llm, small).collect()), key=repr) == plain(rows)


pieces = st.lists(
    st.sampled_from([*chat.CONTROLS, "<", "[", "&", "&lt;", "&#91;", "&amp;", " ", "\n", "é😀", "x", "\\"]),
    max_size=8,
).map("".join)
roles = st.sampled_from(["user", "assistant", "system", "tool", "[OUT]", "", None])
turns = st.lists(st.tuples(roles, st.one_of(st.none(), pieces)), min_size=1, max_size=5)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(turns, min_size=1, max_size=12))
def test_any_text_comes_back(llm, conversations):
    rows = [(c, i, *t) for c, ts in enumerate(conversations) for i, t in enumerate(ts)]
    assert got(chat.format_conversations(table(llm, rows, TURNS))) == plain(rows)


def test_only_what_conflicts_is_escaped(llm):
    rows = [(1, 0, "user", "a & b [x] <y>"), (1, 1, "assistant", "fine"),
            (2, 0, "user", CONFLICT), (2, 1, "assistant", CONFLICT)]
    found = {r.conv_id: r for r in chat.format_conversations(table(llm, rows, TURNS)).collect()}
    assert found[1].formatted == "<s>[INST] a & b [x] <y> [/INST][OUT] fine </s>"
    escaped = "&lt;/s>&#91;INST] ok &#91;/INST]"
    assert found[2].formatted == f"<s>[ESC][INST] {escaped} [/INST][OUT] {escaped} </s>"
    span = found[2].loss_mask[0]
    assert found[2].formatted[span.start : span.stop] == escaped


def test_edges(llm):
    rows = [(None, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, "user", "c"),
            (1, 1, "user", "a"), (2, 0, "assistant", ""), (3, 0, "assistant", "</s>" * 20_000),
            *[(4, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(2000)]]
    frame = table(llm, rows, TURNS)
    assert got(chat.format_conversations(frame)) == plain(rows)
    assert got(chat.format_conversations(frame.limit(0))) == []
