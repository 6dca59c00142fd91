from __future__ import annotations

import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.llm import archive, idcoder, tokens
from docflow.llm.queries import tokenizer_path
from tests.llm.conftest import table

ids = st.one_of(
    st.lists(st.integers(0, 2**32 - 1), max_size=300),
    st.lists(st.integers(0, 5), max_size=300),
    st.integers(0, 50_000).map(lambda n: [n % 777] * (n % 400)),
)


@settings(max_examples=30, deadline=None)
@given(ids)
def test_ids_come_back(values):
    data = idcoder.encode_ids(np.array(values, dtype=np.int64))
    assert idcoder.decode_ids(data).tolist() == values


def test_blocks_are_independent_and_repetition_is_cheap():
    rng = np.random.default_rng(1)
    values = np.tile(rng.integers(0, 50_000, 50), 90)
    data = idcoder.encode_ids(values)
    assert len(data) * 8 < 2 * len(values)
    heads, payloads = idcoder.split_blocks(data)
    assert len(heads) == -(-len(values) // idcoder.BLOCK)
    second = idcoder._decode_lanes(heads[1:2], payloads[1:2])[:, 0]
    assert (second == values[idcoder.BLOCK : 2 * idcoder.BLOCK]).all()


def test_damage_is_noticed():
    data = bytearray(idcoder.encode_ids(np.arange(500)))
    for at in (0, 6, 14, 40, len(data) - 1):
        broken = bytes(data[:at]) + bytes([data[at] ^ 255]) + bytes(data[at + 1 :])
        with pytest.raises(ValueError):
            idcoder.decode_ids(broken)
    with pytest.raises(idcoder.DamagedBlock):
        idcoder.decode_ids(bytes(data[:-2]))


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


pieces = st.one_of(
    st.sampled_from(["<|endoftext|>", " <|endoftext|> ", "a<|endoftext|>", "<|endoftext"]),
    st.text(alphabet=" \n\t　\x1f\x85ab'sé漢1._<|>", max_size=8),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(pieces, max_size=6).map("".join))
def test_units_encode_like_the_whole(text):
    whole = plain_tokenizer().encode(text, add_special_tokens=False).ids
    assert tokens.encoder(tokenizer_path())([text])[0].tolist() == whole


def test_the_special_string_is_one_id():
    assert tokens.encoder(tokenizer_path())(["<|endoftext|>"])[0].tolist() == [50256]


marked = st.text(alphabet=" \n\tab'sSé漢1.,;:!?<|>", max_size=12)


@settings(max_examples=400, deadline=None)
@given(st.lists(marked, min_size=1, max_size=4))
def test_marks_and_line_ends_encode_like_the_whole(texts):
    encode = tokens.encoder(tokenizer_path())
    wanted = [whole.ids for whole in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in encode(texts)] == wanted


class Counting:
    """A tokenizer that keeps what it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_a_word_is_tokenized_once_whatever_mark_follows():
    encode = tokens.UnitEncoder(tokenizer_path())
    encode.tokenizer = counting = Counting(encode.tokenizer)
    words = ["house", "tree", "water", "street", "garden", "window", "table", "paper"]
    text = "x " + " ".join(w + mark for w in words for mark in ("", ",", ".", ";", "!", ":"))
    assert encode([text])[0].tolist() == plain_tokenizer().encode(text).ids
    assert counting.given.count(" house") == 1 and len(counting.given) <= 1 + len(words) + 5


def test_frequent_units_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 40)
    encode = tokens.UnitEncoder(tokenizer_path())
    encode.tokenizer = counting = Counting(encode.tokenizer)
    plain = plain_tokenizer()
    for i in range(30):
        text = "so often it " + " ".join(f"w{i}x{j}" for j in range(10))
        assert encode([text])[0].tolist() == plain.encode(text).ids
        assert len(encode.known) + len(encode.older) <= 40
    assert counting.given.count(" often") == 1 and len(counting.given) <= 303


def test_blocks_decode_alike_in_any_company():
    """Records and weights of a lane must not depend on the lanes beside it."""
    rng = np.random.default_rng(2)
    values = np.minimum(rng.zipf(1.4, 9 * idcoder.BLOCK + 700), 40_000)
    heads, payloads = idcoder.split_blocks(idcoder.encode_ids(values))
    for some in ([3], [0, 8, 9], [5, 2, 7, 1, 9]):
        found = idcoder._decode_lanes([heads[i] for i in some], [payloads[i] for i in some])
        for lane, i in enumerate(some):
            own = values[i * idcoder.BLOCK : (i + 1) * idcoder.BLOCK]
            assert (found[: len(own), lane] == own).all()


def text_hash(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64 if value >> 63 else 0)


def test_a_shared_id_spreads_over_the_parts(llm, tmp_path):
    """A third of the rows has no id, half of those one text."""
    rows = [(None, "same" if i % 2 else f"text {i}") for i in range(400)] + [(i, "x") for i in range(800)]
    archive.write_archive(table(llm, rows), str(tmp_path / "a"), tokenizer_path(), parts=8)
    runs = llm.read.schema(archive.ARCHIVE).parquet(str(tmp_path / "a")).collect()
    assert len({r.part for r in runs if None in r.doc_ids}) >= 2
    found = archive.archive_documents(llm, str(tmp_path / "a")).collect()
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in found)
    assert len(starts) == 1200 and [s[2] for s in starts] == [None] * 400 + list(range(800))
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))


def test_round_trip(llm, small):
    docs = llm.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000, None), (1001, ""), (1002, "<|endoftext|> a  b\n"), (1002, "again"), (-5, "x")]
    tokenizer = plain_tokenizer()
    wanted, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0], text_hash(r[1] or ""))):
        own = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(own, dtype="<u4").tobytes())
        wanted.append((doc_id, start, len(own), crc))
        start += len(own)
    frame = table(llm, rows).withColumn("start", F.lit("clash"))
    assert sorted(map(tuple, archive.round_trip(frame, tokenizer_path()).collect())) == wanted
    assert archive.round_trip(table(llm, []), tokenizer_path()).collect() == []
    one = archive.round_trip(table(llm, [(None, None)]), tokenizer_path()).collect()
    assert [tuple(r)[:3] for r in one] == [(None, 0, 1)]
