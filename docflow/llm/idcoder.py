"""Adaptive context-mixing range coder for token ids.

A block holds up to ``BLOCK`` ids, starts from an empty model and carries two
checksums (and one for its head), so it can be read alone. Three predictions are mixed for each id:

* order 2: the id that last followed the previous two ids,
* order 1: the id that last followed the previous one,
* order 0: the frequencies of the block's ids so far, with an escape to all ids for new ones.

Orders 1 and 2 name one id each, trusted as their record at the same confidence
deserves; the rest of their weight falls to order 0. The weights follow each
order's success. What orders 1 and 2 name is learned with each id; records, weights and
frequencies are renewed after 16, 32, 64, … and every 512 ids. The mixture is cut into integer
intervals that drive a range coder with carries.

Encoding and decoding walk all blocks of a batch in step, one numpy lane per block. The
encoder knows all ids, so only what is learned with each id and the range itself are taken step by
step; decoding takes all of it in step.
All model arithmetic is on integers or on +, -, *, / of doubles in a fixed order, and doubles are
summed as integers, so both sides get the same numbers however blocks are batched.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block.
BLOCK = 2048
#: Blocks that are coded in step.
LANES = 2048
MAGIC = b"CMR2"
_HEAD = struct.Struct("<4sIIIIB")  # magic, ids, words, crc of ids, crc of words, id bits
_CRC = struct.Struct("<I")  # of the head
_HEAD_SIZE = _HEAD.size + _CRC.size

_TOTAL_BITS = 24
_TOTAL = 1 << _TOTAL_BITS
_SLOT_BITS = 12
_SLOTS = 1 << _SLOT_BITS
_CONTEXTS = 1 << 12
#: Confidences of a context's named id; at 0 it names none yet, from ``_FIRM`` on it outlives a miss.
_LEVELS, _FIRM = 16, 3
_LEVEL = np.arange(_LEVELS)
#: Confidence after a miss (even places) and a hit (odd ones).
_NEXT = np.stack((np.where(_LEVEL, (_LEVEL - 1 >> 2) + 1, 1), np.where(_LEVEL, np.minimum(_LEVEL + 1, 15), 1)), 1)
_NEXT = _NEXT.ravel().astype(np.uint8)
#: Hits and tries a confidence starts with.
_RIGHT, _TRIED = np.where(_LEVEL, 0.25 + _LEVEL / 4, 0.0), 1.25 + _LEVEL / 4
#: What order 0 is said to have given an id that a longer order named.
_NAMED = 1 / 256
#: Unit of summed weights.
_SHARE = 1 << 20
#: Steps whose intervals are made at once.
_PIECE = 32
_U = np.uint64
_LOW48 = (1 << 48) - 1
_FLOOR = 1 << 32


class _Writer:
    """Range encoder of all lanes: 48-bit low, 16-bit words out.

    Words are kept with their carries until the end.
    """

    def __init__(self, lanes: int, ids: int):
        self.low = np.zeros(lanes, dtype=_U)
        self.range = np.full(lanes, 1 << 48, dtype=_U)
        self.out = np.zeros((lanes, 4 * ids + 8), dtype=np.uint32)
        self.words = self.out.reshape(-1)
        self.first = np.arange(lanes) * self.out.shape[1]
        self.at = self.first.copy()

    def put(self, lanes, start: np.ndarray, size: np.ndarray | int, bits: int) -> None:
        """``lanes`` is a slice or an index array; start and size in 1 / 2**bits."""
        part = self.range[lanes] >> _U(bits)
        low = self.low[lanes] + start * part
        span = part * size
        at = self.at[lanes]
        over = np.flatnonzero(low > _LOW48)
        if len(over):
            low[over] &= _U(_LOW48)
            self.words[at[over] - 1] += np.uint32(1)
        short = span < _FLOOR
        while short.any():
            self.words[at] = low >> _U(32)  # written over unless the place moves on
            shift = short.astype(_U) << _U(4)
            low = (low << shift) & _U(_LOW48)
            span <<= shift
            at = at + short
            short = span < _FLOOR
        self.low[lanes], self.range[lanes], self.at[lanes] = low, span, at

    def close(self) -> list[bytes]:
        for shift in (32, 16, 0):
            self.words[self.at] = (self.low >> _U(shift)) & _U(0xFFFF)
            self.at += 1
        sizes = self.at - self.first
        out = self.out[:, : int(sizes.max())]
        while (carry := out >> 16).any():
            out &= 0xFFFF
            out[:, :-1] += carry[:, 1:]
        out = out.astype("<u2")
        return [out[i, :n].tobytes() for i, n in enumerate(sizes.tolist())]


class _Reader:
    """Range decoder of all lanes."""

    def __init__(self, payloads: list[bytes]):
        words = [np.frombuffer(p, dtype="<u2") for p in payloads]
        table = np.zeros((len(words), max(map(len, words)) + 8), dtype=np.uint16)
        for i, w in enumerate(words):
            table[i, : len(w)] = w
        first = table[:, :3].astype(np.int64)
        self.code = (first[:, 0] << 32) | (first[:, 1] << 16) | first[:, 2]
        self.range = np.full(len(words), 1 << 48, dtype=np.int64)
        self.words, self.stop = table.reshape(-1), table.size - 1
        self.at = np.arange(len(words)) * table.shape[1] + 3

    def peek(self, lanes, bits: int) -> np.ndarray:
        """Place in the range, in 1 / 2**bits; doubles divide numbers of 48 bits exactly enough."""
        part = self.range[lanes] >> bits
        return np.minimum((self.code[lanes] / part).astype(np.int64), (1 << bits) - 1)

    def take(self, lanes, start: np.ndarray, size: np.ndarray | int, bits: int) -> None:
        part = self.range[lanes] >> bits
        code = self.code[lanes] - start * part
        span = part * size
        at = self.at[lanes]
        short = span < _FLOOR
        while short.any():
            word = self.words[np.minimum(at, self.stop)]
            shift = short.astype(np.int64) << 4
            code = (code << shift) | np.where(short, word, 0)
            span <<= shift
            at = at + short
            short = span < _FLOOR
        self.code[lanes], self.range[lanes], self.at[lanes] = code, span, at


class _Cells:
    """What orders 1 and 2 (rows 0 and 1) name in each of their contexts, and how surely."""

    def __init__(self, lanes: int):
        self.guess = np.zeros(2 * lanes * _CONTEXTS, dtype=np.uint32)
        self.sure = np.zeros(2 * lanes * _CONTEXTS, dtype=np.uint8)
        self.base = np.arange(2 * lanes).reshape(2, lanes) * _CONTEXTS

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Cells after the ids ``one`` and, before it, ``two``; rows of an order are the last but one axis."""
        mixed = one * 0x9E3779B1
        keys = np.stack((mixed >> 12, (mixed ^ (two * 0x85EBCA6B)) >> 11), axis=-2)
        keys &= _CONTEXTS - 1
        keys += self.base[:, : keys.shape[-1]]
        return keys

    def learn(self, cells: np.ndarray, guess: np.ndarray, sure: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each guess was right."""
        hit = guess == ids
        self.sure[cells] = _NEXT[(sure << 1) | hit]
        self.guess[cells] = np.where(sure >= _FIRM, guess, ids)
        return hit


class _Mixture:
    """Records of orders 1 and 2 at each confidence, and the weights of all orders."""

    def __init__(self, lanes: int):
        self.row = np.arange(2 * lanes).reshape(2, lanes) * _LEVELS
        self.right = np.zeros(2 * lanes * _LEVELS, dtype=np.int64)
        self.tried = np.zeros(2 * lanes * _LEVELS, dtype=np.int64)
        self.weight = np.full((3, lanes), 1 / 3)
        self._forget()
        self._spread()

    def _forget(self) -> None:
        lanes = self.weight.shape[1]
        self.share, self.seen = np.zeros((2, lanes), dtype=np.int64), np.zeros(lanes, dtype=np.int64)

    def _spread(self) -> None:
        lanes = self.weight.shape[1]
        shape = (2, lanes, _LEVELS)
        chance = (self.right.reshape(shape) + _RIGHT) / (self.tried.reshape(shape) + _TRIED)
        self.chance = chance.reshape(-1)
        wide = self.weight[1:, :, None] * chance * float(_TOTAL - (1 << 16))
        self.wide = wide.astype(np.int64).reshape(-1)

    def widths(self, at: np.ndarray, guess_same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Integer sizes of order 2 and order 1; order 2 has both if they name the same id."""
        wide = self.wide[at]
        both = wide[..., 0, :] * guess_same
        return wide[..., 1, :] + both, wide[..., 0, :] - both

    def record(self, at: np.ndarray, hit: np.ndarray, order0: np.ndarray, live: np.ndarray | None) -> None:
        """Successes of some steps (the first axis); ``order0``: what order 0 gave each id."""
        n = at.shape[-1]
        chance, weight = self.chance[at], self.weight[:, :n]
        order0 = order0[:, None, :]
        parts = weight[1:] * ((1.0 - chance) * order0 + chance * hit)
        rest = weight[0] * order0
        total = parts[:, :1] + parts[:, 1:] + rest
        share = (parts / total * _SHARE).astype(np.int64)
        places = at * 2 + hit
        if live is None:
            self.seen[:n] += len(at)
        else:
            self.seen[:n] += live.sum(axis=0)
            share *= live[:, None, :]
            places = places[np.broadcast_to(live[:, None, :], places.shape)]
        self.share[:, :n] += share.sum(axis=0)
        counts = np.bincount(places.ravel(), minlength=2 * len(self.right)).reshape(-1, 2)
        self.right += counts[:, 1]
        self.tried += counts[:, 0] + counts[:, 1]

    def renew(self) -> None:
        new = self.share / (_SHARE * np.maximum(self.seen, 1))
        new = np.stack((1.0 - new[0] - new[1], new[0], new[1]))
        self.weight = np.where(self.seen > 0, new * 0.97 + 0.01, self.weight)
        self._forget()
        self._spread()


def _sizes(counts: np.ndarray, of: np.ndarray, lanes: int, seen: np.ndarray) -> np.ndarray:
    """Slots of each counted id (those of a lane leave the rest to its escape)."""
    kinds = np.bincount(of, minlength=lanes)
    single = np.bincount(of[counts == 1], minlength=lanes)
    escape = np.maximum(32, _SLOTS * single // (2 * seen))
    room = _SLOTS - escape - kinds
    return 1 + counts * room[of] // seen[of]


def _due(t: int) -> bool:
    return t >= 16 and (t & (t - 1) == 0 or t % 512 == 0)


def _pieces(longest: int) -> list[tuple[int, int]]:
    """Stretches of steps; none goes across a renewal."""
    edges = [t for t in range(longest) if t % _PIECE == 0 or _due(t)]
    return list(zip(edges, [*edges[1:], longest], strict=True))


def _uniform_steps(bits: int) -> list[tuple[int, int]]:
    """(shift, bits) of the steps that spell out a new id."""
    return [(0, bits)] if bits <= 16 else [(16, bits - 16), (0, 16)]


def _numbered(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each id among its lane's, in order of lane and id; lane of each number)."""
    steps, lanes = ids.shape
    places = steps.bit_length()
    keys = (np.arange(lanes) << bits | ids) << places | np.arange(steps)[:, None]
    keys = np.sort(keys, axis=None)
    step, keys = keys & ((1 << places) - 1), keys >> places
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    lane = keys >> bits
    index = np.empty((steps, lanes), dtype=np.int64)
    index.reshape(-1)[step * lanes + lane] = np.cumsum(new) - 1
    return index, lane[new]


def _learned(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(confidence, whether named rightly, whether both orders name the same) of each id."""
    steps, lanes = ids.shape
    cells = _Cells(lanes)
    sure = np.zeros((steps, 2, lanes), dtype=np.uint8)
    hit = np.zeros((steps, 2, lanes), dtype=bool)
    same = np.zeros((steps, lanes), dtype=bool)
    before = np.concatenate((np.zeros((2, lanes), dtype=np.int64), ids[:-1]))
    short = ids.astype(np.uint32)
    for a, b in _pieces(steps):
        found = cells.find(before[a + 1 : b + 1], before[a:b])
        for t in range(a, b):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            at = found[t - a, :, :n]
            guess, own = cells.guess[at], cells.sure[at]
            sure[t, :, :n] = own
            same[t, :n] = guess[0] == guess[1]
            hit[t, :, :n] = cells.learn(at, guess, own, short[t, :n])
    return sure, hit, same


def encode_blocks(blocks: list[np.ndarray]) -> bytes:
    """Blocks in their file form, one after the other; lengths must not grow."""
    lanes, longest = len(blocks), len(blocks[0])
    lengths = np.array([len(b) for b in blocks], dtype=np.int64)
    ids = np.zeros((longest, lanes), dtype=np.int64)
    for i, block in enumerate(blocks):
        ids[: len(block), i] = block
    bits = max(1, int(ids.max(initial=0)).bit_length())
    index, of = _numbered(ids, bits)
    first = np.searchsorted(of, np.arange(lanes))
    sure, hit, same = _learned(ids, lengths)
    slots = np.zeros(len(of), dtype=np.int64)  # first slot and number of slots
    escape_at = np.zeros(lanes, dtype=np.int64)
    writer, mixture = _Writer(lanes, longest), _Mixture(lanes)
    counts, counted = np.zeros(len(of), dtype=np.int64), 0
    for a, b in _pieces(longest):
        if _due(a):
            mixture.renew()
            live = np.arange(counted, a)[:, None] < lengths
            counts += np.bincount(index[counted:a][live], minlength=len(of))
            counted = a
            known = np.flatnonzero(counts)
            size = np.zeros(len(of), dtype=np.int64)
            size[known] = _sizes(counts[known], of[known], lanes, np.minimum(lengths, a))
            start = np.cumsum(size) - size
            slots = (start - start[first][of]) << 16 | size
            escape_at = np.bincount(of, weights=size, minlength=lanes).astype(np.int64)
        n = int(np.searchsorted(-lengths, -a, side="left"))
        live = None if lengths[n - 1] >= b else np.arange(a, b)[:, None] < lengths[:n]
        own = slots[index[a:b, :n]]
        size, start = own & 0xFFFF, own >> 16
        new = size == 0
        size = np.where(new, _SLOTS - escape_at[:n], size)
        start = np.where(new, escape_at[:n], start)
        order0 = size / _SLOTS
        order0 = np.where(new, order0 / (1 << bits), order0)
        at = mixture.row[:, :n] + sure[a:b, :, :n]
        wide2, wide1 = mixture.widths(at, same[a:b, :n])
        wide = wide2 + wide1
        unit = (_TOTAL - wide) >> _SLOT_BITS
        hit2 = hit[a:b, 1, :n] & (wide2 > 0)
        hit1 = hit[a:b, 0, :n] & (wide1 > 0) & ~hit2
        named = hit2 | hit1
        begin = np.where(hit2, 0, np.where(hit1, wide2, wide + start * unit)).view(_U)
        extent = np.where(hit2, wide2, np.where(hit1, wide1, size * unit)).view(_U)
        mixture.record(at, hit[a:b, :, :n], np.where(named, _NAMED, order0), live)
        spell = new & ~named
        for t in range(a, b):
            m = n if live is None else int(live[t - a].sum())
            writer.put(slice(0, m), begin[t - a, :m], extent[t - a, :m], _TOTAL_BITS)
            rows = np.flatnonzero(spell[t - a, :m])
            if len(rows):
                for shift, width in _uniform_steps(bits):
                    value = (ids[t, rows] >> shift) & ((1 << width) - 1)
                    writer.put(rows, value.astype(_U), _U(1), width)
    out = []
    for block, payload in zip(blocks, writer.close(), strict=True):
        raw = np.asarray(block).astype("<u4").tobytes()
        head = _HEAD.pack(
            MAGIC, len(block), len(payload) // 2, zlib.crc32(raw), zlib.crc32(payload), bits
        )
        out += [head, _CRC.pack(zlib.crc32(head)), payload]
    return b"".join(out)


def _slot_table(ids: np.ndarray, lengths: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each slot within its lane; first entry of each lane; entries: id, first slot, slots).

    A lane's last entry is its escape, whose slots end at the last one.
    """
    lanes = len(lengths)
    lane = np.arange(lanes)
    live = np.arange(t)[:, None] < lengths
    kinds, counts = np.unique((lane << 32 | ids[:t])[live], return_counts=True)
    of = kinds >> 32
    size = _sizes(counts, of, lanes, np.minimum(lengths, t))
    escape = _SLOTS - np.bincount(of, weights=size, minlength=lanes).astype(np.int64)
    ends = np.searchsorted(of, lane, side="right")
    entry_id = np.insert(kinds & 0xFFFFFFFF, ends, 0)
    entry_size = np.insert(size, ends, escape)
    first = np.concatenate(([0], ends[:-1])) + lane
    entries = np.diff(np.append(first, len(entry_id)))
    start = np.cumsum(entry_size) - entry_size - np.repeat(lane * _SLOTS, entries)
    within = (np.arange(len(entry_id)) - np.repeat(first, entries)).astype(np.uint16)
    return np.repeat(within, entry_size), first, entry_id << 31 | start << 16 | entry_size


def _decode_lanes(heads: list[tuple], payloads: list[bytes]) -> np.ndarray:
    """Ids of blocks of one id width in step; (longest, lanes)."""
    lanes = len(heads)
    lengths = np.array([h[0] for h in heads], dtype=np.int64)
    longest, bits = int(lengths[0]), heads[0][3]
    ids = np.zeros((longest, lanes), dtype=np.int64)
    reader, cells, mixture = _Reader(payloads), _Cells(lanes), _Mixture(lanes)
    lane = np.arange(lanes)
    slot, first, entries = np.zeros(lanes * _SLOTS, dtype=np.uint16), lane, np.full(lanes, _SLOTS)
    one = two = np.zeros(lanes, dtype=np.int64)
    for a, b in _pieces(longest):
        if _due(a):
            mixture.renew()
            slot, first, entries = _slot_table(ids, lengths, a)
        n = int(np.searchsorted(-lengths, -a, side="left"))
        live = None if lengths[n - 1] >= b else np.arange(a, b)[:, None] < lengths[:n]
        places = np.zeros((b - a, 2, n), dtype=np.int64)
        hits = np.zeros((b - a, 2, n), dtype=bool)
        order0 = np.ones((b - a, n))
        for t in range(a, b):
            m = n if live is None else int(live[t - a].sum())
            cell = cells.find(one[:m], two[:m])
            guess, sure = cells.guess[cell], cells.sure[cell]
            at = mixture.row[:, :m] + sure
            wide2, wide1 = mixture.widths(at, guess[0] == guess[1])
            wide = wide2 + wide1
            value = reader.peek(slice(0, m), _TOTAL_BITS)
            unit = (_TOTAL - wide) >> _SLOT_BITS
            hit2 = value < wide2
            named = value < wide
            rest = (np.maximum(value - wide, 0) / unit).astype(np.int64)
            rest = np.minimum(rest, _SLOTS - 1)
            rest += lane[:m] << _SLOT_BITS
            entry = entries[first[:m] + slot[rest]]
            size, start = entry & 0xFFFF, (entry >> 16) & 0x7FFF
            now = np.where(named, np.where(hit2, guess[1], guess[0]), entry >> 31)
            begin = np.where(hit2, 0, np.where(named, wide2, wide + start * unit))
            extent = np.where(hit2, wide2, np.where(named, wide1, size * unit))
            reader.take(slice(0, m), begin, extent, _TOTAL_BITS)
            chance = size / _SLOTS
            new = (start + size == _SLOTS) & ~named
            rows = np.flatnonzero(new)
            if len(rows):
                whole = np.zeros(len(rows), dtype=np.int64)
                for shift, width in _uniform_steps(bits):
                    part = reader.peek(rows, width)
                    reader.take(rows, part, 1, width)
                    whole |= part << shift
                now[rows] = whole
                chance[rows] /= 1 << bits
            order0[t - a, :m] = np.where(named, _NAMED, chance)
            places[t - a, :, :m] = at
            hits[t - a, :, :m] = cells.learn(cell, guess, sure, now.astype(np.uint32))
            ids[t, :m] = now
            one, two = now, one
        mixture.record(places, hits, order0, live)
    return ids


class DamagedBlock(ValueError):
    """A block whose marks, length or checksums are wrong."""


def split_blocks(data: bytes) -> tuple[list[tuple], list[bytes]]:
    """Heads (ids, words, crc of ids, id bits) and payloads of consecutive blocks."""
    heads, payloads, at = [], [], 0
    while at < len(data):
        if at + _HEAD_SIZE > len(data):
            raise DamagedBlock("a block's head is cut off")
        magic, ids, words, crc, payload_crc, bits = _HEAD.unpack_from(data, at)
        (head_crc,) = _CRC.unpack_from(data, at + _HEAD.size)
        if magic != MAGIC or zlib.crc32(data[at : at + _HEAD.size]) != head_crc:
            raise DamagedBlock(f"the head of block {len(heads)} is damaged")
        payload = data[at + _HEAD_SIZE : at + _HEAD_SIZE + 2 * words]
        if len(payload) != 2 * words or zlib.crc32(payload) != payload_crc:
            raise DamagedBlock(f"block {len(heads)} is damaged")
        heads.append((ids, words, crc, bits))
        payloads.append(payload)
        at += _HEAD_SIZE + 2 * words
    return heads, payloads


def encode_ids(ids: np.ndarray) -> bytes:
    """A sequence of unsigned 32-bit ids as blocks; empty for no ids."""
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    groups = [blocks[i : i + LANES] for i in range(0, len(blocks), LANES)]
    return b"".join(encode_blocks(g) for g in groups)


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of consecutive blocks; raises DamagedBlock if a checksum is wrong."""
    heads, payloads = split_blocks(data)
    parts: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * len(heads)
    by_bits: dict[int, list[int]] = {}
    for i, head in enumerate(heads):
        by_bits.setdefault(head[3], []).append(i)
    for members in by_bits.values():
        members.sort(key=lambda i: -heads[i][0])
        for a in range(0, len(members), LANES):
            some = members[a : a + LANES]
            ids = _decode_lanes([heads[i] for i in some], [payloads[i] for i in some])
            for lane, i in enumerate(some):
                parts[i] = ids[: heads[i][0], lane].astype("<u4")
                if zlib.crc32(parts[i].tobytes()) != heads[i][2]:
                    raise DamagedBlock(f"block {i} decodes to other ids")
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
