"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for every piece that matches; the forward pass sums path weights up to each
position and the backward pass draws a path from its end, edge by edge, so segmentations are
drawn exactly by their weight. Draws come from a counter-based generator keyed by the row key, the
unit's place in the text and the step, and a node's cumulative probabilities are summed on their own: the
same row is always cut the same way, whichever executor does it, however rows are dealt and whatever is beside it.

No piece crosses from a non-blank to a blank or over a line feed or tab, so the lattice falls into units (checked
when the vocabulary is loaded). The forward pass of a unit is done once and kept in a bounded table. Units
of more than ``LONG_UNIT`` bytes (texts without blanks) are done one by one in blocks: the forward pass keeps the sums at
the blocks' bounds, and the backward pass makes each block's again. A long text is read a part at a time.

The vocabulary file is a byte-fallback BPE model, which has merge ranks instead of probabilities. A piece's
weight is Zipfian in its rank, raised to ``alpha``; larger values cut less freely. The driver reads the file and sends
it along. Text is taken as it is: one blank goes in front, blanks become the model's blank mark, and characters
without a piece are cut into byte pieces. Decoding joins the pieces' bytes and drops that blank, which gives back any text.

A null text has null ids; an empty one has the pieces of the blank in front. A null row key is a key of its own.
Repeated rows are cut alike; an empty table gives no rows; other columns do not matter, and a kept one that is called
as a result gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import islice
from math import exp, log1p
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ROW, bounded_batches, pack, runs, table, tidy, unpack, utf8, with_row

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 17
RUN_BYTES = 1 << 18
#: Edges that the table of known units holds before it is begun anew.
TABLE_EDGES = 2_000_000
#: Bytes of a unit that is done on its own, and of the blocks it is done in.
LONG_UNIT = 2048
BLOCK = 1 << 15
#: Units of a long text that are cut at once.
PART = 50_000

_MARK = "▁"
_UNITS = re.compile(rb"[\n\t]| *[^ \n\t]+| +")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Piece bytes and log weights, and a trie of the pieces."""

    def __init__(self, model: bytes, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.pieces: list[bytes] = []
        self.byte_ids = np.full(256, -1, np.int32)
        self.log_weight = np.zeros(n)
        listed = []
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value] = i
                self.pieces.append(bytes([value]))
                self.log_weight[i] = -alpha * np.log(4.0 * n)
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.pieces.append(b"")
            else:
                piece = sp.id_to_piece(i).replace(_MARK, " ").encode()
                if re.search(rb"[^ ] |[\n\t]", piece):
                    raise ValueError(f"piece {i} crosses a unit's bounds")
                self.pieces.append(piece)
                self.log_weight[i] = -alpha * np.log(10.0 - sp.get_score(i))
                listed.append((piece, i))
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        children: dict[int, int] = {}
        ends = [-1]
        for piece, i in listed:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in children:
                    children[key] = len(ends)
                    ends.append(-1)
                node = children[key]
            ends[node] = i
        self.keys = np.array(sorted(children), np.int64)
        self.child = np.array([children[k] for k in self.keys.tolist()], np.int32)
        self.ends = np.array(ends, np.int32)
        self.root = np.array([children.get(b, -1) for b in range(256)], np.int32)
        self.longest = max(len(p) for p in self.pieces)

    @cached_property
    def by_bytes(self) -> dict[bytes, int]:
        """The pieces that are not byte pieces."""
        bytes_ = set(self.byte_ids.tolist())
        return {p: i for i, p in enumerate(self.pieces) if p and i not in bytes_}

    @cached_property
    def children(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.child.tolist(), strict=True))

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.child[at], -1)


class Lattices:
    """Backward sampling tables of units: for every node its edges, longest first, with cumulative probabilities."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.end_node: dict[bytes, int] = {}
        self.nodes = self.edges = 0
        self.first = np.zeros(1 << 16, np.int32)  # first edge of every node
        self.root = np.zeros(1 << 16, bool)
        self.cum = np.zeros(1 << 18, np.float64)
        self.start = np.zeros(1 << 18, np.int32)  # node an edge comes from
        self.piece = np.zeros(1 << 18, np.int32)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        room = getattr(self, name)
        if at + len(values) > len(room):
            wider = np.zeros(max(at + len(values), len(room) * 3 // 2), room.dtype)
            wider[:at] = room[:at]
            setattr(self, name, wider)
            room = wider
        room[at : at + len(values)] = values

    def add(self, units: list[bytes]) -> None:
        """Forward filtering of new units."""
        v = self.v
        raw = np.frombuffer(b"".join(units), np.uint8)
        sizes = np.array([len(u) for u in units])
        ends = np.repeat(np.cumsum(sizes), sizes)
        word = np.repeat(np.arange(len(units)), sizes)
        begins = np.cumsum(sizes) - sizes
        char = np.nonzero((raw & 0xC0) != 0x80)[0]
        whole = np.ones(256, np.int64)
        whole[0xC0:0xE0], whole[0xE0:0xF0], whole[0xF0:] = 2, 3, 4
        size_of = np.zeros(len(raw), np.int64)
        size_of[char] = whole[raw[char]]
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        known = np.zeros(len(raw), bool)
        at, node = char, v.root[raw[char]]
        depth = 1
        while len(at):
            alive = node >= 0
            at, node = at[alive], node[alive]
            hit = v.ends[node] >= 0
            levels.append((at[hit], v.ends[node[hit]]))
            one = at[hit][size_of[at[hit]] == depth]
            known[one] = True
            more = at + depth < ends[at]
            at, node = at[more], node[more]
            node = v.step(node, raw[at + depth])
            depth += 1
        # Characters without a piece of their own: an edge for each byte.
        lead = np.zeros(len(raw), np.int64)
        lead[char] = 1
        owner = char[np.cumsum(lead) - 1] if len(char) else lead
        odd = np.nonzero(~known[owner])[0]
        merged = np.concatenate([levels[0][0], odd]) if levels else odd
        levels[:1] = [(merged, np.concatenate([levels[0][1], v.byte_ids[raw[odd]]]) if levels else v.byte_ids[raw[odd]])]
        nodes = len(raw) + len(units)
        degree = np.zeros(nodes + 1, np.int64)
        for d, (at, _) in enumerate(levels, 1):
            degree[at + word[at] + d] += 1
        first = np.cumsum(degree) - degree
        total = int(degree.sum())
        slot_start, slot_piece = np.empty(total, np.int64), np.empty(total, np.int32)
        filled = first.copy()
        places = []
        for d in range(len(levels), 0, -1):
            at, ids = levels[d - 1]
            end = at + word[at] + d
            slot = filled[end]
            filled[end] += 1
            slot_start[slot], slot_piece[slot] = at + word[at], ids
            places.append((slot, end, at - begins[word[at]]))
        slot = np.concatenate([p[0] for p in places])
        end = np.concatenate([p[1] for p in places])
        offset = np.concatenate([p[2] for p in places])
        order = np.argsort(offset.astype(np.uint16) if offset.max(initial=0) < 65536 else offset, kind="stable")
        slot, end = slot[order], end[order]
        source, weight = slot_start[slot], v.log_weight[slot_piece[slot]]
        alpha = np.full(nodes, -np.inf)
        roots = begins + np.arange(len(units))
        alpha[roots] = 0.0
        cuts = np.concatenate([[0], np.cumsum(np.bincount(offset))])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:  # the edges of one offset have distinct ends
                to = end[a:b]
                alpha[to] = np.logaddexp(alpha[to], alpha[source[a:b]] + weight[a:b])
        chance = np.empty(total)
        with np.errstate(invalid="ignore"):
            chance[slot] = np.exp(alpha[source] + weight - alpha[end])
        chance = np.nan_to_num(chance)  # nodes inside a character that no path reaches
        cum = np.empty(total)
        for k in range(int(degree.max(initial=0))):  # each node's on its own, so that no other unit has a part in it
            at = first[degree > k] + k
            cum[at] = chance[at] + (cum[at - 1] if k else 0.0)
        cum[(first + degree - 1)[degree > 0]] = 2.0
        is_root = np.zeros(nodes, bool)
        is_root[roots] = True
        self._put("cum", self.edges, cum)
        self._put("start", self.edges, slot_start + self.nodes)
        self._put("piece", self.edges, slot_piece)
        self._put("first", self.nodes, first[:nodes] + self.edges)
        self._put("root", self.nodes, is_root)
        for unit, node in zip(units, (roots + sizes + self.nodes).tolist(), strict=True):
            self.end_node[unit] = node
        self.nodes += nodes
        self.edges += total

    def sample(self, nodes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling: the pieces of unit occurrences in order, and how many each has."""
        n = len(nodes)
        which, drawn = [], []
        count = np.zeros(n, np.int64)
        active, node = np.arange(n), nodes
        while len(active):
            state = _mix(state + _GOLD)
            u = (state >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.first[node].astype(np.int64)
            wait = np.nonzero(u >= self.cum[edge])[0]
            while len(wait):
                edge[wait] += 1
                wait = wait[u[wait] >= self.cum[edge[wait]]]
            which.append(active)
            drawn.append(self.piece[edge])
            count[active] += 1
            node = self.start[edge]
            on = ~self.root[node]
            active, node, state = active[on], node[on], state[on]
        after = np.cumsum(count)
        out = np.empty(int(after[-1]) if n else 0, np.int32)
        for k, (at, ids) in enumerate(zip(which, drawn, strict=True)):
            out[after[at] - 1 - k] = ids
        return out, count


class LongUnit:
    """Forward filtering and backward sampling of one unit, by blocks of its bytes."""

    def __init__(self, v: Vocabulary, unit: bytes):
        self.v, self.unit = v, unit
        ends, edge = v.ends.tolist(), v.children
        root, self.weight, self.byte_ids = v.root.tolist(), v.log_weight.tolist(), v.byte_ids.tolist()
        self.walk = ends, edge, root
        carry, self.carries = {0: 0.0}, []
        for p in range(0, len(unit), BLOCK):
            self.carries.append(carry)
            sums = self._sums(p)
            carry = {k: x for k, x in sums.items() if k >= p + BLOCK}
        self.last = carry if len(unit) % BLOCK == 0 else sums

    def _char(self, at: int) -> bytes:
        """The character that the byte at ``at`` is part of."""
        end = at + 1
        while self.unit[at] & 0xC0 == 0x80 and at:
            at -= 1
        while end < len(self.unit) and self.unit[end] & 0xC0 == 0x80:
            end += 1
        return self.unit[at:end]

    def _sums(self, p: int) -> dict[int, float]:
        """Log weights of all paths to each node of the block at ``p``, and what it adds to those after it."""
        unit, (ends, edge, root) = self.unit, self.walk
        sums = dict(self.carries[p // BLOCK])

        def add(source: float, to: int, piece: int) -> None:
            x = source + self.weight[piece]
            old = sums.get(to)
            sums[to] = x if old is None else max(old, x) + log1p(exp(-abs(old - x)))

        odd = self._char(p) not in self.v.by_bytes
        for at in range(p, min(p + BLOCK, len(unit))):
            source = sums.get(at)
            if source is None:
                continue
            if unit[at] & 0xC0 != 0x80:
                node, to = root[unit[at]], at + 1
                while node >= 0:
                    if ends[node] >= 0:
                        add(source, to, ends[node])
                    if to == len(unit):
                        break
                    node = edge.get(node << 8 | unit[to], -1)
                    to += 1
                odd = self._char(at) not in self.v.by_bytes
            if odd:
                add(source, at + 1, self.byte_ids[unit[at]])
        return sums

    def _edges(self, to: int) -> Iterator[tuple[int, int]]:
        """Starts and pieces of the edges that end at ``to``, longest first."""
        unit, known = self.unit, self.v.by_bytes
        for at in range(max(0, to - self.v.longest), to):
            piece = known.get(unit[at:to]) if unit[at] & 0xC0 != 0x80 else None
            if piece is not None:
                yield at, piece
        if self._char(to - 1) not in known:
            yield to - 1, self.byte_ids[unit[to - 1]]

    def sample(self, state: int) -> list[int]:
        pieces, to, block = [], len(self.unit), -1
        state_of = np.array([state], np.uint64)
        while to > 0:
            if block != (to - 1) // BLOCK:
                block = (to - 1) // BLOCK
                sums = {**(self._sums((block - 1) * BLOCK) if block else {}), **self._sums(block * BLOCK)}
            state_of = _mix(state_of + _GOLD)
            u = float(state_of[0] >> np.uint64(11)) * 2.0**-53
            cum = 0.0
            for at, piece in self._edges(to):
                if at not in sums:
                    continue
                start, drawn = at, piece
                cum += exp(sums[at] + self.weight[piece] - sums[to])
                if u < cum:
                    break
            pieces.append(drawn)
            to = start
        return pieces[::-1]


@cache
def _vocabulary(model: bytes, alpha: float) -> Vocabulary:
    return Vocabulary(model, alpha)


def _sampled(lat: Lattices, units: list[bytes], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of units in order and how many each has."""
    long = [k for k, u in enumerate(units) if len(u) > LONG_UNIT]
    if long:
        own = np.ones(len(units), bool)
        own[long] = False
        ids, count = _sampled(lat, [u for u in units if len(u) <= LONG_UNIT], state[own])
        parts = {k: np.array(LongUnit(lat.v, units[k]).sample(int(state[k])), np.int32) for k in long}
        counts = np.zeros(len(units), np.int64)
        counts[own] = count
        before = np.concatenate([[0], np.cumsum(counts)])
        out, at = [], 0
        for k, part in parts.items():
            out += [ids[at : before[k]], part]
            at = before[k]
            counts[k] = len(part)
        return np.concatenate([*out, ids[at:]]), counts
    if lat.edges > TABLE_EDGES:
        lat.clear()
    new = [u for u in dict.fromkeys(units) if u not in lat.end_node]
    if new:
        lat.add(new)
    return lat.sample(np.fromiter(map(lat.end_node.__getitem__, units), np.int64, len(units)), state)


def _states(keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    return _mix(keys + (place.astype(np.uint64) + np.uint64(1)) * _GOLD)


def _encode(lat: Lattices, texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of consecutive texts and where each text's begin."""
    if len(texts) == 1 and len(texts[0]) > RUN_BYTES:
        parts, place = [], 0
        every = (m.group() for m in _UNITS.finditer(b" " + texts[0]))
        while units := list(islice(every, PART)):
            parts.append(_sampled(lat, units, _states(np.repeat(keys, len(units)), place + np.arange(len(units))))[0])
            place += len(units)
        ids = np.concatenate(parts)
        return ids, np.array([0, len(ids)])
    units: list[bytes] = []
    sizes = []
    for raw in texts:
        own = _UNITS.findall(b" " + raw)
        sizes.append(len(own))
        units += own
    first = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(units)) - np.repeat(first[:-1], sizes)
    ids, count = _sampled(lat, units, _states(np.repeat(keys, sizes), place))
    return ids, np.concatenate([[0], np.cumsum(count)])[first]


def encode(docs: DataFrame, key: Column, *, keep: list[str], model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``keep`` columns and ids (array<int>): a sampled segmentation of each whole text, seeded by ``key``."""
    bounded_batches(docs.sparkSession)
    packed = docs.select(pack(keep), F.xxhash64(key, F.lit(seed)).alias("key"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattices(_vocabulary(shared.value, alpha))
        for batch in batches:
            texts = batch.column("text")
            keys = batch.column("key").to_numpy().view(np.uint64)
            raw, bounds = utf8(texts)
            for i, j in runs(bounds, RUN_BYTES):
                ids, first = _encode(lat, [raw[bounds[k] : bounds[k + 1]].tobytes() for k in range(i, j)], keys[i:j])
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=texts.slice(i, j - i).is_null())
                yield pa.RecordBatch.from_arrays([batch.column(ROW).slice(i, j - i), lists], names=[ROW, "ids"])

    return packed.mapInArrow(tidy(cut), with_row(packed, "ids array<int>")).select(*unpack(keep, ["ids"]))


def _decode(pieces: list[bytes], ids: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The texts that pieces stand for, without the blank in front."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        parts = [b"".join(map(pieces.__getitem__, ids[k : min(k + 10 * PART, b)].tolist())) for k in range(a, b, 10 * PART)]
        out.append(b"".join(parts)[1:])
    return out


def decode(encoded: DataFrame, *, keep: list[str], model: str = MODEL) -> DataFrame:
    """``keep`` columns and text, put together again from ids; null ids give a null text."""
    bounded_batches(encoded.sparkSession)
    packed = encoded.select(pack(keep), "ids")
    shared = encoded.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _vocabulary(shared.value, ALPHA).pieces
        for batch in batches:
            column = batch.column("ids")
            texts = _decode(pieces, column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy())
            out = pa.array([t.decode() if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(ROW), out], names=[ROW, "text"])

    return packed.mapInArrow(tidy(join), with_row(packed, "text string")).select(*unpack(keep, ["text"]))


def round_trip(docs: DataFrame, *, key: str = "doc_id", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The key column, ids, n_pieces, n_bytes and lossless (decoding gives back the text) of every document.

    Encodes like ``encode`` and decodes like ``decode``, both in the worker that holds the text.
    """
    bounded_batches(docs.sparkSession)
    packed = docs.select(pack([key]), F.xxhash64(F.col(key), F.lit(seed)).alias("key"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    results = ["ids", "n_pieces", "n_bytes", "lossless"]

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = Lattices(_vocabulary(shared.value, alpha))
        for batch in batches:
            column = batch.column("text")
            keys = batch.column("key").to_numpy().view(np.uint64)
            raw, bounds = utf8(column)
            for i, j in runs(bounds, RUN_BYTES):
                texts = [raw[bounds[k] : bounds[k + 1]].tobytes() for k in range(i, j)]
                ids, first = _encode(lat, texts, keys[i:j])
                same = [x == y for x, y in zip(_decode(lat.v.pieces, ids, first), texts, strict=True)]
                missing = column.slice(i, j - i).is_null()
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=missing)
                counts = np.where(missing.to_numpy(zero_copy_only=False), 0, np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(ROW).slice(i, j - i), lists, pa.array(counts), pa.array(np.diff(bounds[i : j + 1])), pa.array(same)], names=[ROW, *results])

    done = packed.mapInArrow(tidy(both), with_row(packed, "ids array<int>, n_pieces bigint, n_bytes bigint, lossless boolean"))
    return done.select(*unpack([key], results))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
