"""Suffix-array dedup: repeated 50-byte strings across documents, by distributed difference covers.

Texts are UTF-8 bytes. A byte goes when a string of ``LENGTH`` bytes covers it that also starts in a
document of smaller doc_id. Sorting every suffix of a corpus would shuffle many times its size, so
the suffixes that can matter are found first, without loss, and those are sorted:

1. Every string of 50 bytes holds an anchor: the 24-byte gram of least hash in it. Equal strings have
   equal anchors, so a string can repeat only where its anchor does. Documents are also cut, at
   content-defined places, into units; a unit is a stretch with the 49 bytes after it. Equal units are
   represented by the smallest document that has them, so copies are sorted once.
   Stretches are compared by 128 bits of a cryptographic hash, anchors are only dealt by theirs.
2. Anchors that stand in different units of different representatives are dealt by hash; the text around them
   goes to the same bucket, where its suffixes are sorted: names of sampled triples, recursion on the
   names while they repeat, then the merge with the remaining suffixes. Neighbours in that order whose
   50-byte prefixes agree are equal strings; each class takes the smallest doc_id that has it. Of equal text
   around equal anchors a task sends the smallest document's on only: all of it goes in the others, so
   a passage that many documents share reaches its bucket once a task. Around an anchor of very many documents
   the text is dealt twice, by the 13 bytes before the anchor and by those after it: two texts that share a string
   agree in one of them.
3. The removed spans go back to their documents, and with them the copied units.

Buckets are dealt in proportion to the input's bytes. Null and empty texts have no bytes, an empty table gives
no rows. Matches never cross documents. Rows without a doc_id neither remove nor lose anything; rows of the same
doc_id do not remove each other's bytes. Very long texts are marked in overlapping pieces, as a whole; a task
holds one document's text and its marks at once. Only doc_id and text (and ``keep``) are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import ROW, bounded_batches, pack, runs, scratch_alone, table, tidy, unpack, utf8, with_row

LENGTH = 50
GRAM = 24
#: Cut places have the least gram within so many bytes to either side.
RADIUS = 128
RUN_BYTES = 1 << 18
#: Text that one bucket answers for.
BUCKET_BYTES = 1 << 20
#: Parts of such a bucket that are sorted on their own.
SORTED_PARTS = 4
#: Documents of one anchor from which on the text around it is dealt by the bytes beside the anchor as well.
HOT_ANCHOR = 2000
#: Pieces of text around anchors that a task remembers, to tell copies at once.
SEEN = 100_000

#: Bytes to either side that decide whether a place is an anchor or a cut, at most.
_MARGIN = 256
_REACH = LENGTH - GRAM  # bytes of a string on one side of its anchor, at most
_TOP = np.uint32(0xFFFFFFFF)
_GRAM_VALUES = np.random.default_rng(50).integers(0, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)


def _gram_hash(raw: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 24 bytes from each position on."""
    h, step, width = _GRAM_VALUES[raw], 0x9E3779B1, 1
    held = {1: h}
    while width < 16:
        h = h[:-width] * np.uint32(step) + h[width:]
        step = step * step & 0xFFFFFFFF
        width *= 2
        held[width] = h
    eight = held[8][16:]
    eight_step = pow(0x9E3779B1, 8, 1 << 32)
    h = held[16][: len(eight)] * np.uint32(eight_step) + eight
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width``."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def _places(raw: np.ndarray, bounds: np.ndarray, anchors: bool = True, cuts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and cut places of consecutive texts, as far as they are wanted."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
    # A gap after each text keeps its neighbours out of every window.
    spread = np.arange(len(raw)) + doc * np.int64(RADIUS + LENGTH)
    room = len(raw) + n * (RADIUS + LENGTH) + RADIUS + LENGTH
    gapped = np.zeros(room, np.uint8)
    gapped[spread] = raw
    left = bounds[1:][doc] - np.arange(len(raw))  # bytes to the end of the text
    order = np.full(room, _TOP, np.uint32)
    h = np.minimum(_gram_hash(gapped), _TOP - np.uint32(1))
    whole = left >= GRAM
    order[spread[whole]] = h[spread[whole]]
    own = order[spread]
    found = cut = np.empty(0, np.int64)
    if anchors:
        width = _REACH + 1
        least = _least(order, width)
        in_string = np.zeros(room, np.uint32)
        full = spread[left >= LENGTH]
        in_string[full] = least[full]
        most = ~_least(~np.concatenate([np.zeros(width - 1, np.uint32), in_string]), width)
        found = np.nonzero((most[spread] == own) & whole)[0]
    if cuts:
        near = _least(np.concatenate([np.full(RADIUS, _TOP, np.uint32), order, np.full(RADIUS, _TOP, np.uint32)]), RADIUS)
        here = (near[spread + RADIUS] == own) & (near[spread] > own) & whole  # so cuts are over RADIUS apart
        here[bounds[:-1][sizes > 0]] = True
        cut = np.nonzero(here)[0]
    return found, cut


def _places_of_one(raw: np.ndarray, anchors: bool = True, cuts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``_places`` of one long text, by overlapping pieces."""
    found: tuple[list, list] = [], []
    for a in range(0, len(raw), RUN_BYTES):
        low, high = max(0, a - _MARGIN), min(len(raw), a + RUN_BYTES + _MARGIN)
        for out, at in zip(found, _places(raw[low:high], np.array([0, high - low]), anchors, cuts), strict=True):
            at = at + low
            out.append(at[(at >= a) & (at < a + RUN_BYTES)])
    return np.concatenate(found[0]), np.concatenate(found[1])


def _found(raw: np.ndarray, bounds: np.ndarray, anchors: bool = True, cuts: bool = True) -> tuple[np.ndarray, np.ndarray]:
    long = len(bounds) == 2 and len(raw) > 2 * RUN_BYTES
    return _places_of_one(raw, anchors, cuts) if long else _places(raw, bounds, anchors, cuts)


class Anchors:
    """Anchors of consecutive texts; positions count over all of them."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, at: np.ndarray | None = None):
        self.at = _found(raw, bounds, cuts=False)[0] if at is None else at
        self.doc = np.searchsorted(bounds, self.at, side="right") - 1
        self.hash = shingles.span_hash(raw, self.at, np.full(len(self.at), GRAM))


class Units:
    """Units of consecutive texts, with 128 bits of each one's hash; positions count over all texts."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, starts: np.ndarray | None = None):
        self.starts = _found(raw, bounds, anchors=False)[1] if starts is None else starts
        self.doc = np.searchsorted(bounds, self.starts, side="right") - 1
        ends = bounds[1:][self.doc] if len(self.starts) else self.starts
        self.stops = np.minimum(np.minimum(np.append(self.starts[1:], len(raw))[: len(self.starts)], ends) + LENGTH - 1, ends)
        data = memoryview(np.ascontiguousarray(raw))
        self.digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(self.starts.tolist(), self.stops.tolist(), strict=True)]
        halves = np.frombuffer(b"".join(self.digests), np.uint64).reshape(-1, 2)
        self.hash, self.more = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def _held(anchors: Anchors, units: Units, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an anchor and a unit in which its strings start: its own unit or the one before."""
    unit = np.searchsorted(units.starts, anchors.at, side="right") - 1
    early = np.searchsorted(units.starts, np.maximum(anchors.at - _REACH, bounds[:-1][anchors.doc]), side="right") - 1
    split = np.nonzero(early != unit)[0]
    return np.concatenate([np.arange(len(unit)), split]), np.concatenate([unit, early[split]])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def _dealt(kind: int, buckets: int, h: np.ndarray, unit: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
    """Rows bucket, kind, first doc and packed hashes, units and doc steps, each bucket's once.

    Kind 0 has anchors with half the hash of a unit, kind 1 the two halves of units' hashes.
    """
    if not len(h):
        return
    pair = np.lexsort((doc, unit, h))
    h, unit, doc = h[pair], unit[pair], doc[pair]
    fresh = np.ones(len(h), bool)  # the smallest document of an anchor in a unit stands for the others
    fresh[1:] = (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])
    if kind:
        fresh[1:] |= doc[1:] != doc[:-1]
    h, unit, doc = h[fresh], unit[fresh], doc[fresh]
    where = _bucket(h, buckets)
    by = np.lexsort((doc, where))
    h, unit, doc, where = h[by], unit[by], doc[by], where[by]
    cuts = np.concatenate([[0], np.nonzero(np.diff(where))[0] + 1, [len(where)]])
    h_raw = h.view(np.uint8).reshape(-1, 8)[:, : 8 if kind else 6]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        steps = np.diff(doc[a:b])
        top = int(steps.max(initial=0))
        size = next(k for k in (1, 2, 4, 8) if top < 1 << (8 * k - 1))
        yield int(where[a]), kind, int(doc[a]), h_raw[a:b].tobytes(), unit[a:b].tobytes(), steps.astype(f"<i{size}").tobytes(), size


_DEALT = "bucket int, kind int, first bigint, h binary, unit binary, steps binary, size int"


def _widened(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view(np.uint64).reshape(-1)


def _survey(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchors (kind 0) with their units, and units (kind 1), of every document."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            parts: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, j in runs(bounds, RUN_BYTES):
                text, base, own = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], ids[i:j]
                at, starts = _found(text, base)
                anchors, units = Anchors(text, base, at), Units(text, base, starts)
                anchor, unit = _held(anchors, units, base)
                for part, values in zip(parts, (anchors.hash[anchor], units.hash[unit], own[anchors.doc[anchor]], units.hash, units.more, own[units.doc]), strict=True):
                    part.append(values)
            if not parts[0]:
                continue
            h, unit, doc, unit_h, unit_more, unit_doc = (np.concatenate(p) for p in parts)
            rows = [*_dealt(0, buckets, h, unit, doc), *_dealt(1, buckets, unit_h, unit_more, unit_doc)]
            if rows:
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "first", "h", "unit", "steps", "size"])

    return docs.mapInArrow(tidy(mark), _DEALT)


def _resolve(t: pa.Table, hot_anchor: int) -> pa.Table:
    """For one bucket: kind 0 (doc_id, anchor) to be sorted, kind 1 (doc_id, unit) copied from a smaller document."""
    found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for kind in (0, 1):
        rows = [r for r in t.to_pylist() if r["kind"] == kind]
        if not rows:
            continue
        h = np.concatenate([_widened(r["h"], 8 if kind else 6) for r in rows])
        unit = np.concatenate([np.frombuffer(r["unit"], np.uint64) for r in rows])
        doc = np.concatenate([r["first"] + np.concatenate([[0], np.cumsum(np.frombuffer(r["steps"], f"<i{r['size']}").astype(np.int64))]) for r in rows]).astype(np.int64)
        order = np.lexsort((doc, unit, h))
        h, unit, doc = h[order], unit[order], doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])
        if kind == 1:
            owner = doc[np.nonzero(first)[0]][np.cumsum(first) - 1]
            copied = doc > owner
            found.append((1, doc[copied], h[copied], unit[copied]))
            continue
        h, doc = h[first], doc[first]  # an anchor once for each distinct unit, with its smallest document
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        begins = np.concatenate([[True], h[1:] != h[:-1]])
        ends = np.concatenate([begins[1:], [True]])
        group = np.cumsum(begins) - 1
        pick = (doc[begins] < doc[ends])[group]
        pick[1:] &= begins[1:] | (doc[1:] != doc[:-1])
        hot = (np.bincount(group) >= hot_anchor)[group].astype(np.uint64)
        found.append((0, doc[pick], h[pick] | (hot[pick] << np.uint64(48)), h[pick]))
    column = lambda k, kind: np.concatenate([f[k] for f in found]).view(kind) if found else np.empty(0, kind)
    kinds = np.concatenate([np.full(len(f[1]), f[0], np.int32) for f in found]) if found else np.empty(0, np.int32)
    return pa.table({"doc_id": column(1, np.int64), "kind": kinds, "mark": column(2, np.int64), "more": column(3, np.int64)})


_LOW48 = np.uint64((1 << 48) - 1)


def _listed(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of rows i to j of a list column and the row of each, counted from i."""
    part = column.slice(i, j - i)
    offsets = part.offsets.to_numpy()
    return part.values.to_numpy()[offsets[0] : offsets[-1]], np.repeat(np.arange(j - i), np.diff(offsets))


def _sides(text: bytes, lead: int, anchor: int, buckets: int) -> set[int]:
    """Buckets of a text by the half of a string's other bytes that stands on either side of its anchor."""
    half = _REACH // 2
    sides = (text[lead - half : lead] if lead >= half else None, text[lead + GRAM : lead + GRAM + half])
    named = [bytes([k]) + x for k, x in enumerate(sides) if x is not None and len(x) == half]
    start = anchor.to_bytes(8, "little", signed=True)
    return {int.from_bytes(hashlib.blake2b(start + x, digest_size=8).digest(), "little") % buckets for x in named}


def _segments(docs: DataFrame, buckets: int) -> DataFrame:
    """The text around every anchor to be sorted, dealt by the anchor's hash.

    Where the task has seen the same text around the same anchor in a smaller document, all of it goes:
    a row with lead -1 says so, with the span's end in place of the anchor.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, bytes], int] = {}
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            ids, prints = batch.column("doc_id").to_numpy(), batch.column("print").to_numpy()
            for i, j in runs(bounds, RUN_BYTES):
                rows: list[tuple] = []
                spans: dict[int, list[tuple[int, int]]] = {}
                own, base = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                m = Anchors(own, base)
                marks, row = _listed(batch.column("anchors"), i, j)
                mark = marks.view(np.uint64)
                asked, one = np.unique(shingles.mix((mark & _LOW48) + shingles.mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
                row_of = m.doc
                key = shingles.mix((m.hash & _LOW48) + shingles.mix(row_of.astype(np.uint64) + np.uint64(1)))
                at = np.minimum(np.searchsorted(asked, key), max(len(asked) - 1, 0))
                hit = np.nonzero(asked[at] == key)[0] if len(asked) else at[:0]
                hot = mark[one[at[hit]]] > _LOW48
                q, h, row_of = m.at[hit], m.hash[hit], row_of[hit]
                begin, end = np.maximum(base[row_of], q - _REACH), np.minimum(base[row_of + 1], q + LENGTH)
                data = own.tobytes()
                every = zip(row_of.tolist(), begin.tolist(), end.tolist(), (q - begin).tolist(), h.view(np.int64).tolist(), _bucket(h, buckets).tolist(), hot.tolist(), strict=True)
                for r, a, b, lead, anchor, where, crowded in every:
                    doc, text = int(ids[i + r]), data[a:b]
                    least = seen.get((anchor, lead, text))
                    if least is not None and least < doc:
                        if b - a >= LENGTH:
                            spans.setdefault(r, []).append((a, b))
                        continue
                    if least is None:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen[anchor, lead, text] = doc
                    elif doc < least:
                        seen[anchor, lead, text] = doc
                    for at in _sides(text, lead, anchor, buckets) if crowded else (where,):
                        rows.append((at, doc, int(prints[i + r]), a - int(base[r]), anchor, lead, text))
                for r, found in spans.items():
                    doc, start = int(ids[i + r]), int(base[r])
                    a, b = found[0]
                    for c, d in [*found[1:], (len(data) + LENGTH, 0)]:  # in order of place
                        if c > b:
                            rows.append(((doc ^ a) % buckets, doc, int(prints[i + r]), a - start, b - start, -1, b""))
                            a, b = c, d
                        b = max(b, d)
                rows.sort(key=lambda x: x[0])
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "doc_id", "print", "begin", "anchor", "lead", "bytes"])

    return docs.mapInArrow(tidy(cut), "bucket int, doc_id bigint, print bigint, begin bigint, anchor bigint, lead int, bytes binary")


def difference_cover_order(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers above 0 by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate([s, np.zeros(3, np.int64)])
    base = int(padded.max()) + 1
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([one, two])
    # Names of the sampled triples.
    lead = padded[sampled] * base + padded[sampled + 1]
    if base >= 1 << 20:
        lead = _names(lead)
    names = _names(lead * base + padded[sampled + 2]) + 1
    order = difference_cover_order(names) if int(names.max()) < len(names) else np.argsort(names)
    by_rank = sampled[order]
    rank = np.zeros(n + 3, np.int64)
    rank[by_rank] = np.arange(1, len(by_rank) + 1)
    by_rank = by_rank[by_rank < n]
    # The remaining suffixes, by first symbol and the rank of what follows.
    top = len(sampled) + 2
    rest = np.arange(0, n, 3)
    rest_key = padded[rest] * top + rank[rest + 1]
    by_key = np.argsort(rest_key)
    rest, rest_key = rest[by_key], rest_key[by_key]
    # The merge: how many sampled suffixes of either residue stand before each.
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted(padded[first] * top + rank[first + 1], rest_key)
    lead = np.concatenate([padded[second] * base + padded[second + 1], padded[rest] * base + padded[rest + 1]])
    if base >= 1 << 16:
        lead = _names(lead)
    key = lead * top + rank[np.concatenate([second, rest]) + 2]
    before = before + np.searchsorted(key[: len(second)], key[len(second) :])
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    at = before + np.arange(len(rest))
    taken[at] = True
    out[at] = rest
    out[~taken] = by_rank
    return out


def _names(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys among their distinct values."""
    return np.unique(keys, return_inverse=True)[1]


def _string_classes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A class number for the 50-byte string at each start; equal strings have equal numbers.

    ``raw`` holds the texts as symbols byte + 2, with ones between them.
    """
    order = difference_cover_order(raw.astype(np.int64))
    wanted = np.zeros(len(raw), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    # Compare neighbours' prefixes, eight symbols at a time.
    low = np.maximum(raw - 2, 0).astype(np.uint64)
    eight = low[: len(low) - 7].copy()
    for k in range(1, 8):
        eight |= low[k : len(low) - 7 + k] << np.uint64(8 * k)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        same &= eight[order[1:] + k] == eight[order[:-1] + k]
    classes = np.empty(len(raw), np.int64)
    classes[order] = np.cumsum(np.concatenate([[0], ~same])) if len(order) else order
    return classes[starts]


def _removed(t: pa.Table) -> pa.Table:
    """For one bucket: the spans [a, b) of documents to remove."""
    told = pc.equal(t.column("lead"), -1)
    copied = t.filter(told)
    sure = pa.table({"doc_id": copied.column("doc_id"), "print": copied.column("print"), "a": copied.column("begin"), "b": copied.column("anchor")})
    return pa.concat_tables([sure, _sorted_spans(t.filter(pc.invert(told)))])


def _sorted_spans(t: pa.Table) -> pa.Table:
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "print": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not t.num_rows:
        return empty
    doc, print_, begin = (t.column(c).to_numpy() for c in ("doc_id", "print", "begin"))
    around = zip(t.column("anchor").to_pylist(), t.column("lead").to_pylist(), t.column("bytes").to_pylist(), strict=True)
    # Equal text around equal anchors is sorted once, for the smallest document that has it.
    kept: dict[tuple[int, int, bytes], int] = {}
    slot = np.fromiter((kept.setdefault(x, len(kept)) for x in around), np.int64, len(doc))
    k = len(kept)
    least = np.full(k, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, doc)
    distinct = [x[2] for x in kept]
    alone = _alone(list(kept))
    sizes = np.array([len(x) for x in distinct])
    strings = np.maximum(sizes - LENGTH + 1, 0)
    low = np.repeat(least, strings)  # smallest document of each string of each distinct text
    which = np.repeat(np.arange(k), strings)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(strings) - strings, strings)
    crowd = np.nonzero(~alone)[0]
    if len(crowd):
        at = np.zeros(k, np.int64)
        at[crowd] = np.cumsum(sizes[crowd] + 1) - sizes[crowd] - 1
        raw = np.ones(int((sizes[crowd] + 1).sum()) + 8, np.int16)
        body = np.ones(len(raw), bool)
        body[at[crowd] + sizes[crowd]] = False
        body[-8:] = False
        raw[body] = np.frombuffer(b"".join(distinct[i] for i in crowd), np.uint8).astype(np.int16) + 2
        mine = np.nonzero(~alone[which])[0]
        classes = _string_classes(raw, at[which[mine]] + offset[mine])
        best = np.full(int(classes.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(best, classes, low[mine])
        low[mine] = best[classes]
    # Back to every occurrence: strings that a smaller document has, as spans.
    first = np.cumsum(strings) - strings
    times = strings[slot]
    row = np.repeat(np.arange(len(slot)), times)
    place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    gone = low[first[slot[row]] + place] < doc[row]
    row, place = row[gone], place[gone]
    if not len(row):
        return empty
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
    a = np.nonzero(new)[0]
    b = np.append(a[1:], len(row)) - 1
    r = row[a]
    return pa.table({"doc_id": doc[r], "print": print_[r], "a": begin[r] + place[a], "b": begin[r] + place[b] + LENGTH})


def _alone(kept: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Texts that share no string with another: of the 26 bytes that a shared string has beside
    its anchor, 13 or more stand on one side, and no other text has the same 13 there."""
    half = _REACH // 2
    seen: dict[tuple[int, bytes, bool], int] = {}
    sides = []
    for anchor, lead, text in kept:
        own = []
        if lead >= half:
            own.append((anchor, text[lead - half : lead], True))
        if len(text) - lead - GRAM >= half:
            own.append((anchor, text[lead + GRAM : lead + GRAM + half], False))
        for side in own:
            seen[side] = seen.get(side, 0) + 1
        sides.append(own)
    return np.array([all(seen[side] == 1 for side in own) for own in sides], bool)


def _marks(docs: DataFrame, buckets: int, hot_anchor: int) -> DataFrame:
    """doc_id and its marks (print, mark, more, a, b): spans to remove where print is set, else a copied unit."""
    named = docs.where("doc_id IS NOT NULL")
    dealt = _survey(named.select("doc_id", "text"), buckets)
    resolved = scratch_alone(dealt.groupBy("bucket").applyInArrow(lambda t: _resolve(t, hot_anchor), "doc_id bigint, kind int, mark bigint, more bigint"), "resolved")
    asked = resolved.where("kind = 0").groupBy("doc_id").agg(F.collect_list("mark").alias("anchors"))
    texts = named.select("doc_id", F.xxhash64("text").alias("print"), "text").join(asked, "doc_id")
    around = _segments(texts, buckets * SORTED_PARTS)
    spans = around.groupBy("bucket").applyInArrow(_removed, "doc_id bigint, print bigint, a bigint, b bigint")
    none = F.lit(0).cast("bigint")
    copied = resolved.where("kind = 1").select("doc_id", F.lit(None).cast("bigint").alias("print"), "mark", "more", none.alias("a"), none.alias("b"))
    every = scratch_alone(spans, "spans").select("doc_id", "print", none.alias("mark"), none.alias("more"), "a", "b").unionByName(copied)
    return every.groupBy("doc_id").agg(F.collect_list(F.struct("print", "mark", "more", "a", "b")).alias("marks"))


def _gone(raw: np.ndarray, bounds: np.ndarray, prints: np.ndarray, marks: pa.ListArray) -> np.ndarray:
    """Which bytes of consecutive texts are removed by their marks."""
    offsets, listed = marks.offsets.to_numpy(), marks.values
    row = np.repeat(np.arange(len(prints)), np.diff(offsets))
    unit = listed.field("print").is_null().to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    print_, mark, more, a, b = (listed.field(k).fill_null(0).to_numpy()[offsets[0] : offsets[-1]] for k in ("print", "mark", "more", "a", "b"))
    own = ~unit & (print_ == prints[row])
    begin, end = [bounds[row[own]] + a[own]], [bounds[row[own]] + b[own]]
    copied: dict[int, set[bytes]] = {}
    both = np.stack([mark[unit], more[unit]], 1).tobytes()
    for k, r in enumerate(row[unit].tolist()):
        copied.setdefault(r, set()).add(both[16 * k : 16 * k + 16])
    sizes = np.diff(bounds)
    chosen = np.array([r for r in sorted(copied) if sizes[r] >= LENGTH], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes[chosen])])
    for i, j in runs(ends, RUN_BYTES):
        text = np.concatenate([raw[bounds[r] : bounds[r + 1]] for r in chosen[i:j].tolist()])
        base = ends[i : j + 1] - ends[i]
        units = Units(text, base)
        hit = np.array([d in copied[r] for r, d in zip(chosen[i:j][units.doc].tolist(), units.digests, strict=True)], bool) & (units.stops - units.starts >= LENGTH)
        moved = (bounds[chosen[i:j]] - base[:-1])[units.doc[hit]]
        begin.append(units.starts[hit] + moved)
        end.append(units.stops[hit] + moved)
    change = np.zeros(len(raw) + 1, np.int32)
    np.add.at(change, np.concatenate(begin), 1)
    np.add.at(change, np.concatenate(end), -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def remove_repeats(docs: DataFrame, *, keep: list[str], whole_characters: bool = False, hot_anchor: int = HOT_ANCHOR) -> DataFrame:
    """``keep`` columns with n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row.

    ``whole_characters`` leaves characters that are only removed in part, so that ``kept`` is a text.
    A kept column that is called as a result gives way to it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    packed = docs.select(pack(keep), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = packed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = _marks(packed.select("doc_id", "text"), max(16, -(-total // BUCKET_BYTES)), hot_anchor)
    marked = packed.join(marks, "doc_id", "left").select(ROW, "text", F.xxhash64("text").alias("print"), "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            sizes = np.diff(bounds)
            gone = _gone(raw, bounds, batch.column("print").to_numpy(), batch.column("marks"))
            first = bounds[:-1][sizes > 0]
            if whole_characters and gone.any():
                lead = (raw & 0xC0) != 0x80
                lead[first] = True
                char = np.nonzero(lead)[0]
                gone = np.repeat(np.logical_and.reduceat(gone, char), np.diff(np.append(char, len(raw))))
            fresh = gone.copy()
            fresh[1:] &= ~gone[:-1]
            fresh[first] = gone[first]
            before, spans = (np.concatenate([[0], np.cumsum(x)])[bounds] for x in (gone, fresh))
            at = (bounds - before).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(raw[~gone])])
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(sizes), pa.array(np.diff(before)), pa.array(np.diff(spans)), kept], names=[ROW, "n_bytes", "n_removed", "n_spans", "kept"])

    done = marked.mapInArrow(tidy(cut), with_row(packed, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))
    return done.select(*unpack(keep, ["n_bytes", "n_removed", "n_spans", "kept"]))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, j, substr(h, 2 * j + 1, {2 * (256 + LENGTH - 1)}) AS p FROM d, LATERAL (SELECT unnest(range(0, length(h) // 2, 256)) AS j)),
places AS (SELECT doc_id, j, p, range(0, greatest(length(p) // 2 - {LENGTH - 1}, 0)) AS ks FROM blocks),
starts AS (SELECT doc_id, j + k AS k, s FROM (SELECT doc_id, j, unnest(ks) AS k, unnest(list_transform(ks, lambda k: substr(p, 2 * k + 1, {2 * LENGTH}))) AS s FROM places)),
firsts AS (SELECT s, min(doc_id) AS low FROM starts GROUP BY s),
gone AS (SELECT doc_id, k FROM starts JOIN firsts USING (s) WHERE low < doc_id),
islands AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM (
  SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM gone)),
spans AS (SELECT doc_id, min(k) AS a, max(k) + {LENGTH} AS b FROM islands GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, substr(h, 2 * before + 1, 2 * (a - before)) AS piece FROM (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans) JOIN d USING (doc_id)
),
totals AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last FROM spans GROUP BY doc_id),
heads AS (SELECT doc_id, string_agg(piece, '' ORDER BY a) AS head FROM pieces GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN totals USING (doc_id) LEFT JOIN heads USING (doc_id)
"""
