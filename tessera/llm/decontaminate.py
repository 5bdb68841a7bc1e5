"""Benchmark decontamination: an FM-index per shard of training text.

A shard is a run of whole documents of a few MB. Its words become numbers of the benchmark's
vocabulary; words, and neighbours, that no benchmark window has can not lie inside a
hit, so the shard's sequence keeps only the stretches between them. The index over that
sequence is a suffix array's Burrows-Wheeler transform in a wavelet matrix; all windows are
searched backwards at once through its ranks, occurrences are located by walking to sampled
suffix positions, and located spans are merged per document.

The benchmark is a stated query set. It is read in blocks of ``BLOCK_BYTES``, each sent as flat arrays;
a task takes its documents some MB at a time past one block after the other, so that it holds one block at once and
no document is moved. A text longer than a shard is read in pieces that share ``WINDOW`` - 1 words.

Words: A-Z lower-cased, runs of characters other than ``\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F``. A window
is WINDOW consecutive words of an item, or the whole of a shorter item. Null or wordless
texts have no hits, null or wordless items no windows; a null item_id counts as ''. Items that share a window,
or an item_id, all count. Repeated documents each keep a row; an empty table gives no rows, an empty benchmark no hits. Only
doc_id, text (and ``keep``) are read; a kept column that is called as a result gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ROW, bounded_batches, pack, rewritten, runs, shown, table, tidy, unpack, utf8, with_row

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Text of the benchmark that one pass holds.
BLOCK_BYTES = 4 << 20
#: Documents that pass by the blocks together, where there are several.
CHUNK_BYTES = 16 << 20
#: Windows that are searched together.
SEARCHED = 1 << 16
#: One suffix position in so many is stored.
SAMPLE = 8

_KEPT = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class WaveletMatrix:
    """Ranks and symbols of an integer sequence, many at once."""

    def __init__(self, seq: np.ndarray):
        self.bits = max(1, int(seq.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        begin = np.zeros_like(end)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = (symbol >> (self.bits - 1 - k)) & 1 == 1
            b, e = ones[begin], ones[end]
            begin, end = np.where(up, zeros + b, begin - b), np.where(up, zeros + e, end - e)
        return end - begin

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[at]
            bit = ones[at + 1] - before
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + before, at - before)
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling. Symbol 0 separates: each 0 is distinct, the earlier the smaller."""
    n = len(seq)
    parted = seq == 0
    rank = seq.astype(np.int64) + int(parted.sum())
    rank[parted] = np.arange(int(parted.sum()))
    step = 1
    key = rank
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if int(fresh.sum()) == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 2) + after
        step *= 2


class FMIndex:
    """Over a sequence of symbols above 0 whose stretches each end in 0."""

    def __init__(self, seq: np.ndarray):
        order = suffix_array(seq)
        self.n = len(seq)
        last = seq[order - 1].astype(np.int64)  # the first suffix wraps to the final 0
        self.tree = WaveletMatrix(last)
        self.size = int(seq.max(initial=0)) + 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=self.size))])
        stored = (order % SAMPLE == 0) | (last == 0)  # a stretch's first position is always stored
        self.marks = np.concatenate([[0], np.cumsum(stored)])
        self.positions = order[stored]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of patterns of one length, a row each; symbols beyond the index give none."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        known = (patterns < self.size).all(axis=1)
        high[~known] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = np.where(known, patterns[:, k], 0)
            low, high = self.smaller[c] + self.tree.rank(c, low), self.smaller[c] + self.tree.rank(c, high)
            high = np.where(known, high, low)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes, by stepping back to stored ones."""
        out = np.empty(len(rows), np.int64)
        left, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            stored = self.marks[rows + 1] > self.marks[rows]
            out[left[stored]] = self.positions[self.marks[rows[stored]]] + steps
            left, rows = left[~stored], rows[~stored]
            c = self.tree.symbol(rows)
            rows = self.smaller[c] + self.tree.rank(c, rows)
            steps += 1
        return out


class Windows:
    """The windows of one block of benchmark items, as places in the numbers of its words."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        numbers = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(raw)], np.int32) for _, raw in items]
        sizes = np.array([len(x) for x in numbers], np.int64)
        self.ids = np.concatenate([*numbers, np.empty(0, np.int32)])
        first = np.cumsum(sizes) - sizes
        #: By a window's length: where its words begin, and the item.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(sizes[sizes > 0], width)).tolist():
            own = np.nonzero((sizes == size) | ((sizes > width) & (size == width)))[0]
            each = sizes[own] - size + 1
            start = np.repeat(first[own], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            self.by_length[size] = start, np.repeat(own, each).astype(np.int32)
        self.base = len(self.vocabulary) + 1
        ends = np.cumsum(sizes)
        inner = np.ones(max(len(self.ids) - 1, 0), bool)
        inner[(ends[(ends > 0) & (ends < len(self.ids))] - 1)] = False
        wide = self.ids.astype(np.int64)
        self.pairs = np.unique((wide[:-1] * self.base + wide[1:])[inner])
        self.alone = np.zeros(self.base, bool)
        if 1 in self.by_length:
            self.alone[self.ids[self.by_length[1][0]]] = True

    def searched(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, words and item of all windows, some at a time."""
        for size, (start, item) in self.by_length.items():
            for k in range(0, len(start), SEARCHED):
                yield size, self.ids[start[k : k + SEARCHED, None] + np.arange(size)].astype(np.int64), item[k : k + SEARCHED]


def _stretches(ids: np.ndarray, doc: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The part of a shard that may hold a window, 0 after each stretch, and where its words were."""
    n = len(ids)
    near = np.nonzero((ids[:-1] > 0) & (ids[1:] > 0) & (doc[:-1] == doc[1:]))[0] if n > 1 else np.empty(0, np.int64)
    code = ids[near] * w.base + ids[near + 1]
    if len(w.pairs):
        near = near[w.pairs[np.minimum(np.searchsorted(w.pairs, code), len(w.pairs) - 1)] == code]
    else:
        near = near[:0]
    tied = np.zeros(n + 1, bool)  # word i belongs together with word i + 1
    tied[near] = True
    kept = w.alone[ids]
    kept[near] = True
    kept[near + 1] = True
    at = np.nonzero(kept)[0]
    if not len(at):
        return np.empty(0, np.int64), at
    ends = ~tied[at]
    stretch = np.cumsum(np.concatenate([[0], ends[:-1]]))
    long = np.bincount(stretch) >= min(w.by_length)
    at, ends = at[long[stretch]], ends[long[stretch]]
    if not len(at):
        return np.empty(0, np.int64), at
    where = np.arange(len(at)) + np.concatenate([[0], np.cumsum(ends[:-1])])
    seq = np.zeros(int(where[-1]) + 2, np.int64)
    seq[where] = ids[at]
    back = np.full(len(seq), -1, np.int64)
    back[where] = at
    return seq, back


def find_hits(texts: list[bytes], w: Windows) -> tuple[list[int], dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    """Word counts of a shard's texts; merged word spans and items of those that have hits."""
    words: list[bytes] = []
    sizes = []
    for raw in texts:
        own = words_of(raw)
        sizes.append(len(own))
        words += own
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    if not words or not w.by_length:
        return sizes, spans, items
    ids = np.fromiter(map(w.vocabulary.get, words, repeat(0)), np.int64, len(words))
    doc = np.repeat(np.arange(len(texts)), sizes)
    seq, back = _stretches(ids, doc, w)
    if not len(seq):
        return sizes, spans, items
    index = FMIndex(seq)
    starts, lengths = [], []
    for size, patterns, owner in w.searched():
        low, high = index.search(patterns)
        found = np.nonzero(high > low)[0]
        times = high[found] - low[found]
        rows = np.repeat(low[found], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        at = back[index.locate(rows)]
        starts.append(at)
        lengths.append(np.full(len(at), size))
        for d, item in np.unique(np.stack([doc[at], np.repeat(owner[found], times)], 1), axis=0).tolist():
            items.setdefault(d, set()).add(w.items[item])
    if starts:
        first = np.concatenate([[0], np.cumsum(sizes)])
        change = np.zeros(len(words) + 1, np.int64)
        begin = np.concatenate(starts)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + np.concatenate(lengths), -1)
        covered = np.cumsum(change[:-1]) > 0
        # A span ends with its document.
        edge = np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))
        for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0], strict=True):
            while a < b:
                d = int(doc[a])
                stop = min(int(b), int(first[d + 1]))
                spans.setdefault(d, []).append((int(a - first[d]), int(stop - first[d])))
                a = stop
    return sizes, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _whole(raw: bytes, w: Windows, width: int) -> tuple[int, list[tuple[int, int]], set[str]]:
    """``find_hits`` of one text of any length."""
    n, spans, items = 0, [], set()
    carry: list[bytes] = []
    a = 0
    while a < len(raw) or not a:
        b = min(a + SHARD_BYTES, len(raw))
        while b < len(raw) and _FOLD[raw[b]] != 32:
            b += 1
        sizes, new, named = find_hits([b" ".join([*carry, raw[a:b]])], w)
        shift = n - len(carry)
        spans += [(x + shift, y + shift) for x, y in new.get(0, [])]
        items |= named.get(0, set())
        n += sizes[0] - len(carry)
        carry = [*carry, *_last_words(raw[a:b], width - 1)][-(width - 1) :] if width > 1 else []
        a = max(b, 1)
    return n, _merged(spans), items


def _last_words(raw: bytes, n: int) -> list[bytes]:
    size = 1 << 12
    while size < len(raw):
        words = words_of(raw[-size:])
        if len(words) > n:  # the first may be cut
            return words[-n:] if n else []
        size *= 4
    return words_of(raw)[-n:] if n else []


def _byte_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where runs of words [a, b), in order, stand in a text."""
    out = []
    every = enumerate(_KEPT.finditer(raw.translate(_FOLD)))
    for a, b in spans:
        begin = end = 0
        for k, m in every:
            if k == a:
                begin = m.start()
            if k == b - 1:
                end = m.end()
                break
        out.append((begin, end))
    return out


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> list[Broadcast]:
    """The benchmark's windows, a block after the other: the driver, too, holds one at once."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = lambda k: items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
    return [benchmark.sparkSession.sparkContext.broadcast(Windows([(r["item"], r["text"].encode()) for r in part(k).toLocalIterator()], width)) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns with n_words, spans (merged runs of hit words, [a, b)) and items (sorted) of every document.

    ``keep`` may include text. Documents are not moved.
    """
    bounded_batches(docs.sparkSession)
    blocks = _blocks(benchmark, width, block_bytes)
    packed = docs.select(pack(keep), F.coalesce("text", F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK_BYTES if len(blocks) > 1 else 0):
            state = [([0] * b.num_rows, [[] for _ in range(b.num_rows)], [set() for _ in range(b.num_rows)]) for b in chunk]
            for w in shown(blocks):
                for batch, (sizes, spans, items) in zip(chunk, state, strict=True):
                    raw, bounds = utf8(batch.column("text"))
                    for i, j in runs(bounds, SHARD_BYTES):
                        if j == i + 1 and bounds[j] - bounds[i] > SHARD_BYTES:
                            n, more, named = _whole(raw[bounds[i] : bounds[j]].tobytes(), w, width)
                            ns, new, found = [n], {0: more}, {0: named}
                        else:
                            ns, new, found = find_hits([raw[bounds[k] : bounds[k + 1]].tobytes() for k in range(i, j)], w)
                        sizes[i:j] = ns
                        for k, more in new.items():
                            spans[i + k] = _merged(spans[i + k] + more)
                        for k, more in found.items():
                            items[i + k] |= more
            for batch, (sizes, spans, items) in zip(chunk, state, strict=True):
                rows = [[{"a": a, "b": b} for a, b in row] for row in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(ROW), pa.array(sizes, pa.int64()), pa.array(rows, _SPANS), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=[ROW, "n_words", "spans", "items"],
                )

    results = "n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"
    return packed.mapInArrow(tidy(scan), with_row(packed, results)).select(*unpack(keep, ["n_words", "spans", "items"]))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield held
            held = []
    if held:
        yield held


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, their columns as they were, without the hit words and what stands between
    those of one span. A document of which nothing but blanks is left is dropped; n_chars, if there, follows the text."""
    columns = docs.columns
    found = find_contamination(docs.select(pack(columns), "text"), benchmark, keep=[ROW, "text"])
    found = found.select(F.col(ROW), "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = batch.column("spans")
            for k in np.nonzero(pc.list_value_length(spans).to_numpy(zero_copy_only=False))[0].tolist():
                raw, at, parts = texts[k].encode(), 0, []
                for a, b in _byte_spans(raw, [(s["a"], s["b"]) for s in spans[k].as_py()]):
                    parts.append(raw[at:a])
                    at = b
                texts[k] = (b"".join(parts) + raw[at:]).decode()
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(texts, pa.string()), pc.greater(pc.list_value_length(spans), 0)], names=[ROW, "text", "cut"])

    left = found.mapInArrow(tidy(cut), with_row(found, "text string, cut boolean")).where(~F.col("cut") | (F.trim("text") != ""))
    return left.select(*rewritten(docs, F.col("text"), F.col("cut")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS_SQL} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS win, least(len(w), {WINDOW}) AS m
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i) WHERE len(w) > 0
),
lens AS (SELECT DISTINCT m FROM wins),
hits AS (
  SELECT DISTINCT doc_id, i, x.m, item FROM (
    SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
    FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i) WHERE len(w) >= m
  ) x JOIN wins ON wins.win = x.win AND wins.m = x.m
),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
