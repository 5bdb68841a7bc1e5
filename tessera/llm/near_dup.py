"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures.

A document's set of word shingles gets a signature of ``SYMBOLS`` MinHash symbols of 16 bits.
The signature is split into chunks of four symbols; by the pigeonhole principle two signatures
that differ in at most ``MAX_DISTANCE`` = 2 x chunks - 1 symbols have a chunk with at most one
error, so each chunk is posted four times, once with each symbol left out. Pairs under the
distance threshold thus always share a posting. (At a similarity of 0.8 a pair lies over it
about twice in 100,000.) Every link is confirmed on the full shingle sets.

Documents of equal sets form a class that takes part once, whatever their ids. A posting list is
never paired with itself: each member is first compared with the list's smallest, confirmed links are
joined into components, and only members outside a list's largest component are
then compared with the rest of it, by signatures and larger sketches. Lists in which that is much work
are dealt out anew by two symbols of another chunk, which loses no pair: of at most
``MAX_DISTANCE`` errors, one of the other chunks has two at most. A pair that is left out
is linked already or out of reach, so no component is lost (sketches: but for five deviations).

Words are compared as 64-bit hashes chained over all their bytes; a link between different sets of up to ``EXACT_WORDS``
words is confirmed on the words themselves, and the class of a set of few shingles is a digest of its words.

Components come from distributed min-label propagation with pointer jumping; rows that repeat a doc_id
are one node, with all their texts. Null, empty and blank texts have an empty set and are linked with nothing. Rows
without a doc_id keep a row, linked only by an equal set. Very long texts are hashed in pieces, as a
whole. An empty table gives no rows. Only doc_id and text (and ``keep``) are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import FILE_ROWS, bounded_batches, held, runs, scratch, sent, settled, table, tidy, utf8

SYMBOLS, CHUNK = 40, 4
MAX_DISTANCE = 2 * (SYMBOLS // CHUNK) - 1
RUN_BYTES = 1 << 18
#: Hash ranges of the sketch that pairs of a list are sifted by.
BINS = 512
#: Members of a posting list that are compared in one block.
BLOCK = 512
#: Comparisons from which a list is dealt out anew by two symbols of another chunk.
LONG_LIST = 1 << 22
#: Sets of as many shingles at most are put in classes by their words, not by hashes of them.
FEW = 16
#: Texts of up to so many words are confirmed word by word, longer ones by the 64-bit hashes of their shingles.
EXACT_WORDS = 200_000
#: A class that holds one row in so many is joined by broadcast, as there can only be as many such classes.
HOT_SHARE = 1000

_RNG = np.random.default_rng(7)
_MULT = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """The 16-bit MinHash symbols of a shingle set that is not empty."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 4096):
        least = np.minimum(least, (items[i : i + 4096, None] * _MULT + _ADD).min(axis=0))
    return (shingles.mix(least) >> np.uint64(48)).astype(np.uint16)


def postings(sig: np.ndarray) -> np.ndarray:
    """Keys of a signature: chunk, symbol left out and the other three symbols, 54 bits."""
    wide = sig.astype(np.int64).reshape(-1, CHUNK)
    chunk = np.arange(len(wide), dtype=np.int64)
    keys = []
    for out in range(CHUNK):
        key = chunk * CHUNK + out
        for k in range(CHUNK):
            if k != out:
                key = key << 16 | wide[:, k]
        keys.append(key)
    return np.concatenate(keys)


def sketch(items: np.ndarray) -> np.ndarray:
    """The least shingle of each of ``BINS`` hash ranges, as a byte; 0 for an empty range."""
    out = np.zeros(BINS, np.uint8)
    place = (items >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(items), bool)
    first[1:] = place[1:] != place[:-1]
    out[place[first]] = (shingles.mix(items[first]) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    return out


def _may_link(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sketches allow a similarity of 0.8: their share of equal bins is not five deviations under it.

    Bins sample the union without replacement, so the deviation shrinks as they come to hold all of it.
    """
    used = np.maximum(((x > 0) | (y > 0)).sum(axis=1), 1)
    equal = ((x == y) & (x > 0)).sum(axis=1)
    unseen = np.clip(1 - used / (sizes / 1.8), 0.02, 1.0)
    return equal / used >= 0.8 - 5 * np.sqrt(0.16 * unseen / used) - 1 / used


def _sets(raw: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    for i, j in runs(bounds, RUN_BYTES):
        hashes, first = shingles.words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        yield from shingles.shingle_sets(hashes, first, width)


def exact_set(raw: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text as words; bytes are split and folded at ASCII characters only."""
    words = raw.lower().split()
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)} if words else set()


def _digest(items: np.ndarray, raw: np.ndarray, width: int) -> bytes | None:
    if len(items) > FEW:
        return hashlib.blake2b(items.tobytes(), digest_size=16).digest()
    few = sorted(b" ".join(x) for x in exact_set(raw.tobytes(), width))
    return hashlib.blake2b(b"\n".join(few), digest_size=16, person=b"few").digest() if few else None


def signatures(docs: DataFrame, width: int, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, doc_id, n_shingles, digest of the set, sig and sketch (null for empty sets) of every row."""
    bounded_batches(docs.sparkSession)
    keep = keep or []

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sigs, sketches = [], [], [], []
            raw, bounds = utf8(batch.column("text"))
            for k, items in enumerate(_sets(raw, bounds, width)):
                sizes.append(len(items))
                digests.append(_digest(items, raw[bounds[k] : bounds[k + 1]], width))
                sigs.append(signature(items).tobytes() if len(items) else None)
                sketches.append(sketch(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, sigs, sketches))],
                names=[*keep, "doc_id", "n_shingles", "digest", "sig", "sketch"],
            )

    kept = "".join(f"`{n}` {t}, " for n, t in docs.select(*keep).dtypes)
    return docs.select(*keep, "doc_id", "text").mapInArrow(tidy(sign), kept + "doc_id bigint, n_shingles bigint, digest binary, sig binary, sketch binary")


def _posted(signed: DataFrame) -> DataFrame:
    """key, node: the postings of every class."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [postings(np.frombuffer(x, np.uint16)) for x in batch.column("sig").to_pylist()]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column("node").to_numpy(), SYMBOLS))], names=["key", "node"])

    return signed.select("node", "sig").mapInArrow(post, "key bigint, node bigint")


def _close(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs a, b whose signatures and set sizes allow a link."""
    side = lambda c: signed.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(utf8(batch.column(c))[0].tobytes(), np.uint16).reshape(-1, SYMBOLS) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= MAX_DISTANCE))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where("100 * least(n_a, n_b) >= 80 * greatest(n_a, n_b)")
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(near), "a bigint, b bigint")


def _texts(nodes: DataFrame, docs: DataFrame, signed: DataFrame, width: int) -> DataFrame:
    """node, text: a text of each class, told from others of the same doc_id by its digest."""
    wanted = signed.select("node", "rep", "digest").join(nodes, "node", "left_semi")
    found = docs.select(F.col("doc_id").alias("rep"), "text").join(sent(scratch(wanted, "wanted")), "rep")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            wanted = batch.column("digest").to_pylist()
            same = [_digest(items, raw[bounds[k] : bounds[k + 1]], width) == wanted[k] for k, items in enumerate(_sets(raw, bounds, width))]
            yield batch.select(["node", "text"]).filter(pa.array(same, pa.bool_()))

    # Rows may repeat a doc_id and its text.
    return found.select("node", "digest", "text").mapInArrow(tidy(own), "node bigint, text string").groupBy("node").agg(F.first("text").alias("text"))


def _confirmed(pairs: DataFrame, docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs a, b whose full sets are similar enough."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, signed, width)
    texts = scratch(texts, "texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))

    def shingled(raw: np.ndarray) -> tuple[set | None, np.ndarray | None]:
        text = raw.tobytes()
        if text.count(b" ") + text.count(b"\n") <= EXACT_WORDS:
            return exact_set(text, width), None
        return None, next(_sets(raw, np.array([0, len(raw)]), width))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_a, at_a = utf8(batch.column("text_a"))
            raw_b, at_b = utf8(batch.column("text_b"))
            linked, last, hub = [], None, (None, None)
            for row, b in enumerate(batch.column("b").to_pylist()):
                x, y = raw_a[at_a[row] : at_a[row + 1]], raw_b[at_b[row] : at_b[row + 1]]
                if b != last:  # rows of one hub lie together
                    last, hub = b, shingled(y)
                own = shingled(x)
                if own[0] is not None and hub[0] is not None:
                    sizes, common = len(own[0]) + len(hub[0]), len(own[0] & hub[0])
                else:
                    p, q = (s if s is not None else next(_sets(r, np.array([0, len(r)]), width)) for s, r in ((own[1], x), (hub[1], y)))
                    sizes, common = len(p) + len(q), len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * common >= percent * (sizes - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(tidy(check), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node that has an edge a, b.

    Every round takes the least label of the neighbours and then that label's own label, so
    the rounds grow with the logarithm of a component's width.
    """
    files = max(1, -(-2 * edges.count() // FILE_ROWS))
    cut = lambda df, name: scratch(df.coalesce(files), name)
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "labels")
    while True:
        told = both.join(labels.toDF("other", "told"), "other").groupBy("node").agg(F.min("told").alias("told"))
        heard = labels.join(told, "node").select("node", F.col("comp").alias("old"), F.least("comp", "told").alias("comp"))
        jump = heard.join(labels.toDF("comp", "root"), "comp").select("node", F.least("comp", "root").alias("comp"), "old")
        state = cut(jump, "labels")
        labels = state.select("node", "comp")
        if state.where("comp <> old").isEmpty():
            return labels


def _open(rows: DataFrame) -> DataFrame:
    """Lists of which members are not in one component: key, largest component, members and how many are outside it."""
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    lists = sizes.groupBy("key").agg(F.max_by("comp", "n").alias("largest"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("members"), F.max("n").alias("most"))
    # A list of two was compared in the first round; one component needs nothing more.
    return lists.where("k > 1 AND members > 2").select("key", "largest", "members", (F.col("members") - F.col("most")).alias("outside"))


def _dealt_anew(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """key, place, node, comp: the members of long lists, in a list for every two symbols of each other chunk."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = SYMBOLS // CHUNK
        pairs = [(i, j) for i in range(CHUNK) for j in range(i)]
        for batch in batches:
            sig = np.frombuffer(utf8(batch.column("sig"))[0].tobytes(), np.uint16).reshape(-1, chunks, CHUNK).astype(np.uint64)
            place = batch.column("place").to_numpy()
            rows = np.arange(len(place))
            own = shingles.mix(batch.column("key").to_numpy().view(np.uint64))
            for c in range(chunks):
                at = rows[place // CHUNK != c]
                for k, (i, j) in enumerate(pairs):
                    two = (sig[at, c, i] << np.uint64(16) | sig[at, c, j]) + np.uint64((c * len(pairs) + k) << 32)
                    key = shingles.mix(own[at] + shingles.mix(two + np.uint64(1))).view(np.int64)
                    part = batch.select(["place", "node", "comp"]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns], names=["key", "place", "node", "comp"])

    kept = rows.join(signed.select("node", "sig"), "node").select("key", "place", "node", "comp", "sig")
    return kept.mapInArrow(tidy(deal), "key bigint, place int, node bigint, comp bigint")


def _rest(listed: DataFrame, labels: DataFrame, signed: DataFrame, long_list: int, shelf: list[DataFrame]) -> DataFrame:
    """Pairs a < b of different components that share a posting list, by signature."""
    place = F.shiftright("key", 16 * (CHUNK - 1)).cast("int").alias("place")
    rows = listed.join(labels.toDF("node", "comp"), "node", "left").select("key", place, "node", F.coalesce("comp", "node").alias("comp"))
    open_ = held(_open(rows), shelf)
    long = open_.where(F.col("outside") * F.col("members") > long_list)
    if not long.isEmpty():
        anew = _dealt_anew(rows.join(long.select("key"), "key", "left_semi"), signed)
        short = open_.where(F.col("outside") * F.col("members") <= long_list)
        rows = held(rows.join(short.select("key"), "key", "left_semi").unionByName(anew), shelf)
        open_ = _open(rows)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")
    rows = rows.join(open_.select("key", "largest", blocks), "key").join(signed.select("node", "sig", "sketch", "n_shingles"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    outside = F.col("comp") != F.col("largest")
    columns = ["place", "node", "comp", "sig", "sketch", "n_shingles"]
    members = rows.select("key", own.alias("block"), F.lit(False).alias("asks"), *columns)
    asking = rows.where(outside).select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), *columns)
    dealt = members.unionByName(asking).repartition("key", "block").sortWithinPartitions("key", "block", F.desc("asks"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[pa.RecordBatch] = []
        last = None

        def done(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(group).combine_chunks()
            asks, node, comp, n, place = (t.column(c).to_numpy() for c in ("asks", "node", "comp", "n_shingles", "place"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            members = np.nonzero(~asks.astype(bool))[0]
            low, high = [], []
            for q in np.nonzero(asks)[0]:
                m = members[(comp[members] != comp[q]) & (100 * np.minimum(n[members], n[q]) >= 80 * np.maximum(n[members], n[q]))]
                same = sig[m] == sig[q]
                near = same.sum(axis=1) >= SYMBOLS - MAX_DISTANCE
                m, same = m[near], same[near]
                if not len(m):
                    continue
                same = same.reshape(-1, SYMBOLS // CHUNK, CHUNK)
                # Of the lists that a pair shares, only the first compares it.
                others = same.sum(axis=2, keepdims=True) - same
                m = m[(others == CHUNK - 1).reshape(len(m), -1).argmax(axis=1) == place[q]]
                m = m[_may_link(sketches[m], sketches[q], n[m] + n[q])]
                low.append(np.minimum(node[m], node[q]))
                high.append(np.maximum(node[m], node[q]))
            if low:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], names=["b", "a"])

        for batch in batches:
            key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
            cuts = [0, *(np.nonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]))[0] + 1), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if last is not None and last != (key[i], block[i]):
                    yield from done(group)
                    group = []
                last = key[i], block[i]
                group.append(batch.slice(i, j - i))
        if group:
            yield from done(group)

    return dealt.mapInArrow(tidy(compare), "b bigint, a bigint").select("a", "b").distinct()


def _same_ids(every: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs a, b of classes that hold different texts of one doc_id."""
    ids = every.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    several = ids.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
    held_by = ids.join(several, "doc_id").select("doc_id", "digest").distinct().join(signed.select("digest", "node"), "digest")
    hubs = held_by.groupBy("doc_id").agg(F.min("node").alias("b"))
    return held_by.join(hubs, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, keep: list[str] | None = None, long_list: int = LONG_LIST) -> DataFrame:
    """``keep`` columns, doc_id, n_shingles, component_id and kept (the smallest doc_id of its component) of every row.

    Sets of ``width``-word shingles with 100 x intersection >= ``percent`` x union are linked.
    ``percent`` is 80 or more; the signature threshold is set for that. ``keep`` columns may not be
    named as one of the operator's.
    """
    if percent < 80:
        raise ValueError("the signature threshold holds for a similarity of 0.8 or more")
    keep = keep or []
    docs = docs.select(*keep, F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shelf: list[DataFrame] = []
    every = held(signatures(docs, width, keep), shelf)
    # A class meets in one row by way of partial sums.
    classes = every.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "sketch"))
    )
    signed = scratch(classes, "classes")
    # A class is the node of its smallest doc_id. Where that is not enough, as a doc_id has several texts, nodes are
    # numbers in the order of doc_ids, written down. A list's smallest is then often what the others were made from.
    if signed.where("rep IS NOT NULL").groupBy("rep").count().where("count > 1").isEmpty():
        signed = signed.withColumn("node", F.col("rep"))
    else:
        signed = scratch(signed.orderBy("rep", "digest").withColumn("node", F.monotonically_increasing_id()), "nodes")
    posted = _posted(signed.where("rep IS NOT NULL"))
    hubs = posted.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    listed = held(posted.join(hubs, "key"), shelf)
    stars = listed.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    tried = settled(_close(stars, signed), "tried")
    first = settled(_confirmed(tried, docs, signed, width, percent), "links")
    labels = components(first)
    rest = settled(_rest(listed.select("key", "node"), labels, signed, long_list, shelf).join(tried, ["a", "b"], "left_anti"), "rest")
    second = _confirmed(rest, docs, signed, width, percent)
    links = settled(first.unionByName(second).unionByName(_same_ids(every, signed)), "links")
    found = components(links)
    # The smallest doc_id of every component; a class that is linked with none keeps its own.
    linked = signed.select("node", "rep").join(found, "node")
    least = linked.groupBy("comp").agg(F.min("rep").alias("least"))
    of_class = linked.join(least, "comp").select("node", F.col("least").alias("component_id"))
    named = signed.select("digest", "rep", "rows", "node").join(of_class, "node", "left").select("digest", "rows", F.coalesce("component_id", "rep").alias("component_id"))
    named = scratch(named, "named")
    total = every.count()
    hot = named.where(F.col("rows") * HOT_SHARE > total).drop("rows")
    rows = every.select(*keep, "doc_id", "n_shingles", "digest")
    out = rows.where("digest IS NULL").withColumn("component_id", F.col("doc_id"))
    out = out.unionByName(rows.join(F.broadcast(hot), "digest"))
    cold = rows.where("digest IS NOT NULL").join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    out = out.unionByName(cold.join(named.where(F.col("rows") * HOT_SHARE <= total).drop("rows"), "digest"))
    component = F.coalesce("component_id", "doc_id")
    done = scratch(out.select(*keep, "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")), "near")
    for kept in shelf:
        kept.unpersist()
    return done


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, y AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
least_of AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""
