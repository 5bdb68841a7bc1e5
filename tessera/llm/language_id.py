"""Language ID: interpolated Kneser-Ney character trigram models, one per language.

Texts are folded to lower-case letters; whatever is no letter is one symbol, and runs of it count once.
Trigrams of whole code points are counted over all training documents: each task adds up what it
reads and Spark sums the tasks, so the tables grow with what the corpus holds. The orders below
count the distinct continuations, with discounts estimated from each order's counts of one and two. All
probabilities and back-off shares of all languages stand in one array, sorted by a 64-bit hash of language, order and
n-gram, and are looked up there; a table of over ``SHARD_ENTRIES`` is several arrays, of which a worker holds one at once.

A document takes the language of least cross-entropy per symbol (ties: the first by name). One training document in
``HELD_BACK`` is not counted; how far such documents lie from their own language's model, by size, sets
the cutoff above which a prediction is flagged ``rejected``.

Null texts and texts without a letter are ``und`` with score 0. Without training rows every document is ``und``;
an empty table gives no rows. Whole texts are read, however long. Repeated rows each get a result; only text (and
``keep``) is read, and a kept column that is called as a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import ROW, bounded_batches, code_points, letters, pack, runs, scratch, shown, table, tidy, unpack, utf8, with_row

#: Discount of an order whose counts of one and two give none.
DISCOUNT = 0.75
RUN_BYTES = 1 << 19
#: Entries (12 bytes each) of one sorted array.
SHARD_ENTRIES = 2_000_000
#: Distinct trigrams that a counting task holds before it hands them on.
HELD_GRAMS = 1_000_000
#: One training document in so many sets the rejection cutoffs, at this quantile.
HELD_BACK = 10
QUANTILE = 0.999
#: Held-back documents of a size from which their own quantile is taken, not the language's.
ENOUGH = 50
_BITS = 21
_POINT = (1 << _BITS) - 1
TRIGRAM, TRIGRAM_SHARE, BIGRAM, BIGRAM_SHARE, UNIGRAM, UNSEEN = range(6)


def _codes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of consecutive texts, the row of each, and the rows that have a letter.

    A text's symbols stand between two 0, and a trigram ends in each of them but the first 0.
    """
    n = len(bounds) - 1
    points, row = code_points(raw, bounds)  # a line feed, no letter, ends every text
    symbols = letters()[np.minimum(points, 0x10FFFF)]
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (row[1:] != row[:-1])
    seq, row = symbols[keep].astype(np.uint64), row[keep]
    first = np.concatenate([[True], row[1:] != row[:-1]])
    has = np.zeros(n, bool)
    has[row[seq != 0]] = True
    mid = np.concatenate([[np.uint64(0)], seq[:-1]])
    left = np.concatenate([np.zeros(2, np.uint64), seq[:-2]])[: len(seq)]
    second = np.concatenate([[False], first[:-1]])
    mid[first] = 0
    left[first | second] = 0
    code = (left << np.uint64(2 * _BITS)) | (mid << np.uint64(_BITS)) | seq
    use = ~(first & (seq == 0))  # blanks in front are the edge itself
    return code[use], row[use], has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    none = np.empty(0, np.uint64), np.empty(0, np.int64)

    def given() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        raw, bounds = utf8(batch.column("text"))
        for i, j in runs(bounds, RUN_BYTES):
            code, row, _ = _codes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            names = sorted(set(langs[i:j]))
            which = np.array([names.index(x) for x in langs[i:j]])[row]
            for k, lang in enumerate(names):
                new, times = np.unique(code[which == k], return_counts=True)
                codes, counts = held.get(lang, none)
                every, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
                held[lang] = every, np.bincount(at, weights=np.concatenate([counts, times]), minlength=len(every)).astype(np.int64)
            if sum(len(codes) for codes, _ in held.values()) > HELD_GRAMS:
                yield from given()
    yield from given()


def gram_counts(training: DataFrame) -> DataFrame:
    """lang, gram, n over every training document (columns lang, text; both not null)."""
    bounded_batches(training.sparkSession)
    counted = training.select("lang", "text").mapInArrow(tidy(_count), "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame, n: str, name: str) -> DataFrame:
    """lang and the absolute discount of an order, from how many n-grams were seen once and twice."""
    one, two = F.count_if(F.col(n) == 1), F.count_if(F.col(n) == 2)
    return counts.groupBy("lang").agg(F.when((one > 0) & (two > 0), one / (one + 2 * two)).otherwise(F.lit(DISCOUNT)).alias(name))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, kind, gram, log: the log probabilities and back-off shares of every order. ``counts`` is read several times."""
    last, low = F.lit((1 << 2 * _BITS) - 1), F.lit(_POINT)
    bigrams = counts.groupBy("lang", F.col("gram").bitwiseAND(last).alias("pair")).agg(F.count(F.lit(1)).alias("f2"))
    single = bigrams.groupBy("lang", F.col("pair").bitwiseAND(low).alias("symbol")).agg(F.count(F.lit(1)).alias("f1"))
    alphabet = single.agg(F.countDistinct("symbol").alias("size")).first()["size"] + 1
    each = single.groupBy("lang").agg(F.sum("f1").alias("t1"), F.count(F.lit(1)).alias("k1"))
    for part, n, name in ((counts, "n", "d3"), (bigrams, "f2", "d2"), (single, "f1", "d1")):
        each = each.join(_discounts(part, n, name), "lang")
    each = F.broadcast(scratch(each, "languages").withColumn("floor", F.col("d1") * F.col("k1") / F.col("t1") / alphabet))  # a row a language
    of_single = single.join(each, "lang").select("lang", "symbol", (F.greatest(F.col("f1") - F.col("d1"), F.lit(0.0)) / F.col("t1") + F.col("floor")).alias("p1"))
    before = F.shiftright("pair", _BITS)
    of_mid = bigrams.groupBy("lang", before.alias("mid")).agg(F.sum("f2").alias("t2"), F.count(F.lit(1)).alias("k2"))
    of_mid = of_mid.join(each, "lang").select("lang", "mid", "t2", (F.col("d2") * F.col("k2") / F.col("t2")).alias("share2"))
    of_pair = bigrams.withColumn("mid", before).withColumn("symbol", F.col("pair").bitwiseAND(low)).join(of_mid, ["lang", "mid"]).join(of_single, ["lang", "symbol"]).join(each, "lang")
    of_pair = of_pair.select("lang", "pair", (F.greatest(F.col("f2") - F.col("d2"), F.lit(0.0)) / F.col("t2") + F.col("share2") * F.col("p1")).alias("p2"))
    context = F.shiftright("gram", _BITS)
    of_context = counts.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("t3"), F.count(F.lit(1)).alias("k3"))
    of_context = of_context.join(each, "lang").select("lang", "context", "t3", (F.col("d3") * F.col("k3") / F.col("t3")).alias("share3"))
    whole = counts.withColumn("context", context).withColumn("pair", F.col("gram").bitwiseAND(last)).join(of_context, ["lang", "context"]).join(of_pair, ["lang", "pair"]).join(each, "lang")
    of_gram = whole.select("lang", "gram", (F.greatest(F.col("n") - F.col("d3"), F.lit(0.0)) / F.col("t3") + F.col("share3") * F.col("p2")).alias("p3"))
    parts = [(TRIGRAM, of_gram, "gram", "p3"), (TRIGRAM_SHARE, of_context, "context", "share3"), (BIGRAM, of_pair, "pair", "p2"), (BIGRAM_SHARE, of_mid, "mid", "share2"), (UNIGRAM, of_single, "symbol", "p1"), (UNSEEN, each.withColumn("none", F.lit(0)), "none", "floor")]
    rows = [df.select("lang", F.lit(kind).alias("kind"), F.col(gram).cast("bigint").alias("gram"), F.log(p).alias("log")) for kind, df, gram, p in parts]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _hash(kind: int | np.ndarray, lang: int | np.ndarray, gram: np.ndarray) -> np.ndarray:
    tag = np.atleast_1d(lang).astype(np.uint64) * np.uint64(8) + np.atleast_1d(kind).astype(np.uint64)
    return shingles.mix(gram.astype(np.uint64) ^ shingles.mix(tag + np.uint64(1)))


class Models:
    """The languages, their tables as arrays sorted by hash, and the rejection cutoffs."""

    def __init__(self, langs: list[str], shards: list[Broadcast]):
        self.langs, self.shards = langs, shards
        self.cutoffs: dict[tuple[str, int], float] = {}  # by language and size class, -1 for all

    def find(self, kind: int, lang: int, grams: np.ndarray) -> np.ndarray:
        """The logs of n-grams, nan where there is none."""
        wanted = _hash(kind, lang, grams)
        out = np.full(len(grams), np.nan, np.float32)
        for hashes, logs in shown(self.shards):
            if len(hashes) and len(wanted):
                at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
                hit = hashes[at] == wanted
                out[hit] = logs[at[hit]]
        return out

    def logs(self, lang: int, grams: np.ndarray) -> np.ndarray:
        """Log probability of each trigram: its own entry, or what the lower orders leave it."""
        out = self.find(TRIGRAM, lang, grams).astype(np.float64)
        miss = np.nonzero(np.isnan(out))[0]
        pair, context = grams[miss] & np.uint64((1 << 2 * _BITS) - 1), grams[miss] >> np.uint64(_BITS)
        backed = self.find(BIGRAM, lang, pair).astype(np.float64)
        none = np.nonzero(np.isnan(backed))[0]
        single = self.find(UNIGRAM, lang, pair[none] & np.uint64(_POINT))
        floor = self.find(UNSEEN, lang, np.zeros(1, np.uint64))[0]
        backed[none] = np.where(np.isnan(single), floor, single) + np.nan_to_num(self.find(BIGRAM_SHARE, lang, pair[none] >> np.uint64(_BITS)))
        out[miss] = backed + np.nan_to_num(self.find(TRIGRAM_SHARE, lang, context))
        return out

    def cutoff(self, lang: str, size: int) -> float:
        return self.cutoffs.get((lang, size), self.cutoffs.get((lang, -1), np.inf))


def _size_class(size: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(size, 1)).astype(np.int64) // 2


def _fold(docs: DataFrame) -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(HELD_BACK)) == 0


def fit(training: DataFrame, shard_entries: int = SHARD_ENTRIES) -> Models:
    """``training``: lang, text, both not null. The tables come to the driver one sorted array at a time."""
    spark = training.sparkSession
    training = training.select("lang", "text")
    counts = scratch(gram_counts(training.where(~_fold(training))), "grams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return Models([], [])
    places = F.create_map(*[x for k, lang in enumerate(langs) for x in (F.lit(lang), F.lit(k))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _hash(*(b.column(c).to_numpy() for c in ("kind", "place", "gram")))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("log").cast(pa.float32())], names=["h", "log"])

    entries = scratch(kneser_ney(counts).select("kind", F.element_at(places, F.col("lang")).alias("place"), "gram", "log").mapInArrow(hashed, "h bigint, log float"), "entries")
    n = max(1, -(-entries.count() // shard_entries))
    shards = []
    for k in range(n):
        part = (entries.where(F.pmod("h", F.lit(n)) == k) if n > 1 else entries).toArrow()
        h, logs = part.column("h").to_numpy().view(np.uint64), part.column("log").to_numpy()
        order = np.argsort(h)
        shards.append(spark.sparkContext.broadcast((h[order], logs[order])))
    models = Models(langs, shards)
    told = identify(training.where(_fold(training)), models, keep=["lang"]).where("lang_pred = lang")
    by = told.groupBy("lang_pred", "size").agg(F.percentile_approx("cross_entropy", QUANTILE, 10_000).alias("most"), F.count(F.lit(1)).alias("n"))
    every = told.groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", QUANTILE, 10_000).alias("most"))
    models.cutoffs = {(r["lang_pred"], r["size"]): r["most"] for r in by.where(F.col("n") >= ENOUGH).collect()} | {(r["lang_pred"], -1): r["most"] for r in every.collect()}
    return models


def identify(docs: DataFrame, models: Models, *, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred, score (posterior of the prediction), cross_entropy, size (class) and rejected."""
    bounded_batches(docs.sparkSession)
    results = ["lang_pred", "score", "cross_entropy", "size", "rejected"]
    inner = [f"_{n}" for n in results]
    packed = docs.select(pack(keep), "text")
    shared = docs.sparkSession.sparkContext.broadcast(models.cutoffs)
    langs, shards = models.langs, models.shards

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Models(langs, shards)
        m.cutoffs = shared.value
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            n = batch.num_rows
            pred, prob, entropy, sizes, rejected = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, bool)
            for i, j in runs(bounds, RUN_BYTES) if m.langs else ():
                code, row, has = _codes(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                distinct, at = np.unique(code, return_inverse=True)
                size = np.bincount(row, minlength=j - i)
                sums = np.stack([np.bincount(row, weights=m.logs(k, distinct)[at], minlength=j - i) for k in range(len(m.langs))], axis=1)
                best = sums.argmax(axis=1)
                # Letters are not independent, so the evidence is tempered before it is normalised.
                odds = np.exp((sums - sums.max(axis=1, keepdims=True)) * 0.25).sum(axis=1)
                cross = -sums.max(axis=1) / np.maximum(size, 1)
                classes = _size_class(size)
                for r in np.nonzero(has)[0].tolist():
                    lang = m.langs[best[r]]
                    pred[i + r], prob[i + r], entropy[i + r], sizes[i + r] = lang, 1 / odds[r], cross[r], classes[r]
                    rejected[i + r] = cross[r] > m.cutoff(lang, int(classes[r]))
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(pred, pa.string()), pa.array(prob), pa.array(entropy, from_pandas=True), pa.array(sizes), pa.array(rejected)], names=[ROW, *inner])

    done = packed.mapInArrow(tidy(score), with_row(packed, "_lang_pred string, _score double, _cross_entropy double, _size bigint, _rejected boolean"))
    return done.withColumnsRenamed(dict(zip(inner, results, strict=True))).select(*unpack(keep, results))


def fold(doc_id: Column, k: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    models = fit(docs.where(~held_out).where("text IS NOT NULL AND lang IS NOT NULL"))
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), models, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
