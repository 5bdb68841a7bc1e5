"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A document's own evidence is a naive Bayes log-likelihood ratio over binned text statistics,
counted from every labelled document. One of them is what its words say: the mean log ratio of the
rates at which good and bad documents hold them, learnt as hashed words from at most ``TRAIN_ROWS`` labelled
documents of either class, those of least hash (a documented bound); such a document is left out of its own rates.

Its site gives the prior: host posteriors shrink towards the global rate, path posteriors towards their
host's, each by a strength estimated from how much the sites differ (method of moments). Site rates are
grouped aggregates over all documents, of their labels where there are any and of the classifier's soft
verdicts elsewhere; a document's own vote is taken out of its site before it is judged. Log odds of the two levels add
up to the score. Evidence is held within +-``CLAMP``, strengths between 2 and 10,000 and priors between 0.001
and 0.999, so that no single figure decides alone.

Texts are read once; what is joined and aggregated are rows of a few numbers. In ``documents`` the host is
``source`` and the path below it ``lang``; null ones form a site of their own. Null and empty texts have the statistics
of an empty text, very long ones are measured as a whole. Without labels the evidence is 0 and every document keeps the
prior; an empty table gives no rows. Repeated rows each get a result, repeated labels of a document count as the worst. Only
the named columns are read; a kept one that is called as a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import ROW, bounded_batches, pack, runs, scratch, table, tidy, unpack, utf8, with_row

RUN_BYTES = 1 << 18
BINS = 12
STATISTICS = ("symbols", "capitals", "repeats", "variety", "word_size", "shouts", "words")
#: Characters and words that damp the shares of short texts.
SHORT_CHARS, SHORT_WORDS = 60, 10
#: Hash bits of a word, and labelled documents of either class from which words are learnt, at most.
WORD_BITS = 18
TRAIN_ROWS = 10_000
#: Posterior probability of good quality that a kept document has at least.
THRESHOLD = 0.2
#: Evidence of one document is held within these log odds, so that no statistic outvotes all others.
CLAMP = 12.0
#: Sites (host and path pairs) up to which their table is broadcast; beyond it is joined by key.
BROADCAST_SITES = 50_000

_KINDS = np.zeros(256, np.uint8)
_KINDS[[ord(c) for c in "#*$%&|<>{}[]=_~^\\"]] = 1
_KINDS[65:91] = 2
_KINDS[[ord(c) for c in "!?"]] = 3
_KINDS[[9, 10, 11, 12, 13, 32]] = 4


def _bin(share: np.ndarray) -> np.ndarray:
    """Shares 0 to 1 on a scale that is finer near 0."""
    return np.minimum((np.sqrt(np.clip(share, 0, 1)) * BINS).astype(np.int64), BINS - 1)


def _words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words a text and how many of them repeat the one before; distinct (text, word bucket) pairs."""
    n = len(bounds) - 1
    hashes, first = shingles.words(raw, bounds)
    sizes = np.diff(first)
    owner = np.repeat(np.arange(n), sizes)
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])])[: len(hashes)]
    again = np.bincount(owner, weights=same, minlength=n)
    # 40 bits tell the words of a few texts apart; the lowest are the bucket.
    pair = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (hashes & np.uint64((1 << 40) - 1)))
    return sizes, again, (pair >> np.uint64(40)).astype(np.int64), (pair & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)


class WordModel:
    """Log ratios of the rates at which good and bad documents hold a word's bucket."""

    def __init__(self, held: np.ndarray, rows: np.ndarray, ids: np.ndarray, classes: np.ndarray):
        self.held, self.rows = held, rows  # by class
        order = np.argsort(ids, kind="stable")
        self.ids, self.classes = ids[order], classes[order]

    def ratios(self, without: int | None) -> np.ndarray:
        """For a document of class ``without`` that was counted itself."""
        rates = []
        for k in (0, 1):
            own = int(without == k)
            rates.append((np.maximum(self.held[k] - own, 0) + 0.5) / (max(self.rows[k] - own, 0) + 1))
        return np.log(rates[1]) - np.log(rates[0])

    def known(self, ids: np.ndarray) -> np.ndarray:
        """The class of documents that were counted, -1 for others."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, self.classes[at], -1)


def statistics(raw: np.ndarray, bounds: np.ndarray, ratios: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A bin of each statistic for consecutive texts, one row each. ``ratios``: of documents not counted, then by class."""
    n = len(bounds) - 1
    kinds = _KINDS[raw]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    by = np.bincount(row * 5 + kinds, minlength=n * 5).reshape(n, 5)
    solid = by.sum(axis=1) - by[:, 4]
    damped = solid + SHORT_CHARS  # a few characters prove little
    sizes, again, owner, bucket = _words(raw, bounds)
    repeats = again / (sizes + SHORT_WORDS)
    # Variety: distinct words among as many as make shares of long and short texts comparable.
    distinct = np.bincount(owner, minlength=n)
    variety = np.where(sizes > 0, np.log1p(distinct + SHORT_WORDS) / np.log1p(sizes + SHORT_WORDS), 0.0)
    word_size = np.minimum((solid + 5 * SHORT_WORDS) / (sizes + SHORT_WORDS) / 20, 1)
    said = np.bincount(owner, weights=ratios[known[owner] + 1, bucket], minlength=n) / (distinct + SHORT_WORDS)
    shares = [by[:, 1] / damped, by[:, 2] / damped, repeats, variety**4, word_size, by[:, 3] / damped]
    words = np.minimum((BINS / (1 + np.exp(-2 * said))).astype(np.int64), BINS - 1)
    return np.stack([*(_bin(s) for s in shares), words], axis=1)


def word_model(docs: DataFrame, good: DataFrame, train_rows: int = TRAIN_ROWS) -> WordModel:
    """``docs``: doc_id, text. ``good``: doc_id, good (0 or 1)."""
    bounded_batches(docs.sparkSession)
    parts = [good.where(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for k in (0, 1)]
    chosen = scratch(parts[0].unionByName(parts[1]), "labelled")  # at most 2 x train_rows ids
    sample = docs.join(F.broadcast(chosen), "doc_id").select("good", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = np.zeros((2, 1 << WORD_BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            of = batch.column("good").to_numpy()
            rows += np.bincount(of, minlength=2)
            for i, j in runs(bounds, RUN_BYTES):
                _, _, owner, bucket = _words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                for k in (0, 1):
                    held[k] += np.bincount(bucket[of[i:j][owner] == k], minlength=1 << WORD_BITS)
        seen = np.nonzero(held.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *seen.tolist()], pa.int32()), *(pa.array(np.concatenate([rows[k : k + 1], held[k, seen]])) for k in (0, 1))], names=["bucket", "bad", "good"])

    sums = sample.mapInArrow(tidy(count), "bucket int, bad bigint, good bigint").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    bucket, of = sums.column("bucket").to_numpy(), np.stack([sums.column(c).to_numpy() for c in ("bad", "good")]) if sums.num_rows else np.zeros((2, 0), np.int64)
    held = np.zeros((2, 1 << WORD_BITS), np.int32)
    held[:, bucket[bucket >= 0]] = of[:, bucket >= 0]
    ids = chosen.select(F.xxhash64(F.col("doc_id").cast("string")).alias("id"), "good").toArrow()
    return WordModel(held, of[:, bucket < 0].sum(axis=1), ids.column("id").to_numpy(), ids.column("good").to_numpy())


def document_statistics(docs: DataFrame, model: WordModel, *, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``bins``: one small number per statistic, each in a range of its own."""
    bounded_batches(docs.sparkSession)
    packed = docs.select(pack(keep), F.xxhash64(F.col("doc_id").cast("string")).alias("id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ratios = np.stack([m.ratios(None), m.ratios(0), m.ratios(1)])
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            known = m.known(batch.column("id").to_numpy())
            cells = [np.empty((0, len(STATISTICS)), np.int64)]
            for i, j in runs(bounds, RUN_BYTES):
                cells.append(statistics(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], ratios, known[i:j]) + np.arange(len(STATISTICS)) * BINS)
            flat = pa.array(np.concatenate(cells).reshape(-1).astype(np.int32))
            bins = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(ROW), bins], names=[ROW, "bins"])

    return packed.mapInArrow(tidy(measure), with_row(packed, "bins array<int>")).select(*unpack(keep, ["bins"]))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _evidence_model(measured: DataFrame, labels: DataFrame) -> tuple[list[float], float]:
    """Log ratio per bin and the rate of good labels, from every labelled document."""
    cells = len(STATISTICS) * BINS
    seen = measured.join(labels, "doc_id").select("good", F.explode("bins").alias("bin")).groupBy("bin").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    good, bad = np.zeros(cells), np.zeros(cells)
    for r in seen:  # at most one row per bin
        good[r["bin"]], bad[r["bin"]] = r["good"], r["n"] - r["good"]
    good_n, bad_n = good[:BINS].sum(), bad[:BINS].sum()
    ratios = np.log((good + 1) / (good_n + BINS)) - np.log((bad + 1) / (bad_n + BINS))
    if not good_n or not bad_n:
        ratios[:] = 0
    return ratios.tolist(), float((good_n + 1) / (good_n + bad_n + 2))


def _strength(sites: DataFrame, rate: str, parent: str) -> float:
    """Prior strength by the method of moments: weak where sites differ more than chance."""
    r = sites.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.pow(F.col(rate) - F.col(parent), 2)).alias("spread"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("chance"),
    ).first()
    if not r["n"] or r["k"] < 2:
        return 10.0
    within, between = r["chance"] / r["n"], r["spread"] / r["n"]
    size = r["n"] / r["k"]
    excess = max(between - within / size, 1e-6)
    return float(min(max(within / excess - 1, 2.0), 10_000.0))


def judge_documents(docs: DataFrame, labels: DataFrame, *, keep: list[str], host: str = "source", path: str = "lang", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``keep`` columns with evidence, site_prior, score (posterior of good quality) and kept.

    ``labels``: doc_id, quality (0 or 1). The kept columns move with the rows of figures, so keep texts out of them.
    """
    # Labels grow with the documents; compressed they look small enough to broadcast, which they are not.
    good = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("good")).hint("merge")
    site = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(n) for c, n in ((host, "host"), (path, "path"))]
    named = docs.select(pack(keep), "doc_id", "text", *site)
    model = word_model(named.select("doc_id", "text"), good, train_rows)
    measured = scratch(document_statistics(named, model, keep=[ROW, "doc_id", "host", "path"]), "quality")
    ratios, base = _evidence_model(measured.select("doc_id", "bins"), good)
    cells = F.array(*[F.lit(x) for x in ratios])
    evidence = F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), F.aggregate("bins", F.lit(0.0), lambda s, b: s + F.get(cells, b))))
    soft = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(float(np.log(base / (1 - base)))))))
    # Documents without an id have no label; dealt out by row, they do not meet in one task of the join.
    voted = measured.withColumn("evidence", evidence).drop("bins")
    labelled = voted.where("doc_id IS NOT NULL").join(good, "doc_id", "left").unionByName(voted.where("doc_id IS NULL").withColumn("good", F.lit(None).cast("int")))
    voted = scratch(labelled.select(ROW, "host", "path", "evidence", F.coalesce(F.col("good").cast("double"), soft).alias("vote")), "votes")
    paths = scratch(voted.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("vote").alias("votes")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("votes").alias("host_votes"))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_votes").alias("votes")).first()
    overall = (total["votes"] + 1) / (total["n"] + 2) if total["n"] else base
    k_host = _strength(hosts.select(F.col("host_n").alias("n"), (F.col("host_votes") / F.col("host_n")).alias("rate"), F.lit(overall).alias("above")), "rate", "above")
    shrunk = (F.col("host_votes") + k_host * F.lit(overall)) / (F.col("host_n") + k_host)
    sites = scratch(paths.join(hosts, "host"), "priors")
    k_path = _strength(sites.select("n", (F.col("votes") / F.col("n")).alias("rate"), shrunk.alias("above")), "rate", "above")
    few = sites.count() <= BROADCAST_SITES
    own = F.col("vote")
    above = (F.col("host_votes") - own + k_host * F.lit(overall)) / (F.col("host_n") - 1 + k_host)
    prior = (F.col("votes") - own + k_path * above) / (F.col("n") - 1 + k_path)
    out = voted.join(F.broadcast(sites) if few else sites, ["host", "path"]).withColumn("site_prior", F.least(F.lit(0.999), F.greatest(F.lit(0.001), prior)))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("site_prior"))))))
    out = out.select(F.col(ROW), "evidence", "site_prior", "score", (F.col("score") >= threshold).alias("kept"))
    return out.select(*unpack(keep, ["evidence", "site_prior", "score", "kept"]))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge_documents(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), keep=["doc_id"])
