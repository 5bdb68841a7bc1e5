"""Toxicity: a character n-gram linear classifier on naive Bayes scaled features.

Texts are folded to lower-case letters with single blanks; their character 3-, 4- and 5-grams
are hashed. From labelled documents come the document counts of every hash per
class; the classifier has the ``FEATURES`` hashes of clearest evidence (its size, a documented parameter; ties go to the
smaller hash), and a document's vector has the naive Bayes log-count ratio of each it holds. A logistic regression on
these vectors gives the score. Counts and fit take at most ``TRAIN_ROWS`` labelled documents of either class, those
of least hash (a documented bound); every whole text is scored.

Null and empty texts are scored like a text without features, very long ones as a whole. Without labelled
rows of both classes the model is neutral: everything scores the prior. An empty table gives no rows. Only text (and
``keep``) is read for scores; a kept column called score gives way to it.
Repeated rows each get a result; repeated labels of a document count once (any toxic wins).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ROW, bounded_batches, code_points, letters, pack, runs, scratch, table, tidy, unpack, utf8, with_row

ORDERS = (3, 4, 5)
BITS = 18
FEATURES = 1024
#: Labelled documents of either class the classifier is fitted on, at most.
TRAIN_ROWS = 10_000
THRESHOLD = 0.7
RUN_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _grams(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashes of consecutive texts' n-grams and the text of each."""
    points, row = code_points(raw, bounds)
    folded = letters()[np.minimum(points, 0x10FFFF)]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 0) | (folded[:-1] != 0)
    folded, row = folded[keep].astype(np.uint64), row[keep]
    value = (folded + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)
    rolled, width = value, 1
    for order in ORDERS:
        while width < order and len(rolled) > 1:
            rolled = rolled[:-1] * _STEP + value[width : width + len(rolled) - 1]
            width += 1
        if width < order:
            return
        own = row[: len(rolled)] == row[width - 1 : width - 1 + len(rolled)]
        hashed = ((rolled ^ (rolled >> np.uint64(31))) * _STEP) >> np.uint64(64 - BITS)
        yield hashed[own].astype(np.int64), row[: len(rolled)][own]


@dataclass
class Classifier:
    slot: np.ndarray  # feature of each hash, -1 for none
    weight: np.ndarray  # learnt weight times log-count ratio
    bias: float

    def scores(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        rows, found = _features(raw, bounds, self.slot)
        z = self.bias + np.bincount(rows, weights=self.weight[found], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(raw: np.ndarray, bounds: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs."""
    rows, found = [], []
    for hashed, row in _grams(raw, bounds):
        at = slot[hashed]
        hit = np.nonzero(at >= 0)[0]
        rows.append(row[hit])
        found.append(at[hit].astype(np.int64))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pair = np.unique(np.concatenate(rows) * FEATURES + np.concatenate(found))
    return pair // FEATURES, pair % FEATURES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that hold each hash; hash -1 counts all."""
    held = np.zeros((2, (1 << BITS) + 1), np.int64)
    for batch in batches:
        labels = np.array(batch.column("label").to_pylist())
        raw, bounds = utf8(batch.column("text"))
        for i, j in runs(bounds, RUN_BYTES):
            pairs = [row * (1 << BITS) + hashed for hashed, row in _grams(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])]
            pair = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
            own = labels[i:j][pair >> BITS] if len(pair) else pair
            for k in (0, 1):
                held[k, :-1] += np.bincount(pair[own == k] & ((1 << BITS) - 1), minlength=1 << BITS)
                held[k, -1] += int((labels[i:j] == k).sum())
    seen = np.nonzero(held.sum(axis=0))[0]
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(held[0, seen]), pa.array(held[1, seen])], names=["hash", "n0", "n1"])


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; classes weigh the same."""
    n, k = x.shape
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)).astype(np.float32)
    rate = 4.0 / max(float((share[:, None] * x * x).sum(axis=0).max(initial=1.0)) * 8, 1.0)
    w, b = np.zeros(k, np.float32), 0.0
    pw, pb = w.copy(), b
    for t in range(1, rounds + 1):
        m = (t - 1) / (t + 2)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        err = (1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - y) * share
        pw, pb = w, b
        w, b = vw - rate * (x.T @ err + ridge * vw), vb - rate * float(err.sum())
    return w, b


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Classifier:
    """``docs``: doc_id, text. ``labels``: doc_id, toxic (0 or 1)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    each = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    parts = [each.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 x train_rows ids
    sample = scratch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("label", "text"), "toxic")
    counts = sample.mapInArrow(tidy(_count), "hash bigint, n0 bigint, n1 bigint").groupBy("hash").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = counts.toArrow()
    cells = np.stack([found.column(c).to_numpy() for c in ("hash", "n0", "n1")], axis=1).astype(np.int64)
    cells = cells[np.argsort(cells[:, 0])]
    total = cells[cells[:, 0] == 1 << BITS][:, 1:].sum(axis=0) if len(cells) else np.zeros(2)
    slot = np.full(1 << BITS, -1, np.int16)
    if not len(cells) or not total.all():
        return Classifier(slot, np.zeros(FEATURES), 0.0 if not sum(total) else float(np.log((total[1] + 1) / (total[0] + 1))))
    cells = cells[cells[:, 0] < 1 << BITS]
    p, q = (cells[:, 2] + 0.5) / (total[1] + 1), (cells[:, 1] + 0.5) / (total[0] + 1)
    pooled = cells[:, 1:].sum(axis=1) / total.sum()
    clear = np.abs(p - q) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / total[0] + 1 / total[1]))
    best = np.argsort(-clear, kind="stable")[:FEATURES]
    slot[cells[best, 0]] = np.arange(len(best))
    ratio = np.zeros(FEATURES)
    ratio[: len(best)] = np.log(p[best]) - np.log(q[best])
    shared = spark.sparkContext.broadcast(slot)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            bits = np.zeros((batch.num_rows, FEATURES), bool)
            for i, j in runs(bounds, RUN_BYTES):
                rows, found = _features(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shared.value)
                bits[i + rows, found] = True
            packed = [x.tobytes() for x in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(packed, pa.binary())], names=["label", "bits"])

    rows = sample.mapInArrow(tidy(vectors), "label int, bits binary").collect()  # train_rows x FEATURES bits a class
    rows.sort(key=lambda r: (r["label"], bytes(r["bits"])))
    x = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, :FEATURES]
    w, b = _fit(x * ratio.astype(np.float32), np.array([r["label"] for r in rows], np.float32))
    return Classifier(slot, w * ratio, b)


def score_documents(docs: DataFrame, model: Classifier, *, keep: list[str]) -> DataFrame:
    """``keep`` columns and score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    packed = docs.select(pack(keep), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = utf8(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for i, j in runs(bounds, RUN_BYTES):
                out[i:j] = shared.value.scores(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(out)], names=[ROW, "score"])

    return packed.mapInArrow(tidy(score), with_row(packed, "score double")).select(*unpack(keep, ["score"]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held("doc_id").alias("held_out"), "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held("doc_id"))
    model = fit(docs.select("doc_id", "text"), labels)
    scored = score_documents(docs, model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
