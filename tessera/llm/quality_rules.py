"""Quality rules: counted text rules, then a hashed n-gram log-likelihood ratio.

Documents that pass the counted rules are judged by the mean log ratio of their hashed
word unigrams and bigrams between a trusted-target multinomial and the raw-corpus
multinomial. Everything runs as DataFrame expressions: the corpus counts are a
map-side combined aggregate over all documents, with one bucket per ``BUCKET_BYTES`` of
text, so that as many n-grams share a bucket at every size. Up to ``ARRAY_BUCKETS`` the
model is an array and each document is scored where it lies; a larger one is joined by bucket.

A task's counts of nearly all buckets are sent, so the bytes sent are tasks times buckets, and both
grow with the text. Hence ``COUNT_PARTS`` tasks count for an array. For a larger model the documents are
counted in up to as many blocks and scored in up to ``JOIN_BLOCKS``, whose shuffle files go before the next one.

The threshold is the cut that judges the fewest labelled documents wrong, in the middle of
the gap it falls in. A trusted document's own n-grams do not count for it there (each as if
it stood once in its bucket), as unlabelled documents are not in the target either.

Words are runs of characters other than ASCII white space. A null or blank text has no
words, so it fails the base rule. Windows and n-grams are compared by 64-bit hashes.
Repeated rows each keep a result row; without trusted rows the ratio is neutral.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import held, scratch_alone, table

#: Column that marks the documents of the target.
TARGET = "tessera_target"
BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bytes of text a hash bucket of the two multinomials stands for, and the fewest buckets.
BUCKET_BYTES = 512
LEAST_BUCKETS = 1 << 16
#: Buckets of a model that is sent to the executors as an array; more are joined.
ARRAY_BUCKETS = 1 << 22
#: Parts of the corpus that are counted on their own: a bucket's counts are sent at most so often.
COUNT_PARTS = 8
#: Blocks of documents whose n-grams are joined with a model that is no array, and the fewest buckets there are for each.
JOIN_BLOCKS = 32
BLOCK_BUCKETS = 1 << 18
#: Buckets of a task of that join.
TASK_BUCKETS = 1 << 20
#: Trusted doc_ids that are sent to the executors (some 30 bytes each); more are joined by sorting, which moves the texts.
SENT_IDS = 5_000_000
#: Buckets gathered into one row before the array is put together.
CHUNK = 1 << 10
#: Decimals of the ratios between which the threshold is searched.
CUT_DECIMALS = 3


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def buckets_for(docs: DataFrame) -> int:
    """A power of two that grows with the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, 1 << (-(-size // BUCKET_BYTES) - 1).bit_length())


def _grams(hashes: Column, buckets: int) -> Column:
    """Buckets of the unigrams, then of the bigrams."""
    kind = "int" if buckets <= 1 << 31 else "bigint"
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast(kind))
    twos = F.transform(hashes, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast(kind))
    return F.concat(ones, F.slice(twos, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))))


def base_counts(docs: DataFrame, *, keep: list[str]) -> DataFrame:
    """``keep`` columns, the word hashes and the counted rules of every document."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    out = (
        docs.select(*keep, text.alias("text"))
        .withColumn("words", words_of(F.col("text")))
        .withColumn("lines", lines)
        .select(
            *keep,
            F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
            F.size("words").cast("bigint").alias("n_words"),
            F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        )
    )
    hashes = F.col("hashes")
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    out = out.withColumn("windows", windows).withColumn("repeats", F.size("windows") > F.size(F.array_distinct("windows")))
    ordered = F.when(F.col("repeats"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("ordered", ordered)
    twice = F.filter("ordered", lambda x, j: (F.get("ordered", j - 1)["h"] == x["h"]) | (F.get("ordered", j + 1)["h"] == x["h"]))
    out = out.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # Each repeated window adds five words, or as many as lie before the next one.
    added = F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1), p + WINDOW) - p))
    covered = F.aggregate(added, F.lit(0).cast("bigint"), lambda s, x: s + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("windows", "repeats", "ordered", "at")


def _marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """With ``TARGET`` 1 in the rows of trusted documents."""
    chosen = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn(TARGET, F.lit(1))
    return docs.join(F.broadcast(chosen) if chosen.count() <= SENT_IDS else chosen, "doc_id", "left")


def gram_counts(marked: DataFrame, buckets: int) -> DataFrame:
    """bucket, raw and target counts of every bucket that occurs: over all documents, and over all trusted ones."""
    flagged = marked.select(F.col(TARGET).alias("target"), "text")
    hashed = flagged.select("target", words_of(F.col("text")).alias("words")).select("target", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    return (
        hashed.select("target", F.explode(_grams(F.col("hashes"), buckets)).alias("bucket"))
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("target").alias("target"))
    )


def _ratio() -> Column:
    return F.log((F.col("target") + 1) / (F.col("raw") + 1))


def _loss() -> Column:
    """What the ratio loses when one n-gram less is in the target."""
    return F.log((F.col("target") + 1) / F.greatest("target", F.lit(1)))


def _means_by_array(counted: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    spark = counted.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    cell = F.struct("bucket", _ratio().alias("ratio"), _loss().cast("float").alias("loss"))
    cells = every.groupBy(F.floor(F.col("bucket") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    chunks = cells.select(F.struct("chunk", F.col("cells.ratio").alias("ratio"), F.col("cells.loss").alias("loss")).alias("c"))
    whole = chunks.agg(F.sort_array(F.collect_list("c")).alias("c"))
    model = held(whole.select(F.flatten("c.ratio").alias("ratios"), F.flatten("c.loss").alias("losses")))
    # Each of the two arrays is used once, in the projection above its own: so the optimizer puts it where it
    # is read, and no row gets a copy. A column that is made here and used twice would prevent that.
    scored = counted.withColumn("ratios", model.select("ratios").scalar()).withColumn("losses", model.select("losses").scalar())
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    mean = lambda name: F.aggregate(_grams(F.col("hashes"), buckets), F.lit(0.0), lambda s, b: s + F.get(name, b)) / F.when(n_grams > 0, n_grams)
    means = {"mean_ratio": mean("ratios"), "mean_loss": F.when(F.col(TARGET) == 1, mean("losses")), "n_grams": n_grams}
    return scored.withColumns(means).drop("hashes", "ratios", "losses")


def _blocks(docs: DataFrame, trusted: DataFrame, buckets: int, most: int) -> Iterator[DataFrame]:
    """``_marked`` documents in up to ``most`` parts by doc_id, as the trusted ones."""
    blocks = min(most, max(1, buckets // BLOCK_BUCKETS))
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(blocks))
    for k in range(blocks):
        yield _marked(docs.where(block == k), trusted.where(block == k))


def _counts_by_block(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """``gram_counts`` of all documents, a block at a time."""
    parts = [scratch_alone(gram_counts(marked, buckets), "op4-counts") for marked in _blocks(docs, trusted, buckets, COUNT_PARTS)]
    whole = reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    return scratch_alone(whole, "op4-counts")


def _means_by_join(counted: DataFrame, counts: DataFrame, buckets: int) -> DataFrame:
    """As by array. Rows with equal words share a key and a mean, so their n-grams may be summed together."""
    keyed = counted.withColumn("key", F.struct(F.xxhash64("hashes").alias("a"), F.xxhash64(F.lit(1), "hashes").alias("b")))
    cells = counts.select("bucket", _ratio().alias("ratio"), _loss().cast("float").alias("loss"))
    grams = keyed.select("key", F.explode(_grams(F.col("hashes"), buckets)).alias("bucket"))
    # Few tasks, so that one meets several n-grams of a document and sends their sum.
    tasks = max(16, buckets // TASK_BUCKETS)
    both = grams.repartition(tasks, "bucket").join(cells.repartition(tasks, "bucket").hint("shuffle_hash"), "bucket")
    means = both.groupBy("key").agg(F.avg("ratio").alias("mean_ratio"), F.avg("loss").alias("mean_loss"))
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    return keyed.withColumn("n_grams", n_grams).drop("hashes").join(means, "key", "left").drop("key")


def _means_by_block(docs: DataFrame, trusted: DataFrame, counts: DataFrame, buckets: int, keep: list[str]) -> DataFrame:
    """``_means_by_join`` of all documents, a block at a time."""
    done = []
    for marked in _blocks(docs, trusted, buckets, JOIN_BLOCKS):
        counted = held(base_counts(marked, keep=keep))
        done.append(scratch_alone(_means_by_join(counted, counts, buckets), "op4-means"))
        counted.unpersist()
    return reduce(DataFrame.unionByName, done)


def score_quality(docs: DataFrame, trusted: DataFrame, *, keep: list[str], buckets: int | None = None, array_buckets: int = ARRAY_BUCKETS) -> DataFrame:
    """``keep`` columns, the counted rules, the mean log ratio and, of a trusted document, the mean without its own n-grams in the target.

    ``trusted`` has column doc_id. Raw counts take every document, the target every trusted one.
    """
    counted = docs if buckets else docs.coalesce(COUNT_PARTS)
    buckets = buckets or buckets_for(docs)
    if buckets <= array_buckets:
        counts = held(gram_counts(_marked(counted, trusted), buckets))
        scored = _means_by_array(base_counts(_marked(docs, trusted), keep=[*keep, TARGET]), counts, buckets)
    else:
        counts = _counts_by_block(docs, trusted, buckets)
        scored = _means_by_block(docs, trusted, counts, buckets, [*keep, TARGET])
    sums = held(counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")))
    raw, target = sums.select("raw").scalar(), sums.select("target").scalar()
    ratio = F.col("mean_ratio") + F.log(raw + F.lit(buckets)) - F.log(target + F.lit(buckets))
    others = F.greatest(target - F.col("n_grams"), F.lit(0))
    without = F.col("mean_ratio") - F.col("mean_loss") + F.log(raw + F.lit(buckets)) - F.log(others + F.lit(buckets))
    neutral = (target == 0) | F.col("mean_ratio").isNull()
    scored = scored.withColumn("log_ratio", F.when(neutral, F.lit(0.0)).otherwise(ratio))
    scored = scored.withColumn("ratio_without", F.when(F.col(TARGET) == 1, F.when(neutral, F.lit(0.0)).otherwise(without)))
    return scored.drop("mean_ratio", "mean_loss", "n_grams", TARGET)


def threshold_of(ratios: DataFrame) -> DataFrame:
    """One row ``threshold``, null without rows, from ``ratios`` (ratio, good).

    Rows are counted by rounded ratio, so that one task meets as many rows as there are values between the extremes.
    """
    bins = ratios.groupBy(F.round("ratio", CUT_DECIMALS).alias("v")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    before, upward = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("v")
    wrong = F.coalesce(F.sum("good").over(before), F.lit(0)) - F.coalesce(F.sum("bad").over(before), F.lit(0))
    cuts = bins.select("v", wrong.alias("wrong"), ((F.col("v") + F.coalesce(F.lag("v").over(upward), F.col("v"))) / 2).alias("cut"))
    # Where dropping all is best, the cut lies above every row.
    above = bins.agg((F.sum("good") - F.sum("bad")).alias("wrong"), (F.max("v") + 10**-CUT_DECIMALS).alias("cut")).where("cut IS NOT NULL")
    return cuts.select("wrong", "cut").unionByName(above).agg(F.min_by("cut", F.struct("wrong", "cut")).alias("threshold"))


def judge_quality(docs: DataFrame, trusted: DataFrame, *, keep: list[str], distrusted: DataFrame | None = None, threshold: float | None = None, **kwargs) -> DataFrame:
    """``keep`` columns, the counted rules, mean log ratio and the verdict of every document.

    Without ``threshold`` it is set between the ``trusted`` and the ``distrusted`` documents (doc_id; one
    in both is trusted) that pass the counted rules; without the latter it is the trusted ones' least ratio.
    """
    own = "tessera_doc_id"
    scored = held(score_quality(docs.withColumn(own, F.col("doc_id")), trusted, keep=[*keep, own], **kwargs))
    cut = F.lit(threshold)
    if threshold is None:
        marks = trusted.select("doc_id", F.lit(True).alias("good"))
        if distrusted is not None:
            marks = marks.unionByName(distrusted.select("doc_id", F.lit(False).alias("good")))
        marks = marks.groupBy(F.col("doc_id").alias(own)).agg(F.max("good").alias("good"))
        found = scored.where("NOT base_failed").select(own, "log_ratio", "ratio_without").join(marks, own)
        cut = F.coalesce(threshold_of(found.select("good", F.coalesce("ratio_without", "log_ratio").alias("ratio"))).scalar(), F.lit(0.0))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= cut)).drop(own, "ratio_without")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    trusted, distrusted = labels.where("quality = 1").select("doc_id"), labels.where("quality = 0").select("doc_id")
    return judge_quality(docs, trusted, keep=["doc_id"], distrusted=distrusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("log_ratio", 6).alias("log_ratio")
    )
