"""Helpers shared by the corpus operators: table access, shared scratch, Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of one Arrow batch handed to a Python worker. Documents may be long, so
#: the defaults of 10,000 rows and 64 MB would not bound a worker's memory well.
ARROW_ROWS = 2000
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for workers that hold a few hundred MB.

    Plans read these settings when they run, after the operator has returned, so they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("/tmp/tessera-checkpoints")  # one machine, as in tests
    return "/tmp/tessera-checkpoints"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors. The folder is the caller's to clean, like any checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_alone(df: DataFrame, name: str) -> DataFrame:
    """``scratch``, after which the shuffle files of its own plan go at once; as a rule they stay on the executors'
    disks until the driver happens to collect what refers to them."""
    setting, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(setting)
    conf.set(setting, "true")
    try:
        return scratch(df, name)
    finally:
        conf.set(setting, before)


def held(df: DataFrame, shelf: list[DataFrame] | None = None) -> DataFrame:
    """Keep ``df`` on the executors' disks for use in several places. What a lost executor held is computed again.
    ``shelf`` lists what the caller gives up with ``unpersist`` when its result is written."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    if shelf is not None:
        shelf.append(kept)
    return kept


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


#: The column in which operators carry what the caller keeps; its fields can have any names.
ROW = "tessera_row"


def pack(keep: list[str]) -> Column:
    return F.struct(*[F.col(f"`{n.replace('`', '``')}`").alias(n) for n in keep]).alias(ROW)


def with_row(packed: DataFrame, results: str) -> StructType:
    """The schema of ``ROW`` and the columns of ``results``."""
    return StructType([packed.schema[ROW], *StructType.fromDDL(results).fields])


def unpack(keep: list[str], results: list[str]) -> list[Column]:
    """The kept columns again, then the results; a kept column that is called as a result gives way to it."""
    mine = {r.lower() for r in results}
    return [*(F.col(ROW).getField(n).alias(n) for n in keep if n.lower() not in mine), *(F.col(r) for r in results)]


def rewritten(docs: DataFrame, text: Column, changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``ROW``, with ``text`` for its text; n_chars, if there, follows a text that has ``changed``."""
    kinds = dict(docs.dtypes)
    of = {"text": text}
    if "n_chars" in kinds:
        of["n_chars"] = F.when(changed, F.length(text).cast(kinds["n_chars"])).otherwise(F.col(ROW).getField("n_chars"))
    return [of.get(n, F.col(ROW).getField(n)).alias(n) for n in docs.columns]


def row_key() -> Column:
    """A text that equals for rows of equal doc_id and text only (the text by 128 bits of hash and its length)."""
    text = F.col("text")
    parts = [F.col("doc_id").cast("string"), F.xxhash64(text).cast("string"), F.xxhash64(F.lit(1), text).cast("string"), F.octet_length(text).cast("string")]
    return F.concat_ws("|", *[F.coalesce(p, F.lit("null")) for p in parts])


#: Rows of a few numbers that are broadcast at most, so that texts stay where they are (up to some 30 MB).
SENT_ROWS = 500_000


def sent(narrow: DataFrame) -> DataFrame:
    """``narrow``, broadcast if a count shows that it is small; else both sides of its join are dealt by key."""
    return F.broadcast(narrow) if narrow.count() <= SENT_ROWS else narrow.hint("merge")


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in the column ``key`` of ``keys``; columns may have any names.
    ``keys`` is counted, so it should be written."""
    own = fresh("tessera_key", docs.columns)
    both = lambda key: F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(2), key).alias("b")).alias(own)
    dropped = sent(keys.select(both(F.col("key"))))
    return docs.select("*", both(row_key())).join(dropped, own, "left_anti").select(*docs.columns)


#: Rows of one file of a table that is only written to cut the lineage.
FILE_ROWS = 500_000


def settled(df: DataFrame, name: str) -> DataFrame:
    """``scratch`` in as few files as the rows need: a result of much work that has few rows."""
    worked = held(df)
    files = max(1, -(-worked.count() // FILE_ROWS))
    written = scratch(worked.coalesce(files), name)
    worked.unpersist()
    return written


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives its memory back when its task ends, as workers live on for other tasks."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows (null: empty), without copying."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into consecutive runs [i, j) of at most ``most`` bytes, or one longer row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@cache
def letters() -> np.ndarray:
    """The lower-case letter of every code point, 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        for cp in range(low, high):
            if chr(cp).isalpha():
                out[cp] = ord(chr(cp).lower()[0])
    return out


def shown(parts: list[Broadcast]) -> Iterator:
    """The values of broadcasts, one after the other: of several, a worker holds one at once."""
    for part in parts:
        yield part.value
        if len(parts) > 1 and getattr(part, "_path", None):
            part.__dict__.pop("_value", None)  # read again from the worker's disk when it is asked for


def code_points(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of consecutive texts, a line feed after each, and the text of each point."""
    n = len(bounds) - 1
    parts = raw.tobytes()
    joined = b"\n".join(parts[bounds[i] : bounds[i + 1]] for i in range(n)) + b"\n"
    points = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)])
    ends = before[bounds[1:] + np.arange(1, n + 1)]
    return points, np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
