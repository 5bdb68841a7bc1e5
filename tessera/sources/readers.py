"""Scans of logs, manifests, question files, source trees and graphs."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import first_sentence
from tessera.sources import schemas

#: Directories that a tree's hash leaves out (fixed values).
HASH_EXCLUDED = (".git", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".venv", ".DS_Store")
#: Function names that make no task (fixed values).
COMMON_NAMES = ("__init__", "__repr__", "__str__", "__eq__", "__hash__", "__call__", "__getitem__", "__setitem__", "__len__", "main", "setup")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def run_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Run records of JSON lines; a malformed line is an error. Several stores are taken together."""
    return spark.read.schema(schemas.RUN_RECORD).option("mode", "FAILFAST").json(path if isinstance(path, str) else list(path))


def usage_log(spark: SparkSession, folder: str, date: str) -> DataFrame:
    """One day's usage lines; malformed ones are skipped and a missing day is empty."""
    path = f"{folder}/date={date}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.USAGE)
    return spark.read.schema(schemas.USAGE).option("mode", "DROPMALFORMED").json(path)


def judge_audit(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of the judge logs with their uri and order; missing files are ignored and a file with any malformed line counts for nothing."""
    there = [p for p in dict.fromkeys(paths) if path_exists(spark, p)]
    empty = spark.createDataFrame([], f"{schemas.JUDGE_AUDIT}, uri string, seq bigint")
    if not there:
        return empty
    rows = spark.read.text(there).select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("_b"), "value").where(F.trim("value") != "")
    parsed = rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("_bad", F.try_parse_json("value").isNull())
    bad = parsed.where("_bad").select("uri").distinct()
    good = parsed.join(bad, "uri", "left_anti").withColumn("_r", F.from_json("value", schemas.JUDGE_AUDIT))
    return good.select("_r.*", "uri", "seq")


def _checked(spark: SparkSession, path: str, schema: str, required: Sequence[str]) -> DataFrame:
    """JSON lines without blank and comment lines; a line that does not parse or lacks a field is an error."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    row = lines.withColumn("_r", F.from_json("value", schema, {"mode": "FAILFAST"})).select("_r.*", "seq")
    for name in required:
        row = row.withColumn(name, F.coalesce(name, F.raise_error(F.lit(f"field {name} is missing")).cast("string")))
    return row


def _last(rows: DataFrame, key: str) -> DataFrame:
    names = [c for c in rows.columns if c not in (key, "seq")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "seq").alias("_r")).select(key, "_r.*")


def human_labels(spark: SparkSession, path: str) -> DataFrame:
    """task_id, human: the last label of each task; only pass and fail, in any case, are labels. No label at all is an error."""
    rows = _checked(spark, path, schemas.HUMAN_LABEL, ("task_id", "label", "annotator_id"))
    label = F.lower(F.trim("label"))
    human = F.when(label == "pass", True).when(label == "fail", False).otherwise(F.raise_error(F.concat(F.lit("not a label: "), "label")).cast("boolean"))
    out = _last(rows.select("task_id", human.alias("human"), "annotator_id", "rationale", "seq"), "task_id")
    if out.isEmpty():
        raise ValueError(f"no labels in {path}")
    return out


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """The last candidate of each task."""
    out = _last(_checked(spark, path, schemas.CANDIDATE, ("task_id", "candidate")), "task_id")
    if out.isEmpty():
        raise ValueError(f"no candidates in {path}")
    return out


def questions(spark: SparkSession, path: str, pins: DataFrame, version: str = "1.0.0", canary: str = "") -> DataFrame:
    """Tasks of a question file with the repository they name; an unknown one is an error."""
    rows = _checked(spark, path, schemas.QUESTION, ("task_id", "repo_id", "question", "reference"))
    pin = pins.select(F.col("short_id").alias("repo_id"), F.struct("url", "commit", "snapshot_sha256", F.lit(None).cast("string").alias("docker_image")).alias("repo"), "license")
    joined = rows.join(pin, "repo_id", "left").withColumn("repo", F.coalesce("repo", F.raise_error(F.concat(F.lit("unknown repository "), "repo_id")).cast(schemas.REPO)))
    defaults = F.map_from_arrays(F.array(F.lit("difficulty"), F.lit("repo_id")), F.array(F.coalesce("difficulty", F.lit("medium")), F.col("repo_id")))
    given = F.coalesce("meta", F.expr("map()").cast("map<string,string>"))
    meta = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k)), given)
    return joined.select(
        "task_id", F.lit(version).alias("dataset_version"), F.lit("repo_qa").alias("task_type"), "question", "repo", F.col("reference").alias("gold"),
        F.lit(None).cast("string").alias("needle"), F.lit("llm_judge").alias("scoring"), F.lit(canary).alias("canary"), "license", meta.alias("meta"),
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """task_id and strata of a split manifest; comments are skipped and a missing file is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "task_id string, strata array<string>")
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')")
    cut = F.split("value", "\t", 2)
    return lines.select(F.trim(F.get(cut, F.lit(0))).alias("task_id"), F.split(F.coalesce(F.get(cut, F.lit(1)), F.lit("")), ",").alias("strata")).dropDuplicates(["task_id"])


def keep_tasks(tasks: DataFrame, listed: DataFrame) -> DataFrame:
    return tasks.join(listed.select("task_id"), "task_id", "left_semi")


def source_tree(spark: SparkSession, root: str, pattern: str = "*.py", tests: bool = True, hidden: bool = False) -> DataFrame:
    """path, text, content of the files below a folder, but for hidden ones; without ``tests`` also test and docs folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = re.sub("^[a-z0-9]+:/*", "/", root.rstrip("/")) + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), rf"^.*?\Q{base}\E", "")
    out = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), "content")
    parts = F.split("path", "/")
    if not hidden:
        out = out.where(~F.exists(parts, lambda p: F.startswith(p, F.lit("."))))
    if not tests:
        out = out.where(~F.exists(parts, lambda p: p.isin("tests", "docs") | F.startswith(p, F.lit("test_")) | F.contains(p, F.lit("_test"))))
    return out


def tree_hash(spark: SparkSession, root: str, excluded: Sequence[str] = HASH_EXCLUDED) -> str:
    """SHA-256 over length-prefixed paths (4 bytes) and contents (8 bytes) in path order, one file in memory at a time.

    The digest is sequential, so files pass through the driver one partition at a time.
    """
    files = source_tree(spark, root, "*", hidden=True).where(~F.exists(F.split("path", "/"), lambda p: p.isin(*excluded)))
    digest = hashlib.sha256()
    for row in files.select(F.split("path", "/").alias("parts"), "path", "content").orderBy("parts").toLocalIterator():
        for part, width in ((row["path"].encode(), 4), (bytes(row["content"]), 8)):
            digest.update(len(part).to_bytes(width, "big"))
            digest.update(part)
    return digest.hexdigest()


def verify_trees(spark: SparkSession, pins: DataFrame, folder: str) -> list[tuple[str, bool]]:
    """Whether each pinned snapshot still has its hash; pins are few."""
    return [(r["short_id"], tree_hash(spark, f"{folder}/{r['short_id']}") == r["snapshot_sha256"]) for r in pins.orderBy("short_id").collect()]


def _signature(node: ast.AST, name: str) -> str:
    if isinstance(node, ast.ClassDef):
        return f"class {name}"
    return f"def {name}({', '.join(a.arg for a in node.args.args)})"


def python_symbols(tree: DataFrame) -> DataFrame:
    """file, kind, name, signature, doc, place and listed of every class and function; files that do not parse have none.

    ``listed`` are those a repository map shows: what a module defines itself and the public methods of its classes.
    """

    def walk(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    module = ast.parse(text)
                except (SyntaxError, ValueError):
                    continue
                shown = {id(n): (n.name, "class" if isinstance(n, ast.ClassDef) else "def") for n in module.body if hasattr(n, "name")}
                for owner in module.body:
                    if isinstance(owner, ast.ClassDef):
                        shown |= {id(n): (f"{owner.name}.{n.name}", "method") for n in owner.body if hasattr(n, "args") and not n.name.startswith("_")}
                for place, node in enumerate(ast.walk(module)):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        name, kind = shown.get(id(node), (node.name, "class" if isinstance(node, ast.ClassDef) else "def"))
                        rows.append((path, kind, name, _signature(node, name), ast.get_docstring(node) or "", place, id(node) in shown))
            yield pd.DataFrame(rows, columns=["file", "kind", "name", "signature", "doc", "place", "listed"])

    found = tree.select("path", "text").mapInPandas(walk, "file string, kind string, name string, signature string, doc string, place int, listed boolean")
    return found.withColumn("summary", first_sentence(F.col("doc"), 120))


def needle_tasks(symbols: DataFrame, repo: Column, per_repo: int = 100) -> DataFrame:
    """Tasks that ask for a function by its description: documented public functions, at most ``per_repo`` of each repository, numbered over all."""
    short = F.element_at(F.split("name", r"\."), -1)
    fit = symbols.where("kind <> 'class'").withColumn("repo_id", repo).withColumn("short", short).where(~F.startswith("short", F.lit("_")) & ~F.col("short").isin(*COMMON_NAMES) & (F.length(F.trim("doc")) >= 30))
    ranked = fit.withColumn("_n", F.row_number().over(Window.partitionBy("repo_id").orderBy("file", "place"))).where(F.col("_n") <= per_repo)
    number = F.row_number().over(Window.orderBy("repo_id", "file", "place")) - 1  # per_repo bounds what is numbered
    return ranked.withColumn("idx", number).select(F.format_string("needle-%s-%04d", "repo_id", "idx").alias("task_id"), "repo_id", "file", F.col("short").alias("needle"), first_sentence(F.col("doc"), 200).alias("summary"))


def mock_tasks(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.format_string("mock-%04d", "id").alias("task_id"), F.col("id").alias("task_index"), F.format_string("What is the value of symbol_%d?", "id").alias("question"), F.format_string("symbol_%d", "id").alias("gold"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and links of a graph file."""
    whole = spark.read.schema(schemas.GRAPH).option("multiLine", True).json(path)
    return whole.select(F.inline("nodes")), whole.select(F.inline("links"))


def digests(spark: SparkSession, path: str) -> dict[str, str]:
    """The image digest of each repository; a missing file gives none."""
    if not path_exists(spark, path):
        return {}
    row = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string, string>").alias("m")).first()
    return dict(row["m"] or {})
