"""Every registered query and the pipeline on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import random

import pytest

queries = pytest.importorskip("tessera.llm.queries")
pipeline = pytest.importorskip("corpus_pipeline")

from .conftest import prose  # noqa: E402

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Extra columns, called as ones that operators make.
CLASHING = ("kept", "score", "evidence", "site_prior", "bins", "n_removed", "n_bytes", "n_spans", "print", "marks", "spans", "items", "n_words", "key", "host", "digest", "component_id", "held_out")
TABLES = {
    "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id string, text string", "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def rows_of():
    rng = random.Random(31)
    plain = [prose(rng, 60) for _ in range(30)]
    long = " ".join(prose(rng, 50) for _ in range(1200))
    texts = [*plain, plain[0], plain[1] + " end", long, long[200_000:] + " tail", "x" * 300_000, "", None, "   ", "é日本 語", "!!%% AAA " * 30]
    docs = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[3], docs[3], (None, plain[4], "en", "s1", 3), (None, plain[4], "en", "s1", 3), (None, None, None, None, None), (7, plain[9] + " other", "en", "s1", 1)]
    return docs


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = rows_of()
    extra = ", ".join(f"`{c}` int" for c in CLASHING)
    spark.createDataFrame([(*d, *[7] * len(CLASHING)) for d in docs], f"{DOCUMENTS}, {extra}").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 35), int(i == 38)) for i in range(0, 40, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (3, None, None), (39, 0, 1)]
    data = {
        "labels": labels, "benchmark": [("a", " ".join(docs[5][1].split()[:14])), ("b", None), (None, ""), ("a", "lone words")],
        "pages": [(1, "http://x.net/", ""), (1, "http://x.net/", ""), (None, None, None), (2, "", ""), (3, "no", "")],
        "conversations": [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, None), (2, 0, "assistant", "<|im_end|>" * 3)],
    }
    for name, kind in TABLES.items():
        spark.createDataFrame(data[name], kind).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    for name, kind in {"documents": DOCUMENTS, **TABLES}.items():
        spark.createDataFrame([], kind).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, odd, nothing, name):
    got = queries.QUERIES[name](spark, odd).collect()
    n = {"op5": 5, "op9": 4}.get(name.split("_")[0], len(rows_of()))
    assert len(got) == n
    if name.startswith(("op3", "op10")):
        assert all(0 <= r["score"] <= 1 for r in got)
    if name.startswith("op3"):
        assert all((r["score"] >= 0.7) == r["predicted"] for r in got) and not any(r["held_out"] for r in got if r["doc_id"] is None)
    if name.startswith("op10"):
        text = {i: t for i, t, *_ in rows_of()}
        assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in text[r["doc_id"]] or "")) for r in got if r["doc_id"] not in (None, 7))
    if name.startswith("op1_"):
        assert all(r["lossless"] for r in got)
    assert len(queries.QUERIES[name](spark, nothing).collect()) == (1 if name.startswith("op9") else 0)


def test_pipeline_stages(spark, odd, nothing, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, odd).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns and out.where(" OR ".join(f"`{c}` <> 7 OR `{c}` IS NULL" for c in CLASHING)).count() == 0
        if k == 1:  # one row of exact copies, with an id or without
            assert out.groupBy("doc_id", "text").count().where("count > 1").count() == 0
            assert out.where("doc_id = 30").count() == 0 and out.where("doc_id = 3").count() == 1
        docs = out
    assert docs.count() > 20 and docs.where("NOT lossless").count() == 0
    assert pipeline.run(spark, nothing).count() == 0
