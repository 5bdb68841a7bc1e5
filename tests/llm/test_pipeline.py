"""The pipeline's stages against brute force on a small corpus with planted cases."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from .conftest import prose  # noqa: E402
from .test_filters import contamination, near  # noqa: E402
from .test_suffix_dedup import brute  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    passage, leak = prose(rng, 55), prose(rng, 30)
    texts = [prose(rng, rng.choice([30, 120])) for _ in range(80)]
    texts += [texts[0], texts[1], texts[2] + " tail"]
    texts += [f"{prose(rng, 25)} {passage} {prose(rng, 25)}" for _ in range(5)]
    texts += [f"{prose(rng, 25)} {leak} {prose(rng, 25)}", leak]
    junk = [" ".join(w.upper() + "!!%%$$" for w in prose(rng, 40).split()) for _ in range(20)]
    n = len(texts)
    docs = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)] + [(n + i, t, "en", "src9", len(t)) for i, t in enumerate(junk)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1) for i in range(0, n, 2)] + [(n + i, 0) for i in range(0, 20, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before, leak = docs.columns, rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns
            after = rows(out)
            assert out.where("n_chars <> length(text)").count() == 0
        if k == 0:
            kept = {i for i, _ in after}
            assert not any(i in kept for i, t in before if "!!%%" in t) and len(kept) >= 0.95 * sum("!!%%" not in t for _, t in before)
        elif k == 1:
            assert {i for i, _ in after} == {i for i, (_, _, keep) in near(before, 5).items() if keep}
        elif k == 2:
            gone = brute(before)
            assert {i: len(t.encode()) for i, t in after} == {i: n - m for i, (n, m, _, _) in gone.items() if n > m}
        elif k == 3:
            assert all(n == 0 for _, n, _ in contamination(after, [(1, leak)]).values())
            clean = {i: t for i, t in before if contamination([(i, t)], [(1, leak)])[i][1] == 0}
            assert {i: t for i, t in after if i in clean} == clean
        else:
            assert out.where("NOT lossless").count() == 0 and {r["doc_id"] for r in out.collect()} == {i for i, _ in before}
        docs, before = out, after
    assert pipeline.run(spark, sf_dir).count() == len(before)
