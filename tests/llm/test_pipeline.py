"""The pipeline's stages against plain versions, on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import linedup, minhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    path = str(tmp_path_factory.mktemp("sf"))
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    good = [text(80) + "\n" + text(60) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(200 + i, good[i]) for i in range(10)] + [(300 + i, good[i + 20].replace(" ", " x ", 1)) for i in range(10)] + [(400 + i, "BUY!! NOW!! " * 40) for i in range(80)] + [(500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not 400 <= i < 500)) for i, t in rows], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not any(400 <= i < 500 for i in ids) and set(range(120)) <= ids
    lines = corpus_pipeline.line_dedup(spark, kept, folder)
    assert lines.columns == docs.columns
    rows = {r["doc_id"]: r for r in lines.collect()}
    assert not any(200 <= i < 310 for i in rows) and all(rows[i]["n_chars"] == len(rows[i]["text"]) for i in range(120))
    near = corpus_pipeline.near_dedup(spark, kept, folder)
    assert near.columns == docs.columns and not any(200 <= r["doc_id"] < 310 for r in near.collect())
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.collect()} == {i for i in rows if i < 200 or i >= 500}


def test_stages_keep_other_columns(spark, folder):
    """Columns whose names the operators use themselves, and repeated rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clash = docs.unionByName(docs.where("doc_id = 5")).withColumns({"line": F.lit(1), "n": F.lit(2.5), "component_id": F.lit("c"), "score": F.lit(True), "g": F.lit(3), "label": F.lit(4), "h1": F.lit(5), "piece": F.lit(6)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left, plain = stage(spark, clash, folder), stage(spark, docs, folder)
        assert left.columns == clash.columns
        assert sorted(map(str, left.dropDuplicates(["doc_id"]).select(docs.columns).collect())) == sorted(map(str, plain.select(docs.columns).collect()))
        assert left.where("doc_id = 5").count() == 2
    pieces = corpus_pipeline.packing(spark, clash, folder)
    assert pieces.where("doc_id = 5").count() == 2 and pieces.select("doc_id").distinct().count() == docs.count()


def test_stages_on_nothing(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    assert linedup.drop_similar_lines(none).count() == 0 and minhash.drop_near_duplicates(none).count() == 0
