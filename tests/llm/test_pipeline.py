"""The pipeline's stages, and the guard around the subpackage."""

import corpus_pipeline
from tests.llm import fixtures


def test_stages_and_run(spark, tmp_path):
    rows = fixtures.documents(n=80)
    docs = fixtures.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    fixtures.save(docs, tmp_path, "documents")
    fixtures.save(spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "personal_data", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert all(r.n_chars == len(r.text) for r in now.collect())
    left = {r.doc_id for r in now.collect()}
    assert 20 not in left or 10 not in left  # exact copies
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == left


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names


def test_every_query_runs(spark, tmp_path):
    from storyloom.llm.registry import QUERIES

    docs = fixtures.frame(spark, fixtures.documents() + fixtures.documents()[:2] + [(None, "no id", "en", "s", 0, "", "", 0)])
    fixtures.save(docs, tmp_path, "documents")
    fixtures.save(spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) toxic"), tmp_path, "labels")
    fixtures.save(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, None, None)], "conv_id long, turn long, role string, text string"), tmp_path, "conversations")
    n = docs.count()
    for name, query in QUERIES.items():
        found = query(spark, str(tmp_path))
        assert found.count() == (3 if name == "op5_chat" else n) or name == "op9_packing" and found.where("piece = 0").count() == n, name
