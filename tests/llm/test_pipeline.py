import corpus_pipeline as C
from specforge.llm.common import DOCUMENT_COLUMNS, written
from specforge.llm.packing import packed, vocabulary_path
from specforge.llm.quality import judged
from specforge.llm.secrets import secret_spans


def test_stages_hand_on_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(C.STAGES) - 1:
            assert tuple(out.columns) == DOCUMENT_COLUMNS
        out.write.parquet(str(tmp_path / name))
        seen.append(docs)
        docs = spark.read.parquet(str(tmp_path / name))
    first, kept, single, masked, mix = seen
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged(first).where("kept").collect()}
    assert single.groupBy("text").count().where("count > 1").count() == 0
    assert secret_spans(masked).where("n_access + n_hex > 0").count() == 0
    assert mix.select("doc_id").distinct().count() <= masked.count()
    assert docs.where("piece = 0").count() == mix.count() == packed(mix, vocabulary_path()).where("piece = 0").count()


def test_run_on_the_smallest_table(spark, sf_dir):
    assert C.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_on_odd_tables(spark, none, repeated, sf_dir):
    """Empty tables stay empty; null and repeated numbers and clashing columns go through every stage."""
    for name, stage in C.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
    n = repeated.count()
    docs = repeated
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns, name
        docs = out.cache()
        assert docs.count() > 0 and (k > 2 or docs.count() <= n)
        docs = written(docs, "odd") if k < len(C.STAGES) - 1 else docs


def test_registered_beside_the_queries():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is C.run and len([k for k in entry.queries() if k.startswith("op")]) == 10
