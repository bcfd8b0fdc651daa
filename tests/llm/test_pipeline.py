"""The stages against the operators they call, on a small corpus."""

import pytest
from test_operators import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = corpus(3, 80)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, int(bool(t) and len(t) > 200), 0) for d, t, *_ in rows[:100]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, sf):
    import corpus_pipeline as p
    from brookline.llm.ngram_join import ngram_jaccard_join
    from brookline.llm.quality_rules import quality_rules

    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in p.STAGES[:3]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == p.COLUMNS
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    first, second, third = kept
    assert third < second <= first
    before = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id in ({','.join(map(str, first))})")
    assert second == {r.doc_id for r in quality_rules(before).where("kept").collect()}
    members = ngram_jaccard_join(before.where(f"doc_id in ({','.join(map(str, second))})")).collect()
    assert third == {r.component_id for r in members}
    assert docs.count() == len(third)
    packed = p.packing(spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == third


def test_run_and_empty(spark, sf, tmp_path):
    import corpus_pipeline as p

    assert p.run(spark, sf).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
