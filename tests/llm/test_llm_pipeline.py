"""The pipeline against its operators' plain counterparts, and on an empty table."""

import corpus_pipeline
from netfathom.llm import quality_classifier

from test_llm_operators import brute_components, brute_spans

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    seen = [texts(docs)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / str(k)))
            docs = spark.read.parquet(str(tmp_path / str(k)))
            seen.append(texts(docs))
        else:
            pieces = out.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.learn(spark.read.parquet(f"{SF}/documents.parquet"), quality_classifier.grades_of(labels))
    kept = {r["doc_id"] for r in quality_classifier.grade(spark.read.parquet(f"{SF}/documents.parquet"), model).where("selected").collect()}
    assert set(seen[1]) == kept
    assert set(seen[2]) == {i for i, (_, c) in brute_components(seen[1], 5, 80).items() if i == c}
    assert set(seen[4]) == set(seen[3]) <= set(seen[2])
    assert not any(brute_spans(t) for t in seen[4].values())
    assert {r["doc_id"] for r in pieces} == set(seen[4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, pieces))


def test_empty_table_passes(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        empty = stage(spark, empty, SF)
        assert empty.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[4][1](spark, empty, SF).count() == 0
