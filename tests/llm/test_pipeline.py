import os
from collections import Counter

import pytest

import corpus_pipeline
from quarry.llm import langid, minhash, pieces

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the provided tables")
def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[2] < seen[1] and seen[4] < seen[3] and seen[5] == seen[4]
    rows = docs.collect()
    assert all(r.round_trip for r in rows)
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()), key=str) == sorted((tuple(r) for r in rows), key=str)
    # what the last stages took: texts without near duplicates among them
    texts = spark.read.parquet(str(tmp_path / "decontamination"))
    assert minhash.near_duplicates(spark, texts).where("not kept").count() == 0
    codec = pieces.Codec(pieces.load_vocabulary(corpus_pipeline.MODEL_PATH))
    by_id = Counter((r.doc_id, tuple(r.ids)) for r in rows)
    assert by_id == Counter((r.doc_id, tuple(codec.encode(r.text).tolist())) for r in texts.collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the provided tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(spark, docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 13)}
    assert set(entry.oracle_sql()) <= set(names)
