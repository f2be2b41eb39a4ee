import corpus_pipeline
from pyspark.sql import functions as F
from test_near_copies import brute

from sigloom.llm import exact_dedup, langid, mixing, packing
from sigloom.llm.queries import tokenizer_path


def test_stages_feed_each_other(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            known = {r.doc_id for r in langid.identify(before).filter((F.col("lang_pred") != "und") & (F.col("score") >= corpus_pipeline.LEAST_SCORE)).collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == known
        if k == 1:
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in exact_dedup.exact_groups(before).filter("kept").collect()}
        if k == 2:
            least, _ = brute({r.doc_id: r.text for r in before.select("doc_id", "text").collect()})
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {k for k in least if least[k] == k}
        if k == 3:
            copies = {r.doc_id: r.copies for r in mixing.mix(before, mixing.word_count(F.col("text"))).collect() if r.copies}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == copies
        if k == 4:
            assert docs.agg(F.sum("length")).first() == packing.pack_documents(before, tokenizer_path()).agg(F.sum("length")).first()
    assert sizes[0] > sizes[2] >= sizes[3] > 0 and sizes[5] > 0


def test_run_gives_the_last_stage_and_leaves_nothing_else(spark, sf_dir):
    from pathlib import Path

    held = lambda: {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).iterdir()}
    before = held()
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and [n.rsplit("-", 1)[0] for n in held() - before] == ["pipeline-packing"]
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
