import re

import corpus_pipeline
from quillgraph.llm import mixing


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path, small):
    for name in ("benchmark",):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text
    own = docs.where("doc_id = 1").first()
    odd = [(9001, "?? 123", "en", "src1", 6), (9002, own.text + " tail", "en", "src1", 9), (9003, f"{own.text[::-1]} {item}", "en", "src2", 9), (9004, None, None, None, None)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    frames, now = [before], before
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        frames.append(now)
    assert all(f.columns == before.columns for f in frames[:-1])
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in frames]
    assert {9001, 9004} <= ids[0] - ids[1] and len(ids[0] - ids[1]) <= 3
    assert 9002 in ids[1] - ids[2] and 1 in ids[2]
    assert 9003 in ids[2] - ids[3]
    assert ids[3] == ids[4]
    private = re.compile(r"\S+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)")
    found = lambda f: {m for r in f.select("text").collect() for m in private.findall(r.text)}
    assert found(frames[3]) and not found(frames[3]) & found(frames[4])
    words = lambda f: f.select(mixing.word_count("text").alias("n")).groupBy().sum().first()[0]
    assert abs(words(frames[5]) - words(frames[4])) <= 0.05 * words(frames[4])


def test_run_equals_the_stages(spark, small):
    once = corpus_pipeline.run(spark, small)
    again = corpus_pipeline.run(spark, small)
    assert once.columns[-1] == "epoch" and once.count() == again.count() > 0
    assert once.exceptAll(again).count() == 0
