import corpus_pipeline as P
from tempoloom.llm import decontaminate, exact_dedup, language_id, near_dedup
from tempoloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        ids, old = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= old and len(ids) > 0.5 * len(old)
        if name == "exact_dedup":
            assert old - ids == {r.doc_id for r in exact_dedup.exact_copies(before).collect()} and after.count() == after.select("text").distinct().count()
        if name == "minhash_near_dedup":
            assert old - ids == {r.doc_id for r in near_dedup.near_copies(before).collect()}
        if name == "decontaminate":
            assert decontaminate.contaminated(after, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if k < len(P.STAGES) - 1:
            assert after.columns == columns
            before = after
    assert all(r.text == t for r, t in zip(after.orderBy("doc_id").collect(), [r.text for r in before.orderBy("doc_id").collect()]))
    assert P.run(spark, SF).count() == after.count()


def test_ten_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and language_id.TRAIN_DOCS
