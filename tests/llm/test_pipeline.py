"""The pipeline over the smallest tables: every stage's rows follow from its predecessor's."""

import corpus_pipeline
from vocabulon.llm import neardup, packing, pii, quality
from vocabulon.llm.durable import written
from vocabulon.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, seen[-1], SF), name)
        if name != "best_fit_packing":
            assert out.columns == columns
        seen.append(out)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:], strict=False))
    kept = {r["doc_id"] for r in quality.judged(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert ids[1] == kept
    assert ids[2] == {r["doc_id"] for r in neardup.near_duplicates(seen[1]).where("doc_id = component_id").collect()}
    before = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert all(r["text"] == pii.redact(before[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in seen[3].collect())
    total = sum(r["length"] for r in packing.pieces(seen[4], tokenizer_path()).collect())
    assert seen[5].groupBy().sum("length").first()[0] == total
    assert seen[5].count() == corpus_pipeline.run(spark, SF).count()


def test_odd_rows_and_empty_tables_pass_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    few = docs.where("doc_id < 40")
    odd = few.where("doc_id < 3").unionByName(few.where("doc_id < 3").selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars"))
    odd = odd.unionByName(few.where("doc_id = 5").selectExpr("doc_id", "cast(null as string) as text", "lang", "cast(null as string) as source", "n_chars"))
    odd = odd.unionByName(few.where("doc_id = 9").selectExpr("cast(5 as bigint) as doc_id", "text", "cast(null as string) as lang", "source", "n_chars"))
    for name, table in (("odd", few.unionByName(odd)), ("empty", few.where("false"))):
        sf = f"{tmp_path}/{name}"
        table.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        rows = corpus_pipeline.run(spark, sf).collect()
        assert (len(rows) > 10) == (name == "odd")
        used = {}
        for r in rows:
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
