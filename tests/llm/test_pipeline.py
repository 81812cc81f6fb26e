import sys
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from tabrisk.llm import mixing, queries, secrets, simhash, toxicity  # noqa: E402
from tabrisk.llm.spark_util import written  # noqa: E402
from tests.llm.test_packing import check  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):  # on the smallest table with secrets
    """Each stage's decisions, from the operator's own report on the stage's input."""
    SF = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "stage-test")
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "toxicity":
            chain = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r["doc_id"] for r in toxicity.score(docs, chain).collect() if not r["rejected"]}
            assert {r["doc_id"] for r in after} == want and len(after) < len(before)
        elif name == "simhash_near_dedup":
            want = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
            assert sorted(r["doc_id"] for r in after) == sorted(want) and len(after) < len(before)
        elif name == "secret_scans":
            assert len(after) == len(before)
            assert not secrets.scan_versions(out).where("spans != ''").collect()
            had = {r["doc_id"] for r in secrets.scan_versions(docs).where("spans != ''").collect()}
            was = {r["doc_id"]: r["text"] for r in before}
            assert had and {r["doc_id"] for r in after if r["text"] != was[r["doc_id"]]} == had
            assert all(r["n_chars"] == len(r["text"]) for r in after if r["doc_id"] in had)
        elif name == "mixing":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in mixing.mix(docs).where("kept").collect()}
            assert len(after) >= 0.7 * len(before)
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
            check(tokenizer, [(r["doc_id"], r["text"]) for r in before], after)
        docs = out


def test_run_gives_the_stages_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage-test")
    key = lambda r: (r["doc_id"], r["start"])
    assert sorted(corpus_pipeline.run(spark, SF).collect(), key=key) == sorted(docs.collect(), key=key)


def test_pipeline_on_an_empty_and_an_odd_table(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = [(1, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (None, "words of a text", "en", None, 15),
           (2, "the same words " * 20, "en", "a", 1), (3, "the same words " * 20, "en", "a", 1)]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, rows in enumerate(([], odd)):
        folder = str(tmp_path / str(k))
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert bool(got) == bool(rows)


def test_columns_of_any_name_stay(spark):
    """Names that stages use inside come through with their values."""
    clash = ["_row", "row_key", "row_digest", "_spans", "spans", "_p", "p", "_source", "_lang", "_topic", "_tokens", "_docs_blob", "docs_blob", "_id", "id",
             "_blob", "blob", "blob_id", "fp", "y", "content", "_own", "rejected", "weight"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), "clash-test")
        assert out.columns == docs.columns, name
        rows = out.select("doc_id", *clash).collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in clash), name
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
