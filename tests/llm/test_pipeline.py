from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from hatospark.llm import queries, texts
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


def test_registered():
    numbers = [n.split("_")[0] for n in queries.QUERIES]
    assert numbers == [f"op{i}" for i in range(1, 14)]
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())


def test_stages_on_odd_and_empty_tables(spark, odd_documents, no_documents, tmp_path):
    """Clashing column names come through every stage with their values; empty tables stay empty."""
    odd = odd_documents.selectExpr(
        "* EXCEPT (_id, _version, _gone, row, place)",
        "'a' AS row", "doc_id AS _id", "1L AS _version", "2L AS _gone", "3L AS place",
    )
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, odd, SF)
        assert set(odd.columns) - {"size", "target"} <= set(kept.columns), name
        got = kept.select("doc_id", "row", "_id", "_version", "_gone", "place").collect()
        assert got and all(tuple(r) == (r.doc_id, "a", r.doc_id, 1, 2, 3) for r in got), name
        assert stage(spark, no_documents, SF).count() == 0, name
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    no_documents.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_broadcast_counts_the_numbers_of_its_rows(spark, monkeypatch):
    monkeypatch.setattr(texts, "BROADCAST_ROWS", 100)
    table = spark.range(20).select("id", F.sequence(F.lit(1), F.lit(10)).alias("h"))

    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString()

    assert hinted(texts.if_small(table)) and not hinted(texts.if_small(table, F.size("h")))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != "mix":
            assert sorted(docs.columns) == sorted(columns)
        if name == "quality":
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept[name] for i in good) / len(good) > 0.97
            assert sum(i in kept[name] for i, q in labels.items() if q == 0) < 0.3 * (len(labels) - len(good))
        if name == "lines":
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in docs.collect():
                assert r.n_chars == len(r.text) or r.text == texts[r.doc_id]
                assert set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n"))
        if name == "near_duplicates":
            prints = {r.doc_id: plain_fingerprint(r.text) for r in before.collect()}
            assert kept[name] == set(plain_components(prints).values())
    assert docs.filter("taken > 2 * size OR taken <= 0").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == kept["mix"]
