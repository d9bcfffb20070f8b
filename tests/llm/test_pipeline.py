"""The pipeline: stages keep the columns and take effect."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinoframe.llm import queries
from kinoframe.llm.shards import written
from tests.llm.fixtures import words
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns, name
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[2] == n[1]
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k:k + 10]) for w in items for k in range(len(w) - 9)}
    for r in docs.collect():
        w = words(r["text"])
        assert not any(tuple(w[k:k + 10]) in windows for k in range(len(w) - 9))
        assert r["n_chars"] == len(r["text"])
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n[-1] and {"doc_id", "n_tokens", "ids_sha256"} <= set(last.columns)


def test_documents_without_lines_of_their_own_go(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 200").limit(1)
    row = given.first().asDict()
    text = "the first long line of this text stands here\nand a second one follows it at once"
    rows = [row | {"doc_id": k, "text": t, "n_chars": len(t or "")} for k, t in
            enumerate([text, text, text + "\n!!", text + "\nshort", "", None, "..."])]
    docs = spark.createDataFrame([tuple(r[c] for c in given.columns) for r in rows], given.schema).coalesce(1)
    kept = written(corpus_pipeline.drop_lines(spark, docs, SF), "test-stage")
    assert kept.columns == docs.columns and kept.count() == len(rows)
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_near_duplicates(spark, kept, SF).collect()}
    assert left == {0: text, 3: "short", 4: "", 5: "", 6: "..."}


def test_stages_keep_columns_named_as_results(spark):
    names = ["score", "predicted", "held_out", "n_lines", "n_removed", "kept"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({n: F.lit("mine") for n in names})
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = written(stage(spark, docs, SF), "test-stage")
        assert docs.count() and docs.where(" or ".join(f"{n} <> 'mine'" for n in names)).isEmpty()


def test_stages_take_empty_tables_and_awkward_texts(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.drop_lines(spark, corpus_pipeline.drop_toxic(spark, given.limit(0), SF), SF).columns == given.columns
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate([None, "", " \n", "a", "\u00e9" * 400, "x " * 30000])]
    docs = spark.createDataFrame(rows, given.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "test-stage")
    assert {r["doc_id"] for r in docs.collect()} == {0, 1, 2, 3, 4, 5}


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    res = compare(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF, duck(SF))
    assert res["ok"], res
